"""Defined results at the edges: nulls, repeats, retries and missing parts."""

import zipfile

import pytest

from headway.operators import criticality, forecast
from headway.sources import feed, frames


def test_rank_percentiles(spark):
    """Index int(q (n - 1)) of the values that are not null, with keys and without."""
    rows = [("a", float(v)) for v in range(10)] + [("a", None)] * 5 + [("b", 7.0)] * 1000 + [("b", 9.0)] + [(None, 1.0), ("c", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    got = {r.k: (r.p50, r.p95, r.p99) for r in forecast.rank_percentiles(df, "v", keys=("k",)).collect()}
    assert got == {"a": (4.0, 8.0, 8.0), "b": (7.0, 7.0, 7.0), None: (1.0, 1.0, 1.0)}
    assert tuple(forecast.rank_percentiles(df.where("k = 'a'"), "v").first()) == (4.0, 8.0, 8.0)
    assert tuple(forecast.rank_percentiles(df.limit(0), "v").first()) == (None, None, None)


def test_frames_of_a_wrong_time(spark):
    """A reading of a wrong time becomes a dead letter and stops nothing."""
    df = spark.createDataFrame([(1, 1_700_000_000, 5.0), (1, 1_700_000_002, 6.0), (1, 0, 5.0), (2, None, 1.0)], "station int, ts long, delay double")
    assert sorted(map(tuple, forecast.frames(df, 1).collect())) == [(1, 1_700_000_000, 5.0, True), (1, 1_700_000_001, 5.0, False), (1, 1_700_000_002, 6.0, True)]
    assert sorted((r.station, r.ts, r.reason) for r in forecast.wrong_times(df, 1).collect()) == [(1, 0, "wrong time"), (2, None, "wrong time")]
    assert forecast.frames(df.limit(0)).collect() == forecast.wrong_times(df.limit(0)).collect() == []


def test_interval_join_repeats(spark):
    """Events that share an id stay apart."""
    c = spark.createDataFrame([(1, 1, 1000, "x"), (1, 2, 500_000, "x")], "station int, seq long, event_time_ms long, event_id string")
    p = spark.createDataFrame([(1, 3, 2000, "p", 0.5)], "station int, seq long, event_time_ms long, event_id string, escalation double")
    got = sorted((r.seq, r.prediction_id, r.lag_ms) for r in criticality.interval_join(c, p, 60_000).collect())
    assert got == [(1, "p", 1000), (2, None, -1)]


def test_interval_totals_are_those_of_all_pairs(spark):
    """counts and lags without the pairs; repeats, ends of the window, missing stations and times."""
    import random

    rng = random.Random(5)
    event = lambda k: (rng.choice([1, 2, None]), k, rng.choice([None, *range(0, 400, 10)]), f"e{k}")
    c = spark.createDataFrame([event(k) for k in range(150)] + [(3, 900, 5, "far")], "station int, seq long, event_time_ms long, event_id string")
    p = spark.createDataFrame([(*event(k), 0.5) for k in range(80)] + [(3, 901, 66, "p", 0.5)], "station int, seq long, event_time_ms long, event_id string, escalation double")
    from collections import Counter

    n, pairs, lags = Counter(), Counter(), Counter()
    for r in criticality.interval_join(c, p, 60).collect():
        key = (r.station, r.event_time_ms)
        pairs[key] += r.prediction_id is not None
        lags[key] += r.lag_ms if r.prediction_id is not None else 0
    for r in c.collect():
        n[r.station, r.event_time_ms] += 1
    got = {(r.station, r.event_time_ms): (r.cascades, r.cascades * r.pairs, r.cascades * r.lag_ms) for r in criticality.interval_totals(c, p, 60, parts=5).collect()}
    assert got == {key: (n[key], pairs[key], lags[key]) for key in n}


def test_retried_batch(spark, tmp_path):
    raw = spark.createDataFrame([("POSITION", '{"trip_id":"T","lat":1,"lon":2}'), ("POSITION", "no json")], "kind string, body string")
    rows = frames.normalize_positions(raw, spark.createDataFrame([("q", 1)], "stop_id string, station int"), 5)
    for _ in range(2):
        frames.write_routed(rows, str(tmp_path), 5, "b1")
    frames.write_routed(rows, str(tmp_path), 5, "b2")
    assert spark.read.parquet(f"{tmp_path}/events").count() == 2 and spark.read.parquet(f"{tmp_path}/dead_letters").count() == 2


def test_zip_without_a_member(spark, tmp_path):
    path = str(tmp_path / "feed.zip")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("stops.txt", "stop_id,stop_name\n1,A\n")
    assert feed.read_table(spark, path, "stops").count() == 1 and feed.read_table(spark, path, "shapes").count() == 0
    with pytest.raises(Exception, match="trips.txt is not in"):
        feed.read_table(spark, path, "trips").collect()


def test_a_large_member_is_read_in_batches(spark, tmp_path):
    """Columns in another order, blank and missing values, quotes, and a filter that the source applies itself."""
    path = str(tmp_path / "feed.zip")
    lines = ["stop_name, stop_id,zone\r\n", '"A, ""b""",S0,1\r\n', ",S1\r\n"] + [f"N{k},S{k}\r\n" for k in range(2, 45_000)]
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("in/side/stops.txt", "\ufeff" + "".join(lines))
    stops = feed.read_table(spark, path, "stops")
    assert stops.count() == 45_000 and stops.columns == feed.COLUMNS["stops"]
    few = stops.where("stop_id in ('S0', 'S1', 'S44999')")
    assert sorted((r.stop_id, r.stop_name, r.parent_station) for r in few.collect()) == [("S0", 'A, "b"', None), ("S1", None, None), ("S44999", "N44999", None)]


def test_scratch_goes_with_its_block(spark):
    from headway.functions.tables import saved, scratch

    kept = saved(spark.range(3))
    with scratch(spark):
        inner = saved(spark.range(4))
        assert inner.count() == 4
        path = inner.inputFiles()[0]
    assert kept.count() == 3
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
        spark.read.parquet(path).count()
