"""Golden values of hand-made networks and frames."""

import json

import pytest
from pyspark.sql import functions as F

from headway.functions.parsing import clock_seconds, epoch_ms, seconds_of
from headway.operators import boards, cascade, criticality, forecast, graph, journeys, network
from headway.sources import feed, frames

NOW = 1_700_000_000_000


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def chain(spark):
    edges = spark.createDataFrame([(0, 1, 120, 60), (1, 2, 120, 60), (2, 3, 120, 60)], "src int, dst int, run_sec int, run_slack_sec int")
    dwell = spark.createDataFrame([(1, 30), (2, 30), (3, 30)], "station int, dwell_slack_sec int")
    walks = spark.createDataFrame([(2, 4, 120, 100)], "src int, dst int, min_sec int, slack_sec int")
    return edges, dwell, walks


def test_cascade(spark, chain):
    sources = spark.createDataFrame([("a", 0, 300), ("b", 0, 100), ("c", 0, 0), ("d", 999, 300), ("e", 0, 300)], "source_id string, station int, delay int")
    got = cascade.propagate(sources, *chain)
    full = [(0, 300, 0, False, 0), (1, 210, 90, False, 1), (2, 120, 180, False, 2), (3, 30, 270, False, 3), (4, 20, 280, True, 3)]
    assert rows(got) == sorted([("a", *r) for r in full] + [("e", *r) for r in full] + [("b", 0, 100, 0, False, 0), ("b", 1, 10, 90, False, 1)], key=str)
    summary = {r.source_id: r for r in cascade.cascade_summary(got, 5).collect()}
    assert summary["a"].stations_hit == 5 and summary["a"].missed == 1 and summary["a"].network_share == 1.0 and summary["b"].max_hop == 1


def test_zero_slack_ties(spark):
    edges = spark.createDataFrame([(0, 1, 1, 0), (1, 2, 1, 0), (2, 1, 1, 0)], "src int, dst int, run_sec int, run_slack_sec int")
    none = spark.createDataFrame([], "station int, dwell_slack_sec int")
    walks = spark.createDataFrame([], "src int, dst int, min_sec int, slack_sec int")
    got = cascade.propagate(spark.createDataFrame([("a", 0, 9)], "source_id string, station int, delay int"), edges, none, walks)
    assert rows(got) == [("a", 0, 9, 0, False, 0), ("a", 1, 9, 0, False, 1), ("a", 2, 9, 0, False, 2)]


def trips(spark, *stops):
    data = [(f"{name}", 0, pos, s, a, dep) for name, calls in stops for pos, (s, a, dep) in enumerate(calls)]
    return spark.createDataFrame(data, "pattern_id string, trip_no int, pos int, station int, arr_sec int, dep_sec int")


def direct(name, a, b, dep, arr):
    return name, [(a, dep, dep), (b, arr, arr)]


def test_journeys(spark):
    walks = spark.createDataFrame([(2, 5, 60, 0)], "src int, dst int, min_sec int, slack_sec int")
    times = trips(spark, direct("X", 0, 2, 28800, 32400), direct("Y", 0, 1, 28800, 30000), direct("Z", 1, 2, 30300, 31200))
    q = spark.createDataFrame([("q", 0, 2, 28800), ("same", 1, 1, 5), ("none", 2, 0, 0), ("walk", 0, 5, 28800)], "query_id string, origin int, dest int, departure_sec int")
    assert rows(journeys.plan(q, times, walks)) == [("q", 31200, 1), ("q", 32400, 0), ("same", 5, 0), ("walk", 31260, 1), ("walk", 32460, 0)]
    assert [r[2] for r in rows(journeys.plan(q.where("query_id = 'q'"), times, walks, 1))] == [0]
    legs = rows(journeys.paths(q, times, walks))
    assert [x for x in legs if x[0] == "walk"] == [("walk", 0, "RIDE", 0, 1, 28800, 30000), ("walk", 1, "RIDE", 1, 2, 30300, 31200), ("walk", 2, "WALK", 2, 5, 31200, 31260)]
    assert not [x for x in legs if x[0] in ("none", "same")]
    shapes = spark.createDataFrame([(0, 1, [(0.0, 0.0), (0.5, 0.0), (1.0, 0.0)])], "src int, dst int, path array<struct<lon:double,lat:double>>")
    nodes = spark.createDataFrame([(k, float(k), 0.0) for k in (0, 1, 2, 5)], "station int, lon double, lat double")
    shape = {(r.query_id, r.leg): [p.lon for p in r.shape] for r in journeys.leg_shapes(journeys.paths(q, times, walks), times, shapes, nodes).collect()}
    assert shape["walk", 0] == [0.0, 0.5, 1.0] and shape["walk", 1] == [1.0, 2.0] and shape["walk", 2] == [2.0, 5.0]


def test_staircase(spark):
    local = ("LOCAL", [(k, k * 360, k * 360 + 30) for k in range(100)])
    times = trips(spark, local, direct("DIRECT", 0, 99, 0, 9000), direct("FEED", 0, 50, 0, 2000), direct("EXP", 50, 99, 2100, 4000), direct("A", 0, 33, 0, 1000), direct("B", 33, 66, 1100, 2000), direct("C", 66, 99, 2100, 3000))
    walks = spark.createDataFrame([], "src int, dst int, min_sec int, slack_sec int")
    q = spark.createDataFrame([("q", 0, 99, 0)], "query_id string, origin int, dest int, departure_sec int")
    assert rows(journeys.plan(q, times, walks)) == [("q", 3000, 2), ("q", 4000, 1), ("q", 9000, 0)]
    assert rows(journeys.plan(q, times, walks, 2)) == [("q", 4000, 1), ("q", 9000, 0)]


def test_path_graph(spark):
    edges = spark.createDataFrame([(0, 1, 120, 0), (1, 2, 120, 0)], "src int, dst int, run_sec int, run_slack_sec int")
    nodes = spark.createDataFrame([(0,), (1,), (2,)], "station int")
    lap = graph.laplacian(graph.kernel_weights(graph.undirected(edges)), nodes)
    values = {(r.row, r.col): r.val for r in lap.collect()}
    assert len(values) == 7 and values[0, 0] == 1 and abs(values[0, 1] + 0.5**0.5) < 1e-9 and (0, 2) not in values
    largest = graph.lambda_max(lap, nodes, 60)
    assert abs(largest - 2) < 1e-6
    assert all(-1 - 1e-6 <= r.val <= 1 + 1e-6 for r in graph.scaled_laplacian(lap, largest).collect())


def test_pagerank(spark):
    edges = spark.createDataFrame([(0, 1, 1), (2, 1, 1)], "src int, dst int, run_sec int")
    nodes = spark.createDataFrame([(0, ["A"]), (1, ["A"]), (2, ["B"])], "station int, lines array<string>")
    ranks = {r.station: r.pagerank for r in graph.pagerank(edges, nodes, iterations=20).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9 and ranks[1] > ranks[0] == ranks[2]
    directives = spark.createDataFrame([("line", "A", 3.0), ("station", "2", 0.0), ("station", "9", 2.0), ("zone", "1", 2.0), ("line", "A", -1.0)], "target string, id string, weight double")
    again, rejected = graph.rerank(edges, nodes, directives, 10)
    assert rejected.count() == 3 and {r.station: r.pagerank for r in again.collect()}[2] == 0


def joined(spark, events, window=60_000, **options):
    schema = "seq long, side string, station int, event_time_ms long, event_id string, delay double, missed boolean, escalation double"
    data = [(k, side, station, t, f"{side}{k}", 60.0, False, 0.5) for k, (side, station, t) in enumerate(events)]
    df = spark.createDataFrame(data, schema)
    out = criticality.window_join(df.where("side = 'c'"), df.where("side = 'p'"), window, **options)
    return sorted((r.cascade_id, r.prediction_id, r.lag_ms) for r in out.collect())


def test_window_join(spark):
    assert joined(spark, [("c", 5, 1000), ("p", 5, 30000)]) == [("c0", "p1", 29000)]
    assert joined(spark, [("p", 7, 5000), ("c", 7, 40000)]) == [("c1", "p0", 35000)]
    assert joined(spark, [("c", 3, 1000), ("p", 3, 90000)], emit_unjoined=False) == []
    assert joined(spark, [("c", 3, 1000), ("p", 4, 1000)], emit_unjoined=False) == []
    assert joined(spark, [("p", 9, 10000), ("c", 9, 20000), ("c", 9, 30000)]) == [("c1", "p0", 10000), ("c2", "p0", 20000)]
    assert joined(spark, [("c", 2, 1000)]) == [("c0", None, -1)]
    assert joined(spark, [("c", 2, 1000), ("c", 2, 2000), ("p", 2, 3000)]) == [("c0", None, -1), ("c1", "p2", 1000)]
    assert joined(spark, [("c", 2, 1000), ("c", 2, 2000), ("p", 2, 3000)], on_replace="drop") == [("c1", "p2", 1000)]


def test_score(spark):
    ranks = spark.createDataFrame([(1, 0.5), (2, 0.25)], "station int, pagerank double")
    events = spark.createDataFrame([(1, 120.0, True, 0.5), (2, -5.0, False, 7.0), (3, 60.0, None, None)], "station int, delay double, missed boolean, escalation double")
    got = {r.station: r.total for r in criticality.score(events, ranks).collect()}
    assert got == {1: 2 * (2 + 2 + 1.5), 2: 1.5 * 3.0, 3: 1.0}


def test_forecast(spark):
    data = spark.createDataFrame([(1, 0, 100.0, "t"), (1, 130, 0.0, "t"), (2, 60, 50.0, None)], "station int, ts long, delay double, trip_id string")
    framed = forecast.frames(data)
    assert rows(framed.select("station", "frame", "delay")) == [(1, 0, 100.0), (1, 1, 100.0), (1, 2, 0.0), (2, 0, 0.0), (2, 1, 50.0), (2, 2, 50.0)]
    late = forecast.escalation(forecast.rolling_history(framed)).collect()
    assert len(late) == 2 and all(r.fallback_used and abs(r.escalation_ratio - 0.1) < 1e-9 and r.quantiles[2].delay_seconds > r.quantiles[1].delay_seconds for r in late)
    assert rows(forecast.frames(data, max_age_frames=0).where("frame = 2 and station = 2").select("delay")) == [(0.0,)]


MAPPED = [
    ({"trip_id": "T", "vehicle_id": "V", "lat": 48.8443, "lon": 2.3, "delay_seconds": 125, "timestamp": 1700000000}, None, 125.0, None, 1700000000000),
    ({"VehicleJourneyRef": "T", "Position": {"Latitude": 48.8, "Longitude": 2.3}, "Delay": "PT2M30S", "RecordedAtTime": "2023-11-14T22:13:20Z"}, None, 150.0, None, 1700000000000),
    ({"lat": 1, "lon": 2}, "missing trip id", 0.0, None, NOW),
    ({"trip_id": "T"}, "no place", 0.0, None, NOW),
    ({"trip_id": "T", "stop_id": "IDFM:463685"}, None, 0.0, 42, NOW),
    ({"trip_id": "T", "MonitoringRef": "8775810"}, None, 0.0, 7, NOW),
    ({"trip_id": "T", "station_id": 95}, None, 0.0, 95, NOW),
    ({"trip_id": "T", "lat": 1, "lon": 2, "stop_id": "nowhere"}, None, 0.0, None, NOW),
    ({"trip_id": "T", "stop_id": "StopPoint:Q:8775810"}, None, 0.0, 7, NOW),
    ({"trip_id": "T", "stop_id": "x:", "stationId": "12"}, None, 0.0, 12, NOW),
]


def test_positions(spark):
    stops = spark.createDataFrame([("IDFM:463685", 42), ("8775810", 7)], "stop_id string, station int")
    raw = [("POSITION", json.dumps(b)) for b, *_ in MAPPED] + [("POSITION", '{"trip_id":"BROKEN", not json')]
    got = frames.normalize_positions(spark.createDataFrame(raw, "kind string, body string"), stops, NOW)
    by = {r.body: r for r in got.collect()}
    for body, reason, delay, station, time in MAPPED:
        r = by[json.dumps(body)]
        assert (r.reason, r.delay_seconds, r.station_id, r.event_time_ms) == (reason, delay, station, time), body
    assert frames.accepted(got).count() + frames.dead_letters(got, NOW).count() == len(raw)
    assert [r.body for r in frames.dead_letters(got, NOW).collect() if "BROKEN" in r.body] == [raw[-1][1]]


def test_batches_and_incidents(spark):
    raw = spark.createDataFrame([("INCIDENT", '[{"lines":"A","stations":[1,"x",3],"level":"high"},{"trip_id":"T"}]'), ("INCIDENT", '{"level":"low"}'), ("INCIDENT", "[broken")], "kind string, body string")
    got = frames.normalize_incidents(frames.unnested(raw), NOW)
    assert sorted((r.key or "", r.reason or "", tuple(r.impacted_station_ids)) for r in got.collect()) == [("", "malformed json", ()), ("", "no trip or line", ()), ("A", "", (1, 3)), ("T", "", ())]


def test_realtime(spark):
    schema = "id string, header_ts long, trip_update struct<trip_id:string,route_id:string,timestamp:long,stop_time_updates:array<struct<stop_id:string,arrival_delay:int,departure_delay:int>>>, vehicle struct<trip_id:string,route_id:string,lat:double,lon:double,bearing:double,speed:double,stop_id:string,timestamp:long>"
    data = [("1", 5, ("t1", "r", None, [("a", 9, None), ("b", 1, 240)]), None), ("2", 5, ("t2", "r", 7, [("a", None, None), ("b", 60, None)]), None), ("3", 5, ("t3", "r", 7, [("a", None, None)]), None), ("4", 5, None, ("t4", "r", 1.0, 2.0, 3.0, 10.0, None, None))]
    got = {r.trip_id: r for r in frames.realtime_frames(spark.createDataFrame(data, schema), "rt").collect()}
    assert set(got) == {"t1", "t2", "t4"} and (got["t1"].stop_id, got["t1"].delay_seconds, got["t1"].event_time_ms) == ("b", 240.0, 5000)
    assert got["t2"].delay_seconds == 60.0 and got["t4"].speed_kmh == 36.0


def test_expressions(spark):
    df = spark.createDataFrame([("25:01:02",), ("7:05",), ("x",), (None,), ("-PT1H",), ("1700000000",)], "s string")
    got = df.select(clock_seconds(F.col("s")).alias("c"), seconds_of(F.col("s")).alias("d"), epoch_ms(F.col("s")).alias("e")).collect()
    assert [r.c for r in got][:4] == [90062, 25500, None, None] and got[4].d == -3600.0 and got[5].e == 1700000000000


FEED = {
    "stops": '﻿stop_id,stop_name,stop_lat,stop_lon,location_type,parent_station\nS1,"One, the first",48.0,2.0,1,\nP1,One p,48.0,2.0,0,S1\nS2,Two,48.0,2.1,1,\nS3,Three,48.0,2.2,1,\nS9,Unseen,0,0,1,\n',
    "routes": "route_id,route_short_name,route_long_name,route_type\nR1,a,,2\nR2,B,,3\n",
    "trips": "route_id,service_id,trip_id,shape_id\nR1,x,T1,H\nR1,x,T2,H\nR1,x,T3,\nR2,x,T4,\n",
    "stop_times": "trip_id,arrival_time,departure_time,stop_id,stop_sequence\nT1,08:00:00,08:00:00,P1,1\nT1,08:05:00,08:06:00,S2,2\nT1,08:10:00,,S3,3\nT2,24:00:00,24:00:00,P1,1\nT2,24:07:00,24:09:00,S2,2\nT2,24:14:00,24:14:00,S3,3\nT3,09:00:00,09:00:00,S1,1\nT4,09:00:00,09:00:00,S9,1\nT4,09:10:00,09:10:00,S1,2\n",
    "transfers": "from_stop_id,to_stop_id,transfer_type,min_transfer_time\nS1,S2,2,\nS1,S9,2,60\nS1,P1,2,60\n",
    "shapes": "shape_id,shape_pt_lat,shape_pt_lon,shape_pt_sequence\nH,48.0,2.2,1\nH,48.01,2.15,2\nH,48.0,2.1,3\nH,48.0,2.05,4\nH,48.0,2.0,5\n",
}


def test_feed(spark, tmp_path):
    import zipfile

    for name, text in FEED.items():
        (tmp_path / f"{name}.txt").write_text(text, encoding="utf-8")
    with zipfile.ZipFile(tmp_path / "feed.zip", "w") as z:
        for name, text in FEED.items():
            z.writestr(f"nested/{name}.txt", text)
    for name in FEED:
        assert rows(feed.read_table(spark, str(tmp_path / "feed.zip"), name)) == rows(feed.read_table(spark, str(tmp_path), name))
    assert feed.read_table(spark, str(tmp_path), "stops").where("stop_id = 'S1'").first().stop_name == "One, the first"
    t = {name: feed.read_table(spark, str(tmp_path), name) for name in FEED}
    calls = network.timetable(t["stops"], t["routes"], t["trips"], t["stop_times"], lines=("A",))
    seen = network.stations(calls)
    assert rows(seen.select("station", "stop_id", "lines")) == [(0, "S1", ["a"]), (1, "S2", ["a"]), (2, "S3", ["a"])]
    calls = calls.join(seen.select("station", "stop_id"), "stop_id")
    assert rows(network.edges(calls)) == [(0, 1, 300, 60), (1, 2, 240, 30)]
    assert rows(network.dwell(calls)) == [(1, 30)]
    assert rows(network.transfers(t["transfers"], t["stops"], seen)) == [(0, 1, 120, 120), (1, 0, 120, 120)]
    kinds, times = network.patterns(calls)
    assert [(r.n_stops, r.n_trips) for r in kinds.collect()] == [(3, 2)] and rows(network.pattern_stops(times).select("pos", "station")) == [(0, 0), (1, 1), (2, 2)]
    paths = {(r.src, r.dst): [p.lon for p in r.path] for r in network.geometry(calls, t["shapes"]).collect()}
    assert paths == {(0, 1): [2.0, 2.05, 2.1], (1, 2): [2.1, 2.15, 2.2]}
    board = boards.departures(times, kinds, 8 * 3600, 6 * 3600)
    assert rows(board.select("station", "dep_sec", "terminus")) == [(0, 28800, 2), (1, 29160, 2)]
    message = boards.display_messages(board, seen, "2024-01-15").orderBy("message_id").first()
    assert (message.subject, message.body, message.valid_to_ms) == ("piv/idf/0/a", "08:00", 1705302000000)
    assert network.display_station(spark.createDataFrame([("piv/idf/12/A",), ("x",)], "subject string")).orderBy("station").first().station == -1


def test_ranks_by_powers_equal_plain_rounds(spark, monkeypatch):
    """However many steps a join takes, and from whatever start, the ranks are those of plain rounds."""
    import random

    rng = random.Random(2)
    n, links = 30, sorted({(rng.randrange(25), rng.randrange(30)) for _ in range(70)})
    edges = spark.createDataFrame(links, "src int, dst int")
    nodes = spark.createDataFrame([(k,) for k in range(n)], "station int")
    tele, begin = [(k % 4 + 1) / sum(j % 4 + 1 for j in range(n)) for k in range(n)], [(k % 3) / sum(j % 3 for j in range(n)) for k in range(n)]
    personal = spark.createDataFrame(list(enumerate(tele)), "station int, teleport double")
    start = spark.createDataFrame(list(enumerate(begin)), "station int, pagerank double")
    out = {k: [d for s, d in links if s == k] for k in range(n)}

    def plain(x, rounds):
        for _ in range(rounds):
            dead = sum(x[k] for k in range(n) if not out[k])
            x = [0.15 * tele[k] + 0.85 * (sum(x[s] / len(out[s]) for s, d in links if d == k) + dead * tele[k]) for k in range(n)]
        return x

    for entries, rounds, first in ((2_000_000, 21, None), (0, 3, None), (2_000_000, 21, start), (2_000_000, 1, start)):
        monkeypatch.setattr(graph.powers, "__defaults__", (graph.STEPS, entries))
        got = {r.station: r.pagerank for r in graph.pagerank(edges, nodes, personal, rounds, start=first).collect()}
        assert got == pytest.approx(dict(enumerate(plain(begin if first else tele, rounds))), abs=1e-12)


def test_directives_as_a_log(spark):
    nodes = spark.createDataFrame([(1, ["A"]), (2, ["A", "B"])], "station int, lines array<string>")
    log = [(1, "set", "line", "A", 3.0), (2, "set", "station", "2", 5.0), (3, "clear", None, None, None), (4, "set", "line", "A", 2.0), (5, "set", "line", "A", 0.5), (6, "set", "line", "A", -1.0), (7, "set", "station", "9", 1.0), (8, None, "line", "B", 1.0), (9, "set", "zone", "B", 1.0), (10, "set", "station", "1", None)]
    force, rejected = graph.active_overrides(spark.createDataFrame(log, "seq long, action string, target string, id string, weight double"), nodes)
    assert rows(force) == [("line", "A", 0.5, 5)]
    assert {r.seq: r.reason for r in rejected.collect()} == {6: "no weight", 7: "unknown id", 8: "unknown action", 9: "unknown target", 10: "no weight"}


def test_regression_by_sums(spark):
    """The model is that of all rows at once; rows with a null and no rows at all are defined."""
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3))
    y = 600 * (x @ [0.5, -1.0, 2.0] + 0.25) + rng.normal(size=200)
    data = [(*map(float, r), float(t)) for r, t in zip(x, y)] + [(None, 1.0, 1.0, 5.0), (1.0, 1.0, 1.0, None)]
    df = spark.createDataFrame(data, "a double, b double, c double, y double").repartition(3)
    model = forecast.fit_residuals(df, ["a", "b", "c"])
    full = np.column_stack([x, np.ones(200)])
    want = np.linalg.solve(full.T @ full / 200 + np.diag([1e-3] * 3 + [0]), full.T @ (y / 600) / 200)
    assert [r.weight for r in model.collect()] == pytest.approx(want.tolist())
    got = forecast.predict_residuals(model, df).collect()
    assert got[0].prediction == pytest.approx(600 * (np.array(got[0][:3]) @ want[:3] + want[3])) and sum(r.prediction is None for r in got) == 1
    assert {r.weight for r in forecast.fit_residuals(df.limit(0), ["a"]).collect()} == {0.0}


def test_largest_eigenvalue_of_equal_degrees(spark):
    """all pairs of 25 stations at no distance: the uniform vector cancels out, and the SQL's iteration ends at the floor."""
    edges = spark.createDataFrame([(a, b, 0) for a in range(25) for b in range(25) if a != b], "src int, dst int, run_sec int")
    nodes = spark.createDataFrame([(a,) for a in range(25)], "station int")
    lap = graph.laplacian(graph.kernel_weights(graph.undirected(edges.repartition(5)), sigma=20.0), nodes)
    assert graph.lambda_max(lap, nodes) == 1e-6
    assert graph.lambda_max(lap.limit(0), nodes) == 2.0


def test_equal_journeys_are_planned_once(spark, monkeypatch):
    """a timetable of whole trips gives the same, and the scan meets each distinct journey once."""
    walks = spark.createDataFrame([(2, 5, 60, 0)], "src int, dst int, min_sec int, slack_sec int")
    trips_ = spark.createDataFrame([([(0, 0, 28000, 28800), (1, 1, 30000, 30300), (2, 2, 31200, 31200)],)], "stops array<struct<pos:int,station:int,arr:int,dep:int>>")
    q = spark.createDataFrame([(f"q{k}", 0, 5 - k % 2 * 3, 28800) for k in range(40)] + [("none", 2, 0, 0), ("null", None, 2, 5)], "query_id string, origin int, dest int, departure_sec int")
    met, scan = [], journeys.scan
    monkeypatch.setattr(journeys, "scan", lambda queries, *rest: met.append(queries.count()) or scan(queries, *rest))
    want = sorted((f"q{k}", 31200 if k % 2 else 31260, 0) for k in range(40))
    assert rows(journeys.plan(q, trips_, walks)) == want
    legs = journeys.paths(q, trips_, walks).localCheckpoint()
    assert sorted((r.query_id, r.leg, r.kind) for r in legs.where("query_id in ('q0', 'q1')").collect()) == [("q0", 0, "RIDE"), ("q0", 1, "WALK"), ("q1", 0, "RIDE")]
    assert rows(journeys.path_proofs(legs, q, trips_, walks)) == [(*w, True, True) for w in want]
    assert met == [4, 4]
