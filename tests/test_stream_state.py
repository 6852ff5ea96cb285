"""State of streams: equal to the batch operators, kept over restarts, read between batches."""

import json

import pytest
from pyspark.sql import functions as F

from headway.operators import criticality, forecast
from headway.streaming import pipelines, state

READINGS = "station int, ts long, delay double"


@pytest.fixture
def one_partition(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("\n".join(map(json.dumps, rows)))


def run(frame, path, checkpoint, mode="append"):
    if mode == "append":
        writer = frame.writeStream.format("parquet").option("path", path)
    else:
        writer = frame.writeStream.foreachBatch(lambda batch, k: batch.write.mode("append").parquet(path))
    query = writer.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    assert query.awaitTermination(120)


def readings(*rows):
    return [{"station": s, "ts": t, "delay": d} for s, t, d in rows]


def history(spark, tmp_path, version, snapshot=None, name="a"):
    rows = pipelines.file_stream(spark, str(tmp_path / "in"), READINGS, 1).withColumn("event_time", F.timestamp_seconds("ts"))
    out = state.rolling_history_stream(rows, version, snapshot, 60, delay="0 seconds")
    run(out, str(tmp_path / name), str(tmp_path / f"{name}-cp"))
    return spark.read.parquet(str(tmp_path / name))


def test_history_equals_the_batch_and_survives_restarts(spark, tmp_path, one_partition):
    first = readings((1, 1, 60.0), (2, 5, 0.0), (1, 30, 90.0), (1, 130, 0.0), (2, 200, 75.0))
    put(tmp_path / "in", "1", first)
    history(spark, tmp_path, "v1")
    second = readings((1, 600, 120.0), (2, 1500, 61.0), (1, 1500, 10.0))
    put(tmp_path / "in", "2", second)
    got = history(spark, tmp_path, "v1")
    batch = forecast.rolling_history(forecast.frames(spark.createDataFrame([tuple(r.values()) for r in first + second], READINGS), 60))
    closed = batch.where("frame < 25")
    key = lambda r: (r.station, r.frame, r.delay, tuple(r.history), r.seen)
    assert sorted(map(key, got.collect())) == sorted(map(key, closed.collect())) and got.agg(F.sum("late")).first()[0] == 0


def test_a_snapshot_counts_for_its_own_version_only(spark, tmp_path, one_partition):
    put(tmp_path / "in", "1", readings((1, 6000, 60.0), (1, 6700, 5.0)))
    snapshot = state.history_snapshot(history(spark, tmp_path, "v1"), "v1")
    held = snapshot.first()
    assert (held.frame, held.delay, held.seen, len(held.history)) == (110, 60.0, 11, 11)
    snapshot = spark.createDataFrame(snapshot.collect(), state.SNAPSHOT)
    put(tmp_path / "in", "1", readings((1, 6660, 70.0), (1, 6900, 5.0)))
    warm = history(spark, tmp_path, "v1", snapshot, "warm").orderBy("frame").collect()
    assert warm[0].frame == 111 and warm[0].history == [60.0] * 11 + [70.0] and warm[0].seen == 12
    cold = history(spark, tmp_path, "v2", snapshot, "cold").orderBy("frame").collect()
    assert cold[0].frame == 111 and cold[0].history == [70.0] and cold[0].seen == 1


def test_latest_scores_between_batches_and_after_a_restart(spark, tmp_path, one_partition):
    schema = "station int, cascade_id string, total double, event_time_ms long"
    rows = [(1, "a", 5.0, 10), (1, "b", 3.0, 20), (2, "c", 9.0, 10), (1, "d", 8.0, 15), (3, "e", 1.0, 5), (2, None, 99.0, 99)]
    source = lambda: pipelines.file_stream(spark, str(tmp_path / "in"), schema, 1)
    cp, out = str(tmp_path / "cp"), str(tmp_path / "out")
    seen = []
    for n, part in enumerate((rows[:3], rows[3:])):
        put(tmp_path / "in", str(n), [dict(zip(("station", "cascade_id", "total", "event_time_ms"), r)) for r in part])
        run(state.latest_scores_stream(source()), out, cp, "update")
        seen += [r for r in part if r[1]]
        now = state.latest_scores_now(spark, cp)
        want = criticality.latest_scores(spark.createDataFrame(seen, schema)).select(*now.columns)
        assert sorted(map(tuple, now.collect())) == sorted(map(tuple, want.collect()))
    assert [(r.station, r.total) for r in criticality.top_stations(now, 2).collect()] == [(2, 9.0), (1, 3.0)]
    assert sorted(r.cascade_id for r in spark.read.parquet(out).collect()) == ["b", "c", "e"]


def test_interval_join_and_frame_counts(spark, tmp_path, one_partition):
    side = "station int, event_time_ms long, event_id string"
    for name, rows in (("c", [(1, 1000, "c1"), (1, 90_000, "c2"), (2, 1000, "c3"), (9, 9_000_000, "c9")]), ("p", [(1, 30_000, "p1"), (1, 140_000, "p2"), (9, 9_000_000, "p9")])):
        put(tmp_path / name, "1", [dict(zip(("station", "event_time_ms", "event_id"), r)) for r in rows])
    timed = lambda name: pipelines.file_stream(spark, str(tmp_path / name), side).withColumn("event_time", F.timestamp_millis("event_time_ms"))
    run(pipelines.interval_join_stream(timed("c"), timed("p")), str(tmp_path / "pairs"), str(tmp_path / "pairs-cp"))
    got = {(r.cascade_id, r.prediction_id) for r in spark.read.parquet(str(tmp_path / "pairs")).collect()}
    assert got == {("c1", "p1"), ("c2", "p1"), ("c2", "p2"), ("c3", None), ("c9", "p9")}
    put(tmp_path / "in", "1", readings((1, 1, 5.0), (1, 59, 7.0), (2, 61, 1.0), (1, 7000, 0.0)))
    rows = pipelines.file_stream(spark, str(tmp_path / "in"), READINGS).withColumn("event_time", F.timestamp_seconds("ts"))
    run(pipelines.frame_counts(rows), str(tmp_path / "counts"), str(tmp_path / "counts-cp"))
    assert sorted((r.station, r.readings, r.delay) for r in spark.read.parquet(str(tmp_path / "counts")).collect()) == [(1, 2, 7.0), (2, 1, 1.0)]
