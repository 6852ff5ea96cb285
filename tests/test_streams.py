"""Streams give what the batch operators give."""

import json
import time

import pytest
from pyspark.sql import functions as F

from headway.operators import criticality
from headway.sources import ledger
from headway.streaming import pipelines

SCHEMA = "seq long, side string, station int, event_time_ms long, event_id string, delay double, missed boolean, escalation double"


def test_window_join(spark, tmp_path):
    events = [("p", 9, 10000), ("c", 9, 20000), ("c", 9, 30000), ("c", 2, 1000), ("c", 5, 1000), ("p", 5, 30000), ("c", 7, 900000)]
    data = [{"seq": k, "side": s, "station": st, "event_time_ms": t, "event_id": f"{s}{k}", "delay": 60.0, "missed": False, "escalation": 0.5} for k, (s, st, t) in enumerate(events)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(map(json.dumps, data[:6])))
    stream = pipelines.file_stream(spark, str(tmp_path / "in"), SCHEMA, 1).withColumn("event_time", F.timestamp_millis("event_time_ms"))
    (tmp_path / "in" / "2.json").write_text(json.dumps(data[6]))
    query = pipelines.window_join_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(90)
    got = {(r.cascade_id, r.prediction_id, r.lag_ms) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    df = spark.createDataFrame(data, SCHEMA)
    batch = {(r.cascade_id, r.prediction_id, r.lag_ms) for r in criticality.window_join(df.where("side = 'c'"), df.where("side = 'p'")).collect()}
    assert got == batch - {("c6", None, -1)}


def test_routing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('{"trip_id":"T","station_id":3}\n[{"trip_id":"U","station_id":4},{"lat":1}]\nbroken\n')
    from headway.sources.frames import read_frames

    stops = spark.createDataFrame([("x", 1)], "stop_id string, station int")
    frames = read_frames(spark, str(tmp_path / "in"), "POSITION", stream=True)
    pipelines.route_positions(frames, stops, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(90)
    assert {r.trip_id for r in ledger.committed(spark, str(tmp_path / "out"), "positions").collect()} == {"T", "U"}
    assert ledger.committed(spark, str(tmp_path / "out"), "dead_letters").count() == 2


def test_outputs_of_a_batch_appear_together(spark, tmp_path, monkeypatch):
    """A batch that fails between two outputs shows nothing; its retry leaves each row once, in every sink."""
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    put = lambda name, rows: (tmp_path / "in").mkdir(exist_ok=True) or (tmp_path / "in" / name).write_text("\n".join(json.dumps({"kind": k, "body": b}) for k, b in rows))
    put("1.json", [("POSITION", '{"trip_id":"T","station_id":0,"delay":300}'), ("SIGNALLING", '{"tripId":"T","blockId":"B"}'), ("INCIDENT", '{"lines":["A"]}'), ("ODD", "{}"), ("POSITION", "no")])
    stops = spark.createDataFrame([("x", 1)], "stop_id string, station int")
    source = lambda: pipelines.file_stream(spark, str(tmp_path / "in"), "kind string, body string", 1)
    write, calls = ledger.write_batch, []

    def failing(outputs, path, batch):
        calls.append(batch)
        if len(calls) == 1:
            outputs["positions"].write.parquet(f"{path}/positions/batch={batch}")
            raise RuntimeError("killed")
        write(outputs, path, batch)

    monkeypatch.setattr(ledger, "write_batch", failing)
    query = ledger.publish(source(), pipelines.telemetry(stops), out, cp)
    with pytest.raises(Exception, match="killed"):
        query.awaitTermination(90)
    assert not (tmp_path / "out" / ledger.LEDGER).exists()
    ledger.publish(source(), pipelines.telemetry(stops), out, cp).awaitTermination(90)
    assert calls == [0, 0]
    count = {name: ledger.committed(spark, out, name).count() for name in ("positions", "signalling", "incidents", "dead_letters")}
    assert count == {"positions": 1, "signalling": 1, "incidents": 1, "dead_letters": 2}
    network = {
        "edges": spark.createDataFrame([(0, 1, 120, 60)], "src int, dst int, run_sec int, run_slack_sec int"), "dwell": spark.createDataFrame([], "station int, dwell_slack_sec int"), "transfers": spark.createDataFrame([], "src int, dst int, min_sec int, slack_sec int"),
        "ranks": spark.createDataFrame([(0, 0.5), (1, 0.5)], "station int, pagerank double"), "nodes": spark.createDataFrame([(0, "N0"), (1, "N1")], "station int, name string"),
        "trip_times": spark.createDataFrame([("P", 0, 0, 0, 86000, 86000), ("P", 0, 1, 1, 86100, 86100)], "pattern_id string, trip_no int, pos int, station int, arr_sec int, dep_sec int"), "kinds": spark.createDataFrame([("P", "L", 2)], "pattern_id string, line string, n_stops int"),
    }
    positions = ledger.committed(spark, out, "positions").drop("batch")
    ledger.write_batch(pipelines.effects(network, "2024-01-15")(positions, 1_705_273_200_000 + 80_000_000), str(tmp_path / "effects"), 0)
    sinks = {name: ledger.committed(spark, str(tmp_path / "effects"), name) for name in ("cascades", "scores", "displays")}
    assert sorted(r.station_id for r in sinks["cascades"].collect()) == [0, 1] and sorted(r.station_name for r in sinks["scores"].collect()) == ["N0", "N1"]
    assert [r.headline for r in sinks["displays"].collect()] == ["N1"]


def test_late_rows_are_counted(spark, tmp_path):
    listener = ledger.LateRows(spark, str(tmp_path / "late"))
    spark.streams.addListener(listener)
    try:
        for n, rows in enumerate(([(1, 10_000), (1, 20_000)], [(1, 5)], [(1, 30_000)])):
            (tmp_path / "in").mkdir(exist_ok=True)
            (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps({"station": s, "ts": t, "delay": 1.0}) for s, t in rows))
            stream = pipelines.file_stream(spark, str(tmp_path / "in"), "station int, ts long, delay double", 1).withColumn("event_time", F.timestamp_seconds("ts"))
            query = pipelines.frame_counts(stream).writeStream.queryName("counts").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination(90)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        for _ in range(50):
            if (tmp_path / "late").exists():
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert [(r.name, r.dropped) for r in spark.read.parquet(str(tmp_path / "late")).collect()] == [("counts", 1)]
