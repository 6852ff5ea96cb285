"""Frames are read in one pass: one parse, no join, code that compiles; a stop table too large to look into gives the same rows."""

import json

from headway.functions import tables
from headway.sources import frames

BODIES = [
    {"trip_id": "T", "station_id": 3, "lat": 1, "lon": 2},
    {"tripId": " ", "tripRef": "U", "stationId": "x:y", "stop_id": "IDFM:Q7"},
    {"trip_id": "V", "stop_id": "Q7", "station_id": "nowhere", "delay": "PT1M5S", "delaySeconds": "odd"},
    {"trip_id": "W", "station_id": "12", "Position": {"Latitude": "48.5", "lat": "", "Longitude": 2}, "latitude": 9},
    {"trip_id": "X", "station_id": 2.5, "ts": 1700000000, "event_time_ms": "soon"},
    {"trip_id": "Y", "position": [1], "stopId": ":"},
    [1],
    {"lat": 1, "lon": 1},
]


def test_one_parse_and_no_join(spark, monkeypatch):
    raw = spark.createDataFrame([("POSITION", json.dumps(b)) for b in BODIES] + [("POSITION", "no json"), ("POSITION", None)], "kind string, body string")
    stops = spark.createDataFrame([("Q7", 70), ("x:y", 5), ("y", 6)], "stop_id string, station int")
    out = frames.normalize_positions(raw, stops, 5)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("parseJson(") == 1
    got = {r.trip_id: r for r in out.collect()}
    assert [got[t].station_id for t in "TUVWXY"] == [3, 5, 70, 12, 3, None]
    assert (got["W"].latitude, got["W"].longitude, got["V"].delay_seconds, got["X"].event_time_ms) == (48.5, 2.0, 65.0, 1_700_000_000_000)
    assert sorted(r.reason for r in out.collect() if r.reason) == ["malformed json", "malformed json", "missing trip id", "missing trip id", "no place"]
    monkeypatch.setattr(frames, "lookup", lambda *_: None)
    assert sorted(map(str, frames.normalize_positions(raw, stops, 5).collect())) == sorted(map(str, out.collect()))


def test_sizes_are_of_bytes(spark):
    rows = spark.createDataFrame([("a" * 1000, 1), (None, 2)], "t string, n int")
    assert tables.size_of(rows, 10_000) == 1000 + 2 * 16 and tables.size_of(rows.limit(0), 10) == 0
    assert tables.lookup(rows, "t", "n", 500) is None and tables.lookup(rows, "t", "n") is not None
    assert tables.size_of(spark.range(1_000_000), 800) > 800
