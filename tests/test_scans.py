"""One station that holds all events runs in many blocks and gives what a walk through its events gives."""

import random

import pytest
from pyspark.sql import functions as F

from headway.functions import scans
from headway.operators import criticality, forecast

PARTS = 7


def walked(events, window, on_replace):
    """The window join by a plain loop over events (seq, side, station, time, id)."""
    last, waiting, out = {}, {}, []
    for _, side, station, t, name in sorted(events):
        if side == "c":
            if station in last and abs(t - last[station][0]) <= window:
                out.append((name, last[station][1], abs(t - last[station][0])))
                continue
            if station in waiting and on_replace != "drop":
                out.append((waiting[station][1], None, -1))
            waiting[station] = (t, name)
        else:
            last[station] = (t, name)
            if station in waiting and abs(t - waiting[station][0]) <= window:
                out.append((waiting[station][1], name, abs(t - waiting[station][0])))
                del waiting[station]
    return sorted(out + [(name, None, -1) for _, name in waiting.values()], key=str)


@pytest.mark.parametrize("seed", range(3))
def test_window_join_of_a_hot_station(spark, seed):
    rng = random.Random(seed)
    events = [(k, rng.choice("cp" if seed else "cccp"), 1 if rng.random() < 0.9 else rng.randint(2, 5), rng.randint(0, 40) * 1000 + k * 300, f"e{k}") for k in range(600)]
    schema = "seq long, side string, station int, event_time_ms long, event_id string"
    rows = spark.createDataFrame(events, schema).withColumns({"delay": F.lit(60.0), "missed": F.lit(False), "escalation": F.lit(0.5)})
    for on_replace in ("emit_unjoined", "drop"):
        got = criticality.window_join(rows.where("side = 'c'"), rows.where("side = 'p'"), 10_000, on_replace=on_replace, parts=PARTS)
        assert sorted(((r.cascade_id, r.prediction_id, r.lag_ms) for r in got.collect()), key=str) == walked(events, 10_000, on_replace)


def test_a_hot_key_is_in_many_blocks(spark):
    rows = scans.in_blocks(spark.range(5000).select(F.lit(1).alias("k"), "id"), "k", "id", parts=PARTS)
    blocks = rows.groupBy("_block").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).orderBy("_block").collect()
    assert len(blocks) == PARTS and all(a.hi < b.lo for a, b in zip(blocks, blocks[1:]))


def test_scans_against_lists(spark):
    rng = random.Random(4)
    data = [(k, n, rng.choice([None, float(n % 7)])) for k, size in ((1, 400), (2, 1), (3, 30)) for n in rng.sample(range(1000), size)]
    rows = scans.in_blocks(spark.createDataFrame(data, "k int, n int, v double"), "k", "n", parts=PARTS)
    rows = rows.withColumn("w", F.coalesce("v", F.lit(-1.0)))
    out = scans.last_before(rows, F.col("v"), "before", "k", "n")
    out = scans.last_before(out, F.col("v"), "upto", "k", "n", inclusive=True)
    out = scans.sum_up_to(out, F.col("w"), "total", "k", "n")
    out = scans.last_values(out, "w", 60, "tail", "k", "n")
    out = scans.following(out, "v", "next", "k", "n")
    got = {(r.k, r.n): (r.before, r.upto, r.total, r.tail, r.next) for r in out.collect()}
    for key in (1, 2, 3):
        own = sorted((n, v) for k, n, v in data if k == key)
        for i, (n, _) in enumerate(own):
            values = [v for _, v in own[: i + 1]]
            plain = [-1.0 if v is None else v for v in values]
            known = [v for v in values[:-1] if v is not None]
            upto = [v for v in values if v is not None]
            assert got[key, n] == (known[-1] if known else None, upto[-1] if upto else None, sum(plain), plain[-60:], own[i + 1][1] if i + 1 < len(own) else None)


def test_frames_and_history_of_a_hot_station(spark):
    rng = random.Random(5)
    readings = [(1 if rng.random() < 0.95 else 2, rng.randint(0, 30_000), float(rng.randint(0, 3) * 50)) for _ in range(900)]
    frames, delay, want = {}, {1: 0.0, 2: 0.0}, {}
    for s, t, d in sorted(readings):
        frames[s, t // 60] = d
    lo, hi = min(f for _, f in frames), max(f for _, f in frames)
    past = {1: [], 2: []}
    for f in range(lo, hi + 1):
        for s in (1, 2):
            delay[s] = frames.get((s, f), delay[s])
            past[s].append(delay[s])
            want[s, f] = (delay[s], (s, f) in frames, past[s][-12:], min(13, sum(d != 0 for d in past[s])))
    df = spark.createDataFrame(readings, "station int, ts long, delay double")
    framed = forecast.frames(df, 60, parts=PARTS)
    got = {(r.station, r.frame): (r.delay, r.fresh, r.history, r.seen) for r in forecast.rolling_history(framed, parts=PARTS).collect()}
    assert got == want
    windows = {(r.station, r.frame): (r.x, r.y) for r in forecast.supervised_windows(framed, steps=5, parts=PARTS).collect()}
    assert windows == {(s, f): (w[2], want[s, f + 5][0] - w[0]) for (s, f), w in want.items() if len(w[2]) == 12 and f + 5 <= hi}
    aged = {(r.station, r.frame): r.delay for r in forecast.frames(df, 60, max_age_frames=2, parts=PARTS).collect()}
    assert len(aged) == len(want) and all(aged[s, f] == (want[s, f][0] if any((s, f - k) in frames for k in range(3)) else 0.0) for s, f in want)
