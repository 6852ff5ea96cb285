"""Joining cascades with predictions in a time window, and one criticality score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parsing import content_id
from ..functions.scans import in_blocks, last_before, sum_up_to
from ..functions.tables import saved

WINDOW_MS = 60_000
W_DELAY, W_MISSED, W_ESCALATE, BETA_GAIN = 1.0, 2.0, 3.0, 1.0
SIDE = ["station", "seq", "event_time_ms", "event_id"]


def window_join(cascades: DataFrame, predictions: DataFrame, window_ms: int = WINDOW_MS, emit_unjoined: bool = True, on_replace: str = "emit_unjoined", parts: int | None = None) -> DataFrame:
    """(station, cascade_id, prediction_id, lag_ms, delay, missed, escalation, event_time_ms), events taken in order of seq.

    A cascade meets its station's last prediction if that is within the window; else it waits, in the
    place of one that waited before, for the first later prediction within the window. Cascades that meet none
    have no prediction and lag -1. A station's events lie in as many blocks (parts in all) as they need; each block starts
    from the last prediction and the waiting cascade of those before it.
    """
    null = lambda t: F.lit(None).cast(t)
    c = cascades.select(*SIDE, "delay", "missed", null("double").alias("escalation"), F.lit(True).alias("is_c"))
    p = predictions.select(*SIDE, null("double").alias("delay"), null("boolean").alias("missed"), "escalation", F.lit(False).alias("is_c"))
    near = lambda a, b: F.abs(a - b) <= window_ms
    order = ("seq", "is_c", "event_id")
    rows = last_before(in_blocks(c.union(p), "station", *order, parts=parts), F.when(~F.col("is_c"), F.struct("event_id", "event_time_ms", "escalation")), "last", "station", *order)
    rows = rows.withColumn("joined", F.col("is_c") & F.coalesce(near(F.col("event_time_ms"), F.col("last.event_time_ms")), F.lit(False)))
    waits = F.col("is_c") & ~F.col("joined")
    rows = saved(last_before(rows, F.when(waits, F.struct("event_id", "seq", "event_time_ms", "delay", "missed")), "waiting", "station", *order), "joined")
    at_once = rows.where("joined").select("station", F.col("event_id").alias("cascade_id"), F.col("last.event_id").alias("prediction_id"), F.abs(F.col("event_time_ms") - F.col("last.event_time_ms")).alias("lag_ms"), "delay", "missed", F.col("last.escalation").alias("escalation"), "event_time_ms")
    meets = rows.where(~F.col("is_c") & near(F.col("event_time_ms"), F.col("waiting.event_time_ms"))).groupBy("station", "waiting").agg(F.min_by(F.struct("event_id", "event_time_ms", "escalation"), F.struct("seq", "event_id")).alias("p"))
    later = meets.select("station", F.col("waiting.event_id").alias("cascade_id"), F.col("p.event_id").alias("prediction_id"), F.abs(F.col("p.event_time_ms") - F.col("waiting.event_time_ms")).alias("lag_ms"), F.col("waiting.delay").alias("delay"), F.col("waiting.missed").alias("missed"), F.col("p.escalation").alias("escalation"), F.col("waiting.event_time_ms").alias("event_time_ms"))
    out = at_once.union(later)
    if not emit_unjoined:
        return out
    alone = rows.where(waits).join(meets.select("station", F.col("waiting.seq").alias("seq"), F.col("waiting.event_id").alias("event_id")), ["station", "seq", "event_id"], "left_anti")
    if on_replace == "drop":
        still = rows.where(waits).groupBy("station").agg(F.max(F.struct("seq", "event_id")).alias("w"))
        alone = alone.join(still.select("station", "w.*"), ["station", "seq", "event_id"], "left_semi")
    lost = alone.select("station", F.col("event_id").alias("cascade_id"), null("string").alias("prediction_id"), F.lit(-1).cast("long").alias("lag_ms"), "delay", "missed", null("double").alias("escalation"), "event_time_ms")
    return out.union(lost)


def interval_join(cascades: DataFrame, predictions: DataFrame, window_ms: int = WINDOW_MS) -> DataFrame:
    """All pairs of a station within the window, left outer; repeated event ids stay apart. Both sides are also cut into time buckets, so that the join has equal keys and no hot station."""
    c = cascades.withColumn("_b", F.explode(F.array(*[F.floor(F.col("event_time_ms") / window_ms) + k for k in (-1, 0, 1)])))
    p = predictions.select(F.col("station").alias("_s"), F.col("event_id").alias("prediction_id"), F.col("event_time_ms").alias("_t"), "escalation", F.floor(F.col("event_time_ms") / window_ms).alias("_p"))
    pairs = c.join(p, (F.col("station") == F.col("_s")) & (F.col("_b") == F.col("_p")) & (F.abs(F.col("event_time_ms") - F.col("_t")) <= window_ms))
    pairs = pairs.select(*cascades.columns, "prediction_id", "escalation", F.abs(F.col("event_time_ms") - F.col("_t")).alias("lag_ms"))
    alone = cascades.join(pairs.select(*SIDE).distinct(), SIDE, "left_anti").select(*cascades.columns)
    return pairs.unionByName(alone.withColumn("lag_ms", F.lit(-1).cast("long")), allowMissingColumns=True)


def interval_totals(cascades: DataFrame, predictions: DataFrame, window_ms: int = WINDOW_MS, parts: int | None = None) -> DataFrame:
    """(station, event_time_ms, cascades, pairs, lag_ms): for each time of a station's cascades, their number, and how many
    predictions interval_join pairs each of them with, and the sum of the lags; no pair is made.

    Predictions are counted and their times added up along time (segmented scans, parts blocks in all); a cascade takes
    the differences between its window's ends. Work grows with the events, not with the pairs.
    """
    start = predictions.agg(F.min("event_time_ms")).first()[0] or 0
    t = (F.col("event_time_ms") - F.lit(start)).cast("decimal(20,0)")
    at = cascades.groupBy("station", "event_time_ms").agg(F.count("*").alias("cascades"))
    seen = predictions.where("station is not null and event_time_ms is not null").groupBy("station", F.col("event_time_ms").alias("at")).agg(F.count("*").alias("n"), F.sum(t).alias("total"))
    none = [F.lit(0).cast("long").alias("n"), F.lit(0).cast("decimal(30,0)").alias("total")]
    # a window begins after all before it, and its middle and end follow what happens at their time
    ends = F.explode(F.array(*[F.struct(F.lit(k).alias("end"), (F.col("event_time_ms") + shift).alias("at")) for k, shift in enumerate((-window_ms - 1, 0, window_ms))]))
    asked = at.where("station is not null and event_time_ms is not null").select("station", "event_time_ms", "cascades", ends.alias("e")).select("station", F.col("e.at").alias("at"), F.col("e.end").alias("end"), "event_time_ms", "cascades", *none)
    known = seen.select("station", "at", F.lit(-1).alias("end"), F.lit(None).cast("long").alias("event_time_ms"), F.lit(None).cast("long").alias("cascades"), "n", F.col("total").cast("decimal(30,0)").alias("total"))
    order = ("at", "end", "event_time_ms")
    rows = in_blocks(asked.unionByName(known), "station", *order, parts=parts)
    rows = sum_up_to(sum_up_to(rows, F.col("n"), "upto", "station", *order), F.col("total"), "added", "station", *order).where("end >= 0")
    pick = lambda c, k: F.max(F.when(F.col("end") == k, F.col(c)))
    each = rows.groupBy("station", "event_time_ms").agg(F.max("cascades").alias("cascades"), *[pick(c, k).alias(f"{c}{k}") for c in ("upto", "added") for k in range(3)])
    lag = t * (2 * F.col("upto1") - F.col("upto0") - F.col("upto2")) - (2 * F.col("added1") - F.col("added0") - F.col("added2"))
    found = each.select("station", "event_time_ms", "cascades", (F.col("upto2") - F.col("upto0")).alias("pairs"), lag.cast("long").alias("lag_ms"))
    lost = at.where("station is null or event_time_ms is null").select("*", F.lit(0).cast("long").alias("pairs"), F.lit(0).cast("long").alias("lag_ms"))
    return found.union(lost)


def score(rows: DataFrame, ranks: DataFrame, weights: tuple[float, float, float] = (W_DELAY, W_MISSED, W_ESCALATE), gain: float = BETA_GAIN, divisor: float = 60.0) -> DataFrame:
    """Adds t_impact, p_miss, i_escalate, v_context, beta_hub and total to rows(station, delay, missed, escalation)."""
    top = ranks.agg(F.max("pagerank").alias("top"))
    hub = ranks.join(F.broadcast(top), F.lit(True)).select("station", (1 + gain * F.coalesce(F.try_divide(F.col("pagerank"), F.col("top")), F.lit(0.0))).alias("_beta"))
    real = lambda c: F.when(F.isnan(c) | c.isNull(), 0.0).otherwise(c)
    clamp = lambda c: F.least(F.greatest(real(c), F.lit(0.0)), F.lit(1.0))
    out = rows.join(hub, "station", "left")
    out = out.withColumns({"t_impact": F.greatest(real(F.col("delay").cast("double")), F.lit(0.0)) / divisor, "p_miss": F.coalesce(F.col("missed").cast("double"), F.lit(0.0)), "i_escalate": clamp(F.col("escalation").cast("double")), "beta_hub": F.coalesce("_beta", F.lit(1.0))})
    out = out.withColumn("v_context", weights[0] * F.col("t_impact") + weights[1] * F.col("p_miss") + weights[2] * F.col("i_escalate"))
    return out.withColumn("total", F.col("beta_hub") * F.col("v_context")).drop("_beta")


def criticality_events(scored: DataFrame, nodes: DataFrame, graph_version: str, decision_time_ms: int) -> DataFrame:
    """Events with provenance: both ids, lag, whether a prediction joined, the station's name."""
    parts = ["t_impact", "p_miss", "i_escalate", "v_context", "beta_hub", "total"]
    named = scored.join(nodes.select("station", F.col("name").alias("station_name")), "station", "left")
    out = named.select(F.col("station").alias("station_id"), "station_name", F.struct(*parts).alias("score"), F.col("cascade_id").alias("cascade_event_id"), F.col("prediction_id").alias("prediction_event_id"), F.col("lag_ms").alias("join_lag_ms"), F.col("prediction_id").isNotNull().alias("prediction_joined"), F.lit(graph_version).alias("graph_version"), "event_time_ms", F.lit(decision_time_ms).cast("long").alias("decision_time_ms"))
    return out.withColumn("event_id", content_id("cascade_event_id", "prediction_event_id"))


def latest_scores(scored: DataFrame, time: str = "event_time_ms", tie: str = "cascade_id") -> DataFrame:
    """The last row of each station."""
    rest = [c for c in scored.columns if c != "station"]
    last = scored.groupBy("station").agg(F.max_by(F.struct(*rest), F.struct(time, tie)).alias("r"))
    return last.select("station", "r.*")


def top_stations(scored: DataFrame, k: int = 10) -> DataFrame:
    return scored.orderBy(F.desc("total"), "station").limit(max(k, 1)).withColumn("total", F.round("total", 3))


def topk_decisions(scored: DataFrame, k: int, *keys: str, total: Column | str = "total", tie: str = "cascade_id") -> DataFrame:
    """(keys, decisions): each target's k highest scores in order."""
    total = F.col(total) if isinstance(total, str) else total
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(total.desc(), tie))
    best = scored.withColumn("place", n).where(F.col("place") <= k)
    return best.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", tie, total.alias("total")))).alias("decisions"))
