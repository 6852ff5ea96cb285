"""Time-series features of station delays, escalation forecasts and their losses."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scans import following, in_blocks, last_values, sum_up_to
from ..functions.tables import saved
from .graph import chebyshev_terms

HISTORY, HORIZON_S, FRAME_S, SCALE_S, WARM = 12, 1800, 60, 600.0, 3
LATE_S, FLOOR_S, COLD, P90, P95 = 60.0, 30.0, 1.10, 1.25, 1.40
MOST_FRAMES = 10_000_000
LONG_GAP = 10_000


def latest_observation(observations: DataFrame, n_stations: int | None = None) -> DataFrame:
    """(station, delay, trip_id): the last reading of each station; ids outside 0..n-1 are ignored."""
    if n_stations is not None:
        observations = observations.where((F.col("station") >= 0) & (F.col("station") < n_stations))
    return observations.groupBy("station").agg(F.max_by(F.struct("delay", "trip_id"), F.struct("ts", "delay", "trip_id")).alias("o")).select("station", "o.*")


def time_bounds(observations: DataFrame, frame_seconds: int = FRAME_S, most: int = MOST_FRAMES) -> tuple[float, float] | None:
    """The times within `most` frames of the median reading; None without readings."""
    middle = observations.agg(F.percentile_approx("ts", 0.5).alias("m")).first().m
    return None if middle is None else (middle - most * frame_seconds, middle + most * frame_seconds)


def wrong_times(observations: DataFrame, frame_seconds: int = FRAME_S, most: int = MOST_FRAMES) -> DataFrame:
    """Dead letters of the readings that frames leaves out: their columns and a reason. Their time is null or outside time_bounds."""
    low, high = time_bounds(observations, frame_seconds, most) or (0.0, 0.0)
    return observations.where(F.col("ts").isNull() | ~F.col("ts").between(low, high)).withColumn("reason", F.lit("wrong time"))


def frames(observations: DataFrame, frame_seconds: int = FRAME_S, max_age_frames: int | None = None, most: int = MOST_FRAMES, parts: int | None = None) -> DataFrame:
    """(station, frame, delay, fresh): every station's delay at the end of each frame, carried forward, 0 before its first reading.

    observations(station, ts seconds, delay). A reading may expire after max_age_frames. Readings of a wrong time are no
    part of it, see wrong_times. Each reading fills the frames up to its station's next one, so no station is one task.
    """
    bounds = time_bounds(observations, frame_seconds, most)
    good = observations.where(F.col("ts").between(*bounds) if bounds else F.lit(False))
    of = good.select("station", F.floor(F.col("ts") / frame_seconds).cast("long").alias("frame"), "ts", "delay")
    read = in_blocks(of.groupBy("station", "frame").agg(F.max_by("delay", F.struct("ts", "delay")).alias("read")), "station", "frame", parts=parts)
    span = read.agg(F.min("frame").alias("lo"), F.max("frame").alias("hi")).first()
    if span.lo is None:
        return read.select("station", "frame", F.col("read").alias("delay"), F.lit(False).alias("fresh"))
    first = read.groupBy("station").agg(F.min("frame").alias("until")).select("station", F.lit(span.lo).cast("long").alias("frame"), (F.col("until") - 1).alias("until"), F.lit(0.0).alias("read"), F.lit(False).alias("is_read")).where("until >= frame")
    held = following(read, "frame", "next", "station", "frame").select("station", "frame", (F.coalesce("next", F.lit(span.hi + 1)) - 1).cast("long").alias("until"), "read", F.lit(True).alias("is_read"))
    piece = F.explode(F.sequence("frame", "until", F.lit(LONG_GAP).cast("long")))
    rows = held.unionByName(first).select("*", piece.alias("start"))
    rows = rows.select("*", F.explode(F.sequence("start", F.least("until", F.col("start") + LONG_GAP - 1))).alias("at"))
    fresh = F.col("is_read") & (F.col("at") == F.col("frame"))
    value = F.col("read") if max_age_frames is None else F.when(F.col("at") - F.col("frame") <= max_age_frames, F.col("read"))
    return rows.select("station", F.col("at").alias("frame"), F.coalesce(value, F.lit(0.0)).alias("delay"), fresh.alias("fresh"))


def rolling_history(framed: DataFrame, history: int = HISTORY, parts: int | None = None) -> DataFrame:
    """Adds history (the last frames' delays, oldest first) and seen (frames with a delay so far, at most history + 1).

    A station's frames lie in as many blocks (parts in all) as they need; each starts from the last frames before it.
    """
    rows = sum_up_to(in_blocks(framed, "station", "frame", parts=parts), (F.col("delay") != 0).cast("int"), "seen", "station", "frame")
    rows = last_values(rows, "delay", history, "history", "station", "frame")
    return rows.select(*framed.columns, "history", F.least("seen", F.lit(history + 1)).cast("int").alias("seen"))


def escalation(rows: DataFrame, residual: Column | None = None) -> DataFrame:
    """Adds forecast, escalation_ratio, fallback_used and quantiles to rows(station, delay, seen) that are a minute late or more."""
    d = F.col("delay")
    cold = (F.col("seen") < WARM) | (F.lit(True) if residual is None else residual.isNull())
    forecast = F.when(cold, d * COLD).otherwise(F.greatest(d + (F.lit(0.0) if residual is None else residual), F.lit(0.0)))
    ratio = F.least(F.greatest((F.col("forecast") - d) / F.greatest(d, F.lit(FLOOR_S)), F.lit(0.0)), F.lit(1.0))
    out = rows.where(d >= LATE_S).withColumn("fallback_used", cold).withColumn("forecast", forecast).withColumn("escalation_ratio", ratio)
    quantile = lambda tau, by: F.struct(F.lit(tau).alias("tau"), (F.col("forecast") * by).alias("delay_seconds"))
    return out.withColumn("quantiles", F.array(quantile(0.5, 1.0), quantile(0.9, P90), quantile(0.95, P95)))


def prediction_events(forecasts: DataFrame, inference_time_ms: int, model_version: str, graph_version: str) -> DataFrame:
    from ..functions.parsing import content_id

    key = F.coalesce("trip_id", F.concat(F.lit("station-"), F.col("station").cast("string")))
    out = forecasts.select(key.alias("trip_id"), F.col("station").alias("station_id"), F.lit(HORIZON_S).alias("horizon_seconds"), F.col("delay").alias("current_delay_seconds"), "quantiles", "escalation_ratio", "fallback_used", F.lit(model_version).alias("model_version"), F.lit(graph_version).alias("graph_version"), "event_time_ms", F.lit(inference_time_ms).cast("long").alias("inference_time_ms"))
    return out.withColumn("event_id", content_id("trip_id", "station_id", "event_time_ms"))


def supervised_windows(framed: DataFrame, history: int = HISTORY, steps: int = HORIZON_S // FRAME_S, parts: int | None = None) -> DataFrame:
    """(station, frame, x, y): whole histories and how the delay changes over the horizon, up to the frame `steps` later."""
    rows = rolling_history(framed, history, parts).where(F.size("history") == history)
    later = framed.select("station", (F.col("frame") - steps).alias("frame"), F.col("delay").alias("later"))
    return rows.join(later, ["station", "frame"]).select("station", "frame", F.col("history").alias("x"), (F.col("later") - F.col("delay")).alias("y"))


def split(rows: DataFrame, percent: int = 20, *keys: str) -> tuple[DataFrame, DataFrame]:
    """(training, validation) by a hash of the keys: the same rows every time."""
    held = F.pmod(F.xxhash64(*(keys or ("station", "frame"))), F.lit(100)) < percent
    return rows.where(~held), rows.where(held)


def losses(rows: DataFrame, tau: float = 0.9, mix: float = 0.7, scale: float = SCALE_S) -> DataFrame:
    """mse and pinball in units of scale, mae in seconds, and their mix, of rows(y, prediction) in seconds."""
    e = (F.col("y") - F.col("prediction")) / scale
    mse, pinball = F.avg(e * e), F.avg(F.greatest(tau * e, (tau - 1) * e))
    return rows.agg(mse.alias("mse"), F.avg(F.abs(e) * scale).alias("mae_seconds"), pinball.alias("pinball"), (mix * mse + (1 - mix) * pinball).alias("loss"))


def model_features(framed: DataFrame, scaled: DataFrame, order: int = 3, history: int = HISTORY, parts: int | None = None) -> tuple[DataFrame, list[str]]:
    """framed with seen and the features of the forecaster, in units of SCALE_S, and their names.

    h0, h1, ..: the delays of the last frames, null where there are fewer. g1, g2, ..: the Chebyshev terms of all
    stations' delays of the frame over the network, scaled(row, col, val) being its scaled Laplacian.
    """
    rows = rolling_history(framed, history, parts)
    for k, term in enumerate(chebyshev_terms(scaled, framed.select("frame", "station", F.col("delay").alias("x")), order)):
        if k:
            rows = rows.join(term.withColumnRenamed("x", f"g{k}"), ["frame", "station"], "left")
    whole = F.size("history") == history
    rows = rows.withColumns({f"h{k}": F.when(whole, F.col("history")[k] / SCALE_S) for k in range(history)} | {f"g{k}": F.coalesce(f"g{k}", F.lit(0.0)) / SCALE_S for k in range(1, order)})
    return rows.drop("history"), [f"h{k}" for k in range(history)] + [f"g{k}" for k in range(1, order)]


def fit_residuals(training: DataFrame, features: list[str], ridge: float = 1e-3) -> DataFrame:
    """(feature, weight): the ridge regression of y / SCALE_S on numeric feature columns and `bias`, the model as a table.

    One aggregation gives the mean products of all columns; the equations, as many as there are features, are solved
    where they arrive. Rows with a null are left out; no rows give weights of 0.
    """
    columns = {**{c: F.col(c) for c in features}, "bias": F.lit(1.0), "y": F.col("y") / SCALE_S}
    names = list(columns)
    rows = training.dropna(subset=[*features, "y"])
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    means = rows.agg(*[F.avg(columns[names[i]] * columns[names[j]]).alias(f"p{i}_{j}") for i, j in pairs]).first()
    n = len(features) + 1
    products = np.zeros((n + 1, n + 1))
    for i, j in pairs:
        products[i, j] = products[j, i] = means[f"p{i}_{j}"] or 0.0
    weights = np.linalg.solve(products[:n, :n] + np.diag([ridge] * (n - 1) + [0.0 if products[n - 1, n - 1] else 1.0]), products[:n, n])
    return training.sparkSession.createDataFrame(list(zip([*features, "bias"], weights.tolist(), strict=True)), "feature string, weight double")


def predict_residuals(model: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds prediction, in seconds; null where a feature is. A model has a row for each feature."""
    weights = {r.feature: r.weight for r in model.collect()}
    value = F.lit(weights.pop("bias", 0.0))
    for name, w in weights.items():
        value = value + F.col(name) * F.lit(w)
    return rows.withColumn("prediction", value * SCALE_S)


def rank_percentiles(rows: DataFrame, value: str, fractions: tuple[float, ...] = (0.5, 0.95, 0.99), keys: tuple[str, ...] = ()) -> DataFrame:
    """The values at index int(q (n - 1)) of the sorted sample of each key; nulls are no part of it.

    Values are counted first and the counts dealt by range, so a hot key is spread over tasks: each adds up its own
    counts, on top of one total for every range before it. No rows and no keys give one row of nulls.
    """
    named = rows.where(F.col(value).isNotNull()).withColumn("_all", F.lit(0))
    group = [*keys, "_all"]
    counts = named.groupBy(*group, value).agg(F.count("*").alias("_n")).repartitionByRange(*group, value)
    counts = saved(counts.withColumn("_part", F.spark_partition_id()), "counts")
    totals = counts.groupBy(*group, "_part").agg(F.sum("_n").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(*group, "_part", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_sum").over(Window.partitionBy(*group)).alias("_size"))
    own = F.sum("_n").over(Window.partitionBy(*group, "_part").orderBy(value))
    placed = counts.withColumn("_own", own).alias("c").join(totals.alias("t"), [F.col(f"c.{k}").eqNullSafe(F.col(f"t.{k}")) for k in [*group, "_part"]])
    last, n, size = F.col("_own") + F.col("_before"), F.col("_n"), F.col("_size")
    index = lambda q: F.floor(F.lit(q) * (size - 1))
    pick = [F.max(F.when((index(q) < last) & (index(q) >= last - n), F.col(f"c.{value}"))).alias(f"p{round(q * 100)}") for q in fractions]
    return placed.groupBy(*[F.col(f"c.{k}").alias(k) for k in keys]).agg(*pick)
