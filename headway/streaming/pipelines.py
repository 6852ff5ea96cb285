"""The batch operators over streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import boards, cascade, criticality
from ..operators.criticality import WINDOW_MS
from ..sources.frames import KINDS, accepted, dead_letters, normalize_incidents, normalize_positions, normalize_signalling, unnested
from ..sources.ledger import publish

JOINED = "station int, cascade_id string, prediction_id string, lag_ms long, delay double, missed boolean, escalation double, event_time_ms long"
STATE = "p_id string, p_time long, p_escalation double, c_id string, c_time long, c_delay double, c_missed boolean"


def file_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def telemetry(stop_map: DataFrame) -> Callable[[DataFrame, int], dict[str, DataFrame]]:
    """The outputs of raw frames of all kinds: positions, signalling, incidents and dead_letters."""

    def outputs(batch: DataFrame, now: int) -> dict[str, DataFrame]:
        frames = unnested(batch)
        kind = lambda k: frames.where(F.col("kind") == k)
        rows = {"positions": normalize_positions(kind("POSITION"), stop_map, now), "signalling": normalize_signalling(kind("SIGNALLING"), stop_map, now), "incidents": normalize_incidents(kind("INCIDENT"), now)}
        lost = frames.where(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False))).select("kind", "body", F.lit("unknown kind").alias("reason"), F.lit(now).cast("long").alias("ingest_ts"))
        for normalized in rows.values():
            lost = lost.unionByName(dead_letters(normalized, now))
        return {name: accepted(normalized) for name, normalized in rows.items()} | {"dead_letters": lost}

    return outputs


def effects(network: dict[str, DataFrame], service_date: str) -> Callable[[DataFrame, int], dict[str, DataFrame]]:
    """The outputs of accepted positions: cascades, scores of the stations they hit, and the displays there.

    network has edges, dwell, transfers, ranks(station, pagerank), nodes(station, name), trip_times and kinds.
    """

    def outputs(batch: DataFrame, now: int) -> dict[str, DataFrame]:
        hit = cascade.cascade_events(batch, network["edges"], network["dwell"], network["transfers"], now, network["ranks"])
        rows = hit.select(F.col("station_id").alias("station"), F.col("event_id").alias("cascade_id"), F.lit(None).cast("string").alias("prediction_id"), F.lit(-1).cast("long").alias("lag_ms"), F.col("propagated_delay_seconds").alias("delay"), F.col("missed_connection").alias("missed"), F.lit(None).cast("double").alias("escalation"), "event_time_ms")
        scores = criticality.criticality_events(criticality.score(rows, network["ranks"]), network["nodes"], "batch", now)
        midnight = F.unix_millis(F.to_utc_timestamp(F.lit(f"{service_date} 00:00:00"), boards.ZONE))
        second = batch.sparkSession.range(1).select(F.greatest(F.lit(0), ((F.lit(now) - midnight) / 1000).cast("int"))).first()[0]
        board = boards.departures(network["trip_times"], network["kinds"], second).join(hit.select(F.col("station_id").alias("station")).distinct(), "station", "left_semi")
        return {"cascades": hit, "scores": scores, "displays": boards.display_messages(board, network["nodes"], service_date)}

    return outputs


def route_positions(frames: DataFrame, stop_map: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Frames to typed events and dead letters, entered in the ledger batch by batch (see sources.ledger)."""
    return publish(frames, telemetry(stop_map), path, checkpoint)


def window_join_stream(events: DataFrame, window_ms: int = WINDOW_MS, emit_unjoined: bool = True, emit_replaced: bool = True) -> DataFrame:
    """The window join of criticality.window_join with keyed state.

    events(seq, side 'c' or 'p', station, event_time_ms, event_time timestamp, event_id, delay, missed, escalation).
    A station's state is its last prediction and the waiting cascade; a waiting cascade leaves unjoined when the
    watermark passes its time plus the window.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        p, c, out = None, None, []
        if state.exists:
            s = state.get
            p = s[:3] if s[0] is not None else None
            c = s[3:] if s[3] is not None else None
        emit = lambda c, p: out.append((key[0], c[0], p[0] if p else None, abs(c[1] - p[1]) if p else -1, c[2], c[3], p[2] if p else None, c[1]))
        if state.hasTimedOut:
            if c and emit_unjoined:
                emit(c, None)
            state.remove()
        else:
            for frame in frames:
                for r in frame.sort_values("seq").itertuples():
                    if r.side == "c":
                        new = (r.event_id, int(r.event_time_ms), float(r.delay), bool(r.missed))
                        if p and abs(new[1] - p[1]) <= window_ms:
                            emit(new, p)
                        else:
                            if c and emit_unjoined and emit_replaced:
                                emit(c, None)
                            c = new
                    else:
                        p = (r.event_id, int(r.event_time_ms), float(r.escalation))
                        if c and abs(c[1] - p[1]) <= window_ms:
                            emit(c, p)
                            c = None
            state.update((*(p or (None,) * 3), *(c or (None,) * 4)))
            due = max(x[1] for x in (p, c) if x) + window_ms
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["station", "cascade_id", "prediction_id", "lag_ms", "delay", "missed", "escalation", "event_time_ms"])

    marked = events.withWatermark("event_time", f"{window_ms} milliseconds")
    return marked.groupBy("station").applyInPandasWithState(run, JOINED, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def interval_join_stream(cascades: DataFrame, predictions: DataFrame, window_ms: int = WINDOW_MS) -> DataFrame:
    """All pairs within the window, left outer, as a stream-stream join; both sides have an event_time timestamp."""
    gap = f"interval {window_ms / 1000} seconds"
    c = cascades.withWatermark("event_time", f"{window_ms} milliseconds").alias("c")
    p = predictions.withWatermark("event_time", f"{window_ms} milliseconds").alias("p")
    on = F.expr(f"c.station = p.station and p.event_time >= c.event_time - {gap} and p.event_time <= c.event_time + {gap}")
    return c.join(p, on, "leftOuter").select(F.col("c.station").alias("station"), F.col("c.event_id").alias("cascade_id"), F.col("p.event_id").alias("prediction_id"), F.col("c.event_time").alias("event_time"))


def frame_counts(observations: DataFrame, frame_seconds: int = 60, late: str = "2 minutes") -> DataFrame:
    """Readings and last delay a station and tumbling frame, final when the watermark passes."""
    return observations.withWatermark("event_time", late).groupBy("station", F.window("event_time", f"{frame_seconds} seconds")).agg(F.count("*").alias("readings"), F.max_by("delay", "event_time").alias("delay"))
