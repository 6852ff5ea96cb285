"""Keyed state of streams: rolling history with frame timers, and the last score of each station.

State lies in Spark's state store under the query's checkpoint: it survives restarts, and is read between batches by the
state data source. Both functions set the store that such state needs on the session.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.forecast import FRAME_S, HISTORY

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FRAMES = "station int, frame long, delay double, history array<double>, seen int, late long"
SNAPSHOT = "station int, frame long, delay double, history array<double>, seen int, version string"
SCORES = "station int, cascade_id string, total double, event_time_ms long"


def _with_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class _History(StatefulProcessor):
    """A station's frames in order. A timer at the end of each frame puts it out, whether it had readings or not."""

    def __init__(self, frame_ms: int, history: int, version: str):
        self.frame_ms, self.length, self.version = frame_ms, history, version

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.past = handle.getListState("history", "delay double")
        self.now = handle.getValueState("now", "next long, delay double, seen int, late long")
        self.waiting = handle.getMapState("waiting", "frame long", "ts double, delay double")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """A snapshot of another network version is left alone: the station starts cold."""
        if initialState.version == self.version:
            self.past.put([(d,) for d in initialState.history])
            self.now.update((initialState.frame + 1, initialState.delay, initialState.seen, 0))
            self.handle.registerTimer((initialState.frame + 2) * self.frame_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        best: dict[int, tuple[float, float]] = {}
        for r in rows:
            if r.ts is not None and r.delay is not None:
                frame = int(r.ts * 1000 // self.frame_ms)
                best[frame] = max(best.get(frame, (r.ts, r.delay)), (float(r.ts), float(r.delay)))
        if not best:
            return
        following, delay, seen, late = tuple(self.now.get()) if self.now.exists() else (min(best), 0.0, 0, 0)
        for frame, read in best.items():
            if frame < following:
                late += 1
            else:
                held = tuple(self.waiting.getValue((frame,))) if self.waiting.containsKey((frame,)) else read
                self.waiting.updateValue((frame,), max(held, read))
        self.now.update((following, delay, seen, late))
        self.handle.registerTimer((following + 1) * self.frame_ms)
        return
        yield

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        following, delay, seen, late = tuple(self.now.get())
        past = [r[0] for r in self.past.get()] if self.past.exists() else []
        end = timerValues.getCurrentWatermarkInMs() // self.frame_ms
        while following < end:
            if self.waiting.containsKey((following,)):
                delay = self.waiting.getValue((following,))[1]
                self.waiting.removeKey((following,))
            past = [*past, delay][-self.length :]
            seen = min(seen + (delay != 0), self.length + 1)
            yield Row(station=key[0], frame=following, delay=delay, history=past, seen=seen, late=late)
            following, late = following + 1, 0
        self.past.put([(d,) for d in past])
        self.now.update((following, delay, seen, late))
        self.handle.registerTimer((following + 1) * self.frame_ms)

    def close(self) -> None:
        pass


def rolling_history_stream(observations: DataFrame, version: str, snapshot: DataFrame | None = None, frame_seconds: int = FRAME_S, history: int = HISTORY, delay: str = "2 minutes") -> DataFrame:
    """(station, frame, delay, history, seen, late) of each frame that the watermark has passed, as forecast.rolling_history has it.

    observations(station, ts seconds, delay, event_time timestamp). A station's frames start with its first reading, or
    after the last frame of a snapshot (see history_snapshot) if that is of the same network version. late: frames with
    readings that came after the frame was put out; those readings change nothing.
    """
    _with_store(observations.sparkSession)
    start = {"initialState": snapshot.groupBy("station")} if snapshot is not None else {}
    keyed = observations.select(F.col("station").cast("int").alias("station"), F.col("ts").cast("double").alias("ts"), "delay", "event_time").withWatermark("event_time", delay).groupBy("station")
    return keyed.transformWithState(_History(frame_seconds * 1000, history, version), FRAMES, "append", "eventTime", **start)


def history_snapshot(framed: DataFrame, version: str) -> DataFrame:
    """The last row of each station with the network version it belongs to."""
    last = F.row_number().over(Window.partitionBy("station").orderBy(F.desc("frame")))
    return framed.withColumn("_n", last).where("_n = 1").select("station", "frame", "delay", "history", "seen", F.lit(version).alias("version"))


class _Latest(StatefulProcessor):
    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "cascade_id string, total double, event_time_ms long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = tuple(self.latest.get()) if self.latest.exists() else None
        new = max(((r.event_time_ms, r.cascade_id, r.total) for r in rows), default=None)
        if new and (held is None or new[:2] > (held[2], held[0])):
            self.latest.update((new[1], new[2], new[0]))
            yield Row(station=key[0], cascade_id=new[1], total=new[2], event_time_ms=new[0])

    def close(self) -> None:
        pass


def latest_scores_stream(scores: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """(station, cascade_id, total, event_time_ms) of each station whose last score a batch changes; scores older than ttl_ms expire.

    The last scores themselves are state: see latest_scores_now.
    """
    _with_store(scores.sparkSession)
    keyed = scores.where("event_time_ms is not null and cascade_id is not null").select(F.col("station").cast("int").alias("station"), "cascade_id", F.col("total").cast("double").alias("total"), "event_time_ms").groupBy("station")
    return keyed.transformWithState(_Latest(ttl_ms), SCORES, "update", "processingTime" if ttl_ms else "none")


def latest_scores_now(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The last score of each station as of the last batch, read from the state store under a query's checkpoint."""
    _with_store(spark)
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "latest").load()
    value = "value.value" if "value" in state.schema["value"].dataType.names else "value"
    return state.select("key.station", f"{value}.cascade_id", f"{value}.total", f"{value}.event_time_ms")
