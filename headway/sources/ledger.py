"""One writer for all sinks: the outputs of a batch appear together or not at all.

Each output of a batch goes to a folder of its own, `path/name/batch=k`. When all are written, the batch is entered in the
ledger; readers see only batches of the ledger. A batch that fails between two outputs leaves folders that nobody
reads, and its retry replaces them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..functions.tables import scratch

LEDGER = "_ledger"


def write_batch(outputs: dict[str, DataFrame], path: str, batch: int) -> None:
    """Writes all outputs of a batch, then enters it in the ledger. The same batch again replaces what it wrote before."""
    for name, rows in outputs.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")
    if outputs:
        spark = next(iter(outputs.values())).sparkSession
        entry = spark.createDataFrame([(name,) for name in sorted(outputs)], "output string").coalesce(1)
        entry.write.mode("overwrite").parquet(f"{path}/{LEDGER}/entry={batch}")


def committed(spark: SparkSession, path: str, name: str, schema: str | None = None) -> DataFrame:
    """The rows of an output, with their batch, of every batch that the ledger has."""
    reader = spark.read.option("basePath", f"{path}/{name}")
    entries = spark.read.parquet(f"{path}/{LEDGER}").where(F.col("output") == name).select(F.col("entry").alias("batch"))
    return (reader.schema(schema) if schema else reader).parquet(f"{path}/{name}").join(F.broadcast(entries), "batch", "left_semi")


def publish(stream: DataFrame, outputs: Callable[[DataFrame, int], dict[str, DataFrame]], path: str, checkpoint: str) -> StreamingQuery:
    """Runs a stream whose every batch gives several tables; outputs(batch rows, now in ms) names them."""

    def write(batch: DataFrame, batch_id: int) -> None:
        now = int(batch.sparkSession.sql("select unix_millis(current_timestamp())").first()[0])
        batch = batch.persist()
        try:
            with scratch(batch.sparkSession):
                write_batch(outputs(batch, now), path, batch_id)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class LateRows(StreamingQueryListener):
    """Counts the rows that come after the watermark: a row for each query, batch and operator that dropped any, under path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        dropped = [(str(p.id), p.name, p.batchId, k, s.numRowsDroppedByWatermark) for k, s in enumerate(p.stateOperators) if s.numRowsDroppedByWatermark]
        if dropped:
            rows = self.spark.createDataFrame(dropped, "query string, name string, batch long, operator int, dropped long")
            rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/of={p.id}/at={p.batchId}")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
