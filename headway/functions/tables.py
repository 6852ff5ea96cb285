"""Intermediate tables on shared storage, and size-checked broadcast."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 16 << 20
_OWN: dict[str, str] = {}
_SCRATCH: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a new temporary one where it is unset (local runs and tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        app = spark.sparkContext.applicationId
        folder = _OWN.setdefault(app, _OWN.get(app) or "file://" + tempfile.mkdtemp(prefix="spark-headway-"))
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has been written to; see scratch for when it goes."""
    path = f"{shared_folder(spark)}/headway/{name}-{uuid.uuid4().hex}"
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return path


def saved(df: DataFrame, name: str = "table") -> DataFrame:
    """df written to the shared folder and read back: cuts the lineage of a loop, and outlives any executor."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes what saved wrote within the block when the block ends: for jobs that end in it, such as a stream's batch."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its rows take at most so many bytes (texts by their length, other values by eight), else as it is."""
    return df.hint("broadcast") if size_of(df, limit) <= limit else df


def size_of(df: DataFrame, limit: int) -> int:
    """The bytes of df's rows; more than limit if there are more rows than limit could hold."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) if kind in ("string", "binary") else F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) if "<" in kind else F.lit(0) for c, kind in df.dtypes), F.lit(8 * len(df.columns)))
    return df.select(size.alias("s")).limit(limit // (8 * len(df.columns)) + 1).agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s")).first().s


def lookup(table: DataFrame, key: str, value: str, limit: int = BROADCAST_BYTES) -> Callable[[Column], Column] | None:
    """An expression that gives the value of a key of a small table, NULL for others; None if the table is over the limit.

    The table is one value, short maps by the keys' hashes, so that rows are neither joined nor shuffled however many keys they have.
    """
    if size_of(table, limit) > limit:
        return None
    buckets = max(1, table.count())
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")
    each = table.where(F.col(key).isNotNull()).groupBy(place(F.col(key)).alias("_place")).agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias("_entries"))
    whole = each.agg(F.map_from_entries(F.collect_list(F.struct("_place", "_entries"))).alias("_m"))
    kind = dict(table.dtypes)
    filled = F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda k: F.try_element_at(F.col("_m"), k))
    filled = whole.select(filled.cast(f"array<map<{kind[key]},{kind[value]}>>").alias("_m"))
    values = filled.scalar()
    return lambda c: F.try_element_at(F.get(values, place(c)), c)
