"""Segmented scans: what a row has to know of all rows before it of its key, without a key in one task.

Rows are dealt by ranges of key and order, so a hot key lies in as many blocks as its rows need. A block sums up what it
hands on (a last value, a sum, its last rows); these summaries, one for each key and block, are put together in order,
and each block starts from what came before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import saved

BLOCK = "_block"


def in_blocks(rows: DataFrame, key: str, *order: str, parts: int | None = None) -> DataFrame:
    """rows with the number of their range of (key, order) as _block, on shared storage, so that the ranges stay as they are.

    Blocks are numbered in order. parts: their number; else Spark's number of shuffle partitions, joined where small.
    """
    dealt = rows.repartitionByRange(parts, key, *order) if parts else rows.repartitionByRange(key, *order)
    return saved(dealt.withColumn(BLOCK, F.spark_partition_id()), "blocks")


def _own(key: str, *order: str):
    return Window.partitionBy(key, BLOCK).orderBy(*order)


def _with_carry(rows: DataFrame, summary: DataFrame, key: str) -> DataFrame:
    """Joined by key and block, by which the rows are partitioned anyway."""
    return rows.join(summary, [key, BLOCK], "left")


def last_before(rows: DataFrame, value: Column, name: str, key: str, *order: str, inclusive: bool = False) -> DataFrame:
    """Adds the last value that is not null of the rows before each one of its key, itself too if inclusive."""
    place = F.when(F.col("_value").isNotNull(), F.struct(*order))
    rows = rows.withColumn("_value", value)
    handed = rows.groupBy(key, BLOCK).agg(F.max_by("_value", place).alias("_handed"))
    before = F.last("_handed", ignorenulls=True).over(Window.partitionBy(key).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1))
    summary = handed.select(key, BLOCK, before.alias("_before"))
    inside = F.last("_value", ignorenulls=True).over(_own(key, *order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    return _with_carry(rows.withColumn("_inside", inside), summary, key).withColumn(name, F.coalesce("_inside", "_before")).drop("_value", "_inside", "_before")


def sum_up_to(rows: DataFrame, value: Column, name: str, key: str, *order: str) -> DataFrame:
    """Adds the sum of value over the rows of its key up to each one."""
    rows = rows.withColumn("_value", value)
    before = F.sum("_handed").over(Window.partitionBy(key).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1))
    summary = rows.groupBy(key, BLOCK).agg(F.sum("_value").alias("_handed")).select(key, BLOCK, before.alias("_before"))
    inside = F.sum("_value").over(_own(key, *order).rowsBetween(Window.unboundedPreceding, 0))
    return _with_carry(rows.withColumn("_inside", inside), summary, key).withColumn(name, F.col("_inside") + F.coalesce("_before", F.lit(0))).drop("_value", "_inside", "_before")


def last_values(rows: DataFrame, value: str, n: int, name: str, key: str, *order: str) -> DataFrame:
    """Adds the array of the last n values of its key up to and with each row, oldest first. value must not be null."""
    inside = F.collect_list(value).over(_own(key, *order).rowsBetween(1 - n, 0))
    if n < 2:
        return rows.withColumn(name, inside)
    place = F.row_number().over(Window.partitionBy(key, BLOCK).orderBy(*[F.col(c).desc() for c in order]))
    tails = rows.withColumn("_place", place).where(F.col("_place") < n).groupBy(key, BLOCK).agg(F.array_sort(F.collect_list(F.struct((-F.col("_place")).alias("p"), F.col(value).alias("v")))).alias("_tail"))
    before = F.flatten(F.collect_list(F.transform("_tail", lambda x: x["v"])).over(Window.partitionBy(key).orderBy(BLOCK).rowsBetween(1 - n, -1)))
    both = lambda: F.concat(F.coalesce("_before", F.array()), "_inside")
    out = _with_carry(rows.withColumn("_inside", inside), tails.select(key, BLOCK, before.alias("_before")), key)
    return out.withColumn(name, F.slice(both(), F.greatest(F.size(both()) - (n - 1), F.lit(1)), n)).drop("_inside", "_before")


def following(rows: DataFrame, value: str, name: str, key: str, *order: str) -> DataFrame:
    """Adds the value of the next row of its key, null for the last."""
    inside = F.lead(F.struct(F.col(value).alias("v"))).over(_own(key, *order))
    heads = rows.groupBy(key, BLOCK).agg(F.min_by(value, F.struct(*order)).alias("_head"))
    after = F.lead("_head").over(Window.partitionBy(key).orderBy(BLOCK))
    return _with_carry(rows.withColumn("_inside", inside), heads.select(key, BLOCK, after.alias("_after")), key).withColumn(name, F.when(F.col("_inside").isNotNull(), F.col("_inside.v")).otherwise(F.col("_after"))).drop("_inside", "_after")
