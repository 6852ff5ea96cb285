"""Reproducible shuffle and sharding: a Feistel permutation with cycle walking over global row numbers, in SQL functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import saved

ROUNDS = 6
BUCKET_ROWS = 50_000


def _round(x: DataFrame, a: int, b: int, seed: int) -> DataFrame:
    """One Feistel permutation of [0, a b): column x is split into a left half below a and a right half below b."""
    x = x.withColumns({"_l": F.expr(f"x div {b}"), "_r": F.pmod("x", F.lit(b))})
    for k in range(ROUNDS):
        mine, other, size = ("_l", "_r", a) if k % 2 == 0 else ("_r", "_l", b)
        x = x.withColumn(mine, F.pmod(F.col(mine) + F.pmod(F.xxhash64(F.lit(seed * 31 + k), other), F.lit(size)), F.lit(size)))
    return x.withColumn("_y", F.col("_l") * b + F.col("_r")).drop("_l", "_r")


def permuted(rows: DataFrame, column: str, n: int, seed: int) -> DataFrame:
    """rows with the column, which holds numbers in [0, n), replaced by their image under a permutation of [0, n).

    The permutation is a Feistel network on a domain a b just above n. Images of n or more are mapped
    again until they are below n; how many steps that takes at most is found by walking the fewer than
    sqrt(n) + 1 numbers of the domain outside [0, n).
    """
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))
    outside = rows.sparkSession.range(n, a * b).select(F.col("id").alias("x"))
    # only those with no image from outside are ever reached from within; their walks end within
    steps, outside = 0, saved(outside.join(_round(outside, a, b, seed).select(F.col("_y").alias("x")), "x", "left_anti"), "walk")
    while not outside.isEmpty():
        steps += 1
        outside = saved(_round(outside, a, b, seed).where(F.col("_y") >= n).select(F.col("_y").alias("x")), "walk")
    out = _round(rows.withColumn("x", F.col(column)), a, b, seed).withColumn("x", F.col("_y")).drop("_y")
    for _ in range(steps):
        out = _round(out, a, b, seed).withColumn("x", F.when(F.col("x") < n, F.col("x")).otherwise(F.col("_y"))).drop("_y")
    return out.withColumn(column, F.col("x")).drop("x")


def numbered(groups: DataFrame, keys: list[str], weight: str, n: int) -> DataFrame:
    """Adds `number`: how many rows come before each group in a fixed order of all groups, a group counting for its weight.

    Groups are dealt by hash over buckets of about BUCKET_ROWS and ordered within; only one count a bucket is added up over all.
    """
    buckets = max(16, -(-n // BUCKET_ROWS))
    dealt = groups.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    within = F.sum(weight).over(Window.partitionBy("_bucket").orderBy(*keys)) - F.col(weight)
    totals = dealt.groupBy("_bucket").agg(F.sum(weight).alias("_rows"))
    before = totals.select("_bucket", (F.sum("_rows").over(Window.orderBy("_bucket")) - F.col("_rows")).alias("_before"))
    return dealt.withColumn("_within", within).join(before, "_bucket").withColumn("number", F.col("_before") + F.col("_within")).drop("_bucket", "_within", "_before")


def shard(documents: DataFrame, shards: int = 8, seed: int = 20240229, text: Column | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each document row.

    Rows are numbered in an order that only their contents decide, the numbers permuted, and image p
    goes to shard p mod shards, slot p div shards: counts of shards differ by at most one and slots have no
    gaps (law `rows`; grown_shard is null). Size is the text's UTF-8 bytes plus 1; null texts count as empty.
    Rows with equal doc_id, size and checksum are numbered as one group and then told apart, so repeated
    rows are no hot spot. Null ids are numbered first; other columns are ignored; an empty table gives an empty result.
    """
    body = F.coalesce("text", F.lit("")) if text is None else text
    keys = ["doc_id", "size", "text_crc32"]
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).cast("long").alias("text_crc32"))
    groups = saved(rows.groupBy(*keys).agg(F.count("*").alias("copies")), "groups")
    n = groups.agg(F.sum("copies")).first()[0] or 0
    each = numbered(groups, keys, "copies", n).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    image = permuted(each.select(*keys, (F.col("number") + F.col("copy")).alias("image")), "image", n, seed)
    return image.select(*keys, F.lit("rows").alias("law"), F.pmod("image", F.lit(shards)).cast("int").alias("shard"), F.expr(f"image div {shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
