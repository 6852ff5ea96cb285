"""Cosine near-duplicates of embeddings by int8 tile products with rigorous quantisation error bounds."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import saved

TILE = 4096  # rows of a block, at least
TILE_BYTES = 64 << 20  # of a block, at most
COPIES = 8  # blocks of a label, while they stay within TILE_BYTES
STRIP = 512
OPEN = 50_000
EXACT = 1024  # so many products of two int8 values add up exactly in float32


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, their scale, the length of the decoded vector and of the quantisation error, for each unit vector."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    decoded = codes * scale[:, None]
    return codes, scale, np.linalg.norm(decoded, axis=1), np.linalg.norm(unit - decoded, axis=1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products of int8 rows, exact: float32 sums stay below 2 ** 24 within a slice of dimensions."""
    total = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], EXACT):
        total += a[:, k : k + EXACT].astype(np.float32) @ b[:, k : k + EXACT].astype(np.float32).T
    return total


def tile_links(x: np.ndarray, y: np.ndarray | None, threshold: float, weight_x: np.ndarray, weight_y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of the rows of x with those of y, or with each other if y is None.

    Returns for the rows of x, then y, the weights of the rows linked to them, and a forest (two arrays
    of row numbers) that connects all linked rows. Never holds more than a strip of the tile.

    With x = decoded x + error x: x.y = dx.dy + dx.ey + ex.y, so the cosine differs from the decoded
    product by at most |dx| |ey| + |ex|. Only pairs that this bound leaves open are computed in full.
    """
    size = lambda v: np.sqrt(np.einsum("ij,ij->i", v, v))
    own = y is None
    y, weight_y = (x, weight_x) if own else (y, weight_y)
    nx, ny = size(x), size(y)
    ux, uy = x / nx[:, None], y / ny[:, None]
    cx, sx, dx, ex = quantised(ux)
    cy, sy, _, ey = (cx, sx, dx, ex) if own else quantised(uy)
    n, m = len(x), len(y)
    links = np.zeros(n + (0 if own else m))
    label = np.arange(n + (0 if own else m))
    shift = 0 if own else n
    for at, over in itertools.product(range(0, n, STRIP), range(0, m, TILE)):
        if own and over + TILE <= at:
            continue
        rows, others = slice(at, min(n, at + STRIP)), slice(over, min(m, over + TILE))
        near = products(cx[rows], cy[others]) * sx[rows, None] * sy[None, others]
        near += dx[rows, None] * ey[None, others] + ex[rows, None] + 1e-9
        i, j = np.nonzero(near >= threshold)
        i, j = i + at, j + over
        if own:
            i, j = i[i < j], j[i < j]
        cosine = np.concatenate([np.einsum("ij,ij->i", x[i[k : k + OPEN]], y[j[k : k + OPEN]]) for k in range(0, len(i), OPEN)] or [np.zeros(0)]) / nx[i] / ny[j]
        i, j = i[cosine >= threshold], j[cosine >= threshold]
        np.add.at(links, i, weight_y[j])
        np.add.at(links, j + shift, weight_x[i])
        for a, b in zip(np.unique(i), np.split(j, np.flatnonzero(np.diff(i)) + 1), strict=False):
            met = np.unique(np.r_[label[a], label[b + shift]])
            if len(met) > 1:
                label[np.isin(label, met)] = met[0]
    moved = np.flatnonzero(label != np.arange(len(label)))
    return links, moved, label[moved]


def near_duplicate_vectors(embeddings: DataFrame, threshold: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each vector row.

    Two rows of the same non-null label and dimension are linked when the cosine of their embeddings, in
    double precision, is at least the threshold; labels are of any type that compares. n_links counts the other rows linked directly,
    component_id is the smallest vec_id reachable. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing. Rows with equal label and embedding are compared as one,
    with their number as weight; vec_ids should be unique, repeated ones make one node. Other columns are
    ignored; an empty table gives an empty result.

    Each label's vectors are dealt by hash over blocks, and each pair of blocks is a task of its own: a hot label
    gives more tasks, not larger ones. A vector travels once for each block of its label: at most COPIES times while
    blocks of TILE_BYTES hold the label, n * its bytes / TILE_BYTES times beyond.
    """
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    usable = vectors.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda v: v != 0))
    groups = saved(usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight")), "vectors")
    counts = groups.groupBy("label", F.size("embedding").alias("size")).agg(F.count("*").alias("n"))
    fitting = F.greatest(F.lit(TILE), F.least(F.ceil(F.col("n") / COPIES), F.floor(TILE_BYTES / (8 * F.col("size")))))
    blocks = F.ceil(F.col("n") / fitting)
    dealt = groups.withColumn("size", F.size("embedding")).join(counts.select("label", "size", blocks.alias("blocks")), ["label", "size"])
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("first"), "blocks")).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("label", "size", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "first", "weight", "embedding")

    def run(t: pa.Table) -> pa.Table:
        first, weight, block = (t[c].to_numpy() for c in ("first", "weight", "block"))
        x = t["embedding"].combine_chunks().flatten().to_numpy().reshape(len(first), -1)
        x = x / np.abs(x).max(axis=1)[:, None]  # so that no square over- or underflows
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        order = np.argsort(first, kind="stable") if i == j else np.r_[np.flatnonzero(block == i), np.flatnonzero(block == j)]
        first, weight, x = first[order], weight[order], x[order]
        cut = len(x) if i == j else int((block == i).sum())
        none = cut == 0 or i != j and cut == len(x)
        links, a, b = (np.zeros(len(x)), np.zeros(0, int), np.zeros(0, int)) if none else tile_links(x[:cut], None if i == j else x[cut:], threshold, weight[:cut], weight[cut:])
        some = links > 0
        return pa.table({"a": pa.array(np.r_[first[some], first[a]]), "b": pa.array(np.r_[first[some], first[b]]), "links": pa.array(np.r_[links[some].astype(np.int64), np.zeros(len(a), np.int64)])})

    found = saved(dealt.groupBy("label", "size", "i", "j").applyInArrow(run, "a long, b long, links long"), "vector-links")
    linked = found.groupBy(F.col("a").alias("first")).agg(F.sum("links").alias("links"))
    labels = components(found.where("a != b").select("a", "b"))
    known = groups.join(linked, "first", "left").join(labels, F.col("first") == labels.node, "left")
    known = known.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("component", "first").alias("component"))
    out = vectors.join(known, ["label", "embedding"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
