"""Packing token pieces into sequences of limited length by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import zlib
from bisect import insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import saved
from .tokens import byte_encoder

GROUP = 4096
WINDOWS = 1 << 20
FEW = 16


def differenced(sizes: list[int], k: int) -> list[tuple[int, list[int]]]:
    """Splits item numbers into at most k windows of near-equal sums.

    Each item starts as a partial partition of its own. The two partial partitions with the largest
    spread are merged, the largest window of one with the smallest of the other, until one is left.
    Only non-empty windows are kept, largest first.

    A partition is a list of (sum, node) by sum; a node beyond the items stands for two joined windows.
    A partition with few windows is put into one with many by binary search, so that a merge costs little
    more than the smaller side.
    """
    joined: list[tuple[int, int]] = []
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = n = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heap[0][2]
        if len(a) < len(b):
            a, b = b, a
        overlap = max(0, len(a) + len(b) - k)
        met = []
        for (x, p), (y, q) in zip(a[:overlap], reversed(b[:overlap]), strict=True):
            met.append((x + y, n + len(joined)))
            joined.append((p, q))
        if FEW * len(b) < len(a):
            del a[:overlap]
            for window in b[overlap:] + met:
                insort(a, window)
        else:
            a = sorted(a[overlap:] + b[overlap:] + met)
        heapq.heapreplace(heap, (a[0][0] * (len(a) == k) - a[-1][0], serial, a))
        serial += 1

    def items(node: int) -> list[int]:
        found, open_ = [], [node]
        while open_:
            node = open_.pop()
            if node < n:
                found.append(node)
            else:
                open_ += joined[node - n]
        return found

    return [(s, items(node)) for s, node in reversed(heap[0][2])] if heap else []


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Item numbers by window.

    The window count starts at the least possible one and rises whenever a window is over capacity: first by
    what is over, in windows, then by twice as much each time. Between the last count that was too small and
    the first that is enough, the least that is enough is found by halving.
    """
    k = max(1, -(-sum(sizes) // capacity))
    found, low, step = differenced(sizes, k), k, 0
    while over := sum(s - capacity for s, _ in found if s > capacity):
        low, step = k, 2 * step or -(-over // capacity)
        k += step
        found = differenced(sizes, k)
    while k - low > 1:
        middle = (k + low) // 2
        fewer = differenced(sizes, middle)
        if fewer[0][0] > capacity:
            low = middle
        else:
            k, found = middle, fewer
    return [members for _, members in found]


def pieces(documents: DataFrame, tokenizer: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    """Every document's ids, its end id included, cut into pieces of capacity ids and a rest."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "spread"] + ["ids"] * with_ids
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, serial = byte_encoder(tokenizer).encode, 0
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + end
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    part = ids[4 * start : 4 * (start + capacity)]
                    serial += 1
                    rows.append((doc_id, start, len(part) // 4, zlib.crc32(part), total, zlib.crc32(b"%d %d" % (doc_id or 0, serial)), part))
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:6]] + [pa.array(columns[6], pa.binary())] * with_ids, names)

    schema = ", ".join(f"{n} long" for n in names[:6]) + ", ids binary" * with_ids
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def pack(documents: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for) of sequences of at most capacity ids.

    A document's pieces of full capacity are sequences of their own. The rests are spread at random over
    groups of about 4,096 and each group is differenced into near-equal windows; no row sees more than its group.
    Null texts are empty documents: one piece with the end id. Repeated rows and null ids are packed like
    others; other columns are ignored; an empty table gives an empty result.
    """
    cut = saved(pieces(documents, tokenizer, capacity, end_id, with_ids), "pieces")
    rests = cut.where(F.col("length") < capacity)
    groups = max(1, -(-rests.count() // GROUP))
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("spread", "ascending")])
        sizes, base = t["length"].to_pylist(), t["group"][0].as_py() * WINDOWS
        sequence, offset = [0] * len(sizes), [0] * len(sizes)
        for k, members in enumerate(windows(sizes, capacity)):
            at = 0
            for i in members:
                sequence[i], offset[i], at = base + k, at, at + sizes[i]
        return t.append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64())).select(out)

    kinds = dict(cut.dtypes) | {"sequence_id": "bigint", "offset": "bigint"}
    schema = ", ".join(f"{n} {kinds[n]}" for n in out)
    packed = rests.withColumn("group", F.pmod("spread", F.lit(groups))).groupBy("group").applyInArrow(run, schema)
    full = cut.where(F.col("length") == capacity).withColumn("sequence_id", F.lit(groups * WINDOWS) + F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(full.select(out))
