"""Self-join of documents on the Jaccard similarity of their word shingles, with adaptive multi-match prefixes.

A document's shingles are ordered by rarity. Two documents that reach the threshold share at
least l of their first n - ceil(t n) + l shingles. Each document takes the l of least estimated
cost, and a pair is verified once it shares min(l, l') prefix shingles.

Rarity comes from a counting sketch over all documents, sized by their number: any order that all
documents share is right, a better one only makes fewer candidates.

No group is ever expanded into all its pairs. Copies within a task stand behind one of them.
First every document is compared with one pivot that shares its prefix shingles; then only pairs
between different components of what was found are looked for, in tiles of bounded size.
Shingles are compared as 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .columns import free_names
from .components import components
from .shingles import mix, sets_of
from .storage import saved

_U = np.uint64
SEGMENTS = 64
MOST_MATCHES = 4
HOT = 20_000
TILE = 1024
STRIP = 256
FILTER_BITS = (16, 26)
SKETCH_BITS = (21, 24)


def _meta(pos: np.ndarray, n: int, matches: int) -> np.ndarray:
    """Position, set size and required matches in one long that sorts by position: 30, 30 and 3 bits."""
    return (pos.astype(np.int64) << 33) | (n << 3) | matches


def _position(meta):
    return meta >> 33


def _size(meta):
    return (meta >> 3) & ((1 << 30) - 1)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Smaller batches, for less memory at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, 1000):
            yield batch.slice(k, 1000)


def _outline(items: np.ndarray) -> bytes | None:
    """How many shingles fall into each of 64 bins, a byte each; None if one does not fit. Two sets share no more than the sum of the smaller counts."""
    bins = np.bincount((items >> _U(20)).astype(np.int64) & 63, minlength=64)
    return bins.astype(np.uint8).tobytes() if bins.max() < 256 else None


def _outlines(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bins of each row, and whether it has any."""
    known = column.is_valid().to_numpy(zero_copy_only=False)
    rows = column.fill_null(bytes(64)).to_pylist()
    return np.frombuffer(b"".join(rows), np.uint8).reshape(-1, 64), known


def _overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum(a, b).sum(axis=1, dtype=np.int64)


def sizes_and_sketch(docs: DataFrame, words: int, bits: int) -> DataFrame:
    """A row (doc_id, n_shingles, counts: its outline) for each document, and rows (segment, counts) with each task's part of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << bits, np.int32)
        for batch in _cut(batches):
            found = [s for _, s in sets_of(batch.column(1), words)]
            slots = (np.concatenate(found or [np.zeros(0, _U)]) >> _U(64 - bits)).astype(np.int64)
            if bits > 21:
                slots, times = np.unique(slots, return_counts=True)
                sketch[slots] += times.astype(np.int32)
            else:
                sketch += np.bincount(slots, minlength=1 << bits).astype(np.int32)
            n = len(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in found], pa.int64()), pa.nulls(n, pa.int32()), pa.array([_outline(s) for s in found], pa.binary())], ["doc_id", "n_shingles", "segment", "counts"])
        for k, part in enumerate(np.split(sketch, SEGMENTS)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([k], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["doc_id", "n_shingles", "segment", "counts"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, segment int, counts binary")


def _summed(parts: DataFrame, *keys: str) -> DataFrame:
    """Adds the counts of each key as they stream by, one running sum in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["segment", "counts"])
        for batch in batches:
            for row in batch.to_pylist():
                key, part = tuple(row[k] for k in keys), np.frombuffer(zlib.decompress(row["counts"]), np.int32)
                if key == now:
                    total = np.minimum(total.astype(np.int64) + part, 2**31 - 1).astype(np.int32)
                else:
                    if now is not None:
                        yield out()
                    now, total = key, part
        if now is not None:
            yield out()

    return parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "segment int, counts binary")


def _rarity(parts: DataFrame, bits: int) -> np.ndarray:
    """The summed sketch: 2 ** bits counts. Two levels of sums, so none reads a part of every task."""
    first = _summed(parts.withColumn("part", F.pmod(F.xxhash64("counts"), F.lit(16))), "segment", "part")
    sketch = np.zeros(1 << bits, np.int32)
    for row in _summed(first, "segment").collect():
        sketch[row.segment << (bits - 6) : (row.segment + 1) << (bits - 6)] = np.frombuffer(zlib.decompress(row.counts), np.int32)
    return sketch


def _prefixes(docs: DataFrame, words: int, percent: int, bits: int, sketch) -> DataFrame:
    """Rows (kind 0, token, doc, meta, salt) of every document's prefix, and (kind 2, doc, copy of) for copies met in the same task."""
    columns = ["kind", "x", "y", "meta", "salt"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        noise = int(np.median(counts))
        met: dict[bytes, int] = {}
        for batch in _cut(batches):
            ids, token, doc, meta, salt, copies = batch.column(0).to_pylist(), [], [], [], [], []
            for row, found in sets_of(batch.column(1), words):
                me, n = ids[row], len(found)
                if me is None or n == 0:
                    continue
                key = found.tobytes() if n < 3 else mix(found).sum().tobytes() + found[:2].tobytes() + found[-2:].tobytes()
                first = met.setdefault(key, me)
                if first != me:
                    copies.append((me, first))
                    continue
                count = counts[(found >> _U(64 - bits)).astype(np.int64)]
                order = np.argsort(count, kind="stable")
                least = (percent * n + 99) // 100
                others = np.maximum(count[order[: n - least + MOST_MATCHES]].astype(np.int64) - noise, 0)
                reach = np.cumsum(others)
                cost = [(reach[min(n - least + k, len(reach)) - 1] / k + n - least + k, k) for k in range(1, MOST_MATCHES + 1) if n - least + k <= n]
                matches = min(cost)[1]
                p = n - least + matches
                token.append(found[order[:p]])
                doc.append(np.full(p, me, np.int64))
                meta.append(_meta(np.arange(p), n, matches))
                salt.append(np.where(others[:p] > HOT, ((int(mix(np.array([me & (2**63 - 1)], _U))[0]) >> 1) % (others[:p] // HOT + 1)), -1))
            if token:
                tokens = np.concatenate(token).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(tokens), np.int8)), pa.array(tokens), pa.array(np.concatenate(doc)), pa.array(np.concatenate(meta)), pa.array(np.concatenate(salt).astype(np.int32))], columns)
            if copies:
                a, b = map(list, zip(*copies, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), 2, np.int8)), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.zeros(len(a), np.int64)), pa.array(np.full(len(a), -1, np.int32))], columns)

    return docs.mapInArrow(run, "kind byte, x long, y long, meta long, salt int")


def _plausible(meta_a, meta_b, matched, percent: int):
    """Length and positional bounds of a pair that shares a token, after `matched` shared tokens at most."""
    na, nb = _size(meta_a), _size(meta_b)
    rest = np.minimum(na - _position(meta_a), nb - _position(meta_b))
    return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & ((100 + percent) * (matched + rest) >= percent * (na + nb))


def _pivots(prefixes: DataFrame, percent: int) -> DataFrame:
    """Streams over the tokens in order: drops tokens of one document, and pairs each document with the token's first (kind 1)."""
    columns = ["kind", "x", "y", "meta"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the first row of the last token, and whether it has been passed on
        for batch in batches:
            kind, x, y, meta, salt = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            copy = kind == 2
            if copy.any():
                yield pa.RecordBatch.from_arrays([pa.array(kind[copy]), pa.array(x[copy]), pa.array(y[copy]), pa.array(meta[copy])], columns)
                x, y, meta, salt = x[~copy], y[~copy], meta[~copy], salt[~copy]
            if not len(x):
                continue
            told = bool(held and held[4])
            if held:
                x, y, meta, salt = np.r_[held[0], x], np.r_[held[1], y], np.r_[held[2], meta], np.r_[held[3], salt]
            new = np.r_[True, (x[1:] != x[:-1]) | (salt[1:] != salt[:-1])]
            start = np.flatnonzero(new)
            length = np.diff(np.r_[start, len(x)])
            first = np.repeat(start, length)
            keep = np.repeat(length > 1, length) | (salt >= 0)
            skip = np.zeros(len(x), bool)
            skip[0] = told
            out = keep & ~skip
            last = start[-1]
            held = (x[last], y[last], meta[last], salt[last], bool(keep[last]))
            pair = ~new & (y != y[first])
            pair[pair] = _plausible(meta[pair], meta[first[pair]], np.minimum(_position(meta[pair]), _position(meta[first[pair]])), percent)
            n, m = int(out.sum()), int(pair.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[np.zeros(n, np.int8), np.ones(m, np.int8)]), pa.array(np.r_[x[out], y[pair]]), pa.array(np.r_[y[out], y[first[pair]]]), pa.array(np.r_[meta[out], meta[pair]])], columns)

    return prefixes.repartition("x", "salt").sortWithinPartitions("x", "salt", "meta", "y").mapInArrow(run, "kind byte, x long, y long, meta long")


def _bits(entries: int, each: int, bounds: tuple[int, int]) -> int:
    """The power of two that gives each entry so many places, within bounds that a task's memory sets."""
    return min(max((each * max(entries, 1) - 1).bit_length(), bounds[0]), bounds[1])


def _id_filter(ids: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of one hash over ids, sized by their number; false hits only cost work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, bool)
        for batch in batches:
            seen[_slot(batch.column(0).to_numpy(), bits)] = True
        if seen.any():
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.packbits(seen).tobytes(), 1)], pa.binary())], ["bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << (bits - 3), np.uint8)
        for batch in batches:
            for part in batch.column(0).to_pylist():
                seen |= np.frombuffer(zlib.decompress(part), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(seen.tobytes(), 1)], pa.binary())], ["bits"])

    seen = np.zeros(1 << (bits - 3), np.uint8)
    for row in ids.mapInArrow(run, "bits binary").repartition(4).mapInArrow(merge, "bits binary").collect():
        seen |= np.frombuffer(zlib.decompress(row.bits), np.uint8)
    return seen


def _slot(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(_U)) >> _U(64 - bits)).astype(np.int64)


def _conceivable(pairs: DataFrame, outlines: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose outlines leave the threshold within reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (p, p_known), (q, q_known) = _outlines(batch.column("p")), _outlines(batch.column("q"))
            total = p.sum(axis=1, dtype=np.int64) + q.sum(axis=1, dtype=np.int64)
            keep = ~(p_known & q_known) | ((100 + percent) * _overlap(p, q) >= percent * total)
            yield batch.filter(pa.array(keep)).select(["a", "b"])

    one = pairs.join(outlines.select(F.col("doc").alias("a"), F.col("outline").alias("p")), "a")
    two = one.join(outlines.select(F.col("doc").alias("b"), F.col("outline").alias("q")), "b").select("a", "b", "p", "q")
    return two.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold. Only documents of pairs have their sets made again."""
    pairs = saved(pairs, "pairs")
    size = _bits(2 * pairs.count(), 8, FILTER_BITS)
    seen = docs.sparkSession.sparkContext.broadcast(_id_filter(pairs.select("a").union(pairs.select("b")), size))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(seen.value).astype(bool)
        for batch in batches:
            ids = batch.column(0)
            slots = _slot(ids.fill_null(0).to_numpy(zero_copy_only=False), size)
            batch = batch.filter(pa.array(bits[slots] & ids.is_valid().to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for _, s in sets_of(batch.column(1), words)], pa.binary())], ["doc", "items"])

    items = saved(docs.mapInArrow(sets, "doc long, items binary"), "sets")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for p, q in zip(batch.column("p"), batch.column("q"), strict=True):
                u, v = np.frombuffer(p.as_buffer(), _U), np.frombuffer(q.as_buffer(), _U)
                both = len(u) + len(v) - len(np.union1d(u, v))
                keep.append(100 * both >= percent * (len(u) + len(v) - both) and both > 0)
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    one = pairs.join(items.select(F.col("doc").alias("a"), F.col("items").alias("p")), "a")
    two = one.join(items.select(F.col("doc").alias("b"), F.col("items").alias("q")), "b").select("a", "b", "p", "q")
    return two.mapInArrow(alike, "a long, b long")


def _between(tokens: DataFrame, labels: DataFrame, outlines: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of documents of different components that share as many prefix tokens as both ask for and pass all bounds."""
    pos, n = F.shiftright("meta", 33), F.shiftright("meta", 3).bitwiseAND((1 << 30) - 1)
    named = tokens.join(labels, tokens.doc == labels.node, "left").select("token", "doc", "meta", F.coalesce("component", "doc").alias("component"))
    order = Window.partitionBy("doc").orderBy("meta", "token")
    before, previous = (F.row_number().over(order) - 1).cast("long"), F.coalesce(F.lag("token").over(order), F.col("token"))
    rows = saved(named.select("*", n.alias("n"), before.alias("shared"), previous.alias("previous")), "rows")
    mixed = rows.groupBy("token").agg(F.min("n").alias("low"), F.min("component").alias("first"), F.max("component").alias("other")).where("first != other")
    own = pos - F.col("shared")  # its prefix tokens so far that no other prefix has
    need = F.greatest("low", F.floor((percent * F.col("n") + 99) / 100))
    rows = rows.join(mixed, "token").where((100 + percent) * (F.col("n") - own) >= percent * (F.col("n") + need)).select("token", "doc", "meta", "component", "shared", "previous")
    rows = saved(rows.join(outlines, "doc"), "bounded")
    mixed = rows.groupBy("token").agg(F.min("component").alias("first"), F.max("component").alias("other"), F.count("*").alias("m")).where("first != other")
    blocks = F.floor((F.col("m") + TILE - 1) / TILE)
    rows = rows.join(mixed.select("token", blocks.alias("blocks")), "token").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("token", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "doc", "meta", "component", "shared", "previous", "outline")

    def pairs_of(t: np.ndarray, bins: np.ndarray, known: np.ndarray) -> Iterator[list[np.ndarray]]:
        token, i, j, block, doc, meta, component, shared, previous = t
        own = i[0] == j[0]
        left, right = (np.arange(len(doc)),) * 2 if own else (np.flatnonzero(block == i[0]), np.flatnonzero(block == j[0]))
        for k in range(0, len(left), STRIP):
            a, b = np.meshgrid(left[k : k + STRIP], right, indexing="ij")
            ok = component[a] != component[b]
            a, b = (a[ok & (a < b)], b[ok & (a < b)]) if own else (a[ok], b[ok])
            ok = (doc[a] != doc[b]) & _plausible(meta[a], meta[b], np.minimum(shared[a], shared[b]), percent)
            a, b = a[ok], b[ok]
            asked = np.minimum(meta[a] & 7, meta[b] & 7)
            # one match is enough for most pairs: if both came here from the same shared token, they met there
            met = (previous[a] == previous[b]) & (previous[a] != token[a]) & (asked == 1)
            a, b, asked = a[~met], b[~met], asked[~met]
            ok = ~(known[a] & known[b]) | ((100 + percent) * _overlap(bins[a], bins[b]) >= percent * (_size(meta[a]) + _size(meta[b])))
            a, b, asked = a[ok], b[ok], asked[ok]
            yield [np.minimum(doc[a], doc[b]), np.maximum(doc[a], doc[b]), asked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bins, known = np.zeros((9, 0), np.int64), np.zeros((0, 64), np.uint8), np.zeros(0, bool)

        def emitted(found: list[list[np.ndarray]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in found])) for k in range(3)], ["a", "b", "need"])

        for batch in (x for source in (batches, [None]) for x in source):
            if batch is not None:
                more, more_known = _outlines(batch.column(9))
                held = np.hstack([held, np.vstack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(9)])])
                bins, known = np.vstack([bins, more]), np.r_[known, more_known]
            ends = np.flatnonzero((held[:3, 1:] != held[:3, :-1]).any(axis=0)) + 1
            cuts = [0, *ends.tolist()] + ([held.shape[1]] if batch is None and held.shape[1] else [])
            found, size = [], 0
            for k in range(len(cuts) - 1):
                for part in pairs_of(held[:, cuts[k] : cuts[k + 1]], bins[cuts[k] : cuts[k + 1]], known[cuts[k] : cuts[k + 1]]):
                    found.append(part)
                    size += len(part[0])
                if size > 100_000:
                    yield emitted(found)
                    found, size = [], 0
            if found:
                yield emitted(found)
            held, bins, known = held[:, cuts[-1] :], bins[cuts[-1] :], known[cuts[-1] :]

    found = rows.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(run, "a long, b long, need long")
    return found.groupBy("a", "b").agg(F.count("*").alias("k"), F.min("need").alias("need")).where("k >= need").select("a", "b")


def ngram_jaccard_join(documents: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each document row: the size of its set of `words`-word shingles,
    and the smallest doc_id reachable by pairs with Jaccard similarity of at least percent / 100.

    Words are runs of non-white-space after lower-casing A-Z. A text with fewer words has its whole
    sequence as one shingle; null and blank texts have none and link with nothing (component_id is
    their own doc_id). Rows with the same doc_id are one node, so a link of either counts for both.
    Rows with a null doc_id have n_shingles and a null component_id. Other columns are ignored.
    An empty table gives an empty result.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch_bits = _bits(docs.count(), 8, SKETCH_BITS)
    base = saved(sizes_and_sketch(docs, words, sketch_bits), "base")
    sizes = base.where("segment is null").select("doc_id", "n_shingles")
    outlines = base.where("segment is null and doc_id is not null").select(F.col("doc_id").alias("doc"), F.col("counts").alias("outline"))
    sketch = docs.sparkSession.sparkContext.broadcast(_rarity(base.where("segment is not null").select("segment", "counts"), sketch_bits))
    index = saved(_pivots(_prefixes(docs, words, percent, sketch_bits, sketch), percent), "index")
    tokens = index.where("kind = 0").select(F.col("x").alias("token"), F.col("y").alias("doc"), "meta")
    copies = index.where("kind = 2").select(F.col("x").alias("a"), F.col("y").alias("b"))
    met = index.where("kind = 1").groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.count("*").alias("k"))
    best = met.groupBy("a").agg(F.max_by("b", F.struct("k", -F.col("b"))).alias("b"))
    links = saved(_verified(_conceivable(best, outlines, percent), docs, words, percent).union(copies), "links")
    labels = components(links)
    more = saved(_verified(_between(tokens, labels, outlines, percent), docs, words, percent), "more")
    if not more.isEmpty():
        labels = components(links.union(more))
    out = sizes.join(labels, sizes.doc_id == labels.node, "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each_group(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """documents with one row of each group of linked texts: that of the smallest doc_id, null ids last.

    A row is named by its doc_id and a 64-bit hash of both it and its text, so rows that share an id but not a text are judged
    apart, and of rows equal in both one stays. Null and blank texts link with nothing; all columns stay, whatever
    their names; an empty table gives an empty result.
    """
    [node, many, row] = free_names(["node", "many", "row"], documents.columns)
    named = documents.withColumn(node, F.xxhash64("doc_id", "text"))
    ids = named.select(F.col(f"`{node}`").alias("node"), F.col("doc_id").cast("long").alias("id")).groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    groups = ngram_jaccard_join(named.select(F.col(f"`{node}`").alias("doc_id"), "text"), words, percent).select(F.col("doc_id").alias("node"), "component_id").distinct()
    first = groups.join(ids, "node").groupBy("component_id").agg(F.min_by(F.struct("node", "n"), F.struct(F.col("id").isNull(), "id", "node")).alias("first"))
    kept = saved(first.select(F.col("first.node").alias(node), (F.col("first.n") > 1).alias(many)), "kept")
    chosen = named.join(kept.where(f"not `{many}`"), node, "left_semi").select(*[F.col(f"`{c}`") for c in documents.columns])
    repeated = named.join(kept.where(f"`{many}`"), node, "left_semi").groupBy(f"`{node}`").agg(F.first(F.struct(*[F.col(f"`{c}`") for c in documents.columns])).alias(row))
    return chosen.unionByName(repeated.select(*[F.col(f"`{row}`")[c].alias(c) for c in documents.columns]))
