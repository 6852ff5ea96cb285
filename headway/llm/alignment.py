"""Alignment of two tokenizers' tokens over the same bytes, and how often their ids are linked.

The ends of both tokenizers' tokens are compared by diagonal runs: at the current index shift, ever longer stretches of
the two end arrays are compared at once and jumped while equal, all of it one-to-one; where they differ, the few tokens
up to the next common end are one irregular group, which sets the shift anew.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from operator import add

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import saved
from .tokens import LONGEST_PIECE, MEMO, byte_encoder

SHIFT = 20
LOW = (1 << SHIFT) - 1
CHUNK = 2_000_000
TOGETHER = 1 << 20


def diagonal_runs(a: list[int], b: list[int]) -> Iterator[tuple[int, int, int, int, bool]]:
    """(i, p, j, q, single) over two rising arrays of ends with the same last end: tokens i to p - 1 of a and j to q - 1 of b.

    single: one irregular group; else a stretch of one-to-one groups.
    """
    i = j = 0
    n = len(a)
    while i < n:
        if a[i] == b[j]:
            k = step = 1
            while (x := a[i + k : i + k + step]) and x == b[j + k : j + k + step]:
                k += step
                step *= 2
            while step > 1:
                step //= 2
                if (x := a[i + k : i + k + step]) and x == b[j + k : j + k + step]:
                    k += step
            k = min(k, n - i)
            yield i, i + k, j, j + k, False
            i, j = i + k, j + k
            if i == n:
                return
        p, q = i, j
        x, y = a[p], b[q]
        while x != y:
            if x < y:
                p += 1
                x = a[p]
            else:
                q += 1
                y = b[q]
        yield i, p + 1, j, q + 1, True
        i, j = p + 1, q + 1


class PairNames(dict):
    """`a|b` for an id pair held as a's id shifted and b's id added."""

    def __missing__(self, pair: int) -> str:
        if len(self) >= MEMO:
            self.clear()
        self[pair] = name = f"{pair >> SHIFT}|{pair & LOW}"
        return name


class Aligner:
    """Tokens of space + text in both vocabularies, a byte-level one (.json) and a sentencepiece one (.model), and their groups.

    No token of either goes from a character other than white space into a space, so equal words are encoded once;
    texts with runs of spaces or with white space before a space are encoded whole.
    """

    def __init__(self, path_a: str, path_b: str):
        with open(path_a, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        self.encode_a = byte_encoder(path_a).whole
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        piece = self.b.id_to_piece
        self.bytes_b = [bytes([int(piece(k)[1:-1], 16)]) if self.b.is_byte(k) else piece(k).replace("▁", " ").encode() for k in range(self.b.get_piece_size())]
        self.sizes_a = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, k in vocabulary.items():
            self.sizes_a[k] = len(token)  # a byte-level token has a character for each byte
        self.sizes_b = np.array(list(map(len, self.bytes_b)))
        self.names = PairNames()
        self.words: dict[str, tuple[bytes, bytes] | None] = {}

    def tokens(self, text: str, b: list[int]) -> tuple[bytes, bytes] | None:
        """Both vocabularies' ids over space + text, b's as given, as little-endian 32-bit bytes; None if b's bytes differ from it."""
        if b"".join(map(self.bytes_b.__getitem__, b)) != b" " + text.encode():
            return None
        return self.encode_a(" " + text), np.array(b, "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        """Encodes words that can stand alone, all in one go: tokens end where words do, so the ids are cut there."""
        if not words:
            return
        text = [f" {w}".encode() for w in words]
        a, b = self.encode_a(" " + " ".join(words)), self.b.encode(words, num_threads=1)
        if b"".join([self.bytes_b[k] for k in chain.from_iterable(b)]) != b"".join(text):
            self.words.update((w, self.tokens(w, ids)) for w, ids in zip(words, b, strict=True))
            return
        ends = self.sizes_a[np.frombuffer(a, "<u4")].cumsum().searchsorted(np.cumsum(list(map(len, text)))) + 1
        flat = np.fromiter(chain.from_iterable(b), "<u4").tobytes()
        first_a = first_b = 0
        for w, last_a, n in zip(words, (4 * ends).tolist(), map(len, b), strict=True):
            self.words[w] = (a[first_a:last_a], flat[first_b : first_b + 4 * n])
            first_a, first_b = last_a, first_b + 4 * n

    def text_tokens(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """The ids of each text in both vocabularies; None for texts without tokens."""
        split = [t.split(" ") if t and "▁" not in t else [] for t in texts]
        new = set(chain.from_iterable(split)) - self.words.keys()
        if len(self.words) + len(new) > MEMO:
            self.words.clear()
            new = set(chain.from_iterable(split))
        self._learn([w for w in new if w and len(w) <= LONGEST_PIECE and not w[-1].isspace()])
        out = []
        for text, words in zip(texts, split, strict=True):
            found = None
            if words:
                parts = list(map(self.words.get, words))
                found = self.tokens(text, self.b.encode(text)) if None in parts else tuple(map(b"".join, zip(*parts, strict=True)))
            out.append(found and tuple(np.frombuffer(x, "<u4").astype(np.int64) for x in found))
        return out

    def groups(self, a: np.ndarray, b: np.ndarray) -> tuple[str, int]:
        """The groups as `a1,a2|b1;a3|b2`, ids in decimal, and their number."""
        high, low = (a << SHIFT).tolist(), b.tolist()
        parts: list[str] = []
        for i, p, j, q, single in diagonal_runs(self.sizes_a[a].cumsum().tolist(), self.sizes_b[b].cumsum().tolist()):
            if single:
                parts.append(f"{','.join([str(k >> SHIFT) for k in high[i:p]])}|{','.join(map(str, low[j:q]))}")
            else:
                parts += map(self.names.__getitem__, map(add, high[i:p], low[j:q]))
        return ";".join(parts), len(parts)

    def links(self, tokens: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text, its linked id pairs in order and how many pairs of overlapping token occurrences have each.

        Between two neighbouring ends of either side lies one overlap, and each overlap lies between two such ends. The
        texts are laid one after another, so that one pass over the bytes serves all of them.
        """
        a, b = (np.concatenate([t[k] for t in tokens]) for k in (0, 1))
        ends_a, ends_b = self.sizes_a[a].cumsum(), self.sizes_b[b].cumsum()
        at_a, at_b = np.zeros(ends_a[-1] + 1, bool), np.zeros(ends_a[-1] + 1, bool)
        at_a[ends_a], at_b[ends_b] = True, True
        ends = np.flatnonzero(at_a | at_b)
        pairs = (a[at_a.cumsum()[ends] - at_a[ends]] << SHIFT) + b[at_b.cumsum()[ends] - at_b[ends]]
        lasts = ends.searchsorted(ends_a[np.cumsum([len(t[0]) for t in tokens]) - 1]) + 1
        return [np.unique(part, return_counts=True) for part in np.split(pairs, lasts[:-1])]


@lru_cache(1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def aligned(documents: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Each document's counts, its groups' hash, its linked id pairs in order and how many links each has."""
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
    kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        for batch in batches:
            for part in parts_of(batch):
                tokens = both.text_tokens(part.column(1).to_pylist())
                linked = iter(both.links(known) if (known := [t for t in tokens if t]) else [])
                rows = []
                for t in tokens:
                    if not t:
                        rows.append((0, 0, 0, 0, "", b"", b""))
                        continue
                    (text, n), (pairs, times) = both.groups(*t), next(linked)
                    rows.append((len(t[0]), len(t[1]), n, int(times.sum()), hashlib.sha256(text.encode()).hexdigest(), pairs.astype("<i8").tobytes(), times.astype("<i4").tobytes()))
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True))], [f.split()[0] for f in schema.split(", ")])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def parts_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most TOGETHER bytes of text, or of a single row."""
    sizes = [len(x.as_buffer() or b"") if x.is_valid else 0 for x in batch.column(1)]
    first = size = 0
    for k, n in enumerate(sizes):
        if k > first and size + n > TOGETHER:
            yield batch.slice(first, k - first)
            first, size = k, 0
        size += n
    if batch.num_rows:
        yield batch.slice(first)


def pair_counts(links_of_documents: DataFrame) -> DataFrame:
    """(pair, n, best): how many documents hold each id pair linked, and whether no pair of the same a id is in more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def counted() -> pa.RecordBatch:
            pairs, n = np.unique(np.concatenate(waiting), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n.astype(np.int64))], ["pair", "n"])

        for batch in batches:
            for pairs in batch.column(0).to_pylist():
                waiting.append(np.frombuffer(pairs, "<i8"))
                if (size := size + len(waiting[-1])) >= CHUNK:
                    yield counted()
                    waiting, size = [], 0
        if size:
            yield counted()

    counts = saved(links_of_documents.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "counts")
    a_id = F.shiftright("pair", SHIFT)
    most = counts.groupBy(a_id.alias("a")).agg(F.max("n").alias("most"))
    return counts.join(most, a_id == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align_tokenizers(documents: DataFrame, path_a: str, path_b: str, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each document row.

    path_a is a byte-level vocabulary (.json), path_b a sentencepiece one (.model), both at that path on every machine.
    Null and empty texts, and texts of which a vocabulary changes a byte, have no tokens: zeros and an empty groups_sha256.
    Special tokens' strings are plain text. Repeated rows count as documents of their own; null ids pass through; other
    columns are ignored; an empty table gives an empty result.

    The pair counts, bounded by the vocabularies and not by the corpus, are sent to the tasks in ranges of `chunk` pairs,
    one range after another, so no task and not the driver ever holds more than one range.
    """
    found = saved(aligned(documents, path_a, path_b), "aligned")
    counts = saved(pair_counts(found), "pairs")
    out = found.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    ranges = -(-counts.count() // chunk)
    bounds = [None, *(counts.approxQuantile("pair", [k / ranges for k in range(1, ranges)], 0.01) if ranges > 1 else []), None]
    for k, (low, high) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        part = counts if low is None else counts.where(F.col("pair") >= int(low))
        part = part if high is None else part.where(F.col("pair") < int(high))
        out = _with_counts(out if k == 0 else saved(out, "counted"), part)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _with_counts(documents: DataFrame, counts: DataFrame) -> DataFrame:
    """documents with the counts of these pairs added to n_best and count_sum."""
    table = counts.orderBy("pair").toArrow()
    known = documents.sparkSession.sparkContext.broadcast([table[c].to_numpy() for c in ("pair", "n", "best")])
    names = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = known.value
        n, best = np.append(n, 0), np.append(best, False)
        for batch in batches:
            columns = dict(zip(names, batch.columns, strict=True))
            pairs = [np.frombuffer(x, "<i8") for x in columns["pairs"].to_pylist()]
            times = np.concatenate([np.frombuffer(x, "<i4") for x in columns["times"].to_pylist()] or [np.zeros(0, "<i4")])
            starts = np.concatenate([[0], np.cumsum([len(p) for p in pairs])]).astype(np.int64)
            wanted = np.concatenate(pairs or [np.zeros(0, "<i8")])
            at = keys.searchsorted(wanted)
            at[at == len(keys)] = 0 if len(keys) else len(n) - 1
            at = np.where(keys[at] == wanted, at, len(n) - 1) if len(keys) else at
            for name, values in (("n_best", best[at] * times.astype(np.int64)), ("count_sum", n[at] * times)):
                sums = np.concatenate([[0], np.cumsum(values)])
                columns[name] = pa.array(columns[name].to_numpy(zero_copy_only=False) + sums[starts[1:]] - sums[starts[:-1]], pa.int64())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    return documents.mapInArrow(run, documents.schema)
