"""Token counts by byte-pair merging, and fast token ids, both memoised by white-space separated piece."""

from __future__ import annotations

import heapq
import json
import re
import sys
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

# The pre-tokenisation patterns of the two vocabularies; letters, digits and others are the library's own classes.
WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[{others}]+"
BYTE_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

MEMO = 400_000
LONGEST_PIECE = 48


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def merged_length(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many symbols are left when the adjacent pair of lowest rank, leftmost first, is merged again and again.

    A heap holds the pairs, a linked list the neighbours; pairs that a merge has changed are skipped
    when popped. The count is the initial symbols less the merges.
    """
    n = len(symbols)
    symbol, left, right = list(symbols), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(ranks[p], i, *p) for i in range(n - 1) if (p := (symbol[i], symbol[i + 1])) in ranks]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i]
        if symbol[i] != a or j >= n or symbol[j] != b:
            continue
        merges += 1
        symbol[i], symbol[j] = a + b, ""
        right[i] = k = right[j]
        if k < n:
            left[k] = i
            if (p := (a + b, symbol[k])) in ranks:
                heapq.heappush(heap, (ranks[p], i, *p))
        if (h := left[i]) >= 0 and (p := (symbol[h], a + b)) in ranks:
            heapq.heappush(heap, (ranks[p], h, *p))
    return n - merges


BLOCK = 256


def _library(path: str) -> Tokenizer:
    """The library's normaliser and first split of a vocabulary file, without its vocabulary."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    empty = {"type": "BPE", "vocab": {}, "merges": []}
    return Tokenizer.from_str(json.dumps({"version": "1.0", "added_tokens": [], "model": empty, "normalizer": spec["normalizer"], "pre_tokenizer": spec["pre_tokenizer"]["pretokenizers"][0]}))


def character_classes(path: str) -> dict[str, str]:
    """The letters, digits and other characters of the vocabulary's own pre-tokeniser, as ranges for a pattern.

    Libraries differ in their version of Unicode, so the library itself is asked: a letter stays in the word of a
    letter before it, an "other" in that of a mark; a digit is a word of its own; white space is dropped.
    Whole blocks of code points first, one by one where a block is mixed.
    """
    split = _library(path).pre_tokenizer.pre_tokenize_str
    found: dict[str, list[list[int]]] = {"letters": [], "digits": [], "others": []}

    def add(kind: str, first: int, last: int) -> None:
        if found[kind] and found[kind][-1][1] == first - 1:
            found[kind][-1][1] = last
        else:
            found[kind].append([first, last])

    for at in range(0, sys.maxunicode + 1, BLOCK):
        if 0xD800 <= at < 0xE000:
            continue
        block = "".join(map(chr, range(at, at + BLOCK)))
        whole = next((kind for kind, mark in (("letters", "x"), ("others", "!")) if len(split(mark + block)) == 1), None)
        if whole:
            add(whole, at, at + BLOCK - 1)
            continue
        for c in range(at, at + BLOCK):
            if len(split("x" + chr(c))) == 1 and split(chr(c)):
                add("letters", c, c)
            elif len(split("!" + chr(c))) == 1 and split(chr(c)):
                add("others", c, c)
            elif split(chr(c)):
                add("digits", c, c)
    return {kind: "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) for kind, ranges in found.items()}


class WordCounter:
    """Counts tokens for a lower-casing BPE vocabulary with word ends (a tokenizers .json file).

    classes are its character classes, where they have been found before.
    """

    def __init__(self, path: str, classes: tuple[tuple[str, str], ...] = ()):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = spec["model"]["merges"]
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): k for k, m in enumerate(merges)}
        self.end = spec["model"]["end_of_word_suffix"] or ""
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.normalize = _library(path).normalizer.normalize_str
        self.find = re.compile(WORD_PATTERN.format(**dict(classes or character_classes(path)))).findall
        self.find_ascii = re.compile(WORD_PATTERN.format(letters="a-z", digits="0-9", others=r"!-/:-`{-\x7f\x00-\x08\x0e-\x1f")).findall
        self.symbols = byte_symbols()
        self.word = lru_cache(MEMO)(self._word)
        outer = self

        class Pieces(dict):
            def __missing__(self, piece: str) -> int:
                count = outer._piece(piece)
                if len(piece) <= LONGEST_PIECE:
                    if len(self) >= MEMO:
                        self.clear()
                    self[piece] = count
                return count

        self.pieces = Pieces()

    def _word(self, word: str) -> int:
        symbols = [self.symbols[b] for b in word.encode()]
        symbols[-1] += self.end
        return merged_length(symbols, self.ranks)

    def _piece(self, piece: str) -> int:
        words = self.find_ascii(piece.lower()) if piece.isascii() else self.find(self.normalize(piece))
        return sum(self.word(w) if len(w) <= LONGEST_PIECE else self._word(w) for w in words)

    def count(self, text: str) -> int:
        parts, found = [text], 0
        for special in self.special:
            if special in text:
                parts = [x for p in parts for x in p.split(special)]
                found = len(parts) - 1
        return found + sum(sum(map(self.pieces.__getitem__, p.replace("\n", " ").split(" "))) for p in parts)


class ByteEncoder:
    """Ids of a byte-level BPE vocabulary (a tokenizers .json file) as little-endian unsigned 32-bit bytes.

    No match of the pattern goes from a non-space character into a space or line feed, so a text can be
    cut before each of these that follows a non-space character, and equal pieces encoded once. A text
    with other white space at such a place, or with runs of white space, is encoded as a whole.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {c: b for b, c in enumerate(byte_symbols())}
        self.special = {t["content"]: t["id"].to_bytes(4, "little") for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in token): k for token, k in spec["model"]["vocab"].items() if token not in self.special}
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})
        outer = self

        class Pieces(dict):
            def __missing__(self, piece: str) -> bytes | None:
                ids = None if not piece or piece == "\n" or piece[-1].isspace() else outer.whole(piece if piece[0] == "\n" else " " + piece)
                if len(piece) <= LONGEST_PIECE:
                    if len(self) >= MEMO:
                        self.clear()
                    self[piece] = ids
                return ids

        self.pieces = Pieces()

    def whole(self, text: str) -> bytes:
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes() if len(text) > 400 else b"".join(i.to_bytes(4, "little") for i in self.encoding.encode_ordinary(text))

    def _plain(self, text: str) -> bytes:
        first, *rest = text.replace("\n", " \n").split(" ")
        if not first or first[-1].isspace():
            return self.whole(text)
        try:
            return self.whole(first) + b"".join(map(self.pieces.__getitem__, rest))
        except TypeError:
            return self.whole(text)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        for special, ids in self.special.items():
            if special in text:
                return ids.join(map(self.encode, text.split(special)))
        return self._plain(text)


@lru_cache(1)
def word_counter(path: str, classes: tuple[tuple[str, str], ...]) -> WordCounter:
    return WordCounter(path, classes)


@lru_cache(1)
def byte_encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


def token_counts(documents: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each document row; tokenizer is the path of the vocabulary file on every machine.

    Null texts count as empty (0 bytes, 0 tokens). Whole texts of any length, repeated rows and null ids
    pass through; other columns are ignored; an empty table gives an empty result.
    """

    classes = tuple(character_classes(tokenizer).items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = word_counter(tokenizer, classes).count
        for batch in batches:
            n = [count(t) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    counted = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", size).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
