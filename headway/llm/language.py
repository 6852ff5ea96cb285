"""Language identification by cross-parsing entropy.

Per language a suffix automaton holds labelled text. Another text is parsed greedily: each phrase is the longest
beginning of what is left that occurs in the labelled text, found by walking the automaton until no transition is
left. A phrase is worth the logarithm of the labelled text's size (it names a place there), so a text costs
phrases * log2(size) bits in a language; the language in which it costs least wins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHARS = 32768
ROWS = 64
LANGUAGES = 32
UNKNOWN, BREAK, FIRST = 0, 1, 2
FEW = 24
TOGETHER = 1 << 24
SPACED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def normal(text: str) -> bytes:
    """The text in lower case and UTF-8, each stretch of ASCII characters that are no letters as one space, one before and after it."""
    return b" %b " % b" ".join(text.lower().encode().translate(SPACED).split())


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """The transitions of each state of the smallest automaton of all substrings of text; state 0 is the start."""
    following: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new, p = len(following), last
        following.append({})
        link.append(0)
        length.append(length[last] + 1)
        while p >= 0 and c not in following[p]:
            following[p][c] = new
            p = link[p]
        if p >= 0:
            q = following[p][c]
            if length[q] != length[p] + 1:
                copy = len(following)
                following.append(dict(following[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and following[p].get(c) == q:
                    following[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
            else:
                link[new] = q
        last = new
    return following


class Languages:
    """Counts the phrases of coded texts in each language's automaton.

    All automata lie in one array, a row of symbols for each state. A transition is the place of the next state's row;
    0 stands for none, as no transition leads to a start. The last row is where an unknown symbol leads: nothing
    follows, so such a symbol is a phrase of its own. One coding covers the bytes that occur in any labelled text.
    """

    def __init__(self, samples: tuple[tuple[str, tuple[bytes, ...]], ...]):
        known = sorted({b for _, texts in samples for t in texts for b in t})
        code = {b: FIRST + k for k, b in enumerate(known)}
        self.table = bytes(code.get(b, UNKNOWN) for b in range(256))
        self.names = [lang for lang, _ in samples]
        self.symbols = symbols = FIRST + len(known)
        automata = [bytes([BREAK]).join(t.translate(self.table) for t in texts) for _, texts in samples]
        self.bits = np.array([math.log2(max(2, len(text))) for text in automata])
        rows = [suffix_automaton(text) for text in automata]
        self.dead = symbols * sum(map(len, rows))
        self.steps, base, starts = np.zeros(self.dead + symbols, np.int32), 0, []
        for states in rows:
            for k, state in enumerate(states):
                for c, to in state.items():
                    self.steps[base + k * symbols + c] = base + to * symbols
            first = self.steps[base : base + symbols]
            starts.append(np.where(first == 0, self.dead, first))
            base += len(states) * symbols
        self.starts = np.array(starts, np.int32).reshape(len(samples), symbols)

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """How many phrases each text has in each language, as a matrix.

        All texts and languages go on together, one symbol a step, the longest texts first so that those which
        go on stay in front; the last few go on one by one, as a step of few costs as much as one of many.
        """
        order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
        sizes = [len(texts[k]) for k in order]
        codes = np.frombuffer(b"".join(texts[k] for k in order), np.uint8)
        places = np.concatenate([[0], np.cumsum(sizes)])[:-1].astype(np.int64)
        at = np.full((len(self.names), len(texts)), self.dead, np.int32)
        counts = np.zeros((len(self.names), len(texts)), np.int64)
        rows, on, step = np.arange(len(self.names))[:, None], len(texts), 0
        while True:
            while on and sizes[on - 1] <= step:
                on -= 1
            if on <= FEW:
                break
            c = codes[places[:on] + step]
            to = self.steps[at[:, :on] + c]
            missing = to == 0
            counts[:, :on] += missing
            at[:, :on] = np.where(missing, self.starts[rows, c], to)
            step += 1
        steps = memoryview(self.steps)
        for lang, start in enumerate(self.starts.tolist()):
            for k in range(on):
                state, count = int(at[lang, k]), 0
                for c in texts[order[k]][step:]:
                    state = steps[state + c]
                    if not state:
                        count += 1
                        state = start[c]
                counts[lang, k] += count
        out = np.empty_like(counts)
        out[:, order] = counts
        return out.T

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The language of fewest bits (of equal ones the first by name), and its share of 2^-bits over all languages."""
        out = [("und", 0.0)] * len(texts)
        lettered = [k for k, t in enumerate(texts) if t and self.names and has_letter(t)]
        while lettered:
            now, size = [], 0
            while lettered and (not now or size + len(texts[lettered[-1]]) <= TOGETHER):
                now.append(lettered.pop())
                size += len(texts[now[-1]])
            bits = self.phrases([normal(texts[k]).translate(self.table) for k in now]) * self.bits
            best = bits.argmin(axis=1)
            share = 1 / np.exp2(np.maximum(bits.min(axis=1)[:, None] - bits, -1000.0)).sum(axis=1)
            for k, lang, score in zip(now, best.tolist(), share.tolist(), strict=True):
                out[k] = (self.names[lang], score)
        return out


@lru_cache(2)
def languages(samples: tuple[tuple[str, tuple[bytes, ...]], ...]) -> Languages:
    return Languages(samples)


def labelled_samples(documents: DataFrame, chars: int = CHARS, rows: int = ROWS, most: int = LANGUAGES) -> tuple[tuple[str, tuple[bytes, ...]], ...]:
    """(language, normalised texts) of a bounded sample of the labelled rows whose crc32(doc_id as text) mod 4 is not 2.

    The `most` languages of most labelled rows are learned, each from about 4 * rows rows chosen by a hash of doc_id and
    text, the beginning of each (chars * 2 / rows characters, more where a language has fewer rows), equal ones once, up
    to chars characters in all. These bounds keep what reaches the driver below 8 * chars * most characters; they
    bound the training only, predictions read whole texts.
    """
    known = documents.select(F.col("doc_id").cast("string").alias("id"), F.col("lang").cast("string").alias("lang"), "text")
    known = known.where("id is not null and lang is not null and text is not null").where(F.pmod(F.crc32("id"), F.lit(4)) != 2)
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most).collect()}
    if not counts:
        return ()
    per_lang = lambda f: F.element_at(F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, f(n))]), F.col("lang"))
    place = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    piece = F.substring("text", F.lit(1), per_lang(lambda n: 2 * chars // min(n, rows)))
    chosen = known.where(F.col("lang").isin(list(counts))).where(place < per_lang(lambda n: 4.0 * rows / n)).select("lang", piece.alias("piece")).distinct()
    by_lang: dict[str, list[str]] = {lang: [] for lang in counts}
    for r in chosen.orderBy("lang", F.xxhash64("piece"), "piece").collect():
        if (left := chars - sum(map(len, by_lang[r.lang]))) > 0 and has_letter(r.piece):
            by_lang[r.lang].append(r.piece[:left])
    return tuple((lang, tuple(map(normal, texts))) for lang, texts in sorted(by_lang.items()) if texts)


def identify_languages(documents: DataFrame, chars: int = CHARS, rows: int = ROWS, most: int = LANGUAGES) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each document row.

    The language of the cheapest cross-parsing over the whole text; `und` with score 0 if the text is null, empty or
    has no letter, or if nothing was learned. Score: the language's share of 2^-bits over the learned languages. Ties
    go to the first language by name. Repeated rows get equal results; a null doc_id is not held out and not learned
    from; other columns are ignored; an empty table gives an empty result. Learning: see labelled_samples.
    """
    samples = labelled_samples(documents, chars, rows, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = languages(samples).predict
        for batch in batches:
            found = predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    predicted = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    return predicted.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
