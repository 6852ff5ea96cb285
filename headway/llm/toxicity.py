"""Toxicity by a weighted finite-state grammar over clauses.

A lexer gives each word a symbol: insult, harm verb, intent, target, negation, report or other. Four
transducers read the symbols of a clause, each the output of the one before, and mark what they recognise:

    threat    a harm verb within three words after intent       arc gain 1 or more
    target    an insult or threat in a clause with a target      arc gain 1 or more
    negation  up to three words after a negation                 arc gain below 1
    report    anything after a verb of saying                    arc gain below 1

An insult or threat is worth its lexical weight times the gains of the arcs that it took; a clause is worth
the sum over its insults and threats, and a text's score is the logistic function of its clauses. The insult
lexicon, the arcs' gains and the logistic function are learned from labelled texts. Gains start from a prior and
stay on their side of 1, so a target never lowers and a negation or report never raises a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import saved

# Common words of the grammar in English, German, French and Spanish.
WORDS = {
    "t": "you your yours yourself he him his she her they them their this these those people du dich dir dein deine ihr euch sie er tu te toi ton ta tes vous votre il elle ils elles tú ti tus usted ustedes él ella ellos".split(),
    "n": "not no never nor isn't aren't wasn't don't doesn't didn't won't can't nicht nie kein keine niemals ne pas jamais aucun nunca jamás tampoco".split(),
    "r": "said says say saying called calls call told tells wrote writes quoted quotes claimed sagte sagt nannte schrieb dit disait appelé écrit dijo dice llamó escribió".split(),
    "m": "will gonna going shall should must want wanna werde wirst wird will vais va veux voy va vamos quiero".split(),
    "h": "kill murder hurt destroy beat stab shoot burn hang töten umbringen schlagen verletzen tuer frapper détruire blesser matar golpear destruir herir".split(),
    "i": "idiot idiots moron morons stupid dumb loser losers trash scum worthless pathetic disgusting clown clowns bastard".split(),
}
OTHER = "o"
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
CLAUSE = re.compile(r"[.!?;:\n]+")
PREFIXES = (4, 5, 6)
TOGETHER = 256


ARCS = ["threat", "target", "negation", "report"]
# The model's parameters: the log gains of the arcs, then slopes for the clauses and for different insults, and the bias.
PRIOR = np.array([0.5, 0.5, -1.5, -1.5, 2.0, 0.5, -3.0])
LOWEST = np.array([0.0, 0.0, -5.0, -5.0, 0.1, 0.0, -20.0])
HIGHEST = np.array([3.0, 3.0, -0.5, -0.5, 20.0, 20.0, 0.0])


class Transducer:
    """A deterministic finite-state transducer: step(state, symbol) -> (state, symbol, weights of the arc)."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def __matmul__(self, other: Transducer) -> Transducer:
        """The composition: what self puts out is other's input; an arc carries the weights of both."""

        def step(state, symbol):
            a, symbol, one = self.step(state[0], symbol)
            b, symbol, two = other.step(state[1], symbol)
            return (a, b), symbol, one | two

        return Transducer((self.start, other.start), step)

    def run(self, symbols: str) -> list[tuple[str, int]]:
        """The output symbols, each with the set of weighted arcs taken, as bits in the order of ARCS."""
        state, out = self.start, []
        for s in symbols:
            state, s, arcs = self.step(state, s)
            out.append((s, arcs))
        return out


def _threat(left: int, s: str) -> tuple[int, str, int]:
    if s == "m":
        return 3, s, 0
    return (max(0, left - 1), "x", 1) if s == "h" and left else (max(0, left - 1), s, 0)


def _target(seen: int, s: str) -> tuple[int, str, int]:
    seen = int(seen or s == "t")
    return seen, s, 2 * (seen and s in "ix")


def _negation(left: int, s: str) -> tuple[int, str, int]:
    if s == "n":
        return 3, s, 0
    return max(0, left - 1), s, 4 * (left > 0 and s in "ix")


def _report(seen: int, s: str) -> tuple[int, str, int]:
    return int(seen or s == "r"), s, 8 * (seen > 0 and s in "ix")


GRAMMAR = Transducer(0, _threat) @ Transducer(0, _target) @ Transducer(0, _negation) @ Transducer(0, _report)
PATHS = 1 << len(ARCS)
TAKEN = np.array([[path >> k & 1 for k in range(len(ARCS))] for path in range(PATHS)], float)


class Lexer(dict):
    """Symbol and lexical weight of each lower-case word, remembered for words met."""

    def __init__(self, terms: dict[str, float]):
        super().__init__()
        self.terms = terms
        self.own = {w: (s, 1.0) for s, words in WORDS.items() for w in words}

    def __missing__(self, word: str) -> tuple[str, float]:
        found = self.own.get(word)
        weight = max([self.terms.get(word, 0.0), *(self.terms.get(word[:k] + "*", 0.0) for k in PREFIXES if len(word) > k)])
        if weight and (found is None or found[0] != "h"):
            found = ("i", weight)
        if len(self) > 500_000:
            self.clear()
        self[word] = found = found or (OTHER, 0.0)
        return found


def features(text: str, lexer: Lexer, grammar: Transducer = GRAMMAR) -> list[float]:
    """The lexical weight of the text's insults and threats by the arcs they took, then log(1 + different ones)."""
    lower = text.lower()
    mass, kinds = [0.0] * PATHS, set()
    if any(lexer[w][0] in "ih" for w in WORD.findall(lower)):
        for clause in CLAUSE.split(lower):
            words = WORD.findall(clause)
            parts = [lexer[w] for w in words]
            if not any(s in "ih" for s, _ in parts):
                continue
            for word, (symbol, arcs), (_, weight) in zip(words, grammar.run("".join(s for s, _ in parts)), parts, strict=True):
                if symbol in "ix":
                    mass[arcs] += weight
                    kinds.add(word)
    return [*mass, float(np.log1p(len(kinds)))]


def logits(x: np.ndarray, model: np.ndarray) -> np.ndarray:
    """x: rows of features. An arc that a path takes multiplies its weight by the arc's gain."""
    clauses = x[:, :PATHS] @ np.exp(TAKEN @ model[: len(ARCS)])
    return model[-3] * np.log1p(clauses) + model[-2] * x[:, PATHS] + model[-1]


def fit_arcs(x: np.ndarray, y: np.ndarray, steps: int = 400) -> np.ndarray:
    """The parameters of greatest posterior probability, by damped Newton steps within the bounds.

    A normal prior around PRIOR, wide for the slopes and the bias, narrow for the gains, decides where the
    texts say nothing, as of an arc that no text takes. No rows give the prior itself.
    """
    precision = np.array([1.0] * len(ARCS) + [0.05, 0.05, 0.01])
    model = PRIOR.copy()
    damping = 1.0

    def cost(m: np.ndarray) -> float:
        z = logits(x, m)
        return float((np.logaddexp(0, z) - y * z).sum() + 0.5 * (precision * (m - PRIOR) ** 2).sum())

    now = cost(model)
    for _ in range(steps):
        gains = np.exp(TAKEN @ model[: len(ARCS)])
        clauses = x[:, :PATHS] @ gains
        slopes = (x[:, :PATHS] * gains) @ TAKEN * (model[-3] / (1 + clauses))[:, None]
        jacobian = np.column_stack([slopes, np.log1p(clauses), x[:, PATHS], np.ones(len(x))])
        p = 1 / (1 + np.exp(-np.clip(logits(x, model), -30, 30)))
        gradient = jacobian.T @ (p - y) + precision * (model - PRIOR)
        hessian = (jacobian * (p * (1 - p))[:, None]).T @ jacobian + np.diag(precision * (1 + damping))
        moved = np.clip(model - np.linalg.solve(hessian, gradient), LOWEST, HIGHEST)
        after = cost(moved)
        if after > now:
            damping *= 4
            if damping > 1e9:
                break
            continue
        done = now - after < 1e-9 * (1 + now)
        model, now, damping = moved, after, max(damping / 4, 1e-3)
        if done:
            break
    return model


def _terms_of(text: str) -> Iterator[tuple[str, str]]:
    """(term, context) of each word and word beginning; the context are the words around it."""
    words = WORD.findall(text.lower())
    for k, w in enumerate(words):
        if len(w) > 2:
            around = f"{words[k - 1] if k else ''} {words[k + 1] if k + 1 < len(words) else ''}"
            yield w, around
            for n in PREFIXES:
                if len(w) > n:
                    yield w[:n] + "*", around


def learn_terms(training: DataFrame) -> dict[str, float]:
    """Words and word beginnings of toxic texts, with weights from their log odds.

    A term must occur in four toxic texts and in one of 250, and three times out of four with neighbours of its
    own: near copies repeat a chance word with the same neighbours. Every such term is learned; the training texts,
    not the corpus, bound how many there are.
    """
    n_clean, n_toxic = (training.where(F.col("toxic") == k).count() for k in (0, 1))
    least = max(4, -(-n_toxic // 250))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (toxic if y else clean).update({t for t, _ in _terms_of(text)})
        terms = [*toxic, *(t for t in clean if t not in toxic)]
        for k in range(0, len(terms), 100_000):
            part = terms[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([toxic[t] for t in part], pa.int64()), pa.array([clean[t] for t in part], pa.int64())], ["term", "toxic", "clean"])

    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    counts = training.select("text", "toxic").mapInArrow(counted, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    likely = counts.where(F.col("toxic") >= least).withColumn("odds", odds).where("odds > 2.5")
    likely = {r.term: (r.odds, r.toxic) for r in likely.collect()}

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x for text in batch.column(0).to_pylist() for x in {(t, c) for t, c in _terms_of(text) if t in likely}]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["term", "around"])

    wide = training.where("toxic = 1").select("text").mapInArrow(spread, "term string, around string").groupBy("term").agg(F.countDistinct("around").alias("n"))
    return {r.term: min(2.0, likely[r.term][0] / 3) for r in wide.collect() if r.n >= max(least, 0.75 * likely[r.term][1])}


def train(documents: DataFrame, labels: DataFrame, sample: int = 3000) -> tuple[dict[str, float], np.ndarray]:
    """Lexicon and model from at most `sample` toxic and three times as many clean labelled texts, the first by a hash of their doc_id.

    One text a doc_id, the least one where ids repeat. The model is fitted on half of the texts, with a lexicon
    learned from the other half, so that it does not trust chance terms; the lexicon that is returned is learned from all.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    known = known.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = None
    for k in (0, 1):
        part = known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample if k else 3 * sample)
        chosen = part if chosen is None else chosen.union(part)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic"))
    training = saved(texts.select("text", "toxic", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0).alias("half")), "training")
    terms, half_terms = learn_terms(training), learn_terms(training.where("half"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexer = Lexer(half_terms)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([features(t, lexer) for t in batch.column(0).to_pylist()], pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    rows = sorted((r.x, r.y) for r in training.where("not half").select("text", "toxic").mapInArrow(run, "x array<double>, y int").collect())
    return terms, fit_arcs(np.array([x for x, _ in rows]).reshape(-1, PATHS + 1), np.array([y for _, y in rows], float))


def _scores(texts: list[str | None], lexer: Lexer, model: np.ndarray) -> np.ndarray:
    z = logits(np.array([features(t or "", lexer) for t in texts]).reshape(-1, PATHS + 1), model)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score_toxicity(documents: DataFrame, labels: DataFrame, sample: int = 3000) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each document row.

    Learns from labelled rows with crc32(doc_id as text) mod 5 other than 0 (see train). Null texts count
    as empty and get the score of a text without matches. Null or repeated ids pass through (held_out is
    false for a null id); labels without a document, null labels and other columns are ignored.
    """
    terms, model = train(documents, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexer = Lexer(terms)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(batch.column(1).to_pylist(), lexer, model))], ["doc_id", "score"])

    scored = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(documents: DataFrame, labels: DataFrame, sample: int = 3000) -> DataFrame:
    """documents without the rows whose text scores one half or more; all columns stay. The model is learned as in score_toxicity.

    Null texts count as empty and score as a text without matches. Null ids and repeated rows stay or go by their
    text; columns of any other name pass through untouched; an empty table gives an empty result.
    """
    terms, model = train(documents, labels, sample)
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexer = Lexer(terms)
        for batch in batches:
            for part in (batch.slice(k, TOGETHER) for k in range(0, batch.num_rows, TOGETHER)):  # few texts at a time as Python strings
                yield part.filter(pa.array(_scores(part.column(at).to_pylist(), lexer, model) < 0.5))

    return documents.mapInArrow(run, documents.schema)
