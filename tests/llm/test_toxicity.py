import random
import zlib

import numpy as np
import pytest

from headway.llm.toxicity import ARCS, GRAMMAR, PATHS, PRIOR, Lexer, Transducer, _negation, _report, _target, _threat, drop_toxic, features, fit_arcs, logits, score_toxicity


def marks(symbols):
    return [(s, [a for k, a in enumerate(ARCS) if arcs >> k & 1]) for s, arcs in GRAMMAR.run(symbols)]


def test_grammar():
    assert marks("oti")[-1] == ("i", ["target"])
    assert marks("oio")[1] == ("i", [])
    assert marks("tnoi")[-1] == ("i", ["target", "negation"])
    assert marks("troti")[-1] == ("i", ["target", "report"])
    assert marks("tmoht")[3] == ("x", ["threat", "target"]) and marks("toh")[-1] == ("h", [])


def score(text, model=PRIOR, grammar=GRAMMAR):
    return float(logits(np.array([features(text, Lexer({"zork*": 1.0}), grammar)]), model)[0])


def test_clauses():
    lexer = Lexer({"zork*": 1.0})
    assert features("You are an idiot. Good day.", lexer)[2] == 1.0
    assert features("A zorkish day", lexer)[0] > 0 and features("zork day", lexer)[0] == 0
    assert features("They said. You idiot", lexer)[2] == 1.0 and features("They said you idiot", lexer)[2 + 8] == 1.0
    assert features("", lexer) == [0.0] * (PATHS + 1)
    assert score("you idiot") > score("an idiot") > score("not an idiot") and score("you idiot") > score("they said you idiot")
    assert score("I will kill you") > score("I kill time")


@pytest.mark.parametrize("left_out, text, lower", [(0, "i will hurt it", True), (1, "you idiot", True), (2, "not an idiot", False), (3, "wrote an idiot", False)])
def test_each_transducer_counts(left_out, text, lower):
    """Without a transducer the score of a text that it recognises falls (threat, target) or rises (negation, report)."""
    plain = Transducer(0, lambda state, s: (state, s, 0))
    steps = [Transducer(0, s) for s in (_threat, _target, _negation, _report)]
    steps[left_out] = plain
    rest = steps[0] @ steps[1] @ steps[2] @ steps[3]
    assert (score(text, grammar=rest) < score(text)) == lower and score(text, grammar=rest) != score(text)


def test_learned_gains():
    """Targeted insults are toxic, negated ones are not: the gains follow, and stay on their side of 1."""
    rows = [("you idiot", 1), ("an idiot", 0), ("you not idiot", 0), ("hello", 0)] * 50
    x = np.array([features(t, Lexer({})) for t, _ in rows])
    model = fit_arcs(x, np.array([float(y) for _, y in rows]))
    assert model[1] > PRIOR[1] and model[2] <= -0.5 and score("you idiot", model) > 0 > score("an idiot", model)
    assert fit_arcs(x[:0], np.zeros(0)).tolist() == PRIOR.tolist()


def test_held_out_accuracy(spark):
    rng = random.Random(2)
    plain = ["".join(rng.choice("aeioulrstn") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    bad = ["gruft" + s for s in ("a", "or", "ing", "el", "ost", "um")] + ["blarf"]
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 80))]
        toxic = int(i % 6 == 0)
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), 0.5))
        labels.append((i, 1, toxic))
    rows += [(None, None, 0.5), (5000, "", 0.5), (5001, None, 0.5), (5002, "ok " * 50000, 0.5), (0, rows[0][1], 0.5)]
    labels += [(9999, 0, 1), (None, 1, 1), (3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double").repartition(4)
    truth = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = score_toxicity(docs, truth).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    assert sum(r.predicted == (r.doc_id < 600 and r.doc_id % 6 == 0) for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert score_toxicity(docs.limit(0), truth).count() == 0 and score_toxicity(docs, truth.limit(0)).count() == len(rows)


def test_drop_toxic(spark):
    """Columns with the names of the score's own stay as they are; null and empty texts stay."""
    rows = [(1, "you idiot you moron, you stupid scum. you trash", 7.0, "a"), (2, "hello", 8.0, "b"), (2, "hello", 8.0, "b"), (None, None, 9.0, "c"), (4, "", 1.0, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, x string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert sorted(map(str, drop_toxic(docs, none).collect())) == sorted(map(str, docs.where("doc_id is null or doc_id != 1").collect()))
    assert drop_toxic(docs.limit(0), none).count() == 0
