import random
import re

import pytest

from headway.llm import decontamination
from headway.llm.decontamination import decontaminate

LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, size=10):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + size]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[x]
        out.append((i, len(w), len(hit), len(found), tuple(sorted(found)), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_against_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(decontamination, "small", (lambda df: df) if bound == 0 else decontamination.small)
    rng = random.Random(8)
    vocabulary = ["the", "of", "Été", "É", "zu", "9a"] + [f"v{k}" for k in range(25)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 9, 10, 11, 25])))) for k in range(25)] + [(100, None), (101, "..."), (102, "a a a a a a a a a a a a"), (None, "unnamed " * 10), (7, "the of the of the of the of the of zu")]
    docs = []
    for i in range(60):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            t = words(rng.choice(items)[1])
            a = rng.randrange(len(t) + 1) // 2
            w[len(w) // 2 : len(w) // 2] = t[a:] if rng.random() < 0.5 else t
        docs.append((i, ", ".join(w).upper() if i % 3 else "  ".join(w)))
    docs += [(0, docs[1][1]), (1, docs[1][1]), (None, docs[2][1]), (None, None), (500, ""), (501, "a " * 20000)]
    frame = spark.createDataFrame([r + (1,) for r in docs], "doc_id long, text string, n_words int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, tuple(r["items"]), r.contaminated) for r in decontaminate(frame, bench).collect()), key=str)
    assert got == brute(docs, [(i, t) for i, t in items if i is not None] + [("", t) for i, t in items if i is None]) or got == brute(docs, [(i, t) for i, t in items if i is not None])


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate(docs.limit(0), bench).count() == 0
    assert [tuple(r)[2:5] for r in decontaminate(docs, bench.limit(0)).collect()] == [(2, 0, 0)]
    assert [r.n_hit for r in decontaminate(docs, bench).collect()] == [2]
