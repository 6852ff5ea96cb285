import random
import re

from headway.llm.ngram_join import ngram_jaccard_join

LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows, words=4, percent=85):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), find(i)) for i in ids}


def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    rows = []
    base = [rng.choice(vocabulary) for _ in range(147)]
    for i in range(160):
        kind = i % 4
        if kind == 0:
            w = list(base)
            for _ in range(rng.randrange(7)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        elif kind == 1:
            w = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 60))] + passage
        elif kind == 2 and rows:
            w = rng.choice(rows)[1].split()
            if rng.random() < 0.6 and w:
                w = w[: rng.randrange(len(w) * 7 // 8, len(w) + 1)]
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.randrange(9))]
        rows.append((i * 3, (" " if i % 2 else "\n\t ").join(w).upper() if i % 5 == 0 else "  ".join(w)))
    return rows


def test_against_brute_force(spark):
    rows = corpus() + [(1000, None), (1001, ""), (1002, " \n"), (1003, "One two"), (1004, "one  TWO"), (1005, "é È x"), (1006, "é è x"), (1007, "x " * 30000)]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, component string").repartition(5)
    got = {tuple(r) for r in ngram_jaccard_join(df).collect()}
    assert got == brute(rows)


def test_empty_repeated_and_null(spark):
    assert ngram_jaccard_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (1, "q r s t"), (2, "q r s t"), (None, "q r s t")], "doc_id long, text string")
    assert sorted(map(tuple, ngram_jaccard_join(df).collect()), key=str) == sorted([(1, 2, 1), (1, 2, 1), (1, 1, 1), (2, 1, 1), (None, 1, None)], key=str)
