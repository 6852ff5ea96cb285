import numpy as np

from headway.llm import vector_links
from headway.llm.vector_links import near_duplicate_vectors, quantised, tile_links


def corpus(n=300, d=16):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, d))
    return [(int(i), [float(v) for v in np.float32(base[rng.integers(12)] + rng.normal(size=d) * rng.choice([0, 0.02, 0.1, 0.25, 1]))], int(rng.integers(3))) for i in range(n)]


def brute(rows, threshold=0.98):
    n = len(rows)
    good = [k for k, (i, v, label) in enumerate(rows) if label is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    links, root = [0] * n, list(range(n))
    for p in range(len(good)):
        for q in range(p):
            a, b = good[p], good[q]
            x, y = np.array(rows[a][1]), np.array(rows[b][1])
            if rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold:
                links[a] += 1
                links[b] += 1
                ra, rb = root[a], root[b]
                root = [min(ra, rb) if r in (ra, rb) else r for r in root]
    least = {r: min(rows[k][0] for k in range(n) if root[k] == r) for r in root}
    return {(rows[k][0], links[k], least[root[k]], rows[k][0] == least[root[k]]) for k in range(n)}


def test_bound_holds():
    x = np.random.default_rng(1).normal(size=(200, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    c, s, d, e = quantised(x)
    near = (c.astype(int) @ c.T.astype(int)) * s[:, None] * s[None, :]
    assert (np.abs(near - x @ x.T) <= d[:, None] * e[None, :] + e[:, None] + 1e-12).all()


def test_many_dimensions():
    x = np.random.default_rng(2).normal(size=(40, 3000))
    x[20:] = x[:20] + 0.01 * x[20:]
    links, a, b = tile_links(x, None, 0.98, np.ones(40), np.ones(40))
    assert (links == 1).all() and len(a) == 20


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_links, "TILE", 40)
    inf, nan = float("inf"), float("nan")
    rows = corpus() + [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [nan] + [1.0] * 15, 1), (1003, [inf] + [1.0] * 15, 1), (1004, [1.0] * 16, None), (1005, [], 1), (1006, [1.0, 2.0], 1), (1007, [2.0, 4.0], 1), (1008, [None, 4.0], 1)]
    rows += [(2000 + k, rows[0][1], rows[0][2]) for k in range(30)]
    df = spark.createDataFrame([r + (1,) for r in rows], "vec_id long, embedding array<float>, label int, n_links int")
    assert {tuple(r) for r in near_duplicate_vectors(df).collect()} == brute(rows)
    assert near_duplicate_vectors(df.limit(0)).count() == 0


def test_text_labels(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [1.0, 0.01], "a"), (3, [1.0, 0.0], "b"), (4, [1.0, 0.0], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    assert {(r.vec_id, r.n_links, r.component_id) for r in near_duplicate_vectors(df).collect()} == {(1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 0, 4)}


def test_slices_of_a_tile(monkeypatch):
    """A tile is worked off in strips and slices; the links are those of the whole."""
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(90, 8)), rng.normal(size=(70, 8))
    y[:30] = x[:30] + 0.01 * y[:30]
    whole = [tile_links(x, None, 0.6, np.ones(90), np.ones(90)), tile_links(x, y, 0.6, np.ones(90), np.ones(70))]
    monkeypatch.setattr(vector_links, "TILE", 16)
    monkeypatch.setattr(vector_links, "STRIP", 12)
    monkeypatch.setattr(vector_links, "OPEN", 7)
    parts = [tile_links(x, None, 0.6, np.ones(90), np.ones(90)), tile_links(x, y, 0.6, np.ones(90), np.ones(70))]
    for a, b in zip(whole, parts, strict=True):
        assert (a[0] == b[0]).all() and (a[1] == b[1]).all()
