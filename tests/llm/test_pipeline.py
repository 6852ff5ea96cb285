import random

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(9)
    words = ["".join(rng.choice("aeiou") + rng.choice("lnrst") for _ in range(rng.randrange(2, 5))) for _ in range(500)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, prose(60), "en", "s", 0) for i in range(120)]
    labels = [(i, 1, 0) for i in range(120)]
    for i in range(120, 150):
        w = prose(50).split()
        for _ in range(4):
            w.insert(rng.randrange(50), rng.choice(["zogger", "zoggish", "frell"]))
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 0, 1))
    item = prose(30)
    rows += [(200, rows[3][1], "en", "s", 0), (201, rows[4][1] + " tail", "en", "s", 0), (202, prose(20) + " " + item + " " + prose(20), "en", "s", 0), (203, prose(30) + " mail a.b@c.org now", "en", "s", 0), (204, None, None, None, None)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), {i: t for i, t, *_ in rows}


def test_stages(spark, corpus):
    path, texts = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, ids = docs.columns, lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept.append(ids(docs))
    assert not kept[0] & set(range(120, 150)) and len(kept[0]) == 125
    assert kept[0] - kept[1] == {200, 201}
    assert kept[1] - kept[2] == {202}
    text = {r.doc_id: r.text for r in docs.collect()}
    assert text[203].endswith("mail <EMAIL> now") and all(text[i] == texts[i] for i in text if i != 203)
    packed = corpus_pipeline.packing(spark, docs, path).collect()
    assert {r.doc_id for r in packed} == kept[3]


CLASHING = "doc_id long, text string, n_chars long, _id long, _key string, _n int, _spans string, node string, many int, row string, score double, `spans of ip` string, hit_doc string"


def clashing_rows():
    rng = random.Random(5)
    prose = lambda n: " ".join("".join(rng.choice("bcdfg") + rng.choice("aeiou") for _ in range(3)) for _ in range(n))
    same, other = prose(40), prose(40)
    rows = [(1, same, 1), (2, same, 2), (3, other, 3), (3, other, 3), (3, prose(40), 4), (None, prose(9), 5), (None, same, 6), (7, None, 7), (8, "", 8), (9, "1.2.3.4 " + prose(30), 9)]
    return [(i, t, len(t or ""), n, f"k{n}", n, f"s{n}", "x", n, "r", 0.5, "q", "h") for i, t, n in rows]


def test_hard_rows(spark, corpus):
    """Clashing columns, repeated rows, shared ids, nulls and empty tables in every stage that returns documents."""
    path, _ = corpus
    docs = spark.createDataFrame(clashing_rows(), CLASHING)
    want = {"toxicity": docs.count(), "ngram_join": 7, "decontamination": docs.count(), "pii": docs.count()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, path)
        assert got.columns == docs.columns
        rows = got.collect()
        assert len(rows) == want[name], name
        if name == "pii":
            assert sorted(r._n for r in rows if "<IP>" in (r.text or "")) == [9] and all(r.n_chars == len(r.text) for r in rows if r.text is not None)
        else:
            assert set(rows) <= set(docs.collect())
        if name == "ngram_join":
            assert sorted(r._n for r in rows) == [1, 3, 4, 5, 7, 8, 9]
        assert stage(spark, docs.limit(0), path).count() == 0
    assert corpus_pipeline.packing(spark, docs, path).count() == docs.count()


def test_one_column_less(spark, corpus):
    """Stages need only doc_id and text."""
    docs = spark.createDataFrame([(1, "a@b.org")], "doc_id long, text string")
    assert corpus_pipeline.pii(spark, docs, corpus[0]).collect()[0].text == "<EMAIL>"
