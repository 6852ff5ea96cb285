import math
import os
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from headway.llm import language as L
from headway.llm.language import Languages, identify_languages, normal, suffix_automaton

SF = "/root/testdata/sf0.01"


def greedy(text: bytes, samples: list[bytes]) -> int:
    """Phrases by search: the longest beginning that occurs in a sample, else one symbol."""
    count, at = 0, 0
    while at < len(text):
        n = 1
        while at + n < len(text) and any(text[at : at + n + 1] in s for s in samples):
            n += 1
        count, at = count + 1, at + n
    return count


@given(st.binary(max_size=40), st.binary(max_size=6))
def test_automaton_accepts_substrings_only(text, part):
    state, states = 0, suffix_automaton(text)
    for c in part:
        state = states[state].get(c) if state is not None else None
    assert (state is not None) == (part in text)


@pytest.mark.parametrize("few", [0, 3, 100])
@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab é!", max_size=30), min_size=1, max_size=8), st.lists(st.text(alphabet="abc é", max_size=20), min_size=1, max_size=4))
def test_phrases_equal_greedy_search(few, texts, samples):
    L.FEW, before = few, L.FEW
    learned = [tuple(map(normal, samples)), tuple(map(normal, samples[:1]))]
    both = Languages((("x", learned[0]), ("y", learned[1])))
    parsed = [normal(t) for t in texts]
    found = both.phrases([p.translate(both.table) for p in parsed]).tolist()
    L.FEW = before
    assert found == [[greedy(p, list(s)) for s in learned] for p in parsed]


def test_cheapest_language_and_share():
    m = Languages((("a", (normal("the cat sat on the mat and the hat"),)), ("b", (normal("die katze sass auf der matte und dem hut"),))))
    text = "the cat and the mat"
    (lang, score), (other, _), nothing, null, digits = m.predict([text, "der hut und die matte", "", None, "12 ¹ !?"])
    bits = [p * b for p, b in zip(m.phrases([normal(text).translate(m.table)])[0], m.bits, strict=True)]
    assert (lang, other) == ("a", "b") and score == pytest.approx(1 / sum(2 ** (min(bits) - b) for b in bits))
    assert nothing == null == digits == ("und", 0.0)
    assert Languages(()).predict(["some text"]) == [("und", 0.0)]


def test_rows_of_every_kind(spark):
    rows = [(k, "the cat sat on the mat " * 3, "en", "x") for k in range(8)] + [(8 + k, "die katze sass auf der matte " * 3, "de", "x") for k in range(8)]
    rows += [(100, None, "en", "x"), (101, "", None, "x"), (102, "123 !!", "de", "x"), (None, "the mat", "en", "x"), (103, "die matte " * 100_000, None, "x"), (103, "die matte", None, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    found = identify_languages(docs).collect()
    assert len(found) == len(rows)
    by_id = {}
    for r in found:
        by_id.setdefault(r.doc_id, []).append(r)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    assert all(by_id[k][0].lang_pred == ("en" if k < 8 else "de") for k in range(16))
    assert all(by_id[k][0].lang_pred == "und" for k in (100, 101, 102)) and by_id[None][0].lang_pred == "en"
    assert [r.lang_pred for r in by_id[103]] == ["de", "de"]
    assert identify_languages(docs.limit(0)).collect() == []
    unlabelled = identify_languages(docs.withColumn("lang", docs.lang.substr(9, 1)).where("doc_id < 3"))
    assert len(unlabelled.collect()) == 3


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    right, n = (identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").selectExpr("sum(cast(lang = lang_pred as int)) r", "count(*) n").first())
    assert n > 100 and right / n > 0.98 and math.isfinite(right)
