import random
import struct
import sys
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from headway.llm.packing import differenced, pack, windows  # noqa: E402
from headway.llm.tokens import ByteEncoder, WordCounter, token_counts  # noqa: E402

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
word_counter, byte_encoder = WordCounter(WORD), ByteEncoder(BYTE)
word_library, byte_library = Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)
TEXTS = ["", " ", "\n", "a", " a", "a ", "a  b", "a \n b", "a\n\nb", "\n a", "a\t b", "a  b", "x\x1c y\x85z", "It's WE'LL don't 's 't", "ΑΣ ΟΔΟΣ. İI", "é ́x", "東京 123 ４５", "a<|endoftext|>b <|endoftext|>", "<|startoftext|> hi<|endoftext|><|startoftext|>", "!!!???", "x" * 3000, "9 " * 500, "​ q 　w", "😀👍🏽 ok", "foo.\nBar baz,\nqux"]


def ids(text):
    return struct.pack(f"<{len(e)}I", *e) if (e := byte_library.encode(text, add_special_tokens=False).ids) else b""


@pytest.mark.parametrize("text", TEXTS)
def test_fixed_texts(text):
    assert word_counter.count(text) == len(word_library.encode(text, add_special_tokens=False).ids)
    assert byte_encoder.encode(text) == ids(text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\tab'sÉé.!1 ́")), st.characters(codec="utf-8")), max_size=40))
def test_random_texts(text):
    assert word_counter.count(text) == len(word_library.encode(text, add_special_tokens=False).ids)
    assert byte_encoder.encode(text) == ids(text)


@pytest.mark.parametrize("before", ["", "x", "¨"])
def test_every_code_point(before):
    """Each code point alone, after a letter and after a mark; blocks far from any assigned one only alone."""
    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and (not before or c < 0x24000 or 0x2F000 <= c < 0x32000 or 0x3C000 <= c < 0x3E000 or 0xE0000 <= c < 0xE0200)]
    for k in range(0, len(points), 4096):
        text = " ".join(before + chr(c) for c in points[k : k + 4096])
        if word_counter.count(text) != len(word_library.encode(text, add_special_tokens=False).ids):
            words = [before + chr(c) for c in points[k : k + 4096]]
            assert [] == [ascii(w) for w in words if word_counter.count(w) != len(word_library.encode(w, add_special_tokens=False).ids)]
        assert byte_encoder.encode(text) == ids(text)


@given(st.lists(st.integers(1, 100), max_size=60))
def test_windows_hold_each_item_once(sizes):
    found = windows(sizes, 100)
    assert sorted(i for w in found for i in w) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in w) <= 100 for w in found)


def test_differencing_balances():
    assert [s for s, _ in differenced([8, 7, 6, 5, 4], 2)] == [16, 14]
    rng = random.Random(1)
    sizes = [rng.randrange(1, 2048) for _ in range(1000)]
    found = windows(sizes, 2048)
    assert len(found) <= 1.025 * sum(sizes) / 2048


def plain_differenced(sizes, k):
    """The same differencing, each partition a full list of k windows."""
    parts = [sorted([0] * (k - 1) + [s]) for s in sizes]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[-1] - p[0])
        a, b = parts.pop(), parts.pop()
        parts.append(sorted(x + y for x, y in zip(a, reversed(b), strict=True)))
    return [s for s in reversed(parts[0]) if s]


@given(st.lists(st.integers(1, 10**6), min_size=1, max_size=80, unique=True), st.integers(1, 9))
def test_differencing_equals_plain(sizes, k):
    """Distinct sizes leave no ties between single items; the largest window and the number of windows agree."""
    sizes = [s * 7919 + i * i for i, s in enumerate(sizes)]
    assert [s for s, _ in differenced(sizes, k)] == plain_differenced(sizes, k)


def test_pack_round_trip(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma.", "Delta"]) for _ in range(rng.choice([0, 3, 50, 4000]))), 7) for i in range(40)] + [(50, None, 7), (50, None, 7), (None, "x", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(3)
    got = pack(df, BYTE, 256, with_ids=True).collect()
    rebuilt, used = {}, {}
    for r in sorted(got, key=lambda r: r.start):
        assert r.length == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids)
        rebuilt.setdefault(r.doc_id, []).append(r.ids)
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t, _ in rows:
        if i != 50:
            assert b"".join(rebuilt[i]) == ids(t or "") + b"\1\0\0\0"
    assert len(rebuilt[50]) == 2
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r.length for r in got)
    assert len(used) <= 1.1 * total / 256 + 1


def test_counts(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, None, 1), (99, None, 1), (99, None, 1)], "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, token_counts(df, WORD, 100).collect()), key=str)
    n = lambda t: len(word_library.encode(t or "", add_special_tokens=False).ids)
    assert got == sorted(((r.doc_id, len((r.text or "").encode()), n(r.text), n(r.text) > 100) for r in df.collect()), key=str)
    assert token_counts(df.limit(0), WORD).count() == 0 and pack(df.limit(0), BYTE).count() == 0
