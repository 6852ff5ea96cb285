import hashlib
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
import sentencepiece  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from headway.llm import alignment as L  # noqa: E402

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
library_a, library_b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
library_a.encode_special_tokens = True
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
TEXTS = ["", None, "a", " a", "a  b", "a \n b", "x" * 300, "It's 東京 😀 é́ ok", "a<|endoftext|>b <s> <unk> <0x41>", "literal ▁ mark", "the cat sat on the mat", "the cat sat on the mat", "tab\tand\x00nul", "trailing ", "Donaudampfschifffahrt ümlaut straße", "a" * 49 + " b", "w " * 3000 + "end"]


def byte_of() -> dict[str, int]:
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


BYTE = byte_of()


def spans(tokens):
    at, out = 0, []
    for t in tokens:
        out.append((at, at + len(t)))
        at += len(t)
    return out


def tokens_of(text):
    if not text:
        return None
    a = library_a.encode(" " + text, add_special_tokens=False).ids
    b = library_b.encode(text)
    bytes_a = [bytes(BYTE[c] for c in library_a.id_to_token(k)) for k in a]
    bytes_b = [bytes([int(p[3:5], 16)]) if library_b.is_byte(k) else p.replace("▁", " ").encode() for k in b for p in [library_b.id_to_piece(k)]]
    whole = (" " + text).encode()
    return None if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole else (a, b, spans(bytes_a), spans(bytes_b))


def brute(texts):
    rows, counts = [], Counter()
    for text in texts:
        if not (found := tokens_of(text)):
            rows.append((0, 0, 0, [], ""))
            continue
        a, b, sa, sb = found
        cuts = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, start = [], 0
        for end in cuts:
            groups.append(",".join(str(k) for k, (x, y) in zip(a, sa, strict=True) if start <= x and y <= end) + "|" + ",".join(str(k) for k, (x, y) in zip(b, sb, strict=True) if start <= x and y <= end))
            start = end
        links = [(p, q) for p, (x, y) in zip(a, sa, strict=True) for q, (v, w) in zip(b, sb, strict=True) if x < w and v < y]
        counts.update(set(links))
        rows.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = Counter()
    for (p, _), n in counts.items():
        most[p] = max(most[p], n)
    return [(n_a, n_b, g, len(links), sum(counts[x] == most[x[0]] for x in links), sum(counts[x] for x in links), sha) for n_a, n_b, g, links, sha in rows]


@given(st.lists(st.booleans(), max_size=60), st.lists(st.booleans(), max_size=60))
def test_runs_are_the_groups_between_common_ends(x, y):
    n = max(len(x), len(y)) + 1
    a, b = ([k + 1 for k, cut in enumerate(z) if cut and k + 1 < n] + [n] for z in (x, y))
    groups, i, j = [], 0, 0
    for end in sorted(set(a) & set(b)):
        p, q = a.index(end) + 1, b.index(end) + 1
        groups.append((i, p, j, q))
        i, j = p, q
    found = []
    for i, p, j, q, single in L.diagonal_runs(a, b):
        found += [(i, p, j, q)] if single else [(i + k, i + k + 1, j + k, j + k + 1) for k in range(p - i)]
        assert single or p - i == q - j
    assert found == groups


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\tab'sÉé.!1▁")), st.characters(codec="utf-8")), max_size=30), max_size=4))
def test_random_texts(texts):
    both = L.aligner(A, B)
    for text, found in zip(texts, both.text_tokens(texts), strict=True):
        expected = tokens_of(text)
        assert (found and tuple(x.tolist() for x in found)) == (expected and expected[:2])


def test_whole_result_against_brute_force(spark):
    rng = random.Random(1)
    words = "the of tion Straße über café naïve running tokenizer 12345 don't foo.\nBar ### ,,, émile".split(" ")
    texts = TEXTS + [" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(40)]
    docs = spark.createDataFrame([(k if k % 9 else None, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, n_a string").repartition(3)
    expected = sorted(((k if k % 9 else -1), *row) for k, row in enumerate(brute(texts)))
    for chunk in (L.CHUNK, 40):
        found = L.align_tokenizers(docs, A, B, chunk)
        assert found.columns == ["doc_id", *COLUMNS]
        assert sorted((-1 if r.doc_id is None else r.doc_id, *(r[c] for c in COLUMNS)) for r in found.collect()) == expected
    assert L.align_tokenizers(docs.limit(0), A, B).collect() == []
    nothing = L.align_tokenizers(docs.where("text is null"), A, B).collect()
    assert [tuple(r)[1:] for r in nothing] == [(0, 0, 0, 0, 0, 0, "")]
