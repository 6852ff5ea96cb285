import random
import re
import time

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from headway.llm.pii import KINDS, find_pii, redact

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def good(kind, s):
    d = re.sub("[^0-9]", "", s)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in s.split(".")), "card": lambda: 16 <= len(d) <= 19 and luhn(d), "phone": lambda: 8 <= len(d) <= 15}[kind]()


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k in KINDS for m in re.finditer(PLAIN[k], text or "") if good(k, m.group())]


TEXTS = [
    "", None, "mail me at a.b@c.org, or x@y.z.w_d@e.f and a@b", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.0000255", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "😀 4015623723127985 é +1 (238) 555-6608, +49 30 1234567 +1", "call 238 555-6608 or 238-555-6608; token 123-456-7890x", "write to jo [at] example [dot] com",
    "1 2 3 4 5 6 7 8 9 " * 3000, "9" * 20000, "a" * 20000 + "@", "+" * 3000, "card 3782 822463 10005.", "1.2.3.4@5.6.7.8", "--1--2- 3 -4", "+1-2.3(4)5 6-7 8", "a@b.c@d.e", "4111 1111  1111 1111",
]


def test_base_spans(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "a@b.co", 1), (2, TEXTS[2], 1)], "doc_id long, text string, n_ip int")
    got = find_pii(df).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        t = "a@b.co" if r.doc_id is None else TEXTS[r.doc_id]
        assert r.base == brute(t), t
        assert set(r.base) <= set(r.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b.startswith(k) for b in r.base) for k in KINDS]
        assert r.spans == sorted(r.spans, key=lambda s: (KINDS.index(s.split(":")[0]), int(s.split(":")[1])))
    assert find_pii(df.limit(0)).count() == 0


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(texts=st.lists(st.text(alphabet="019.-+ ()@aé_\n", max_size=60), min_size=80, max_size=120))
def test_random_texts(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.base for r in find_pii(df).collect()} == {i: brute(t) for i, t in enumerate(texts)}


def test_new_spans(spark):
    texts = [f"call me at 238-555-{1000 + k} today" for k in range(40)] + [f"part no/{k}38-555-1234x" for k in range(9)]
    got = {r.doc_id: r.spans for r in find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(got[k] == ["phone:11:23"] for k in range(40)) and not any(got[k] for k in range(40, 49))


def test_recall_of_added_spans(spark):
    """Spans that the base patterns miss, among numbers that look like them: nine tenths found, nine tenths right."""
    rng = random.Random(4)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    texts, planted = [], []
    for k in range(600):
        word, kind = rng.choice(["and so it was", "see the note", "on that day"]), k % 6
        if kind == 0:
            lead, item, name = rng.choice(["mail ", "write to ", "contact: "]), f"jo.{digits(2)} [at] mail{digits(1)} [dot] org", "email"
        elif kind == 1:
            lead, item, name = rng.choice(["call ", "tel. ", "phone: ", "fax "]), f"{rng.randrange(200, 999)}-{digits(3)}-{digits(4)}", "phone"
        elif kind == 2:
            stem = "37" + digits(12)
            item = next(stem + c for c in "0123456789" if luhn(stem + c))
            lead, name = rng.choice(["card ", "amex: ", "credit card "]), "card"
        else:
            lead, item, name = rng.choice(["part no/", "build_", "order #", "ref="]), rng.choice([f"{rng.randrange(200, 999)}-{digits(3)}-{digits(4)}x", f"9{digits(14)}a", f"{digits(3)} {digits(3)} {digits(3)} {digits(3)} {digits(3)}"]), None
        texts.append(f"{word} {lead}{item} {word}.")
        start = len(word) + 1 + len(lead)
        planted.append([f"{name}:{start}:{start + len(item)}"] if name else [])
    got = {r.doc_id: set(r.spans) - set(r.base) for r in find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    right = sum(len(got[k] & set(p)) for k, p in enumerate(planted))
    assert right >= 0.9 * sum(map(len, planted)) and right >= 0.9 * sum(map(len, got.values()))


def test_time_grows_with_the_text(spark):
    """Four times the matches take little more than four times as long, less what planning takes."""

    def seconds(n):
        df = spark.createDataFrame([(1, "1.2.3.4 a@b.co é +49 30 1234567, " * n)], "doc_id long, text string")
        began = time.time()
        assert len(find_pii(df).collect()[0].spans) == 3 * n and redact(df).collect()[0].text == "<IP> <EMAIL> é <PHONE>, " * n
        return time.time() - began

    base = seconds(1)
    assert seconds(60_000) - base < 7 * max(seconds(15_000) - base, 3)


def test_redact_keeps_other_columns(spark):
    """Names that the operator could use itself, overlaps, repeated rows, null ids and an empty table."""
    rows = [(1, "a@b.org", "x", 1), (1, "a@b.org", "x", 1), (None, "1.2.3.4@5.6.7.8 z", "y", 2), (3, "", None, None), (4, "q" * 5000 + " 1.2.3.4 " + "é" * 5000 + " a@b.org " + "w" * 3000, "z", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `spans of email` string, _base_email int")
    got = redact(df)
    assert got.columns == df.columns
    want = ["<EMAIL>", "<EMAIL>", "<EMAIL> z", "", "q" * 5000 + " <IP> " + "é" * 5000 + " <EMAIL> " + "w" * 3000]
    assert sorted(map(str, got.collect())) == sorted(str(type(r)(**{**r.asDict(), "text": t})) for r, t in zip(df.collect(), want, strict=True))
    assert redact(df.limit(0)).count() == 0


def test_redact(spark):
    rows = [(1, "é a@b.org, 1.2.3.4 x", "en"), (2, "none", "en"), (3, None, "en"), (4, "a@b.org", None)]
    got = redact(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert got.columns == ["doc_id", "text", "lang"]
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(1, "é <EMAIL>, <IP> x"), (2, "none"), (3, None), (4, "<EMAIL>")]


def test_no_span_of_one_kind_within_a_base_span_of_another(spark):
    """Wider patterns run on what the base spans of all kinds leave."""
    texts = ["pay 4111 1111 1111 1111 now", "mail 238-555-6608@a.org or 1:2:3:4:5:6:7:8", "+1 (826) 555-4081, then 10.20.30.40", "4015623723127985 and a@b.c"] + TEXTS
    for r in find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans)]
        base = {(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.base)}
        assert not [(x, y) for x in spans if x not in base for y in base if x[1] < y[2] and y[1] < x[2]], texts[r.doc_id]
        assert r.base == brute(texts[r.doc_id])


def test_wider_forms(spark):
    texts = ["please call 1-800-555-0199 today", "Telefon 0151 23456789 bitte", "host fe80::1:2ab is up", "std::vector and a::b, 12:30:45"]
    got = {r.doc_id: r.spans for r in find_pii(spark.createDataFrame(list(enumerate(texts * 20)), "doc_id long, text string")).collect()}
    assert [got[k] for k in range(4)] == [["phone:12:26"], ["phone:8:21"], ["ip:5:16"], []]
