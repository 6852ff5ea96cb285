"""Personal data by weak supervision, in SQL functions only.

Patterns propose spans. Three labelers vote on each (1, -1 or 0 for no opinion): the pattern's strict
form, a gazetteer of words that announce such data, and the characters around the span.
Expectation-maximisation over the counts of all votes estimates how reliable each labeler is, and the
posteriors train the span classifier, a logistic model over the votes and features of the span and its
surroundings, which decides on every span that the base patterns do not have. Spans of the base patterns are always kept.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import free_names
from .storage import saved

KINDS = ["email", "ip", "card", "phone"]

# The base patterns, written so that a match can only begin where the plain ones' leftmost
# match begins and no repetition gives back what it took.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:(?![\x20-](?![0-9]))[0-9\x20-])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GUARD = {"email": "@", "phone": "+"}

# Wider patterns for spans that the base ones miss, of any length.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|\[at\]|\(at\))\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?(?:\[dot\]|\(dot\))\x20?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]{0,40}[0-9])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}:){0,5}[0-9A-Fa-f]{1,4})(?![0-9A-Za-z:])",
    "card": r"[0-9](?<![0-9][0-9])[0-9]{3}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5}(?![0-9])",
    "phone": r"(?<![0-9.+/-])(?:(?:[01][\x20.-])?\(?[0-9]{2,5}\)?[\x20./-][0-9]{3,4}[\x20.-][0-9]{3,4}|0[0-9]{2,4}[\x20/-][0-9]{6,8})(?![0-9]|[.-][0-9])",
}
WIDE_GUARD = {"email": r"[\[(]at[\])]|@\x20|\x20@", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f:]", "card": "[0-9]{4}", "phone": "[0-9]{3}"}

# Words that announce personal data, in English, German, French and Spanish.
GAZETTEER = {
    "email": "e-?mail|mail|contact|write|kontakt|schreib|courriel|contacter|correo|contacto",
    "ip": "ip|address|host|server|adresse|hôte|serveur|dirección|servidor",
    "card": "card|visa|mastercard|amex|credit|karte|kreditkarte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|cell|fax|telefon|anruf|handy|téléphone|appel|portable|teléfono|llama|móvil",
}
LABELERS = ["form", "gazetteer", "context"]
FEATURES = ["separated", "repeated", "glued", "long", "zero"]
# The classifier's weights lean to these where votes and features say little: labelers, then features, then the bias.
PRIOR = [1.0, 1.5, 1.0, 0.0, -0.5, -1.0, 0.0, -0.5, -1.0]
CONTEXT = 24
CHUNK = 256
PIECE = 1024
SPAN = "struct<start:int,stop:int,base:boolean,form:int,gazetteer:int,context:int,separated:int,repeated:int,glued:int,long:int,zero:int>"
MASK = "\x01"
# What speaks against a span beside it, and features of the span.
GLUE_BEFORE, GLUE_AFTER = r"[\p{L}\p{N}=/#$€£\x22\x27_-]$", r"^[\p{L}\p{N}_=/-]"
DIGIT_BEFORE, DIGIT_AFTER = r"[0-9][.\x20-]?$", r"^[.\x20-]?[0-9]"
SEPARATED, REPEATED = r"[\x20./()-]", r"([0-9A-Za-z])\1{4}"


# Expressions over arrays are written as SQL text, which Spark parses at once.


def _text(pattern: str) -> str:
    """A pattern as a raw SQL string; patterns hold no single quote."""
    return f"r'{pattern}'"


def _digits(s: str) -> str:
    return f"regexp_replace({s}, '[^0-9]', '')"


def luhn(digits: str) -> str:
    """Whether a string of digits passes Luhn's check."""
    d = f"int(substr({digits}, k, 1))"
    twice = f"if((length({digits}) - k) % 2 = 1, if({d} > 4, 2 * {d} - 9, 2 * {d}), {d})"
    return f"aggregate(sequence(1, greatest(length({digits}), 1)), 0, (t, k) -> t + {twice}) % 10 = 0"


def _valid(kind: str, s: str) -> str:
    if kind == "ip":
        return rf"forall(split({s}, r'\.', -1), q -> coalesce(ltrim('0', q) rlike r'^[0-9]{{0,3}}$' and int(concat('0', left(ltrim('0', q), 3))) <= 255, false))"
    if kind == "card":
        return f"(length({_digits(s)}) between 16 and 19 and {luhn(_digits(s))})"
    if kind == "phone":
        return f"length({_digits(s)}) between 8 and 15"
    return "true"


def _form(kind: str, s: str) -> str:
    """The strict-form labeler."""
    good = {
        "email": rf"{s} rlike r'(?i)[.)\]]\x20?(?:com|org|net|edu|gov|info|io|[a-z]{{2}})$'",
        "ip": f"{s} rlike r'^[1-9]|^[0-9A-Fa-f]{{1,4}}:'",
        "card": f"{luhn(_digits(s))} and {s} rlike '^[3-6]'",
        "phone": f"length({_digits(s)}) between 9 and 13",
    }[kind]
    return f"if({good}, 1, -1)"


def _let(name: str, value: str, body: str) -> str:
    """body with value evaluated once, as name."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _scan(values: str, op: str) -> str:
    """What op makes of 0 and the elements before each; in chunks, as every append copies the array it appends to."""
    step = (lambda t: f"{t} + e") if op == "sum" else lambda t: f"{op}({t}, e)"

    def running(chunk: str, first: str) -> str:
        return f"aggregate({chunk}, struct({first} as at, cast(array() as array<int>) as done), (acc, e) -> struct({step('acc.at')} as at, array_append(acc.done, acc.at) as done), acc -> acc.done)"

    totals = f"transform(cs, c -> aggregate(c, 0, (t, e) -> {step('t')}))"
    chunks = f"transform(sequence(0, greatest(size(v) - 1, 0), {CHUNK}), k -> slice(v, k + 1, {CHUNK}))"
    return _let("v", values, _let("cs", chunks, f"flatten(zip_with(cs, {running(totals, '0')}, (c, f) -> {running('c', 'f')}))"))


def _base_guard(text: str, kind: str) -> str:
    """A cheap test that a text without a base match mostly fails."""
    return f"contains({text}, '{GUARD[kind]}')" if kind in GUARD else f"{text} rlike '[0-9]'"


def _placed(text: str, kind: str, pattern: str, base: bool) -> str:
    """The matches of a pattern in code points with votes and features, and the text with those of a base pattern masked.

    What split() leaves are the gaps between the matches, so running lengths give the places.
    """
    announced = rf"(?i)(?<![\p{{L}}])(?:{GAZETTEER[kind]})[\p{{L}}]*[^\p{{L}}]{{0,6}}(?:\p{{L}}{{1,3}}[^\p{{L}}]{{0,3}})?$"
    flag = lambda condition: f"if({condition}, 1, 0)"
    start, before = "s + char_length(p.g)", f"right(p.g, {CONTEXT})"
    near = rf"case when {before} rlike {_text(GLUE_BEFORE)} or p.after rlike {_text(GLUE_AFTER)} then -1 when {before} rlike r'(?:^|[\s(:,;<])$' then 1 else 0 end"
    span = (
        f"struct({start} as start, {start} + char_length(p.m) as stop, {str(base).lower()} as base, {_form(kind, 'p.m')} as form, {flag(f'{before} rlike {_text(announced)}')} as gazetteer, {near} as context, "
        + f"{flag(f'p.m rlike {_text(SEPARATED)}')} as separated, {flag(f'p.m rlike {_text(REPEATED)}')} as repeated, {flag(f'p.after rlike {_text(DIGIT_AFTER)} or {before} rlike {_text(DIGIT_BEFORE)}')} as glued, "
        + f"{flag('char_length(p.m) > 40')} as long, {flag('startswith(p.m, 0)')} as zero)"
    )
    starts = _scan("transform(ps, p -> char_length(p.g) + coalesce(char_length(p.m), 0))", "sum")
    spans = f"transform(filter(zip_with(ps, {starts}, (p, s) -> struct(p.ok as ok, if(p.ok, {span}, null) as x)), y -> y.ok), y -> y.x)"
    masked = f"array_join(transform(ps, p -> concat(p.g, if(p.ok, repeat('{MASK}', char_length(p.m)), coalesce(p.m, '')))), '')" if base else text
    ok = f"(m.m is not null and coalesce({_valid(kind, 'm.m')}, false))" if base else "m.m is not null"
    pairs = _let("gs", f"split({text}, {_text(pattern)}, -1)", "transform(gs, (g, i) -> struct(g as g, get(found, i) as m, left(coalesce(get(gs, i + 1), ''), 4) as after))")
    pairs = f"transform({pairs}, m -> struct(m.g as g, m.m as m, m.after as after, {ok} as ok))"
    nothing = f"struct(cast(array() as array<{SPAN}>) as spans, {text} as text)"
    matched = f"if(size(found) > 0, {_let('ps', pairs, f'struct(cast({spans} as array<{SPAN}>) as spans, {masked} as text)')}, {nothing})"
    guard = _base_guard(text, kind) if base else f"{text} rlike {_text(WIDE_GUARD[kind])}"
    return f"if({guard}, {_let('found', f'regexp_extract_all({text}, {_text(pattern)}, 0)', matched)}, {nothing})"


def _masked(text: str, kind: str) -> str:
    """The text with the base spans of a kind masked, of the same length."""
    marks = f"transform(found, m -> if(coalesce({_valid(kind, 'm')}, false), repeat('{MASK}', char_length(m)), m))"
    filled = f"array_join(zip_with(split({text}, {_text(BASE[kind])}, -1), {marks}, (g, m) -> concat(g, coalesce(m, ''))), '')"
    return f"if({_base_guard(text, kind)}, {_let('found', f'regexp_extract_all({text}, {_text(BASE[kind])}, 0)', f'if(size(found) > 0, {filled}, {text})')}, {text})"


def candidates(text: str, kind: str) -> Column:
    """The base spans of a kind and those of the wider pattern in what the base spans of all kinds leave of the text, by start; text is SQL."""
    wide = _placed("w", kind, WIDE[kind], False)
    for k, other in enumerate(o for o in KINDS if o != kind):
        wide = _let(f"w{k}" if k else "w", _masked(f"w{k + 1}" if k < len(KINDS) - 2 else "b.text", other), wide)
    wide = f"if(b.text rlike {_text(WIDE_GUARD[kind])}, {wide}.spans, cast(array() as array<{SPAN}>))"
    return F.expr(_let("t", text, _let("b", _placed("t", kind, BASE[kind], True), f"array_sort(concat(b.spans, {wide}))")))


def span_columns(columns: list[str]) -> dict[str, str]:
    """A column for the spans of each kind, none of whose names is taken."""
    return dict(zip(KINDS, free_names([f"spans of {k}" for k in KINDS], columns), strict=True))


def with_candidates(documents: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds for each kind the column that columns names, with the candidates of its text."""
    return documents.withColumns({columns[k]: candidates("coalesce(text, '')", k) for k in KINDS})


def fit_votes(votes: np.ndarray, n: np.ndarray, rounds: int = 50) -> np.ndarray:
    """The probability that a span is personal data, for each row of votes (-1, 0, 1) with its count: EM with a reliability per labeler and class."""
    prior, start = 0.5, np.array([[0.6, 0.2, 0.2], [0.2, 0.2, 0.6]])  # P(vote -1, 0, 1 | no data, data)
    rate = np.repeat(start[None], votes.shape[1], axis=0)
    cast = votes + 1
    for _ in range(rounds):
        zero, one = ((prior if c else 1 - prior) * np.prod([rate[k, c, cast[:, k]] for k in range(votes.shape[1])], axis=0) for c in (0, 1))
        posterior = one / (one + zero)
        prior = ((posterior * n).sum() + 1) / (n.sum() + 2)
        for k in range(votes.shape[1]):
            for c, weight in ((0, (1 - posterior) * n), (1, posterior * n)):
                mass = np.bincount(cast[:, k], weight, minlength=3) + 1.0 + 2.0 * (np.arange(3) == 2 * c)
                rate[k, c] = mass / mass.sum()
    return posterior


def fit_classifier(x: np.ndarray, posterior: np.ndarray, n: np.ndarray, steps: int = 50) -> np.ndarray:
    """Weights and bias of a logistic model of the posteriors, by Newton steps, drawn to PRIOR as by ten spans."""
    x = np.column_stack([x, np.ones(len(x))])
    w, pull = np.array(PRIOR), 10.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (p - posterior)) + pull * (w - PRIOR)
        change = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w)), gradient)
        w = w - change * min(1.0, 2 / (np.abs(change).max() + 1e-12))
        if np.abs(change).max() < 1e-9:
            break
    return w


def learn(spans: DataFrame, columns: dict[str, str]) -> dict[str, list[float]]:
    """The span classifier of each kind, from a table with the candidates.

    Only counts of votes and features reach the driver: at most 27 * 32 rows a kind, whatever the corpus.
    """
    names, counts = [*LABELERS, *FEATURES], None
    for kind in KINDS:
        one = spans.select(F.explode(columns[kind]).alias("x")).select(F.lit(kind).alias("kind"), *[F.col(f"x.{c}") for c in names])
        counts = one if counts is None else counts.union(one)
    rows = sorted(map(tuple, counts.groupBy("kind", *names).agg(F.count("*").alias("n")).collect()))
    models = {}
    for kind in KINDS:
        x = np.array([r[1:-1] for r in rows if r[0] == kind]).reshape(-1, len(names))
        n = np.array([r[-1] for r in rows if r[0] == kind], float)
        models[kind] = fit_classifier(x, fit_votes(x[:, : len(LABELERS)], n) if len(x) else n, n).tolist()
    return models


def _accepted(spans: Column, weights: list[float]) -> Column:
    """Base spans, and others that the classifier gives one half or more."""

    def good(x: Column) -> Column:
        z = F.lit(weights[-1])
        for name, w in zip([*LABELERS, *FEATURES], weights, strict=False):
            z = z + x[name] * F.lit(w)
        return x["base"] | (z >= 0)

    return F.filter(spans, good)


def _named(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["stop"].cast("string")))


def _marked(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), (-x["stop"]).alias("back"), x["stop"].alias("stop"), F.lit(f"<{kind.upper()}>").alias("mark")))


def find_pii(documents: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, spans) for each document row.

    base and spans are arrays of kind:start:end in code points, end exclusive, by kind then start; the
    counts are those of the base spans. Null texts count as empty; null ids and repeated rows pass through;
    other columns are ignored; an empty table gives an empty result. Texts of any length take time in proportion.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    columns = span_columns(rows.columns)
    found = saved(with_candidates(rows, columns).drop("text"), "spans")
    models = learn(found, columns)
    base = {k: F.filter(columns[k], lambda x: x["base"]) for k in KINDS}
    counts = [F.size(base[k]).cast("long").alias(f"n_{k}") for k in KINDS]
    listed = F.concat(*[_named(k, base[k]) for k in KINDS]), F.concat(*[_named(k, _accepted(F.col(columns[k]), models[k])) for k in KINDS])
    return found.select("doc_id", *counts, listed[0].alias("base"), listed[1].alias("spans"))


def redact(documents: DataFrame) -> DataFrame:
    """documents with each span of the text replaced by its kind in angle brackets; spans that overlap become one, of the kind of the first and longest.

    Null texts stay null; rows with null or repeated ids are treated alike; columns of any other name pass through
    untouched; an empty table gives an empty result. The candidates are found once and written beside the documents.
    """
    columns = span_columns(documents.columns)
    found = saved(with_candidates(documents, columns), "spans")
    models = learn(found, columns)
    spans = F.array_sort(F.concat(*[_marked(k, _accepted(F.col(columns[k]), models[k])) for k in KINDS]))

    # the text from a to b, out of its pieces, as a place in a text is found by counting from the text's beginning
    cut = lambda a, b: f"if({b} > {a}, concat(substr(get(ps, int({a} div {PIECE})), {a} % {PIECE} + 1, {b} - {a}), array_join(slice(ps, int({a} div {PIECE}) + 2, greatest(int(({b} - 1) div {PIECE}) - int({a} div {PIECE}) - 1, 0)), ''), if(({b} - 1) div {PIECE} > {a} div {PIECE}, left(get(ps, int(({b} - 1) div {PIECE})), int(({b} - 1) % {PIECE}) + 1), '')), '')"
    # what stands before each span that begins a group of overlapping ones, and its mark; then the rest
    kept = f"zip_with(ss, {_scan('transform(ss, y -> y.stop)', 'greatest')}, (y, e) -> if(y.start >= e, concat({cut('e', 'y.start')}, y.mark), ''))"
    rest = _let("z", "array_max(transform(ss, y -> y.stop))", _let("n", "char_length(text)", cut("z", "n")))
    [name] = free_names(["marked spans"], found.columns)
    replaced = _let("ss", f"`{name}`", _let("ps", f"regexp_extract_all(text, r'(?s).{{1,{PIECE}}}', 0)", f"concat(array_join({kept}, ''), {rest})"))
    clean = F.when(F.size(F.col(name)) > 0, F.expr(replaced)).otherwise(F.col("text"))
    return found.withColumn(name, spans).withColumn("text", clean).select(*[F.col(f"`{c}`") for c in documents.columns])
