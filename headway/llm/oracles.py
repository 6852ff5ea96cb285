"""DuckDB SQL for the numbered queries that SQL can express."""

from __future__ import annotations

from .licenses import SENTENCES, SLOT_WORDS, TAG, ranked_rules

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ITEM_WORDS = rf"list_filter(string_split_regex({LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
PLAIN_WORDS = rf"list_filter(string_split_regex({LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

DECONTAMINATION = f"""WITH d AS (SELECT doc_id, {ITEM_WORDS} AS w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {ITEM_WORDS} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS win FROM (SELECT *, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
places AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM windows) s)),
hits AS (SELECT doc_id, i, p.n, item_id FROM places p JOIN windows USING (win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS s FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

JACCARD = f"""WITH RECURSIVE d AS (SELECT doc_id, {PLAIN_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT *, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)"""

VECTORS = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
u AS (SELECT *, sqrt(list_dot_product(x, x)) AS n FROM v WHERE label IS NOT NULL AND len(x) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0 WHERE list_dot_product(a.x, b.x) / a.n / b.n >= 0.98),
r(vec_id, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id WHERE r.c < l.b)
SELECT v.vec_id, coalesce(k, 0) AS n_links, c AS component_id, v.vec_id = c AS kept FROM v LEFT JOIN (SELECT a AS vec_id, count(*) AS k FROM l GROUP BY a) USING (vec_id) JOIN (SELECT vec_id, min(c) AS c FROM r GROUP BY vec_id) USING (vec_id)"""


def _licenses() -> str:
    """Known sentences by place in the joined words of a text: one runs from the start of a piece to the end of a piece."""
    known = ", ".join(f"({i}, '{k}', '{v}', {len(v)})" for i, (k, v) in enumerate(SENTENCES.items()))
    slots = ", ".join(f"({i}, '{v.partition('*')[0]}', '{v.partition('*')[2]}')" for i, v in enumerate(SENTENCES.values()) if "*" in v)
    rules = ", ".join(f"('{rule}', '{name}')" for rule, name in ranked_rules().items())
    return rf"""WITH RECURSIVE known(id, sentence, words, n) AS (VALUES {known}), rules(rule, licence) AS (VALUES {rules}), slots(id, head, tail) AS (VALUES {slots}),
parts AS (SELECT doc_id, string_split_regex(regexp_replace(text, '([.!?;])(\s|$)', chr(1) || '\2', 'g'), '\x01|\n+|{TAG}') AS p FROM documents WHERE text IS NOT NULL),
cut AS (SELECT doc_id, unnest(p) AS raw, generate_subscripts(p, 1) - 1 AS place FROM parts),
colons AS (SELECT doc_id, place, string_split_regex(regexp_replace(raw, ':(\s+[^\s\p{{Ll}}]|\s*$)', chr(1) || '\1', 'g'), '\x01') AS q FROM cut),
each AS (SELECT doc_id, place, unnest(q) AS raw, generate_subscripts(q, 1) AS sub FROM colons),
words AS (SELECT doc_id, place, sub, trim(regexp_replace(lower(raw), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS w FROM each),
pieces AS (SELECT *, sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY place, sub) AS stop FROM words WHERE w <> ''),
joined AS (SELECT doc_id, string_agg(w, ' ' ORDER BY place, sub) AS t FROM pieces GROUP BY doc_id),
met AS MATERIALIZED (SELECT p.doc_id, CAST(p.stop - length(p.w) AS BIGINT) AS start, k.n, k.id, CAST(p.place AS BIGINT) AS place FROM pieces p JOIN joined j USING (doc_id) JOIN known k ON substr(j.t, CAST(p.stop - length(p.w) AS BIGINT), k.n) = k.words
  WHERE EXISTS (SELECT 1 FROM pieces e WHERE e.doc_id = p.doc_id AND e.stop = p.stop - length(p.w) + k.n)
  UNION ALL SELECT doc_id, start, n, id, place FROM (SELECT p.doc_id, CAST(p.stop - length(p.w) AS BIGINT) AS start, CAST(e.stop - p.stop + length(p.w) AS BIGINT) AS n, s.id, CAST(p.place AS BIGINT) AS place, s.head, s.tail,
      substr(j.t, CAST(p.stop - length(p.w) AS BIGINT), CAST(e.stop - p.stop + length(p.w) AS BIGINT)) AS m
    FROM joined j JOIN slots s ON contains(j.t, s.tail) JOIN pieces e ON e.doc_id = j.doc_id AND (s.tail = '' OR substr(j.t, CAST(e.stop - length(s.tail) AS BIGINT), length(s.tail)) = s.tail)
      JOIN pieces p ON p.doc_id = j.doc_id AND p.stop <= e.stop AND substr(j.t, CAST(p.stop - length(p.w) AS BIGINT), length(s.head)) = s.head)
    WHERE length(m) > length(head) + length(tail) AND starts_with(m, head) AND ends_with(m, tail) AND len(string_split(substr(m, length(head) + 1, length(m) - length(head) - length(tail)), ' ')) <= {SLOT_WORDS}),
scan(doc_id, start, n, id, place) AS (SELECT * FROM (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY start, n DESC) = 1)
  UNION ALL SELECT * FROM (SELECT m.* FROM scan s JOIN met m ON m.doc_id = s.doc_id AND m.start >= s.start + s.n QUALIFY row_number() OVER (PARTITION BY m.doc_id ORDER BY m.start, m.n DESC) = 1)),
per AS (SELECT doc_id, string_agg(sentence, ' ' ORDER BY start) AS s, count(*) AS n, min(place) AS a, max(place) AS b FROM scan JOIN known USING (id) GROUP BY doc_id),
named AS (SELECT doc_id, list_sort(list(DISTINCT licence)) AS l FROM (SELECT doc_id, unnest(regexp_extract_all('<' || replace(s, ' ', '><') || '>', '{"|".join(ranked_rules())}')) AS rule FROM per) JOIN rules USING (rule) GROUP BY doc_id)
SELECT doc_id, coalesce(array_to_string(l, ','), '') AS licenses, s AS sentences, n AS n_sentences, a AS first_place, b AS last_place FROM per LEFT JOIN named USING (doc_id)"""


ORACLES = {
    "op5_benchmark_decontamination": DECONTAMINATION,
    "op6_embedding_near_dedup": VECTORS,
    "op7_license_scan": _licenses(),
    "op10_ngram_jaccard_join": JACCARD,
}
