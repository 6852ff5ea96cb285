"""Benchmark decontamination: a prefix-filtered join of documents with item windows, in SQL functions only.

A window is `size` consecutive item words (an item with fewer words is one window), and stands for
the set of its word shingles. A document that contains a window contains all its shingles, so one
shingle is prefix enough: the one that is rarest over all documents. One pass over the documents finds the
places of all shingles that items have; these are counted, and only those of prefixes are kept. Where one occurs,
the window can start at one place only; it must leave the window room in the document, and then the words there are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import small
from .columns import free_names
from .storage import saved

SHINGLE = 3
ROW = ["doc", "unnamed", "text_key"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text: A-Z lower-cased, runs of digits, a-z and characters beyond ASCII. Null has none."""
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.filter(F.split(F.coalesce(lowered, F.lit("")), GAPS, -1), lambda w: w != "")


def _shingles(words: Column, k: int) -> Column:
    """Structs of k words; those at the end, with nulls, are left to the caller."""
    return F.arrays_zip(*[(words if j == 0 else F.slice(words, j + 1, F.greatest(F.size(words) - j, F.lit(0)))).alias(f"w{j}") for j in range(k)])


def item_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """(item_id, window: array of words) of every window of every item with words."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    last = F.greatest(F.size("words") - size + 1, F.lit(1))
    return words.select("item_id", "words", F.explode(F.sequence(F.lit(1), last)).alias("at")).select("item_id", F.slice("words", F.col("at"), size).alias("window")).distinct()


def _places(docs: DataFrame, k: int) -> DataFrame:
    """The columns of docs with pos and w0.. wk-1 of each place of a shingle of k words in a document, and their hash as key."""
    names = [f"w{j}" for j in range(k)]
    place = docs.select(*docs.columns, F.posexplode(_shingles(F.col("words"), k)).alias("pos", "s"))
    place = place.select(*docs.columns, F.col("pos").cast("long").alias("pos"), *[F.col(f"s.{w}").alias(w) for w in names])
    return place.where(F.col(names[-1]).isNotNull()).withColumn("key", F.xxhash64(*names))


def _met(docs: DataFrame, shingles: DataFrame, k: int) -> DataFrame:
    """(doc, unnamed, text_key, n_words, pos, key, k) wherever a document has a shingle of k words that an item has, up to collisions of hashes.

    Only the items' keys are sent to the documents, where they are small; else the places are joined by key, and
    a key with many places is split like any skewed one.
    """
    wanted = shingles.where(F.size("shingle_words") == k).select("key").distinct()
    return _places(docs, k).select(*ROW, "n_words", "pos", "key").join(small(wanted), "key").withColumn("k", F.lit(k))


def _hits(documents: DataFrame, met: DataFrame, parts: DataFrame) -> DataFrame:
    """(doc, unnamed, text_key, name, start, length) wherever a document(.., text) holds a whole window.

    A window's prefix is its shingle with the fewest places. Of the places, those of prefixes are left; each allows the
    window one start, where there must be room. Only the texts with such a start are cut into words again, and compared.
    """
    rarity = met.groupBy("k", "key").agg(F.count("*").alias("n"))
    rare = parts.withColumn("k", F.size("shingle_words")).join(rarity, ["k", "key"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    prefixes = rare.groupBy("name").agg(F.min_by(F.struct("k", "key", "offset", "length", "n"), F.struct("n", "key", "offset")).alias("p"))
    prefixes = saved(prefixes.select("name", "p.*").where("n > 0").drop("n"), "prefixes")
    at = met.join(small(prefixes), ["k", "key"]).withColumn("start", F.col("pos") - F.col("offset"))
    at = saved(at.where((F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.col("n_words"))).select(*ROW, "name", "start", "length").distinct(), "starts")
    texts = documents.join(small(at.select(*ROW).distinct()), ROW, "left_semi").select(*ROW, words_of(F.col("text")).alias("words"))
    whole = F.array_join(F.slice("words", (F.col("start") + 1).cast("int"), F.col("length").cast("int")), " ") == F.col("name")
    return at.join(texts, ROW).where(whole).select(*ROW, "name", "start", "length").distinct()


def decontaminate(documents: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """(doc_id, text_key, n_words, n_hit, n_items, items, contaminated) for each document row.

    n_hit counts the words inside any occurrence of a window of `size` consecutive item words, items are the
    sorted item_ids (as strings) with occurring windows. Null and empty texts have no words; items without
    words or with null text have no windows; null ids and repeated rows of either table pass through; an
    empty table of documents gives an empty result, an empty benchmark no hits. text_key is a hash of the
    text: with doc_id it names a row's contents. Other columns are ignored.
    """
    windows = saved(item_windows(benchmark, size).select("item_id", "window", F.array_join("window", " ").alias("name")), "windows")
    by_name = windows.select("name", "window").distinct()
    shape = f"transform(sequence(0, size(window) - least(size(window), {SHINGLE})), j -> struct(j AS offset, slice(window, j + 1, least(size(window), {SHINGLE})) AS words))"
    parts = by_name.select("name", F.size("window").cast("long").alias("length"), F.explode(F.expr(shape)).alias("part"))
    parts = parts.select("name", "length", F.col("part.offset").cast("long").alias("offset"), F.col("part.words").alias("shingle_words"))
    keys = F.when(F.size("shingle_words") == 1, F.xxhash64(F.col("shingle_words")[0])).when(F.size("shingle_words") == 2, F.xxhash64(F.col("shingle_words")[0], F.col("shingle_words")[1])).otherwise(F.xxhash64(*[F.get("shingle_words", F.lit(j)) for j in range(SHINGLE)]))
    parts = saved(parts.withColumn("key", keys), "parts")
    sizes = sorted(r.k for r in parts.select(F.size("shingle_words").alias("k")).distinct().collect())

    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc"), F.col("doc_id").cast("long").isNull().alias("unnamed"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")]
    docs = documents.select(*key, words_of(F.col("text")).alias("words")).withColumn("n_words", F.size("words").cast("long"))
    rows = docs.select(F.when(~F.col("unnamed"), F.col("doc")).alias("doc_id"), "text_key", "n_words")
    met = None
    for k in sizes:
        found = _met(docs, parts, k)
        met = found if met is None else met.unionByName(found)
    none = documents.sparkSession.createDataFrame([], "doc long, unnamed boolean, text_key long, name string, start long, length long")
    hits = none if met is None else _hits(documents.select(*key, "text"), saved(met, "met"), parts)
    hits = saved(hits, "hits")

    spans = hits.select(*ROW, "start", (F.col("start") + F.col("length")).alias("end")).distinct()
    before = F.max("end").over(Window.partitionBy(*ROW).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    covered = spans.withColumn("new", F.greatest(F.col("end") - F.greatest("start", F.coalesce(before, F.lit(0).cast("long"))), F.lit(0)))
    covered = covered.groupBy(*ROW).agg(F.sum("new").alias("n_hit"))
    names = windows.select("name", "item_id").distinct()
    items = hits.select(*ROW, "name").distinct().join(names, "name").select(*ROW, "item_id").distinct()
    items = items.groupBy(*ROW).agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    found = covered.join(items, ROW, "left").withColumn("doc_id", F.when(~F.col("unnamed"), F.col("doc"))).drop("doc", "unnamed")
    out = rows.alias("r").join(found.alias("f"), (F.col("r.text_key") == F.col("f.text_key")) & F.col("r.doc_id").eqNullSafe(F.col("f.doc_id")), "left")
    none = F.array().cast("array<string>")
    hit = F.coalesce("f.n_hit", F.lit(0)).cast("long")
    listed = F.coalesce("f.items", none)
    return out.select("r.doc_id", "r.text_key", "r.n_words", hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), listed.alias("items"), (hit > 0).alias("contaminated"))


def clean_documents(documents: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """documents without the rows that hold a benchmark window; all columns stay.

    Rows go by their own text, so repeated ids with clean texts stay, as do null and empty texts and null ids;
    columns of any other name pass through untouched; an empty table gives an empty result, an empty benchmark
    drops nothing.
    """
    hit = saved(decontaminate(documents, benchmark, size).where("contaminated").select("doc_id", "text_key").distinct(), "contaminated")
    a, b = free_names(["hit doc_id", "hit text_key"], documents.columns)
    hit = hit.toDF(a, b)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(f"`{a}`")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(f"`{b}`"))
    return documents.join(small(hit), same, "left_anti")
