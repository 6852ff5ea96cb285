"""From raw documents to packed training sequences in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.functions.shipping import ship
from headway.llm.decontamination import clean_documents
from headway.llm.ngram_join import one_of_each_group
from headway.llm.packing import pack
from headway.llm.pii import redact
from headway.llm.queries import table, tokenizer
from headway.llm.storage import saved
from headway.llm.toxicity import drop_toxic


# Every stage but the last returns the columns of docs. A column of any other name passes through untouched, an empty
# table gives an empty result, and rows with null or repeated ids are judged by their own text like any other.


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the grammar scores as toxic. Null texts count as empty; repeated rows stay or go alike."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest doc_id of each group linked by Jaccard similarity of 0.8 or more over five-word shingles.

    Null and empty texts link with nothing. Of rows that repeat an id and its text one stays; rows that share only the id are judged apart.
    """
    return one_of_each_group(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item, or a whole shorter item. Null and empty texts stay."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"), size=10)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind; n_chars, where docs have it, follows. Null texts stay null."""
    clean = redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences of 2,048. Null texts are empty documents; repeated rows are packed each."""
    return pack(docs, tokenizer("byte_bpe_50k.json"), capacity=2048, end_id=1)


STAGES = [("toxicity", toxicity), ("ngram_join", ngram_join), ("decontamination", decontamination), ("pii", pii), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written as Parquet and read again."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
