"""A corpus from raw documents to token ids: quality, near-dedup, passages, mixture, encoding.

Each stage takes what its predecessor kept and returns the columns of
``documents``; the last adds the token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelathe.llm import mixing, quality_rules, sentencepiece_codec, simhash_dedup, substring_dedup
from framelathe.llm._common import cut, sweep, tables

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``documents``, n_chars counted anew."""
    return df.select(
        "doc_id", F.col(text).alias("text"), "lang", "source", F.length(F.col(text)).cast("long").alias("n_chars")
    )


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; of the others, lines that fail the line rules go.

    Null and empty texts are rejected, whatever their doc_id; repeated rows are judged alike.  Empty table: empty.
    """
    judged = quality_rules.quality(docs.select(*COLUMNS))
    return _documents(judged.filter("kept"), "clean_text")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five-word shingles, a cosine of 0.8.

    Texts without words are one group.  Rows with a null doc_id all stay; repeated rows become one; rows of one doc_id
    with unlike texts are judged apart.  Empty table: empty.
    """
    return _documents(simhash_dedup.keep_one(docs.select(*COLUMNS)))


def passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut; a document left without a word goes.

    Rows with a null doc_id or text pass as they are; rows of one doc_id cut nothing from each other.  Empty table: empty.
    """
    done = substring_dedup.substring_dedup(docs.select(*COLUMNS))
    return _documents(done.filter("n_removed = 0 or n_removed < n_words"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weighted by the square root of their size, in as many characters as before.

    A null source is a source; a source without any text is left out; repeated rows draw alike.  Empty table: empty.
    """
    return _documents(mixing.mix(docs.select(*COLUMNS)))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each copy, and whether they decode to its text.

    Null texts have null ids, empty ones an empty list.  Rows stand alone.  Empty table: empty.
    """
    return sentencepiece_codec.encode(docs.select(*COLUMNS)).drop("text")


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("substring_dedup", passages_stage),
    ("source_mixing", mixing_stage),
    ("sentencepiece", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.  Tables that a stage left in the shared folder go once the next table is written;
    the last stage's input stays until ``framelathe.llm._common.sweep`` is called, when the result is stored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    others = tables()
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
        sweep(spark, others | {p for p in tables() if f"/{name}-" in p})
    return STAGES[-1][1](spark, docs, sf_dir)


#: SentencePiece encoding can't be expressed in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None
