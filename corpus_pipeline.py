"""Stages that turn the documents table into a training mix.

Each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
reread as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselon.llm import decontaminate, line_dedup, minhash, mixing, toxicity
from tesselon.llm._shared import forget, maybe_broadcast, private_names, read, store

#: A document is rejected if its toxicity is at least this.
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the threshold of a grammar that is learnt from all labelled rows; null and empty texts stay,
    and rows of one doc_id are judged each by its own text."""
    scored = toxicity.score_toxicity(docs, read(spark, sf_dir, "labels"))
    return scored.where(F.col("toxicity") < TOXIC).select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that five or more of them share, but in the one with the largest doc_id;
    n_chars follows the text. All rows stay, those with a null text unchanged."""
    out = line_dedup.dedup_lines(docs)
    changed = F.col("n_dropped") > 0
    return out.select(*[F.when(changed, F.col("kept_text")).otherwise(F.col("text")).alias("text") if c == "text" else F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies by five-word shingles: the one with the smallest doc_id.
    Rows of one doc_id stay or go together."""
    found = minhash.near_duplicates(docs, size=5, percent=80)
    (name,) = private_names(docs.columns, "gone")
    gone = store(found.where(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct())
    return docs.join(maybe_broadcast(gone, 64), F.col("doc_id") == F.col(name), "left_anti")


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item. Rows with a null or empty text, or a null doc_id, stay if
    their text holds none; rows of one doc_id are judged each by its own text; an empty table gives no rows."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time that a document is taken, its text cut where it is taken in part, with size,
    source_size, target, taken (words of this row) and epoch. Rows without words are never taken; rows without
    a source are one source; an empty table gives no rows."""
    return mixing.mixture(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", drop_near_copies),
    ("decontaminate", drop_benchmark_copies),
    ("mix_sources", mix),
]

#: SQL cannot express the toxicity model; tests/llm holds the other stages against brute force on a small corpus.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; what a stage keeps is written to the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, store(stage(spark, docs, sf_dir))
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
