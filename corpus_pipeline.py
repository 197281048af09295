"""The corpus pipeline: toxicity, near-dedup, repeats, decontamination, mixing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the columns of
``documents``; the last one returns how much of each document the mix takes. Between stages the rows are
written as Parquet and read again, so a stage's intermediates go before the next one begins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.llm import decontaminate, mixing, near_dup, suffix_array, toxicity
from pixelmill.llm.scratch import Scratch, end_stage, pipeline_stage

#: Percent of shared five-word shingles from which documents are near copies.
SIMILAR = 80
#: The columns that stages pass on.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain rejects go; columns beyond ``COLUMNS`` do not go on, here and in all later stages.

    Null or empty texts have no features and stay unless the chain rejects what it knows nothing of; long texts are scored whole;
    repeated rows are scored alike, ties included (rejected from the threshold on); without labels, or rows, nothing goes.
    """
    with pipeline_stage(spark):
        labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
        scored = toxicity.score_toxicity(spark, docs.select(*COLUMNS), labels)
        return scored.filter("toxic = 0").select(*COLUMNS)


def near_dup_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: that with the smallest doc_id, null after all others, of repeated rows any one.

    Rows are told apart by themselves, not by doc_id: different texts under one doc_id do not go with each other. Rows without words
    (null or empty texts) all stay; long texts are compared whole; an empty table stays empty.
    """
    with pipeline_stage(spark):
        return near_dup.deduplicate(spark, docs.select(*COLUMNS), SIMILAR)


def repeats_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that an earlier document holds go; characters of which only some bytes are left go whole. Documents that
    lose all their text go, those that were empty stay.

    A null doc_id is later than all others, null text stays null; rows with the same doc_id take nothing from each other; long
    texts are handled whole; an empty table stays empty. n_chars is counted anew where text changes.
    """
    with pipeline_stage(spark):
        cut = suffix_array.remove_repeats(spark, docs.select(*COLUMNS), 50).filter("n_removed < n_bytes or n_bytes = 0")
        changed = F.col("n_removed") > 0
        text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
        out = cut.select("doc_id", text.alias("text"), "lang", "source", "n_chars", changed.alias("changed"))
        return out.withColumn("n_chars", F.when(F.col("changed"), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its error budget go.

    Null or empty texts hold none, null or empty items are in none; every row is judged on its own, repeated ones alike; long
    texts are searched whole; an empty table stays empty.
    """
    with pipeline_stage(spark):
        return decontaminate.clean(spark, docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How much of each document the mix takes: doc_id, size, source_size, target, taken.

    Null text has size 0, a null source is a source of its own, a null doc_id is ordered like any other; rows that repeat a doc_id
    are ordered by size; an empty table gives no rows.
    """
    with pipeline_stage(spark):
        return mixing.mix(spark, docs).select("doc_id", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", toxic_out),
    ("near_dedup", near_dup_out),
    ("suffix_array_dedup", repeats_out),
    ("decontamination", benchmark_out),
    ("mixing", mix),
]

#: SQL expresses neither the fitted chain nor the components; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each stage's rows are written, and what it needed on the way is gone; the last rows alone remain."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = held.keep(stage(spark, docs, sf_dir), name)
        end_stage(spark)
        if k:
            held.drop(STAGES[k - 1][0])
    return docs
