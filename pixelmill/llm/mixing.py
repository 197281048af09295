"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch, result

WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = "mix"
#: Leading hex digits of a document's seeded order by which a source is split.
DIGITS = 3


def word_count(text) -> F.Column:
    """Number of words `[^\\x20\\x09-\\x0D]+`; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def weigh(sources: DataFrame, weights=WEIGHTS) -> DataFrame:
    """Add ``weight``: sources by code point, null last, take the weights in turn. One row per source."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.get(F.array(*map(F.lit, weights)), (rank % len(weights)).cast("int")))


def water_fill(work: Scratch, sources: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """Add ``target`` to (source, source_size, weight).

    All sizes are shared by weight; a source above ``epochs`` times its size is clamped there, and what is left is
    shared again by weight among the others until none is above. The driver sees two sums a round.
    """
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    state, k = work.keep(sources.withColumn("clamped", F.lit(False)), "fill0"), 0
    while True:
        row = state.agg(F.sum(F.when(F.col("clamped"), F.col("source_size") * epochs).otherwise(0)), F.sum(F.when(~F.col("clamped"), F.col("weight")).otherwise(0))).first()
        left, weight = total - (row[0] or 0), row[1] or 0
        if not weight:
            return state.withColumn("target", (F.col("source_size") * epochs).cast("double")).drop("clamped")
        share = F.col("weight").cast("decimal(38,0)") * F.lit(left).cast("decimal(18,0)")
        above = ~F.col("clamped") & (share > (F.col("source_size") * epochs).cast("decimal(18,0)") * F.lit(weight).cast("decimal(18,0)"))
        if not state.filter(above).head(1):
            target = F.when(F.col("clamped"), (F.col("source_size") * epochs).cast("double")).otherwise(F.col("weight").cast("double") * F.lit(float(left)) / F.lit(float(weight)))
            return state.withColumn("target", target).drop("clamped")
        k += 1
        state = work.keep(state.withColumn("clamped", F.col("clamped") | above), f"fill{k}")


def mix(spark: SparkSession, docs: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """How much of each document the mix takes: doc_id, size, source_size, target, whole, taken.

    A source takes every document floor(target / source_size) times, and once more the first documents in a seeded
    order, as many as come nearest to what is left of its target. The order of a source is split by its leading
    digits, so no task sorts a whole source. Null text has size 0, null source is a source of its own, rows that
    repeat a doc_id are ordered by size; an empty table gives an empty result. Columns other than doc_id, text and source
    are not used.
    """
    work = Scratch(spark, "mix")
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    sized = work.keep(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key")).withColumn("part", F.substring("key", 1, DIGITS)), "sized")
    parts = work.keep(sized.groupBy("source", "part").agg(F.sum("size").alias("part_size")), "parts")
    sources = parts.groupBy("source").agg(F.sum("part_size").alias("source_size"))
    filled = water_fill(work, weigh(sources, weights), epochs)
    before = F.coalesce(F.sum("part_size").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    plan = parts.withColumn("before", before).join(F.broadcast(filled) if sources.count() <= 10_000 else filled, parts["source"].eqNullSafe(filled["source"])).select(
        parts["source"].alias("source_"), parts["part"].alias("part_"), "before", "source_size", "target"
    )
    own = F.coalesce(F.sum("size").over(Window.partitionBy("source", "part").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sized.withColumn("own", own)
    j = placed.join(plan, placed["source"].eqNullSafe(plan["source_"]) & (placed["part"] == plan["part_"]))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    left = F.col("target") - F.col("whole") * F.col("source_size")
    more = (2 * (F.col("before") + F.col("own")) + F.col("size") <= 2 * left) & (F.col("size") > 0)
    return j.withColumn("whole", whole).select("doc_id", "size", "source_size", "target", "whole", (F.col("size") * (F.col("whole") + more.cast("long"))).alias("taken"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return result(spark, "op7", lambda: mix(spark, docs).select("doc_id", "size", "source_size", "target", "taken"))


OP7_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM sums),
ratios AS (SELECT *, 3.0::DOUBLE * source_size / weight AS ratio, sum(source_size) OVER () AS total FROM weighed),
swept AS (
  SELECT *, total - coalesce(sum(3 * source_size) OVER (ORDER BY ratio RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) AS rest,
         sum(weight) OVER (ORDER BY ratio RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM ratios),
marked AS (SELECT *, weight * rest > 3 * source_size * open_weight AS clamped FROM swept),
level AS (
  SELECT total - coalesce(sum(CASE WHEN clamped THEN 3 * source_size END) OVER (), 0) AS rest_all,
         coalesce(sum(CASE WHEN NOT clamped THEN weight END) OVER (), 0) AS weight_all,
         source, source_size, weight, clamped
  FROM marked),
targets AS (
  SELECT source, source_size, CASE WHEN clamped THEN (3 * source_size)::DOUBLE ELSE weight::DOUBLE * rest_all::DOUBLE / weight_all::DOUBLE END AS target FROM level),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS whole,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
       (size * (whole + CASE WHEN size > 0 AND 2 * before + size <= 2 * (target - whole * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed
"""
