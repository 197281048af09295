"""Pixel relations: dense or sparse rasters made from tables, as (img, y, x, b, v)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def with_value(px: DataFrame) -> DataFrame:
    """Add ``v``, the byte ``b`` on a scale from 0 to 1."""
    return px.withColumn("v", F.col("b") / F.lit(255.0))


def embedding_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One image: a row for each vector, a column for each element, -1..1 scaled to bytes."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("x", "e"))
    b = F.floor((F.col("e").cast("double") + F.lit(1.0)) * F.lit(127.5)).cast("int")
    return with_value(e.select(F.lit(0).alias("img"), F.col("vec_id").cast("int").alias("y"), "x", b.alias("b")))


def event_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image for each event type: day of month by hour, number of events, 0 where there are none."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = e.groupBy(F.col("event_type").alias("img"), (F.dayofmonth("ts") - 1).alias("y"), F.hour("ts").alias("x")).agg(F.count("*").cast("int").alias("n"))
    grid = e.select(F.col("event_type").alias("img")).distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(30)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(23))))
    return with_value(grid.join(n, ["img", "y", "x"], "left").select("img", "y", "x", F.coalesce("n", F.lit(0)).alias("b")))


def event_mask(spark: SparkSession, sf_dir: str, least: int = 4) -> DataFrame:
    """(img, y, x, m): where ``event_raster`` has at least ``least`` events."""
    return event_raster(spark, sf_dir).select("img", "y", "x", (F.col("b") >= least).alias("m"))


def embedding_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img, y, x, cls): the vectors' label modulo 3, for all their pixels."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    n = F.size("embedding")
    return e.filter(n > 0).select(F.lit(0).alias("img"), F.col("vec_id").cast("int").alias("y"), F.explode(F.sequence(F.lit(0), n - 1)).alias("x"), F.pmod("label", F.lit(3)).alias("cls"))


def sparse_labels(classes: DataFrame, every: int = 5) -> DataFrame:
    """(img, y, x, label): classes counted from 1 on every fifth row, 0 (not labelled) elsewhere."""
    return classes.select("img", "y", "x", F.when(F.pmod("y", F.lit(every)) == 0, F.col("cls") + 1).otherwise(0).alias("label"))


def to_rgb(px: DataFrame) -> DataFrame:
    """Three equal channels, column ``ch``."""
    return px.withColumn("ch", F.explode(F.sequence(F.lit(0), F.lit(2))))


def extent(px: DataFrame, keys=("img",)) -> DataFrame:
    """Height and width of each image."""
    return px.groupBy(*keys).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
