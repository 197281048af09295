"""Run-length encoded label images: height, width, then pairs of value and count, row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Pixels, and runs, that are put in order at once.
PIECE = 1 << 16


def running_total(df: DataFrame, keys: list[str], at: str, value: str, out: str, piece: int = PIECE) -> DataFrame:
    """Add the sum of ``value`` over the rows of a group that come before in ``at`` (whole numbers from 0): within pieces of the order, and from
    the pieces' own totals, one row each, so that no task holds a whole group. 0 for the first row."""
    placed = df.withColumn("piece_", F.floor(F.col(at) / piece))
    totals = placed.groupBy(*keys, "piece_").agg(F.sum(value).alias("total_"))
    along = lambda part, order: Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, "piece_", F.coalesce(F.sum("total_").over(along(keys, "piece_")), F.lit(0)).alias("carried_"))
    own = F.coalesce(F.sum(value).over(along([*keys, "piece_"], at)), F.lit(0))
    return placed.withColumn("own_", own).join(carried, [*keys, "piece_"]).withColumn(out, F.col("own_") + F.col("carried_")).drop("piece_", "own_", "carried_")


def decode_rle(lines: DataFrame, bias: int = 0) -> DataFrame:
    """(img, y, x, label) for the pixels that runs cover, from (img, line); ``bias`` is added to every count.

    Counts are taken as they are; pixels past the image's end are left out, pixels past the last run are not labelled.
    Running sums go over the runs of one image, not over its pixels, and in two levels.
    """
    n = F.split(F.trim("line"), r"\s+")
    split = lines.select("img", n.alias("n"))
    parts = split.select("img", F.get("n", F.lit(0)).cast("int").alias("h"), F.get("n", F.lit(1)).cast("int").alias("w"), F.slice("n", 3, F.greatest(F.size("n") - 2, F.lit(0))).alias("rest"))
    runs = parts.select("img", "h", "w", F.posexplode("rest").alias("k", "t"))
    pairs = runs.groupBy("img", "h", "w", F.floor(F.col("k") / 2).alias("run")).agg(
        F.max(F.when(F.col("k") % 2 == 0, F.col("t").cast("int"))).alias("label"), F.max(F.when(F.col("k") % 2 == 1, F.col("t").cast("long"))).alias("n")
    )
    pairs = pairs.withColumn("n", F.col("n") + bias).filter("n > 0")
    px = running_total(pairs, ["img"], "run", "n", "a")
    px = px.withColumn("i", F.explode(F.sequence(F.col("a"), F.col("a") + F.col("n") - 1))).filter(F.col("i") < F.col("h").cast("long") * F.col("w"))
    return px.select("img", F.floor(F.col("i") / F.col("w")).cast("int").alias("y"), (F.col("i") % F.col("w")).cast("int").alias("x"), "label")


def encode_rle(labels: DataFrame, width: int, piece: int = PIECE) -> DataFrame:
    """(img, value, n) runs of dense labels (img, y, x, label) in reading order, as (img, run, label, n).

    Runs are found within pieces of the reading order; a relation of one row for each piece says how many runs came before and whether its
    first run goes on with the last one of the piece before. No task orders a whole image.
    """
    i = (F.col("y").cast("long") * width + F.col("x")).cast("long")
    w = Window.partitionBy("img", "piece").orderBy("i")
    new = F.coalesce(F.lag("label").over(w) != F.col("label"), F.lit(True)).cast("int")
    placed = labels.select("img", "label", i.alias("i"), F.floor(i / piece).alias("piece")).withColumn("new", new)
    runs = placed.withColumn("run", F.sum("new").over(w) - 1).groupBy("img", "piece", "run").agg(F.first("label").alias("label"), F.count("*").alias("n"))
    ends = runs.groupBy("img", "piece").agg(F.count("*").alias("runs"), F.min_by("label", "run").alias("first"), F.max_by("label", "run").alias("last"))
    along = Window.partitionBy("img").orderBy("piece")
    goes_on = F.coalesce(F.lag("last").over(along) == F.col("first"), F.lit(False)).cast("int")
    before = F.coalesce(F.sum("runs").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.sum("on").over(along.rowsBetween(Window.unboundedPreceding, 0))
    carried = ends.withColumn("on", goes_on).select("img", "piece", before.alias("before"))
    whole = runs.join(carried, ["img", "piece"]).withColumn("run", F.col("run") + F.col("before"))
    return whole.groupBy("img", "run").agg(F.first("label").alias("label"), F.sum("n").alias("n"))
