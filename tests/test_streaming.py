import random

import numpy as np
from pyspark.sql import functions as F

from pixelmill.functions.config import FeatureConfig
from pixelmill.operators.features import multiscale_features
from pixelmill.operators.rasters import event_raster, with_value
from pixelmill.streaming.arrivals import PIECES, featurise_arrivals, featurise_pieces, read_arrivals, read_pieces


def test_arrivals_equal_a_batch(spark, sf, tmp_path):
    c = FeatureConfig(sigmas=(4.0,), membrane_projections=False)
    px = event_raster(spark, sf).select(F.col("img").cast("string").alias("img"), "y", "x", "b")
    images = [r.img for r in px.select("img").distinct().orderBy("img").collect()]
    for half in (images[:2], images[2:]):
        px.filter(F.col("img").isin(half)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = featurise_arrivals(read_arrivals(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state", c)
        q.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").drop("batch")
    want = multiscale_features(with_value(px), c).select(*got.columns)
    assert got.count() == want.count() and not got.exceptAll(want).head(1)


def test_tiles_in_any_order_equal_the_whole(spark, tmp_path):
    """Pieces of two images mixed over four files and as many restarts, some rows twice, one image never complete."""
    c = FeatureConfig(sigmas=(1.0, 2.0), membrane_projections=False, mean=True)
    rng = np.random.default_rng(0)
    sizes = {"a": (50, 41), "b": (16, 16), "lost": (20, 20)}
    rows = [(k, h, w, y, x, int(rng.integers(0, 256))) for k, (h, w) in sizes.items() for y in range(h) for x in range(w)]
    whole = [r for r in rows if r[0] != "lost"]
    sent = [r for r in rows if r[0] != "lost" or (r[3], r[4]) != (10, 10)]
    random.Random(1).shuffle(sent)
    counts = []
    for k in range(4):
        part = sent[k::4] + sent[:20] + [("a", 50, 41, 60, 3, 9)]  # some rows again, and one beyond its image
        spark.createDataFrame(part, PIECES).repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
        featurise_pieces(read_pieces(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state", c, tile=16).awaitTermination()
        counts.append(spark.read.parquet(f"{tmp_path}/out").count())
    got = spark.read.parquet(f"{tmp_path}/out")
    px = with_value(spark.createDataFrame(whole, PIECES).select("img", "y", "x", "b"))
    want = multiscale_features(px, c).select(*got.columns)
    assert counts == sorted(counts) and got.filter("img = 'lost' and y < 0").count() == 0
    here = got.filter("img <> 'lost'")
    assert here.count() == want.count() == len(whole) and not here.exceptAll(want).head(1)
