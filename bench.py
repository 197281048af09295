"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line with seconds for each."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "multiscale_features", "gaussian_blur", "hessian_filter", "rank_median", "bilateral", "membrane_projections", "structure_tensor", "training_pixels", "iou_per_class", "connected_components", "edt", "modal_filter",
    "rf_segment", "gbt_segment", "train_and_apply",
)


def square(spark: SparkSession, side: int):
    """A side x side raster whose pixels repeat the embedding raster's, cached as rows."""
    from pixelmill.operators.rasters import embedding_raster

    px = embedding_raster(spark, SF)
    size = px.agg(F.max("y") + 1, F.max("x") + 1).first()
    grid = spark.range(side * side).select(F.floor(F.col("id") / side).cast("int").alias("ty"), (F.col("id") % side).cast("int").alias("tx"))
    grid = grid.select("ty", "tx", (F.col("ty") % size[0]).cast("int").alias("y"), (F.col("tx") % size[1]).cast("int").alias("x"))
    out = grid.join(px, ["y", "x"]).select("img", F.col("ty").alias("y"), F.col("tx").alias("x"), "b", "v").cache()
    out.count()
    return out


def timed(run, repeat: int = 3) -> float:
    """Seconds of the best of some runs, the rows written nowhere."""
    best = float("inf")
    for _ in range(repeat):
        t = time.time()
        run().write.format("noop").mode("overwrite").save()
        best = min(best, time.time() - t)
    return best


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from pixelmill.functions.config import FeatureConfig
    from pixelmill.operators import features, models
    from pixelmill.operators import labels as L
    from pixelmill.plans.registry import QUERIES

    seconds = {q: round(timed(lambda q=q: QUERIES[q](spark, SF), 2), 3) for q in HEADLINE}
    for side in (512, 1536):
        px = square(spark, side)
        seconds[f"featurise_{side}"] = round(timed(lambda: features.multiscale_features(px, FeatureConfig())), 3)
        stack = features.multiscale_features(px, FeatureConfig()).cache()  # all 58 default features
        stack.count()
        names = [c for c in stack.columns if c not in ("img", "y", "x")]
        labels = px.select("img", "y", "x", F.when(F.col("y") % 32 == 0, 1 + F.least(F.floor(F.col("b") / 86), F.lit(2)).cast("int")).otherwise(0).alias("label"))
        train = L.training_pixels(stack, labels).cache()
        model = models.train(models.get_model("random_forest", names, 3, {"n_estimators": 200, "max_features": 2}), train)
        seconds[f"apply_{side}"] = round(timed(lambda model=model: models.apply(model, stack)), 3)
        for df in (train, stack, px):
            df.unpersist()
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": SF}))
    spark.stop()


if __name__ == "__main__":
    main()
