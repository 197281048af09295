"""Names of all queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All default features of the embedding raster."""
    return QUERIES["multiscale_features"](spark, sf_dir)
