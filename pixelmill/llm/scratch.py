"""Shared scratch space and the staged corpus that several operators read more than once.

Intermediate tables go below ``spark.checkpoint.dir`` (all executors share it); a local folder is
set only where a local session has none, as in tests. Lost executors recompute from those tables.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The list that scratch folders made in the current context are entered in, if any.
_OWNER: ContextVar[list | None] = ContextVar("owner", default=None)


def shared_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            base = current.get()
        elif spark.sparkContext.master.startswith("local"):
            base = "file://" + tempfile.mkdtemp(prefix="llm-scratch-")
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return qualified(spark, base).rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """A bare path with the store that Spark takes it to be in, so that those who open files by name meet the same one."""
    if ":" in path:
        return path
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString()


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def owned():
    """A list of the scratch folders made within; whoever opens this removes them when their rows are written."""
    made: list[Scratch] = []
    token = _OWNER.set(made)
    try:
        yield made
    finally:
        _OWNER.reset(token)


def result(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The rows of ``make()``, written and reread; all other scratch that it made is gone."""
    out = Scratch(spark, name)
    with owned() as made:
        try:
            return out.keep(make(), "rows")
        finally:
            for s in made:
                s.remove()


def end_stage(spark: SparkSession) -> None:
    """Remove the scratch of the session's last pipeline stage, whose rows are written by now."""
    for s in getattr(spark, "_stage_scratch", []):
        s.remove()
    spark._stage_scratch = []


@contextmanager
def pipeline_stage(spark: SparkSession):
    """Scratch made within belongs to the session's current stage; that of the stage before goes first."""
    end_stage(spark)
    with owned() as made:
        spark._stage_scratch = made
        yield


class Scratch:
    """One folder for the intermediates of one operator call."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.tables: list[str] = []
        self.batches = 0  #: batches of the corpus staged last, at least
        owner = _OWNER.get()
        if owner is not None:
            owner.append(self)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write and reread: cuts the lineage without a copy that dies with its executor."""
        at = f"{self.path}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, name: str) -> None:
        _remove(self.spark, f"{self.path}/{name}")

    def remove(self) -> None:
        """Delete everything; call it only when the results that read it have been written."""
        for t in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")
        self.tables.clear()
        _remove(self.spark, self.path)

    def stage(self, docs: DataFrame, name: str = "corpus", text: str = "text") -> tuple[DataFrame, int]:
        """Write ``docs`` once, without a shuffle, as a table bucketed by ``batch``.

        Every input partition becomes one bucket (beyond ``BUCKETS`` partitions some share one), of batches of about ``BATCH_MB`` of
        text, so later per-batch answers meet the texts without moving them. Returns the table and the number of buckets.
        """
        parts = max(1, docs.rdd.getNumPartitions())
        n = min(parts, BUCKETS)
        size = docs.select(F.spark_partition_id().alias("p"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n")).groupBy("p").agg(F.sum("n").alias("n"))
        need = np.ones(parts, np.int32)
        for r in size.toLocalIterator():  # a row for each input partition
            need[r["p"] % parts] = max(1, -(-r["n"] // (BATCH_MB << 20)))
        most, self.batches = int(need.max()), int(need.sum())

        @F.pandas_udf("long")
        def batch(p: pd.Series, row: pd.Series) -> pd.Series:
            p, row = p.to_numpy() % parts, row.to_numpy()
            return pd.Series(bucket_value(p % n, (p // n) * most + row % need[p]))

        numbered = docs.withColumns({"__staged_partition": F.spark_partition_id(), "__staged_row": F.monotonically_increasing_id()})
        out = numbered.withColumn("batch", batch("__staged_partition", "__staged_row")).drop("__staged_partition", "__staged_row")
        table = f"stage_{uuid.uuid4().hex[:16]}"
        self.tables.append(table)
        out.write.bucketBy(n, "batch").option("path", f"{self.path}/{name}").option("compression", "zstd").format("parquet").saveAsTable(table)
        return self.spark.table(table), n


#: Buckets of a staged table at most (Spark's own limit); MB of text to a batch.
BUCKETS, BATCH_MB = 100_000, 4


def _u32(x) -> np.ndarray:
    return np.asarray(x).astype(np.int64).astype(np.uint32)


def _turn(x: np.ndarray, k: int) -> np.ndarray:
    return (x << np.uint32(k)) | (x >> np.uint32(32 - k))


def bucket_value(bucket: np.ndarray, k: np.ndarray, seed: int = 42) -> np.ndarray:
    """The long with upper half ``k`` whose 32-bit Murmur3 hash, which Spark's bucketing uses, is the number ``bucket``.

    Every step of the hash can be undone, so a bucket has one such long for each ``k``.
    """
    inverse = lambda m: np.uint32(pow(m, -1, 1 << 32))
    h, high = _u32(bucket), _u32(k)
    h = h ^ (h >> np.uint32(16))
    h = h * inverse(0xC2B2AE35)
    h = h ^ (h >> np.uint32(13)) ^ (h >> np.uint32(26))
    h = h * inverse(0x85EBCA6B)
    h = h ^ (h >> np.uint32(16)) ^ np.uint32(8)

    def before(x):
        return _turn((x - np.uint32(0xE6546B64)) * inverse(5), 19)

    h = before(h) ^ (_turn(high * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593))
    low = before(h) ^ np.uint32(seed)
    low = _turn(low * inverse(0x1B873593), 17) * inverse(0xCC9E2D51)
    return (high.astype(np.int64) << 32) | low.astype(np.int64)
