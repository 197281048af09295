"""The folder that all executors share, for files and checkpoints."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


#: The list that folders made in the current context are entered in, if any.
_MADE: ContextVar[list | None] = ContextVar("made", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders that operators stage within are removed at the end, so rows that are wanted afterwards must be written by then. Of
    contexts within each other the innermost owns what is staged."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(token)
        for path in made:
            remove(spark, path)


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local folder is set only where a local session has none, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not base and current.isDefined():
        base = current.get()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="pixelmill-")
    if not current.isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return qualified(spark, base).rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """A bare path with the store that Spark takes it to be in, so that those who open files by name meet the same one."""
    if ":" in path:
        return path
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString()


def store_path(spark: SparkSession, path: str) -> str:
    """A bare path means another disk on every executor of a cluster, so it is refused there."""
    if ":" not in path and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError(f"{path}: a path on a cluster names its store, as file:///... or s3a://... do")
    return path


def open_store(path: str):
    """(file system, path in it), for files that tasks read in part or write by name. Hadoop's names of object stores are known too."""
    from pyarrow import fs

    local = re.match(r"file:(?://)?(/[^/].*)", path)
    if local:  # taken as it is, as Spark does: spaces and % are parts of names
        return fs.LocalFileSystem(), local[1]
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))
    return fs.LocalFileSystem(), path


def opens(path: str) -> bool:
    """Does ``open_store`` reach the store of a path? Others are written and read by Spark alone."""
    try:
        return bool(open_store(path))
    except (OSError, ValueError, NotImplementedError):
        return False


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a file within its store; what was at ``target`` goes."""
    source, target = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (source, target))
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.delete(target, False)
    if not system.rename(source, target):
        raise OSError(f"cannot rename {source} to {target}")


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return [s.getPath().getName() for s in target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(target)]


def new_path(spark: SparkSession, name: str) -> str:
    path, made = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}", _MADE.get()
    if made is not None:
        made.append(path)
    return path


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def staged(df: DataFrame, name: str = "staged") -> DataFrame:
    """Write and reread in the shared folder: for rows that several steps read, so that they are computed once."""
    path = new_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in any store."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Rounds:
    """Tables of an iteration in the shared folder. What a round wrote goes when the next one is written; what is held stays."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.last = spark, name, None

    def hold(self, df: DataFrame) -> DataFrame:
        return staged(df, self.name)

    def keep(self, df: DataFrame) -> DataFrame:
        path = new_path(self.spark, self.name)
        df.write.mode("overwrite").parquet(path)
        if self.last:
            remove(self.spark, self.last)
        self.last = path
        return self.spark.read.schema(df.schema).parquet(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A text without line breaks, in any store that Spark writes."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path).first()[0]
