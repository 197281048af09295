"""Images that arrive over time: features of every micro-batch of whole images, or of tiles as soon as they and what lies around
them have arrived, appended as Parquet."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.config import FeatureConfig
from ..operators import stencil as S
from ..operators.features import halo_of, multiscale_features, stack_names, tile_kernel
from ..operators.rasters import with_value

PX = "img string, y int, x int, b int"
#: Pixels that arrive in any order: each tells the size of its image.
PIECES = "img string, h int, w int, y int, x int, b int"


def read_arrivals(spark: SparkSession, path: str) -> DataFrame:
    """A stream of pixel rows; a file holds whole images."""
    return spark.readStream.schema(PX).parquet(path)


def featurise_arrivals(px: DataFrame, out: str, checkpoint: str, config: FeatureConfig | None = None) -> StreamingQuery:
    """Write features of all images that are there, a folder for each batch, and stop.

    A batch that is repeated after a failure replaces its own folder, so no image is written twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        multiscale_features(with_value(batch), config).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return px.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    """A stream of pixel rows; a file holds any part of any images."""
    return spark.readStream.schema(PIECES).parquet(path)


def tile_features(px: DataFrame, config: FeatureConfig | None = None, tile: int = S.TILE) -> DataFrame:
    """(img, y, x, features) of a stream of ``PIECES``, tile by tile.

    A tile and its halo are a state of their own, which gathers pixels over batches until none is missing; then its features go out, once,
    and its pixels go. A pixel goes to the few tiles whose halo it lies in. Pixels that arrive again before their tile is complete replace
    the earlier ones, later they change nothing; tiles that never fill up stay in the state. Rows outside their image are left out.
    """
    c = config or FeatureConfig()
    halo, names, kernel = halo_of(c), stack_names(c), tile_kernel(c)
    kind = T.DoubleType() if c.cast_to == "f64" else T.FloatType()
    out = T.StructType([T.StructField("img", T.StringType()), T.StructField("y", T.IntegerType()), T.StructField("x", T.IntegerType()), *(T.StructField(n, kind) for n in names)])
    near = lambda at, side: F.sequence(F.greatest(F.lit(0), F.floor((F.col(at) - halo) / tile)).cast("int"), F.least(F.floor((F.col(side) - 1) / tile), F.floor((F.col(at) + halo) / tile)).cast("int"))
    inside = px.filter("y >= 0 and x >= 0 and y < h and x < w")
    dealt = inside.withColumn("ty", F.explode(near("y", "h"))).withColumn("tx", F.explode(near("x", "w")))

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        img, h, w, ty, tx = key
        y0, x0 = max(0, ty * tile - halo), max(0, tx * tile - halo)
        shape = min(h, (ty + 1) * tile + halo) - y0, min(w, (tx + 1) * tile + halo) - x0
        done, held = state.get if state.exists else (False, b"")
        if done:
            return
        a = np.frombuffer(held, np.int16).reshape(shape).copy() if held else np.full(shape, -1, np.int16)
        for f in frames:
            a[f["y"].to_numpy() - y0, f["x"].to_numpy() - x0] = f["b"].to_numpy()
        if (a < 0).any():
            state.update((False, a.tobytes()))
            return
        state.update((True, b""))
        y1, x1 = min(h, (ty + 1) * tile), min(w, (tx + 1) * tile)
        own = slice(ty * tile - y0, y1 - y0), slice(tx * tile - x0, x1 - x0)
        planes = kernel(a.astype(np.int32))
        rows, columns = (v.ravel() for v in np.mgrid[ty * tile : y1, tx * tile : x1])
        yield pd.DataFrame({"img": img, "y": rows.astype(np.int32), "x": columns.astype(np.int32)} | {n: np.ascontiguousarray(p[own]).ravel() for n, p in zip(names, planes)})

    return dealt.groupBy("img", "h", "w", "ty", "tx").applyInPandasWithState(run, out, "done boolean, held binary", "append", GroupStateTimeout.NoTimeout)


def featurise_pieces(px: DataFrame, out: str, checkpoint: str, config: FeatureConfig | None = None, tile: int = S.TILE) -> StreamingQuery:
    """Append the features of all tiles that are complete with what is there, and stop; the checkpoint keeps the others for the next call."""
    rows = tile_features(px, config, tile).writeStream.format("parquet").option("path", out)
    return rows.option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
