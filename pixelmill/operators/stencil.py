"""Neighbourhood operators in two forms with equal results.

*Relational*: taps along an axis are window functions, two-dimensional neighbourhoods a join with offsets.
*Tiles*: pixels are dealt to tiles with a halo, each tile is a dense array in a Python worker. Relational suits
separable filters, tiles suit discs, whose offset join would multiply the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rasters import extent

#: Side of a tile without its halo.
TILE = 256
#: A side that no image exceeds: an image is one tile, which is filled and given out piece by piece.
WHOLE = 1 << 30
#: Pixels of a whole image that go out in one batch.
BATCH = 1 << 18
AXES = ("y", "x")


def line(axis: str, keys: Sequence[str] = ("img",)) -> Window:
    """The pixels of a row or column, in order along ``axis``."""
    other = AXES[1 - AXES.index(axis)]
    return Window.partitionBy(*keys, other).orderBy(axis)


def neighbour(col: Column, k: int, axis: str, keys=("img",), mode: str = "nearest") -> Column:
    """The value ``k`` pixels further along ``axis``; outside the image, the nearest pixel's, 0, or null (``none``)."""
    w = line(axis, keys)
    if k == 0:
        return col
    got = F.lag(col, -k).over(w) if k < 0 else F.lead(col, k).over(w)
    if mode == "none":
        return got
    if mode == "zero":
        return F.coalesce(got, F.lit(0.0))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.coalesce(got, (F.first(col) if k < 0 else F.last(col)).over(whole))


def blur(px: DataFrame, col: str, taps: Sequence[float], out: str, keys=("img",), mode: str = "nearest") -> DataFrame:
    """Weighted sums along y, then x, in the order of the taps. One projection for each axis."""
    r = len(taps) // 2
    if r == 0:
        return px.withColumn(out, F.col(col))
    for axis, source in (("y", col), ("x", "blur_")):
        terms = [F.lit(w) * neighbour(F.col(source), k - r, axis, keys, mode) for k, w in enumerate(taps)]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        px = px.withColumn("blur_", total)
    return px.withColumn(out, F.col("blur_")).drop("blur_")


def gradient(col: Column, axis: str, keys=("img",)) -> Column:
    """Central difference, one-sided at the border, 0 where the axis has one pixel."""
    before, after = neighbour(col, -1, axis, keys, "none"), neighbour(col, 1, axis, keys, "none")
    return F.when(before.isNull() & after.isNull(), F.lit(0.0)).when(before.isNull(), after - col).when(after.isNull(), col - before).otherwise((after - before) / F.lit(2.0))


def edges(px: DataFrame, col: str, out: str, keys=("img",)) -> DataFrame:
    g = px.withColumn("gx_", gradient(F.col(col), "x", keys)).withColumn("gy_", gradient(F.col(col), "y", keys))
    return g.withColumn(out, F.sqrt(F.col("gx_") * F.col("gx_") + F.col("gy_") * F.col("gy_"))).drop("gx_", "gy_")


def hessian(px: DataFrame, col: str, names: Sequence[str], keys=("img",)) -> DataFrame:
    """Eigenvalues, and with five names also modulus, trace and determinant."""
    g = px.withColumn("gx_", gradient(F.col(col), "x", keys)).withColumn("d", gradient(F.col("gx_"), "x", keys))
    g = g.withColumn("gy_", gradient(F.col(col), "y", keys)).withColumn("b_", gradient(F.col("gy_"), "x", keys)).withColumn("a_", gradient(F.col("gy_"), "y", keys))
    a, b, d = F.col("a_"), F.col("b_"), F.col("d")
    root = F.sqrt(F.lit(4) * b * b + (a - d) * (a - d))
    made = [(a + d + root) / 2, (a + d - root) / 2, F.sqrt(a * a + b * b + d * d), a + d, a * d - b * b]
    out = g.select(*px.columns, *[m.alias(n) for m, n in zip(made, names)])
    return out


def laplacian(px: DataFrame, col: str, out: str, keys=("img",)) -> DataFrame:
    c = F.col(col)
    near = lambda k, axis: neighbour(c, k, axis, keys)
    return px.withColumn(out, F.lit(4.0) * c - near(-1, "y") - near(1, "y") - near(-1, "x") - near(1, "x"))


def over_disc(px: DataFrame, offsets: Sequence[tuple[int, int]], aggregates: Sequence[Column], carry: Sequence[str] = (), keys=("img",)) -> DataFrame:
    """Offset join: each pixel meets all pixels of its neighbourhood, which ``aggregates`` see as ``n`` (value) and carried columns.

    The rows are as many as pixels times offsets before the partial sums; tiles do better on large discs.
    """
    spark = px.sparkSession
    offs = spark.createDataFrame([(int(y), int(x)) for y, x in offsets], "dy int, dx int")  # as many rows as the disc has cells
    moved = px.select(*keys, "y", "x", F.col("b").alias("n")).join(F.broadcast(offs)).select(*keys, (F.col("y") - F.col("dy")).alias("y"), (F.col("x") - F.col("dx")).alias("x"), "n")
    here = px.select(*keys, "y", "x", *carry)
    return here.join(moved, [*keys, "y", "x"]).groupBy(*keys, "y", "x").agg(*aggregates)


def by_tile(
    px: DataFrame, kernel: Callable[..., Sequence[np.ndarray]], out: T.StructType | str, halo: int, value: str | Sequence[str] = "b", keys: Sequence[str] = ("img",), tile: int = TILE, shape: DataFrame | None = None
) -> DataFrame:
    """Apply ``kernel`` to the dense array of every tile with a halo, and return its results as columns beside keys, y and x. With
    several value columns it gets an array for each.

    A tile sees ``halo`` pixels beyond its sides where the image goes on, so the kernel's border rule holds at the
    image's border only. Missing pixels count as 0 and get no row. Images of any size spread over tiles of bounded size.
    ``shape`` (keys, h, w) spares the pass that finds the extents. With ``tile`` WHOLE the kernel gets whole images; then a task holds the
    arrays of one and what the kernel makes of them, while its pixels come and go in batches.
    """
    schema = T._parse_datatype_string(out) if isinstance(out, str) else out
    values = [value] if isinstance(value, str) else list(value)
    kinds = [f for f in px.select(*keys).schema.fields]
    packed = T.StructType([*kinds, T.StructField("ty", T.IntegerType()), T.StructField("tx", T.IntegerType()), *[T.StructField(f"p{i}", T.BinaryType()) for i in range(2 + len(values))]])
    result = T.StructType([*kinds, T.StructField("y", T.IntegerType()), T.StructField("x", T.IntegerType()), *schema.fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, sent = to_arrow_schema(result), to_arrow_schema(packed)
    types = [np.dtype(np.int32), np.dtype(np.int32), *(f.type.to_pandas_dtype() for f in to_arrow_schema(px.select(*values).schema))]

    def deal(batches):
        """For every tile that the pixels of a batch are near, one row with all of them."""
        for rb in batches:
            if not rb.num_rows:
                continue
            cols = [pc.fill_null(rb.column(i), 0) if rb.column(i).null_count else rb.column(i) for i in range(len(keys), rb.num_columns)]
            cols = [np.ascontiguousarray(c.to_numpy(zero_copy_only=False).astype(t)) for c, t in zip(cols, types)]
            group = np.zeros(rb.num_rows, np.int64)
            for i in range(len(keys)):
                d = pc.dictionary_encode(rb.column(i), null_encoding="encode")
                group = group * len(d.dictionary) + d.indices.to_numpy(zero_copy_only=False)
            y, x = (c.astype(np.int64) for c in cols[:2])
            k = -(-halo // tile)
            reach = range(-k, k + 1)
            for dy in reach:
                ty = y // tile + dy
                near_y = (ty >= 0) & (ty >= (y - halo) // tile) & (ty <= (y + halo) // tile)
                for dx in reach:
                    tx = x // tile + dx
                    near = near_y & (tx >= 0) & (tx >= (x - halo) // tile) & (tx <= (x + halo) // tile)
                    at = np.flatnonzero(near)
                    if not len(at):
                        continue
                    code = (group[at] << 42) | (ty[at] << 21) | tx[at]
                    if (code[1:] < code[:-1]).any():
                        order = np.argsort(code, kind="stable")
                        at, code = at[order], code[order]
                    cut = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
                    first = pa.array(at[cut])
                    blobs = [[c[at[i:j]].tobytes() for i, j in zip(cut, np.append(cut[1:], len(at)))] for c in cols]
                    yield pa.RecordBatch.from_arrays(
                        [*(rb.column(i).take(first) for i in range(len(keys))), pa.array(ty[at[cut]].astype(np.int32)), pa.array(tx[at[cut]].astype(np.int32)), *(pa.array(b, pa.binary()) for b in blobs)], schema=sent
                    )

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        h, w = t.column("h")[0].as_py(), t.column("w")[0].as_py()
        ty, tx = key[-2].as_py(), key[-1].as_py()
        y0, x0 = max(0, ty * tile - halo), max(0, tx * tile - halo)
        y1, x1 = min(h, (ty + 1) * tile + halo), min(w, (tx + 1) * tile + halo)
        ys, xs, *flats = (np.frombuffer(b"".join(t.column(f"p{i}").to_pylist()), d) for i, d in enumerate(types))
        arrays = []
        for flat in flats:
            a = np.zeros((y1 - y0, x1 - x0), flat.dtype)
            a[ys - y0, xs - x0] = flat
            arrays.append(a)
        mine = (ys >= ty * tile) & (ys < (ty + 1) * tile) & (xs >= tx * tile) & (xs < (tx + 1) * tile)
        ys, xs = ys[mine], xs[mine]
        if not len(ys):
            return arrow.empty_table()
        inner = (slice(ty * tile - y0, min(h, (ty + 1) * tile) - y0), slice(tx * tile - x0, min(w, (tx + 1) * tile) - x0))
        rows, cols_ = inner[0].stop - inner[0].start, inner[1].stop - inner[1].start
        whole = len(ys) == rows * cols_ and len(np.unique(ys.astype(np.int64) * (w + 1) + xs)) == len(ys)
        if whole:  # every pixel is there: planes go out as they lie
            ys, xs = np.repeat(np.arange(rows, dtype=np.int32) + inner[0].start + y0, cols_), np.tile(np.arange(cols_, dtype=np.int32) + inner[1].start + x0, rows)
        cols = {k: pa.array([x.as_py()] * len(ys), t.column(k).type) for k, x in zip(keys, key)}
        cols |= {"y": pa.array(ys.astype(np.int32)), "x": pa.array(xs.astype(np.int32))}
        for name, plane in zip((f.name for f in schema), kernel(*arrays)):
            cols[name] = pa.array(np.ascontiguousarray(plane[inner]).ravel() if whole else np.ascontiguousarray(plane[ys - y0, xs - x0]))
        return pa.table(cols).cast(arrow)

    def run_whole(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = None
        for rb in batches:
            for i in range(rb.num_rows):
                if arrays is None:
                    h, w = rb.column("h")[i].as_py(), rb.column("w")[i].as_py()
                    arrays, times = [np.zeros((h, w), d) for d in types[2:]], np.zeros((h, w), np.uint32)
                ys, xs, *flats = (np.frombuffer(rb.column(f"p{k}")[i].as_buffer(), d) for k, d in enumerate(types))
                for a, flat in zip(arrays, flats):
                    a[ys, xs] = flat
                np.add.at(times, (ys, xs), 1)
        planes, step = list(kernel(*arrays)), max(1, BATCH // w)
        for top in range(0, h, step):
            rows = times[top : top + step]
            ys, xs = np.nonzero(rows)
            if len(ys) and int(rows.max()) > 1:  # a pixel given twice has two rows
                ys, xs = (np.repeat(c, rows[ys, xs]) for c in (ys, xs))
            cols = {k: pa.repeat(x, len(ys)) for k, x in zip(keys, key)}
            cols |= {"y": pa.array((ys + top).astype(np.int32)), "x": pa.array(xs.astype(np.int32))}
            cols |= {f.name: pa.array(np.asarray(plane)[ys + top, xs]) for f, plane in zip(schema, planes)}
            yield from pa.table(cols).cast(arrow).to_batches()

    dealt = px.select(*keys, "y", "x", *values).mapInArrow(deal, packed).join(extent(px, keys) if shape is None else shape, list(keys))
    # few bytes, much work: the number of tasks must not follow the bytes, so partitions are asked for by number
    tasks = 2 * int(px.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(tasks, *keys, "ty", "tx").groupBy(*keys, "ty", "tx").applyInArrow(run_whole if tile >= WHOLE else run, result)
