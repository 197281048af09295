"""Dense random fields by mean-field steps on grey and colour images of any size.

Messages of the wide kernel over places and colours run through a sparse lattice of cells: a tile shares its pixels out to the corners
of the cells they lie in, and sends the sums of its cells, few beside its pixels, to the tiles within the kernel's reach. A tile adds up what
it got, blurs the cells along each axis, and reads its pixels back. The narrow kernel over places is a separable convolution
on the tile and strips of its neighbours' pixels. Between steps the messages are written; a task holds one tile and what reaches it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import filters as K
from ..functions.config import CRFParams
from ..sources.shared import Rounds

#: Probabilities are kept above this before their logarithm is taken; the side of a tile.
LEAST, TILE = 1e-6, 512
#: Cells to a kernel's width; sharing out and reading back already spread by a third of a cell's square. Cells that a blur reaches.
CELLS = 1.5
REACH = int(np.ceil(3 * CELLS))
#: Bits of a cell's number for y, x and three colours; numbers begin at ``REACH`` + 1, so a blur never leaves its bits.
BITS = (18, 18, 9, 9, 9)
SHIFT = tuple(sum(BITS[k + 1 :]) for k in range(5))


class Lattice:
    """The corners of the cells that points (n, 5), one a kernel's width, lie in; dimensions that are not in ``keep`` do not count."""

    def __init__(self, points: np.ndarray, keep: list[int]):
        scaled = points[:, keep] * CELLS
        low = np.floor(scaled)
        part, low = scaled - low, low.astype(np.int64)
        for k, bits in enumerate(BITS[i] for i in keep):
            if len(low) and (low[:, k].min() < 0 or low[:, k].max() + 2 * REACH + 3 >= 1 << bits):
                raise ValueError("a kernel is too narrow for an image of this size")
        stride = np.array([1 << SHIFT[i] for i in keep], np.int64)
        base, which = np.unique(((low + REACH + 1) * stride).sum(1), return_inverse=True)
        corners = list(product((0, 1), repeat=len(keep)))
        codes = [base + int(np.dot(c, stride)) for c in corners]
        self.cells = np.unique(np.concatenate(codes))
        self.at = [np.searchsorted(self.cells, c)[which] for c in codes]
        self.weights = [np.prod([part[:, k] if bit else 1 - part[:, k] for k, bit in enumerate(c)], 0) for c in corners]

    def share(self, values: np.ndarray) -> np.ndarray:
        """The sums of ``values`` (n, k) at the cells."""
        out = np.zeros((len(self.cells), values.shape[1]))
        for at, w in zip(self.at, self.weights):
            for j in range(values.shape[1]):
                out[:, j] += np.bincount(at, w * values[:, j], len(self.cells))
        return out

    def read(self, cells: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """The values of the points from those of all cells, which hold at least the points' own."""
        own = sums[np.searchsorted(cells, self.cells)]
        return sum(w[:, None] * own[at] for at, w in zip(self.at, self.weights))


def blurred(cells: np.ndarray, sums: np.ndarray, keep: list[int]) -> np.ndarray:
    """Sums spread along each axis over the cells in use; others hold nothing and are not filled."""
    taps = np.exp(-np.arange(1, REACH + 1) ** 2 / (2 * (CELLS * CELLS - 1 / 3)))
    for i in keep:
        new = sums.copy()
        for k in range(1, REACH + 1):
            here = np.searchsorted(cells, cells + (k << SHIFT[i]))
            one = np.flatnonzero(here < len(cells))
            one = one[cells[here[one]] == cells[one] + (k << SHIFT[i])]
            other = here[one]
            new[one] += taps[k - 1] * sums[other]
            new[other] += taps[k - 1] * sums[one]
        sums = new
    return sums


def _soft(m: np.ndarray) -> np.ndarray:
    e = np.exp(m - m.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _numbers(raw: bytes, kind: str, width: int | None = None) -> np.ndarray:
    out = np.frombuffer(raw, kind)
    return out if width is None else out.reshape(-1, width)


_TILE = "ty int, tx int, h int, w int, keep int, y binary, x binary, unary binary, colour binary"
_STATE = f"{_TILE}, narrow binary, wide binary"
_MESSAGE = "ty int, tx int, cells binary, sums binary, ys binary, xs binary, vals binary"


class Tile:
    """A tile's pixels, and what they send and receive."""

    def __init__(self, row: dict, p: CRFParams, side: int):
        self.p, self.side = p, side
        self.ty, self.tx, self.h, self.w = (row[c] for c in ("ty", "tx", "h", "w"))
        self.y, self.x = _numbers(row["y"], "<i4"), _numbers(row["x"], "<i4")
        self.unary, colour = _numbers(row["unary"], "<f8").reshape(len(self.y), -1), _numbers(row["colour"], "<f8", 3)
        self.keep = [k for k in range(5) if row["keep"] >> k & 1] or [0]
        self.lattice = Lattice(np.hstack([np.stack([self.y / p.sxy_b[0], self.x / p.sxy_b[1]], 1), colour / np.array(p.s_rgb)]), self.keep)
        self.norms = [_numbers(row[c], "<f8")[:, None] for c in ("narrow", "wide")] if "narrow" in row else None

    def _span(self, axis: int, t: int) -> tuple[int, int]:
        """Cells, as numbered, that reach pixels of the t-th tile along an axis."""
        width, low = self.p.sxy_b[axis], REACH + 1
        return int(np.floor(t * self.side / width * CELLS)) + low - REACH, int(np.floor(((t + 1) * self.side - 1) / width * CELLS)) + 1 + low + REACH

    def _near(self, axis: int) -> range:
        own, n = (self.ty, self.tx)[axis], -(-(self.h, self.w)[axis] // self.side)
        reach = max((2 * REACH + 3) * self.p.sxy_b[axis] / CELLS, 4 * self.p.sxy_g[axis] + 1)
        k = int(np.ceil(reach / self.side))
        return range(max(0, own - k), min(n, own + k + 1))

    def messages(self, narrow: np.ndarray, wide: np.ndarray) -> Iterator[tuple]:
        """For each tile within reach: sums of cells, and pixels' values for the narrow kernel."""
        cells, sums = self.lattice.cells, self.lattice.share(wide)
        at = [(cells >> SHIFT[k]) & ((1 << BITS[k]) - 1) for k in (0, 1)]
        inside = lambda axis, t: np.ones(len(cells), bool) if axis not in self.keep else (at[axis] >= self._span(axis, t)[0]) & (at[axis] <= self._span(axis, t)[1])
        strip = lambda axis, t, v: (v >= t * self.side - int(4 * self.p.sxy_g[axis] + 0.5)) & (v < (t + 1) * self.side + int(4 * self.p.sxy_g[axis] + 0.5))
        for ty in self._near(0):
            c, s = inside(0, ty), strip(0, ty, self.y)
            for tx in self._near(1):
                mine, px = np.flatnonzero(c & inside(1, tx)), np.flatnonzero(s & strip(1, tx, self.x))
                if len(mine) or len(px):
                    yield ty, tx, cells[mine].tobytes(), sums[mine].tobytes(), self.y[px].tobytes(), self.x[px].tobytes(), narrow[px].tobytes()

    def received(self, t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """The sums of both kernels at the tile's pixels."""
        got = {c: t.column(c).to_pylist() for c in ("cells", "sums", "ys", "xs", "vals")}
        each = [_numbers(c, "<i8") for c in got["cells"]]
        cells, which = np.unique(np.concatenate(each), return_inverse=True)
        parts = np.concatenate([_numbers(s, "<f8").reshape(len(c), -1) for c, s in zip(each, got["sums"]) if len(c)])
        sums = np.zeros((len(cells), parts.shape[1]))
        np.add.at(sums, which, parts)
        wide = self.lattice.read(cells, blurred(cells, sums, self.keep))
        ys, xs = (np.concatenate([_numbers(v, "<i4") for v in got[c]]) for c in ("ys", "xs"))
        vals = np.concatenate([_numbers(v, "<f8") for v in got["vals"]]).reshape(len(ys), -1)
        taps = [np.exp(-(np.arange(-int(4 * s + 0.5), int(4 * s + 0.5) + 1) ** 2) / (2.0 * s * s)) for s in self.p.sxy_g]
        r = [len(a) // 2 for a in taps]
        y0, x0, shape = self.ty * self.side - r[0], self.tx * self.side - r[1], [self.side + 2 * k for k in r]
        narrow = np.empty((len(self.y), vals.shape[1]))
        for j in range(vals.shape[1]):
            plane = np.zeros(shape)
            plane[ys - y0, xs - x0] = vals[:, j]
            for axis, a in enumerate(taps):
                n = shape[axis]
                p = K.pad(plane, *((r[0], 0) if axis == 0 else (0, r[1])), "zero")
                plane = sum(v * (p[k : k + n] if axis == 0 else p[:, k : k + n]) for k, v in enumerate(a))
            narrow[:, j] = plane[self.y - y0, self.x - x0]
        return narrow, wide

    def sent(self, q: np.ndarray) -> Iterator[tuple]:
        return self.messages(q * self.norms[0], q * self.norms[1])

    def step(self, t: pa.Table) -> np.ndarray:
        sums = self.received(t)
        return _soft(sum(weight * norm * s for weight, norm, s in zip((self.p.compat_g, self.p.compat_b), self.norms, sums)) - self.unary)


def _table(rows, img, kind: pa.DataType, schema: str) -> pa.Table:
    """Rows of tuples as a table with the image's key before them."""
    types = {"int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) or [[]] * len(fields)
    return pa.table({"img": pa.array([img] * len(columns[0]), kind)} | {n: pa.array(c, types[k]) for (n, k), c in zip(fields, columns)})


def _tiles(px: DataFrame, side: int) -> DataFrame:
    """One row for each tile of (img, y, x, prob, c): its pixels packed, the image's size, and which dimensions vary in it."""
    kind = px.schema["img"].dataType.simpleString()
    value = lambda k: F.col("c")[k]
    size = px.groupBy("img").agg(
        (F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"),
        sum((F.when(F.min(v) < F.max(v), 1 << k).otherwise(0) for k, v in enumerate([F.col("y"), F.col("x"), value(0), value(1), value(2)])), F.lit(0)).cast("int").alias("keep"),
    )

    def pack(key, t):
        flat = lambda c: t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1).astype("<f8")
        unary = -np.log(np.clip(flat("prob"), LEAST, 1))
        y, x = (t.column(c).to_numpy().astype("<i4") for c in ("y", "x"))
        row = (key[1].as_py(), key[2].as_py(), *(t.column(c)[0].as_py() for c in ("h", "w", "keep")), y.tobytes(), x.tobytes(), unary.tobytes(), flat("c").tobytes())
        return _table([row], key[0].as_py(), t.column("img").type, _TILE)

    at = px.withColumns({"ty": F.floor(F.col("y") / side).cast("int"), "tx": F.floor(F.col("x") / side).cast("int")})
    return at.join(size, "img").groupBy("img", "ty", "tx").applyInArrow(pack, f"img {kind}, {_TILE}")


def refine(prob: DataFrame, px: DataFrame, params: CRFParams | None = None, tile: int = TILE) -> DataFrame:
    """(img, y, x, seg): class of most probability after refining ``prob`` (array) by places and the grey values or colours
    (column ``ch``) of ``px``. A grey image counts as three equal channels. Kernels are symmetrically normalised, compatibility is Potts'.

    Every tile of an image is a task of its own in each step; results do not depend on ``tile`` but for the order of sums.
    """
    p = params or CRFParams()
    kind = px.schema["img"].dataType.simpleString()
    if "ch" in px.columns:
        channel = lambda k: F.max(F.when(F.col("ch") == k, F.col("b")))
        grouped = px.groupBy("img", "y", "x").agg(*[channel(k).cast("double").alias(f"c{k}") for k in range(3)])
        colours = grouped.select("img", "y", "x", F.when(F.col("c1").isNull() | F.col("c2").isNull(), F.array("c0", "c0", "c0")).otherwise(F.array("c0", "c1", "c2")).alias("c"))
    else:
        colours = px.select("img", "y", "x", F.array(*[F.col("b").cast("double")] * 3).alias("c"))
    rounds = Rounds(px.sparkSession, "field")
    tiles = rounds.hold(_tiles(prob.select("img", "y", "x", "prob").join(colours, ["img", "y", "x"]), tile))

    def sends(make):
        """Messages of tiles by themselves."""

        def run(batches):
            for rb in batches:
                for row in rb.to_pylist():
                    t = Tile(row, p, tile)
                    yield from _table(make(t), row["img"], rb.schema.field("img").type, _MESSAGE).to_batches()

        return run

    def meets(make, schema: str):
        """Tiles with the messages that reach them; where no pixels are, messages go."""

        def run(key, own, got):
            rows = own.to_pylist()
            return _table([x for row in rows for x in make(row, Tile(row, p, tile), got)], key[0].as_py(), got.column("img").type, schema)

        return lambda own, got: own.groupBy("img", "ty", "tx").cogroup(got.groupBy("img", "ty", "tx")).applyInArrow(run, f"img {kind}, {schema}")

    def ones(t: Tile):
        one = np.ones((len(t.y), 1))
        return t.messages(one, one)

    def normed(row: dict, t: Tile, got: pa.Table):
        yield (*(row[f.split()[0]] for f in _TILE.split(", ")), *((1 / np.sqrt(np.maximum(s, 1e-20))).tobytes() for s in t.received(got)))

    def classes(row: dict, t: Tile, q: np.ndarray):
        yield from zip(t.y.tolist(), t.x.tolist(), q.argmax(1).tolist())

    if not p.n_infer:
        alone = lambda batches: (b for rb in batches for row in rb.to_pylist() for t in [Tile(row, p, tile)] for b in _table(classes(row, t, -t.unary), row["img"], rb.schema.field("img").type, "y int, x int, seg int").to_batches())
        return tiles.mapInArrow(alone, f"img {kind}, y int, x int, seg int")
    message = f"img {kind}, {_MESSAGE}"
    state = rounds.hold(meets(normed, _STATE)(tiles, rounds.keep(tiles.mapInArrow(sends(ones), message))))
    sent = rounds.keep(state.mapInArrow(sends(lambda t: t.sent(_soft(-t.unary))), message))
    for _ in range(p.n_infer - 1):
        sent = rounds.keep(meets(lambda row, t, got: t.sent(t.step(got)), _MESSAGE)(state, sent))
    return meets(lambda row, t, got: classes(row, t, t.step(got)), "y int, x int, seg int")(state, sent)


def from_labels(seg: DataFrame, px: DataFrame, classes: int, confidence: float | None = None, params: CRFParams | None = None) -> DataFrame:
    """As ``refine``, from hard labels (img, y, x, seg) that are right with ``confidence`` (that of ``params`` where not given)."""
    confidence = (params or CRFParams()).label_confidence if confidence is None else confidence
    rest = (1 - confidence) / max(classes - 1, 1)
    made = F.array(*[F.when(F.col("seg") == i, F.lit(confidence)).otherwise(F.lit(rest)) for i in range(classes)])
    return refine(seg.select("img", "y", "x", made.alias("prob")), px, params)
