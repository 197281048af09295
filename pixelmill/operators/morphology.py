"""Components, regions, distances, modal filter, connectivity objectives."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import filters as K
from ..sources.shared import checkpoint, staged
from . import stencil as S

MODAL_K = 2


def modal_filter(seg: DataFrame, k: int = MODAL_K, value: str = "seg", tile: int = S.TILE) -> DataFrame:
    """The most frequent class in the closed disc of radius 2k + 1; of equally frequent ones the lowest."""
    r = 2 * k + 1
    offs = K.disc(r, closed=True)

    def mode(a: np.ndarray):
        best, most = np.zeros(a.shape, np.int64), np.full(a.shape, -1)
        views = list(K._shifted(a.astype(np.int64), offs))
        for c in np.unique(a):
            n = sum(((v == c) & ok).astype(np.int16) for v, ok in views)
            better = n > most
            best[better], most[better] = c, n[better]
        return [best]

    return S.by_tile(seg, mode, f"{value} int", r, value, tile=tile)


def modal_by_join(seg: DataFrame, k: int = MODAL_K, value: str = "seg") -> DataFrame:
    """As ``modal_filter``, by the offset join."""
    px = seg.select("img", "y", "x", F.col(value).alias("b"))
    return S.over_disc(px, K.disc(2 * k + 1, closed=True), [F.mode("n", True).cast("int").alias(value)])


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join pairs of labels to the smaller one, in rounds of pointer jumping."""
    while len(a):
        ra, rb = parent[a], parent[b]
        lo, hi = np.minimum(ra, rb), np.maximum(ra, rb)
        np.minimum.at(parent, hi, lo)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up
        open_ = parent[a] != parent[b]
        a, b = a[open_], b[open_]


def label_dense(mask: np.ndarray, classes: np.ndarray | None = None, connectivity: int = 8) -> np.ndarray:
    """Components of a dense mask: for each pixel the smallest row-major index of its component, -1 outside. With ``classes``,
    neighbours must also have the same class."""
    h, w = mask.shape
    c = np.zeros(mask.shape, np.int8) if classes is None else classes
    parent = np.arange(h * w)
    index = parent.reshape(h, w).copy()
    steps = ((0, 1), (1, 0)) + (((1, 1), (1, -1)) if connectivity == 8 else ())
    pairs = []
    for dy, dx in steps:
        a = (slice(0, h - dy), slice(max(0, -dx), w - max(0, dx)))
        b = (slice(dy, h), slice(max(0, dx), w - max(0, -dx)))
        joined = mask[a] & mask[b] & (c[a] == c[b])
        pairs.append((index[a][joined], index[b][joined]))
    _unite(parent, np.concatenate([p for p, _ in pairs]), np.concatenate([q for _, q in pairs]))
    return np.where(mask, parent.reshape(h, w), -1)


def connected_components(mask: DataFrame, cls: str | None = None, connectivity: int = 8, tile: int = S.TILE, width: int = 1 << 20) -> DataFrame:
    """(img, y, x, lab[, cls]) for pixels with ``m``; lab is y * width + x of the component's first pixel in reading order.

    Each tile finds its own components; labels that touch across tiles are then united by alternating stars over
    the tiles' border pixels only. With ``cls``, only pixels of equal class are connected.
    """
    code = F.when(F.col("m"), F.lit(1) if cls is None else F.col(cls).cast("int") + 1).otherwise(0).alias("code")
    wide = F.assert_true(F.col("x") < width, F.lit(f"images of up to {width} columns have labels"))
    px = mask.select("img", "y", F.when(wide.isNull(), F.col("x")).alias("x"), code)

    def run(a: np.ndarray):
        lab = label_dense(a > 0, a, connectivity)
        return [lab.astype(np.int64), a.astype(np.int32), np.full(a.shape, a.shape[1], np.int32)]

    local = S.by_tile(px, run, "lab long, code int, tw int", 0, "code", tile=tile).filter("code > 0")
    ty, tx = F.floor(F.col("y") / tile), F.floor(F.col("x") / tile)
    local = local.withColumn("lab", (ty * tile + F.floor(F.col("lab") / F.col("tw"))) * width + tx * tile + F.col("lab") % F.col("tw")).withColumn("lab", F.col("lab").cast("long"))
    local = local.select("img", "y", "x", "lab", "code")
    rim = local.filter((F.pmod("y", F.lit(tile)) == 0) | (F.pmod("y", F.lit(tile)) == tile - 1) | (F.pmod("x", F.lit(tile)) == 0) | (F.pmod("x", F.lit(tile)) == tile - 1))
    steps = [(0, 1), (1, 0), (1, 1), (1, -1)] if connectivity == 8 else [(0, 1), (1, 0)]
    offs = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in steps]))
    moved = rim.withColumn("o", offs).select("img", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), F.col("lab").alias("other"), "code")
    links = rim.join(moved, ["img", "y", "x", "code"]).filter("lab <> other").select("img", F.col("lab").alias("a"), F.col("other").alias("b")).distinct()
    united = unite(links)
    out = local.join(united, ["img", "lab"], "left").withColumn("lab", F.coalesce("root", "lab"))
    return out.select("img", "y", "x", "lab", *([] if cls is None else [(F.col("code") - 1).alias(cls)]))


def unite(links: DataFrame) -> DataFrame:
    """(img, lab, root): the smallest label reachable over links (img, a, b), for labels that have links."""
    edges = checkpoint(links.select("img", F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while edges.head(1):
        both = edges.unionByName(edges.select("img", F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("img", "u").agg(F.min("v").alias("w")).withColumn("w", F.least("u", "w"))
        large = both.join(least, ["img", "u"]).filter("v > u").select("img", F.col("v").alias("u"), F.col("w").alias("v")).distinct()
        low = large.groupBy("img", "u").agg(F.min("v").alias("w"))
        star = large.join(low, ["img", "u"])
        after = star.filter("v <> w").select("img", F.col("v").alias("u"), F.col("w").alias("v")).unionByName(star.select("img", "u", F.col("w").alias("v"))).distinct()
        after = checkpoint(after)
        same = not after.exceptAll(edges).head(1) and not edges.exceptAll(after).head(1)
        edges = after
        if same:
            break
    return edges.select("img", F.col("u").alias("lab"), F.col("v").alias("root"))


def regions(components: DataFrame, by: Sequence[str] = ("img", "lab")) -> DataFrame:
    """area and bounding box (maxr and maxc one past the last pixel) of each component."""
    return components.groupBy(*by).agg(
        F.count("*").alias("area"), F.min("y").alias("minr"), F.min("x").alias("minc"), (F.max("y") + 1).alias("maxr"), (F.max("x") + 1).alias("maxc")
    )


def _leaders(cost: np.ndarray) -> np.ndarray:
    """Places whose cost is below that of all later ones."""
    later = np.append(np.minimum.accumulate(cost[::-1])[::-1][1:], np.iinfo(np.int64).max)
    return np.flatnonzero(cost < later)


def row_distances(seed_row: np.ndarray, seed_x: np.ndarray, seed: np.ndarray, row: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each place (row, x) the least seed + (x - seed_x)**2 of its row's seeds, -1 without any. Both sides in order of row and x.

    The nearest seed moves to the right as the place does, so every second place of a level lies between the seeds of its neighbours: each
    level looks at each seed about once, and levels are as many as a row's places have binary digits.
    """
    out = np.full(len(x), -1, np.int64)
    if not len(x) or not len(seed):
        return out
    first = np.flatnonzero(np.diff(row, prepend=row[0] - 1))
    size = np.diff(np.append(first, len(row)))
    lo, hi = (np.searchsorted(seed_row, row[first], side) for side in ("left", "right"))
    at, of = np.arange(1, len(row) + 1) - np.repeat(first, size), np.repeat(size, size)  # place within its row, from 1
    low, high = np.repeat(lo, size), np.repeat(hi - 1, size)  # the seeds that may be nearest
    known = np.full(len(row), -1, np.int64)
    step = 1 << int(size.max()).bit_length()
    while step:
        mine = np.flatnonzero((at % (2 * step) == step) & (high >= low))
        before, after = mine[at[mine] > step], mine[at[mine] + step <= of[mine]]
        low[before], high[after] = known[before - step], known[after + step]
        a, b = low[mine], high[mine]
        n = b - a + 1
        start = np.cumsum(n) - n
        s = np.arange(int(n.sum())) - np.repeat(start - a, n)
        cost = seed[s] + (np.repeat(x[mine], n) - seed_x[s]) ** 2
        if len(mine):
            best = np.minimum.reduceat(cost, start)
            hit = np.flatnonzero(cost == np.repeat(best, n))
            known[mine], out[mine] = s[hit[np.searchsorted(hit, start)]], best
        step //= 2
    return out


def edt_squared(mask: DataFrame, columns: int = 4096, rows: int = 64) -> DataFrame:
    """(img, y, x, d2): squared distance of each pixel with ``m`` to the nearest one without; 0 for those without, null
    where an image has none.

    The distance within columns comes from windows. Rows are then cut in pieces, a task holds ``rows`` x ``columns`` pixels; of a piece other
    pieces of the row see those seeds only that may be the nearest of all of them beyond its ends. Work is in proportion to the pixels.
    """
    w = Window.partitionBy("img", "x").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(~F.col("m"), F.col("y")), True)
    g = F.least(F.col("y") - last.over(w.orderBy("y")), last.over(w.orderBy(F.col("y").desc())) - F.col("y")).cast("long")
    near = mask.select("img", "y", "x", (g * g).alias("g"), F.floor(F.col("y") / rows).cast("int").alias("band"), F.floor(F.col("x") / columns).cast("int").alias("piece"))
    kind = mask.schema["img"].dataType.simpleString()
    keys = ["img", "band", "piece"]

    def held(t):
        y, x = (t.column(c).to_numpy().astype(np.int64) for c in ("y", "x"))
        order = np.lexsort((x, y))
        g = t.column("g").combine_chunks()
        return y[order], x[order], g.is_valid().to_numpy(zero_copy_only=False)[order], g.fill_null(0).to_numpy(zero_copy_only=False)[order]

    def ends(key, t):
        """Seeds that pieces on the right (side 1) and on the left (side 0) may need."""
        y, x, ok, g = held(t)
        y, x, g = y[ok], x[ok], g[ok]
        out = [[], [], [], []]
        for i, j in zip(*(lambda f: (f, np.append(f[1:], len(y))))(np.flatnonzero(np.diff(y, prepend=-1)))):
            right = i + _leaders(g[i:j] + ((key[2].as_py() + 1) * columns - x[i:j]) ** 2)
            left = j - 1 - _leaders((g[i:j] + (x[i:j] - key[2].as_py() * columns + 1) ** 2)[::-1])
            for side, at in ((0, left), (1, right)):
                for column, v in zip(out, (np.full(len(at), side), y[at], x[at], g[at])):
                    column.append(v)
        cols = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
        n = len(cols[0])
        return pa.table({"img": pa.array([key[0].as_py()] * n, t.column("img").type), "band": pa.array([key[1].as_py()] * n, pa.int32()), "piece": pa.array([key[2].as_py()] * n, pa.int32())} | {c: pa.array(v.astype(np.int64)) for c, v in zip(("side", "y", "x", "g"), cols)})

    def resolved(key, t, *others):
        y, x, ok, g = held(t)
        sy, sx, sg = y[ok], x[ok], g[ok]
        for o in others:
            sy, sx, sg = (np.concatenate((mine, o.column(c).to_numpy())) for mine, c in ((sy, "y"), (sx, "x"), (sg, "g")))
            order = np.lexsort((sx, sy))
            sy, sx, sg = sy[order], sx[order], sg[order]
        d = row_distances(sy, sx, sg, y, x)
        return pa.table({"img": pa.array([key[0].as_py()] * len(y), t.column("img").type), "y": pa.array(y.astype(np.int32)), "x": pa.array(x.astype(np.int32)), "d2": pa.array(np.maximum(d, 0), mask=d < 0)})

    out = f"img {kind}, y int, x int, d2 long"
    if (mask.agg(F.max("x")).first()[0] or 0) < columns:
        return near.groupBy(*keys).applyInArrow(lambda key, t: resolved(key, t), out)
    near = staged(near, "distances")
    far = near.groupBy(*keys).applyInArrow(ends, f"img {kind}, band int, piece int, side long, y long, x long, g long")
    to = near.select("img", "band", F.col("piece").alias("to")).distinct()
    reach = (F.col("side") == 1) & (F.col("to") > F.col("piece")) | (F.col("side") == 0) & (F.col("to") < F.col("piece"))
    sent = far.join(to, ["img", "band"]).filter(reach).select("img", "band", F.col("to").alias("piece"), "y", "x", "g")
    return near.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(lambda key, t, other: resolved(key, t, other), out)


def uniform(mask: DataFrame) -> DataFrame:
    """(img, uniform): whether all pixels of the image agree."""
    return mask.groupBy("img").agg((F.bool_and("m") | ~F.bool_or("m")).alias("uniform"))


def connectivity_objective(mask: DataFrame, target: str, weight: float = 1.0, connectivity: int = 8) -> DataFrame:
    """(img, y, x, loss, grad) for the connectivity of one class's mask.

    ``minimise``: loss weight / n for n components, grad weight * loss / distance to the outside. ``maximise``: loss
    weight * ln n, grad weight * loss * (area / largest area + 1 / distance to the inside). 1 / 0 counts as 0; a uniform
    mask has no loss and no gradient.
    """
    same = uniform(mask)
    lab = connected_components(mask, connectivity=connectivity)
    reg = regions(lab)
    n = reg.groupBy("img").agg(F.count("*").alias("n"), F.max("area").alias("largest"))
    px = mask.join(same, "img").join(n, "img", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    inverse = lambda d: F.when(F.coalesce(d, F.lit(0)) > 0, F.lit(1.0) / F.sqrt(d.cast("double"))).otherwise(F.lit(0.0))
    if target == "minimise":
        d = edt_squared(mask)
        loss = F.when(F.col("uniform") | (F.col("n") == 0), F.lit(0.0)).otherwise(F.lit(float(weight)) / F.col("n"))
        j = px.join(d, ["img", "y", "x"])
        return j.select("img", "y", "x", loss.alias("loss"), (F.lit(float(weight)) * loss * inverse(F.col("d2"))).alias("grad"))
    if target == "maximise":
        d = edt_squared(mask.withColumn("m", ~F.col("m")))
        loss = F.when(F.col("uniform") | (F.col("n") == 0), F.lit(0.0)).otherwise(F.lit(float(weight)) * F.log(F.col("n").cast("double")))
        area = lab.join(reg.select("img", "lab", "area"), ["img", "lab"]).select("img", "y", "x", "area")
        j = px.join(d, ["img", "y", "x"]).join(area, ["img", "y", "x"], "left")
        share = F.coalesce(F.col("area") / F.col("largest"), F.lit(0.0))
        return j.select("img", "y", "x", loss.alias("loss"), (F.lit(float(weight)) * loss * (share + inverse(F.col("d2")))).alias("grad"))
    raise ValueError(f"unknown connectivity target {target}")


def connectivity_gradient(seg: DataFrame, targets: dict[int, str], classes: int, weight: float = 1.0) -> DataFrame:
    """(img, y, x, grad): for each class array element the sum over targeted classes, + for the class itself, - for the others."""
    total = None
    for cls, target in targets.items():
        g = connectivity_objective(seg.select("img", "y", "x", (F.col("seg") == cls).alias("m")), target, weight).select("img", "y", "x", F.lit(cls).alias("cls"), "grad")
        total = g if total is None else total.unionByName(g)
    made = F.array(*[F.sum(F.when(F.col("cls") == i, F.col("grad")).otherwise(-F.col("grad"))) for i in range(classes)])
    return total.groupBy("img", "y", "x").agg(made.alias("grad"))


def candidate_regions(seg: DataFrame, least: dict[int, int] | None = None, default: int = 225) -> DataFrame:
    """Components of equal class, class 0 left out, with more pixels than the class's least size: area, box and class."""
    comp = connected_components(seg.withColumn("m", F.col("seg") > 0), cls="seg")
    reg = regions(comp, ("img", "seg", "lab"))
    need = F.lit(default)
    for c, n in (least or {}).items():
        need = F.when(F.col("seg") == c, n).otherwise(need)
    return reg.filter(F.col("area") > need)


def paste_masks(seg: DataFrame, masks: DataFrame) -> DataFrame:
    """Set pixels of ``masks`` (img, y, x, value, ord) in ``seg``; where masks overlap the one with the highest ord wins."""
    top = masks.groupBy("img", "y", "x").agg(F.max_by("value", "ord").alias("value"))
    return seg.join(top, ["img", "y", "x"], "left").select("img", "y", "x", F.coalesce("value", "seg").alias("seg"))
