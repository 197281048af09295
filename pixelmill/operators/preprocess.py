"""Preprocessing of images before features: blur, wavelet denoising, adaptive equalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import filters as K
from ..sources.shared import Rounds, staged
from . import stencil as S
from .rasters import extent

#: Steps in the order in which they are tested; each starts from the original image, so the last one named holds.
ORDER = ("blur", "denoise", "equalize")


def blur(px: DataFrame, keys=("img",)) -> DataFrame:
    """Gaussian of width 1, cut at 4: (keys, y, x, v)."""
    return S.blur(px, "v", K.normal_taps(1.0, 4), "p_", keys).select(*keys, "y", "x", F.col("p_").alias("v"))


#: Median of the absolute value of a standard normal variable.
NORMAL_MEDIAN = 0.6744897501960817
#: Bins of a round of ``exact_median``; bins and tiles a side of the adaptive equalisation.
MEDIAN_BINS, BINS, GRID = 4096, 256, 8


def exact_median(values: DataFrame, col: str, keys: Sequence[str], out: str = "median") -> DataFrame:
    """(keys, out): the exact median of each group, the mean of the two middle values of an even number.

    The two middle ranks are narrowed down by histograms: each round counts the values between the bounds in equal bins and goes on
    with the least and greatest value of the bin that holds the rank, until they are one. A group is never in one place; a rank's
    histogram has ``MEDIAN_BINS`` rows.
    """
    n = values.groupBy(*keys).agg(F.min(col).alias("lo"), F.max(col).alias("hi"), F.count(col).alias("n"))
    ranks = F.explode(F.array(F.struct(F.lit(0).alias("half"), F.floor((F.col("n") - 1) / 2).alias("nth")), F.struct(F.lit(1).alias("half"), F.floor(F.col("n") / 2).alias("nth"))))
    rounds = Rounds(values.sparkSession, "median")
    state = rounds.keep(n.filter("n > 0").withColumn("r", ranks).select(*keys, "r.half", F.col("r.nth").cast("long").alias("nth"), F.lit(0).cast("long").alias("below"), "lo", "hi"))
    while state.filter("lo < hi").head(1):
        j = values.join(state.filter("lo < hi"), list(keys)).filter(F.col(col).between(F.col("lo"), F.col("hi")))
        place = F.floor((F.col(col) - F.col("lo")) / (F.col("hi") - F.col("lo")) * MEDIAN_BINS)
        bins = j.groupBy(*keys, "half", "nth", "below", F.least(place, F.lit(MEDIAN_BINS - 1)).alias("bin")).agg(F.count("*").alias("c"), F.min(col).alias("lo"), F.max(col).alias("hi"))
        w = Window.partitionBy(*keys, "half").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        before = F.col("below") + F.coalesce(F.sum("c").over(w), F.lit(0))
        held = bins.withColumn("before", before).filter((F.col("before") <= F.col("nth")) & (F.col("nth") < F.col("before") + F.col("c")))
        state = rounds.keep(state.filter("lo = hi").unionByName(held.select(*keys, "half", "nth", F.col("before").alias("below"), "lo", "hi")))
    return state.groupBy(*keys).agg(F.avg("lo").alias(out))


def haar_level(px: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, y, x, a, dx, dy, dd) of the 2 x 2 blocks of (keys, y, x, v, h, w): mean, and details across, down and diagonal, all times 2.
    A side of odd length repeats its last pixel; other missing pixels count as 0."""
    at = lambda dy, dx: F.max(F.when((F.col("y") % 2 == dy) & (F.col("x") % 2 == dx), F.col("v")))
    blocks = px.groupBy(*keys, "h", "w", F.floor(F.col("y") / 2).cast("int").alias("y"), F.floor(F.col("x") / 2).cast("int").alias("x")).agg(at(0, 0).alias("p"), at(0, 1).alias("q"), at(1, 0).alias("r"), at(1, 1).alias("s"))
    right, below = 2 * F.col("x") + 1 < F.col("w"), 2 * F.col("y") + 1 < F.col("h")
    none = F.lit(0.0)
    b = blocks.withColumn("p", F.coalesce("p", none))
    b = b.withColumn("q", F.when(right, F.coalesce("q", none)).otherwise(F.col("p"))).withColumn("r", F.when(below, F.coalesce("r", none)).otherwise(F.col("p")))
    b = b.withColumn("s", F.when(right & below, F.coalesce("s", none)).when(right, F.col("q")).otherwise(F.col("r")))
    p, q, r, s = (F.col(c) for c in "pqrs")
    half = lambda side: F.floor((F.col(side) + 1) / 2).cast("int").alias(side)
    return b.select(*keys, "y", "x", half("h"), half("w"), ((p + q + r + s) / 2).alias("a"), ((p - q + r - s) / 2).alias("dx"), ((p + q - r - s) / 2).alias("dy"), ((p - q - r + s) / 2).alias("dd"))


def _shrunk(detail: str) -> Column:
    """A detail moved towards 0 by the noise's square over the signal of its band."""
    b, noise = F.col(detail), F.col("noise")
    t = noise * noise / F.sqrt(F.greatest(F.col(f"m_{detail}") - noise * noise, F.lit(1e-12)))
    return F.signum(b) * F.greatest(F.abs(b) - t, F.lit(0.0))


def denoise(px: DataFrame, keys=("img",)) -> DataFrame:
    """Haar wavelet shrinkage, (keys, y, x, v), with a threshold for each band from the image's noise and the band's own spread.

    The pyramid is a relation: a level's blocks are the rows of the next one, a quarter as many. The noise is the exact median of the
    finest diagonal details; on the way down each row takes its place in its parent's block. Images with a side of one pixel stay as they are.
    """
    keys = list(keys)
    depth = F.when(F.least("h", "w") < 2, 0).otherwise(F.greatest(F.lit(1), F.length(F.bin(F.least("h", "w"))) - 4))
    size = extent(px, keys).withColumn("levels", depth)
    here = px.select(*keys, "y", "x", F.col("v").cast("double").alias("v")).join(size.select(*keys, "h", "w"), keys)
    most = size.agg(F.max("levels")).first()[0] or 0
    levels, rows = [], here
    for k in range(1, most + 1):
        made = staged(haar_level(rows.join(size.filter(F.col("levels") >= k).select(*keys), keys, "left_semi"), keys), "haar")
        levels.append(made)
        rows = made.withColumnRenamed("a", "v")
    if not levels:
        return px.select(*keys, "y", "x", F.col("v").cast("double").alias("v"))
    noise = exact_median(levels[0].select(*keys, F.abs("dd").alias("m")), "m", keys).select(*keys, (F.col("median") / F.lit(NORMAL_MEDIAN)).alias("noise"))
    below = None
    for k in range(most, 0, -1):
        made = levels[k - 1]
        spread = made.groupBy(*keys).agg(*[F.avg(F.col(d) * F.col(d)).alias(f"m_{d}") for d in ("dx", "dy", "dd")]).join(noise, keys)
        top = made.join(size.filter(F.col("levels") == k).select(*keys), keys, "left_semi").select(*keys, "y", "x", "a")
        mean = top if below is None else top.unionByName(below.withColumnRenamed("v", "a"))
        parent = made.drop("a", "h", "w").join(mean, [*keys, "y", "x"]).join(spread, keys)
        parent = parent.select(*keys, F.col("y").alias("py"), F.col("x").alias("px"), "a", *[_shrunk(d).alias(d) for d in ("dx", "dy", "dd")])
        child = here if k == 1 else levels[k - 2]
        child = child.select(*keys, "y", "x", F.floor(F.col("y") / 2).cast("int").alias("py"), F.floor(F.col("x") / 2).cast("int").alias("px"))
        down, right = F.col("y") % 2 == 1, F.col("x") % 2 == 1
        a, x, y, d = (F.col(c) for c in ("a", "dx", "dy", "dd"))
        value = F.when(~down & ~right, (a + x + y + d) / 2).when(~down, (a - x + y - d) / 2).when(~right, (a + x - y - d) / 2).otherwise((a - x - y + d) / 2)
        below = child.join(parent, [*keys, "py", "px"]).select(*keys, "y", "x", value.alias("v"))
    still = here.join(size.filter("levels = 0").select(*keys), keys, "left_semi").select(*keys, "y", "x", "v")
    return below.unionByName(still)


def equalize(px: DataFrame, keys=("img",), clip: float = 0.01) -> DataFrame:
    """Histogram equalisation, (keys, y, x, v), on a grid of 8 x 8 tiles with clipped histograms, blended between tile centres.

    Pixels meet their histograms as sums by tile and bin; running shares of the bins are a relation of ``GRID`` * ``GRID`` * ``BINS`` rows for
    each image, which pixels join once, by the four tiles around them and their own bin. A flat image becomes 0. Missing pixels do not count.
    """
    keys = list(keys)
    size = px.groupBy(*keys).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    side = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / GRID)).cast("int")
    size = size.withColumns({"th": side("h"), "tw": side("w")}).withColumns({"ny": F.ceil(F.col("h") / F.col("th")).cast("int"), "nx": F.ceil(F.col("w") / F.col("tw")).cast("int")})
    flat = F.col("hi") <= F.col("lo")
    q = F.when(flat, 0).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1))).cast("int")
    here = px.select(*keys, "y", "x", "v").join(size, keys).withColumn("q", q)
    i, j = F.floor(F.col("y") / F.col("th")).cast("int").alias("i"), F.floor(F.col("x") / F.col("tw")).cast("int").alias("j")
    counts = here.groupBy(*keys, i, j, "q").agg(F.count("*").alias("n"))
    total = counts.groupBy(*keys, "i", "j").agg(F.sum("n").alias("size"))
    most = F.greatest(F.lit(1.0), F.lit(clip) * F.col("size"))
    over = counts.join(total, [*keys, "i", "j"]).withColumn("over", F.greatest(F.col("n") - most, F.lit(0.0)))
    all_bins = total.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))))
    shares = all_bins.join(over.select(*keys, "i", "j", "q", F.least(F.col("n").cast("double"), most).alias("n"), "over"), [*keys, "i", "j", "q"], "left").na.fill(0.0, ["n", "over"])
    w = Window.partitionBy(*keys, "i", "j").orderBy("q")
    spread = F.sum("over").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) / BINS
    shares = shares.withColumn("share", (F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) + (F.col("q") + 1) * spread) / F.col("size"))
    # a tile's shares go to the pixels right of and below its centre, and to those of the tiles left of and above it
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    at = lambda a, b: F.max(F.when((F.col("c.a") == a) & (F.col("c.b") == b), F.col("share")))
    maps = shares.withColumn("c", corner).groupBy(*keys, (F.col("i") - F.col("c.a")).alias("i"), (F.col("j") - F.col("c.b")).alias("j"), "q").agg(*[at(a, b).alias(f"s{a}{b}") for a in (0, 1) for b in (0, 1)])
    maps = maps.filter("s00 is not null").withColumns({"s01": F.coalesce("s01", "s00"), "s10": F.coalesce("s10", "s00")}).withColumn("s11", F.coalesce("s11", "s01", "s10"))
    last_row, last_column = F.col("i") == F.col("ny") - 1, F.col("j") == F.col("nx") - 1
    fy, fx = (F.col("y") + 0.5) / F.col("th") - 0.5, (F.col("x") + 0.5) / F.col("tw") - 0.5
    placed = here.withColumns({"fy": fy, "fx": fx}).withColumns({"i": F.greatest(F.least(F.floor("fy"), F.col("ny") - 1), F.lit(0)).cast("int"), "j": F.greatest(F.least(F.floor("fx"), F.col("nx") - 1), F.lit(0)).cast("int")})
    near = placed.join(maps, [*keys, "i", "j", "q"])
    s01 = F.when(last_column, F.col("s00")).otherwise(F.col("s01"))
    s10 = F.when(last_row, F.col("s00")).otherwise(F.col("s10"))
    s11 = F.when(last_row & last_column, F.col("s00")).when(last_row, F.col("s01")).when(last_column, F.col("s10")).otherwise(F.col("s11"))
    part = lambda f, k: F.least(F.greatest(f - k, F.lit(0.0)), F.lit(1.0))
    ay, ax = part(F.col("fy"), F.col("i")), part(F.col("fx"), F.col("j"))
    value = (1 - ay) * ((1 - ax) * F.col("s00") + ax * s01) + ay * ((1 - ax) * s10 + ax * s11)
    return near.select(*keys, "y", "x", F.when(flat, F.lit(0.0)).otherwise(value).alias("v"))


def preprocess(px: DataFrame, steps, keys=("img",)) -> DataFrame:
    """The last of the named steps in ``ORDER``, from the original image; None or no steps give the image itself.

    Values are floats from 0 to 1 after a step. Channels in a column ``ch`` are preprocessed each on its own if it is among the keys.
    """
    steps = steps or ()
    unknown = set(steps) - set(ORDER)
    if unknown:
        raise ValueError(f"unknown preprocessing {sorted(unknown)}")
    out = px
    for s in ORDER:
        if s in steps:
            out = {"blur": blur, "denoise": denoise, "equalize": equalize}[s](px, keys)
    return out
