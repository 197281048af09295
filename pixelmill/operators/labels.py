"""Labels, training sets, probabilities and metrics as relations over pixels."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Distinct label values at most.
MOST_LABELS = 20


def contiguous(labels: DataFrame, value: str = "label", most: int = MOST_LABELS) -> DataFrame:
    """Replace the sorted distinct values of each image by 0, 1, 2, ...; more than ``most`` of them is an error.

    The lowest value becomes 0, the unlabelled one, whether or not it stood for that.
    """
    kinds = labels.select("img", value).distinct()
    w = Window.partitionBy("img").orderBy(value)
    ranked = kinds.withColumn("to_", F.dense_rank().over(w) - 1)
    too_many = F.assert_true(F.col("to_") < most, F.lit(f"more than {most} label values"))
    ranked = ranked.withColumn("to_", F.when(too_many.isNull(), F.col("to_")))
    return labels.join(ranked, ["img", value]).withColumn(value, F.col("to_").cast("int")).drop("to_")


def rgb_key(r: Column, g: Column, b: Column) -> Column:
    """One number for a colour; (255, 0, 0) and (0, 1, 0) share one."""
    return r + 255 * g + 255 * 255 * b


def from_rgb(labels: DataFrame, most: int = MOST_LABELS) -> DataFrame:
    """(img, y, x, label) from (img, y, x, r, g, b)."""
    return contiguous(labels.select("img", "y", "x", rgb_key(F.col("r"), F.col("g"), F.col("b")).alias("label")), "label", most)


def to_grey(seg: DataFrame, value: str = "label", offset: int = 1, largest: int | None = None) -> DataFrame:
    """Spread class numbers over 0..255: (value + offset) * (255 div (largest + offset))."""
    if largest is None:
        top = seg.groupBy("img").agg(F.max(value).alias("top_"))
        seg = seg.join(top, "img")
    else:
        seg = seg.withColumn("top_", F.lit(largest))
    step = F.floor(F.lit(255) / (F.col("top_") + offset)).cast("int")
    return seg.withColumn("grey", ((F.col(value) + offset) * step).cast("int")).drop("top_")


def merge_classes(labels: DataFrame, into: dict[int, int], value: str = "label") -> DataFrame:
    c = F.col(value)
    for old, new in into.items():
        c = F.when(F.col(value) == old, new).otherwise(c)
    return labels.withColumn(value, c)


def resize_nearest(labels: DataFrame, h: int, w: int, value: str = "label") -> DataFrame:
    """Scale label images to h x w by the nearest source pixel."""
    from .rasters import extent

    size = extent(labels)
    grid = size.withColumn("ty", F.explode(F.sequence(F.lit(0), F.lit(h - 1)))).withColumn("tx", F.explode(F.sequence(F.lit(0), F.lit(w - 1))))
    source = lambda at, old, new: F.floor((F.col(at) + 0.5) * F.col(old) / F.lit(float(new))).cast("int")
    grid = grid.select("img", "ty", "tx", source("ty", "h", h).alias("y"), source("tx", "w", w).alias("x"))
    return grid.join(labels, ["img", "y", "x"]).select("img", F.col("ty").alias("y"), F.col("tx").alias("x"), value)


def training_pixels(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Features of labelled pixels; labels are counted from 1, classes of the result from 0."""
    return features.join(labels.filter("label <> 0"), ["img", "y", "x"]).withColumn("label", F.col("label") - 1)


def training_union(stacks: Sequence[DataFrame | str], labels: Sequence[DataFrame]) -> DataFrame:
    """Training pixels of several images together. A stack may be the path of one that was kept (``images.load_features``)."""
    from ..sources.images import load_features

    if not stacks or len(stacks) != len(labels):
        raise ValueError("as many label sets as stacks are needed, and one at least")
    read = [load_features(y.sparkSession, f) if isinstance(f, str) else f for f, y in zip(stacks, labels)]
    return reduce(DataFrame.unionByName, (training_pixels(f, y) for f, y in zip(read, labels)))


def sample(train: DataFrame, n: int = -1, shuffle: bool = True, seed: int = 0) -> DataFrame:
    """The first ``n`` rows (all where n is not positive), in seeded order or by image, row and column."""
    if n <= 0:
        return train
    keys = [F.col("img"), F.col("y"), F.col("x")]
    mixed = F.md5(F.concat_ws(" ", F.lit(str(seed)), *[k.cast("string") for k in keys]).cast("binary"))
    return train.orderBy(mixed if shuffle else keys[0], *keys).limit(n)


def argmax(prob: Column) -> Column:
    """Place, from 0, of the largest probability; the first of equal ones."""
    return (F.array_position(prob, F.array_max(prob)) - 1).cast("int")


def iou_per_class(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """(cls, iou) for the classes of ``truth``; ``pred`` has seg, ``truth`` has cls."""
    both = pred.join(truth, ["img", "y", "x"])
    pairs = both.groupBy("seg", "cls").agg(F.count("*").alias("n"))
    of_truth = pairs.groupBy("cls").agg(F.sum("n").alias("t"), F.sum(F.when(F.col("seg") == F.col("cls"), F.col("n")).otherwise(0)).alias("both"))
    of_pred = pairs.groupBy(F.col("seg").alias("cls")).agg(F.sum("n").alias("p"))
    j = of_truth.join(of_pred, "cls", "left").withColumn("p", F.coalesce("p", F.lit(0)))
    return j.select("cls", (F.col("both") / (F.col("t") + F.col("p") - F.col("both"))).alias("iou"))


def miou(pred: DataFrame, truth: DataFrame) -> DataFrame:
    return iou_per_class(pred, truth).agg(F.avg("iou").alias("miou"))


def class_weights(train: DataFrame) -> DataFrame:
    """(label, n, weight): rows / (classes * rows of the class)."""
    n = train.groupBy("label").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("rows"), F.count("*").alias("classes"))
    return n.join(F.broadcast(total)).select("label", "n", (F.col("rows") / (F.col("classes") * F.col("n"))).alias("weight"))


def volume_fraction(seg: DataFrame) -> DataFrame:
    """(img, seg, fraction): the share of an image's pixels that each class has."""
    n = seg.groupBy("img", "seg").agg(F.count("*").alias("n"))
    total = n.groupBy("img").agg(F.sum("n").alias("all"))
    return n.join(total, "img").select("img", "seg", (F.col("n") / F.col("all")).alias("fraction"))


def volume_fraction_gradient(prob: DataFrame, target: Sequence[float], weight: float = 1.0) -> DataFrame:
    """Loss and gradient of the volume fractions of argmax classes against ``target``; classes with no positive target are left out.

    (img, loss, grad): loss = weight * sum (p - t)^2, grad = 2 * weight * (p - t) for each class; the same for all pixels.
    """
    k = len(target)
    seg = prob.select("img", argmax(F.col("prob")).alias("seg"))
    p = seg.groupBy("img").agg(*[F.avg((F.col("seg") == i).cast("double")).alias(f"p{i}") for i in range(k)])
    d = [(F.col(f"p{i}") - F.lit(float(t))) if t is not None and t > 0 else F.lit(0.0) for i, t in enumerate(target)]
    loss = F.lit(0.0)
    for x in d:
        loss = loss + x * x
    return p.select("img", (F.lit(float(weight)) * loss).alias("loss"), F.array(*[F.lit(2.0 * weight) * x for x in d]).alias("grad"))


def one_hot(label: Column, k: int) -> Column:
    return F.array(*[(label == i).cast("int") for i in range(k)])


def softmax_gradient(prob: Column, label: Column, k: int) -> tuple[Column, Column]:
    """g = p - onehot, h = 2 p (1 - p)."""
    p = lambda i: F.get(prob, F.lit(i))
    g = F.array(*[p(i) - (label == i).cast("double") for i in range(k)])
    return g, F.array(*[F.lit(2.0) * p(i) * (F.lit(1.0) - p(i)) for i in range(k)])


def minmax(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), eps: float = 0.0) -> DataFrame:
    """Scale columns to 0..1 over the rows given, or over groups; a column without range, or NaN, becomes 0."""
    made = [f(c).alias(f"{n}_{c}") for c in columns for f, n in ((F.min, "lo"), (F.max, "hi"))]
    stats = df.groupBy(*by).agg(*made) if by else df.agg(*made)
    j = df.join(stats, list(by)) if by else df.join(F.broadcast(stats))
    for c in columns:
        span = F.col(f"hi_{c}") - F.col(f"lo_{c}") + F.lit(eps)
        j = j.withColumn(c, F.when(span == 0, F.lit(0.0)).otherwise(F.nanvl((F.col(c) - F.col(f"lo_{c}")) / F.when(span != 0, span), F.lit(0.0))))
    return j.select(*df.columns)


def normalised_mse(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, mse): mean squared difference of both sides after scaling each to 0..1."""
    x = minmax(a.select("img", "y", "x", *columns), columns)
    y = minmax(b.select("img", "y", "x", *[F.col(c).alias(f"b_{c}") for c in columns]), [f"b_{c}" for c in columns])
    m = x.join(y, ["img", "y", "x"]).agg(*[F.avg((F.col(c) - F.col(f"b_{c}")) ** 2).alias(c) for c in columns])
    return m.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*columns))).alias("feature", "mse"))


def overlay(px: DataFrame, labels: DataFrame, palette: dict[int, tuple[int, int, int]], alpha: float = 1.0) -> DataFrame:
    """(img, y, x, r, g, b): the palette's colour on labelled pixels, the grey value elsewhere."""
    spark = px.sparkSession
    colours = spark.createDataFrame([(k, *v) for k, v in palette.items()], "label int, r_ int, g_ int, b_ int")  # a colour for each class
    j = px.join(labels, ["img", "y", "x"], "left").join(F.broadcast(colours), "label", "left")
    mix = lambda c: F.when(F.col(c).isNull(), F.col("b")).otherwise(F.floor(F.lit(alpha) * F.col(c) + F.lit(1.0 - alpha) * F.col("b"))).cast("int")
    return j.select("img", "y", "x", mix("r_").alias("r"), mix("g_").alias("g"), mix("b_").alias("b"))


#: Colours of the first classes.
PALETTE = {1: (31, 119, 180), 2: (255, 127, 14), 3: (44, 160, 44), 4: (214, 39, 40), 5: (148, 103, 189), 6: (140, 86, 75)}


def inset(px: DataFrame, y0: int, x0: int, h: int, w: int, scale: int, at_y: int, at_x: int) -> DataFrame:
    """Paste an enlarged part of each image over it, its upper left corner at (at_y, at_x)."""
    part = px.filter((F.col("y") >= y0) & (F.col("y") < y0 + h) & (F.col("x") >= x0) & (F.col("x") < x0 + w))
    big = part.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(scale - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(scale - 1))))
    big = big.select("img", ((F.col("y") - y0) * scale + F.col("i") + at_y).alias("y"), ((F.col("x") - x0) * scale + F.col("j") + at_x).alias("x"), F.col("b").alias("b_"))
    return px.join(big, ["img", "y", "x"], "left").select("img", "y", "x", F.coalesce("b_", "b").alias("b"))
