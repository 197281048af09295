"""Every operator as a query on the driver tables, with its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import filters as K
from ..functions.config import ClassInfo, CRFParams, FeatureConfig, TrainingConfig, feature_names, hessian_names
from ..operators import crf, expert, models, sam, segmentation
from ..operators import features as X
from ..operators import labels as L
from ..operators import morphology as M
from ..operators import preprocess as P
from ..operators import rasters as R
from ..operators import stencil as S
from ..sources import images, rle, tiff
from ..sources.shared import checkpoint, new_path
from . import sql as Q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PX = ("img", "y", "x")


def add(name: str, oracle: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return put


emb, evt = R.embedding_raster, R.event_raster


def prob_of(px: DataFrame) -> DataFrame:
    """Probabilities of three classes by value."""
    p = lambda e: e / F.lit(383.0)
    return px.withColumn("prob", F.array(p(F.col("b")), p(255 - F.col("b")), p(F.lit(128))))


def seg_of(px: DataFrame) -> DataFrame:
    return prob_of(px).select(*PX, L.argmax(F.col("prob")).alias("seg"))


def evt_seg(spark, sf_dir) -> DataFrame:
    """Classes 0, 1, 2 of the event raster: below 3 events, below 6, above."""
    return evt(spark, sf_dir).select(*PX, F.least(F.floor(F.col("b") / 3), F.lit(2)).cast("int").alias("seg"))


_EVT_SEG = "seg AS (SELECT img, y, x, least(b // 3, 2)::INT AS seg FROM px)"

# pixels and casts

add("px_cast", Q.query(Q.EMB, select="SELECT * FROM px"))(emb)


@add("px_maxnorm", Q.query(Q.EMB, select="SELECT img, y, x, v / max(v) OVER (PARTITION BY img) AS vn FROM px"))
def px_maxnorm(spark, sf_dir):
    px = emb(spark, sf_dir)
    top = px.groupBy("img").agg(F.max("v").alias("top"))
    return px.join(top, "img").select(*PX, (F.col("v") / F.col("top")).alias("vn"))


_POWER = "pow(2.0::DOUBLE, floor(log2(v)) - 10.0::DOUBLE)"


@add("cast_f16", Q.query(Q.EMB, select=f"SELECT img, y, x, (CASE WHEN v = 0 THEN 0.0::DOUBLE ELSE round_even(v / {_POWER}, 0) * {_POWER} END)::FLOAT AS v FROM px"))
def cast_f16(spark, sf_dir):
    return X.cast_features(emb(spark, sf_dir).select(*PX, "v"), ["v"], "f16")


_RGB = FeatureConfig(cast_to="f64", sigmas=(), difference_of_gaussians=False, membrane_projections=False)
_RGB_COLUMNS = ["v", "e", "h0", "h1", "h2", "h3", "h4"]


@add("rgb_features", Q.query(Q.EMB, *Q.derived("px", "v", "z", "e", _RGB_COLUMNS[2:]), select="SELECT img, y, x, " + ", ".join(f"{c} AS {n}_c{k}" for k in range(3) for c, n in zip(_RGB_COLUMNS, feature_names(_RGB))) + " FROM z"))
def rgb_features(spark, sf_dir):
    return X.channel_features(R.to_rgb(emb(spark, sf_dir)), _RGB)


_G1 = K.gaussian_taps(1.0)


@add("concat_feats", Q.query(Q.EMB, *Q.blur("px", "v", _G1, "g", "gaussian_blur"), *Q.derived("g", "gaussian_blur", "z", "sobel_filter", ["h0", "h1"]), select="SELECT img, y, x, gaussian_blur, sobel_filter FROM z"))
def concat_feats(spark, sf_dir):
    px = emb(spark, sf_dir)
    return X.concat_features(X.gaussian_blur(px, 1.0), X.sobel_filter(px, 1.0))


@add("to_rgb", Q.query(Q.EMB, select="SELECT img, y, x, b, c.ch::INT AS ch FROM px, range(3) c(ch)"))
def to_rgb(spark, sf_dir):
    return R.to_rgb(emb(spark, sf_dir).select(*PX, "b"))


@add("feature_names", Q.query(Q.EVT, select="SELECT i, name, n FROM (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(feature_names())) + ") t(i, name), (SELECT count(*) AS n FROM px)"))
def feature_names_(spark, sf_dir):
    """The columns of the default stack in order, and for how many pixels of the events' images each has a value."""
    stack = X.multiscale_features(evt(spark, sf_dir), FeatureConfig())
    names = [c for c in stack.columns if c not in PX]
    counts = stack.agg(*[F.count(c).alias(c) for c in names])
    return counts.select(F.posexplode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in names])).alias("i", "f")).select("i", "f.name", "f.n")


@add("minmax_scale", Q.query(Q.EMB, select="SELECT img, y, x, (v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER () + 0.0::DOUBLE) AS v FROM px"))
def minmax_scale(spark, sf_dir):
    return L.minmax(emb(spark, sf_dir).select(*PX, "v"), ["v"])


@add("minmax_channels", Q.query(Q.EVT, select=f"SELECT img, y, x, (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w + {Q.d(1e-8)}) AS v FROM px WINDOW w AS (PARTITION BY img)"))
def minmax_channels(spark, sf_dir):
    return L.minmax(evt(spark, sf_dir).select(*PX, "v"), ["v"], ["img"], 1e-8)


@add("onnx_image", Q.query(Q.EMB, select="SELECT img, c.ch::INT AS ch, y, x, CASE WHEN max(b) OVER (PARTITION BY img) > 1 THEN b / 255.0::DOUBLE ELSE b::DOUBLE END AS value FROM px, range(3) c(ch)"))
def onnx_image(spark, sf_dir):
    return sam.to_model_image(emb(spark, sf_dir))


@add("point_prompt", "SELECT vec_id AS id, vec_id::FLOAT AS x, label::FLOAT AS y, 1.0::FLOAT AS label FROM embeddings")
def point_prompt(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("x"), F.col("label").alias("y"), F.lit(1).alias("label"))
    return sam.point_prompt(e).select("id", F.col("coords")[0][0].alias("x"), F.col("coords")[0][1].alias("y"), F.col("labels")[0].alias("label"))


@add("box_prompt", "SELECT vec_id AS id, vec_id::FLOAT AS x0, label::FLOAT AS y0, (vec_id + 30)::FLOAT AS x1, (label + 40)::FLOAT AS y1, 2.0::FLOAT AS l0, 3.0::FLOAT AS l1 FROM embeddings")
def box_prompt(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("x"), F.col("label").alias("y"), F.lit(30).alias("w"), F.lit(40).alias("h"))
    c, k = F.col("coords"), F.col("labels")
    return sam.box_prompt(e).select("id", c[0][0].alias("x0"), c[0][1].alias("y0"), c[1][0].alias("x1"), c[1][1].alias("y1"), k[0].alias("l0"), k[1].alias("l1"))


_P = [f"prob[{i + 1}]" for i in range(3)]


@add("softmax_grad", Q.query(Q.EMB, Q.CLS, Q.PROB, select="SELECT img, y, x, " + ", ".join(f"{p} - (cls = {i})::INT::DOUBLE AS g{i}, 2.0::DOUBLE * {p} * (1.0::DOUBLE - {p}) AS h{i}" for i, p in enumerate(_P)) + " FROM prob JOIN classes USING (img, y, x)"))
def softmax_grad(spark, sf_dir):
    j = prob_of(emb(spark, sf_dir)).join(R.embedding_classes(spark, sf_dir), list(PX))
    g, h = L.softmax_gradient(F.col("prob"), F.col("cls"), 3)
    return j.select(*PX, g.alias("g"), h.alias("h")).select(*PX, *[F.col(c)[i].alias(f"{c}{i}") for i in range(3) for c in "gh"])


@add("onehot", Q.query(Q.CLS, select="SELECT img, y, x, (cls = 0)::INT AS c0, (cls = 1)::INT AS c1, (cls = 2)::INT AS c2 FROM classes"))
def onehot(spark, sf_dir):
    return R.embedding_classes(spark, sf_dir).select(*PX, L.one_hot(F.col("cls"), 3).alias("o")).select(*PX, *[F.col("o")[i].alias(f"c{i}") for i in range(3)])


@add("resize_nearest", Q.query(Q.CLS, "size AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM classes)", "grid AS (SELECT a.y::INT AS y, c.x::INT AS x, floor((a.y + 0.5) * h / 300.0)::INT AS sy, floor((c.x + 0.5) * w / 96.0)::INT AS sx FROM size, range(300) a(y), range(96) c(x))", select="SELECT img, g.y, g.x, cls AS label FROM grid g JOIN classes s ON s.y = g.sy AND s.x = g.sx"))
def resize_nearest(spark, sf_dir):
    return L.resize_nearest(R.embedding_classes(spark, sf_dir).withColumnRenamed("cls", "label"), 300, 96)


@add("merge_classes", Q.query(Q.CLS, Q.LABELS, select="SELECT img, y, x, CASE WHEN label = 3 THEN 1 ELSE label END AS label FROM labels"))
def merge_classes(spark, sf_dir):
    return L.merge_classes(R.sparse_labels(R.embedding_classes(spark, sf_dir)), {3: 1})


# preprocessing

add("pre_blur", Q.query(Q.EMB, *Q.blur("px", "v", K.normal_taps(1.0, 4), "g", "g1"), select="SELECT img, y, x, g1 AS v FROM g"))(lambda spark, sf_dir: P.preprocess(emb(spark, sf_dir), ("blur",)))
_ROUNDED = lambda source: f"SELECT img, y, x, round(v, 9) AS v FROM {source}"
rounded = lambda df: df.select(*PX, F.round("v", 9).alias("v"))
add("pre_denoise", Q.query(Q.EMB, *Q.denoised("px", 3), select=_ROUNDED("clean")))(lambda spark, sf_dir: rounded(P.preprocess(emb(spark, sf_dir), ("blur", "denoise"))))
add("pre_equalize", Q.query(Q.EMB, *Q.equalized(), select=_ROUNDED("flat")))(lambda spark, sf_dir: rounded(P.preprocess(emb(spark, sf_dir), ("equalize",))))

# neighbourhoods


_FOOT = "px p JOIN px q ON q.img = p.img AND (q.y - p.y) * (q.y - p.y) + (q.x - p.x) * (q.x - p.x) < 25"


@add("footprint", Q.query(Q.EVT, select=f"SELECT p.img, p.y, p.x, count(*) AS cells, max(q.y - p.y)::INT AS down, max(q.x - p.x)::INT AS across FROM {_FOOT} GROUP BY p.img, p.y, p.x"))
def footprint(spark, sf_dir):
    """How many cells of the disc of radius 5 lie in the image, and how far they reach, for each pixel."""
    px = evt(spark, sf_dir).select(*PX, F.col("y").alias("b"))
    down = S.over_disc(px, K.disc(5), [F.count("*").alias("cells"), F.max(F.col("n") - F.col("y")).cast("int").alias("down")])
    across = S.over_disc(px.withColumn("b", F.col("x")), K.disc(5), [F.max(F.col("n") - F.col("x")).cast("int").alias("across")])
    return down.join(across, list(PX))


add("gaussian_blur", Q.query(Q.EMB, *Q.blur("px", "v", _G1, "g", "gaussian_blur"), select="SELECT img, y, x, gaussian_blur FROM g"))(lambda spark, sf_dir: X.gaussian_blur(emb(spark, sf_dir), 1.0))
add("gaussian_blur_wide", Q.query(Q.EMB, *Q.blur("px", "v", K.gaussian_taps(16.0), "g", "gaussian_blur"), select="SELECT img, y, x, gaussian_blur FROM g"))(lambda spark, sf_dir: X.gaussian_blur(emb(spark, sf_dir), 16.0))
_H = hessian_names(True)
_D2 = [Q.EMB, *Q.blur("px", "v", K.gaussian_taps(2.0), "g", "g2"), *Q.derived("g", "g2", "z", "sobel_filter", _H)]
add("sobel_filter", Q.query(*_D2, select="SELECT img, y, x, sobel_filter FROM z"))(lambda spark, sf_dir: X.sobel_filter(emb(spark, sf_dir), 2.0))
add("hessian_filter", Q.query(*_D2, select=f"SELECT img, y, x, {', '.join(_H)} FROM z"))(lambda spark, sf_dir: X.hessian_filter(emb(spark, sf_dir), 2.0))
_LAP = "4.0::DOUBLE * {c} - {a} - {b} - {e} - {f}"


def _lap(col: str, mode: str) -> str:
    return _LAP.format(c=col, a=Q.near(col, -1, "y", mode), b=Q.near(col, 1, "y", mode), e=Q.near(col, -1, "x", mode), f=Q.near(col, 1, "x", mode))


add("laplacian", Q.query(Q.EMB, *Q.blur("px", "v", K.gaussian_taps(2.0), "g", "g2"), select=f"SELECT img, y, x, {_lap('g2', 'nearest')} AS laplacian FROM g"))(lambda spark, sf_dir: X.laplacian(emb(spark, sf_dir), 2.0))
for _kind in ("mean", "minimum", "maximum", "median"):
    add(f"rank_{_kind}", Q.rank(4, _kind))(lambda spark, sf_dir, kind=_kind: X.rank_filter(emb(spark, sf_dir), 4.0, kind))
add("rank_mean_join", Q.rank(2, "mean"))(lambda spark, sf_dir: X.rank_by_join(emb(spark, sf_dir), 2.0, "mean"))
add("structure_tensor", Q.structure(1.0))(lambda spark, sf_dir: X.structure_tensor(emb(spark, sf_dir), 1.0))
add("bilateral", Q.bilateral((5, 10), (50, 100)))(lambda spark, sf_dir: X.bilateral(emb(spark, sf_dir)))
add("membrane_projections", Q.query(Q.EMB, *Q.membrane(15), select="SELECT * FROM membrane"))(lambda spark, sf_dir: X.membrane_projections(emb(spark, sf_dir)))

_S48 = [Q.EMB, *Q.blur("px", "v", K.gaussian_taps(4.0, 0.4), "a", "g4"), *Q.blur("a", "v", K.gaussian_taps(8.0, 0.4), "c", "g8"), *Q.blur("c", "v", K.gaussian_taps(16.0, 0.4), "e", "g16")]
add("difference_of_gaussians", Q.query(*_S48, select="SELECT img, y, x, g4 - g8 AS dog_s8_s4, g4 - g16 AS dog_s16_s4, g8 - g16 AS dog_s16_s8 FROM e"))(
    lambda spark, sf_dir: X.difference_of_gaussians(emb(spark, sf_dir), (4.0, 8.0, 16.0), 0.4)
)

_ONE = FeatureConfig(cast_to="f64", sigmas=(4.0,), add_zero_scale_features=False, difference_of_gaussians=False, membrane_projections=False)
add("features_sigma", Q.query(Q.EMB, *Q.blur("px", "v", K.gaussian_taps(4.0, 0.4), "g", "g4"), *Q.derived("g", "g4", "z", "e", ["h0", "h1", "h2", "h3", "h4"]), select="SELECT img, y, x, " + ", ".join(f"{c} AS {n}" for c, n in zip(["g4", "e", "h0", "h1", "h2", "h3", "h4"], feature_names(_ONE))) + " FROM z"))(
    lambda spark, sf_dir: X.multiscale_features(emb(spark, sf_dir), _ONE)
)
add("features_zero_scale", Q.query(Q.EMB, *Q.derived("px", "v", "z", "e", _RGB_COLUMNS[2:]), select="SELECT img, y, x, " + ", ".join(f"{c} AS {n}" for c, n in zip(_RGB_COLUMNS, feature_names(_RGB))) + " FROM z"))(
    lambda spark, sf_dir: X.multiscale_features(emb(spark, sf_dir), _RGB)
)
_EXACT = FeatureConfig(cast_to="f64")
add("multiscale_features", Q.multiscale())(lambda spark, sf_dir: X.multiscale_features(emb(spark, sf_dir), _EXACT))

# formulas of the accelerated variant


def tile(kernel, out: str, halo: int, value: str = "b", rounded: bool = False):
    def run(spark, sf_dir):
        df = S.by_tile(emb(spark, sf_dir), kernel, out, halo, value)
        return near_zero(df) if rounded else df

    return run


def near_zero(df: DataFrame) -> DataFrame:
    """Features rounded as the SQL rounds them where the order of its sums is free."""
    return df.select(*PX, *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in df.columns if c not in PX])


_W4, _W8 = (K.normal_taps(0.4 * s, 2 * int(0.4 * 16.0)) for s in (4.0, 8.0))
add("gpu_gaussian", Q.query(Q.EMB, *Q.wide("px", "v", _W4, "g", "t"), select=f"SELECT img, y, x, {Q.near_zero('t')} AS gaussian_blur FROM g"))(
    tile(lambda v: [K.wide_gaussian(v, 4.0, 0.4, 16.0)], "gaussian_blur double", 13, "v", True)
)
add("gpu_sobel_hessian", Q.gpu_sobel())(tile(lambda v: [K.sobel_edges(v), *K.sobel_hessian(v)], "sobel_filter double, " + ", ".join(f"{n} double" for n in _H), 2, "v"))
add("gpu_square_pools", Q.square(2))(tile(lambda b: [K.square(b, 2, "mean"), K.square(b, 2, "minimum"), K.square(b, 2, "maximum")], "mean double, minimum long, maximum long", 2))
add("gpu_median", Q.square_median(2))(tile(lambda b: [K.square_median(b, 2)], "median long", 2))
add("gpu_laplacian", Q.query(Q.EMB, select=f"SELECT img, y, x, {_lap('v', 'mirror1')} AS laplacian FROM px"))(tile(lambda v: [K.laplacian(v, "mirror")], "laplacian double", 1, "v"))
add("gpu_bilateral", Q.soft_bilateral(X.GPU_RADII, X.GPU_WIDTHS))(tile(lambda v: [K.soft_bilateral(v, r, w / 255.0) for r in X.GPU_RADII for w in X.GPU_WIDTHS], ", ".join(f"bilateral_r{r}_v{w:g} double" for r in X.GPU_RADII for w in X.GPU_WIDTHS), 5, "v", True))
add("gpu_difference_of_gaussians", Q.query(Q.EMB, *Q.wide("px", "v", _W4, "g", "t"), *Q.wide("px", "v", _W8, "k", "u"), select=f"SELECT img, y, x, {Q.near_zero('t - u')} AS dog_s8_s4 FROM g JOIN k USING (img, y, x)"))(
    tile(lambda v: [K.wide_gaussian(v, 4.0, 0.4, 16.0) - K.wide_gaussian(v, 8.0, 0.4, 16.0)], "dog_s8_s4 double", 13, "v", True)
)
add("gpu_membrane", Q.query(Q.EMB, *Q.membrane(X.GPU_PATCH, "mirror", 1, False), select="SELECT * FROM membrane"))(
    tile(lambda b: K.membrane(b, X.GPU_PATCH, 1, "mirror", 1, False), ", ".join(f"membrane_{m} double" for m in ("mean", "max", "min", "sum", "std", "median")), 8)
)
_GPU = FeatureConfig(cast_to="f64", use_gpu=True)
add("gpu_multiscale_features", Q.gpu_multiscale(_GPU, _GPU.membrane_patch_size))(lambda spark, sf_dir: near_zero(X.multiscale_features(emb(spark, sf_dir), _GPU)))

# whole images: preprocessed, coloured, of floats

_PRE = TrainingConfig(feature_config=FeatureConfig(cast_to="f64", sigmas=(2.0,), difference_of_gaussians=False, membrane_projections=False, add_weka_sigma_multiplier=False), preprocessing=("blur",))
_PRE_SQL = [*Q.blur("px", "v", K.normal_taps(1.0, 4), "g", "g1"), *Q.derived("g", "g1", "z", "e0", [f"h0_{i}" for i in range(5)]), *Q.blur("z", "g1", K.gaussian_taps(2.0), "k", "g2"), *Q.derived("k", "g2", "f", "e1", [f"h1_{i}" for i in range(5)])]
_PRE_COLUMNS = ["g1", "e0", *[f"h0_{i}" for i in range(5)], "g2", "e1", *[f"h1_{i}" for i in range(5)]]
add("featurise_preprocessed", Q.query(Q.EMB, *_PRE_SQL, select="SELECT img, y, x, " + ", ".join(f"{c} AS {n}" for c, n in zip(_PRE_COLUMNS, feature_names(_PRE.feature_config), strict=True)) + " FROM f"))(
    lambda spark, sf_dir: segmentation.featurise(emb(spark, sf_dir), _PRE)
)


def colour(spark, sf_dir) -> DataFrame:
    """A colour image: the raster, its inverse, and a third channel of its own."""
    b = F.col("b")
    px = emb(spark, sf_dir).select(*PX, F.posexplode(F.array(b, 255 - b, F.pmod(b * 7, F.lit(256)))).alias("ch", "b"))
    return R.with_value(px)


def _colour_sql() -> str:
    ctes, cols = [Q.EMB], []
    for k, e in enumerate(("b", "255 - b", "(b * 7) % 256")):
        ctes.append(f"p{k} AS (SELECT img, y, x, ({e}) / 255.0::DOUBLE AS v FROM px)")
        ctes += Q.derived(f"p{k}", "v", f"z{k}", "e", _RGB_COLUMNS[2:])
        cols += [f"z{k}.{c} AS {n}_c{k}" for c, n in zip(_RGB_COLUMNS, feature_names(_RGB))]
    return Q.query(*ctes, select=f"SELECT z0.img, z0.y, z0.x, {', '.join(cols)} FROM z0 JOIN z1 ON z1.img = z0.img AND z1.y = z0.y AND z1.x = z0.x JOIN z2 ON z2.img = z0.img AND z2.y = z0.y AND z2.x = z0.x")


add("featurise_rgb", _colour_sql())(lambda spark, sf_dir: segmentation.featurise(colour(spark, sf_dir), TrainingConfig(feature_config=_RGB)))
add("scan_float", Q.query(Q.EVT, select="SELECT img, y, x, v FROM px"))(
    lambda spark, sf_dir: images.pixels_of(images.image_files(evt(spark, sf_dir), "v", "tif")).select(F.regexp_extract("img", r"([^/]+)\.\w+$", 1).alias("img"), "y", "x", "v")
)
add("featurise_float", Q.query(Q.EVT, *Q.derived("px", "v", "z", "e", _RGB_COLUMNS[2:]), select="SELECT img, y, x, " + ", ".join(f"{c} AS {n}" for c, n in zip(_RGB_COLUMNS, feature_names(_RGB))) + " FROM z"))(
    lambda spark, sf_dir: segmentation.featurise(QUERIES["scan_float"](spark, sf_dir).withColumn("b", F.col("v").cast("int")), TrainingConfig(feature_config=_RGB))
)

# labels, training sets, metrics


def labelled(spark, sf_dir, every: int = 5) -> DataFrame:
    return R.sparse_labels(R.embedding_classes(spark, sf_dir), every)


_TRAIN = "train AS (SELECT img, y, x, b, v, label - 1 AS label FROM px JOIN labels USING (img, y, x) WHERE label <> 0)"
add("training_pixels", Q.query(Q.EMB, Q.CLS, Q.LABELS, _TRAIN, select="SELECT * FROM train"))(lambda spark, sf_dir: L.training_pixels(emb(spark, sf_dir), labelled(spark, sf_dir)))
add("training_union", Q.query(Q.EMB, Q.CLS, Q.LABELS, _TRAIN, select="SELECT * FROM train UNION ALL SELECT img, y, x, b, v, cls AS label FROM px JOIN classes USING (img, y, x) WHERE y % 7 = 0"))(
    lambda spark, sf_dir: L.training_union([emb(spark, sf_dir)] * 2, [labelled(spark, sf_dir), labelled(spark, sf_dir, 7)])
)
add("sample_head", Q.query(Q.EMB, Q.CLS, Q.LABELS, _TRAIN, select="SELECT * FROM train ORDER BY img, y, x LIMIT 500"))(
    lambda spark, sf_dir: L.sample(L.training_pixels(emb(spark, sf_dir), labelled(spark, sf_dir)), 500, shuffle=False)
)
add("sample_shuffle", Q.query(Q.EMB, Q.CLS, Q.LABELS, _TRAIN, select="SELECT * FROM train ORDER BY md5('3 ' || img || ' ' || y || ' ' || x), img, y, x LIMIT 500"))(lambda spark, sf_dir: L.sample(L.training_pixels(emb(spark, sf_dir), labelled(spark, sf_dir)), 500, seed=3))
add("argmax_segment", Q.query(Q.EMB, Q.PROB, Q.SEG, select="SELECT * FROM seg"))(lambda spark, sf_dir: seg_of(emb(spark, sf_dir)))
_IOU = "iou AS (SELECT c.cls, sum((s.seg = c.cls)::INT)::BIGINT / (count(*) + (SELECT count(*) FROM seg t WHERE t.seg = c.cls) - sum((s.seg = c.cls)::INT))::DOUBLE AS iou FROM seg s JOIN classes c USING (img, y, x) GROUP BY c.cls)"
add("iou_per_class", Q.query(Q.EMB, Q.CLS, Q.PROB, Q.SEG, _IOU, select="SELECT * FROM iou"))(lambda spark, sf_dir: L.iou_per_class(seg_of(emb(spark, sf_dir)), R.embedding_classes(spark, sf_dir)))
add("miou", Q.query(Q.EMB, Q.CLS, Q.PROB, Q.SEG, _IOU, select="SELECT round(avg(iou), 9) AS miou FROM iou"))(
    lambda spark, sf_dir: L.miou(seg_of(emb(spark, sf_dir)), R.embedding_classes(spark, sf_dir)).select(F.round("miou", 9).alias("miou"))
)


@add("labels_contiguous", Q.query(Q.EMB, select="SELECT img, y, x, (dense_rank() OVER (PARTITION BY img ORDER BY b // 16) - 1)::INT AS label FROM px"))
def labels_contiguous(spark, sf_dir):
    return L.contiguous(emb(spark, sf_dir).select(*PX, (F.floor(F.col("b") / 16) * 7).alias("label"))).select(*PX, "label")


@add("labels_rgb", Q.query(Q.EMB, select="SELECT img, y, x, (dense_rank() OVER (PARTITION BY img ORDER BY (b // 64) * 64 + 255 * ((b // 32) * 8) + 65025 * (x % 2)) - 1)::INT AS label FROM px"))
def labels_rgb(spark, sf_dir):
    b = F.col("b")
    px = emb(spark, sf_dir).select(*PX, (F.floor(b / 64) * 64).alias("r"), (F.floor(b / 32) * 8).alias("g"), (F.col("x") % 2).alias("b"))
    return L.from_rgb(px).select(*PX, "label")


_GREY = "(label + {o}) * (255 // (max(label) OVER (PARTITION BY img) + {o}))"
add("seg_rescale_grey", Q.query(Q.EMB, Q.PROB, Q.SEG, select=f"SELECT img, y, x, {_GREY.format(o=1).replace('label', 'seg')}::INT AS grey FROM seg"))(
    lambda spark, sf_dir: L.to_grey(seg_of(emb(spark, sf_dir)), "seg").select(*PX, "grey")
)
add("labels_rescale_grey", Q.query(Q.CLS, Q.LABELS, select=f"SELECT img, y, x, {_GREY.format(o=0)}::INT AS grey FROM labels"))(
    lambda spark, sf_dir: L.to_grey(labelled(spark, sf_dir), "label", 0).select(*PX, "grey")
)
add("class_weights", Q.query(Q.EMB, Q.CLS, Q.LABELS, _TRAIN, select="SELECT label, count(*) AS n, sum(count(*)) OVER ()::BIGINT / (count(*) OVER () * count(*))::DOUBLE AS weight FROM train GROUP BY label"))(
    lambda spark, sf_dir: L.class_weights(L.training_pixels(emb(spark, sf_dir), labelled(spark, sf_dir)))
)
add("volume_fraction", Q.query(Q.EVT, _EVT_SEG, select="SELECT img, seg, count(*) / sum(count(*)) OVER (PARTITION BY img)::DOUBLE AS fraction FROM seg GROUP BY img, seg"))(lambda spark, sf_dir: L.volume_fraction(evt_seg(spark, sf_dir)))
_VF = (0.4, -1.0, 0.3)
_VF_SQL = ", ".join(f"avg((seg = {i})::INT::DOUBLE) - {Q.d(t)} AS d{i}" if t > 0 else f"0.0::DOUBLE AS d{i}" for i, t in enumerate(_VF))


@add("vf_gradient", Q.query(Q.EMB, Q.PROB, Q.SEG, f"f AS (SELECT img, {_VF_SQL} FROM seg GROUP BY img)", select="SELECT img, round(d0 * d0 + d1 * d1 + d2 * d2, 9) AS loss, round(2 * d0, 9) AS g0, round(2 * d1, 9) AS g1, round(2 * d2, 9) AS g2 FROM f"))
def vf_gradient(spark, sf_dir):
    g = L.volume_fraction_gradient(prob_of(emb(spark, sf_dir)), _VF)
    return g.select("img", F.round("loss", 9).alias("loss"), *[F.round(F.col("grad")[i], 9).alias(f"g{i}") for i in range(3)])


@add("norm_mse", Q.query(Q.EMB, *Q.blur("px", "v", _G1, "g", "g1"), "n AS (SELECT (v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) AS p, (g1 - min(g1) OVER ()) / (max(g1) OVER () - min(g1) OVER ()) AS q FROM g)", select="SELECT 'v' AS feature, round(avg((p - q) * (p - q)), 9) AS mse FROM n"))
def norm_mse(spark, sf_dir):
    px = emb(spark, sf_dir)
    return L.normalised_mse(px, X.gaussian_blur(px, 1.0).withColumnRenamed("gaussian_blur", "v"), ["v"]).select("feature", F.round("mse", 9).alias("mse"))


_PAL = ", ".join(f"({k}, {r}, {g}, {b})" for k, (r, g, b) in L.PALETTE.items())
add("overlay", Q.query(Q.EMB, Q.CLS, Q.LABELS, f"pal(label, pr, pg, pb) AS (VALUES {_PAL})", select="SELECT img, y, x, coalesce(pr, b)::INT AS r, coalesce(pg, b)::INT AS g, coalesce(pb, b)::INT AS b FROM px JOIN labels USING (img, y, x) LEFT JOIN pal USING (label)"))(
    lambda spark, sf_dir: L.overlay(emb(spark, sf_dir), labelled(spark, sf_dir), L.PALETTE)
)
add("inset_zoom", Q.query(Q.EMB, select="SELECT p.img, p.y, p.x, coalesce(q.b, p.b) AS b FROM px p LEFT JOIN px q ON p.img = q.img AND p.y >= 20 AND p.y < 44 AND p.x >= 30 AND p.x < 54 AND q.y = 5 + (p.y - 20) // 3 AND q.x = 6 + (p.x - 30) // 3"))(
    lambda spark, sf_dir: L.inset(emb(spark, sf_dir), 5, 6, 8, 8, 3, 20, 30)
)

# morphology

_COMP = Q.components("on_")
_ON = "on_ AS (SELECT * FROM mask WHERE m)"
add("connected_components", Q.query(Q.EVT, Q.MASK, _ON, *_COMP, select="SELECT * FROM comp", recursive=True))(lambda spark, sf_dir: M.connected_components(R.event_mask(spark, sf_dir)))
_REG = "count(*) AS area, min(y) AS minr, min(x) AS minc, max(y) + 1 AS maxr, max(x) + 1 AS maxc"
add("region_props", Q.query(Q.EVT, Q.MASK, _ON, *_COMP, select=f"SELECT img, lab, {_REG} FROM comp GROUP BY img, lab", recursive=True))(lambda spark, sf_dir: M.regions(M.connected_components(R.event_mask(spark, sf_dir))))
add("edt", Q.query(Q.EVT, Q.MASK, Q.edt(), select="SELECT * FROM edt"))(lambda spark, sf_dir: M.edt_squared(R.event_mask(spark, sf_dir)))
add("uniform_check", Q.query(Q.EVT, Q.MASK, select="SELECT img, bool_and(m) OR NOT bool_or(m) AS uniform FROM mask GROUP BY img"))(lambda spark, sf_dir: M.uniform(R.event_mask(spark, sf_dir)))
_ROUND = "SELECT img, y, x, round(loss, 9) AS loss, round(grad, 9) AS grad FROM obj"
for _target in ("minimise", "maximise"):
    add(f"conn_objective_{_target}", Q.query(Q.EVT, Q.MASK, *Q.objective(_target), select=_ROUND, recursive=True))(
        lambda spark, sf_dir, target=_target: M.connectivity_objective(R.event_mask(spark, sf_dir), target).select(*PX, F.round("loss", 9).alias("loss"), F.round("grad", 9).alias("grad"))
    )


@add("conn_gradient", Q.query(Q.EVT, _EVT_SEG, "mask AS (SELECT img, y, x, seg = 2 AS m FROM seg)", *Q.objective("minimise"), select="SELECT img, y, x, round(0.0::DOUBLE - grad, 9) AS g0, round(0.0::DOUBLE - grad, 9) AS g1, round(grad, 9) AS g2 FROM obj", recursive=True))
def conn_gradient(spark, sf_dir):
    g = M.connectivity_gradient(evt_seg(spark, sf_dir), {2: "minimise"}, 3)
    return g.select(*PX, *[F.round(F.col("grad")[i], 9).alias(f"g{i}") for i in range(3)])


_SEG_COMP = [Q.EVT, _EVT_SEG, "on_ AS (SELECT * FROM seg WHERE seg > 0)", *Q.components("on_", "seg"), f"cand AS (SELECT img, seg, lab, {_REG} FROM comp GROUP BY img, seg, lab HAVING count(*) > CASE WHEN seg = 2 THEN 3 ELSE 8 END)"]
add("sam_candidates", Q.query(*_SEG_COMP, select="SELECT * FROM cand", recursive=True))(lambda spark, sf_dir: M.candidate_regions(evt_seg(spark, sf_dir), {2: 3}, 8))
_PASTE = "masks AS (SELECT c.img, s.y, s.x, c.seg AS value, row_number() OVER (PARTITION BY c.img, s.y, s.x ORDER BY c.seg DESC, c.lab DESC) AS k FROM cand c JOIN seg s ON s.img = c.img AND s.y >= c.minr AND s.y < c.maxr AND s.x >= c.minc AND s.x < c.maxc)"
add("sam_postproc_bbox", Q.query(*_SEG_COMP, _PASTE, select="SELECT s.img, s.y, s.x, coalesce(m.value, s.seg) AS seg FROM seg s LEFT JOIN masks m ON m.img = s.img AND m.y = s.y AND m.x = s.x AND m.k = 1", recursive=True))(
    lambda spark, sf_dir: sam.refine_regions(evt_seg(spark, sf_dir), {2: 3}, 8)
)


@add("mask_paste", Q.query(Q.EVT, _EVT_SEG, select="SELECT img, y, x, CASE WHEN y < 10 AND x < 12 THEN 5 WHEN y < 20 AND x < 6 THEN 4 ELSE seg END AS seg FROM seg"))
def mask_paste(spark, sf_dir):
    s = evt_seg(spark, sf_dir)
    a = s.filter("y < 20 and x < 6").select(*PX, F.lit(4).alias("value"), F.lit(1).alias("ord"))
    b = s.filter("y < 10 and x < 12").select(*PX, F.lit(5).alias("value"), F.lit(2).alias("ord"))
    return M.paste_masks(s, a.unionByName(b))


_MODAL = [
    Q.EMB, Q.offsets(K.disc(5, True)), Q.spots(), "c AS (SELECT p.img, p.y, p.x, (q.b // 16)::INT AS seg, count(*) AS n FROM spots p JOIN px q ON q.img = p.img AND q.y = p.qy AND q.x = p.qx GROUP BY ALL)",
    "r AS (SELECT *, row_number() OVER (PARTITION BY img, y, x ORDER BY n DESC, seg) AS k FROM c)",
]
add("modal_filter", Q.query(*_MODAL, select="SELECT img, y, x, seg FROM r WHERE k = 1"))(lambda spark, sf_dir: M.modal_filter(emb(spark, sf_dir).select(*PX, F.floor(F.col("b") / 16).cast("int").alias("seg"))))

# sources and sinks

_EVT_PX = Q.query(Q.EVT, select="SELECT img, y, x, b FROM px")


def _read_back(px: DataFrame) -> DataFrame:
    return px.select(F.regexp_extract("img", r"([^/]+)\.\w+$", 1).alias("img"), "y", "x", "b")


add("scan_png", _EVT_PX)(lambda spark, sf_dir: _read_back(images.pixels_of(images.image_files(evt(spark, sf_dir), "b", "png"))))
add("scan_tiff", _EVT_PX)(lambda spark, sf_dir: _read_back(images.pixels_of(images.image_files(evt(spark, sf_dir), "b", "tif"))))


@add("scan_image", _EVT_PX)
def scan_image(spark, sf_dir):
    path = new_path(spark, "images")
    images.write_images(evt(spark, sf_dir), path)
    return _read_back(images.read_images(spark, path))


@add("featurestack_roundtrip", Q.query(Q.EMB, *Q.blur("px", "v", _G1, "g", "gaussian_blur"), select="SELECT img, y, x, gaussian_blur FROM g"))
def featurestack_roundtrip(spark, sf_dir):
    path = new_path(spark, "features")
    images.save_features(X.gaussian_blur(emb(spark, sf_dir), 1.0), path)
    return images.load_features(spark, path).select(*PX, "gaussian_blur")


@add("featurestack_arrays", Q.query(Q.EMB, *Q.blur("px", "v", _G1, "g", "gaussian_blur"), select="SELECT img::VARCHAR AS img, y, x, gaussian_blur, v AS value FROM g"))
def featurestack_arrays(spark, sf_dir):
    path = new_path(spark, "arrays")
    px = emb(spark, sf_dir)
    images.save_features(X.concat_features(X.gaussian_blur(px, 1.0), px.select(*PX, F.col("v").alias("value"))), path, "npy")
    return images.load_features(spark, f"{path}/*.npy", ["gaussian_blur", "value"])


@add("rle_decode", Q.query(Q.EMB, select="SELECT img::VARCHAR AS img, y, x, (b // 64)::INT AS label FROM px"))
def rle_decode(spark, sf_dir):
    px = emb(spark, sf_dir).select(F.col("img").cast("string").alias("img"), "y", "x", F.floor(F.col("b") / 64).cast("int").alias("label"))
    size = R.extent(px)
    runs = rle.encode_rle(px.join(size, "img").select("img", "y", "x", "label"), 64).groupBy("img").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "label", "n"))), lambda r: F.concat_ws(" ", r["label"], r["n"])), " ").alias("runs"))
    return rle.decode_rle(runs.join(size, "img").select("img", F.concat_ws(" ", "h", "w", "runs").alias("line")))


@add("scan_tiff_region", Q.query(Q.EMB, select="SELECT p.page::INT AS page, y, x, (b + p.page) % 256 AS b FROM px, range(2) p(page) WHERE y >= 20 AND y < 90 AND x > 40"))
def scan_tiff_region(spark, sf_dir):
    """A region of both pages of a tiled file with offsets of 64 bits, of which only the tiles it touches are read."""
    path = new_path(spark, "tiles")
    images.write_images(emb(spark, sf_dir), path, kind="tif", encoder=lambda a: tiff.encode_pages([(a + k).astype(np.uint8) for k in range(2)], tile=(16, 32), big=True))
    return tiff.read_tiff(spark, path, 4096).filter("y >= 20 and y < 90 and x > 40").select("page", "y", "x", "b")


# models


def intensity_classes(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pixels with four features, classes by blurred value, sparse labels of these)."""
    px = emb(spark, sf_dir)
    f = S.blur(S.blur(px, "v", _G1, "g1"), "v", K.gaussian_taps(3.0), "g3")
    f = checkpoint(S.edges(f, "v", "e").select(*PX, "b", "v", "g1", "g3", "e"))
    g = F.col("g3")
    truth = f.select(*PX, F.when(g < 0.49, 0).when(g < 0.51, 1).otherwise(2).alias("cls"))
    return f, truth, R.sparse_labels(truth)


FEATURES = ["v", "g1", "g3", "e"]


def segment(name: str, **params):
    def run(spark, sf_dir):
        f, _, labels = intensity_classes(spark, sf_dir)
        model = models.train(models.get_model(name, FEATURES, 3, params), L.training_pixels(f, labels))
        return models.apply(model, f).select(*PX, "seg")

    return run


add("rf_segment")(segment("random_forest", n_estimators=20, max_depth=8, seed=1))
add("logistic_segment")(segment("logistic_regression"))
add("ridge_segment")(segment("linear_regression"))
add("mlp_segment")(segment("mlp", hidden_layer_sizes=(16,), max_iter=20, seed=1))
add("gbt_segment")(segment("xgb", n_estimators=5))


@add("model_roundtrip")
def model_roundtrip(spark, sf_dir):
    f, _, labels = intensity_classes(spark, sf_dir)
    model = models.train(models.get_model("logistic_regression", FEATURES, 3), L.training_pixels(f, labels))
    path = new_path(spark, "model")
    model.save(spark, path)
    return models.apply(models.load_classifier(spark, path), f).select(*PX, "seg")


_TRAINING = TrainingConfig(classifier_params={"n_estimators": 20, "max_depth": 8, "seed": 1}, modal_filter=True)


@add("train_and_apply")
def train_and_apply(spark, sf_dir):
    _, _, labels = intensity_classes(spark, sf_dir)
    px = emb(spark, sf_dir)
    out, _ = segmentation.train_and_apply(px, labels, _TRAINING, 3)
    return out.select(*PX, "seg")


@add("autocontext")
def autocontext(spark, sf_dir):
    _, _, labels = intensity_classes(spark, sf_dir)
    config = TrainingConfig(feature_config=_ONE, classifier="logistic_regression", classifier_params={}, autocontext=True, autocontext_type="ilastik")
    out, _ = segmentation.train_and_apply(emb(spark, sf_dir), labels, config, 3)
    return out.select(*PX, "seg")


@add("expertseg")
def expertseg(spark, sf_dir):
    f, _, labels = intensity_classes(spark, sf_dir)
    infos = (ClassInfo("low", 0, desired_volume_fraction=0.4), ClassInfo("high", 2))
    model = expert.ExpertClassifier(FEATURES, infos, 3).fit(f, L.training_pixels(f, labels), 4)
    return model.predict(f).select(*PX, "seg")


def evt_prob(spark, sf_dir) -> DataFrame:
    s = evt_seg(spark, sf_dir)
    return s.select(*PX, F.array(*[F.when(F.col("seg") == i, F.lit(0.6)).otherwise(F.lit(0.2)) for i in range(3)]).alias("prob"))


add("crf_refine")(lambda spark, sf_dir: crf.refine(evt_prob(spark, sf_dir), evt(spark, sf_dir), CRFParams(n_infer=5)))
add("crf_labels")(lambda spark, sf_dir: crf.from_labels(evt_seg(spark, sf_dir), evt(spark, sf_dir), 3, params=CRFParams(n_infer=5)))
def _box_decoder():
    """Two masks for a box: pixels above its mean, and the others; the larger one is better."""

    def decode(image, coords, labels):
        pixels, scores = np.full((len(coords), 2, *image.shape), -1.0), np.zeros((len(coords), 2))
        for k, ((x0, y0), (x1, y1)) in enumerate(coords):
            box = (slice(int(y0), int(y1)), slice(int(x0), int(x1)))
            above = image[box].astype(int) * image[box].size > int(image[box].sum())
            pixels[(k, 0, *box)], pixels[(k, 1, *box)] = np.where(above, 1, -1), np.where(above, -1, 1)
            scores[k] = above.sum(), (~above).sum()
        return pixels, scores

    return decode


_BOXES = "WHERE b.y >= q.k % 4 * 7 AND b.y < q.k % 4 * 7 + 10 AND b.x >= q.k // 4 * 6 AND b.x < q.k // 4 * 6 + 6"


@add(
    "sam_encoded",
    Q.query(
        Q.EVT, "images AS (SELECT DISTINCT img FROM px)", f"boxed AS (SELECT b.img, q.k AS ord, y, x, b.b FROM px b, range(16) q(k) {_BOXES})",
        "sides AS (SELECT *, b * count(*) OVER (PARTITION BY img, ord) > sum(b) OVER (PARTITION BY img, ord) AS above FROM boxed)",
        "sizes AS (SELECT *, count(*) FILTER (above) OVER (PARTITION BY img, ord) AS n1, count(*) FILTER (NOT above) OVER (PARTITION BY img, ord) AS n0 FROM sides)",
        select="SELECT img, 1 + ord % 2 AS value, ord, greatest(n0, n1)::DOUBLE AS score, y, x FROM sizes WHERE above = (n1 >= n0)",
    ),
)
def sam_encoded(spark, sf_dir):
    """Sixteen boxes for each image of events, which is encoded once."""
    px = evt(spark, sf_dir)
    embedded = sam.encode(sam.pack_images(px), lambda: lambda image: image)
    k = F.col("ord")
    boxes = embedded.select("img", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))).alias("ord"))
    corner = lambda x, y: F.array(x.cast("float"), y.cast("float"))
    x, y = F.floor(k / 4) * 6, k % 4 * 7
    prompts = boxes.select("img", F.array(corner(x, y), corner(x + 6, y + 10)).alias("coords"), F.array(F.lit(2.0), F.lit(3.0)).alias("labels"), (1 + k % 2).alias("value"), "ord")
    return sam.prompted_masks(embedded, prompts, _box_decoder)


add("crf_embedding")(lambda spark, sf_dir: crf.refine(prob_of(emb(spark, sf_dir)), emb(spark, sf_dir), CRFParams(n_infer=2)))


@add("custom_feature_rgb", Q.query(Q.EMB, select="SELECT img, y, x, (b + 255 - b + b)::DOUBLE AS total, (255 - b)::DOUBLE AS second, b * 2.0::DOUBLE AS scaled FROM px"))
def custom_feature_rgb(spark, sf_dir):
    px = R.to_rgb(emb(spark, sf_dir)).withColumn("b", F.when(F.col("ch") == 1, 255 - F.col("b")).otherwise(F.col("b")))
    fn = lambda image, config: [image.astype(int).sum(-1), image[..., 1], image[..., 2] * float(config.sigmas[1])]
    return X.custom_features(px, fn, ["total", "second", "scaled"], halo=0, config=FeatureConfig(sigmas=(1.0, 2.0)))


add("custom_feature", Q.query(Q.EMB, select="SELECT img, y, x, b * 2.0::DOUBLE AS twice, (255 - b)::DOUBLE AS inverse FROM px"))(
    lambda spark, sf_dir: X.custom_features(emb(spark, sf_dir), lambda b: [b * 2.0, 255 - b], ["twice", "inverse"], halo=0)
)
