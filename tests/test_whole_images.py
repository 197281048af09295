"""Operators that spread one image over many tasks, held against arrays of whole images."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan

from pixelmill.functions.config import CRFParams, FeatureConfig, TrainingConfig
from pixelmill.operators import crf, models, sam, segmentation
from pixelmill.operators import labels as L
from pixelmill.operators import morphology as M
from pixelmill.operators import preprocess as P
from pixelmill.sources import images as io
from pixelmill.sources import rle, shared, tiff

from . import dense


def frame(spark, planes, kind="double"):
    rows = [(k, y, x, planes[k][y, x].item()) for k in planes for y in range(planes[k].shape[0]) for x in range(planes[k].shape[1])]
    return spark.createDataFrame(rows, f"img string, y int, x int, v {kind}").repartition(3)


def back(df, shapes, col="v"):
    out = {k: np.full(s, np.nan) for k, s in shapes.items()}
    for r in df.collect():
        assert np.isnan(out[r.img][r.y, r.x])
        out[r.img][r.y, r.x] = r[col]
    return out


def images(seed, sizes):
    rng = np.random.default_rng(seed)
    return {f"i{k}": np.round(rng.normal(0, 1, s) * 3, 1 if k % 2 else 9) for k, s in enumerate(sizes)}


def test_denoise(spark):
    planes = images(0, [(70, 91), (33, 40), (5, 7), (1, 9), (2, 2), (128, 64)])
    got = back(P.denoise(frame(spark, planes)), {k: v.shape for k, v in planes.items()})
    for k, v in planes.items():
        assert np.allclose(got[k], dense.haar_denoise(v) if min(v.shape) > 1 else v, atol=1e-12), k
    assert P.denoise(frame(spark, {"a": np.zeros((2, 2))}).filter("y > 9")).count() == 0


def naive_png_rows(kinds, rows, step):
    """Filtered bytes back, one after the other, by the format's definition."""
    out = np.zeros(rows.shape, int)
    for y, kind in enumerate(kinds):
        for i in range(rows.shape[1]):
            a = out[y, i - step] if i >= step else 0
            b = out[y - 1, i] if y else 0
            c = out[y - 1, i - step] if y and i >= step else 0
            near = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            out[y, i] = (int(rows[y, i]) + (0, a, b, (a + b) // 2, near)[kind]) % 256
    return out


@pytest.mark.parametrize("h, w, step", [(1, 1, 1), (1, 30, 3), (30, 1, 4), (17, 40, 3), (40, 17, 1), (12, 12, 6)])
def test_png_filters_mixed_by_row(h, w, step):
    rng = np.random.default_rng(h * w)
    for low in (0, 3):  # all filters, and only those that need the decoded pixel to the left
        kinds, rows = rng.integers(low, 5, h), rng.integers(0, 256, (h, w * step)).astype(np.uint8)
        assert np.array_equal(io._unfilter_rows(kinds, rows, np.zeros(w * step, np.uint8), step), naive_png_rows(kinds, rows, step))
    with pytest.raises(ValueError):
        io._unfilter_rows(np.array([5]), rows[:1], rows[0], step)


def folders(spark):
    base = shared.shared_dir(spark).removeprefix("file:")
    return {p.name for p in Path(base).iterdir() if "-" in p.name and not p.name.startswith(("rdd-", "."))}


def test_scratch_is_removed(spark):
    """What is staged within goes; of nested contexts each removes its own."""
    df, before = spark.range(5), folders(spark)
    with shared.scratch(spark):
        kept = shared.staged(df, "outer")
        with shared.scratch(spark):
            assert shared.staged(df, "inner").count() == 5
            assert len(folders(spark) - before) == 2
        assert kept.count() == 5 and [x.split("-")[0] for x in folders(spark) - before] == ["outer"]
    assert folders(spark) == before
    with pytest.raises(ZeroDivisionError), shared.scratch(spark):
        shared.staged(df, "failed")
        1 / 0
    assert folders(spark) == before


@pytest.mark.parametrize("kind", ["random_forest", "mlp", "xgb"])
def test_fit_leaves_nothing(spark, kind):
    """A model is fitted and applied; training rows, margins and batches are gone, features are the caller's."""
    r = np.random.default_rng(2)
    rows = [("a", y, x, float(v), float(v * v)) for y in range(20) for x in range(20) for v in [r.normal() + (x > 9) * 3]]
    feats = spark.createDataFrame(rows, "img string, y int, x int, f double, g double")
    labels = feats.filter("y % 3 = 0").select("img", "y", "x", F.when(F.col("x") > 9, 2).otherwise(1).alias("label"))
    before = folders(spark)
    model = segmentation.fit(feats, labels, TrainingConfig(classifier=kind), 2)
    out = models.apply(model, feats)
    assert out.count() == 400 and out.filter("seg = cast(x > 9 as int)").count() > 340
    assert folders(spark) == before


def test_median_of_groups(spark):
    rng = np.random.default_rng(1)
    groups = {"even": rng.normal(size=100), "odd": rng.normal(size=101), "one": np.array([4.0]), "two": np.array([1.0, 2.0]), "ties": np.array([1.0] * 50 + [2.0] * 50), "wide": np.concatenate((rng.normal(size=300) * 1e-9, [1e300])), "same": np.full(9, 0.1)}
    df = spark.createDataFrame([(k, float(v)) for k, g in groups.items() for v in g], "k string, v double")
    assert {r.k: r.median for r in P.exact_median(df, "v", ["k"]).collect()} == {k: np.median(g) for k, g in groups.items()}


def test_equalize(spark):
    planes = images(2, [(70, 91), (8, 8), (3, 20), (1, 1), (64, 64), (17, 9)]) | {"flat": np.ones((6, 5))}
    got = back(P.equalize(frame(spark, planes)), {k: v.shape for k, v in planes.items()})
    for k, v in planes.items():
        assert np.allclose(got[k], dense.equalise_adaptive(v), atol=1e-12), k


@pytest.mark.parametrize("grey", [True, False])
def test_field_over_tiles(spark, grey):
    """Tiles of any size give the classes of the whole image, kernels reaching over several tiles."""
    rng = np.random.default_rng(5)
    shape = (61, 47)
    yy, xx = np.mgrid[: shape[0], : shape[1]]
    colour = np.stack([(xx * 4) % 256, (yy * 5) % 200, ((xx + yy) * 3) % 256], -1).astype(int)
    colour = np.repeat(colour[..., :1], 3, 2) if grey else colour
    prob = rng.dirichlet(np.ones(3), shape) + (xx > 18)[..., None] * [0.5, 0, 0]
    prob /= prob.sum(-1, keepdims=True)
    p = CRFParams(n_infer=3, sxy_b=(14.0, 9.0), sxy_g=(2.0, 3.0))
    place = np.stack([yy.ravel(), xx.ravel()], 1).astype(float)
    want = dense.mean_field(-np.log(prob.reshape(-1, 3)), place, colour.reshape(-1, 3).astype(float), p)
    rows = [("a", y, x, prob[y, x].tolist()) for y in range(shape[0]) for x in range(shape[1])]
    probs = spark.createDataFrame(rows, "img string, y int, x int, prob array<double>")
    if grey:
        px = spark.createDataFrame([("a", y, x, int(colour[y, x, 0])) for y in range(shape[0]) for x in range(shape[1])], "img string, y int, x int, b int")
    else:
        px = spark.createDataFrame([("a", y, x, c, int(colour[y, x, c])) for y in range(shape[0]) for x in range(shape[1]) for c in range(3)], "img string, y int, x int, ch int, b int")
    sure = np.sort(want, 1)
    sure = (sure[:, -1] - sure[:, -2] > 1e-3).reshape(shape)
    for tile in (16, 512):
        got = back(crf.refine(probs, px, p, tile), {"a": shape}, "seg")["a"]
        assert (got == want.argmax(1).reshape(shape))[sure].all() and sure.mean() > 0.9


def test_field_messages_are_exact(spark):
    """Sums that a tile reads equal those of the whole image to rounding."""
    rng = np.random.default_rng(6)
    yy, xx = np.mgrid[:40, :40]
    y, x = yy.ravel(), xx.ravel()
    colour = rng.integers(0, 256, (1600, 3)).astype(float)
    p = CRFParams(sxy_b=(11.0, 13.0))
    grid = dense.Grid(np.hstack([np.stack([y, x], 1) / np.array(p.sxy_b), colour / np.array(p.s_rgb)]))
    places = dense.Places(y, x, p.sxy_g)
    values = rng.random((1600, 2))
    tiles, got = {}, {}
    for k in ((a, b) for a in range(3) for b in range(3)):
        at = np.flatnonzero((y // 16 == k[0]) & (x // 16 == k[1]))
        row = {"ty": k[0], "tx": k[1], "h": 40, "w": 40, "keep": 31, "y": y[at].astype("<i4").tobytes(), "x": x[at].astype("<i4").tobytes(), "unary": values[at].tobytes(), "colour": colour[at].tobytes()}
        tiles[k] = at, crf.Tile(row, p, 16)
        for ty, tx, *rest in tiles[k][1].messages(values[at], values[at]):
            got.setdefault((ty, tx), []).append((ty, tx, *rest))
    for k, (at, t) in tiles.items():
        import pyarrow as pa

        narrow, wide = t.received(crf._table(got[k], "a", pa.string(), crf._MESSAGE))
        assert np.allclose(narrow, places(values)[at], rtol=1e-12) and np.allclose(wide, grid(values)[at], rtol=1e-9)


def brute_distances(m):
    h, w = m.shape
    out = np.full((h, w), -1, np.int64)
    ys, xs = np.nonzero(~m)
    if len(ys):
        for y in range(h):
            for x in range(w):
                out[y, x] = ((ys - y) ** 2 + (xs - x) ** 2).min()
    return out


def test_distances_over_pieces(spark):
    """Rows cut in pieces, with dense and single seeds far away, equal all pairs."""
    rng = np.random.default_rng(7)
    planes = {"few": rng.random((9, 70)) < 0.99, "many": rng.random((12, 33)) < 0.5, "none": np.ones((3, 20), bool), "left": np.ones((5, 64), bool), "all": np.zeros((2, 18), bool)}
    planes["left"][4, 0] = False
    df = frame(spark, planes, "boolean").withColumnRenamed("v", "m")
    for columns, rows in ((8, 2), (17, 64), (4096, 64)):
        got = {}
        for r in M.edt_squared(df, columns, rows).collect():
            got[r.img, r.y, r.x] = -1 if r.d2 is None else r.d2
        for k, m in planes.items():
            want = brute_distances(m)
            assert all(got.pop((k, y, x)) == want[y, x] for y in range(m.shape[0]) for x in range(m.shape[1])), (k, columns)
        assert not got


def test_long_row_is_linear():
    x = np.arange(1_000_000)
    zero = np.zeros(len(x), np.int64)
    assert np.array_equal(M.row_distances(np.zeros(1, np.int64), np.array([17]), np.array([4]), zero, x), 4 + (x - 17) ** 2)
    d = M.row_distances(zero, x, (x % 1000) ** 2, zero, x)
    assert d[500] == 500**2 // 2 and (d <= (x % 1000) ** 2).all()


def test_runs_over_pieces(spark):
    rng = np.random.default_rng(8)
    planes = {"a": (rng.random((11, 13)) < 0.3).astype(int), "b": np.zeros((7, 13), int), "c": rng.integers(0, 3, (1, 13))}
    df = frame(spark, planes, "int").withColumnRenamed("v", "label")
    for piece in (1, 5, 13, 1 << 16):
        got = {}
        for r in rle.encode_rle(df, 13, piece).orderBy("img", "run").collect():
            got.setdefault(r.img, []).append((r.run, r.label, r.n))
        for k, a in planes.items():
            flat = a.ravel()
            cut = np.append(np.flatnonzero(np.diff(flat, prepend=-1)), len(flat))
            assert got[k] == [(i, flat[s], e - s) for i, (s, e) in enumerate(zip(cut, cut[1:]))], (k, piece)
    n = spark.createDataFrame([("g", i, i % 7) for i in range(50)] + [("h", 0, 3)], "k string, i long, n long")
    for piece in (1, 4, 100):
        assert all(r.s == sum(j % 7 for j in range(r.i)) for r in rle.running_total(n, ["k"], "i", "n", "s", piece).collect())


def test_custom_functions_see_whole_pixels(spark):
    """Colours arrive together and floats as they are; a pixel has one row."""
    rng = np.random.default_rng(9)
    a = rng.integers(0, 256, (5, 6, 3))
    px = spark.createDataFrame([("a", y, x, c, int(a[y, x, c]), float(a[y, x, c] / 255.0)) for y in range(5) for x in range(6) for c in range(3)], "img string, y int, x int, ch int, b int, v double")
    config = TrainingConfig(feature_config=FeatureConfig(sigmas=(2.0,), mean=False, maximum=False, minimum=False, hessian_filter=False, membrane_projections=False))
    out = segmentation.featurise(px, config, [(lambda image: [image.astype(int).max(-1)], ["top"]), (lambda image, c: [image[..., 1] * c.sigmas[0]], ["green"])])
    rows = out.select("y", "x", "top", "green").collect()
    assert len(rows) == 30 and all(r.top == a[r.y, r.x].max() and r.green == 2 * a[r.y, r.x, 1] for r in rows)
    v = rng.normal(size=(4, 5)) * 10
    px = spark.createDataFrame([("a", y, x, 0, float(v[y, x])) for y in range(4) for x in range(5)], "img string, y int, x int, b int, v double")
    rows = segmentation.featurise(px, config, [(lambda image: [image - 1], ["less"])]).select("y", "x", "less").collect()
    assert len(rows) == 20 and all(r.less == v[r.y, r.x] - 1 for r in rows)


def test_images_are_encoded_once(spark):
    """However many prompts an image has; masks do not depend on how prompts are grouped."""
    sc = spark.sparkContext
    calls = sc.accumulator(0)
    px = spark.createDataFrame([(k, y, x, (7 * y + 3 * x + len(k)) % 50) for k in ("a", "bb", "none") for y in range(8) for x in range(9)], "img string, y int, x int, b int")

    def provider():
        def encoder(image):
            calls.add(1)
            return image * 2.0

        return encoder

    embedded = sam.encode(sam.pack_images(px), provider)
    prompts = spark.createDataFrame([(k, [[float(i % 5), 0.0], [float(i % 5 + 4), 8.0]], [2.0, 3.0], 1 + i % 3, i) for k in ("a", "bb", "gone") for i in range(70)], "img string, coords array<array<float>>, labels array<float>, value long, ord long")

    def decoder():
        def decode(e, coords, labels):
            pixels = np.full((len(coords), 3, *e.shape), -1.0)
            for k, ((x0, _), (x1, _)) in enumerate(coords):
                for m in range(3):
                    pixels[k, m, :, int(x0) : int(x1)] = e[:, int(x0) : int(x1)] - 20 * m
            return pixels, np.array([[0.1, 0.7, 0.7]] * len(coords))

        return decode

    want = None
    for together in (3, 16, 100):
        rows = sorted(map(tuple, sam.prompted_masks(embedded, prompts, decoder, together).collect()))
        assert rows and (want is None or rows == want) and {r[0] for r in rows} == {"a", "bb"} and {r[3] for r in rows} == {0.7}
        want = rows
    assert calls.value == 3
    first = {(r[4], r[5]) for r in want if r[0] == "a" and r[2] == 0}
    assert first == {(y, x) for y in range(8) for x in range(4) if (7 * y + 3 * x + 1) % 50 * 2 > 20}


def test_perceptron_does_not_depend_on_partitions(spark, tmp_path):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(700, 2))
    label = ((x[:, 0] * x[:, 1] > 0) + (np.hypot(*x.T) > 1.6) * 1).astype(int)  # no plane parts these
    df = spark.createDataFrame([("a", i, 0, float(a), float(b) if i % 50 else None, int(k)) for i, ((a, b), k) in enumerate(zip(x, label))], "img string, y int, x int, f double, g double, label int").cache()
    train, held = df.filter("y % 3 > 0"), df.filter("y % 3 = 0")
    make = lambda d: models.get_model("mlp", ["f", "g"], 3, {"hidden_layer_sizes": (32, 16), "max_iter": 30, "seed": 1}).fit(d)
    a, b = make(train.repartition(1)), make(train.repartition(5, "y"))
    assert all(np.array_equal(v, w) for v, w in zip(a.weights, b.weights))
    truth = held.withColumnRenamed("label", "cls")
    assert L.miou(a.predict(held), truth).first()[0] > 0.5
    a.save(spark, f"file://{tmp_path}/m")
    assert models.load_classifier(spark, f"file://{tmp_path}/m").predict_proba(held).select("prob").collect() == a.predict_proba(held).select("prob").collect()
    none = make(train.filter("y < 0"))
    assert none.predict(held).count() == held.count()


def test_application_of_a_model_to_another_image(spark):
    """All refinements run from a model that exists; what they need must be given."""
    rng = np.random.default_rng(12)
    image = lambda k: spark.createDataFrame([(k, y, x, int(np.clip((x > 8) * 120 + rng.normal() * 20 + 60, 0, 255))) for y in range(16) for x in range(18)], "img string, y int, x int, b int").withColumn("v", F.col("b") / 255.0)
    px, other = image("a").cache(), image("b").cache()
    labels = px.select("img", "y", "x", F.when(F.col("y") % 4 == 0, 1 + (F.col("x") > 8).cast("int")).otherwise(0).alias("label"))
    one = FeatureConfig(sigmas=(1.0,), membrane_projections=False)
    config = TrainingConfig(feature_config=one, classifier="linear_regression", modal_filter=True, CRF=True, CRF_params=CRFParams(n_infer=1, sxy_b=(8.0, 8.0)), autocontext=True)
    feats = segmentation.featurise(px, config)
    model = segmentation.fit(feats, labels, config, 2)
    out, second = segmentation.apply(model, feats, config, px, labels)
    assert len(second.features) == len(model.features) + 2
    whole, _ = segmentation.train_and_apply(px, labels, config, 2)
    assert sorted(out.select("y", "x", "seg").collect()) == sorted(whole.select("y", "x", "seg").collect())
    plain = TrainingConfig(feature_config=one, classifier="linear_regression", modal_filter=True)
    seg, same = segmentation.apply(model, segmentation.featurise(other, plain), plain)
    assert same is model and seg.filter((F.col("x") > 8).cast("int") == F.col("seg")).count() > 0.9 * 16 * 18
    for needs in (TrainingConfig(autocontext=True), TrainingConfig(CRF=True)):
        with pytest.raises(ValueError):
            segmentation.apply(model, feats, needs)


@pytest.mark.parametrize("kind", [np.uint8, np.int16, np.uint16, np.float32, np.float64])
def test_tiff_layouts(spark, tmp_path, kind):
    """Strips and tiles, planes, pages, both byte orders and sizes of offsets, differences; shares of a file make the whole."""
    rng = np.random.default_rng(13)
    pages = [(rng.normal(size=s) * 90).astype(kind) for s in ((21, 34, 3), (21, 34), (5, 70))]
    integers = np.dtype(kind).kind != "f"
    for i, how in enumerate(({"rows": 4}, {"tile": (16, 16)}, {"tile": (16, 32), "planar": True, "big": True}, {"rows": 9, "planar": True, "order": ">"}, {"tile": (8, 16), "order": ">", "big": True, "predictor": 2 if integers else 1})):
        (tmp_path / f"a{i}.tif").write_bytes(tiff.encode_pages(pages, **how))
        rows = tiff.read_tiff(spark, f"file://{tmp_path}/a{i}.tif", 700).collect()
        got = {(r.page, r.y, r.x, r.ch): (r.b, r.v) for r in rows}
        assert len(got) == len(rows) == sum(p.size for p in pages)
        for k, p in enumerate(pages):
            for y, x, c in np.ndindex(p.shape if p.ndim == 3 else (*p.shape, 1)):
                value = p[y, x, c] if p.ndim == 3 else p[y, x]
                assert got[k, y, x, c] == (int(value), value / float(np.iinfo(kind).max) if np.dtype(kind).kind == "u" else float(value))
    if kind == np.uint8:
        assert np.array_equal(io.decode_tiff(tiff.encode_pages(pages[:1], rows=4)), pages[0])


def test_tiff_regions_read_only_their_segments(spark, tmp_path):
    rng = np.random.default_rng(14)
    a = rng.integers(0, 256, (512, 640, 3)).astype(np.uint8)
    (tmp_path / "a.tif").write_bytes(tiff.encode_pages([a, a[::-1]], tile=(64, 64), planar=True))
    size = (tmp_path / "a.tif").stat().st_size

    def run(*filters):
        r = tiff.TiffReader({"path": f"file://{tmp_path}", "split_bytes": 1 << 30})
        assert list(r.pushFilters(list(filters))) == list(filters)
        n = sum(b.num_rows for p in r.partitions() for b in r.read(p))
        return r.bytes / size, n

    one = [EqualTo(("page",), 1), EqualTo(("ch",), 2)]
    assert run() == (pytest.approx(1, abs=0.03), 2 * a.size)
    share, n = run(*one, GreaterThanOrEqual(("y",), 70), LessThan(("y",), 120), In(("x",), (3, 60)))
    assert n == 64 * 64 and share < 0.03
    assert run(GreaterThan(("y",), 5000))[1] == 0
    got = tiff.read_tiff(spark, f"file://{tmp_path}", 50_000).filter("page = 1 and ch = 2 and y between 70 and 119 and x in (3, null, 60)")
    assert {(r.y, r.x): r.b for r in got.collect()} == {(y, x): a[511 - y, x, 2] for y in range(70, 120) for x in (3, 60)}
    (tmp_path / "cut.tif").write_bytes((tmp_path / "a.tif").read_bytes()[: size // 2])
    with pytest.raises(Exception, match="cut.tif|struct|early"):
        tiff.read_tiff(spark, f"file://{tmp_path}/cut.tif").count()
    assert tiff.unpack_bits(bytes([2, 1, 2, 3, 254, 9, 0, 7])) == bytes([1, 2, 3, 9, 9, 9, 7])
