"""Labels, morphology, sources and models on small inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelmill.functions.config import ClassInfo, CRFParams
from pixelmill.operators import boost, crf, expert, models, sam
from pixelmill.operators import labels as L
from pixelmill.operators import morphology as M
from pixelmill.operators import preprocess as P
from pixelmill.sources import images, rle

from . import dense


def mask_frame(spark, a, img="a"):
    return spark.createDataFrame([(img, y, x, bool(a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1])], "img string, y int, x int, m boolean")


def flood(a, eight=True):
    h, w = a.shape
    out = np.full(a.shape, -1)
    for y in range(h):
        for x in range(w):
            if a[y, x] and out[y, x] < 0:
                todo, out[y, x] = [(y, x)], y * (1 << 20) + x
                while todo:
                    p, q = todo.pop()
                    for dy in (-1, 0, 1):
                        for dx in (-1, 0, 1):
                            if (eight or not dy or not dx) and 0 <= p + dy < h and 0 <= q + dx < w and a[p + dy, q + dx] and out[p + dy, q + dx] < 0:
                                out[p + dy, q + dx] = out[y, x]
                                todo.append((p + dy, q + dx))
    return out


@pytest.mark.parametrize("connectivity", [4, 8])
def test_components_across_tiles(spark, connectivity):
    a = np.random.default_rng(5).random((37, 29)) < (0.45 if connectivity == 8 else 0.6)
    want = flood(a, connectivity == 8)
    got = {(r.y, r.x): r.lab for r in M.connected_components(mask_frame(spark, a), connectivity=connectivity, tile=8).collect()}
    assert got == {(y, x): want[y, x] for y, x in zip(*np.nonzero(a))}


def test_distance(spark):
    a = np.random.default_rng(6).random((17, 23)) < 0.8
    zeros = np.argwhere(~a)
    for r in M.edt_squared(mask_frame(spark, a)).collect():
        assert r.d2 == ((zeros - [r.y, r.x]) ** 2).sum(1).min()
    full = M.edt_squared(mask_frame(spark, np.ones((3, 3), bool))).collect()
    assert all(r.d2 is None for r in full)


def test_modal_forms_agree(spark):
    a = np.random.default_rng(7).integers(0, 4, (21, 18))
    seg = spark.createDataFrame([("a", y, x, int(a[y, x])) for y in range(21) for x in range(18)], "img string, y int, x int, seg int")
    t = {(r.y, r.x): r.seg for r in M.modal_filter(seg, tile=8).collect()}
    assert t == {(r.y, r.x): r.seg for r in M.modal_by_join(seg).collect()}


def test_objectives_are_zero_on_uniform_masks(spark):
    m = mask_frame(spark, np.ones((4, 5), bool))
    for target in ("minimise", "maximise"):
        assert M.connectivity_objective(m, target).agg(F.sum("loss"), F.sum("grad")).first()[:] == (0.0, 0.0)
    with pytest.raises(ValueError):
        M.connectivity_objective(m, "other")


def test_contiguous_labels(spark):
    df = spark.createDataFrame([("a", 0, i, v) for i, v in enumerate([7, 3, 9, 3])], "img string, y int, x int, label int")
    assert [r.label for r in L.contiguous(df).orderBy("x").collect()] == [1, 0, 2, 0]
    many = spark.range(30).select(F.lit("a").alias("img"), F.lit(0).alias("y"), F.col("id").cast("int").alias("x"), F.col("id").cast("int").alias("label"))
    with pytest.raises(Exception, match="label values"):
        L.contiguous(many).collect()


def test_colour_keys_collide(spark):
    px = spark.createDataFrame([("a", 0, 0, 255, 0, 0), ("a", 0, 1, 0, 1, 0)], "img string, y int, x int, r int, g int, b int")
    assert {r.label for r in L.from_rgb(px).collect()} == {0}


def test_sampling(spark):
    df = spark.range(50).select(F.lit("a").alias("img"), F.col("id").cast("int").alias("y"), F.lit(0).alias("x"))
    assert [r.y for r in L.sample(df, 3, shuffle=False).collect()] == [0, 1, 2]
    assert L.sample(df, 5, seed=1).collect() == L.sample(df, 5, seed=1).collect()
    assert L.sample(df).count() == 50
    with pytest.raises(ValueError):
        L.training_union([], [])


def test_iou(spark):
    pred = spark.createDataFrame([("a", 0, i, s) for i, s in enumerate([0, 0, 1, 2])], "img string, y int, x int, seg int")
    truth = spark.createDataFrame([("a", 0, i, s) for i, s in enumerate([0, 1, 1, 1])], "img string, y int, x int, cls int")
    assert {r.cls: r.iou for r in L.iou_per_class(pred, truth).collect()} == {0: 0.5, 1: 1 / 3}
    assert L.miou(pred, truth).first()[0] == pytest.approx((0.5 + 1 / 3) / 2)


def test_minmax_of_a_constant_is_zero(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert [tuple(r) for r in L.minmax(df, ["a", "b"]).orderBy("a").collect()] == [(0.0, 0.0), (1.0, 0.0)]


def test_image_codecs(spark):
    rng = np.random.default_rng(8)
    grey, colour = rng.integers(0, 256, (9, 7)).astype(np.uint8), rng.integers(0, 256, (5, 6, 3)).astype(np.uint8)
    for a in (grey, colour):
        assert np.array_equal(images.decode_png(images.encode_png(a)), a)
        assert np.array_equal(images.decode_tiff(images.encode_tiff(a)), a)
    with pytest.raises(ValueError):
        images.decode(b"", "a.bmp")


@pytest.mark.parametrize("kind", [1, 2, 3, 4])
def test_png_row_filters(kind):
    rng = np.random.default_rng(kind)
    row, above, step = rng.integers(0, 256, 12).astype(np.uint8), rng.integers(0, 256, 12).astype(np.uint8), 3
    coded = np.zeros(12, np.uint8)
    for i in range(12):
        left = int(row[i - step]) if i >= step else 0
        up, corner = int(above[i]), int(above[i - step]) if i >= step else 0
        p = left + up - corner
        near = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
        coded[i] = (int(row[i]) - {1: left, 2: up, 3: (left + up) // 2, 4: near}[kind]) % 256
    assert np.array_equal(images._unfilter(kind, coded, above, step), row)


@pytest.mark.parametrize("depth", [1, 2, 4, 8])
@pytest.mark.parametrize("interlaced", [0, 1])
def test_png_depths_and_passes(depth, interlaced):
    import struct
    import zlib

    h, w = 13, 11
    a = np.random.default_rng(depth).integers(0, 2**depth, (h, w)).astype(np.uint8)
    body = b""
    for y0, x0, dy, dx in images._PASSES if interlaced else ((0, 0, 1, 1),):
        part = a[y0::dy, x0::dx]
        if part.size:
            bits = np.unpackbits(part[..., None], axis=2)[..., 8 - depth :].reshape(len(part), -1)
            body += b"".join(b"\0" + np.packbits(r).tobytes() for r in bits)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, 0, 0, 0, interlaced)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")
    assert np.array_equal(images.decode_png(data), a * (255 // (2**depth - 1)))


def pack_lzw(data):
    """LZW as TIFF has it, for the test."""
    table, width, out, held = {bytes([i]): i for i in range(256)}, 9, [(256, 9)], b""
    n = 258
    for c in data:
        c = bytes([c])
        if held + c in table:
            held += c
            continue
        out.append((table[held], width))
        table[held + c] = n
        n += 1
        if n >= 4094:
            out.append((256, 12))
            table, n, width = {bytes([i]): i for i in range(256)}, 258, 9
        else:
            width = max(9, (n).bit_length())
        held = c
    out += [(table[held], width), (257, max(9, (n + 1).bit_length()))]
    bits = "".join(f"{v:0{k}b}" for v, k in out)
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def test_packed_tiff():
    import struct

    rng = np.random.default_rng(2)
    for n in (10, 3000, 20_000):
        data = rng.integers(0, 7, n).astype(np.uint8).tobytes()
        assert images.unpack_lzw(pack_lzw(data)) == data
    a = rng.integers(0, 256, (8, 9, 3)).astype(np.uint8)
    diff = a.copy()
    diff[:, 1:] -= a[:, :-1]
    strip = pack_lzw(diff.tobytes())
    tags = [(256, 9), (257, 8), (258, 8), (259, 5), (262, 2), (273, 8), (277, 3), (278, 8), (279, len(strip)), (317, 2)]
    strip += b"\0" * (len(strip) % 2)
    data = b"II*\0" + struct.pack("<I", 8 + len(strip)) + strip + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in tags) + bytes(4)
    assert np.array_equal(images.decode_tiff(data), a)


@pytest.mark.parametrize("kind", ["npy", "npz", "tif"])
def test_stacks_as_arrays(spark, tmp_path, kind):
    rows = [(i, y, x, y * 0.25 + x, float(y)) for i in ("a", "b") for y in range(3) for x in range(4)]
    df = spark.createDataFrame(rows, "img string, y int, x int, f double, g double")
    images.save_features(df, f"file://{tmp_path}/s", kind)
    back = images.load_features(spark, f"file://{tmp_path}/s/*.{kind}", ["f", "g"])
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    assert images.load_features(spark, f"file://{tmp_path}/s/*.{kind}").columns == ["img", "y", "x", "f0", "f1"]
    lab = spark.createDataFrame([("a", 0, 1, 2), ("b", 2, 2, 1), ("b", 0, 0, 0)], "img string, y int, x int, label int")
    union = L.training_union([f"file://{tmp_path}/s/a.{kind}", f"file://{tmp_path}/s/b.{kind}"], [lab, lab])
    assert sorted((r.img, r.f0, r.label) for r in union.collect()) == [("a", 1.0, 1), ("b", 2.5, 0)]
    with pytest.raises(ValueError):
        images.save_features(df, "x", "pt")


def test_arrays_and_files(spark, tmp_path):
    a = np.arange(12, dtype=np.uint8).reshape(3, 4)
    np.save(tmp_path / "a.npy", a)
    np.savez(tmp_path / "b.npz", a)
    rows = images.read_images(spark, f"file://{tmp_path}/*.np*").collect()
    assert len(rows) == 24 and all(r.b == a[r.y, r.x] for r in rows)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        images.read_images(spark, f"file://{tmp_path}/none").count()


def test_rle(spark):
    lines = spark.createDataFrame([("a", "2 3 0 2 1 0 5 3 2 9")], "img string, line string")
    got = {(r.y, r.x): r.label for r in rle.decode_rle(lines).collect()}
    assert got == {(0, 0): 0, (0, 1): 0, (0, 2): 5, (1, 0): 5, (1, 1): 5, (1, 2): 2}
    assert rle.decode_rle(lines, bias=1).filter("label = 1").count() == 1


def training(spark, n=400):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(n):
        k = int(rng.integers(0, 3))
        rows.append(("a", i // 20, i % 20, float(k + rng.normal() * 0.2), float(rng.normal()), k))
    return spark.createDataFrame(rows, "img string, y int, x int, f double, g double, label int")


@pytest.mark.parametrize("name,params", [("random_forest", {"n_estimators": 10, "max_depth": 5}), ("logistic_regression", {}), ("linear_regression", {}), ("mlp", {"hidden_layer_sizes": (8,), "max_iter": 25}), ("xgb", {"n_estimators": 5})])
def test_classifiers(spark, name, params):
    data = training(spark).cache()
    model = models.train(models.get_model(name, ["f", "g"], 3, params), data, balanced=name != "mlp")
    out = model.predict(data).filter("seg = label").count()
    assert out / data.count() > (0.6 if name == "linear_regression" else 0.85)
    assert name.split("_")[0][:2] and "classes" in repr(model)


def test_two_classes_and_unknown_names(spark):
    data = training(spark).filter("label < 2").cache()
    model = models.train(models.get_model("linear_regression", ["f", "g"], 2), data)
    assert model.predict(data).filter("seg = label").count() / data.count() > 0.9
    with pytest.raises(ValueError):
        models.get_model("other", [], 2)


def test_expert_needs_and_follows_a_target(spark):
    data = training(spark).cache()
    with pytest.raises(ValueError):
        expert.ExpertClassifier(["f", "g"], [ClassInfo("a", 0)], 3)
    m = expert.ExpertClassifier(["f", "g"], [ClassInfo("a", 0, desired_volume_fraction=0.33)], 3).fit(data, data.filter("y < 10"), 3)
    assert m.predict(data).filter("seg = label").count() / data.count() > 0.8


@pytest.mark.parametrize("name,params", [("random_forest", {"n_estimators": 5, "max_depth": 4}), ("logistic_regression", {}), ("linear_regression", {"alpha": 2.0}), ("mlp", {"hidden_layer_sizes": [4], "max_iter": 4}), ("xgb", {"n_estimators": 3})])
def test_models_come_back(spark, tmp_path, name, params):
    data = training(spark).cache()
    model = models.train(models.get_model(name, ["f", "g"], 3, params), data)
    model.save(spark, f"file://{tmp_path}/m")
    again = models.load_classifier(spark, f"file://{tmp_path}/m")
    assert type(again) is type(model) and again.params == model.params
    assert again.predict_proba(data).select("prob").collect() == model.predict_proba(data).select("prob").collect()


@pytest.mark.parametrize("kind", ["float", "double"])
def test_forests_answer_as_spark_does(spark, kind):
    from pyspark.ml.functions import vector_to_array

    data = training(spark, 900).select("img", "y", "x", F.col("f").cast(kind), F.col("g").cast(kind), "label").cache()
    model = models.get_model("random_forest", ["f", "g"], 3, {"n_estimators": 12, "max_depth": None}).fit(data)
    got = {(r.y, r.x): r.prob for r in model.predict_proba(data).collect()}
    for r in model.model.transform(data).select("y", "x", vector_to_array("probability").alias("p")).collect():
        assert np.allclose(got[r.y, r.x], r.p, atol=1e-12)


def test_bins_are_those_of_double_precision():
    from pixelmill.functions.forest import bins_of

    rng = np.random.default_rng(1)
    edges = np.sort(np.append(rng.normal(size=20), [0.1, np.float64(np.float32(0.3))]))
    x = np.concatenate([rng.normal(size=500), edges, [np.nan, np.inf, -np.inf]])
    assert np.array_equal(bins_of(x, edges), np.searchsorted(edges, x, "left"))
    y = np.concatenate([x.astype(np.float32), np.nextafter(edges.astype(np.float32), np.float32(9))])
    assert np.array_equal(bins_of(y, edges), np.searchsorted(edges, y.astype(float), "left"))


def test_expert_models_come_back(spark, tmp_path):
    data = training(spark).cache()
    m = expert.ExpertClassifier(["f", "g"], [ClassInfo("a", 0, desired_volume_fraction=0.33), ClassInfo("b", 1)], 3, depth=2).fit(data, data.filter("y < 10"), 2)
    m.save(spark, f"file://{tmp_path}/m")
    again = models.load_classifier(spark, f"file://{tmp_path}/m")
    assert again.fractions == m.fractions and again.predict(data).select("seg").collect() == m.predict(data).select("seg").collect()


def test_rows_dealt_otherwise_grow_the_same_trees(spark):
    """Edges, trees and leaves to the last bit, over rounds that write margins anew."""
    data = training(spark).withColumn("w", F.col("f") * F.col("f") + 0.37).cache()
    states = [boost.Booster(["f", "g"], 3, depth=4).fit(data.repartition(n, F.rand(n)), 10, "w").state() for n in (1, 8)]
    assert states[0] == states[1] and len(states[0]["rounds"]) == 10


def test_trees_are_those_of_all_sums(spark):
    """A tree grown from left nodes' sums equals one from the sums of every node."""
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(600, 3)), rng.integers(0, 2, 600)
    x[rng.random(600) < 0.2, 1] = np.nan
    y[np.isnan(x[:, 1])] = 1  # missing values tell the class
    df = spark.createDataFrame([(*(None if np.isnan(v) else float(v) for v in r), int(k)) for r, k in zip(x, y)], "a double, b double, c double, label int")
    b = boost.Booster(["a", "b", "c"], 2, depth=3).fit(df, 1)
    bins = np.stack([np.where(np.isnan(c), boost.MISSING, np.searchsorted(e, c)) for c, e in zip(x.T, b.edges)]).astype(np.uint8)
    for c, t in enumerate(b.rounds[0]):
        g, h = boost.rounded(0.5 - (y == c)), np.full(600, 0.5)
        for n in range(4):
            mine = t.node(bins, 2) == n
            best = 0.0
            for f in range(3):
                for cut in range(32):
                    for side in (False, True):
                        left = mine & ((bins[f] <= cut) | (side & (bins[f] == boost.MISSING)))
                        score = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
                        best = max(best, score(left) + score(mine & ~left) - score(mine))
            left = mine & (t.node(bins, 3) == 2 * n)
            got = sum(g[m].sum() ** 2 / (h[m].sum() + 1) for m in (left, mine & ~left)) - g[mine].sum() ** 2 / (h[mine].sum() + 1)
            assert abs(got - best) < 1e-9
            assert np.allclose(t.value[2 * n : 2 * n + 2], [-g[m].sum() / (h[m].sum() + 1) for m in (left, mine & ~left)])
    root = b.rounds[0][1]
    assert root.feature[0] == 1 and b.predict_proba(df).filter("b is null and prob[1] <= 0.5").count() == 0


def test_edges_are_weighted_quantiles(spark):
    rng = np.random.default_rng(3)
    x, w = np.concatenate([rng.normal(size=900) * 10.0 ** rng.integers(-5, 5, 900), [0.0, -0.0]]), rng.random(902)
    d = rng.integers(0, 3, 902).astype(float)
    df = spark.createDataFrame([(float(a), float(b), None, float(c)) for a, b, c in zip(x, d, w)], "x double, d double, n double, w double").repartition(3)
    e = boost.quantile_edges(df, ["x", "d", "n"], "w", 16)
    assert e.shape == (3, 15) and not e[2].any()
    for values, edges in ((x, e[0]), (d, e[1])):
        order = np.argsort(values)
        share = np.cumsum(w[order]) / w.sum()
        for i, edge in enumerate(edges, 1):
            exact = values[order][np.searchsorted(share, i / 16)]
            assert exact <= edge <= exact + abs(exact) * 2.0**-14 + 1e-30
    assert boost.value_of(boost.keys_of(np.array([-3.5, -0.0, 0.0, 1e-30, 7.0]))).tolist() == [-3.5, 0.0, 0.0, float(np.float32(1e-30)), 7.0]


def test_tree_nodes():
    from pixelmill.operators.boost import Tree

    rng = np.random.default_rng(3)
    for depth in (1, 2, 5, 8):
        t = Tree(depth)
        t.feature, t.cut = rng.integers(0, 4, 2**depth - 1), rng.integers(0, 32, 2**depth - 1)
        bins = rng.integers(0, 32, (4, 200)).astype(np.uint8)
        for level in range(depth + 1):
            want = []
            for row in bins.T:
                k = 0
                for d in range(level):
                    node = 2**d - 1 + k
                    k = 2 * k + int(row[t.feature[node]] > t.cut[node])
                want.append(k)
            assert t.node(bins, level).tolist() == want


def test_field_smooths(spark):
    a = np.zeros((12, 12), int)
    a[:, 6:] = 1
    noisy = a.copy()
    noisy[3, 3] = 1
    rows = [("a", y, x, int(noisy[y, x]), int(a[y, x] * 200)) for y in range(12) for x in range(12)]
    df = spark.createDataFrame(rows, "img string, y int, x int, seg int, b int")
    out = {(r.y, r.x): r.seg for r in crf.from_labels(df.drop("b"), df.drop("seg"), 2, params=CRFParams(n_infer=5)).collect()}
    assert out[3, 3] == 0 and all(out[y, x] == a[y, x] for y in range(12) for x in range(12))


def exact_field(unary, place, colour, p):
    """The mean field with every pair of pixels."""
    kernels = []
    for f, weight in ((place / np.array(p.sxy_g), p.compat_g), (np.hstack([place / np.array(p.sxy_b), colour / np.array(p.s_rgb)]), p.compat_b)):
        k = np.exp(-0.5 * ((f[:, None] - f[None]) ** 2).sum(-1))
        n = 1 / np.sqrt(k.sum(1))
        kernels.append(weight * n[:, None] * k * n[None])
    q = dense._soft(-unary)
    for _ in range(p.n_infer):
        q = dense._soft(sum(k @ q for k in kernels) - unary)
    return q


@pytest.mark.parametrize("grey", [True, False])
def test_field_is_near_the_exact_one(grey):
    rng = np.random.default_rng(0)
    yy, xx = np.mgrid[:32, :36]
    colour = np.stack([(xx * 4) % 256, (yy * 5) % 200, ((xx + yy) * 3) % 256], -1).reshape(-1, 3) + rng.normal(size=(32 * 36, 3)) * 5
    colour = np.repeat(colour[:, :1], 3, 1) if grey else colour
    place = np.stack([yy.ravel(), xx.ravel()], 1).astype(float)
    prob = rng.dirichlet(np.ones(3), len(place)) + (xx.ravel() > 18)[:, None] * [0.5, 0, 0]
    unary = -np.log(prob / prob.sum(1, keepdims=True))
    p = CRFParams(n_infer=5, sxy_b=(10.0, 10.0))
    got, want = dense.mean_field(unary, place, colour, p), exact_field(unary, place, colour, p)
    assert (got.argmax(1) == want.argmax(1)).mean() > 0.97 and np.abs(got - want).mean() < 0.02


def test_field_of_colours(spark):
    """Noise goes where the colours agree, and an edge that only one channel shows stays."""
    a = np.zeros((12, 12), int)
    a[:, 6:] = 1
    noisy = a.copy()
    noisy[3, 3] = 1
    rows = [("a", y, x, ch, int(a[y, x] * 200) if ch == 2 else 90) for y in range(12) for x in range(12) for ch in range(3)]
    px = spark.createDataFrame(rows, "img string, y int, x int, ch int, b int")
    seg = spark.createDataFrame([("a", y, x, int(noisy[y, x])) for y in range(12) for x in range(12)], "img string, y int, x int, seg int")
    out = {(r.y, r.x): r.seg for r in crf.from_labels(seg, px, 2, params=CRFParams(n_infer=5)).collect()}
    assert all(out[y, x] == a[y, x] for y in range(12) for x in range(12))


def test_regions_and_prompts(spark):
    a = np.zeros((10, 10), int)
    a[2:6, 2:6] = 1
    a[3, 3] = 0
    a[8, 8] = 1
    seg = spark.createDataFrame([("a", y, x, int(a[y, x])) for y in range(10) for x in range(10)], "img string, y int, x int, seg int")
    out = {(r.y, r.x): r.seg for r in sam.refine_regions(seg, default=3).collect()}
    assert out[3, 3] == 1 and out[8, 8] == 1 and out[0, 0] == 0
    assert {(r.y, r.x): r.seg for r in sam.refine_regions(seg).collect()} == {(r.y, r.x): r.seg for r in seg.collect()}
    p = sam.box_prompt(spark.createDataFrame([(1, 10, 20, 30, 40)], "id int, x int, y int, w int, h int")).first()
    assert p.coords == [[10.0, 20.0], [40.0, 60.0]] and p.labels == [2.0, 3.0]


def test_masks_of_a_model(spark):
    """The path through a model: image and prompts in, masks pasted over the regions; the model is a stand-in."""
    a = np.zeros((10, 10), int)
    a[2:6, 2:6] = 1
    seg = spark.createDataFrame([("a", y, x, int(a[y, x])) for y in range(10) for x in range(10)], "img string, y int, x int, seg int")

    def provider():
        def model(image, coords, labels):
            (x0, y0), (x1, y1) = coords
            assert labels == [2.0, 3.0]
            scores = np.full((10, 10), -1.0)
            scores[int(y0) : int(y1), int(x0) : int(x1)] = image[0]
            return scores

        return model

    def masks(regions):
        boxes = regions.select(F.concat_ws("/", "img", "seg", "lab").alias("id"), F.col("minc").alias("x"), F.col("minr").alias("y"), (F.col("maxc") - F.col("minc") + 1).alias("w"), (F.col("maxr") - F.col("minr")).alias("h"), "img", "seg", "lab")
        asked = sam.box_prompt(boxes).join(boxes.select("id", "img", "seg", "lab"), "id").select("img", F.lit(b"\x05").alias("image"), "coords", "labels", F.col("seg").cast("long").alias("value"), F.col("lab").alias("ord"))
        return sam.model_masks(asked, provider)

    out = {(r.y, r.x): r.seg for r in sam.refine_regions(seg, {1: 3}, 1000, masks).collect()}
    assert all(out[y, x] == int(2 <= y < 6 and 2 <= x < 7) for y in range(10) for x in range(10))


def test_preprocessing():
    rng = np.random.default_rng(10)
    clean = np.zeros((64, 64))
    clean[:, 32:] = 1
    noisy = clean + rng.normal(size=clean.shape) * 0.1
    assert ((dense.haar_denoise(noisy) - clean) ** 2).mean() < 0.5 * ((noisy - clean) ** 2).mean()
    assert np.allclose(dense.haar_denoise(clean[:5, :7]), clean[:5, :7])
    flat = dense.equalise_adaptive(np.linspace(0.4, 0.6, 64 * 64).reshape(64, 64))
    assert flat.min() >= 0 and flat.max() <= 1 and flat.std() > 0.1
    assert (dense.equalise_adaptive(np.ones((4, 4))) == 0).all()


def test_denoise_of_a_large_image_is_that_of_the_whole(spark):
    v = np.random.default_rng(4).normal(0, 1, (1100, 24)) * np.linspace(1, 9, 1100)[:, None]
    rows = [("a", y, x, float(v[y, x])) for y in range(1100) for x in range(24)]
    got = np.zeros(v.shape)
    for r in P.denoise(spark.createDataFrame(rows, "img string, y int, x int, v double")).collect():
        got[r.y, r.x] = r.v
    assert np.allclose(got, dense.haar_denoise(v))


def test_configurations_in_any_store(spark, tmp_path):
    from pixelmill.functions import config as C

    c = C.TrainingConfig(feature_config=C.FeatureConfig(sigmas=(1.0, 3.0), median=True), CRF=True, class_infos=(C.ClassInfo("a", 0, connectivity_target="minimise"),))
    C.save(c, f"file://{tmp_path}/one", spark)
    assert C.load(f"file://{tmp_path}/one", spark) == c
    C.save(c, f"{tmp_path}/two.json")
    assert C.load(f"{tmp_path}/two.json") == C.load(f"file://{tmp_path}/two.json", spark) == c


def test_large_forests_are_applied_by_spark(spark, monkeypatch):
    data = training(spark).cache()
    model = models.get_model("random_forest", ["f", "g"], 3, {"n_estimators": 5, "max_depth": 4}).fit(data)
    want = {(r.y, r.x): r.prob for r in models.apply(model, data).collect()}
    monkeypatch.setattr(models.RandomForest, "NODES", 3)
    got = {(r.y, r.x): r.prob for r in models.apply(model, data).collect()}
    assert want.keys() == got.keys() and all(np.allclose(want[k], got[k]) for k in want)
