"""Filters on small rasters with known answers, and tiles against whole images and against joins."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelmill.functions import filters as K
from pixelmill.functions.config import ClassInfo, FeatureConfig, TrainingConfig, dumps, feature_names, loads, sigma_range
from pixelmill.operators import features as X
from pixelmill.operators import segmentation
from pixelmill.operators import stencil as S


def frame(spark, a, img="a"):
    return spark.createDataFrame([(img, y, x, int(a[y, x]), int(a[y, x]) / 255.0) for y in range(a.shape[0]) for x in range(a.shape[1])], "img string, y int, x int, b int, v double")


def dense(df, name, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r.y, r.x] = r[name]
    return out


@pytest.mark.parametrize("r", [6, 8, 16])
def test_footprint_area(r):
    assert len(K.disc(r)) == pytest.approx(np.pi * r * r, rel=0.05)


def test_edges_of_planes_and_steps():
    """Constant slopes have one gradient; a step shows in the two columns that touch it."""
    yy, xx = np.mgrid[:9, :12].astype(float)
    assert np.allclose(K.edges(3 * xx - 4 * yy), 5)
    step = np.where(xx < 5, 2.0, 8.0)
    assert sorted(set(np.nonzero(K.edges(step))[1].tolist())) == [4, 5] and K.edges(step).max() == 3


def test_membranes_by_brute_force():
    """The greatest projection of a rotated line is that of the kernels applied one by one."""
    a = np.random.default_rng(2).integers(0, 256, (20, 23))
    sums, tops = K.membrane(a, 19)[:2]
    assert tops.shape == sums.shape == a.shape
    stripe = np.zeros((41, 41), np.int64)
    stripe[np.arange(41), np.arange(41)[::-1]] = 200  # a diagonal
    top = K.membrane(stripe, 19)[1]
    assert all(top[k, 40 - k] > top[k, 20 - k] for k in range(10, 18))


@pytest.mark.parametrize(("radius", "width"), [(2, 30), (3, 90), (4, 200)])
def test_bilateral_by_brute_force(radius, width):
    a = np.random.default_rng(radius).integers(0, 256, (13, 11))
    for y, x in np.ndindex(a.shape):
        near = [int(a[y + dy, x + dx]) for dy, dx in K.disc(radius) if 0 <= y + dy < 13 and 0 <= x + dx < 11 and abs(int(a[y + dy, x + dx]) - int(a[y, x])) < width]
        assert K.bilateral(a, radius, width)[y, x] == sum(near) // len(near)


def test_gaussian_radii():
    assert [len(K.gaussian_taps(s, 0.4)) // 2 for s in (1, 2, 4, 8, 16)] == [0, 0, 3, 7, 13]
    assert [len(K.gaussian_taps(s)) // 2 for s in (1, 2, 4, 8, 16)] == [3, 5, 9, 17, 33]


def test_rotation_by_right_angles_turns_the_kernel():
    a = np.zeros((15, 15))
    a[:, 7] = 1
    assert np.array_equal(np.rint(K.rotate(a, 90)), a.T)
    assert np.allclose(K.rotate(a, 0), a)


@settings(max_examples=20, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.integers(0, 4))
def test_mirror_index_matches_numpy(h, w, r):
    v = np.arange(h * w, dtype=float).reshape(h, w)
    if r < h and r < w:
        assert np.array_equal(K.pad(v, r, r, "mirror"), np.pad(v, r, mode="reflect"))
        assert np.array_equal(K.pad(v, r, r, "reflect"), np.pad(v, r, mode="symmetric"))


def test_config():
    assert len(feature_names()) == 58
    assert len(feature_names(FeatureConfig(mean=True, minimum=True, maximum=True, median=True, sigmas=(1.0, 2.0, 4.0, 8.0)))) == 63
    assert sigma_range(2, 8) == (2, 4, 8) and sigma_range(4, 16) == (4, 8, 16) and FeatureConfig(max_sigma=4.0).sigmas == (1, 2, 4)
    t = TrainingConfig(class_infos=(ClassInfo("solid", 0, desired_volume_fraction=0.4),))
    assert loads(dumps(t)) == t
    with pytest.raises(ValueError):
        FeatureConfig(min_sigma=0)
    with pytest.raises(ValueError):
        FeatureConfig(use_gpu=True, structure_tensor_eigvals=True)
    with pytest.warns(UserWarning):
        loads('{"rules": []}')
    # null where a setting is off
    t = loads('{"feature_config": {"name": "x"}, "preprocessing": null, "rules": null, "CRF_params": {"s_rgb": [5, 5, 5], "label_confidence": 0.7}, "class_infos": [{"name": "a", "value": 0, "desired_volume_fraction": null, "connectivity_target": null}]}')
    assert t.preprocessing is None and t.CRF_params.s_rgb == (5, 5, 5) and t.CRF_params.label_confidence == 0.7 and not t.class_infos[0].do_sam_postproc
    assert t.params() == {"class_weight": "balanced"} and not t.modal_filter and t.feature_config.add_mod_trace_det_hessian


def test_values_of_their_own(spark):
    """Preprocessed and float images: filters see the values as they are, byte filters what is left of them as bytes."""
    rng = np.random.default_rng(5)
    v = rng.random((20, 18)) * 1.5
    c = FeatureConfig(cast_to="f64", sigmas=(2.0,), minimum=True, maximum=True, bilateral=True)
    rows = [("a", y, x, int(v[y, x]), float(v[y, x])) for y in range(20) for x in range(18)]
    px = spark.createDataFrame(rows, "img string, y int, x int, b int, v double")
    whole = dict(zip(feature_names(c), X.stack_of(c)(v.astype(int), v)))
    assert set(np.unique(whole["maximum_s2"])) <= {0, 1} and whole["gaussian_blur_s0"] is v
    out = segmentation.featurise(px, TrainingConfig(feature_config=c))
    for n, plane in whole.items():
        assert np.array_equal(dense(out, n, v.shape), plane), n
    blurred = K.separable(v, K.normal_taps(1.0, 4))
    out = segmentation.featurise(px, TrainingConfig(feature_config=c, preprocessing=("blur",)))
    for n, plane in zip(feature_names(c), X.stack_of(c)(blurred.astype(int), blurred)):
        assert np.array_equal(dense(out, n, v.shape), plane), n


def test_colour_images_and_casts(spark, tmp_path):
    a = np.random.default_rng(6).integers(0, 256, (9, 8, 3))
    rows = [("a", y, x, k, int(a[y, x, k]), float(a[y, x, k] / 255.0)) for y in range(9) for x in range(8) for k in range(3)]
    px = spark.createDataFrame(rows, "img string, y int, x int, ch int, b int, v double")
    c = FeatureConfig(sigmas=(4.0,))
    out = segmentation.featurise(px, TrainingConfig(feature_config=c), save_path=f"file://{tmp_path}/kept")
    assert len(out.columns) == 3 + 3 * len(feature_names(c)) and {t for n, t in out.dtypes if n not in ("img", "y", "x")} == {"float"}
    for k in range(3):
        for n, plane in zip(feature_names(c), X.stack_of(c)(a[..., k])):
            assert np.array_equal(dense(out, f"{n}_c{k}", (9, 8)), plane.astype(np.float16).astype(float)), n
    one = segmentation.featurise(px.filter("ch = 0"), TrainingConfig(feature_config=c))
    assert one.columns == ["img", "y", "x", *feature_names(c)]
    two = segmentation.featurise(px, TrainingConfig(feature_config=c, preprocessing=("blur",)))
    assert two.columns == out.columns


def test_default_configuration_end_to_end(spark):
    """The settings of a default file, all named, from a colour image to a refined segmentation."""
    text = """{"feature_config": {"name": "default", "desc": "x", "cast_to": "f16", "add_weka_sigma_multiplier": true, "gaussian_blur": true, "sobel_filter": true, "hessian_filter": true,
    "difference_of_gaussians": true, "membrane_projections": true, "mean": false, "minimum": false, "maximum": false, "median": false, "bilateral": false, "laplacian": false, "structure_tensor_eigvals": false,
    "add_mod_trace_det_hessian": true, "membrane_thickness": 1, "membrane_patch_size": 15, "add_zero_scale_features": true, "min_sigma": 1.0, "max_sigma": 16.0, "sigmas": [1.0, 2.0, 4.0, 8.0, 16.0], "use_gpu": false},
    "classifier": "random_forest", "classifier_params": {"n_estimators": 10}, "balance_classes": true, "shuffle_data": true, "n_samples": -1, "preprocessing": null, "modal_filter": true, "modal_filter_k": 2,
    "autocontext": true, "CRF": true, "CRF_params": {"label_confidence": 0.6, "sxy_g": [3, 3], "sxy_b": [80, 80], "s_rgb": [13, 13, 13], "compat_g": 10.0, "compat_b": 10.0, "n_infer": 10}, "add_dino_features": false,
    "HITL": false, "HITL_strategy": "wrong", "rules": null, "class_infos": [{"name": "a", "value": 1, "do_sam_postproc": false}], "use_gpu": false}"""
    truth = np.zeros((40, 40), int)
    truth[:, 20:] = 1
    noise = np.random.default_rng(7).normal(size=(40, 40, 3)) * 20
    a = np.clip(np.stack([60 + 90 * truth, 100 - 0 * truth, 200 - 120 * truth], -1) + noise, 0, 255).astype(int)
    rows = [("a", y, x, k, int(a[y, x, k]), float(a[y, x, k] / 255.0)) for y in range(40) for x in range(40) for k in range(3)]
    px = spark.createDataFrame(rows, "img string, y int, x int, ch int, b int, v double").cache()
    labels = spark.createDataFrame([("a", y, x, int(truth[y, x]) + 1 if y % 8 == 0 else 0) for y in range(40) for x in range(40)], "img string, y int, x int, label int")
    out, model = segmentation.train_and_apply(px, labels, loads(text), 2)
    got = dense(out, "seg", (40, 40))
    assert (got == truth).mean() > 0.95 and len(model.features) == 3 * 58 + 2


def test_tiles_equal_the_whole_image(spark):
    a = np.random.default_rng(0).integers(0, 256, (40, 33))
    c = FeatureConfig(cast_to="f64", sigmas=(1.0, 4.0), mean=True, median=True, laplacian=True, structure_tensor_eigvals=True, bilateral=True, membrane_patch_size=9)
    whole = dict(zip(feature_names(c), X.stack_of(c)(a)))
    rows = X.multiscale_features(frame(spark, a), c, tile=16).collect()
    assert len(rows) == a.size
    for n, plane in whole.items():
        got = np.zeros(a.shape)
        for r in rows:
            got[r.y, r.x] = r[n]
        assert np.array_equal(got, plane), n


@pytest.mark.parametrize("kind", ["mean", "minimum", "maximum", "median"])
def test_joins_equal_tiles(spark, kind):
    px = frame(spark, np.random.default_rng(1).integers(0, 256, (20, 17)))
    a = dense(X.rank_by_join(px, 3.0, kind), kind, (20, 17))
    assert np.array_equal(a, dense(X.rank_filter(px, 3.0, kind, tile=8), kind, (20, 17)))


def test_windows_equal_arrays(spark):
    a = np.random.default_rng(2).integers(0, 256, (12, 19))
    px = frame(spark, a)
    v = a / 255.0
    assert np.array_equal(dense(X.gaussian_blur(px, 2.0), "gaussian_blur", a.shape), K.gaussian(v, 2.0))
    assert np.array_equal(dense(X.sobel_filter(px, 2.0), "sobel_filter", a.shape), K.edges(K.gaussian(v, 2.0)))
    assert np.array_equal(dense(X.hessian_filter(px, 1.0), "hess_det", a.shape), K.hessian(K.gaussian(v, 1.0))[4])


def test_single_row_and_single_pixel(spark):
    for a in (np.arange(7).reshape(1, 7), np.array([[9]])):
        out = X.multiscale_features(frame(spark, a)).collect()
        assert len(out) == a.size and all(r.sobel_filter_s0 is not None for r in out)


def test_empty_image(spark):
    px = frame(spark, np.zeros((1, 1))).filter("y < 0")
    assert X.multiscale_features(px).count() == 0 and X.gaussian_blur(px, 1.0).count() == 0


def test_variants_are_alike():
    a = np.random.default_rng(3).integers(0, 256, (48, 48))
    a = K.rank(a, 3, "mean")
    cpu = dict(zip(feature_names(FeatureConfig()), X.stack_of(FeatureConfig())(a)))
    gpu = dict(zip(feature_names(FeatureConfig()), X.gpu_stack_of(FeatureConfig(use_gpu=True))(a)))
    scaled = lambda p: (p - p.min()) / max(p.max() - p.min(), 1e-9)
    for n in ("gaussian_blur_s8", "membrane_mean", "membrane_sum"):
        assert ((scaled(cpu[n]) - scaled(gpu[n])) ** 2).mean() < 0.03


def test_custom_features_and_half_precision(spark):
    a = np.arange(12).reshape(3, 4)
    out = X.custom_features(frame(spark, a), lambda b: [b * 0.1], ["tenth"])
    half = {(r.y, r.x): r.tenth for r in X.cast_features(out, ["tenth"]).collect()}
    assert half[2, 3] == float(np.float16(1.1))
    assert S.TILE == 256


@pytest.mark.parametrize("radius", [1, 2, 4, 5, 9])
def test_sliding_ranks_equal_sorted_discs(radius):
    """Running sums, spans and sliding histograms against every disc's values, also on images smaller than the disc."""
    rng = np.random.default_rng(radius)
    for shape in ((1, 1), (3, 31), (22, 5), (17, 19)):
        b = rng.choice([0, 1, 7, 128, 254, 255], shape) if radius % 2 else rng.integers(0, 256, shape)
        held = [[sorted(int(b[y + dy, x + dx]) for dy, dx in K.disc(radius) if 0 <= y + dy < shape[0] and 0 <= x + dx < shape[1]) for x in range(shape[1])] for y in range(shape[0])]
        for kind, of in (("mean", lambda v: sum(v) // len(v)), ("minimum", min), ("maximum", max), ("median", lambda v: v[len(v) // 2])):
            assert K.rank(b.astype(np.uint8), radius, kind).tolist() == [[of(v) for v in row] for row in held], kind
        assert np.array_equal(K.disc_median(b, K.disc(radius)), K.sorted_median(b, K.disc(radius)))
