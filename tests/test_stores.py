"""Files written and read by name, in the stores that a cluster may have: bare paths, and stores that Spark alone reaches."""

import numpy as np
import pytest
from pyspark.sql.datasource import GreaterThan, GreaterThanOrEqual, LessThan

from pixelmill.llm import scratch
from pixelmill.operators import features as X
from pixelmill.operators import sam
from pixelmill.sources import images, shared, tiff


@pytest.fixture
def bare(spark, tmp_path, monkeypatch):
    """The shared folder is named without a store; the setting itself is fixed when a session begins."""
    get, path = type(spark.conf).get, tmp_path / "a b"
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *rest: str(path) if key == "spark.checkpoint.dir" else get(self, key, *rest))
    return path


def pixels(spark):
    a = np.random.default_rng(5).integers(0, 256, (9, 70)).astype(np.uint8)
    rows = [(i, y, x, int(a[y, x]) ^ k) for k, i in enumerate(("one", "t=w o%")) for y in range(9) for x in range(70)]
    return spark.createDataFrame(rows, "img string, y int, x int, b int"), sorted((y, x, b) for _, y, x, b in rows)


def test_a_bare_shared_folder_names_its_store(spark, bare):
    assert shared.new_path(spark, "x").startswith("file:/") and scratch.shared_dir(spark).startswith("file:/")
    px, want = pixels(spark)
    path = shared.new_path(spark, "images")
    images.write_images(px, path)
    assert len(list(bare.glob("images-*/*.png"))) == 2
    assert sorted(tuple(r) for r in images.read_images(spark, path).select("y", "x", "b").collect()) == want


def test_stores_that_spark_alone_reaches(spark, tmp_path):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.store.link./in", f"file://{tmp_path}")
    px, want = pixels(spark)
    got = lambda df: sorted(tuple(r) for r in df.select("y", "x", "b").collect())
    for kind in ("png", "tif"):
        for _ in range(2):  # a second write replaces
            images.write_images(px, f"viewfs://store/in/{kind}", kind=kind)
        assert sorted(f.name for f in (tmp_path / kind).iterdir() if not f.name.startswith(".")) == [f"one.{kind}", f"t=w o%.{kind}"]
        assert got(images.read_images(spark, f"viewfs://store/in/{kind}")) == want
    images.write_images(px, "viewfs://store/in/tiles", kind="tif", encoder=lambda a: tiff.encode_pages([a, a], tile=(16, 32), big=True))
    t = tiff.read_tiff(spark, "viewfs://store/in/tiles", 4096)
    assert got(t.filter("page = 1")) == want and t.filter("page = 0 and x > 40").count() == 2 * 9 * 29
    stack = X.concat_features(px.select("img", "y", "x", px.b.cast("double").alias("f")), px.select("img", "y", "x", (px.b * 0.1).alias("g")))
    for kind in images.STACKS:
        images.save_features(stack, f"viewfs://store/in/stack-{kind}", kind)
        back = images.load_features(spark, f"viewfs://store/in/stack-{kind}/*.{kind}", ["f", "g"])
        assert sorted(back.select("y", "x", "f", "g").collect()) == sorted(stack.select("y", "x", "f", "g").collect())


def counts(spark, top):
    rows = [(i, y, x, (y * 40 + x) * top // 279 if i == "many" else y + x) for i in ("many", "few") for y in range(7) for x in range(40)]
    return spark.createDataFrame(rows, "img string, y int, x int, b int"), sorted(rows)


def test_prompts_see_counts_beyond_255(spark):
    for top in (200, 1700, (1 << 22) + 3, 40_000_001):
        px, _ = counts(spark, top)
        embedded = sam.encode(sam.pack_images(px), lambda: lambda image: image)
        prompts = spark.createDataFrame([("many", [[0.0, 0.0], [40.0, 7.0]], [2.0, 3.0], 1, 0)], "img string, coords array<array<float>>, labels array<float>, value long, ord long")
        decode = lambda image, coords, labels: (image.astype(int)[None, None] - top // 2, np.ones((1, 1)))
        got = {(r.y, r.x) for r in sam.prompted_masks(embedded, prompts, lambda decode=decode: decode).collect()}
        assert got == {(r.y, r.x) for r in px.filter("img = 'many'").collect() if r.b > top // 2}


@pytest.mark.parametrize("top", [255, 256, 65535])
def test_png_keeps_values_of_16_bits(spark, top):
    rng = np.random.default_rng(top)
    for shape in ((7, 9), (5, 6, 3)):
        a = rng.integers(0, top + 1, shape)
        a.flat[0] = top
        assert np.array_equal(images.decode_png(images.encode_png(a)), a)
    with pytest.raises(ValueError):
        images.encode_png(np.array([[65536]]))


def test_png_files_of_counts_beyond_255(spark):
    px, want = counts(spark, 1700)
    got = images.pixels_of(images.image_files(px, "b", "png")).selectExpr("split(img, '[.]')[0] AS img", "y", "x", "b")
    assert sorted(map(tuple, got.collect())) == want


def test_tiff_files_of_counts_beyond_255(spark):
    for top in (1700, 1 << 22):
        px, want = counts(spark, top)
        got = images.pixels_of(images.image_files(px, "b", "tif")).selectExpr("split(img, '[.]')[0] AS img", "y", "x", "b")
        assert sorted(map(tuple, got.collect())) == want
    for a in (np.array([[-5, 70_000]]), np.array([[1 << 31, 0]]), np.array([[300, 65_535]]), np.array([[0, 255]])):
        back = images.decode_tiff(images.encode_tiff(a))
        assert np.array_equal(back, a) and (a.max() > 255 or back.dtype == np.uint8)
    with pytest.raises(ValueError):
        images.encode_tiff(np.array([[1 << 40]]))


def test_array_files_in_bands(spark, tmp_path, monkeypatch):
    """Written band by band by the task of an image, read by many tasks, none of which holds a file."""
    monkeypatch.setattr(images, "BAND", 4096)
    monkeypatch.setattr(images, "BATCH", 200)
    for kind in ("double", "float"):
        df = spark.range(2).selectExpr("concat('i', id) AS img", "explode(sequence(0, 50 + 9 * cast(id AS int))) AS y").selectExpr("*", "explode(sequence(0, 36)) AS x")
        df = df.filter("y * x <> 6").selectExpr("img", "y", "x", f"cast(y * 0.5 + x AS {kind}) AS f", f"cast(y AS {kind}) AS g").repartition(4)
        images.save_features(df, f"file://{tmp_path}/{kind}", "npy")
        a = np.load(tmp_path / kind / "i1.npy")
        assert a.shape == (60, 37, 2) and a.dtype == np.dtype(kind.replace("float", "float32")) and a[4, 7, 0] == 9 and not a[1, 6].any()
        back = images.load_features(spark, f"file://{tmp_path}/{kind}/*.npy", ["f", "g"])
        assert back.filter("y * x <> 6").exceptAll(df.selectExpr("img", "y", "x", "double(f)", "double(g)")).count() == 0 and back.count() == (51 + 60) * 37
        assert back.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).filter(bool).count() > 2
    np.save(tmp_path / "t.npy", np.asfortranarray(np.arange(700.0).reshape(35, 20)))
    assert {(r.y, r.x, r.f) for r in images.load_features(spark, f"file://{tmp_path}/t.npy", ["f"]).collect()} == {(i // 20, i % 20, float(i)) for i in range(700)}


def test_shares_without_wanted_segments_get_no_task(spark, tmp_path):
    a = np.random.default_rng(6).integers(0, 256, (400, 70)).astype(np.uint8)
    (tmp_path / "a.tif").write_bytes(tiff.encode_pages([a, a[::-1]], tile=(16, 32), big=True))

    def shares(*filters):
        reader = tiff.TiffReader({"path": f"file://{tmp_path}", "split_bytes": "1024"})
        list(reader.pushFilters(filters))
        return reader.partitions()

    every = len(shares())
    assert every > 20
    assert len(shares(GreaterThanOrEqual(("y",), 20), LessThan(("y",), 90), GreaterThan(("x",), 40))) < every / 2
    assert len(shares(GreaterThan(("y",), 1000))) == 1 and len(shares(GreaterThanOrEqual(("x",), 0))) == every
    rows = tiff.read_tiff(spark, f"file://{tmp_path}", 1024).filter("y >= 20 and y < 90 and x > 40").collect()
    assert sorted((r.page, r.y, r.x, r.b) for r in rows) == [(p, y, x, int(page[y, x])) for p, page in enumerate((a, a[::-1])) for y in range(20, 90) for x in range(41, 70)]
