"""Custom functions: whole images in batches, and the registered query over tiles."""

import numpy as np

from pixelmill.operators import features as X
from pixelmill.operators import stencil as S
from pixelmill.plans.queries import QUERIES


def test_whole_images_come_and_go_in_batches(spark, monkeypatch):
    """A function of whole images sees all of it; its pixels, also missing ones and those given twice, go out in batches."""
    monkeypatch.setattr(S, "BATCH", 100)
    rng = np.random.default_rng(4)
    a = {k: rng.integers(0, 256, (23, 40)) for k in ("a", "b")}
    rows = [(k, y, x, int(v[y, x]), float(v[y, x] / 4)) for k, v in a.items() for y in range(23) for x in range(40) if (y, x) != (3, 5) and y != 7]
    px = spark.createDataFrame([*rows, rows[0]], "img string, y int, x int, b int, v double").repartition(5)
    for column, values, scale in (("b", False, 1), ("v", True, 4)):
        got = X.custom_features(px, lambda b: [b - b.max(), b.cumsum(0)], ["less", "sum"], values=values)
        for k, v in a.items():
            seen = np.where((np.indices(v.shape)[0] == 7) | (np.arange(v.size).reshape(v.shape) == 3 * 40 + 5), 0, v)
            part = [(r.y, r.x, r.less * scale, r.sum * scale) for r in got.collect() if r.img == k]
            want = [(y, x, int(seen[y, x] - seen.max()), int(seen.cumsum(0)[y, x])) for i, y, x, *_ in [*rows, rows[0]] if i == k]
            assert sorted(part) == sorted(want), (column, k)


def test_the_custom_query_spreads_over_tiles(spark, sf, monkeypatch):
    calls, kept = spark.sparkContext.accumulator(0), S.by_tile

    def counted(px, kernel, *rest, **more):
        def one(*planes):
            calls.add(1)
            return kernel(*planes)

        return kept(px, one, *rest, **more)

    monkeypatch.setattr(S, "by_tile", counted)
    assert QUERIES["custom_feature"](spark, sf).count() == 500 * 64
    assert calls.value == 2  # of 256 rows each
