"""Quality classifier: random Fourier features over document statistics, ridge, isotonic calibration."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import statistics as S
from .scratch import Scratch, result

#: Random features, width of the Gaussian kernel in standard deviations, folds, seed, and where a document counts as good.
FEATURES, WIDTH, FOLDS, SEED, GOOD = 192, 4.0, 4, 7, 0.7
PENALTIES = (1e-4, 1e-3, 1e-2, 1e-1)
BINS = 4096


class Fourier:
    """cos(w.x + b) features whose inner products approximate a Gaussian kernel, after centring; plus x and 1."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int = FEATURES, width: float = WIDTH, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, np.where(scale > 1e-9, scale, 1.0)
        self.w = rng.normal(size=(len(mean), features)) / width
        self.b = rng.uniform(0, 2 * np.pi, features)
        self.size = features + len(mean) + 1

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        f = np.cos(z @ self.w + self.b) * np.sqrt(2.0 / self.w.shape[1])
        return np.hstack([f, z / 4, np.ones((len(x), 1))])


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, len(S.NAMES)))


def normal_equations(train: DataFrame, features: Fourier, folds: int) -> np.ndarray:
    """Per fold Z'Z and Z'y, summed within partitions, then row by row over partitions; size fixed by ``features``.

    Element [fold, i] is row i of Z'Z with (Z'y)_i at its end; the last row holds y'Z, y'y.
    """
    d = features.size

    def part(batches):
        total = np.zeros((folds, d + 1, d + 1))
        for rb in batches:
            z = features(_matrix(rb.column("stats")))
            z = np.hstack([z, rb.column("label").to_numpy(zero_copy_only=False).astype(float)[:, None]])
            fold = rb.column("fold").to_numpy(zero_copy_only=False)
            for k in range(folds):
                zk = z[fold == k]
                total[k] += zk.T @ zk
        n = folds * (d + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array([r.tobytes() for r in total.reshape(n, d + 1)], pa.binary())], ["i", "row"])

    def add(t: pa.Table) -> pa.Table:
        rows = np.sum([np.frombuffer(x) for x in t.column("row").to_pylist()], axis=0)
        return pa.table({"i": t.column("i")[:1], "row": pa.array([rows.tobytes()], pa.binary())})

    summed = train.mapInArrow(part, "i int, row binary").groupBy("i").applyInArrow(add, "i int, row binary").collect()
    out = np.zeros((folds * (d + 1), d + 1))
    for r in summed:
        out[r["i"]] = np.frombuffer(bytes(r["row"]))
    return out.reshape(folds, d + 1, d + 1)


def solve(eq: np.ndarray, penalty: float) -> np.ndarray:
    d = len(eq) - 1
    n = max(eq[d - 1, d - 1], 1.0)  # the last feature is 1, so its square sums to the rows
    ridge = np.full(d, penalty * n)
    ridge[-1] = 1e-9 * n
    return np.linalg.solve(eq[:d, :d] + np.diag(ridge) + 1e-9 * np.eye(d), eq[:d, d])


def fit_ridge(eqs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights on all folds and, per fold, weights without it; the penalty with the least error on left-out folds."""
    total, best = eqs.sum(axis=0), None
    for penalty in PENALTIES:
        ws = np.stack([solve(total - e, penalty) for e in eqs])
        error = sum(e[-1, -1] - 2 * w @ e[:-1, -1] + w @ e[:-1, :-1] @ w for w, e in zip(ws, eqs))
        if best is None or error < best[0]:
            best = error, penalty, ws
    return solve(total, best[1]), best[2]


def isotonic(x: np.ndarray, n: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over sorted x with n rows each: knots and values, not falling. Half a row of each
    label is added to a block, so no value is 0 or 1."""
    blocks: list[list[float]] = []
    for xi, ni, pi in zip(x, n, positive):
        blocks.append([pi, ni, xi * ni])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            p, m, s = blocks.pop()
            blocks[-1][0] += p
            blocks[-1][1] += m
            blocks[-1][2] += s
    knots = np.array([s / m for _, m, s in blocks])
    values = np.maximum.accumulate(np.array([(p + 0.5) / (m + 1) for p, m, _ in blocks]))
    return knots, values


def calibrated(raw: np.ndarray, knots: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Interpolated probability; a small share of the raw score keeps the order within flat stretches."""
    p = np.interp(raw, knots, values)
    return np.clip(0.999 * p + 0.001 / (1 + np.exp(-4 * (raw - 0.5))), 0, 1)


def score_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, features: int = FEATURES) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted (1 from ``GOOD`` on).

    Learns from rows of ``labels`` (doc_id, quality 0/1) whose ``remainder`` is not 2, all of them; statistics are
    taken over whole texts. Null or empty texts get the score of an empty text; a null id is not held out; null labels are left
    out; a doc_id labelled twice counts twice; without labels of both kinds every score is their share (0.5 without any).
    An empty table gives an empty result.
    """
    work = Scratch(spark, "quality")
    stats = work.keep(S.document_statistics(docs), "stats")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).filter("label in (0, 1)")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")
    train = stats.join(known.filter(remainder(F.col("doc_id")) != 2), "doc_id").select("stats", "label", fold.alias("fold"))
    train = work.keep(train, "train")
    k = len(S.NAMES)
    row = train.agg(F.count("*"), F.sum("label"), *[F.avg(F.get("stats", F.lit(i))) for i in range(k)], *[F.stddev_pop(F.get("stats", F.lit(i))) for i in range(k)]).first()
    n, good = row[0], row[1] or 0
    held = F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False)).alias("held_out")
    if not 0 < good < n:
        share = F.lit(good / n if n else 0.5)
        return stats.select("doc_id", held, share.alias("score"), (share >= GOOD).cast("int").alias("predicted"))
    make = Fourier(np.array(row[2 : 2 + k]), np.array(row[2 + k :]), features)
    weights, without = fit_ridge(normal_equations(train, make, FOLDS))

    def left_out(batches):
        for rb in batches:
            raw = np.einsum("ij,ij->i", make(_matrix(rb.column("stats"))), without[rb.column("fold").to_numpy(zero_copy_only=False)])
            yield pa.RecordBatch.from_arrays([pa.array(np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int32)), rb.column("label")], ["bin", "label"])

    bins = train.mapInArrow(left_out, "bin int, label int").groupBy("bin").agg(F.count("*").alias("n"), F.sum("label").alias("good")).orderBy("bin").collect()
    knots, values = isotonic(np.array([(b["bin"] + 0.5) / BINS * 2 - 0.5 for b in bins]), np.array([b["n"] for b in bins], float), np.array([b["good"] for b in bins], float))

    def score(batches):
        for rb in batches:
            s = calibrated(make(_matrix(rb.column("stats"))) @ weights, knots, values)
            yield pa.RecordBatch.from_arrays([rb.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    out = stats.mapInArrow(score, "doc_id long, score double")
    return out.select("doc_id", held, "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result(spark, "op5", lambda: score_quality(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")))
