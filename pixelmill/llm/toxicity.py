"""Toxicity: a chain of linear models over hashed words and word beginnings.

Categories are predicted one after the other; each model also sees the probabilities of the earlier
categories, in training those of models that had not seen the row (out-of-fold).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .scratch import Scratch, result

#: Hash buckets; labelled rows to learn from at most; features kept for each category; folds; penalty; where a category holds.
BUCKETS, SAMPLE, KEEP, FOLDS, PENALTY, TOXIC = 1 << 18, 12_000, 96, 4, 0.1, 0.5
#: Lengths of the word beginnings, in bytes, that count as features beside whole words.
PREFIXES = (4, 5, 6)
_PARTS = 16


def buckets_of(raw: np.ndarray, offsets: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hash buckets of all words and word beginnings of lower-cased texts."""
    raw = K.LOWER[raw]
    starts, ends, at = K.words(raw, offsets, K.NOT_ALNUM)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(at))
    rows, found = [row], [_hash(raw, starts, ends, n_buckets, 0)]
    for p in PREFIXES:
        longer = ends - starts > p
        s = starts[longer]
        rows.append(row[longer])
        found.append(_hash(raw, s, s + p, n_buckets, p))
    return np.concatenate(rows), np.concatenate(found)


def _hash(raw, starts, ends, n, salt):
    return (K.mix(K.word_hashes(raw, starts, ends) + K.U(salt * 0x9E3779B1)) >> K.U(17)).astype(np.int64) & (n - 1)


def _presence(train: DataFrame, categories: list[str], n_buckets: int) -> np.ndarray:
    """Rows that have each bucket, and per category those with its label; a fixed-size sum over partitions."""
    width = n_buckets // _PARTS

    def part(batches):
        total = np.zeros((1 + len(categories), n_buckets), np.int32)
        for whole in batches:
            for rb in K.text_slices(whole):
                rows, found = buckets_of(*K.text_buffer(rb.column("text")), n_buckets)
                pair = np.unique(rows.astype(np.int64) * n_buckets + found)
                rows, found = pair // n_buckets, pair % n_buckets
                total[0] += np.bincount(found, minlength=n_buckets).astype(np.int32)
                for i, c in enumerate(categories):
                    y = rb.column(c).to_numpy(zero_copy_only=False).astype(bool)
                    total[1 + i] += np.bincount(found[y[rows]], minlength=n_buckets).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(_PARTS, dtype=np.int32)), pa.array([total[:, k * width : (k + 1) * width].tobytes() for k in range(_PARTS)], pa.binary())], ["part", "counts"]
        )

    def add(t: pa.Table) -> pa.Table:
        s = np.zeros((1 + len(categories)) * width, np.int32)
        for x in t.column("counts").to_pylist():
            s += np.frombuffer(x, np.int32)
        return pa.table({"part": t.column("part")[:1], "counts": pa.array([s.tobytes()], pa.binary())})

    out = np.zeros((1 + len(categories), n_buckets), np.int64)
    for r in train.mapInArrow(part, "part int, counts binary").groupBy("part").applyInArrow(add, "part int, counts binary").collect():
        out[:, r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(bytes(r["counts"]), np.int32).reshape(-1, width)
    return out


def select_features(counts: np.ndarray, n: int, positives: np.ndarray, keep: int) -> np.ndarray:
    """Buckets whose presence tells most about a category: by the log-likelihood ratio, over-represented ones only."""
    chosen: set[int] = set()
    seen = counts[0]
    for c, total in zip(counts[1:], positives):
        if not 0 < total < n:
            continue
        expect = seen * (total / n)
        more = (c >= 3) & (c > expect)
        with np.errstate(divide="ignore", invalid="ignore"):
            a = np.where(c > 0, c * np.log(c / expect), 0)
            rest, other = seen - c, seen * (1 - total / n)
            b = np.where(rest > 0, rest * np.log(rest / other), 0)
        gain = np.where(more, a + b, -1.0)
        best = np.argsort(-gain, kind="stable")[:keep]
        chosen.update(best[gain[best] > 2.0].tolist())
    return np.array(sorted(chosen), np.int64)


def matrix(raw, offsets, features: np.ndarray, n_buckets: int) -> np.ndarray:
    """log(1 + count) of the chosen buckets, per row."""
    place = np.full(n_buckets, -1, np.int32)
    place[features] = np.arange(len(features))
    rows, found = buckets_of(raw, offsets, n_buckets)
    col = place[found]
    hit = col >= 0
    n = len(offsets) - 1
    return np.log1p(np.bincount(rows[hit].astype(np.int64) * len(features) + col[hit], minlength=n * len(features)).reshape(n, len(features)))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, rounds: int = 12) -> np.ndarray:
    """Weights, the last one the intercept, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


class Chain:
    """One model for each category in order."""

    def __init__(self, features: np.ndarray, weights: list[np.ndarray], n_buckets: int):
        self.features, self.weights, self.n_buckets = features, weights, n_buckets

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray, fold: np.ndarray, columns: np.ndarray, features: list[np.ndarray], n_buckets: int) -> Chain:
        """``x`` has the buckets ``columns``; ``features`` are those chosen without each fold, and last those chosen from all rows. An
        earlier category's probability of a row comes from models and features that its fold had no part in."""
        held = [np.searchsorted(columns, f) for f in features]
        weights, earlier = [], np.zeros((len(x), 0))
        for y in labels.T.astype(float):
            weights.append(logistic(np.hstack([x[:, held[-1]], earlier]), y))
            p = np.empty(len(x))
            for k in range(FOLDS):
                out, xe = fold == k, np.hstack([x[:, held[k]], earlier])
                p[out] = probability(xe[out], logistic(xe[~out], y[~out])) if (~out).any() else y.mean()
            earlier = np.hstack([earlier, p[:, None]])
        return cls(features[-1], weights, n_buckets)

    def predict(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        x = matrix(raw, offsets, self.features, self.n_buckets)
        out = np.zeros((len(x), 0))
        for w in self.weights:
            out = np.hstack([out, probability(np.hstack([x, out]), w)[:, None]])
        return out


def fit_chain(spark: SparkSession, docs: DataFrame, labels: DataFrame, categories: list[str], sample: int = SAMPLE, n_buckets: int = BUCKETS) -> Chain:
    """Fit on ``labels`` (doc_id and a 0/1 column for each category), on at most ``sample`` documents by hash of doc_id.

    A doc_id counts once: of several labels the greatest holds, of several texts the first in order.
    """
    complete = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("int").alias(c) for c in categories]).na.drop()
    some = complete.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in categories]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").join(F.broadcast(some), "doc_id")
    train = texts.groupBy("doc_id", *categories).agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    train = Scratch(spark, "train").keep(train.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)).cast("int")), "rows")
    folds = np.zeros((FOLDS, 1 + len(categories)), np.int64)
    for r in train.groupBy("fold").agg(F.count("*"), *[F.sum(c) for c in categories]).collect():
        folds[r[0]] = [x or 0 for x in r[1:]]
    if not folds[:, 0].any():
        return Chain(np.zeros(0, np.int64), [np.array([-30.0]) if not i else np.append(np.zeros(i), -30.0) for i in range(len(categories))], n_buckets)
    each = [_presence(train.filter(F.col("fold") == k), categories, n_buckets).astype(np.int32) for k in range(FOLDS)]
    total, rows_of = sum(each), folds.sum(0)
    chosen = [select_features(total - c, n[0], n[1:], KEEP) for c, n in zip([*each, 0], [*(rows_of - folds), rows_of])]
    features = np.unique(np.concatenate(chosen))
    del each, total

    def rows(batches):
        for whole in batches:
            for rb in K.text_slices(whole):
                x = matrix(*K.text_buffer(rb.column("text")), features, n_buckets).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), rb.column("fold"), *(rb.column(c) for c in categories)], ["x", "fold", *categories])

    schema = "x binary, fold int, " + ", ".join(f"`{c}` int" for c in categories)
    got = train.mapInArrow(rows, schema).collect()  # at most ``sample`` rows of fixed width
    x = np.frombuffer(b"".join(r["x"] for r in got), np.float32).reshape(len(got), len(features))
    fold, truth = np.array([r["fold"] for r in got]), np.array([[r[c] for c in categories] for r in got])
    del got
    return Chain.fit(x, truth, fold, features, chosen, n_buckets)


def apply_chain(docs: DataFrame, chain: Chain, categories: list[str]) -> DataFrame:
    """All columns of ``docs`` (those named like the results replaced) and p_<category> for each category.

    Null or empty texts get the intercepts' probabilities; rows are scored each on its own; an empty table gives an empty result.
    """
    made = [f"p_{c}" for c in categories]
    docs = docs.select(*[c for c in docs.columns if c not in made])
    width = len(docs.columns)

    def run(batches):
        for whole in batches:
            for rb in K.text_slices(whole):
                p = chain.predict(*K.text_buffer(rb.column("text")))
                yield pa.RecordBatch.from_arrays([*(rb.column(i) for i in range(width)), *(pa.array(c) for c in p.T)], [*rb.schema.names, *made])

    from pyspark.sql import types as T

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(m, T.DoubleType()) for m in made)]))


#: Specific categories first; the last is the one that decides.
CATEGORIES = ["toxic_english", "toxic_other", "toxic"]


def category_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels of the chain: toxic in English documents, toxic in others, toxic. Languages define labels and are no inputs.

    At most ``SAMPLE`` rows. A doc_id counts once: of several labels the greatest holds, of several languages the first in order.
    """
    t = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1) and doc_id is not null")
    t = t.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    lang = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang_")).join(F.broadcast(t), "doc_id")
    one = lang.groupBy("doc_id", "toxic").agg(F.min("lang_").alias("lang_"))
    english = (F.col("lang_") == "en").cast("int")
    return one.select("doc_id", (F.col("toxic") * english).alias("toxic_english"), (F.col("toxic") * (1 - english)).alias("toxic_other"), "toxic")


def score_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, train_docs: DataFrame | None = None) -> DataFrame:
    """The columns of ``docs`` with p_toxic_english, p_toxic_other, p_toxic and ``toxic`` (1 from ``TOXIC`` on).

    Learns from at most ``SAMPLE`` rows of ``labels`` (doc_id, toxic) with their texts in ``train_docs`` (``docs`` where not
    given). Null or empty texts have no features and get the intercept's probability; ties and repeated rows are scored
    alike; without labels nothing is toxic; an empty table gives an empty result. A column ``toxic`` of ``docs`` is replaced.
    """
    source = docs if train_docs is None else train_docs
    chain = fit_chain(spark, source, category_labels(source, labels), CATEGORIES)
    out = apply_chain(docs.select(*[c for c in docs.columns if c != "toxic"]), chain, CATEGORIES)
    return out.withColumn("toxic", (F.col("p_toxic") >= TOXIC).cast("int"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = ("doc_id", "p_toxic_english", "p_toxic_other", "p_toxic", "toxic")
    return result(spark, "op6", lambda: score_toxicity(spark, docs.select("doc_id", "text", "lang"), spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*made))
