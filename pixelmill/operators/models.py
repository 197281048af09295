"""Classifiers of pixels: training on labelled pixels, probabilities and segmentations of all."""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections.abc import Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import MinMaxScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.forest import Forest
from ..sources.shared import new_path, read_text, remove, staged, write_text
from . import labels as L
from .boost import Booster, added

KEYS = ("img", "y", "x")


class Classifier(ABC):
    """fit on (features, label 0..K-1[, weight]); ``predict_proba`` adds ``prob``, ``predict`` adds ``seg``, both 0-based.

    A class of a caller's own that has something to keep overrides ``state`` and ``restore``.
    """

    def __init__(self, features: Sequence[str], classes: int, **params: Any):
        self.features, self.classes, self.params = list(features), classes, params

    @abstractmethod
    def fit(self, train: DataFrame, weight: str | None = None) -> Classifier: ...

    @abstractmethod
    def predict_proba(self, px: DataFrame) -> DataFrame: ...

    def probabilities(self, px: DataFrame, keys: Sequence[str]) -> DataFrame:
        """(keys, prob) only."""
        return self.predict_proba(px).select(*keys, "prob")

    def predict(self, px: DataFrame) -> DataFrame:
        return self.predict_proba(px).withColumn("seg", L.argmax(F.col("prob")))

    def state(self) -> dict[str, Any]:
        """What was learned, for JSON; whatever ``restore`` needs beside."""
        return {}

    def restore(self, state: dict[str, Any], spark: SparkSession, path: str) -> None:
        """Take up what ``state`` gave."""

    def save(self, spark: SparkSession, path: str) -> None:
        """Write to any store that Spark writes; ``load_classifier`` brings it back."""
        write_text(spark, f"{path}/about", json.dumps({"kind": type(self).__name__, "features": self.features, "classes": self.classes, "params": self.params, "state": self.state()}))

    def __repr__(self) -> str:
        return f"{type(self).__name__}({len(self.features)} features, {self.classes} classes, {self.params})"


class PipelineClassifier(Classifier):
    """A Spark ML pipeline."""

    def stages(self, weight: str | None) -> list:
        raise NotImplementedError

    def fit(self, train: DataFrame, weight: str | None = None) -> PipelineClassifier:
        data = train.withColumn("label", F.col("label").cast("double"))
        self.model = Pipeline(stages=[VectorAssembler(inputCols=self.features, outputCol="raw_features", handleInvalid="keep"), *self.stages(weight)]).fit(data)
        return self

    def predict_proba(self, px: DataFrame) -> DataFrame:
        out = self.model.transform(px)
        return out.select(*px.columns, vector_to_array("probability").alias("prob"))

    def save(self, spark: SparkSession, path: str) -> None:
        super().save(spark, path)
        self.model.write().overwrite().save(f"{path}/model")

    def restore(self, state, spark, path):
        self.model = PipelineModel.load(f"{path}/model")


class RandomForest(PipelineClassifier):
    """n_estimators, max_depth (no limit: 30, the most there is), max_features (a number or auto), seed.

    A forest of up to ``NODES`` nodes is applied as arrays, of which the driver holds all; larger ones by Spark's own model.
    """

    NODES = 4_000_000

    def stages(self, weight):
        p = self.params
        forest = RandomForestClassifier(
            featuresCol="raw_features", labelCol="label", numTrees=p.get("n_estimators", 100), maxDepth=min(p.get("max_depth") or 30, 30),
            featureSubsetStrategy=str(p.get("max_features", "auto")), seed=p.get("seed", 0), minInstancesPerNode=p.get("min_samples_leaf", 1),
        )
        if weight:
            forest.setWeightCol(weight)
        return [forest]

    def fit(self, train, weight=None):
        self.forest = None
        return super().fit(train, weight)

    def _packed(self, spark: SparkSession) -> Forest:
        """The trees as arrays, read once from what Spark writes of its model; as large as the model."""
        if self.forest is None:
            path = new_path(spark, "forest")
            self.model.stages[-1].write().save(path)
            d = F.col("nodeData")
            nodes = spark.read.parquet(f"{path}/data").select("treeID", d["id"], d["split"]["featureIndex"], F.get(d["split"]["leftCategoriesOrThreshold"], F.lit(0)), d["leftChild"], d["rightChild"], d["impurityStats"])
            self.forest = Forest.of_nodes(len(self.features), [tuple(r) for r in nodes.collect()])
            remove(spark, path)
        return self.forest

    def predict_proba(self, px: DataFrame) -> DataFrame:
        """The same probabilities as Spark's, by bitwise steps over columns."""
        return self.probabilities(px, px.columns)

    def probabilities(self, px: DataFrame, keys: Sequence[str]) -> DataFrame:
        if self.model.stages[-1].totalNumNodes > self.NODES:
            return super().predict_proba(px).select(*keys, "prob")
        forest, names, carried = self._packed(px.sparkSession), self.features, list(keys)

        def run(batches):
            for rb in batches:
                if rb.num_rows:
                    p = forest.predict_proba([rb.column(c).to_numpy(zero_copy_only=False) for c in names])
                    prob = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32)), pa.array(p.ravel()))
                    yield pa.RecordBatch.from_arrays([*(rb.column(c) for c in carried), prob], [*carried, "prob"])

        return px.mapInArrow(run, T.StructType([*px.select(*carried).schema.fields, T.StructField("prob", T.ArrayType(T.DoubleType()))]))

    def restore(self, state, spark, path):
        super().restore(state, spark, path)
        self.forest = None


class Logistic(PipelineClassifier):
    """Multinomial regression on features scaled to 0..1; scaling is learned when fitting."""

    def stages(self, weight):
        r = LogisticRegression(featuresCol="features", labelCol="label", maxIter=self.params.get("max_iter", 100), regParam=1.0 / self.params.get("C", 1e3), family="multinomial")
        if weight:
            r.setWeightCol(weight)
        return [MinMaxScaler(inputCol="raw_features", outputCol="features"), r]


def _matrix(rb: pa.RecordBatch | pa.Table, names: Sequence[str], low: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Features scaled so that those of the training rows go from -2 to 2; missing ones count as 0."""
    x = np.stack([rb.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names], 1)
    return np.nan_to_num((x - low) / span * 4 - 2)


class MLP(Classifier):
    """Hidden layers with rectified units and softmax, fitted by Adam on minibatches.

    ``hidden_layer_sizes`` (100,), ``alpha`` 1e-4, ``learning_rate_init`` 0.03, ``max_iter`` 60 passes, ``batch_size`` 200 rows but at most ``BATCHES`` batches a pass,
    ``tol`` 1e-3 and ``n_iter_no_change`` 8: passes without a better loss after which it stops, ``seed``. A step is a job: every partition sums
    its gradient, rows in blocks of one shape and factors rounded so that sums are exact; weights do not depend on how rows are dealt.
    """

    #: Minibatches in a pass; rows in a block; steps to which activations and errors are rounded.
    BATCHES, BLOCK, ACTIVATION, ERROR = 4, 256, 2.0**-10, 2.0**-20

    def fit(self, train: DataFrame, weight: str | None = None) -> MLP:
        names, p = self.features, self.params
        stats = train.agg(F.count(F.lit(1)), *[f(F.nanvl(F.col(c).cast("double"), F.lit(None))) for c in names for f in (F.min, F.max)]).first()
        n, ends = stats[0], np.array([x if x is not None else 0.0 for x in stats[1:]], float)
        self.low, self.span = ends[0::2], np.where(ends[1::2] > ends[0::2], ends[1::2] - ends[0::2], 1.0)
        sizes = [len(names), *p.get("hidden_layer_sizes", (100,)), self.classes]
        rng = np.random.default_rng(p.get("seed", 0))
        self.weights = [rng.uniform(-1, 1, (i + 1, o)) * np.sqrt(6 / (i + o)) for i, o in zip(sizes, sizes[1:])]
        if not n:
            return self
        batches = int(min(self.BATCHES, -(-n // p.get("batch_size", 200))))
        cols = [F.col(c).cast("double").alias(c) for c in names]
        data = train.select(*cols, F.col("label").cast("int").alias("label"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w_"))
        data = staged(data.withColumn("batch_", F.pmod(F.xxhash64(*names, "label"), F.lit(batches)).cast("int")).hint("rebalance"), "perceptron")  # few files where rows are few
        moment, square, steps, best, stale = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights], 0, np.inf, 0
        for _ in range(p.get("max_iter", 60)):
            loss = rows = 0.0
            for k in range(batches):
                gradient, total, some = self._gradient(data.filter(F.col("batch_") == k))
                if not some:
                    continue
                loss, rows, steps = loss + total, rows + some, steps + 1
                for i, g in enumerate(gradient):
                    g = g / some
                    g[:-1] += p.get("alpha", 1e-4) * self.weights[i][:-1] / some
                    moment[i], square[i] = 0.9 * moment[i] + 0.1 * g, 0.999 * square[i] + 0.001 * g * g
                    rate = p.get("learning_rate_init", 0.03) * np.sqrt(1 - 0.999**steps) / (1 - 0.9**steps)
                    self.weights[i] = self.weights[i] - rate * moment[i] / (np.sqrt(square[i]) + 1e-8)
            stale = 0 if loss / rows < best - p.get("tol", 1e-3) else stale + 1
            best = min(best, loss / rows)
            if stale >= p.get("n_iter_no_change", 8):
                break
        return self

    def _forward(self, x: np.ndarray) -> list[np.ndarray]:
        """The inputs of every layer, and last the probabilities."""
        out = [x]
        for i, w in enumerate(self.weights):
            z = out[-1] @ w[:-1] + w[-1]
            if i < len(self.weights) - 1:
                out.append(np.maximum(z, 0))
            else:
                e = np.exp(z - z.max(1, keepdims=True))
                out.append(e / e.sum(1, keepdims=True))
        return out

    def _gradient(self, rows: DataFrame) -> tuple[list[np.ndarray], float, float]:
        """Summed gradients of the layers, loss and weight of the rows."""
        me = self

        def part(batches):
            total = [np.zeros_like(w) for w in me.weights]
            loss = many = 0.0
            for rb in batches:
                x, y, w = _matrix(rb, me.features, me.low, me.span), rb.column("label").to_numpy(), np.rint(rb.column("w_").to_numpy() / me.ERROR) * me.ERROR
                for a in range(0, len(x), me.BLOCK):
                    n = len(x[a : a + me.BLOCK])
                    block = np.zeros((me.BLOCK, x.shape[1]))
                    block[:n] = x[a : a + n]
                    layers, one = me._forward(block), np.zeros((me.BLOCK, me.classes))
                    one[np.arange(n), y[a : a + n]] = 1
                    weight = np.zeros(me.BLOCK)
                    weight[:n] = w[a : a + n]
                    loss += float((np.rint(-np.log(np.maximum((layers[-1] * one).sum(1), 1e-12))[:n] * weight[:n] / me.ERROR) * me.ERROR).sum())
                    many += float(weight.sum())
                    error = (layers[-1] - one) * weight[:, None]
                    for i in range(len(me.weights) - 1, -1, -1):
                        error = np.rint(error / me.ERROR) * me.ERROR
                        inputs = np.rint(layers[i] / me.ACTIVATION) * me.ACTIVATION
                        total[i][:-1] += inputs.T @ error
                        total[i][-1] += error.sum(0)
                        error = (error @ me.weights[i][:-1].T) * (layers[i] > 0)
            sums = [*(t.tobytes() for t in total), np.array([loss, many]).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(sums, pa.binary())], ["c", "h"])

        got = {r["c"]: np.frombuffer(bytes(r["h"])) for r in rows.mapInArrow(part, "c int, h binary").groupBy("c").applyInArrow(added, "c int, h binary").collect()}  # as large as the model
        if not got:
            return [], 0.0, 0.0
        loss, many = got[len(self.weights)]
        return [got[i].reshape(w.shape).copy() for i, w in enumerate(self.weights)], float(loss), float(many)

    def state(self):
        return {"low": self.low.tolist(), "span": self.span.tolist(), "weights": [w.tolist() for w in self.weights]}

    def restore(self, state, spark, path):
        self.low, self.span, self.weights = np.array(state["low"]), np.array(state["span"]), [np.array(w) for w in state["weights"]]

    def predict_proba(self, px: DataFrame) -> DataFrame:
        return self.probabilities(px, px.columns)

    def probabilities(self, px: DataFrame, keys: Sequence[str]) -> DataFrame:
        me, carried = self, list(keys)

        def run(batches):
            for rb in batches:
                p = me._forward(_matrix(rb, me.features, me.low, me.span))[-1]
                prob = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, me.classes, dtype=np.int32)), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([*(rb.column(c) for c in carried), prob], [*carried, "prob"])

        return px.mapInArrow(run, T.StructType([*px.select(*carried).schema.fields, T.StructField("prob", T.ArrayType(T.DoubleType()))]))


class Ridge(Classifier):
    """One against the rest with targets -1 and 1; the scores of its classes, two of them included, stand for probabilities."""

    def fit(self, train: DataFrame, weight: str | None = None) -> Ridge:
        names, k = self.features, self.classes
        stats = train.agg(*[f(c) for c in names for f in (F.min, F.max)]).first()
        self.low = np.array(stats[0::2], float)
        span = np.array(stats[1::2], float) - self.low
        self.span = np.where(span > 0, span, 1.0)
        low, width = self.low, self.span
        d = len(names) + 1

        def part(batches):
            total = np.zeros((d, d + k))
            for rb in batches:
                x = np.stack([rb.column(c).to_numpy(zero_copy_only=False) for c in names], 1)
                x = np.hstack([np.nan_to_num((x - low) / width), np.ones((rb.num_rows, 1))])
                y = np.where(rb.column("label").to_numpy(zero_copy_only=False)[:, None] == np.arange(k), 1.0, -1.0)
                w = rb.column("w_").to_numpy(zero_copy_only=False)[:, None]
                total += (x * w).T @ np.hstack([x, y])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array([r.tobytes() for r in total], pa.binary())], ["i", "row"])

        def add(t: pa.Table) -> pa.Table:
            return pa.table({"i": t.column("i")[:1], "row": pa.array([np.sum([np.frombuffer(r) for r in t.column("row").to_pylist()], axis=0).tobytes()], pa.binary())})

        data = train.select(*[F.col(c).cast("double").alias(c) for c in names], "label", (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w_"))
        rows = data.mapInArrow(part, "i int, row binary").groupBy("i").applyInArrow(add, "i int, row binary").collect()  # as many as features
        g = np.zeros((d, d + k))
        for r in rows:
            g[r["i"]] = np.frombuffer(bytes(r["row"]))
        ridge = np.eye(d) * self.params.get("alpha", 1.0)
        ridge[-1, -1] = 1e-9
        self.coef = np.linalg.solve(g[:, :d] + ridge, g[:, d:])
        return self

    def state(self):
        return {"low": self.low.tolist(), "span": self.span.tolist(), "coef": self.coef.tolist()}

    def restore(self, state, spark, path):
        self.low, self.span, self.coef = (np.array(state[k]) for k in ("low", "span", "coef"))

    def predict_proba(self, px: DataFrame) -> DataFrame:
        scores = []
        for i in range(self.classes):
            s = F.lit(float(self.coef[-1, i]))
            for j, c in enumerate(self.features):
                s = s + F.lit(float(self.coef[j, i])) * F.nanvl((F.col(c).cast("double") - F.lit(float(self.low[j]))) / F.lit(float(self.span[j])), F.lit(0.0))
            scores.append(s)
        return px.select(*px.columns, F.array(*scores).alias("prob"))


class Boosted(Classifier):
    """Newton boosting; classes are 0-based throughout."""

    def fit(self, train: DataFrame, weight: str | None = None) -> Boosted:
        p = self.params
        self.model = Booster(self.features, self.classes, p.get("learning_rate", 0.3), p.get("max_depth", 3), p.get("reg_lambda", 1.0), p.get("bins", 32))
        self.model.fit(train, p.get("n_estimators", 10), weight)
        return self

    def predict_proba(self, px: DataFrame) -> DataFrame:
        return self.model.predict_proba(px)

    def probabilities(self, px: DataFrame, keys: Sequence[str]) -> DataFrame:
        return self.model.predict_proba(px, keys)

    def state(self):
        return {"booster": self.model.state()}

    def restore(self, state, spark, path):
        self.model = Booster.of(state["booster"])


REGISTRY: dict[str, type[Classifier]] = {
    "random_forest": RandomForest, "logistic_regression": Logistic, "linear_regression": Ridge, "mlp": MLP, "xgb": Boosted,
}


def get_model(name: str, features: Sequence[str], classes: int, params: dict[str, Any] | None = None) -> Classifier:
    if name not in REGISTRY:
        raise ValueError(f"unknown classifier {name}; there are {', '.join(REGISTRY)}")
    return REGISTRY[name](features, classes, **(params or {}))


def known_kinds() -> dict[str, type[Classifier]]:
    """All classes of classifiers by name, a caller's own among them."""
    found, todo = {}, [Classifier]
    while todo:
        kind = todo.pop()
        found[kind.__name__] = kind
        todo += kind.__subclasses__()
    return found


def load_classifier(spark: SparkSession, path: str) -> Classifier:
    """What ``save`` wrote, of whatever kind it is."""
    from . import expert  # noqa: F401  a kind of its own

    about = json.loads(read_text(spark, f"{path}/about"))
    kinds = known_kinds()
    if about["kind"] not in kinds:
        raise ValueError(f"unknown classifier {about['kind']}")
    out = kinds[about["kind"]](about["features"], classes=about["classes"], **about["params"])
    out.restore(about["state"], spark, path)
    return out


def train(model: Classifier, data: DataFrame, balanced: bool = False) -> Classifier:
    """Fit, with balanced class weights if asked for."""
    if balanced:
        data = data.join(F.broadcast(L.class_weights(data).select("label", "weight")), "label")  # one row a class
    return model.fit(data, "weight" if balanced else None)


def apply(model: Classifier, features: DataFrame) -> DataFrame:
    """(img, y, x, prob, seg); only what the model reads goes through it."""
    out = model.probabilities(features.select(*KEYS, *model.features), KEYS)
    return out.select(*KEYS, "prob", L.argmax(F.col("prob")).alias("seg"))
