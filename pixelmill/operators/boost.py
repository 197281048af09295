"""Newton boosting with histograms: trees on first and second derivatives, which callers may extend.

Rows are cut to bins, a byte a feature, once; the bins' edges come from a sketch of the values' leading digits, weighted by the second
derivatives that rows start with. A level of trees is a job: sums within and then over partitions, of every second node only, as a node's sums are its
parent's less its sibling's. Derivatives are rounded to ``GRID``, so their sums are exact and the trees the same however rows are dealt.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.forest import bins_of, mask_of, pick
from ..sources.shared import staged

#: Rounds after which margins are written anew; steps to which derivatives are rounded (2**33 of them add up exactly); the bin of missing values.
KEEP, GRID, MISSING = 8, 2.0**-20, 255


def rounded(v: np.ndarray) -> np.ndarray:
    return np.rint(v / GRID) * GRID


def keys_of(x: np.ndarray) -> np.ndarray:
    """Numbers of 32 bits in the order of the values, as single precision has them."""
    with np.errstate(over="ignore"):
        u = (x.astype(np.float32) + np.float32(0)).view(np.uint32)
    return np.where(u >> 31, ~u, u | np.uint32(1 << 31)).astype(np.int64)


def value_of(key: np.ndarray) -> np.ndarray:
    u = np.asarray(key, np.uint32)
    return np.where(u >> 31, u & np.uint32((1 << 31) - 1), ~u).astype(np.uint32).view(np.float32).astype(float)


def quantile_edges(rows: DataFrame, features: Sequence[str], weight: str, bins: int) -> np.ndarray:
    """(features, bins - 1): for each feature the values that cut its weight in equal parts, rounded up to 24 bits of single precision.

    Three rounds narrow down eight bits each. A round's sums are 256 for each rank that is sought, whatever the number of rows, and add
    up exactly, so edges do not depend on how rows are dealt. Missing values do not count; a feature without values has zeros.
    """
    names = list(features)
    ranks, before, found = None, np.zeros((len(names), bins - 1)), np.zeros((len(names), bins - 1), np.int64)
    for digit in range(3):
        up, known = 24 - 8 * digit, [np.unique(f) for f in found]

        def part(batches, up=up, known=known):
            out = [np.zeros(256 * len(k)) for k in known]
            for rb in batches:
                w = rounded(rb.column(weight).to_numpy(zero_copy_only=False))
                for j, c in enumerate(names):
                    x = rb.column(c).to_numpy(zero_copy_only=False).astype(float)
                    key = keys_of(x)
                    at = np.minimum(np.searchsorted(known[j], key >> (up + 8)), len(known[j]) - 1)
                    mine = (known[j][at] == key >> (up + 8)) & ~np.isnan(x)
                    out[j] += np.bincount(at[mine] * 256 + (key[mine] >> up & 255), w[mine], len(out[j]))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(names), dtype=np.int32)), pa.array([o.tobytes() for o in out], pa.binary())], ["c", "h"])

        sums = {r["c"]: np.frombuffer(bytes(r["h"])).reshape(-1, 256) for r in rows.mapInArrow(part, "c int, h binary").groupBy("c").applyInArrow(added, "c int, h binary").collect()}
        if ranks is None:
            ranks = np.array([np.arange(1, bins) / bins * (sums[j].sum() if j in sums else 0) for j in range(len(names))])
        for j in sums:
            total = np.cumsum(sums[j], 1)
            for i, k in enumerate(np.searchsorted(known[j], found[j])):
                b = min(int(np.searchsorted(before[j, i] + total[k], ranks[j, i])), 255)
                before[j, i] += total[k, b] - sums[j][k, b]
                found[j, i] = found[j, i] << 8 | b
    return np.array([value_of(f << 8 | 255) if r.any() else np.zeros(bins - 1) for f, r in zip(found, ranks)]).reshape(len(names), bins - 1)


def added(t: pa.Table) -> pa.Table:
    """Sums of binary rows of doubles."""
    return pa.table({"c": t.column("c")[:1], "h": pa.array([np.sum([np.frombuffer(x) for x in t.column("h").to_pylist()], axis=0).tobytes()], pa.binary())})


def _softmax(m: np.ndarray) -> np.ndarray:
    e = np.exp(m - m.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class Tree:
    """A tree of full depth: ``feature`` and ``cut`` of inner nodes (rows with bin <= cut go left, missing values where ``missing`` says), ``value`` of leaves."""

    def __init__(self, depth: int):
        self.depth = depth
        self.feature, self.cut, self.missing = np.zeros(2**depth - 1, int), np.full(2**depth - 1, MISSING), np.zeros(2**depth - 1, bool)
        self.value = np.zeros(2**depth)

    def node(self, bins: np.ndarray, level: int) -> np.ndarray:
        """For each row the node of a level, counted from 0. ``bins``: a row of bytes for each feature.

        Every inner node's test runs over all rows, byte by byte; from the last level up, each node keeps the answer of the side it takes.
        """
        if not level:
            return np.zeros(bins.shape[1], np.uint8)
        tests = zip(*(a[: 2**level - 1].tolist() for a in (self.feature, self.cut, self.missing)))
        right = [(bins[f] > c) & (bins[f] != MISSING) if left else bins[f] > c for f, c, left in tests]
        below = [right[2 ** (level - 1) - 1 + k].view(np.uint8) for k in range(2 ** (level - 1))]
        for d in range(level - 2, -1, -1):
            step = np.uint8(2 ** (level - 1 - d))
            below = [pick(below[2 * k], below[2 * k + 1] + step, mask_of(right[2**d - 1 + k], np.uint8)) for k in range(2**d)]
        return below[0]

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.node(bins, self.depth)]

    def state(self) -> dict:
        return {"feature": self.feature.tolist(), "cut": self.cut.tolist(), "missing": self.missing.tolist(), "value": self.value.tolist()}

    @classmethod
    def of(cls, depth: int, state: dict) -> Tree:
        t = cls(depth)
        t.feature, t.cut, t.value = (np.array(state[k]) for k in ("feature", "cut", "value"))
        t.missing = np.array(state.get("missing", [False] * len(t.feature)), bool)
        return t


class Booster:
    """A tree for each class and round. What reaches the driver is nodes x features x bins, whatever the number of rows."""

    def __init__(self, features: Sequence[str], classes: int, rate: float = 0.3, depth: int = 3, penalty: float = 1.0, bins: int = 32):
        if not 1 <= depth <= 8 or not 2 <= bins <= MISSING:
            raise ValueError("trees have 1 to 8 levels and 2 to 255 bins")
        self.features, self.classes, self.rate, self.depth, self.penalty, self.bins = list(features), classes, rate, depth, penalty, bins
        self.rounds: list[list[Tree]] = []
        self.edges: np.ndarray | None = None

    def _binned(self, rb: pa.RecordBatch | pa.Table) -> np.ndarray:
        """A row of bytes for each feature."""
        out = np.empty((len(self.features), rb.num_rows), np.uint8)
        for j, c in enumerate(self.features):
            x = rb.column(c).to_numpy(zero_copy_only=False)
            x = x if x.dtype.kind == "f" else x.astype(float)
            out[j] = bins_of(x, self.edges[j])
            out[j][np.isnan(x)] = MISSING
        return out

    def margin(self, bins: np.ndarray, since: int = 0) -> np.ndarray:
        """Sums of all trees from the round ``since`` on."""
        m = np.zeros((self.classes, bins.shape[1]))
        for a in range(0, bins.shape[1], 1 << 15):  # a block's bins stay in the cache for all trees
            part = np.ascontiguousarray(bins[:, a : a + (1 << 15)])
            for trees in self.rounds[since:]:
                for k, t in enumerate(trees):
                    m[k, a : a + (1 << 15)] += np.take(self.rate * t.value, t.node(part, self.depth))
        return np.ascontiguousarray(m.T)

    def fit(self, train: DataFrame, rounds: int, weight: str | None = None, extra: Callable[[Booster], DataFrame | None] | None = None) -> Booster:
        """``extra(self)`` may give (img, y, x, grad array) to be added to the first derivatives of the round. Null features count as missing."""
        keys = ["img", "y", "x"] if extra else []
        cols = [F.col(c).cast("double").alias(c) for c in self.features]
        rows = train.select(*keys, *cols, F.col("label").cast("int").alias("label"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w_"))
        if not rows.head(1):
            return self
        if self.edges is None:
            self.edges = quantile_edges(rows, self.features, "w_", self.bins)
        data, since = self._keep(rows, keys, None, 0), len(self.rounds)
        for _ in range(rounds):
            more = extra(self) if extra else None
            self._round(data if more is None else data.join(more.withColumnRenamed("grad", "more_"), keys), since)
            if len(self.rounds) - since >= KEEP:
                data, since = self._keep(data, keys, since, len(self.rounds)), len(self.rounds)
        return self

    def _derivatives(self, margin: np.ndarray, y: np.ndarray, w: np.ndarray, more: np.ndarray | None):
        """(g, h) of each class."""
        p = _softmax(margin)
        for c in range(self.classes):
            g = w * (p[:, c] - (y == c))
            yield rounded(g if more is None else g + more[:, c]), np.maximum(rounded(w * 2 * p[:, c] * (1 - p[:, c])), GRID)

    def _histogram(self, tree: Tree, bins: np.ndarray, level: int, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """(nodes, features, bins and missing, 2): sums of g and h; of a level below the first the left nodes only."""
        node, n_b = tree.node(bins, level).astype(np.int64), self.bins + 1
        if level:
            left = np.flatnonzero(node % 2 == 0)
            node, bins, g, h = node[left] >> 1, bins[:, left], g[left], h[left]
        nodes = max(1, 2 ** (level - 1))
        out = np.empty((nodes, len(bins), n_b, 2))
        for j, b in enumerate(bins):
            at = node * n_b + np.minimum(b, self.bins)
            for i, v in enumerate((g, h)):
                out[:, j, :, i] = np.bincount(at, v, minlength=nodes * n_b).reshape(nodes, n_b)
        return out

    def _grow(self, tree: Tree, level: int, h: np.ndarray) -> None:
        """Split the nodes of a level, missing values to the side where they serve best; the histograms of the last one give the leaves as well."""
        below, missing, whole = np.cumsum(h[:, :, :-1], axis=2), h[:, :, -1:], h.sum(2)[:, :, None]
        left = np.stack([below, below + missing], 2)  # nodes, features, side of the missing, cuts, sums
        whole = whole[:, :, None]
        gain = lambda x: x[..., 0] ** 2 / (x[..., 1] + self.penalty)
        g = gain(left) + gain(whole - left) - gain(whole)
        for n in range(len(h)):
            f, m, b = np.unravel_index(int(g[n].argmax()), g[n].shape)
            k = 2**level - 1 + n
            sides = [h[n, 0].sum(0), np.zeros(2)]
            if g[n, f, m, b] > 1e-9:
                tree.feature[k], tree.cut[k], tree.missing[k] = f, b, bool(m)
                sides = [left[n, f, m, b], whole[n, f, 0, 0] - left[n, f, m, b]]
            if level == self.depth - 1:
                tree.value[2 * n : 2 * n + 2] = [-s[0] / (s[1] + self.penalty) for s in sides]

    def _keep(self, rows: DataFrame, keys: list[str], since: int | None, upto: int) -> DataFrame:
        """(keys, label, w_, bins, margin), written: bins of new rows, margins with all trees so far."""
        me = self

        def run(batches):
            for rb in batches:
                if since is None:
                    bins = me._binned(rb)
                    margin = me.margin(bins)
                else:
                    bins, margin = me._unpacked(rb)
                    margin = margin + me.margin(bins, since)
                packed = [pa.array([x.tobytes() for x in a], pa.binary()) for a in (np.ascontiguousarray(bins.T), margin)]
                yield pa.RecordBatch.from_arrays([*(rb.column(k) for k in keys), rb.column("label"), rb.column("w_"), *packed], [*keys, "label", "w_", "bins", "margin"])

        kinds = [f for f in rows.select(*keys).schema.fields]
        schema = T.StructType([*kinds, T.StructField("label", T.IntegerType()), T.StructField("w_", T.DoubleType()), T.StructField("bins", T.BinaryType()), T.StructField("margin", T.BinaryType())])
        return staged(rows.mapInArrow(run, schema), f"boost{upto}")

    def _unpacked(self, rb: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        n = rb.num_rows
        bins = np.frombuffer(b"".join(rb.column("bins").to_pylist()), np.uint8).reshape(n, -1)
        return np.ascontiguousarray(bins.T), np.frombuffer(b"".join(rb.column("margin").to_pylist())).reshape(n, self.classes)

    def _round(self, data: DataFrame, since: int) -> None:
        """A tree for each class; a job for each level."""
        trees = [Tree(self.depth) for _ in range(self.classes)]
        more = F.col("more_") if "more_" in data.columns else F.array(*[F.lit(0.0)] * self.classes)
        rows = data.select("label", "w_", "bins", "margin", more.alias("more_"))
        above = None
        for level in range(self.depth):
            found = self._histograms(rows, trees, level, since)
            if level:  # the right node has what the left one leaves of their parent
                found = np.stack([found, above - found], 2).reshape(self.classes, 2**level, *found.shape[2:])
            for t, h in zip(trees, found):
                self._grow(t, level, h)
            above = found
        self.rounds.append(trees)

    def _histograms(self, rows: DataFrame, trees: list[Tree], level: int, since: int) -> np.ndarray:
        n_f, n_b, k, nodes = len(self.features), self.bins + 1, self.classes, max(1, 2 ** (level - 1))
        me = self

        def part(batches):
            out = np.zeros((k, nodes, n_f, n_b, 2))
            for rb in batches:
                if not rb.num_rows:
                    continue
                bins, margin = me._unpacked(rb)
                more = rb.column("more_").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                numbers = [rb.column(c).to_numpy(zero_copy_only=False) for c in ("label", "w_")]
                for c, (g, h) in enumerate(me._derivatives(margin + me.margin(bins, since), *numbers, more)):
                    out[c] += me._histogram(trees[c], bins, level, g, h)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array([x.tobytes() for x in out], pa.binary())], ["c", "h"])

        out = np.zeros((k, nodes, n_f, n_b, 2))
        for r in rows.mapInArrow(part, "c int, h binary").groupBy("c").applyInArrow(added, "c int, h binary").collect():
            out[r["c"]] = np.frombuffer(bytes(r["h"])).reshape(nodes, n_f, n_b, 2)
        return out

    def predict_proba(self, px: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
        """All columns, or only the ``keys``, and ``prob``."""
        me, carried = self, list(px.columns if keys is None else keys)

        def run(batches):
            for rb in batches:
                p = _softmax(me.margin(me._binned(rb)))
                prob = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, me.classes, dtype=np.int32)), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([*(rb.column(c) for c in carried), prob], [*carried, "prob"])

        return px.mapInArrow(run, T.StructType([*px.select(*carried).schema.fields, T.StructField("prob", T.ArrayType(T.DoubleType()))]))

    def state(self) -> dict:
        return {
            "features": self.features, "classes": self.classes, "rate": self.rate, "depth": self.depth, "penalty": self.penalty, "bins": self.bins,
            "edges": None if self.edges is None else self.edges.tolist(), "rounds": [[t.state() for t in r] for r in self.rounds],
        }

    @classmethod
    def of(cls, state: dict) -> Booster:
        out = cls(*(state[k] for k in ("features", "classes", "rate", "depth", "penalty", "bins")))
        out.edges = None if state["edges"] is None else np.array(state["edges"])
        out.rounds = [[Tree.of(out.depth, t) for t in r] for r in state["rounds"]]
        return out
