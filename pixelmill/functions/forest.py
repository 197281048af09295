"""Decision trees applied to many rows at once: features become bins of a byte, and the answers of all inner nodes are folded into
leaf numbers by bitwise steps over whole columns."""

from __future__ import annotations

import numpy as np


def bins_of(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """For each value the number of ``edges`` (rising) below it; NaN is above all. A byte each, or two beyond 255 edges."""
    edges = np.asarray(edges, float)
    if x.dtype == np.float32:  # the same answers as in double precision: each edge becomes the greatest float not above it
        near = edges.astype(np.float32)
        edges = np.where(near.astype(float) > edges, np.nextafter(near, np.float32(-np.inf)), near)
    out = np.zeros(len(x), np.uint8 if len(edges) < 256 else np.uint16)
    hit = np.empty(len(x), bool)
    for e in edges:
        np.less_equal(x, e, out=hit)
        out += ~hit
    return out


def pick(left: np.ndarray | int, right: np.ndarray | int, mask: np.ndarray) -> np.ndarray:
    """``right`` where all bits of ``mask`` are set, ``left`` where none is."""
    return ((left ^ right) & mask) ^ left


def mask_of(right: np.ndarray, kind: type) -> np.ndarray:
    """All bits set where true."""
    return np.negative(right.view(np.uint8)) if kind == np.uint8 else np.negative(right.astype(kind))


class Forest:
    """Trees with inner nodes (feature, cut: bins above go right) and leaves with class probabilities; their mean is the answer."""

    def __init__(self, edges: list[np.ndarray], trees: list[dict]):
        #: each tree: feature, cut, left, right (numbers of nodes, or -1 - leaf) of its inner nodes, root first, and prob (leaves, classes)
        self.edges, self.trees = edges, trees

    @classmethod
    def of_nodes(cls, features: int, nodes: list[tuple]) -> Forest:
        """From (tree, node, feature, threshold, left, right, weights of the classes) rows; ``left`` below 0 tells a leaf."""
        cuts: list[set] = [set() for _ in range(features)]
        by: dict[int, dict[int, tuple]] = {}
        for tree, node, f, t, left, right, weights in nodes:
            by.setdefault(tree, {})[node] = (f, t, left, right, weights)
            if left >= 0:
                cuts[f].add(t)
        edges = [np.array(sorted(c)) for c in cuts]
        trees = []
        for _, rows in sorted(by.items()):
            inner = [n for n in sorted(rows) if rows[n][2] >= 0]
            leaves = [n for n in sorted(rows) if rows[n][2] < 0]
            at = {n: i for i, n in enumerate(inner)} | {n: -1 - i for i, n in enumerate(leaves)}
            weights = np.array([rows[n][4] for n in leaves], float)
            trees.append({
                "feature": [rows[n][0] for n in inner], "cut": [int(np.searchsorted(edges[rows[n][0]], rows[n][1])) for n in inner],
                "left": [at[rows[n][2]] for n in inner], "right": [at[rows[n][3]] for n in inner], "prob": weights / weights.sum(1, keepdims=True),
            })
        return cls(edges, trees)

    def predict_proba(self, columns: list[np.ndarray], block: int = 1 << 15) -> np.ndarray:
        """(rows, classes) from a column for each feature."""
        n, k = len(columns[0]), self.trees[0]["prob"].shape[1]
        used = sorted({f for t in self.trees for f in t["feature"]})
        out = np.empty((n, k))
        for a in range(0, n, block):
            bins = {f: bins_of(columns[f][a : a + block], self.edges[f]) for f in used}
            total = np.zeros((k, min(block, n - a)))
            for t in self.trees:
                leaf = self._leaves(t, bins, total.shape[1])
                for c in range(k):
                    total[c] += np.take(t["prob"][:, c], leaf)
            out[a : a + block] = total.T
        return out / len(self.trees)

    @staticmethod
    def _leaves(t: dict, bins: dict[int, np.ndarray], n: int) -> np.ndarray:
        if not t["feature"]:
            return np.zeros(n, np.uint8)
        kind = np.uint8 if len(t["prob"]) <= 256 else np.uint16 if len(t["prob"]) <= 1 << 16 else np.uint32
        found: list = [None] * len(t["feature"])
        for i in range(len(found) - 1, -1, -1):  # children have greater numbers
            left, right = (found[j] if j >= 0 else kind(-1 - j) for j in (t["left"][i], t["right"][i]))
            found[i] = pick(left, right, mask_of(bins[t["feature"][i]] > t["cut"][i], kind))
            for j in (t["left"][i], t["right"][i]):
                if j >= 0:
                    found[j] = None
        return found[0]
