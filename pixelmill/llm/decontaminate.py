"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of e is split into e + 1 pieces; a text within e edits of the item holds at
least one piece unchanged. Rolling hashes of all places of a text are looked up among the pieces' beginnings, hits are
compared character by character, and around every exact piece the item is verified with Myers' bit-parallel edit distance.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K

#: Edits allowed, as a share of an item's length; the shortest piece; characters of test items to a block (a pass over the texts).
BUDGET, PIECE, BLOCK = 0.08, 10, 1 << 24

#: Lower case where it is one character; the Greek final s as any other, which has the same capital.
_FOLD = {i: ord(c) for i in range(sys.maxunicode + 1) if len(c := chr(i).lower()) == 1 and ord(c) != i} | {i: 32 for i in range(9, 14)} | {0x3C2: 0x3C3}
_FOLDED = np.arange(sys.maxunicode + 1, dtype=np.uint32)
_FOLDED[list(_FOLD)] = list(_FOLD.values())
_SYMBOL = K.mix(_FOLDED.astype(np.uint64) + K.U(1))


def fold(text: str | None) -> str:
    """Characters in lower case, and each of the characters 9 to 13 a space; places stay the same."""
    return (text or "").translate(_FOLD)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def budget(length: int, share: float = BUDGET) -> int:
    """Edits allowed for an item: as the share says, but no more than leaves pieces of ``PIECE`` characters."""
    return max(0, min(math.floor(length * share), length // PIECE - 1))


def masks(pattern) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def best_end(pattern, peq: dict[int, int], text, most: int) -> tuple[int, int] | None:
    """Least distance of ``pattern`` to a substring of ``text``, and the first end where it is reached; None above ``most``."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = most + 1, -1
    get = peq.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full  # a match may start anywhere: no cost before the first character
        mh = mh << 1 & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
            if not best:
                break
    return (best, end) if best <= most else None


class Items:
    """The test items of a block: (item_id, text) rows, their pieces by the hash of their first characters."""

    def __init__(self, rows: list[tuple[int | None, str]], share: float):
        self.ids, self.codes, self.budgets = [], [], []
        found: dict[int, list[tuple[int, int, int, int]]] = {}  # characters hashed: (hash, item, offset, length)
        for item_id, text in rows:
            t = fold(text).strip()
            if not t:
                continue
            e, i, codes = budget(len(t), share), len(self.ids), codes_of(t)
            self.ids.append(item_id)
            self.codes.append(codes)
            self.budgets.append(e)
            cut = len(t) * np.arange(e + 2) // (e + 1)
            roll = K.Rolling(_SYMBOL[codes])
            size = np.diff(cut)
            for k in np.unique(np.minimum(size, PIECE)).tolist():
                mine = np.minimum(size, PIECE) == k
                grams = roll.grams(k)[cut[:-1][mine]]
                found.setdefault(k, []).append((grams, np.full(len(grams), i), cut[:-1][mine], size[mine]))
        self.starts = np.cumsum([0, *map(len, self.codes)])
        self.flat = np.concatenate(self.codes) if self.codes else np.zeros(0, np.uint32)
        self.tables = []
        for k, parts in found.items():
            grams, item, offset, size = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(grams, kind="stable")
            keys, first = np.unique(grams[order], return_index=True)
            bits = max(16, int(len(keys) * 16).bit_length())
            seen = np.zeros(1 << bits, bool)
            seen[keys >> K.U(64 - bits)] = True
            self.tables.append((k, keys, np.append(first, len(grams)), seen, K.U(64 - bits), item[order], offset[order], size[order]))
        self._masks: dict[int, tuple[dict, dict]] = {}

    def hits(self, codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every exact place of a piece: its row, its item, and where the item would start; rows follow each other in ``codes``."""
        out = []
        for k, keys, first, seen, shift, item, offset, size in self.tables:
            for a, b in K.row_chunks(offsets, k):
                if b - a < k:
                    continue
                grams = K.Rolling(_SYMBOL[codes[a:b]]).grams(k)
                at = np.flatnonzero(seen[grams >> shift])
                key = np.minimum(np.searchsorted(keys, grams[at]), len(keys) - 1)
                same = keys[key] == grams[at]
                at, key = at[same] + a, key[same]
                n = first[key + 1] - first[key]
                piece = np.repeat(first[key] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                at = np.repeat(at, n)
                row = np.searchsorted(offsets, at, "right") - 1
                fits = at + size[piece] <= offsets[row + 1]
                at, row, piece = at[fits], row[fits], piece[fits]
                if len(at):
                    theirs = self.starts[item[piece]] + offset[piece]
                    differ = K.gather(_FOLDED[codes[a : b + int(size[piece].max())]], at - a, size[piece]) != K.gather(self.flat, theirs, size[piece])
                    exact = np.add.reduceat(differ, np.cumsum(size[piece]) - size[piece]) == 0
                    out.append((row[exact], item[piece][exact], (at - offset[piece])[exact]))
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out))

    def find(self, codes: np.ndarray, offsets: np.ndarray, first_only: bool = False):
        """(row, item_id, distance, start, end) of the best match of each item in each row; of equal ones that which ends first.

        ``codes``: characters of the rows, not folded; ``first_only``: one match of a row is enough.
        """
        row, item, begin = self.hits(codes, offsets)
        order = np.lexsort((begin, item, row))
        row, item, begin = row[order].tolist(), item[order].tolist(), begin[order].tolist()
        i, done = 0, -1
        while i < len(row):
            j = i
            while j < len(row) and row[j] == row[i] and item[j] == item[i]:
                j += 1
            r, k = row[i], item[i]
            if not (first_only and done == r):
                got = self._best(codes, int(offsets[r]), int(offsets[r + 1]), k, begin[i:j])
                if got:
                    done = r
                    yield r, self.ids[k], *got
            i = j

    def _best(self, codes, lo: int, hi: int, k: int, begins: list[int]):
        t, e = self.codes[k], self.budgets[k]
        if k not in self._masks:
            p = t.tolist()
            self._masks[k] = p, masks(p), masks(p[::-1])
        p, peq, back = self._masks[k]
        best = None
        for a, b in _joined([(max(lo, x - e), min(hi, x + len(p) + e)) for x in begins]):
            got = best_end(p, peq, _FOLDED[codes[a:b]].tolist(), e if best is None else best[0] - 1)
            if got:
                best = got[0], a + got[1]
                if not best[0]:
                    break
        if not best:
            return None
        d, end = best
        start = end - best_start(p, back, _FOLDED[codes[max(lo, end - len(p) - d) : end]].tolist()[::-1], d)
        return d, start - lo, end - lo


def characters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The characters of a string column, rows after each other, and their offsets; null is empty."""
    raw, offsets = K.text_buffer(column)
    heads = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return codes_of(raw.tobytes().decode("utf-8", "surrogatepass")), heads[offsets]


def best_start(pattern, back: dict[int, int], reverse, d: int) -> int:
    """Shortest length of a prefix of ``reverse`` that is at distance d of the reversed pattern, both from their start."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    if score == d:
        return 0
    for j, c in enumerate(reverse):
        eq = back.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1 | 1) & full  # both start together: every character skipped costs one
        mh = mh << 1 & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score == d:
            return j + 1
    return len(reverse)


def _joined(spans: list[tuple[int, int]]):
    """Overlapping ranges made one, so that no stretch is verified twice."""
    at, end = spans[0]
    for a, b in spans[1:]:
        if a <= end:
            end = max(end, b)
        else:
            yield at, end
            at, end = a, b
    yield at, end


def _blocks(benchmark: DataFrame, block: int) -> list[list[tuple[int | None, str]]]:
    """The items in blocks of about ``block`` characters; a block at a time is on the driver."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    n = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // block))
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        yield sorted(((r["item_id"], r["text"]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def matches(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, share: float = BUDGET, block: int = BLOCK) -> DataFrame:
    """(row_id, doc_id, item_id, distance, start, end): for each row of ``docs`` and each item within its budget, the best match.

    Texts are compared after ``fold``; items are stripped, empty or null items match nothing, nor do empty or null texts. An item
    may differ in ``share`` of its characters, as far as pieces of ``PIECE`` characters allow: items below 50 characters in
    less, those below 20 in none.
    start and end count characters of the text; of equally near places the one that ends first is given, and of its
    starts the last. Test items are handled in blocks of about ``block`` characters, each sent to all executors, and each a pass
    over the texts. A null item_id stays null; repeated items and rows are matched on their own; other columns are not used.
    """
    out = None
    for rows in _blocks(benchmark, block):
        found = _matches(spark, docs, rows, share)
        out = found if out is None else out.unionByName(found)
    return out


_FOUND = "row_id long, doc_id long, item_id long, distance int, start long, end long"


def _matches(spark: SparkSession, docs: DataFrame, rows: list, share: float) -> DataFrame:
    sent = spark.sparkContext.broadcast(Items(rows, share))

    def run(batches):
        from pyspark import TaskContext

        items, row = sent.value, TaskContext.get().partitionId() << 40
        for whole in batches:
            for rb in K.text_slices(whole):
                ids = rb.column("doc_id")
                out = [(row + r, ids[r].as_py(), *found) for r, *found in items.find(*characters(rb.column("text")))]
                row += rb.num_rows
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)], _NAMES)

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, _FOUND)


_NAMES = ["row_id", "doc_id", "item_id", "distance", "start", "end"]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, share: float = BUDGET, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, that hold no item within its budget. The rules of ``matches`` hold."""
    for rows in _blocks(benchmark, block):
        docs = _without(spark, docs, rows, share)
    return docs


def _without(spark: SparkSession, docs: DataFrame, rows: list, share: float) -> DataFrame:
    sent = spark.sparkContext.broadcast(Items(rows, share))

    def run(batches):
        for whole in batches:
            for rb in K.text_slices(whole):
                keep = np.ones(rb.num_rows, bool)
                for r, *_ in sent.value.find(*characters(rb.column("text")), first_only=True):
                    keep[r] = False
                yield rb.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All (doc_id, item_id) of documents that hold a benchmark item, with the distance and place of the best match."""
    found = matches(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "distance", "start", "end")  # nothing is staged: one pass
