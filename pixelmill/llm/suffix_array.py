"""Suffix-array dedup: bytes that an earlier document already holds.

An enhanced suffix array (suffixes in order, lengths of common prefixes with the neighbour) is built
over the segments of a bucket; a stack scan of the prefix lengths yields the interval tree. An
interval whose common prefix has at least ``length`` bytes is a repeat; it is maximal if the bytes
before its occurrences differ. ``index`` derives what is removed from these groups with all their occurrences.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from . import repeats as R
from .scratch import Scratch, result


def _big_endian_words(raw: np.ndarray, at: np.ndarray, size: np.ndarray, depth: int) -> list[np.ndarray]:
    """The bytes raw[at : at + min(size, depth)] as big-endian 64-bit numbers, padded with zeros."""
    padded = np.zeros(len(raw) + depth + 8, np.uint8)
    padded[: len(raw)] = raw
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    out = []
    for k in range(0, depth, 8):
        word = np.ascontiguousarray(eight[at + k]).view(">u8").ravel().astype(np.uint64)
        left = np.clip(np.minimum(size, depth) - k, 0, 8)
        bits = ((8 - left) * 8).astype(np.uint64)
        mask = np.where(left == 0, K.U(0), K.U(0xFFFFFFFFFFFFFFFF) << np.minimum(bits, K.U(63)))
        out.append(word & mask)
    return out


class EnhancedSuffixArray:
    """Suffixes ``raw[at : at + size]`` in order, compared to ``depth`` bytes."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, size: np.ndarray, depth: int):
        keys = _big_endian_words(raw, at, size, depth)
        self.order = np.lexsort((size, *keys[::-1]))
        size = np.minimum(size, depth)[self.order]
        lcp, open_ = np.zeros(len(at), np.int64), np.ones(max(len(at) - 1, 0), bool)
        for k in keys:
            s = k[self.order]
            x = s[1:] ^ s[:-1]
            same = np.full(len(x), 8, np.int64)
            differs = x != 0
            _, exponent = np.frexp((x[differs] >> K.U(11)).astype(np.float64))
            small = (x[differs] >> K.U(11)) == 0
            high = np.where(small, np.where(x[differs] < K.U(256), 8, 11), exponent + 11)  # a position at or above the highest set bit, exact to the byte
            same[differs] = (64 - high) // 8
            lcp[1:] += np.where(open_, same, 0)
            open_ &= ~differs
        lcp[1:] = np.minimum(lcp[1:], np.minimum(size[1:], size[:-1]))
        #: lcp[i]: common prefix of suffixes i - 1 and i in order
        self.lcp, self.depth = lcp, depth

    def intervals(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Stack scan: common prefix, first and last place of every node of the interval tree of at least ``length``.

        Stretches in which all neighbours share the same number of bytes are one node each; the others are scanned.
        """
        n = len(self.lcp)
        head = self.lcp < length
        head[:1] = True
        first = np.flatnonzero(head)
        last = np.append(first[1:], n) - 1
        some = last > first
        first, last = first[some], last[some]
        if not len(first):
            return first, first, first
        low, high = self.lcp.copy(), self.lcp.copy()
        low[head], high[head] = np.iinfo(np.int64).max, -1
        low, high = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
        even = low == high
        found = [(low[even], first[even], last[even])]
        depths, starts, ends = [], [], []
        for a, b in zip(first[~even].tolist(), last[~even].tolist()):
            stack: list[tuple[int, int]] = []
            for i, v in enumerate([*self.lcp[a + 1 : b + 1].tolist(), -1], a + 1):
                left = i - 1
                while stack and stack[-1][0] > v:
                    depth, left = stack.pop()
                    depths.append(depth)
                    starts.append(left)
                    ends.append(i - 1)
                if v >= length and (not stack or stack[-1][0] < v):
                    stack.append((v, left))
        found.append((np.array(depths, np.int64), np.array(starts, np.int64), np.array(ends, np.int64)))
        return tuple(np.concatenate(x) for x in zip(*found))

    def maximal(self, length: int, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Those intervals before whose occurrences not always the same byte stands (255: nothing that is known to be the same)."""
        depth, i, j = self.intervals(length)
        b = before[self.order]
        changes = np.cumsum(np.append(False, (b[1:] != b[:-1]) | (b[1:] == 255)))
        diverse = changes[j] != changes[i]
        return depth[diverse], i[diverse], j[diverse]


def expand(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... of ``sizes[i]`` numbers each, after one another."""
    return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def index(e: R.Entries, ids: np.ndarray, length: int) -> None:
    """Smallest document of each window, from the maximal repeat groups of at least ``length`` bytes among some entries.

    Where a window repeats, the window before repeats too, unless the bytes before differ or an entry starts there; so the
    maximal repeats cover all that repeats. Intervals at ``length`` under which nothing differs to the left hold none and are
    left out before the full array is built.
    """
    own, j = e.windows(ids)
    at = e.at[ids][own] + j
    before = np.where(j == 0, 255, e.raw[np.maximum(at - 1, 0)]).astype(np.uint8)
    short = EnhancedSuffixArray(e.raw, at, np.full(len(at), length), length)
    head = short.lcp < length
    head[:1] = True
    first = np.flatnonzero(head)
    sizes = np.diff(np.append(first, len(at)))
    b = before[short.order]
    diverse = (sizes > 1) & ((np.minimum.reduceat(b, first) != np.maximum.reduceat(b, first)) | (np.maximum.reduceat(b, first) == 255))
    live = short.order[np.repeat(diverse, sizes)]
    if not len(live):
        return
    left = e.size[ids][own[live]] - j[live]
    esa = EnhancedSuffixArray(e.raw, at[live], left, int(left.max()))
    depth, i, k = esa.maximal(length, before[live])
    sizes = k - i + 1
    e.mark(ids, own, j, live[esa.order[expand(i, sizes)]], sizes, depth - length + 1)


def _spans(mask: np.ndarray, offsets: np.ndarray):
    """Starts, ends and rows of the maximal runs in ``mask``; runs never cross rows."""
    n = len(mask)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    prior, after = np.zeros(n, bool), np.zeros(n, bool)
    prior[1:], after[:-1] = mask[:-1], mask[1:]
    a = np.flatnonzero(mask & (~prior | edge[:n]))
    b = np.flatnonzero(mask & (~after | edge[1:])) + 1
    return a, b, np.searchsorted(offsets, a, "right") - 1


def _finish(schema: pa.Schema, texts: bool):
    def run(table: pa.Table, c, gone) -> pa.Table:
        if c is None:
            return schema.empty_table()
        raw, offsets = c.view.raw, c.view.offsets
        n = len(offsets) - 1
        a, b, rows = _spans(gone, offsets)
        removed = np.zeros(n, np.int64)
        np.add.at(removed, rows, b - a)
        keep = raw[~gone]
        at = offsets - np.concatenate(([0], np.cumsum(removed)))
        blob = keep.tobytes()
        kept = [blob[i:j] for i, j in zip(at.tolist(), at[1:].tolist())]
        cols = {f: table.column(f) for f in table.column_names if f in schema.names}
        cols |= {"n_bytes": np.diff(offsets), "n_removed": removed, "n_spans": np.bincount(rows, minlength=n), "kept_sha256": [hashlib.sha256(x).hexdigest() for x in kept]}
        if texts:
            first = np.searchsorted(rows, np.arange(n + 1))
            a, b = (a - offsets[rows]).tolist(), (b - offsets[rows]).tolist()
            cols["kept"] = kept
            cols["kept_text"] = [x.decode("utf-8", "ignore") for x in kept]
            cols["spans"] = [[{"start": s, "end": t} for s, t in zip(a[i:j], b[i:j])] for i, j in zip(first, first[1:])]
        return pa.table([pa.chunked_array(cols[f.name].chunks, f.type) if isinstance(cols[f.name], pa.ChunkedArray) else pa.array(cols[f.name], f.type) for f in schema], schema=schema)

    return run


_DIGEST = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())]
_TEXTS = [T.StructField("kept", T.BinaryType()), T.StructField("kept_text", T.StringType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))]


def remove_repeats(spark: SparkSession, docs: DataFrame, length: int = 50, texts: bool = True) -> DataFrame:
    """Remove each byte covered by a ``length``-byte string that also starts in a document with a smaller doc_id.

    Strings are judged on the input; matches never cross documents. Returns the columns of ``docs`` with
    n_bytes, n_removed, n_spans, kept_sha256 and, with ``texts``, ``kept`` (the remaining bytes), ``kept_text`` (without
    characters of which only some bytes remain) and ``spans``.

    ``length`` is from 1 to ``repeats.MOST``, else a ValueError. Null text is empty; a null doc_id counts as larger than every other; rows with the same doc_id do not
    take bytes from each other; an empty table gives an empty result. Further columns are returned as they
    are, except that columns with the names above are replaced. Very long texts are handled in pieces.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    made = [*_DIGEST, *(_TEXTS if texts else [])]
    names = {f.name for f in made} | {"batch"}
    docs = docs.select(*[c for c in docs.columns if c not in names])
    schema = R.doc_schema(docs, *made)
    return R.removals(spark, docs, length, R.ByteView, index, _finish(to_arrow_schema(schema), texts), schema, "suffixes")


_PLACE = np.dtype([("doc", "<i8"), ("start", "<i8"), ("count", "<i4"), ("size", "<i4"), ("left", "u1")])
#: Bytes of a suffix that are compared first; each later round takes twice as many.
CONTEXT = 256
_TIED = "repeat_id long, size long, doc_id long, start long, batch long, row int, left int, tied boolean"
_TIED_ARROW = pa.schema([("repeat_id", pa.int64()), ("size", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("batch", pa.int64()), ("row", pa.int32()), ("left", pa.int32()), ("tied", pa.bool_())])


def _group_rows(esa: EnhancedSuffixArray, least: int, base: int, cols: dict[str, np.ndarray]) -> pa.Table:
    """Rows of the maximal groups, one for each occurrence; groups that agree to the full depth are ``tied``.

    ``base``: bytes known to be equal before; ``cols``: doc, start, batch, row and left of each suffix.
    """
    depth, i, j = esa.maximal(least, cols["left"])
    if not len(depth):
        return _TIED_ARROW.empty_table()
    sizes = j - i + 1
    member = esa.order[expand(i, sizes)]
    at = np.cumsum(sizes) - sizes
    docs = cols["doc"][member]
    tied = depth == esa.depth  # decided in the next round
    keep = np.minimum.reduceat(docs, at) != np.maximum.reduceat(docs, at)
    # one name for a group wherever it is made: its first occurrence and size
    order = np.lexsort((cols["start"][member], cols["row"][member], cols["batch"][member], np.repeat(np.arange(len(sizes)), sizes)))
    head = member[order][at]
    name = K.mix(cols["batch"][head].astype(np.uint64) * K.U(0x9E3779B97F4A7C15) + K.mix(cols["row"][head].astype(np.uint64) << K.U(40) | cols["start"][head].astype(np.uint64)) + K.mix((depth + base).astype(np.uint64)))
    rep = np.repeat(keep, sizes)
    out = {
        "repeat_id": np.repeat(name.view(np.int64), sizes), "size": np.repeat(depth + base, sizes), "doc_id": docs, "start": cols["start"][member], "batch": cols["batch"][member],
        "row": cols["row"][member], "left": cols["left"][member].astype(np.int32), "tied": np.repeat(tied, sizes),
    }
    return pa.table({f.name: pa.array(out[f.name][rep], f.type) for f in _TIED_ARROW})


def maximal_repeats(spark: SparkSession, docs: DataFrame, length: int = 50, context: int = CONTEXT) -> DataFrame:
    """Maximal repeat groups of more than one document, a row for each occurrence: repeat_id, size (bytes), doc_id, start (byte).

    A group is all places of a string that can be made longer neither to the left nor to the right without losing one; a
    document's start and end count as different from everything. Suffixes are compared by ``context`` bytes first; groups that
    agree so far go on with twice as many, until every true size is known. The occurrences under one minimiser meet in one task; where
    many different segments lie under it they are split by longer ones, to whole windows at last.
    Null, empty and short texts are in no group; a null doc_id is a document of its own, after all others; rows that repeat a
    doc_id count as one document, their places are all listed; an empty table has no groups. Only doc_id and text are used.
    """
    if context < length:
        raise ValueError("context must hold a window")
    work = Scratch(spark, "groups")
    corpus, n = work.stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row_no")))
    buckets, parts = R.bucket_numbers(work, n)
    shared = R.shared_keys(work, corpus, length, R.ByteView, buckets)

    def in_order(table: pa.Table) -> pa.Table:
        return table.sort_by("row_no").combine_chunks()

    def send(table: pa.Table, answers: pa.Table) -> pa.Table:
        out: tuple[list, list, list, list, list] = ([], [], [], [], [])
        if table.num_rows:
            table = in_order(table)
            v = R.ByteView(*K.text_buffer(table.column("text")))
            seg, docs = R.sent_segments(v, answers, length, buckets), R._ids(table.column("doc_id").combine_chunks())
            start, count, row, key = seg.start, seg.count, seg.row, seg.key
            place, first = np.zeros(len(start), _PLACE), v.offsets[row]
            place["doc"], place["start"], place["count"] = docs[row], start - first, count
            place["size"] = np.minimum(v.offsets[row + 1] - start, count - 1 + context)
            place["left"] = np.where(start == first, 255, v.raw[np.maximum(start - 1, 0)])
            part = R._bucket(key, parts)
            order = np.argsort(part, kind="stable")
            cut = np.flatnonzero(np.append(True, part[order][1:] != part[order][:-1])) if len(order) else []
            batch = table.column("batch")[0].as_py()
            for i, j in zip(cut, np.append(cut[1:], len(order))):
                k = order[i:j]
                for col, x in zip(out, (int(part[k[0]]), batch, v.flat_slices(start[k], place["size"][k].astype(np.int64)), place[k].tobytes(), row[k].astype(np.int32).tobytes())):
                    col.append(x)
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("bucket", "batch", "content", "places", "rows"), out, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))})

    def find(table: pa.Table) -> pa.Table:
        raw = np.frombuffer(b"".join(table.column("content").to_pylist()), np.uint8)
        places = [np.frombuffer(x, _PLACE) for x in table.column("places").to_pylist()]
        p = np.concatenate(places)
        batch = np.repeat(table.column("batch").to_numpy(), [len(x) for x in places])
        row = np.concatenate([np.frombuffer(x, np.int32) for x in table.column("rows").to_pylist()])
        at = np.cumsum(p["size"].astype(np.int64)) - p["size"]
        own, j = np.repeat(np.arange(len(p)), p["count"]), expand(np.zeros(len(p), np.int64), p["count"].astype(np.int64))
        here, known = at[own] + j, p["size"][own].astype(np.int64) - j
        cols = {"doc": p["doc"][own], "start": p["start"][own] + j, "batch": batch[own], "row": row[own], "left": np.where(j == 0, p["left"][own], raw[np.maximum(here - 1, 0)])}
        esa = EnhancedSuffixArray(raw, here, np.minimum(known, context), context)
        return _group_rows(esa, length, 0, cols)

    def fetch(base: int, step: int):
        def run(table: pa.Table, asked: pa.Table) -> pa.Table:
            """The next bytes of the suffixes that are still tied."""
            if not table.num_rows or not asked.num_rows:
                return pa.table({**{f.name: pa.array([], f.type) for f in _TIED_ARROW}, "next": pa.array([], pa.binary())})
            raw, offsets = K.text_buffer(in_order(table).column("text"))
            row = asked.column("row").to_numpy()
            a = offsets[row] + asked.column("start").to_numpy() + base
            b = np.minimum(a + step, offsets[row + 1])
            return asked.append_column("next", pa.array([raw[i:j].tobytes() for i, j in zip(a.tolist(), b.tolist())], pa.binary()))

        return run

    def split(base: int, step: int):
        def run(table: pa.Table) -> pa.Table:
            blobs = table.column("next").to_pylist()
            known = np.array([len(x) for x in blobs], np.int64)
            raw = np.frombuffer(b"".join(blobs), np.uint8)
            cols = {c: table.column(c).to_numpy() for c in ("start", "batch", "row")} | {"doc": table.column("doc_id").to_numpy(), "left": table.column("left").to_numpy().astype(np.uint8)}
            return _group_rows(EnhancedSuffixArray(raw, np.cumsum(known) - known, known, step), 0, base, cols)

        return run

    sent = corpus.groupBy("batch").cogroup(shared.groupBy("batch")).applyInArrow(send, "bucket long, batch long, content binary, places binary, rows binary")
    found = work.keep(sent.groupBy("bucket").applyInArrow(find, _TIED), "round0")
    out, base, step, k = found.filter("not tied"), context, 2 * context, 1
    while (open_ := found.filter("tied")).head(1):
        more = corpus.groupBy("batch").cogroup(open_.groupBy("batch")).applyInArrow(fetch(base, step), _TIED + ", next binary")
        found = work.keep(more.groupBy("repeat_id").applyInArrow(split(base, step), _TIED), f"round{k}")
        out, base, step, k = out.unionByName(found.filter("not tied")), base + step, 2 * step, k + 1
    doc = F.when(F.col("doc_id") != R.LAST, F.col("doc_id")).alias("doc_id")
    return out.select("repeat_id", "size", doc, "start")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of ``remove_repeats`` over all documents, with 50-byte strings."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return result(spark, "op2", lambda: remove_repeats(spark, docs, 50, texts=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))
