"""Exact repeats across documents, by windows that meet under their minimiser.

A *window* is ``length`` consecutive elements (bytes or words) of one document. Consecutive windows
with the same minimiser form a segment; equal windows have equal minimisers, so segments that can
share a window meet in the same bucket. Three passes over a staged corpus (its texts never move):

1. every batch sends the distinct minimisers of its segments; buckets answer one bit each: seen in
   more than one document or not; and another for minimisers under which more than ``HOT`` distinct segments lie.
   Windows under such a hot minimiser are cut anew by minimisers of longer grams, which take this pass again; the longest
   gram is the window itself, under which there is one content only;
2. batches send the distinct segments under shared minimisers once each, with the smallest document
   that holds them, whatever the grams they were cut by; buckets index their suffixes (``suffix_array`` or ``suffix_tree``),
   find the maximal repeats and answer one bit per window: does a smaller document hold it;
3. batches apply the answers to all their documents.

What a bucket gets is one entry per batch and distinct segment, however many documents share it, so
a passage held by a third of all rows costs its bucket no more than one entry per batch; a batch sends a message to those
buckets only that own one of its minimisers, so there are never more messages than minimisers. Hashes only bring
segments together: what is merged or removed has been compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .scratch import Scratch

#: Order of a null doc_id: after all others.
LAST = np.iinfo(np.int64).max
#: Distinct segments under a minimiser (summed over batches, each rounded down to a power of two) beyond which it is hot.
HOT = 1 << 16
_SENT = "bucket long, batch long, data binary, meta binary"
_ANSWER = "batch long, kind int, bucket long, bits binary"
_KNOWN = 0  # kinds of answers: on windows, and for each length of grams on minimisers


def _shared(level: int) -> int:
    return 1 + 2 * level


def _hot(level: int) -> int:
    return 2 + 2 * level


def gram_lengths(view, length: int) -> list[int]:
    """Lengths of the grams whose minimisers cut a text, each next one for what is hot under the one before; the last is the window."""
    least = view.gram(length)
    return sorted({least, (least + length) // 2, length})


class ByteView:
    """A batch of documents as bytes."""

    def __init__(self, raw, offsets):
        self.raw, self.offsets = raw, offsets
        self.flat = raw

    @staticmethod
    def gram(length: int) -> int:
        return max(1, length * 2 // 5)

    def symbols(self, a, b):
        return K.BYTE_SYMBOLS[self.raw[a:b]]

    def places(self, starts, counts):
        """Where elements lie in ``flat``: first byte and number of bytes."""
        return starts, np.broadcast_to(counts, np.shape(starts))

    def flat_slices(self, starts, sizes) -> bytes:
        return K.gather(self.flat, starts, sizes).tobytes()


class WordView:
    """A batch of documents as words; in ``flat`` each is followed by one space."""

    def __init__(self, raw, offsets):
        self.raw, self.bytes_of = raw, offsets
        self.starts, self.ends, self.offsets = K.words(raw, offsets, K.SPACE)
        size = self.ends - self.starts
        self.at = np.concatenate(([0], np.cumsum(size + 1)))
        self.flat = np.full(int(self.at[-1]), 32, np.uint8)
        for i in range(0, len(size), 1 << 18):
            k = slice(i, i + (1 << 18))
            where = np.repeat(self.at[:-1][k] - (np.cumsum(size[k]) - size[k]), size[k])
            self.flat[where + np.arange(len(where))] = K.gather(raw, self.starts[k], size[k])
        self.ids = K.mix(K.word_hashes(raw, self.starts, self.ends) + K.U(1))

    @staticmethod
    def gram(length: int) -> int:
        return max(1, length * 4 // 25)

    def symbols(self, a, b):
        return self.ids[a:b]

    def places(self, starts, counts):
        return self.at[starts], self.at[starts + counts] - self.at[starts]


def equal_slices(raw: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each i: raw[a[i] : a[i] + size[i]] == raw[b[i] : b[i] + size[i]], in pieces of bounded size."""
    out = np.ones(len(a), bool)
    i, ends = 0, np.cumsum(size)
    while i < len(a):
        j = max(int(np.searchsorted(ends, (ends[i - 1] if i else 0) + (1 << 21), "right")), i + 1)
        differ = K.gather(raw, a[i:j], size[i:j]) != K.gather(raw, b[i:j], size[i:j])
        if differ.any():
            out[i:j][np.repeat(np.arange(j - i), size[i:j])[differ]] = False
        i = j
    return out


def distinct_slices(raw: np.ndarray, at: np.ndarray, size: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of one slice for each content, and for each slice the place of its content in that list.

    Equal hashes bring slices together, the bytes decide.
    """
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((size, hashes))
    h, z = hashes[order], size[order]
    heads = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (z[1:] != z[:-1])))
    label = np.empty(len(at), np.int64)
    label[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(at))))
    first = order[heads]
    other = np.flatnonzero(first[label] != np.arange(len(at)))
    same = equal_slices(raw, at[other], at[first[label[other]]], size[other])
    if not same.all():  # different contents with one hash: told apart by what they are
        found: dict[tuple[int, bytes], int] = {}
        more = []
        for i in other[~same].tolist():
            k = (int(label[i]), raw[at[i] : at[i] + size[i]].tobytes())
            if k not in found:
                found[k] = len(first) + len(more)
                more.append(i)
            label[i] = found[k]
        first = np.append(first, more)
    return first, label


def _ids(column) -> np.ndarray:
    return column.fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)


def _bucket(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> K.U(40)) % K.U(n)).astype(np.int64)


def _distinct_keys(keys, docs, contents):
    """Sorted distinct keys, whether more than one document in the batch has them, and log2 of their distinct contents."""
    if not len(keys):
        return keys, np.zeros(0, bool), np.zeros(0, np.uint8)
    order = np.lexsort((contents, keys))
    k, d, c = keys[order], docs[order], contents[order]
    new = np.append(True, k[1:] != k[:-1])
    at = np.flatnonzero(new)
    n = np.add.reduceat(new | np.append(True, c[1:] != c[:-1]), at, dtype=np.int64)
    return k[at], np.minimum.reduceat(d, at) != np.maximum.reduceat(d, at), np.log2(n).astype(np.uint8)


def _by_bucket(keys, n):
    """Order of sorted keys by bucket then key, and the bounds of the buckets present."""
    b = _bucket(keys, n)
    order = np.argsort(b, kind="stable")
    present, first = np.unique(b[order], return_index=True)
    return order, present, np.append(first, len(keys))


def _sketcher(view, length: int, buckets: int):
    def run(rows):
        parts: dict[int, list] = {}
        for rb in rows:
            owner = rb.column("batch").to_numpy()
            v = view(*K.text_buffer(rb.column("text")))
            seg = K.segments(v.symbols, v.offsets, length, view.gram(length))
            ids = _ids(rb.column("doc_id"))
            for b in np.unique(owner).tolist():
                mine = owner[seg.row] == b
                parts.setdefault(b, []).append(_distinct_keys(seg.key[mine], ids[seg.row[mine]], seg.content[mine]))
        for b in list(parts):
            yield _sketch(b, buckets, *zip(*parts.pop(b)))

    return run


def _sketch(batch, buckets: int, keys, many, sizes) -> pa.RecordBatch:
    """A batch's distinct minimisers, a row for each bucket that owns some."""
    k, m, z = np.concatenate(keys), np.concatenate(many), np.concatenate(sizes)
    if len(keys) > 1 and len(k):  # the same key in two Arrow batches: taken as shared, later steps decide exactly
        order = np.argsort(k)
        k, m, z = k[order], m[order], z[order]
        at = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        m = np.logical_or.reduceat(m, at) | (np.diff(np.append(at, len(k))) > 1)
        k, z = k[at], np.maximum.reduceat(z, at)
    order, present, cut = _by_bucket(k, buckets)
    k, m, z = k[order], m[order], z[order]
    return pa.RecordBatch.from_pydict({
        "bucket": pa.array(present, pa.int64()), "batch": pa.array([batch] * len(present), pa.int64()),
        "data": pa.array([k[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
        # one byte a key: log2 of its contents, and in the highest bit whether it is shared within the batch
        "meta": pa.array([(z[a:b] | m[a:b].astype(np.uint8) << 7).tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
    })


def _resketcher(view, length: int, buckets: int, level: int):
    """Minimisers of the longer grams of ``level``, of what is hot under all shorter ones."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        keys = docs = contents = np.zeros(0, np.uint64)
        if table.num_rows and _hot(level - 1) in answers.column("kind").to_pylist():
            v = view(*K.text_buffer(table.column("text")))
            seg, _ = list(cut_segments(v, answers, length, buckets))[level]
            keys, docs, contents = seg.key, _ids(table.column("doc_id").combine_chunks())[seg.row], seg.content
        batch = table.column("batch")[0].as_py() if table.num_rows else 0
        return pa.Table.from_batches([_sketch(batch, buckets, *([x] for x in _distinct_keys(keys, docs, contents)))])

    return run


def _shared_keys(level: int, hot: int):
    def run(table: pa.Table) -> pa.Table:
        """For every key sent: does another batch, or another document of its batch, have it; and is it hot?"""
        parts = [np.frombuffer(x, np.uint64) for x in table.column("data").to_pylist()]
        keys = np.concatenate(parts)
        meta = np.concatenate([np.frombuffer(m, np.uint8) for m in table.column("meta").to_pylist()])
        order = np.argsort(keys)
        k = keys[order]
        at = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        size = np.diff(np.append(at, len(k)))
        shared, crowded = np.empty(len(k), bool), np.empty(len(k), bool)
        both = (size > 1) | np.logical_or.reduceat(meta[order] >= 128, at)
        shared[order] = np.repeat(both, size)
        crowded[order] = np.repeat(both & (np.add.reduceat(np.left_shift(1, (meta[order] & 127).astype(np.int64)), at) > hot), size)
        cut = np.cumsum([0, *map(len, parts)])
        batch, bucket = table.column("batch").to_pylist(), table.column("bucket").to_pylist()
        rows = [(b, _shared(level), c, np.packbits(shared[i:j]).tobytes()) for b, c, i, j in zip(batch, bucket, cut, cut[1:])]
        rows += [(b, _hot(level), c, np.packbits(crowded[i:j]).tobytes()) for b, c, i, j in zip(batch, bucket, cut, cut[1:]) if crowded[i:j].any()]
        cols = zip(*rows)
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("batch", "kind", "bucket", "bits"), cols, (pa.int64(), pa.int32(), pa.int64(), pa.binary()))})

    return run


def _answers(table: pa.Table, kind: int) -> dict[int, bytes]:
    return {b: x for k, b, x in zip(table.column("kind").to_pylist(), table.column("bucket").to_pylist(), table.column("bits").to_pylist()) if k == kind}


def shared_segments(seg: K.Segments, answers: pa.Table, buckets: int, kind: int) -> np.ndarray:
    """Which segments lie under minimisers that the first pass answered yes to."""
    keys = np.unique(seg.key)
    order, present, cut = _by_bucket(keys, buckets)
    bits, out = _answers(answers, kind), np.zeros(len(keys), bool)
    for b, i, j in zip(present, cut, cut[1:]):
        if b in bits:
            out[order[i:j]] = np.unpackbits(np.frombuffer(bits[b], np.uint8), count=j - i).astype(bool)
    return out[np.searchsorted(keys, seg.key)] if len(keys) else np.zeros(0, bool)


def cut_segments(v, answers: pa.Table, length: int, buckets: int):
    """Segments for each length of grams, and which of them lie under shared minimisers that are not hot; what is hot is cut
    anew by the next length. Equal windows are cut by the same length and have the same key."""
    among = None
    for level, gram in enumerate(gram_lengths(v, length)):
        seg = K.segments(v.symbols, v.offsets, length, gram, among)
        hot = shared_segments(seg, answers, buckets, _hot(level))
        yield seg, shared_segments(seg, answers, buckets, _shared(level)) & ~hot
        if not hot.any():
            return
        start, count = seg.start[hot], seg.count[hot]
        among = np.zeros(int(v.offsets[-1]), bool)
        among[np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))] = True


def sent_segments(v, answers: pa.Table, length: int, buckets: int) -> K.Segments:
    """All segments of a batch that meet those of others, whatever the grams they were cut by."""
    found = [(seg.start[k], seg.count[k], seg.key[k], seg.content[k], seg.row[k]) for seg, k in cut_segments(v, answers, length, buckets)]
    return K.Segments(*map(np.concatenate, zip(*found)))


class _Candidates:
    """Segments of a batch under shared minimisers, and the distinct ones among them in sending order."""

    def __init__(self, table: pa.Table, answers: pa.Table, view, length: int, buckets: int, parts: int):
        self.view = view(*K.text_buffer(table.column("text")))
        self.docs = _ids(table.column("doc_id").combine_chunks())
        seg = sent_segments(self.view, answers, length, buckets)
        self.start, self.count, self.row, self.key, content = seg.start, seg.count, seg.row, seg.key, seg.content
        self.doc = self.docs[self.row]
        # distinct contents, those of one bucket together, with the smallest document of each
        part = _bucket(self.key, parts)
        self.at, self.size = self.view.places(self.start, self.count + length - 1)
        first, which = distinct_slices(self.view.flat, self.at, self.size, content)
        low = np.full(len(first), LAST)
        np.minimum.at(low, which, self.doc)
        by = np.argsort(part[first], kind="stable")
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        self.first, self.low, self.which = first[by], low[by], place[which]
        self.present, at = np.unique(part[self.first], return_index=True)
        self.cut = np.append(at, len(self.first))


def _meta_type(length: int, view) -> np.dtype:
    """What is sent with a segment: smallest document, key group, number of windows, and for words the number of bytes."""
    count = ("count", "u1" if length - view.gram(length) < 255 else "<u4")
    return np.dtype([("doc", "<i8"), ("key", "<u4"), count, *([("size", "<u4")] if view is WordView else [])])


def _sender(view, length, buckets, parts):
    kind = _meta_type(length, view)

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"bucket": pa.array([], pa.int64()), "batch": pa.array([], pa.int64()), "data": pa.array([], pa.binary()), "meta": pa.array([], pa.binary())})
        c = _Candidates(table, answers, view, length, buckets, parts)
        data, meta = [], []
        for i, j in zip(c.cut, c.cut[1:]):
            f = c.first[i:j]
            data.append(K.gather(c.view.flat, c.at[f], c.size[f]).tobytes())
            m = np.empty(j - i, kind)
            m["doc"], m["key"], m["count"] = c.low[i:j], (c.key[f] & K.U(0xFFFFFFFF)).astype(np.uint32), c.count[f]
            if "size" in kind.names:
                m["size"] = c.size[f]
            meta.append(m.tobytes())
        batch = table.column("batch")[0].as_py()
        return pa.table({"bucket": pa.array(c.present, pa.int64()), "batch": pa.array([batch] * len(c.present), pa.int64()), "data": pa.array(data, pa.binary()), "meta": pa.array(meta, pa.binary())})

    return run


class Entries:
    """The distinct segments of one bucket: contents, window counts, key groups, smallest documents."""

    def __init__(self, data: list[bytes], meta: list[bytes], length: int, kind: np.dtype):
        m = np.concatenate([np.frombuffer(x, kind) for x in meta])
        self.doc, self.count = m["doc"].copy(), m["count"].astype(np.int64)
        key = m["key"]
        self.raw = np.frombuffer(b"".join(data), np.uint8)
        size = m["size"].astype(np.int64) if "size" in kind.names else self.count + length - 1
        at = np.cumsum(size) - size
        # equal segments of several batches become one entry
        content = np.empty(len(at), np.uint64)
        i = 0
        while i < len(at):
            j = max(int(np.searchsorted(at, at[i] + K.CHUNK)), i + 1)
            lo, hi = int(at[i]), int(at[j - 1] + size[j - 1])
            content[i:j] = K.Rolling(K.BYTE_SYMBOLS[self.raw[lo:hi]]).slices(at[i:j] - lo, at[i:j] - lo + size[i:j])
            i = j
        rep, which = distinct_slices(self.raw, at, size, content)
        low = np.full(len(rep), LAST)
        np.minimum.at(low, which, self.doc)
        by = np.argsort(key[rep], kind="stable")
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        self.entry = place[which]
        rep, self.low = rep[by], low[by]
        self.at, self.size, self.n, self.group = at[rep], size[rep], self.count[rep], key[rep]
        self.window_at = np.cumsum(self.n) - self.n  # where an entry's windows start in the answer
        #: smallest document of each window; an entry alone under its key needs no comparison
        self.smallest = np.repeat(self.low, self.n)
        edge = np.append(True, self.group[1:] != self.group[:-1])
        sizes = np.diff(np.append(np.flatnonzero(edge), len(edge)))
        self.crowded = np.flatnonzero(np.repeat(sizes > 1, sizes))

    def slabs(self, most: int = 1 << 19):
        """Entries of crowded key groups, some whole groups at a time; a group has at most about ``HOT`` entries."""
        i, ids = 0, self.crowded
        n = np.cumsum(self.n[ids])
        edge = np.flatnonzero(np.append(self.group[ids][1:] != self.group[ids][:-1], True)) + 1 if len(ids) else []
        while i < len(ids):
            base = n[i] - self.n[ids[i]]
            ends = edge[np.searchsorted(edge, i, "right") :]
            k = max(int(np.searchsorted(n[ends - 1], base + most, "right")), 1)
            j = int(ends[k - 1])
            yield ids[i:j]
            i = j

    def windows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All windows of some entries: the entry's place in ``ids``, and the window's number in it."""
        n = self.n[ids]
        own = np.repeat(np.arange(len(ids)), n)
        return own, np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)

    def mark(self, ids: np.ndarray, own: np.ndarray, j: np.ndarray, members: np.ndarray, sizes: np.ndarray, windows: np.ndarray) -> None:
        """Take in maximal repeats: group after group the numbers of its occurrences (in ``own`` and ``j``), the sizes
        of the groups, and how many windows long each repeat is. All of an occurrence's windows get the smallest document of its group."""
        if not len(members):
            return
        low = self.low[ids][own[members]]
        least = np.repeat(np.minimum.reduceat(low, np.cumsum(sizes) - sizes), sizes)
        long = np.repeat(windows, sizes)
        more = least < low
        at, least, long = (self.window_at[ids][own[members]] + j[members])[more], least[more], long[more]
        for i in range(0, len(at), 1 << 15):
            k = slice(i, i + (1 << 15))
            n = long[k]
            place = np.repeat(at[k] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            np.minimum.at(self.smallest, place, np.repeat(least[k], n))

    def bits(self, length: int) -> np.ndarray:
        """Per window of every segment sent: is it in a document smaller than the sender's?"""
        ends = np.cumsum(self.count)
        out = np.empty(int(ends[-1]), bool)
        for i in range(0, len(ends), 1 << 15):
            k = slice(i, i + (1 << 15))
            count, begin = self.count[k], ends[k] - self.count[k]
            a, b = int(begin[0]), int(ends[k][-1])
            at = np.repeat(self.window_at[self.entry[k]] - begin, count) + np.arange(a, b)
            out[a:b] = self.smallest[at] < np.repeat(self.doc[k], count)
        return out


def _resolver(index: Callable, view, length: int):
    kind = _meta_type(length, view)

    def run(table: pa.Table) -> pa.Table:
        data, meta = table.column("data").to_pylist(), table.column("meta").to_pylist()
        e = Entries(data, meta, length, kind)
        for ids in e.slabs():
            index(e, ids, length)
        bits = e.bits(length)
        n = [int(np.frombuffer(m, kind)["count"].astype(np.int64).sum()) for m in meta]
        cut = np.cumsum([0, *n])
        return pa.table({
            "batch": table.column("batch").cast(pa.int64()), "kind": pa.array([_KNOWN] * len(n), pa.int32()), "bucket": table.column("bucket").cast(pa.int64()),
            "bits": pa.array([np.packbits(bits[a:b]).tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
        })

    return run


def _marks(table, answers, view, length, buckets, parts):
    """The batch's candidates, and per element of its view whether it is removed."""
    c = _Candidates(table, answers, view, length, buckets, parts)
    gone = np.zeros(int(c.view.offsets[-1]) if len(c.view.offsets) else 0, bool)
    if len(c.start):
        got, held = _answers(answers, _KNOWN), []
        size = c.count[c.first]
        for p, i, j in zip(c.present, c.cut, c.cut[1:]):
            m = int(size[i:j].sum())
            held.append(np.unpackbits(np.frombuffer(got[p], np.uint8), count=m).astype(bool))
        held = np.concatenate(held)
        at = np.cumsum(size) - size
        low = c.low[c.which]
        for i in range(0, len(c.start), 1 << 15):
            k = slice(i, i + (1 << 15))
            count = c.count[k]
            own = np.repeat(np.arange(len(count)), count)
            j = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
            yes = held[at[c.which[k]][own] + j] | (low[k] < c.doc[k])[own]
            gone[(c.start[k][own] + j)[yes]] = True
    return c, K.covered(gone, length)


def shared_keys(work: Scratch, corpus: DataFrame, length: int, view, buckets: int) -> DataFrame:
    """The first pass: per batch and bucket a bit for each minimiser, whether more than one document has it, and one whether it
    is hot; again with longer grams for what is hot, as long as there is any."""
    if not 1 <= length <= MOST:
        raise ValueError(f"a window has 1 to {MOST} elements")
    last = len(gram_lengths(view, length)) - 1
    sketch = corpus.mapInArrow(_sketcher(view, length, buckets), _SENT)
    level, answers = 0, None
    while True:
        found = sketch.groupBy("bucket").applyInArrow(_shared_keys(level, HOT if level < last else LAST), _ANSWER)
        found = work.keep(found, f"shared{level}")
        answers = answers.unionByName(found) if answers else found
        if level == last or not found.filter(F.col("kind") == _hot(level)).head(1):
            return answers
        level += 1
        sketch = corpus.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_resketcher(view, length, buckets, level), _SENT)


#: Elements of a window at most: a window and its overlap must fit in a piece of a long text.
MOST = 1 << 16


def bucket_numbers(work: Scratch, n: int) -> tuple[int, int]:
    """Buckets for minimisers and for segments of a corpus staged in ``n`` buckets: as many as its bytes ask for, however many it is staged in."""
    n = max(n, -(-work.batches // 32))
    return max(12, n), max(24, 4 * n)


def removals(spark: SparkSession, docs: DataFrame, length: int, view, index: Callable, finish: Callable, schema, name: str) -> DataFrame:
    """Run the three passes; ``finish(table, candidates, removed)`` makes the rows of a batch."""
    work = Scratch(spark, name)
    corpus, n = work.stage(docs)
    buckets, parts = bucket_numbers(work, n)
    thin = corpus.select("batch", F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = shared_keys(work, thin, length, view, buckets)
    sent = thin.groupBy("batch").cogroup(shared.groupBy("batch")).applyInArrow(_sender(view, length, buckets, parts), _SENT)
    answers = shared.unionByName(work.keep(sent.groupBy("bucket").applyInArrow(_resolver(index, view, length), _ANSWER), "known"))

    def last(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return finish(table, None, None)
        c, gone = _marks(table, answers, view, length, buckets, parts)
        return finish(table, c, gone)

    return corpus.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(last, schema)


def doc_schema(docs: DataFrame, *more: T.StructField) -> T.StructType:
    return T.StructType([*docs.schema.fields, *more])
