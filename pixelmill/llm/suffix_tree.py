"""Substring dedup on words: suffix trees over groups of suffixes that share a prefix.

Suffixes that can hold a common window meet under an anchor of eight words, or under all words of the window where too
many meet (``repeats``). There they are split by the words they start with; a prefix is made longer until its group fits in
memory. Each group's subtree is built from its top; its internal nodes of at least ``length`` words give the maximal
repeats, and these what is removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import repeats as R
from .scratch import result

#: Suffixes of a group at most, unless they agree in all words.
GROUP = 1 << 16


def prefix_groups(ids: np.ndarray, at: np.ndarray, length: int, most: int = GROUP):
    """Split suffixes by variable-length prefixes: (depth, suffix numbers) of at most ``most`` each.

    A group larger than that agrees in all ``length`` words.
    """
    todo = [(0, np.arange(len(at)))]
    while todo:
        depth, members = todo.pop()
        if len(members) <= most or depth == length:
            yield depth, members
            continue
        word = ids[at[members] + depth]
        order = np.argsort(word, kind="stable")
        w = word[order]
        cut = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
        small: list[np.ndarray] = []
        held = 0
        for i, j in zip(cut, np.append(cut[1:], len(w))):
            part = members[order[i:j]]
            if j - i > most:
                todo.append((depth + 1, part))
                continue
            if held + j - i > most:  # neighbouring prefixes share a group while they fit
                yield depth, np.concatenate(small)
                small, held = [], 0
            small.append(part)
            held += j - i
        if small:
            yield depth, np.concatenate(small)


def word_ids(raw: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of some entries, equal for equal words only, and where each entry's words start.

    A word of up to seven bytes is its bytes and length; longer ones are numbered by their bytes, brought together by hash.
    """
    text = R.K.gather(raw, at, size)
    ends = np.flatnonzero(text == 32)
    starts = np.append(0, ends[:-1] + 1) if len(ends) else ends
    n = ends - starts
    padded = np.append(text, np.zeros(8, np.uint8))
    eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[starts]).view("<u8").ravel()
    short = n < 8
    ids = (eight & ((np.uint64(1) << (8 * np.minimum(n, 7)).astype(np.uint64)) - np.uint64(1))) | (n.astype(np.uint64) << np.uint64(56))
    long = np.flatnonzero(~short)
    if len(long):
        _, which = R.distinct_slices(text, starts[long], n[long], R.K.word_hashes(text, starts[long], ends[long]))
        ids[long] = which.astype(np.uint64) | np.uint64(255 << 56)
    return ids, np.searchsorted(starts, np.cumsum(size) - size)


def subtree(ids: np.ndarray, at: np.ndarray, size: np.ndarray, left: np.ndarray, depth: int, length: int):
    """Maximal repeats in the subtree of a group of suffixes that share ``depth`` words: (words, members, sizes of the groups).

    The tree is built from its top: suffixes of a node part by their next word; a stretch on which all agree is one edge. An
    internal node lies where suffixes part or end; deep ones, of at least ``length`` words, whose suffixes have different words
    before (``left``; 0: nothing that is known to be the same) are maximal repeats. Nodes with one suffix, and deep ones with the same word before all, go no
    further.
    """
    node, live, d = np.zeros(len(at), np.int64), np.arange(len(at)), depth
    while len(live) > 1:
        word = np.where(size[live] > d, ids[np.minimum(at[live] + d, len(ids) - 1)], np.uint64(0))  # no word is numbered 0: a suffix that ends
        order = np.lexsort((word, node[live]))
        live, word = live[order], word[order]
        m = node[live]
        top = np.append(True, m[1:] != m[:-1])
        new = top | np.append(True, word[1:] != word[:-1])
        if d >= length:
            first = np.flatnonzero(top)
            sizes = np.diff(np.append(first, len(live)))
            parts = np.add.reduceat(new, first, dtype=np.int64) > 1
            parts |= (word[first] == 0) & (sizes > 1)
            lo, hi = np.minimum.reduceat(left[live], first), np.maximum.reduceat(left[live], first)
            diverse = (sizes > 1) & ((lo != hi) | (lo == 0))
            out = parts & diverse
            if out.any():
                yield d, live[np.repeat(out, sizes)], sizes[out]
        heads = np.flatnonzero(new)
        count = np.diff(np.append(heads, len(live)))
        node[live] = np.repeat(np.arange(len(heads)), count)
        on = (count > 1) & (word[heads] != 0)
        if d >= length - 1 and len(heads):
            lo, hi = np.minimum.reduceat(left[live], heads), np.maximum.reduceat(left[live], heads)
            on &= (lo != hi) | (lo == 0)
        live = live[np.repeat(on, count)]
        d += 1


def index(e: R.Entries, ids: np.ndarray, length: int) -> None:
    """Smallest document of each window, from the maximal repeats at deep internal nodes.

    The suffixes are split by variable-length prefixes; each group's subtree is built on its own.
    """
    own, j = e.windows(ids)
    words, begin = word_ids(e.raw, e.at[ids], e.size[ids])
    at = begin[own] + j
    size = np.append(begin[1:], len(words))[own] - at
    left = np.where(j == 0, np.uint64(0), words[np.maximum(at - 1, 0)])
    for depth, members in prefix_groups(words, at, length):
        for d, found, sizes in subtree(words, at[members], size[members], left[members], depth, length):
            e.mark(ids, own, j, members[found], sizes, np.full(len(sizes), d - length + 1))


def _finish(schema: pa.Schema, texts: bool):
    def run(table: pa.Table, c, gone) -> pa.Table:
        if c is None:
            return schema.empty_table()
        v = c.view
        n = len(v.offsets) - 1
        removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[v.offsets]) if len(gone) else np.zeros(n, np.int64)
        # kept words joined by one space: their bytes, and a space after each
        s, t = v.starts[~gone], v.ends[~gone]
        size = t - s
        cut = np.cumsum(size + 1) - (size + 1)
        blob = np.full(int((size + 1).sum()), 32, np.uint8)
        where = np.repeat(cut - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        blob[where] = R.K.gather(v.raw, s, size)
        words_at = v.offsets - np.concatenate(([0], np.cumsum(removed)))
        ends = np.append(cut, len(blob))
        data = blob.tobytes()
        kept = [data[ends[i] : ends[j] - 1] if j > i else b"" for i, j in zip(words_at.tolist(), words_at[1:].tolist())]
        cols = {f: table.column(f) for f in table.column_names if f in schema.names}
        cols |= {"n_words": np.diff(v.offsets), "n_removed": removed, "kept_sha256": [hashlib.sha256(x).hexdigest() for x in kept]}
        if texts:
            cols["kept"] = kept
        return pa.table([pa.chunked_array(cols[f.name].chunks, f.type) if isinstance(cols[f.name], pa.ChunkedArray) else pa.array(cols[f.name], f.type) for f in schema], schema=schema)

    return run


def remove_repeated_words(spark: SparkSession, docs: DataFrame, length: int = 50, texts: bool = True) -> DataFrame:
    """Remove each word covered by a window of ``length`` words that also starts in a document with a smaller doc_id.

    Windows are judged on the input; ``length`` is from 1 to ``repeats.MOST``, else a ValueError. Returns the columns of ``docs`` with n_words, n_removed, kept_sha256 and,
    with ``texts``, ``kept`` (the kept words joined by one space, UTF-8). Null text has no words; a null doc_id counts as
    larger than every other; rows with the same doc_id do not take words from each other; an empty table
    gives an empty result. Further columns are returned, those with the names above replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    made = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    if texts:
        made.append(T.StructField("kept", T.BinaryType()))
    names = {f.name for f in made} | {"batch"}
    docs = docs.select(*[c for c in docs.columns if c not in names])
    schema = R.doc_schema(docs, *made)
    return R.removals(spark, docs, length, R.WordView, index, _finish(to_arrow_schema(schema), texts), schema, "trees")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of ``remove_repeated_words`` over all documents, with windows of 50 words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return result(spark, "op10", lambda: remove_repeated_words(spark, docs, 50, texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256"))
