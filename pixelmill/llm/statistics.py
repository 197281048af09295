"""Document statistics for scores, computed over whole texts in bounded pieces."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K

#: Classes of bytes whose shares are statistics.
_CLASS = np.full(256, 10, np.uint8)
_CLASS[[*range(97, 123)]] = 0
_CLASS[[*range(65, 91)]] = 1
_CLASS[[*range(48, 58)]] = 2
_CLASS[[0x20]] = 3
_CLASS[[0x0A]] = 4
_CLASS[[ord(c) for c in ".,;:'\"-()?"]] = 5
_CLASS[[ord("!")]] = 6
_CLASS[[ord(c) for c in "#$%&*@^~+=_"]] = 7
_CLASS[[ord(c) for c in "|<>{}[]\\/`"]] = 8
_CLASS[[*range(128, 256)]] = 9
N_CLASSES = 11
NAMES = (
    "lower", "upper", "digit", "space", "newline", "point", "shout", "symbol", "markup", "wide", "control",
    "log_bytes", "log_words", "mean_word", "distinct_words", "distinct_lines", "mean_line", "shouted_words", "symbol_words",
)


def _distinct(hashes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes per row."""
    key = np.unique((rows.astype(np.uint64) << K.U(44)) | (hashes >> K.U(20)))
    return np.bincount((key >> K.U(44)).astype(np.int64), minlength=n)


def statistics_of(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ``NAMES`` for each text; zeros where there is no text."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    row = np.repeat(np.arange(n, dtype=np.int32), size)
    kind = _CLASS[raw]
    shares = np.bincount(row * np.int32(N_CLASSES) + kind, minlength=n * N_CLASSES).reshape(n, N_CLASSES) / np.maximum(size, 1)[:, None]
    starts, ends, at = K.words(raw, offsets, K.SPACE)
    words = np.diff(at)
    some = np.maximum(words, 1)
    wrow = np.repeat(np.arange(n), words)
    distinct = _distinct(K.word_hashes(raw, starts, ends), wrow, n) / some
    newline = np.zeros(256, bool)
    newline[0x0A] = True
    ls, le, lat = K.words(raw, offsets, newline)
    lines = np.diff(lat)
    long = le - ls
    lhash = K.word_hashes(raw, ls, le) if len(ls) else np.zeros(0, np.uint64)
    dlines = _distinct(lhash, np.repeat(np.arange(n), lines), n) / np.maximum(lines, 1)
    last = kind[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    first = kind[starts] if len(starts) else last
    second = kind[np.minimum(starts + 1, np.maximum(ends - 1, 0))] if len(starts) else last
    shouted = np.bincount(wrow, (first == 1) & (second == 1), minlength=n) / some
    symbols = np.bincount(wrow, (last == 6) | (last == 7) | (last == 8), minlength=n) / some
    more = np.stack([
        np.log1p(size), np.log1p(words), size / some, distinct, dlines,
        np.log1p(np.bincount(np.repeat(np.arange(n), lines), long, minlength=n) / np.maximum(lines, 1)), shouted, symbols,
    ], axis=1)
    return np.hstack([shares, more])


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) for every row; null text is empty. Other columns are not used."""

    def run(batches):
        for whole in batches:
            for rb in K.text_slices(whole, most=1 << 20):
                s = statistics_of(*K.text_buffer(rb.column("text")))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, s.size + 1, s.shape[1], dtype=np.int32)), pa.array(s.ravel()))
                yield pa.RecordBatch.from_arrays([rb.column("doc_id"), flat], ["doc_id", "stats"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, stats array<double>")
