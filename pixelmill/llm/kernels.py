"""Vectorised text kernels shared by the operators: tokenising, rolling hashes, window minimisers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_B = U(0x9E3779B97F4A7C15 | 1)
#: Elements handled at once; longer documents are cut into overlapping pieces.
CHUNK = 1 << 19
_IDX = U((1 << 24) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; returns a new array."""
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(29)
    x *= U(0xC2B2AE3D27D4EB4F)
    x ^= x >> U(32)
    return x


BYTE_SYMBOLS = mix(np.arange(1, 257, dtype=np.uint64) * U(0x632BE59BD9B4E019))
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK + 4096), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps)
    return have


_INV = pow(int(_B), -1, 1 << 64)


class Rolling:
    """Hashes of any slices of a symbol sequence, from one prefix sum modulo 2**64."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.inverse = _power(_INV, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * _power(int(_B), n + 1)[:n], out=self.sums[1:])

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[k:] - self.sums[:n]) * self.inverse[:n])

    def slices(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.inverse[a] + (b - a).astype(np.uint64) * U(0xA0761D6478BD642F))


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    if not data or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]



#: Bytes that end a word `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes outside words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(raw: np.ndarray, offsets: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in ``raw``, and the word offsets of each row. Words never cross rows."""
    n = len(raw)
    inside = ~stop[raw]
    edge = np.zeros(n + 1, bool)  # a word may start here although the byte before is inside too
    edge[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1 : n + 1])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, in pieces of bounded size."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(int(np.searchsorted(starts, starts[i] + CHUNK)), i + 1)
        lo, hi = int(starts[i]), int(ends[j - 1])
        roll = Rolling(BYTE_SYMBOLS[raw[lo:hi]])
        out[i:j] = roll.slices(starts[i:j] - lo, ends[i:j] - lo)
        i = j
    return out


def row_chunks(offsets: np.ndarray, window: int):
    """Ranges [a, b) of at most CHUNK elements such that every window lies in exactly one."""
    end, a = int(offsets[-1]), 0
    while a < end:
        b = min(end, a + CHUNK)
        if b < end:
            k = int(np.searchsorted(offsets, b, "right")) - 1
            if offsets[k] > a:
                b = int(offsets[k])
                yield a, b
                a = b
                continue
        yield a, b
        if b == end:
            break
        a = b - window + 1  # inside one long row: overlap


class Segments:
    """Runs of consecutive windows that share their minimiser, for one batch of rows.

    Equal windows have equal minimisers, so whatever must be compared meets under ``key``.
    ``start``: element index of the first window; ``count``: windows in the run; ``row``: the row.
    """

    __slots__ = ("content", "count", "key", "row", "start")

    def __init__(self, start, count, key, content, row):
        self.start, self.count, self.key, self.content, self.row = start, count, key, content, row


def window_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by doubling."""
    have, span = x, 1
    while 2 * span <= w:
        have = np.minimum(have[: len(have) - span], have[span:])
        span *= 2
    if span < w:
        d = w - span
        have = np.minimum(have[: len(have) - d], have[d:])
    return have


def segments(symbols_of, offsets: np.ndarray, window: int, k: int, among: np.ndarray | None = None) -> Segments:
    """``symbols_of(a, b)`` gives the symbols of elements [a, b) as uint64; ``among`` says for each element whether the window that starts there is one of those asked for."""
    parts = []
    for a, b in row_chunks(offsets, window):
        if b - a < window:
            continue
        roll = Rolling(symbols_of(a, b))
        grams = roll.grams(k)
        low = window_minimum((grams & ~_IDX) | np.arange(len(grams), dtype=np.uint64), window - k + 1)
        at = (low & _IDX).astype(np.int64)
        first, last = int(np.searchsorted(offsets, a, "right")) - 1, int(np.searchsorted(offsets, b))
        cut = offsets[first : last + 1]
        row = np.repeat(np.arange(first, last), np.diff(np.clip(cut, a, b)))[: len(at)]
        ends = np.minimum(offsets[row + 1], b) - a
        ok = np.arange(len(at)) + window <= ends
        if among is not None:
            ok &= among[a : a + len(at)]
        at[~ok] = -1
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
        s = np.flatnonzero(new)
        n = np.diff(np.append(s, len(at)))
        good = at[s] >= 0
        s, n = s[good], n[good]
        parts.append((s + a, n, grams[at[s]], roll.slices(s, s + n + window - 1), row[s]))
    if not parts:
        z = np.zeros(0, np.int64)
        return Segments(z, z, z.astype(np.uint64), z.astype(np.uint64), z)
    return Segments(*(np.concatenate(c) for c in zip(*parts)))


def gather(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of raw[starts[i] : starts[i] + lengths[i]]."""
    total = int(lengths.sum())
    if not total:
        return raw[:0]
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return raw[shift + np.arange(total)]


def covered(starts: np.ndarray, window: int) -> np.ndarray:
    """From a mask of window starts, which elements lie in a window."""
    n, last = len(starts), -window
    out = np.empty(n, bool)
    for a in range(0, n, CHUNK):
        at = np.arange(a, min(n, a + CHUNK))
        seen = np.where(starts[a : a + CHUNK], at, last)
        np.maximum.accumulate(seen, out=seen)
        out[a : a + CHUNK] = at - seen < window
        last = int(seen[-1])
    return out


def text_slices(batch: pa.RecordBatch, column: str = "text", most: int = 2 << 20):
    """Slices of a record batch whose texts have about ``most`` bytes together, one row at least."""
    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < batch.num_rows:
        base = int(size[a - 1]) if a else 0
        b = max(int(np.searchsorted(size, base + most, "right")), a + 1)
        yield batch.slice(a, b - a)
        a = b
