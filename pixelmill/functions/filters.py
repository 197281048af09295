"""Neighbourhood filters on dense 2-D arrays, for tiles.

Sums run in one fixed order of taps, and integer images are summed as integers, so a filter has the
same bits here as in SQL. ``int`` inputs are pixel values 0..255, ``float`` inputs those values / 255.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np


def disc(radius: int, closed: bool = False) -> list[tuple[int, int]]:
    """Offsets (dy, dx) of a disc, row by row."""
    r2 = radius * radius
    r = range(-radius, radius + 1)
    return [(y, x) for y in r for x in r if (y * y + x * x <= r2 if closed else y * y + x * x < r2)]


def gaussian_taps(sigma: float, multiplier: float = 1.0) -> tuple[float, ...]:
    """Weights of the blur at ``sigma``: the width is cut to a whole number, and 0 means no blur."""
    a = multiplier * sigma
    s = int(a)
    if s == 0:
        return (1.0,)
    radius = int((4 * a + 2) / (2 * a) * s + 0.5)
    return normal_taps(s, radius)


@lru_cache(maxsize=256)
def normal_taps(sigma: float, radius: int) -> tuple[float, ...]:
    w = [math.exp(-k * k / (2.0 * sigma * sigma)) for k in range(-radius, radius + 1)]
    total = math.fsum(w)
    return tuple(x / total for x in w)


#: How coordinates outside the image are read.
def _index(n: int, radius: int, mode: str) -> np.ndarray:
    i = np.arange(-radius, n + radius)
    if mode == "nearest":
        return np.clip(i, 0, n - 1)
    if mode == "mirror":  # whole-sample reflection
        if n == 1:
            return np.zeros_like(i)
        i = np.abs(np.mod(i, 2 * (n - 1)))
        return np.where(i >= n, 2 * (n - 1) - i, i)
    if mode == "reflect":  # half-sample reflection
        i = np.mod(i, 2 * n)
        return np.where(i >= n, 2 * n - 1 - i, i)
    raise ValueError(mode)


def pad(v: np.ndarray, ry: int, rx: int, mode: str) -> np.ndarray:
    if mode == "zero":
        return np.pad(v, ((ry, ry), (rx, rx)))
    return v[_index(v.shape[0], ry, mode)][:, _index(v.shape[1], rx, mode)]


def separable(v: np.ndarray, taps, mode: str = "nearest") -> np.ndarray:
    """The taps along y, then along x."""
    r = len(taps) // 2
    if r == 0:
        return v * taps[0] if taps[0] != 1.0 else v
    h, w = v.shape
    p = pad(v, r, 0, mode)
    out = taps[0] * p[:h]
    for k in range(1, len(taps)):
        out += taps[k] * p[k : k + h]
    p = pad(out, 0, r, mode)
    out = taps[0] * p[:, :w]
    for k in range(1, len(taps)):
        out += taps[k] * p[:, k : k + w]
    return out


def gaussian(v: np.ndarray, sigma: float, multiplier: float = 1.0) -> np.ndarray:
    return separable(v, gaussian_taps(sigma, multiplier))


def gradient(v: np.ndarray, axis: int) -> np.ndarray:
    """Central differences, one-sided at the border; 0 along an axis of one pixel."""
    v = np.moveaxis(v, axis, 0)
    g = np.zeros_like(v)
    if len(v) > 1:
        g[1:-1] = (v[2:] - v[:-2]) / 2
        g[0] = v[1] - v[0]
        g[-1] = v[-1] - v[-2]
    return np.moveaxis(g, 0, axis)


def edges(v: np.ndarray) -> np.ndarray:
    gx, gy = gradient(v, 1), gradient(v, 0)
    return np.sqrt(gx * gx + gy * gy)


def hessian(v: np.ndarray, full: bool = True) -> list[np.ndarray]:
    gy = gradient(v, 0)
    return hessian_parts(gradient(gy, 0), gradient(gy, 1), gradient(gradient(v, 1), 1), full)


def hessian_parts(a, b, d, full: bool = True) -> list[np.ndarray]:
    """Eigenvalues of [[a, b], [b, d]], larger first; modulus, trace and determinant."""
    root = np.sqrt(4 * b * b + (a - d) * (a - d))
    out = [(a + d + root) / 2, (a + d - root) / 2]
    return out + [np.sqrt(a * a + b * b + d * d), a + d, a * d - b * b] if full else out


def _shifted(b: np.ndarray, offsets):
    """Values at each offset and whether they are inside the image."""
    h, w = b.shape
    ry, rx = max(abs(y) for y, _ in offsets), max(abs(x) for _, x in offsets)
    p, inside = np.pad(b, ((ry, ry), (rx, rx))), np.pad(np.ones(b.shape, bool), ((ry, ry), (rx, rx)))
    for y, x in offsets:
        yield p[ry + y : ry + y + h, rx + x : rx + x + w], inside[ry + y : ry + y + h, rx + x : rx + x + w]


#: Cells of a disc up to which values are sorted.
SMALL_DISC = 64


def half_widths(offsets) -> dict[int, int]:
    """For each row of a disc how far it reaches to both sides."""
    out: dict[int, int] = {}
    for y, x in offsets:
        out[y] = max(out.get(y, 0), x)
    return out


def disc_sums(b: np.ndarray, offsets) -> tuple[np.ndarray, np.ndarray]:
    """Sum and number of the disc's pixels inside the image, two differences of running sums for each row of the disc."""
    h, w = b.shape
    rows = half_widths(offsets)
    ry, rx = max(rows), max(rows.values())
    total, n = np.zeros((h, w), np.int64), np.zeros((h, w), np.int64)
    sums = np.zeros((h + 2 * ry, w + 2 * rx + 1), np.int64)
    np.cumsum(np.pad(b, ((ry, ry), (rx, rx))), axis=1, out=sums[:, 1:])
    y, x = np.arange(h)[:, None], np.arange(w)[None]
    for dy, k in rows.items():
        band = sums[ry + dy : ry + dy + h]
        total += band[:, rx + k + 1 : rx + k + 1 + w] - band[:, rx - k : rx - k + w]
        n += np.where((y + dy >= 0) & (y + dy < h), np.minimum(x + k, w - 1) - np.maximum(x - k, 0) + 1, 0)
    return total, n


def disc_extreme(b: np.ndarray, offsets, pick, none: int) -> np.ndarray:
    """Minimum or maximum over the disc: each of its rows is two overlapping spans of a power of two, whose extremes are known by doubling."""
    h, w = b.shape
    rows = half_widths(offsets)
    ry, rx = max(rows), max(rows.values())
    spans = [np.pad(b, ((ry, ry), (rx, rx)), constant_values=none)]
    while 2 << (len(spans) - 1) <= 2 * rx + 1:
        last, step = spans[-1], 1 << (len(spans) - 1)
        spans.append(pick(last[:, : last.shape[1] - step], last[:, step:]))
    out = None
    for dy, k in rows.items():
        level = (2 * k + 1).bit_length() - 1
        band = spans[level][ry + dy : ry + dy + h]
        left, right = rx - k, rx + k + 1 - (1 << level)
        v = pick(band[:, left : left + w], band[:, right : right + w])
        out = v if out is None else pick(out, v)
    return out


def disc_median(b: np.ndarray, offsets) -> np.ndarray:
    """The upper median of bytes over the disc. A histogram for each pixel of a row slides down the image: of each column of the disc one
    pixel enters and one leaves; the rank is sought among sums of 16 values first."""
    h, w = b.shape
    columns = half_widths([(x, y) for y, x in offsets])
    dx, k = np.array(list(columns)), np.array(list(columns.values()))
    r, rx = int(k.max()), int(np.abs(dx).max())
    p = np.pad(b, ((r, r + 1), (rx, rx)), constant_values=256)
    at = np.arange(w)[None] + rx + dx[:, None]
    base = (np.arange(w) * 257)[None]
    counts = np.zeros((w, 257), np.int32)
    flat, out, x = counts.reshape(-1), np.empty((h, w), np.int64), np.arange(w)
    for y, d in offsets:
        flat[base[0] + p[r + y, rx + d : rx + d + w]] += 1
    for y in range(h):
        fine = counts[:, :256].reshape(w, 16, 16)
        coarse = np.cumsum(fine.sum(2), 1)
        n = coarse[:, -1] // 2
        c = (coarse <= n[:, None]).sum(1)
        n -= np.where(c > 0, coarse[x, c - 1], 0)
        out[y] = 16 * c + (np.cumsum(fine[x, c], 1) <= n[:, None]).sum(1)
        for enters, leaves in zip(base + p[(r + y + 1 + k)[:, None], at], base + p[(r + y - k)[:, None], at]):  # a column's pixels all differ
            flat[enters] += 1
            flat[leaves] -= 1
    return out


def sorted_median(b: np.ndarray, offsets) -> np.ndarray:
    """As ``disc_median``, by sorting the few values of a small disc."""
    part = np.stack([np.where(ok, v, 256) for v, ok in _shifted(b, offsets)], -1)
    n = (part < 256).sum(-1)
    part.sort(-1)
    return np.take_along_axis(part, (n // 2)[..., None], -1)[..., 0]


def rank(b: np.ndarray, radius: int, kind: str) -> np.ndarray:
    """mean, minimum, maximum or median of bytes over the open disc; pixels outside the image are left out."""
    b = b.astype(np.int64)
    offs = disc(radius)
    if kind == "mean":
        total, n = disc_sums(b, offs)
        return total // n
    if kind in ("minimum", "maximum"):
        return disc_extreme(b, offs, *((np.minimum, 256) if kind == "minimum" else (np.maximum, -1)))
    if kind == "median":
        return (sorted_median if len(offs) <= SMALL_DISC else disc_median)(b, offs)
    raise ValueError(kind)


def bilateral(b: np.ndarray, radius: int, width: int) -> np.ndarray:
    """Mean, cut to a whole number, of the disc's pixels whose value is less than ``width`` from the centre's."""
    b = b.astype(np.int64)
    total, n = np.zeros_like(b), np.zeros_like(b)
    for v, ok in _shifted(b, disc(radius)):
        near = ok & (np.abs(v - b) < width)
        total += np.where(near, v, 0)
        n += near
    return total // n


#: 3x3 derivative kernels along x.
SOBEL_X = ((-1, 0, 1), (-2, 0, 2), (-1, 0, 1))


def correlate(v: np.ndarray, kernel, mode: str) -> np.ndarray:
    k = np.asarray(kernel)
    ry, rx = k.shape[0] // 2, k.shape[1] // 2
    p = pad(v, ry, rx, mode)
    out = None
    for y in range(k.shape[0]):
        for x in range(k.shape[1]):
            if k[y, x]:
                term = p[y : y + v.shape[0], x : x + v.shape[1]] * float(k[y, x])
                out = term if out is None else out + term
    return np.zeros_like(v) if out is None else out


def laplacian(v: np.ndarray, mode: str = "reflect") -> np.ndarray:
    p = pad(v, 1, 1, mode)
    return 4.0 * v - p[:-2, 1:-1] - p[2:, 1:-1] - p[1:-1, :-2] - p[1:-1, 2:]


def structure_tensor(v: np.ndarray, sigma: float) -> list[np.ndarray]:
    """Eigenvalues, larger first, of the blurred products of Sobel derivatives; zero outside the image."""
    gy, gx = correlate(v, np.transpose(SOBEL_X), "zero"), correlate(v, SOBEL_X, "zero")
    taps = normal_taps(sigma, int(4 * sigma + 0.5))
    a, b, d = (separable(p, taps, "zero") for p in (gy * gy, gy * gx, gx * gx))
    return hessian_parts(a, b, d, full=False)


def _spline_coefficients(f: np.ndarray, axis: int) -> np.ndarray:
    """Cubic B-spline coefficients along an axis, mirrored at the ends."""
    n = f.shape[axis]
    m = np.zeros((n, n))
    for i in range(n):
        for j, w in ((i - 1, 1.0), (i, 4.0), (i + 1, 1.0)):
            j = abs(j)
            j = 2 * (n - 1) - j if j >= n else j
            m[i, j] += w / 6
    return np.moveaxis(np.linalg.solve(m, np.moveaxis(f, axis, 0).reshape(n, -1)).reshape(np.moveaxis(f, axis, 0).shape), 0, axis)


def _cubic(t: np.ndarray) -> np.ndarray:
    t = np.abs(t)
    return np.where(t < 1, 2 / 3 - t * t + t**3 / 2, np.where(t < 2, (2 - t) ** 3 / 6, 0.0))


def rotate(image: np.ndarray, degrees: float) -> np.ndarray:
    """Rotation about the centre by cubic splines, size kept, 0 outside."""
    c = _spline_coefficients(_spline_coefficients(image.astype(float), 0), 1)
    h, w = image.shape
    t = math.radians(degrees)
    cos, sin = math.cos(t), math.sin(t)
    cy, cx = (h - 1) / 2, (w - 1) / 2
    yy, xx = np.mgrid[:h, :w].astype(float)
    sy = cos * (yy - cy) + sin * (xx - cx) + cy
    sx = -sin * (yy - cy) + cos * (xx - cx) + cx
    eps = 1e-9
    inside = (sy >= -eps) & (sy <= h - 1 + eps) & (sx >= -eps) & (sx <= w - 1 + eps)
    out = np.zeros(image.shape)
    iy, ix = np.floor(sy).astype(int), np.floor(sx).astype(int)
    for a in range(-1, 3):
        wy = _cubic(sy - (iy + a))
        ky = np.abs(iy + a)
        ky = np.clip(np.where(ky >= h, 2 * (h - 1) - ky, ky), 0, h - 1)
        for b in range(-1, 3):
            kx = np.abs(ix + b)
            kx = np.clip(np.where(kx >= w, 2 * (w - 1) - kx, kx), 0, w - 1)
            out += wy * _cubic(sx - (ix + b)) * c[ky, kx]
    return np.where(inside, out, 0.0)


@lru_cache(maxsize=8)
def membrane_kernels(patch: int, thickness: int = 1) -> tuple[tuple[tuple[int, int, int], ...], ...]:
    """A line through a patch, turned in 30 steps of 6 degrees and rounded: (dy, dx, weight) of each kernel, as
    convolution reads the image."""
    base = np.zeros((patch, patch))
    base[:, patch // 2 - thickness // 2 : 1 + patch // 2 + thickness // 2] = 1
    r = patch // 2
    out = []
    for k in range(30):
        m = np.rint(rotate(base, 6 * k)).astype(int)
        ys, xs = np.nonzero(m)
        out.append(tuple(sorted((int(r - y), int(r - x), int(m[y, x])) for y, x in zip(ys, xs))))
    return tuple(out)


def membrane(b: np.ndarray, patch: int = 15, thickness: int = 1, mode: str = "reflect", ddof: int = 0, upper: bool | None = None) -> list[np.ndarray]:
    """mean, max, min, sum, std, median over the 30 responses, from whole-number sums of pixel values; of float images from their sums.

    ``upper``: None takes the middle of both medians, False the lower one.
    """
    r = patch // 2
    whole = np.issubdtype(b.dtype, np.integer)
    most = 255 * max(sum(abs(weight) for _, _, weight in kernel) for kernel in membrane_kernels(patch, thickness))
    small = whole and 30 * most * most < 1 << 31 and (not b.size or 0 <= b.min() and b.max() <= 255)
    kind, one = (np.int32 if small else np.int64, 255.0) if whole else (np.float64, 1.0)
    p = pad(b.astype(kind), r, r, mode)
    h, w = b.shape
    n = 30
    total, square = np.zeros((h, w), kind), np.zeros((h, w), kind)
    stack = np.empty((n, h, w), np.int32 if whole else kind)
    for k, kernel in enumerate(membrane_kernels(patch, thickness)):
        s = np.zeros((h, w), kind)
        for dy, dx, weight in kernel:
            part = p[r + dy : r + dy + h, r + dx : r + dx + w]
            s += part if weight == 1 else weight * part
        stack[k] = s
        total += s
        square += s * s
    total, square = (total.astype(np.int64), square.astype(np.int64)) if small else (total, square)
    stack.sort(axis=0)
    median = (stack[n // 2 - 1] + stack[n // 2]) / 2.0 if upper is None else stack[(n - 1) // 2].astype(float)
    deviation = np.sqrt(np.maximum(n * square - total * total, 0) / float(n * (n - ddof)))
    return [total / one / 30.0, stack[-1] / one, stack[0] / one, total / one, deviation / one, median / one]


# The variants below follow the formulas of the accelerated path: same names, other edges and kernels.


def wide_gaussian(v: np.ndarray, sigma: float, multiplier: float, largest: float) -> np.ndarray:
    """All scales share the kernel size of the largest; the width is not cut to a whole number."""
    return separable(v, normal_taps(multiplier * sigma, 2 * int(multiplier * largest)), "mirror")


def sobel_pair(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives along x and y by normalised 3x3 kernels."""
    return correlate(v, SOBEL_X, "mirror") / 8.0, correlate(v, np.transpose(SOBEL_X), "mirror") / 8.0


def sobel_edges(v: np.ndarray) -> np.ndarray:
    gx, gy = sobel_pair(v)
    return np.sqrt(gx * gx + gy * gy)


def sobel_hessian(v: np.ndarray, full: bool = True) -> list[np.ndarray]:
    gx, gy = sobel_pair(v)
    xx, xy = sobel_pair(gx)
    return hessian_parts(xx, xy, sobel_pair(gy)[1], full)


def square(v: np.ndarray, radius: int, kind: str) -> np.ndarray:
    """mean, minimum or maximum of a square window, mirrored at the border; by one axis after the other."""
    h, w = v.shape
    p = pad(v, radius, radius, "mirror")
    f = {"mean": np.add, "minimum": np.minimum, "maximum": np.maximum}[kind]
    n = 2 * radius + 1
    rows = p[:h]
    for k in range(1, n):
        rows = f(rows, p[k : k + h])
    out = rows[:, :w]
    for k in range(1, n):
        out = f(out, rows[:, k : k + w])
    return out / float(n * n) if kind == "mean" else out


def square_median(v: np.ndarray, radius: int) -> np.ndarray:
    """Lower median of a square window, zero outside the image."""
    h, w = v.shape
    n = 2 * radius + 1
    out = np.empty_like(v)
    p = np.pad(v, radius)
    step = max(1, (1 << 22) // (w * n * n))
    for y in range(0, h, step):
        m = min(step, h - y)
        views = np.stack([p[y + a : y + a + m, x : x + w] for a in range(n) for x in range(n)], -1)
        out[y : y + m] = np.partition(views, (n * n - 1) // 2, -1)[..., (n * n - 1) // 2]
    return out


def soft_bilateral(v: np.ndarray, radius: int, width: float) -> np.ndarray:
    """Weighted mean of a square window; weights fall with distance and with difference from the centre."""
    n = 2 * radius + 1
    sigma = 0.3 * ((n - 1) * 0.5 - 1) + 0.8
    g = normal_taps(sigma, radius)
    p = pad(v, radius, radius, "mirror")
    h, w = v.shape
    total, weight = np.zeros((h, w)), np.zeros((h, w))
    for y in range(n):
        for x in range(n):
            q = p[y : y + h, x : x + w]
            k = g[y] * g[x] * np.exp(-((q - v) ** 2) / (2 * width * width))
            total += k * q
            weight += k
    return total / weight
