"""Whole-image arrays of what the library does with relations and tiles, to hold it against."""

from itertools import product

import numpy as np

from pixelmill.functions import filters as K

CELLS = 1.5


class Grid:
    """Gaussian sums over points of several dimensions (width 1 in each)."""

    def __init__(self, points: np.ndarray):
        scaled = points * CELLS
        low = np.floor(scaled)
        part = scaled - low
        n, d = points.shape
        keep = [k for k in range(d) if np.ptp(points[:, k]) > 0] or [0]
        low, part = low[:, keep] - low[:, keep].min(0), part[:, keep]
        reach = int(np.ceil(3 * CELLS))
        size = low.max(0).astype(np.int64) + 2 + 2 * reach
        stride = np.append(np.cumprod(size[::-1])[-2::-1], 1) if len(size) > 1 else np.ones(1, np.int64)
        base = ((low.astype(np.int64) + reach) * stride).sum(1)
        corners = list(product((0, 1), repeat=len(keep)))
        codes = [base + int(np.dot(c, stride)) for c in corners]
        weights = [np.prod([part[:, k] if bit else 1 - part[:, k] for k, bit in enumerate(c)], 0) for c in corners]
        self.cells = np.unique(np.concatenate(codes))
        self.at = [np.searchsorted(self.cells, c) for c in codes]
        self.weights = weights
        spread = CELLS * CELLS - 1 / 3
        self.taps = np.exp(-np.arange(1, reach + 1) ** 2 / (2 * spread))
        # cells along each axis that are in use; those that are not hold nothing and are not filled
        self.near = []
        for s in stride:
            for k in range(1, reach + 1):
                here = np.searchsorted(self.cells, self.cells + k * s)
                ok = here < len(self.cells)
                ok[ok] = self.cells[here[ok]] == self.cells[ok] + k * s
                self.near.append((k, np.flatnonzero(ok), here[ok]))
        self.axes, self.reach = len(stride), reach

    def __call__(self, values: np.ndarray) -> np.ndarray:
        """For each point the sum of ``values`` (n, k) of all points, weighted by the kernel."""
        out = np.empty_like(values)
        for j in range(values.shape[1]):
            cell = np.zeros(len(self.cells))
            for at, w in zip(self.at, self.weights):
                cell += np.bincount(at, w * values[:, j], len(self.cells))
            for a in range(self.axes):
                new = cell.copy()
                for k, one, other in self.near[a * self.reach : (a + 1) * self.reach]:
                    new[one] += self.taps[k - 1] * cell[other]
                    new[other] += self.taps[k - 1] * cell[one]
                cell = new
            out[:, j] = sum(w * cell[at] for at, w in zip(self.at, self.weights))
        return out


class Places:
    """Gaussian sums over the places of a dense image, by convolution; outside the image there is nothing."""

    def __init__(self, y: np.ndarray, x: np.ndarray, widths: tuple[float, float]):
        self.y, self.x = y - y.min(), x - x.min()
        self.shape = int(self.y.max()) + 1, int(self.x.max()) + 1
        self.taps = [np.exp(-(np.arange(-int(4 * s + 0.5), int(4 * s + 0.5) + 1) ** 2) / (2.0 * s * s)) for s in widths]

    def __call__(self, values: np.ndarray) -> np.ndarray:
        out = np.empty_like(values)
        for j in range(values.shape[1]):
            plane = np.zeros(self.shape)
            plane[self.y, self.x] = values[:, j]
            for axis, taps in enumerate(self.taps):
                r, n = len(taps) // 2, self.shape[axis]
                p = K.pad(plane, *((r, 0) if axis == 0 else (0, r)), "zero")
                plane = sum(t * (p[k : k + n] if axis == 0 else p[:, k : k + n]) for k, t in enumerate(taps))
            out[:, j] = plane[self.y, self.x]
        return out


def mean_field(unary: np.ndarray, place: np.ndarray, colour: np.ndarray, p) -> np.ndarray:
    """Class probabilities (n, k) after ``p.n_infer`` steps; kernels are symmetrically normalised, compatibility is Potts'."""
    wide = Grid(np.hstack([place / np.array(p.sxy_b), colour / np.array(p.s_rgb[: colour.shape[1]])]))
    narrow = Places(place[:, 0].astype(int), place[:, 1].astype(int), p.sxy_g)
    kernels = []
    for sums, weight in ((narrow, p.compat_g), (wide, p.compat_b)):
        kernels.append((sums, weight, 1 / np.sqrt(np.maximum(sums(np.ones((len(unary), 1))), 1e-20))))
    q = _soft(-unary)
    for _ in range(p.n_infer):
        q = _soft(sum(weight * norm * sums(q * norm) for sums, weight, norm in kernels) - unary)
    return q


def _soft(m: np.ndarray) -> np.ndarray:
    e = np.exp(m - m.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def haar_denoise(v: np.ndarray, levels: int | None = None) -> np.ndarray:
    """Haar wavelet shrinkage with a threshold for each band from the noise and the band's own spread."""
    h, w = v.shape
    levels = max(1, int(np.log2(max(2, min(h, w)))) - 3) if levels is None else levels
    bands, a = [], v.astype(float)
    for _ in range(levels):
        if min(a.shape) < 2:
            break
        shape = a.shape
        a = np.pad(a, ((0, a.shape[0] % 2), (0, a.shape[1] % 2)), mode="symmetric")
        p, q, r, s = a[::2, ::2], a[::2, 1::2], a[1::2, ::2], a[1::2, 1::2]
        bands.append((shape, ((p - q + r - s) / 2, (p + q - r - s) / 2, (p - q - r + s) / 2)))
        a = (p + q + r + s) / 2
    if not bands:
        return a
    noise = np.median(np.abs(bands[0][1][2])) / 0.6744897501960817
    for shape, details in reversed(bands):
        x, y, d = (_shrunk(b, noise) for b in details)
        out = np.empty((2 * a.shape[0], 2 * a.shape[1]))
        out[::2, ::2], out[::2, 1::2] = (a + x + y + d) / 2, (a - x + y - d) / 2
        out[1::2, ::2], out[1::2, 1::2] = (a + x - y - d) / 2, (a - x - y + d) / 2
        a = out[: shape[0], : shape[1]]
    return a


def _shrunk(b: np.ndarray, noise: float) -> np.ndarray:
    signal = np.sqrt(max(np.mean(b * b) - noise * noise, 1e-12))
    t = noise * noise / signal
    return np.sign(b) * np.maximum(np.abs(b) - t, 0)


def equalise_adaptive(v: np.ndarray, clip: float = 0.01, bins: int = 256) -> np.ndarray:
    """Histogram equalisation on a grid of 8 x 8 tiles with a clipped histogram, blended between tile centres."""
    h, w = v.shape
    lo, hi = v.min(), v.max()
    if hi <= lo:
        return np.zeros_like(v, float)
    q = np.minimum(((v - lo) / (hi - lo) * bins).astype(int), bins - 1)
    th, tw = max(1, -(-h // 8)), max(1, -(-w // 8))
    ny, nx = -(-h // th), -(-w // tw)
    maps = np.empty((ny, nx, bins))
    for i in range(ny):
        for j in range(nx):
            part = q[i * th : (i + 1) * th, j * tw : (j + 1) * tw]
            n = np.bincount(part.ravel(), minlength=bins).astype(float)
            most = max(1.0, clip * part.size)
            over = np.maximum(n - most, 0).sum()
            n = np.minimum(n, most) + over / bins
            maps[i, j] = np.cumsum(n) / part.size
    fy, fx = (np.arange(h) + 0.5) / th - 0.5, (np.arange(w) + 0.5) / tw - 0.5
    y0, x0 = np.clip(np.floor(fy).astype(int), 0, ny - 1), np.clip(np.floor(fx).astype(int), 0, nx - 1)
    y1, x1 = np.minimum(y0 + 1, ny - 1), np.minimum(x0 + 1, nx - 1)
    ay, ax = np.clip(fy - y0, 0, 1)[:, None], np.clip(fx - x0, 0, 1)[None]
    at = lambda i, j: maps[i[:, None], j[None], q]
    return (1 - ay) * ((1 - ax) * at(y0, x0) + ax * at(y0, x1)) + ay * ((1 - ax) * at(y1, x0) + ax * at(y1, x1))
