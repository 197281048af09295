"""Multi-scale features of images: single operators, and whole stacks built from a configuration."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import filters as K
from ..functions.config import BILATERAL_RADII, BILATERAL_RANGES, FeatureConfig, feature_names, hessian_names
from . import stencil as S

#: Largest multiples the accelerated variant takes its fixed radii and widths from.
GPU_RADII, GPU_WIDTHS, GPU_PATCH = (3, 5), (50.0, 100.0), 17


def gaussian_blur(px: DataFrame, sigma: float, multiplier: float = 1.0, keys=("img",)) -> DataFrame:
    """(keys, y, x, gaussian_blur)"""
    return S.blur(px, "v", K.gaussian_taps(sigma, multiplier), "gaussian_blur", keys).select(*keys, "y", "x", "gaussian_blur")


def sobel_filter(px: DataFrame, sigma: float, multiplier: float = 1.0, keys=("img",)) -> DataFrame:
    g = S.blur(px, "v", K.gaussian_taps(sigma, multiplier), "g_", keys)
    return S.edges(g, "g_", "sobel_filter", keys).select(*keys, "y", "x", "sobel_filter")


def hessian_filter(px: DataFrame, sigma: float, multiplier: float = 1.0, full: bool = True, keys=("img",)) -> DataFrame:
    g = S.blur(px, "v", K.gaussian_taps(sigma, multiplier), "g_", keys)
    return S.hessian(g, "g_", hessian_names(full), keys).select(*keys, "y", "x", *hessian_names(full))


def laplacian(px: DataFrame, sigma: float, multiplier: float = 1.0, keys=("img",)) -> DataFrame:
    g = S.blur(px, "v", K.gaussian_taps(sigma, multiplier), "g_", keys)
    return S.laplacian(g, "g_", "laplacian", keys).select(*keys, "y", "x", "laplacian")


def difference_of_gaussians(px: DataFrame, sigmas: Sequence[float], multiplier: float = 1.0, keys=("img",)) -> DataFrame:
    """Blur at the smaller scale minus blur at the larger, for all pairs."""
    for i, s in enumerate(sigmas):
        px = S.blur(px, "v", K.gaussian_taps(s, multiplier), f"g{i}", keys)
    made = [(F.col(f"g{j}") - F.col(f"g{i}")).alias(f"dog_s{sigmas[i]:g}_s{sigmas[j]:g}") for i in range(len(sigmas)) for j in range(i)]
    return px.select(*keys, "y", "x", *made)


def rank_filter(px: DataFrame, sigma: float, kind: str, keys=("img",), tile: int = S.TILE) -> DataFrame:
    """mean, minimum, maximum or median over the disc of radius ceil(sigma), on bytes."""
    r = int(np.ceil(sigma))
    return S.by_tile(px, lambda b: [K.rank(b, r, kind)], f"{kind} long", r, "b", keys, tile)


def rank_by_join(px: DataFrame, sigma: float, kind: str, keys=("img",)) -> DataFrame:
    """As ``rank_filter``, by the offset join."""
    made = {
        "mean": F.floor(F.sum("n") / F.count("n")), "minimum": F.min("n"), "maximum": F.max("n"),
        "median": F.get(F.sort_array(F.collect_list("n")), F.floor(F.count("n") / 2).cast("int")),
    }[kind]
    return S.over_disc(px, K.disc(int(np.ceil(sigma))), [made.cast("long").alias(kind)], keys=keys)


def bilateral(px: DataFrame, radii=BILATERAL_RADII, ranges=BILATERAL_RANGES, keys=("img",)) -> DataFrame:
    """Mean over the disc of pixels near the centre's value, for all radii and ranges."""
    names = [f"bilateral_r{r}_v{v}" for r in radii for v in ranges]
    return S.by_tile(px, lambda b: [K.bilateral(b, r, v) for r in radii for v in ranges], ", ".join(f"{n} long" for n in names), max(radii), "b", keys)


def membrane_projections(px: DataFrame, patch: int = 15, thickness: int = 1, keys=("img",)) -> DataFrame:
    """mean, max, min, sum, std, median of the responses to a line in 30 directions."""
    names = ", ".join(f"membrane_{m} double" for m in ("mean", "max", "min", "sum", "std", "median"))
    return S.by_tile(px, lambda b: K.membrane(b, patch, thickness), names, patch // 2, "b", keys)


def structure_tensor(px: DataFrame, sigma: float, keys=("img",)) -> DataFrame:
    halo = int(4 * sigma + 0.5) + 1
    return S.by_tile(px, lambda v: K.structure_tensor(v, sigma), "structure_eig_1 double, structure_eig_2 double", halo, "v", keys)


def stack_of(config: FeatureConfig) -> Callable[..., list[np.ndarray]]:
    """All features of a tile, in the order of ``feature_names``; a blur that several features need is made once.

    Byte filters see the bytes, all others the values: those bytes / 255, or where they are given, values of their own.
    """
    c = config

    def run(b: np.ndarray, values: np.ndarray | None = None) -> list[np.ndarray]:
        v = b / 255.0 if values is None else values
        blurs: dict[tuple, np.ndarray] = {}

        def derived(g: np.ndarray) -> list[np.ndarray]:
            return ([K.edges(g)] if c.sobel_filter else []) + (K.hessian(g, c.add_mod_trace_det_hessian) if c.hessian_filter else [])

        out: list[np.ndarray] = [v, *derived(v)] if c.add_zero_scale_features else []
        seen: dict[tuple, list[np.ndarray]] = {(1.0,): derived(v)}
        gs = []
        for s in c.sigmas:
            taps = K.gaussian_taps(s, c.multiplier)
            if taps not in blurs:
                blurs[taps] = K.separable(v, taps)
            g = blurs[taps]
            gs.append(g)
            if taps not in seen:
                seen[taps] = derived(g)
            r = int(np.ceil(s))
            out += ([g] if c.gaussian_blur else []) + seen[taps]
            out += [K.rank(b, r, k).astype(float) for k in ("mean", "minimum", "maximum", "median") if getattr(c, k)]
            out += [K.laplacian(g)] if c.laplacian else []
            out += K.structure_tensor(v, s) if c.structure_tensor_eigvals else []
        if c.difference_of_gaussians:
            out += [gs[j] - gs[i] for i in range(len(gs)) for j in range(i)]
        if c.membrane_projections:
            out += K.membrane(b if values is None else v, c.membrane_patch_size, c.membrane_thickness)
        if c.bilateral:
            out += [K.bilateral(b, r, w).astype(float) for r in BILATERAL_RADII for w in BILATERAL_RANGES]
        return out

    return run


def gpu_stack_of(config: FeatureConfig) -> Callable[..., list[np.ndarray]]:
    """As ``stack_of`` by the formulas of the accelerated variant."""
    c = config

    def run(b: np.ndarray, values: np.ndarray | None = None) -> list[np.ndarray]:
        v = b / 255.0 if values is None else values
        derived = lambda g: ([K.sobel_edges(g)] if c.sobel_filter else []) + (K.sobel_hessian(g, c.add_mod_trace_det_hessian) if c.hessian_filter else [])
        out: list[np.ndarray] = [v, *derived(v)] if c.add_zero_scale_features else []
        gs = []
        for s in c.sigmas:
            g = K.wide_gaussian(v, s, c.multiplier, max(c.sigmas))
            gs.append(g)
            r = int(np.ceil(s))
            out += ([g] if c.gaussian_blur else []) + derived(g)
            out += [K.square(v, r, k) for k in ("mean", "minimum", "maximum") if getattr(c, k)]
            out += [K.square_median(v, r)] if c.median else []
            out += [K.laplacian(g, "mirror")] if c.laplacian else []
        if c.difference_of_gaussians:
            out += [gs[j] - gs[i] for i in range(len(gs)) for j in range(i)]
        if c.membrane_projections:
            out += K.membrane(b if values is None else v, c.membrane_patch_size, c.membrane_thickness, "mirror", ddof=1, upper=False)
        if c.bilateral:
            out += [K.soft_bilateral(v, r, w / 255.0) for r in GPU_RADII for w in GPU_WIDTHS]
        return out

    return run


def halo_of(config: FeatureConfig) -> int:
    """Pixels around a tile on which its features depend."""
    c = config
    reach = [3]
    for s in c.sigmas:
        r = int(np.ceil(s))
        reach += [len(K.gaussian_taps(s, c.multiplier)) // 2 + 2, r if (c.mean or c.minimum or c.maximum or c.median) else 0, int(4 * s + 0.5) + 1 if c.structure_tensor_eigvals else 0]
    if c.use_gpu:
        reach.append(2 * int(c.multiplier * max(c.sigmas)) + 2)
    reach.append(c.membrane_patch_size // 2 if c.membrane_projections else 0)
    reach.append(max(BILATERAL_RADII) if c.bilateral else 0)
    return max(reach)


def stack_names(config: FeatureConfig) -> list[str]:
    """Names of the features of one channel, in the order of the stack."""
    names = feature_names(config)
    if config.use_gpu and config.bilateral:
        names = names[: -len(BILATERAL_RADII) * len(BILATERAL_RANGES)] + [f"bilateral_r{r}_v{w:g}" for r in GPU_RADII for w in GPU_WIDTHS]
    return names


def _rounded(planes: Sequence[np.ndarray], to: str) -> list[np.ndarray]:
    if to == "f64":
        return list(planes)
    with np.errstate(over="ignore"):
        return [(p.astype(np.float16) if to == "f16" else p).astype(np.float32) for p in planes]


def multiscale_features(px: DataFrame, config: FeatureConfig | None = None, keys=("img",), tile: int = S.TILE, values: bool = False) -> DataFrame:
    """(keys, y, x and one column for each feature), rounded as ``cast_to`` says (halves are stored as FLOAT, which holds them).

    ``values``: the column ``v`` holds values of its own, not bytes / 255. An image with a column ``ch`` has the features of each
    channel (``channel_features``), unless ``ch`` is among the keys.
    """
    c = config or FeatureConfig()
    if "ch" in px.columns and "ch" not in keys:
        return channel_features(px, c, None, keys, tile, values)
    return _stacked(px, c, [("", ("b", "v") if values else ("b",))], keys, tile)


def tile_kernel(c: FeatureConfig) -> Callable[[np.ndarray], list[np.ndarray]]:
    """All features of the dense array of a tile with its halo, rounded, in the order of ``stack_names``."""
    one = gpu_stack_of(c) if c.use_gpu else stack_of(c)
    return lambda a: _rounded(one(a), c.cast_to)


def _stacked(px: DataFrame, c: FeatureConfig, planes: Sequence[tuple[str, tuple[str, ...]]], keys, tile: int) -> DataFrame:
    """Stacks of several channels, given as (ending of the names, value columns), in one pass over the tiles."""
    one = gpu_stack_of(c) if c.use_gpu else stack_of(c)
    n = len(planes[0][1])

    def kernel(*arrays: np.ndarray) -> list[np.ndarray]:
        return _rounded([p for k in range(0, len(arrays), n) for p in one(*arrays[k : k + n])], c.cast_to)

    kind = T.DoubleType() if c.cast_to == "f64" else T.FloatType()
    schema = T.StructType([T.StructField(name + end, kind) for end, _ in planes for name in stack_names(c)])
    return S.by_tile(px, kernel, schema, halo_of(c), [v for _, vs in planes for v in vs], keys, tile)


def channel_features(px: DataFrame, config: FeatureConfig | None = None, channels: int | None = 3, keys=("img",), tile: int = S.TILE, values: bool = False) -> DataFrame:
    """Features of each channel next to each other, names ending in _c<channel>; of a single channel without ending. ``px`` has a
    column ``ch``; without ``channels`` its greatest value tells how many there are."""
    c = config or FeatureConfig()
    n = channels or (px.agg(F.max("ch")).first()[0] or 0) + 1
    if n == 1:
        return _stacked(px, c, [("", ("b", "v") if values else ("b",))], keys, tile)
    cols = ("b", "v") if values else ("b",)
    wide = px.groupBy(*keys, "y", "x").agg(*[F.max(F.when(F.col("ch") == k, F.col(v))).alias(f"{v}{k}") for k in range(n) for v in cols])
    wide = wide.na.fill(0)  # a channel that a pixel lacks counts as 0, as missing pixels do
    return _stacked(wide, c, [(f"_c{k}", tuple(f"{v}{k}" for v in cols)) for k in range(n)], keys, tile)


def cast_features(df: DataFrame, names: Sequence[str], to: str = "f16") -> DataFrame:
    """Round feature columns to half, single or double precision; halves are stored as FLOAT, which holds them exactly."""
    if to == "f64":
        return df
    if to == "f32":
        return df.withColumns({n: F.col(n).cast("float") for n in names})
    import pyarrow as pa

    def half(batches):
        for rb in batches:
            cols = [pa.array(c.to_numpy(zero_copy_only=False).astype(np.float16).astype(np.float32)) if n in chosen else c for n, c in zip(rb.schema.names, rb.columns)]
            yield pa.RecordBatch.from_arrays(cols, rb.schema.names)

    chosen = set(names)
    schema = T.StructType([T.StructField(f.name, T.FloatType()) if f.name in chosen else f for f in df.schema])
    return df.mapInArrow(half, schema)


def concat_features(a: DataFrame, b: DataFrame, keys=("img", "y", "x")) -> DataFrame:
    """Feature columns of both sides for each pixel."""
    return a.join(b, list(keys))


def custom_features(px: DataFrame, fn: Callable[..., Sequence[np.ndarray]], names: Sequence[str], halo: int | None = None, keys=("img",), config: FeatureConfig | None = None, values: bool = False) -> DataFrame:
    """A user's function of the raw image, ``fn(image)`` or ``fn(image, config)``, to planes. Without ``halo`` it sees whole images, one task each; with it, tiles
    and ``halo`` pixels around them, of images of any size (0: values depend on their own pixel).

    The image is an array (h, w) of bytes, or of the floats in ``v`` with ``values``; one with a column ``ch`` that is not among the keys is
    (h, w, channels), a channel that a pixel lacks being 0. A pixel has one row whatever its channels.
    """
    tile, halo = (S.WHOLE, 0) if halo is None else (S.TILE, halo)
    value = "v" if values else "b"
    if "ch" in px.columns and "ch" not in keys:
        n = (px.agg(F.max("ch")).first()[0] or 0) + 1
        px = px.groupBy(*keys, "y", "x").agg(*[F.coalesce(F.max(F.when(F.col("ch") == k, F.col(value))), F.lit(0)).alias(f"{value}{k}") for k in range(n)])
        columns = [f"{value}{k}" for k in range(n)]
    else:
        columns = [value]
    given = (config or FeatureConfig(),) if len([p for p in inspect.signature(fn).parameters.values() if p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD) and p.default is p.empty]) > 1 else ()
    several = "ch" not in keys and len(columns) > 1

    def kernel(*planes: np.ndarray) -> list[np.ndarray]:
        return [np.asarray(p, float) for p in fn(np.stack(planes, -1) if several else planes[0], *given)]

    return S.by_tile(px, kernel, ", ".join(f"`{n}` double" for n in names), halo, columns, keys, tile)
