"""Configurations, and the names and order of features that follow from them."""

from __future__ import annotations

import json
import math
import warnings
from dataclasses import asdict, dataclass, field, fields, replace
from typing import Any

from pyspark.sql import SparkSession

from ..sources.shared import write_text

#: Defaults of the feature configuration.
SIGMAS = (1.0, 2.0, 4.0, 8.0, 16.0)
SIGMA_MULTIPLIER = 0.4
MEMBRANE_PATCH = 15
BILATERAL_RADII = (5, 10)
BILATERAL_RANGES = (50, 100)


@dataclass(frozen=True)
class FeatureConfig:
    """Which filters run, at which scales; names and defaults are fixed values. ``sigmas`` is replaced if min_sigma or max_sigma differ from their defaults."""

    name: str = "default"
    desc: str = "weka-style features"
    cast_to: str = "f16"
    gaussian_blur: bool = True
    sobel_filter: bool = True
    hessian_filter: bool = True
    mean: bool = False
    minimum: bool = False
    maximum: bool = False
    median: bool = False
    laplacian: bool = False
    structure_tensor_eigvals: bool = False
    difference_of_gaussians: bool = True
    membrane_projections: bool = True
    bilateral: bool = False
    add_zero_scale_features: bool = True
    add_mod_trace_det_hessian: bool = True
    add_weka_sigma_multiplier: bool = True
    sigmas: tuple[float, ...] = SIGMAS
    min_sigma: float = 1.0
    max_sigma: float = 16.0
    membrane_thickness: int = 1
    membrane_patch_size: int = MEMBRANE_PATCH
    use_gpu: bool = False

    def __post_init__(self):
        if self.min_sigma <= 0:
            raise ValueError("min_sigma must be above 0")
        if self.max_sigma > 128:
            raise ValueError("max_sigma must be at most 128")
        if self.membrane_thickness < 1 or self.membrane_patch_size < 3:
            raise ValueError("membrane thickness must be at least 1 and its patch at least 3")
        if self.cast_to not in ("f16", "f32", "f64"):
            raise ValueError(f"unknown cast {self.cast_to}")
        if self.use_gpu and self.structure_tensor_eigvals:
            raise ValueError("structure_tensor_eigvals has no gpu variant")
        if (self.min_sigma, self.max_sigma) != (1.0, 16.0):
            object.__setattr__(self, "sigmas", sigma_range(self.min_sigma, self.max_sigma))
        if any(s <= 0 for s in self.sigmas):
            raise ValueError("sigmas must be above 0")

    @property
    def multiplier(self) -> float:
        return SIGMA_MULTIPLIER if self.add_weka_sigma_multiplier else 1.0


def sigma_range(low: float, high: float) -> tuple[float, ...]:
    """Powers of two from low to high, evenly spaced in the exponent."""
    a, b = math.log2(low), math.log2(high)
    n = int(b - a) + 1
    return tuple(2.0 ** (a + (b - a) * k / max(n - 1, 1)) for k in range(n))


_SCALED = ("gaussian_blur", "sobel_filter", "hessian_filter", "mean", "minimum", "maximum", "median", "laplacian", "structure_tensor_eigvals")


def hessian_names(full: bool) -> list[str]:
    return ["hess_eig_1", "hess_eig_2", *(["hess_mod", "hess_trace", "hess_det"] if full else [])]


def names_at(config: FeatureConfig, sigma: float, zero: bool = False) -> list[str]:
    """Names of one scale in output order. The raw image always opens the zero scale."""
    out: list[str] = []
    for kind in _SCALED[:3] if zero else _SCALED:
        on = getattr(config, kind)
        if kind == "gaussian_blur":
            out += [kind] if on or zero else []
        elif kind == "hessian_filter":
            out += hessian_names(config.add_mod_trace_det_hessian) if on else []
        elif kind == "structure_tensor_eigvals":
            out += ["structure_eig_1", "structure_eig_2"] if on else []
        else:
            out += [kind] if on else []
    return [f"{n}_s{_plain(sigma)}" for n in out]


def _plain(x: float) -> str:
    return str(int(x)) if float(x).is_integer() else str(x).replace(".", "p")


MEMBRANE = ("mean", "max", "min", "sum", "std", "median")


def feature_names(config: FeatureConfig | None = None) -> list[str]:
    """Names of all features of a single channel, in output order."""
    c = config or FeatureConfig()
    out = names_at(c, 0, zero=True) if c.add_zero_scale_features else []
    for s in c.sigmas:
        out += names_at(c, s)
    if c.difference_of_gaussians:
        out += [f"dog_s{_plain(a)}_s{_plain(b)}" for i, a in enumerate(c.sigmas) for b in c.sigmas[:i]]
    if c.membrane_projections:
        out += [f"membrane_{m}" for m in MEMBRANE]
    if c.bilateral:
        out += [f"bilateral_r{r}_v{v}" for r in BILATERAL_RADII for v in BILATERAL_RANGES]
    return out


@dataclass(frozen=True)
class CRFParams:
    """Spatial and colour widths and weights of the random field, and its rounds."""

    label_confidence: float = 0.6
    sxy_g: tuple[float, float] = (3.0, 3.0)
    sxy_b: tuple[float, float] = (80.0, 80.0)
    s_rgb: tuple[float, float, float] = (13.0, 13.0, 13.0)
    compat_g: float = 10.0
    compat_b: float = 10.0
    n_infer: int = 10


@dataclass(frozen=True)
class ClassInfo:
    """A class, and what is known of it; ``value`` is the 0-based class index."""

    name: str
    value: int
    desc: str = ""
    parent_name: str | None = None
    min_size_px: int | None = None
    max_size_px: int | None = None
    desired_volume_fraction: float | None = None
    connectivity_target: str | None = None
    do_sam_postproc: bool = False


@dataclass(frozen=True)
class TrainingConfig:
    """End-to-end settings; names and defaults are fixed values but for those of this engine's own. ``seed`` and ``autocontext_type`` ("original": probabilities themselves; "ilastik": features of them) are
    this engine's own; add_dino_features, HITL and HITL_strategy are kept and not read."""

    feature_config: FeatureConfig = field(default_factory=FeatureConfig)
    classifier: str = "random_forest"
    classifier_params: dict[str, Any] = field(default_factory=dict)
    balance_classes: bool = True
    shuffle_data: bool = True
    n_samples: int = -1
    preprocessing: tuple[str, ...] | None = None
    modal_filter: bool = False
    modal_filter_k: int = 2
    autocontext: bool = False
    CRF: bool = False
    CRF_params: CRFParams = field(default_factory=CRFParams)
    add_dino_features: bool = False
    HITL: bool = False
    HITL_strategy: str = "wrong"
    class_infos: tuple[ClassInfo, ...] = ()
    use_gpu: bool = False
    autocontext_type: str = "original"
    seed: int = 0

    def params(self) -> dict[str, Any]:
        """Classifier parameters; balancing is for forests and logistic regression only."""
        extra = {"class_weight": "balanced"} if self.balance_classes and self.classifier in ("random_forest", "logistic_regression") else {}
        return {**self.classifier_params, **extra}


_NESTED = {"feature_config": FeatureConfig, "CRF_params": CRFParams}


def _build(cls, data: dict):
    known = {f.name for f in fields(cls)}
    unknown = {k for k in set(data) - known if data[k] is not None}
    if unknown:
        warnings.warn(f"ignored fields of {cls.__name__}: {', '.join(sorted(unknown))}", stacklevel=3)
    out = {}
    for k in known & set(data):
        v = data[k]
        if k in _NESTED:
            v = _build(_NESTED[k], v or {})
        elif k == "class_infos":
            v = tuple(_build(ClassInfo, x) for x in v or ())
        elif isinstance(v, list):
            v = tuple(v)
        out[k] = v
    return cls(**out)


def effective(config: TrainingConfig) -> FeatureConfig:
    """The feature configuration; ``use_gpu`` of either level chooses the accelerated formulas."""
    return replace(config.feature_config, use_gpu=True) if config.use_gpu and not config.feature_config.use_gpu else config.feature_config


def dumps(config: TrainingConfig) -> str:
    return json.dumps(asdict(config), indent=2)


def loads(text: str) -> TrainingConfig:
    return _build(TrainingConfig, json.loads(text))


def save(config: TrainingConfig, path: str, spark: SparkSession | None = None) -> None:
    """To any store that Spark writes where a session is given, else to a file here."""
    if spark:
        write_text(spark, path, json.dumps(asdict(config)))
        return
    with open(path, "w") as f:
        f.write(dumps(config))


def load(path: str, spark: SparkSession | None = None) -> TrainingConfig:
    """From any store that Spark reads where a session is given, a file of several lines included; else from a file here."""
    if spark:
        return loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
    with open(path) as f:
        return loads(f.read())
