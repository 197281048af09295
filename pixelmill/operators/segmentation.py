"""From an image to a segmentation: features, training, application and refinement in one call each."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.config import TrainingConfig, effective
from ..sources import images
from ..sources.shared import scratch, staged
from . import crf, sam
from . import features as X
from . import labels as L
from . import models as M
from . import morphology as R
from .preprocess import preprocess

KEYS = ("img", "y", "x")


def _own_values(px: DataFrame) -> bool:
    """Does ``v`` hold values of its own, not bytes / 255?"""
    return "v" in px.columns and bool(px.filter(~F.col("v").eqNullSafe(F.col("b") / F.lit(255.0))).head(1))


def featurise(px: DataFrame, config: TrainingConfig, custom: Sequence[tuple[Callable, Sequence[str]]] = (), save_path: str | None = None) -> DataFrame:
    """Features of the preprocessed image, and of custom functions on the raw one with all its channels; kept at ``save_path`` where one is given.

    ``px``: (img, y, x, b, v) and, of colour images, ch. Float values, those of preprocessed images among them, go into the
    filters unchanged; byte filters see them truncated to bytes, so of values from 0 to 1 they see 0 and 1 only. Each channel of a
    colour image is preprocessed and featurised on its own.
    """
    several = "ch" in px.columns and bool(px.filter("ch > 0").head(1))
    keys = ("img", "ch") if several else ("img",)
    raw, own = px if several else px.drop("ch"), _own_values(px)
    image, values = raw, own
    if config.preprocessing:
        image, values = preprocess(image, config.preprocessing, keys), True
    if values:
        image = image.withColumn("b", F.pmod(F.col("v").cast("int"), F.lit(256)))
    out = X.multiscale_features(image, effective(config), values=values)
    for fn, names in custom:
        out = X.concat_features(out, X.custom_features(raw, fn, names, config=effective(config), values=own))
    if save_path:
        images.save_features(out, save_path)
        return images.load_features(px.sparkSession, save_path)
    return out


def autocontext(px: DataFrame, feats: DataFrame, prob: DataFrame, config: TrainingConfig, classes: int) -> DataFrame:
    """Features with the probabilities of a first model (``original``) or with features of them (``ilastik``), taken as float
    images as they are and preprocessed like images."""
    planes = [F.get("prob", F.lit(i)) for i in range(classes)]
    if config.autocontext_type == "original":
        return feats.join(prob.select(*KEYS, *[p.alias(f"prob_{i}") for i, p in enumerate(planes)]), list(KEYS))
    long = prob.select(*KEYS, F.posexplode("prob").alias("ch", "v")).withColumn("b", F.col("v").cast("int"))
    if config.preprocessing:
        long = preprocess(long, config.preprocessing, ("img", "ch")).withColumn("b", F.col("v").cast("int"))
    more = X.channel_features(long, effective(config), classes, values=True)
    return feats.join(more.select(*KEYS, *[F.col(n).alias(f"prob_{n}") for n in more.columns if n not in KEYS]), list(KEYS))


def train_and_apply(px: DataFrame, labels: DataFrame, config: TrainingConfig, classes: int, feats: DataFrame | None = None) -> tuple[DataFrame, M.Classifier]:
    """(img, y, x, prob, seg) and the model that made it: the second one where autocontext is on.

    Order of refinements: autocontext, random field, modal filter, regions. ``prob`` stays that of the model. Features are computed
    once, and kept in the shared folder for training and application; ``shared.scratch`` around the call and the writing of its rows removes them.
    """
    feats = staged(featurise(px, config), "features") if feats is None else feats
    return apply(fit(feats, labels, config, classes), feats, config, px, labels)


def fit(feats: DataFrame, labels: DataFrame, config: TrainingConfig, classes: int) -> M.Classifier:
    """The configuration's classifier, fitted on the labelled pixels of ``feats``. What is staged on the way is gone afterwards."""
    names = [c for c in feats.columns if c not in KEYS]
    params = config.params()
    balanced = params.pop("class_weight", None) == "balanced"
    with scratch(feats.sparkSession):
        data = staged(L.sample(L.training_pixels(feats, labels), config.n_samples, config.shuffle_data, config.seed), "training")
        return M.train(M.get_model(config.classifier, names, classes, params), data, balanced)


def apply(model: M.Classifier, feats: DataFrame, config: TrainingConfig, px: DataFrame | None = None, labels: DataFrame | None = None) -> tuple[DataFrame, M.Classifier]:
    """(img, y, x, prob, seg) of a trained model with all refinements that the configuration names, and the model that made it.

    Autocontext fits a second model on ``labels`` with features of the first one's probabilities; it and the random field need the image
    ``px``. Without refinements neither is needed.
    """
    out = M.apply(model, feats)
    if config.autocontext:
        if px is None or labels is None:
            raise ValueError("autocontext needs the image and labels")
        feats = staged(autocontext(px, feats, out, config, model.classes), "context")
        model = fit(feats, labels, config, model.classes)
        out = M.apply(model, feats)
    if config.CRF and px is None:
        raise ValueError("a random field needs the image")
    if not (config.CRF or config.modal_filter or any(c.do_sam_postproc for c in config.class_infos)):
        return out, model
    out = staged(out, "probabilities")
    return out.drop("seg").join(refine(out, px, config), list(KEYS)), model


def refine(out: DataFrame, px: DataFrame | None, config: TrainingConfig) -> DataFrame:
    """(img, y, x, seg) after the refinements that the configuration names."""
    seg = out.select(*KEYS, "seg")
    if config.CRF:
        seg = crf.refine(out, px, config.CRF_params)
    if config.modal_filter:
        seg = R.modal_filter(seg, config.modal_filter_k)
    wanted = {c.value: c.min_size_px or 225 for c in config.class_infos if c.do_sam_postproc}
    if wanted:
        seg = sam.refine_regions(seg, wanted, default=1 << 62)
    return seg
