"""Boosting with what is known of classes: volume fractions and connectivity steer the gradients."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.config import ClassInfo
from ..sources.shared import checkpoint
from . import labels as L
from . import morphology as M
from .boost import Booster
from .models import Classifier


class ExpertClassifier(Classifier):
    """Needs a volume fraction or a connectivity target for at least one class."""

    def __init__(self, features: Sequence[str], infos: Sequence[ClassInfo | dict], classes: int, weight_vf: float = 1.0, weight_conn: float = 0.1, **params):
        infos = [i if isinstance(i, ClassInfo) else ClassInfo(**i) for i in infos]
        super().__init__(features, classes, infos=[asdict(i) for i in infos], weight_vf=weight_vf, weight_conn=weight_conn, **params)
        self.fractions = [-1.0] * classes
        for i in infos:
            self.fractions[i.value] = -1.0 if i.desired_volume_fraction is None else i.desired_volume_fraction
        self.connectivity = {i.value: i.connectivity_target for i in infos if i.connectivity_target in ("minimise", "maximise")}
        if not self.connectivity and not any(t > 0 for t in self.fractions):
            raise ValueError("a class needs a volume fraction or a connectivity target")
        self.weight_vf, self.weight_conn = weight_vf, weight_conn
        self.booster = Booster(features, classes, **params)

    def fit(self, px: DataFrame, train: DataFrame, epochs: int = 5) -> ExpertClassifier:
        """``px``: features of all pixels; ``train``: those labelled, 0-based. A round of trees per epoch."""

        def extra(b: Booster):
            prob = checkpoint(b.predict_proba(px).select("img", "y", "x", "prob"))
            at = train.select("img", "y", "x")
            out = None
            if any(t > 0 for t in self.fractions):
                g = L.volume_fraction_gradient(prob, self.fractions, self.weight_vf).select("img", "grad")
                out = at.join(g, "img")
            if self.connectivity:
                seg = prob.select("img", "y", "x", L.argmax(F.col("prob")).alias("seg"))
                c = M.connectivity_gradient(seg, self.connectivity, self.classes, self.weight_conn)
                c = at.join(c, ["img", "y", "x"])
                if out is None:
                    out = c
                else:
                    c = c.withColumnRenamed("grad", "more")
                    out = out.join(c, ["img", "y", "x"]).select("img", "y", "x", F.zip_with("grad", "more", lambda a, b: a + b).alias("grad"))
            return out

        self.booster.fit(train, epochs, extra=extra)
        return self

    def predict_proba(self, px: DataFrame) -> DataFrame:
        return self.booster.predict_proba(px)

    def state(self):
        return {"booster": self.booster.state()}

    def restore(self, state, spark, path):
        self.booster = Booster.of(state["booster"])
