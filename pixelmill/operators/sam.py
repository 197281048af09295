"""Refinement of regions by a promptable mask model; the model is the caller's."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.images import narrowest
from ..sources.shared import staged
from . import morphology as M

#: Prompts of one image that go through a decoder together.
PROMPTS = 16


def to_model_image(px: DataFrame) -> DataFrame:
    """(img, ch, y, x, value): three channels, scaled to 0..1 where an image exceeds 1."""
    from .rasters import to_rgb

    top = px.groupBy("img").agg(F.max("b").alias("top_"))
    v = F.when(F.col("top_") > 1, F.col("b") / F.lit(255.0)).otherwise(F.col("b").cast("double"))
    return to_rgb(px).join(top, "img").select("img", "ch", "y", "x", v.alias("value"))


def point_prompt(points: DataFrame) -> DataFrame:
    """(id, coords, labels): a point (x, y, label) as one-row arrays."""
    f = lambda c: F.col(c).cast("float")
    return points.select("id", F.array(F.array(f("x"), f("y"))).alias("coords"), F.array(f("label")).alias("labels"))


def box_prompt(boxes: DataFrame) -> DataFrame:
    """(id, coords, labels): a box (x, y, w, h) as its corners, labelled 2 and 3. A row holds one box."""
    f = lambda c: F.col(c).cast("float")
    corners = F.array(F.array(f("x"), f("y")), F.array(f("x") + f("w"), f("y") + f("h")))
    return boxes.select("id", corners.alias("coords"), F.array(F.lit(2.0).cast("float"), F.lit(3.0).cast("float")).alias("labels"))


def model_masks(tiles: DataFrame, provider: Callable[[], Callable[[bytes, list, list], np.ndarray]]) -> DataFrame:
    """(img, value, ord, y, x) from (img, image binary, coords, labels, value, ord): ``provider`` loads a model once for each
    worker and returns a function from image and prompt to a mask of scores, of which those above 0 count."""

    def run(batches: Iterable[pa.RecordBatch]):
        model = provider()
        for rb in batches:
            for r in rb.to_pylist():
                y, x = np.nonzero(np.asarray(model(r["image"], r["coords"], r["labels"])) > 0)
                n = len(y)
                yield pa.RecordBatch.from_pydict({"img": [r["img"]] * n, "value": [r["value"]] * n, "ord": [r["ord"]] * n, "y": y.astype(np.int32), "x": x.astype(np.int32)})

    kind = tiles.schema["img"].dataType.simpleString()
    return tiles.mapInArrow(run, f"img {kind}, value long, ord long, y int, x int")


def pack_images(px: DataFrame) -> DataFrame:
    """(img, h, w, image, kind): each dense image (img, y, x, b), row by row; missing pixels are 0. ``kind`` is the narrowest kind of
    numbers that holds the image's values: bytes up to 255, wider ones beyond."""

    def pack(key, t):
        y, x = (t.column(c).to_numpy() for c in ("y", "x"))
        b = narrowest(t.column("b").fill_null(0).to_numpy())
        plane = np.zeros((int(y.max()) + 1, int(x.max()) + 1), b.dtype)
        plane[y, x] = b
        return pa.table({"img": pa.array([key[0].as_py()], t.column("img").type), "h": pa.array([plane.shape[0]], pa.int32()), "w": pa.array([plane.shape[1]], pa.int32()), "image": pa.array([plane.tobytes()], pa.binary()), "kind": [plane.dtype.str]})

    kind = px.schema["img"].dataType.simpleString()
    return px.select("img", "y", "x", "b").groupBy("img").applyInArrow(pack, f"img {kind}, h int, w int, image binary, kind string")


def encode(images: DataFrame, provider: Callable[[], Callable[[np.ndarray], np.ndarray]]) -> DataFrame:
    """(img, shape, embedding, kind) of (img, h, w, image), written: every image goes through the encoder once, however many prompts follow.
    ``provider`` loads the encoder once for each task; it turns an array of bytes, or of what the images' ``kind`` says, into one that is
    kept in single precision, or in double where it has whole numbers that single precision does not hold."""

    def run(batches: Iterable[pa.RecordBatch]):
        encoder = provider()
        for rb in batches:
            for i in range(rb.num_rows):
                r = rb.slice(i, 1).to_pylist()[0]
                e = np.asarray(encoder(np.frombuffer(r["image"], r.get("kind") or np.uint8).reshape(r["h"], r["w"])))
                wide = e.dtype.kind in "iu" and e.size and max(-int(e.min()), int(e.max())) > 1 << 24
                e = np.ascontiguousarray(e, np.float64 if wide else np.float32)
                yield pa.RecordBatch.from_arrays([rb.column("img").slice(i, 1), pa.array([list(e.shape)], pa.list_(pa.int32())), pa.array([e.tobytes()], pa.binary()), pa.array([e.dtype.str])], ["img", "shape", "embedding", "kind"])

    kind = images.schema["img"].dataType.simpleString()
    return staged(images.select("img", "h", "w", "image", *(["kind"] if "kind" in images.columns else [])).mapInArrow(run, f"img {kind}, shape array<int>, embedding binary, kind string"), "embeddings")


def prompted_masks(embeddings: DataFrame, prompts: DataFrame, provider: Callable[[], Callable[[np.ndarray, list, list], tuple[np.ndarray, np.ndarray]]], together: int = PROMPTS) -> DataFrame:
    """(img, value, ord, score, y, x): the pixels of each prompt's best mask.

    ``prompts``: (img, coords, labels, value, ord), any number for an image. Those of an image meet its embedding in groups of about
    ``together``, each group one call of the decoder: (embedding, coords, labels) to scores of pixels (prompts, masks, h, w), of which those above 0 count, and
    scores of masks (prompts, masks). Of equally good masks the first counts; prompts of images without embedding find nothing.
    """
    n = prompts.groupBy("img").agg(F.ceil(F.count(F.lit(1)) / together).cast("int").alias("groups_"))
    asked = prompts.join(n, "img").withColumn("group_", F.pmod(F.xxhash64(F.to_json(F.struct("coords", "labels")), "value", "ord"), F.col("groups_")).cast("int"))
    asked = asked.select(*[F.col(c).alias(c) for c in (*prompts.columns, "group_")])  # prompts may come from the embeddings themselves
    held = embeddings.join(n, "img").withColumn("group_", F.explode(F.sequence(F.lit(0), F.col("groups_") - 1))).drop("groups_")
    kind = embeddings.schema["img"].dataType.simpleString()

    def run(key, image, some):
        found = {c: [] for c in ("value", "ord", "score", "y", "x")}
        if image.num_rows and some.num_rows:
            r = image.slice(0, 1).to_pylist()[0]
            decoder, e = provider(), np.frombuffer(r["embedding"], r.get("kind") or np.float32).reshape(r["shape"])
            some = some.sort_by([("ord", "ascending"), ("value", "ascending")])
            for a in range(0, some.num_rows, together):
                part = some.slice(a, together)
                pixels, scores = decoder(e, part.column("coords").to_pylist(), part.column("labels").to_pylist())
                best = np.argmax(scores, 1)
                for k, (value, order) in enumerate(zip(part.column("value").to_pylist(), part.column("ord").to_pylist())):
                    y, x = np.nonzero(pixels[k, best[k]] > 0)
                    for c, v in zip(found, (value, order, float(scores[k, best[k]]), y, x)):
                        found[c].append(np.broadcast_to(v, y.shape))
        made = {c: np.concatenate(v) if v else np.zeros(0) for c, v in found.items()}
        size = len(made["y"])
        return pa.table({"img": pa.array([key[0].as_py()] * size, image.column("img").type), **{c: pa.array(made[c].astype(t)) for c, t in (("value", np.int64), ("ord", np.int64), ("score", float), ("y", np.int32), ("x", np.int32))}})

    return held.groupBy("img", "group_").cogroup(asked.groupBy("img", "group_")).applyInArrow(run, f"img {kind}, value long, ord long, score double, y int, x int")


def box_masks(regions: DataFrame) -> DataFrame:
    """The default provider: every pixel of a region's box. Later classes lie over earlier ones, later regions over earlier ones."""
    r = regions.withColumn("ord", F.struct("seg", "lab")).withColumn("y", F.explode(F.sequence("minr", F.col("maxr") - 1))).withColumn("x", F.explode(F.sequence("minc", F.col("maxc") - 1)))
    return r.select("img", "y", "x", F.col("seg").alias("value"), "ord")


def refine_regions(seg: DataFrame, least: dict[int, int] | None = None, default: int = 225, masks: Callable[[DataFrame], DataFrame] = box_masks) -> DataFrame:
    """Replace what ``masks`` finds for every region that is large enough; a mask may exceed its box."""
    return M.paste_masks(seg, masks(M.candidate_regions(seg, least, default)))
