"""License scans by diagonal voting.

Every two and every three neighbouring words of every document are hashed; Spark joins the hashes to their places in
the license templates, where the words themselves must agree too. Each hit votes for the diagonal (place in the text minus place in
the template) it lies on; neighbouring diagonals are merged, and a merged span is verified by the longest chain of its hits that runs
forward in both the text and the template.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from . import license_texts as L
from .scratch import Scratch, result

#: Words to a gram; templates of fewer words are one gram of all their words, of ``SHORT`` at least.
GRAM, SHORT = 3, 2
#: In place of a gram: where there is none, and after the last of every row.
NONE, MARK = 2, 0


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    base: bool = False
    #: Share of the template's grams that a verified span must hold, in order.
    share: float = 1.0


TEMPLATES = (
    Template("cc-by", "cc by", base=True),
    Template("gpl", "general public license", base=True),
    Template("reserved", "all rights reserved", base=True),
    Template("apache", "licensed under the apache license"),
    Template("mit", "released under the mit license"),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("mpl", "mozilla public license"),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc-by", "creative commons attribution"),
    Template("mit", L.MIT, share=0.6),
    Template("mit", L.MIT_WARRANTY, share=0.6),
    Template("bsd", L.BSD, share=0.6),
    Template("isc", L.ISC, share=0.6),
    Template("apache", L.APACHE, share=0.6),
    Template("gpl-notice", L.GPL, share=0.6),
    Template("lgpl", L.LGPL, share=0.8),
    Template("agpl", L.AGPL, share=0.8),
    Template("mpl", L.MPL, share=0.6),
    Template("unlicense", L.UNLICENSE, share=0.6),
    Template("boost", L.BOOST, share=0.6),
    Template("zlib", L.ZLIB, share=0.6),
)


def template_words(text: str) -> list[str]:
    raw = K.LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = K.words(raw, np.array([0, len(raw)]), K.NOT_ALNUM)
    return [raw[a:b].tobytes().decode() for a, b in zip(starts, ends)]


def _grams(ids: np.ndarray, k: int) -> np.ndarray:
    """A signed 64-bit hash of each word with the next k - 1, one for each word; all are odd, ``NONE`` stands where words end."""
    out = np.full(len(ids), NONE, np.uint64)
    if len(ids) >= k:
        h = ids[: len(ids) - k + 1]
        for i in range(1, k):
            h = K.mix(h * K.U(0x9E3779B97F4A7C15) + ids[i : len(ids) - k + 1 + i])
        out[: len(h)] = h + K.U(k) | K.U(1)
    return out.view(np.int64)


def _template_rows(templates) -> list[tuple[int, int, int, str]]:
    rows = []
    for i, t in enumerate(templates):
        w = template_words(t.text)
        if len(w) < SHORT:
            raise ValueError(f"a template has at least {SHORT} words: {t.text!r}")
        k = min(GRAM, len(w))
        raw = np.frombuffer(" ".join(w).encode(), np.uint8)
        s, e, _ = K.words(raw, np.array([0, len(raw)]), K.NOT_ALNUM)
        g = _grams(K.word_hashes(raw, s, e), k)
        rows += [(int(g[p]), i, p, " ".join(w[p : p + k])) for p in range(len(w) - k + 1)]
    return rows


def template_grams(spark: SparkSession, templates) -> DataFrame:
    """(gram, template, tpos, phrase), one row per place in a template; as large as the templates are. ``MARK`` tells rows."""
    return spark.createDataFrame([(MARK, -1, 0, ""), *_template_rows(templates)], "gram long, template int, tpos int, phrase string")


def document_grams(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Per row: row_id, doc_id, n_words, and all rolling grams: of two and of three words for each word in turn, then a mark that
    every row has. ``phrases``: beside a gram whose hash is a template's, the words themselves."""
    known = np.unique(np.array([r[0] for r in _template_rows(templates)], np.int64))
    seen = np.zeros(1 << 16, bool)
    seen[known.view(np.uint64) >> K.U(48)] = True

    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for whole in batches:
            for rb in K.text_slices(whole, most=1 << 20):
                raw, offsets = K.text_buffer(rb.column("text"))
                raw = K.LOWER[raw]
                starts, ends, at = K.words(raw, offsets, K.NOT_ALNUM)
                n, words = np.diff(at), len(starts)
                ids = K.word_hashes(raw, starts, ends)
                left = np.repeat(at[1:], n) - np.arange(words)  # words to the end of the row
                both = np.stack([np.where(left >= k, _grams(ids, k), NONE) for k in (SHORT, GRAM)], 1).ravel()
                cut = np.concatenate(([0], np.cumsum(2 * n + 1)))
                out = np.full(int(cut[-1]), MARK, np.int64)
                place = np.repeat(cut[:-1] - 2 * at[:-1], 2 * n) + np.arange(2 * words)
                out[place] = both
                maybe = np.flatnonzero(seen[both.view(np.uint64) >> K.U(48)])
                hit = maybe[np.isin(both[maybe], known)]
                phrases = np.full(len(out), None, object)
                for i in hit.tolist():
                    w, k = i // 2, (SHORT, GRAM)[i % 2]
                    phrases[place[i]] = " ".join(raw[starts[x] : ends[x]].tobytes().decode("utf-8", "replace") for x in range(w, w + k))
                offs = pa.array(cut.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + np.arange(rb.num_rows)), rb.column("doc_id"), pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(offs, pa.array(out)), pa.ListArray.from_arrays(offs, pa.array(phrases, pa.string()))],
                    ["row_id", "doc_id", "n_words", "grams", "phrases"],
                )
                row += rb.num_rows

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "row_id long, doc_id long, n_words long, grams array<long>, phrases array<string>")


_SPANS = "row_id long, template int, start long, votes int"


def longest_chain(pairs: list[tuple[int, int]]) -> int:
    """The most of (place in the text, place in the template) that run forward in both."""
    tails: list[int] = []
    for _, t in sorted(pairs, key=lambda p: (p[0], -p[1])):
        k = bisect_left(tails, t)
        tails[k : k + 1] = [t]
    return len(tails)


def _verified(batches):
    for rb in batches:
        votes = [longest_chain([(h["pos"], h["tpos"]) for h in hits]) for hits in rb.column("hits").to_pylist()]
        yield pa.RecordBatch.from_arrays([rb.column("row_id"), rb.column("template"), rb.column("start"), pa.array(votes, pa.int32())], ["row_id", "template", "start", "votes"])


def license_spans(spark: SparkSession, docs: DataFrame, templates=TEMPLATES, gap: int = 3) -> DataFrame:
    """Verified spans: row_id, doc_id, n_words, and per row an array ``spans`` of (template, start, share).

    A row without spans, empty or null texts included, has an empty array; rows are never merged, even where
    a doc_id repeats. ``gap``: diagonals at most so far apart are merged, of templates that need not be held whole; ``start`` is a
    span's first diagonal, at least 0, ``share`` the grams of its longest chain as a share of the template's. Of equally long
    chains any will do, as they count alike. Columns other than doc_id and text are not used.
    """
    marked = document_grams(docs, templates).select("row_id", "doc_id", "n_words", F.posexplode(F.arrays_zip("grams", "phrases")).alias("at", "g"))
    marked = marked.select("row_id", "doc_id", "n_words", F.shiftright("at", 1).alias("pos"), F.col("g.grams").alias("gram"), F.col("g.phrases").alias("phrase"))
    hits = marked.join(F.broadcast(template_grams(spark, templates)).withColumnRenamed("phrase", "words"), "gram").filter("template < 0 or phrase = words")
    return _merge(Scratch(spark, "licenses").keep(hits.select("row_id", "doc_id", "n_words", "template", "tpos", "pos"), "hits"), templates, gap)


def _merge(hits: DataFrame, templates, gap: int) -> DataFrame:
    of = lambda value: F.element_at(F.array(*[F.lit(value(t)) for t in templates]), F.col("template") + 1)
    size = of(lambda t: max(1, len(template_words(t.text)) - GRAM + 1))
    w = Window.partitionBy("row_id", "template").orderBy("diagonal")
    votes = hits.filter("template >= 0").groupBy("row_id", "template", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.collect_set(F.struct("pos", "tpos")).alias("held"))
    apart = (F.col("diagonal") - F.lag("diagonal").over(w) > of(lambda t: 0 if t.share == 1.0 else gap)) | F.lag("diagonal").over(w).isNull()
    runs = votes.withColumn("new", apart.cast("int")).withColumn("run", F.sum("new").over(w))
    spans = runs.groupBy("row_id", "template", "run").agg(F.greatest(F.min("diagonal"), F.lit(0)).cast("long").alias("start"), F.flatten(F.collect_list("held")).alias("hits"))
    spans = spans.filter(F.size("hits") >= size * of(lambda t: t.share))  # no chain is longer than its hits
    spans = spans.select("row_id", "template", "start", "hits").mapInArrow(_verified, _SPANS)
    spans = spans.withColumn("share", F.col("votes") / size).filter(F.col("share") >= of(lambda t: t.share))
    per_row = spans.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("template", "start", "share"))).alias("spans"))
    rows = hits.filter("template < 0").select("row_id", "doc_id", "n_words")
    empty = F.lit([]).cast("array<struct<template:int,start:long,share:double>>")
    return rows.join(per_row, "row_id", "left").withColumn("spans", F.coalesce("spans", empty))


def scan(spark: SparkSession, docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (largest share of a template).

    Null and empty texts have no words, no labels and score 0; every row is scanned on its own, so repeated rows and null ids give
    repeated rows; an empty table gives none.
    """
    spans = license_spans(spark, docs, templates)
    label = lambda t: F.element_at(F.array(*[F.lit(x.label) for x in templates]), t + 1)
    base = F.filter("spans", lambda s: F.array_contains(F.array(*[F.lit(i) for i, x in enumerate(templates) if x.base]), s["template"]))
    names = lambda c: F.array_join(F.sort_array(F.array_distinct(F.transform(c, lambda s: label(s["template"])))), ",")
    starts = lambda c: F.transform(c, lambda s: s["start"])
    return spans.withColumn("base", base).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts(F.col("base"))).alias("first_word"), F.array_max(starts(F.col("base"))).alias("last_word"),
        names(F.col("base")).alias("base_labels"), names(F.col("spans")).alias("labels"), F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)).alias("score"),
    )


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result(spark, "op4", lambda: scan(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")))
