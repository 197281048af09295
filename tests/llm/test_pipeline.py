"""The pipeline against stages done by brute force, and the registered queries."""

import re

import pytest

import __spark_entry__ as entry
import corpus_pipeline as P
from pixelmill.llm import decontaminate as D
from pixelmill.llm.scratch import Scratch, bucket_value, result

from .test_operators import brute_links, least_distance
from .test_repeats import brute_bytes


def test_names():
    q = entry.queries()
    assert [sum(k.startswith(f"op{n}_") for k in q) for n in range(1, 11)] == [1] * 10 and q["pipeline"].__wrapped__ is P.run
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_dedup", "suffix_array_dedup", "decontamination", "mixing"]
    assert "op7_mixing" in entry.oracle_sql()


def test_stages(spark, sf):
    work = Scratch(spark, "test")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    items = [D.fold(r.text).strip() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    seen = {}
    for name, stage in P.STAGES:
        before, docs = docs, work.keep(stage(spark, docs, sf), name)
        seen[name] = (before, docs)
        if name != "mixing":
            assert docs.columns == before.columns
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    a, b = map(texts, seen["toxicity"])
    assert all(t == a[i] for i, t in b.items())
    assert sum(labels.get(i) == 0 for i in a) == sum(labels.get(i) == 0 for i in b)  # labelled clean documents stay
    assert sum(labels.get(i) == 1 for i in b) <= 0.3 * sum(labels.get(i) == 1 for i in a)
    a, b = map(texts, seen["near_dedup"])
    assert set(b) == {i for i, (_, c) in brute_links([(i, t, "") for i, t in a.items()], P.SIMILAR).items() if c == i}
    a, b = map(texts, seen["suffix_array_dedup"])
    want = {i: (n, gone) for i, n, gone, _, _ in brute_bytes(list(a.items()))}
    assert set(b) == {i for i, (n, gone) in want.items() if gone < n or not n}
    assert all((b[i] == a[i]) == (want[i][1] == 0) and len(b[i].encode()) <= want[i][0] - want[i][1] for i in b)
    a, b = map(texts, seen["decontamination"])
    hit = {i for i, t in a.items() if any(p in D.fold(t) for p in items)}
    assert hit.isdisjoint(b) and len(a) - len(b) <= len(hit) + 2
    for i in set(a) - set(b) - hit:
        assert any(least_distance(p, D.fold(a[i])) <= D.budget(len(p)) for p in items)
    docs, mixed = seen["mixing"]
    size = {r.doc_id: len(re.findall("[^\x20\x09-\x0d]+", r.text or "")) for r in docs.collect()}
    rows = mixed.collect()
    assert {r.doc_id: r.size for r in rows} == size and all(r.taken <= 3 * r.size for r in rows)
    whole = P.run(spark, sf).select("doc_id", "size", "taken").collect()
    assert sorted(map(tuple, whole)) == sorted((r.doc_id, r.size, r.taken) for r in rows)
    work.remove()


def test_near_copies_go_by_row_not_by_number(spark, sf):
    a, b = "one two three four five six seven", "other words that nobody else has here"
    rows = [(3, a), (5, a), (5, b), (None, a), (None, b + " x y z"), (7, ""), (7, None), (8, b), (8, b)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = P.near_dup_out(spark, docs, sf)
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == sorted([("3", a), ("5", b), ("None", b + " x y z"), ("7", ""), ("7", "None")]) and kept.columns == docs.columns


def test_buckets_follow_spark(spark):
    import numpy as np
    from pyspark.sql import functions as F

    b, k = np.arange(7).repeat(5), np.tile(np.arange(5), 7)
    v = bucket_value(b, k)
    df = spark.createDataFrame(list(zip(v.tolist(), b.tolist())), "v long, b int")
    assert len(set(v.tolist())) == 35 and df.filter(F.pmod(F.hash("v"), F.lit(7)) == F.col("b")).count() == 35


def test_scratch_goes_when_a_result_is_written(spark):
    import glob

    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before, tables = set(glob.glob(f"{root}/*")), spark.catalog.listTables()
    docs = spark.createDataFrame([(1, "x y"), (2, None)], "doc_id long, text string")

    def make():
        staged, _ = Scratch(spark, "inner").stage(docs)
        return staged.select("doc_id")

    assert result(spark, "outer", make).count() == 2
    assert [p.rpartition("/")[2].split("-")[0] for p in set(glob.glob(f"{root}/*")) - before] == ["outer"] and len(spark.catalog.listTables()) == len(tables)


@pytest.mark.parametrize("name", sorted(k for k in entry.queries() if k.startswith("op")))
def test_rows_of_queries(spark, sf, name):
    out = entry.queries()[name](spark, sf)
    table = {"op3": "pages", "op12": "embeddings"}.get(name.partition("_")[0], "documents")
    n = spark.read.parquet(f"{sf}/{table}.parquet").count()
    assert out.count() == n if not name.startswith("op1_") else out.count() > 0


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (None, "same same", "en", None, 3), (1, "", None, "a", None), (2, " \t ", "en", "a", 3), (3, "ä" * 90_000, "de", "b", 1), (3, "ä" * 90_000, "de", "b", 1), (4, "one two three four five six", "en", "b", 1), (5, "one two three four five six", "en", "b", 1)]])
def test_stages_on_hard_rows(spark, sf, rows):
    work = Scratch(spark, "hard")
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, component_id string, batch int")
    counts = []
    for name, stage in P.STAGES:
        docs = work.keep(stage(spark, docs, sf), name)
        counts.append(docs.count())
        if name != "mixing":
            assert docs.columns == list(P.COLUMNS)
    # one of both rows of document 3 stays; 5 is a copy of 4
    assert counts == ([0] * 5 if not rows else [8, 6, 6, 6, 6])
    work.remove()
