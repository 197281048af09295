"""MinHash near-dedup: chosen-path set similarity join on word shingles.

Documents with the same set of shingles are one class, and one of them stands for it. In each of several
independent trees a node sends its documents on by the token that has the least value under the node's
hash function; nodes that are small enough are compared exhaustively on the full sets, larger ones branch
again. Two sets with similarity J are together in a tree at level d with probability J**d; ``TREES`` trees find a pair of
similarity 0.85 that is compared at the first level with probability 1 - 1e-10, at the fourth 1 - 1e-4. A node that is
still too large in the last level (thousands of copies that all differ) is first split into blocks that share a few
documents, which join most of it; then all pairs of its documents that are not joined yet are compared, block by block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .scratch import Scratch, result

SHINGLE, TREES, FIRST, LEVELS, LEADERS, SALTS = 5, 12, 2, 6, 4, 16
#: Documents of a node that is compared in the first ``BRANCH`` levels; from then on (what is still together is alike) more
#: documents, but no more shingles than a task holds.
NODE, BRANCH, LARGE, LOAD = 192, 3, 4096, 4_000_000
#: Shingles that a batch sends at once for the block pairs of crowded nodes.
SENT = 8_000_000
_MULT = (np.random.default_rng(20).integers(1, 1 << 62, TREES * LEVELS, dtype=np.uint64) << K.U(1)) | K.U(1)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of each row, rows after each other, and their offsets.

    Fewer words than ``size`` make one shingle of all; no words make none.
    """
    raw = K.LOWER[raw]
    starts, ends, at = K.words(raw, offsets, K.SPACE)
    n = len(offsets) - 1
    words = np.diff(at)
    ids = K.mix(K.word_hashes(raw, starts, ends) + K.U(3))
    rows, grams = [], []
    for a, b in K.row_chunks(at, size):
        if b - a < size:
            continue
        g = K.Rolling(ids[a:b]).grams(size)
        first, last = int(np.searchsorted(at, a, "right")) - 1, int(np.searchsorted(at, b))
        row = np.repeat(np.arange(first, last), np.diff(np.clip(at[first : last + 1], a, b)))[: len(g)]
        ok = np.arange(a, a + len(g)) + size <= at[row + 1]
        rows.append(row[ok])
        grams.append(g[ok])
    short = np.flatnonzero((words > 0) & (words < size))
    if len(short):
        h = np.zeros(len(short), np.uint64)
        for j in range(size - 1):
            more = words[short] > j
            h[more] = K.mix(h[more] * K.U(0x9E3779B97F4A7C15) + ids[at[short][more] + j])
        rows.append(short)
        grams.append(h)
    if not rows:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    row, gram = np.concatenate(rows), np.concatenate(grams)
    order = np.argsort(gram)
    order = order[np.argsort(row[order].astype(np.int32), kind="stable")]
    row, gram = row[order], gram[order]
    new = np.append(True, (row[1:] != row[:-1]) | (gram[1:] != gram[:-1]))
    row, gram = row[new], gram[new]
    return gram, np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n))))


def paths(grams: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per row and tree the path keys of all levels: a key tells the tokens chosen so far. Rows must not be empty."""
    n = len(offsets) - 1
    out = np.empty((n, TREES, LEVELS), np.uint64)
    for t in range(TREES):
        key = np.full(n, t + 1, np.uint64)
        for d in range(LEVELS):
            low = np.minimum.reduceat(grams * _MULT[t * LEVELS + d], offsets[:-1])
            key = K.mix(key * K.U(0x9E3779B97F4A7C15) + low)
            out[:, t, d] = key
    return out


_SIGNED = "batch long, doc_id long, n_shingles long, class1 long, class2 long, paths binary"


def signatures(corpus: DataFrame) -> DataFrame:
    """Per row: the size of its set, two hashes that tell sets apart, and its paths (empty without shingles)."""

    def run(batches):
        for whole in batches:
            for rb in K.text_slices(whole):
                grams, offsets = shingle_sets(*K.text_buffer(rb.column("text")))
                n = np.diff(offsets)
                some = n > 0
                c1, c2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                found: list[bytes] = [b""] * len(n)
                if some.any():
                    heads = offsets[:-1][some]
                    c1[some] = np.add.reduceat(K.mix(grams + K.U(11)), heads)
                    c2[some] = np.add.reduceat(K.mix(grams ^ K.U(0xABCDEF)), heads)
                    p = paths(grams, np.append(heads, len(grams)))
                    for i, x in zip(np.flatnonzero(some).tolist(), p.reshape(len(p), -1)):
                        found[i] = x.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [rb.column("batch"), rb.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)), pa.array(found, pa.binary())],
                    ["batch", "doc_id", "n_shingles", "class1", "class2", "paths"],
                )

    return corpus.select("batch", "doc_id", "text").mapInArrow(run, _SIGNED)


def _salted(rows: DataFrame, on: list[str], table: DataFrame) -> DataFrame:
    """Left join of ``rows`` with a ``table`` that has one row for each key; keys that many rows share are spread by salts."""
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    spread = table.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt_", salt).join(spread, [*on, "salt_"], "left").drop("salt_")


def _keys_at(reps: DataFrame, level: int, trees: range) -> DataFrame:
    """(doc_id, batch, n, part, before, key), a row for each of the trees: the path keys of a level and of the one before."""
    pick = np.array(trees)

    def run(batches):
        for rb in batches:
            keys = np.frombuffer(b"".join(rb.column("paths").to_pylist()), np.int64).reshape(-1, TREES, LEVELS)[:, pick].reshape(-1, LEVELS)
            rep = lambda c: pa.array(np.repeat(rb.column(c).to_numpy(), len(pick)))
            before = keys[:, level - 1] if level else np.zeros(len(keys), np.int64)
            yield pa.RecordBatch.from_arrays(
                [rep("doc_id"), rep("batch"), rep("n_shingles"), rep("part"), pa.array(np.ascontiguousarray(before)), pa.array(np.ascontiguousarray(keys[:, level]))],
                ["doc_id", "batch", "n", "part", "before", "key"],
            )

    return reps.select("doc_id", "batch", "n_shingles", "part", "paths").mapInArrow(run, "doc_id long, batch long, n long, part long, before long, key long")


def branch(work: Scratch, reps: DataFrame, trees: range) -> tuple[DataFrame, DataFrame | None]:
    """(node, doc_id, batch, n): the small nodes of some trees, those whose documents are all in one ``part`` already left out;
    and (key, doc_id, batch, n) of the nodes that are too large in the last level, if any, for ``block_pairs``.

    Joins whose both sides grow with the corpus are merge joins at every size. Rows move by key only with what a node needs; the rows of an oversized node are an even split for
    Spark's skew join. The keys of oversized nodes alone go on to the next level.
    """
    out, hot = None, None
    for d in range(LEVELS):
        rows = _keys_at(reps, d, trees)
        if hot is not None:
            rows = rows.join(hot.select(F.col("key").alias("before")), "before", "left_semi")
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("load"), F.min("part").alias("lo"), F.max("part").alias("hi"))
        fits = (F.col("size") <= (NODE if d < BRANCH else LARGE)) & (F.col("load") <= LOAD)
        sizes = work.keep(sizes.filter("lo < hi").select("key", "size", "load", fits.alias("fits")), f"sizes{trees.start}_{d}")
        rows = rows.select("key", "doc_id", "batch", "n")
        small = rows.join(sizes.filter("fits").select("key").hint("merge"), "key", "left_semi").withColumnRenamed("key", "node")
        small = work.keep(small, f"small{trees.start}_{d}")  # keeps the plan of all levels together short
        out = small if out is None else out.unionByName(small)
        hot = sizes.filter("not fits").select("key", "size", "load")
        if not hot.head(1):
            return out, None
    # blocks of documents in an order of their own for each node, and the leaders of the node in each block
    left = work.keep(rows.join(hot, "key"), f"left{trees.start}")
    leads = left.groupBy("key").agg(*[F.min_by("doc_id", F.xxhash64("doc_id", F.lit(i))).alias(f"lead{i}") for i in range(LEADERS)])
    leads = leads.select("key", F.array(*[f"lead{i}" for i in range(LEADERS)]).alias("leads"))
    blocks = F.ceil(F.greatest(F.col("size") / NODE, F.col("load") / LOAD)).cast("int")
    block = F.pmod(F.xxhash64("doc_id", "key"), blocks).cast("int")
    dealt = left.join(leads, "key").withColumn("block", F.explode(F.when(F.array_contains("leads", F.col("doc_id")), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(block))))
    return out.unionByName(dealt.select(F.xxhash64("key", F.lit("block"), "block").alias("node"), "doc_id", "batch", "n")), left.drop("size", "load")


def block_pairs(left: DataFrame, joined: DataFrame) -> DataFrame:
    """(node, doc_id, batch, n, part): nodes in which any two documents of a crowded node meet that are not in one part.

    The documents of the node's largest part and the others are cut into blocks of half a task's size; two blocks make a
    node, unless both are of the largest part.
    """
    rows = left.join(joined.hint("merge"), "doc_id", "left").withColumn("part", F.coalesce("component", "doc_id")).drop("component")
    parts = rows.groupBy("key", "part").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("load"))
    most = parts.groupBy("key").agg(F.max(F.struct("size", "part", "load")).alias("most"), F.sum("size").alias("size"), F.sum("load").alias("load"))
    blocks = lambda size, load: F.ceil(F.greatest(size / (LARGE / 2), load / (LOAD / 2))).cast("int")
    cut = most.filter("size > most.size").select(
        "key", F.col("most.part").alias("main"), blocks(F.col("most.size"), F.col("most.load")).alias("a"), blocks(F.expr("size - most.size"), F.expr("load - most.load")).alias("b")
    )
    hashed = lambda n: F.pmod(F.xxhash64("doc_id", "key"), F.col(n)).cast("int")
    dealt = rows.join(cut, "key").withColumn("own", F.when(F.col("part") == F.col("main"), hashed("a")).otherwise(F.col("a") + hashed("b")))
    others = F.when(F.col("part") == F.col("main"), F.sequence(F.col("a"), F.expr("a + b - 1"))).otherwise(F.array_remove(F.sequence(F.lit(0), F.expr("a + b - 1")), F.col("own")))
    dealt = dealt.withColumn("other", F.explode(others))
    return dealt.select(F.xxhash64("key", F.lit("pair"), F.least("own", "other"), F.greatest("own", "other")).alias("node"), "doc_id", "batch", "n", "part")


def distinct_nodes(nodes: DataFrame, percent: int) -> DataFrame:
    """(node, members): documents with a partner of fitting size only, and each set of members once; with a ``part`` no node of one part."""
    own = ["part"] if "part" in nodes.columns else []
    fits = lambda a, b: a["n"] * 100 >= b["n"] * percent
    both = nodes.groupBy("node").agg(F.array_sort(F.collect_set(F.struct("n", "doc_id", "batch", *own))).alias("m"))
    near = F.filter("m", lambda x, i: (F.coalesce(fits(F.get("m", i - 1), x), F.lit(False)) | F.coalesce(fits(x, F.get("m", i + 1)), F.lit(False))))
    kept = both.select("node", near.alias("m")).filter(F.size(F.array_distinct(F.transform("m", lambda x: x[own[0]]))) > 1 if own else F.size("m") > 1)
    return kept.groupBy(F.transform("m", lambda x: x["doc_id"]).alias("ids")).agg(F.min(F.struct("node", "m")).alias("one")).select("one.node", F.col("one.m").alias("members"))


def _send(table: pa.Table, asked: pa.Table) -> pa.Table:
    """The sets of the documents asked for, once for each node."""
    node, ids, parts, blobs = [], [], [], []
    if table.num_rows and asked.num_rows:
        want: dict[int, list[tuple[int, int]]] = {}
        for n, i, p in zip(asked.column("node").to_pylist(), asked.column("doc_id").to_pylist(), asked.column("part").to_pylist()):
            want.setdefault(i, []).append((n, p))
        mine = table.filter(pa.compute.is_in(table.column("doc_id"), pa.array(list(want), pa.int64())))
        for rb in mine.combine_chunks().to_batches():
            for part in K.text_slices(rb):
                grams, offsets = shingle_sets(*K.text_buffer(part.column("text")))
                for k, i in enumerate(part.column("doc_id").to_pylist()):
                    blob = grams[offsets[k] : offsets[k + 1]].tobytes()
                    for n, p in want[i]:
                        node.append(n)
                        ids.append(i)
                        parts.append(p)
                        blobs.append(blob)
    return pa.table({"node": pa.array(node, pa.int64()), "doc_id": pa.array(ids, pa.int64()), "part": pa.array(parts, pa.int64()), "shingles": pa.array(blobs, pa.binary())})


def links_in(ids: np.ndarray, sets: list[np.ndarray], percent: int, parts: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between documents of a node, as many as connect what is connected: pairs already joined (in ``parts`` or here) are passed over."""
    order = np.argsort(np.array([len(s) for s in sets]), kind="stable")
    ids, sets = ids[order], [sets[i] for i in order]
    size = np.array([len(s) for s in sets])
    m = len(sets)
    part = np.arange(m) if parts is None else np.unique(parts[order], return_inverse=True)[1]
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.concatenate(([0], np.cumsum(size)))
    flag = np.zeros(int(token.max(initial=-1)) + 1, bool)
    out = []
    for i in range(m - 1):
        end = int(np.searchsorted(size, size[i] * 100 // percent, "right"))
        others = np.flatnonzero(part[i + 1 : end] != part[i]) + i + 1
        if not len(others):
            continue
        mine = token[at[i] : at[i + 1]]
        flag[mine] = True
        if 2 * len(others) > end - i - 1:
            both = np.add.reduceat(flag[token[at[i + 1] : at[end]]], at[i + 1 : end] - at[i + 1], dtype=np.int64)[others - i - 1]
        else:
            theirs = np.concatenate([token[at[j] : at[j + 1]] for j in others])
            both = np.add.reduceat(flag[theirs], np.cumsum(size[others]) - size[others], dtype=np.int64)
        flag[mine] = False
        for j in others[100 * both >= percent * (size[i] + size[others] - both)]:
            if part[j] != part[i]:
                part[part == part[j]] = part[i]
                out.append((int(ids[i]), int(ids[j])))
    return out


def _compare(percent: int):
    def run(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        ids, parts = table.column("doc_id").to_numpy(), table.column("part").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        order = np.argsort(node, kind="stable")
        cut = np.flatnonzero(np.append(True, node[order][1:] != node[order][:-1]))
        out: set[tuple[int, int]] = set()
        for i, j in zip(cut, np.append(cut[1:], len(order))):
            if j - i > 1:
                k = order[i:j]
                out.update((min(p), max(p)) for p in links_in(ids[k], [sets[x] for x in k], percent, parts[k]))
        a, b = zip(*sorted(out)) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _links(corpus: DataFrame, nodes: DataFrame, n_batches: int, percent: int) -> DataFrame:
    """(a, b): links within nodes, found on the full sets."""
    load = nodes.agg(F.sum(F.aggregate("members", F.lit(0).cast("long"), lambda a, x: a + x["n"]))).first()[0] or 0
    parts = max(12, n_batches, load * 8 // (4 << 20))
    asked = nodes.select("node", F.explode("members").alias("m")).select("node", "m.*")
    asked = asked.select("node", "doc_id", "batch", F.col("part" if "part" in asked.columns else "doc_id").alias("part"))
    sent = corpus.groupBy("batch").cogroup(asked.groupBy("batch")).applyInArrow(_send, "node long, doc_id long, part long, shingles binary")
    return sent.withColumn("task", F.pmod(F.xxhash64("node"), F.lit(parts))).groupBy("task").applyInArrow(_compare(percent), "a long, b long")


def components(work: Scratch, links: DataFrame, name: str = "edges") -> DataFrame:
    """(doc_id, component): the least document reachable, for all that have links; alternating large and small stars."""
    edges, k = work.keep(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}0"), 0
    before = last = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if state == before and not edges.join(last, ["u", "v"], "left_anti").head(1):  # the same set twice
            return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("component"))
        before, last = state, edges
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).withColumn("w", F.least("u", "w"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("w").alias("v")).filter("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("w"))
        star = large.join(small, "u").select(F.col("v").alias("x"), "w", "u")
        after = star.filter("x <> w").select(F.col("x").alias("u"), F.col("w").alias("v")).unionByName(star.select("u", F.col("w").alias("v"))).distinct()
        k += 1
        edges = work.keep(after, f"{name}{k}")


def near_duplicates(spark: SparkSession, docs: DataFrame, percent: int = 85) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (least doc_id reachable over links), kept (doc_id = component_id).

    A link is a pair of sets of five-word shingles with 100 * intersection >= ``percent`` * union, both not empty.
    Null or empty texts have no shingles and no links; a null doc_id has a null component and is kept. Rows that repeat a doc_id
    with the same text have the same result; with different texts each row counts with its own set. An empty
    table gives an empty result. Only doc_id and text are used.
    """
    work = Scratch(spark, "near")
    corpus, n_batches = work.stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return _linked(work, corpus, n_batches, percent)


def deduplicate(spark: SparkSession, docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, without near copies: of each group of linked rows one stays, that with the
    smallest doc_id (null after all others), and of rows that repeat it any one.

    Rows are told apart by a number of their own, so different texts under one doc_id do not go with each other, and exact
    repeats of a row are copies like others. Rows without words (null or empty texts) are linked with nothing and stay. An
    empty table gives an empty result.
    """
    work = Scratch(spark, "near")
    named = docs.select(F.monotonically_increasing_id().alias("row_no"), F.col("doc_id").cast("long").alias("order_id"), F.struct("*").alias("row"))
    corpus, n_batches = work.stage(named, text="row.text")
    found = _linked(work, corpus.select("batch", F.col("row_no").alias("doc_id"), F.col("row.text").cast("string").alias("text")), n_batches, percent)
    found = work.keep(found.select(F.col("doc_id").alias("row_no"), F.col("component_id").alias("group_no")), "groups")
    # groups of more than one row; the one that stays has the least (order_id, row_no)
    several = found.groupBy("group_no").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("group_no")
    ranked = corpus.select("batch", "row_no", "order_id").join(found.join(several.hint("merge"), "group_no", "left_semi").hint("merge"), "row_no")
    first = F.min(F.struct(F.col("order_id").isNull().alias("last"), "order_id", "row_no")).alias("first")
    stays = ranked.groupBy("group_no").agg(first).select(F.col("first.row_no").alias("row_no"))
    gone = work.keep(ranked.select("batch", "row_no").join(stays.hint("merge"), "row_no", "left_anti"), "gone")
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(docs.schema)

    def keep(table: pa.Table, gone: pa.Table) -> pa.Table:
        table = table.filter(pa.compute.invert(pa.compute.is_in(table.column("row_no"), gone.column("row_no"))))
        if not table.num_rows:
            return schema.empty_table()
        return pa.Table.from_arrays([pa.chunked_array(c) for c in zip(*(x.flatten() for x in table.column("row").chunks))], names=schema.names).cast(schema)

    # numbers of rows that go meet the texts by batch, so texts do not move
    return corpus.select("batch", "row_no", "row").groupBy("batch").cogroup(gone.groupBy("batch")).applyInArrow(keep, docs.schema)


def _linked(work: Scratch, corpus: DataFrame, n_batches: int, percent: int) -> DataFrame:
    """``near_duplicates`` over a staged (batch, doc_id, text)."""
    signed = work.keep(signatures(corpus), "signed")
    has = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = work.keep(has.groupBy("class1", "class2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows")), "classes")
    many = classes.filter("rows > 1").select("class1", "class2", "n_shingles", "rep")
    # a class is represented by one row; a class of one row by itself
    reps = _salted(has, ["class1", "class2", "n_shingles"], many).filter("rep is null or rep = doc_id").select("doc_id", "batch", "n_shingles", "paths")
    reps = work.keep(reps, "reps")
    ids = work.keep(signed.select("doc_id", "n_shingles", "class1", "class2"), "ids")
    work.drop("signed")
    # the first trees join most of what belongs together; the others look only at nodes that are not joined yet
    links = joined = crowded = None
    for trees in (range(FIRST), range(FIRST, TREES)):
        parted = reps.withColumn("part", F.col("doc_id")) if joined is None else reps.join(joined.hint("merge"), "doc_id", "left").withColumn("part", F.coalesce("component", "doc_id"))
        if joined is not None:
            parted = work.keep(parted.select("doc_id", "batch", "n_shingles", "part", "paths"), "parted")
            work.drop("reps")
        nodes, left = branch(work, parted, trees)
        crowded = left if crowded is None else crowded.unionByName(left) if left is not None else crowded
        nodes = work.keep(distinct_nodes(nodes, percent), f"nodes{trees.start}")
        found = work.keep(_links(corpus, nodes, n_batches, percent), f"links{trees.start}")
        links = found if links is None else links.unionByName(found)
        joined = components(work, links, f"edges{trees.start}_")
    if crowded is not None:
        nodes = work.keep(distinct_nodes(block_pairs(crowded, joined), percent), "nodes_pairs")
        most = nodes.select(F.explode("members").alias("m")).groupBy("m.batch").agg(F.sum("m.n").alias("n")).agg(F.max("n")).first()[0] or 0
        rounds = -(-most // SENT)
        for k in range(rounds):
            some = nodes.filter(F.pmod(F.xxhash64("node"), F.lit(rounds)) == k)
            links = links.unionByName(work.keep(_links(corpus, some, n_batches, percent), f"links_pairs{k}"))
        if rounds:
            joined = components(work, links, "edges_pairs")
    comp = joined.select(F.col("doc_id").alias("rep"), "component")
    # components by class; every class with more than one row or with links
    by_class = classes.join(comp, "rep", "left").filter("rows > 1 or component is not null").select("class1", "class2", "n_shingles", F.coalesce("component", "rep").alias("component"))
    rows = _salted(ids, ["class1", "class2", "n_shingles"], by_class)
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")
    return rows.select("doc_id", "n_shingles", found).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result(spark, "op9", lambda: near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")))
