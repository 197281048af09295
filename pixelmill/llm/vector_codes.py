"""Codes for vectors: product quantisation with exact integer centres, nearest entries found by trees of balls.

A vector's components become integers, and it is cut into equal parts with a codebook each. An entry is sought in a tree of
balls over its codebook, built anew for every round: a ball is passed over only where even its nearest point must be farther than the best so far.
Bounds are floating point and rounded to the safe side, a tie is always looked at, and what decides are integer distances.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, result

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Entries in a leaf; integers below this are exact in 64 bits, with parts of up to 2**7 components and their sums over a task.
LEAF, SMALL = 16, 1 << 27
#: A long that no error exceeds; relative rounding of a bound, well above that of its terms.
MOST, SLACK = (1 << 63) - 1, 1e-9
LIMB = 40


def integers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x): 64-bit integers where all are small, Python's otherwise."""
    if not x.size or np.abs(x).max() < SMALL / scale:
        return np.floor(x * scale).astype(np.int64)
    return np.array([math.floor(v * scale) if abs(v) < 2.0**900 else int(v) * scale for v in x.ravel().tolist()], object).reshape(x.shape)


def small(x: np.ndarray) -> bool:
    return x.dtype != object and x.shape[-1] <= 1 << 7


class Ball:
    """A node: the entries below it lie within ``radius`` of ``centre``."""

    def __init__(self, entries: np.ndarray, at: np.ndarray):
        own = entries[at]
        self.centre = own.mean(axis=0)
        self.radius = math.nextafter(float(np.sqrt(((own - self.centre) ** 2).sum(axis=1)).max(initial=0.0)) * (1 + SLACK), math.inf)
        self.at, self.children = at, ()
        if len(at) > LEAF:
            far = own[np.argmax(((own - self.centre) ** 2).sum(axis=1))]
            farther = own[np.argmax(((own - far) ** 2).sum(axis=1))]
            order = np.argsort(own @ (far - farther), kind="stable")
            half = len(at) // 2
            self.children = (Ball(entries, np.sort(at[order[:half]])), Ball(entries, np.sort(at[order[half:]])))


class Book:
    """A codebook and its tree."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.floats = entries, entries.astype(np.float64)
        self.root = Ball(self.floats, np.arange(len(entries))) if len(entries) else None

    def nearest(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each row's nearest entry, the lower index of equally near ones."""
        exact = small(part) and small(self.entries)
        q, e = (part, self.entries) if exact else (part.astype(object), self.entries.astype(object))
        floats = part.astype(np.float64)
        index, distance = np.zeros(len(part), np.int64), np.full(len(part), -1, np.int64 if exact else object)

        def visit(ball: Ball, rows: np.ndarray, reach: np.ndarray) -> None:
            """``reach``: distances from the rows to the ball's centre."""
            least = np.maximum(reach * (1 - SLACK) - ball.radius, 0)
            best = distance[rows]
            open_ = (best < 0) | (least * least * (1 - SLACK) <= best.astype(np.float64) * (1 + SLACK))
            rows = rows[open_]
            if not len(rows):
                return
            if not ball.children:
                d = ((q[rows][:, None, :] - e[ball.at][None, :, :]) ** 2).sum(axis=2)
                d = d.reshape(len(rows), len(ball.at))
                at = np.argmin(d, axis=1)
                near, found = d[np.arange(len(rows)), at], ball.at[at]
                better = (distance[rows] < 0) | (near < distance[rows]) | ((near == distance[rows]) & (found < index[rows]))
                distance[rows[better]], index[rows[better]] = near[better], found[better]
                return
            to = np.stack([np.sqrt(((floats[rows] - c.centre) ** 2).sum(axis=1)) for c in ball.children])
            left = to[0] <= to[1]
            for first in (True, False):  # the nearer child goes first
                for k in (0, 1):
                    mine = left == ((k == 0) == first)
                    if mine.any():
                        visit(ball.children[k], rows[mine], to[k][mine])

        if self.root is not None and len(part):
            visit(self.root, np.arange(len(part)), np.sqrt(((floats - self.root.centre) ** 2).sum(axis=1)))
        return index, distance


def limbs(value: int) -> list[int]:
    """A whole number as digits of base 2**LIMB, all with its sign, so that sums of them fit."""
    sign, value, out = (-1 if value < 0 else 1), abs(value), []
    while value:
        out.append(sign * (value & ((1 << LIMB) - 1)))
        value >>= LIMB
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _cut(rb: pa.RecordBatch, books: list[Book]):
    """The parts of a batch's vectors as integers; a batch with few large numbers is split, so that only those rows are slow."""
    x = _matrix(rb.column("vector"))
    large = np.abs(x).max(axis=1, initial=0) >= SMALL / SCALE
    for rows in (np.flatnonzero(~large), np.flatnonzero(large)):
        if len(rows):
            v = integers(x[rows])
            wide = v.shape[1] // len(books)
            yield rows, [(k, v[:, k * wide : (k + 1) * wide], book) for k, book in enumerate(books)]


def _sums(books: list[Book], entries: int):
    """Per part, entry and position: the sum of a task's integers, in limbs; position -1 counts."""

    def run(batches):
        n = np.zeros((len(books), entries), np.int64)
        wide = books[0].entries.shape[1]
        total, much = np.zeros((len(books), entries, wide), np.int64), {}
        for rb in batches:
            for _, parts in _cut(rb, books):
                for k, v, book in parts:
                    at, _ = book.nearest(v)
                    n[k] += np.bincount(at, minlength=entries)
                    if v.dtype != object:
                        np.add.at(total[k], at, v)
                    else:
                        for i, row in zip(at.tolist(), v):
                            for j, value in enumerate(row):
                                much[k, i, j] = much.get((k, i, j), 0) + value
        out = [(int(k), int(e), -1, 0, int(n[k, e])) for k, e in zip(*np.nonzero(n))]
        for k, e, _, _, _ in list(out):
            for j in range(wide):
                out += [(k, e, j, i, x) for i, x in enumerate(limbs(int(total[k, e, j]) + much.get((k, e, j), 0)))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["part", "entry", "position", "limb", "total"])

    return run


def refined(vectors: DataFrame, books: list[Book]) -> list[Book]:
    """Entries become the floor of their parts' means; an entry without parts stays. What reaches the driver has the size of the codebooks."""
    entries = len(books[0].entries)
    rows = vectors.mapInArrow(_sums(books, entries), "part int, entry int, position int, limb int, total long").groupBy("part", "entry", "position", "limb").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    total: dict[tuple, int] = {}
    for r in rows:
        key = r["part"], r["entry"], r["position"]
        total[key] = total.get(key, 0) + (int(r["total"]) << (LIMB * r["limb"]))
    out = []
    for k, book in enumerate(books):
        new = [[int(v) if not total.get((k, e, -1)) else total.get((k, e, j), 0) // total[k, e, -1] for j, v in enumerate(row)] for e, row in enumerate(book.entries.tolist())]
        large = any(abs(v) >= SMALL for row in new for v in row)
        out.append(Book(np.array(new, object if large else np.int64).reshape(book.entries.shape)))
    return out


def _coded(books: list[Book]):
    def run(batches):
        for rb in batches:
            code, error = np.zeros((rb.num_rows, len(books)), np.int64), [0] * rb.num_rows
            for rows, parts in _cut(rb, books):
                for k, v, book in parts:
                    at, distance = book.nearest(v)
                    code[rows, k] = at
                    for i, d in zip(rows.tolist(), distance.tolist()):
                        error[i] += d
            codes = pa.array(["".join(map("{:02x}".format, c)) for c in code.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([rb.column("vec_id"), rb.column("label"), codes, pa.array([min(e, MOST) for e in error], pa.int64())], ["vec_id", "label", "code", "error"])

    return run


def finite_vectors(table: DataFrame) -> DataFrame:
    """Rows whose vector is there, without null or non-finite components: vec_id, label, vector as doubles."""
    sound = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return table.filter(sound).select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("vector"))


def compress(spark: SparkSession, table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Per kept row of ``table`` (vec_id, embedding, label): vec_id, code, error, label_error, codebooks_sha256.

    Vectors that are null or hold null or non-finite components go; the others must be of one length that ``parts`` divides, else this is an
    error. Codebooks start from the smallest vec_ids, null after all others, rows with one vec_id in the order of their vectors; with fewer
    rows than ``entries`` they are smaller. Repeated rows count as often as they stand there, all ties go to the lower index. Large numbers are exact too; errors
    and their sums stop at 2**63 - 1. An empty table gives an empty result. Columns other than the three are not used.
    """
    work = Scratch(spark, "vector-codes")
    vectors = work.keep(finite_vectors(table), "vectors")
    size = vectors.agg(F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if size[0] != size[1] or (size[0] or 0) % parts:
        raise ValueError(f"vectors have {size[0]} to {size[1]} components; one number that {parts} divides is needed")
    first = vectors.select("vec_id", "vector").orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    wide = (size[0] or 0) // parts
    start = integers(np.array([r["vector"] for r in first], float).reshape(len(first), parts * wide))
    books = [Book(start[:, k * wide : (k + 1) * wide]) for k in range(parts)]
    for _ in range(rounds if first else 0):
        books = refined(vectors, books)
    digest = hashlib.sha256(",".join(str(v) for b in books for row in b.entries.tolist() for v in row).encode()).hexdigest()
    label = vectors.schema["label"].dataType.simpleString()
    coded = work.keep(vectors.mapInArrow(_coded(books), f"vec_id long, label {label}, code string, error long"), "coded")
    sums = coded.groupBy(F.col("label").alias("label_")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    joined = coded.join(work.keep(sums, "labels"), F.col("label").eqNullSafe(F.col("label_")))  # Spark sends the sums to all only where their files are small
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result(spark, "op12", lambda: compress(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def _round(k: int) -> str:
    return f"""
near{k} AS MATERIALIZED (
  SELECT r, p, min(list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(s, c)])::BIGINT * 256 + e) AS de
  FROM parts JOIN book{k} USING (p) GROUP BY r, p),
sums{k + 1} AS (
  SELECT p, de % 256 AS e, i, sum(s[i])::HUGEINT AS t, count(*)::HUGEINT AS n
  FROM near{k} JOIN parts USING (r, p), range(1, w + 1) AS g(i) GROUP BY ALL),
book{k + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(n.c, b.c) AS c
  FROM book{k} b LEFT JOIN (SELECT p, e, list(((t - ((t % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM sums{k + 1} GROUP BY p, e) n USING (p, e))"""


OP12_SQL = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, [floor(1024 * x::DOUBLE)::BIGINT for x in embedding] AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
parts AS MATERIALIZED (SELECT r, p, len(v) // {PARTS} AS w, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS s FROM kept, range({PARTS}) AS g(p)),
book0 AS MATERIALIZED (SELECT p, r - 1 AS e, s AS c FROM parts WHERE r <= {ENTRIES}),{",".join(map(_round, range(ROUNDS)))},
final AS MATERIALIZED (
  SELECT r, p, min(list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(s, c)])::BIGINT * 256 + e) AS de
  FROM parts JOIN book{ROUNDS} USING (p) GROUP BY r, p),
coded AS (SELECT r, string_agg(printf('%02x', (de % 256)::INTEGER), '' ORDER BY p) AS code, sum(de // 256)::BIGINT AS error FROM final GROUP BY r),
book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (r), book
"""
