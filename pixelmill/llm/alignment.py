"""Alignment of two tokenizers: links between tokens that cover the same bytes, counted and scored over a corpus.

Both tokenizers cut the same bytes; where both end a token, a group ends. Within a group every token of the one is linked with every token
of the other. The counts of id pairs are dense: ids of the first tokenizer are dealt in turn to ``STRIPES`` stripes, a stripe is a block of
(its ids x all ids of the second), pairs are added to it by ``np.add.at``, and the row maxima are the best counts. A batch of documents asks
each stripe once for each of its distinct pairs; the answers go back to the batch, where its links lie.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .scratch import Scratch, result
from .token_counts import PATTERN, byte_letters

#: Stripes of ids; MB of requests that one task adds to a stripe; pairs in a row of counts; bytes of text in a batch.
STRIPES, TASK_MB, PIECE, BATCH = 128, 128, 1 << 16, 4 << 20
#: Token pairs of a group from which repeated ids are put together before they are crossed.
CROWDED = 64


class Vocabulary:
    """Token bytes, their lengths, and decimal ids as rows of digits."""

    def __init__(self, entries: list[bytes]):
        self.n, self.entries = len(entries), entries
        self.length = np.array([len(e) for e in entries], np.int64)
        width = len(str(self.n)) + 1
        self.digits = np.frombuffer("".join(str(i).ljust(width) for i in range(self.n)).encode(), np.uint8).reshape(-1, width)
        self.width = np.array([len(str(i)) for i in range(self.n)], np.int64)


class ByteTokens(Vocabulary):
    """A byte-level BPE file; ids of a space and the text, special strings being plain text."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.exact.encode_special_tokens = True
        vocab = self.exact.get_vocab(with_added_tokens=False)
        letters = {c: b for b, c in enumerate(byte_letters())}
        special = {t.content for t in self.exact.get_added_tokens_decoder().values()}
        entries = [b""] * (max(self.exact.get_vocab().values()) + 1)
        for token, i in vocab.items():
            entries[i] = token.encode() if token in special else bytes(letters[c] for c in token)
        super().__init__(entries)
        ranks = {e: i for i, e in enumerate(entries) if e and i not in {vocab.get(s) for s in special}}
        self.fast = tiktoken.Encoding("pairs", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        try:
            return self.fast.encode_ordinary(" " + text)
        except (ValueError, RuntimeError):  # its pattern gives up on very long runs
            return self.exact.encode(" " + text, add_special_tokens=False).ids

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        return [self.encode(t) for t in texts]


class PieceTokens(Vocabulary):
    """A sentence piece model, which puts a space before the text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        pieces = [self.model.id_to_piece(i) for i in ids]
        super().__init__([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, pieces)])

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1) if texts else []


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return (PieceTokens if path.endswith(".model") else ByteTokens)(path)


def pack(x: np.ndarray) -> bytes:
    """Numbers below 2**32 by planes of their bytes, which compress well."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unpack(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _steps(x: np.ndarray) -> np.ndarray:
    """Differences of rising numbers, the first from 0."""
    return np.diff(x, prepend=0)


class Links:
    """Groups and links of a batch of texts; rows are texts, ``key`` holds distinct (row, pair) with ``times`` links each."""

    def __init__(self, texts: list[str | None], a: Vocabulary, b: Vocabulary):
        rows = len(texts)
        ids = [[], []]
        filled = [i for i, t in enumerate(texts) if t]
        for side, (v, into) in enumerate(zip((a, b), ids)):
            into.extend([[]] * rows)
            for i, x in zip(filled, v.encode_all([texts[i] for i in filled])):
                into[i] = x
        for i in filled:
            want = (" " + texts[i]).encode()
            if any(b"".join(map(v.entries.__getitem__, side[i])) != want for v, side in zip((a, b), ids)):
                ids[0][i] = ids[1][i] = []
        self.n_a, self.n_b = (np.fromiter(map(len, side), np.int64, rows) for side in ids)
        ta, tb = (np.concatenate([np.array(x, np.int64) for x in side]) if rows else np.zeros(0, np.int64) for side in ids)
        end_a, end_b = np.cumsum(a.length[ta]), np.cumsum(b.length[tb])
        ends = np.zeros((2, int(end_a[-1]) + 1 if len(end_a) else 1), bool)
        ends[0][end_a], ends[1][end_b] = True, True
        last_a, last_b = ends[1][end_a], ends[0][end_b]
        self.group_a, self.group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        self.ta, self.tb, self.last_a, self.last_b, self.a, self.b = ta, tb, last_a, last_b, a, b
        groups = int(last_a.sum())
        in_a, in_b = np.bincount(self.group_a, minlength=groups), np.bincount(self.group_b, minlength=groups)
        self.row = np.repeat(np.arange(rows), self.n_a)[last_a]  # of each group
        self.n_groups = np.bincount(self.row, minlength=rows).astype(np.int64)
        self.n_links = np.zeros(rows, np.int64)
        np.add.at(self.n_links, self.row, in_a * in_b)
        self._cross(in_a * in_b > CROWDED, groups)

    def _cross(self, crowded: np.ndarray, groups: int) -> None:
        ga, ia, ma = self._together(self.group_a, self.ta, crowded, self.a.n)
        gb, ib, mb = self._together(self.group_b, self.tb, crowded, self.b.n)
        in_a, in_b = np.bincount(ga, minlength=groups), np.bincount(gb, minlength=groups)
        start = np.cumsum(in_b) - in_b
        each = in_b[ga]
        at = np.repeat(np.arange(len(ga)), each)
        to = np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(start[ga], each)
        pair = ia[at] * self.b.n + ib[to]
        self.pairs, which = np.unique(pair, return_inverse=True)
        key = self.row[ga[at]] * max(1, len(self.pairs)) + which
        if crowded.any():
            order = np.argsort(key, kind="stable")
            key, times = key[order], (ma[at] * mb[to])[order]
        else:
            key, times = np.sort(key), np.ones(len(key), np.int64)
        first = np.flatnonzero(np.diff(key, prepend=-1))
        self.key, self.times = key[first], np.add.reduceat(times, first) if len(first) else times

    @staticmethod
    def _together(group: np.ndarray, ids: np.ndarray, crowded: np.ndarray, n: int):
        """(group, id, times): ids of crowded groups once each, the others as they stand."""
        much = crowded[group]
        if not much.any():
            return group, ids, np.ones(len(ids), np.int64)
        key, times = np.unique(group[much] * n + ids[much], return_counts=True)
        g = np.concatenate((group[~much], key // n))
        order = np.argsort(g, kind="stable")
        return g[order], np.concatenate((ids[~much], key % n))[order], np.concatenate((np.ones(int((~much).sum()), np.int64), times))[order]

    def digests(self) -> list[str]:
        """SHA-256 of ``a1,a2|b1;a3|b2,b3``, ids of both sides by group; '' without tokens."""
        groups = len(self.row)
        in_a, in_b = np.bincount(self.group_a, minlength=groups), np.bincount(self.group_b, minlength=groups)
        at_a = np.arange(len(self.ta)) + (np.cumsum(in_b) - in_b)[self.group_a]
        at_b = np.arange(len(self.tb)) + np.cumsum(in_a)[self.group_b]
        n, wide = len(at_a) + len(at_b), max(self.a.digits.shape[1], self.b.digits.shape[1])
        cells, width = np.zeros((n, wide), np.uint8), np.empty(n, np.int64)
        for at, ids, last, v, stop in ((at_a, self.ta, self.last_a, self.a, b",|"), (at_b, self.tb, self.last_b, self.b, b",;")):
            cells[at, : v.digits.shape[1]] = v.digits[ids]
            width[at] = v.width[ids]
            cells[at, v.width[ids]] = np.where(last, stop[1], stop[0])
        flat = cells[np.arange(wide) <= width[:, None]].tobytes()
        ends = np.concatenate(([0], np.cumsum(width + 1)))[np.concatenate(([0], np.cumsum(self.n_a + self.n_b)))]
        return [hashlib.sha256(flat[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]


_LINKED = "batch long, stripe int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def link_documents(docs: DataFrame, path_a: str, path_b: str, stripes: int = STRIPES) -> DataFrame:
    """Two kinds of rows. stripe -1: a document, its links as steps between the numbers of its batch's distinct pairs, and their times.
    Others: a batch's distinct pairs in a stripe, as steps between places of the block, and the documents of the batch that hold them."""

    def run(batches):
        from pyspark import TaskContext

        a, b = vocabulary(path_a), vocabulary(path_b)
        tall = -(-a.n // stripes)  # ids in a stripe
        batch = TaskContext.get().partitionId() << 32
        for whole in batches:
            for rb in K.text_slices(whole, most=BATCH):
                x = Links(rb.column("text").to_pylist(), a, b)
                rows, n = rb.num_rows, len(x.pairs)
                ia, ib = x.pairs // b.n, x.pairs % b.n
                place = (ia % stripes) * (tall * b.n) + ia // stripes * b.n + ib
                order = np.argsort(place)
                number = np.empty(n, np.int64)
                number[order] = np.arange(n)
                row, pair = x.key // max(1, n), number[x.key % max(1, n)]
                held = np.bincount(pair, minlength=n)
                by = np.argsort(row * max(1, n) + pair)
                pair, times = pair[by], x.times[by]
                cut = np.searchsorted(row, np.arange(rows + 1))
                place = place[order]
                asked = np.unique(place // (tall * b.n))
                part = np.append(np.searchsorted(place, asked * (tall * b.n)), n)
                place %= tall * b.n
                lone = [None] * len(asked)
                numbers = [pa.array(np.concatenate((c, np.zeros(len(asked), np.int64)))) for c in (x.n_a, x.n_b, x.n_groups, x.n_links)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(rows + len(asked), batch)), pa.array(np.concatenate((np.full(rows, -1), asked)).astype(np.int32)),
                        pa.concat_arrays([rb.column("doc_id"), pa.nulls(len(asked), pa.int64())]), *numbers, pa.array(x.digests() + lone, pa.string()),
                        pa.array([pack(_steps(pair[i:j])) for i, j in zip(cut, cut[1:])] + [pack(_steps(place[i:j])) for i, j in zip(part, part[1:])], pa.binary()),
                        pa.array([pack(times[i:j]) for i, j in zip(cut, cut[1:])] + [pack(held[i:j]) for i, j in zip(part, part[1:])], pa.binary()),
                    ],
                    ["batch", "stripe", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
                )
                batch += 1

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, _LINKED)


class Block:
    """The dense counts of one stripe, reused from stripe to stripe; only places that were added to are emptied again."""

    def __init__(self, tall: int, wide: int):
        self.counts, self.wide = np.zeros(tall * wide, np.int64), wide
        self.stripe, self.places, self.many = None, [], 0

    def turn(self, stripe) -> None:
        if stripe != self.stripe:
            self.counts[self.held()] = 0
            self.stripe, self.places, self.many = stripe, [], 0

    def add(self, place: np.ndarray, n: np.ndarray) -> None:
        np.add.at(self.counts, place, n)
        self.many += len(place)
        if self.many < len(self.counts) // 8:
            self.places.append(place)

    def held(self) -> np.ndarray:
        """Places with counts, in order; looked up in the block where as much was added as it is large."""
        if self.many >= len(self.counts) // 8:
            return np.flatnonzero(self.counts)
        return np.unique(np.concatenate(self.places)) if self.places else np.zeros(0, np.int64)

    def rows(self):
        """What the block holds, in rows of bounded size."""
        place = self.held()
        n = self.counts[place]
        for i in range(0, len(place), PIECE):
            yield place[i : i + PIECE].astype("<u4").tobytes(), n[i : i + PIECE].astype("<i8").tobytes()

    def best(self) -> np.ndarray:
        """The highest count of each row."""
        out, place = np.zeros(len(self.counts) // self.wide, np.int64), self.held()
        row = place // self.wide
        first = np.flatnonzero(np.diff(row, prepend=-1))
        if len(first):
            out[row[first]] = np.maximum.reduceat(self.counts[place], first)
        return out


def _counted(tall: int, wide: int, salted: bool):
    """Sums of a stripe's rows (within its salt), rows of a stripe lying together; either requests or counts."""

    def run(batches):
        block, key = Block(tall, wide), None

        def out():
            held = list(block.rows())
            stripe, salt = key
            yield pa.RecordBatch.from_arrays(
                [pa.array([stripe] * len(held), pa.int32()), pa.array([salt] * len(held), pa.int32()), pa.array([p for p, _ in held], pa.binary()), pa.array([n for _, n in held], pa.binary())], ["stripe", "salt", "place", "n"]
            )

        for rb in batches:
            for stripe, salt, x, n in zip(*(rb.column(c).to_pylist() for c in ("stripe", "salt", "place", "n"))):
                if key is not None and key != (stripe, salt):
                    yield from out()
                key = (stripe, salt)
                block.turn(key)
                if salted:
                    block.add(np.cumsum(unpack(x)), unpack(n))
                else:
                    block.add(np.frombuffer(x, "<u4").astype(np.int64), np.frombuffer(n, "<i8"))
        if key is not None:
            yield from out()

    return run


def _answered(tall: int, wide: int):
    """A stripe's counts come before the requests of batches, which get the counts of their pairs and whether they are the best."""

    def run(batches):
        block, best = Block(tall, wide), None
        for rb in batches:
            got = []
            for stripe, salt, batch, x, n in zip(*(rb.column(c).to_pylist() for c in ("stripe", "salt", "batch", "place", "n"))):
                block.turn((stripe, salt))
                if batch is None:
                    block.add(np.frombuffer(x, "<u4").astype(np.int64), np.frombuffer(n, "<i8"))
                    best = None
                    continue
                if best is None or best[0] != (stripe, salt):
                    best = (stripe, salt), block.best()
                place = np.cumsum(unpack(x))
                count = block.counts[place]
                high, low = np.divmod(count, 1 << 31)
                got.append((batch, stripe, pack(low << 1 | (count == best[1][place // wide])), pack(high)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got) if got else [[]] * 4, (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["batch", "stripe", "low", "high"])

    return run


_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _scored(_, docs: pa.Table, answers: pa.Table) -> pa.Table:
    """The links of a batch's documents with the counts of its pairs."""
    answers = answers.sort_by("stripe")
    low = np.concatenate([unpack(x) for x in answers.column("low").to_pylist()] or [np.zeros(0, np.int64)])
    high = np.concatenate([unpack(x) for x in answers.column("high").to_pylist()] or [np.zeros(0, np.int64)])
    count, best = (high << 31) + (low >> 1), low & 1
    sums, bests = [], []
    for pairs, times in zip(docs.column("pairs").to_pylist(), docs.column("times").to_pylist()):
        pair, times = np.cumsum(unpack(pairs)), unpack(times)
        sums.append(int(count[pair] @ times))
        bests.append(int(best[pair] @ times))
    kept = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    return kept.append_column("n_best", pa.array(bests, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64())).append_column("groups_sha256", docs.column("groups_sha256"))


def align(spark: SparkSession, docs: DataFrame, path_a: str, path_b: str, stripes: int = STRIPES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``path_a`` and ``path_b``: a byte-level BPE file or a sentence piece model (by its ending .model), which every executor has. A pair's count is
    the number of rows that hold it linked; ``n_best`` are links whose count is the highest of their first id, ties included. Texts that are null or
    empty, or that the tokens of either side do not spell, have no tokens: zeros, and an empty digest. Long texts are linked whole; in groups where
    no ends meet for long, repeated ids are put together before they are crossed. Repeated rows and null ids count as documents of their own;
    an empty table gives none. Columns other than doc_id and text are not used.
    """
    work = Scratch(spark, "align")
    a, b = vocabulary(path_a), vocabulary(path_b)
    tall, wide = -(-a.n // stripes), b.n
    linked = work.keep(link_documents(docs, path_a, path_b, stripes), "linked")
    asked = linked.filter("stripe >= 0").select("batch", "stripe", F.col("pairs").alias("place"), F.col("times").alias("n"))
    size = asked.agg(F.sum(F.octet_length("place") + F.octet_length("n"))).first()[0] or 0
    salts = 1 + int(size // (stripes * TASK_MB * (1 << 20)))
    asked = asked.withColumn("salt", F.pmod(F.xxhash64("batch"), F.lit(salts)).cast("int"))
    kind = "stripe int, salt int, place binary, n binary"
    some = asked.select("stripe", "salt", "place", "n").repartition("stripe", "salt").sortWithinPartitions("stripe", "salt").mapInArrow(_counted(tall, wide, True), kind)
    if salts > 1:
        some = some.withColumn("salt", F.lit(0)).repartition("stripe").sortWithinPartitions("stripe").mapInArrow(_counted(tall, wide, False), kind)
    counts = work.keep(some, "counts")
    known = counts.select("stripe", F.explode(F.sequence(F.lit(0), F.lit(int(salts) - 1))).alias("salt"), F.lit(None).cast("long").alias("batch"), "place", "n")
    both = known.unionByName(asked).repartition("stripe", "salt").sortWithinPartitions("stripe", "salt", F.col("batch").asc_nulls_first())
    answers = both.mapInArrow(_answered(tall, wide), "batch long, stripe int, low binary, high binary")
    rows = linked.filter("stripe < 0").drop("stripe")
    return rows.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_scored, _OUT)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return result(spark, "op11", lambda: align(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), a, b))
