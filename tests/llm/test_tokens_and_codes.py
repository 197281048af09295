"""Tokenizer alignment, vector codes and token counts against plain versions."""

import collections
import hashlib
import itertools
import math
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

os.environ["TOKENIZERS_PARALLELISM"] = "false"
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from pixelmill.llm import alignment as A
from pixelmill.llm import token_counts as T
from pixelmill.llm import vector_codes as V
from pixelmill.llm.queries import QUERIES

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
HARD = [None, "", " ", " ", "a" * 3000, "ä▁ö", "<|endoftext|> <s> </s> x", "\x00\x01 日本語 the the the", "   x  y\n\n\tz ", " " * 500, "xyzzy" * 30 + " " + "qwertyuiop" * 50, "é ﬁ ½ ①", "the same row", "the same row", "it's I'll we've 12345 12,5", "word " * 3000]


def docs(spark, texts):
    return spark.createDataFrame([(None if i == 3 else i // 2, t, "en", i, None) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string, batch int, stripe int").repartition(3)


# token counts


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTES)


def counted(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_pattern_is_the_file_s_own():
    assert T.PATTERN == public_tokenizers.PATTERN


def test_counts(spark, library):
    got = sorted(map(tuple, T.count_tokens(docs(spark, HARD), BYTES).collect()), key=str)
    n = counted(library, [t or "" for t in HARD])
    want = [(None if i == 3 else i // 2, len((t or "").encode()), k, k > 1024) for i, (t, k) in enumerate(zip(HARD, n))]
    assert got == sorted(want, key=str) and any(r[3] for r in got)
    assert T.count_tokens(docs(spark, HARD).filter("doc_id > 99"), BYTES).count() == 0
    assert dict(T.count_tokens(docs(spark, HARD), BYTES, 3).select("n_tokens", "over_limit").collect())[3] is False


def test_counts_of_whole_table(spark, sf, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op13_token_counts"](spark, sf).collect()}
    n = dict(zip(texts, counted(library, [t or "" for t in texts.values()])))
    assert got == {i: (len((t or "").encode()), n[i], n[i] > 1024) for i, t in texts.items()}


def test_every_character_is_classed_as_in_the_library(library):
    """A sample by steps of all code points between letters, numbers and spaces, and all those that Unicode assigned late."""
    late = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c % 7 == 0 or T._LATER.match(chr(c)))]
    for form in ("a{0}b", "1{0}2", " {0} {0}", "'{0}'s"):
        for k in range(0, len(late), 20_000):
            texts = [form.format(chr(c)) for c in late[k : k + 20_000]]
            assert T.count_texts(texts, BYTES).tolist() == counted(library, texts), form


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab the'sld\n\t 1é日<|endoftext|>"), max_size=40), max_size=5))
def test_counts_of_any_text(texts):
    assert T.count_texts(texts, BYTES).tolist() == counted(Tokenizer.from_file(BYTES), texts)


def test_long_texts_are_cut_where_no_word_is(library, monkeypatch):
    monkeypatch.setattr(T, "PIECE", 7)
    monkeypatch.setattr(T, "HELD", 3)
    monkeypatch.setattr(T, "REMEMBERED", 5)
    rng = random.Random(0)
    texts = ["".join(rng.choice("ab  \n'sé1,") for _ in range(200)) for _ in range(30)]
    assert T.count_texts(texts, BYTES).tolist() == counted(library, texts)


def test_repeated_symbols(library):
    for text in ("a" * 1001, "^" * 999, "=" * 64 + "-" * 33, "ha" * 77, "".join(random.Random(1).choice("etaoinshr") for _ in range(2000))):
        assert T.count_texts([text], BYTES).tolist() == counted(library, [text])


def test_other_kinds_of_files_are_refused(tmp_path):
    with pytest.raises(ValueError):
        T.Merges(public_tokenizers.path("word_bpe_49k.json"))


# alignment


def aligned(rows):
    """The contract by dictionaries and loops."""
    t, sp = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    t.encode_special_tokens = True
    byte = {c: i for i, c in enumerate(T.byte_letters())}
    of_a = {i: w.encode() if i == 50256 else bytes(byte[c] for c in w) for w, i in t.get_vocab().items()}

    def of_b(i):
        p = sp.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()

    held, counts = [], collections.Counter()
    for doc_id, text in rows:
        a = t.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        if text and any(b"".join(map(f, ids)) != (" " + text).encode() for f, ids in ((of_a.get, a), (of_b, b))):
            a = b = []
        ends = [list(itertools.accumulate(len(f(i)) for i in ids)) for f, ids in ((of_a.get, a), (of_b, b))]
        groups, i, j = [], 0, 0
        for stop in sorted(set(ends[0]) & set(ends[1])):
            left, right = ends[0].index(stop) + 1, ends[1].index(stop) + 1
            groups.append((a[i:left], b[j:right]))
            i, j = left, right
        links = collections.Counter((p, q) for g, h in groups for p in g for q in h)
        counts.update(links.keys())
        held.append((doc_id, len(a), len(b), groups, links))
    best = {}
    for (p, _), n in counts.items():
        best[p] = max(best.get(p, 0), n)
    for doc_id, n_a, n_b, groups, links in held:
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        yield doc_id, n_a, n_b, len(groups), sum(links.values()), sum(n for (p, q), n in links.items() if counts[p, q] == best[p]), sum(n * counts[k] for k, n in links.items()), digest


@pytest.mark.parametrize(("batch", "task_mb", "stripes"), [(A.BATCH, A.TASK_MB, 16), (2000, 1e-7, 7)])
def test_alignment(spark, monkeypatch, batch, task_mb, stripes):
    """Also in small batches, with stripes split and put together again."""
    monkeypatch.setattr(A, "BATCH", batch)
    monkeypatch.setattr(A, "TASK_MB", task_mb)
    got = A.align(spark, docs(spark, HARD), BYTES, PIECES, stripes).collect()
    want = aligned([(None if i == 3 else i // 2, t) for i, t in enumerate(HARD)])
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert A.align(spark, docs(spark, HARD).filter("doc_id > 99"), BYTES, PIECES, stripes).count() == 0


def test_alignment_of_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op11_alignment"](spark, sf).collect())) == sorted(aligned(rows))


def test_crowded_groups_are_put_together(monkeypatch):
    """Repeated ids of a long group without common ends count as often as they stand there."""
    a, b = A.vocabulary(BYTES), A.vocabulary(PIECES)
    texts = ["=" * 501 + "x", "plain words " * 5, "-" * 333]
    want = A.Links(texts, a, b)
    monkeypatch.setattr(A, "CROWDED", 1)
    got = A.Links(texts, a, b)
    assert np.array_equal(want.key, got.key) and np.array_equal(want.times, got.times) and want.n_links.tolist() == got.n_links.tolist()


def test_runs_that_the_fast_encoder_gives_up_on(library):
    v = A.vocabulary(BYTES)
    for text in (" " * 200_000, "a" * 50_000, "<|endoftext|>"):
        exact = Tokenizer.from_file(BYTES)
        exact.encode_special_tokens = True
        assert v.encode(text) == exact.encode(" " + text, add_special_tokens=False).ids


def test_block_of_counts():
    block = A.Block(3, 1000)
    for stripe in ("a", "b"):
        block.turn(stripe)
        place = np.array([5, 7, 1005, 5])
        block.add(place, np.array([1, 2, 3, 4]))
        assert block.held().tolist() == [5, 7, 1005] and block.best().tolist() == [5, 3, 0]
    block.add(np.arange(3000), np.ones(3000, np.int64))
    assert len(block.held()) == 3000 and block.best().tolist() == [6, 4, 1]
    x = np.array([0, 255, 256, 1 << 31, (1 << 32) - 1])
    assert A.unpack(A.pack(x)).tolist() == x.tolist() and A.unpack(A.pack(x[:0])).tolist() == []


# vector codes


def coded(rows, entries=256, rounds=4):
    """Exhaustive search in Python's integers."""
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    wide = len(kept[0][1]) // 4
    parts = [[[math.floor(x * 1024) for x in v[k * wide : (k + 1) * wide]] for k in range(4)] for _, v, _ in kept]
    books = [[p[k] for p in parts[:entries]] for k in range(4)]
    near = lambda p, book: min((sum((x - y) ** 2 for x, y in zip(p, e)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        new = []
        for k, book in enumerate(books):
            held = collections.defaultdict(list)
            for p in parts:
                held[near(p[k], book)[1]].append(p[k])
            new.append([[sum(c) // len(c) for c in zip(*held[i])] if i in held else e for i, e in enumerate(book)])
        books = new
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, sums = [], collections.Counter()
    for (i, _, label), p in zip(kept, parts):
        found = [near(p[k], books[k]) for k in range(4)]
        error = min(sum(d for d, _ in found), V.MOST)
        sums[label] += error
        out.append((i, "".join(f"{e:02x}" for _, e in found), error, label, digest))
    return [(i, c, e, min(sums[label], V.MOST), d) for i, c, e, label, d in out]


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], "vec_id long, embedding array<float>, label int, code string, error int").repartition(3)


def test_codes_of_hard_vectors(spark):
    rng = np.random.default_rng(0)
    f = lambda v: [float(np.float32(x)) for x in v]
    rows = [(i, f(rng.normal(size=8) * rng.choice([0.01, 1, 30])), int(rng.integers(0, 3)) if i % 5 else None) for i in range(60)]
    rows += [(None, f(rng.normal(size=8)), 1), (7, f(rng.normal(size=8)), 1), (7, f(rng.normal(size=8)), 1), rows[9], rows[9]]
    rows += [(100, None, 1), (101, [1.0, None] * 4, 1), (102, [float("nan")] * 8, 1), (103, [float("inf")] * 8, 1), (104, [-float("inf")] + [0.0] * 7, None)]
    rows += [(i, [0.5 * (i % 2)] * 8, None) for i in range(200, 220)]
    for entries, more in ((256, []), (8, []), (8, [(300, f([3e38, -3e38, 0, 1, 2, 3, 4, 5]), 2), (-1, f([1e20] * 8), None)])):
        got = V.compress(spark, vectors(spark, rows + more), entries=entries)
        assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(coded(rows + more, entries), key=str)
    assert V.compress(spark, vectors(spark, rows).filter("vec_id > 999")).count() == 0
    with pytest.raises(ValueError):
        V.compress(spark, vectors(spark, [(1, [1.0] * 8, 1), (2, [1.0] * 4, 1)]))
    with pytest.raises(ValueError):
        V.compress(spark, vectors(spark, [(1, [1.0] * 6, 1)]))


@pytest.mark.parametrize("scale", [3, 40, 100_000])
def test_tree_finds_the_first_nearest(scale):
    """Ties, repeated entries and entries far away, as all pairs find them."""
    rng = np.random.default_rng(scale)
    for n in (1, 2, 15, 17, 100, 256):
        entries, q = rng.integers(-scale, scale, (n, 4)), rng.integers(-scale, scale, (500, 4))
        entries[n // 2 :] = entries[rng.integers(0, n, n - n // 2)]
        d = ((q[:, None] - entries[None]) ** 2).sum(-1)
        at, distance = V.Book(entries).nearest(q)
        assert np.array_equal(at, d.argmin(1)) and np.array_equal(distance, d.min(1))


def test_balls_are_passed_over():
    rng = np.random.default_rng(2)
    entries = np.concatenate([rng.integers(0, 50, (64, 4)) + 10_000 * k for k in range(4)])
    seen = []
    book = V.Book(entries)
    visit = V.np.argmin
    q = entries[::4] + 1
    try:
        V.np.argmin = lambda d, axis: seen.append(d.shape[0]) or visit(d, axis)
        book.nearest(q)
    finally:
        V.np.argmin = visit
    assert sum(seen) < len(q) * 16 * 0.5


def test_limbs():
    for v in (0, 1, -1, 2**40, -(2**40) - 5, 3**200, -(3**200)):
        assert sum(x << (V.LIMB * i) for i, x in enumerate(V.limbs(v))) == v
