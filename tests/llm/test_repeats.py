"""Repeats on bytes and words against brute force, and hard inputs."""

import hashlib
import random
import re

import numpy as np
import pytest

from pixelmill.llm import kernels as K
from pixelmill.llm import repeats as R
from pixelmill.llm import suffix_array as A
from pixelmill.llm import suffix_tree as B

SCHEMA = "doc_id long, text string, n_bytes string, lang string"


def fixture(seed=0):
    r = random.Random(seed)
    words = ["alpha", "beta", "gâmma", "δ", "epsilon", "the", "of", "a"]
    say = lambda n: " ".join(r.choice(words) + str(r.randrange(40)) for _ in range(n))
    shared = [say(60), say(55), say(52)]
    rows = [(0, None), (1, ""), (2, "short"), (3, say(200) + shared[0]), (4, shared[0] + say(30)), (5, say(10) + shared[1] + say(5) + shared[0]), (6, shared[1]), (7, shared[1])]
    rows += [(8, "ab" * 400), (9, "ab" * 300), (9, "ab" * 300), (10, "x" * 49), (11, "x" * 49), (12, "x" * 50), (13, "x" * 51), (14, say(3000) + shared[2]), (15, shared[2] + "\t\n " + shared[2])]
    rows += [(None, shared[0]), (None, "y" * 80), (16, " ".join(["same"] * 120)), (17, " ".join(["same"] * 70)), (18, say(49)), (19, "\n".join([shared[0]] * 3))]
    rows += [(20 + i, shared[r.randrange(3)] if r.random() < 0.3 else say(r.randrange(1, 80))) for i in range(30)]
    return rows


def key(i):
    return float("inf") if i is None else i


def brute_bytes(rows, size=50):
    first, out = {}, []
    for i, t in sorted(rows, key=lambda x: key(x[0])):
        b = (t or "").encode()
        for s in range(len(b) - size + 1):
            first.setdefault(b[s : s + size], key(i))
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - size + 1):
            if first[b[s : s + size]] < key(i):
                gone[s : s + size] = b"\1" * size
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for p in range(len(b)) if gone[p] and not (p and gone[p - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=lambda x: (key(x[0]), x))


def brute_words(rows, size=50):
    split = lambda t: re.findall("[^\x20\x09-\x0d]+", t or "")
    first, out = {}, []
    for i, t in sorted(rows, key=lambda x: key(x[0])):
        w = split(t)
        for s in range(len(w) - size + 1):
            first.setdefault(tuple(w[s : s + size]), key(i))
    for i, t in rows:
        w = split(t)
        gone = [False] * len(w)
        for s in range(len(w) - size + 1):
            if first[tuple(w[s : s + size])] < key(i):
                gone[s : s + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=lambda x: (key(x[0]), x))


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "clash", "en") for i, t in rows], SCHEMA).repartition(parts)


@pytest.mark.parametrize("parts", [1, 5])
def test_bytes(spark, parts):
    rows = fixture(parts)
    got = A.remove_repeats(spark, frame(spark, rows, parts)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=lambda x: (key(x[0]), x)) == brute_bytes(rows)


@pytest.mark.parametrize("parts", [1, 5])
def test_words(spark, parts):
    rows = fixture(10 + parts)
    got = B.remove_repeated_words(spark, frame(spark, rows, parts)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=lambda x: (key(x[0]), x)) == brute_words(rows)


@pytest.mark.parametrize("most", [0, 3, 40])
def test_crowded_minimisers(spark, monkeypatch, most):
    """One minimiser in every document, in different company: it is split by longer grams, by whole windows at last."""
    monkeypatch.setattr(R, "HOT", most)
    r = random.Random(8)
    hot = "the same words in all of the documents here"
    rows = [(i, f"{''.join(r.choice('abc') for _ in range(r.randrange(3, 9)))} {hot} {r.choice('xy')} " + "w " * r.randrange(60)) for i in range(120)] + fixture(2)
    got = A.remove_repeats(spark, frame(spark, rows, 4)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=lambda x: (key(x[0]), x)) == brute_bytes(rows)
    got = B.remove_repeated_words(spark, frame(spark, rows, 4), 20).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=lambda x: (key(x[0]), x)) == brute_words(rows, 20)


def table(doc_ids, texts, batch):
    import pyarrow as pa

    return pa.table({"batch": pa.array([batch] * len(texts), pa.int64()), "doc_id": pa.array(doc_ids, pa.int64()), "text": texts})


@pytest.mark.parametrize("view", [R.ByteView, R.WordView])
def test_hot_windows_take_the_same_way(monkeypatch, view):
    """Each window lies under one key only, equal windows under the same; the maximal groups come from the same index, and no bucket
    gets more distinct contents under a hot key than of one window."""
    import pyarrow as pa

    r = random.Random(3)
    lead = "one lead of eight quite common words here "
    texts = [[" ".join(r.choice("abcdef") * 3 for _ in range(4)) + " " + lead * 2 + " ".join(r.choice("uvw") for _ in range(25)) for _ in range(15)] for _ in range(2)]
    tables = [table(list(range(b * 100, b * 100 + 15)), t, b) for b, t in enumerate(texts)]
    length, buckets, answers = 20, 3, None
    for level in range(len(R.gram_lengths(view, length))):
        make = R._sketcher(view, length, buckets) if not level else None
        sent = [pa.Table.from_batches(list(make(t.to_batches()))) if make else R._resketcher(view, length, buckets, level)(t, answers.filter(pa.compute.equal(answers["batch"], b))) for b, t in enumerate(tables)]
        sent = pa.concat_tables(sent)
        hot = 2 if level < 2 else R.LAST
        found = [R._shared_keys(level, hot)(sent.filter(pa.compute.equal(sent["bucket"], c))) for c in set(sent["bucket"].to_pylist())]
        answers = pa.concat_tables([x for x in [answers, *found] if x is not None])
    assert {R._hot(0), R._hot(1), R._shared(2)} <= set(answers["kind"].to_pylist()) and R._hot(2) not in answers["kind"].to_pylist()
    under: dict[bytes, set] = {}
    counts: dict[bytes, int] = {}
    for b, t in enumerate(tables):
        mine = answers.filter(pa.compute.equal(answers["batch"], b))
        v = view(*K.text_buffer(t["text"]))
        seg = R.sent_segments(v, mine, length, buckets)
        places = [(s + i, int(k)) for s, n, k in zip(seg.start.tolist(), seg.count.tolist(), seg.key) for i in range(n)]
        assert len({p for p, _ in places}) == len(places)
        at, size = v.places(np.array([p for p, _ in places]), length)
        for (_, k), a, n in zip(places, at.tolist(), size.tolist()):
            under.setdefault(v.flat[a : a + n].tobytes(), set()).add(k)
        every = [s for i, j in zip(v.offsets, v.offsets[1:]) for s in range(i, j - length + 1)]
        at, size = v.places(np.array(every), length)
        for w in {v.flat[a : a + n].tobytes() for a, n in zip(at.tolist(), size.tolist())}:
            counts[w] = counts.get(w, 0) + 1
    assert all(len(k) == 1 for k in under.values())
    assert {w for w, n in counts.items() if n > 1} <= set(under)


@pytest.mark.parametrize("size", [1, 10, 300])
def test_other_lengths(spark, size):
    rows = [*fixture(4), (200, "q" * 3000), (201, "q" * 3000), (202, " ".join(["z"] * 700)), (203, " ".join(["z"] * 700))]
    got = A.remove_repeats(spark, frame(spark, rows, 2), size).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=lambda x: (key(x[0]), x)) == brute_bytes(rows, size)
    got = B.remove_repeated_words(spark, frame(spark, rows, 2), size).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=lambda x: (key(x[0]), x)) == brute_words(rows, size)


@pytest.mark.parametrize("run", [A.remove_repeats, B.remove_repeated_words])
def test_impossible_lengths(spark, run):
    for size in (0, R.MOST + 1):
        with pytest.raises(ValueError):
            run(spark, frame(spark, [(1, "x")]), size)


def test_messages_follow_the_input(spark):
    """However many buckets there are, a batch sends a message to those only that own one of its minimisers."""
    import pyarrow as pa

    text = " ".join(f"{i} some words" for i in range(400))
    rb = pa.RecordBatch.from_pydict({"batch": [1], "doc_id": [1], "text": [text]})
    keys = len(np.unique(K.segments(R.ByteView(*K.text_buffer(rb.column("text"))).symbols, np.array([0, len(text)]), 50, 20).key))
    for buckets in (10, 10**6):
        sent = sum(x.num_rows for x in R._sketcher(R.ByteView, 50, buckets)([rb]))
        assert sent <= min(buckets, keys)


def test_equal_hashes_are_told_apart():
    raw = np.frombuffer(b"abcabdabcxyz", np.uint8)
    at, size = np.array([0, 3, 6, 9]), np.full(4, 3)
    first, which = R.distinct_slices(raw, at, size, np.zeros(4, np.uint64))
    assert which[0] == which[2] and len(set(which.tolist())) == 3 and sorted(raw[i : i + 3].tobytes() for i in at[first]) == [b"abc", b"abd", b"xyz"]


def test_word_numbers_are_words():
    words = ["a", "ab", "sevenby", "eight888", "a longer one".replace(" ", "_"), "eight889", "ab", "eight888"]
    raw = np.frombuffer((" ".join(words) + " ").encode(), np.uint8)
    ids, begin = B.word_ids(raw, np.array([0]), np.array([len(raw)]))
    assert [words.index(w) for w in words] == [ids.tolist().index(i) for i in ids.tolist()] and begin.tolist() == [0] and (ids != 0).all()


def test_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(K, "CHUNK", 300)
    rows = [(i, t) for i, t in fixture(3)]
    raw, offsets = K.text_buffer(__import__("pyarrow").array([t for _, t in rows]))
    whole = []
    for a, b in K.row_chunks(offsets, 50):
        row = np.searchsorted(offsets, np.arange(a, b), "right") - 1
        whole += [s for s, r in zip(range(a, b), row) if s + 50 <= min(b, offsets[r + 1])]
    want = [s for r in range(len(rows)) for s in range(offsets[r], offsets[r + 1] - 49)]
    assert sorted(whole) == want and len(set(whole)) == len(whole)


def test_texts_and_spans(spark):
    rows = [(1, "é" * 40 + "!"), (2, "a" + "é" * 40), (3, "z" * 10)]
    got = {r.doc_id: r for r in A.remove_repeats(spark, frame(spark, rows)).collect()}
    assert [(s.start, s.end) for s in got[2].spans] == [(1, 81)] and bytes(got[2].kept) == b"a" and got[2].kept_text == "a"
    assert got[3].kept_text == "z" * 10 and got[3].lang == "en"
    words = {r.doc_id: bytes(r.kept) for r in B.remove_repeated_words(spark, frame(spark, [(1, "a  b\tc")])).collect()}
    assert words == {1: b"a b c"}


@pytest.mark.parametrize("run", [A.remove_repeats, B.remove_repeated_words])
def test_empty_table(spark, run):
    assert run(spark, frame(spark, [(1, "x")]).filter("doc_id > 1")).count() == 0


def naive_groups(rows, size):
    texts = {i: t.encode() for i, t in rows}
    found = {}
    for i, b in texts.items():
        for s in range(len(b) - size + 1):
            found.setdefault(b[s : s + size], []).append((i, s))
    out = set()
    for w, places in found.items():
        for i, s in places:
            for k, t in places:
                if (i, s) < (k, t):
                    n = 0
                    while s + n < len(texts[i]) and t + n < len(texts[k]) and texts[i][s + n] == texts[k][t + n]:
                        n += 1
                    out.add(texts[i][s : s + n])
    groups = {}
    for r in out:
        places = [(i, m.start()) for i, b in texts.items() for m in re.finditer(b"(?=" + re.escape(r) + b")", b)]
        before = {texts[i][s - 1] if s else None for i, s in places}
        if (len(before) > 1 or None in before) and len({i for i, _ in places}) > 1:
            groups[r] = sorted(places)
    return groups


@pytest.mark.parametrize("context, most", [(24, 1 << 16), (37, 2), (256, 1 << 16), (256, 0)])
def test_maximal_repeats(spark, monkeypatch, context, most):
    monkeypatch.setattr(R, "HOT", most)
    r = random.Random(4)
    say = lambda n: "".join(r.choice("abcd") for _ in range(n))
    common, long = say(40), say(900)
    rows = [(1, say(30) + common + say(20)), (2, common), (3, "q" + common[5:] + say(9)), (4, say(15) + common[:30] + say(10)), (5, say(60)), (6, "a" * 60), (7, "a" * 40)]
    rows += [(8, "zz" + long + "x"), (9, long), (10, "k" + long[:700]), (11, "m" + long[:700] + "u"), (12, long[100:400]), (13, "y" + long + "xr")]
    groups = {}
    for x in A.maximal_repeats(spark, frame(spark, rows), 24, context).collect():
        groups.setdefault((x.repeat_id, x["size"]), []).append((x.doc_id, x.start))
    texts = {i: t.encode() for i, t in rows}
    got = {texts[places[0][0]][places[0][1] : places[0][1] + n]: sorted(places) for (_, n), places in groups.items()}
    assert len(got) == len(groups) and got == naive_groups(rows, 24)
    assert A.maximal_repeats(spark, frame(spark, rows).filter("doc_id > 99"), 24).count() == 0


def naive_tree(words, starts, ends, left, length):
    """Maximal repeats of at least ``length`` words among suffixes words[start : end], by definition."""
    out = {}
    for a in range(len(starts)):
        for b in range(a):
            n = 0
            while starts[a] + n < ends[a] and starts[b] + n < ends[b] and words[starts[a] + n] == words[starts[b] + n]:
                n += 1
            if n >= length:
                out[tuple(words[starts[a] : starts[a] + n])] = None
    found = {}
    for w in out:
        members = tuple(i for i in range(len(starts)) if tuple(words[starts[i] : min(ends[i], starts[i] + len(w))]) == w)
        if len({left[i] for i in members}) > 1 or 0 in {left[i] for i in members}:
            found[members, len(w)] = None
    return set(found)


def test_subtrees_by_definition():
    r = np.random.default_rng(11)
    for _ in range(20):
        words = r.integers(1, 3, 120).astype(np.uint64)
        starts = np.sort(r.choice(90, 40, replace=False))
        ends = starts + r.integers(5, 30, 40)
        left = r.integers(0, 3, 40).astype(np.uint64)
        got = set()
        for d, members, sizes in B.subtree(words, starts, ends - starts, left, 0, 4):
            cut = np.cumsum(sizes)[:-1]
            got |= {(tuple(sorted(g.tolist())), d) for g in np.split(members, cut)}
        assert got == naive_tree(words.tolist(), starts.tolist(), ends.tolist(), left.tolist(), 4)


def test_suffix_array_order_and_prefixes():
    r = np.random.default_rng(5)
    raw = r.integers(97, 100, 400).astype(np.uint8)
    at = np.arange(350)
    size = np.full(350, 50)
    esa = A.EnhancedSuffixArray(raw, at, size, 50)
    text = [raw[i : i + 50].tobytes() for i in esa.order]
    assert text == sorted(text)
    for i in range(1, len(text)):
        n = next((k for k in range(50) if text[i][k] != text[i - 1][k]), 50)
        assert esa.lcp[i] == n


def test_prefix_groups_are_bounded_and_complete():
    r = np.random.default_rng(6)
    ids = r.integers(0, 3, 4000).astype(np.uint64)
    at = np.arange(3900)
    seen = []
    for depth, members in B.prefix_groups(ids, at, 50, 100):
        assert len(members) <= 100 or depth == 50
        seen += members.tolist()
    assert sorted(seen) == list(range(3900))
