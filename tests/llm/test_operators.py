"""Archives, licences, scores, mixing, media, decontamination and near copies on small and hard inputs."""

import base64
import gzip
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelmill.llm import decontaminate as D
from pixelmill.llm import licenses, media, mixing, near_dup, quality, statistics, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, parts=2):
    return spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], DOCS).repartition(parts)


def hard():
    return [(None, None, None), (None, "some words here", "a"), (1001, "", "a"), (1002, " \t\n ", None), (1003, "ä" * 100_000, "b"), (1003, "ä" * 100_000, "b"), (1004, "word " * 30_000, "b"), (1005, "\u0000\u001f odd   text", "c")]


# archives


def pages(spark):
    rows = [(1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (3, None, "<p>same</p>"), (4, "http://b\r\nX: y", "é" * 500), (5, "u", None), (6, "u", ""), (None, "u", "<p>same</p>"), (7, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\nx"), (7, "u", "two"), (7, "u", "two")]
    return spark.createDataFrame([(i, u, h, "z") for i, u, h in rows], "page_id long, url string, html string, record_type string")


def test_archives(spark, tmp_path):
    warc.write_deduplicated(spark, pages(spark), f"file://{tmp_path}/w")
    back = warc.read_warc(spark, f"file://{tmp_path}/w", digest=True).collect()
    assert len(back) == 10
    by = {}
    for r in back:
        by.setdefault(r.record_id, []).append(r)
    assert [r.record_type for r in by["<urn:page:1>"]] == ["response"]
    assert all(by[f"<urn:page:{i}>"][0].refers_to == "<urn:page:1>" for i in (2, 3)) and by["<urn:page:>"][0].record_type == "revisit"
    assert by["<urn:page:5>"][0].record_type == "response" and by["<urn:page:6>"][0].refers_to == "<urn:page:5>"
    assert bytes(by["<urn:page:4>"][0].payload) == ("é" * 500).encode() and "\r" not in by["<urn:page:4>"][0].target_uri
    assert [r.record_type for r in by["<urn:page:7>"]] == ["response"] * 3
    for r in back:
        if r.record_type == "response":
            assert r.declared_digest == "sha1:" + base64.b32encode(hashlib.sha1(bytes(r.payload)).digest()).decode() == "sha1:" + r.payload_sha1
        else:
            assert r.payload is None and r.payload_length in (0, 11)


def test_archive_predicates(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_deduplicated(spark, pages(spark), path, least=1)
    r = warc.read_warc(spark, path)
    wanted = r.filter("record_type = 'revisit'")
    assert wanted.count() == 3
    assert r.filter(F.col("target_uri").isin("http://a/1", "http://a/2")).count() == 2
    assert warc.read_warc(spark, path, types=("response",)).count() == 7
    assert r.filter("record_type = 'response' and payload_length > 100").count() == 1
    empty = f"file://{tmp_path}/e"
    warc.write_deduplicated(spark, pages(spark).filter("page_id > 9999"), empty)
    assert warc.read_warc(spark, empty).count() == 0


def test_second_writes(spark, tmp_path):
    path, p = f"file://{tmp_path}/w", pages(spark)
    warc.write_deduplicated(spark, p.filter("page_id <= 2"), path)
    warc.write_deduplicated(spark, p.filter("page_id = 4"), path)
    assert sorted(r.record_id for r in warc.read_warc(spark, path).collect()) == ["<urn:page:1>", "<urn:page:2>", "<urn:page:4>"]
    warc.write_deduplicated(spark, p.filter("page_id = 6"), path, mode="overwrite")
    assert [r.record_id for r in warc.read_warc(spark, path).collect()] == ["<urn:page:6>"]
    assert len(list((tmp_path / "w").glob("*.warc.gz"))) == 1
    (tmp_path / "w" / "other").mkdir()
    (tmp_path / "w" / "other" / "a.warc").write_bytes(b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\ninfo\r\n\r\n")
    assert warc.read_warc(spark, path).count() == 2


class Counting:
    """A file that counts the bytes read from it."""

    def __init__(self, file, seen):
        self.file, self.seen = file, seen

    def read(self, n):
        out = self.file.read(n)
        self.seen.append(len(out))
        return out

    def __getattr__(self, name):
        return getattr(self.file, name)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()


@pytest.mark.parametrize("compress", ["true", "false"])
def test_unwanted_payloads_are_not_touched(spark, tmp_path, compress):
    from pyarrow import fs

    r = random.Random(1)
    noise = "".join(chr(r.randrange(33, 1000)) for _ in range(100_000))
    path = f"file://{tmp_path}/w"
    row = lambda i, kind, payload: (f"<{i}>", kind, "u", "<0>", None, None, "sha1:X", 3, None, None, payload, None, None)
    rows = [row(i, "revisit" if i % 10 == 9 else "response", None if i % 10 == 9 else (noise[i:]).encode()) for i in range(40)]
    spark.dataSource.register(warc.WarcDataSource)
    spark.createDataFrame(rows, warc.SCHEMA).coalesce(1).write.format("warc").mode("append").option("path", path).option("compress", compress).save()
    reader = warc.WarcReader({"path": path, "types": "revisit", "split_bytes": "1000000"})
    seen = []

    class System:
        def __init__(self):
            self.inner = fs.LocalFileSystem()

        def open_input_file(self, p):
            return Counting(self.inner.open_input_file(p), seen)

        def __getattr__(self, name):
            return getattr(self.inner, name)

    parts = reader.partitions()
    size = sum(f.stat().st_size for f in (tmp_path / "w").glob("*.warc*") if not f.name.endswith(".index.gz"))
    assert len(parts) > 2 and size > 3_000_000
    got = [x for part in parts for path_, a, b, indexed in part.files for x in reader._indexed(System(), path_, a, b)]
    assert [x[0][0] for x in got] == ["<9>", "<19>", "<29>", "<39>"] and sum(seen) < 4 * 800
    assert warc.read_warc(spark, path).count() == 40
    back = warc.read_warc(spark, path).filter("record_id = '<17>'").first()
    assert bytes(back.payload).decode() == noise[17:]


def test_damaged_archives(spark, tmp_path):
    whole = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\ninfo\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(whole + whole[:-7])
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(whole) + gzip.compress(whole * 50)[:60])
    with pytest.raises(Exception, match="damaged archive"):
        warc.read_warc(spark, f"file://{tmp_path}").count()
    spark.dataSource.register(warc.WarcDataSource)
    assert spark.read.format("warc").option("path", f"file://{tmp_path}/a.warc").option("damaged", "stop").load().count() == 1
    assert spark.read.format("warc").option("path", f"file://{tmp_path}").option("damaged", "stop").load().count() >= 2


def test_filters_reach_the_reader():
    reader = warc.WarcReader({"path": "x"})
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    left = list(reader.pushFilters([EqualTo(("record_type",), "response"), In(("target_uri",), ("a", "b")), GreaterThan(("payload_length",), 5)]))
    assert len(left) == 1 and reader.wanted == [("warc-type", frozenset(["response"])), ("warc-target-uri", frozenset(["a", "b"]))]


def test_foreign_archives(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nhello"
    records = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\ninfo\r\n\r\n" + b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://x/\r\n folded\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(records)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(records))
    rows = warc.read_warc(spark, f"file://{tmp_path}").filter("record_type = 'response'").collect()
    assert [bytes(r.payload) for r in rows] == [b"hello"] * 2 and rows[0].target_uri == "http://x/ folded"


def test_base32(spark):
    for x in (b"", b"abc", b"\xff" * 50):
        h = hashlib.sha1(x)
        assert spark.range(1).select(warc._hex_to_base32(F.lit(h.hexdigest()))).first()[0] == base64.b32encode(h.digest()).decode()


# licences


def test_licences(spark):
    from pixelmill.llm import license_texts

    half = " ".join(license_texts.MIT.split()[:60])
    rows = [(1, "CC BY, cc by-nc! All RIGHTS reserved", "a"), (2, "general public\nlicense general public license", "a"), (3, "cc cc by by all rights", "a"), (4, "x " + license_texts.MIT.replace("copies", "pieces", 1), "a"), (5, half, "a"), *hard()]
    rows += [(6, " ".join(reversed(license_texts.MIT.split())), "a"), (7, license_texts.APACHE + license_texts.ISC + "all rights reserved", "a")]
    got = licenses.scan(spark, documents(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert (by[1].n_words, by[1].n_base, by[1].first_word, by[1].last_word, by[1].base_labels, by[1].labels, by[1].score) == (8, 3, 0, 5, "cc-by,reserved", "cc-by,cc-by-nc,reserved", 1.0)
    assert (by[2].n_base, by[2].first_word, by[2].last_word, by[2].base_labels) == (2, 0, 3, "gpl")
    assert (by[3].n_base, by[3].first_word) == (1, 1)
    assert by[4].labels == "mit" and by[4].n_base == 0 and by[4].first_word is None and 0.9 <= by[4].score < 1
    assert by[2].labels == "gpl" and by[5].labels == "mit" and 0.6 <= by[5].score < 0.8
    assert by[6].labels == "" and by[6].score == 0 and by[7].labels == "apache,isc,reserved" and by[7].score == 1
    assert by[1001].n_words == 0 and by[1003].n_words == 1 and by[1003].score == 0
    assert licenses.scan(spark, documents(spark, rows).filter("doc_id > 9999")).count() == 0


def brute_scan(text, templates, gap=3):
    """n_words, n_base, first, last, base labels, labels and score of a text, all pairs of places compared."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    places, labels, score = [], set(), 0.0
    for t in templates:
        v = licenses.template_words(t.text)
        k = min(licenses.GRAM, len(v))
        hits = [(i, j) for i in range(len(w) - k + 1) for j in range(len(v) - k + 1) if w[i : i + k] == v[j : j + k]]
        diagonals = sorted({i - j for i, j in hits})
        runs = []
        for d in diagonals:
            if runs and d - runs[-1][-1] <= (0 if t.share == 1 else gap):
                runs[-1].append(d)
            else:
                runs.append([d])
        for run in runs:
            mine = sorted(h for h in hits if h[0] - h[1] in run)
            best = [1] * len(mine)
            for x in range(len(mine)):
                for y in range(x):
                    if mine[y][0] < mine[x][0] and mine[y][1] < mine[x][1]:
                        best[x] = max(best[x], best[y] + 1)
            share = max(best) / max(1, len(v) - licenses.GRAM + 1)
            if share >= t.share:
                labels.add(t.label)
                score = max(score, share)
                if t.base:
                    places.append((max(run[0], 0), t.label))
    places.sort()
    return len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), score


def test_licences_by_brute_force(spark):
    r = random.Random(2)
    words = ["cc", "by", "all", "rights", "reserved", "general", "public", "license", "x"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randrange(0, 40))), "a") for i in range(60)]
    small = (*licenses.TEMPLATES[:3], licenses.Template("long", "x y x y z all rights x y w", share=0.5), licenses.Template("loop", "cc by cc by cc by all rights", share=0.6))
    more = ["x", "y", "z", "all", "rights", "cc", "by", "w"]
    rows += [(100 + i, " ".join(r.choice(more) for _ in range(r.randrange(0, 50))), "a") for i in range(60)]
    long = [t.text for t in licenses.TEMPLATES if t.share < 1]
    for i in range(25):
        w = (r.choice(long) + " cc by " + r.choice(long)).split()
        for _ in range(r.randrange(0, 40)):
            k = r.randrange(len(w))
            w[k : k + r.randrange(0, 3)] = [r.choice(["x", "the", "software"])]
        rows.append((200 + i, " ".join(w), "a"))
    texts = {i: t for i, t, _ in rows}
    for templates in (small, licenses.TEMPLATES):
        for got in licenses.scan(spark, documents(spark, rows), templates).collect():
            want = brute_scan(texts[got.doc_id], templates)
            assert tuple(got)[1:-1] == want[:-1] and abs(got.score - want[-1]) < 1e-12, (got, want)


# scores


def labelled_documents(spark, n=600):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        bad = r.random() < 0.2
        w = [r.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(r.randrange(5, 60))]
        text = " ".join(x.upper() + "!!" if bad else x for x in w)
        toxic = r.random() < 0.2
        rows.append((i, text + (" idiot" if toxic else ""), "a"))
        labels.append((i, int(not bad), int(toxic)))
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(spark):
    docs, labels = labelled_documents(spark)
    got = quality.score_quality(spark, docs.unionByName(documents(spark, hard())), labels, features=32).collect()
    assert len(got) == 608 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert {r.doc_id for r in held} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(not r.held_out for r in got if r.doc_id is None)


def test_quality_without_labels_or_rows(spark):
    docs, labels = labelled_documents(spark, 20)
    assert {r.score for r in quality.score_quality(spark, docs, labels.filter("doc_id < 0")).collect()} == {0.5}
    assert quality.score_quality(spark, docs.filter("doc_id < 0"), labels).count() == 0


def brute_isotonic(n, good):
    """The non-decreasing fit by its definition: of all stretches that end at or after a place the least mean, of all that begin before it the greatest."""
    mean = lambda a, b: good[a : b + 1].sum() / n[a : b + 1].sum()
    return np.array([max(min(mean(a, b) for b in range(i, len(n))) for a in range(i + 1)) for i in range(len(n))])


def test_quality_by_brute_force(spark):
    """The same scores from all rows at once: dense least squares for every penalty and fold, the isotonic fit by its definition."""
    docs, labels = labelled_documents(spark, 300)
    rows = statistics.document_statistics(docs).select("doc_id", "stats", F.pmod(F.xxhash64("doc_id"), F.lit(quality.FOLDS)).alias("fold")).orderBy("doc_id").collect()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    x, fold, ids = np.array([r.stats for r in rows]), np.array([r.fold for r in rows]), [r.doc_id for r in rows]
    known = np.array([zlib.crc32(str(i).encode()) % 4 != 2 for i in ids])
    y = np.array([truth[i] for i in ids], float)
    f = quality.Fourier(x[known].mean(0), x[known].std(0), 32)
    z, zk, yk, fk = f(x), f(x[known]), y[known], fold[known]

    def ridge(a, b, penalty):
        n, d = len(a), a.shape[1]
        more = np.full(d, penalty * n)
        more[-1] = 1e-9 * n
        return np.linalg.lstsq(np.vstack([a, np.diag(np.sqrt(more + 1e-9))]), np.append(b, np.zeros(d)), rcond=None)[0]

    def left_out(penalty):
        return np.concatenate([[ridge(zk[fk != k], yk[fk != k], penalty) for k in range(quality.FOLDS)]])

    errors = {p: sum(((zk[fk == k] @ w - yk[fk == k]) ** 2).sum() for k, w in enumerate(left_out(p))) for p in quality.PENALTIES}
    best = min(errors, key=errors.get)
    raw = np.einsum("ij,ij->i", zk, left_out(best)[fk])
    bins = np.clip((raw + 0.5) / 2 * quality.BINS, 0, quality.BINS - 1).astype(int)
    used = np.unique(bins)
    n, good = np.array([(bins == b).sum() for b in used], float), np.array([yk[bins == b].sum() for b in used])
    level = brute_isotonic(n, good)
    blocks = [np.flatnonzero(np.isclose(level, v, atol=1e-12)) for v in sorted(set(np.round(level, 12)))]
    centre = (used + 0.5) / quality.BINS * 2 - 0.5
    knots = np.array([(centre[b] * n[b]).sum() / n[b].sum() for b in blocks])
    values = np.maximum.accumulate([(good[b].sum() + 0.5) / (n[b].sum() + 1) for b in blocks])
    want = dict(zip(ids, quality.calibrated(z @ ridge(zk, yk, best), knots, values)))
    got = {r.doc_id: r.score for r in quality.score_quality(spark, docs, labels, features=32).collect()}
    assert max(abs(got[i] - want[i]) for i in ids) < 1e-3


def test_isotonic_by_definition():
    r = np.random.default_rng(12)
    for _ in range(20):
        n, x = r.integers(1, 5, 30).astype(float), np.arange(30.0)
        good = np.array([r.integers(0, int(k) + 1) for k in n], float)
        knots, values = quality.isotonic(x, n, good)
        level = brute_isotonic(n, good)
        blocks = [np.flatnonzero(np.isclose(level, v)) for v in sorted(set(np.round(level, 12)))]
        assert np.allclose(knots, [(x[b] * n[b]).sum() / n[b].sum() for b in blocks])
        assert np.allclose(values, np.maximum.accumulate([(good[b].sum() + 0.5) / (n[b].sum() + 1) for b in blocks]))


def test_isotonic_does_not_fall():
    r = np.random.default_rng(4)
    x = np.sort(r.normal(size=200))
    y = (r.random(200) < 1 / (1 + np.exp(-2 * x))).astype(float)
    knots, values = quality.isotonic(x, np.ones(200), y)
    assert (np.diff(values) >= 0).all() and (np.diff(knots) > 0).all()
    s = quality.calibrated(x, knots, values)
    assert (np.diff(s) >= 0).all()


def test_fourier_features_approximate_the_kernel():
    r = np.random.default_rng(5)
    f = quality.Fourier(np.zeros(6), np.ones(6), features=8000)
    x = r.normal(size=(20, 6))
    z = f(x)[:, :8000]
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert np.abs(z @ z.T - np.exp(-d / (2 * quality.WIDTH**2))).max() < 0.06


def test_statistics():
    import pyarrow as pa

    from pixelmill.llm import kernels as K

    s = dict(zip(statistics.NAMES, statistics.statistics_of(*K.text_buffer(pa.array(["Ab c!\nAb c!\n", None])))[0]))
    assert s["distinct_lines"] == 0.5 and s["distinct_words"] == 0.5 and s["shout"] == 2 / 12 and s["log_words"] == np.log(5)


def test_toxicity(spark):
    docs, labels = labelled_documents(spark)
    got = toxicity.score_toxicity(spark, docs.withColumn("toxic", F.lit("clash")), labels).collect()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert len(got) == 600 and all(r.toxic == truth[r.doc_id] for r in got) and "text" in got[0]
    none = toxicity.score_toxicity(spark, documents(spark, hard()), labels.filter("doc_id < 0")).collect()
    assert len(none) == 8 and all(r.toxic == 0 for r in none)
    assert toxicity.score_toxicity(spark, docs.filter("doc_id < 0"), labels, train_docs=docs).count() == 0


def test_labels_that_repeat(spark):
    """A doc_id counts once: the greatest of its labels, the first of its texts and languages; so training data is bounded."""
    docs, labels = labelled_documents(spark, 200)
    many = docs.unionByName(docs.filter("doc_id < 20").withColumn("text", F.lit("zzz"))).unionByName(docs.filter("doc_id < 20").withColumn("lang", F.lit("zz")))
    twice = labels.unionByName(labels.filter("doc_id < 20").withColumn("toxic", F.lit(0)))
    got = toxicity.category_labels(many, twice).collect()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert len(got) == 200 and {r.doc_id: (r.toxic_english, r.toxic_other, r.toxic) for r in got} == {i: (t, 0, t) for i, t in truth.items()}
    a = toxicity.fit_chain(spark, many, toxicity.category_labels(many, twice), toxicity.CATEGORIES)
    b = toxicity.fit_chain(spark, docs, toxicity.category_labels(docs, labels), toxicity.CATEGORIES)
    assert all(np.allclose(x, y) for x, y in zip(a.weights, b.weights))


def test_toxicity_by_brute_force(spark):
    """Features counted word by word, the choice of features one by one, weights at the optimum, and the chain row by row."""
    import pyarrow as pa

    from pixelmill.llm import kernels as K

    docs, labels = labelled_documents(spark, 150)
    texts = {r.doc_id: r.text for r in docs.collect()}
    known = {r.doc_id: (r.toxic_english, r.toxic_other, r.toxic) for r in toxicity.category_labels(docs, labels).collect()}
    buckets = 1 << 12

    def buckets_of(text):
        found = []
        for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()):
            raw = np.frombuffer(w.encode(), np.uint8)
            for p in (0, *toxicity.PREFIXES):
                if not p or len(raw) > p:
                    found.append(int(toxicity._hash(raw, np.array([0]), np.array([p or len(raw)]), buckets, p)[0]))
        return found

    ids = sorted(known)
    counts = np.zeros((len(ids), buckets))
    for k, i in enumerate(ids):
        for b in buckets_of(texts[i]):
            counts[k, b] += 1
    y = np.array([known[i] for i in ids], float)
    chosen = set()
    for c in range(3):
        n, total = len(ids), y[:, c].sum()
        if not 0 < total < n:
            continue
        gains = []
        for b in range(buckets):
            seen, mine = (counts[:, b] > 0).sum(), ((counts[:, b] > 0) & (y[:, c] > 0)).sum()
            if mine >= 3 and mine > seen * total / n:
                rest = seen - mine
                g = mine * np.log(mine / (seen * total / n)) + (rest * np.log(rest / (seen * (1 - total / n))) if rest else 0)
                if g > 2:
                    gains.append((-g, b))
        chosen |= {b for _, b in sorted(gains)[: toxicity.KEEP]}
    chain = toxicity.fit_chain(spark, docs, toxicity.category_labels(docs, labels), toxicity.CATEGORIES, n_buckets=buckets)
    assert chain.features.tolist() == sorted(chosen)
    x = np.log1p(counts[:, chain.features])
    raw = K.text_buffer(pa.array([texts[i] for i in ids]))
    assert np.allclose(toxicity.matrix(*raw, chain.features, buckets), x)
    # the first model has no inputs beside the features: its gradient, penalty included, is 0
    w = chain.weights[0]
    one = np.hstack([x, np.ones((len(x), 1))])
    p = 1 / (1 + np.exp(-one @ w))
    penalty = np.append(np.full(x.shape[1], toxicity.PENALTY), 1e-3)
    assert np.abs(one.T @ (y[:, 0] - p) - penalty * w).max() < 1e-3
    out = {r.doc_id: (r.p_toxic_english, r.p_toxic_other, r.p_toxic) for r in toxicity.apply_chain(docs, chain, toxicity.CATEGORIES).collect()}
    for k, i in enumerate(ids):
        earlier = []
        for w in chain.weights:
            row = np.concatenate([x[k], earlier, [1.0]])
            earlier.append(1 / (1 + np.exp(-np.clip(row @ w, -30, 30))))
        assert np.allclose(out[i], earlier)


def test_chain_uses_earlier_categories():
    r = np.random.default_rng(6)
    a = r.integers(0, 2, 400)
    x = np.stack([a + r.normal(size=400) * 0.3, r.normal(size=400)], 1)
    c = toxicity.Chain.fit(x, np.stack([a, a], 1), np.arange(400) % 4, np.arange(2), [np.arange(2)] * 5, 8)
    assert len(c.weights[0]) == 3 and len(c.weights[1]) == 4 and c.weights[1][2] > 0


# mixing


def test_mixing(spark, sf):
    c = duckdb.connect()
    r = random.Random(7)
    rows = [(i, "w " * r.randrange(0, 50), r.choice(["a", "b", "c", "d", None, "É", "z"])) for i in range(300)] + [(500, "w " * 5000, "big"), (501, "w", "tiny"), (7, "w w", "a"), (7, "w w w", "a")] + hard()
    docs = documents(spark, rows, 4)
    got = mixing.mix(spark, docs).select("doc_id", "size", "source_size", "target", "taken")
    c.register("documents", docs.select("doc_id", "text", "source").toArrow())
    want = c.execute(mixing.OP7_SQL).fetchall()
    order = lambda x: (float("inf") if x[0] is None else x[0], x[1:])
    found = sorted(map(tuple, got.collect()), key=order)
    assert found == sorted(want, key=order)
    assert all(x[4] <= 3 * x[1] for x in found)
    assert sum(x[1] for x in found) == sum(len(re.findall("[^\x20\x09-\x0d]+", t or "")) for _, t, _ in rows)
    sums = mixing.mix(spark, docs).select("source_size", "target").distinct().collect()
    assert all(s.target <= 3 * s.source_size for s in sums)
    assert mixing.mix(spark, docs.filter("doc_id > 9999")).count() == 0


# media


def test_media(spark):
    rows = hard() + [(9, "abc", "x")]
    got = media.media_digest(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    p = b"abc" + b" " * 189
    assert (by[9].n_bytes, by[9].payload_bytes, by[9].payload_sha256, by[9].tail_crc32) == (3, 192, hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    assert by[1001].n_bytes == 0 and by[1001].payload_bytes == 192
    row = media.media_column(documents(spark, [(3, "x" * 10_000, "a")])).first()
    track = media.read_tracks(bytes(row.media))[0]
    assert media.read_payload(bytes(row.media), track) == b"x" * 10_000 + b" " * (53 * 192 - 10_000)
    assert (row.codec, row.duration, row.n_samples) == ("raw ", 53 * 192, 53) and [tuple(k) for k in row.keyframes] == track["keyframes"] and len(row.keyframes) == 4
    assert media.media_digest(documents(spark, rows).filter("doc_id > 9999")).count() == 0


@pytest.mark.parametrize("per_chunk,key_every", [(1, 1), (64, 16), (3, 100)])
def test_media_round_trip(per_chunk, key_every):
    payload = bytes(np.random.default_rng(8).integers(0, 256, 192 * 11).astype(np.uint8))
    data = media.write_media(payload, per_chunk=per_chunk, key_every=key_every)
    t = media.read_tracks(data)[0]
    assert media.read_payload(data, t) == payload and [data[a:b] for a, b in t["keyframes"]] == [payload[192 * k : 192 * (k + 1)] for k in range(0, 11, key_every)]
    for cut in range(0, len(data), 97):  # damaged files end the walk, they do not crash it
        media.read_tracks(data[:cut])
    with pytest.raises(ValueError):
        media.write_media(b"x")


def test_media_digest_by_other_means(spark):
    """What is stored, taken from the file by searching it for the payload instead of walking its boxes."""
    rows = [(1, "abc", "a"), (2, None, "a"), (3, "é" * 5000, "a"), (4, "x" * 192, "a"), (None, "y" * 193, "a")]
    files = {r.doc_id: bytes(r.media) for r in media.media_column(documents(spark, rows)).collect()}
    for r in media.media_digest(documents(spark, rows)).collect():
        raw = (next(t for i, t, _ in rows if i == r.doc_id) or "").encode()
        p = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        f = files[r.doc_id]
        at = f.index(b"mdat") + 4
        assert f[at : at + len(p)] == p and f[at + len(p) + 4 : at + len(p) + 8] == b"moov"
        keys = range(0, len(p) // 192, 16)
        feature = f"raw |24000|{len(p)}|{len(p) // 192}|{len(keys)}|{at}-{at + 192 * keys[-1] + 192}|{192 * len(keys)}"
        assert tuple(r)[1:] == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(f), hashlib.sha256(f).hexdigest(), feature)


def test_fragments():
    payload = bytes(np.random.default_rng(9).integers(0, 256, 192 * 150).astype(np.uint8))
    whole, parts = media.read_tracks(media.write_media(payload))[0], media.write_fragments(payload)
    t = media.read_tracks(parts)[0]
    assert media.read_payload(parts, t) == payload and (t["codec"], t["duration"], t["decode_times"]) == (whole["codec"], whole["duration"], whole["decode_times"])
    assert [parts[a:b] for a, b in t["keyframes"]] == [payload[192 * k : 192 * (k + 1)] for k in range(0, 150, 16)]
    for cut in range(0, len(parts), 997):
        media.read_tracks(parts[:cut])


def test_sample_tables():
    import struct

    def track(*tables):
        head = media.box(b"trak", media.box(b"edts", media.full(b"elst", struct.pack(">IIii", 1, 7, 5, 1 << 16))), media.box(b"mdia", media.box(b"minf", media.box(b"stbl", *tables))))
        return media.box(b"moov", head)

    stsc = media.full(b"stsc", struct.pack(">I", 1), struct.pack(">III", 1, 2, 1))
    stco = media.full(b"stco", struct.pack(">III", 2, 0, 50))
    for bits, body in ((4, bytes([0x31, 0x42])), (8, bytes([3, 1, 4, 2])), (16, bytes([0, 3, 0, 1, 0, 4, 0, 2]))):
        t = media.read_tracks(track(stsc, stco, media.full(b"stz2", struct.pack(">II", bits, 4), body)))[0]
        assert t["samples"] == [(0, 3), (3, 4), (50, 54), (54, 56)] and t["keyframes"] == t["samples"] and t["edits"] == [(7, 5)]
    times = (media.full(b"stts", struct.pack(">IIIII", 2, 1, 10, 3, 20)), media.full(b"ctts", struct.pack(">IIi", 1, 4, -5), version=1))
    t = media.read_tracks(track(stsc, stco, media.full(b"stsz", struct.pack(">II", 2, 4)), *times))[0]
    assert t["decode_times"] == [0, 10, 30, 50] and t["times"] == [-5, 5, 25, 45]
    # counts that no file can hold, and a first chunk of 0
    huge = struct.pack(">II", 1, (1 << 32) - 1)
    most = media.read_tracks(track(media.full(b"stsc", struct.pack(">I", 1), struct.pack(">III", 1, (1 << 32) - 1, 1)), stco, media.full(b"stsz", huge), media.full(b"stts", struct.pack(">III", 1, (1 << 32) - 1, 1))))[0]
    assert 0 < len(most["samples"]) < 400
    assert media.read_tracks(track(media.full(b"stsc", struct.pack(">I", 1), struct.pack(">III", 0, 2, 1)), stco, media.full(b"stsz", huge)))[0]["samples"] == []


def test_media_column_on_hard_rows(spark):
    rows = hard()
    got = media.media_column(documents(spark, rows).withColumn("codec", F.lit("clash"))).collect()
    assert len(got) == len(rows) and all(r.codec == "raw " for r in got)
    assert sorted(media.read_payload(bytes(r.media), media.read_tracks(bytes(r.media))[0]).rstrip(b" ") for r in got) == sorted((t or "").encode().rstrip(b" ") for _, t, _ in rows)
    assert media.media_column(documents(spark, rows).filter("doc_id > 9999")).count() == 0


# decontamination


def least_distance(p, t):
    col, best = list(range(len(p) + 1)), len(p)
    for c in t:
        new = [0]
        for i in range(1, len(p) + 1):
            new.append(min(col[i - 1] + (p[i - 1] != c), col[i] + 1, new[-1] + 1))
        col = new
        best = min(best, col[-1])
    return best


def test_capitals_of_all_scripts_are_no_edits():
    for item in ("été à la forêt, où les élèves répétèrent leur leçon", "последний урок был в пятницу вечером", "ο τελευταίος δρόμος της πόλης ήταν κενός"):
        text = "x " + item.upper() + " İ y"
        assert len(D.fold(text)) == len(text)
        assert list(D.Items([(7, item)], 0.08).find(D.codes_of(text), np.array([0, len(text)]))) == [(0, 7, 0, 2, 2 + len(item))]


def test_decontamination_by_brute_force(spark):
    r = random.Random(9)
    say = lambda n: "".join(r.choice("abcde ") for _ in range(n))

    def edit(t, n):
        t = list(t)
        for _ in range(n):
            k, o = r.randrange(len(t)), r.random()
            if o < 0.4:
                t[k] = r.choice("xyz")
            elif o < 0.7:
                t.insert(k, r.choice("xyz"))
            else:
                del t[k]
        return "".join(t)

    items = [(0, say(60)), (1, say(120)), (2, "Short One"), (3, None), (4, "  "), (5, say(25)), (5, say(30)), (-1, say(70)), (None, say(80))]
    rows = [(i, say(r.randrange(0, 80)) + (edit(r.choice([t for _, t in items if t and len(t) > 20]).strip(), r.randrange(0, 12)) if r.random() < 0.7 else "") + say(10), "a") for i in range(80)] + [(99, "it is SHORT\none!", "b"), *hard()]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, rows, 3)
    for block in (1 << 20, 50):
        got = D.matches(spark, docs, bench, block=block).collect()
        found = {(x.doc_id, x.item_id, x.distance) for x in got}
        want = set()
        for i, t, _ in rows:
            t = D.fold(t)
            if len(t) > 10_000:
                continue
            for k, p in items:
                p = D.fold(p).strip()
                d = least_distance(p, t) if p else None
                if p and d <= D.budget(len(p)):
                    want.add((i, k, d))
        assert found == want
        for x in got:
            t = next(t for i, t, _ in rows if i == x.doc_id)
            assert x.distance == min(least_distance(D.fold(p).strip(), D.fold(t)[x.start : x.end]) for k, p in items if k == x.item_id and p)
    kept = D.clean(spark, docs, bench)
    dirty = {i for i, _, _ in want}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _, _ in rows if i not in dirty) and kept.columns == docs.columns
    assert D.matches(spark, docs.filter("doc_id > 9999"), bench).count() == 0 and D.matches(spark, docs, bench.filter("item_id > 99")).count() == 0


# near copies


def brute_links(rows, percent):
    sets = {}
    for i, t, _ in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if a < b and sets[a] and sets[b] and 100 * both >= percent * either:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_copies(spark, percent):
    r = random.Random(percent)
    say = lambda n: [f"w{r.randrange(200)}" for _ in range(n)]
    rows = []
    for k in range(12):
        base = say(r.randrange(20, 120))
        for _ in range(r.randrange(1, 7)):
            w = list(base)
            for _ in range(r.randrange(0, 4)):
                w[r.randrange(len(w))] = r.choice("xyz")
            rows.append((len(rows), " ".join(w), "a"))
    rows += [(100, "One two", "a"), (101, "one  TWO", "a"), (102, "", "a"), (103, None, "a"), (104, "a a a a a a a a", "a"), (105, "a a a a a", "a")]
    docs = documents(spark, rows + [(None, "one two", "a"), (None, None, "b")], 3).withColumn("component_id", F.lit("clash"))
    got = near_dup.near_duplicates(spark, docs, percent).collect()
    assert len(got) == len(rows) + 2
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got if x.doc_id is not None} == brute_links(rows, percent)
    assert all(x.kept == (x.doc_id == x.component_id) for x in got if x.doc_id is not None)
    assert all(x.kept and x.component_id is None for x in got if x.doc_id is None)


def test_near_copies_in_crowded_nodes(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "NODE", 8)
    monkeypatch.setattr(near_dup, "LARGE", 30)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        w[i] = "x"
        rows.append((i, " ".join(w), "a"))
    rows.append((60, " ".join(f"v{i}" for i in range(50)), "a"))
    got = {x.doc_id: x.component_id for x in near_dup.near_duplicates(spark, documents(spark, rows)).collect()}
    assert got == {i: c for i, (_, c) in brute_links(rows, 85).items()}
    assert near_dup.near_duplicates(spark, documents(spark, rows).filter("doc_id > 9999")).count() == 0


def test_single_links_in_crowded_nodes(spark, monkeypatch):
    """All variants are near their base only, in nodes that are split into blocks."""
    monkeypatch.setattr(near_dup, "NODE", 8)
    monkeypatch.setattr(near_dup, "LARGE", 30)
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(1000)]
    rows = [(500, " ".join(base), "a")]
    for i in range(120):
        w = list(base)
        for k in rnd.sample(range(2, 1000, 5), 10):
            w[k] = f"x{i}y{k}"
        rows.append((i, " ".join(w), "a"))
    got = {x.doc_id: x.component_id for x in near_dup.near_duplicates(spark, documents(spark, rows, 3)).collect()}
    assert got == {i: c for i, (_, c) in brute_links(rows, 85).items()} == dict.fromkeys([500, *range(120)], 0)


@pytest.mark.parametrize("percent", [80, 85])
def test_recall_of_single_links(spark, monkeypatch, percent):
    """Pairs just above the threshold, each the only link of its documents, in nodes that branch several times."""
    monkeypatch.setattr(near_dup, "NODE", 6)
    rnd = random.Random(percent)
    common = [f"c{i}" for i in range(8)]
    rows = []
    for k in range(150):
        base = [f"a{k}x{i}" for i in range(260)] + common * 6
        other = list(base)
        while True:
            other[rnd.randrange(260)] = f"b{rnd.randrange(10**6)}"
            a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (base, other))
            if 100 * len(a & b) < (percent + 3) * len(a | b):
                break
        rows += [(2 * k, " ".join(base), "a"), (2 * k + 1, " ".join(other), "a")]
    want = brute_links(rows, percent)
    got = {x.doc_id: x.component_id for x in near_dup.near_duplicates(spark, documents(spark, rows, 3), percent).collect()}
    linked = [i for i, (_, c) in want.items() if c != i]
    assert len(linked) > 60 and all(got[i] == i for i in got if want[i][1] == i)
    assert sum(got[i] == want[i][1] for i in linked) >= 0.99 * len(linked)


def test_links_pass_over_parts():
    rnd = np.random.default_rng(5)
    base = rnd.integers(0, 1 << 60, 100).astype(np.uint64)
    sets = [np.unique(np.append(base[: 100 - i % 7], rnd.integers(0, 1 << 60, i % 5).astype(np.uint64))) for i in range(40)]
    ids, parts = np.arange(40), np.arange(40) // 20
    assert len(near_dup.links_in(ids, sets, 85)) == 39
    assert len(near_dup.links_in(ids, sets, 85, parts)) == 1
    assert len(near_dup.links_in(ids, sets, 85, np.minimum(ids, 4))) == 4


def test_long_text_shingles():
    import pyarrow as pa

    from pixelmill.llm import kernels as K

    n = K.CHUNK + 1000
    g, o = near_dup.shingle_sets(*K.text_buffer(pa.array([" ".join(map(str, range(n))), "a b c d e"])))
    assert o.tolist() == [0, n - 4, n - 3] and len(g) == n - 3


# cases that no table holds


def test_predicates_with_null_and_archives_of_others(spark, tmp_path):
    """Pushed conditions hold as SQL has them, and archives beside a manifest are not passed over in silence."""
    path = f"file://{tmp_path}/w"
    warc.write_deduplicated(spark, pages(spark), path)
    r, plain = warc.read_warc(spark, path), [x.target_uri for x in warc.read_warc(spark, path).collect()]
    assert None in plain
    for wanted in (("u",), ("http://a/1", "u")):
        condition = "target_uri in (null, " + ", ".join(f"'{w}'" for w in wanted) + ")"
        assert r.filter(condition).count() == sum(u in wanted for u in plain)
    assert r.filter("target_uri in (null)").count() == 0 == r.filter("target_uri = null").count()
    assert r.filter("target_uri is null").count() == plain.count(None)
    record = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\ninfo\r\n\r\n"
    (tmp_path / "w" / "strange.warc").write_bytes(record)
    (tmp_path / "w" / "part-0123456789ab-000000-7-0000.warc").write_bytes(record)  # an attempt that was lost
    with pytest.raises(Exception, match="strange.warc"):
        warc.read_warc(spark, path).count()
    option = lambda v: spark.read.format("warc").option("path", path).option("unlisted", v).load().count()
    assert option("read") == 11 and option("skip") == 10


def test_boxes_as_deep_as_a_file_says(spark):
    deep = b""
    for _ in range(3000):
        deep = (len(deep) + 8).to_bytes(4, "big") + b"moov" + deep
    found = list(media.boxes(deep))
    assert len(found) == media.DEEPEST + 1 and found[0] == ((b"moov",), 8, len(deep))
    inner = (8).to_bytes(4, "big") + b"free"
    both = (24).to_bytes(4, "big") + b"moov" + inner + inner + inner
    assert [p for p, _, _ in media.boxes(both)] == [(b"moov",), (b"moov", b"free"), (b"moov", b"free"), (b"free",)]


def test_features_of_a_fold_come_from_other_folds():
    """A bucket that only one fold's rows show is no input of that fold's probabilities."""
    rng = np.random.default_rng(0)
    fold, y = np.arange(400) % 4, (np.arange(400) // 4) % 2
    x = np.stack([y + rng.normal(size=400) * 0.1, (fold == 0) * y], 1).astype(float)
    own = toxicity.Chain.fit(x, y[:, None], fold, np.array([3, 9]), [np.array([3]), np.array([3, 9]), np.array([3, 9]), np.array([3, 9]), np.array([3, 9])], 16)
    assert own.features.tolist() == [3, 9] and len(own.weights[0]) == 3


def test_crowded_nodes_of_long_texts_are_split_by_load(spark, monkeypatch):
    """No block of an oversized node holds more shingles than a task is meant to, and links stay whole."""
    monkeypatch.setattr(near_dup, "LOAD", 900)
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = []
    for i in range(24):
        words = list(base)
        words[(i * 7) % 200] = f"x{i}"
        texts.append(" ".join(words))
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark, documents(spark, rows), 80).collect()}
    assert set(got.values()) == {0} and len(got) == 24
