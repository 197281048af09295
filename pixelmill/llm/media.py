"""Media columns: ISO base media files written, walked and summarised without decoding payloads."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Boxes that hold boxes, and the bytes before their children.
#: Levels of boxes; files as they are written have about ten.
DEEPEST = 32
CONTAINERS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"dinf": 0, b"stbl": 0, b"edts": 0, b"udta": 0, b"mvex": 0, b"moof": 0, b"traf": 0}
SAMPLE = 192
RATE = 24_000
#: A keyframe every so many samples.
KEY_EVERY = 16


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def write_fragments(payload: bytes, sample: int = SAMPLE, codec: bytes = b"raw ", rate: int = RATE, key_every: int = KEY_EVERY, per_fragment: int = 64) -> bytes:
    """The same samples as ``write_media``'s as a fragmented file: an empty track, then a moof and an mdat for each fragment."""
    n, rest = divmod(len(payload), sample)
    if rest or not n:
        raise ValueError("the payload must be a positive multiple of the sample size")
    empty = box(b"stbl", full(b"stsd", struct.pack(">I", 1), box(codec, bytes(28))), full(b"stts", bytes(4)), full(b"stsc", bytes(4)), full(b"stsz", bytes(8)), full(b"stco", bytes(4)))
    trak = box(b"trak", full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, 0), bytes(60)), box(b"mdia", full(b"mdhd", struct.pack(">IIII", 0, 0, rate, 0), bytes(4)), box(b"minf", empty)))
    trex = full(b"trex", struct.pack(">IIIII", 1, 1, sample, sample, 0x10000))
    out = [box(b"ftyp", b"iso5", struct.pack(">I", 512), b"iso5"), box(b"moov", trak, box(b"mvex", trex))]
    for at in range(0, n, per_fragment):
        m = min(per_fragment, n - at)
        entries = b"".join(struct.pack(">I", 0 if k % key_every == 0 else 0x10000) for k in range(at, at + m))

        def moof(offset: int, at: int = at, m: int = m, entries: bytes = entries) -> bytes:
            run = full(b"trun", struct.pack(">Ii", m, offset), entries, flags=0x401)
            return box(b"moof", full(b"mfhd", struct.pack(">I", 1 + at // per_fragment)), box(b"traf", full(b"tfhd", struct.pack(">I", 1), flags=0x20000), full(b"tfdt", struct.pack(">I", at * sample)), run))

        out += [moof(len(moof(0)) + 8), box(b"mdat", payload[at * sample : (at + m) * sample])]
    return b"".join(out)


def write_media(payload: bytes, sample: int = SAMPLE, codec: bytes = b"raw ", rate: int = RATE, key_every: int = KEY_EVERY, per_chunk: int = 64) -> bytes:
    """An ISO media file with one track of 8-bit samples, ``sample`` bytes to a table entry.

    The length of ``payload`` must be a positive multiple of ``sample``.
    """
    n, rest = divmod(len(payload), sample)
    if rest or not n:
        raise ValueError("the payload must be a positive multiple of the sample size")
    matrix = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    duration = n * sample
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"iso2", b"mp41")
    at = len(ftyp) + (8 if len(payload) < (1 << 32) - 8 else 16)
    starts = range(at, at + len(payload), per_chunk * sample)
    whole, last = divmod(n, per_chunk)
    runs = ([(1, per_chunk, 1)] if whole else []) + ([(whole + 1, last, 1)] if last else [])
    wide = at + len(payload) >= 1 << 32
    entry = struct.pack(">6xH", 1) + struct.pack(">8xHHHHI", 1, 8, 0, 0, (rate << 16) & 0xFFFFFFFF)
    keys = range(1, n + 1, key_every)
    stbl = box(
        b"stbl",
        full(b"stsd", struct.pack(">I", 1), box(codec, entry)),
        full(b"stts", struct.pack(">III", 1, n, sample)),
        full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
        full(b"stsz", struct.pack(">II", sample, n)),
        full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        full(b"co64" if wide else b"stco", struct.pack(f">I{len(starts)}{'Q' if wide else 'I'}", len(starts), *starts)),
    )
    dinf = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
    minf = box(b"minf", full(b"smhd", struct.pack(">HH", 0, 0)), dinf, stbl)
    long = duration >= 1 << 32
    times = struct.pack(">QQIQ" if long else ">IIII", 0, 0, rate, duration)
    mdia = box(
        b"mdia",
        full(b"mdhd", times, struct.pack(">HH", 0x55C4, 0), version=int(long)),
        full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"samples\0"),
        minf,
    )
    track = struct.pack(">QQIIQ" if long else ">IIIII", 0, 0, 1, 0, duration)
    trak = box(b"trak", full(b"tkhd", track, struct.pack(">8xhhhH", 0, 0, 0x100, 0), matrix, struct.pack(">II", 0, 0), version=int(long), flags=3), mdia)
    mvhd = full(b"mvhd", times, struct.pack(">IHxxxxxxxxxx", 0x10000, 0x100), matrix, bytes(24), struct.pack(">I", 2), version=int(long))
    mdat = struct.pack(">I4s", 8 + len(payload), b"mdat") if at == len(ftyp) + 8 else struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload))
    return b"".join((ftyp, mdat, payload, box(b"moov", mvhd, trak)))


def boxes(data, a: int = 0, b: int | None = None):
    """(path, first byte of the body, end) of every box in order, nested ones after their parents; bad sizes end a level, and boxes
    that lie deeper than ``DEEPEST`` are not entered."""
    open_ = [(a, len(data) if b is None else b, ())]
    while open_:
        a, b, path = open_.pop()
        if a + 8 > b:
            continue
        size, kind = struct.unpack_from(">I4s", data, a)
        head = 8
        if size == 1:
            if a + 16 > b:
                continue
            (size,) = struct.unpack_from(">Q", data, a + 8)
            head = 16
        elif size == 0:
            size = b - a
        if size < head or a + size > b:
            continue
        yield (*path, kind), a + head, a + size
        open_.append((a + size, b, path))
        if kind in CONTAINERS and len(path) < DEEPEST:
            open_.append((a + head + CONTAINERS[kind], a + size, (*path, kind)))


def _table(data, a: int, b: int, form: str) -> list[tuple]:
    """Rows of a counted table after version and flags; a count beyond the box is cut to it."""
    if b - a < 8:
        return []
    (n,) = struct.unpack_from(">I", data, a + 4)
    size = struct.calcsize(">" + form)
    return list(struct.iter_unpack(">" + form, bytes(data[a + 8 : a + 8 + min(n, (b - a - 8) // size) * size])))


def _sizes(view, a: int, b: int, compact: bool) -> tuple[int, np.ndarray | None, int]:
    """Of stsz or stz2: the size that all samples share (0: none), the sizes, and how many samples there are."""
    if b - a < 12:
        return 0, None, 0
    each, n = struct.unpack_from(">II", view, a + 4)
    if not compact:
        return (each, None, n) if each else (0, np.frombuffer(view, ">u4", min(n, (b - a - 12) // 4), a + 12).astype(np.int64), n)
    bits = each & 255
    if bits not in (4, 8, 16):
        return 0, None, 0
    if bits == 4:
        pair = np.frombuffer(view, np.uint8, min((n + 1) // 2, b - a - 12), a + 12)
        got = np.stack([pair >> 4, pair & 15], 1).ravel()[:n]
    else:
        got = np.frombuffer(view, ">u2" if bits == 16 else "u1", min(n, (b - a - 12) * 8 // bits), a + 12)
    return 0, got.astype(np.int64), n


def _sample_ranges(t: dict, end: int) -> np.ndarray:
    """(n, 2) byte ranges of the samples of a track's tables. Ranges beyond the file end the list, and no table can ask for more
    samples than bytes there are, whatever its counts say."""
    chunks = np.array(t["chunks"], np.int64)
    stsc = [(f, p) for f, p, _ in t["stsc"] if f >= 1]
    each, sizes, n = t["sizes"]
    if not len(chunks) or not stsc or not n:
        return np.zeros((0, 2), np.int64)
    per = np.zeros(len(chunks), np.int64)
    for i, (f, p) in enumerate(stsc):
        until = stsc[i + 1][0] - 1 if i + 1 < len(stsc) else len(chunks)
        per[f - 1 : max(until, f - 1)] = p
    most = min(n if sizes is None else len(sizes), end // each if each else len(sizes) if sizes is not None else 0)
    upto = np.minimum(np.cumsum(np.minimum(per, most)), most)
    per = np.diff(np.append(0, upto))
    total = int(upto[-1])
    size = np.full(total, each, np.int64) if sizes is None else sizes[:total]
    before = np.append(0, np.cumsum(size))
    at = np.cumsum(per) - per
    start = np.repeat(chunks, per) + before[:-1] - np.repeat(before[at], per)
    out = np.stack([start, start + size], 1)
    bad = np.flatnonzero((out[:, 1] > end) | (out[:, 0] < 0))
    return out[: bad[0]] if len(bad) else out


def read_tracks(data) -> list[dict]:
    """Per track: id, codec, timescale, duration (units of the timescale), sample byte ranges, keyframe byte ranges, decode and
    presentation times of the samples, and the edit list as (duration, media time).

    Only boxes and sample tables are read; ranges point into ``data``. Fragments (moof) add their samples to the track
    that they name. Counts that the file cannot hold are cut to what it holds.
    """
    tracks: list[dict] = []
    defaults: dict[int, dict] = {}
    view = memoryview(data)
    moof = 0
    run: dict = {}
    for path, a, b in boxes(view):
        kind = path[-1]
        if kind == b"moof":
            moof = a - 8 if struct.unpack_from(">I", view, a - 8)[0] != 1 else a - 16
        if kind == b"trak":
            tracks.append({"id": 0, "codec": None, "timescale": 0, "duration": 0, "stts": [], "ctts": [], "stss": None, "stsc": [], "chunks": [], "sizes": (0, None, 0), "edits": [], "more": []})
        if kind == b"trex" and b - a >= 24:
            number, _, duration, size, flags = struct.unpack_from(">IIIII", view, a + 4)
            defaults[number] = {"duration": duration, "size": size, "flags": flags}
        if b"traf" in path:
            if kind == b"tfhd" and b - a >= 8:
                run = _fragment_header(view, a, b, moof, defaults)
            elif kind == b"tfdt" and b - a >= 8:
                run["time"] = struct.unpack_from(">Q", view, a + 4)[0] if view[a] == 1 and b - a >= 12 else struct.unpack_from(">I", view, a + 4)[0]
            elif kind == b"trun" and b - a >= 8 and run:
                track = next((t for t in tracks if t["id"] == run["id"]), None)
                samples = _fragment_run(view, a, b, run, len(data))
                if track is not None:
                    track["more"].extend(samples)
            continue
        if not tracks or b"trak" not in path:
            continue
        t = tracks[-1]
        if kind == b"tkhd" and b - a >= 24:
            t["id"] = struct.unpack_from(">I", view, a + (20 if view[a] == 1 else 12))[0]
        elif kind == b"mdhd" and b - a >= 24:
            if view[a] == 1 and b - a >= 32:
                t["timescale"], t["duration"] = struct.unpack_from(">IQ", view, a + 20)
            else:
                t["timescale"], t["duration"] = struct.unpack_from(">II", view, a + 12)
        elif kind == b"stsd" and b - a >= 16:
            t["codec"] = bytes(view[a + 12 : a + 16]).decode("latin-1")
        elif kind == b"elst":
            t["edits"] = [(d, m) for d, m, _ in _table(view, a, b, "Qqi" if view[a : a + 1] == b"\1" else "Iii")]
        elif kind == b"stts":
            t["stts"] = _table(view, a, b, "II")
        elif kind == b"ctts":
            t["ctts"] = _table(view, a, b, "Ii" if view[a : a + 1] == b"\1" else "II")
        elif kind == b"stss":
            t["stss"] = [x for (x,) in _table(view, a, b, "I")]
        elif kind == b"stsc":
            t["stsc"] = _table(view, a, b, "III")
        elif kind in (b"stco", b"co64"):
            t["chunks"] = [min(x, 1 << 62) for (x,) in _table(view, a, b, "I" if kind == b"stco" else "Q")]
        elif kind in (b"stsz", b"stz2"):
            t["sizes"] = _sizes(view, a, b, kind == b"stz2")
    out = []
    for t in tracks:
        table = _sample_ranges(t, len(data))
        n = len(table)
        times = np.append(0, np.cumsum(_spread(t["stts"], n)))[:n]
        shown = times + _spread(t["ctts"], n)
        ranges = [(a, b) for a, b in table.tolist()] + [(a, b) for a, b, *_ in t["more"]]
        keys = list(range(1, n + 1)) if t["stss"] is None else [k for k in t["stss"] if 1 <= k <= n]
        keyframes = [ranges[k - 1] for k in keys] + [(a, b) for a, b, key, *_ in t["more"] if key]
        out.append({
            "id": t["id"], "codec": t["codec"], "timescale": t["timescale"], "duration": t["duration"] or sum(x[4] for x in t["more"]), "samples": ranges, "keyframes": keyframes,
            "decode_times": times.tolist() + [x[3] for x in t["more"]], "times": shown.tolist() + [x[3] + x[5] for x in t["more"]], "edits": t["edits"],
        })
    return out


def _spread(table: list[tuple], n: int) -> np.ndarray:
    """The values of a run-length table (count, value) for n samples; 0 beyond it."""
    if not table or not n:
        return np.zeros(n, np.int64)
    count, value = (np.array(x, np.int64) for x in zip(*table))
    count = np.diff(np.append(0, np.minimum(np.cumsum(np.minimum(count, n)), n)))
    got = np.repeat(value, count)
    return np.append(got, np.zeros(n - len(got), np.int64))


def _fragment_header(view, a: int, b: int, moof: int, defaults: dict[int, dict]) -> dict:
    """What a tfhd box says of the samples of its track in this fragment."""
    flags, number = struct.unpack_from(">I", view, a)[0] & 0xFFFFFF, struct.unpack_from(">I", view, a + 4)[0]
    out = {"id": number, "base": moof, "at": None, "time": 0, **defaults.get(number, {"duration": 0, "size": 0, "flags": 0})}
    at = a + 8
    for bit, name, form in ((1, "base", ">Q"), (2, None, ">I"), (8, "duration", ">I"), (16, "size", ">I"), (32, "flags", ">I")):
        if flags & bit and at + struct.calcsize(form) <= b:
            if name:
                out[name] = struct.unpack_from(form, view, at)[0]
            at += struct.calcsize(form)
    return out


def _fragment_run(view, a: int, b: int, run: dict, end: int) -> list[tuple]:
    """(start, end, keyframe, time, duration, offset) of the samples of a trun box; those beyond the file end the list."""
    flags, n = struct.unpack_from(">I", view, a)[0] & 0xFFFFFF, struct.unpack_from(">I", view, a + 4)[0]
    signed = view[a] == 1
    at, first = a + 8, None
    place = run["at"] if run["at"] is not None else run["base"]
    if flags & 1 and at + 4 <= b:
        place = run["base"] + struct.unpack_from(">i", view, at)[0]
        at += 4
    if flags & 4 and at + 4 <= b:
        first = struct.unpack_from(">I", view, at)[0]
        at += 4
    fields = [name for bit, name in ((0x100, "duration"), (0x200, "size"), (0x400, "flags"), (0x800, "offset")) if flags & bit]
    step = 4 * len(fields)
    n = min(n, (b - at) // step if step else end // run["size"] if run["size"] else 0)
    out = []
    for i in range(n):
        s = {"duration": run["duration"], "size": run["size"], "flags": first if first is not None and not i else run["flags"], "offset": 0}
        for k, name in enumerate(fields):
            s[name] = struct.unpack_from(">i" if name == "offset" and signed else ">I", view, at + i * step + 4 * k)[0]
        if place < 0 or place + s["size"] > end:
            break
        out.append((place, place + s["size"], not s["flags"] & 0x10000, run["time"], s["duration"], s["offset"]))
        place += s["size"]
        run["time"] += s["duration"]
    run["at"] = place
    return out


def read_payload(data, track: dict) -> bytes:
    """The samples' bytes in order; neighbouring ranges are read together."""
    view, out = memoryview(data), []
    at = end = None
    for a, b in track["samples"]:
        if a != end:
            if at is not None:
                out.append(view[at:end])
            at = a
        end = b
    if at is not None:
        out.append(view[at:end])
    return b"".join(out)


def padded(text: str | None, unit: int = SAMPLE) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + b" " * (max(unit, -(-len(raw) // unit) * unit) - len(raw)), len(raw)


MEDIA = "doc_id long, media binary, codec string, timescale long, duration long, n_samples long, keyframes array<struct<start:long,end:long>>"


def media_column(docs: DataFrame) -> DataFrame:
    """Store each text as an ISO media file and return it with codec, duration and keyframe byte ranges.

    Null text is empty; payloads are filled with spaces to a positive multiple of ``SAMPLE``. Rows are independent:
    repeated rows and null ids give repeated rows; an empty table gives none. Only doc_id and text are used.
    """

    def run(batches):
        for rb in batches:
            for i, text in zip(rb.column("doc_id").to_pylist(), rb.column("text")):  # one text at a time
                media = write_media(padded(text.as_py())[0])
                t = read_tracks(media)[0]
                yield pa.RecordBatch.from_pylist(
                    [{"doc_id": i, "media": media, "codec": t["codec"], "timescale": t["timescale"], "duration": t["duration"], "n_samples": len(t["samples"]), "keyframes": [{"start": a, "end": b} for a, b in t["keyframes"]]}],
                    schema=_MEDIA_ARROW,
                )

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, MEDIA)


_MEDIA_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("media", pa.binary()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("n_samples", pa.int64()),
    ("keyframes", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
])
DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digest(text: str | None) -> tuple:
    payload, n = padded(text)
    media = write_media(payload)
    track = read_tracks(media)[0]
    back = read_payload(media, track)
    keys = track["keyframes"]
    feature = f"{track['codec']}|{track['timescale']}|{track['duration']}|{len(track['samples'])}|{len(keys)}|{keys[0][0]}-{keys[-1][1]}|{sum(b - a for a, b in keys)}"
    return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature


def media_digest(docs: DataFrame) -> DataFrame:
    """Digests of what ``media_column`` stores, without returning the files. The same rules hold."""

    def run(batches):
        for rb in batches:
            rows = [_digest(t.as_py()) for t in rb.column("text")]
            cols = list(zip(*rows)) or [()] * 7
            names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([rb.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", *names])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, DIGEST)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
