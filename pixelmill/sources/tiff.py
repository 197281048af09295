"""TIFF files as a Spark data source that reads only the strips or tiles a query needs.

A task takes a share of one file's segments: it reads the directories of the file, leaves out segments beyond the query's bounds on ``page``,
``y``, ``x`` and ``ch``, and decodes the others one by one, so neither a file nor an image is ever held whole. Files may have strips or
tiles, samples next to each other or in planes, several pages, and offsets of 32 or 64 bits.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .images import unpack_lzw
from .shared import open_store, opens, store_path

SCHEMA = "img string, page int, y int, x int, ch int, b int, v double"
#: Numbers of the tags that are read, and bytes of their types.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS, STRIP_BYTES, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 339
FORMS = {1: "B", 3: "H", 4: "I", 16: "Q"}
KINDS = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}
#: Pixels that go out in one batch.
BATCH = 1 << 18


def unpack_bits(data: bytes) -> bytes:
    """Runs of bytes: a count below 128 and that many bytes and one more, or above 128 and one byte that repeats."""
    out, i = [], 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out.append(data[i + 1 : i + 2 + n])
            i += n + 2
        else:
            if n > 128:
                out.append(data[i + 1 : i + 2] * (257 - n))
            i += 2
    return b"".join(out)


UNPACK = {1: bytes, 5: unpack_lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: unpack_bits}


@dataclass
class Segment:
    """A strip or tile: where its bytes lie, the part of the page that it covers, its own width and first sample."""

    at: int
    size: int
    y: int
    x: int
    h: int
    w: int
    wide: int
    ch: int
    samples: int


class Page:
    def __init__(self, number: int, order: str, tags: dict[int, tuple]):
        one = lambda tag, default=None: (tags.get(tag) or (default,))[0]
        self.number, self.h, self.w, self.samples = number, one(HEIGHT), one(WIDTH), one(SAMPLES, 1)
        self.compression, self.predictor, planar = one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANAR, 1) == 2
        if self.compression not in UNPACK or self.predictor not in (1, 2) or (one(FORMAT, 1), one(BITS, 1)) not in KINDS:
            raise ValueError("a TIFF page of a kind that is not read")
        self.kind = np.dtype(order + KINDS[one(FORMAT, 1), one(BITS, 1)])
        tall, wide = (one(TILE_HEIGHT), one(TILE_WIDTH)) if TILES in tags else (min(one(ROWS, self.h), self.h), self.w)
        starts, sizes = (tags[TILES], tags[TILE_BYTES]) if TILES in tags else (tags[STRIPS], tags[STRIP_BYTES])
        places = [(ch, y, x) for ch in range(self.samples if planar else 1) for y in range(0, self.h, tall) for x in range(0, self.w, wide)]
        each = 1 if planar else self.samples
        self.segments = [Segment(a, n, y, x, min(tall, self.h - y), min(wide, self.w - x), wide, ch, each) for (ch, y, x), a, n in zip(places, starts, sizes)]

    def decode(self, s: Segment, data: bytes) -> np.ndarray:
        """(rows, columns, samples) of a segment inside the page."""
        raw = np.frombuffer(UNPACK[self.compression](data), self.kind, s.h * s.wide * s.samples)
        a = raw.reshape(s.h, s.wide, s.samples)
        return (np.cumsum(a, axis=1, dtype=a.dtype) if self.predictor == 2 else a)[:, : s.w]


def pages_of(read) -> Iterator[Page]:
    """The pages of a file, of which ``read(at, n)`` gives bytes; only its directories are read."""
    head = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack_from(order + "H", head, 2)[0] if order else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    big = version == 43
    at = struct.unpack_from(order + ("Q" if big else "I"), head, 8 if big else 4)[0]
    count, word = ("Q", "Q") if big else ("H", "I")
    step, field = struct.calcsize("=HH" + 2 * word), struct.calcsize("=" + word)
    number, seen = 0, set()
    while at and at not in seen:
        seen.add(at)
        n = struct.unpack(order + count, read(at, struct.calcsize("=" + count)))[0]
        body = read(at + struct.calcsize("=" + count), n * step + field)
        tags = {}
        for k in range(n):
            tag, kind, many = struct.unpack_from(order + "HH" + word, body, k * step)
            if kind not in FORMS or tag not in (WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS, STRIP_BYTES, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT):
                continue
            size = many * struct.calcsize("=" + FORMS[kind])
            value = body[k * step + 4 + field :][:size] if size <= field else read(struct.unpack_from(order + word, body, k * step + 4 + field)[0], size)
            tags[tag] = struct.unpack(f"{order}{many}{FORMS[kind]}", value)
        yield Page(number, order, tags)
        number += 1
        at = struct.unpack_from(order + word, body, n * step)[0]


@dataclass
class Share(InputPartition):
    """The ``part``-th of ``parts`` shares of a file's segments."""

    path: str
    part: int
    parts: int

    def __init__(self, path, part, parts):
        self.path, self.part, self.parts = path, part, parts


class TiffDataSource(DataSource):
    """Format ``tiff``. Options: ``path`` (a file or folder), ``split_bytes`` (bytes of a file to a task)."""

    @classmethod
    def name(cls):
        return "tiff"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return TiffReader(dict(self.options))


class TiffReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split_bytes", 32 << 20))
        self.bounds = {c: [-(1 << 31), (1 << 31) - 1] for c in ("page", "y", "x", "ch")}
        self.bytes = 0

    def pushFilters(self, filters):
        """Bounds narrow down what is read; Spark tests the rows again."""
        for f in filters:
            column, value = (f.attribute[0] if getattr(f, "attribute", None) else None), getattr(f, "value", None)
            values = [v for v in value if v is not None] if isinstance(f, In) else [value]
            if column in self.bounds and values and all(isinstance(v, (int, float)) for v in values):
                low, high = self.bounds[column]
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, In)):
                    low = max(low, min(values))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual, In)):
                    high = min(high, max(values))
                self.bounds[column] = [low, high]
            yield f

    def partitions(self):
        system, root = open_store(self.path)
        info = system.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and x.path.lower().endswith((".tif", ".tiff")))
        return [Share(p, k, n) for p, size in files for n in [max(1, -(-size // self.split))] for k in self._reached(system, p, n)] or [Share("", 0, 1)]

    def _reached(self, system, path: str, parts: int) -> list[int]:
        """The shares of a file in which a segment reaches the bounds, by the file's directories; all of them where nothing is bounded."""
        if parts == 1 or all(b == [-(1 << 31), (1 << 31) - 1] for b in self.bounds.values()):
            return list(range(parts))
        found = set()
        with system.open_input_file(path) as file:

            def read(at: int, n: int) -> bytes:
                file.seek(at)
                return file.read(n)

            for page in pages_of(read):
                if self._meets("page", page.number, page.number + 1):
                    found |= {((i + 1) * parts - 1) // len(page.segments) for i, s in enumerate(page.segments) if self._wants(s)}
        return sorted(found)

    def _wants(self, s: Segment) -> bool:
        return self._meets("y", s.y, s.y + s.h) and self._meets("x", s.x, s.x + s.w) and self._meets("ch", s.ch, s.ch + s.samples)

    def _meets(self, column: str, a: int, b: int) -> bool:
        """Do numbers from a to b - 1 reach the bounds?"""
        low, high = self.bounds[column]
        return a <= high and b - 1 >= low

    def read(self, partition):
        if not partition.path:
            return
        system, _ = open_store(self.path)
        with system.open_input_file(partition.path) as file:

            def read(at: int, n: int) -> bytes:
                file.seek(at)
                data = file.read(n)
                self.bytes += len(data)
                return data

            for page in pages_of(read):
                if not self._meets("page", page.number, page.number + 1):
                    continue
                n = len(page.segments)
                for s in page.segments[partition.part * n // partition.parts : (partition.part + 1) * n // partition.parts]:
                    if self._wants(s):
                        data = read(s.at, s.size)
                        if len(data) < s.size:
                            raise ValueError(f"{partition.path}: a segment ends early")
                        yield from self._batches(partition.path, page, s, page.decode(s, data))

    @staticmethod
    def _batches(path: str, page: Page, s: Segment, a: np.ndarray) -> Iterator[pa.RecordBatch]:
        step = max(1, BATCH // max(1, s.w * s.samples))
        for top in range(0, s.h, step):
            part = a[top : top + step]
            y, x, ch = (k.ravel().astype(np.int32) for k in np.indices(part.shape))
            flat = np.ascontiguousarray(part).ravel()
            v = flat / float(np.iinfo(flat.dtype).max) if flat.dtype.kind == "u" else flat.astype(float)
            b = np.clip(np.nan_to_num(flat.astype(float)), -(1 << 31), (1 << 31) - 1).astype(np.int32)
            n = len(flat)
            columns = [pa.array([path] * n), pa.array(np.full(n, page.number, np.int32)), pa.array(y + np.int32(s.y + top)), pa.array(x + np.int32(s.x)), pa.array(ch + np.int32(s.ch)), pa.array(b), pa.array(v)]
            yield pa.RecordBatch.from_arrays(columns, ["img", "page", "y", "x", "ch", "b", "v"])


def read_tiff(spark: SparkSession, path: str, split_bytes: int = 32 << 20) -> DataFrame:
    """(img, page, y, x, ch, b, v) of all TIFF files below ``path``, img being a file's path in its store. Conditions on page, y, x and ch
    reach the reader, which leaves out segments beyond them. Integers and floats of 8 to 64 bits; other kinds of pages are an error.

    In a store that ``pyarrow.fs`` does not reach, Spark reads whole files, one to a task, and leaves out rows only."""
    if not opens(store_path(spark, path)):

        def run(batches):
            for rb in batches:
                for name, content in zip(rb.column("path").to_pylist(), rb.column("content")):
                    data = content.as_py()
                    for page in pages_of(lambda at, n, data=data: data[at : at + n]):
                        for s in page.segments:
                            yield from TiffReader._batches(name, page, s, page.decode(s, data[s.at : s.at + s.size]))

        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{tif,tiff,TIF,TIFF}").load(path)
        return files.select("path", "content").mapInArrow(run, SCHEMA)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # the reader takes filters, so Spark wants it on
    spark.dataSource.register(TiffDataSource)
    return spark.read.format("tiff").option("path", store_path(spark, path)).option("split_bytes", str(split_bytes)).load()


def encode_pages(pages: list[np.ndarray], tile: tuple[int, int] | None = None, rows: int = 64, planar: bool = False, big: bool = False, order: str = "<", predictor: int = 1) -> bytes:
    """A DEFLATE-compressed file of pages (h, w) or (h, w, samples) in tiles of a size, or in strips of ``rows``."""
    word, count = ("Q", "Q") if big else ("I", "H")
    mark = {"<": b"II", ">": b"MM"}[order]
    head = mark + (struct.pack(order + "HHHQ", 43, 8, 0, 0) if big else struct.pack(order + "HI", 42, 0))
    out, link = bytearray(head), len(head) - struct.calcsize("=" + word)  # where the next directory's place is told
    for a in pages:
        a = a if a.ndim == 3 else a[..., None]
        a = a.astype(a.dtype.newbyteorder(order))
        h, w, samples = a.shape
        tall, wide = tile or (rows, w)
        starts, sizes = [], []
        for plane in [a[..., k : k + 1] for k in range(samples)] if planar else [a]:
            for y in range(0, h, tall):
                for x in range(0, w, wide):
                    part = plane[y : y + tall, x : x + wide]
                    if tile:
                        part = np.pad(part, ((0, tall - part.shape[0]), (0, wide - part.shape[1]), (0, 0)))
                    if predictor == 2:
                        part = np.concatenate([part[:, :1], np.diff(part, axis=1)], 1).astype(a.dtype)
                    data = zlib.compress(np.ascontiguousarray(part).tobytes(), 6)
                    starts.append(len(out))
                    sizes.append(len(data))
                    out += data
        number = 16 if big else 4
        entries = [(WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [8 * a.dtype.itemsize] * samples), (COMPRESSION, 3, [8]), (262, 3, [2 if samples == 3 else 1])]
        entries += [] if tile else [(STRIPS, number, starts)]
        entries += [(SAMPLES, 3, [samples])] + ([] if tile else [(ROWS, 4, [tall]), (STRIP_BYTES, number, sizes)])
        entries += [(PLANAR, 3, [2 if planar else 1]), (PREDICTOR, 3, [predictor])]
        entries += [(TILE_WIDTH, 4, [wide]), (TILE_HEIGHT, 4, [tall]), (TILES, number, starts), (TILE_BYTES, number, sizes)] if tile else []
        entries.append((FORMAT, 3, [{"u": 1, "i": 2, "f": 3}[a.dtype.kind]] * samples))
        body = b""
        for tag, kind, values in entries:
            value = struct.pack(f"{order}{len(values)}{FORMS[kind]}", *values)
            if len(value) > struct.calcsize("=" + word):
                place = len(out)
                out += value
                value = struct.pack(order + word, place)
            body += struct.pack(order + "HH" + word, tag, kind, len(values)) + value.ljust(struct.calcsize("=" + word), b"\0")
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + word, out, link, len(out))
        out += struct.pack(order + count, len(entries)) + body
        link = len(out)
        out += struct.pack(order + word, 0)
    return bytes(out)
