"""Image files as pixel relations: PNG and TIFF by own codecs, JPEG by Spark's image source, NumPy arrays.

Decoders run on executors over Spark's ``binaryFile`` source, so paths may be in any store Spark reads.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import children, move, open_store, opens, remove, store_path

PX = "img string, y int, x int, ch int, b int, v double"


def narrowest(a: np.ndarray) -> np.ndarray:
    """Whole numbers in the narrowest kind that holds them all, bytes first; floats lose their fractions, nothing else is cut."""
    a = a if a.dtype.kind in "iub" else np.nan_to_num(a).astype(np.int64)
    low, high = (int(a.min()), int(a.max())) if a.size else (0, 0)
    return a.astype(next(k for k in (np.uint8, np.uint16, np.int32, np.uint32, np.int64, np.uint64) if np.iinfo(k).min <= low and high <= np.iinfo(k).max))


def encode_png(a: np.ndarray) -> bytes:
    """A grey (h, w) or colour (h, w, 3) image, in 8 bits, or in 16 where values exceed 255. Beyond 65535 or below 0 is an error: the format ends there."""
    a = narrowest(a)
    if a.dtype.itemsize > 2:
        raise ValueError("PNG files hold whole numbers from 0 to 65535")
    h, w = a.shape[:2]
    rows = np.hstack([np.zeros((h, 1), np.uint8), np.ascontiguousarray(a.astype(a.dtype.newbyteorder(">"))).reshape(h, -1).view(np.uint8)])
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", w, h, 8 * a.dtype.itemsize, 2 if a.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """Grey, colour or palette images of 1 to 16 bits, interlaced or not; alpha is dropped, 16 bits stay, grey values of fewer than 8
    are spread over 0..255."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, body, palette, head = 8, [], None, None
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + n
    w, h, depth, colour, _, _, interlaced = head
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    raw, out = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8), np.zeros((h, w, channels), np.uint16 if depth == 16 else np.uint8)
    at = 0
    for y0, x0, dy, dx in _PASSES if interlaced else ((0, 0, 1, 1),):
        ph, pw = -(-(h - y0) // dy), -(-(w - x0) // dx)
        if ph > 0 and pw > 0:
            plane, at = _png_pass(raw, at, ph, pw, channels, depth)
            out[y0::dy, x0::dx] = plane
    if palette is not None and colour == 3:
        return palette[out[..., 0]]
    if depth < 8:
        out = out * np.uint8(255 // (2**depth - 1))
    if colour in (4, 6):
        out = out[..., :-1]
    return out[..., 0] if out.shape[2] == 1 else out


#: First row and column, and steps, of the passes of interlaced images.
_PASSES = ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1))


def _png_pass(raw: np.ndarray, at: int, h: int, w: int, channels: int, depth: int) -> tuple[np.ndarray, int]:
    """(h, w, channels) of a pass that begins at a byte, and where the next one begins."""
    step, n = max(1, channels * depth // 8), -(-w * channels * depth // 8)
    rows = raw[at : at + h * (n + 1)].reshape(h, n + 1)
    out, above = np.zeros((h, n), np.uint8), np.zeros(n, np.uint8)
    if (rows[:, 0] > 2).any():
        out = _unfilter_rows(rows[:, 0], rows[:, 1:], above, step)
    else:
        for y in range(h):
            out[y] = above = _unfilter(int(rows[y, 0]), rows[y, 1:], above, step)
    if depth < 8:
        bits = np.unpackbits(out, axis=1).reshape(h, -1, depth)[:, : w * channels]
        out = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(2).astype(np.uint8)
    elif depth == 16:
        out = out.view(">u2").astype(np.uint16)
    return out.reshape(h, w, channels), at + h * (n + 1)


def _unfilter(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return row.copy()
    if kind == 2:
        return row + above
    if kind == 1:
        return np.cumsum(row.reshape(-1, step).astype(np.uint64), axis=0).astype(np.uint8).ravel()
    return _unfilter_rows(np.array([kind]), row[None], above, step)[0]


def _unfilter_rows(kinds: np.ndarray, rows: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """All rows of a pass together: a pixel needs those to its left, above and between, so the pixels of an anti-diagonal are
    decoded at once, whatever the filters of their rows."""
    if kinds.max(initial=0) > 4:
        raise ValueError("damaged PNG file")
    h, w = rows.shape[0], rows.shape[1] // step
    raw = rows.reshape(h, w, step)
    out = np.zeros((h + 1, w + 1, step), np.int16)  # a row above, and a column to the left
    out[0, 1:] = above.reshape(w, step)
    for d in range(h + w - 1):
        y = np.arange(max(0, d - w + 1), min(h, d + 1))
        x = d - y
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        a, b, c = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
        nearest = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        guess = np.choose(kinds[y][:, None], (np.zeros_like(left), left, up, (left + up) >> 1, nearest))
        out[y + 1, x + 1] = (raw[y, x] + guess) & 255
    return out[1:, 1:].astype(np.uint8).reshape(h, w * step)


def encode_tiff(a: np.ndarray) -> bytes:
    """One DEFLATE-compressed strip; floats of 32 or 64 bits stay, all else becomes whole numbers of 8 bits, or of 16 or 32 where
    values need them. Beyond 32 bits is an error."""
    a = np.ascontiguousarray(a if a.dtype in (np.float32, np.float64) else narrowest(a))
    if a.dtype.kind != "f" and a.dtype.itemsize > 4:
        raise ValueError("TIFF files hold whole numbers of up to 32 bits here")
    h, w = a.shape[:2]
    samples, bits = 1 if a.ndim == 2 else a.shape[2], 8 * a.dtype.itemsize
    strip = zlib.compress(a.tobytes(), 6)
    entries = [(256, 4, w), (257, 4, h), (258, 3, bits), (259, 3, 8), (262, 3, 2 if samples == 3 else 1), (273, 4, 8), (277, 3, samples), (278, 4, h), (279, 4, len(strip)), (339, 3, {"u": 1, "i": 2, "f": 3}[a.dtype.kind])]
    pad = len(strip) % 2
    directory = struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII" if t == 4 else "<HHIHxx", tag, t, 1, v) for tag, t, v in entries) + struct.pack("<I", 0)
    return b"II*\0" + struct.pack("<I", 8 + len(strip) + pad) + strip + b"\0" * pad + directory


def unpack_lzw(data: bytes) -> bytes:
    """A TIFF strip packed by LZW: codes of 9 to 12 bits, most significant bit first."""
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    table, out, width, held, bits, last = list(first), [], 9, 0, 0, None
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = list(first), 9, None
            continue
        if last is None:
            entry = table[code]
        else:
            if code > len(table):
                raise ValueError("damaged LZW strip")
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
        out.append(entry)
        last = entry
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return b"".join(out)


_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 16: 8}


def decode_tiff(data: bytes) -> np.ndarray:
    """The first image: 8-, 16- or 32-bit integers or floats in strips, plain, DEFLATE- or LZW-compressed, with differences of
    neighbours (predictor 2) or without."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack_from(order + "I", data, 4)[0]
    tags: dict[int, list[int]] = {}
    for k in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        form = {1: "B", 3: "H", 4: "I", 16: "Q"}.get(kind)
        if form:
            where = at + 2 + 12 * k + 8
            if n * _SIZES[kind] > 4:
                where = struct.unpack_from(order + "I", data, where)[0]
            tags[tag] = list(struct.unpack_from(f"{order}{n}{form}", data, where))
    w, h, compression = tags[256][0], tags[257][0], tags.get(259, [1])[0]
    predictor = tags.get(317, [1])[0]
    if compression not in (1, 5, 8, 32946) or 322 in tags or predictor not in (1, 2):
        raise ValueError("TIFF files in strips, plain, DEFLATE- or LZW-compressed, can be read")
    samples, bits = tags.get(277, [1])[0], tags.get(258, [1])[0]
    if samples > 1 and tags.get(284, [1])[0] != 1:
        raise ValueError("TIFF files with their samples next to each other can be read")
    kind = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}[tags.get(339, [1])[0], bits]
    unpack = {1: bytes, 5: unpack_lzw}.get(compression, zlib.decompress)
    raw = b"".join(unpack(data[o : o + n]) for o, n in zip(tags[273], tags[279]))
    a = np.frombuffer(raw, order + kind, h * w * samples).reshape(h, w, samples)
    if predictor == 2:
        a = np.cumsum(a, axis=1, dtype=a.dtype)
    return a[..., 0] if samples == 1 else a


def decode(data: bytes, name: str) -> np.ndarray:
    ext = name.rpartition(".")[2].lower()
    if ext == "png":
        return decode_png(data)
    if ext in ("tif", "tiff"):
        return decode_tiff(data)
    if ext == "npy":
        return np.load(io.BytesIO(data), allow_pickle=False)
    if ext == "npz":
        with np.load(io.BytesIO(data), allow_pickle=False) as z:
            return z[z.files[0]]
    raise ValueError(f"cannot read .{ext} images")


def _rows(path: str, a: np.ndarray) -> pa.RecordBatch:
    """``b``: the value cut to a whole number; ``v``: unsigned values as a share of their greatest, others as they are."""
    a = a if a.ndim == 3 else a[..., None]
    h, w, c = a.shape
    y, x, ch = (k.ravel().astype(np.int32) for k in np.indices((h, w, c)))
    flat = np.ascontiguousarray(a).ravel()
    v = flat / float(np.iinfo(flat.dtype).max) if flat.dtype.kind == "u" else flat.astype(float)
    b = np.clip(np.nan_to_num(flat.astype(float)), -(1 << 31), (1 << 31) - 1).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array([path] * flat.size), pa.array(y), pa.array(x), pa.array(ch), pa.array(b), pa.array(v)], ["img", "y", "x", "ch", "b", "v"])


def pixels_of(files: DataFrame) -> DataFrame:
    """(img, y, x, ch, b, v) from (path, content)."""

    def run(batches):
        for rb in batches:
            for path, content in zip(rb.column("path").to_pylist(), rb.column("content")):
                yield _rows(path, decode(content.as_py(), path))

    return files.select("path", "content").mapInArrow(run, PX)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """All PNG, TIFF, NPY and NPZ files below ``path``, and JPEG files by Spark's image source, as pixels.

    A missing path is an error, as are other kinds of files.
    """
    if path.lower().endswith((".jpg", ".jpeg")):
        i = spark.read.format("image").load(path).select(F.col("image.origin").alias("img"), "image.height", "image.width", "image.nChannels", "image.data")

        def run(batches):
            for rb in batches:
                for name, h, w, c, data in zip(*(col.to_pylist() for col in rb.columns)):
                    yield _rows(name, np.frombuffer(data, np.uint8).reshape(h, w, c)[..., :3][..., ::-1])  # stored blue first

        return i.mapInArrow(run, PX)
    return pixels_of(spark.read.format("binaryFile").load(path))


def encode_npy(a: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, a)
    return out.getvalue()


def encode_npz(a: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, a)
    return out.getvalue()


def image_files(px: DataFrame, value: str = "b", kind: str = "png", encoder: Callable[[np.ndarray], bytes] | None = None) -> DataFrame:
    """(path, content): a file for each image of (img, y, x, value), whole images in one task each. Floats stay but in PNG files; the
    encoder gets whole numbers as bytes, or as a wider kind where an image's values exceed 255."""
    encoder = encoder or {"png": encode_png, "tif": encode_tiff, "npy": encode_npy}[kind]

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        y, x = (t.column(c).to_numpy() for c in ("y", "x"))
        v = t.column(value)
        v = (v.fill_null(0) if pa.types.is_integer(v.type) else v).to_numpy()
        v = v if v.dtype.kind == "f" and kind != "png" else narrowest(v)
        a = np.zeros((int(y.max()) + 1, int(x.max()) + 1), v.dtype)
        a[y, x] = v
        return pa.table({"path": [f"{key[0].as_py()}.{kind}"], "content": pa.array([encoder(a)], pa.binary())})

    return px.select("img", "y", "x", value).groupBy("img").applyInArrow(run, "path string, content binary")


def write_images(px: DataFrame, path: str, value: str = "b", kind: str = "png", encoder: Callable[[np.ndarray], bytes] | None = None) -> None:
    """Write a file for each image into the folder ``path``, from the executors."""
    _put(image_files(px, value, kind, encoder), path)


def _put(files: DataFrame, path: str) -> None:
    """Write (path, content) rows as files of one folder, from the executors: with ``pyarrow.fs``, or where that does not reach, as Spark's
    text files, which end in a line break that no decoder here reads, renamed at the end."""
    if not opens(store_path(files.sparkSession, path)):
        spark, made = files.sparkSession, f"{path}/_files-{uuid.uuid4().hex[:12]}"
        files.select(F.col("content").cast("string").alias("value"), F.col("path").alias("name")).write.option("lineSep", "\n").partitionBy("name").text(made)
        for folder in children(spark, made):
            if folder.startswith("name="):
                for part in children(spark, f"{made}/{folder}"):
                    move(spark, f"{made}/{folder}/{part}", f"{path}/{unquote(folder[5:])}")
        remove(spark, made)
        return

    def run(batches):
        system, root = open_store(path)
        system.create_dir(root, recursive=True)
        for rb in batches:
            for name, content in zip(rb.column("path").to_pylist(), rb.column("content").to_pylist()):
                with system.open_output_stream(f"{root}/{name}") as f:
                    f.write(content)
            yield rb.select(["path"])

    files.mapInArrow(run, "path string").count()


#: Bytes of an array file to a task, and pixels that are read or written together.
BAND, BATCH = 32 << 20, 1 << 18
#: What stacks of features can be kept as.
STACKS = {"npy": encode_npy, "npz": encode_npz, "tif": encode_tiff}


def save_features(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """A feature stack (img, y, x, features): Parquet, a folder for each image; or ``kind`` npy, npz or tif, a file
    <img>.<kind> of (height, width, features) floats for each image, which is one task each. Other kinds are an error."""
    if kind == "parquet":
        df.withColumn("img_folder", F.col("img")).write.mode("overwrite").partitionBy("img_folder").parquet(path)
        return
    if kind not in STACKS:
        raise ValueError(f"feature stacks can be kept as parquet, {', '.join(STACKS)}")
    names = [c for c in df.columns if c not in ("img", "y", "x")]

    number = np.float32 if {t for c, t in df.dtypes if c in names} == {"float"} else float
    named = kind == "npy" and opens(store_path(df.sparkSession, path))

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, h, w = np.zeros((0, 0, len(names)), number), 0, 0
        for rb in batches:
            if not rb.num_rows:
                continue
            y, x = rb.column("y").to_numpy(), rb.column("x").to_numpy()
            h, w = max(h, int(y.max()) + 1), max(w, int(x.max()) + 1)
            if h > a.shape[0] or w > a.shape[1]:  # sides double, so little is copied
                wider = np.zeros((*(n if n <= m else max(n, 2 * m) for n, m in zip((h, w), a.shape)), len(names)), number)
                wider[: a.shape[0], : a.shape[1]] = a
                a = wider
            for k, n in enumerate(names):
                a[y, x, k] = rb.column(n).to_numpy(zero_copy_only=False)
        name, a = f"{key[0].as_py()}.{kind}", a[:h, :w]
        if named:
            _write_npy(path, name, a)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([None if named else STACKS[kind](a)], pa.binary())], ["path", "content"])

    files = df.groupBy("img").applyInArrow(run, "path string, content binary")
    if named:
        files.count()
    else:
        _put(files, path)


def _write_npy(path: str, name: str, a: np.ndarray) -> None:
    """An array file, written in bands of rows."""
    system, root = open_store(path)
    system.create_dir(root, recursive=True)
    head, step = io.BytesIO(), max(1, BATCH // max(1, a.shape[1]))
    np.lib.format.write_array_header_1_0(head, {"descr": a.dtype.str, "fortran_order": False, "shape": a.shape})
    with system.open_output_stream(f"{root}/{name}") as f:
        f.write(head.getvalue())
        for top in range(0, a.shape[0], step):
            f.write(np.ascontiguousarray(a[top : top + step]).tobytes())


def _npy_bands(path: str, part: int, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, rows) of a share of an array file, which is read in bands where its rows lie one after the other."""
    system, root = open_store(path)
    with system.open_input_file(root) as f:
        version = np.lib.format.read_magic(f)
        head = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}.get(version)
        shape, fortran, kind = head(f) if head else ((), True, np.dtype(float))
        if fortran or kind.hasobject or len(shape) not in (2, 3):
            f.seek(0)
            if part == 0:
                yield 0, _stack(f.read(), path)
            return
        h, w, n = (*shape, 1)[:3]
        at, step = f.tell(), max(1, BATCH // max(1, w))
        for top in range(part * h // parts, end := (part + 1) * h // parts, step):
            rows = min(step, end - top)
            f.seek(at + top * w * n * kind.itemsize)
            yield top, np.frombuffer(f.read(rows * w * n * kind.itemsize), kind).reshape(rows, w, n)


def load_features(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """What ``save_features`` wrote, or any (height, width, features) arrays: ``path`` is a Parquet folder, or npy, npz or tif files
    (a pattern is allowed). Arrays do not tell names: their features are ``names``, or f0, f1 and so on."""
    ext = path.rpartition(".")[2].lower()
    if ext not in (*STACKS, "tiff"):
        return spark.read.parquet(path).drop("img_folder")
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)\.\w+$", 1).alias("img"), "path", "content")
    if names is None:  # of the first file: all stacks have the same features
        first = files.limit(1).mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [_stack(c.as_py(), p).shape[2] for p, c in zip(rb.column("path").to_pylist(), rb.column("content"))]}) for rb in bs), "n long").first()
        names = [f"f{k}" for k in range(first[0] if first else 0)]

    def rows_of(img: str, p: str, first: int, a: np.ndarray) -> Iterator[pa.RecordBatch]:
        if a.shape[2] != len(names):
            raise ValueError(f"{p} has {a.shape[2]} features, not {len(names)}")
        step = max(1, BATCH // max(1, a.shape[1]))
        for top in range(0, a.shape[0], step):
            part = a[top : top + step]
            y, x = (k.ravel().astype(np.int32) for k in np.indices(part.shape[:2]))
            cols = [pa.array(np.ascontiguousarray(part[..., k]).ravel().astype(float)) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([pa.array([img] * len(y)), pa.array(y + np.int32(first + top)), pa.array(x), *cols], ["img", "y", "x", *names])

    def run(batches):
        for rb in batches:
            for img, p, content in zip(rb.column("img").to_pylist(), rb.column("path").to_pylist(), rb.column("content")):
                yield from rows_of(img, p, 0, _stack(content.as_py(), p))

    def run_bands(batches):
        for rb in batches:
            for img, p, part, parts in zip(*(rb.column(c).to_pylist() for c in ("img", "path", "part", "parts"))):
                for first, a in _npy_bands(p, part, parts):
                    yield from rows_of(img, p, first, a)

    schema = "img string, y int, x int, " + ", ".join(f"`{n}` double" for n in names)
    if ext == "npy" and opens(path):  # rows of an array lie one after the other, so its bands are read by many tasks
        shares = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)\.\w+$", 1).alias("img"), "path", F.ceil(F.col("length") / BAND).cast("int").alias("parts"))
        shares = shares.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        return shares.repartition(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "part").mapInArrow(run_bands, schema)
    return files.mapInArrow(run, schema)


def _stack(data: bytes, path: str) -> np.ndarray:
    a = decode(data, path)
    return a if a.ndim == 3 else a[..., None]
