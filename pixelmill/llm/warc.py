"""WARC archives as a Spark data source, and a writer that stores equal payloads once.

Reading plans partitions of runs of files and of byte ranges of large ones, parses the headers of a record first, and passes
over the payload unless the record is wanted. Conditions on ``record_type`` and header columns are taken from
the query (``read_warc`` turns on ``spark.sql.python.filterPushdown.enabled``) or from options.

The writer puts an index beside every archive: where each record lies, and its headers. With it a reader seeks to the records
that are wanted and touches no other byte. Without one, plain archives are sought through by record lengths; of compressed
ones the unwanted payloads must be inflated to find their ends, but are not kept.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import uuid
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from .scratch import Scratch, result

SCHEMA = (
    "record_id string, record_type string, target_uri string, refers_to string, date string, content_type string, "
    "declared_digest string, payload_length long, payload_sha1 string, headers map<string,string>, payload binary, path string, offset long"
)
#: Columns that come from headers, and can be tested before the payload is read.
HEADER_OF = {
    "record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to",
    "date": "warc-date", "content_type": "content-type", "declared_digest": "warc-payload-digest",
}
#: A manifest of each write lists its archives; the index of an archive has one more ending.
MANIFEST, INDEX = "_manifest-", ".index.gz"
OWN = re.compile(r"/part-[0-9a-f]{12}-\d{6}-\d+-\d{4}\.warc(\.gz)?$")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _open_fs(path: str):
    """The store of a path; Hadoop's names of object stores are known too."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))
    return fs.LocalFileSystem(), path


@dataclass
class FilePartition(InputPartition):
    """Stretches of archives: (path, first byte, end, whether there is an index). Records belong where they start."""

    files: list

    def __init__(self, files):
        self.files = files


@dataclass
class Committed(WriterCommitMessage):
    files: list = field(default_factory=list)


class WarcDataSource(DataSource):
    """Format ``warc``.

    Options: ``path``; reading: ``payload`` (true: return payloads), ``digest`` (true: SHA-1 of payloads), ``types``
    (comma-separated record types), ``split_bytes``, ``damaged`` (raise: an error; stop: the records before the damage of an
    archive are returned), ``unlisted`` (archives of others in a folder with manifests that list none of them: raise, read or skip); writing: ``compress`` (true: a gzip member per record), ``file_bytes``. Mode append adds archives,
    overwrite replaces those that earlier writes listed.
    """

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options), overwrite)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.digest = str(options.get("digest", "false")).lower() == "true"
        self.split = int(options.get("split_bytes", 32 << 20))
        self.damaged = options.get("damaged", "raise")
        if self.damaged not in ("raise", "stop"):
            raise ValueError(f"damaged is raise or stop, not {self.damaged}")
        self.unlisted = options.get("unlisted", "raise")
        if self.unlisted not in ("raise", "read", "skip"):
            raise ValueError(f"unlisted is raise, read or skip, not {self.unlisted}")
        self.wanted: list[tuple[str, frozenset]] = []
        if options.get("types"):
            self.wanted.append(("warc-type", frozenset(x.strip() for x in options["types"].split(","))))

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) else None
            if isinstance(f, EqualTo) and column in HEADER_OF:
                self.wanted.append((HEADER_OF[column], frozenset([f.value]) - {None}))  # no header equals null
            elif isinstance(f, In) and column in HEADER_OF:
                self.wanted.append((HEADER_OF[column], frozenset(f.value) - {None}))
            else:
                yield f

    def _archives(self, system, root) -> list[tuple[str, int, bool]]:
        """(path, size, has an index) of all archives: those that manifests list, and in folders without one all there are."""
        info = system.get_file_info(root)
        if info.type == fs.FileType.File:
            return [(info.path, info.size, False)]
        listed = {x.path: x.size for x in system.get_file_info(fs.FileSelector(root, recursive=True)) if x.type == fs.FileType.File}
        manifests, replaced = {}, set()
        for p in listed:
            folder, _, name = p.rpartition("/")
            if name.startswith(MANIFEST):
                with system.open_input_stream(p) as f:
                    manifests[p] = json.loads(f.read())
                replaced |= {f"{folder}/{n}" for n in manifests[p]["replaces"]}
        folders = {p.rpartition("/")[0] for p in manifests}
        found = [(f"{p.rpartition('/')[0]}/{name}", size, True) for p, m in manifests.items() if p not in replaced for name, size in m["files"]]
        written = {f"{p.rpartition('/')[0]}/{name}" for p, m in manifests.items() for name, _ in m["files"]}
        others = {p: n for p, n in listed.items() if re.search(r"\.warc(\.gz)?$", p) and p not in written}
        # what the writer named and never listed was left by attempts that were not committed
        strange = sorted(p for p in others if p.rpartition("/")[0] in folders and not OWN.search(p))
        if strange and self.unlisted == "raise":
            raise ValueError(f"archives that no manifest lists, such as {strange[0]}; the option unlisted says read or skip")
        return sorted(found + [(p, n, p + INDEX in listed) for p, n in others.items() if p.rpartition("/")[0] not in folders or (self.unlisted == "read" and p in strange)])

    def partitions(self):
        system, root = _open_fs(self.path)
        parts, run, held = [], [], 0
        for path, size, indexed in self._archives(system, root):
            step = self.split if indexed else max(size, 1)
            for at in range(0, size, step):
                n = min(step, size - at)
                if run and held + n > self.split:
                    parts.append(FilePartition(run))
                    run, held = [], 0
                run.append((path, at, at + n, indexed))
                held += n
        if run:
            parts.append(FilePartition(run))
        return parts or [FilePartition([])]

    def read(self, partition):
        system, _ = _open_fs(self.path)
        rows, held = [], 0
        for path, a, b, indexed in partition.files:
            try:
                for row, size in self._indexed(system, path, a, b) if indexed else self._scanned(system, path):
                    rows.append(row)
                    held += size
                    if len(rows) >= 4096 or held >= 8 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
            except (ValueError, EOFError, OSError, zlib.error) as broken:
                if self.damaged == "raise":
                    raise ValueError(f"{path}: damaged archive ({broken})") from broken
        if rows:
            yield _batch(rows)

    def _scanned(self, system, path):
        if path.endswith(".gz"):
            with system.open_input_stream(path, compression=None) as raw:
                yield from self._records(gzip.GzipFile(fileobj=raw), path)
        else:
            with system.open_input_file(path) as raw:
                yield from self._records(raw, path)

    def _indexed(self, system, path, a, b):
        """Only the bytes of wanted records that start in [a, b) are read, neighbours together."""
        with system.open_input_stream(path + INDEX, compression=None) as f:
            index = [json.loads(line) for line in gzip.decompress(f.read()).splitlines()]
        wanted = [(at, n) for at, n, headers in index if a <= at < b and self._wants(headers)]
        with system.open_input_file(path) as raw:
            i = 0
            while i < len(wanted):
                j, end = i, wanted[i][0]
                while j < len(wanted) and wanted[j][0] == end and (j == i or end + wanted[j][1] - wanted[i][0] <= 4 << 20):
                    end += wanted[j][1]
                    j += 1
                raw.seek(wanted[i][0])
                data = raw.read(end - wanted[i][0])
                for at, n in wanted[i:j]:
                    part = data[at - wanted[i][0] : at - wanted[i][0] + n]
                    if len(part) < n:
                        raise ValueError("a record ends early")
                    member = gzip.decompress(part) if path.endswith(".gz") else part
                    yield from self._records(io.BytesIO(member), path, at)
                i = j

    def _wants(self, headers: dict) -> bool:
        return all(headers.get(h) in values for h, values in self.wanted)

    def _records(self, stream, path, base: int = 0):
        source = _Lines(stream)
        while True:
            at = base + source.at
            line = source.line()
            if line is None:
                return
            if not line.startswith(b"WARC/"):
                if line.strip():
                    raise ValueError(f"{path}: no WARC record at byte {at}")
                continue
            headers = _headers(source)
            length = int(headers.get("content-length", "0"))
            if not self._wants(headers):
                source.skip(length)
                continue
            http = headers.get("content-type", "").startswith("application/http")
            block_at, size = source.at, None
            if http:
                source.line()
                inner = _headers(source)
                size = int(inner["content-length"]) if inner.get("content-length", "").isdigit() else None
            left = length - (source.at - block_at)
            payload = digest = None
            if headers.get("warc-type") == "revisit":
                source.skip(left)
            elif self.payload or self.digest:
                payload = source.take(left)
                size = len(payload)
                digest = base32_sha1(payload) if self.digest else None
            else:
                source.skip(left)
                size = left
            declared = headers.get("warc-payload-digest")
            yield (
                headers.get("warc-record-id"), headers.get("warc-type"), headers.get("warc-target-uri"), headers.get("warc-refers-to"), headers.get("warc-date"), headers.get("content-type"),
                declared, size, digest, list(headers.items()), payload if self.payload else None, path, at,
            ), (size or 0) if self.payload else 256


class _Lines:
    """Buffered reading by lines and lengths; counts bytes."""

    def __init__(self, stream, block: int = 1 << 18):
        self.stream, self.block, self.buffer, self.pos, self.at = stream, block, b"", 0, 0

    def _more(self) -> bool:
        new = getattr(self.stream, "read1", self.stream.read)(self.block)  # of a compressed file what comes before damage
        if not new:
            return False
        self.buffer = self.buffer[self.pos :] + bytes(new)
        self.pos = 0
        return True

    def line(self):
        while (end := self.buffer.find(b"\n", self.pos)) < 0:
            if not self._more():
                rest = self.buffer[self.pos :]
                self.pos = len(self.buffer)
                self.at += len(rest)
                return rest or None
        out = self.buffer[self.pos : end + 1]
        self.pos = end + 1
        self.at += len(out)
        return out

    def take(self, n: int) -> bytes:
        parts, need = [], n
        while need > 0:
            have = self.buffer[self.pos : self.pos + need]
            if have:
                parts.append(have)
                self.pos += len(have)
                need -= len(have)
            elif not self._more():
                raise ValueError("a record ends early")
        self.at += n
        return b"".join(parts)

    def skip(self, n: int) -> None:
        need = n
        if isinstance(self.stream, pa.NativeFile) and n > len(self.buffer) - self.pos:  # a plain archive: seek
            to = self.stream.tell() + n - (len(self.buffer) - self.pos)
            if to > self.stream.size():
                raise ValueError("a record ends early")
            self.stream.seek(to)
            self.buffer, self.pos, need = b"", 0, 0
        while need > 0:
            step = min(need, len(self.buffer) - self.pos)
            if step:
                self.pos += step
                need -= step
            elif not self._more():
                raise ValueError("a record ends early")
        self.at += n


def _headers(source: _Lines) -> dict[str, str]:
    out, last = {}, None
    while (line := source.line()) is not None:
        text = line.rstrip(b"\r\n").decode("utf-8", "replace")
        if not text:
            break
        if text[0] in " \t" and last:  # a folded header
            out[last] += " " + text.strip()
            continue
        name, _, value = text.partition(":")
        last = name.strip().lower()
        out[last] = value.strip()
    return out


_ARROW = pa.schema([
    *((c, pa.string()) for c in ("record_id", "record_type", "target_uri", "refers_to", "date", "content_type", "declared_digest")),
    ("payload_length", pa.int64()), ("payload_sha1", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("path", pa.string()), ("offset", pa.int64()),
])


def _batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


class WarcWriter(DataSourceArrowWriter):
    """Writes rows with record_id, record_type, target_uri, refers_to, payload, payload_length, declared_digest."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex[:12]
        self.compress = str(options.get("compress", "true")).lower() == "true"
        self.most = int(options.get("file_bytes", 32 << 20))

    def write(self, iterator):
        from pyspark import TaskContext

        task = TaskContext.get()
        system, root = _open_fs(self.path)
        system.create_dir(root, recursive=True)
        stem = f"part-{self.job}-{task.partitionId():06d}-{task.taskAttemptId()}"
        done, out, index, size = [], None, [], 0

        def close():
            out.close()
            with system.open_output_stream(f"{root}/{done[-1][0]}{INDEX}", compression=None) as f:
                f.write(gzip.compress("\n".join(index).encode(), 6, mtime=0))
            done[-1] = (done[-1][0], size)

        for rb in iterator:
            for row in (row for i in range(0, rb.num_rows, 128) for row in rb.slice(i, 128).to_pylist()):
                record, headers = _record(row)
                if self.compress:
                    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                    record = packer.compress(record) + packer.flush()
                if out is None:
                    done.append((f"{stem}-{len(done):04d}.warc" + (".gz" if self.compress else ""), 0))
                    out, index, size = system.open_output_stream(f"{root}/{done[-1][0]}", compression=None), [], 0
                out.write(record)
                index.append(json.dumps([size, len(record), headers], ensure_ascii=False))
                size += len(record)
                if size >= self.most:
                    close()
                    out = None
        if out is not None:
            close()
        return Committed(done)

    def commit(self, messages):
        """A manifest of this write beside those of earlier ones; overwriting, it takes their place, then their archives go."""
        system, root = _open_fs(self.path)
        system.create_dir(root, recursive=True)
        old = [x.path for x in system.get_file_info(fs.FileSelector(root)) if x.base_name.startswith(MANIFEST)] if self.overwrite else []
        with system.open_output_stream(f"{root}/{MANIFEST}{self.job}.json") as f:
            f.write(json.dumps({"files": sorted(x for m in messages if m for x in m.files), "replaces": [p.rpartition("/")[2] for p in old]}).encode())
        for p in old:
            with system.open_input_stream(p) as f:
                names = [name for name, _ in json.loads(f.read())["files"]]
            self._delete(system, root, names)
            system.delete_file(p)

    def _delete(self, system, root, names):
        for name in names:
            for path in (f"{root}/{name}", f"{root}/{name}{INDEX}"):
                if system.get_file_info(path).type == fs.FileType.File:
                    system.delete_file(path)

    def abort(self, messages):
        system, root = _open_fs(self.path)
        self._delete(system, root, [name for m in messages if m for name, _ in m.files])


def _one_line(value: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _record(row: dict) -> tuple[bytes, dict[str, str]]:
    """A record, and its headers as a reader finds them."""
    payload = row["payload"] or b""
    revisit = row["record_type"] == "revisit"
    length = row["payload_length"] if revisit else len(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode() + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {row['record_id']}", "WARC-Date: 2000-01-01T00:00:00Z"]
    if row["target_uri"] is not None:
        head.append(f"WARC-Target-URI: {_one_line(row['target_uri'])}")
    digest = row["declared_digest"] if revisit else "sha1:" + base32_sha1(payload)
    head.append(f"WARC-Payload-Digest: {digest}")
    if revisit:
        head += [f"WARC-Refers-To: {row['refers_to']}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    headers = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in head[1:])}
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n", headers


#: Salts over which a group of equal payloads is spread.
SALTS = 16


def _hex_to_base32(column):
    """Base32 of a 40-digit hex string: eight groups of 20 bits, each four letters."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    out = []
    for i in range(0, 40, 5):
        v = F.conv(F.substring(column, i + 1, 5), 16, 10).cast("int")
        out += [F.substring(letters, F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def _shared(spark: SparkSession, path: str) -> str:
    """A bare path means another disk on every executor of a cluster, so it is refused there."""
    if ":" not in path and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError(f"{path}: a path on a cluster names its store, as file:///... or s3a://... do")
    return path


def write_deduplicated(spark: SparkSession, pages: DataFrame, path: str, least: int = 0, mode: str = "append") -> None:
    """Write a record per page; of equal payloads of at least ``least`` bytes, that with the smallest page_id is a
    response and others revisit it; shorter ones are all responses.

    Null html is an empty payload; null url gives no target URI. A row without page_id revisits if its payload is also
    a numbered page's; else it is a response. Rows that repeat the smallest page_id are responses too. Further columns are not used.
    A second write to a path adds records, or with ``mode`` overwrite replaces them; payloads of different writes are not compared.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("sha", F.sha1("payload")).withColumn("payload_length", F.length("payload").cast("long"))
    p = p.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    firsts = p.filter(F.col("payload_length") >= least).groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = firsts.filter("n > 1 and first is not null").select("sha", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    j = p.join(firsts, ["sha", "salt"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    out = j.select(
        urn(F.col("page_id")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.col("url").alias("target_uri"),
        F.when(revisit, urn(F.col("first"))).alias("refers_to"), F.lit(None).cast("string").alias("date"), F.lit(None).cast("string").alias("content_type"),
        F.when(revisit, F.concat(F.lit("sha1:"), _hex_to_base32(F.col("sha")))).alias("declared_digest"), "payload_length", F.lit(None).cast("string").alias("payload_sha1"),
        F.lit(None).cast("map<string,string>").alias("headers"), F.when(~revisit, F.col("payload")).alias("payload"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("long").alias("offset"),
    )
    spark.dataSource.register(WarcDataSource)
    out.write.format("warc").mode(mode).option("path", _shared(spark, path)).save()


def read_warc(spark: SparkSession, path: str, payload: bool = True, digest: bool = False, types: tuple[str, ...] = ()) -> DataFrame:
    """Records of the archives below ``path``; with ``types`` only those, whose payloads alone are read.

    Archives without records give none; a damaged or cut archive is an error (see the option ``damaged`` of the format).
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # the reader takes filters, so Spark wants it on
    spark.dataSource.register(WarcDataSource)
    reader = spark.read.format("warc").option("path", _shared(spark, path)).option("payload", str(payload).lower()).option("digest", str(digest).lower())
    return (reader.option("types", ",".join(types)) if types else reader).load()


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages as WARC records, read the archives back, and tell what each record is.

    Payloads are read of responses only; of revisits the headers tell all, so their read passes over every payload.
    """

    def make():
        path = Scratch(spark, "warc").path + "/archives"
        write_deduplicated(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
        number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")

        def of(kind, digest, refers):
            r = read_warc(spark, path, payload=False, digest=kind == "response").filter(F.col("record_type") == kind)
            return r.select(number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", refers.alias("refers_to"))

        revisits = of("revisit", F.regexp_replace("declared_digest", "^sha1:", ""), number("refers_to"))
        return of("response", F.col("payload_sha1"), F.lit(None).cast("long")).unionByName(revisits)

    return result(spark, "op3", make)
