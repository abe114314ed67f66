"""WARC records in ZIP packages: writer and range reader.

A package is a ZIP file, streamed out as its records come, whose members are
stored (not compressed by ZIP): ``archive/data.warc.gz``, one gzip member per record, and
``indexes/index.cdxj``, one line per record with its offset and length inside
that member.  Packages are written to the folder that driver and executors
share, under a name of their own for each attempt of a task; only names that a
finished attempt returned are read, so a lost executor leaves at worst a file
that nobody reads.

The reader never extracts.  It reads the end of each file, the central
directory (through the ZIP64 end record and locator where there are such),
locates archives and indexes, reads the indexes, and plans byte ranges of at
most ``RANGE`` bytes of neighbouring records; the ranges are dealt evenly over
tasks, which read each with one request.  A package of any size is thus read by
many tasks.

Defined results: a null payload is empty.  Payloads of at least
``LEAST_REVISIT`` bytes that are equal are stored once, in the record with the
smallest page_id (of rows that share that id, all); others are revisits that
refer to it.  A null page_id sorts after all others.  Repeated rows are records
of their own; an empty table makes no package.  Other columns of the input are
not read, whatever their names.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtable.llm._shared import has, salted_join, scratch, table, written

LEAST_REVISIT = 100
#: Bytes after which a task begins another package, and of one range read.
ROLL = 1 << 30
RANGE = 4 << 20
SALTS = 32
#: Digests of repeated payloads are sent to all tasks up to this number (about 150 bytes each); beyond, a salted join does the same.
BROADCAST_DIGESTS = 300_000

# Fixed values of the ZIP format.
LOCAL, DESCRIPTOR, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x07\x08", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
MAX16, MAX32 = 0xFFFF, 0xFFFFFFFF


class Package:
    """Writes a ZIP file of stored members to a stream, front to back: a member's bytes go out as they come, its size and checksum after them (and into the central directory), so nothing is held but the directory."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.zip64, self.at, self.central = out, zip64, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        self.name, self.start, self.crc, self.size = name.encode(), self.at, 0, 0
        # Sizes follow the data (flag 8), as 64-bit numbers since there is a ZIP64 field.
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._put(LOCAL + struct.pack("<HHHHHIIIHH", 45, 0x808, 0, 0, 0x21, 0, MAX32, MAX32, len(self.name), len(extra)) + self.name + extra)

    def write(self, data: bytes) -> None:
        self.crc = zlib.crc32(data, self.crc)
        self.size += len(data)
        self._put(data)

    def end(self) -> None:
        self._put(DESCRIPTOR + struct.pack("<IQQ", self.crc, self.size, self.size))
        big = self.zip64 or self.size >= MAX32 or self.start >= MAX32
        extra = struct.pack("<HHQQQ", 1, 24, self.size, self.size, self.start) if big else b""
        size, start = (MAX32, MAX32) if big else (self.size, self.start)
        self.central.append(CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0x808, 0, 0, 0x21, self.crc, size, size, len(self.name), len(extra), 0, 0, 0, 0, start) + self.name + extra)

    def member(self, name: str, data: bytes) -> None:
        self.begin(name)
        self.write(data)
        self.end()

    def finish(self) -> int:
        """Writes the directory; returns the file's size."""
        start, body, n = self.at, b"".join(self.central), len(self.central)
        self._put(body)
        size = len(body)
        if self.zip64 or n >= MAX16 or start >= MAX32 or size >= MAX32:
            at = self.at
            self._put(END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, start))
            self._put(LOCATOR64 + struct.pack("<IQI", 0, at, 1))
            n, size, start = MAX16, MAX32, MAX32
        self._put(END + struct.pack("<HHHHIIH", 0, 0, n, n, size, start, 0))
        return self.at


def zip_file(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP file of stored members in memory; with ``zip64`` (or where a number needs it) with ZIP64 fields."""
    out = io.BytesIO()
    package = Package(out, zip64)
    for name, data in members:
        package.member(name, data)
    package.finish()
    return out.getvalue()


def members(read, size: int) -> list[dict]:
    """The central directory of a ZIP file: name, offset, size, method.  ``read(offset, length)`` gives bytes; ``offset`` is where a member's data begins."""
    tail_at = max(0, size - (1 << 16) - 22)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(END)
    while at >= 0 and at + 22 + (struct.unpack_from("<H", tail, at + 20)[0] if at + 22 <= len(tail) else 0) > len(tail):
        at = tail.rfind(END, 0, at)  # these four bytes were part of a comment
    if at < 0:
        raise ValueError("no end of central directory")
    _, _, _, n, length, start, _ = struct.unpack_from("<HHHHIIH", tail, at + 4)
    if n == MAX16 or length == MAX32 or start == MAX32:
        place = tail_at + at - 20
        locator = read(place, 20) if place >= 0 else b""
        if locator[:4] == LOCATOR64:
            where = struct.unpack_from("<Q", locator, 8)[0]
            record = read(where, 56)
            if record[:4] != END64:
                raise ValueError("no ZIP64 end of central directory")
            n, length, start = struct.unpack_from("<QQQ", record, 32)
    body = read(start, length)
    out, at = [], 0
    for _ in range(n):
        if body[at : at + 4] != CENTRAL:
            raise ValueError("the central directory is cut off")
        method = struct.unpack_from("<H", body, at + 10)[0]
        packed, full, name_size, extra_size, comment_size = struct.unpack_from("<IIHHH", body, at + 20)
        local = struct.unpack_from("<I", body, at + 42)[0]
        name = body[at + 46 : at + 46 + name_size].decode("utf-8")
        extra = body[at + 46 + name_size : at + 46 + name_size + extra_size]
        while len(extra) >= 4:
            kind, size_ = struct.unpack_from("<HH", extra)
            if kind == 1:  # 64-bit values, only of the fields that are full
                field = extra[4 : 4 + size_]
                for key in ("full", "packed", "local"):
                    if {"full": full, "packed": packed, "local": local}[key] == MAX32 and len(field) >= 8:
                        value, field = struct.unpack_from("<Q", field)[0], field[8:]
                        full, packed, local = (value if key == "full" else full), (value if key == "packed" else packed), (value if key == "local" else local)
            extra = extra[4 + size_ :]
        head = read(local, 30)
        if head[:4] != LOCAL:
            raise ValueError(f"no member at {local}")
        skip = sum(struct.unpack_from("<HH", head, 26))
        out.append({"name": name, "offset": local + 30 + skip, "size": packed, "method": method})
        at += 46 + name_size + extra_size + comment_size
    return out


def warc_record(page_id: int | None, url: str | None, kind: str, digest: str, size: int, payload: bytes, refers_to: int | None) -> bytes:
    """A response or revisit record.  The HTTP head keeps the length of the full payload, as revisits of equal payloads do."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields of one record, its payload checked against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload is not what was written")
    page = lambda key: (lambda s: int(s) if s else None)(fields[key].removeprefix("<urn:page:").removesuffix(">")) if key in fields else None
    return {"page_id": page("WARC-Record-ID"), "url": fields["WARC-Target-URI"], "payload": payload, "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": page("WARC-Refers-To")}


def _opened(path: str):
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _reader(file):
    def read(offset: int, length: int) -> bytes:
        file.seek(offset)
        return file.read(length)

    return read


def planned(pages: DataFrame, *, id_col: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_REVISIT, broadcast_digests: int = BROADCAST_DIGESTS) -> DataFrame:
    """page_id, url, payload, size, digest, and ``first``: the page whose payload a row repeats (null: none, or itself).

    Sizes and digests alone are grouped, first by (digest, salt), so a payload
    that a third of all pages share is counted in many tasks.  Digests that do
    repeat are written and counted: few are sent to all tasks, and payloads stay
    where they are; many are joined by salt.  Payloads too short to be revisited
    meet no digest and are dealt evenly.
    """
    raw = F.encode(F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), raw.alias("payload"))
    rows = rows.withColumn("size", F.length("payload").cast("bigint")).withColumn("digest", F.sha2("payload", 256))
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS))
    some = rows.where(F.col("size") >= least).groupBy("digest", salt.alias("salt")).agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    firsts = written(some.groupBy("digest").agg(F.min("first").alias("first"), F.sum("n").alias("n")).where("n > 1 AND first IS NOT NULL").select("digest", "first"), "repeated")
    key = firsts.withColumnRenamed("digest", "key")
    if firsts.count() <= broadcast_digests:
        out = rows.join(F.broadcast(key), (F.col("digest") == F.col("key")) & (F.col("size") >= least), "left")
    else:
        key = key.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
        # Salts under 0 meet nothing: short payloads are dealt by them alone.
        own = F.when(F.col("size") >= least, salt).otherwise(-1 - F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 30)))
        out = rows.withColumn("salt", own).join(key.withColumnRenamed("key", "digest"), ["digest", "salt"], "left")
    return out.withColumn("first", F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first"))).select("page_id", "url", "payload", "size", "digest", "first")


def write(pages: DataFrame, folder: str, *, roll: int = ROLL, zip64: bool = False, **names) -> DataFrame:
    """Writes ``pages`` as packages of about ``roll`` bytes below ``folder``; returns path and size of each, as a table written beside them."""
    spark = pages.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = fs.FileSystem.from_uri(folder)
        system.create_dir(inner, recursive=True)
        package, file, name, index = None, None, "", []

        def close() -> pa.RecordBatch:
            package.end()
            package.member("indexes/index.cdxj", "".join(index).encode())
            package.member("datapackage.json", b'{"profile": "data-package", "wacz_version": "1.1.1"}')
            size = package.finish()
            file.close()
            index.clear()
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size], pa.int64())], names=["path", "size"])

        for batch in batches:
            for page, url, payload, size, digest, first in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "size", "digest", "first")), strict=True):
                kind = "response" if first.as_py() is None else "revisit"
                record = gzip.compress(warc_record(page.as_py(), url.as_py(), kind, digest.as_py(), size.as_py(), payload.as_py(), first.as_py()), 4, mtime=0)
                if package is None:
                    name = f"{uuid.uuid4().hex}.wacz"
                    file = system.open_output_stream(f"{inner}/{name}")
                    package = Package(file, zip64)
                    package.begin("archive/data.warc.gz")
                index.append(f"{page.as_py()} 19700101000000 {json.dumps({'offset': str(package.size), 'length': str(len(record)), 'filename': 'data.warc.gz'})}\n")
                package.write(record)
                if package.size >= roll:
                    yield close()
                    package = None
        if package is not None:
            yield close()

    plan = planned(pages, **names)
    manifest = f"{folder}/manifest"
    plan.mapInArrow(run, "path string, size bigint").write.parquet(manifest)
    return spark.read.schema("path string, size bigint").parquet(manifest)


def ranges(packages: DataFrame) -> DataFrame:
    """path, offset, length and the record lengths of runs of neighbouring records, from the directories and indexes alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size in zip(batch.column("path").to_pylist(), batch.column("size").to_pylist(), strict=True):
                with _opened(path) as file:
                    read = _reader(file)
                    found = members(read, size)
                    archives = {m["name"].rsplit("/", 1)[-1]: m for m in found if m["name"].startswith("archive/")}
                    for m in found:
                        if m["method"] and m["name"].startswith(("archive/", "indexes/")):
                            raise ValueError(f"{path}: {m['name']} is not stored")
                    runs: list[tuple[int, list[int]]] = []
                    for m in found:
                        if not m["name"].startswith("indexes/"):
                            continue
                        places = [json.loads(line.split(" ", 2)[2]) for line in read(m["offset"], m["size"]).decode().splitlines() if line]
                        for at, length in sorted((archives[p["filename"]]["offset"] + int(p["offset"]), int(p["length"])) for p in places):
                            if runs and runs[-1][0] + sum(runs[-1][1]) == at and sum(runs[-1][1]) + length <= RANGE and len(runs[-1][1]) < 2000:
                                runs[-1][1].append(length)
                            else:
                                runs.append((at, [length]))
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(runs), pa.string()), pa.array([r[0] for r in runs], pa.int64()), pa.array([r[1] for r in runs], pa.list_(pa.int64()))], names=["path", "offset", "lengths"])

    return packages.mapInArrow(run, "path string, offset bigint, lengths array<bigint>")


def read(packages: DataFrame, *, payloads: bool = False) -> DataFrame:
    """Every record of the packages (path, size), by range reads: page_id, payload_bytes, payload_digest, record_type, refers_to, url and, if asked, the payload (null for revisits)."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"] + ["payload"] * payloads
    types = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, offset, lengths in zip(batch.column("path").to_pylist(), batch.column("offset").to_pylist(), batch.column("lengths").to_pylist(), strict=True):
                with _opened(path) as file:
                    raw = _reader(file)(offset, sum(lengths))
                rows, at = [], 0
                for n in lengths:
                    rows.append(parse_record(gzip.decompress(raw[at : at + n])))
                    at += n
                    if rows[-1]["record_type"] == "revisit":
                        rows[-1]["payload"] = None
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], types.get(c, pa.string())) for c in names], names=names)

    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string" + ", payload binary" * payloads
    spread = max(packages.sparkSession.sparkContext.defaultParallelism, int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return ranges(packages.repartition(spread)).repartition(spread).mapInArrow(run, schema)


def restored(records: DataFrame) -> DataFrame:
    """Records of ``read(payloads=True)`` with the payload of revisits filled in from the response of their digest, checked against the digest; an error if there is none."""
    again = records.where("record_type = 'revisit'")
    asked = again.select("payload_digest").distinct()
    full = records.where(f"record_type = 'response' AND payload_bytes >= {LEAST_REVISIT}").join(asked, "payload_digest", "left_semi").groupBy("payload_digest").agg(F.first("payload").alias("full"))
    met = salted_join(again.withColumn("at", F.monotonically_increasing_id()), full, ["payload_digest"], ["at"], "left")
    fits = F.sha2("full", 256) == F.col("payload_digest")
    checked = F.when(F.coalesce(fits, F.lit(False)), F.col("full")).otherwise(F.raise_error(F.concat(F.lit("no payload for page "), F.col("page_id").cast("string"))).cast("binary"))
    return records.where("record_type <> 'revisit'").unionByName(met.withColumn("payload", checked).select(records.columns))


def round_trip(spark: SparkSession, pages: DataFrame, **names) -> DataFrame:
    """Writes ``pages`` as packages and reads them back."""
    has(pages, names.get("id_col", "page_id"), names.get("url", "url"), names.get("html", "html"))
    return read(write(pages, scratch(spark, "warc"), **names))


def op1(spark, sf_dir):
    return round_trip(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
