"""Media columns: archive directories read by byte range through a Spark data source of our own.

A payload is stored as an 8-bit greyscale PNG of 192 samples a row, a member of a tar archive beside which an
index of member offsets lies. The data source plans byte-range partitions over the archives of a directory; a partition owns the members whose
headers start in its range, reads each on its own by offset, tries a failed one again by itself, and streams Arrow batches.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import time
import zlib
from collections.abc import Iterator
from contextlib import nullcontext, suppress

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .store import new_dir, open_fs

WIDTH = 192
PNG = b"\x89PNG\r\n\x1a\n"
#: key, is the key null, bytes before padding, header's offset, data's offset, data's length, CRC-32 of the data
ENTRY = np.dtype([("key", "<i8"), ("none", "<i8"), ("n_bytes", "<i8"), ("header", "<i8"), ("start", "<i8"), ("length", "<i8"), ("crc", "<i8")])
SPLIT_BYTES = 8 << 20
BATCH_BYTES = 4 << 20


def padded(raw: bytes) -> bytes:
    return raw + b" " * (-len(raw) % WIDTH if raw else WIDTH)


def encode(payload: bytes) -> bytes:
    """An 8-bit greyscale PNG with ``payload`` as its samples."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), dtype=np.uint8)
    rows[:, 1:] = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 5)) + chunk(b"IEND", b"")


def decode(png: bytes) -> bytes:
    """The samples of a PNG that ``encode`` made; raises ValueError on any failed check."""
    if png[:8] != PNG:
        raise ValueError("no PNG signature")
    at, data, height = 8, [], 0
    while at < len(png):
        n, kind = struct.unpack(">I4s", png[at : at + 8])
        body = png[at + 8 : at + 8 + n]
        if struct.unpack(">I", png[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError("chunk checksum")
        if kind == b"IHDR":
            height = struct.unpack(">IIBBBBB", body)[1]
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(height, WIDTH + 1)
    if rows[:, 0].any():
        raise ValueError("unknown row filter")
    return rows[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean sample in thousandths and the shares of eight brightness bands in thousandths."""
    x = np.frombuffer(payload, dtype=np.uint8)
    bands = np.bincount(x >> 5, minlength=8) * 1000 // len(x)
    return f"mean={int(x.sum(dtype=np.int64)) * 1000 // len(x)};bands=" + "-".join(map(str, bands.tolist()))


def write_archives(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> int:
    """Write one tar archive and its index for each partition of ``df`` below ``path``; returns the number of members.

    An attempt writes under a name of its own and renames at its end, so a lost task leaves no half archive.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        name, own = f"part-{context.partitionId():06d}", f".{context.partitionId():06d}-{context.taskAttemptId()}"
        fs, inner = open_fs(path)
        fs.create_dir(inner, recursive=True)
        entries, at = [], 0
        with fs.open_output_stream(f"{inner}/{own}.tar") as out:
            for b in batches:
                for k, raw in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()), strict=True):
                    raw = raw.as_py() or b""
                    data = encode(padded(raw))
                    info = tarfile.TarInfo(f"{len(entries):09d}.png")
                    info.size = len(data)
                    head = info.tobuf(tarfile.PAX_FORMAT)
                    out.write(head + data + b"\0" * (-len(data) % 512))
                    entries.append((k or 0, k is None, len(raw), at, at + len(head), len(data), zlib.crc32(data)))
                    at += len(head) + len(data) + -len(data) % 512
            out.write(b"\0" * 1024)
        with fs.open_output_stream(f"{inner}/{own}.idx") as out:
            out.write(np.array(entries, dtype=ENTRY).tobytes())
        fs.move(f"{inner}/{own}.idx", f"{inner}/{name}.idx")
        fs.move(f"{inner}/{own}.tar", f"{inner}/{name}.tar")
        yield pa.RecordBatch.from_arrays([pa.array([len(entries)], pa.int64())], names=["n"])

    return df.select(df[key].cast("long").alias("key"), df[text].alias("text")).mapInArrow(task, "n long").agg(F.sum("n")).first()[0] or 0


def entry_at(index: pa.NativeFile, offset: int) -> int:
    """Number of an index's entries whose header stands before ``offset``; entries are sorted by header."""
    lo, hi = 0, index.size() // ENTRY.itemsize
    while lo < hi:
        mid = (lo + hi) // 2
        entry = np.frombuffer(index.read_at(ENTRY.itemsize, mid * ENTRY.itemsize), dtype=ENTRY)[0]
        lo, hi = (mid + 1, hi) if entry["header"] < offset else (lo, mid)
    return lo


class Range(InputPartition):
    def __init__(self, archive: str, start: int, end: int):
        self.archive, self.start, self.end = archive, start, end


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.tries = int(options.get("tries", 3))
        self.report = options.get("onerror", "raise") == "report"

    def partitions(self) -> list[Range]:
        fs, inner = open_fs(self.path)
        found = fs.get_file_info(pafs.FileSelector(inner, allow_not_found=True))
        archives = sorted((f.base_name, f.size) for f in found if f.base_name.endswith(".tar") and not f.base_name.startswith("."))
        return [Range(name, at, min(size, at + self.split)) for name, size in archives for at in range(0, size, self.split)] or [Range("", 0, 0)]

    def member(self, fs: pafs.FileSystem, archive: str, entry) -> bytes:
        """One member by offset, opened anew at each try."""
        error: Exception | None = None
        for wait in range(self.tries):
            try:
                with fs.open_input_file(archive) as f:
                    data = f.read_at(int(entry["length"]), int(entry["start"]))
                if zlib.crc32(data) == entry["crc"]:
                    return data
                error = ValueError("member checksum")
            except OSError as e:
                error = e
            time.sleep(0.1 * wait)
        raise OSError(f"{archive} at {entry['start']}: {error}")

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        fs, inner = open_fs(self.path)
        archive = f"{inner}/{partition.archive}"
        with fs.open_input_file(archive.removesuffix(".tar") + ".idx") as f:
            first, last = (entry_at(f, x) for x in (partition.start, partition.end))
            mine = np.frombuffer(f.read_at((last - first) * ENTRY.itemsize, first * ENTRY.itemsize), dtype=ENTRY)
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string()), strict=True)], names=["key", "n_bytes", "archive", "offset", "media", "error"])

        try:
            whole = fs.open_input_file(archive)
        except OSError:
            whole = None
        with whole or nullcontext():
            for e in mine:
                data, error = None, None
                if whole:
                    with suppress(OSError):
                        data = whole.read_at(int(e["length"]), int(e["start"]))
                if data is None or zlib.crc32(data) != e["crc"]:
                    try:
                        data = self.member(fs, archive, e)
                    except OSError as failed:
                        if not self.report:
                            raise
                        data, error = None, str(failed)
                rows.append((None if e["none"] else int(e["key"]), int(e["n_bytes"]), partition.archive, int(e["start"]), data, error))
                held += len(data or b"")
                if held >= BATCH_BYTES:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()


class ArchiveSource(DataSource):
    """``spark.read.format("media_archive")``: members of the tar archives below ``path``.

    Options: splitBytes, tries, onError (raise, or report for a row with ``error`` and no media).
    """

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "key long, n_bytes long, archive string, offset long, media binary, error string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader({k.lower(): v for k, v in self.options.items()})


def read_archives(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archive").options(path=path, **options).load()


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_features(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Store each text as a media member, read it back and measure it: SCHEMA, one row for each row of ``df``.

    A null text is empty, and an empty one is a row of spaces. Repeated rows give repeated members; a null key stays null; an empty table gives no rows; other columns
    are not read. A member that stays unreadable fails the task, which Spark runs again. A very long text is one member, which a worker holds whole.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, n, media in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                payload = decode(media)
                rows.append((k, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
            if rows:
                names = [c.split()[0] for c in SCHEMA.split(", ")]
                kinds = [pa.string() if c.endswith("string") else pa.int64() for c in SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    path = new_dir(df.sparkSession, "media")
    write_archives(df, path, text, key)
    return read_archives(df.sparkSession, path).select("key", "n_bytes", "media").mapInArrow(measure, SCHEMA)
