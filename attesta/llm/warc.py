"""WARC archives: writing with revisit records, and a reader that salvages damaged files.

The reader checks each record (gzip member, version line, lengths, and the digests that it names). After a failed check it searches for
the next member or version line that holds a valid record, goes on from there, and logs the bytes between as a quarantined gap. A damaged record whose length still
leads to the next record is skipped whole; where it doesn't, a record found within the damaged one's bytes may be part of its payload, and is reported as nested.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import RowStore, materialise, new_dir, open_fs

#: Payloads of fewer bytes are always stored.
LEAST_PAYLOAD = 100
#: Records of an archive.
ARCHIVE_ROWS = 5_000
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
START = re.compile(rb"\x1f\x8b\x08|WARC/1\.")


def record(page_id: int | None, url: str | None, payload: bytes, number: int, refers_to: tuple | None = None) -> bytes:
    """One record; ``refers_to`` makes it a revisit without payload, and holds the page_id of the response."""
    digest = hashlib.sha256(payload).hexdigest()
    block = HTTP if refers_to else HTTP + payload
    head = [
        ("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, str(number))}>"), ("WARC-Date", "2024-01-01T00:00:00Z"),
        ("WARC-Target-URI", quote(url or "", safe=":/?#[]@!$&'()*+,;=%~-._", errors="surrogatepass")), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Payload-Length", str(len(payload))),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    if page_id is not None:
        head.append(("Page-Id", str(page_id)))
    if refers_to:
        head.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        if refers_to[0] is not None:
            head.append(("Refers-To-Page-Id", str(refers_to[0])))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    """A record as a gzip member of its own."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


class Damaged(ValueError):
    """A failed check; ``extent`` is where the record ends by its own header, if that could be read."""

    def __init__(self, reason: str, extent: int | None = None):
        super().__init__(reason)
        self.extent = extent


def digest_fits(named: str | None, data: bytes) -> bool | None:
    """Whether a digest like ``sha1:BASE32`` or ``sha256:hex`` is that of the data; None without one, or with one of an unknown kind."""
    kind, _, value = (named or "").partition(":")
    kind = kind.lower().replace("-", "")
    if not value or kind not in ("md5", "sha1", "sha256", "sha512"):
        return None
    made = hashlib.new(kind, data).digest()
    return value.lower() == made.hex() or value.upper().rstrip("=") == base64.b32encode(made).decode().rstrip("=") or value.rstrip("=") == base64.b64encode(made).decode().rstrip("=")


def parse(raw: bytes, start: int = 0) -> tuple[dict, bytes, int]:
    """Header, block and end of the record at ``start``; Damaged on any failed check. A record without block digest is checked by its lengths alone."""
    if raw[start : start + len(VERSION)] != VERSION:
        raise Damaged("no version line")
    stop = raw.find(b"\r\n\r\n", start)
    if stop < 0:
        raise Damaged("open header")
    head = {}
    for x in raw[start:stop].split(b"\r\n")[1:]:
        name, colon, value = x.partition(b":")
        if not colon:
            raise Damaged("header line")
        head[name.decode("latin-1").lower()] = value.strip().decode("latin-1")
    try:
        n = int(head["content-length"])
    except (KeyError, ValueError):
        raise Damaged("content length") from None
    end = stop + 4 + n
    if n < 0 or raw[end : end + 4] != b"\r\n\r\n":
        raise Damaged("block length", end + 4 if n >= 0 else None)
    block = raw[stop + 4 : end]
    if digest_fits(head.get("warc-block-digest"), block) is False:
        raise Damaged("block digest", end + 4)
    return head, block, end + 4


def inflate(data: bytes, start: int) -> tuple[bytes, int]:
    """The gzip member at ``start`` and its end; the stream's own checksum and length are checked."""
    z, out, at = zlib.decompressobj(31), [], start
    try:
        while not z.eof:
            if at >= len(data):
                raise Damaged("open member")
            out.append(z.decompress(data[at : at + 65536]))
            at += 65536
    except zlib.error as e:
        raise Damaged(str(e)) from None
    return b"".join(out), min(at, len(data)) - len(z.unused_data)


def one(data: bytes, at: int) -> tuple[dict, bytes, int]:
    if data[at : at + 3] == MAGIC:
        raw, end = inflate(data, at)
        try:
            head, block, used = parse(raw)
        except Damaged as e:
            raise Damaged(str(e), end) from None  # the member itself is sound
        if used != len(raw):
            raise Damaged("more than a record in a member")
        return head, block, end
    return parse(data, at)


def salvage(data: bytes) -> Iterator[tuple[str, int, int, object]]:
    """('record', start, end, (header, block)) and ('gap', start, end, reason) that cover ``data`` in order.

    A record found inside the extent of a damaged one, where that extent couldn't be trusted, is 'nested' instead of 'record'.
    """
    at = extent = 0
    while at < len(data):
        try:
            head, block, end = one(data, at)
            yield "record" if at >= extent else "nested", at, end, (head, block)
            at = end
            continue
        except Damaged as e:
            reason, start, claimed = str(e), at, e.extent
        if claimed and start < claimed <= len(data) and (claimed == len(data) or START.match(data, claimed)):
            yield "gap", start, claimed, reason
            at = claimed
            continue
        extent = max(extent, min(claimed or 0, len(data)))
        for m in START.finditer(data, start + 1):
            try:
                one(data, m.start())
            except Damaged:
                continue
            at = m.start()
            break
        else:
            at = len(data)
        yield "gap", start, at, reason


def roles(store: RowStore, payload: str, key: str, least: int) -> DataFrame:
    """rid, a (1), b (the response's key), c (1 if that key is null) of the rows that revisit another. Only digests are shuffled."""
    rid = F.col(store.rid)
    own = store.df.select(rid.alias("rid"), F.col(key).cast("long").alias("k"), F.octet_length(payload).alias("size"), F.sha2(F.col(payload), 256).alias("digest")).where(F.col("size") >= least)
    first = own.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct(F.col("k").isNull().alias("none"), F.col("k"), F.col("rid"))).alias("first")).where("n > 1")
    return own.join(first, "digest").where("rid <> first.rid").select("rid", F.lit(1).alias("a"), F.coalesce("first.k", F.lit(0)).alias("b"), F.col("first.none").cast("long").alias("c"))


def write_archives(df: DataFrame, payload: str = "html", url: str = "url", key: str = "page_id", least: int = LEAST_PAYLOAD) -> DataFrame:
    """Write the rows as gzip-member WARC archives in the shared folder; returns their manifest: archive, records.

    Of equal payloads of ``least`` bytes or more the row with the least key (then the first) is the response, null keys last.
    """
    spark = df.sparkSession
    store = RowStore.write(df.select(df[key].cast("long").alias("page_id"), df[url].alias("url"), df[payload].alias("payload")), "pages")
    path, name = new_dir(spark, "warc"), store.rid

    def write(rows: pa.RecordBatch, control: list) -> pa.RecordBatch:
        ids = rows.column(rows.schema.get_field_index(name)).to_numpy()
        revisit = {r: (None if none else to,) for r, _, to, none in zip(*(x.tolist() for x in control[:4]), strict=True)}
        fs, inner = open_fs(path)
        fs.create_dir(inner, recursive=True)
        archive, own = f"{ids[0]:016d}.warc.gz", f".{uuid.uuid4().hex}"
        with fs.open_output_stream(f"{inner}/{own}") as out:
            for i, k, u, raw in zip(ids.tolist(), *(rows.column(rows.schema.get_field_index(c)).to_pylist() for c in ("page_id", "url", "payload")), strict=True):
                out.write(member(record(k, u, (raw or "").encode("utf-8", "surrogatepass"), i, revisit.get(i))))
        fs.move(f"{inner}/{own}", f"{inner}/{archive}")
        return pa.RecordBatch.from_arrays([pa.array([f"{path}/{archive}"]), pa.array([len(ids)], pa.int64())], names=["archive", "records"])

    return materialise(store.run(roles(store, "payload", "page_id", least), write, "archive string, records long", batch=ARCHIVE_ROWS), "manifest")


READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, start long, end long, problem string"


def read_record(head: dict, block: bytes) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, problem of a record; what its header doesn't hold is null."""
    number = lambda x: int(x) if x is not None and re.fullmatch(r"-?\d{1,18}", x) else None
    kind, named, problem = head.get("warc-type"), head.get("warc-payload-digest"), None
    if kind == "revisit":
        size, digest = number(head.get("payload-length")), named and named.removeprefix("sha256:")
    else:
        payload = block.partition(b"\r\n\r\n")[2] if head.get("content-type", "").startswith("application/http") else block
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
        problem = "payload digest" if digest_fits(named, payload) is False else None
    return number(head.get("page-id")), size, digest, kind, number(head.get("refers-to-page-id")), problem


def read_archives(archives: DataFrame, parts: int | None = None) -> DataFrame:
    """Records and gaps (record_type 'gap', with the reason in problem) of the files in the column ``archive``.

    A response whose payload digest is wrong is reported with the problem, and so is a record found within a damaged one's bytes; the digest and length returned are of what was read. Revisits
    carry theirs in the header. Null names are left out, names that stand twice are read twice, and no archives give no rows. Where there is a column ``records``, a file with
    another number of records fails the task. A worker holds one archive whole, and a record of any length with it.
    """
    counted = "records" in archives.columns

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for b in batches:
            for uri, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, inner = open_fs(uri)
                with fs.open_input_file(inner) as f:
                    data = f.read()
                rows = []
                for kind, start, end, what in salvage(data):
                    if kind == "gap":
                        rows.append((None, None, None, "gap", None, uri, start, end, what))
                        continue
                    *found, problem = read_record(*what)
                    rows.append((*found, uri, start, end, "inside a damaged record" if kind == "nested" else problem))
                have = sum(r[3] != "gap" for r in rows)
                if wanted is not None and have != wanted:
                    raise OSError(f"{uri} holds {have} records, not {wanted}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in READ_SCHEMA.split(", ")])

    width = parts or int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = F.col("records").cast("long") if counted else F.lit(None).cast("long")
    return archives.where("archive IS NOT NULL").select("archive", wanted.alias("records")).repartition(width).mapInArrow(task, READ_SCHEMA)


def round_trip(df: DataFrame, payload: str = "html", url: str = "url", key: str = "page_id") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the records read back: one row for each row of ``df``.

    A null payload is empty. Repeated rows of one key and payload: the first is the response, the others revisit it. A null key stays null,
    and a response without key leaves refers_to null. An empty table gives no rows; other columns are not read. A very long payload is one record. An archive that
    doesn't hold what was written fails the job.
    """
    return read_archives(write_archives(df, payload, url, key)).where("record_type <> 'gap'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
