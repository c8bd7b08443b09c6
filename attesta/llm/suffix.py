"""Removal of long repeated substrings with a run-length compressed index.

A string of ``length`` bytes that starts twice is found in three steps:

1. *Anchors.* Of the GRAM-byte strings inside each window of ``length`` bytes, the one with the least hash is
   the window's anchor, so equal windows have equal anchors. Consecutive windows of one anchor make a *segment*.
   Anchors that stand once in the corpus rule their windows out.
2. *Index.* The segments of an anchor that stands several times meet in a bucket, those of a frequent anchor in several buckets of some BUCKET segments
   each. Equal segments of a bucket are kept once, and the different ones go into a run-length index: their run-compressed Burrows-Wheeler transform, with suffix positions
   sampled at the ends of its runs. From the samples it streams, for each position, the longest match with the suffixes before and after it;
   windows that match over ``length`` bytes or more are marked. Where an anchor has several buckets, each gives out its different windows once, as
   digests, and a shuffle finds those that stand in several buckets.
3. *Removal.* Marked ranges go back to the texts' segments.

Equal windows always share an anchor, so an index over one anchor's segments sees all places of its windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import RowStore, materialise

LENGTH = 200
GRAM = 50
#: Bytes of different segments in one index, or those of one bucket if they are more; bounds a task's memory (some 120 bytes for each).
BLOCK = 1 << 19
#: Segments of one anchor that meet in a bucket, on average; a bucket's bytes are at most some 350 times as many.
BUCKET = 1_000
SEPARATOR, START = 0xFF, 0xFE  # bytes that UTF-8 never holds


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by prefix doubling over the suffixes that are still tied; the end sorts first."""
    n = len(t)
    wide = np.zeros(n + 7, dtype=np.int64)
    wide[:n] = t.astype(np.int64) + 1
    key = np.zeros(n, dtype=np.int64)
    for k in range(7):
        key = key * 257 + wide[k : k + n]
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    fresh = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    slots = np.flatnonzero(~(fresh & np.concatenate([fresh[1:], [True]])))
    k = 7
    while len(slots):
        at = order[slots]
        group = rank[at]
        ahead = at + k
        following = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
        o = np.lexsort((following, group))
        at, group, following = at[o], group[o], following[o]
        order[slots] = at
        fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (following[1:] != following[:-1])])
        rank[at] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))]
        slots = slots[~(fresh & np.concatenate([fresh[1:], [True]]))]
        k *= 2
    return order


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of a byte text, with suffix positions sampled at both ends of each run."""

    def __init__(self, text: np.ndarray):
        self.text, n = text, len(text)
        order = suffix_array(text)
        before = np.where(order > 0, text[order - 1], START)
        edge = before[1:] != before[:-1]
        first = np.concatenate([[True], edge]) if n else np.zeros(0, dtype=bool)
        last = np.concatenate([edge, [True]]) if n else np.zeros(0, dtype=bool)
        heads, tails = np.flatnonzero(first), np.flatnonzero(last)
        self.letters, self.lengths = before[heads], tails - heads + 1
        self.head_at, self.tail_at = order[heads], order[tails]
        self.head_match = self.common(order[heads], order[heads - 1], heads > 0)
        self.tail_match = self.common(order[tails], order[np.minimum(tails + 1, n - 1)], tails < n - 1)

    @property
    def runs(self) -> int:
        return len(self.letters)

    def common(self, p: np.ndarray, q: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of the suffixes at ``p`` and ``q``; 0 where not valid."""
        t, n = self.text, len(self.text)
        if not hasattr(self, "words"):
            wide = np.zeros(n + 16, dtype=np.uint64)
            wide[:n] = t
            self.words = np.zeros(n + 9, dtype=np.uint64)
            for k in range(8):
                self.words |= wide[k : k + n + 9] << np.uint64(8 * k)
        out = np.zeros(len(p), dtype=np.int64)
        live = np.flatnonzero(valid)
        while len(live):
            x = self.words[np.minimum(p[live] + out[live], n)] ^ self.words[np.minimum(q[live] + out[live], n)]
            bits = x & (~x + np.uint64(1))
            out[live] += np.where(x == 0, 8, np.bitwise_count(bits - np.uint64(1)) // 8)
            going = (x == 0) & (np.maximum(p[live], q[live]) + out[live] < n)
            live = live[going]
        return np.minimum(out, np.where(valid, n - np.maximum(p, q), 0))

    def matching_statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For each position the lengths of its match with the suffix before it in order, and with the one after it; the greater is its longest
        match with any other position.

        A suffix inside a run has its neighbour's match shortened by one letter from the position before, so the values at run ends
        are streamed from left to right.
        """
        n, here = len(self.text), np.arange(len(self.text))
        out = []
        for at, match in ((self.head_at, self.head_match), (self.tail_at, self.tail_match)):
            sampled = np.full(n, -1, dtype=np.int64)
            sampled[at] = at
            sampled = np.maximum.accumulate(sampled)
            value = np.zeros(n, dtype=np.int64)
            value[at] = match
            out.append(value[sampled] - (here - sampled))
        return out[0], out[1]

    def occurrences(self, pattern: bytes) -> int:
        """Number of places of ``pattern``, by backward search over the runs."""
        ends = np.cumsum(self.lengths)
        starts = ends - self.lengths
        counts = {int(c): int((self.text == c).sum()) for c in np.unique(self.text)}
        below, total = {}, 1  # the empty suffix sorts first
        for c in sorted(counts):
            below[c], total = total, total + counts[c]
        tail_letter = int(self.text[-1]) if len(self.text) else -1

        def rank(c: int, i: int) -> int:  # places of c among the first i rows; row 0 is the empty suffix
            if i <= 0:
                return 0
            mine = self.letters == c
            full = np.minimum(ends[mine], i - 1) - np.minimum(starts[mine], i - 1)
            return int(full.sum()) + (tail_letter == c)

        lo, hi = 0, len(self.text) + 1
        for c in reversed(pattern):
            if c not in below:
                return 0
            lo, hi = below[c] + rank(c, lo), below[c] + rank(c, hi)
            if lo >= hi:
                return 0
        return hi - lo


BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []
#: Windows of a long text that are worked on at once; positions in a stretch take 20 bits.
STRETCH = 1 << 19


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 15)
        with np.errstate(over="ignore"):
            up = np.full(size, BASE, dtype=np.uint64)
            down = np.full(size, pow(BASE, -1, 1 << 64), dtype=np.uint64)
            up[0] = down[0] = 1
            _POWERS[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POWERS[0][:n], _POWERS[1][:n]


def anchors(raw: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hashes (signed) with the byte ranges of their segments: every window of ``length`` bytes lies in one."""
    out: list[tuple] = []
    windows = len(raw) - length + 1
    for base in range(0, windows, STRETCH):
        part = raw[base : min(windows, base + STRETCH) + length - 1]
        up, down = powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * down[: len(part)], out=sums[1:])
        h = (sums[gram:] - sums[:-gram]) * up[: len(part) - gram + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        least = (h & ~np.uint64((1 << 20) - 1)) | np.arange(len(h), dtype=np.uint64)
        span, step = length - gram + 1, 1
        while step * 2 <= span:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if span > step:
            least = np.minimum(least[: len(least) - (span - step)], least[span - step :])
        at = (least & np.uint64((1 << 20) - 1)).astype(np.int64)
        starts = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
        ends = np.concatenate([starts[1:], [len(at)]])
        out.append((h[at[starts]].view(np.int64), base + starts, base + ends - 1 + length))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def find_anchors(rows: pa.RecordBatch, control: list, rid: str, text: str, length: int) -> pa.RecordBatch:
    """h, rid, a, b of the segments; h is null for ranges that stand twice within their text. Rows in control are left out."""
    out = []
    ids = rows.column(rows.schema.get_field_index(rid)).to_numpy()
    skip = np.isin(ids, control[0])
    for i, raw in enumerate(rows.column(rows.schema.get_field_index(text)).cast(pa.large_binary())):
        if skip[i] or not raw.is_valid or len(buffer := raw.as_buffer()) < length:
            continue
        t = np.frombuffer(buffer, dtype=np.uint8)
        h, a, b = anchors(t, length)
        keep, local = np.ones(len(h), dtype=bool), []
        order = np.argsort(h, kind="stable")
        same = h[order[1:]] == h[order[:-1]]
        if same.any():
            again = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
            seen: dict = {}
            for j in again:
                first = seen.setdefault((h[j], t[a[j] : b[j]].tobytes()), j)
                if first != j:
                    keep[j] = False
                    local += [first, j]
        local = np.unique(np.array(local, dtype=np.int64))
        out.append((h[keep], np.full(keep.sum(), ids[i]), a[keep], b[keep], np.zeros(keep.sum(), dtype=bool)))
        if len(local):
            out.append((h[local], np.full(len(local), ids[i]), a[local], b[local], np.ones(len(local), dtype=bool)))
    if not out:
        return None
    h, r, a, b, null = (np.concatenate(x) for x in zip(*out, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(h, mask=null), pa.array(r), pa.array(a), pa.array(b)], names=["h", "rid", "a", "b"])


def cut(rows: pa.RecordBatch, control: list, rid: str, text: str) -> pa.RecordBatch:
    """h, bucket, several, rid, a, s: the bytes of the segments in control (c is the anchor, d the number of its buckets)."""
    if not len(control[0]):
        return None
    ids = rows.column(rows.schema.get_field_index(rid)).to_numpy()
    texts = rows.column(rows.schema.get_field_index(text)).cast(pa.large_binary())
    r, a, b, h, d = control
    spread = (r.astype(np.uint64) * np.uint64(BASE) + a.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
    bucket = ((spread >> np.uint64(33)) % d.astype(np.uint64)).astype(np.int64)
    raws = [texts[row].as_buffer() for row in range(len(ids))] if len(r) > len(ids) else None
    at = np.searchsorted(ids, r).tolist()
    s = [(raws[row] if raws else texts[row].as_buffer())[x:y].to_pybytes() for row, x, y in zip(at, a.tolist(), b.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(h), pa.array(bucket), pa.array(d > 1), pa.array(r), pa.array(a), pa.array(s, pa.binary())], names=["h", "bucket", "several", "rid", "a", "s"])


def match_segments(batches: Iterator[pa.RecordBatch], length: int, block: int) -> Iterator[pa.RecordBatch]:
    """MATCHES, from segments sorted by anchor and bucket: ranges (rid, a, b) of windows that stand twice or more in their bucket, and, without b,
    the different windows of anchors with several buckets by digest (h, g): with their place if they stand once in the bucket."""
    ranges: list[tuple] = []
    windows: list[tuple] = []
    waiting: list[tuple[bytes, list, bool]] = []
    size = 0

    def settle(group: dict[bytes, list], several: bool) -> None:
        nonlocal size
        for s, places in group.items():
            if len(places) > 1:
                ranges.extend((r, a, a + len(s)) for r, a in places)
        if len(group) > 1 or several:
            bytes_ = sum(map(len, group))
            if size and size + bytes_ > block:
                index()
            waiting.extend((s, places, several) for s, places in group.items())
            size += bytes_

    def index() -> None:
        nonlocal size
        text = np.frombuffer(b"\xff".join([*(s for s, *_ in waiting), b""]), dtype=np.uint8)
        before, after = RunLengthIndex(text).matching_statistics()
        first, twice = before < length, np.maximum(before, after) >= length
        at = 0
        for s, places, several in waiting:
            n = len(s) - length + 1
            if len(places) == 1:
                (r, a), *_ = places
                edges = np.diff(np.concatenate([[0], twice[at : at + n].astype(np.int8), [0]]))
                ranges.extend((r, a + x, a + y - 1 + length) for x, y in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True))
            if several:
                for i in np.flatnonzero(first[at : at + n]).tolist():
                    d = hashlib.blake2b(s[i : i + length], digest_size=16).digest()
                    alone = len(places) == 1 and not twice[at + i]
                    windows.append((int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True), *((places[0][0], places[0][1] + i) if alone else (None, None))))
            at += len(s) + 1
        waiting.clear()
        size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        names = ["h", "g", "rid", "a", "b"]
        for rows, have in ((ranges, names[2:]), (windows, names[:4])):
            if rows:
                columns = dict(zip(have, zip(*rows, strict=True), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns.get(c, [None] * len(rows)), pa.int64()) for c in names], names=names)
                rows.clear()

    last, group = (None, None, False), {}
    for b in batches:
        for h, bucket, several, r, a, s in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
            if h != last[0] or bucket != last[1]:
                settle(group, last[2])
                last, group = (h, bucket, several), {}
                if len(ranges) + len(windows) > 50_000:
                    yield from flush()
            group.setdefault(s, []).append((r, a))
    settle(group, last[2])
    if waiting:
        index()
    yield from flush()


MATCHES = "h long, g long, rid long, a long, b long"


def joined_windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """rid, a, b of the runs of windows (rid, a, sorted) that overlap or touch; runs may be cut between batches."""
    for b in batches:
        r, a = b.column(0).to_numpy(), b.column(1).to_numpy()
        if len(r):
            new = np.concatenate([[True], (r[1:] != r[:-1]) | (a[1:] > a[:-1] + length)])
            first, last = np.flatnonzero(new), np.concatenate([np.flatnonzero(new)[1:] - 1, [len(r) - 1]])
            yield pa.RecordBatch.from_arrays([pa.array(r[first]), pa.array(a[first]), pa.array(a[last] + length)], names=["rid", "a", "b"])


def repeated_ranges(store: RowStore, text: str, length: int, block: int = BLOCK, bucket: int = BUCKET) -> DataFrame:
    """rid, a, b: byte ranges whose union is what is covered by strings of ``length`` bytes that start twice or more."""
    spark, rid = store.spark, store.rid
    shown = store.df.select(F.col(rid).alias("rid"), F.octet_length(text).cast("long").alias("size"), F.sha2(F.col(text), 256).alias("same")).where(F.col("size") >= length)
    several = shown.groupBy("same").agg(F.count("*").alias("n"), F.min("rid").alias("kept")).where("n > 1").select("same", "kept")
    copies = materialise(shown.join(several, "same").select("rid", "size", (F.col("rid") == F.col("kept")).alias("kept")), "copies")
    whole = copies.select("rid", F.lit(0).cast("long").alias("a"), F.col("size").alias("b"))
    found = materialise(store.run(copies.where("not kept").select("rid"), lambda rows, control: find_anchors(rows, control, rid, text, length), "h long, rid long, a long, b long", [text]), "anchors")
    counts = materialise(found.where("h is not null").groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h", F.ceil(F.col("n") / bucket).alias("d")), "counts")
    wanted = found.join(counts, "h").select("rid", "a", "b", F.col("h").alias("c"), "d")
    pieces = store.run(wanted, lambda rows, control: cut(rows, control, rid, text), "h long, bucket long, several boolean, rid long, a long, s binary", [text])
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    segments = pieces.repartition(width, "h", "bucket").sortWithinPartitions("h", "bucket")
    matches = segments.mapInArrow(lambda it: match_segments(it, length, block), MATCHES)
    frequent = not counts.where("d > 1").isEmpty()
    if frequent:
        matches = materialise(matches, "matches")
    out = whole.unionByName(found.where("h is null").select("rid", "a", "b")).unionByName(matches.where("b is not null").select("rid", "a", "b"))
    if frequent:
        windows = matches.where("b is null")
        twice = windows.groupBy("h", "g").agg(F.count("*").alias("n")).where("n > 1").select("h", "g")
        again = windows.where("rid is not null").join(twice, ["h", "g"]).select("rid", "a").repartition(width, "rid").sortWithinPartitions("rid", "a")
        out = out.unionByName(again.mapInArrow(lambda it: joined_windows(it, length), "rid long, a long, b long"))
    return materialise(out, "ranges")


def removed(ids: np.ndarray, control: list) -> Iterator[list[tuple[int, int]]]:
    """For each row the merged ranges."""
    lo, hi = np.searchsorted(control[0], ids, "left"), np.searchsorted(control[0], ids, "right")
    for x, y in zip(lo, hi, strict=True):
        merged: list[list[int]] = []
        for a, b in zip(control[1][x:y].tolist(), control[2][x:y].tolist(), strict=True):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        yield merged


def kept_bytes(raw: bytes, ranges: list) -> bytes:
    if not ranges:
        return raw
    edges = [0, *(x for r in ranges for x in r), len(raw)]
    return b"".join([raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])


def dedup_report(df: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row for each row of ``df``.

    A null text is empty. Texts under ``length`` bytes lose nothing; repeated rows lose all of a text of ``length`` bytes or more. A null key stays null; an
    empty table gives no rows; only the text and the key are read. A very long text is searched whole, in stretches that overlap by a window; one worker holds it.
    """
    store = RowStore.write(df.select(df[key].cast("long").alias("doc_id"), df[text].alias("text")), "suffix")
    name = store.rid

    def report(rows: pa.RecordBatch, control: list) -> pa.RecordBatch:
        ids = rows.column(rows.schema.get_field_index(name)).to_numpy()
        raws = [x or b"" for x in rows.column(rows.schema.get_field_index("text")).cast(pa.large_binary()).to_pylist()]
        out = [(len(raw), sum(b - a for a, b in ranges), len(ranges), hashlib.sha256(kept_bytes(raw, ranges)).hexdigest()) for raw, ranges in zip(raws, removed(ids, control), strict=True)]
        n, gone, spans, sha = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index("doc_id")), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return store.run(repeated_ranges(store, "text", length), report, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", ["doc_id", "text"])


def drop_repeats(df: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """``df`` without the repeated bytes of its texts. A character that a removal cuts through is dropped whole; null stays null.

    Repeated rows of ``length`` bytes or more become empty texts, as each is a copy of the other; an empty table gives no rows; all other columns stay as they are.
    """
    store = RowStore.write(df, "suffix")
    name, names = store.rid, df.columns

    def strip(rows: pa.RecordBatch, control: list) -> pa.RecordBatch:
        ids = rows.column(rows.schema.get_field_index(name)).to_numpy()
        at = rows.schema.get_field_index(text)
        raws = rows.column(at).cast(pa.large_binary()).to_pylist()
        texts = [None if raw is None else kept_bytes(raw, ranges).decode("utf-8", "ignore") for raw, ranges in zip(raws, removed(ids, control), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else rows.column(i) for i in range(len(names))], names=names)

    return store.run(repeated_ranges(store, text, length), strip, df.schema, names)
