"""SimHash near-duplicates through Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits. Two fingerprints within two bits agree wholly
in one of them (pigeonhole), and in each other one they differ in two bits at most. The
perfect Golay code of length 23 decodes such a segment to the codewords within four bits: one, or six.
Segments within two bits share a codeword, since the nearest one to a word between them is within four bits of
both. So a key is a whole segment with a codeword index of the next one, 3 to 18 keys each.
Buckets are joined on keys and verified.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import overlap
from .components import components
from .store import RowStore, materialise

SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))
RADIUS = 2
#: Fingerprints that more than one in so many rows have; so there are fewer of them, and they may be broadcast.
HOT_SHARE = 1_000
#: Buckets up to this size are compared in pairs, larger ones through the words between their members.
PAIRS = 256
#: Buckets up to this size are held by one task (8 bytes a fingerprint and 520 while it works); beyond it, their members
#: are linked through a shuffle on the words between them, at most 65 fingerprints to each.
HELD = 50_000
#: Generator polynomial of the cyclic Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


def fingerprint(text: str | None) -> int:
    """64 bits of the XXH64 values of three-word shingles, repeats included; zero without words."""
    import xxhash

    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    if len(words) < 3:
        values = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        digest = xxhash.xxh64_intdigest
        values = [digest(a + b" " + b + b" " + c, SEED) for a, b, c in zip(words, words[1:], words[2:])]  # noqa: B905
    return folded(np.array(values, dtype="<u8"))


@cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndrome of each 23-bit word's halves, and by syndrome the error patterns of up to four bits (padded by the first)."""
    def remainder(x: int) -> int:
        for bit in range(22, 10, -1):
            if x >> bit & 1:
                x ^= GENERATOR << (bit - 11)
        return x

    one = [remainder(1 << i) for i in range(23)]
    low, high = np.zeros(4096, dtype=np.int64), np.zeros(2048, dtype=np.int64)
    for table, shift in ((low, 0), (high, 12)):
        for x in range(1, len(table)):
            top = x.bit_length() - 1
            table[x] = table[x ^ (1 << top)] ^ one[shift + top]
    errors: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            s = e = 0
            for b in bits:
                s, e = s ^ one[b], e | 1 << b
            errors[s].append(e)
    assert {len(x) for x in errors} == {1, 6}
    return low, high, np.array([x + x[:1] * (6 - len(x)) for x in errors], dtype=np.int64)



def codewords(words: np.ndarray) -> np.ndarray:
    """For each 23-bit word, the indices (upper 12 bits) of the codewords within four bits; six columns, repeats where there is one."""
    low, high, errors = golay()
    syndrome = low[words & 4095] ^ high[words >> 12]
    return (words[:, None] ^ errors[syndrome]) >> 11


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys and the positions of their fingerprints."""
    parts = [((prints >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    out, rows = [], []
    for i, whole in enumerate(parts):
        near = codewords(parts[(i + 1) % 3])
        keep = np.ones(near.shape, dtype=bool)
        keep[:, 1:] = near[:, 1:] != near[:, :1]
        out.append((((i << 22 | whole)[:, None] << 12) | near)[keep])
        rows.append(np.broadcast_to(np.arange(len(prints))[:, None], near.shape)[keep])
    return np.concatenate(out), np.concatenate(rows)


def stars(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root, member) links that join all of a bucket that are linked within it, a member at most once."""
    m = len(prints)
    label = np.arange(m)
    if m <= PAIRS:
        near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= RADIUS
        i, j = np.nonzero(np.triu(near, 1))
    else:
        between = np.concatenate([prints[:, None], prints[:, None] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))[None, :]], axis=1).ravel()
        order = np.argsort(between, kind="stable")
        same = between[order[1:]] == between[order[:-1]]
        i, j = order[1:][same] // 65, order[:-1][same] // 65
    while len(i):
        least = label.copy()
        np.minimum.at(least, i, label[j])
        np.minimum.at(least, j, label[i])
        np.minimum.at(least, label[i], least[i])
        np.minimum.at(least, label[j], least[j])
        least = least[least]
        if (least == label).all():
            break
        label = least
    moved = np.flatnonzero(label != np.arange(m))
    return prints[label[moved]], prints[moved]


def links(prints: DataFrame) -> DataFrame:
    """(u, v) whose components are those of all pairs of distinct fingerprints (column fp) within RADIUS bits."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy()
            for at in range(0, len(fp), 20_000):
                part = fp[at : at + 20_000]
                key, row = keys(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row])], names=["key", "fp"])

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, v = [], []
            for members in b.column(0):
                root, member = stars(members.values.to_numpy().view(np.uint64))
                u.append(root.view(np.int64))
                v.append(member.view(np.int64))
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])

    keyed = materialise(prints.select("fp").mapInArrow(expand, "key long, fp long"), "golay")
    sizes = materialise(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n > 1"), "buckets")
    two = sizes.where("n = 2").where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS).select("u", "v")
    some = keyed.join(sizes.where((F.col("n") > 2) & (F.col("n") <= HELD)).select("key"), "key").groupBy("key").agg(F.collect_list("fp").alias("members")).select("members")
    out = two.unionByName(some.mapInArrow(bucket, "u long, v long"))
    if not sizes.where(F.col("n") > HELD).isEmpty():
        rest = keyed.join(sizes.where(F.col("n") > HELD).select("key"), "key", "left_semi").select("fp").distinct()
        flips = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(1 << k if k < 63 else -(1 << 63))) for k in range(64)))
        between = rest.select("fp", F.explode(flips).alias("word")).groupBy("word").agg(F.collect_set("fp").alias("members")).where(F.size("members") > 1)
        out = out.unionByName(between.select(F.array_min("members").alias("u"), F.explode("members").alias("v")).where("u <> v"))
    return out


def fingerprints(df: DataFrame, columns: list, text) -> DataFrame:
    """``columns`` of ``df`` with the fingerprint as a signed long ``fp``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column(b.num_columns - 1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp)], names=[*b.schema.names[:-1], "fp"])

    out = df.select(*columns, text.alias("text"))
    schema = ", ".join(f"{c} {t}" for c, t in out.dtypes[:-1]) + ", fp long"
    return out.mapInArrow(task, schema)


def grouped(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` (with fp) and ``component``: the least ``order`` among the rows that they are linked with, directly or not."""
    prints = materialise(rows.groupBy("fp").agg(F.min(order).alias("least"), F.count("*").alias("n")), "prints")
    roots = materialise(components(links(prints)), "roots")
    least = prints.join(roots, F.col("fp") == F.col("node")).groupBy("root").agg(F.min("least").alias("component")).join(roots, "root").select(F.col("node").alias("fp"), "component")
    every = materialise(prints.join(least, "fp", "left").select("fp", F.coalesce("component", "least").alias("component"), "n"), "components")
    total = prints.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(every.where(F.col("n") * HOT_SHARE > total).select("fp", "component"))  # under HOT_SHARE rows
    cold = rows.join(hot.select("fp"), "fp", "left_anti").join(every.select("fp", "component"), "fp")
    return rows.join(hot, "fp").unionByName(cold)


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the least key reachable): one row for each row of ``df``.

    Texts without words, null ones too, have fingerprint zero and are linked with each other. Repeated rows give
    repeated rows. A null key is no component's least while another is there; a component of null keys alone has a null id. An empty table
    gives no rows; other columns are not read.
    """
    rows = materialise(fingerprints(df, [df[key].cast("long").alias("doc_id")], df[text]), "fingerprints")
    return grouped(rows, "doc_id").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Distinct 64-bit hashes of ``width``-word shingles, a shorter text being one; words are those of ``fingerprint``."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.int64)
    digest, some = xxhash.xxh64_intdigest, min(width, len(words))
    each = np.fromiter((digest(w, SEED) for w in words), dtype=np.uint64, count=len(words))
    h = np.full(len(words) - some + 1, some, dtype=np.uint64)
    for i in range(some):
        h = (h ^ each[i : len(words) - some + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return np.unique(h.view(np.int64))


def folded(h: np.ndarray) -> int:
    """The bits that over half of the hashes have; zero without hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 65536):
        ones += np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")


def word_digests(df: DataFrame, columns: list, text, width: int) -> DataFrame:
    """``columns`` of ``df`` with a 128-bit digest (d, e) of the words in order, and of the distinct ``width``-word shingles the fingerprint fp, the number n and the sketch."""

    more = ["d", "e", "fp", "n", *overlap.SKETCH]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, fp, n, brief = [], [], [], []
            for t in b.column(b.num_columns - 1).to_pylist():
                raw.append(hashlib.blake2b(b" ".join((t or "").encode("utf-8", "surrogatepass").lower().split()), digest_size=16).digest())
                s = shingles(t, width)
                fp.append(folded(s)), n.append(len(s)), brief.append(overlap.sketch(s, np.array([len(s)])))
            d = np.frombuffer(b"".join(raw), dtype="<i8").reshape(-1, 2)
            k = np.concatenate(brief) if brief else np.zeros((0, len(overlap.SKETCH)), dtype=np.int64)
            made = [pa.array(x) for x in (d[:, 0].copy(), d[:, 1].copy(), np.array(fp, dtype=np.uint64).view(np.int64), np.array(n, dtype=np.int64), *(c.copy() for c in k.T))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], names=[*b.schema.names[:-1], *more])

    out = df.select(*columns, text.alias("text"))
    schema = ", ".join(f"{c} {t}" for c, t in out.dtypes[:-1]) + "".join(f", {c} long" for c in more)
    return out.mapInArrow(task, schema)


def near_pairs(classes: DataFrame) -> DataFrame:
    """(u, v) of ids whose fingerprints are equal or were linked through Golay keys: candidates, a star for each bucket."""
    named = materialise(classes.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")), "named")
    equal = classes.join(named.where("n > 1"), "fp").where("id <> first").select(F.col("first").alias("u"), F.col("id").alias("v"))
    left, right = named.select(F.col("fp").alias("u"), F.col("first").alias("a")), named.select(F.col("fp").alias("v"), F.col("first").alias("b"))
    near = materialise(links(named), "near").join(left, "u").join(right, "v").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    return equal.unionByName(near).distinct()


def drop_similar(df: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, least: float = 0.8) -> DataFrame:
    """``df`` with one row of each group of texts linked, directly or not, by Jaccard ``least`` or more of their
    ``width``-word shingles: that of the least key, the first of several with it (null keys last).

    Fingerprints of the shingles that Golay keys bring together are verified first. Two bits of 64 do not reach Jaccard 0.8 (such pairs lie some ten bits
    apart), so the groups that they leave apart are compared by prefix filtering (``operators.overlap``), which misses no pair; each link is counted on whole
    shingle sets. Texts without words, null ones too, are one group. An empty table gives no rows; other columns stay as they are. A very long text is one worker's, whole.
    """
    store = RowStore.write(df, "similar")
    rows = materialise(word_digests(store.df, [F.col(store.rid).alias("rid"), store.df[key].cast("long").alias("doc_id")], store.df[text], width), "words")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    brief = F.min_by(F.struct("fp", "n", *overlap.SKETCH), "rid")  # rows of one class have equal ones
    classes = materialise(rows.groupBy("d", "e").agg(F.min(place).alias("place"), F.count("*").alias("rows"), brief.alias("brief")).select("d", "e", "place", "rows", "brief.*"), "classes")
    sketches = classes.select(F.col("place.rid").alias("id"), "n", *overlap.SKETCH)
    name = store.rid

    def sets(rows: pa.RecordBatch, control: list, named: bool) -> pa.RecordBatch:
        ids, at, count = np.unique(control[0], return_index=True, return_counts=True)
        mine = rows.filter(pa.array(np.isin(rows.column(rows.schema.get_field_index(name)).to_numpy(), ids)))
        made = [shingles(t, width) for t in mine.column(mine.schema.get_field_index(text)).to_pylist()]
        columns = [mine.column(mine.schema.get_field_index(name)), pa.array(made, pa.list_(pa.int64()))]
        if named:
            offsets = pa.array(np.append(at, len(control[0])), pa.int32())
            columns += [pa.ListArray.from_arrays(offsets, pa.array(c)) for c in control[1:3]]
        return pa.RecordBatch.from_arrays(columns, names=["id", "s", "e", "w"][: len(columns)])

    def fetch(ids: DataFrame, each=lambda b: b, schema: str = "id long, s array<long>") -> DataFrame:
        named = "e" in ids.columns
        control = ids.select(F.col("id").alias("rid"), *([F.col("e").alias("a"), F.col("w").alias("b")] if named else []))
        return store.run(control, lambda rows, control: each(sets(rows, control, named)) if len(control[0]) else None, schema, [text], batch=500, every=False)

    golay = overlap.possible(near_pairs(classes.select(F.col("place.rid").alias("id"), "fp")), least, sketches)
    known = materialise(overlap.verified(golay, fetch, least, materialise).select("u", "v"), "near")
    roots = materialise(components(overlap.links(classes.select(F.col("place.rid").alias("id")), fetch, least, materialise, components, sketches, known)), "roots")
    firsts = classes.join(roots, F.col("place.rid") == F.col("node"), "left").select("d", "e", "place", "rows", F.coalesce("root", "place.rid").alias("root"))
    kept = firsts.groupBy("root").agg(F.min("place").alias("kept"))
    several = materialise(firsts.join(kept, "root").where("rows > 1 OR place.rid <> kept.rid").select("d", "e", F.col("kept.rid").alias("kept")), "several")
    dropped = rows.join(several, ["d", "e"]).where("rid <> kept").select("rid", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    return without(store, dropped, df)


def drop_near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``df`` with one row of each component of ``near_duplicates``: that of the least key, the first of several with it (null keys last).
    Texts without words, null ones too, are one component; an empty table gives no rows; other columns stay as they are."""
    store = RowStore.write(df, "simhash")
    rows = materialise(fingerprints(store.df, [F.col(store.rid).alias("rid"), store.df[key].cast("long").alias("doc_id")], store.df[text]), "fingerprints")
    ranked = rows.select("rid", "fp", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid").alias("place"))
    dropped = grouped(ranked, "place").where("rid <> component.rid").select("rid", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    return without(store, dropped, df)


def without(store: RowStore, dropped: DataFrame, df: DataFrame) -> DataFrame:
    """The stored ``df`` without the rows that ``dropped`` names."""
    name, at = store.rid, store.df.columns.index(store.rid)

    def keep(rows: pa.RecordBatch, control: list) -> pa.RecordBatch:
        good = rows.filter(pa.array(~np.isin(rows.column(rows.schema.get_field_index(name)).to_numpy(), control[0])))
        return pa.RecordBatch.from_arrays([c for i, c in enumerate(good.columns) if i != at], names=[n for i, n in enumerate(good.schema.names) if i != at])

    return store.run(dropped, keep, df.schema)
