"""Pairs of sets whose Jaccard overlap reaches a bound, by prefix filtering: none is missed.

Elements have one global order, those that many sets hold last: first those that are frequent in a sample, then, counted over all sets, those that many prefixes
hold. Of sets with Jaccard ``t`` or more, the first ``n - ceil(t n) + 1`` elements of both share one, so only these are joined, and the first one that they share
leaves enough elements behind it in both. What the order is decides how much is compared, never which pairs are found.

Pairs are first tried on *sketches*: the parities of the numbers of a set's elements in BITS cells. Two sets differ in at least as many elements as their sketches in
bits, so a pair that is ruled out can't reach ``t``. The others are counted on whole sets.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import itertools
import operator
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sets in the sample, and the most elements that it may name as frequent (driver and tasks hold them).
SAMPLE, FREQUENT = 4_000, 50_000
#: An element in more prefixes than this goes behind those of fewer; they are counted over a share of all sets, one in so many.
COMMON, COUNTED = 32, 8
#: Up to so many such elements are listed (driver and tasks hold them); more are joined with the sets' elements.
LISTED = 200_000
#: Cells of a sketch.
BITS = 2048
SKETCH = [f"k{i}" for i in range(BITS // 64)]
SKETCH_SCHEMA = "id long, n long, " + ", ".join(f"{k} long" for k in SKETCH)
#: Rounds in which each set is compared with some of the sets that it shares elements with, before all of them are; and how many of them.
ROUNDS, HUBS = 2, 3

#: Cuts the lineage of a table; its attribute ``drop``, if there is one, removes such a table.
Keep = Callable[[DataFrame, str], DataFrame]
#: The sets (id long, s array<long> without repeats) that a table of ids names; or, with a function of their record batches and its schema, what it makes of
#: them. Where the table has rows (id, e, w), several for an id, the batches have them as lists e and w.
Fetch = Callable[..., DataFrame]


def frequent(ids: DataFrame, fetch: Fetch) -> np.ndarray:
    """Elements that three sets or more of a sample hold, from the rarest on."""
    share = max(1, ids.count() // SAMPLE)
    sample = fetch(ids.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0))
    some = sample.select(F.explode("s").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n >= 3")
    found = some.orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    return found.column("h").to_numpy()[::-1]



def weights(b: pa.RecordBatch, h: np.ndarray, row: np.ndarray, listed: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The weight of each element of a batch's sets, from a list (elements, sorted, and weights) or from the batch's e and w; 0 where none names it."""
    out = np.zeros(len(h), dtype=np.int64)
    if len(listed[0]) and len(h):
        at = np.minimum(np.searchsorted(listed[0], h), len(listed[0]) - 1)
        out = np.where(listed[0][at] == h, listed[1][at], 0)
    if b.num_columns > 2:
        e, w = b.column(2), b.column(3)
        named, of = e.flatten().to_numpy(), np.repeat(np.arange(b.num_rows), np.diff(e.offsets.to_numpy()))
        flag = np.concatenate([np.zeros(len(h), dtype=bool), np.ones(len(named), dtype=bool)])
        order = np.lexsort((flag, np.concatenate([h, named]), np.concatenate([row, of])))  # a named one follows the element itself
        at = np.flatnonzero(flag[order])
        out[order[at - 1]] = w.flatten().to_numpy()[order[at] - len(h)]
    return out


def elements(b: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([b.column(1).flatten(), pa.array(np.repeat(b.column(0).to_numpy(), np.diff(b.column(1).offsets.to_numpy())))], names=["h", "id"])


def sketch(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sketches, a row each, of sets of n elements that stand in h one after the other."""
    cell = ((h.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)
    odd = np.bincount(np.repeat(np.arange(len(n)), n) * BITS + cell, minlength=len(n) * BITS) & 1
    return np.packbits(odd.reshape(len(n), BITS).astype(bool), axis=1).view(np.int64)


def sketches(b: pa.RecordBatch) -> pa.RecordBatch:
    """Sketches of a batch of sets (id, s): SKETCH_SCHEMA."""
    n = np.diff(b.column(1).offsets.to_numpy()).astype(np.int64)
    made = sketch(b.column(1).flatten().to_numpy(), n)
    return pa.RecordBatch.from_arrays([b.column(0), pa.array(n), *(pa.array(np.ascontiguousarray(c)) for c in made.T)], names=["id", "n", *SKETCH])


def prefixes(ids: DataFrame, fetch: Fetch, t: float, keep: Keep) -> tuple[DataFrame, Callable[[], None]]:
    """(h, id, n, p): the elements of each set of n that stand first in the global order, with their place p there; and what removes the table behind them."""
    late = frequent(ids, fetch)
    by_value = np.argsort(late, kind="stable")
    values, ranks = late[by_value], by_value + 1

    nothing = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def first(b: pa.RecordBatch, listed: tuple = nothing) -> pa.RecordBatch:
        s = b.column(1)
        h, n = s.flatten().to_numpy(), np.diff(s.offsets.to_numpy())
        rank = np.zeros(len(h), dtype=np.int64)
        if len(values) and len(h):
            at = np.minimum(np.searchsorted(values, h), len(values) - 1)
            rank = np.where(values[at] == h, ranks[at], 0)
        row = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((h, weights(b, h, row, listed), rank, row))
        place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
        chosen = place < (n - np.ceil(n * t - 1e-9).astype(np.int64) + 1)[row]
        some, place = order[chosen], place[chosen]
        return pa.RecordBatch.from_arrays([pa.array(h[some]), pa.array(b.column(0).to_numpy()[row[some]]), pa.array(n[row[some]].astype(np.int64)), pa.array(place), pa.array(rank[some] > 0)], names=["h", "id", "n", "p", "late"])

    schema = "h long, id long, n long, p long, late boolean"
    rows = keep(fetch(ids, first, schema), "prefixes")
    counted = rows.where("not late").where(F.pmod(F.xxhash64("id"), F.lit(COUNTED)) == 0)  # for the order only
    common = keep(counted.groupBy("h").agg(F.count("*").alias("w")).where(F.col("w") * COUNTED > COMMON), "common")
    touched = keep(rows.join(common, "h", "left_semi").select("id").distinct(), "touched")
    if common.count() <= LISTED:
        table = common.orderBy("h").toArrow()
        listed = table.column("h").to_numpy(), table.column("w").to_numpy()
        again = fetch(touched, lambda b: first(b, listed), schema)
    else:
        named = keep(fetch(touched, elements, "h long, id long").hint("merge").join(common, "h").select("id", F.col("h").alias("e"), "w"), "named")
        again = fetch(named, first, schema)
    return rows.join(touched, "id", "left_anti").unionByName(again).select("h", "id", "n", "p"), lambda: getattr(keep, "drop", lambda _: None)(rows)


#: Sets of one element up to which all their pairs are tried at once, and rows of one element that are held until its last.
FEW, HELD = 8, 10_000


def alive(b: pa.RecordBatch, t: float) -> pa.RecordBatch:
    """Of whole groups of one element (h, id, n, p, sorted by h), the rows that can reach t with another one, and all rows of groups of more than FEW."""
    h, n, p = (b.column(i).to_numpy() for i in (0, 2, 3))
    keep = np.zeros(len(h), dtype=bool)
    for d in range(1, min(FEW, len(h))):
        at = np.flatnonzero(h[d:] == h[:-d])
        x, y = n[at], n[at + d]
        good = at[(np.minimum(x, y) >= np.maximum(x, y) * t - 1e-9) & (np.minimum(x - p[at], y - p[at + d]) >= (x + y) * (t / (1 + t)) - 1e-9)]
        keep[good] = keep[good + d] = True
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    sizes = np.diff(np.append(starts, len(h)))
    return b.filter(pa.array(keep | np.repeat(sizes > FEW, sizes)))


def runs(batches: Iterator[pa.RecordBatch], t: float) -> Iterator[pa.RecordBatch]:
    """``alive`` of rows sorted by the first column; groups may go over batches."""
    held, large = None, None  # rows of the last element so far; an element whose rows are given out as they come
    for b in batches:
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            held = None
        h = b.column(0).to_numpy()
        if large is not None:
            more = int((h == large).sum())
            if more:
                yield b.slice(0, more)
            b, h = b.slice(more), h[more:]
        if not len(h):
            continue
        large = None
        last = int(np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))[-1])
        if last:
            yield alive(b.slice(0, last), t)
        held = b.slice(last)
        if held.num_rows > HELD:
            yield held
            held, large = None, h[-1]
    if held is not None:
        yield alive(held, t)


def shared(ids: DataFrame, fetch: Fetch, t: float, keep: Keep) -> DataFrame:
    """Prefix elements (h, id, n, p) that another set has with which a set can reach t."""
    rows, drop = prefixes(ids, fetch, t, keep)
    out = matched(rows, t, keep)
    drop()
    return out


def matched(rows: DataFrame, t: float, keep: Keep) -> DataFrame:
    """Of prefix elements (h, id, n, p), those that another set has with which a set can reach t."""
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(width, "h").sortWithinPartitions("h")
    return keep(dealt.mapInArrow(lambda batches: runs(batches, t), "h long, id long, n long, p long"), "shared")


def partners(b: pa.RecordBatch) -> pa.RecordBatch:
    """A set once for each id that it is to be compared with (e)."""
    at = pa.array(np.repeat(np.arange(b.num_rows), np.diff(b.column(2).offsets.to_numpy())))
    return pa.RecordBatch.from_arrays([b.column(2).flatten(), b.column(0).take(at), b.column(1).take(at)], names=["u", "v", "b"])


def possible(pairs: DataFrame, t: float, brief: DataFrame) -> DataFrame:
    """(u, v, apart) of the pairs that their sketches (``brief``: SKETCH_SCHEMA, of all sets) don't rule out, with the bits in which these differ."""
    left = brief.select(F.col("id").alias("u"), F.col("n").alias("nu"), *(F.col(k).alias(f"a{k}") for k in SKETCH))
    right = brief.select(F.col("id").alias("v"), F.col("n").alias("nv"), *(F.col(k).alias(f"b{k}") for k in SKETCH))
    apart = functools.reduce(operator.add, (F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}"))) for k in SKETCH))
    both = pairs.join(left, "u").join(right, "v").select("u", "v", "nu", "nv", apart.alias("apart"))
    return both.where(F.col("apart") <= (F.col("nu") + F.col("nv")) * ((1 - t) / (1 + t)) + 1e-9).select("u", "v", "apart")


def verified(pairs: DataFrame, fetch: Fetch, t: float, keep: Keep) -> DataFrame:
    """(u, v, jaccard) of the pairs whose Jaccard, counted on whole sets, is t or more."""
    pairs = keep(pairs.select("u", "v"), "pairs")
    # no size is known of what comes out of Python, so neither side may be broadcast
    left = fetch(pairs.select(F.col("u").alias("id")).distinct()).select(F.col("id").alias("u"), F.col("s").alias("a"))
    right = fetch(pairs.select(F.col("v").alias("id"), F.col("u").alias("e"), F.lit(0).cast("long").alias("w")), partners, "u long, v long, b array<long>")
    both = right.join(left.hint("merge"), "u").select("u", "v", F.size(F.array_intersect("a", "b")).alias("x"), (F.size("a") + F.size("b")).alias("n"))
    return both.select("u", "v", (F.col("x") / (F.col("n") - F.col("x"))).alias("jaccard")).where(F.col("jaccard") >= t)


def reaching(t: float, n: str, p: str, m: str, q: str):
    """Whether sets of n and m elements that share their elements at the places p and q, and none before, can reach t."""
    n, p, m, q = map(F.col, (n, p, m, q))
    size = F.least(n, m) >= F.greatest(n, m) * t - 1e-9
    return size & (F.least(n - p, m - q) >= (n + m) * (t / (1 + t)) - 1e-9)


def candidates(rows: DataFrame, t: float) -> DataFrame:
    """(u, v), u < v, that may reach t: pairs of ``shared`` rows (with a column ``part``) of different parts. Of each element's sets, those
    outside the part that holds most of them are paired with all."""
    most = rows.groupBy("h", "part").agg(F.count("*").alias("m")).groupBy("h").agg(F.count("*").alias("parts"), F.max_by("part", F.struct("m", "part")).alias("large")).where("parts > 1")
    rows = rows.join(most.select("h", "large"), "h")
    left = rows.where("part <> large").select("h", F.col("id").alias("u"), F.col("n").alias("nu"), F.col("p").alias("pu"), F.col("part").alias("of"))
    right = rows.select("h", F.col("id").alias("v"), F.col("n").alias("nv"), F.col("p").alias("pv"), "part", (F.col("part") == F.col("large")).alias("most"))
    pairs = left.join(right, "h").where("of <> part AND (most OR u < v)").where(reaching(t, "nu", "pu", "nv", "pv"))
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


#: Elements that a task packs at once, and about as many to a bucket.
PACKED, BUCKET = 2_000_000, 4_000_000
PACKED_SCHEMA = "bucket int, k long, m long, h binary, doc binary, ids binary, ns binary"


def shingles(text: str | None, width: int) -> np.ndarray:
    """Distinct hashes of ``width``-word shingles of words with spaces between them, sorted; none of a shorter text."""
    import xxhash

    words = [w for w in (text or "").encode("utf-8", "surrogatepass").split(b" ") if w]
    if len(words) < width:
        return np.zeros(0, dtype=np.int64)
    each = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), dtype=np.uint64, count=len(words))
    h = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for i in range(width):
        h = (h ^ each[i : len(words) - width + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return np.unique(h.view(np.int64))


def briefs(texts: DataFrame, width: int) -> DataFrame:
    """id, a digest (d, e) of a text's shingles, and their number and sketch, of each text (id, text) that has any."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t, width) for t in b.column(1).to_pylist()]
            n = np.array([len(x) for x in sets], dtype=np.int64)
            some = [x for x in sets if len(x)]
            if not some:
                continue
            d = np.frombuffer(b"".join(hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in some), dtype="<i8").reshape(-1, 2)
            k = np.concatenate([sketch(x, np.array([len(x)])) for x in some])
            made = [pa.array(np.ascontiguousarray(c)) for c in (d[:, 0], d[:, 1], n[n > 0], *k.T)]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(n > 0)), *made], names=["id", "d", "e", "n", *SKETCH])

    return texts.mapInArrow(task, "id long, d long, e long, n long, " + ", ".join(f"{k} long" for k in SKETCH))


def squeezed(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), codec="zstd", asbytes=True)


def unsqueezed(x: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    flat = np.frombuffer(pa.decompress(x, n * size, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(flat.reshape(size, n).T).view(kind).ravel()


def packs(ids: list, sets: list, buckets: int) -> Iterator[pa.RecordBatch]:
    """Sets dealt to buckets by ranges of their elements: of each bucket the sorted elements' differences, and which of some ids (and of how many) has each."""
    ids, ns = np.array(ids, dtype=np.int64), np.array([len(x) for x in sets], dtype=np.uint32)
    h, doc = np.concatenate(sets).view(np.uint64), np.repeat(np.arange(len(sets), dtype=np.uint32), ns)
    order = np.argsort(h, kind="stable")
    h, doc = h[order], doc[order]
    cuts = np.searchsorted((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
    rows = []
    for bucket in np.flatnonzero(np.diff(cuts)):
        mine, at = h[cuts[bucket] : cuts[bucket + 1]], doc[cuts[bucket] : cuts[bucket + 1]]
        some, at = np.unique(at, return_inverse=True)
        gaps = [np.diff(mine, prepend=np.uint64(0)), at.astype(np.uint32), np.diff(ids[some], prepend=0), ns[some]]
        rows.append((int(bucket), len(mine), len(some), *map(squeezed, gaps)))
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4))], names=["bucket", "k", "m", "h", "doc", "ids", "ns"])


def held_by_several(rows: list) -> Iterator[pa.RecordBatch]:
    """(id, n, h, w): a bucket's elements that w > 1 sets have."""
    h, ids, ns = [], [], []
    for r in rows:
        at = unsqueezed(r["doc"], r["k"], np.uint32)
        h.append(np.cumsum(unsqueezed(r["h"], r["k"], np.uint64), dtype=np.uint64))
        ids.append(np.cumsum(unsqueezed(r["ids"], r["m"], np.int64))[at])
        ns.append(unsqueezed(r["ns"], r["m"], np.uint32)[at])
    h, ids, ns = map(np.concatenate, (h, ids, ns))
    order = np.argsort(h, kind="stable")
    h = h[order]
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    w = np.diff(np.append(starts, len(h)))
    w = np.repeat(w, w)
    some = np.flatnonzero(w > 1)
    for i in range(0, len(some), 100_000):
        x = some[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (ids[order[x]], ns[order[x]].astype(np.int64), h[x].view(np.int64), w[x].astype(np.int64))], names=["id", "n", "h", "w"])


def common(texts: DataFrame, width: int, elements: int) -> DataFrame:
    """(id, n, h, w): the shingles h that w > 1 of the texts (id, text) have, with each one's number n of all its shingles. Only packed buckets are shuffled."""
    buckets = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), elements // BUCKET + 1)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sets, size = [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = shingles(t, width)
                if len(s):
                    ids.append(i), sets.append(s)
                    size += len(s)
                if size >= PACKED:
                    yield from packs(ids, sets, buckets)
                    ids, sets, size = [], [], 0
        if ids:
            yield from packs(ids, sets, buckets)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in b.to_pylist())
        for _, mine in itertools.groupby(rows, lambda r: r["bucket"]):
            yield from held_by_several(list(mine))

    dealt = texts.mapInArrow(pack, PACKED_SCHEMA).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(unpack, "id long, n long, h long, w long")


def released(df: DataFrame) -> None:
    """Let the driver's collector find the shuffles that nothing reads any more, so that Spark removes their files."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def similar(texts: DataFrame, brief: DataFrame, width: int, t: float, keep: Keep) -> DataFrame:
    """(u, v, jaccard), u < v, of all pairs of the texts (id, text) whose shingles reach Jaccard t; ``brief`` has their sketches (SKETCH_SCHEMA).

    Elements of one set alone can't be common to two. So they come first in the order, which goes by how many sets hold an element, and only their number is kept: a set
    with fewer than t n other elements is in no pair, and the overlap of two is that of what else they hold. Pairs are counted in rounds of half as many as there are sets.
    """
    count, elements = brief.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    need = F.ceil(F.col("n") * t - 1e-9)
    lists = common(texts, width, elements).repartition("id").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("w", "h"))).alias("x"))
    held = keep(lists.where(F.size("x") >= need).select("id", "n", F.col("x.h").alias("s")), "held")
    released(held)
    first = held.select("id", "n", F.size("s").alias("k"), F.posexplode(F.slice("s", F.lit(1), (F.size("s") - need + 1).cast("int"))).alias("i", "h"))
    rows = matched(first.select("h", "id", "n", (F.col("n") - F.col("k") + F.col("i")).alias("p")), t, keep)
    pairs = keep(candidates(rows.withColumn("part", F.col("id")), t), "candidates")
    released(pairs)
    rounds = 2 * pairs.count() // max(count, 20_000) + 1
    found = []
    for turn in range(rounds):
        some = keep(possible(pairs.where(F.pmod(F.xxhash64("u", "v"), F.lit(rounds)) == turn), t, brief).select("u", "v"), "possible")
        left = held.join(some.select(F.col("u").alias("id")).distinct(), "id").select(F.col("id").alias("u"), F.col("n").alias("nu"), F.col("s").alias("a"))
        right = held.join(some.withColumnRenamed("v", "id"), "id").select("u", F.col("id").alias("v"), F.col("n").alias("nv"), F.col("s").alias("b"))
        both = right.join(left, "u").select("u", "v", F.size(F.array_intersect("a", "b")).alias("x"), (F.col("nu") + F.col("nv")).alias("n"))
        found.append(keep(both.select("u", "v", (F.col("x") / (F.col("n") - F.col("x"))).alias("jaccard")).where(F.col("jaccard") >= t), "counted"))
        del some, left, right, both
        released(held)
    return functools.reduce(DataFrame.unionByName, found)


def hubs(rows: DataFrame, t: float, turn: int) -> DataFrame:
    """(u, v): sets v (rows as for ``candidates``) with the sets u of other parts that share most with them, of those that are drawn from an element's sets: HUBS
    each, at random, but for the last among those where the element stands first. These have the fewest rare elements, so they are nearest to the others."""
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(width, "h")  # both sides of the join read this shuffle
    one = lambda k: F.min_by(F.struct(F.lit(k).alias("k"), F.col("id").alias("u"), F.col("n").alias("nu"), F.col("p").alias("pu"), F.col("part").alias("of")), F.struct(F.col("p") if k < HUBS - 1 else F.lit(0), F.xxhash64("id", F.lit(turn * HUBS + k))))
    drawn = rows.groupBy("h").agg(F.min("part").alias("a"), F.max("part").alias("b"), F.array(*map(one, range(HUBS))).alias("hubs")).where("a <> b").select("h", "hubs")
    some = rows.join(drawn, "h").select("id", "n", "p", "part", F.explode("hubs").alias("hub")).select("id", "n", "p", "part", "hub.*")
    some = some.where("part <> of").where(reaching(t, "n", "p", "nu", "pu"))
    best = some.groupBy("id", "k", "u").agg(F.count("*").alias("m")).groupBy("id", "k").agg(F.max_by("u", F.struct("m", "u")).alias("u"))
    return best.select("u", F.col("id").alias("v")).distinct()


def links(ids: DataFrame, fetch: Fetch, t: float, keep: Keep, components: Callable[[DataFrame], DataFrame], brief: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(u, v) whose components are those of all pairs with Jaccard t or more.

    Large groups are first drawn together: each set is compared with the nearest of a few that it shares elements with. After
    that, only pairs of different components are. ``brief`` has all sets' sketches; ``known`` are links that were verified before.
    """
    rows, found = shared(ids, fetch, t, keep), known

    def parted() -> DataFrame:
        if found is None:
            return rows.withColumn("part", F.col("id"))
        roots = keep(components(found), "parts")
        return keep(rows.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("part", F.coalesce("root", "id")).drop("root"), "parted")

    for turn in range(ROUNDS):
        nearest = possible(hubs(parted(), t, turn), t, brief).groupBy("v").agg(F.min_by("u", F.struct("apart", "u")).alias("u"))
        near = keep(verified(nearest, fetch, t, keep).select("u", "v"), "stars")
        found = near if found is None else found.unionByName(near)
    return found.unionByName(verified(possible(candidates(parted(), t), t, brief), fetch, t, keep).select("u", "v"))
