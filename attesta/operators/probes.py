"""Probe windows, probe strings, multi-pattern search and context digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normal

PROBE, STRIDE, CONTEXT = 160, 120, 500
#: Bytes of patterns that one automaton holds; more patterns take more passes over the texts.
BLOCK_BYTES = 4 << 20


def windows(x: Column, size: int = PROBE, stride: int = STRIDE) -> Column:
    """The whole text up to ``size`` characters, else windows at ``stride`` and one that ends with the text."""
    n = F.char_length(x)
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0), n - 1, F.lit(stride)), F.array(n - size)))
    return F.when(n == 0, F.array().cast("array<string>")).when(n <= size, F.array(x)).otherwise(F.transform(F.array_sort(starts), lambda i: F.substring(x, i + 1, size)))


def strings(x: Column) -> Column:
    """Quoted spans and the segments between them that hold a letter or digit and don't end in a colon; distinct, in order."""
    quoted = F.transform(F.regexp_extract_all(x, F.lit("[\"“「]([^\"”」]+)[\"”」]"), F.lit(1)), lambda s: F.trim(s))
    rest = F.filter(F.transform(F.split(x, "[\"“「][^\"”」]+[\"”」]"), lambda s: F.trim(s)), lambda s: s.rlike(r"[\p{L}\p{N}]") & ~F.endswith(s, F.lit(":")))
    return F.array_distinct(F.filter(F.concat(quoted, rest), lambda s: s != ""))


def contained(docs: DataFrame, terms: DataFrame, text: str, key: str, term: str, term_key: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, term_key) for every term that stands in a text: Aho-Corasick over blocks of terms.

    Terms are read block by block, so the driver and a task hold one block at most, and each block is one pass over the texts. Equal terms
    are searched once; empty and null ones match nothing.
    """
    types = dict(docs.dtypes) | {f"t.{k}": v for k, v in terms.dtypes}
    schema = f"{key} {types[key]}, {term_key} {types['t.' + term_key]}"
    out: DataFrame | None = None

    def search(block: dict[str, list]) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(list(block.items()))

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            a = ahocorasick.Automaton()
            for t, ids in shared.value:
                a.add_word(t, ids)
            a.make_automaton()
            for b in batches:
                keys, hits = [], []
                for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    found = {i for _, ids in a.iter(x or "") for i in ids}
                    keys += [k] * len(found)
                    hits += sorted(found)
                yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), pa.array(hits, kind)], names=[key, term_key])

        return docs.select(key, text).mapInArrow(task, schema)

    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[types[f"t.{term_key}"]]
    block: dict[str, list] = {}
    size = 0
    for row in terms.select(term_key, term).where(F.char_length(term) > 0).toLocalIterator():
        if row[1] not in block:
            size += len(row[1].encode())
        block.setdefault(row[1], []).append(row[0])
        if size >= block_bytes:
            out = search(block) if out is None else out.unionByName(search(block))
            block, size = {}, 0
    if block or out is None:
        out = search(block or {"\x00nothing\x00": []}) if out is None else out.unionByName(search(block))
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def context_digests(doc: pd.Series, probes: pd.Series) -> pd.Series:
    """Sorted distinct SHA-256 digests of the 500 characters around every place of every probe."""

    def one(d: str, ps) -> list[str]:
        found = set()
        for p in ps if ps is not None else []:
            at = (d or "").find(p) if p else -1
            while at >= 0:
                found.add(hashlib.sha256(d[max(0, at - CONTEXT) : at + len(p) + CONTEXT].encode("utf-8", "surrogatepass")).hexdigest())
                at = d.find(p, at + 1)
        return sorted(found)

    return pd.Series([one(d, p) for d, p in zip(doc, probes, strict=True)])


@F.pandas_udf(T.ArrayType(T.StringType()))
def wanted(probes: pd.Series) -> pd.Series:
    """Windows of the normalised probes, in order and distinct."""

    def one(p: str) -> list[str]:
        n = len(p)
        return [p[i : i + PROBE] for i in sorted({*range(0, n, STRIDE), n - PROBE})] if n > PROBE else [p] if p else []

    return probes.map(lambda ps: list(dict.fromkeys(w for p in (ps if ps is not None else []) for w in one(normal(p)))))


def digests(probes: Column) -> Column:
    return F.transform(probes, lambda p: F.sha2(p, 256))


def check_status(probes: Column, doc: Column) -> Column:
    """verified, mismatch, unverified (no document) or skipped (no probe)."""
    return F.when(F.size(probes) == 0, "skipped").when(doc.isNull(), "unverified").when(F.forall(probes, lambda p: F.contains(doc, p)), "verified").otherwise("mismatch")


def overall_status(status: Column, enabled: Column | None = None) -> Column:
    """Aggregate of a group's check states: skipped, incomplete without checks, failed, incomplete, passed."""
    count = lambda s: F.count_if(status == s)
    rolled = F.when(F.count(status) == 0, "incomplete").when(count("mismatch") > 0, "failed").when(count("unverified") + count("skipped") > 0, "incomplete").otherwise("passed")
    return rolled if enabled is None else F.when(~F.bool_or(enabled), "skipped").otherwise(rolled)
