"""Sharding by longest-processing-time scheduling.

Rows of one text form a group. Groups are dealt by hash into blocks; in each block they are sorted by size, largest first, and each goes to the
least-loaded bin through a heap. The blocks' bins are then scheduled onto the shards the same way. So no
task holds more than a heap, and what the last step sees is bounded by blocks times shards.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .store import materialise

#: Most blocks; with ``shards`` it bounds the rows of the last schedule.
MOST_BLOCKS = 4096


def schedule(sizes: Iterator[int], shards: int) -> Iterator[int]:
    """Shard of each size, given largest first: the least loaded, the lowest number of several."""
    heap = [(0, s) for s in range(shards)]
    for n in sizes:
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + n, shard))
        yield shard


def shard(df: DataFrame, shards: int = 8, text: str = "text", key: str = "doc_id", blocks: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law 'bytes', shard, slot, grown_shard (null): one row for each row of ``df``.

    Size is the text's UTF-8 bytes and 1; a null text has no bytes and is a group apart from the empty text's. Slots number a shard's rows from 0 without
    gaps. Repeated rows keep together as equal texts do; a null key stays null; an empty table gives no rows. A group larger than an eighth of
    all sets its shard's size, as groups are never split.
    """
    spark = df.sparkSession
    whole = df[text]
    rows = materialise(df.select(df[key].cast("long").alias("doc_id"), (F.coalesce(F.octet_length(whole), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(whole, F.lit("")).cast("binary")).alias("text_crc32"), F.coalesce(F.sha2(whole, 256), F.lit("")).alias("group")), "rows")
    blocks = min(MOST_BLOCKS, blocks or int(spark.conf.get("spark.sql.shuffle.partitions")))

    def lpt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list] = {}
        for b in batches:
            out = []
            for block, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                heap = heaps.setdefault(block, [(0, s) for s in range(shards)])
                load, at = heap[0]
                heapq.heapreplace(heap, (load + n, at))
                out.append(at)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int32())], names=[*b.schema.names, "bin"])

    groups = rows.groupBy("group").agg(F.sum("size").alias("total")).select("group", F.pmod(F.xxhash64("group"), F.lit(blocks)).cast("int").alias("block"), "total")
    binned = materialise(groups.repartition(blocks, "block").sortWithinPartitions("block", F.desc("total"), "group").mapInArrow(lpt, "group string, block int, total long, bin int"), "bins")
    bins = sorted(((r.total, r.block, r.bin) for r in binned.groupBy("block", "bin").agg(F.sum("total").alias("total")).collect()), key=lambda x: (-x[0], x[1], x[2]))
    placed = [(block, b, s) for (_, block, b), s in zip(bins, schedule((x[0] for x in bins), shards), strict=True)]
    where = spark.createDataFrame(placed, "block int, bin int, shard int")
    by_group = binned.join(F.broadcast(where), ["block", "bin"]).select("group", "shard")  # at most blocks times shards rows

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        count, task = [0] * shards, TaskContext.get().partitionId()
        for b in batches:
            slots = []
            for s in b.column(3).to_pylist():
                slots.append(count[s])
                count[s] += 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([task] * len(slots), pa.int32()), pa.array(slots, pa.int64())], names=[*b.schema.names, "task", "local"])

    numbered = materialise(rows.join(by_group, "group").select("doc_id", "size", "text_crc32", "shard").mapInArrow(number, "doc_id long, size long, text_crc32 long, shard int, task int, local long"), "slots")
    counts = numbered.groupBy("shard", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))  # a row for each task and shard
    return numbered.join(starts, ["shard", "task"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("local")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
