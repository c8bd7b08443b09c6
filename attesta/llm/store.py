"""Shared storage for multi-pass operators.

Everything is written below ``spark.checkpoint.dir``, the folder that the driver and all
executors share; a folder of our own is set only where the session has none (tests).
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Root of the shared folder as a URI without a trailing slash."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            found = jdir.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        else:
            found = "file://" + tempfile.mkdtemp(prefix="attesta-")
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and inner path of a URI or of an absolute local path."""
    if re.match(r"file:/[^/]", uri):
        uri = "file://" + uri[5:]
    if "://" in uri:
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write a table in the shared folder and read it back."""
    path = new_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Remove a table that ``materialise`` wrote, when nothing reads it any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        fs, inner = open_fs(folder)
        fs.delete_dir(inner)


materialise.drop = drop


def fresh(df: DataFrame, name: str) -> str:
    """A column name that clashes with none of ``df``'s, compared as Spark compares."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


#: Columns of control rows beside the row id.
CONTROL = ("a", "b", "c", "d")
#: Most tasks of a pass; a task takes several segments where there are more.
MOST_TASKS = 50_000


class RowStore:
    """A table written once, one file a task, with a row id that stays the same in later passes.

    The row id is ``segment << 33 | position``; a segment is one file. A pass hands each segment to
    one task together with small *control rows* ``(rid, a, b, c, d)`` for it, so that several passes over
    long texts shuffle only control rows and never the texts.
    """

    def __init__(self, spark: SparkSession, path: str, df: DataFrame, rid: str):
        self.spark, self.path, self.rid = spark, path, rid
        self.df = spark.read.schema(df.schema).parquet(path)
        fs, inner = open_fs(path)
        names = [f.base_name for f in fs.get_file_info(pafs.FileSelector(inner)) if f.base_name.startswith("part-")]
        found = [re.match(r"part-(\d+)(.*)", n) for n in names]
        #: Files are named by the task that wrote them; a task without rows has none.
        self.segments = 1 + max((int(m[1]) for m in found), default=-1)
        self.digits, self.ending = min((len(m[1]) for m in found), default=0), found[0][2] if found else ""
        assert all(m[2] == self.ending for m in found)
        self.present = np.zeros(self.segments, dtype=bool)
        self.present[[int(m[1]) for m in found]] = True

    @classmethod
    def write(cls, df: DataFrame, name: str) -> RowStore:
        spark, path, rid = df.sparkSession, new_dir(df.sparkSession, name), fresh(df, "rid")
        out = df.withColumn(rid, F.monotonically_increasing_id())
        out.write.option("compression", "zstd").option("maxRecordsPerFile", 0).parquet(path)
        return cls(spark, path, out, rid)

    def run(self, control: DataFrame | None, fn: Callable[[pa.RecordBatch, list], pa.RecordBatch], schema, columns: list[str] | None = None, batch: int = 2000, every: bool = True) -> DataFrame:
        """Apply ``fn(rows, control)`` to the batches of every segment.

        ``rows`` has ``columns`` and the row id; ``control`` is a list of numpy arrays rid, a, b, c, d for those rows,
        sorted (columns of longs; absent ones are 0). Control rows of one segment meet in one task; they are bounded
        by the segment's size. Every segment is read, with control rows or without, or only those with some.
        """
        tasks = max(1, min(self.segments, MOST_TASKS))
        none = [F.lit(None).cast("long").alias("rid"), *(F.lit(0).cast("long").alias(c) for c in CONTROL)]
        heads = self.spark.range(self.segments).select(F.col("id").cast("int").alias("segment"), *none)
        if control is not None:
            have = [F.col(c).cast("long").alias(c) if c in control.columns else F.lit(0).cast("long").alias(c) for c in CONTROL]
            named = control.select(F.shiftright("rid", 33).cast("int").alias("segment"), "rid", *have)
            heads = heads.unionByName(named) if every else named
        dealt = heads.repartitionById(tasks, F.col("segment") % tasks).sortWithinPartitions("segment", "rid", *CONTROL)
        path, digits, ending, present, rid = self.path, self.digits, self.ending, np.packbits(self.present), self.rid
        take = None if columns is None else [*dict.fromkeys([*columns, rid])]

        def segment_rows(segment: int, keys: list) -> Iterator[pa.RecordBatch]:
            if not present[segment >> 3] >> (7 - (segment & 7)) & 1:
                return
            fs, inner = open_fs(f"{path}/part-{segment:0{digits}d}{ending}")
            with pq.ParquetFile(fs.open_input_file(inner)) as f:
                at = 0
                for rows in f.iter_batches(batch_size=batch, columns=take):
                    if rows.num_rows:
                        last = rows.column(rid)[-1].as_py()
                        to = at + int(keys[0][at:].searchsorted(last, side="right"))
                        out = fn(rows, [k[at:to] for k in keys])
                        at = to
                        if out is not None and out.num_rows:
                            yield out

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list] = {}
            for b in batches:
                ordinals = b.column(0).to_numpy(zero_copy_only=False)
                for o in np.unique(ordinals):
                    for older in [x for x in held if x < o]:
                        yield from flush(older, held.pop(older))
                    held.setdefault(int(o), []).append(b.filter(pa.array(ordinals == o)))
            for o in sorted(held):
                yield from flush(o, held.pop(o))
            pa.default_memory_pool().release_unused()  # the worker lives on

        def flush(o: int, parts: list) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(parts)
            t = t.filter(t.column("rid").is_valid())
            yield from segment_rows(o, [t.column(c).to_numpy() for c in ("rid", *CONTROL)])

        return dealt.mapInArrow(task, schema)
