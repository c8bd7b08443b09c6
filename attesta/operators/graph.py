"""Graph operators: components, reachability and cycles, iterated to a fixed point with written tables between rounds."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local session without one gets a folder of our own."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="attesta-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def _settled(df: DataFrame) -> DataFrame:
    """Cut the lineage in the session's checkpoint folder."""
    _folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Cut the lineage through a compressed table in the session's checkpoint folder."""
    path = f"{_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(links: DataFrame) -> DataFrame:
    """node, component of undirected links (u, v): the least node that is reachable.

    Every node hooks onto the least label around it, then labels jump to their labels' labels, so rounds grow with the logarithm of the path length.
    """
    edges = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct()
    edges = _settled(edges)
    labels = _settled(links.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("component", F.col("node")))
    while True:
        around = edges.join(labels, edges.v == labels.node).groupBy("u").agg(F.min("component").alias("least"))
        hooked = labels.join(around, labels.node == around.u, "left").select("node", F.least("component", "least").alias("step"), F.col("component").alias("was"))
        jump = hooked.select(F.col("node").alias("at"), F.col("step").alias("next"))
        new = _settled(hooked.join(jump, hooked.step == jump.at).select("node", F.least("step", "next").alias("component"), "was"))
        changed = new.where("component <> was").isEmpty()
        labels = new.select("node", "component")
        if changed:
            return labels


def reaching(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """node: the targets and all nodes from which a path of edges (src, dst) leads to one; semi-naive."""
    found = frontier = _settled(targets.select("node").distinct())
    edges = _settled(edges.select("src", "dst").distinct())
    while True:
        frontier = _settled(edges.join(frontier, edges.dst == frontier.node).select(F.col("src").alias("node")).distinct().join(found, "node", "left_anti"))
        if frontier.isEmpty():
            return found
        found = _settled(found.unionByName(frontier))


def closure(edges: DataFrame) -> DataFrame:
    """src, dst of all non-empty paths; for graphs whose closure is known to be small, as it may be quadratic."""
    edges = _settled(edges.select("src", "dst").distinct())
    found = frontier = edges
    while True:
        step = frontier.select("src", F.col("dst").alias("mid")).join(edges.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()
        frontier = _settled(step.join(found, ["src", "dst"], "left_anti"))
        if frontier.isEmpty():
            return found
        found = _settled(found.unionByName(frontier))


def contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges in which each run of nodes with one edge in and one out has become one edge; (node, u, w) of the runs' nodes with that edge; and (node, label) of
    rings of such nodes alone, labelled by their least. Pointers jump to their targets' targets, so rounds grow with the logarithm of the longest run."""
    ins = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"), F.min("src").alias("prev")).where("n = 1")
    outs = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("m"), F.min("dst").alias("at")).where("m = 1")
    inner = _settled(ins.join(outs, "node").select("node", "prev", "at"))
    names = inner.select(F.col("node").alias("name"))
    # least: of the nodes behind ``node`` up to ``at``, so it is the node itself only on a ring; open: whether ``at`` belongs to the run too
    state = inner.join(names, inner.at == names.name, "left").select("node", F.col("node").alias("last"), "at", F.col("at").alias("least"), F.col("name").isNotNull().alias("open"))
    while True:
        state = _settled(state)
        rings = state.where("node = least").select(F.col("node").alias("ring"))
        if state.where("open").join(rings, F.col("least") == F.col("ring"), "left_anti").isEmpty():
            break
        ahead = state.select(*(F.col(c).alias(f"{c}2") for c in state.columns))
        step = state.where("open").join(ahead, F.col("at") == F.col("node2"))
        moved = step.select("node", F.col("last2").alias("last"), F.col("at2").alias("at"), F.least("least", "least2").alias("least"), F.col("open2").alias("open"))
        state = state.where("NOT open").unionByName(moved)
    runs = state.where("NOT open")
    heads = inner.join(names, inner.prev == names.name, "left_anti").select("node", F.col("prev").alias("u"))
    heads = _settled(runs.join(heads, "node").select("last", "u", F.col("at").alias("w")))
    outer = edges.join(names, edges.src == names.name, "left_anti").join(names, F.col("dst") == F.col("name"), "left_anti").select("src", "dst")
    short = _settled(outer.unionByName(heads.select(F.col("u").alias("src"), F.col("w").alias("dst"))).distinct())
    return short, runs.select("node", "last").join(heads, "last").select("node", "u", "w"), state.where("open").select("node", F.col("least").alias("label"))


def on_cycles(edges: DataFrame) -> DataFrame:
    """node: all nodes on a directed cycle. Nodes without an edge in or out are trimmed and runs of nodes contracted until neither changes anything; the rest, which
    holds all cycles but the rings found on the way, is closed. A run's nodes are on a cycle if its edge is, so if both ends have one label: the least node of those on cycles with them."""
    edges = _settled(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    n, runs, found = edges.count(), [], []
    while n:
        kept = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        kept = _settled(kept.join(kept.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        edges, inner, rings = contracted(kept)
        runs.append(inner)
        found.append(_settled(rings))
        m = edges.count()
        if m == n:
            break
        n = m
    if n:
        reach = closure(edges)
        both = reach.join(reach.select(F.col("src").alias("dst"), F.col("dst").alias("src")), ["src", "dst"])
        found.append(_settled(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("label"))))
    if not found:
        return edges.select(F.col("src").alias("node"))
    labels = functools.reduce(DataFrame.unionByName, found)
    for inner in reversed(runs):
        ends = inner.join(labels.select(F.col("node").alias("u"), "label"), "u").join(labels.select(F.col("node").alias("w"), F.col("label").alias("other")), "w")
        labels = labels.unionByName(_settled(ends.where("label = other").select("node", "label")))
    return labels.select("node")
