"""Source fidelity: which claim-source pairs are checked, against which documents, with what status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import probes

SAMPLES = 8


def weight(importance: Column, included: Column, central: Column) -> Column:
    return F.when(central, 3).when((importance == "key") & included, 2).when(included, 1).otherwise(0)


def samples(tables: dict[str, DataFrame], most: int = SAMPLES) -> DataFrame:
    """The weightiest pairs of each ledger that have probes and an address; ties by claim and source as text. ``most`` 0 takes all."""
    central = tables["synthesis_refs"].where("part = 'central'").select("ledger_id", "claim_id").distinct().withColumn("central", F.lit(True))
    c = tables["claims"].select("ledger_id", "claim_id", "importance", "included").join(central, ["ledger_id", "claim_id"], "left")
    pairs = tables["claim_evidence"].join(c, ["ledger_id", "claim_id"]).join(tables["sources"].where("url IS NOT NULL AND url <> ''").select("ledger_id", "source_id", "url"), ["ledger_id", "source_id"])
    pairs = pairs.withColumns({"probes": probes.strings(F.col("text")), "weight": weight(F.col("importance"), F.col("included"), F.coalesce("central", F.lit(False)))}).where("size(probes) > 0")
    w = Window.partitionBy("ledger_id").orderBy(F.desc("weight"), "claim_id", "source_id")
    ranked = pairs.withColumn("rank", F.row_number().over(w))
    return (ranked.where(F.col("rank") <= most) if most else ranked).select("ledger_id", "claim_id", "source_id", "url", "probes", "weight")


def checks(sampled: DataFrame, documents: DataFrame) -> DataFrame:
    """Samples with their status against documents (url, html): every probe window stands in the visible text, or not. Each address is read once."""
    seen = documents.groupBy("url").agg(F.max("html").alias("html")).select("url", tx.visible_text("html").alias("visible"))
    j = sampled.join(seen, "url", "left").withColumn("wanted", probes.wanted("probes"))
    return j.select("ledger_id", "claim_id", "source_id", "url", "weight", probes.check_status(F.col("wanted"), F.col("visible")).alias("status"), probes.digests(F.col("wanted")).alias("probe_digests"), probes.context_digests("visible", "wanted").alias("context_digests"))


def outcome(checked: DataFrame) -> DataFrame:
    return checked.groupBy("ledger_id").agg(probes.overall_status(F.col("status")).alias("status"), F.count("*").alias("checks"), F.count_if(F.col("status") == "verified").alias("verified"))


def changed_documents(before: DataFrame, now: DataFrame) -> DataFrame:
    """Pairs whose context digests differ between two snapshots of checks."""
    keys = ["ledger_id", "claim_id", "source_id"]
    return before.select(*keys, F.col("context_digests").alias("was")).join(now.select(*keys, F.col("context_digests").alias("is")), keys).where("was <> is").select(*keys)
