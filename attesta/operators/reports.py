"""Report rules: structure, length, and the report against its ledger."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..functions import text as tx
from ..functions.lexicons import CJK
from . import graph

# fixed values: words or characters that a report of a language may have
LENGTHS = {"en": ("words", 7_500, 15_000), "zh-CN": ("chars", 5_000, 10_000), "zh-HK": ("chars", 5_000, 10_000)}


def finding(df: DataFrame, rule_id: str, detail=None, severity: str = "error") -> DataFrame:
    return df.select("report_id", F.lit(rule_id).alias("rule_id"), F.lit(severity).alias("severity"), (F.lit("") if detail is None else F.coalesce(detail.cast("string"), F.lit(""))).alias("detail"))


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def measured(reports: DataFrame, text: str = "text") -> DataFrame:
    """Reports with prose, words, chars, sections and the source section."""
    titles = [*md.SOURCE_TITLES]
    t = F.coalesce(F.col(text), F.lit(""))
    d = reports.withColumns({"body": t, "prose": md.prose_of(t), "sections": md.section_list(t)})
    is_source = lambda s: F.lower(s["title"]).isin(titles)
    d = d.withColumns({
        "words": F.regexp_count("prose", F.lit(r"(?U)\b[\w'-]+\b")), "chars": F.regexp_count("prose", F.lit(f"[A-Za-z0-9{CJK}]")), "detected": tx.report_language(F.col("prose")),
        "source_at": F.expr("array_position(transform(sections, s -> lower(s.title) IN (" + ", ".join(f"'{x}'" for x in titles) + ")), true)"), "last_source": F.try_element_at(F.filter("sections", is_source), F.lit(-1)),
    })
    return d


def structure(reports: DataFrame, text: str = "text", language: str | None = "language", min_sections: int = 1, min_sources: int = 1) -> DataFrame:
    """report_id, rule_id, severity, detail: emptiness, title, language, length, sections, sources.

    A null text is empty, and an empty report has that one finding. Reports with equal ids are judged each on its own.
    """
    d = measured(reports, text)
    empty = d.where(tx.clean(F.col("body")) == "")
    d = d.where(tx.clean(F.col("body")) != "")
    out = [finding(empty, "P-empty"), finding(d.where(~F.regexp(F.col("body"), F.lit(r"(?m)^#\s+\S"))), "P-title")]
    if language:
        out.append(finding(d.where((F.col("detected") != F.col(language)) & ~((F.col("detected") == "zh") & F.startswith(F.col(language), F.lit("zh-")))), "P-language", F.col("detected")))
        for lang, (unit, low, high) in LENGTHS.items():
            of = d.where(F.col(language) == lang)
            out += [finding(of.where(F.col(unit) < low), "P-short", F.col(unit)), finding(of.where(F.col(unit) > high), "P-long", F.col(unit))]
    tail = d.where("last_source IS NOT NULL").withColumn("tail", F.expr("substring(body, last_source.start + 1)"))
    out += [
        finding(d.where(F.size("sections") < min_sections), "P-sections", F.size("sections")), finding(d.where("last_source IS NULL"), "P-no-sources"),
        finding(d.where("last_source IS NOT NULL AND last_source.start <> try_element_at(sections, -1).start"), "P-sources-last"),
        finding(tail.withColumn("links", md.link_list("tail")).where(F.size("links") < min_sources), "P-few-links"), finding(tail.withColumn("bare", md.raw_url_list("tail")).where(F.size("bare") > 0), "P-raw-urls"),
    ]
    return union(out)


def against_ledger(reports: DataFrame, tables: dict[str, DataFrame], text: str = "text") -> DataFrame:
    """Reports (report_id = ledger_id) against their ledgers: unknown addresses, claims without a place, citation or listed source.

    Foundations here are unbounded in depth and not limited to known sources, unlike those of the ledger rules.
    """
    r = reports.select(F.col("report_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    split = r.select("report_id", "body", F.filter(md.section_list("body"), lambda s: F.lower(s["title"]).isin([*md.SOURCE_TITLES])).alias("s")).select("report_id", "body", F.when(F.size("s") > 0, F.array_min(F.transform("s", lambda x: x["start"]))).alias("cut"))
    split = split.select("report_id", "body", F.when(F.col("cut").isNull(), F.col("body")).otherwise(F.expr("substring(body, 1, cut)")).alias("head"), F.when(F.col("cut").isNull(), "").otherwise(F.expr("substring(body, cut + 1)")).alias("tail"))
    urls = lambda c: split.select("report_id", F.explode(md.link_list(c)).alias("l")).select("report_id", F.col("l.url").alias("url")).distinct()
    sources = tables["sources"].where("url IS NOT NULL AND url <> ''").select(F.col("ledger_id").alias("report_id"), "source_id", "url")
    unknown = urls("body").join(sources.select("report_id", "url").distinct(), ["report_id", "url"], "left_anti")
    claims = tables["claims_raw"].where("included").select(F.col("ledger_id").alias("report_id"), "claim_id", F.coalesce("report_excerpts", F.array().cast("array<string>")).alias("excerpts")).join(r.select("report_id").distinct(), "report_id", "left_semi")
    paragraphs = split.select("report_id", F.posexplode(F.split("head", r"\n\s*\n")).alias("n", "p")).where(tx.clean(F.col("p")) != "").withColumn("norm", md.paragraph_prose("p"))
    wanted = claims.select("report_id", "claim_id", F.explode("excerpts").alias("e")).withColumn("e", tx.collapsed(F.col("e")))
    placed = wanted.join(paragraphs, "report_id").where(F.contains("norm", F.col("e"))).select("report_id", "claim_id", "e", "n")
    lost = wanted.join(placed.select("report_id", "claim_id", "e").distinct(), ["report_id", "claim_id", "e"], "left_anti")
    node = lambda c: F.struct("ledger_id", F.col(c).alias("claim_id"))
    reach = graph.closure(tables["claim_edges"].where("relation = 'supports'").select(node("claim_id").alias("src"), node("related_id").alias("dst")))
    own = tables["claims"].select("ledger_id", "claim_id", F.explode("source_ids").alias("source_id"))
    below = reach.select("src.ledger_id", F.col("src.claim_id").alias("top"), F.col("dst.claim_id").alias("claim_id")).join(own, ["ledger_id", "claim_id"]).select("ledger_id", F.col("top").alias("claim_id"), "source_id")
    expected = own.unionByName(below).distinct().select(F.col("ledger_id").alias("report_id"), "claim_id", "source_id").join(sources, ["report_id", "source_id"]).select("report_id", "claim_id", "url").distinct()
    cited = paragraphs.select("report_id", "n", F.explode(md.link_list("p")).alias("l")).select("report_id", "n", F.col("l.url").alias("url")).distinct()
    near = placed.join(expected, ["report_id", "claim_id"]).join(cited, ["report_id", "n", "url"]).select("report_id", "claim_id", "e").distinct()
    found = placed.select("report_id", "claim_id", "e").distinct()
    uncited = found.join(expected.select("report_id", "claim_id").distinct(), ["report_id", "claim_id"], "left_semi").join(near, ["report_id", "claim_id", "e"], "left_anti")
    unlisted = found.select("report_id", "claim_id").distinct().join(expected, ["report_id", "claim_id"]).join(urls("tail"), ["report_id", "url"], "left_anti")
    return union([
        finding(unknown, "P-unknown-url", F.col("url")), finding(claims.where("size(excerpts) = 0"), "P-no-location", F.col("claim_id")), finding(lost, "P-not-located", F.col("claim_id")),
        finding(uncited, "P-uncited", F.col("claim_id")), finding(unlisted, "P-unlisted", F.concat_ws(" ", "claim_id", "url")),
    ])
