"""Gates and receipts: review findings, digests of what was reviewed, and replay of receipts against present inputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

# fixed values: the least passing score, and the days around a check in which its receipt holds
LEAST_SCORE, RECEIPT_DAYS, CLOCK_DAYS = 4, 30, 1
LEAST_DISCLOSURE, LEAST_REASON = 40, 10
HARD_SECTIONS = "^(Fidelity|Region|AI vocabulary|Hong Kong flavor)"


def finding(df: DataFrame, key: str, rule_id: str, detail: Column | None = None) -> DataFrame:
    return df.select(key, F.lit(rule_id).alias("rule_id"), F.lit("error").alias("severity"), (F.lit("") if detail is None else F.coalesce(detail.cast("string"), F.lit(""))).alias("detail"))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "[/\\\\]"), -1)


def digest(content: Column) -> Column:
    return F.sha2(content, 256)


def review_findings(reviews: DataFrame, reports: DataFrame) -> DataFrame:
    """Findings of reviews (review_id, report_id, report_lang, report_path, report_sha256, scores map, checks map, findings array, sections array) on reports (report_id, path, text, language).

    A review without its report has that one finding.
    """
    key = "review_id"
    j = reviews.join(reports.select("report_id", "path", "text", "language"), "report_id", "left")
    lost = j.where("text IS NULL")
    j = j.where("text IS NOT NULL").withColumn("norm", tx.collapsed(F.col("text")))
    score = j.select(key, F.explode("scores").alias("name", "score"))
    checks = j.select(key, F.explode("checks").alias("name", "passed"))
    f = j.select(key, "norm", F.explode("findings").alias("f")).select(key, "norm", "f.*").withColumn("disclosure", tx.collapsed(F.col("report_disclosure_excerpt")))
    limits = f.where("severity = 'major' AND disposition = 'accepted_limitation'")
    return reduce(DataFrame.unionByName, [
        finding(lost, key, "Q-no-report"), finding(score.where(F.col("score") < LEAST_SCORE), key, "Q-score", F.col("name")), finding(checks.where("NOT passed"), key, "Q-check", F.col("name")),
        finding(j.where("report_lang <> language"), key, "Q-language"), finding(j.where(file_name(F.col("report_path")) != file_name(F.col("path"))), key, "Q-other-report"),
        finding(j.where(F.col("report_sha256") != digest(F.col("text"))), key, "Q-stale"), finding(f.where("severity = 'critical' AND disposition <> 'fixed'"), key, "Q-critical", F.col("finding_id")),
        finding(f.where("severity = 'major' AND disposition = 'rejected'"), key, "Q-major-rejected", F.col("finding_id")),
        finding(limits.where((F.char_length("disclosure") < LEAST_DISCLOSURE) | ~F.contains("norm", F.col("disclosure"))), key, "Q-undisclosed", F.col("finding_id")),
    ])


def section_reviews(sections: DataFrame, reviews: DataFrame) -> DataFrame:
    """Sections (report_id, heading) against their reviews, both ways on the folded heading: missing, unknown, repeated."""
    fold = lambda c: F.lower(tx.collapsed(F.col(c)))
    a = sections.select("report_id", fold("heading").alias("h")).distinct().withColumn("in_report", F.lit(True))
    b = reviews.select("report_id", fold("heading").alias("h")).groupBy("report_id", "h").agg(F.count("*").alias("n"))
    j = a.join(b, ["report_id", "h"], "full_outer")
    return reduce(DataFrame.unionByName, [finding(j.where("n IS NULL"), "report_id", "Q-unreviewed", F.col("h")), finding(j.where("in_report IS NULL"), "report_id", "Q-unknown-section", F.col("h")), finding(j.where("n > 1"), "report_id", "Q-repeated-review", F.col("h"))])


def two_way(found: DataFrame, approved: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of one side only: side 'unapproved' or 'unused'."""
    a, b = found.select(*keys).distinct().withColumn("l", F.lit(True)), approved.select(*keys).distinct().withColumn("r", F.lit(True))
    return a.join(b, keys, "full_outer").where("l IS NULL OR r IS NULL").select(*keys, F.when(F.col("r").isNull(), "unapproved").otherwise("unused").alias("side"))


def apply_waivers(warnings: DataFrame, waivers: DataFrame) -> DataFrame:
    """Warnings (report_id, section, message) with severity: error in hard sections, waived where a waiver names both exactly with a reason, else warning."""
    good = waivers.where(F.char_length(tx.clean(F.col("reason"))) >= LEAST_REASON).select("report_id", "section", "message").distinct().withColumn("waived", F.lit(True))
    j = warnings.join(good, ["report_id", "section", "message"], "left")
    return j.select("report_id", "section", "message", F.when(F.col("section").rlike(HARD_SECTIONS), "error").when(F.col("waived"), "waived").otherwise("error").alias("severity"))


def replay(receipts: DataFrame, present: DataFrame, report_day: Column | None = None) -> DataFrame:
    """Findings of receipts (receipt_id, status, checked_at, inputs map name -> sha256) against present inputs (receipt_id, name, sha256)."""
    key = "receipt_id"
    named = receipts.select(key, F.explode("inputs").alias("name", "was"))
    j = named.join(present.select(key, "name", "sha256"), [key, "name"], "full_outer")
    out = [finding(receipts.where("status <> 'passed'"), key, "R-status"), finding(j.where("sha256 IS NULL"), key, "R-missing", F.col("name")), finding(j.where("was IS NULL"), key, "R-unbound", F.col("name")), finding(j.where("was <> sha256"), key, "R-changed", F.col("name"))]
    if report_day is not None:
        days = F.datediff(report_day, F.to_date("checked_at"))
        out.append(finding(receipts.where(days.isNull() | (days > RECEIPT_DAYS) | (days < -CLOCK_DAYS)), key, "R-window", days))
    return reduce(DataFrame.unionByName, out)


def passes(findings: DataFrame) -> bool:
    """No hard finding; one row is read at most."""
    return findings.where("severity = 'error'").isEmpty()


def append_receipts(receipts: DataFrame, path: str) -> None:
    """Append to the receipts table; the commit protocol publishes all rows or none."""
    receipts.write.mode("append").parquet(path)


def collisions(reads: dict[str, str], writes: dict[str, str]) -> list[str]:
    """Names of writes that would overwrite a read or another write."""
    out = [f"{w} is also read as {r}" for w, p in writes.items() for r, q in reads.items() if p.rstrip("/") == q.rstrip("/")]
    paths = [p.rstrip("/") for p in writes.values()]
    return out + [f"{w} is written twice" for w, p in writes.items() if paths.count(p.rstrip("/")) > 1]
