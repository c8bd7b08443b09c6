"""Ledger scan: JSON documents with a fixed schema, flattened to relations keyed by ledger and id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls as ux

SEARCH = "struct<queries:array<string>,expected_locations:array<string>,searched_at:string>"
HARM_REVIEW = f"struct<category:string,source_floor:string,legal_stage:string,accountable_source_ids:array<string>,attributed_to:string,sourcing_limitation_excerpt:string,resolution_status:string,resolution_claim_ids:array<string>,resolution_search:{SEARCH},right_of_reply:struct<status:string,response_claim_ids:array<string>,search_record:{SEARCH}>,privacy_basis:string,privacy_basis_source_ids:array<string>,governing_question_relevance:string>"
SOURCE = "struct<source_id:string,title:string,url:string,publisher:string,author:string,published:string,accessed:string,provenance:string,evidence_type:string,source_family:string,roles:array<string>,accountability_basis:string,limitations:string,undated_reason:string,family_justification:string>"
CLAIM = (
    "struct<claim_id:string,claim:string,kind:string,importance:string,source_ids:array<string>,extract_or_location:string,source_evidence:array<struct<source_id:string,extract_or_location:string>>,as_of:string,confidence:string,status:string,"
    "include_in_report:boolean,report_excerpts:array<string>,supports:array<string>,contradicts:array<string>,person_ids:array<string>,person_claim_role:string,person_claim_assessment:struct<classification:string,rationale:string>,"
    f"human_harm_review:{HARM_REVIEW},reasoning:string,triangulation:struct<status:string,rationale:string>,resolution:string,limitations:string,assumptions:array<string>,derived_assertions:array<struct<expression:string,derivation:string>>,"
    f"time_sensitive:boolean,verified_at:string,evidence_of_absence:{SEARCH},responds_to_claim_ids:array<string>,resolves_claim_ids:array<string>>"
)
COVERAGE = "struct<area:string,question:string,priority:string,status:string,claim_ids:array<string>,gap_impact:string,notes:string>"
PERSON = "struct<person_id:string,name:string,aliases:array<string>,living_status:string,public_role:string,relationship:string>"
SYNTHESIS = "struct<central_judgment_claim_ids:array<string>,counterevidence_claim_ids:array<string>,adversarial_tests:array<struct<claim_ids:array<string>>>,implications:array<struct<claim_ids:array<string>>>,decisions_or_takeaways:array<struct<rationale_claim_ids:array<string>>>,scenarios:array<struct<claim_ids:array<string>>>,limitations:array<string>,research_stop_reason:string>"
SCHEMA = f"schema_version int, subject string, research_question string, report_date string, brief struct<archetype:string,report_language:string,intended_reader:string>, people array<{PERSON}>, coverage array<{COVERAGE}>, sources array<{SOURCE}>, claims array<{CLAIM}>, synthesis {SYNTHESIS}, unresolved_questions array<string>"


def read_ledgers(spark: SparkSession, path: str) -> DataFrame:
    """One row for each JSON document below ``path``; what doesn't parse is kept in ``corrupt``."""
    return spark.read.schema(f"{SCHEMA}, corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "corrupt").json(path).withColumn("ledger_id", F.col("_metadata.file_path"))


def parse_ledgers(df: DataFrame, text: str, key: str) -> DataFrame:
    """Ledgers from a column of JSON text; malformed ones have null fields and the text in ``corrupt``."""
    parsed = df.select(F.col(key).alias("ledger_id"), F.from_json(text, f"{SCHEMA}, corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}).alias("d"))
    return parsed.select("ledger_id", "d.*")


def day(c):
    return F.when(F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(F.col(c), "yyyy-MM-dd"))


def last_of(df: DataFrame, key: str) -> DataFrame:
    """Of records with one id the last, as look-ups by id see it."""
    rest = [c for c in df.columns if c not in ("ledger_id", key)]
    return df.where(f"{key} IS NOT NULL AND {key} <> ''").groupBy("ledger_id", key).agg(F.max_by(F.struct(*rest), "pos").alias("r")).select("ledger_id", key, "r.*")


def flatten(ledgers: DataFrame) -> dict[str, DataFrame]:
    """Relations of all ledgers, each with ``ledger_id``; *_raw ones keep repeated ids."""
    head = ledgers.select("ledger_id", "schema_version", day("report_date").alias("report_day"), F.col("brief.archetype").alias("archetype"), F.col("brief.report_language").alias("language"), F.col("synthesis").isNotNull().alias("has_synthesis"))

    def exploded(c: str) -> DataFrame:
        return ledgers.select("ledger_id", F.posexplode(c).alias("pos", "r")).select("ledger_id", "pos", "r.*")

    sources_raw = exploded("sources").withColumns({
        "published_day": day("published"), "accessed_day": day("accessed"), "normal_url": ux.normalised_url(F.col("url")), "host": ux.host(F.col("url")), "domain": ux.registrable_domain(F.col("url")),
        "family": tx.family(F.col("source_family")), "publisher_name": tx.family(F.col("publisher")), "justified": F.char_length(tx.clean(F.col("family_justification"))) >= 40,
        "independent": F.coalesce(F.col("provenance").isin("primary_independent", "secondary_independent"), F.lit(False)), "interested": F.coalesce(F.col("provenance").isin("primary_interested", "secondary_dependent"), F.lit(False)),
    })
    extracts = F.filter(F.transform(F.coalesce("source_evidence", F.array()), lambda e: tx.clean(e["extract_or_location"])), lambda e: e != "")
    claims_raw = exploded("claims").withColumns({
        "text": tx.clean(F.col("claim")), "as_of_day": day("as_of"), "verified_day": day("verified_at"), "included": F.coalesce(F.col("include_in_report"), F.lit(False)), "sensitive_to_time": F.coalesce(F.col("time_sensitive"), F.lit(False)),
        "evidence": F.when(F.size(extracts) > 0, F.array_join(extracts, " ")).otherwise(tx.clean(F.col("extract_or_location"))),
    })
    claims_raw = claims_raw.withColumn("claim_id", F.coalesce(F.nullif("claim_id", F.lit("")), F.lit("<unknown>")))
    listed = lambda c, out, source=claims_raw, key="claim_id": source.select("ledger_id", key, F.posexplode(c).alias("at", out))
    edges = listed("supports", "related_id").withColumn("relation", F.lit("supports")).unionByName(listed("contradicts", "related_id").withColumn("relation", F.lit("contradicts")))
    people_raw = exploded("people")
    coverage = exploded("coverage").withColumn("area", F.coalesce("area", F.lit("<unknown>")))
    synthesis = ledgers.where("synthesis IS NOT NULL")
    refs = lambda part, c: synthesis.select("ledger_id", F.lit(part).alias("part"), F.lit(0).alias("item"), F.explode(f"synthesis.{c}").alias("claim_id"))
    items = lambda part, c, ids: synthesis.select("ledger_id", F.lit(part).alias("part"), F.posexplode(f"synthesis.{c}").alias("item", "r")).select("ledger_id", "part", "item", F.explode_outer(f"r.{ids}").alias("claim_id"))
    synthesis_refs = refs("central", "central_judgment_claim_ids").unionByName(refs("counter", "counterevidence_claim_ids"))
    for part, c, ids in (("test", "adversarial_tests", "claim_ids"), ("implication", "implications", "claim_ids"), ("takeaway", "decisions_or_takeaways", "rationale_claim_ids"), ("scenario", "scenarios", "claim_ids")):
        synthesis_refs = synthesis_refs.unionByName(items(part, c, ids))
    return {
        "ledgers": head, "sources_raw": sources_raw, "sources": last_of(sources_raw, "source_id"), "claims_raw": claims_raw, "claims": last_of(claims_raw, "claim_id"), "people_raw": people_raw, "people": last_of(people_raw, "person_id"),
        "coverage": coverage, "coverage_claims": coverage.select("ledger_id", "pos", "area", "priority", "status", F.explode("claim_ids").alias("claim_id")), "claim_sources": listed("source_ids", "source_id"),
        "claim_evidence": claims_raw.select("ledger_id", "claim_id", F.explode("source_evidence").alias("e")).select("ledger_id", "claim_id", "e.source_id", tx.clean(F.col("e.extract_or_location")).alias("text")).where("source_id IS NOT NULL AND source_id <> ''"),
        "claim_edges": edges, "claim_people": listed("person_ids", "person_id"), "synthesis_refs": synthesis_refs,
        "derived": claims_raw.select("ledger_id", "claim_id", "kind", "text", "evidence", F.posexplode("derived_assertions").alias("at", "d")).select("ledger_id", "claim_id", "kind", "text", "evidence", "at", tx.clean(F.col("d.expression")).alias("expression"), tx.clean(F.col("d.derivation")).alias("derivation")),
    }
