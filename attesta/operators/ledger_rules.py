"""Ledger rules L01 to L81: each is a relation over the flattened ledgers, and all of them make one findings table.

findings(ledger_id, rule_id, severity, entity_id, detail). Rules with several messages have several ids (L41a, L41b).
A record that names no parent (dangling ids) is a left anti join, a condition on all or any members a boolean aggregate, a chain of supports a
graph operator; no rule joins without a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import assertions as asr
from ..functions import text as tx
from . import graph

#: Days that a record of something current may lie before the report.
FRESH_DAYS = 30
PROTECTED = ["living", "recently_deceased", "unknown"]
ROLES = ["neutral", "harmful", "sensitive_private_fact", "response", "resolution"]
ACCOUNTABLE = ["court_or_regulator_record", "named_source_investigation", "subject_admission"]

RULES: dict[str, object] = {}


def rule(*ids: str):
    """A function from the relations to rows (ledger_id, entity_id[, detail]); several ids take a dict of such frames."""

    def add(fn):
        RULES[fn.__name__] = (ids, fn)
        return fn

    return add


def found(df: DataFrame, entity, detail=None) -> DataFrame:
    col = lambda x: F.col(x) if isinstance(x, str) else x
    return df.select("ledger_id", col(entity).cast("string").alias("entity_id"), (F.lit("") if detail is None else F.coalesce(col(detail).cast("string"), F.lit(""))).alias("detail"))


def repeated(df: DataFrame, key: str) -> DataFrame:
    return found(df.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy("ledger_id", key).agg(F.count("*").alias("n")).where("n > 1"), key)


def lacking(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Rows of ``child`` whose key no row of ``parent`` in the ledger has; null keys lack one too."""
    p = parent.select("ledger_id", F.col(parent_key or key).alias(key)).distinct()
    return child.join(p, ["ledger_id", key], "left_anti")


def texts(x: str) -> Column:
    return F.filter(F.transform(F.coalesce(F.col(x), F.array().cast("array<string>")), tx.clean), lambda t: t != "")


def stale_search(search: str) -> Column:
    """No search record with queries, places and a day inside the window."""
    at = F.when(F.col(f"{search}.searched_at").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(F.col(f"{search}.searched_at"), "yyyy-MM-dd"))
    late = F.coalesce((at > F.col("report_day")) | (F.datediff("report_day", at) > FRESH_DAYS), F.lit(False))
    return F.col(search).isNull() | (F.coalesce(F.size(f"{search}.queries"), F.lit(-1)) <= 0) | (F.coalesce(F.size(f"{search}.expected_locations"), F.lit(-1)) <= 0) | at.isNull() | late


class Relations(dict):
    """The flattened tables and what several rules derive from them."""

    def __init__(self, tables: dict[str, DataFrame]):
        super().__init__(tables)
        claims, sources = tables["claims"], tables["sources"]
        known = tables["claim_sources"].select("ledger_id", "claim_id", "source_id").distinct().join(sources.select("ledger_id", "source_id"), ["ledger_id", "source_id"])
        self["direct"] = known
        # one declared level of support, never more
        hop = tables["claim_edges"].where("relation = 'supports' AND related_id <> claim_id").select("ledger_id", "claim_id", "related_id").distinct()
        borrowed = hop.join(known.withColumnRenamed("claim_id", "related_id"), ["ledger_id", "related_id"]).select("ledger_id", "source_id", "claim_id")
        self["foundations"] = known.unionByName(borrowed).distinct()
        self["families"] = families(sources)
        judged = self["foundations"].join(sources, ["ledger_id", "source_id"]).join(self["families"], ["ledger_id", "source_id"], "left")
        self["grounds"] = judged.groupBy("ledger_id", "claim_id").agg(F.count("*").alias("n"), F.bool_and("interested").alias("all_interested"), F.bool_or("independent").alias("any_independent"), F.count_distinct("component").alias("families"), F.flatten(F.collect_list(F.coalesce("roles", F.array()))).alias("roles"))
        own = known.join(sources, ["ledger_id", "source_id"])
        self["own_grounds"] = own.groupBy("ledger_id", "claim_id").agg(F.count("*").alias("n"), F.bool_and("interested").alias("all_interested"), F.flatten(F.collect_list(F.coalesce("roles", F.array()))).alias("roles"), F.max("accessed_day").alias("last_access"))
        people = tables["people"].withColumn("protected", F.coalesce(F.col("living_status").isin(PROTECTED), F.lit(False)))
        self["protected_people"] = people
        linked = tables["claim_people"].join(people.select("ledger_id", "person_id", "protected"), ["ledger_id", "person_id"]).groupBy("ledger_id", "claim_id").agg(F.bool_or("protected").alias("protected"))
        links = tables["claim_people"].groupBy("ledger_id", "claim_id").agg(F.collect_set("person_id").alias("linked_people"))
        raw = tables["claims_raw"].join(tables["ledgers"].select("ledger_id", "report_day", "archetype", "has_synthesis"), "ledger_id")
        raw = raw.join(linked, ["ledger_id", "claim_id"], "left").join(links, ["ledger_id", "claim_id"], "left")
        self["judged_claims"] = raw.withColumns({
            "protected": F.coalesce("protected", F.lit(False)), "linked_people": F.coalesce("linked_people", F.array().cast("array<string>")), "role": F.coalesce("person_claim_role", F.lit("")),
            "private": F.col("text").rlike(f"(?i){asr.PRIVATE}"), "harmful": F.col("text").rlike(f"(?i){asr.HARM}") | F.col("text").rlike(f"(?i){asr.PRIVATE}"),
        })
        review = self["judged_claims"].where("protected AND human_harm_review IS NOT NULL").withColumn("r", F.col("human_harm_review"))
        self["reviews"] = review.withColumns({"claim_stages": asr.legal_stages("text"), "evidence_stages": asr.legal_stages(F.array_join(texts_of(F.col("source_evidence")), " "))})
        self["known_claims"] = claims.select("ledger_id", "claim_id")


def texts_of(evidence: Column) -> Column:
    return F.transform(F.coalesce(evidence, F.array()), lambda e: tx.clean(e["extract_or_location"]))


def families(sources: DataFrame) -> DataFrame:
    """ledger_id, source_id, component: sources that share a domain, a declared family or a publisher, under the least id."""
    keys = F.filter(F.array(F.when(F.col("domain") != "", F.concat(F.lit("d:"), "domain")), F.when(F.col("family") != "", F.concat(F.lit("f:"), "family")), F.when(F.col("publisher_name") != "", F.concat(F.lit("p:"), "publisher_name"))), lambda k: k.isNotNull())
    named = sources.select("ledger_id", "source_id", F.explode_outer(keys).alias("key"))
    least = named.where("key IS NOT NULL").groupBy("ledger_id", "key").agg(F.min("source_id").alias("first"))
    links = named.join(least, ["ledger_id", "key"], "left").select(F.struct("ledger_id", "source_id").alias("u"), F.struct("ledger_id", F.coalesce("first", "source_id").alias("source_id")).alias("v"))
    return graph.components(links).select("node.ledger_id", "node.source_id", F.col("component.source_id").alias("component"))


# ---- portfolio and identity

@rule("L01")
def no_independent_source(t):
    any_independent = t["sources"].groupBy("ledger_id").agg(F.bool_or("independent").alias("ok"))
    return found(t["ledgers"].where("schema_version IN (3, 4)").join(any_independent.where("NOT ok"), "ledger_id"), F.lit("portfolio"))


@rule("L02", "L03", "L04", "L05")
def duplicates(t):
    urls = t["sources_raw"].where("url IS NOT NULL AND url <> ''")
    return {"L02": repeated(t["sources_raw"], "source_id"), "L03": repeated(t["claims_raw"].where("claim_id <> '<unknown>'"), "claim_id"), "L04": repeated(t["people_raw"], "person_id"), "L05": repeated(urls, "normal_url")}


# ---- coverage

@rule("L06", "L07", "L08", "L09", "L10", "L11")
def coverage_states(t):
    c, links = t["coverage"], t["coverage_claims"]
    by_status = links.join(t["claims"].select("ledger_id", "claim_id", F.col("status").alias("claim_status")), ["ledger_id", "claim_id"])
    without = lambda s: found(c.where(F.col("status") == s).join(by_status.where(F.col("claim_status") == s).select("ledger_id", "pos").distinct(), ["ledger_id", "pos"], "left_anti"), "area")
    return {
        "L06": found(lacking(links, t["known_claims"], "claim_id"), "area", "claim_id"), "L07": found(c.where("priority = 'high' AND status IN ('unstarted', 'in_progress')"), "area"),
        "L08": found(c.where((F.col("status") == "gap") & (tx.clean(F.col("gap_impact")) == "")), "area"), "L09": found(c.where("status = 'gap' AND size(claim_ids) > 0"), "area"), "L10": without("disputed"), "L11": without("supported"),
    }


@rule("L15")
def interested_coverage(t):
    supported = t["coverage_claims"].where("status = 'supported'")
    grounds = supported.join(t["foundations"], ["ledger_id", "claim_id"]).join(t["sources"].select("ledger_id", "source_id", "interested"), ["ledger_id", "source_id"])
    return found(grounds.groupBy("ledger_id", "pos", "area").agg(F.bool_and("interested").alias("only")).where("only"), "area")


@rule("L12", "L13", "L14", "L16")
def date_order(t):
    s = t["sources"].join(t["ledgers"], "ledger_id").where("NOT (published IS NOT NULL AND published_day IS NULL) AND NOT (accessed IS NOT NULL AND accessed_day IS NULL)")
    c = t["judged_claims"]
    return {"L12": found(s.where("published_day > report_day"), "source_id"), "L13": found(s.where("accessed_day > report_day"), "source_id"), "L14": found(s.where("published_day > accessed_day"), "source_id"), "L16": found(c.where("as_of_day > report_day"), "claim_id")}


# ---- links of claims

@rule("L17", "L18", "L19", "L20", "L21")
def claim_links(t):
    links, proof = t["claim_sources"], t["claim_evidence"]
    pair = ["ledger_id", "claim_id", "source_id"]
    return {
        "L17": found(lacking(links, t["sources"], "source_id"), "claim_id", "source_id"),
        "L18": found(proof.groupBy(*pair).agg(F.count("*").alias("n")).where("n > 1"), "claim_id", "source_id"),
        "L19": found(proof.join(links.select(*pair).distinct(), pair, "left_anti"), "claim_id", "source_id"),
        "L20": found(links.join(proof.select(*pair).distinct(), pair, "left_anti"), "claim_id", "source_id"),
        "L21": found(lacking(t["claim_people"], t["people"], "person_id"), "claim_id", "person_id"),
    }


@rule("L43a", "L43b", "L44", "L45a", "L45b")
def relations(t):
    e, c = t["claim_edges"], t["claims_raw"]
    against = e.where("relation = 'contradicts'").join(t["known_claims"].withColumnRenamed("claim_id", "related_id"), ["ledger_id", "related_id"])
    back = e.where("relation = 'contradicts'").select("ledger_id", F.col("related_id").alias("claim_id"), F.col("claim_id").alias("related_id")).distinct()
    return {
        "L43a": found(e.where("related_id = claim_id"), "claim_id", "relation"), "L43b": found(lacking(e, t["known_claims"], "related_id", "claim_id"), "claim_id", "related_id"),
        "L44": found(against.join(back, ["ledger_id", "claim_id", "related_id"], "left_anti"), "claim_id", "related_id"),
        "L45a": found(c.where((F.col("status") == "disputed") & (tx.clean(F.col("resolution")) == "")), "claim_id"), "L45b": found(c.where("status = 'disputed' AND coalesce(size(contradicts), 0) <= 0"), "claim_id"),
    }


# ---- persons and harm

@rule("L22", "L23", "L24", "L25", "L26", "L27", "L28", "L29a", "L29b")
def persons(t):
    c = t["judged_claims"]
    p = c.where("protected")
    assessed = (F.coalesce(F.col("person_claim_assessment.classification"), F.lit("")) == F.col("role")) & F.col("person_claim_assessment").isNotNull() & (F.char_length(tx.clean(F.col("person_claim_assessment.rationale"))) >= 40)
    names = t["people"].select("ledger_id", "person_id", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"))
    named = c.select("ledger_id", "claim_id", "text", "linked_people").join(names, "ledger_id").where(tx.mentions(F.col("text"), F.col("alias")) & ~F.array_contains("linked_people", F.col("person_id"))).select("ledger_id", "claim_id", "person_id").distinct()
    primary = t["protected_people"].where("protected AND relationship = 'primary_subject'").groupBy("ledger_id").agg(F.count("*").alias("n"), F.first("person_id").alias("primary")).where("n = 1")
    r = t["reviews"]
    return {
        "L22": found(p.where(~F.col("role").isin(ROLES)), "claim_id"), "L23": found(p.where(~assessed), "claim_id"), "L24": found(named, "claim_id", "person_id"),
        "L25": found(c.where("harmful AND archetype = 'person' AND size(linked_people) = 0").join(primary, "ledger_id"), "claim_id", "primary"),
        "L26": found(p.where("harmful AND role NOT IN ('harmful', 'sensitive_private_fact')"), "claim_id"), "L27": found(p.where("private AND role <> 'sensitive_private_fact'"), "claim_id"),
        "L28": found(p.where("(harmful OR role IN ('harmful', 'sensitive_private_fact')) AND human_harm_review IS NULL"), "claim_id"),
        "L29a": found(r.where("role = 'sensitive_private_fact' AND coalesce(r.category, '') <> 'sensitive_private_fact'"), "claim_id"), "L29b": found(r.where("private AND coalesce(r.category, '') <> 'sensitive_private_fact'"), "claim_id"),
    }


@rule("L30", "L31", "L32", "L33")
def source_floor(t):
    r = t["reviews"]
    proof = r.select("ledger_id", "claim_id", F.col("r.legal_stage").alias("stage"), "r.source_floor", "r.accountable_source_ids").join(t["claim_evidence"], ["ledger_id", "claim_id"]).withColumn("stages", asr.legal_stages("text"))
    harm = F.col("text").rlike(f"(?i){asr.HARM}") | F.col("text").rlike(f"(?i){asr.PRIVATE}")
    supporting = proof.where(((F.col("stage") == "nonlegal") & harm) | F.array_contains("stages", F.coalesce("stage", F.lit(""))))
    counted = supporting.join(t["families"], ["ledger_id", "source_id"]).groupBy("ledger_id", "claim_id").agg(F.count_distinct("component").alias("n"))
    met = r.where("r.source_floor = 'met'")
    accountable = supporting.where(F.array_contains("accountable_source_ids", F.col("source_id"))).join(t["sources"].where(F.col("accountability_basis").isin(ACCOUNTABLE)).select("ledger_id", "source_id"), ["ledger_id", "source_id"])
    single = r.where("r.source_floor = 'single_source_limited'").withColumn("limitation", tx.clean(F.col("r.sourcing_limitation_excerpt")))
    modest = (F.col("kind") == "reported_claim") & (F.coalesce("importance", F.lit("")) != "key") & (F.col("confidence") == "low") & (F.coalesce(F.col("triangulation.status"), F.lit("")) == "limited") & (F.col("limitation") != "") & F.contains(F.lower("text"), F.lower("limitation"))
    reach = graph.closure(t["claim_edges"].where("relation = 'supports'").join(t["known_claims"], ["ledger_id", "claim_id"], "left_semi").select(F.struct("ledger_id", "claim_id").alias("src"), F.struct("ledger_id", F.col("related_id").alias("claim_id")).alias("dst")))
    key = t["claims"].where("importance = 'key' AND included").select("ledger_id", F.col("claim_id").alias("key_claim"))
    above = reach.select("src.ledger_id", F.col("src.claim_id").alias("key_claim"), F.col("dst.claim_id").alias("claim_id")).join(key, ["ledger_id", "key_claim"]).where("key_claim <> claim_id")
    return {
        "L30": found(met.join(counted, ["ledger_id", "claim_id"], "left").where("coalesce(n, 0) < 2"), "claim_id"), "L31": found(met.join(accountable.select("ledger_id", "claim_id").distinct(), ["ledger_id", "claim_id"], "left_anti"), "claim_id"),
        "L32": found(single.where(~F.coalesce(modest, F.lit(False))), "claim_id"), "L33": found(single.select("ledger_id", "claim_id").join(above, ["ledger_id", "claim_id"]).select("ledger_id", "claim_id").distinct(), "claim_id"),
    }


@rule("L34", "L35a", "L35b", "L35c", "L36", "L39", "L40")
def harm_stages(t):
    r = t["reviews"].withColumns({"stage": F.coalesce(F.col("r.legal_stage"), F.lit("")), "attributed": tx.clean(F.col("r.attributed_to")), "resolution_state": F.coalesce(F.col("r.resolution_status"), F.lit("")), "resolution_search": F.col("r.resolution_search")})
    legal = r.where("stage <> 'nonlegal'")
    unresolved = r.where("resolution_state = 'unresolved'")
    return {
        "L34": found(r.where(F.expr("attributed = '' OR NOT contains(lower(text), lower(attributed))")), "claim_id"),
        "L35a": found(r.where("stage = 'nonlegal' AND size(claim_stages) + size(evidence_stages) > 0"), "claim_id"), "L35b": found(legal.where("NOT array_contains(claim_stages, stage)"), "claim_id", "stage"),
        "L35c": found(legal.where("NOT array_contains(evidence_stages, stage)"), "claim_id", "stage"), "L36": found(legal.where("resolution_state = 'not_applicable'"), "claim_id"),
        "L39": found(unresolved.where("arrays_overlap(evidence_stages, array('acquitted', 'overturned', 'expunged', 'retracted'))"), "claim_id"), "L40": found(unresolved.where(stale_search("resolution_search")), "claim_id"),
    }


@rule("L37a", "L37b", "L38")
def resolutions(t):
    r = t["reviews"].where("r.resolution_status = 'resolved'").withColumn("ids", F.coalesce("r.resolution_claim_ids", F.array().cast("array<string>")))
    other = t["claims"].select("ledger_id", F.col("claim_id").alias("other"), F.coalesce("person_claim_role", F.lit("")).alias("other_role"), F.coalesce("resolves_claim_ids", F.array().cast("array<string>")).alias("resolves"), F.coalesce("person_ids", F.array().cast("array<string>")).alias("other_people"), texts("report_excerpts").alias("other_excerpts"))
    each = r.select("ledger_id", "claim_id", "linked_people", "included", texts("report_excerpts").alias("excerpts"), F.explode("ids").alias("other")).join(other, ["ledger_id", "other"], "left")
    unknown = r.where("size(ids) = 0").select("ledger_id", "claim_id").unionByName(each.where("other_role IS NULL").select("ledger_id", "claim_id")).distinct()
    shared = each.groupBy("ledger_id", "claim_id").agg(F.bool_or(F.coalesce(F.arrays_overlap("excerpts", "other_excerpts"), F.lit(False))).alias("ok"))
    return {
        "L37a": found(unknown, "claim_id"), "L37b": found(each.where("other_role IS NOT NULL AND NOT (other_role = 'resolution' AND array_contains(resolves, claim_id) AND coalesce(arrays_overlap(other_people, linked_people), false))"), "claim_id", "other"),
        "L38": found(r.where("included").join(shared, ["ledger_id", "claim_id"], "left").where("NOT coalesce(ok, false)"), "claim_id"),
    }


@rule("L41a", "L41b", "L41c", "L41d", "L41e", "L41f", "L41g", "L41h")
def right_of_reply(t):
    r = t["reviews"].withColumn("reply", F.col("r.right_of_reply"))
    r = r.withColumns({"reply_status": F.col("reply.status"), "ids": F.coalesce("reply.response_claim_ids", F.array().cast("array<string>")), "search": F.col("reply.search_record")})
    told = r.where("reply_status IN ('documented', 'declined')")
    admitted = t["claim_sources"].join(t["sources"].where("accountability_basis = 'subject_admission'").select("ledger_id", "source_id"), ["ledger_id", "source_id"]).select("ledger_id", F.col("claim_id").alias("other")).distinct().withColumn("admitted", F.lit(True))
    other = t["claims"].select("ledger_id", F.col("claim_id").alias("other"), F.coalesce("person_claim_role", F.lit("")).alias("other_role"), F.coalesce("responds_to_claim_ids", F.array().cast("array<string>")).alias("responds"), F.coalesce("person_ids", F.array().cast("array<string>")).alias("other_people"), texts("report_excerpts").alias("other_excerpts")).join(admitted, ["ledger_id", "other"], "left")
    each = told.select("ledger_id", "claim_id", "linked_people", "included", texts("report_excerpts").alias("excerpts"), F.explode("ids").alias("other")).join(other, ["ledger_id", "other"], "left")
    known = each.where("other_role IS NOT NULL")
    unknown = told.where("size(ids) = 0").select("ledger_id", "claim_id").unionByName(each.where("other_role IS NULL").select("ledger_id", "claim_id")).distinct()
    elsewhere = known.where("NOT coalesce(arrays_overlap(other_people, linked_people), false)").select("ledger_id", "claim_id").distinct().join(unknown, ["ledger_id", "claim_id"], "left_anti")
    return {
        "L41a": found(r.where("reply IS NULL"), "claim_id"), "L41b": found(unknown, "claim_id"), "L41c": found(elsewhere, "claim_id"), "L41d": found(known.where("NOT (other_role = 'response' AND array_contains(responds, claim_id))"), "claim_id", "other"),
        "L41e": found(known.where("admitted IS NULL"), "claim_id", "other"), "L41f": found(known.where("included AND NOT coalesce(arrays_overlap(excerpts, other_excerpts), false)"), "claim_id", "other"),
        "L41g": found(r.where("reply_status = 'no_public_response'").where(stale_search("search")), "claim_id"),
        "L41h": found(r.where("reply_status = 'not_applicable' AND NOT (coalesce(r.category, '') = 'sensitive_private_fact' AND coalesce(r.privacy_basis, '') = 'self_disclosed')"), "claim_id"),
    }


@rule("L42")
def privacy_basis(t):
    r = t["reviews"].where("r.category = 'sensitive_private_fact'").withColumns({"basis": F.coalesce("r.privacy_basis", F.lit("")), "ids": F.coalesce("r.privacy_basis_source_ids", F.array().cast("array<string>"))})
    each = r.select("ledger_id", "claim_id", "basis", "source_ids", F.explode("ids").alias("source_id")).where(F.array_contains("source_ids", F.col("source_id"))).join(t["sources"].select("ledger_id", "source_id", "roles", "accountability_basis"), ["ledger_id", "source_id"])
    good = each.where("(basis = 'self_disclosed' AND array_contains(roles, 'subject_official')) OR (basis = 'court_or_regulator_record' AND accountability_basis = 'court_or_regulator_record')").select("ledger_id", "claim_id").distinct().withColumn("good", F.lit(True))
    checked = r.join(good, ["ledger_id", "claim_id"], "left")
    return found(checked.where(F.col("good").isNull() | ~F.col("basis").isin("self_disclosed", "court_or_regulator_record") | (F.char_length(tx.clean(F.col("r.governing_question_relevance"))) < 40)), "claim_id")


# ---- evidence

@rule("L46a", "L46b", "L46c", "L46d", "L46e", "L46f")
def derivations(t):
    d = t["derived"]
    some = d.where("expression <> ''")
    folded = F.lower("expression")
    ascii_word = F.concat(F.lit(r"(?U)(?<!\w)\Q"), folded, F.lit(r"\E(?!\w)"))
    within = F.when(F.col("expression").rlike(r"^\p{ASCII}*$"), F.regexp(F.lower("text"), ascii_word)).otherwise(F.contains(F.lower("text"), folded))
    return {
        "L46a": found(d.where("expression = ''"), "claim_id"), "L46b": found(some.where(~within), "claim_id", "expression"), "L46c": found(some.where(F.expr("evidence <> '' AND contains(lower(evidence), lower(expression))")), "claim_id", "expression"),
        "L46d": found(some.groupBy("ledger_id", "claim_id", folded.alias("expression")).agg(F.count("*").alias("n")).where("n > 1"), "claim_id", "expression"), "L46e": found(some.where(F.char_length("derivation") < 40), "claim_id", "expression"),
        "L46f": found(d.groupBy("ledger_id", "claim_id", "kind").agg(F.count("*").alias("n")).where("n > 2 AND coalesce(kind, '') <> 'estimate'"), "claim_id"),
    }


@rule("L47", "L48", "L49", "L50", "L51a", "L51b")
def evidence_binding(t):
    c = t["claims_raw"]
    below = t["claim_edges"].where("relation = 'supports'").join(t["claims"].select("ledger_id", F.col("claim_id").alias("related_id"), F.col("evidence").alias("other")), ["ledger_id", "related_id"]).groupBy("ledger_id", "claim_id").agg(F.array_sort(F.collect_list(F.struct("at", "other"))).alias("below"))
    dates = t["direct"].join(t["sources"].select("ledger_id", "source_id", "accessed", "published", "accessed_day", "published_day"), ["ledger_id", "source_id"]).groupBy("ledger_id", "claim_id").agg(F.flatten(F.collect_list(F.array(F.when(F.col("accessed_day").isNotNull(), F.col("accessed")), F.when(F.col("published_day").isNotNull(), F.col("published"))))).alias("dates"))
    j = c.join(below, ["ledger_id", "claim_id"], "left").join(dates, ["ledger_id", "claim_id"], "left")
    inherited = F.when(F.col("kind") == "analysis", F.array_join(F.transform(F.coalesce("below", F.array()), lambda s: s["other"]), " ")).otherwise("")
    own = F.array(F.when(F.col("as_of_day").isNotNull(), F.col("as_of")), F.when(F.col("verified_day").isNotNull(), F.col("verified_at")))
    empty = F.array().cast("array<string>")
    derived = F.transform(F.coalesce("derived_assertions", F.array()), lambda d: tx.clean(d["expression"]))
    gaps = j.select("ledger_id", "claim_id", F.explode(asr.evidence_gaps("kind", "text", "evidence", inherited, F.concat(own, F.coalesce("dates", empty)), F.coalesce("assumptions", empty), F.coalesce(derived, empty))).alias("g"))
    return {i: found(gaps.where(F.col("g.rule") == i), "claim_id", "g.what") for i in ("L47", "L48", "L49", "L50", "L51a", "L51b")}


@rule("L52a", "L52b", "L52c", "L52d", "L52e")
def absence(t):
    c = t["judged_claims"].where(F.col("text").rlike(f"(?i){asr.ABSENCE}")).withColumn("e", F.col("evidence_of_absence"))
    r = c.where("e IS NOT NULL").withColumn("at", F.when(F.col("e.searched_at").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(F.col("e.searched_at"), "yyyy-MM-dd")))
    empty = lambda f: F.size(texts(f"e.{f}")) == 0
    both = r.where(empty("queries")).select("ledger_id", "claim_id", F.lit("queries").alias("field")).unionByName(r.where(empty("expected_locations")).select("ledger_id", "claim_id", F.lit("expected_locations").alias("field")))
    return {"L52a": found(c.where("e IS NULL"), "claim_id"), "L52b": found(both, "claim_id", "field"), "L52c": found(r.where("at IS NULL"), "claim_id"), "L52d": found(r.where("at > report_day"), "claim_id"), "L52e": found(r.where(f"datediff(report_day, at) > {FRESH_DAYS}"), "claim_id")}


@rule("L53a", "L53b", "L53c", "L53d", "L53e", "L53f")
def verification(t):
    c = t["judged_claims"].join(t["own_grounds"].select("ledger_id", "claim_id", "last_access"), ["ledger_id", "claim_id"], "left")
    v = c.where("verified_day IS NOT NULL")
    return {
        "L53a": found(c.where("verified_at IS NOT NULL AND verified_day IS NULL"), "claim_id"), "L53b": found(c.where("verified_at IS NULL AND sensitive_to_time"), "claim_id"), "L53c": found(v.where("verified_day > report_day"), "claim_id"),
        "L53d": found(v.where("verified_day < as_of_day"), "claim_id"), "L53e": found(v.where("verified_day > last_access"), "claim_id"), "L53f": found(v.where(f"sensitive_to_time AND datediff(report_day, verified_day) > {FRESH_DAYS}"), "claim_id"),
    }


@rule("L54", "L55a", "L55b")
def estimates_and_dates(t):
    c = t["judged_claims"]
    return {"L54": found(c.where((F.col("kind") == "estimate") & (F.size(texts("assumptions")) == 0)), "claim_id"), "L55a": found(c.where("sensitive_to_time AND as_of_day IS NULL"), "claim_id"), "L55b": found(c.where(f"sensitive_to_time AND datediff(report_day, as_of_day) > {FRESH_DAYS}"), "claim_id")}


@rule("L56", "L57a", "L57b", "L58")
def current_sources(t):
    """One cascade for a source of a time-sensitive claim: undated without a reason ends it."""
    c = t["judged_claims"].where("sensitive_to_time").select("ledger_id", "claim_id", "report_day")
    s = c.join(t["foundations"], ["ledger_id", "claim_id"]).join(t["sources"], ["ledger_id", "source_id"]).withColumn("reason", tx.clean(F.col("undated_reason")))
    undated = (F.coalesce("published", F.lit("")) == "") & (F.col("reason") == "")
    rest = s.where(~undated)
    old = F.col("published_day").isNull() | F.coalesce(F.datediff("report_day", "published_day") > FRESH_DAYS, F.lit(False))
    return {
        "L56": found(s.where(undated), "source_id", "claim_id"), "L57a": found(rest.where("report_day IS NOT NULL AND accessed_day IS NULL"), "source_id", "claim_id"),
        "L57b": found(rest.where(f"datediff(report_day, accessed_day) > {FRESH_DAYS}"), "source_id", "claim_id"), "L58": found(rest.where(old & ~F.col("reason").rlike(f"(?i){asr.CONTINUOUS}")), "source_id", "claim_id"),
    }


# ---- independence

@rule("L59", "L60", "L61", "L62", "L63", "L64")
def triangulation(t):
    c = t["claims_raw"].join(t["grounds"].select("ledger_id", "claim_id", "n", "any_independent", "families"), ["ledger_id", "claim_id"], "left").withColumns({"tri": F.coalesce("triangulation.status", F.lit("")), "families": F.coalesce("families", F.lit(0)), "any_independent": F.coalesce("any_independent", F.lit(False))})
    k = c.where("kind = 'analysis' AND importance = 'key'")
    return {
        "L59": found(c.where("confidence = 'high' AND status = 'inference' AND n > 0 AND NOT any_independent"), "claim_id"), "L60": found(k.where("tri = 'met' AND families < 2"), "claim_id", "families"), "L61": found(k.where("tri = 'met' AND NOT any_independent"), "claim_id"),
        "L62": found(k.where("tri = 'limited' AND confidence = 'high'"), "claim_id"), "L63": found(k.where((F.col("tri") == "limited") & (tx.clean(F.col("limitations")) == "")), "claim_id"), "L64": found(k.where("tri = 'not_applicable'"), "claim_id"),
    }


@rule("L65", "L66", "L67")
def key_claims(t):
    """Judged on a claim's own sources; where it has none, on those one level below."""
    key = t["claims_raw"].where("importance = 'key'").select("ledger_id", "claim_id")
    own = t["own_grounds"].select("ledger_id", "claim_id", F.struct("n", "all_interested", "roles").alias("own"))
    all_ = t["grounds"].select("ledger_id", "claim_id", F.struct("n", "all_interested", "roles").alias("all"))
    g = key.join(own, ["ledger_id", "claim_id"], "left").join(all_, ["ledger_id", "claim_id"], "left").withColumn("g", F.coalesce("own", "all"))
    return {"L65": found(g.where("g IS NULL"), "claim_id"), "L66": found(g.where("g.all_interested"), "claim_id"), "L67": found(g.where("size(g.roles) > 0 AND forall(g.roles, r -> r = 'subject_official')"), "claim_id")}


@rule("L68", "L69")
def support_graph(t):
    node = lambda c: F.struct("ledger_id", F.col(c).alias("claim_id"))
    edges = t["claim_edges"].where("relation = 'supports'").join(t["known_claims"], ["ledger_id", "claim_id"], "left_semi")
    edges = edges.join(t["known_claims"].withColumnRenamed("claim_id", "related_id"), ["ledger_id", "related_id"], "left_semi").select(node("claim_id").alias("src"), node("related_id").alias("dst"))
    grounded = graph.reaching(edges, t["direct"].join(t["known_claims"], ["ledger_id", "claim_id"], "left_semi").select(node("claim_id").alias("node"))).select("node.ledger_id", "node.claim_id")
    analysis = t["claims"].where("kind = 'analysis' AND included")
    return {"L68": found(analysis.join(grounded, ["ledger_id", "claim_id"], "left_anti"), "claim_id"), "L69": found(graph.on_cycles(edges).select("node.ledger_id", "node.claim_id"), "claim_id")}


# ---- synthesis

@rule("L70", "L71", "L72", "L73", "L74", "L75", "L76a", "L76b", "L77a", "L77b", "L78a", "L78b", "L79")
def synthesis(t):
    refs, claims = t["synthesis_refs"], t["claims"]
    part = lambda p: refs.where(F.col("part") == p)
    central = part("central").select("ledger_id", "claim_id").distinct()
    key = claims.where("importance = 'key' AND included").select("ledger_id", "claim_id")
    known_central = part("central").join(t["known_claims"], ["ledger_id", "claim_id"], "left_semi")
    counter = part("counter").join(t["known_claims"], ["ledger_id", "claim_id"], "left_semi")
    high = t["coverage_claims"].where("priority = 'high'").select("ledger_id", "claim_id").distinct()
    out = {
        "L70": found(lacking(part("central"), t["known_claims"], "claim_id"), "claim_id"), "L71": found(known_central.join(key, ["ledger_id", "claim_id"], "left_anti"), "claim_id"),
        "L72": found(key.join(t["ledgers"].where("has_synthesis").select("ledger_id"), "ledger_id").join(central, ["ledger_id", "claim_id"], "left_anti"), "claim_id"), "L73": found(lacking(part("counter"), t["known_claims"], "claim_id"), "claim_id"),
        "L74": found(lacking(part("test").where("claim_id IS NOT NULL"), t["known_claims"], "claim_id"), "claim_id"), "L75": found(counter.join(part("test").select("ledger_id", "claim_id").distinct(), ["ledger_id", "claim_id"], "left_anti"), "claim_id"),
        "L79": found(known_central.join(high, ["ledger_id", "claim_id"], "left_anti"), "claim_id"),
    }
    for number, p in (("L76", "implication"), ("L77", "takeaway"), ("L78", "scenario")):
        linked = part(p).join(central, ["ledger_id", "claim_id"], "left_semi").select("ledger_id", "item").distinct()
        out[f"{number}a"] = found(lacking(part(p).where("claim_id IS NOT NULL"), t["known_claims"], "claim_id"), "claim_id")
        out[f"{number}b"] = found(part(p).select("ledger_id", "item").distinct().join(linked, ["ledger_id", "item"], "left_anti"), "item")
    return out


@rule("L80", "L81")
def family_labels(t):
    s = t["sources"]
    split = s.where("domain <> '' AND family <> ''").groupBy("ledger_id", "domain").agg(F.count_distinct("family").alias("n"), F.bool_or(~F.col("justified")).alias("bare")).where("n > 1 AND bare")
    kind = F.when(F.col("independent"), "independent").when(F.col("interested"), "interested").otherwise(F.nullif("provenance", F.lit("")))
    mixed = s.where("host <> ''").groupBy("ledger_id", "host").agg(F.count_distinct(kind).alias("n"), F.bool_or(~F.col("justified")).alias("bare")).where("n > 1 AND bare")
    return {"L80": found(split, "domain"), "L81": found(mixed, "host")}


def findings(tables: dict[str, DataFrame], only: set[str] | None = None) -> DataFrame:
    """All rules' findings, or those of the rule functions named in ``only``. Ledgers without any finding give no rows.

    The flattened tables are written once in the checkpoint folder, so the rules don't parse the ledgers again.
    """
    t = Relations({name: graph._settled(df) for name, df in tables.items()})
    out: DataFrame | None = None
    for name, (ids, fn) in RULES.items():
        if only and name not in only:
            continue
        made = fn(t)
        for rule_id, df in (made if isinstance(made, dict) else {ids[0]: made}).items():
            one = df.select("ledger_id", F.lit(rule_id).alias("rule_id"), F.lit("error").alias("severity"), "entity_id", "detail")
            out = one if out is None else out.unionByName(one)
    return out
