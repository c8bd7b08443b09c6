"""A sound ledger has no findings; each change to it raises its rule."""

import copy
import json

import pytest

from attesta.operators import fidelity, ledger_rules
from attesta.sources import ledgers as src

DAY = "2026-07-28"


def source(i, provenance="primary_independent", **more):
    return {"source_id": f"S{i}", "title": f"T{i}", "url": f"https://site{i}.example/p{i}", "publisher": f"Publisher {i}", "published": "2026-07-01", "accessed": "2026-07-20", "provenance": provenance, "source_family": f"family {i}", "roles": ["empirical_data"]} | more


def claim(i, text, extract, sources=("S1",), **more):
    return {
        "claim_id": f"C{i}", "claim": text, "kind": "fact", "importance": "supporting", "source_ids": list(sources), "source_evidence": [{"source_id": s, "extract_or_location": extract} for s in sources], "as_of": "2026-07-10", "confidence": "medium", "status": "supported",
        "include_in_report": True, "report_excerpts": [text], "supports": [], "contradicts": [], "person_ids": [], "triangulation": {"status": "limited", "rationale": "r"}, "limitations": "one reading",
    } | more


def ledger():
    key = claim(3, "The line gains from both ports.", "", (), kind="analysis", importance="key", supports=["C1", "C2"], source_evidence=[], triangulation={"status": "met", "rationale": "r"})
    return {
        "schema_version": 4, "report_date": DAY, "brief": {"archetype": "topic", "report_language": "en"}, "people": [{"person_id": "P1", "name": "Ada Quill", "aliases": [], "living_status": "living", "relationship": "adjacent"}],
        "sources": [source(1), source(2, "primary_interested")], "claims": [claim(1, "Traffic was 35,000 units.", "Traffic was 35,000 units"), claim(2, "Costs were 12 million.", "costs were 12 million", ("S2",)), key],
        "coverage": [{"area": "traffic", "priority": "high", "status": "supported", "claim_ids": ["C1", "C3"]}],
        "synthesis": {"central_judgment_claim_ids": ["C3"], "counterevidence_claim_ids": ["C2"], "adversarial_tests": [{"claim_ids": ["C2"]}], "implications": [{"claim_ids": ["C3"]}], "decisions_or_takeaways": [{"rationale_claim_ids": ["C3"]}], "scenarios": [{"claim_ids": ["C3"]}]},
    }


def put(path, value):
    def change(d):
        *way, last = path
        for p in way:
            d = d[p]
        d[last] = value

    return change


C1, C3, S1, COVER, SYN = ("claims", 0), ("claims", 2), ("sources", 0), ("coverage", 0), ("synthesis",)
CHANGES = {
    "L01": put((*S1, "provenance"), "primary_interested"), "L02": lambda d: d["sources"].append(source(1)), "L03": lambda d: d["claims"].append(copy.deepcopy(d["claims"][0])), "L05": put(("sources", 1, "url"), "HTTPS://SITE1.example/p1/#x"),
    "L06": put((*COVER, "claim_ids"), ["C1", "C9"]), "L07": put((*COVER, "status"), "in_progress"), "L08": put((*COVER, "status"), "gap"), "L09": put((*COVER, "status"), "gap"), "L10": put((*COVER, "status"), "disputed"), "L11": put((*COVER, "claim_ids"), []),
    "L12": put((*S1, "published"), "2026-08-01"), "L13": put((*S1, "accessed"), "2026-08-01"), "L14": put((*S1, "published"), "2026-07-21"), "L15": put((*COVER, "claim_ids"), ["C2"]), "L16": put((*C1, "as_of"), "2026-08-01"),
    "L17": put((*C1, "source_ids"), ["S1", "S9"]), "L18": lambda d: d["claims"][0]["source_evidence"].append({"source_id": "S1", "extract_or_location": "x"}), "L19": lambda d: d["claims"][0]["source_evidence"].append({"source_id": "S2", "extract_or_location": "x"}),
    "L20": put((*C1, "source_ids"), ["S1", "S2"]), "L21": put((*C1, "person_ids"), ["P9"]), "L22": put((*C1, "person_ids"), ["P1"]), "L23": put((*C1, "person_ids"), ["P1"]), "L24": put((*C1, "claim"), "Ada Quill counted 35,000 units."),
    "L28": lambda d: d["claims"][0].update(person_ids=["P1"], person_claim_role="harmful"), "L43a": put((*C1, "supports"), ["C1"]), "L43b": put((*C1, "supports"), ["C9"]), "L44": put((*C1, "contradicts"), ["C2"]), "L45a": put((*C1, "status"), "disputed"), "L45b": put((*C1, "status"), "disputed"),
    "L46b": put((*C1, "derived_assertions"), [{"expression": "seven", "derivation": "x" * 50}]), "L46e": put((*C1, "derived_assertions"), [{"expression": "Traffic", "derivation": "short"}]), "L47": put((*C1, "claim"), "Traffic was 36,000 units."),
    "L48": put((*C1, "claim"), "Traffic increased to 35,000 units."), "L49": put((*C1, "claim"), "Traffic of 35,000 units was approved."), "L50": put((*C1, "derived_assertions"), [{"expression": "Traffic", "derivation": "x" * 50}]), "L51a": put((*C1, "source_evidence"), []),
    "L52a": put((*C1, "claim"), "No public record exists for 35,000 units."), "L53a": put((*C1, "verified_at"), "soon"), "L53e": put((*C1, "verified_at"), "2026-07-25"), "L54": put((*C1, "kind"), "estimate"), "L53b": put((*C1, "time_sensitive"), True),
    "L55b": lambda d: d["claims"][0].update(time_sensitive=True, as_of="2026-05-01", verified_at="2026-07-15"), "L57b": lambda d: (d["claims"][0].update(time_sensitive=True, verified_at="2026-07-15"), d["sources"][0].update(accessed="2026-05-01", published="2026-04-01")),
    "L60": put((*C3, "supports"), ["C1"]), "L62": lambda d: d["claims"][2].update(triangulation={"status": "limited"}, confidence="high"), "L64": put((*C3, "triangulation"), {"status": "not_applicable"}), "L65": put((*C3, "supports"), []), "L66": put((*C3, "supports"), ["C2"]),
    "L67": lambda d: [s.update(roles=["subject_official"]) for s in d["sources"]], "L68": put((*C3, "supports"), []), "L69": put((*C1, "supports"), ["C3"]), "L70": put((*SYN, "central_judgment_claim_ids"), ["C3", "C9"]), "L71": put((*SYN, "central_judgment_claim_ids"), ["C3", "C1"]),
    "L72": put((*SYN, "central_judgment_claim_ids"), []), "L73": put((*SYN, "counterevidence_claim_ids"), ["C9"]), "L74": put((*SYN, "adversarial_tests"), [{"claim_ids": ["C2", "C9"]}]), "L75": put((*SYN, "adversarial_tests"), []),
    "L76b": put((*SYN, "implications"), [{"claim_ids": ["C1"]}]), "L77a": put((*SYN, "decisions_or_takeaways"), [{"rationale_claim_ids": ["C3", "C9"]}]), "L78b": put((*SYN, "scenarios"), [{"claim_ids": []}]), "L79": put((*COVER, "priority"), "medium"),
    "L80": lambda d: d["sources"].append(source(3, url="https://site1.example/other")), "L81": lambda d: d["sources"].append(source(3, "primary_interested", url="https://site1.example/other")),
}


@pytest.fixture(scope="module")
def found(spark):
    docs = [("sound", json.dumps(ledger()))]
    for name, change in CHANGES.items():
        d = copy.deepcopy(ledger())
        change(d)
        docs.append((name, json.dumps(d)))
    docs += [("broken", "{not json"), ("empty", "{}")]
    parsed = src.parse_ledgers(spark.createDataFrame(docs, "id string, body string"), "body", "id")
    tables = src.flatten(parsed)
    out: dict = {}
    for r in ledger_rules.findings(tables).collect():
        out.setdefault(r.ledger_id, set()).add(r.rule_id)
    return out


def test_sound(found):
    assert "sound" not in found and "broken" not in found and "empty" not in found


@pytest.mark.parametrize("rule", sorted(CHANGES))
def test_rule(found, rule):
    assert rule in found.get(rule, set())


def test_samples(spark):
    tables = src.flatten(src.parse_ledgers(spark.createDataFrame([("a", json.dumps(ledger()))], "id string, body string"), "body", "id"))
    got = fidelity.samples(tables, 1).collect()
    assert [(r.claim_id, r.source_id) for r in got] == [("C1", "S1")]
    pages = spark.createDataFrame([("https://site1.example/p1", "<p>Traffic was <b>35,000</b> units</p><p hidden>x</p>")], "url string, html string")
    assert {r.source_id: r.status for r in fidelity.checks(fidelity.samples(tables, 0), pages).collect()} == {"S1": "verified", "S2": "unverified"}
