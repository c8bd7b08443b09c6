import json

import pytest
from pyspark.sql import functions as F

from attesta.functions import markdown as md
from attesta.functions import network, regions
from attesta.functions import text as tx
from attesta.functions import urls as ux
from attesta.operators import gates, graph, pages, probes, reports, rewrites, style, vectors

REPORT = """# A title

> 28 July 2026
> Prepared by: Ada Quill

## First part

Traffic rose to 35,000 units ([One](https://one.example/a_(b)); [Two](https://two.example/c)). It was `code` here.

- item one
- item two [Three](https://three.example)

| A | B |
|---|---|
| x | 1 |

```
[not](https://code.example) a link
```

## Sources

- [One](https://one.example/a_(b))
- [Two](https://two.example/c)
"""


def col(spark, values, fn, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_urls(spark):
    given = ["HTTPS://User@WWW.Shop.Example.co.uk:8080/a/?q=1#f", "http://a.b.example.com", "http://10.0.0.1/x", "nothing", None]
    assert col(spark, given, ux.host) == ["www.shop.example.co.uk", "a.b.example.com", "10.0.0.1", "", ""]
    assert col(spark, given, ux.registrable_domain) == ["example.co.uk", "example.com", "10.0.0.1", "", ""]
    assert col(spark, given, ux.normalised_url)[:2] == ["https://user@www.shop.example.co.uk:8080/a?q=1", "http://a.b.example.com/"]
    assert col(spark, ["https://x.example/", "http://127.0.0.1/", "https://u:p@x.example/", "https://x.example:8080/", "ftp://x.example", "https://localhost/", "https://192.168.1.1/a"], ux.admissible) == [True] + [False] * 6


def test_addresses():
    assert [network.is_public(a) for a in ("8.8.8.8", "10.1.2.3", "169.254.169.254", "::ffff:127.0.0.1", "2002:7f00:1::", "2606:4700::1111", "fc00::1", "x", None)] == [True, False, False, False, False, True, False, False, False]


def test_text(spark):
    assert col(spark, ["Dr. Quill left. He won 4.5 points."], lambda x: F.size(tx.sentences(x, "en"))) == [2]
    assert col(spark, ["一。二！三"], lambda x: F.size(tx.sentences(x, "zh"))) == [3]
    assert tx.normal("“A”–b​&amp;  Ｃ") == '"a"-b& c'
    assert tx.visible("<p>a<b hidden>no</b></p><div style='display: none'><p>no</p></div><script>no</script><i aria-hidden=true>no</i> z") == "a z"
    assert col(spark, ["關係 係"], tx.cantonese_hits) == [1]
    assert col(spark, ["der und die", "the and of", ""], tx.stop_word_language) == ["de", "en", "en"]
    assert col(spark, ["<b onclick=x>ok</b><script>no</script><a href='javascript:x'>y</a>"], tx.sanitised_html) == ["<b>ok</b><a>y</a>"]
    assert col(spark, [None, "a b", "漢 a"], tx.visual_width) == [None, 2, 3]


def test_markdown():
    kinds = [b.kind for b in md.blocks(REPORT)]
    assert kinds.count("list") == 4 and kinds.count("table_header") == 2 and kinds.count("table_row_label") == 1 and kinds.count("heading") == 3
    assert [u for u, *_ in md.destinations(REPORT)] == ["https://one.example/a_(b)", "https://two.example/c", "https://three.example", "https://one.example/a_(b)", "https://two.example/c"]
    assert sum(b.in_bibliography for b in md.blocks(REPORT)) == 3
    assert "Traffic rose to 35,000 units. It was code here." in md.compared_prose(REPORT)
    assert md.raw_urls("see https://a.example and [x](https://b.example)\n\n[r]: https://c.example") == ["https://a.example"]
    assert md.metadata(REPORT)["prepared_by"] == "Ada Quill" and md.metadata(REPORT)["date"] == "28 July 2026"
    assert [md.safe_label(x) for x in ("Ada Quill", "Northern Freight Research", "we think that", "a: b", "")] == [True, True, False, False, False]


def test_structure(spark):
    rows = [("good", REPORT, "en"), ("empty", " ", "en"), ("null", None, "en"), ("bare", "text only https://x.example", "en"), ("late", REPORT + "\n## More\n\ntext\n", "en")]
    got = {}
    for r in reports.structure(spark.createDataFrame(rows, "report_id string, text string, language string")).collect():
        got.setdefault(r.report_id, set()).add(r.rule_id)
    assert got == {"good": {"P-short"}, "empty": {"P-empty"}, "null": {"P-empty"}, "bare": {"P-title", "P-short", "P-sections", "P-no-sources"}, "late": {"P-short", "P-sources-last"}}


CHANGED = [
    ("Revenue rose because of exports.", "Revenue fell because of exports.", "en", "direction"), ("The plan was not approved by the board.", "The plan was approved by the board.", "en", "negation"), ("Output grew due to demand.", "Output grew due to subsidies.", "en", "cause replaced"),
    ("The route opened in May.", "The route opened in May because of tolls.", "en", "cause added"), ("營收上升，由於出口增加。", "營收下降，由於出口增加。", "zh-HK", "direction"), ("成本没有增加。", "成本增加。", "zh-CN", "negation"),
]


@pytest.mark.parametrize("source, report, lang, kind", CHANGED)
def test_meaning(source, report, lang, kind):
    assert kind in {k for k, *_ in rewrites.compare(source, report, lang)}
    assert rewrites.compare(source, source, lang) == []


def test_split_is_excused():
    kinds = {k for k, *_ in rewrites.compare("The ferry sails at dawn and it does not wait for late freight", "The ferry sails at dawn. And it does not wait for late freight", "en")}
    assert kinds <= {"excused negation", "excused association"}


def test_notes():
    found = [("negation", "the plan was not approved", "the plan was approved"), ("negation", "the plan was not approved", "the plan was approved"), ("direction", "it rose", "it fell")]
    notes = [{"source_fragment": "Not Approved", "report_fragment": "was approved", "reason": "x"}, {"source_fragment": "rose", "report_fragment": "fell", "reason": "x"}]
    remaining, done, unused = rewrites.acknowledge(found, notes)
    assert len(done) == 1 and len(remaining) == 2 and unused == [1]


def test_fidelity_columns(spark):
    d = spark.createDataFrame([(1, "Smith said output rose 5% at Acme. It fell.", "Output rose 7% at Acme and Zentra. Everyone saw that, we will fix it.")], "id int, s string, r string")
    s, r = F.col("s"), F.col("r")
    row = d.select(rewrites.raised_severity(s, r).alias("a"), rewrites.new_numbers(s, r).alias("b"), rewrites.new_names(s, r).alias("c"), rewrites.new_promises(s, r).alias("e")).first()
    assert row.a == ["everyone"] and set(row.b) == {"7%", "7"} and row.c == ["zentra"] and row.e == ["first person"]
    assert rewrites.orphaned(d, "s", "r", "id").count() == 1


def test_style(spark):
    rows = [("flat", "Moreover, we delve deep. " * 10), ("none", None), ("short", "One two. Three.")]
    got = {(r.doc_id, r.rule_id) for r in style.check(spark.createDataFrame(rows, "doc_id string, text string"), "en").collect()}
    assert got == {("flat", "M-uniform"), ("flat", "M-opener"), ("flat", "M-vocabulary")}
    pair = "the quick brown fox jumps over the lazy dog near the old mill"
    d = spark.createDataFrame([("a", "b1", pair), ("b", "b1", pair + " today"), ("c", "b2", pair)], "doc_id string, batch string, text string")
    assert [(r.left, r.right) for r in style.siblings(d, "en", "batch").collect()] == [("a", "b")]
    assert {r.element for r in style.genre_gaps(spark.createDataFrame([("x", "今日發佈")], "doc_id string, text string"), "release").collect()} == {"where"}


def test_regions(spark):
    simplified, traditional = regions.scripts()
    assert "们" in simplified and "們" in traditional and "人" not in simplified + traditional
    d = spark.createDataFrame([("a", "我們的網路和关系，相關系統，關系我們，您好"), ("b", "香港的網絡")], "doc_id string, text string")
    got = {(r.doc_id, r.rule_id): r.detail for r in regions.region_findings(d, "hk").collect()}
    assert got == {("a", "G-foreign"): "網路", ("a", "G-simplified"): "关", ("a", "G-conversion"): "關系→關係", ("a", "G-polite"): "您"}
    assert col(spark, ["这个", "網絡", "網路"], regions.region) == ["zh", "hk", "tw"]
    assert col(spark, ["們" * 20 + "们" * 100, "们" * 100], regions.traditional_excess) == [20, None]


def test_gates(spark):
    text = "The corridor carries freight and nobody knows its full cost because records end in 2019."
    sha = spark.range(1).select(F.sha2(F.lit(text), 256)).first()[0]
    reports_ = spark.createDataFrame([("r", "/x/report.md", text, "en")], "report_id string, path string, text string, language string")
    schema = "review_id string, report_id string, report_lang string, report_path string, report_sha256 string, scores map<string,int>, checks map<string,boolean>, findings array<struct<finding_id:string,severity:string,disposition:string,report_disclosure_excerpt:string>>"
    good = ("good", "r", "en", "report.md", sha, {"a": 4}, {"b": True}, [("F1", "major", "accepted_limitation", "nobody knows its full cost because records end")])
    bad = ("bad", "r", "zh-CN", "other.md", "0", {"a": 3}, {"b": False}, [("F1", "critical", "rejected", None), ("F2", "major", "accepted_limitation", "short")])
    got = {}
    for r in gates.review_findings(spark.createDataFrame([good, bad, ("lost", "q", "en", "x", "0", {}, {}, [])], schema), reports_).collect():
        got.setdefault(r.review_id, set()).add(r.rule_id)
    assert got == {"bad": {"Q-score", "Q-check", "Q-language", "Q-other-report", "Q-stale", "Q-critical", "Q-undisclosed"}, "lost": {"Q-no-report"}}
    receipts = spark.createDataFrame([("k", "passed", "2026-07-20", {"report": "1", "ledger": "2"})], "receipt_id string, status string, checked_at string, inputs map<string,string>")
    now = spark.createDataFrame([("k", "report", "1"), ("k", "ledger", "3"), ("k", "review", "4")], "receipt_id string, name string, sha256 string")
    assert {r.rule_id for r in gates.replay(receipts, now, F.lit("2026-07-28").cast("date")).collect()} == {"R-changed", "R-unbound"}
    assert not gates.passes(gates.replay(receipts, now)) and gates.collisions({"a": "/x"}, {"b": "/x/"}) == ["b is also read as a"]


def test_graph(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(50, 51), (51, 52), (52, 50), (52, 60), (60, 61)], "src int, dst int")
    parts = {r.node: r.component for r in graph.components(edges.toDF("u", "v")).collect()}
    assert parts[40] == 0 and parts[61] == 50
    assert {r.node for r in graph.on_cycles(edges).collect()} == {50, 51, 52}
    assert {r.node for r in graph.reaching(edges, spark.createDataFrame([(61,)], "node int")).collect()} == {50, 51, 52, 60, 61}


def test_probes(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "beta"), (3, None)], "d long, text string")
    terms = spark.createDataFrame([(7, "beta"), (8, "beta gam"), (9, ""), (10, "beta"), (11, None)], "t long, term string")
    for block in (4, 1 << 20):
        got = probes.contained(docs, terms, "text", "d", "term", "t", block)
        assert sorted(map(tuple, got.collect())) == [(1, 7), (1, 8), (1, 10), (2, 7), (2, 10)]
    assert col(spark, ['He said "one two" and: "three" then left'], lambda x: F.array_join(probes.strings(x), "|")) == ["one two|three|He said|then left"]
    assert [len(w) for w in col(spark, ["x" * 300], probes.windows)[0]] == [160, 160, 160, 60]


def test_pages_and_colours(spark):
    assert col(spark, ["ABCDEF+NotoSansCJKsc-Bold", "NotoSansCJKtc", "Helvetica", "Songti", "ArialUnicodeMS"], pages.font_script) == ["simplified", "traditional", "latin", "unknown", "universal"]
    row = spark.range(1).select(vectors.contrast(F.lit("#000000"), F.lit("#ffffff")).alias("c"), vectors.adjusted(F.lit("#999999"), F.lit("#ffffff"), F.lit("#000000"), 4.5).alias("a")).first()
    assert round(row.c, 2) == 21 and row.a is not None
    d = spark.createDataFrame([("d", 1, 0.1, 0.9, False), ("d", 2, 0.1, 0.9, True), ("d", 3, 0.1, 0.2, False), ("d", 4, 0.1, 0.2, False), ("d", 5, 0.001, 0.1, False)], "document_id string, page int, ink double, fill double, is_contents boolean")
    assert {(r.page, r.rule_id) for r in pages.page_findings(d).collect()} == {(4, "thin"), (5, "blank")}
    e = lambda x: spark.createDataFrame([("d", i + 1, v, w) for i, (v, w) in enumerate(x)], "document_id string, page int, detail double, edges array<double>")
    got = pages.render_differences(e([(1.0, [1.0, 0.0]), (1.0, [1.0, 0.0]), (1.0, [1.0, 0.0])]), e([(1.0, [1.0, 0.0]), (0.5, [1.0, 0.0])]))
    assert {(r.page, r.rule_id) for r in got.collect()} == {(2, "detail"), (3, "missing")}


def test_stream(spark, tmp_path):
    from attesta.streaming import ledgers as stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"claims": [{"claim_id": "C1", "source_ids": ["S9"]}], "sources": []}))
    for _ in range(2):
        stream.validate(stream.read_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"), {"claim_links"}).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    assert {r.rule_id for r in found.collect()} == {"L17", "L20"} and found.count() == 2
