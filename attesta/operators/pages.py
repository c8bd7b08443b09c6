"""Page and render checks on measured rows: fonts, header gap, overflow, openers, render comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .vectors import cosine

# fixed values: marks of font names
SIMPLIFIED = ["sc", "gb", "hans", "simplified", "yahei", "simsun"]
TRADITIONAL = ["tc", "hk", "tw", "mo", "hant", "big5", "traditional", "jhenghei", "mingliu"]
CJK_FONTS = "pingfang|songti|heiti|hiragino|yahei|jhenghei|mingliu|notosanscjk|notoserifcjk|sourcehan|droidsansfallback|stsong|stheiti|simsun|kaiti|fangsong|arialunicode"
LEAST_INK, LEAST_FILL, LEAST_GAP_MM = 0.006, 0.32, 6.0
LEAST_DETAIL, LEAST_SIMILARITY = 0.75, 0.85


def font_tokens(name: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.regexp_replace(name, r"^[^+]*\+", ""), F.lit(r"[A-Z]+(?![a-z])|[A-Z][a-z]*|[a-z]+|[0-9]+"), F.lit(0)), lambda t: F.lower(t))


def font_script(name: Column) -> Column:
    """latin, universal, traditional, simplified or unknown."""
    tokens = font_tokens(name)
    joined = F.array_join(tokens, "")
    has = lambda marks, also: F.arrays_overlap(tokens, F.array(*map(F.lit, marks))) | joined.rlike(also)
    hant, hans = has(TRADITIONAL, "jhenghei|mingliu|big5|hant|cjktc|cjkhk|cjktw|cjkhant"), has(SIMPLIFIED, "yahei|simsun|cjksc|cjkhans")
    return F.when(~joined.rlike(CJK_FONTS), "latin").when(joined.contains("arialunicode"), "universal").when(hant & ~hans, "traditional").when(hans & ~hant, "simplified").otherwise("unknown")


def mixed_fonts(fonts: DataFrame) -> DataFrame:
    """Documents (document_id, font) whose fonts are of both scripts."""
    return fonts.groupBy("document_id").agg(F.collect_set(font_script(F.col("font"))).alias("scripts")).where("array_contains(scripts, 'simplified') AND array_contains(scripts, 'traditional')")


def header_gaps(rects: DataFrame, top_margin: float) -> DataFrame:
    """document_id, page, gap in millimetres between the lowest header box and the highest body box; boxes are (bottom, top) in points, with page height."""
    head = F.col("top") > F.col("height") - top_margin * 72 / 25.4
    g = rects.groupBy("document_id", "page").agg(F.min(F.when(head, F.col("bottom"))).alias("h"), F.max(F.when(~head, F.col("top"))).alias("b"), F.count("*").alias("n"))
    return g.where("n >= 2 AND h IS NOT NULL AND b IS NOT NULL").select("document_id", "page", ((F.col("h") - F.col("b")) * 25.4 / 72).alias("gap_mm"))


def overflowing(rects: DataFrame) -> DataFrame:
    """Boxes outside their page."""
    return rects.where("left < 0 OR bottom < 0 OR right > width OR top > height")


def page_findings(pages: DataFrame) -> DataFrame:
    """Thin pages (document_id, page, ink, fill, is_contents): little ink, or little fill on an inner page that opens nothing."""
    w = Window.partitionBy("document_id").orderBy("page")
    d = pages.withColumns({"after_contents": F.coalesce(F.lag("is_contents").over(w), F.lit(False)), "last": F.max("page").over(Window.partitionBy("document_id"))})
    opener = F.col("after_contents") & ~F.col("is_contents")
    rule = F.when(F.col("ink") < LEAST_INK, "blank").when((F.col("page") > 1) & (F.col("page") < F.col("last")) & ~opener & (F.col("fill") < LEAST_FILL), "thin")
    return d.withColumn("rule_id", rule).where("rule_id IS NOT NULL").select("document_id", "page", "rule_id")


def render_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pages (document_id, page, detail, edges) of two renderers that differ: missing, less detail, or unlike edges."""
    j = left.join(right.select("document_id", "page", F.col("detail").alias("detail_b"), F.col("edges").alias("edges_b")), ["document_id", "page"], "full_outer")
    ratio = F.least("detail", "detail_b") / F.greatest("detail", "detail_b", F.lit(1e-12))
    rule = F.when(F.col("detail").isNull() | F.col("detail_b").isNull(), "missing").when((F.greatest("detail", "detail_b") > 0) & (ratio < LEAST_DETAIL), "detail").when(cosine(F.col("edges"), F.col("edges_b")) < LEAST_SIMILARITY, "unlike")
    return j.withColumn("rule_id", rule).where("rule_id IS NOT NULL").select("document_id", "page", "rule_id")
