"""Style metrics of prose, one row of findings for each rule that a document fails. All are column expressions and grouped aggregates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as lex
from ..functions import text as tx

WIDE = ("zh", "hk", "tw")
#: What ``check`` has rules for.
LANGUAGES = ("en", "de", *WIDE)

# fixed values: what a text of a kind must carry
GENRES = {
    "release": [("product", r"[0-9]+\.[0-9]|版本|版|推出|發布|發佈|上線|上市|發表"), ("when", r"今日|今天|即日|本日|[0-9]{1,2}\s*[）)]?\s*[月日]|即將|下週|下星期"), ("where", r"下載|更新至|升級至|升級到|前往|網站|網頁|瀏覽|申請|連結|http|App ?[Ss]tore|應用商店|後台|管理介面")],
    "outage": [("when", r"[0-9]{1,2}\s*[:：時點]|凌晨|上午|下午|晚上|星期|週|周"), ("impact", r"影響|暫停|中斷|無法|不能使用|受影響"), ("action", r"準備|登出|儲存|保存|備份|安排|配合|留意|處理"), ("contact", r"查詢|聯絡|聯繫|找我|搵我|回報|回覆|電郵|email|分機|熱線")],
    "pressrelease": [("when", r"今日|今天|[0-9]{1,2}\s*[）)]?\s*[月日]|昨日|本週|上週"), ("issuer", r"公司|協會|集團|機構|部|局|署|處|會|中心|學院|大學"), ("source", r"表示|指出|說|稱|指|認為|補充|強調")],
    "notice": [("when", r"[0-9]{1,2}\s*[:：時點]|星期|週|周|日|即日"), ("impact", r"影響|暫停|中斷|變更|調整|更新"), ("contact", r"查詢|聯絡|聯繫|找我|搵我|回覆|回報|電郵|email")],
}


def unmarked(x: Column) -> Column:
    """Prose of Markdown: no code, comments, tables, rules or marks; list items end with a stop."""
    x = F.regexp_replace(x, r"(?ms)^[ \t]*(?:```|~~~).*?^[ \t]*(?:```|~~~)[ \t]*$", "")
    x = F.regexp_replace(x, r"(?s)<!--.*?-->", "")
    x = F.regexp_replace(x, r"(?m)^[ \t]*\|.*(?:\n|\z)", "")
    x = F.regexp_replace(x, r"(?m)^[ \t]*#{1,6}\s.*$", "")
    x = F.regexp_replace(x, r"(?m)^[ \t]*(?:-{3,}|\*{3,}|_{3,})[ \t]*(?:\n|\z)", "")
    x = F.regexp_replace(x, r"(?m)^[ \t]*>+[ \t]?", "")
    x = F.regexp_replace(x, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    x = F.regexp_replace(x, r"`([^`]*)`", "$1")
    x = F.regexp_replace(x, r"(?m)^[ \t]*(?:[-*+]|\d+[.)])[ \t]+(.*?[^.!?:;。！？…\s])[ \t]*$", "$1.")
    return F.regexp_replace(x, r"(?m)^[ \t]*(?:[-*+]|\d+[.)])[ \t]+", "")


def prepared(docs: DataFrame, lang: str, text: str = "text", markdown: bool = True) -> DataFrame:
    """original, prose, folded, paragraphs, sentences, lengths (of sentences with words), sizes (of paragraphs), parts (sentences of paragraphs)."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumns({"original": t, "prose": unmarked(t) if markdown else t})
    d = d.withColumns({"folded": tx.folded(F.col("prose")), "paragraphs": tx.paragraphs(F.col("prose")), "sentences": tx.sentences(F.col("prose"), lang)})
    d = d.withColumn("parts", F.transform("paragraphs", lambda p: tx.sentences(p, lang)))
    return d.withColumns({"lengths": F.filter(F.transform("sentences", lambda s: tx.sentence_length(s, lang)), lambda n: n > 0), "sizes": F.transform("parts", lambda p: F.size(p))})


def mean_and_deviation(a: Column) -> tuple[Column, Column]:
    n = F.size(a)
    mean = F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / n
    return mean, F.sqrt(F.greatest(F.lit(0.0), F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v) / n - mean * mean))


def failing(rule_id: str, condition: Column, detail: Column | None = None, severity: str = "warning") -> Column:
    """A finding, or null where the condition doesn't hold."""
    return F.when(condition, F.struct(F.lit(rule_id).alias("rule_id"), F.lit(severity).alias("severity"), F.coalesce(F.lit("") if detail is None else detail.cast("string"), F.lit("")).alias("detail")))


def rhythm(lang: str) -> list[Column]:
    """Spread of sentence lengths from 8 on (0.345 is where two digits round to 0.35), a short one, and from 12 on a long one."""
    short, long = (12, 45) if lang == "tw" else (8, 40) if lang in WIDE else (6, 25)
    mean, deviation = mean_and_deviation(F.col("lengths"))
    n = F.size("lengths")
    return [
        failing("M-uniform", (n >= 8) & (deviation / mean <= 0.345), F.round(deviation / mean, 2)), failing("M-no-short", (n >= 8) & (F.array_min("lengths") >= short), F.array_min("lengths")),
        failing("M-no-long", (n >= 12) & (F.array_max("lengths") <= long), F.array_max("lengths")),
    ]


def openers(lang: str) -> list[Column]:
    """One first word in over three tenths of the sentences and in three at least; ties by alphabet."""
    return [] if lang in WIDE else [failing("M-opener", (F.size("sentences") >= 5) & (-F.col("top.m") >= 3) & (-F.col("top.m") * 10 > F.size("first") * 3), F.col("top.w"))]


def with_openers(d: DataFrame) -> DataFrame:
    first = F.filter(F.transform("sentences", lambda s: F.lower(F.regexp_extract(s, "^[^A-Za-zÀ-ÖØ-öø-ÿ]*([A-Za-zÀ-ÖØ-öø-ÿ']+)", 1))), lambda w: w != "")
    d = d.withColumn("first", F.array_sort(first))
    # in sorted words a run's length is the distance between its first and last place
    places = F.transform(F.array_distinct("first"), lambda w: F.struct((F.array_position("first", w) + F.array_position(F.reverse("first"), w) - F.size("first") - 2).alias("m"), w.alias("w")))
    return d.withColumn("top", F.array_min(places))


def enumeration(lang: str) -> list[Column]:
    crowded = F.size(F.filter("sentences", lambda s: F.char_length(s) - F.char_length(F.replace(s, F.lit(","), F.lit(""))) >= 5))
    words = F.aggregate("lengths", F.lit(0), lambda s, v: s + v)
    return [failing("M-enumeration", crowded > F.floor(words * 3 / 1000), crowded)] if lang == "en" else []


def paragraph_sizes(lang: str) -> list[Column]:
    mean, deviation = mean_and_deviation(F.col("sizes"))
    return [failing("M-paragraphs", (F.size("paragraphs") >= 4) & (deviation / mean <= 0.245), F.round(deviation / mean, 2))]


def closers(lang: str) -> list[Column]:
    """Paragraphs of several sentences that end short after long: over two fifths, and three at least, of five or more."""
    if lang != "en":
        return []
    eligible = F.filter("parts", lambda s: F.size(s) >= 2)
    short = F.size(F.filter(eligible, lambda s: (tx.word_count(F.element_at(s, -1)) < 15) & (tx.word_count(F.element_at(s, -2)) >= 18)))
    return [failing("M-closers", (F.size("paragraphs") >= 5) & (F.size(eligible) >= 5) & (short >= 3) & (short * 5 > F.size(eligible) * 2), short)]


def inflected(word: str, lang: str) -> str:
    """Pattern of a word with its ordinary endings."""
    if " " in word or "-" in word:
        return re.escape(word)
    if lang == "de":
        return word + "(?:e|en|em|er|es|n|s|t|te|ten|end)?"
    if word.endswith("e"):
        return word[:-1] + "(?:e|es|ed|ing)"
    if word.endswith("y") and len(word) > 2 and word[-2] not in "aeiou":
        return word[:-1] + "(?:y|ies|ied|ying)"
    return word + ("(?:es|ed|ing)?" if word.endswith(("s", "x", "z", "ch", "sh")) else "(?:s|ed|ing)?")


def vocabulary(lang: str) -> list[Column]:
    """More than one catalogue term, or one that stands twice."""
    return [failing("M-vocabulary", F.size("hits") > 1, F.array_join(F.array_sort(F.array_distinct("hits")), ", "), "error")] if lang in ("en", "de") else []


def with_hits(d: DataFrame, lang: str) -> DataFrame:
    words, phrases = (lex.WORDS_EN, lex.PHRASES_EN) if lang == "en" else (lex.WORDS_DE, lex.PHRASES_DE)
    word = rf"(?U)\b({'|'.join(inflected(w, lang) for w in words)})\b"
    phrase = "|".join(sorted((re.escape(p).replace("'", "'") for p in phrases), key=len, reverse=True))
    return d.withColumn("hits", F.concat(F.regexp_extract_all("folded", F.lit(word), F.lit(1)), F.regexp_extract_all("folded", F.lit(f"({phrase})"), F.lit(1))))


def punctuation(lang: str) -> list[Column]:
    n = lambda c: tx.literal_count(F.col("original"), c)
    count = lambda p: F.regexp_count("original", F.lit(p))
    curly = n("“") + n("”")
    if lang == "de":
        return [failing("M-dash", n("—") > 0, n("—")), failing("M-hyphen-dash", count(r"(?<=\S) (?:-|--) (?=\S)") > 0), failing("M-quotes", (n('"') > 0) | (n("”") > 0) | ((n("„") > 0) & (n("»") + n("«") > 0)))]
    if lang in WIDE:
        out = [failing("M-half-width", count(rf"[{lex.CJK}][,.;:!?]") > 0)]
        if lang != "tw":
            out.append(failing("M-semicolons", n("；") > F.greatest(F.lit(1), F.floor(F.size("sentences") / 10)), n("；")))
        return [*out, failing("M-quotes", curly > 0 if lang == "tw" else (curly > 0) & (n("「") > 0))]
    apostrophes = count(r"(?U)(?<=\w)'(?=\w)")
    return [failing("M-dash", n("—") * 5 > F.greatest(F.lit(1), F.size("sentences")), n("—")), failing("M-quotes", (curly > 0) & (n('"') > 0)), failing("M-apostrophes", (n("’") > 0) & (apostrophes > 0))]


def flavour(docs: DataFrame, lang: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Figures that are reported and never flagged: contractions and full forms, modal particles, Cantonese markers and the register they show."""
    t = tx.folded(F.coalesce(F.col(text), F.lit("")))
    count = lambda ws: F.regexp_count(t, F.lit(rf"(?U)\b({'|'.join(ws)})\b"))
    if lang == "de":
        return docs.select(key, count(lex.MODAL_PARTICLES_DE).alias("particles"))
    if lang in WIDE:
        hits = tx.cantonese_hits(F.coalesce(F.col(text), F.lit("")))
        return docs.select(key, hits.alias("cantonese"), F.when(hits >= 3, "spoken").when(hits == 0, "written").otherwise("mixed").alias("register"))
    return docs.select(key, count(lex.CONTRACTIONS).alias("contractions"), count(lex.FULL_FORMS).alias("full_forms"))


def check(docs: DataFrame, lang: str, text: str = "text", key: str = "doc_id", markdown: bool = True) -> DataFrame:
    """All style findings of the documents of one language, in one pass. A null text is empty and fails nothing; repeated rows are judged each."""
    d = prepared(docs, lang, text, markdown)
    if lang not in WIDE:
        d = with_openers(d)
    if lang in ("en", "de"):
        d = with_hits(d, lang)
    found = [f for rule in (rhythm, openers, enumeration, paragraph_sizes, closers, vocabulary, punctuation) for f in rule(lang)]
    # the outer form keeps the optimiser from copying all rules into a filter below the generator
    return d.select(key, F.explode_outer(F.array(*found)).alias("f")).where("f IS NOT NULL").select(key, "f.*")


def genre_gaps(docs: DataFrame, genre: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, element) that texts of a genre lack."""
    t = F.coalesce(F.col(text), F.lit(""))
    missing = F.filter(F.array(*(F.when(~t.rlike(f"(?i){p}"), F.lit(e)) for e, p in GENRES[genre])), lambda e: e.isNotNull())
    return docs.select(key, F.explode(missing).alias("element"))


def shingles(x: Column, lang: str) -> Column:
    """Distinct hashes of five words, or six wide characters."""
    if lang in WIDE:
        parts, n, glue = F.regexp_extract_all(x, F.lit(f"[{lex.CJK}]"), F.lit(0)), 6, ""
    else:
        parts, n, glue = tx.words(F.lower(x)), 5, " "
    return F.when(F.size(parts) < n, F.array().cast("array<bigint>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(parts) - (n - 1)), lambda i: F.xxhash64(F.array_join(F.slice(parts, i, n), glue)))))


def siblings(docs: DataFrame, lang: str, batch: str, text: str = "text", key: str = "doc_id", most: float = 0.35) -> DataFrame:
    """Pairs (left, right, jaccard) of one batch whose shingles overlap by ``most`` or more.

    For the drafts of one assignment: a batch is meant to be small. Pairs come from shared shingles, never from all documents.
    """
    s = docs.select(batch, key, shingles(F.coalesce(F.col(text), F.lit("")), lang).alias("s")).where("size(s) > 0")
    one = s.select(batch, key, F.size("s").alias("n"), F.explode("s").alias("h"))
    left = one.select(batch, "h", F.col(key).alias("left"), F.col("n").alias("n_left"))
    right = one.select(batch, "h", F.col(key).alias("right"), F.col("n").alias("n_right"))
    both = left.join(right, [batch, "h"]).where("left < right").groupBy("left", "right", "n_left", "n_right").agg(F.count("*").alias("n"))
    jaccard = F.col("n") / (F.col("n_left") + F.col("n_right") - F.col("n"))
    return both.withColumn("jaccard", jaccard).where(F.col("jaccard") >= most).select("left", "right", "jaccard")


def shared_shapes(docs: DataFrame, lang: str, batch: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Documents of a batch of three or more whose (paragraphs, sentences) another one has, from three paragraphs on."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(batch, key, F.size(tx.paragraphs(t)).alias("paragraphs"), F.size(tx.sentences(t, lang)).alias("sentences"))
    d = d.withColumns({"same": F.count("*").over(Window.partitionBy(batch, "paragraphs", "sentences")), "all": F.count("*").over(Window.partitionBy(batch))})
    return d.where("same >= 2 AND all >= 3 AND paragraphs >= 3").select(batch, key, "paragraphs", "sentences")


def catalogue_gaps(terms: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Catalogue terms that no lexicon entry is part of. The lexicon is a list of a few hundred fixed words, checked before it is spread."""
    entries = [r[0] for r in lexicon.select("term").limit(10_001).collect()]
    if len(entries) > 10_000:
        raise ValueError("a lexicon holds 10,000 terms at most")
    return terms.where(~F.exists(F.array(*map(F.lit, entries)), lambda e: F.contains(F.lower("term"), F.lower(e)))) if entries else terms
