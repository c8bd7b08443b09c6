"""Text functions: normalising, segmenting, counting and language tests.

Column expressions where Spark has them; Pandas UDFs for Unicode normal forms and for HTML, whose hidden parts nest.
"""

from __future__ import annotations

import html
import re
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lexicons import ABBREVIATIONS, CANTONESE, CANTONESE_EXCEPTIONS, CJK, STOP_DE, STOP_EN, TITLES, WORD

WORDISH = r"[\p{L}\p{N}_]+"


def clean(x: Column) -> Column:
    """Null as '', without Unicode white space at the ends."""
    return F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)^\s+|\s+$", "")


def collapsed(x: Column) -> Column:
    return clean(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " "))


def folded(x: Column) -> Column:
    """Straight quotes, plain hyphens and spaces, lower case."""
    return F.lower(F.translate(x, "’‘“”‑ ", "''\"\"- "))


def family(x: Column) -> Column:
    """A name's letters and digits in lower case, one space between runs."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def literal_count(x: Column, term: str) -> Column:
    return F.floor((F.char_length(x) - F.char_length(F.replace(x, F.lit(term), F.lit("")))) / len(term)).cast("int")


def mentions(text: Column, alias: Column) -> Column:
    """Whole-word mention of an ASCII alias in any case; substring for others."""
    a = F.lower(clean(alias))
    t = F.lower(F.coalesce(text, F.lit("")))
    quoted = F.concat(F.lit(r"(?U)(?<!\w)\Q"), a, F.lit(r"\E(?!\w)"))
    return (a != "") & F.when(a.rlike(r"^\p{ASCII}*$"), F.regexp(t, quoted)).otherwise(F.contains(t, a))


def words(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(WORDISH), F.lit(0))


def spaced_words(x: Column) -> Column:
    """``words``, with spaces between them and perhaps at the ends."""
    return F.regexp_replace(x, r"[^\p{L}\p{N}_]+", " ")


def word_count(x: Column) -> Column:
    return F.regexp_count(x, F.lit(WORD))


def paragraphs(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, r"\n\s*\n"), clean), lambda p: p != "")


def protected(x: Column, lang: str) -> Column:
    """Stops that end no sentence replaced by NUL."""
    start = r"(?<![0-9A-Za-zÀ-ÖØ-öø-ÿ])"
    either = lambda terms: "|".join(sorted((a.replace(".", r"\.") for a in terms), key=len, reverse=True))
    if lang in TITLES:
        x = F.regexp_replace(x, rf"{start}((?i:{either(TITLES[lang])}))\.", "$1\x00")
        x = F.regexp_replace(x, rf"{start}((?i:{either(ABBREVIATIONS[lang])}))\.(?!\s+[A-ZÄÖÜ])", "$1\x00")
    return F.regexp_replace(x, rf"(?<=\d)\.(?=\d)|(?<={start}[A-ZÄÖÜ])\.", "\x00")


def sentences(x: Column, lang: str = "en") -> Column:
    if lang in ("zh", "hk", "tw"):
        parts = F.split(x, "[。！？…]+")
    else:
        parts = F.transform(F.split(protected(x, lang), r"(?<=[.!?…])[\"'”’)\]]*\s+"), lambda p: F.replace(p, F.lit("\x00"), F.lit(".")))
    return F.filter(F.transform(parts, clean), lambda s: s != "")


def plain_sentences(x: Column) -> Column:
    """Sentences by terminal marks alone, without look-behind."""
    return F.filter(F.transform(F.split(x, r"[.!?]+(\s+|$)"), lambda s: F.trim(s)), lambda s: s != "")


def sentence_length(s: Column, lang: str = "en") -> Column:
    if lang in ("zh", "hk", "tw"):
        return F.regexp_count(s, F.lit(f"[{CJK}]")) + F.regexp_count(F.regexp_replace(s, f"[{CJK}]", " "), F.lit(WORD))
    return word_count(s)


def stop_word_language(x: Column) -> Column:
    """'de' where German stop words outnumber English ones, else 'en'."""
    tokens = words(F.lower(F.coalesce(x, F.lit(""))))
    hits = lambda stop: F.size(F.filter(tokens, lambda t: t.isin(stop)))
    return F.when(hits(STOP_DE) > hits(STOP_EN), "de").otherwise("en")


def report_language(x: Column, hk_markers: list[str] = CANTONESE, cn_markers: str = "这个们时会说对来国过学发电长开关门问间") -> Column:
    """'en' where Han characters are at most 0.3 of Latin ones; else zh-HK or zh-CN by markers, zh on a tie."""
    t = F.coalesce(x, F.lit(""))
    han, latin = F.regexp_count(t, F.lit(f"[{CJK}]")), F.regexp_count(t, F.lit("[A-Za-z]"))
    hk = sum((literal_count(t, m) for m in hk_markers), F.lit(0))
    cn = F.regexp_count(t, F.lit(f"[{cn_markers}]"))
    return F.when(han <= latin * 0.3, "en").when(hk > cn, "zh-HK").when(cn > hk, "zh-CN").otherwise("zh")


def cantonese_hits(x: Column) -> Column:
    total = F.lit(0)
    for m in CANTONESE:
        n = literal_count(x, m)
        for c in CANTONESE_EXCEPTIONS.get(m, []):
            n = n - literal_count(x, c)
        total = total + F.greatest(F.lit(0), n)
    return total


def visual_width(x: Column) -> Column:
    """Wide characters count two, others one, white space nothing."""
    wide = "\\u3400-\\u9FFF"
    return 2 * F.regexp_count(x, F.lit(f"[{wide}]")) + F.regexp_count(x, F.lit(f"(?U)[^\\s{wide}]"))


def trimmed_summary(x: Column, limit: int = 145) -> Column:
    """Cut at the last space before ``limit`` where the text is longer."""
    x = collapsed(x)
    cut = F.regexp_replace(F.substring(x, 1, limit + 1), r" [^ ]*$", "")
    return F.when(F.char_length(x) <= limit, x).otherwise(F.concat(F.regexp_replace(cut, r"[ ,;:.]+$", ""), F.lit("…")))


def title_parts(x: Column) -> Column:
    """Title and subtitle at the first colon."""
    p = F.split(x, "[:：]", 2)
    return F.struct(F.trim(p[0]).alias("title"), F.trim(F.coalesce(F.try_element_at(p, F.lit(2)), F.lit(""))).alias("subtitle"))


def plain_inline(x: Column) -> Column:
    """Inline Markdown without its marks: images and links become labels."""
    x = F.regexp_replace(x, r"<!--[\s\S]*?-->", "")
    x = F.regexp_replace(x, r"!\[([^\]]*)\]\([^)]*\)", "$1")
    x = F.regexp_replace(x, r"\[([^\]]+)\]\([^)]*\)", "$1")
    x = F.regexp_replace(x, r"<https?://[^>]+>|https?://\S+", "")
    x = F.regexp_replace(x, r"</?[A-Za-z][^>]*>", "")
    x = F.regexp_replace(x, r"(\*\*|__|\*|_|`|~~)", "")
    return F.regexp_replace(x, r"\\([\\`*_{}\[\]()#+\-.!|])", "$1")


def localised_date(lang: Column, day: Column) -> Column:
    cjk = F.concat(F.year(day).cast("string"), F.lit("年"), F.month(day).cast("string"), F.lit("月"), F.dayofmonth(day).cast("string"), F.lit("日"))
    return F.when(lang == "en", F.date_format(day, "dd MMMM yyyy")).otherwise(cjk)


# fixed values: code points without a shape of their own, and the bidirectional controls that no text may hold
IGNORABLE = [(0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF)]
BIDI = "\\u061C\\u200E\\u200F\\u202A-\\u202E\\u2066-\\u2069"
CJK_MARKS = "，。、；：？！（）【】《》「」『』“”‘’—…·"


def bidi_controls(x: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(x, F.lit(f"[{BIDI}]"), F.lit(0))))


def canonical(value: str | None) -> str:
    """Entities resolved, compatibility forms folded but for CJK punctuation, invisible characters gone, controls as spaces."""
    out = []
    for c in unicodedata.normalize("NFC", html.unescape(value or "")):
        for d in c if c in CJK_MARKS else unicodedata.normalize("NFKC", c):
            point, category = ord(d), unicodedata.category(d)
            if category == "Cf" or any(a <= point <= b for a, b in IGNORABLE):
                continue
            out.append(" " if category == "Cc" and d not in "\n\t" else d)
    return "".join(out)


_SAME = str.maketrans({**dict.fromkeys("‘’‚‛′", "'"), **dict.fromkeys("“”„‟″", '"'), **dict.fromkeys("‐‑‒–—―−", "-"), " ": " "})


def normal(value: str | None) -> str:
    return " ".join(canonical(value).translate(_SAME).split()).casefold()


class _Visible(HTMLParser):
    """Text of nodes that are not hidden, nor inside hidden ones."""

    SILENT = {"script", "style", "template", "noscript"}
    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool]] = []
        self.out: list[str] = []

    def handle_starttag(self, tag, attrs):
        a = {k: (v or "").lower() for k, v in attrs}
        style = re.sub(r"\s", "", a.get("style", ""))
        hidden = tag in self.SILENT or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style
        self.out.append(" ")
        if tag not in self.VOID:
            self.open.append((tag, hidden or (bool(self.open) and self.open[-1][1])))

    def handle_endtag(self, tag):
        self.out.append(" ")
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        if not (self.open and self.open[-1][1]):
            self.out.append(data)


def visible(value: str | None) -> str:
    p = _Visible()
    p.feed(value or "")
    p.close()
    return normal("".join(p.out))


@F.pandas_udf(T.StringType())
def canonical_text(x: pd.Series) -> pd.Series:
    return x.map(canonical)


@F.pandas_udf(T.StringType())
def normal_text(x: pd.Series) -> pd.Series:
    return x.map(normal)


@F.pandas_udf(T.StringType())
def visible_text(x: pd.Series) -> pd.Series:
    """Visible text of HTML, normalised."""
    return x.map(visible)


# fixed values: tags and attributes that sanitised fragments may hold, and tags whose content goes too
ALLOWED = {"a": {"href", "title"}, "abbr": {"title"}, "b": set(), "blockquote": set(), "br": set(), "code": set(), "em": set(), "i": set(), "img": {"src", "alt", "title"}, "li": set(), "ol": set(), "p": set(), "pre": set(), "span": set(), "strong": set(), "sub": set(), "sup": set(), "table": set(), "tbody": set(), "td": {"colspan", "rowspan"}, "th": {"colspan", "rowspan"}, "thead": set(), "tr": set(), "ul": set()}
ACTIVE = {"script", "style", "iframe", "object", "embed", "svg", "math"}


class _Sanitiser(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.active = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in ACTIVE:
            self.active += tag != "embed"
        elif not self.active and tag in ALLOWED:
            kept = [(k, v or "") for k, v in attrs if k in ALLOWED[tag] and not (k in ("href", "src") and re.match(r"(?i)\s*(?:javascript|vbscript|data:text)", v or ""))]
            self.out.append(f"<{tag}{''.join(f' {k}={chr(34)}{html.escape(v)}{chr(34)}' for k, v in kept)}>")

    def handle_endtag(self, tag):
        if tag in ACTIVE:
            self.active = max(0, self.active - 1)
        elif not self.active and tag in ALLOWED and tag not in ("br", "img"):
            self.out.append(f"</{tag}>")

    def handle_data(self, data):
        if not self.active:
            self.out.append(html.escape(data, quote=False))


@F.pandas_udf(T.StringType())
def sanitised_html(x: pd.Series) -> pd.Series:
    def one(v: str | None) -> str:
        s = _Sanitiser()
        s.feed(v or "")
        s.close()
        return "".join(s.out)

    return x.map(one)
