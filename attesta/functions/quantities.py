"""Quantities that a text asserts, in forms that compare across notations.

A form is ``n:`` a number, ``u:<dimension>:`` a measure in its base unit, ``d:`` a date or month, ``v:`` a version, ``id:`` an identifier.
Recognisers run in a fixed order; each blanks what it reads, so later ones never read it again.
"""

from __future__ import annotations

import re
from decimal import Decimal
from fractions import Fraction
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Quantity(NamedTuple):
    shown: str
    forms: frozenset[str]
    vague: bool  # read, but asserts nothing


# fixed values: number words
UNITS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen"]
ORDINALS = ["first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth"]
TENS = ["twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
ADDED = {w: i for i, w in enumerate(UNITS)} | {w: i + 1 for i, w in enumerate(ORDINALS)} | {w: 10 * (i + 2) for i, w in enumerate(TENS)}
FACTORS = {"hundred": Fraction(100), "dozen": Fraction(12), "half": Fraction(1, 2)}
CLOSING = {"thousand": 10**3, "million": 10**6, "billion": 10**9, "trillion": 10**12}
SCALES = CLOSING | {"k": 10**3, "m": 10**6, "mm": 10**6, "bn": 10**9, "b": 10**9, "tn": 10**12}
UNIT_ORDINALS = {"second", "third", "quarter", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth"}
MONTHS = {name[:n]: i + 1 for i, name in enumerate(["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]) for n in {3, len(name)}} | {"sept": 9}

# fixed values: Han numerals and measure units (dimension, factor to the base unit)
HAN = {"零": 0, "〇": 0, "一": 1, "二": 2, "兩": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
HAN_PLACES = {"十": 10, "百": 100, "千": 1000}
HAN_SCALES = {"萬": 10**4, "万": 10**4, "億": 10**8, "亿": 10**8}
MEASURES = {
    "瓦": ("W", 1), "千瓦": ("W", 1000), "瓦時": ("Wh", 1), "瓦时": ("Wh", 1), "千瓦時": ("Wh", 1000), "千瓦时": ("Wh", 1000), "米": ("m", 1), "千米": ("m", 1000), "公里": ("m", 1000),
    "克": ("g", 1), "千克": ("g", 1000), "噸": ("t", 1), "吨": ("t", 1), "千噸": ("t", 1000), "千吨": ("t", 1000), "卡": ("cal", 1), "千卡": ("cal", 1000),
    "像素": ("px", 1), "百萬像素": ("px", 10**6), "百万像素": ("px", 10**6), "百分點": ("pp", 1), "百分点": ("pp", 1),
}
CLASSIFIERS = "個个"

_cjk = "⺀-鿿豈-﫿"
_before, _after = rf"(?<![^\W{_cjk}])", rf"(?![^\W{_cjk}])"
_scale, _digit = "".join(HAN_SCALES), "".join(HAN)
_numeral = _digit + "".join(HAN_PLACES) + _scale
_point = rf"(?:[點点][{_digit}]+)?"
_word = "|".join(sorted({*ADDED, *FACTORS, *CLOSING}, key=len, reverse=True))
_gap = "[\\s  -]"


def plain(number) -> str:
    """Canonical digits: no separators, no outer zeros."""
    whole, _, part = re.sub("[,  \\s]", "", str(number)).partition(".")
    part = part.rstrip("0")
    return (whole.lstrip("0") or "0") + (f".{part}" if part else "")


def times(number: str, factor: int) -> str:
    return plain(format(Decimal(number) * factor, "f"))


def words_value(phrase: str) -> str:
    """twenty-five: 25; four hundred million: 400000000; half: 0.5."""
    done, group = Fraction(0), Fraction(0)
    for w in re.findall(rf"\b(?:{_word})\b", phrase.lower()):
        if w in FACTORS:
            group = (group or 1) * FACTORS[w]
        elif w in CLOSING:
            done, group = done + (group or 1) * CLOSING[w], Fraction(0)
        else:
            group += ADDED[w]
    total = done + group
    return str(int(total)) if total.denominator == 1 else str(float(total))


def han_whole(phrase: str) -> int:
    """Groups end with a scale; in a group a digit multiplies the place after it, and an ASCII run is one digit."""
    total = 0
    for group, scale in re.findall(rf"([^{_scale}]*)([{_scale}]?)", phrase):
        value = 0
        for digit, place in re.findall(rf"([0-9]+|[{_digit}])?([十百千])?", group):
            one = int(digit) if digit.isascii() and digit else HAN.get(digit)
            if place:
                value += (1 if one is None else one) * HAN_PLACES[place]
            elif one is not None:
                value += one
        total += value * HAN_SCALES.get(scale, 1)
    return total


def han_value(phrase: str) -> str:
    """With a decimal part read digit by digit, and a scale after it."""
    whole, *rest = re.split("[點点]", phrase, maxsplit=1)
    if not rest:
        return plain(han_whole(phrase))
    tail = rest[0].rstrip(_scale)
    factor = 1
    for c in rest[0][len(tail) :]:
        factor *= HAN_SCALES[c]
    number = f"{han_whole(whole)}.{''.join(str(HAN[c]) for c in tail if c in HAN) or '0'}"
    return times(number, factor)


def readings(phrase: str) -> set[str]:
    """Of a scaled phrase. Digits that end it fill the places below the scale (3萬5: 35000) or the ones (30005): both are offered."""
    out = {han_value(phrase)}
    tail = re.search(rf"([{_scale}])([0-9{_digit.replace('零', '').replace('〇', '')}]+)$", phrase)
    if tail:
        digits = "".join(str(HAN.get(c, c)) for c in tail[2])
        place = HAN_SCALES[tail[1]] // 10 ** len(digits)
        if place:
            out.add(str(han_whole(phrase[: tail.start(2)]) + int(digits) * place))
    return out


def implied_one(phrase: str) -> bool:
    """It opens on a scale, or with the adverb of thousands: an idiom more often than a figure."""
    return not phrase or phrase[0] in HAN_SCALES or (phrase[0] == "千" and phrase[1:2] in HAN_SCALES and len(phrase) > 1)


def unit_at(text: str, at: int) -> tuple[str, str] | None:
    """The longest listed unit at ``at``, spaces skipped, and the text up to its end."""
    start = at + len(text[at:]) - len(text[at:].lstrip(" \t  　"))
    found = max((u for u in MEASURES if text.startswith(u, start)), key=len, default=None)
    return None if found is None else (found, text[at : start + len(found)])


def measured(values: set[str], unit: str) -> frozenset[str]:
    kind, factor = MEASURES[unit]
    return frozenset(x for v in values for x in (f"u:{kind}:{times(v, factor)}", f"n:{times(v, factor)}"))


def numbers(values: set[str]) -> frozenset[str]:
    return frozenset(f"n:{v}" for v in values)


NOTHING: frozenset[str] = frozenset()


class Scanner:
    """One reading of one text."""

    def __init__(self, text: str):
        self.given = text
        text = re.sub(r"(?i)\b(?:https?://|www\.)\S+", " ", text)
        text = re.sub(rf"{_before}[CS][0-9]{{1,7}}{_after}", " ", text)
        self.text, self.found = self.dates(text), []

    @staticmethod
    def dates(text: str) -> str:
        """All dates and months in ISO form."""
        iso = lambda y, m, d: f"{y}-{int(m):02d}" + (f"-{int(d):02d}" if d else "")
        text = re.sub(r"([0-9]{4})\s*年\s*([0-9]{1,2})\s*月(?:\s*([0-9]{1,2})\s*日)?", lambda m: iso(*m.groups()), text)
        text = re.sub(rf"{_before}([0-9]{{4}})/([0-9]{{1,2}})/([0-9]{{1,2}}){_after}", lambda m: iso(*m.groups()), text)
        names = "|".join(sorted(MONTHS, key=len, reverse=True))
        return re.sub(rf"(?i)\b(?:([0-9]{{1,2}})\s+)?({names})\.?\s+(?:([0-9]{{1,2}})(?:st|nd|rd|th)?,?\s+)?([0-9]{{4}})\b", lambda m: iso(m[4], MONTHS[m[2].lower()], m[1] or m[3]), text)

    def run(self) -> list[Quantity]:
        for pattern, reader in RECOGNISERS:

            def read(m: re.Match, reader=reader) -> str:
                q = reader(self, m)
                if q is None:
                    return m[0]
                self.found.append(q)
                return " " * len(m[0])

            self.text = pattern.sub(read, self.text)
        return self.found

    def counted(self, shown: str, values: set[str], end: int) -> Quantity:
        unit = unit_at(self.text, end)
        return Quantity(shown, numbers(values), False) if unit is None else Quantity(shown + unit[1], measured(values, unit[0]), False)

    def tagged(self, tag: str, shown: str, value: str) -> Quantity:
        return Quantity(shown, frozenset({f"{tag}:{value}"}), False)

    def mixed(self, m: re.Match) -> Quantity | None:
        """Digits and Han in one number, with something after the scale."""
        inner = re.search(rf"[{_scale}].", m[0])
        if not re.search("[0-9]", m[0]) or not inner or implied_one(m[0]):
            return None
        return self.counted(m[0], readings(m[0]), m.end())

    def digits(self, m: re.Match) -> Quantity:
        value, factor = plain(m[1]), SCALES.get((m[2] or "").lower()) or HAN_SCALES.get(m[3] or "")
        scaled = times(value, factor) if factor else value
        return self.counted(m[0].strip(), {value if "." in scaled else scaled}, m.end())

    def words(self, m: re.Match) -> Quantity:
        ahead, after = self.given[max(0, m.start() - 12) : m.start()], self.given[m.end() : m.end() + 32]
        unit = m[0].lower() in UNIT_ORDINALS and re.search(rf"(?i)\b(?:an?|per|the){_gap}+$", ahead)
        part = re.match(rf"(?i){_gap}*(?:halves|halfs?|thirds?|quarters?|fifths?|sixths?|sevenths?|eighths?|ninths?|tenths?)\b", after)
        return Quantity(m[0], NOTHING, True) if unit or part else Quantity(m[0], numbers({words_value(m[0])}), False)

    def nothing(self, m: re.Match) -> Quantity:
        return Quantity(m[0], NOTHING, True)

    def percent(self, m: re.Match) -> Quantity:
        return Quantity(m[0], numbers({han_value(m[1])}), False)

    def tenths(self, m: re.Match) -> Quantity:
        return Quantity(m[0], numbers({str(han_whole(m[1]) * 10 + HAN.get(m[2], 0))}), False)

    def han(self, m: re.Match) -> Quantity:
        span, scaled = m[0], bool(re.search(f"[{_scale}]", m[0]))
        if scaled and implied_one(span):
            return self.nothing(m)
        values = readings(span) if scaled else {han_value(span)}
        unit = None if span in HAN_PLACES else unit_at(self.text, m.end())
        if unit:
            return Quantity(span + unit[1], measured(values, unit[0]), False)
        if scaled:
            return Quantity(span, numbers(values), False)
        for name in sorted(MEASURES, key=len, reverse=True):  # the unit's head may have been read as a place: 五百 + 分點
            for n in range(1, len(name)):
                head, rest, number = name[:n], name[n:], span[:-n]
                if number and span.endswith(head) and self.text.startswith(rest, m.end()) and han_whole(span) == han_whole(number) * han_whole(head):
                    return Quantity(span + rest, measured({han_value(number)}, name), False)
        if span == "一" or self.text[m.end() : m.end() + 1] not in [*CLASSIFIERS]:
            return self.nothing(m)
        return Quantity(span, numbers(values), False)


RECOGNISERS = [
    (re.compile(rf"{_before}[A-Za-z]{{2,}}[-‑][0-9][0-9A-Za-z‑-]*{_after}"), lambda s, m: s.tagged("id", m[0], "-".join(re.sub(r"[\W_]+", " ", m[0]).split()).casefold())),
    (re.compile(rf"{_before}[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}{_after}"), lambda s, m: s.tagged("d", m[0], m[0])),
    (re.compile(rf"{_before}[0-9]{{4}}-[0-9]{{2}}{_after}"), lambda s, m: s.tagged("d", m[0], m[0])),
    (re.compile(rf"{_before}[vV]?([0-9]+(?:\.[0-9]+){{2,}}){_after}"), lambda s, m: s.tagged("v", m[0], m[1])),
    (re.compile(rf"{_before}(?<![.,之])[0-9{_numeral}]+"), Scanner.mixed),
    (re.compile(rf"{_before}(?<!\.)([0-9]+(?:[,  ][0-9]{{3}})*(?:\.[0-9]+)?)(?![0-9])(?:\s*(?:(k|mm|m|bn|b|tn|thousand|million|billion|trillion)\b|([{_scale}])))?", re.IGNORECASE), Scanner.digits),
    (re.compile(rf"\b(?:{_word})(?:{_gap}+(?:and{_gap}+)?(?:{_word}))*(?=fold\b|[^A-Za-z]|$)", re.IGNORECASE), Scanner.words),
    (re.compile(f"第[{_numeral}]+"), Scanner.nothing),
    (re.compile(f"百分之([{_numeral}]+{_point})"), Scanner.percent),
    (re.compile(f"[{_numeral}]+分之[{_numeral}]+"), Scanner.nothing),
    (re.compile(f"([{_digit}十])成([{_digit}])?"), Scanner.tenths),
    (re.compile(f"[{_numeral}]+{_point}[{_scale}]?"), Scanner.han),
]


def scan(text: str | None) -> list[Quantity]:
    return Scanner(text or "").run()


def asserted(text: str | None) -> list[Quantity]:
    return [q for q in scan(text) if q.forms and not q.vague]


def offered(*texts: str | None) -> set[str]:
    return {f for t in texts for q in scan(t) for f in q.forms}


def covers(claim, evidence) -> bool:
    """A form in common, or a date of the evidence inside a claimed month."""
    return any(c in evidence or (c.startswith("d:") and any(e.startswith(c) for e in evidence)) for c in claim)


SCHEMA = T.ArrayType(T.StructType([T.StructField("shown", T.StringType()), T.StructField("forms", T.ArrayType(T.StringType())), T.StructField("vague", T.BooleanType())]))


@F.pandas_udf(SCHEMA)
def quantities(x: pd.Series) -> pd.Series:
    return x.map(lambda t: [{"shown": q.shown, "forms": sorted(q.forms), "vague": q.vague} for q in scan(t)])


def obligations(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t["vague"] & (F.size(t["forms"]) > 0))


def covered(claim: Column, evidence: Column) -> Column:
    dates = F.filter(claim, lambda c: F.startswith(c, F.lit("d:")))
    return F.arrays_overlap(claim, evidence) | F.exists(dates, lambda c: F.exists(evidence, lambda e: F.startswith(e, c)))
