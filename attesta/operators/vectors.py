"""Cosine similarity, colour contrast and render comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two number arrays; two zero vectors are alike (1), one is unlike (0)."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    aa, bb = dot(a, a), dot(b, b)
    return F.when((aa == 0) & (bb == 0), 1.0).when((aa == 0) | (bb == 0), 0.0).otherwise(dot(a, b) / F.sqrt(aa * bb))


def luminance(hex_colour: Column) -> Column:
    """Relative luminance of a colour written as #rrggbb."""
    h = F.regexp_replace(hex_colour, "^#", "")

    def channel(i: int) -> Column:
        c = F.conv(F.substring(h, 1 + 2 * i, 2), 16, 10).cast("double") / 255
        return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))

    return channel(0) * 0.2126 + channel(1) * 0.7152 + channel(2) * 0.0722


def contrast(a: Column, b: Column) -> Column:
    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


def mixed(a: Column, b: Column, share: Column) -> Column:
    """Colour ``share`` of the way from a to b, as #rrggbb."""
    part = lambda x, i: F.conv(F.substring(F.regexp_replace(x, "^#", ""), 1 + 2 * i, 2), 16, 10).cast("double")
    one = lambda i: F.lpad(F.lower(F.hex(F.rint(part(a, i) + (part(b, i) - part(a, i)) * share).cast("long"))), 2, "0")
    return F.concat(F.lit("#"), one(0), one(1), one(2))


def adjusted(colour: Column, against: Column, toward: Column, ratio: float) -> Column:
    """The first of 256 steps toward a colour whose contrast meets ``ratio``; null where none does."""
    steps = F.transform(F.sequence(F.lit(0), F.lit(256)), lambda i: mixed(colour, toward, i.cast("double") / 256))
    return F.try_element_at(F.filter(steps, lambda c: contrast(c, against) >= ratio), F.lit(1))


def points(mm: Column) -> Column:
    return mm * 72 / 25.4


def millimetres(pt: Column) -> Column:
    return pt * 25.4 / 72
