"""URL and host functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicons import TWO_LABEL_SUFFIXES

#: scheme, authority, path, query of an address (RFC 3986, appendix B)
PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def host(url: Column) -> Column:
    """Host in lower case without user and port; '' where there is none."""
    authority = F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", ""))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def same_host(a: Column, b: Column) -> Column:
    return (bare_host(a) == bare_host(b)) & (bare_host(a) != "")


def registrable_domain(url: Column) -> Column:
    """Last two labels of the host, three under a two-label suffix; a numeric host stays whole."""
    h = F.regexp_replace(host(url), r"\.$", "")
    labels = F.split(h, r"\.")
    last = lambda n: F.array_join(F.slice(labels, -n, n), ".")
    return (
        F.when(h.rlike(r"^[0-9.]+$") | h.contains(":") | (F.size(labels) <= 2), h)
        .when(last(2).isin(TWO_LABEL_SUFFIXES), last(3))
        .otherwise(last(2))
    )


def normalised_url(url: Column) -> Column:
    """Scheme and authority in lower case, no fragment, no slash at the end of a path, the query kept; an empty path is '/'."""
    u = F.trim(F.coalesce(url, F.lit("")))
    part = lambda i: F.regexp_extract(u, PARTS, i)
    path = F.regexp_replace(part(3), "/+$", "")
    query = F.when(part(4) != "", F.concat(F.lit("?"), part(4))).otherwise("")
    return F.concat(F.lower(part(1)), F.when(part(1) != "", "://").otherwise(""), F.lower(part(2)), F.when(path == "", "/").otherwise(path), query)


def safe_link(url: Column) -> Column:
    """A fragment, or http(s) with a host."""
    return F.startswith(url, F.lit("#")) | (url.rlike("^(?i)https?://[^/?#]+"))


def admissible(url: Column) -> Column:
    """http(s), a host, no credentials, a default port, and no literal private, loopback or link-local address.

    Names are admitted unresolved: looking them up lies outside the engine.
    """
    authority = F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)
    h = host(url)
    private = r"^(127\.|10\.|0\.|169\.254\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.|100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.|22[4-9]\.|2[3-5]\d\.)"
    return url.rlike("^(?i)https?://") & (h != "") & ~authority.contains("@") & ~authority.rlike(r":(?!80$|443$)\d+$") & ~h.isin("localhost") & ~F.endswith(h, F.lit(".localhost")) & ~h.rlike(private) & ~F.startswith(authority, F.lit("["))
