"""Address admission and decoding of fetched documents. Names are not resolved and nothing is fetched here."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_public(value: str | None) -> bool:
    """A global address; one that carries another inside (mapped, 6to4, Teredo) is public only if that one is."""
    try:
        a = ipaddress.ip_address((value or "").strip("[]"))
    except ValueError:
        return False
    if isinstance(a, ipaddress.IPv6Address):
        inner = [x for x in (a.ipv4_mapped, a.sixtofour, *(a.teredo or ())) if x is not None]
        if any(not is_public(str(x)) for x in inner):
            return False
    return a.is_global and not a.is_multicast


@F.pandas_udf(T.BooleanType())
def public_address(x: pd.Series) -> pd.Series:
    return x.map(is_public)


def decoded(body: Column, content_type: Column, charset: str = "UTF-8") -> Column:
    """Text of a textual document; null for other kinds."""
    return F.when(content_type.rlike(r"(?i)^(text/|application/(xhtml\+xml|xml|json))"), F.decode(body, charset))
