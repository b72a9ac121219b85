"""Columns for URLs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from sievemill.functions.suffixes import NONE, registrable, suffix_rules

#: Scheme, authority, path and query of a URL (RFC 3986, appendix B).
_PARTS = r"(?s)\A(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(?:#.*)?\z"


def normalized(url: Column) -> Column:
    """Scheme and host in lower case, without the fragment and, unless the path is just one, slashes at the path's end."""
    part = lambda k: F.regexp_extract(url, _PARTS, k)
    path = part(3)
    scheme = F.when(part(1) != "", F.concat(F.lower(part(1)), F.lit(":"))).otherwise(F.lit(""))
    authority = F.when(part(2) == "//", F.lit("")).otherwise(F.lower(part(2)))
    query = F.when(part(4) == "?", F.lit("")).otherwise(part(4))
    return F.concat(scheme, authority, F.when(F.length(path) > 1, F.rtrim(path, F.lit("/"))).otherwise(path), query)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"\A([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def domain(url: Column) -> Column:
    """The registrable domain, or 'None'."""
    rules = suffix_rules()

    @F.pandas_udf(T.StringType())
    def find(urls: pd.Series) -> pd.Series:
        known: dict[str | None, str] = {}
        return urls.map(lambda u: known[u] if u in known else known.setdefault(u, registrable(u, rules)))

    return find(url)


def off_domain(domain_of: Column, home: Column) -> Column:
    """Whether a registrable domain is another than home; 'None' never is."""
    return (domain_of != NONE) & (domain_of != home)
