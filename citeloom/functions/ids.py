"""Identifiers: white space, resolver addresses, kinds and versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The kinds of identifier that may stand in front of one.
ID_KINDS = "doi|arxiv|openalex|semantic_scholar"


def strip_ws(c: Column) -> Column:
    """Without surrounding white space of any kind (tabs, line ends, no-break spaces); null stays null."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    """Stripped, and null when nothing is left."""
    s = strip_ws(c)
    return F.when(s != "", s)


def bare_id(c: Column) -> Column:
    """The bare identifier, or null for null and blank values.

    Lower case, no surrounding white space, no resolver address, no kind in
    front, and no version on an arXiv id.  A DOI keeps its slash, an old arXiv id
    its archive.
    """
    kind = rf"^(?:{ID_KINDS})\s*:\s*"
    x = F.regexp_replace(F.lower(strip_ws(c)), kind, "")
    address = r"^[a-z][a-z0-9+.\-]*://[^/]+/(?:.*?/)??(10\.[0-9]+/.+|[a-z.\-]+/[0-9]{7}(?:v[0-9]+)?|[^/]+)/*$"
    x = F.regexp_replace(x, address, "$1")
    x = F.regexp_replace(x, kind, "")
    x = F.regexp_replace(x, r"^([0-9]{4}\.[0-9]{4,5}|[a-z.\-]+/[0-9]{7})v[0-9]+$", "$1")
    return F.nullif(x, F.lit(""))


def bare_id_sql(x: str) -> str:
    """The same in DuckDB's SQL, for a column or expression ``x``."""
    s = rf"lower(regexp_replace(regexp_replace({x}, '^\s+', ''), '\s+$', ''))"
    kind = rf"'^(?:{ID_KINDS})\s*:\s*', ''"
    address = r"'^[a-z][a-z0-9+.\-]*://[^/]+/(?:.*?/)??(10\.[0-9]+/.+|[a-z.\-]+/[0-9]{7}(?:v[0-9]+)?|[^/]+)/*$', '\1'"
    version = r"'^([0-9]{4}\.[0-9]{4,5}|[a-z.\-]+/[0-9]{7})v[0-9]+$', '\1'"
    return f"nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace({s}, {kind}), {address}), {kind}), {version}), '')"
