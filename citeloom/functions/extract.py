"""What papers' texts tell about themselves: identifiers, references, headers, titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How DOIs and arXiv ids look in running text.
DOI = r"(?i)\b10\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]+\b"
ARXIV = r"\b[0-9]{4}\.[0-9]{4,5}\b"
#: Parts of lines that are no titles.
NOISE = (
    "proceedings of", "conference on", "workshop on", "symposium on", "international conference", "annual conference", "pages ", "page ", " pp.", " pp ", "vol.", "volume ",
    "issue ", "isbn", "doi:", "arxiv", "abstract", "keywords", "introduction", "references", "bibliography", "ieee ", " acm ", "copyright", "received ", "accepted ",
    "figure ", "table ", "committee", "editorial board", "program committee",
)


def _found(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))


def tail_first(text: Column, pattern: str, tail: int = 1000) -> Column:
    """The first match in the last ``tail`` characters, else in the whole text, in lower case."""
    return F.lower(F.coalesce(_found(F.right(text, F.lit(tail)), pattern), _found(text, pattern)))


def all_dois(text: Column, most: int = 30) -> Column:
    """The distinct DOIs of a text in order, ``most`` at most (a reference list's length, as the extractor reports it)."""
    return F.slice(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(DOI), F.lit(0)), lambda d: F.lower(d))), 1, most)


def strip_tags(text: Column) -> Column:
    """Without markup, white space collapsed; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", " "), r"\s+", " ")), F.lit(""))


def header(text: Column, otherwise: int = 2500) -> Column:
    """The text before its list of references, else its first ``otherwise`` characters."""
    low = F.lower(text)
    at = F.least(*[F.nullif(F.instr(low, w), F.lit(0)) for w in ("references", "bibliography")])
    return F.when(at.isNull(), F.substring(text, 1, otherwise)).otherwise(F.left(text, at - 1))


def guess_title(text: Column) -> Column:
    """The longest (up to 180 characters, the first among equals) of the first 30 lines that may be a title."""
    lines = F.filter(F.transform(F.split(text, r"\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    noisy = lambda x: F.exists(F.array(*[F.lit(n) for n in NOISE]), lambda n: F.instr(F.lower(x), n) > 0)
    kept = F.filter(F.slice(lines, 1, 30), lambda x: (F.length(x) >= 12) & (F.length(x) <= 220) & ~noisy(x) & ~x.rlike(r"^\d{4}\.\d{4,5}"))
    best = F.array_max(F.transform(kept, lambda x, i: F.struct(F.least(F.length(x), F.lit(180)).alias("n"), (-i).alias("i"), x.alias("x"))))
    return best["x"]


def cite_key(paper_id: Column) -> Column:
    k = F.regexp_replace(F.regexp_replace(F.regexp_replace(paper_id, r"[^0-9A-Za-z_]", "_"), "_+", "_"), "^_|_$", "")
    return F.substring(F.when(k == "", "entry").otherwise(k), 1, 80)


def bibtex_escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\{}%])", r"\\$1")


def cache_key(query: Column, top_k: int) -> Column:
    return F.substring(F.sha2(F.concat(F.lower(F.trim(query)), F.lit(f"|top_k={top_k}")), 256), 1, 24)
