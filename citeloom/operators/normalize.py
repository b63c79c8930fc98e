"""Answers of the four sources into typed paper records, inside the JVM.

Every normalizer is one projection over the parsed variant; wrappers, quoting and
arrays around the record are taken off first, so a table of mixed answers is
normalized in one scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.extract import strip_tags
from citeloom.functions.ids import bare_id, blank_to_null
from citeloom.operators.nested import children, let, parse_record


def _s(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _first_text(v: Column, *keys: str) -> Column:
    """The first non-blank text under any of the keys, each an array or a single value."""
    found = [F.get(F.filter(F.transform(children(v, (k,)), lambda x: blank_to_null(F.try_variant_get(x, "$", "string"))), lambda t: t.isNotNull()), F.lit(0)) for k in keys]
    return F.coalesce(*found)


def inverted_abstract(index: Column) -> Column:
    """The text behind a map of words to positions; of two words at one position the last stands; no words give null."""
    entries = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(F.coalesce(e["value"], F.array().cast("array<int>")), lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    ordered = F.array_sort(entries)
    return F.when(F.size(ordered) > 0, F.array_join(F.transform(ordered, lambda x: x["w"]), " "))


def arxiv_year(arxiv_id: Column) -> Column:
    """The year an arXiv id tells: two digits, from 91 on in the last century; new and old style."""
    x = F.trim(arxiv_id)
    yy = F.coalesce(F.nullif(F.regexp_extract(x, r"^(\d{2})\d{2}\.\d{4,5}", 1), F.lit("")), F.nullif(F.regexp_extract(x, r"^[^/]+/(\d{2})", 1), F.lit(""))).cast("int")
    return let(yy, lambda y: F.when(y < 91, 2000 + y).when(y.isNotNull(), 1900 + y))


def normalize(raw: DataFrame, source: str, source_id: str, payload: str) -> DataFrame:
    """(source, source_id, canonical_id, title, abstract, year, venue, doi, authors, references) of payloads that hold a record.

    A missing title becomes a stand-in as each source's answers suggest; years that
    are no numbers are null; references are what the source names them by.
    """
    named = raw.select(F.lower(F.trim(source)).alias("_kind"), F.col(source_id).alias("_id"), F.col(payload).alias("_text"))
    # parsed once and without a filter on it, which would be pushed down and parse again
    record = let(parse_record(F.col("_text")), lambda v: F.when(v.isNotNull(), _fields(v, F.col("_kind"))))
    return named.select(F.col("_kind").alias("source"), F.col("_id").alias("source_id"), F.inline(F.array_compact(F.array(record))))


def _fields(v: Column, source: Column) -> Column:
    tail = lambda c: F.element_at(F.split(c, "/"), -1)
    doi = lambda p: bare_id(_s(v, p))
    people = children(v, ("authorships", "author", "authors"))
    name = lambda a: blank_to_null(F.coalesce(_s(a, "$.author.display_name"), _s(a, "$.name"), F.nullif(F.trim(F.concat_ws(" ", F.trim(_s(a, "$.given")), F.trim(_s(a, "$.family")))), F.lit("")), F.try_variant_get(a, "$", "string")))
    is_ = lambda s: source == s
    openalex_refs = F.transform(children(v, ("referenced_works",)), lambda x: F.try_variant_get(x, "$", "string"))
    crossref_refs = F.transform(children(v, ("reference",)), lambda x: F.lower(_s(x, "$.DOI")))
    s2_refs = F.transform(children(v, ("references",)), lambda x: _s(x, "$.paperId"))
    refs = F.when(is_("openalex"), openalex_refs).when(is_("crossref"), crossref_refs).when(is_("semantic_scholar"), s2_refs)
    aid = F.coalesce(_s(v, "$.id"), F.lit("unknown"))
    own_doi = F.when(is_("crossref"), doi("$.DOI")).when(is_("openalex"), doi("$.doi")).when(is_("semantic_scholar"), doi("$.externalIds.DOI")).otherwise(F.coalesce(doi("$.doi"), F.concat(F.lit("10.48550/arxiv."), F.lower(aid))))
    year = F.coalesce(F.try_variant_get(v, "$.publication_year", "int"), F.try_variant_get(v, "$['published-print']['date-parts'][0][0]", "int"), F.try_variant_get(v, "$.year", "int"))
    title = F.when(is_("crossref"), F.coalesce(_first_text(v, "title", "subtitle", "short-title"), F.concat(F.lit("DOI:"), own_doi))).otherwise(blank_to_null(_s(v, "$.title")))
    empty = F.array().cast("array<string>")
    kind = F.when(is_("openalex"), F.concat(F.lit("openalex:"), F.coalesce(tail(_s(v, "$.id")), F.lit("unknown")))).when(is_("crossref"), F.concat(F.lit("doi:"), F.coalesce(own_doi, F.lit("unknown")))).when(is_("arxiv"), F.concat(F.lit("arxiv:"), aid)).otherwise(F.concat(F.lit("s2:"), F.coalesce(_s(v, "$.paperId"), F.lit("unknown"))))
    return F.struct(
        kind.alias("canonical_id"),
        F.coalesce(title, F.lit("untitled")).alias("title"),
        F.coalesce(strip_tags(_s(v, "$.abstract")), blank_to_null(_s(v, "$.summary")), inverted_abstract(F.try_variant_get(v, "$.abstract_inverted_index", "map<string,array<int>>"))).alias("abstract"),
        F.when(is_("arxiv"), F.lit(None).cast("int")).otherwise(year).alias("year"),
        F.when(is_("arxiv"), "arXiv").otherwise(F.coalesce(_s(v, "$.host_venue.display_name"), _first_text(v, "container-title", "short-container-title"), _s(v, "$.venue"))).alias("venue"),
        own_doi.alias("doi"),
        F.coalesce(F.filter(F.transform(people, name), lambda x: x.isNotNull()), empty).alias("authors"),
        F.coalesce(F.filter(refs, lambda x: x.isNotNull() & (x != "")), empty).alias("references"),
    )


def keep_latest(raw: DataFrame, keys: list[str], at: str, body: str) -> DataFrame:
    """The newest row per key; the larger body among equal times. A combinable aggregate, so a hot key is no hot spot."""
    return raw.groupBy(*keys).agg(F.max(F.struct(F.col(at), F.col(body))).alias("_r")).select(*keys, F.col(f"_r.{at}").alias(at), F.col(f"_r.{body}").alias(body))


def snippets(raw: DataFrame) -> DataFrame:
    """(src, ref_key, context): the first snippet with which a semantic_scholar answer cites each work."""
    r = raw.filter(F.lower(F.trim("source")) == "semantic_scholar").select(bare_id(F.col("source_id")).alias("src"), parse_record(F.col("payload")).alias("v"))
    x = r.select("src", F.posexplode(children(F.col("v"), ("references",))).alias("pos", "r"))
    text = F.get(F.filter(F.transform(children(F.col("r"), ("contexts",)), lambda c: blank_to_null(F.try_variant_get(c, "$", "string"))), lambda c: c.isNotNull()), F.lit(0))
    key = bare_id(F.coalesce(_s(F.col("r"), "$.paperId"), _s(F.col("r"), "$.externalIds.any")))
    y = x.select("src", "pos", key.alias("ref_key"), text.alias("context")).filter("ref_key is not null and context is not null")
    return y.groupBy("src", "ref_key").agg(F.min(F.struct("pos", "context")).alias("m")).select("src", "ref_key", "m.context")
