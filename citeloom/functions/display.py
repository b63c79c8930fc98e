"""Lines that results show, search strings and small readings of titles and queries, as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from citeloom.functions.ids import bare_id, blank_to_null, strip_ws
from citeloom.functions.scores import STOPWORDS

#: Venues that stand for none.
NO_VENUE = ("pending-ingest", "unknown")
#: How an edge's confidence reads.
CONFIDENCE_WORDS = {"high": "High evidence", "medium": "Moderate evidence", "low": "Exploratory evidence"}
#: Fields that a search string may begin with.
SEARCH_FIELDS = r"(?i)^(all|ti|au|abs|co|id|cat)\s*:\s*"
#: File names that tell nothing.
FILE_NOISE = ("untitled", "document", "paper", "draft", "main", "manuscript", "ms", "final", "new")
#: Parts of a query that make it specific.
SPECIFIC = ("optimization", "alignment", "neural", "debugging", "convolutional")
#: What a survey's title says.
SURVEY = ("survey", " literature review", " review of", "taxonomy", "overview of")
#: Origins of works that a user named.
OWN_ORIGINS = ("uploaded_pdf", "api_search")


def text(c: Column) -> Column:
    """Stripped, '' for null."""
    return F.coalesce(strip_ws(c), F.lit(""))


def words(c: Column) -> Column:
    return F.filter(F.split(text(c), r"\s+"), lambda w: w != "")


def short_title(title: Column, most: int = 3) -> Column:
    """The title, or its first ``most`` words and an ellipsis; 'Untitled' without one."""
    t = F.coalesce(blank_to_null(title), F.lit("Untitled"))
    return F.when(F.size(words(t)) <= most, t).otherwise(F.concat(F.array_join(F.slice(words(t), 1, most), " "), F.lit("...")))


def domain_label(domain: Column) -> Column:
    return F.initcap(F.regexp_replace(F.coalesce(blank_to_null(domain), F.lit("General")), "_", " "))


def authors_line(authors: Column, most: int = 6) -> Column:
    """The first names with commas, 'et al.' where there are more authors; '' without names."""
    names = F.filter(F.transform(F.slice(authors, 1, most), lambda a: text(a["name"])), lambda n: n != "")
    more = F.when(F.size(authors) > most, " et al.").otherwise("")
    return F.when(F.coalesce(F.size(names), F.lit(0)) > 0, F.concat(F.array_join(names, ", "), more)).otherwise("")


def venue_line(venue: Column) -> Column:
    return F.when(F.lower(text(venue)).isin(*NO_VENUE), "").otherwise(text(venue))


def primary_url(arxiv: Column, doi: Column) -> Column:
    """Where a work is found: its preprint, else its DOI, else null."""
    a, d = blank_to_null(arxiv), blank_to_null(F.regexp_replace(doi, "^https://doi[.]org/", ""))
    return F.coalesce(F.concat(F.lit("https://arxiv.org/abs/"), a), F.concat(F.lit("https://doi.org/"), d))


def first_sentence(abstract: Column) -> Column:
    """The first sentence of more than twenty characters' abstract with its full stop, else ''."""
    s = strip_ws(F.split(text(abstract), r"\. ").getItem(0))
    return F.when(F.length(s) > 20, F.when(F.endswith(s, F.lit(".")), s).otherwise(F.concat(s, F.lit(".")))).otherwise("")


def confidence_words(confidence: Column) -> Column:
    c = F.lower(F.trim(confidence))
    out = F.lit("Unknown evidence")
    for k, v in CONFIDENCE_WORDS.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def cited_by_count(provenance: Column) -> Column:
    """The citations that the first openalex entry with such a number states."""
    counts = F.transform(F.filter(provenance, lambda p: p["source"] == "openalex"), lambda p: F.try_variant_get(F.try_parse_json(p["raw"]), "$.cited_by_count", "bigint"))
    return F.try_element_at(F.array_compact(counts), F.lit(1))


def anthology_id(doi: Column) -> Column:
    """The anthology id in a DOI under 10.18653/v1/, in capitals."""
    return blank_to_null(F.upper(F.regexp_extract(bare_id(doi), r"^10\.18653/v1/(.*)$", 1)))


def bibtex_field(entry: Column, field: str) -> Column:
    """A field's value in braces (braces inside end it), on one line; null if there is none."""
    return blank_to_null(F.regexp_replace(F.regexp_extract(entry, rf"(?is){field}\s*=\s*\{{(.*?)\}}", 1), r"\s+", " "))


def search_query(c: Column) -> Column:
    """Free text as a search over all fields; text that names a field as it is; '' for none."""
    t = text(c)
    safe = F.trim(F.regexp_replace(F.regexp_replace(t, '["\n]', " "), r"\s+", " "))
    return F.when((t == "") | t.rlike(SEARCH_FIELDS), t).when(safe == "", "").otherwise(F.concat(F.lit("all:"), safe))


def file_stem(name: Column) -> Column:
    """What a file's name says of its content; null for short names, numbers and names that tell nothing."""
    stem = F.regexp_replace(F.regexp_extract(name, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")
    s = F.trim(F.regexp_replace(F.regexp_replace(stem, r"[_\-.]+", " "), r"\s+", " "))
    return F.when((F.length(s) >= 6) & ~F.lower(s).isin(*FILE_NOISE) & ~stem.rlike(r"^[0-9._\-]*$"), s)


def normalized_query(c: Column) -> Column:
    """Compatibility forms composed, zero-width characters dropped, lower case; ASCII queries stay as they are."""

    @F.pandas_udf("string")
    def _compatible(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    plain = F.length(c) == F.octet_length(c)
    return F.lower(F.when(plain, strip_ws(c)).otherwise(F.regexp_replace(_compatible(strip_ws(c)), "[​-‍﻿]", "")))


def query_variants(query: Column, more: Column | None = None) -> Column:
    """The searches that stand for a query: itself, then ``more`` of a registry, else what privacy or a short query calls for."""
    q = text(query)
    low = F.lower(q)
    private = low.contains("pii") | low.contains("identifiable") | low.contains("privacy")
    own = F.when(private, F.array(q, F.concat(q, F.lit(' OR "Personally Identifiable Information"')), F.concat(q, F.lit(' OR "data privacy"')))).when(F.size(words(q)) <= 2, F.array(q, F.concat(q, F.lit(" OR survey")))).otherwise(F.array(q))
    if more is not None:
        own = F.when(F.size(more) > 0, F.concat(F.array(q), more)).otherwise(own)
    return F.when(q == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(own, lambda v: v != "")))


def specificity(query: Column) -> Column:
    """How specific a query is, 0 to 1: its telling words over eight, more for three words and for terms of art."""
    tokens = F.array_distinct(F.filter(F.split(F.lower(query), r"[^\p{L}\p{N}_\-]+"), lambda t: (F.length(t) > 2) & ~t.isin(*STOPWORDS)))
    low = F.lower(F.coalesce(query, F.lit("")))
    art = F.greatest(*[F.when(low.contains(x), 0.15).otherwise(0.0) for x in SPECIFIC])
    long = F.when(F.size(words(low)) >= 3, 0.25).otherwise(0.0)
    return F.when(F.coalesce(F.size(tokens), F.lit(0)) == 0, 0.3).otherwise(F.least(F.lit(1.0), F.size(tokens) / 8.0 + long + art))


def titles_for(query: Column, gold: dict[str, list[str]]) -> Column:
    """The titles expected for a query: of the key that equals it, else of the first key that holds it or that it holds."""
    q = F.lower(text(query))
    lists = {k: F.array(*[F.lit(t) for t in v]) for k, v in gold.items()}
    none = F.array().cast("array<string>")
    exact = [F.when(q == k, v) for k, v in lists.items()]
    part = [F.when(q.contains(k) | (F.instr(F.lit(k), q) > 0), v) for k, v in lists.items()]
    return F.coalesce(*exact, *part, none)


def cluster_hit(blob: Column, markers: Column) -> Column:
    """The share of a cluster's markers in a text, three of them being all."""
    hits = F.size(F.filter(markers, lambda m: F.contains(blob, m)))
    return F.when(F.size(markers) == 0, 0.0).otherwise(F.least(F.lit(1.0), hits / F.least(F.lit(3), F.size(markers))))


def strongest_cluster(blob: Column, clusters: dict[str, list[str]]) -> Column:
    """struct<hit, name> of the cluster with the largest share, the first among equals; (0, null) if none has any."""
    best = F.struct(F.lit(0.0).alias("hit"), F.lit(None).cast("string").alias("name"))
    for name, markers in clusters.items():
        h = cluster_hit(blob, F.array(*[F.lit(m) for m in markers]))
        best = F.when(h > best["hit"], F.struct(h.alias("hit"), F.lit(name).alias("name"))).otherwise(best)
    return best


def venue_topics(blob: Column, venue: Column, terms: Column) -> Column:
    """The share of a query's terms in a text or venue, four of them being all; 0.5 without terms."""
    v = F.lower(F.coalesce(venue, F.lit("")))
    hits = F.size(F.filter(terms, lambda t: F.contains(blob, F.lower(t)) | F.contains(v, F.lower(t))))
    return F.when(F.coalesce(F.size(terms), F.lit(0)) == 0, 0.5).otherwise(F.least(F.lit(1.0), hits / F.least(F.lit(4), F.size(terms))))


def probe_score(provenance: Column) -> Column:
    """The score of the first topic probe among a record's sources, 0 if there is none."""
    scores = F.transform(F.filter(provenance, lambda p: p["source"] == "topic_probe"), lambda p: F.try_variant_get(F.try_parse_json(p["raw"]), "$.score", "double"))
    return F.coalesce(F.try_element_at(scores, F.lit(1)), F.lit(0.0))


def survey_context(hub: Column, relation: Column, origin: Column) -> Column:
    return F.coalesce(hub, F.lit(False)) | (F.coalesce(relation, F.lit(0.0)) >= 0.14) | F.coalesce(F.trim(origin).isin(*OWN_ORIGINS), F.lit(False))


#: The tags of a work in the order they are shown, and the canonicality a tag takes.
TAGS = ("Foundational", "Survey", "Recent", "Bridge", "Canonical", "Cross-domain")
CANONICAL_FROM = 0.55


def role_tags(title: Column, year: Column, hub: Column, bridge: Column, canonical: Column, domain: Column, wanted: Column) -> Column:
    """The tags of a work in order."""
    t, d = F.lower(F.coalesce(title, F.lit(""))), F.lower(text(domain))
    flags = (hub, F.greatest(*[t.contains(s) for s in SURVEY]), year >= 2021, bridge, canonical >= CANONICAL_FROM, (F.size(wanted) > 0) & (d != "") & ~F.array_contains(wanted, d))
    return F.array_compact(F.array(*[F.when(F.coalesce(f, F.lit(False)), name) for f, name in zip(flags, TAGS)]))


def literature_label(title: Column, query: Column, stop: tuple[str, ...]) -> Column:
    """A branch's name from its central title: up to eight telling words that the query does not hold, 72 characters at most."""
    block = F.regexp_extract_all(F.lower(F.coalesce(query, F.lit(""))), F.lit(r"[a-z][a-z0-9\-]{2,}"), F.lit(0))
    found = F.regexp_extract_all(text(title), F.lit(r"[a-zA-Z][a-zA-Z0-9\-]{2,}"), F.lit(0))
    kept = F.filter(found, lambda w: ~F.lower(w).isin(*stop) & ~F.array_contains(block, F.lower(w)))
    phrase = F.initcap(F.array_join(F.slice(kept, 1, 8), " "))
    cut = F.concat(F.regexp_replace(F.substring(phrase, 1, 72), r" [^ ]*$", ""), F.lit("…"))
    head = F.substring(text(title), 1, 70)
    short = F.when((F.length(head) == 70) & head.contains(" "), F.concat(F.regexp_replace(head, r" [^ ]*$", ""), F.lit("…"))).otherwise(head)
    return F.when(F.size(kept) >= 3, F.when(F.length(phrase) > 72, cut).otherwise(phrase)).otherwise(F.coalesce(blank_to_null(short), F.lit("Literature branch")))
