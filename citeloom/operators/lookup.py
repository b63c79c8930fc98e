"""Looking records up among what providers have answered: by id, alias, DOI or title, in chains of providers.

A provider's answers are a table, so a fetch is a join: requests that a table does
not answer go on to the next, and what none answers is a row with nulls.  Requests
carry their position and keep it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.ids import bare_id, blank_to_null
from citeloom.operators.nested import parse_record
from citeloom.operators.skew import salted_join

#: The order in which providers are asked for a DOI, the ids a batch holds, and the hits a search gives at most.
ORDER = ("openalex", "crossref", "semantic_scholar", "arxiv")
BATCH, HITS = 50, 25
WORK_ID = r"(?i)^W[0-9]+$"


def _tail(c: Column) -> Column:
    return F.element_at(F.split(F.trim(c), "/"), -1)


def aliases_of_payloads(raw: DataFrame) -> DataFrame:
    """(alias, source, source_id): every work id of an answer, its own and those under ``ids``, in capitals; the newest answer per alias.

    ``raw`` holds (source, source_id, payload, fetched_unix); payloads that hold no record have none.
    """
    x = raw.select("source", "source_id", "fetched_unix", parse_record(F.col("payload")).alias("v")).filter("v is not null")
    more = F.map_values(F.coalesce(F.try_variant_get("v", "$.ids", "map<string,string>"), F.create_map().cast("map<string,string>")))
    ids = F.concat(F.array(F.try_variant_get("v", "$.id", "string")), more)
    y = x.select("source", "source_id", "fetched_unix", F.explode(F.array_distinct(F.transform(ids, lambda i: F.upper(_tail(i))))).alias("alias")).filter(F.col("alias").rlike(WORK_ID))
    return y.groupBy("alias").agg(F.max_by(F.struct("source", "source_id"), F.struct("fetched_unix", "source", "source_id")).alias("r")).select("alias", "r.*")


def by_alias(requests: DataFrame, aliases: DataFrame) -> DataFrame:
    """Requests (key) with the (source, source_id) that answers them, null if none; only work ids are asked for."""
    asked = requests.withColumn("_a", F.when(F.trim("key").rlike(WORK_ID), F.upper(F.trim("key"))))
    return asked.join(aliases.withColumnRenamed("alias", "_a"), "_a", "left").drop("_a")


def work_ids(seeds: DataFrame) -> DataFrame:
    """(query_id, id, pos): the distinct work ids among seeds (query_id, provider, id, pos) of that provider, each at its first place."""
    w = seeds.filter((F.lower(F.trim("provider")) == "openalex") & F.trim("id").rlike("^W[0-9]+$"))
    return w.groupBy("query_id", F.trim("id").alias("id")).agg(F.min("pos").alias("pos"))


def chained(requests: DataFrame, key: str, records: DataFrame, keys: Column, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Requests with the record of the first provider in ``order`` that knows their ``key``: (source, canonical_id, title), null if none does.

    ``keys`` is an array of the keys of a record.  One join for all providers: the
    best answer per key is a combinable aggregate.
    """
    rank = F.coalesce(*[F.when(F.col("source") == s, i) for i, s in enumerate(order)])
    known = records.select(F.explode(F.array_distinct(keys)).alias(key), rank.alias("_rank"), "source", "canonical_id", "title").filter((F.col(key).isNotNull()) & F.col("_rank").isNotNull())
    best = known.groupBy(key).agg(F.min(F.struct("_rank", "canonical_id", "source", "title")).alias("_b"))
    return salted_join(requests, best.select(key, F.col("_b.source").alias("source"), F.col("_b.canonical_id").alias("canonical_id"), F.col("_b.title").alias("title")), key, "left")


def doi_keys() -> Column:
    """The keys a record answers to when asked by DOI: its own and, for a preprint's DOI, the preprint."""
    d = bare_id(F.col("doi"))
    return F.array_compact(F.array(d, F.when(F.startswith(d, F.lit("10.48550/arxiv.")), F.substring(d, len("10.48550/arxiv.") + 1, 100))))


def title_search(queries: DataFrame, records: DataFrame, most: int = 5, id_column: str = "canonical_id") -> DataFrame:
    """(query_id, canonical_id, score, rank): the records whose titles share most of the query's words, ``most`` (25 at most) each.

    The score is the share of the query's words in the title; records meet queries by
    their words only, and the smaller id goes first among equals.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) > 2))
    q = queries.select("query_id", words(F.col("query")).alias("_q")).filter("size(_q) > 0")
    at = q.select("query_id", F.size("_q").alias("_n"), F.explode("_q").alias("w"))
    t = records.select(id_column, F.explode(words(F.col("title"))).alias("w"))
    hits = t.join(at, "w").groupBy("query_id", id_column).agg((F.count(F.lit(1)) / F.first("_n")).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), id_column)
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max(1, min(HITS, most)))


def routed(seeds: DataFrame, providers: tuple[str, ...] = ORDER) -> DataFrame:
    """Seeds with ``error``: null where there is a provider for them, else what there is."""
    known = F.lower(F.trim("provider")).isin(*providers)
    return seeds.withColumn("error", F.when(~F.coalesce(known, F.lit(False)), F.concat(F.lit("no provider "), F.coalesce("provider", F.lit("?")), F.lit("; there are "), F.lit(", ".join(sorted(providers))))))


def missing_batches(wanted: DataFrame, cached: DataFrame, size: int = BATCH) -> DataFrame:
    """(batch, ids): the distinct wanted ids (id) that are not cached (id), in batches of ``size`` at most.

    Ids are numbered within hash buckets of some thousand, so no task sees all of them.
    """
    miss = wanted.select(F.trim("id").alias("id")).filter(F.col("id").rlike("^W[0-9]+$")).distinct().join(cached.select("id").distinct(), "id", "left_anti")
    n = miss.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / 4096)).alias("_buckets"))
    x = miss.crossJoin(F.broadcast(n)).withColumn("_b", F.pmod(F.xxhash64("id"), F.col("_buckets")))
    x = x.withColumn("_k", F.floor((F.row_number().over(Window.partitionBy("_b").orderBy("id")) - 1) / size))
    return x.groupBy("_b", "_k").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.concat_ws("-", "_b", "_k").alias("batch"), "ids")


def enriched(records: DataFrame, key: str, sources: list[tuple[str, DataFrame]], fields: tuple[str, ...] = ("abstract", "year", "venue")) -> DataFrame:
    """Records without a title of their own ('DOI:...' or blank), filled from ``sources`` (name, table keyed by ``key``) in order.

    A source's title replaces a missing one; its other fields fill empty ones; the
    first source that gives a title ends the chain.  ``enriched_from`` names it.
    """
    lacks = lambda: F.coalesce(F.trim("title"), F.lit("")).rlike(r"(?i)^(doi:.*)?$")
    x = records.withColumn("enriched_from", F.lit(None).cast("string"))
    for name, table in sources:
        # one row per key: the first by title
        t = table.groupBy(key).agg(F.min(F.struct("title", *fields)).alias("_s"))
        x = x.join(t, key, "left").withColumn("_open", lacks() & F.col("_s").isNotNull())
        has = F.col("_open") & blank_to_null(F.col("_s.title")).isNotNull()
        fill = {f: F.when(F.col("_open"), F.coalesce(F.nullif(F.col(f), F.lit("").cast(dict(records.dtypes)[f])) if dict(records.dtypes)[f] == "string" else F.col(f), F.col(f"_s.{f}"))).otherwise(F.col(f)) for f in fields}
        x = x.withColumns({**fill, "enriched_from": F.when(has, F.lit(name)).otherwise(F.col("enriched_from")), "title": F.when(has, F.trim("_s.title")).otherwise(F.col("title"))}).drop("_s", "_open")
    return x


def hydrated(records: DataFrame, answers: list[DataFrame], placeholder: Column, id_column: str = "openalex_id") -> DataFrame:
    """Records in which placeholders are replaced by the first of the rounds ``answers`` (id_column, title) that knows them.

    ``graph_noise``: placeholders with a work id that no round knows.
    """
    x = records.withColumn("_open", placeholder)
    for a in answers:
        fresh = a.groupBy(id_column).agg(F.min("title").alias("_t"))
        x = x.join(fresh, id_column, "left").withColumns({"title": F.when(F.col("_open") & F.col("_t").isNotNull(), F.col("_t")).otherwise(F.col("title")), "_open": F.col("_open") & F.col("_t").isNull()}).drop("_t")
    return x.withColumn("graph_noise", F.col("_open") & F.coalesce(F.trim(id_column).rlike("^W[0-9]+$"), F.lit(False))).drop("_open")


def refreshed(nodes: DataFrame, fresh: DataFrame, key: str, kept: tuple[str, ...]) -> DataFrame:
    """Nodes with the values of ``fresh`` where it has any; the columns ``kept`` (ranks, layout) stay as they are."""
    new = [c for c in fresh.columns if c != key and c not in kept]
    f = fresh.select(key, *[F.col(c).alias(f"_{c}") for c in new])
    return nodes.join(f, key, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in new else F.col(c) for c in nodes.columns])


def zipped(seeds: DataFrame, records: DataFrame, least: float = 0.8) -> DataFrame:
    """Records (query_id, seed_pos, ...) with a topic probe appended to their sources where the seed at their place has a concept score of ``least``.

    Joined by place, so a seed without a record shifts nothing.
    """
    s = seeds.filter(F.col("concept_score") >= least).select("query_id", "seed_pos", F.col("concept_score").alias("_c"))
    return records.join(s, ["query_id", "seed_pos"], "left").withColumn("sources", F.when(F.col("_c").isNotNull(), F.concat("sources", F.array(F.struct(F.lit("topic_probe").alias("source"), F.col("_c").alias("score"))))).otherwise(F.col("sources"))).drop("_c")


def concept_works(raw: DataFrame, concept: str, least: float = 0.8) -> DataFrame:
    """(source_id, score): answers that state a concept (the last part of its id) with a score of ``least`` or more."""
    x = raw.select("source_id", parse_record(F.col("payload")).alias("v"))
    concepts = F.try_variant_get("v", "$.concepts", "array<struct<id:string,score:double>>")
    score = F.array_max(F.transform(F.filter(concepts, lambda c: _tail(c["id"]) == concept), lambda c: c["score"]))
    return x.select("source_id", score.alias("score")).filter(F.col("score") >= least).groupBy("source_id").agg(F.max("score").alias("score"))


def promoted_hubs(resolved: DataFrame, references: DataFrame, cited: DataFrame, known: DataFrame, seeds: int = 2, top: int = 4) -> DataFrame:
    """(query_id, seed, id, rank): of the smallest ``seeds`` resolved ids of a query, the ``top`` most cited references that it does not know yet.

    ``resolved`` (query_id, id), ``references`` (id, ref), ``cited`` (id, n), ``known`` (query_id, id).
    """
    s = resolved.withColumn("_k", F.row_number().over(Window.partitionBy("query_id").orderBy("id"))).filter(F.col("_k") <= seeds).select("query_id", F.col("id").alias("seed"))
    r = s.join(references.select(F.col("id").alias("seed"), F.col("ref").alias("id")).distinct(), "seed").join(cited, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    r = r.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "seed").orderBy(F.desc("n"), "id"))).filter(F.col("rank") <= top)
    return r.join(known.select("query_id", "id").distinct(), ["query_id", "id"], "left_anti").select("query_id", "seed", "id", "rank")


def badges(nodes: DataFrame, hints: DataFrame) -> DataFrame:
    """(canonical_id, badge): the badge of the first hint (pos, provider, id, badge) that names a node by DOI, work id, preprint or end of its id.

    An or-join as a union of equi-joins on the kind and value of an identifier.
    """
    h = hints.filter(blank_to_null(F.col("id")).isNotNull()).select("pos", "badge", F.when(F.lower("provider").isin("doi", "crossref"), "doi").otherwise(F.lower("provider")).alias("kind"), bare_id(F.col("id")).alias("value"))
    own = [F.struct(F.lit(k).alias("kind"), bare_id(F.col(c)).alias("value")) for k, c in (("doi", "doi"), ("openalex", "openalex_id"), ("arxiv", "arxiv_id"))]
    end = F.struct(F.lit("openalex").alias("kind"), bare_id(F.element_at(F.split("canonical_id", ":"), -1)).alias("value"))
    keys = nodes.select("canonical_id", F.inline(F.array(*own, end))).filter("value is not null").distinct()
    return keys.join(h, ["kind", "value"]).groupBy("canonical_id").agg(F.min_by("badge", F.struct("pos", "badge")).alias("badge"))


def missing_link_details(candidates: DataFrame, papers: DataFrame, concept: str, least_links: int = 3) -> DataFrame:
    """(canonical_id, links, cited_by, concept_match, is_hub) of missing-link candidates (canonical_id, links).

    Citations and concepts come from the first openalex source of the record; hubs
    are marked as such, or match the concept with enough links.
    """
    first = F.get(F.filter("provenance", lambda p: p["source"] == "openalex"), F.lit(0))
    v = F.try_parse_json(first["raw"])
    concepts = F.try_variant_get(v, "$.concepts", "array<struct<id:string,score:double>>")
    match = F.coalesce(F.array_max(F.transform(F.filter(concepts, lambda c: _tail(c["id"]) == concept), lambda c: c["score"])), F.lit(0.0))
    p = papers.select("canonical_id", F.coalesce(F.try_variant_get(v, "$.cited_by_count", "int"), F.lit(0)).alias("cited_by"), F.round(match, 4).alias("concept_match"), F.exists(F.coalesce("provenance", F.array().cast(dict(papers.dtypes)["provenance"])), lambda x: x["source"] == "foundational_hub").alias("_h"))
    z = lambda c, d: F.coalesce(F.col(c), F.lit(d)).alias(c)
    x = candidates.join(p, "canonical_id", "left").select("canonical_id", "links", z("cited_by", 0), z("concept_match", 0.0), F.coalesce("_h", F.lit(False)).alias("_h"))
    return x.select("canonical_id", "links", "cited_by", "concept_match", (F.col("_h") | ((F.col("concept_match") >= 0.25) & (F.col("links") >= least_links))).alias("is_hub"))
