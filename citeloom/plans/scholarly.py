"""Queries of the citation graph, discovery and ranking operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.functions import scores as S
from citeloom.functions.ids import bare_id, bare_id_sql
from citeloom.operators import graph as G
from citeloom.operators import ranking as R
from citeloom.staging import Stage
from citeloom.tables import table

#: The query that the scoring queries rank all papers for, and the year they count from.
QUERY = "garbage collection in virtual machines"
AS_OF = 2026
FIELDS = ("title", "abstract", "year", "venue", "domain", "doi", "arxiv_id", "semantic_scholar_id", "openalex_id", "references", "provenance", "authors")


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.nodes(table(spark, d, "papers"), *FIELDS)


def _cites(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = _nodes(spark, d)
    return n, Stage(spark, "cites").put(G.resolve_references(n))


def _drawn(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = _nodes(spark, d)
    return n, Stage(spark, "drawn").put(G.resolve_edges(table(spark, d, "edges"), n))


def _anchors(n: DataFrame, name: str = "anchor") -> DataFrame:
    """The preprints stand for what a user uploaded."""
    return n.filter(F.col("canonical_id").startswith("arxiv:")).select(F.col("canonical_id").alias(name))


def resolve_references(spark, d):
    return _cites(spark, d)[1].select("src", "ref_pos", "ref", "dst")


def edge_context(spark, d):
    n, e = _cites(spark, d)
    return G.edge_context(e.select("src", "ref_pos", "dst"), n)


def graph_degrees(spark, d):
    return G.degrees(*_cites(spark, d))


def cocitation_pairs(spark, d):
    return G.cocitation(_cites(spark, d)[1], 3)


def coupling_pairs(spark, d):
    return G.coupling(_cites(spark, d)[1], 3)


def cocitation_pairs_all(spark, d):
    """Every pair with its intersection, as the reference returns it; only pairs that share nothing are left out."""
    return G.cocitation(_cites(spark, d)[1], 1)


def coupling_pairs_all(spark, d):
    return G.coupling(_cites(spark, d)[1], 1)


def _raw_refs(n: DataFrame) -> DataFrame:
    return n.select(F.col("canonical_id").alias("src"), F.explode(F.array_distinct(F.transform("references", bare_id))).alias("ref")).filter("ref is not null")


def strong_coupling_edges(spark, d):
    n, e = _cites(spark, d)
    return G.strong_coupling_edges(e, _raw_refs(n), 3)


def relation_expand_scores(spark, d):
    n, e = _cites(spark, d)
    r = G.relation_scores(n, e, _anchors(n))
    return r.select("canonical_id", F.round("score", 6).alias("score"), "direct_hits", "max_coupling", "max_cocitation", G.relation_reason().alias("reason"))


def missing_links(spark, d):
    n, e = _cites(spark, d)
    return G.missing_links(e, _anchors(n))


def foundational_refs_3plus(spark, d):
    return missing_links(spark, d).filter("citing_anchors >= 3")


def refs_not_in_graph(spark, d):
    return G.references_outside(_nodes(spark, d))


def second_hop_seeds(spark, d):
    n, e = _cites(spark, d)
    return G.second_hop(e, n, _anchors(n, "seed"), 5)


def broaden_pool(spark, d):
    n, e = _cites(spark, d)
    return G.broaden(e, n, _anchors(n, "seed"), 5, 5)


def second_hop_seeds_full(spark, d):
    """With the reference's cap of 30 references a seed."""
    n, e = _cites(spark, d)
    return G.second_hop(e, n, _anchors(n, "seed"))


def broaden_pool_full(spark, d):
    """With the reference's caps of 35 references and 25 citers a seed."""
    n, e = _cites(spark, d)
    return G.broaden(e, n, _anchors(n, "seed"))


def edge_confidence_histogram(spark, d):
    return G.confidence_histogram(table(spark, d, "edges"))


def edge_quality(spark, d):
    n, e = _drawn(spark, d)
    return G.edge_quality(n, e).select("canonical_id", F.round("raw", 6).alias("raw"), F.round("edge_quality", 6).alias("edge_quality"))


def _semantic(n: DataFrame) -> DataFrame:
    return n.select("canonical_id", S.vocabulary_coherence(F.lit(QUERY)).alias("score"))


def local_connectivity(spark, d):
    n, e = _drawn(spark, d)
    return G.local_connectivity(n, e, _semantic(n)).select("canonical_id", F.round("connectivity", 6).alias("connectivity"))


def hub_suppressed(spark, d):
    n, e = _cites(spark, d)
    x = G.degrees(n, e).withColumn("score", F.sqrt("degree"))
    return G.hub_suppressed(x, "score").select("canonical_id", "degree", F.round("suppressed", 6).alias("suppressed"))


def anchor_hops(spark, d):
    n, e = _cites(spark, d)
    return G.anchor_hops(n, e, _anchors(n))


def pagerank(spark, d):
    _, e = _drawn(spark, d)
    return G.pagerank(e.filter("query_id is not null")).select("query_id", "node", F.round("rank", 8).alias("rank"))


def reading_paths(spark, d):
    n, e = _cites(spark, d)
    return G.time_forward_path(e, n, _anchors(n, "seed"))


def recommend_topk(spark, d):
    n, e = _cites(spark, d)
    x = n.join(G.degrees(n, e), "canonical_id")
    return R.recommend(x, AS_OF, 10)


def trend_grouping_sets(spark, d):
    _nodes(spark, d).select(F.coalesce(F.col("year").cast("string"), F.lit("unknown")).alias("year"), F.coalesce("domain", F.lit("unknown")).alias("domain")).createOrReplaceTempView("citeloom_nodes")
    return spark.sql("select year, domain, count(*) as papers, grouping_id() as which from citeloom_nodes group by grouping sets ((year), (domain))")


def domain_distribution(spark, d):
    return _nodes(spark, d).filter("domain is not null").groupBy("domain").agg(F.count(F.lit(1)).alias("papers")).orderBy(F.desc("papers"), "domain")


def source_summary(spark, d):
    return _nodes(spark, d).groupBy(F.lower(F.trim(F.get("provenance", F.lit(0))["source"])).alias("source")).agg(F.count(F.lit(1)).alias("papers"))


def identifier_keys(spark, d):
    return G.aliases(_nodes(spark, d))


def recency_columns(spark, d):
    n = _nodes(spark, d)
    y = F.when(F.col("year").between(1900, AS_OF), F.col("year"))
    return n.select("canonical_id", S.recency_alignment(y, AS_OF).alias("alignment"), S.recency_penalty(y, AS_OF).alias("penalty"), F.round(S.recency_decay(F.col("domain"), y, AS_OF), 6).alias("decay"), S.era_coherence(y, AS_OF).alias("era"))


def vocabulary_coherence(spark, d):
    n = _nodes(spark, d)
    return n.select("canonical_id", F.round(S.vocabulary_coherence(F.lit(QUERY)), 6).alias("vocabulary"), F.round(S.lexical_similarity(F.lit(QUERY)), 6).alias("lexical"))


def phrase_overlap(spark, d):
    n = _nodes(spark, d)
    return n.select("canonical_id", F.round(S.phrase_overlap(F.lit(QUERY), F.col("title")), 6).alias("overlap"))


def venue_domains(spark, d):
    return _nodes(spark, d).groupBy(S.domain_of_venue(F.col("venue")).alias("domain")).agg(F.count(F.lit(1)).alias("papers"))


def title_query_domains(spark, d):
    return _nodes(spark, d).select("canonical_id", F.explode_outer(S.domains_of_query(F.col("title"))).alias("domain"))


def _features(spark, d) -> DataFrame:
    """(canonical_id, title, year, semantic, graph, connectivity, hops, inbound, domain): the inputs of fusion."""
    n, e = _cites(spark, d)
    deg = G.degrees(n, e)
    g = G.hub_suppressed(deg.withColumn("score", F.sqrt("degree")), "score").select("canonical_id", F.col("suppressed").alias("graph"), F.col("in_degree").alias("inbound"))
    con = G.local_connectivity(n, e.withColumn("confidence", F.lit("low")), _semantic(n))
    hops = G.anchor_hops(n, e, _anchors(n))
    y = F.when(F.col("year").between(1900, AS_OF), F.col("year"))
    x = n.withColumn("year", y).join(g, "canonical_id").join(con, "canonical_id").join(hops, "canonical_id")
    return x.withColumns({"semantic": S.vocabulary_coherence(F.lit(QUERY)), "lexical": S.lexical_similarity(F.lit(QUERY))})


def _scored(spark, d) -> DataFrame:
    x = _features(spark, d)
    year = F.col("year")
    base = S.canonicality(F.lit(QUERY), F.col("inbound"), F.col("canonical_id").startswith("arxiv:"), F.lit(False))
    canon = S.query_canonicality(base, F.col("hops"), F.col("semantic"), F.col("semantic"), year, F.col("inbound"), S.recency_penalty(year, AS_OF), AS_OF)
    x = x.withColumns({"canonical": canon, "recency": S.recency_alignment(year, AS_OF)})
    x = x.withColumn("fused", S.fused(F.col("semantic"), F.col("graph"), F.col("canonical"), F.col("recency"), F.lit("technical_method")))
    dom = S.domain_multiplier(F.col("domain"), F.array(F.lit("cs")))
    return x.withColumns({
        "controlled": S.controlled(F.col("fused"), F.col("connectivity"), S.drift_penalty(F.col("hops")), dom),
        "coherence": S.coherence(F.col("semantic"), F.col("lexical"), F.col("semantic"), F.lit(0.5), S.anchor_consistency(F.col("hops")), S.era_coherence(year, AS_OF), dom),
        "verified": S.verified(F.col("semantic"), F.col("graph"), F.col("connectivity"), S.drift_penalty(F.col("hops"))),
    })


def fused_score(spark, d):
    cols = ("semantic", "graph", "canonical", "recency", "fused", "controlled", "coherence", "verified")
    return _scored(spark, d).select("canonical_id", *[F.round(c, 6).alias(c) for c in cols])


def diversity_rerank(spark, d):
    x = _scored(spark, d).select("canonical_id", "title", F.round("controlled", 6).alias("relevance"))
    return R.diversity(x, "relevance").select("canonical_id", "topic", "repeat", F.round("diverse", 6).alias("diverse"), "diverse_rank")


def top10_floor(spark, d):
    x = _scored(spark, d).select("canonical_id", "semantic", F.round("controlled", 6).alias("relevance"))
    return R.top_floor(x, "relevance", "semantic", 10, 0.5, 0.35).select("canonical_id", F.round("relevance", 6).alias("relevance"), "floored")


def rank_lock(spark, d):
    x = _scored(spark, d)
    key = S.fused(F.col("semantic"), F.col("graph"), F.col("canonical"), F.col("recency"), F.lit("hardware_system"))
    x = x.select("canonical_id", F.round("controlled", 6).alias("relevance"), F.round(key, 6).alias("key"))
    return R.rank_lock(x, "relevance", "key").select("canonical_id", F.round("relevance", 6).alias("relevance"), "locked")


def query_chunks(spark, d):
    x = _scored(spark, d).select("canonical_id", F.round("controlled", 6).alias("relevance"))
    return R.chunks(x, "relevance")


def duplicate_titles_ratio(spark, d):
    """Title similarity of records that share an identifier."""
    n = _nodes(spark, d)
    keys = n.select("canonical_id", "title", F.explode(F.array_distinct(F.array_compact(F.array(*[bare_id(F.col(c)) for c in G.ID_COLUMNS])))).alias("key")).filter(F.length("key") > 4)
    p = keys.select("key", F.col("canonical_id").alias("a"), F.col("title").alias("ta")).join(keys.select("key", F.col("canonical_id").alias("b"), F.col("title").alias("tb")), "key").filter("a < b").select("a", "b", "ta", "tb").distinct()
    return p.select("a", "b", F.round(R.title_ratio("ta", "tb"), 4).alias("ratio"))


def title_jaccard(spark, d):
    """Token overlap of the titles of records that share an identifier."""
    n = _nodes(spark, d)
    w = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("title", F.lit(""))), "[^a-z0-9]+"), lambda t: t != ""))
    keys = n.select("canonical_id", w.alias("w"), F.explode(F.array_distinct(F.array_compact(F.array(*[bare_id(F.col(c)) for c in G.ID_COLUMNS])))).alias("key")).filter(F.length("key") > 4)
    p = keys.select("key", F.col("canonical_id").alias("a"), F.col("w").alias("wa")).join(keys.select("key", F.col("canonical_id").alias("b"), F.col("w").alias("wb")), "key").filter("a < b").select("a", "b", "wa", "wb").distinct()
    u = F.size(F.array_union("wa", "wb"))
    return p.select("a", "b", F.round(F.when(u == 0, 0.0).otherwise(F.size(F.array_intersect("wa", "wb")) / u), 6).alias("jaccard"))


QUERIES = {f.__name__: f for f in (
    resolve_references, edge_context, graph_degrees, cocitation_pairs, coupling_pairs, cocitation_pairs_all, coupling_pairs_all, strong_coupling_edges, relation_expand_scores, missing_links, foundational_refs_3plus,
    refs_not_in_graph, second_hop_seeds, broaden_pool, second_hop_seeds_full, broaden_pool_full, edge_confidence_histogram, edge_quality, local_connectivity, hub_suppressed, anchor_hops, pagerank, reading_paths,
    recommend_topk, trend_grouping_sets, domain_distribution, source_summary, identifier_keys, recency_columns, vocabulary_coherence, phrase_overlap, venue_domains,
    title_query_domains, fused_score, diversity_rerank, top10_floor, rank_lock, query_chunks, duplicate_titles_ratio, title_jaccard,
)}

# --- SQL -----------------------------------------------------------------------------------------------------

_KEYS = " union ".join(f"select canonical_id, pos, {bare_id_sql(c)} as key from n" for c in G.ID_COLUMNS)
_N = """n as (select * exclude (rn) from (select *, row_number() over (partition by canonical_id order by pos nulls last) as rn from papers where canonical_id is not null) where rn = 1)"""
_A = f"""{_N},
keys as (select * from ({_KEYS}) where key is not null),
a as (select key, canonical_id as dst from (select *, row_number() over (partition by key order by pos nulls last, canonical_id) as rn from keys) where rn = 1)"""
_C = f"""{_A},
refs as (select src, i - 1 as ref_pos, ref, {bare_id_sql('ref')} as key from (select canonical_id as src, unnest("references") as ref, generate_subscripts("references", 1) as i from n) where ref is not null),
c as (select src, ref_pos::int as ref_pos, ref, coalesce(x.canonical_id, a.dst) as dst from refs left join n x on x.canonical_id = ref left join a on a.key = refs.key where coalesce(x.canonical_id, a.dst) is not null),
e as (select distinct src, dst from c),
anchors as (select canonical_id as anchor from n where starts_with(canonical_id, 'arxiv:'))"""
_D = f"""{_C},
ends as (select src as canonical_id, 1 as o, 0 as i from c union all select dst, 0, 1 from c),
deg as (select n.canonical_id, coalesce(sum(i), 0)::bigint as in_degree, coalesce(sum(o), 0)::bigint as out_degree, coalesce(sum(i) + sum(o), 0)::bigint as degree from n left join ends using (canonical_id) group by 1)"""
_DRAWN = f"""{_A},
g as (select query_id, source_paper_id as src, a.dst, confidence, context from edges join a on a.key = {bare_id_sql('target_paper_id')} where source_paper_id in (select canonical_id from n))"""
_STOP = "[" + ", ".join(f"'{w}'" for w in S.STOPWORDS) + "]"
_QT = f"list_distinct(list_filter(regexp_split_to_array(lower('{QUERY}'), '[^a-z0-9_]+'), lambda t: length(t) >= 3 and not list_contains({_STOP}, t)))"
_BLOB = "lower(concat(coalesce(title, ''), ' ', substring(coalesce(abstract, ''), 1, 3200)))"
_SHARE = f"round(len(list_filter({_QT}, lambda t: contains({{0}}, t))) / len({_QT}), 15)"
_VOC = f"case when trim({_BLOB}) <> '' then {_SHARE.format(_BLOB)} else 0.45 end"
_LEX = f"case when trim(coalesce(title, '')) <> '' then {_SHARE.format("lower(title)")} else 0.0 end"
_Y = f"(case when year between 1900 and {AS_OF} then year end)"
_HUB = f"""{_D},
raw as (select *, sqrt(degree) / greatest(ln(1 + greatest(degree, 1)), 1e-6) as r from deg),
hub as (select canonical_id, degree, in_degree, case when max(r) over () <= min(r) over () then 0.5 else (r - min(r) over ()) / (max(r) over () - min(r) over ()) end as suppressed from raw)"""
_CONN = """{from_},
sem as (select canonical_id, {voc} as score from n),
und as (select src, dst, w from {edges} union all select dst, src, w from {edges}),
con as (select und.src as canonical_id, sum(w * coalesce(score, 0)) / sum(w) as x from und left join sem on sem.canonical_id = und.dst group by 1),
connectivity as (select n.canonical_id, coalesce(x, 0.45) as connectivity from n left join con using (canonical_id))"""
_W = "case lower(trim(confidence)) when 'high' then 1.0 when 'medium' then 0.65 when 'low' then 0.35 else 0.5 end::double"
_HOPS = f"""{_C},
sides as (select src as u, dst as v from e union select dst, src from e),
walk(v, hop) as (select anchor, 0 from anchors union select sides.v, hop + 1 from walk join sides on sides.u = walk.v where hop < 12),
hops as (select n.canonical_id, coalesce(min(hop), 99)::int as hops from n left join walk on walk.v = n.canonical_id group by 1)"""
_ALIGN = f"case when {_Y} is null then 0.55 when {AS_OF} - year <= 2 then 1.0 when {AS_OF} - year <= 5 then 0.82 when {AS_OF} - year <= 10 then 0.58 when {AS_OF} - year <= 18 then 0.35 else 0.18 end::double"
_PEN = f"case when {_Y} is null then 0.04 when {AS_OF} - year <= 4 then 0.0 when {AS_OF} - year <= 10 then 0.06 when {AS_OF} - year <= 18 then 0.10 else 0.14 end::double"
_ERA = f"case when {_Y} is null then 0.55 when year >= 2018 then 1.0 when {AS_OF} - year <= 25 then 0.72 when {AS_OF} - year <= 35 then 0.5 else 0.35 end::double"
_CANON_WORDS = "list_filter(regexp_split_to_array(lower('" + QUERY + "'), '\\s+'), lambda t: length(t) > 2)"
_CL = "greatest(0.0, least(1.0, {0}))"
_SCORED = f"""{_HUB},
ce as (select src, dst, 0.35::double as w from c),
{_CONN.format(from_="one as (select 1)", voc=_VOC, edges="ce")},
{_HOPS.split("anchors as (select canonical_id as anchor from n where starts_with(canonical_id, 'arxiv:')),", 1)[1]},
f as (select n.canonical_id, n.title, n.year, n.domain, hub.suppressed as graph, hub.in_degree as inbound, connectivity, hops, {_VOC} as semantic, {_LEX} as lexical
  from n join hub using (canonical_id) join connectivity using (canonical_id) join hops using (canonical_id)),
b as (select *, {_ALIGN} as recency, {_PEN} as pen, {_ERA} as era,
  {_CL.format(f"(case when contains(lower(trim(coalesce(title, ''))), '{QUERY}') then 0.6 else 0.45 * len(list_filter({_CANON_WORDS}, lambda t: contains(lower(trim(coalesce(title, ''))), t))) / len({_CANON_WORDS}) end + least(inbound / 100.0, 0.3) + case when starts_with(canonical_id, 'arxiv:') then 0.2 else 0.0 end)::double")} as base,
  case when hops >= 98 then 0.0 when hops <= 1 then 1.0 when hops = 2 then 0.75 when hops = 3 then 0.45 else 0.1 end::double as bonus,
  case when hops >= 98 then 0.25 when hops <= 1 then 1.0 when hops = 2 then 0.82 when hops = 3 then 0.62 when hops <= 5 then 0.45 else 0.28 end::double as anchor_c,
  case when hops >= 98 then 0.0 else least(hops, 10) / 10.0 end::double as drift,
  case when trim(coalesce(domain, '')) = '' then 0.82 when lower(trim(domain)) = 'cs' then 1.0 else 0.58 end::double as dom from f),
k as (select *, {_CL.format(f"(0.32 * base + 0.28 * bonus + 0.22 * semantic + 0.18 * semantic - pen) * case when inbound > 500 and coalesce({AS_OF} - {_Y}, 12) > 10 then 0.85 else 1.0 end + case when {_Y} is not null and {AS_OF} - year <= 7 and semantic >= 0.6 then 0.10 else 0.0 end")}::double as canonical from b),
s0 as (select *, 0.45 * {_CL.format('semantic')} + 0.35 * {_CL.format('recency')} + 0.20 * {_CL.format('graph')} as fused from k),
s as (select canonical_id, title, semantic, graph, canonical, recency, fused, greatest(0.0, (fused + 0.09 * connectivity - 0.12 * drift) * dom) as controlled,
  {_CL.format("0.28 * semantic + 0.22 * lexical + 0.14 * semantic + 0.12 * 0.5 + 0.10 * anchor_c + 0.08 * era + 0.06 * least(1.0, dom)")} as coherence,
  greatest(0.0, 0.45 * semantic + 0.32 * graph + 0.15 * connectivity - 0.12 * drift) as verified from s0)"""
_PAIRS = f"""{_A},
p as (select distinct x.canonical_id as a, y.canonical_id as b from keys x join keys y on x.key = y.key and x.canonical_id < y.canonical_id where length(x.key) > 4)"""
_VD = "case " + " ".join(f"when contains(lower(trim(venue)), '{k}') then '{v}'" for k, v in S.VENUE_DOMAINS) + " end"
_QD = "[" + ", ".join(f"case when contains(lower(title), '{k}') then '{v}' end" for k, v in S.QUERY_DOMAINS) + "]"
_TOPIC_STOP = "[" + ", ".join(f"'{w}'" for w in R.TOPIC_STOP) + "]"
_KEPT = f"list_slice(list_filter(regexp_extract_all(lower(title), '[a-z][a-z0-9\\-]{{{{3,}}}}'), lambda t: not list_contains({_TOPIC_STOP}, t)), 1, 3)".replace("{{", "{").replace("}}", "}")
_JT = "list_distinct(list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^a-z0-9]+'), lambda t: t <> ''))"
_PHRASE = "case when title is null then 0.0 when contains(lower(title), '{q}') then 1.0 ".format(q=QUERY) + " ".join(
    "when " + " or ".join(f"contains(lower(title), '{' '.join(QUERY.split()[i:i + k])}')" for i in range(len(QUERY.split()) - k + 1) if len(" ".join(QUERY.split()[i : i + k])) > 6) + f" then least(1.0, {0.55 + 0.12 * k})"
    for k in range(len(QUERY.split()), 1, -1)
) + " else 0.0 end"

SQL = {
    "resolve_references": f"with {_C} select src, ref_pos, ref, dst from c",
    "edge_context": f"""with {_C}, w as (select c.src, c.ref_pos, c.dst, lower(s.abstract) as ab, nullif(lower(split_part(t.title, ' ', 1)), '') as wd from c join n s on s.canonical_id = src join n t on t.canonical_id = dst)
select src, ref_pos, dst, if(coalesce(contains(ab, wd), false), 'abstract_proxy', 'unresolved_context') as context_source, if(coalesce(contains(ab, wd), false), 'medium', 'low') as confidence from w""",
    "graph_degrees": f"with {_D} select canonical_id, in_degree, out_degree, degree from deg",
    "cocitation_pairs": f"with {_C} select x.dst as a, y.dst as b, count(*) as shared from e x join e y on x.src = y.src and x.dst < y.dst group by 1, 2 having count(*) >= 3",
    "coupling_pairs": f"with {_C} select x.src as a, y.src as b, count(*) as shared from e x join e y on x.dst = y.dst and x.src < y.src group by 1, 2 having count(*) >= 3",
    "cocitation_pairs_all": f"with {_C} select x.dst as a, y.dst as b, count(*) as shared from e x join e y on x.src = y.src and x.dst < y.dst group by 1, 2",
    "coupling_pairs_all": f"with {_C} select x.src as a, y.src as b, count(*) as shared from e x join e y on x.dst = y.dst and x.src < y.src group by 1, 2",
    "strong_coupling_edges": f"""with {_C}, rr as (select distinct src, key from refs where key is not null)
select x.src as a, y.src as b, count(*) as shared from rr x join rr y on x.key = y.key and x.src < y.src
where not exists (select 1 from e where (e.src = x.src and e.dst = y.src) or (e.src = y.src and e.dst = x.src)) group by 1, 2 having count(*) >= 3""",
    "relation_expand_scores": f"""with {_D},
both_ as (select src as c, dst as anchor from e union select dst, src from e),
direct as (select c, 2.0 / sqrt(greatest(x.degree, 1) * greatest(y.degree, 1)) as s, 1 as hit, 0 as cpl, 0 as coc from both_ join anchors using (anchor) join deg x on x.canonical_id = c join deg y on y.canonical_id = anchor),
outs as (select src, count(*) as k from e group by 1), ins as (select dst, count(*) as k from e group by 1),
cp as (select y.src as c, x.src as anchor, count(*) as x from e x join anchors on x.src = anchor join e y on x.dst = y.dst and x.src <> y.src group by 1, 2),
cc as (select y.dst as c, x.dst as anchor, count(*) as x from e x join anchors on x.dst = anchor join e y on x.src = y.src and x.dst <> y.dst group by 1, 2),
parts as (select * from direct union all select c, 0.6 * x / sqrt(o1.k * o2.k), 0, x, 0 from cp join outs o1 on o1.src = c join outs o2 on o2.src = anchor
  union all select c, 0.8 * x / sqrt(i1.k * i2.k), 0, 0, x from cc join ins i1 on i1.dst = c join ins i2 on i2.dst = anchor),
s as (select c as canonical_id, sum(s) as score, sum(hit)::bigint as direct_hits, max(cpl)::bigint as max_coupling, max(coc)::bigint as max_cocitation from parts where c not in (select anchor from anchors) group by 1)
select canonical_id, round(score, 6) as score, direct_hits, max_coupling, max_cocitation, case when max_cocitation >= 2 then 'cocitation' when max_coupling >= 2 then 'coupling' when direct_hits > 0 then 'direct' else 'reference_pool' end as reason from s where score > 1e-9""",
    "missing_links": f"with {_C} select dst as canonical_id, count(*) as citing_anchors from e where src in (select anchor from anchors) and dst not in (select anchor from anchors) group by 1",
    "foundational_refs_3plus": f"with {_C} select dst as canonical_id, count(*) as citing_anchors from e where src in (select anchor from anchors) and dst not in (select anchor from anchors) group by 1 having count(*) >= 3",
    "refs_not_in_graph": f"with {_C} select key, count(distinct src) as citing from refs where key is not null and key not in (select key from a) group by 1",
    "second_hop_seeds": f"""with {_C}, x as (select src, dst, min(ref_pos) as ref_pos from c where src in (select anchor from anchors) and dst not in (select anchor from anchors) group by 1, 2)
select src as parent, dst as canonical_id, rank::int as rank from (select *, row_number() over (partition by src order by ref_pos, dst) as rank from x) where rank <= 5""",
    "broaden_pool": f"""with {_C}, x as (select src, dst, min(ref_pos) as ref_pos from c group by 1, 2),
r as (select dst as id, 0 as o from (select *, row_number() over (partition by src order by ref_pos, dst) as k from x where src in (select anchor from anchors)) where k <= 5),
t as (select src as id, 1 as o from (select *, row_number() over (partition by dst order by src) as k from x where dst in (select anchor from anchors)) where k <= 5)
select id as canonical_id, if(min(o) = 0, 'reference', 'citer') as origin from (select * from r union all select * from t) where id not in (select anchor from anchors) group by 1""",
    "second_hop_seeds_full": f"""with {_C}, x as (select src, dst, min(ref_pos) as ref_pos from c where src in (select anchor from anchors) and dst not in (select anchor from anchors) group by 1, 2)
select src as parent, dst as canonical_id, rank::int as rank from (select *, row_number() over (partition by src order by ref_pos, dst) as rank from x) where rank <= 30""",
    "broaden_pool_full": f"""with {_C}, x as (select src, dst, min(ref_pos) as ref_pos from c group by 1, 2),
r as (select dst as id, 0 as o from (select *, row_number() over (partition by src order by ref_pos, dst) as k from x where src in (select anchor from anchors)) where k <= 35),
t as (select src as id, 1 as o from (select *, row_number() over (partition by dst order by src) as k from x where dst in (select anchor from anchors)) where k <= 25)
select id as canonical_id, if(min(o) = 0, 'reference', 'citer') as origin from (select * from r union all select * from t) where id not in (select anchor from anchors) group by 1""",
    "edge_confidence_histogram": """with x as (select case when lower(trim(confidence)) in ('high', 'medium', 'low') then lower(trim(confidence)) else 'other' end as confidence from edges)
select k.confidence, count(x.confidence) as edges from (select unnest(['high', 'medium', 'low', 'other']) as confidence) k left join x using (confidence) group by 1""",
    "edge_quality": f"""with {_DRAWN}, v as (select src, dst, least(1.0, case lower(trim(confidence)) when 'high' then 1.0 when 'medium' then 0.62 when 'low' then 0.28 else 0.45 end + if(length(trim(context)) > 12, 0.15, 0.0))::double as v from g),
m as (select id, avg(v) as raw from (select src as id, v from v union all select dst, v from v) group by 1),
r as (select n.canonical_id, coalesce(raw, 0.18)::double as raw from n left join m on m.id = n.canonical_id)
select canonical_id, round(raw, 6) as raw, round(case when max(raw) over () <= min(raw) over () then 0.5 else (raw - min(raw) over ()) / (max(raw) over () - min(raw) over ()) end, 6) as edge_quality from r""",
    "local_connectivity": "with " + _CONN.format(from_=_DRAWN + f", gw as (select src, dst, {_W} as w from g)", voc=_VOC, edges="gw") + " select canonical_id, round(connectivity, 6) as connectivity from connectivity",
    "hub_suppressed": f"with {_HUB} select canonical_id, degree, round(suppressed, 6) as suppressed from hub",
    "anchor_hops": f"with recursive {_HOPS} select * from hops",
    "recommend_topk": f"""with {_D}, x as (select n.canonical_id, n.title, case when {_Y} is null then 0.7 else 1.0 / (1.0 + ({AS_OF} - year) / case lower(domain) when 'cs' then 1.0 when 'biomedical' then 2.0 when 'social_sciences' then 5.0 when 'physics' then 2.0 else 3.0 end) end as rec, degree, n.pos,
  if(coalesce(abstract, '') <> '', 0.25, 0.0) + if(coalesce(doi, arxiv_id, openalex_id, '') <> '', 0.15, 0.0) as meta from n join deg using (canonical_id))
select canonical_id, title, round(sqrt(degree) * rec + 0.2 * rec + meta, 3) as score from x order by 3 desc, pos nulls last, canonical_id limit 10""",
    "trend_grouping_sets": f"with {_N}, x as (select coalesce(year::varchar, 'unknown') as year, coalesce(domain, 'unknown') as domain from n) select year, domain, count(*) as papers, grouping(year, domain) as which from x group by grouping sets ((year), (domain))",
    "domain_distribution": f"with {_N} select domain, count(*) as papers from n where domain is not null group by 1",
    "source_summary": f"with {_N} select lower(trim(provenance[1].source)) as source, count(*) as papers from n group by 1",
    "identifier_keys": f"with {_A} select key, dst from a",
    "recency_columns": f"""with {_N} select canonical_id, {_ALIGN} as alignment, {_PEN} as penalty, {_ERA} as era, round(case when {_Y} is null then 0.7 else 1.0 / (1.0 + ({AS_OF} - year) / case lower(domain) when 'cs' then 1.0 when 'biomedical' then 2.0 when 'social_sciences' then 5.0 when 'physics' then 2.0 else 3.0 end) end, 6)::double as decay from n""",
    "vocabulary_coherence": f"with {_N} select canonical_id, round({_VOC}, 6)::double as vocabulary, round({_LEX}, 6)::double as lexical from n",
    "phrase_overlap": f"with {_N} select canonical_id, round({_PHRASE}, 6)::double as overlap from n",
    "venue_domains": f"with {_N} select {_VD} as domain, count(*) as papers from n group by 1",
    "title_query_domains": f"""with {_N}, x as (select canonical_id, list_distinct(list_filter({_QD}, lambda t: t is not null)) as ds from n)
select canonical_id, unnest(ds) as domain from x where len(ds) > 0 union all select canonical_id, null from x where coalesce(len(ds), 0) = 0""",
    "fused_score": f"with recursive {_SCORED} select canonical_id, round(semantic, 6)::double as semantic, round(graph, 6) as graph, round(canonical, 6) as canonical, round(recency, 6) as recency, round(fused, 6) as fused, round(controlled, 6) as controlled, round(coherence, 6) as coherence, round(verified, 6) as verified from s",
    "diversity_rerank": f"""with recursive {_SCORED}, t as (select canonical_id, round(controlled, 6) as rel, case when coalesce(title, '') = '' then 'unknown' when len({_KEPT}) = 0 then 'general' else array_to_string(list_sort(list_distinct({_KEPT})), '|') end as topic from s),
r as (select *, row_number() over (partition by topic order by rel desc, canonical_id) - 1 as repeat from t),
v as (select *, rel * (1 - least(0.45, repeat * 0.12)) as dv from r)
select canonical_id, topic, repeat::int as repeat, round(dv, 6) as diverse, row_number() over (order by round(dv, 6) desc, canonical_id)::int as diverse_rank from v""",
    "top10_floor": f"""with recursive {_SCORED}, r as (select canonical_id, semantic, round(controlled, 6) as rel, row_number() over (order by round(controlled, 6) desc, canonical_id) as k from s)
select canonical_id, round(if(k <= 10 and semantic < 0.5, rel * 0.35, rel), 6) as relevance, k <= 10 and semantic < 0.5 as floored from r""",
    "rank_lock": f"""with recursive {_SCORED}, r as (select canonical_id, round(controlled, 6) as rel, row_number() over (order by round(controlled, 6) desc, canonical_id) as i, row_number() over (order by round(0.45 * semantic + 0.35 * recency + 0.20 * graph, 6) desc, canonical_id) as j from s)
select canonical_id, round(if(i <= 12 and i < j - 2, rel * 0.88, rel), 6) as relevance, i <= 12 and i < j - 2 as locked from r""",
    "query_chunks": f"""with recursive {_SCORED}, r as (select canonical_id, row_number() over (order by round(controlled, 6) desc, canonical_id) as rn, count(*) over () as n from s),
g as (select *, least(4, greatest(1, (n + 5) // 7)) as g from r)
select canonical_id, rn::int as rank, least(floor((rn - 1) / ceil(n / g)), g - 1)::int as chunk from g""",
    "title_jaccard": f"""with {_PAIRS}, w as (select p.a, p.b, {_JT.format('x.title')} as wa, {_JT.format('y.title')} as wb from p join n x on x.canonical_id = p.a join n y on y.canonical_id = p.b)
select a, b, round(case when len(list_distinct(wa || wb)) = 0 then 0.0 else len(list_intersect(wa, wb)) / len(list_distinct(wa || wb)) end, 6)::double as jaccard from w""",
    "pagerank": f"""with recursive {_DRAWN},
x as (select query_id, src, dst from g where query_id is not null),
nd as (select distinct query_id, node from (select query_id, src as node from x union all select query_id, dst from x)),
od as (select query_id, src as node, count(*) as o from x group by 1, 2),
b as (select nd.query_id, nd.node, od.o, count(*) over (partition by nd.query_id) as n from nd left join od using (query_id, node)),
pr(k, query_id, node, o, n, rank) as (select 0, query_id, node, o, n, 1.0::double / n from b
  union all select p.k + 1, p.query_id, p.node, p.o, p.n, 0.15 / p.n + 0.85 * (coalesce(s.got, 0) + sum(if(p.o is null, p.rank, 0)) over (partition by p.query_id) / p.n) from pr p
  left join (select x.query_id, x.dst, sum(q.rank / q.o) as got from x join pr q on q.query_id = x.query_id and q.node = x.src group by 1, 2) s on s.query_id = p.query_id and s.dst = p.node where p.k < 28)
select query_id, node, round(rank, 8) as rank from pr where k = 28""",
    "reading_paths": f"""with recursive {_C},
ys as (select canonical_id, year from n where year between 1900 and 2100),
nx as (select e.dst as at, e.src as nxt, year as ny from e join ys on ys.canonical_id = e.src where e.src <> e.dst),
walk(seed, step, id, year, path) as (select anchor, 1, anchor, year, [anchor] from anchors join ys on ys.canonical_id = anchor
  union all select seed, step + 1, nxt, ny, list_append(path, nxt) from (select walk.*, nxt, ny, row_number() over (partition by seed order by ny, nxt) as rn from walk join nx on nx.at = walk.id where ny >= walk.year and not list_contains(path, nxt) and step < 5) where rn = 1)
select seed, step::int as step, id as canonical_id from walk""",
}
