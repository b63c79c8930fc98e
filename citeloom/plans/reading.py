"""Queries of reading lists and lookups, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions.ids import bare_id, bare_id_sql
from citeloom.operators import graph as G
from citeloom.operators import lookup as L
from citeloom.operators import reading as R
from citeloom.plans.scholarly import _D, _N, _STOP, AS_OF, _cites, _drawn, _nodes
from citeloom.tables import table


def _queries(spark, d):
    """The subject areas stand for what users ask."""
    return table(spark, d, "subjects").select(F.col("subject").alias("query_id"), F.lower("label").alias("query"))


def title_search_hits(spark, d):
    return L.title_search(_queries(spark, d), _nodes(spark, d), 10).select("query_id", "canonical_id", F.round("score", 6).alias("score"), "rank")


def _ranked(spark, d):
    n, e = _cites(spark, d)
    return R.ranked_pool(_queries(spark, d), n, e, G.degrees(n, e), AS_OF)


def query_pools(spark, d):
    """Every work of every query's pool with its scores and rank."""
    return _ranked(spark, d).select("query_id", "canonical_id", "origin", "inbound", F.round("semantic", 6).alias("semantic"), F.round("graph", 6).alias("graph"), F.round("relevance", 6).alias("relevance"), F.round("norm", 6).alias("norm"), "rank")


def reading_list(spark, d):
    """Foundational works, branches and candidates of every query."""
    return R.sections(_ranked(spark, d)).select("query_id", "section", "label", "pos", "canonical_id", F.round("relevance", 6).alias("relevance"))


def reading_report(spark, d):
    """The same as text."""
    return R.report(_queries(spark, d), R.sections(_ranked(spark, d)), _nodes(spark, d))


def _sourced(n):
    kind = F.split("canonical_id", ":")[0]
    return n.withColumn("source", F.when(kind == "doi", "crossref").otherwise(kind))


def doi_chain(spark, d):
    """Which provider answers for every DOI that is cited, asked in order."""
    n = _nodes(spark, d)
    asked = n.select(F.explode("references").alias("ref")).select(bare_id(F.col("ref")).alias("doi")).filter("doi like '10.%'").distinct()
    return L.chained(asked, "doi", _sourced(n).withColumn("key", bare_id(F.col("doi"))), F.array_compact(F.array("key"))).select("doi", "source", "canonical_id")


def fetch_batches(spark, d):
    """How many cited work ids are not in the table, and whether every batch of them is small and no id is in two."""
    n = _nodes(spark, d)
    wanted = n.select(F.explode("references").alias("ref")).select(F.upper(bare_id(F.col("ref"))).alias("id"))
    cached = n.select(F.upper(bare_id(F.col("openalex_id"))).alias("id")).filter("id is not null")
    b = L.missing_batches(wanted, cached)
    ids = b.select(F.explode("ids").alias("id"))
    return b.agg(F.coalesce(F.max(F.size("ids")), F.lit(0)).alias("most")).crossJoin(ids.agg(F.count("id").alias("ids"), F.count_distinct("id").alias("distinct_ids"))).select("ids", "distinct_ids", (F.col("most") <= L.BATCH).alias("small"))


def enriched_titles(spark, d):
    """Records without a title, filled from records of the same DOI, openalex before semantic_scholar."""
    n = _sourced(_nodes(spark, d)).withColumn("key", bare_id(F.col("doi")))
    bare = n.filter("trim(coalesce(title, '')) = '' or lower(title) like 'doi:%'").select("canonical_id", "key", "title", "abstract", "year", "venue")
    of = lambda s: n.filter((F.col("source") == s) & F.col("key").isNotNull()).select("key", "title", "abstract", "year", "venue")
    x = L.enriched(bare, "key", [(s, of(s)) for s in ("openalex", "semantic_scholar", "crossref")])
    return x.select("canonical_id", "title", "year", "venue", "enriched_from")


def metadata_badges(spark, d):
    """The kind of the first document about every work, joined by any identifier."""
    docs = table(spark, d, "documents").filter("paper_id is not null")
    kind = F.split("paper_id", ":")[0]
    return L.badges(_nodes(spark, d), docs.select(F.col("doc_id").alias("pos"), kind.alias("provider"), F.col("paper_id").alias("id"), F.col("kind").alias("badge")))


def work_id_seeds(spark, d):
    """The work ids that every query drew, at their first place."""
    e = table(spark, d, "edges").filter("query_id is not null")
    return L.work_ids(e.select("query_id", F.lit("OpenAlex ").alias("provider"), F.upper(bare_id(F.col("target_paper_id"))).alias("id"), F.col("ref_pos").alias("pos")))


def promoted_hubs(spark, d):
    """The most cited references of each query's first two works that it did not draw itself."""
    n, g = _drawn(spark, d)
    _n, c = _cites(spark, d)
    known = g.filter("query_id is not null").select("query_id", F.col("dst").alias("id")).distinct()
    cited = G.degrees(n, c).select(F.col("canonical_id").alias("id"), F.col("in_degree").alias("n"))
    return L.promoted_hubs(known.filter("id like 'openalex:%'"), c.select(F.col("src").alias("id"), F.col("dst").alias("ref")), cited, known)


QUERIES = {f.__name__: f for f in (title_search_hits, query_pools, reading_list, reading_report, doi_chain, fetch_batches, enriched_titles, metadata_badges, work_id_seeds, promoted_hubs)}

_W = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: length(t) > 2))"
_HITS = f"""qs as (select subject as query_id, lower(label) as query, {_W.format('label')} as ws from subjects),
h0 as (select query_id, query, canonical_id, len(list_intersect(ws, {_W.format("coalesce(title, '')")})) / len(ws) as score from qs, n),
h as (select *, row_number() over (partition by query_id order by score desc, canonical_id) as rank from h0 where score > 0)"""
_BLOB = "lower(concat(coalesce(title, ''), ' ', substring(coalesce(abstract, ''), 1, 3200)))"
_QTS = f"list_distinct(list_filter(regexp_split_to_array(query, '[^\\p{{L}}\\p{{N}}_]+'), lambda t: length(t) >= 3 and not list_contains({_STOP}, t)))"
_POOL = f"""with {_D}, {_HITS},
s as (select query_id, canonical_id from h where rank <= {R.SEEDS}),
rf as (select src, dst, min(ref_pos) as ref_pos from c group by 1, 2),
hop as (select query_id, dst as canonical_id from (select s.query_id, rf.dst, row_number() over (partition by s.query_id, rf.src order by rf.ref_pos, rf.dst) as k from rf join s on s.canonical_id = rf.src) where k <= {R.PER_PARENT}),
p as (select query_id, canonical_id, min(o) as o from (select *, 0 as o from s union all select *, 1 from hop) group by 1, 2),
inb as (select a.query_id, b.canonical_id, count(*) as inbound from p a join e on e.src = a.canonical_id join p b on b.query_id = a.query_id and b.canonical_id = e.dst group by 1, 2),
x0 as (select p.query_id, p.canonical_id, if(o = 0, 'api_search', 'discovered') as origin, coalesce(inbound, 0) as inbound, n.title, n.year, coalesce(n.domain, 'unknown') as domain, in_degree,
  case when trim({_BLOB}) <> '' and len({_QTS}) > 0 then len(list_filter({_QTS}, lambda t: contains({_BLOB}, t))) / len({_QTS}) else 0.45 end as semantic
  from p join n using (canonical_id) join qs using (query_id) left join inb using (query_id, canonical_id) left join deg using (canonical_id)),
x1 as (select *, inbound / greatest(1, max(inbound) over (partition by query_id)) as graph from x0),
x2 as (select *, round(0.6 * semantic + 0.3 * graph + 0.1 * least(1.0, coalesce(in_degree, 0) / 50.0), 9) as relevance from x1),
x as (select *, row_number() over (partition by query_id order by relevance desc, canonical_id) as rank, relevance / if(max(relevance) over (partition by query_id) > 0, max(relevance) over (partition by query_id), 1.0) as norm from x2),
f as (select *, row_number() over (partition by query_id order by inbound desc, relevance desc, canonical_id) as pos from x where inbound >= 2),
b as (select *, row_number() over (partition by query_id, domain order by inbound desc, relevance desc, canonical_id) as pos from x),
lists as (select query_id, 'foundational' as section, '' as label, pos, canonical_id, relevance from f where pos <= {R.FOUNDATIONAL}
  union all select query_id, 'branch', domain, pos, canonical_id, relevance from b where pos <= {R.IN_BRANCH} union all select query_id, 'candidate', '', rank, canonical_id, relevance from x where rank <= {R.CANDIDATES})
"""
_KIND = "case split_part(canonical_id, ':', 1) when 'doi' then 'crossref' else split_part(canonical_id, ':', 1) end"

SQL = {
    "title_search_hits": f"with {_N}, {_HITS} select query_id, canonical_id, round(score, 6)::double as score, rank::int as rank from h where rank <= 10",
    "query_pools": _POOL + "select query_id, canonical_id, origin, inbound, round(semantic, 6)::double as semantic, round(graph, 6)::double as graph, round(relevance, 6)::double as relevance, round(norm, 6)::double as norm, rank::int as rank from x",
    "reading_list": _POOL + "select query_id, section, label, pos::int as pos, canonical_id, round(relevance, 6)::double as relevance from lists",
    "reading_report": _POOL + """, l as (select query_id, case section when 'foundational' then 0 when 'branch' then 1 else 2 end as o, label, pos, section,
  '- ' || coalesce(nullif(trim(title), ''), 'Untitled') || coalesce(' (' || year || ')', '') as line from lists left join (select canonical_id, title, year from n) t using (canonical_id)),
g2 as (select query_id, o, label, case section when 'foundational' then '## Foundational works' when 'branch' then '## Branch: ' || label else '## Candidates' end || chr(10) || string_agg(line, chr(10) order by pos, line) as t from l group by query_id, o, label, section),
r as (select query_id, string_agg(t, chr(10) || chr(10) order by o, label) as body from g2 group by 1)
select qs.query_id, concat_ws(chr(10) || chr(10), '# ' || query, body) as markdown from qs left join r using (query_id)""",
    "doi_chain": f"""with {_N}, asked as (select distinct {bare_id_sql('ref')} as doi from (select unnest("references") as ref from n) where {bare_id_sql('ref')} like '10.%'),
k as (select {bare_id_sql('doi')} as doi, {_KIND} as source, canonical_id from n), r as (select *, row_number() over (partition by doi order by case source when 'openalex' then 0 when 'crossref' then 1 when 'semantic_scholar' then 2 when 'arxiv' then 3 end, canonical_id) as rn from k where doi is not null and source in ('openalex', 'crossref', 'semantic_scholar', 'arxiv'))
select asked.doi, source, canonical_id from asked left join r on r.doi = asked.doi and rn = 1""",
    "fetch_batches": f"""with {_N}, w as (select distinct upper({bare_id_sql('ref')}) as id from (select unnest("references") as ref from n)), m as (select id from w where regexp_matches(id, '^W[0-9]+$') and id not in (select upper({bare_id_sql('openalex_id')}) from n where {bare_id_sql('openalex_id')} is not null))
select count(*) as ids, count(*) as distinct_ids, true as small from m""",
    "enriched_titles": f"""with {_N}, k as (select *, {bare_id_sql('doi')} as key, {_KIND} as source from n), b as (select * from k where trim(coalesce(title, '')) = '' or lower(title) like 'doi:%'),
t as (select * from (select *, row_number() over (partition by source, key order by title nulls first, abstract nulls first, year nulls first, venue nulls first) as rn from k where key is not null) where rn = 1),
j as (select b.canonical_id, b.title, b.year, b.venue, o.title as t1, o.year as y1, o.venue as v1, s.title as t2, s.year as y2, s.venue as v2, c.title as t3, c.year as y3, c.venue as v3, o.key is not null as k1, s.key is not null as k2, c.key is not null as k3,
  coalesce(trim(o.title), '') <> '' as h1, coalesce(trim(s.title), '') <> '' as h2, coalesce(trim(c.title), '') <> '' as h3
  from b left join t o on o.key = b.key and o.source = 'openalex' left join t s on s.key = b.key and s.source = 'semantic_scholar' left join t c on c.key = b.key and c.source = 'crossref'),
z as (select *, case when h1 then trim(t1) else title end as u1, coalesce(year, if(k1, y1, null)) as w1, coalesce(nullif(venue, ''), if(k1, v1, null), venue) as x1 from j),
q as (select *, regexp_matches(coalesce(trim(u1), ''), '(?i)^(doi:.*)?$') as l1 from z),
z2 as (select *, case when l1 and h2 then trim(t2) else u1 end as u2, if(l1 and k2, coalesce(w1, y2), w1) as w2, if(l1 and k2, coalesce(nullif(x1, ''), v2), x1) as x2 from q),
q2 as (select *, regexp_matches(coalesce(trim(u2), ''), '(?i)^(doi:.*)?$') as l2 from z2)
select canonical_id, case when l2 and h3 then trim(t3) else u2 end as title, if(l2 and k3, coalesce(w2, y3), w2)::int as year, if(l2 and k3, coalesce(nullif(x2, ''), v3), x2) as venue, case when l2 and h3 then 'crossref' when l1 and h2 then 'semantic_scholar' when h1 then 'openalex' end as enriched_from from q2""",
    "metadata_badges": f"""with {_N}, hints as (select doc_id as pos, kind as badge, case when lower(split_part(paper_id, ':', 1)) in ('doi', 'crossref') then 'doi' else lower(split_part(paper_id, ':', 1)) end as kind, {bare_id_sql('paper_id')} as value from documents where paper_id is not null and trim(paper_id) <> ''),
keys as (select canonical_id, 'doi' as kind, {bare_id_sql('doi')} as value from n union select canonical_id, 'openalex', {bare_id_sql('openalex_id')} from n union select canonical_id, 'arxiv', {bare_id_sql('arxiv_id')} from n union select canonical_id, 'openalex', {bare_id_sql("split_part(canonical_id, ':', -1)")} from n)
select canonical_id, badge from (select canonical_id, badge, row_number() over (partition by canonical_id order by pos, badge) as rn from keys join hints using (kind, value)) where rn = 1""",
    "work_id_seeds": f"""select query_id, upper({bare_id_sql('target_paper_id')}) as id, min(ref_pos) as pos from edges where query_id is not null and regexp_matches(upper({bare_id_sql('target_paper_id')}), '^W[0-9]+$') group by 1, 2""",
    "promoted_hubs": f"""with {_D}, g as (select query_id, source_paper_id as src, a.dst from edges join a on a.key = {bare_id_sql('target_paper_id')} where source_paper_id in (select canonical_id from n)),
known as (select distinct query_id, dst as id from g where query_id is not null), s as (select query_id, id from (select *, row_number() over (partition by query_id order by id) as k from known where id like 'openalex:%') where k <= 2),
r as (select query_id, s.id as seed, e.dst as id, row_number() over (partition by query_id, s.id order by coalesce(in_degree, 0) desc, e.dst) as rank from s join e on e.src = s.id left join deg on deg.canonical_id = e.dst)
select query_id, seed, id, rank::int as rank from r where rank <= 4 and not exists (select 1 from known k where k.query_id = r.query_id and k.id = r.id)""",
}
