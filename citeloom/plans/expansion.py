"""Queries of expansion, filtering and statistics, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions import scores as S
from citeloom.functions.ids import bare_id_sql
from citeloom.operators import expansion as X
from citeloom.operators import graph as G
from citeloom.plans.presentation import _R, _members
from citeloom.plans.scholarly import _C, _DRAWN, _HOPS, _N, _VOC, QUERY, _anchors, _cites, _drawn, _nodes
from citeloom.tables import table


def seed_origins(spark, d):
    """Works as seeds of their sources; those that feedback calls uploads count as uploaded."""
    n = _nodes(spark, d)
    p = n.select(F.split("canonical_id", ":")[0].alias("provider"), F.regexp_replace("canonical_id", "^[^:]*:", "").alias("id"), F.when(F.col("year").isNull(), "discovered_2hop").otherwise("api_search").alias("origin"), "pos")
    f = table(spark, d, "feedback").filter("event_type = 'merge_hint'").select(F.explode(F.array(F.trim("left_id"), F.trim("right_id"))).alias("i")).filter("i like 'upload:%'")
    u = f.select(F.lit("upload").alias("provider"), F.regexp_replace("i", "^[^:]*:", "").alias("id"), F.lit("uploaded_pdf").alias("origin"), F.lit(None).cast("long").alias("pos"))
    return X.origin_map(p.unionByName(u))


def bridged_references(spark, d):
    return X.bridged_references(_nodes(spark, d)).select("canonical_id", F.size("references").alias("n_references"), F.md5(F.array_join("references", "|")).alias("references_md5"), "bridged")


def anchor_neighbourhood(spark, d):
    n, e = _cites(spark, d)
    x = G.anchor_hops(n, e, _anchors(n)).join(n.select("canonical_id", F.round(S.vocabulary_coherence(F.lit(QUERY)), 6).alias("score")), "canonical_id")
    return X.near_anchors(x, "score")


def visible_edges(spark, d):
    n, e = _drawn(spark, d)
    x = n.withColumn("score", S.vocabulary_coherence(F.lit(QUERY)))
    return X.visible(x, e, "score", 0.3, F.col("canonical_id").startswith("arxiv:"))[1].groupBy("src", "dst").agg(F.count(F.lit(1)).alias("edges"))


def strongest_edges(spark, d):
    _, e = _drawn(spark, d)
    return X.strongest_edges(e.filter("query_id is not null"), "query_id")


def branch_shared_references(spark, d):
    m, _e = _members(spark, d)
    _, e = _cites(spark, d)
    return X.shared_by_all(m, e, "query_id", "domain")


def reference_statistics(spark, d):
    return X.reference_statistics(*_cites(spark, d))


def domain_filter(spark, d):
    return X.in_domains(_nodes(spark, d), ["cs", "physics"]).select("canonical_id")


def search_titles(spark, d):
    return _nodes(spark, d).select("canonical_id", X.search_title(F.col("venue")).alias("venue_words"))


QUERIES = {f.__name__: f for f in (seed_origins, bridged_references, anchor_neighbourhood, visible_edges, strongest_edges, branch_shared_references, reference_statistics, domain_filter, search_titles)}

_ST = "trim(regexp_replace(venue, '\\s+', ' ', 'g'))"
for _p in (r"(?i)^\s*(the\s+)?(\d{1,2}(st|nd|rd|th)\s+)?(annual\s+)?(international\s+)?(conference|workshop|symposium)\s+on\s+", r"(?i)^\s*(in\s+)?proceedings\s+of\s+(the\s+)?", r"(?i)^\s*proc\.\s+", r"(?i)\s*[-–,]\s*(pages?|pp\.)\s*\d.*$", r"(?i)\s*[,;]\s*(vol\.|volume|issue)\s*.+$"):
    _ST = f"trim(regexp_replace({_ST}, '{_p}', '', 'g'))"

SQL = {
    "seed_origins": f"""with {_N}, s as (select lower(canonical_id) as key, if(year is null, 'discovered', 'api_search') as o, pos from n
union all select lower(i), 'uploaded_pdf', null from (select unnest([trim(left_id), trim(right_id)]) as i from feedback where event_type = 'merge_hint') where starts_with(i, 'upload:'))
select key, if(max((o = 'uploaded_pdf')::int) = 1, 'uploaded_pdf', first(o order by pos nulls last, o)) as origin from s group by 1""",
    "bridged_references": f"""with {_N}, ax as (select canonical_id, unnest(list_distinct([{bare_id_sql('canonical_id')}, {bare_id_sql('doi')}])) as key from n where starts_with(canonical_id, 'arxiv:')),
oa as (select "references" as r, unnest(list_distinct([{bare_id_sql('doi')}, {bare_id_sql('arxiv_id')}])) as key from n where starts_with(canonical_id, 'openalex:')),
more as (select canonical_id, unnest(r) as ref, 1 as b from ax join oa on ax.key = oa.key), mine as (select canonical_id, unnest("references") as ref, 0 as b from n where starts_with(canonical_id, 'arxiv:')),
u as (select canonical_id, {bare_id_sql('ref')} as ref, b from (select * from more union all select * from mine)),
g as (select canonical_id, list_sort(list(distinct ref) filter (where ref is not null)) as l, max(b) filter (where ref is not null) as b from u group by 1)
select n.canonical_id, coalesce(len(l), 0)::int as n_references, md5(coalesce(array_to_string(l, '|'), '')) as references_md5, coalesce(b, 0) = 1 as bridged from n left join g using (canonical_id) where starts_with(n.canonical_id, 'arxiv:')""",
    "anchor_neighbourhood": f"with recursive {_HOPS}, x as (select hops.canonical_id, hops, round(({_VOC})::double, 6) as score from hops join n on n.canonical_id = hops.canonical_id) select * from x order by hops, score desc, canonical_id limit 28",
    "visible_edges": f"""with {_DRAWN.replace('confidence, context from', 'confidence, context, context_source from')}, k as (select canonical_id from n where ({_VOC}) >= 0.3 or starts_with(canonical_id, 'arxiv:'))
select src, dst, count(*) as edges from g where src in (select * from k) and dst in (select * from k) and not coalesce(lower(trim(confidence)) = 'low' or context_source = 'abstract_proxy', false) group by 1, 2""",
    "strongest_edges": f"""with {_DRAWN}, x as (select query_id, src, dst, max(case lower(trim(confidence)) when 'high' then 3 when 'medium' then 2 when 'low' then 1 else 0 end) as c, count(*) as n from g where query_id is not null group by 1, 2, 3 having max(case lower(trim(confidence)) when 'high' then 3 when 'medium' then 2 when 'low' then 1 else 0 end) >= 2),
k as (select *, row_number() over (partition by query_id order by c desc, n desc, src, dst) as rank from x) select query_id, src, dst, rank::int as rank from k where rank <= 36""",
    "branch_shared_references": f"""with {_R}, rr as (select src, i - 1 as ref_pos, ref, {bare_id_sql('ref')} as key from (select canonical_id as src, unnest("references") as ref, generate_subscripts("references", 1) as i from n) where ref is not null),
ce as (select distinct src, coalesce(y.canonical_id, a.dst) as dst from rr left join n y on y.canonical_id = rr.ref left join a on a.key = rr.key where coalesce(y.canonical_id, a.dst) is not null),
x as (select m.query_id, m.domain, m.canonical_id, ce.dst from m join ce on ce.src = m.canonical_id), s as (select query_id, domain, count(distinct canonical_id) as n from x group by 1, 2),
c as (select query_id, domain, dst, count(distinct canonical_id) as k from x group by 1, 2, 3)
select s.query_id, s.domain, count(c.dst) as shared from s left join c on c.query_id = s.query_id and c.domain = s.domain and c.k = s.n and s.n > 1 group by 1, 2""",
    "reference_statistics": f"""with {_C}, t as (select count(*) as papers, sum(coalesce(len("references"), 0))::bigint as references_total, (select count(*) from c) as resolved from n)
select *, resolved < 5 as repair, case when resolved = 0 then 'low' when references_total >= 50 and resolved >= 30 then 'high' else 'medium' end as evidence from t""",
    "domain_filter": f"with {_N} select canonical_id from n where domain is null or trim(domain) = '' or lower(trim(domain)) in ('cs', 'physics')",
    "search_titles": f"with {_N} select canonical_id, case when length({_ST}) >= 6 then {_ST} end as venue_words from n",
}
