"""Queries of uploads, node views, branch reports and hubs, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from citeloom.functions import scores as S
from citeloom.functions.display import venue_topics
from citeloom.functions.ids import bare_id, bare_id_sql
from citeloom.operators import branches as B
from citeloom.operators import expansion as EX
from citeloom.operators import uploads as U
from citeloom.operators.ranking import TOPIC_STOP, ranked
from citeloom.plans.scholarly import _C, _N, _VOC, QUERY, _cites, _nodes
from citeloom.plans.signals import _QT, _S, _signals

#: Parts of titles that stand for strange themes.
THEMES = {"markets": "market", "schools": "school", "courts": "court"}


def _previews(spark, d):
    """Every work as if it were an upload: its id, how well it maps to the query, and its references."""
    n = _nodes(spark, d)
    return n.select("pos", F.split("canonical_id", ":")[0].alias("provider"), F.expr("substring(canonical_id, instr(canonical_id, ':') + 1)").alias("id"), "canonical_id", S.vocabulary_coherence(F.lit(QUERY)).alias("mapping_score"), (F.coalesce("year", F.lit(0)) % 5 == 0).alias("quality_override"), "references")


def upload_gate(spark, d):
    return U.gated(_previews(spark, d), 0.2).select("canonical_id", "state")


def upload_gate_statistics(spark, d):
    return U.gate_statistics(U.gated(_previews(spark, d), 0.2), 0.2)


def upload_pool(spark, d):
    """The first 200 distinct references in order of arrival."""
    return U.reference_pool(_previews(spark, d).filter("pos is not null"))


def upload_decisions(spark, d):
    """What each record's identifiers would make of it as an upload."""
    n = _nodes(spark, d)
    x = n.select("canonical_id", bare_id(F.col("arxiv_id")).alias("arxiv"), bare_id(F.col("doi")).alias("doi"), F.col("abstract").isNotNull().alias("known_arxiv"), F.col("venue").isNotNull().alias("known_doi"), bare_id(F.col("openalex_id")).alias("title_id"), (F.length("title") / 100.0).alias("title_score"), bare_id(F.col("semantic_scholar_id")).alias("stem_id"), F.lit(0.5).alias("stem_score"))
    return U.decided(x).select("canonical_id", "provider", "id", F.round("mapping_score", 6).alias("mapping_score"), "resolution")


def node_views(spark, d):
    """Origin, source and stand-ins of every work; preprints are what was uploaded, works of 2020 what a search found."""
    n = _nodes(spark, d)
    up = n.filter("canonical_id like 'arxiv:%'").select(F.lower("canonical_id").alias("key"), F.lit("uploaded_pdf").alias("origin"))
    api = n.filter("year = 2020 and canonical_id not like 'arxiv:%'").select(F.concat(F.lit("doi:"), bare_id(F.col("doi"))).alias("key"), F.lit("api_search").alias("origin")).filter("key is not null")
    return U.node_view(n, up.unionByName(api)).select("canonical_id", "seed_origin", "source_label", "uploaded", "placeholder")


def shown_works(spark, d):
    """Works of two domains and twenty years."""
    n = _nodes(spark, d)
    common = [r[0] for r in n.filter("domain is not null").groupBy("domain").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "domain").limit(2).collect()]  # two rows
    return U.shown_nodes(n, [c.replace("_", " ").title() for c in common], (2000, 2020)).select("canonical_id", "domain")


def node_styles(spark, d):
    s, _e = _signals(spark, d)
    st = U.style(F.col("inbound") >= 5, F.col("inbound") >= 3, F.col("canonical_id").startswith("arxiv:"))
    return s.select("query_id", "canonical_id", st["colour"].alias("colour"), st["size"].alias("size"))


def promoted_anchors(spark, d):
    """Queries without a hub take their two best matches for hubs."""
    s, _e = _signals(spark, d)
    return U.promoted(s.withColumn("is_hub", F.col("inbound") >= 6), "query_id", "semantic_score", "relevance_raw", 0.3).filter("is_hub").select("query_id", "canonical_id")


def blended_scores(spark, d):
    s, _e = _signals(spark, d)
    return s.select("query_id", "canonical_id", F.round(U.blended(F.col("semantic_score"), F.col("graph_score"), F.col("canonicality_score")), 6).alias("blend"))


def expand_ranks(spark, d):
    """The rank of every work that is no preprint by how often it is cited, without a task that sees them all."""
    n, e = _cites(spark, d)
    c = e.groupBy(F.col("dst").alias("canonical_id")).agg(F.count(F.lit(1)).cast("double").alias("relation"))
    x = n.filter("canonical_id not like 'arxiv:%'").select("canonical_id").join(c, "canonical_id", "left").withColumn("relation", F.coalesce("relation", F.lit(0.0)))
    return ranked(x, "relation", "expand_rank").select("canonical_id", "expand_rank")


def _members(spark, d):
    s, e = _signals(spark, d)
    low = F.lower(F.coalesce("title", F.lit("")))
    themes = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(p)), name) for name, p in THEMES.items()]))
    return B.members(s, "query_id", "domain", "inbound").withColumns({"matches": F.col("semantic_score") >= 0.4, "topical": venue_topics(low, F.lit(None).cast("string"), S.query_tokens(F.lit(QUERY))), "purity": F.col("semantic_score"), "themes": themes}), e


def purity_reports(spark, d):
    return B.purity_report(_members(spark, d)[0], "query_id", "domain")


def voted_labels(spark, d):
    return B.voted_labels(_members(spark, d)[0], "query_id", "domain", F.lit(QUERY), TOPIC_STOP)


def unexpected_connections(spark, d):
    m, e = _members(spark, d)
    x = B.unexpected_connections(m, e.filter("query_id is not null").select("query_id", "src", "dst"), "query_id", "domain")
    return x.select("query_id", "left", "right", F.round("overlap", 6).alias("overlap"))


def title_fits(spark, d):
    """Semantic fit of every drawn work, and its best match among the preprints' titles."""
    n = _nodes(spark, d)
    fit = U.fit_columns(n.withColumn("query", F.lit(QUERY))).select("canonical_id", F.round(U.semantic_fit(S.query_tokens(F.col("query")), F.col("query")), 6).alias("fit"))
    best = U.best_title_similarity(n.filter("canonical_id not like 'arxiv:%'").select("canonical_id", "title"), n.filter("canonical_id like 'arxiv:%'").select("title"))
    return fit.join(best, "canonical_id", "left").select("canonical_id", "fit", F.round("similarity", 6).alias("similarity"))


def result_neighbourhoods(spark, d):
    """Up to 28 works of every query that hang together, from its best cited on."""
    s, e = _signals(spark, d)
    n = s.select("query_id", "canonical_id", F.col("relevance_raw").alias("score"), (F.col("inbound") >= 6).alias("is_seed"))
    return EX.neighbourhood(n, e.filter("query_id is not null").select("query_id", "src", "dst"), "query_id", "score")


QUERIES = {f.__name__: f for f in (upload_gate, upload_gate_statistics, upload_pool, upload_decisions, node_views, shown_works, node_styles, promoted_anchors, blended_scores, expand_ranks, purity_reports, voted_labels, unexpected_connections, title_fits, result_neighbourhoods)}

_P = f"""with {_N}, p as (select pos, canonical_id, ({_VOC})::double as score, coalesce(year, 0) % 5 = 0 as over, "references" as refs from n)"""
_LT = "lower(coalesce(title, ''))"
_M = f"""{_S}, w as (select *, row_number() over (partition by query_id, domain order by inbound desc, canonical_id) as k, semantic_score >= 0.4 as hit, least(1.0, len(list_filter({_QT}, lambda t: contains({_LT}, t))) / least(4, len({_QT}))::double) as topical from s)"""
_THEME = " union all ".join(f"select query_id, domain, '{k}' as theme from w where contains({_LT}, '{v}')" for k, v in THEMES.items())
_STOP = ", ".join(f"'{x}'" for x in TOPIC_STOP)

SQL = {
    "upload_gate": _P + " select canonical_id, case when score < 0.2 and over then 'overridden' when score < 0.2 then 'blocked' else 'seed' end as state from p",
    "upload_gate_statistics": _P + " select count(*) filter (where score < 0.2) as low, count(*) filter (where score < 0.2 and over) as overridden, count(*) filter (where score < 0.2 and not over) as blocked, 0.2::double as threshold from p",
    "upload_pool": f"""with {_N}, r as (select pos, i - 1 as k, regexp_replace(regexp_replace(ref, '^\\s+', ''), '\\s+$', '') as id from (select pos, unnest("references") as ref, generate_subscripts("references", 1) as i from n where pos is not null) where ref is not null),
f as (select id, min(struct_pack(a := pos, b := k)) as w from r where id <> '' group by 1) select id, rn::int as pool_pos from (select id, row_number() over (order by w, id) as rn from f) where rn <= {U.POOL}""",
    "upload_decisions": f"""with {_N}, x as (select canonical_id, {bare_id_sql('arxiv_id')} as a, {bare_id_sql('doi')} as d, abstract is not null as ka, venue is not null as kd, {bare_id_sql('openalex_id')} as t, {bare_id_sql('semantic_scholar_id')} as s, length(title) / 100.0 as ts from n),
y as (select *, a is not null and d is not null and d <> '{U.ALIAS}' || a as bb from x)
select canonical_id, case when bb then 'arxiv' when d is not null then 'doi' when a is not null then 'arxiv' when t is not null or s is not null then 'openalex' else 'unresolved' end as provider,
  case when bb then a when d is not null then d when a is not null then a when t is not null then t when s is not null then s else '' end as id,
  round(case when bb then if(ka, {U.VERIFIED}, {U.BY_PREPRINT}) when d is not null then if(kd, {U.VERIFIED}, {U.BY_DOI}) when a is not null then if(ka, {U.VERIFIED}, {U.BY_PREPRINT}) when t is not null then round(ts, 4) when s is not null then 0.5 else 0.0 end, 6)::double as mapping_score,
  case when bb then 'pdf_text' when d is not null then 'doi' when a is null and t is null and s is not null then 'filename' else 'pdf_text' end as resolution from y""",
    "node_views": f"""with {_N}, o as (select key, min(origin) as origin from (select lower(canonical_id) as key, 'uploaded_pdf' as origin from n where canonical_id like 'arxiv:%' union all select 'doi:' || {bare_id_sql('doi')}, 'api_search' from n where year = 2020 and canonical_id not like 'arxiv:%' and {bare_id_sql('doi')} is not null) group by 1),
k as (select canonical_id, 0 as p, 'doi:' || {bare_id_sql('doi')} as key from n union all select canonical_id, 1, 'openalex:' || {bare_id_sql('openalex_id')} from n union all select canonical_id, 2, 'arxiv:' || {bare_id_sql('arxiv_id')} from n union all select canonical_id, 3, lower(canonical_id) from n),
j as (select canonical_id, arg_min(origin, p) as origin, bool_or(origin = 'uploaded_pdf') as up from k join o using (key) group by 1)
select canonical_id, coalesce(origin, 'discovered') as seed_origin, if(origin = 'uploaded_pdf', 'PDF', 'API') as source_label, coalesce(up, false) as uploaded,
  coalesce(len(list_filter(provenance, lambda p: p.source in ('fallback', 'pending'))) > 0, false) or contains(coalesce(title, ''), 'Fallback record') or starts_with(coalesce(title, ''), 'Pending metadata') as placeholder from n left join j using (canonical_id)""",
    "shown_works": f"""with {_N}, c as (select domain from n where domain is not null group by 1 order by count(*) desc, domain limit 2),
l as (select array_to_string(list_transform(string_split(lower(replace(trim(domain), '_', ' ')), ' '), lambda w: upper(w[1]) || w[2:]), ' ') as label from c)
select canonical_id, domain from n where array_to_string(list_transform(string_split(lower(replace(coalesce(nullif(trim(domain), ''), 'General'), '_', ' ')), ' '), lambda w: upper(w[1]) || w[2:]), ' ') in (select label from l) and (year is null or year between 2000 and 2020)""",
    "node_styles": f"""with {_S} select query_id, canonical_id, case when inbound >= 5 then '#D4AF37' when inbound >= 3 then '#CA8A04' when starts_with(canonical_id, 'arxiv:') then '#1D4ED8' else '#D4D4D8' end as colour,
  case when inbound >= 5 then 44 when inbound >= 3 then 30 when starts_with(canonical_id, 'arxiv:') then 34 else 16 end as size from s""",
    "promoted_anchors": f"""with {_S}, bare as (select query_id from s group by 1 having not bool_or(inbound >= 6)), k as (select s.query_id, canonical_id, row_number() over (partition by s.query_id order by semantic_score desc, relevance_raw desc, canonical_id) as k from s join bare using (query_id) where semantic_score >= 0.3)
select query_id, canonical_id from s where inbound >= 6 union all select query_id, canonical_id from k where k <= 2""",
    "blended_scores": f"""with {_S}, b as (select *, 0.7 * (semantic_score * 14.0) + 0.3 * graph_score as raw from s)
select query_id, canonical_id, round(if(semantic_score >= 0.78, greatest(raw, semantic_score * 14.0 * 0.94 + 1.0), raw) + if(semantic_score >= 0.72 and canonicality_score >= 0.48, 0.55, 0.0), 6)::double as blend from b""",
    "expand_ranks": f"""with {_C}, r as (select dst as canonical_id, count(*) as relation from c group by 1)
select canonical_id, (row_number() over (order by coalesce(relation, 0) desc, canonical_id))::int as expand_rank from n left join r using (canonical_id) where canonical_id not like 'arxiv:%'""",
    "purity_reports": f"""with {_M}, t as (select query_id, domain, theme, count(*) as k from ({_THEME}) group by 1, 2, 3), u as (select * from (select *, row_number() over (partition by query_id, domain order by k desc, theme) as rn from t) where rn = 1),
g2 as (select query_id, domain, count(*) as n, avg(hit::int) as match, avg(topical) as tp, avg(semantic_score) as p from w group by 1, 2),
z as (select g2.*, theme, coalesce(k / n, 0.0) as contamination, greatest(0.0, least(1.0, 0.45 * match + 0.35 * tp + 0.20 * p - 0.55 * coalesce(k / n, 0.0) - if(match < 0.25, 0.2, 0.0))) as score from g2 left join u using (query_id, domain))
select query_id, domain, round(score, 4)::double as score, case when score >= 0.55 then 'high' when score >= 0.38 then 'medium' else 'low' end as level, round(match, 4)::double as match, round(contamination, 4)::double as contamination, theme from z""",
    "voted_labels": f"""with {_M}, f as (select query_id, domain, unnest(list_filter(regexp_extract_all({_LT}, '[a-z][a-z0-9\\-]{{3,}}'), lambda x: not list_contains([{_STOP}], x))) as x from w),
q as (select distinct query_id, domain from w), v as (select query_id, domain, x, if(contains('{QUERY}', x), 2, 1) as v from f union all select query_id, domain, unnest(list_filter(regexp_extract_all('{QUERY}', '[a-z][a-z0-9\\-]{{3,}}'), lambda x: not list_contains([{_STOP}], x))), 3 from q),
c as (select query_id, domain, x, sum(v) as v from v group by 1, 2, 3), k as (select *, row_number() over (partition by query_id, domain order by v desc, x) as r from c)
select query_id, domain, array_to_string(list_transform(string_split(string_agg(x, ' ' order by r), ' '), lambda w: upper(w[1]) || w[2:]), ' ') as label from k where r <= 3 group by 1, 2""",
    "unexpected_connections": f"""with {_M}, h as (select * from w where k <= {B.SHOWN}), b as (select distinct query_id, domain, unnest(list_filter(regexp_split_to_array({_LT}, '[^a-z0-9]+'), lambda t: length(t) > 3)) as t from h),
n2 as (select query_id, domain, count(*) as n from b group by 1, 2), e2 as (select distinct g.query_id, least(x.domain, y.domain) as l, greatest(x.domain, y.domain) as r from g join h x on x.query_id = g.query_id and x.canonical_id = g.src join h y on y.query_id = g.query_id and y.canonical_id = g.dst where x.domain <> y.domain),
c2 as (select x.query_id, x.domain as l, y.domain as r, count(*) as c from b x join b y on x.query_id = y.query_id and x.t = y.t and x.domain < y.domain group by 1, 2, 3),
z as (select e2.query_id, e2.l, e2.r, coalesce(c, 0) / (a.n + d.n - coalesce(c, 0)) as o from e2 left join c2 using (query_id, l, r) join n2 a on a.query_id = e2.query_id and a.domain = e2.l join n2 d on d.query_id = e2.query_id and d.domain = e2.r)
select query_id, l as left, r as right, round(o, 6)::double as overlap from (select *, row_number() over (partition by query_id order by o, l, r) as rn from z where o <= 0.35) where rn = 1""",
}
