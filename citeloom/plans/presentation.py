"""Queries of branches, quality metrics and what results show, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions import scores as S
from citeloom.functions.ids import bare_id
from citeloom.operators import branches as B
from citeloom.operators import graph as G
from citeloom.operators.ranking import TOPIC_STOP, ranked
from citeloom.plans.scholarly import SQL as _SCHOLARLY
from citeloom.plans.scholarly import _C, _DRAWN, _VOC, QUERY, _anchors, _cites, _drawn, _nodes
from citeloom.tables import table



def _results(spark, d):
    """(query_id, canonical_id, domain, title, year, score, inbound): the works each query drew."""
    n, e = _drawn(spark, d)
    x = e.filter("query_id is not null").groupBy("query_id", F.col("dst").alias("canonical_id")).agg(F.count(F.lit(1)).alias("inbound"))
    s = n.select("canonical_id", "title", "year", F.coalesce("domain", F.lit("unknown")).alias("domain"), S.vocabulary_coherence(F.lit(QUERY)).alias("score"))
    return x.join(s, "canonical_id"), e


def _members(spark, d):
    r, e = _results(spark, d)
    return B.members(r, "query_id", "domain", "inbound"), e


def branch_members(spark, d):
    m, _e = _members(spark, d)
    return B.shown(m).select("query_id", "domain", "canonical_id", "branch_rank", "branch_size")


def branch_summary(spark, d):
    m, _e = _members(spark, d)
    return B.summary(m, "query_id", "domain", "score").select("query_id", "domain", "size", "central", F.round("purity", 6).alias("purity"))


def branch_coherence(spark, d):
    m, _e = _members(spark, d)
    return B.coherence(m, "query_id", "domain").select("query_id", "domain", F.round("coherence", 6).alias("coherence"))


def branch_labels(spark, d):
    m, _e = _members(spark, d)
    return B.labels(m, "query_id", "domain", TOPIC_STOP)


def branch_bridges(spark, d):
    m, e = _members(spark, d)
    return B.bridges(e.filter("query_id is not null").select("query_id", "src", "dst"), m.select("query_id", "canonical_id", "domain"), "query_id", "domain")


def neighbour_titles(spark, d):
    n, e = _cites(spark, d)
    return B.neighbours(e.select("src", "dst", "ref_pos"), n)


def seed_union(spark, d):
    """Preprints, then works whose title matches the query, then works that other works cite most."""
    n, e = _cites(spark, d)
    a = n.filter("canonical_id like 'arxiv:%'").select(F.col("canonical_id").alias("key"), F.lit("anchor").alias("source"), "pos")
    t = n.filter(S.lexical_similarity(F.lit(QUERY)) >= 0.5).select(F.col("canonical_id").alias("key"), F.lit("search").alias("source"), "pos")
    c = G.degrees(n, e).filter("in_degree >= 20").join(n.select("canonical_id", "pos"), "canonical_id").select(F.col("canonical_id").alias("key"), F.lit("citations").alias("source"), "pos")
    return B.seed_union(a, t, c)


def pending_records(spark, d):
    n = _nodes(spark, d)
    refs = n.select(F.col("canonical_id").alias("src"), F.posexplode("references").alias("ref_pos", "ref")).select("src", "ref_pos", bare_id(F.col("ref")).alias("key")).filter("key is not null")
    return B.placeholders(refs.join(G.aliases(n), "key", "left_anti"))


def node_flags(spark, d):
    """Reason codes, tier and hub flag of every work."""
    n, e = _cites(spark, d)
    deg = G.degrees(n, e).select("canonical_id", "in_degree")
    rel = G.relation_scores(n, e, _anchors(n)).select("canonical_id", F.col("score").alias("relation"))
    miss = G.missing_links(e, _anchors(n))
    x = n.join(deg, "canonical_id").join(rel, "canonical_id", "left").join(miss, "canonical_id", "left")
    sem = S.vocabulary_coherence(F.lit(QUERY))
    why = B.reasons(sem, F.col("in_degree"), F.coalesce("relation", F.lit(0.0)), F.col("canonical_id").startswith("arxiv:"))
    return x.select("canonical_id", F.array_join(why, ",").alias("reasons"), B.tier(sem).alias("tier"), (F.coalesce("citing_anchors", F.lit(0)) >= 3).alias("is_hub"))


def ring_layout(spark, d):
    n, e = _cites(spark, d)
    r = ranked(G.degrees(n, e).select("canonical_id", F.col("degree").cast("double").alias("degree")), "degree")
    x, y = B.polar(F.col("rank"))
    return r.select("canonical_id", "rank", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


def query_metrics(spark, d):
    """Per query: share of works that match the query's words, share of noise, diversity, and a weighted sum."""
    r, _e = _results(spark, d)
    m = B.members(r.withColumn("all", F.lit(1)), "query_id", "all", "inbound")
    q = S.query_tokens(F.lit(QUERY))
    hit = F.size(F.array_intersect(q, B.title_words(F.col("title")))) / F.size(q)
    top = B.shown(m, 40).withColumn("hit", hit)
    y = F.when(F.col("year").between(1900, 2026) & (F.col("branch_rank") <= 20), F.col("year"))
    g = top.groupBy("query_id").agg(
        F.avg((F.col("hit") >= 0.25).cast("double")).alias("precision"),
        (F.count_if((F.col("branch_rank") <= 20) & (F.col("hit") < 0.12) & (F.col("score") < 0.35)) / F.count_if(F.col("branch_rank") <= 20)).alias("noise"),
        F.count_distinct("domain").alias("branches"),
        (F.max(y) - F.min(y)).alias("span"),
    )
    div = 0.6 * F.least(F.lit(1.0), F.col("branches") / 4.0) + 0.4 * F.least(F.lit(1.0), F.coalesce("span", F.lit(0)) / 12.0)
    g = g.withColumn("diversity", div)
    total = 0.22 * F.col("precision") + 0.12 * (1 - F.col("noise")) + 0.08 * F.col("diversity")
    return g.select("query_id", *[F.round(c, 4).alias(c) for c in ("precision", "noise", "diversity")], F.round(total, 4).alias("weighted"))


def payload_budget(spark, d):
    """Which of each source's landed payloads fit a budget of 20 kB, in order of fetching."""
    p = table(spark, d, "raw_payloads").select(F.substring("source_id", 1, 6).alias("key"), F.concat_ws("/", "source", "source_id").alias("name"), F.col("fetched_unix").alias("pos"), F.coalesce(F.octet_length("payload"), F.lit(0)).cast("long").alias("size")).distinct()
    return B.greedy_cap(p, 20_000)


QUERIES = {f.__name__: f for f in (branch_members, branch_summary, branch_coherence, branch_labels, branch_bridges, neighbour_titles, seed_union, pending_records, node_flags, ring_layout, query_metrics, payload_budget)}

_R = f"""{_DRAWN},
r0 as (select query_id, dst as canonical_id, count(*) as inbound from g where query_id is not null group by 1, 2),
r as (select r0.*, title, year, coalesce(domain, 'unknown') as domain, ({_VOC})::double as score from r0 join n using (canonical_id)),
m as (select *, row_number() over (partition by query_id, domain order by inbound desc, canonical_id) as branch_rank, count(*) over (partition by query_id, domain) as branch_size from r)"""
_TW = "list_distinct(list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^a-z0-9]+'), lambda t: t <> ''))"
_QTOK = "list_distinct(list_filter(regexp_split_to_array(lower('" + QUERY + "'), '[^a-z0-9_]+'), lambda t: length(t) >= 3 and not list_contains([" + ", ".join(f"'{w}'" for w in S.STOPWORDS) + "], t)))"
_DEG = "ends as (select src as canonical_id, 1 as o, 0 as i from c union all select dst, 0, 1 from c), deg as (select n.canonical_id, coalesce(sum(i), 0) as in_degree, coalesce(sum(o + i), 0) as degree from n left join ends using (canonical_id) group by 1)"

_REL = _SCHOLARLY["relation_expand_scores"]

SQL = {
    "branch_members": f"with {_R} select query_id, domain, canonical_id, branch_rank::int as branch_rank, branch_size from m where branch_rank <= {B.SHOWN}",
    "branch_summary": f"""with {_R} select query_id, domain, max(branch_size) as size, max(canonical_id) filter (where branch_rank = 1) as central,
round(case when max(branch_size) < 2 then 1.0 else avg(score) * (1 - 0.5 * avg(coalesce(regexp_matches(lower(title), 'survey of|overview of|review of|state of the art|benchmark|dataset'), false)::int)) end, 6)::double as purity from m group by 1, 2""",
    "branch_coherence": f"""with {_R}, s as (select query_id, domain, branch_rank, {_TW.format('title')} as w from m where branch_rank <= {B.SHOWN}),
j as (select a.query_id, a.domain, avg(len(list_intersect(a.w, b.w)) / greatest(1, len(list_distinct(a.w || b.w)))) as c from s a join s b on a.query_id = b.query_id and a.domain = b.domain and a.branch_rank < b.branch_rank group by 1, 2)
select distinct s.query_id, s.domain, round(coalesce(c, 0.5), 6)::double as coherence from s left join j using (query_id, domain)""",
    "branch_labels": f"""with {_R}, t as (select query_id, domain, unnest(list_filter({_TW.format('title')}, lambda w: length(w) >= 4 and not list_contains([{', '.join(f"'{w}'" for w in TOPIC_STOP)}], w))) as w from m),
c as (select query_id, domain, w, count(*) as n from t group by 1, 2, 3), k as (select *, row_number() over (partition by query_id, domain order by n desc, w) as r from c)
select query_id, domain, string_agg(upper(w[1]) || w[2:], ' ' order by r) as label from k where r <= 3 group by 1, 2""",
    "branch_bridges": f"""with {_R} select g.query_id, least(x.domain, y.domain) as left, greatest(x.domain, y.domain) as right, count(*) as edges from g join m x on x.query_id = g.query_id and x.canonical_id = g.src join m y on y.query_id = g.query_id and y.canonical_id = g.dst where x.domain <> y.domain group by 1, 2, 3""",
    "neighbour_titles": f"with {_C}, k as (select *, row_number() over (partition by src order by ref_pos, dst) as rank from c) select src, rank::int as rank, dst, title from k join n on n.canonical_id = k.dst where rank <= 5",
    "seed_union": f"""with {_C}, {_DEG}, u as (select canonical_id as key, 'anchor' as source, pos, 0 as p from n where starts_with(canonical_id, 'arxiv:')
union all select canonical_id, 'search', pos, 1 from n where len(list_filter({_QTOK}, lambda t: contains(lower(coalesce(title, '')), t))) / len({_QTOK}) >= 0.5
union all select canonical_id, 'citations', pos, 2 from deg join n using (canonical_id) where in_degree >= 20),
k as (select *, lower(trim(key)) as lk, row_number() over (partition by lower(trim(key)) order by p, pos nulls first, source) as rn from u) select lk as key, source, pos from k where rn = 1""",
    "pending_records": f"""with {_C}, x as (select src, ref_pos::int as ref_pos, key from refs where key is not null and key not in (select key from a)),
y as (select *, lag(key) over (partition by src order by ref_pos, key) as previous from x), z as (select *, row_number() over (partition by key order by src, ref_pos, previous nulls first) as rn from y)
select key as canonical_id, 'Pending metadata: ' || key as title, previous from z where rn = 1""",
    "payload_budget": """with recursive p as (select distinct substring(source_id, 1, 6) as key, concat_ws('/', source, source_id) as name, fetched_unix as pos, coalesce(strlen(payload), 0)::bigint as size from raw_payloads),
k as (select *, row_number() over (partition by key order by pos nulls first, name, size) as rn from p),
r(key, rn, name, size, used, kept) as (select key, rn, name, size, if(size <= 20000, size, 0)::bigint, size <= 20000 from k where rn = 1
  union all select k.key, k.rn, k.name, k.size, if(r.used + k.size <= 20000, r.used + k.size, r.used)::bigint, r.used + k.size <= 20000 from r join k on k.key is not distinct from r.key and k.rn = r.rn + 1)
select key, name, size, kept from r""",
    "ring_layout": f"""with {_C}, {_DEG}, k as (select canonical_id, row_number() over (order by degree desc, canonical_id) as rank from deg)
select canonical_id, rank::int as rank, round(if(rank = 1, 0.0, (70 + floor((rank - 2) / 7) * 55) * cos(2 * pi() * ((rank - 2) % 7) / 7)), 4) as x, round(if(rank = 1, 0.0, (70 + floor((rank - 2) / 7) * 55) * sin(2 * pi() * ((rank - 2) % 7) / 7)), 4) as y from k""",
    "query_metrics": f"""with {_R}, t as (select *, row_number() over (partition by query_id order by inbound desc, canonical_id) as k, len(list_intersect({_QTOK}, {_TW.format('title')})) / len({_QTOK}) as hit from r),
z as (select query_id, avg((hit >= 0.25)::int) as precision, count(*) filter (where k <= 20 and hit < 0.12 and score < 0.35) / count(*) filter (where k <= 20) as noise, count(distinct domain) as branches,
  max(year) filter (where year between 1900 and 2026 and k <= 20) - min(year) filter (where year between 1900 and 2026 and k <= 20) as span from t where k <= 40 group by 1),
v as (select *, 0.6 * least(1.0, branches / 4.0) + 0.4 * least(1.0, coalesce(span, 0) / 12.0) as diversity from z)
select query_id, round(precision, 4)::double as precision, round(noise, 4)::double as noise, round(diversity, 4)::double as diversity, round(0.22 * precision + 0.12 * (1 - noise) + 0.08 * diversity, 4)::double as weighted from v""",
    "node_flags": f"""{_REL.split("select canonical_id, round(score, 6)")[0]}, miss as (select dst as canonical_id, count(*) as k from e where src in (select anchor from anchors) and dst not in (select anchor from anchors) group by 1),
v as (select n.canonical_id, ({_VOC})::double as sem, in_degree, coalesce(s.score, 0) as rel, coalesce(k, 0) as k from n join deg using (canonical_id) left join s on s.canonical_id = n.canonical_id and s.score > 1e-9 left join miss on miss.canonical_id = n.canonical_id)
select canonical_id, coalesce(nullif(concat_ws(',', if(sem >= 0.45, 'query_match', null), if(in_degree >= 8, 'highly_cited', null), if(rel >= 0.35, 'related_to_anchors', null), if(starts_with(canonical_id, 'arxiv:'), 'anchor', null)), ''), 'pool') as reasons,
  case when sem >= 0.62 then 'core' when sem >= 0.45 then 'near_core' else 'peripheral' end as tier, k >= 3 as is_hub from v""",
}
