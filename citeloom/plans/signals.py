"""Queries of display lines, diagnostics and the full metrics of results, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from citeloom.functions import display as D
from citeloom.functions import scores as S
from citeloom.operators import branches as B
from citeloom.operators import diagnostics as X
from citeloom.operators import metrics as M
from citeloom.operators.ranking import TOPIC_STOP
from citeloom.plans.presentation import _R, _results
from citeloom.plans.scholarly import _N, AS_OF, QUERY, _nodes
from citeloom.tables import table

#: Weights of the fusion that the diagnostics take apart.
WEIGHTS = (0.4, 0.4, 0.2)
#: Queries whose gold titles are known, for ``gold_titles``.
GOLD = {"computing": ["Software and systems"], "law": ["Courts and rights", "Contracts"], "sport": ["Training"]}


def display_lines(spark, d):
    """What a result shows of every work."""
    n = _nodes(spark, d)
    return n.select(
        "canonical_id", D.short_title(F.col("title")).alias("short"), D.domain_label(F.col("domain")).alias("domain"), D.authors_line(F.col("authors")).alias("authors"), D.venue_line(F.col("venue")).alias("venue"),
        D.primary_url(F.col("arxiv_id"), F.col("doi")).alias("url"), D.first_sentence(F.col("abstract")).alias("summary"),
    )


def edge_buckets(spark, d):
    """Drawn citations by evidence and bucket."""
    e = table(spark, d, "edges")
    dashed = F.coalesce(F.trim("context"), F.lit("")) == ""
    return e.groupBy(D.confidence_words(F.col("confidence")).alias("evidence"), X.edge_bucket(F.coalesce(F.col("confidence"), F.lit("")), dashed).alias("bucket")).agg(F.count(F.lit(1)).alias("edges"))


def search_strings(spark, d):
    """Titles as search strings, and DOIs of one anthology."""
    n = _nodes(spark, d)
    return n.select("canonical_id", D.search_query(F.col("title")).alias("search"), D.file_stem(F.concat(F.coalesce("title", F.lit("")), F.lit(".pdf"))).alias("stem"), D.anthology_id(F.col("doi")).alias("anthology"))


def query_variants(spark, d):
    """The subjects as queries: normalized, how specific, and the searches that stand for them."""
    q = table(spark, d, "subjects").select("subject", D.normalized_query(F.col("label")).alias("query"))
    return q.select("subject", "query", F.round(D.specificity(F.col("query")), 6).alias("specificity"), F.array_join(D.query_variants(F.col("query")), " | ").alias("variants"), F.array_join(D.titles_for(F.col("subject"), GOLD), " | ").alias("gold"))


def _signals(spark, d):
    """Every query's works with the four signals."""
    r, e = _results(spark, d)
    graph, canon = F.col("inbound") / (F.col("inbound") + 10.0), F.least(F.lit(1.0), F.col("inbound") / 50.0)
    x = r.select("query_id", "canonical_id", "title", "year", "domain", "inbound", F.col("score").alias("semantic_score"), graph.alias("graph_score"), canon.alias("canonicality_score"))
    fused = WEIGHTS[0] * F.col("semantic_score") + WEIGHTS[1] * F.col("graph_score") + WEIGHTS[2] * F.col("canonicality_score")
    return x.withColumn("relevance_raw", fused), e


def _rounded(df):
    return df.select("query_id", "signal", *[F.round(c, 6).alias(c) for c in ("mean", "stdev", "min", "max")])


def signal_stats(spark, d):
    return _rounded(X.signal_stats(_signals(spark, d)[0], "query_id"))


def fusion_contributions(spark, d):
    return _rounded(X.contributions(_signals(spark, d)[0], "query_id", WEIGHTS))


def observability(spark, d):
    s, e = _signals(spark, d)
    refs = _nodes(spark, d).select("canonical_id", F.coalesce(F.size("references"), F.lit(0)).alias("n_references"))
    n = s.join(refs, "canonical_id").withColumn("pagerank_norm", F.col("graph_score"))
    x = X.observability(n, e.filter("query_id is not null"), "query_id")
    return x.select("query_id", "candidates", "edges", *[F.round(c, 6).alias(c) for c in ("density", "dispersion", "centrality_gap", "reference_ratio")])


def control_means(spark, d):
    """Means of drift, connectivity and domain agreement of each query's works."""
    s, _e = _signals(spark, d)
    wanted = S.domains_of_query(F.lit(QUERY))
    x = s.select("query_id", (1 - F.col("semantic_score")).alias("drift"), F.when(F.col("inbound") > 1, F.col("graph_score")).alias("connectivity"), S.domain_multiplier(F.nullif("domain", F.lit("unknown")), wanted).alias("multiplier"))
    return X.control_means(x, "query_id").select("query_id", *[F.round(c, 4).alias(c) for c in ("drift", "connectivity", "multiplier")])


def discovery_budgets(spark, d):
    """Options of each query: its ambiguity is the share of its works with hardly a word in common with the query's text."""
    s, _e = _signals(spark, d)
    q = s.groupBy("query_id").agg(F.avg((F.col("semantic_score") < 0.25).cast("double")).alias("ambiguity"), F.count(F.lit(1)).cast("int").alias("seeds"))
    q = q.select("*", F.lit(50).alias("top_n"), (F.col("seeds") % 2 == 0).alias("two_hop"), F.lit(120).alias("budget"), F.lit(0.25).alias("concept"), F.lit(3).alias("coupling"), F.lit(0.0).alias("topic"))
    return X.discovery_budget(q).select("query_id", "top_n", "two_hop", "budget", F.round("concept", 6).alias("concept"), "coupling", "topic", F.round("bridge_factor", 6).alias("bridge_factor"))


def evidence_levels(spark, d):
    """Evidence, warnings and the cut of works known by metadata alone."""
    s, e = _signals(spark, d)
    refs = _nodes(spark, d).select("canonical_id", F.coalesce(F.size("references"), F.lit(0)).alias("r"))
    n = s.join(refs, "canonical_id").groupBy("query_id").agg(F.count(F.lit(1)).alias("nodes"), F.sum("r").alias("references"), F.count_if(F.col("canonical_id").startswith("arxiv:")).alias("seeds"), F.count_if(F.col("inbound") > 1).alias("edges"))
    w = X.warnings_of(F.col("nodes"), F.col("edges"), F.col("references"), F.col("seeds"))
    return n.select("query_id", X.evidence(F.col("nodes"), F.col("edges"), F.col("references")).alias("evidence"), F.array_join(w, ",").alias("warnings"), F.when((F.col("references") == 0) & (F.col("edges") == 0), 0.72).otherwise(1.0).alias("factor"))


def coherence_layer(spark, d):
    """Relevance by coherence, the tier of each work, and its share of the best of its query."""
    s, _e = _signals(spark, d)
    venue = D.venue_topics(F.lower(F.coalesce("title", F.lit(""))), F.lit(None).cast("string"), S.query_tokens(F.lit(QUERY)))
    cluster = D.strongest_cluster(F.lower(F.coalesce("title", F.lit(""))), {"collection": ["collection", "garbage"], "machines": ["machine", "virtual", "runtime"]})
    x = s.withColumns({"coherence": 0.6 * F.col("semantic_score") + 0.4 * venue, "is_bridge": (F.col("semantic_score") < 0.2) & (F.col("inbound") < 3), "cluster": cluster})
    out = X.coherence_adjusted(F.col("relevance_raw"), F.col("coherence"), F.col("is_bridge"), F.col("cluster.hit") / 2)
    x = X.relevance_norm(x.withColumn("adjusted", out), "query_id", "adjusted")
    tier = X.confidence_tier(F.col("coherence"), F.col("semantic_score"), F.col("is_bridge"), F.when(F.col("cluster.hit") >= 0.6, F.col("cluster.name")))
    return x.select("query_id", "canonical_id", F.round("adjusted", 6).alias("adjusted"), F.round("relevance_norm", 6).alias("relevance_norm"), tier.alias("tier"))


def oldest_signals(spark, d):
    s, _e = _signals(spark, d)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance_raw"), "canonical_id"))
    x = s.select("query_id", "canonical_id", F.when(F.col("year").between(1900, AS_OF), F.col("year")).alias("year"), (F.col("inbound") >= 5).alias("is_hub"), F.col("graph_score").alias("relation"), rank.alias("rank"))
    return X.oldest_signal(x, "query_id")


def role_tags(spark, d):
    s, _e = _signals(spark, d)
    tags = D.role_tags(F.col("title"), F.col("year"), F.col("inbound") >= 5, F.col("inbound") == 2, F.col("canonicality_score"), F.nullif("domain", F.lit("unknown")), S.domains_of_query(F.lit(QUERY)))
    return s.select("query_id", "canonical_id", F.array_join(tags, ",").alias("tags"), D.literature_label(F.col("title"), F.lit(QUERY), TOPIC_STOP).alias("label"))


def hub_links(spark, d):
    """Drawn works and whether an edge joins them to a work that twenty edges cite."""
    s, e = _signals(spark, d)
    hubs = e.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).filter("n >= 20").select(F.col("dst").alias("hub"))
    return X.hub_linked(s.select("canonical_id").distinct(), hubs, e)


def _result_tables(spark, d):
    """The four tables of every query's result: works by relevance, the first six foundational, domains as branches."""
    s, _e = _signals(spark, d)
    w = Window.partitionBy("query_id").orderBy(F.desc("relevance_raw"), "canonical_id")
    c = s.withColumn("pos", F.row_number().over(w) - 1)
    f = c.filter("pos < 6").select("query_id", "pos", F.col("canonical_id").alias("paper_id"), "title", F.when(F.col("inbound") >= 2, "canonical").otherwise("exploratory").alias("role"), F.concat(F.lit("Cited in this map "), F.col("inbound").cast("string"), F.lit(" times.")).alias("why"))
    m = B.shown(B.members(s, "query_id", "domain", "inbound"))
    b = m.groupBy("query_id", "domain").agg(F.transform(F.array_sort(F.collect_list(F.struct("branch_rank", F.coalesce("title", F.lit("")).alias("title")))), lambda x: x["title"]).alias("titles"))
    b = b.select("query_id", F.col("domain").alias("branch_id"), F.dense_rank().over(Window.partitionBy("query_id").orderBy("domain")).alias("pos"), "titles", F.concat(F.lit("Works of the area "), F.col("domain")).alias("why"))
    q = s.groupBy("query_id").agg(F.count(F.lit(1)).alias("paper_count")).withColumn("query", F.lit(QUERY))
    year = F.when(F.col("year").between(1900, AS_OF), F.col("year"))
    return q, f, b, c.filter("pos < 40").select("query_id", "pos", "title", "semantic_score", year.alias("year")), s


def full_metrics(spark, d):
    """The eight metrics and the composite of every query; the gold title is that of the query's most cited work."""
    q, f, b, c, s = _result_tables(spark, d)
    gold = s.groupBy("query_id").agg(F.min_by("title", F.struct((-F.col("inbound")).alias("i"), "canonical_id")).alias("gold")).filter("trim(gold) <> ''")
    return M.all_metrics(q, f, b, c, gold)


def metrics_without_gold(spark, d):
    """The same without gold titles, whose hit rate is neutral then."""
    q, f, b, c, s = _result_tables(spark, d)
    return M.all_metrics(q, f, b, c, s.select("query_id", F.col("title").alias("gold")).limit(0))


def result_summary(spark, d):
    """How many works each query found, the ids of the first ten, and how recent its first five are."""
    s, _e = _signals(spark, d)
    x = s.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance_raw"), "canonical_id")))
    bias = x.filter("rank <= 5").groupBy("query_id").agg(F.round(F.avg(S.recency_alignment(F.col("year"), AS_OF)), 6).alias("recency"))
    return M.summary(x).join(bias, "query_id").select("query_id", "papers", F.array_join("top", ",").alias("top"), "recency")


QUERIES = {f.__name__: f for f in (display_lines, edge_buckets, search_strings, query_variants, signal_stats, fusion_contributions, observability, control_means, discovery_budgets, evidence_levels, coherence_layer, oldest_signals, role_tags, hub_links, full_metrics, metrics_without_gold, result_summary)}

_STRIP = r"regexp_replace(regexp_replace(coalesce({0}, ''), '^\s+', ''), '\s+$', '')"
_TITLE = "array_to_string(list_transform(string_split(lower({0}), ' '), w -> upper(w[1]) || w[2:]), ' ')".replace("w -> ", "lambda w: ")
_WORDS = "list_filter(regexp_split_to_array(" + _STRIP + r", '\s+'), lambda w: w <> '')"
_T = "coalesce(nullif(" + _STRIP.format("title") + ", ''), 'Untitled')"
_NAMES = "list_filter(list_transform(authors[1:6], lambda a: " + _STRIP.format("a.name") + "), lambda x: x <> '')"
_FIRST = _STRIP.format("split_part(" + _STRIP.format("abstract") + ", '. ', 1)")
_S = f"""{_R},
s as (select query_id, canonical_id, title, year, domain, inbound, score as semantic_score, inbound / (inbound + 10.0) as graph_score, least(1.0, inbound / 50.0) as canonicality_score,
  {WEIGHTS[0]} * score + {WEIGHTS[1]} * (inbound / (inbound + 10.0)) + {WEIGHTS[2]} * least(1.0, inbound / 50.0) as relevance_raw from r)"""
_WANTED = "[" + ", ".join(f"'{v}'" for v in sorted({v for k, v in S.QUERY_DOMAINS if k in QUERY})) + "]::varchar[]"
_QT = "['" + "', '".join(w for w in dict.fromkeys(QUERY.split()) if len(w) >= 3 and w not in S.STOPWORDS) + "']"
_LT = "lower(coalesce(title, ''))"


def _stats(columns: dict[str, str]) -> str:
    one = "select query_id, '{0}' as signal, round(avg({1}), 6)::double as mean, round(stddev_pop({1}), 6)::double as stdev, round(min({1}), 6)::double as min, round(max({1}), 6)::double as max from s group by 1"
    return f"with {_S} " + " union all ".join(one.format(n, c) for n, c in columns.items())


_NORM = r"trim(regexp_replace(lower(coalesce({0}, '')), '\s+', ' ', 'g'))"
_TOK = "list_distinct(regexp_extract_all(" + _NORM + ", '[a-z0-9]+'))"
_QTOK = "list_distinct(regexp_extract_all('" + QUERY + "', '[a-z0-9]+'))"
_METRICS = f"""with {_S},
c as (select *, row_number() over (partition by query_id order by relevance_raw desc, canonical_id) - 1 as pos from s),
f as (select query_id, pos, canonical_id as paper_id, title, if(inbound >= 2, 'canonical', 'exploratory') as role, 'Cited in this map ' || inbound || ' times.' as why from c where pos < 6),
b as (select query_id, domain, dense_rank() over (partition by query_id order by domain) as pos, titles, 'Works of the area ' || domain as why from (select query_id, domain, list(coalesce(title, '') order by branch_rank) as titles from m where branch_rank <= {B.SHOWN} group by 1, 2)),
k as (select * from c where pos < 40),
t as (select query_id, title, row_number() over (partition by query_id order by part, pos, k, title) as n from (
  select query_id, 0 as part, pos, 0 as k, title from f union all select query_id, 1, pos, i - 1, title from (select query_id, pos, unnest(titles) as title, generate_subscripts(titles, 1) as i from b) union all select query_id, 2, pos, 0, title from k) where trim(title) <> ''),
ip as (select query_id, avg((len(list_intersect({_QTOK}, {_TOK.format('title')})) / len({_QTOK}) >= 0.25 or len(list_filter({_QTOK}, lambda w: length(w) > 3 and contains({_NORM.format('title')}, w))) > 0)::int) as intent_precision from t where n <= 40 group by 1),
fq as (select query_id, avg(greatest(0.0, least(1.0, 0.5 * if(length(trim(why)) >= 24, 1.0, 0.3) + 0.5 * if(role <> 'exploratory', 1.0, 0.6) - if(seen > 1, 0.4, 0.0)))) as foundational_quality from (select *, row_number() over (partition by query_id, {_NORM.format('title')} order by pos) as seen from f) group by 1),
nr as (select query_id, avg((len(list_intersect({_QTOK}, {_TOK.format('title')})) / len({_QTOK}) < 0.12 and semantic_score < 0.35)::int) as noise_ratio from k where pos < 20 group by 1),
bm as (select query_id, pos, i, {_TOK.format('title')} as w from (select query_id, pos, unnest(titles) as title, generate_subscripts(titles, 1) as i from b) where title <> ''),
bj as (select x.query_id, x.pos, avg(len(list_intersect(x.w, y.w)) / greatest(1, len(list_distinct(x.w || y.w)))) as j from bm x join bm y on x.query_id = y.query_id and x.pos = y.pos and x.i < y.i group by 1, 2),
bc as (select b.query_id, avg(coalesce(j, 0.5)) as branch_coherence, count(*) as n_branches from b left join bj using (query_id, pos) group by 1),
rd as (select query_id, avg((length(why) between 20 and 280)::int) as readability from (select query_id, why from f union all select query_id, why from b) group by 1),
ys as (select query_id, max(year) filter (where year between 1900 and {AS_OF}) - min(year) filter (where year between 1900 and {AS_OF}) as span from k group by 1),
hr as (select query_id, sum((trim(coalesce(title, '')) = '')::int) / count(*) as hallucination_risk from f group by 1),
z as (select query_id, intent_precision, 1.0 as canonical_hit_rate, foundational_quality, noise_ratio, branch_coherence, 0.6 * least(1.0, n_branches / 4.0) + 0.4 * least(1.0, coalesce(span, 0) / 12.0) as diversity, readability, hallucination_risk
  from fq left join ip using (query_id) join nr using (query_id) join bc using (query_id) join rd using (query_id) join ys using (query_id) join hr using (query_id))
select query_id, round(coalesce(intent_precision, 0), 4)::double as intent_precision, canonical_hit_rate::double as canonical_hit_rate, round(foundational_quality, 4)::double as foundational_quality, round(noise_ratio, 4)::double as noise_ratio, round(branch_coherence, 4)::double as branch_coherence,
  round(diversity, 4)::double as diversity, round(readability, 4)::double as readability, round(hallucination_risk, 4)::double as hallucination_risk,
  round(0.22 * coalesce(intent_precision, 0) + 0.18 * canonical_hit_rate + 0.18 * foundational_quality + 0.12 * (1 - noise_ratio) + 0.12 * branch_coherence + 0.08 * diversity + 0.06 * readability + 0.04 * (1 - hallucination_risk), 4)::double as composite from z"""

_AMB = "greatest(0.0, least(1.0, ambiguity))"
_FACTOR = f"(({_AMB} - 0.5) / 0.5)"
_CL = {"collection": ["collection", "garbage"], "machines": ["machine", "virtual", "runtime"]}
_CLHIT = lambda ms: f"least(1.0, len(list_filter({ms}, lambda x: contains({_LT}, x))) / {min(3, len(ms))}.0)"
_H1, _H2 = _CLHIT(_CL["collection"]), _CLHIT(_CL["machines"])

SQL = {
    "display_lines": f"""with {_N} select canonical_id, if(len({_WORDS.format(_T)}) <= 3, {_T}, array_to_string(({_WORDS.format(_T)})[1:3], ' ') || '...') as short,
  {_TITLE.format("replace(coalesce(nullif(" + _STRIP.format('domain') + ", ''), 'General'), '_', ' ')")} as domain,
  if(len({_NAMES}) > 0, array_to_string({_NAMES}, ', ') || if(len(authors) > 6, ' et al.', ''), '') as authors, if(lower({_STRIP.format('venue')}) in ('pending-ingest', 'unknown'), '', {_STRIP.format('venue')}) as venue,
  coalesce('https://arxiv.org/abs/' || nullif({_STRIP.format('arxiv_id')}, ''), 'https://doi.org/' || nullif({_STRIP.format("regexp_replace(doi, '^https://doi[.]org/', '')")}, '')) as url,
  if(length({_FIRST}) > 20, {_FIRST} || if(ends_with({_FIRST}, '.'), '', '.'), '') as summary from n""",
    "edge_buckets": """select case lower(trim(confidence)) when 'high' then 'High evidence' when 'medium' then 'Moderate evidence' when 'low' then 'Exploratory evidence' else 'Unknown evidence' end as evidence,
  if(trim(coalesce(context, '')) = '' or lower(coalesce(confidence, '')) = 'low', 'potential', 'supported') as bucket, count(*) as edges from edges group by 1, 2""",
    "signal_stats": _stats({s: s for s in X.SIGNALS}),
    "fusion_contributions": _stats({n: f"{w} * {c}" for n, c, w in zip(("weighted_semantic", "weighted_graph", "weighted_canonicality"), X.SIGNALS, WEIGHTS)}),
    "observability": f"""with {_S}, k as (select query_id, count(*) as edges from g where query_id is not null group by 1),
p as (select s.*, coalesce(len("references"), 0) as refs from s join n using (canonical_id))
select query_id, count(*) as candidates, max(edges) as edges, round(max(edges) / count(*), 6)::double as density, round(stddev_pop(semantic_score), 6)::double as dispersion, round(max(graph_score) - avg(graph_score), 6)::double as centrality_gap,
  round(least(1.0, sum(refs) / (count(*) * 8.0)), 6)::double as reference_ratio from p join k using (query_id) group by 1""",
    "control_means": f"""with {_S} select query_id, round(avg(1 - semantic_score), 4)::double as drift, round(avg(if(inbound > 1, graph_score, 0.0)), 4)::double as connectivity,
  round(avg(case when len({_WANTED}) = 0 then 1.0 when domain = 'unknown' or trim(domain) = '' then 0.82 when list_contains({_WANTED}, lower(trim(domain))) then 1.0 else 0.58 end), 4)::double as multiplier from s group by 1""",
    "discovery_budgets": f"""with {_S}, q as (select query_id, avg((semantic_score < 0.25)::int) as ambiguity, count(*)::int as seeds from s group by 1),
o as (select *, if({_AMB} >= 0.5, greatest(30, least(300, floor(120 * greatest(0.55, 1.0 - 0.35 * {_FACTOR})))), 120)::int as b0, if({_AMB} >= 0.5, least(1.0, 0.25 + 0.05 + 0.12 * {_FACTOR}), 0.25) as c0, seeds % 2 = 0 as t0 from q)
select query_id, 50 as top_n, t0 or seeds < 50 as two_hop, case when seeds < 50 and not t0 then greatest(b0, 100) when seeds < 50 and b0 < 200 then least(260, greatest(b0 + 60, 100)) else b0 end::int as budget,
  round(if(seeds < 12, greatest(0.15, c0 - 0.15), c0), 6)::double as concept, if(seeds < 12, 2, 3) as coupling, if(seeds < 12, 0.2, 0.0)::double as topic, round(if({_AMB} >= 0.5, 0.35 + 0.25 * {_FACTOR}, 0.45), 6)::double as bridge_factor from o""",
    "evidence_levels": f"""with {_S}, k as (select query_id, count(*) as nodes, sum(coalesce(len("references"), 0)) as refs, count(*) filter (where starts_with(canonical_id, 'arxiv:')) as seeds, count(*) filter (where inbound > 1) as edges from s join n using (canonical_id) group by 1)
select query_id, case when refs = 0 and edges = 0 then 'low' when refs >= 50 and edges >= 30 then 'high' else 'medium' end as evidence,
  concat_ws(',', if(nodes >= 2 and edges < 2, 'few_links', null), if(nodes >= 4 and refs < 20, 'few_references', null), if(seeds < 3 and nodes >= 2, 'few_anchors', null)) as warnings, if(refs = 0 and edges = 0, 0.72, 1.0)::double as factor from k""",
    "coherence_layer": f"""with {_S}, h as (select *, 0.6 * semantic_score + 0.4 * least(1.0, len(list_filter({_QT}, lambda w: contains({_LT}, w))) / least(4, len({_QT}))::double) as coherence, semantic_score < 0.2 and inbound < 3 as bridge, greatest({_H1}, {_H2}) as hit from s),
j as (select *, greatest(0.0, relevance_raw * (0.55 + 0.45 * if(coherence = 0, 0.5, coherence)) * if(bridge, 0.45, 1.0) * case when hit / 2 >= 0.34 then 0.35 when hit / 2 >= 0.22 then 0.62 else 1.0 end) as adjusted from h)
select query_id, canonical_id, round(adjusted, 6)::double as adjusted, round(adjusted / if(max(adjusted) over (partition by query_id) > 0, max(adjusted) over (partition by query_id), 1.0), 6)::double as relevance_norm,
  case when hit >= 0.6 then 'cross_domain_bridge' when bridge then 'exploratory_connection' when coherence >= 0.62 and semantic_score >= 0.45 then 'core_intent' when coherence >= 0.45 or semantic_score >= 0.35 then 'moderate_intent' when semantic_score >= 0.22 then 'lexically_related' else 'citation_adjacent' end as tier from j""",
    "oldest_signals": f"""with {_S}, k as (select *, if(year between 1900 and {AS_OF}, year, null) as y, row_number() over (partition by query_id order by relevance_raw desc, canonical_id) as rank from s)
select query_id, canonical_id from (select *, row_number() over (partition by query_id order by y nulls last, if(y is null, 0, if(inbound >= 5, 0, 1)), if(y is null, 0, -graph_score), rank) as rn from k) where rn = 1""",
    "hub_links": f"""with {_S}, hubs as (select dst as hub from g group by 1 having count(*) >= 20), ends as (select src as canonical_id from g where dst in (select hub from hubs) union select dst from g where src in (select hub from hubs))
select distinct canonical_id, canonical_id in (select canonical_id from ends) as linked from s""",
    "metrics_without_gold": _METRICS,
    "result_summary": f"""with {_S}, k as (select *, row_number() over (partition by query_id order by relevance_raw desc, canonical_id) as rank from s)
select query_id, count(*) as papers, string_agg(canonical_id, ',' order by rank) filter (where rank <= 10) as top,
  round(avg(case when year is null then 0.55 when {AS_OF} - year <= 2 then 1.0 when {AS_OF} - year <= 5 then 0.82 when {AS_OF} - year <= 10 then 0.58 when {AS_OF} - year <= 18 then 0.35 else 0.18 end) filter (where rank <= 5), 6)::double as recency from k group by 1""",
    "role_tags": f"""with {_S}, x as (select *, list_filter(regexp_extract_all({_STRIP.format('title')}, '[a-zA-Z][a-zA-Z0-9\\-]{{2,}}'), lambda w: not list_contains([{', '.join(f"'{w}'" for w in TOPIC_STOP)}], lower(w)) and not list_contains(regexp_extract_all('{QUERY}', '[a-z][a-z0-9\\-]{{2,}}'), lower(w))) as kept from s),
y as (select *, {_TITLE.format("array_to_string(kept[1:8], ' ')")} as phrase, left({_STRIP.format('title')}, 70) as head from x)
select query_id, canonical_id, concat_ws(',', if(inbound >= 5, 'Foundational', null), if(contains({_LT}, 'survey') or contains({_LT}, ' literature review') or contains({_LT}, ' review of') or contains({_LT}, 'taxonomy') or contains({_LT}, 'overview of'), 'Survey', null),
  if(year >= 2021, 'Recent', null), if(inbound = 2, 'Bridge', null), if(canonicality_score >= {D.CANONICAL_FROM}, 'Canonical', null), if(len({_WANTED}) > 0 and domain <> 'unknown' and trim(domain) <> '' and not list_contains({_WANTED}, lower(trim(domain))), 'Cross-domain', null)) as tags,
  case when len(kept) >= 3 then if(length(phrase) > 72, regexp_replace(left(phrase, 72), ' [^ ]*$', '') || '…', phrase) else coalesce(nullif(trim(if(length(head) = 70 and contains(head, ' '), regexp_replace(head, ' [^ ]*$', '') || '…', head)), ''), 'Literature branch') end as label from y""",
    "query_variants": f"""select subject, lower(label) as query, round(least(1.0, len(t) / 8.0 + if(len(regexp_split_to_array(trim(label), '\\s+')) >= 3, 0.25, 0.0)), 6)::double as specificity,
  case when len(regexp_split_to_array(trim(label), '\\s+')) <= 2 then lower(label) || ' | ' || lower(label) || ' OR survey' else lower(label) end as variants,
  case subject when 'computing' then 'Software and systems' when 'law' then 'Courts and rights | Contracts' when 'sport' then 'Training' else '' end as gold
  from (select subject, label, list_distinct(list_filter(regexp_split_to_array(lower(label), '[^a-z0-9_\\-]+'), lambda w: length(w) > 2 and not list_contains([{', '.join(f"'{w}'" for w in S.STOPWORDS)}], w))) as t from subjects)""",
    "search_strings": f"""with {_N}, t as (select canonical_id, doi, {_STRIP.format('title')} as t, coalesce(title, '') as raw from n),
u as (select *, trim(regexp_replace(regexp_replace(t, '["\n]', ' ', 'g'), '\\s+', ' ', 'g')) as safe, trim(regexp_replace(regexp_replace(regexp_extract(raw, '([^/\\\\]*)$', 1), '[_\\-.]+', ' ', 'g'), '\\s+', ' ', 'g')) as stem, regexp_extract(raw, '([^/\\\\]*)$', 1) as part from t)
select canonical_id, case when t = '' or regexp_matches(t, '(?i)^(all|ti|au|abs|co|id|cat)\\s*:\\s*') then t when safe = '' then '' else 'all:' || safe end as search,
  case when length(stem) >= 6 and lower(stem) not in ({', '.join(f"'{x}'" for x in D.FILE_NOISE)}) and not regexp_matches(part, '^[0-9._\\-]*$') then stem end as stem,
  nullif(upper(regexp_extract(lower(regexp_replace(trim(doi), '^(?i)(?:doi:|[a-z]+://[^/]+/)', '')), '^10\\.18653/v1/(.*)$', 1)), '') as anthology from u""",
}
