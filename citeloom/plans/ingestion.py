"""Queries of normalization, extraction, query intent, resolution, feedback and evaluation, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions import extract as X
from citeloom.functions import scores as S
from citeloom.functions.ids import bare_id, bare_id_sql
from citeloom.operators import evaluation as E
from citeloom.operators import feedback as FB
from citeloom.operators import graph as G
from citeloom.operators import normalize as N
from citeloom.operators import query_intent as Q
from citeloom.operators import resolve as RS
from citeloom.plans.scholarly import _A, _DRAWN, _N, _drawn, _nodes
from citeloom.tables import table


def normalized_records(spark, d):
    raw = N.keep_latest(table(spark, d, "raw_payloads"), ["source", "source_id"], "fetched_unix", "payload")
    r = N.normalize(raw, "source", "source_id", "payload")
    return r.select("source", "source_id", "canonical_id", "title", "year", "venue", "doi", F.size("authors").alias("n_authors"), F.size("references").alias("n_references"))


def inverted_abstracts(spark, d):
    r = table(spark, d, "raw_payloads").filter("source = 'openalex'")
    v = F.try_variant_get(F.try_parse_json("payload"), "$.abstract_inverted_index", "map<string,array<int>>")
    return r.select("source_id", "fetched_unix", N.inverted_abstract(v).alias("abstract")).filter("abstract is not null").distinct()


def cache_keep_latest(spark, d):
    raw = N.keep_latest(table(spark, d, "raw_payloads"), ["source", "source_id"], "fetched_unix", "payload")
    return raw.select("source", "source_id", "fetched_unix", F.md5("payload").alias("payload_md5"))


def cache_validity(spark, d):
    r = table(spark, d, "raw_payloads")
    return r.select("source", N.parse_record(F.col("payload")).isNotNull().alias("valid")).groupBy("source", "valid").agg(F.count(F.lit(1)).alias("payloads"))


def citation_snippets(spark, d):
    return N.snippets(table(spark, d, "raw_payloads"))


def doc_identifiers(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", X.tail_first(t, X.DOI).alias("doi"), X.tail_first(t, X.ARXIV).alias("arxiv_id")).distinct()


def doc_reference_dois(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(X.all_dois(F.col("text"))).alias("doi")).distinct()


def doc_plain_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.strip_tags(F.col("text"))).alias("text_md5")).distinct()


def doc_headers(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.header(F.col("text"))).alias("header_md5")).distinct()


def doc_titles(spark, d):
    return table(spark, d, "documents").filter("kind = 'fulltext'").select("doc_id", X.guess_title(F.col("text")).alias("title")).distinct()


def identifiers_normalized(spark, d):
    n = _nodes(spark, d)
    return n.select("canonical_id", *[bare_id(F.col(c)).alias(c) for c in ("doi", "arxiv_id", "semantic_scholar_id", "openalex_id")], N.arxiv_year(bare_id(F.col("arxiv_id"))).alias("arxiv_year"))


def years_repaired(spark, d):
    """A missing or impossible year from the arXiv id, else the first year in the identifiers, venue or title."""
    n = _nodes(spark, d)
    blob = F.concat_ws(" ", "doi", "arxiv_id", "canonical_id", "venue", "title")
    found = F.nullif(F.regexp_extract(blob, r"(?:^|[^0-9])(19[89][0-9]|20[0-3][0-9])(?:[^0-9]|$)", 1), F.lit("")).cast("int")
    y = F.when(F.col("year").between(1950, 2026), F.col("year"))
    return n.select("canonical_id", F.coalesce(y, N.arxiv_year(bare_id(F.col("arxiv_id"))), found).alias("year"))


def author_overlap(spark, d):
    """Shared name words of records that share an identifier."""
    n = _nodes(spark, d)
    w = F.array_distinct(F.filter(F.flatten(F.transform(F.filter("authors", lambda a: a["name"].isNotNull()), lambda a: F.split(F.lower(a["name"]), "[^a-z]+"))), lambda t: F.length(t) >= 2))
    keys = n.select("canonical_id", F.coalesce(w, F.array().cast("array<string>")).alias("w"), F.explode(F.array_distinct(F.array_compact(F.array(*[bare_id(F.col(c)) for c in G.ID_COLUMNS])))).alias("key")).filter(F.length("key") > 4)
    p = keys.select("key", F.col("canonical_id").alias("a"), F.col("w").alias("wa")).join(keys.select("key", F.col("canonical_id").alias("b"), F.col("w").alias("wb")), "key").filter("a < b")
    return p.select("a", "b", F.size(F.array_intersect("wa", "wb")).alias("shared")).distinct()


def bibtex_entries(spark, d):
    n = _nodes(spark, d)
    esc = lambda c: X.bibtex_escape(F.trim(c))
    names = F.filter(F.transform("authors", lambda a: a["name"]), lambda x: F.coalesce(x, F.lit("")) != "")
    author = F.when(F.size(names) > 0, F.array_join(F.transform(names, X.bibtex_escape), " and ")).otherwise("Unknown")
    return n.select("canonical_id", X.cite_key(F.col("canonical_id")).alias("cite_key"), esc(F.coalesce("title", F.lit("Untitled"))).alias("title"), author.alias("author"))


def cache_keys(spark, d):
    return _nodes(spark, d).filter("title is not null").select("canonical_id", X.cache_key(F.col("title"), 40).alias("cache_key"))


def edge_styles(spark, d):
    c = F.lower(F.trim("confidence"))
    e = table(spark, d, "edges")
    style = F.when(c == "high", "solid").when(c == "medium", "solid").otherwise("dashed")
    width = F.when(c == "high", 1.0).otherwise(0.6)
    return e.groupBy(style.alias("style"), width.alias("width")).agg(F.count(F.lit(1)).alias("edges"))


def provenance_tiers(spark, d):
    """How often each source states each confidence for each field."""
    p = table(spark, d, "papers").select(F.explode("provenance").alias("p"))
    x = p.select(F.lower(F.trim("p.source")).alias("source"), F.explode("p.field_confidence").alias("field", "tier"))
    return x.groupBy("source", F.lower(F.trim("field")).alias("field"), F.lower(F.trim("tier")).alias("tier")).agg(F.count(F.lit(1)).alias("entries"))


def intent_cues(spark, d):
    n = _nodes(spark, d).filter("title is not null")
    return n.select("canonical_id", *[Q.hits(F.col("title"), c).alias(k) for k, c in Q.CUES.items()], Q.hardware_features(F.col("title")).alias("features"))


def intent_classify(spark, d):
    c = Q.classify(F.col("title"))
    return _nodes(spark, d).filter("title is not null").select("canonical_id", c["intent"].alias("intent"), c["confidence"].alias("confidence"))


def intent_distribution(spark, d):
    x = _nodes(spark, d).filter("title is not null").select("canonical_id", F.explode(Q.distribution(F.col("title"))).alias("intent", "share"))
    return x.select("canonical_id", "intent", F.round("share", 4).alias("share"))


def intent_entropy(spark, d):
    x = _nodes(spark, d).filter("title is not null").withColumn("dist", Q.distribution(F.col("title")))
    return x.select("canonical_id", F.round(S.entropy(F.col("dist")), 5).alias("entropy"), (F.array_max(F.map_values("dist")) < 0.52).alias("uncertain"))


def query_ambiguity(spark, d):
    return _nodes(spark, d).filter("title is not null").select("canonical_id", Q.registry_entry(F.col("title")).alias("entry"), F.round(Q.ambiguity(F.col("title")), 4).alias("ambiguity"))


def mixed_final_score(spark, d):
    """Fusion over the intents of each title, with fixed signals."""
    x = _nodes(spark, d).filter("title is not null").select("canonical_id", Q.distribution(F.col("title")).alias("dist"), Q.classify(F.col("title"))["intent"].alias("intent"))
    return x.select("canonical_id", F.round(S.final_score(F.lit(0.6), F.lit(0.4), F.lit(0.3), F.lit(0.58), F.col("intent"), F.col("dist")), 5).alias("final"))


def identifier_dedup(spark, d):
    return _merged(RS.merged_records(_nodes(spark, d), table(spark, d, "feedback")))


def work_dedup(spark, d):
    """The same with records of nearly equal titles taken for one work, too."""
    return _merged(RS.merged_records(_nodes(spark, d), table(spark, d, "feedback"), titles=True))


def _merged(m):
    return m.select("record_id", "members", "title", F.md5("abstract").alias("abstract_md5"), "venue", "doi", F.size("references").alias("n_references"))


def audit_quality(spark, d):
    return RS.audit_report(table(spark, d, "validation_audit"))


def feedback_latest(spark, d):
    return FB.latest(table(spark, d, "feedback"))


def feedback_window_counts(spark, d):
    return FB.window_counts(table(spark, d, "feedback"), "30 days").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


def eval_rank_metrics(spark, d):
    """Per query: works by number of drawn edges against the works with an edge of high confidence."""
    _, e = _drawn(spark, d)
    from pyspark.sql import Window

    e = e.filter("query_id is not null")
    c = e.groupBy("query_id", F.col("dst").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    ranked = c.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), "item")))
    rel = e.filter("lower(trim(confidence)) = 'high'").select("query_id", F.col("dst").alias("item"))
    m = E.rank_metrics(ranked, rel)
    return m.select("query_id", *[F.round(x, 6).alias(x) for x in ("p_at_5", "reciprocal_rank", "recall_at_10")])


def branch_balance(spark, d):
    """Per query: how evenly its works spread over domains."""
    n, e = _drawn(spark, d)
    x = e.filter("query_id is not null").select("query_id", F.col("dst").alias("canonical_id")).distinct().join(n.select("canonical_id", F.coalesce("domain", F.lit("unknown")).alias("domain")), "canonical_id")
    return E.entropy_of_sizes(x, "query_id", "domain").select("query_id", "groups", F.round("balance", 6).alias("balance"))


def retrieval_health(spark, d):
    n, e = _drawn(spark, d)
    return E.health(n, e)


def embedding_cosine_topk(spark, d):
    v = table(spark, d, "embeddings")
    return E.cosine_top_k(v, v.filter("vec_id % 100 = 0"))


QUERIES = {f.__name__: f for f in (
    normalized_records, inverted_abstracts, cache_keep_latest, cache_validity, citation_snippets, doc_identifiers, doc_reference_dois, doc_plain_text, doc_headers, doc_titles,
    identifiers_normalized, years_repaired, author_overlap, bibtex_entries, cache_keys, edge_styles, provenance_tiers, intent_cues, intent_classify, intent_distribution,
    intent_entropy, query_ambiguity, mixed_final_score, identifier_dedup, work_dedup, audit_quality, feedback_latest, feedback_window_counts, eval_rank_metrics, branch_balance,
    retrieval_health, embedding_cosine_topk,
)}

# --- SQL -----------------------------------------------------------------------------------------------------


def _hits(cues, q="lower(trim(title))") -> str:
    return "(" + " + ".join(f"(contains({q}, '{c}'))::int" for c in cues) + ")"


_WORDS = "list_filter(regexp_split_to_array(trim(title), '\\s+'), lambda w: w <> '')"
_FILL = "[" + ", ".join(f"'{w}'" for w in Q.FILLERS) + "]"
_INTENT = f"""{_N},
q as (select canonical_id, title, lower(trim(title)) as q, {_WORDS} as w, {', '.join(f'{_hits(c)} as {k}' for k, c in Q.CUES.items())},
  {_hits(tuple(f for f in Q.HARDWARE_FEATURES if f != 'parallel'))} + regexp_matches(lower(trim(title)), '\\bparallel\\b')::int as features,
  {_hits(tuple(c for c in Q.CUES['technical_method'] if c not in Q.CUES['hardware_system']))} as technical_only from n where title is not null),
p as (select *, len(w) as nw, comparison > 0 or regexp_matches(q, '\\b(and|or)\\b.*\\b(and|or)\\b') as is_cmp,
  len(list_filter(w, lambda x: list_contains({_FILL}, lower(x)))) as fill, len(list_filter(w, lambda x: regexp_matches(x, '^\\p{{Lu}}'))) as cap, len(list_filter(w, lambda x: length(x) > 40)) as longs from q),
r as (select *, hardware_system > 0 or features >= 2 as is_hw,
  case when nw = 0 or nw > 14 then false when nw <= 1 and length(trim(title)) <= 40 then true when q like '%?' then nw <= 10 else nw <= 10 and fill / greatest(nw, 1) < 0.45 end as ent,
  nw >= 2 and nw <= 12 and not is_cmp and definition = 0 and survey = 0 and (cap >= greatest(2, nw // 2) or (nw <= 6 and longs = 0)) as named from p),
i as (select *, case when is_cmp then 'comparison' when features >= 2 then 'hardware_system' when survey > 0 then 'survey' when recent_progress > 0 and ent then 'recent_progress'
  when historical_foundation > 0 and ent then 'historical_foundation' when is_hw then 'hardware_system' when technical_method > 0 and ent then 'technical_method' when definition > 0 and ent then 'definition'
  when named and ent then 'method_lookup' else 'exploratory' end as intent,
  case when is_cmp then 0.72 when features >= 2 then 0.9 when survey > 0 then 0.7 when recent_progress > 0 and ent then 0.68 when historical_foundation > 0 and ent then 0.7 when is_hw then 0.74
  when technical_method > 0 and ent then 0.66 when definition > 0 and ent then 0.8 when named and ent then 0.72 else 0.6 end::double as confidence from r)"""
_MASS = {
    k: f"({p} + {'technical_only' if k == 'technical_method' else k} * {Q.PER_CUE[k]})" if k in Q.PER_CUE else f"({p} + if(named, 0.25, 0.0))" if k == "method_lookup" else f"({p})" for k, p in Q.PRIOR.items()
}
_DIST = f"""{_INTENT},
m as (select canonical_id, intent as main, unnest([{', '.join(f"'{k}'" for k in _MASS)}]) as intent, unnest([{', '.join(f'({v})::double' for v in _MASS.values())}]) as mass from i),
dist as (select canonical_id, main, intent, mass / sum(mass) over (partition by canonical_id) as share from m)"""
_FUSED = "case when intent in ('hardware_system', 'technical_method', 'recent_progress') then 0.45 * 0.6 + 0.35 * 0.58 + 0.20 * 0.4 " + " ".join(f"when intent = '{k}' then {w[0]} * 0.6 + {w[1]} * 0.4 + {w[2]} * 0.3" for k, w in S.FUSION.items()) + " else 0.6 * 0.6 + 0.3 * 0.4 + 0.1 * 0.3 end::double"
_REG = "case " + " ".join(
    f"when (({_hits(p)} > 0)" + (f" or regexp_matches(lower(trim(title)), '{'|'.join(chr(92) + 'b' + w + chr(92) + 'b' for w in whole)}')" if whole else "") + ")" + (f" and {_hits(ex)} = 0" if ex else "") + f" then '{name}'" for name, p, whole, ex, _ in Q.REGISTRY
) + " end"
_AMB = "case entry " + " ".join(f"when '{name}' then {a}" for name, _, _, _, a in Q.REGISTRY) + " end"
_PAIRS = f"{_A}, p as (select distinct x.canonical_id as a, y.canonical_id as b from keys x join keys y on x.key = y.key and x.canonical_id < y.canonical_id where length(x.key) > 4)"
_NAMES = "list_distinct(list_filter(flatten(list_transform(list_filter({0}, lambda t: t.name is not null), lambda t: regexp_split_to_array(lower(t.name), '[^a-z]+'))), lambda w: length(w) >= 2))"
_DOI_RE = r"(?i)\b10\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]+\b"
_ARX_RE = r"\b[0-9]{4}\.[0-9]{4,5}\b"
_TAIL = "lower(coalesce(nullif(regexp_extract(right(text, 1000), '{0}'), ''), nullif(regexp_extract(text, '{0}'), '')))"
_AY = "case when {0} is null then null when {0} < 91 then 2000 + {0} else 1900 + {0} end"
_AYX = _AY.format(f"try_cast(coalesce(nullif(regexp_extract({bare_id_sql('arxiv_id')}, '^(\\d{{2}})\\d{{2}}\\.\\d{{4,5}}', 1), ''), nullif(regexp_extract({bare_id_sql('arxiv_id')}, '^[^/]+/(\\d{{2}})', 1), '')) as int)")
_STRIP = "nullif(trim(regexp_replace(regexp_replace({0}, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), '')"
_PRIO = "coalesce(list_max(list_transform(provenance, lambda p: case lower(trim(p.source)) when 'crossref' then 100 when 'openalex' then 80 when 'semantic_scholar' then 70 when 'arxiv' then 60 else 0 end)), 0)"
_IDS4 = " union ".join(f"select canonical_id, {bare_id_sql(c)} as key from n" for c in RS.KEYS)
_SW = "regexp_replace(regexp_replace({0}, '^\\s+', ''), '\\s+$', '')"
_DEDUP = f"""{_N},
ks as (select canonical_id, key from ({_IDS4}) where key is not null and length(key) > 4),
hint as (select least(l, r) as a, greatest(l, r) as b from (select {_SW.format('left_id')} as l, {_SW.format('right_id')} as r from feedback where event_type = 'merge_hint' and accepted) where l <> '' and r <> '' and l <> r),
refused as (select least(l, r) as a, greatest(l, r) as b from (select {_SW.format('left_id')} as l, {_SW.format('right_id')} as r from feedback where not accepted) where l <> '' and r <> '' and l <> r),
firsts as (select key, min(canonical_id) as a from ks group by 1),
lk as (select least(firsts.a, canonical_id) as a, greatest(firsts.a, canonical_id) as b from ks join firsts using (key) where firsts.a <> canonical_id union select a, b from hint),
links as (select distinct a, b from lk where (a, b) not in (select (a, b) from refused) and a in (select canonical_id from n) and b in (select canonical_id from n)),
sides as (select a, b from links union select b, a from links),
reach(node, other) as (select a, a from sides union select reach.node, sides.b from reach join sides on reach.other = sides.a),
lab as (select node as canonical_id, min(other) as label from reach group by 1),
g as (select n.*, coalesce(label, n.canonical_id) as label, {_PRIO} as p from n left join lab using (canonical_id)),
o as (select *, row_number() over (partition by label order by p desc, canonical_id) as rn from g)"""
_FIRST = "(list({0} order by rn) filter (where regexp_replace({0}, '\\s+', '', 'g') <> ''))[1]"
_NREC = f"""latest as (select source, source_id, payload as body from (select *, row_number() over (partition by source, source_id order by fetched_unix desc, payload desc) as rn from raw_payloads) where rn = 1),
qd as (select *, case when json_valid(body) and json_type(body) = 'VARCHAR' then body::json->>'$' else body end as t from latest),
vd as (select source, source_id, t::json as j from qd where case when json_valid(t) then json_type(t) in ('OBJECT', 'ARRAY') else false end),
fd as (select source, source_id, case when json_type(j) = 'ARRAY' then j->0 else j end as j from vd),
rec as (select lower(trim(source)) as source, source_id, case when json_type(j->'message') = 'OBJECT' then j->'message' when json_type(j->'results'->0) = 'OBJECT' then j->'results'->0 when json_type(j->'data') = 'OBJECT' then j->'data' else j end as v from fd where json_type(j) = 'OBJECT'),
x as (select *, case source when 'crossref' then {bare_id_sql("v->>'DOI'")} when 'openalex' then {bare_id_sql("v->>'doi'")} when 'semantic_scholar' then {bare_id_sql("v->'externalIds'->>'DOI'")} else coalesce({bare_id_sql("v->>'doi'")}, '10.48550/arxiv.' || lower(coalesce(v->>'id', 'unknown'))) end as doi,
  coalesce(nullif(v->'authorships', 'null'), nullif(v->'author', 'null'), nullif(v->'authors', 'null')) as au,
  case source when 'openalex' then nullif(v->'referenced_works', 'null') when 'crossref' then nullif(v->'reference', 'null') when 'semantic_scholar' then nullif(v->'references', 'null') end as rf from rec),
y as (select *, case when au is null then [] when json_type(au) = 'ARRAY' then au->'$[*]' else [au] end as aa, case when rf is null then [] when json_type(rf) = 'ARRAY' then rf->'$[*]' else [rf] end as rr from x)"""
_NAME = "coalesce(a->'author'->>'display_name', a->>'name', nullif(trim(concat_ws(' ', trim(a->>'given'), trim(a->>'family'))), ''), if(json_type(a) = 'VARCHAR', a->>'$', null))"

SQL = {
    "normalized_records": f"""with {_NREC}
select source, source_id, case source when 'openalex' then 'openalex:' || coalesce(split_part(v->>'id', '/', -1), 'unknown') when 'crossref' then 'doi:' || coalesce(doi, 'unknown') when 'arxiv' then 'arxiv:' || coalesce(v->>'id', 'unknown') else 's2:' || coalesce(v->>'paperId', 'unknown') end as canonical_id,
  coalesce(case when source = 'crossref' then coalesce(nullif({_SW.format("v->'title'->>0")}, ''), 'DOI:' || doi) else nullif({_SW.format("v->>'title'")}, '') end, 'untitled') as title,
  case when source = 'arxiv' then null else coalesce(try_cast(v->>'publication_year' as int), try_cast(v->'published-print'->'date-parts'->0->>0 as int), try_cast(v->>'year' as int)) end as year,
  case when source = 'arxiv' then 'arXiv' else coalesce(v->'host_venue'->>'display_name', nullif({_SW.format("v->'container-title'->>0")}, ''), v->>'venue') end as venue, doi,
  len(list_filter(list_transform(aa, lambda a: nullif({_SW.format(_NAME)}, '')), lambda t: t is not null))::int as n_authors,
  len(list_filter(list_transform(rr, lambda a: case source when 'openalex' then a->>'$' when 'crossref' then a->>'DOI' else a->>'paperId' end), lambda t: coalesce(t, '') <> ''))::int as n_references from y""",
    "inverted_abstracts": """with r as (select distinct source_id, fetched_unix, payload::json->'abstract_inverted_index' as j from raw_payloads where source = 'openalex' and case when json_valid(payload) then json_type(payload) = 'OBJECT' else false end),
k as (select source_id, fetched_unix, j, unnest(json_keys(j)) as w from r where json_type(j) = 'OBJECT'),
p as (select source_id, fetched_unix, w, unnest(map_extract(j::json::map(varchar, int[]), w)[1]) as pos from k)
select distinct source_id, fetched_unix, abstract from (select source_id, fetched_unix, string_agg(w, ' ' order by pos, w) as abstract from p group by 1, 2)""",
    "cache_keep_latest": "select source, source_id, fetched_unix, md5(payload) as payload_md5 from (select *, row_number() over (partition by source, source_id order by fetched_unix desc, payload desc) as rn from raw_payloads) where rn = 1",
    "cache_validity": """with q as (select source, case when json_valid(payload) and json_type(payload) = 'VARCHAR' then payload::json->>'$' else payload end as t from raw_payloads)
select source, coalesce(case when json_valid(t) then json_type(t) = 'OBJECT' or json_type(t::json->0) = 'OBJECT' else false end, false) as valid, count(*) as payloads from q group by 1, 2""",
    "doc_identifiers": f"select distinct doc_id, {_TAIL.format(_DOI_RE)} as doi, {_TAIL.format(_ARX_RE)} as arxiv_id from documents",
    "doc_reference_dois": f"select distinct doc_id, unnest(regexp_extract_all(lower(text), '{_DOI_RE}')) as doi from documents",
    "doc_plain_text": f"select distinct doc_id, md5({_STRIP.format('text')}) as text_md5 from documents",
    "doc_headers": """select distinct doc_id, md5(case when least(nullif(instr(lower(text), 'references'), 0), nullif(instr(lower(text), 'bibliography'), 0)) is null then substring(text, 1, 2500) else left(text, least(nullif(instr(lower(text), 'references'), 0), nullif(instr(lower(text), 'bibliography'), 0)) - 1) end) as header_md5 from documents""",
    "identifiers_normalized": f"with {_N} select canonical_id, {', '.join(f'{bare_id_sql(c)} as {c}' for c in ('doi', 'arxiv_id', 'semantic_scholar_id', 'openalex_id'))}, {_AYX} as arxiv_year from n",
    "years_repaired": f"""with {_N} select canonical_id, coalesce(case when year between 1950 and 2026 then year end, {_AYX}, try_cast(nullif(regexp_extract(concat_ws(' ', doi, arxiv_id, canonical_id, venue, title), '(?:^|[^0-9])(19[89][0-9]|20[0-3][0-9])(?:[^0-9]|$)', 1), '') as int)) as year from n""",
    "author_overlap": f"with {_PAIRS} select p.a, p.b, coalesce(len(list_intersect({_NAMES.format('x.authors')}, {_NAMES.format('y.authors')})), 0)::int as shared from p join n x on x.canonical_id = p.a join n y on y.canonical_id = p.b",
    "cache_keys": f"with {_N} select canonical_id, substring(sha256(lower(trim(title)) || '|top_k=40'), 1, 24) as cache_key from n where title is not null",
    "edge_styles": "select if(lower(trim(confidence)) in ('high', 'medium'), 'solid', 'dashed') as style, if(lower(trim(confidence)) = 'high', 1.0, 0.6)::double as width, count(*) as edges from edges group by 1, 2",
    "provenance_tiers": """with p as (select unnest(provenance) as p from papers), x as (select lower(trim(p.source)) as source, unnest(map_entries(p.field_confidence)) as e from p)
select source, lower(trim(e.key)) as field, lower(trim(e.value)) as tier, count(*) as entries from x group by 1, 2, 3""",
    "intent_cues": f"with {_INTENT} select canonical_id, {', '.join(Q.CUES)}, features from i",
    "intent_classify": f"with {_INTENT} select canonical_id, intent, confidence from i",
    "intent_distribution": f"with {_DIST} select canonical_id, intent, round(share, 4) as share from dist",
    "intent_entropy": f"with {_DIST} select canonical_id, round(-sum(share * ln(share + 1e-15)), 5) as entropy, max(share) < 0.52 as uncertain from dist group by 1",
    "query_ambiguity": f"""with {_N}, q as (select canonical_id, {_REG} as entry, len({_WORDS}) as nw from n where title is not null)
select canonical_id, entry, round(case when {_AMB} is null then if(nw <= 2, 0.45, 0.25) else least(1.0, {_AMB} + if(nw <= 2, 0.12, 0.0) + if(nw = 1, 0.08, 0.0)) end, 4)::double as ambiguity from q""",
    "mixed_final_score": f"""with {_DIST}, f as (select canonical_id, main, intent, share, {_FUSED} as fu from dist),
o as (select canonical_id, any_value(main) as main, max(share) as mx, sum(if(share >= 0.03, share * fu, 0)) / nullif(sum(if(share >= 0.03, share, 0)), 0) as mixed, max(if(intent = main, fu, null)) as one from f group by 1)
select canonical_id, round(if(mx < 0.52 and mixed is not null, mixed, one), 5) as final from o""",
    "identifier_dedup": f"""with recursive {_DEDUP}
select first(canonical_id order by rn) as record_id, count(*) as members, first(title order by rn) as title, md5({_FIRST.format('abstract')}) as abstract_md5, {_FIRST.format('venue')} as venue, {_FIRST.format('doi')} as doi,
  len(list_distinct(list_filter(flatten(list(coalesce("references", []))), lambda t: t is not null)))::int as n_references from o group by label""",
    "audit_quality": """with x as (select run_id, max(coalesce(len(merged_pairs), 0))::int as merged, max(coalesce(len(rejected_pairs), 0))::int as rejected, max(coalesce(len(conflict_log), 0))::int as conflicts from validation_audit group by 1)
select *, round(merged / greatest(1, merged + conflicts), 4)::double as precision_proxy, round(merged / greatest(1, merged + rejected + conflicts), 4)::double as recall_proxy from x""",
    "feedback_latest": f"""with x as (select event_type, {_SW.format('left_id')} as l, {_SW.format('right_id')} as r, accepted, created_at from feedback),
y as (select event_type, least(l, r) as a, greatest(l, r) as b, accepted, created_at, row_number() over (partition by event_type, least(l, r), greatest(l, r) order by created_at desc nulls last, accepted desc nulls last) as rn, count(*) over (partition by event_type, least(l, r), greatest(l, r)) as events from x where l <> '' and r <> '')
select event_type, a, b, accepted, strftime(created_at, '%Y-%m-%d %H:%M:%S') as decided_at, events from y where rn = 1""",
    "feedback_window_counts": f"""with x as (select distinct event_type, {_SW.format('left_id')} as l, {_SW.format('right_id')} as r, accepted, created_at from feedback where created_at is not null)
select strftime(time_bucket(interval '30 days', created_at, timestamp '1970-01-01'), '%Y-%m-%d %H:%M:%S') as window_start, event_type, count(*) as events, count(*) filter (where accepted) as accepted from x group by 1, 2""",
    "eval_rank_metrics": f"""with {_DRAWN}, c as (select query_id, dst, count(*) as n, max((lower(trim(confidence)) = 'high')::int) as rel from g where query_id is not null group by 1, 2),
r as (select *, row_number() over (partition by query_id order by n desc, dst) as k from c)
select query_id, round(count(*) filter (where k <= 5 and rel = 1) / least(5, count(*)), 6)::double as p_at_5, round(coalesce(1.0 / min(k) filter (where rel = 1), 0), 6)::double as reciprocal_rank, round(coalesce(count(*) filter (where k <= 10 and rel = 1) / nullif(sum(coalesce(rel, 0)), 0), 0), 6)::double as recall_at_10 from r group by 1""",
    "branch_balance": f"""with {_DRAWN}, x as (select distinct query_id, dst from g where query_id is not null), s as (select query_id, coalesce(domain, 'unknown') as domain, count(*) as n from x join n on canonical_id = dst group by 1, 2),
p as (select query_id, n / sum(n) over (partition by query_id) as p from s)
select query_id, count(*) as groups, round(case when count(*) > 1 then -sum(p * ln(p + 1e-9)) / ln(count(*)) else 0.5 end, 6)::double as balance from p group by 1""",
    "retrieval_health": f"""with {_DRAWN}, x as (select count(*) as papers, count(year) as y, count(*) filter (where coalesce(trim(title), '') <> '') as t, (select count(*) from g) as edges from n)
select papers, edges, round(edges / papers, 4)::double as density, round(0.5 * y / papers + 0.5 * t / papers, 4)::double as metadata_ratio, case when edges / papers >= 2.5 then 'Strong' when edges / papers >= 0.9 then 'Medium' else 'Low' end as citation_level,
  case when 0.5 * y / papers + 0.5 * t / papers >= 0.82 then 'Strong' when 0.5 * y / papers + 0.5 * t / papers >= 0.55 then 'Moderate' else 'Weak' end as metadata_level from x""",
    "embedding_cosine_topk": """with p as (select q.vec_id as query_id, a.vec_id as item, round(list_cosine_similarity(a.embedding::double[], q.embedding::double[]), 6) as cosine from embeddings a join embeddings q on q.vec_id % 100 = 0 and a.vec_id <> q.vec_id)
select query_id, item, cosine, rank::int as rank from (select *, row_number() over (partition by query_id order by cosine desc, item) as rank from p) where rank <= 10""",
    "citation_snippets": f"""with q as (select source_id, case when json_valid(payload) and json_type(payload) = 'VARCHAR' then payload::json->>'$' else payload end as t from raw_payloads where lower(trim(source)) = 'semantic_scholar'),
vd as (select source_id, t::json as j from q where case when json_valid(t) then json_type(t) in ('OBJECT', 'ARRAY') else false end),
fd as (select source_id, case when json_type(j) = 'ARRAY' then j->0 else j end as j from vd),
rec as (select {bare_id_sql('source_id')} as src, case when json_type(j->'message') = 'OBJECT' then j->'message' when json_type(j->'results'->0) = 'OBJECT' then j->'results'->0 when json_type(j->'data') = 'OBJECT' then j->'data' else j end as v from fd where json_type(j) = 'OBJECT'),
rf as (select src, case when json_type(v->'references') = 'ARRAY' then v->'references'->'$[*]' when json_type(v->'references') is null or json_type(v->'references') = 'NULL' then [] else [v->'references'] end as a from rec),
x as (select src, unnest(a) as r, unnest(range(len(a))) as pos from rf),
y as (select src, pos, {bare_id_sql("coalesce(r->>'paperId', r->'externalIds'->>'any')")} as ref_key, list_filter(list_transform(case when json_type(r->'contexts') = 'ARRAY' then r->'contexts'->'$[*]' else [] end, lambda c: nullif({_SW.format("c->>'$'")}, '')), lambda c: c is not null)[1] as context from x),
z as (select *, row_number() over (partition by src, ref_key order by pos, context) as rn from y where ref_key is not null and context is not null)
select src, ref_key, context from z where rn = 1""",
    "doc_titles": f"""with l as (select doc_id, list_slice(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), 1, 30) as ls from documents where kind = 'fulltext'),
x as (select doc_id, unnest(ls) as line, unnest(range(len(ls))) as i from l),
k as (select doc_id, line, least(length(line), 180) as n, i from x where length(line) between 12 and 220 and not regexp_matches(line, '^\\d{{4}}\\.\\d{{4,5}}') and not ({' or '.join(f"contains(lower(line), '{w}')" for w in X.NOISE)})),
b as (select doc_id, line from (select *, row_number() over (partition by doc_id order by n desc, i) as rn from k) where rn = 1)
select distinct d.doc_id, b.line as title from documents d left join b using (doc_id) where d.kind = 'fulltext'""",
    "bibtex_entries": f"""with {_N}, x as (select canonical_id, title, list_filter(list_transform(authors, lambda a: a.name), lambda t: coalesce(t, '') <> '') as names, regexp_replace(regexp_replace(regexp_replace(canonical_id, '[^0-9A-Za-z_]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') as k from n)
select canonical_id, left(if(k = '', 'entry', k), 80) as cite_key, regexp_replace(trim(coalesce(title, 'Untitled')), '([\\\\{{}}%])', '\\\\\\1', 'g') as title,
  case when len(names) > 0 then array_to_string(list_transform(names, lambda t: regexp_replace(t, '([\\\\{{}}%])', '\\\\\\1', 'g')), ' and ') else 'Unknown' end as author from x""",
}
