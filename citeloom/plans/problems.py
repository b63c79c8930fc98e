"""Queries of the general data-pipeline problems (3 and 4), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions.ids import bare_id_sql
from citeloom.operators import nested, orphans
from citeloom.tables import table

ID_COLUMNS = ("canonical_id", "doi", "arxiv_id", "semantic_scholar_id", "openalex_id")


def _fetches(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "raw_payloads").select(F.lit("raw_payloads").alias("origin"), "source", "source_id", F.col("payload").alias("body"), (F.col("fetched_unix") * 1_000_000).alias("at"))
    p = table(spark, d, "papers").select(F.explode("provenance").alias("p"))
    prov = p.select(F.lit("papers").alias("origin"), "p.source", "p.source_id", F.col("p.raw").alias("body"), F.unix_micros(F.col("p.fetched_at").cast("timestamp")).alias("at"))
    return raw.unionByName(prov)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per child object of the newest fetch of each record."""
    keys = ["origin", "source", "source_id"]
    return nested.child_rows(nested.newest_labels(_fetches(spark, d), keys, "body", "at"), keys)


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each flat table by origin, and the records they come from."""
    keys = ["origin", "source", "source_id"]
    nodes = nested.newest_labels(_fetches(spark, d), keys, "body", "at")
    return nodes.groupBy("origin", "path").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(F.struct("source", "source_id")).alias("records"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The references to works of which papers holds no record."""
    return orphans.orphan_references(*_refs(spark, d))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per table and month."""
    refs, parents = _refs(spark, d)
    return orphans.orphan_counts(orphans.orphan_references(refs, parents), refs)


def _refs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    papers = table(spark, d, "papers")
    refs = orphans.edge_references(table(spark, d, "edges")).unionByName(orphans.paper_references(papers))
    return refs, orphans.parent_keys(papers, ID_COLUMNS)


QUERIES = {"p3_found": p3_found, "p3_counts": p3_counts, "p4_found": p4_found, "p4_report": p4_report}

_KEYS = " union ".join(f"select {bare_id_sql(c)} as key from papers" for c in ID_COLUMNS)
_REFS = f"""refs as (
  select distinct table_name, period, source_id, ref_id, {bare_id_sql('ref_id')} as key from (
    select 'edges' as table_name, strftime(created_at, '%Y-%m') as period, source_paper_id as source_id, target_paper_id as ref_id from edges
    union all
    select 'papers', strftime(list_min(list_transform(provenance, lambda p: p.fetched_at)), '%Y-%m'), canonical_id, unnest("references") from papers)
  where regexp_replace(ref_id, '\\s+', '', 'g') <> ''),
known as (select distinct key from ({_KEYS}) where key is not null),
orphans as (select table_name, period, source_id, ref_id from refs where key is null or key not in (select key from known))"""

_P3 = """with fetches as (
  select 'raw_payloads' as origin, source, source_id, payload as body, fetched_unix * 1000000 as ts from raw_payloads
  union all
  select 'papers', p.source, p.source_id, p.raw, epoch_us(p.fetched_at) from (select unnest(provenance) as p from papers)),
quoted as (select *, case when json_valid(body) and json_type(body) = 'VARCHAR' then body::json->>'$' else body end as t from fetches),
valid as (select origin, source, source_id, ts, body, t::json as j from quoted where case when json_valid(t) then json_type(t) in ('OBJECT', 'ARRAY') else false end),
first as (select origin, source, source_id, ts, body, case when json_type(j) = 'ARRAY' then j->0 else j end as j from valid),
objects as (select *, row_number() over (partition by origin, source, source_id order by ts desc, body desc) as rn from first where json_type(j) = 'OBJECT'),
rec as (select origin, source, source_id,
  case when json_type(j->'message') = 'OBJECT' then j->'message' when json_type(j->'results'->0) = 'OBJECT' then j->'results'->0
       when json_type(j->'data') = 'OBJECT' then j->'data' else j end as j from objects where rn = 1),
tops as (select origin, source, source_id, unnest(['author', 'reference', 'funder']) as child, unnest([
  coalesce(nullif(j->'authorships', 'null'), nullif(j->'author', 'null'), nullif(j->'authors', 'null')),
  coalesce(nullif(j->'referenced_works', 'null'), nullif(j->'reference', 'null'), nullif(j->'references', 'null')),
  coalesce(nullif(j->'grants', 'null'), nullif(j->'funder', 'null'))]) as v from rec),
arrays as (select origin, source, source_id, child, case when json_type(v) = 'ARRAY' then v->'$[*]' else [v] end as a from tops where v is not null),
lvl1 as (select origin, source, source_id, child, unnest(range(len(a))) as i, unnest(a) as v from arrays),
nodes1 as (select * from lvl1 where v is not null and json_type(v) <> 'NULL'),
subs as (select origin, source, source_id, if(child = 'author', 'affiliation', 'award') as child, i, case when child = 'author'
  then coalesce(nullif(v->'institutions', 'null'), nullif(v->'affiliation', 'null'), nullif(v->'affiliations', 'null'))
  else coalesce(nullif(v->'award_ids', 'null'), nullif(v->'award', 'null')) end as v from nodes1 where child <> 'reference' and json_type(v) = 'OBJECT'),
arrays2 as (select origin, source, source_id, child, i, case when json_type(v) = 'ARRAY' then v->'$[*]' else [v] end as a from subs where v is not null),
lvl2 as (select origin, source, source_id, child, i, unnest(range(len(a))) as k, unnest(a) as v from arrays2),
found as (select origin, source, source_id, child, -1::int as parent_no, i::int as child_no from nodes1
  union all select origin, source, source_id, child, i::int, k::int from lvl2 where v is not null and json_type(v) <> 'NULL')
"""

SQL = {
    "p3_found": _P3 + "select * from found",
    "p3_counts": _P3 + "select origin, case child when 'affiliation' then 'author/affiliation' when 'award' then 'funder/award' else child end as path, count(*) as n_rows, count(distinct (source, source_id)) as records from found group by 1, 2",
    "p4_found": f"with {_REFS} select * from orphans",
    "p4_report": f"""with {_REFS},
r as (select table_name, period, count(*) as refs from refs group by 1, 2),
o as (select table_name, period, count(*) as orphans, count(distinct ref_id) as orphan_values from orphans group by 1, 2)
select r.table_name, r.period, r.refs, coalesce(o.orphans, 0) as orphans, coalesce(o.orphan_values, 0) as orphan_values, coalesce(o.orphans, 0) / r.refs as orphan_share
from r left join o on r.table_name = o.table_name and r.period is not distinct from o.period""",
}
