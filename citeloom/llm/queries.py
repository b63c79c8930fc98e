"""Queries of the training-data problems, with the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions.ids import bare_id_sql
from citeloom.llm import components, cooccurrence, matching, names, packing, subjects, survivors, tokens
from citeloom.staging import Stage
from citeloom.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """One group identifier for every record id that decisions link, directly or through others."""
    links = components.accepted_links(table(spark, d, "feedback"), table(spark, d, "validation_audit"))
    return components.connected_components(links)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of author entries that name the same person or organisation."""
    return names.variant_pairs(table(spark, d, "authors"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of records that describe the same work."""
    return matching.match(table(spark, d, "papers")).select("left_id", "right_id")


def p5_confidence(spark: SparkSession, d: str) -> DataFrame:
    """The same pairs with their marginal probabilities."""
    return matching.match(table(spark, d, "papers")).withColumnRenamed("p", "confidence")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of references that appear together at least five times and eight times as often as chance."""
    return cooccurrence.lifted_pairs(table(spark, d, "papers")).select("item_a", "item_b")


def p6_scores(spark: SparkSession, d: str) -> DataFrame:
    """The same pairs with their counts and lift."""
    return cooccurrence.lifted_pairs(table(spark, d, "papers"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The record whose abstract, venue and year the survivor of each group keeps, each a bundle of its own."""
    m = survivors.members(p1_found(spark, d), table(spark, d, "papers"))
    best = survivors.best_bundles(m, {"abstract": ("abstract",), "venue": ("venue",), "year": ("year",)})
    return best.select("group_id", F.col("bundle").alias("field_name"), "record_id")


def p7_bundles(spark: SparkSession, d: str) -> DataFrame:
    """Survivors with venue and year as one bundle, which must be one that the abstract's value is found with."""
    m = survivors.members(p1_found(spark, d), table(spark, d, "papers"))
    return survivors.best_bundles(m, {"abstract": ("abstract",), "published": ("venue", "year")}, [("abstract", "published")])


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """The token ids of every document."""
    return tokens.encode(table(spark, d, "documents"))


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Texts decoded from their ids, beside the documents: how many come back unchanged, by kind."""
    docs = table(spark, d, "documents").select("doc_id", "kind", "text")
    back = tokens.decode(tokens.encode(docs)).withColumnRenamed("text", "back")
    same = F.col("back") == F.coalesce("text", F.lit(""))
    return docs.join(back, "doc_id").groupBy("kind").agg(F.count(F.lit(1)).alias("docs"), F.count_if(same).alias("unchanged"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of each document for each context window."""
    stage = Stage(spark, "sizes")
    sized = tokens.sizes(table(spark, d, "documents"), stage)
    windows = [(r[0], r[1]) for r in table(spark, d, "context_windows").select("window_name", "capacity_tokens").distinct().orderBy("window_name").collect()]  # never grows
    return packing.pack(sized, windows)


def _subject_names(spark: SparkSession, d: str) -> list[str]:
    return [r[0] for r in table(spark, d, "subjects").select("subject").distinct().orderBy("subject").collect()]  # never grows


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """The subjects each document is about."""
    return subjects.subjects_of(table(spark, d, "documents"), table(spark, d, "subject_labels"), _subject_names(spark, d))


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents by subject, with the sum of the posteriors as their expected number."""
    p = subjects.classify(table(spark, d, "documents"), table(spark, d, "subject_labels"), _subject_names(spark, d))
    return p.groupBy("subject").agg(F.count_if(F.col("p") >= 0.5).alias("docs"), F.sum("p").alias("expected"))


def p2_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What p2_found must not hold: pairs out of order or repeated, unknown entries, and groups of which a pair is missing (two of a pair with different numbers of partners)."""
    p = Stage(spark, "invariants").put(p2_found(spark, d))
    ends = p.select(F.col("author_no_a").alias("n")).unionByName(p.select(F.col("author_no_b").alias("n"))).groupBy("n").agg(F.count(F.lit(1)).alias("k"))
    unknown = ends.join(table(spark, d, "authors").select(F.col("author_no").alias("n")), "n", "left_anti").agg(F.count(F.lit(1)).alias("unknown"))
    open_ = p.join(ends.select(F.col("n").alias("author_no_a"), F.col("k").alias("ka")), "author_no_a").join(ends.select(F.col("n").alias("author_no_b"), F.col("k").alias("kb")), "author_no_b")
    order = p.agg(F.count_if(F.col("author_no_a") >= F.col("author_no_b")).alias("disordered"), (F.count(F.lit(1)) - F.count_distinct("author_no_a", "author_no_b")).alias("repeated"))
    return order.crossJoin(unknown).crossJoin(open_.agg(F.count_if(F.col("ka") != F.col("kb")).alias("open")))  # three single rows


def p5_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What p5_confidence must not hold: pairs out of order or repeated, unknown records, confidences outside 0.5 to 1."""
    p = Stage(spark, "invariants").put(p5_confidence(spark, d))
    ids = table(spark, d, "papers").select(F.col("canonical_id").alias("id")).distinct()
    ends = p.select(F.col("left_id").alias("id")).unionByName(p.select(F.col("right_id").alias("id"))).distinct()
    unknown = ends.join(ids, "id", "left_anti").agg(F.count(F.lit(1)).alias("unknown"))
    return p.agg(F.count_if(F.col("left_id") >= F.col("right_id")).alias("disordered"), (F.count(F.lit(1)) - F.count_distinct("left_id", "right_id")).alias("repeated"), F.count_if(~F.col("confidence").between(0.5, 1.0)).alias("outside")).crossJoin(unknown)


def p9_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Per window: documents placed, containers above the capacity, documents split although they fit, tokens lost."""
    stage = Stage(spark, "invariants")
    placed = stage.put(p9_containers(spark, d))
    capacity = table(spark, d, "context_windows").select("window_name", "capacity_tokens").distinct()
    tokens_ = tokens.sizes(table(spark, d, "documents"), Stage(spark, "sizes")).agg(F.sum("n_tokens").alias("all"))
    full = placed.groupBy("window_name", "container_no").agg(F.sum("piece_tokens").alias("t")).join(F.broadcast(capacity), "window_name").groupBy("window_name").agg(F.count_if(F.col("t") > F.col("capacity_tokens")).alias("overfull"))
    docs = placed.groupBy("window_name", "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("piece_tokens").alias("t")).join(F.broadcast(capacity), "window_name")
    docs = docs.groupBy("window_name").agg(F.count("doc_id").alias("documents"), F.count_if((F.col("pieces") > 1) & (F.col("t") <= F.col("capacity_tokens"))).alias("split"), F.sum("t").alias("t"))
    return docs.join(full, "window_name").crossJoin(F.broadcast(tokens_)).select("window_name", "documents", "overfull", "split", (F.col("all") - F.col("t")).alias("lost"))


def p10_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What p10_found must not hold: unknown subjects, repeated rows, documents that are unknown, blank or null."""
    p = Stage(spark, "invariants").put(p10_found(spark, d))
    told = table(spark, d, "documents").filter("trim(text) <> ''").select("doc_id").distinct()
    bare = p.select("doc_id").distinct().join(told, "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("bare"))
    return p.agg(F.count_if(~F.col("subject").isin(_subject_names(spark, d))).alias("unknown"), (F.count(F.lit(1)) - F.count_distinct("doc_id", "subject")).alias("repeated")).crossJoin(bare)


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p5_found": p5_found, "p5_confidence": p5_confidence, "p6_found": p6_found, "p6_scores": p6_scores, "p7_found": p7_found, "p7_bundles": p7_bundles, "p8_ids": p8_ids, "p8_round_trip": p8_round_trip, "p9_containers": p9_containers, "p10_found": p10_found, "p10_composition": p10_composition, "p2_invariants": p2_invariants, "p5_invariants": p5_invariants, "p9_invariants": p9_invariants, "p10_invariants": p10_invariants}

_STRIP = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"
_P1 = f"""with recursive pairs as (
  select {_STRIP.format('left_id')} as l, {_STRIP.format('right_id')} as r, accepted, created_at from feedback where lower(trim(event_type)) = 'merge_hint'),
hints as (select least(l, r) as a, greatest(l, r) as b, accepted, created_at from pairs where l <> '' and r <> '' and l <> r),
latest as (select a, b, accepted, row_number() over (partition by a, b order by created_at desc nulls last, accepted desc nulls last) as rn from hints),
merged as (select {_STRIP.format('p.left_id')} as l, {_STRIP.format('p.right_id')} as r from (select unnest(merged_pairs) as p from validation_audit)),
links as (select a, b from latest where rn = 1 and accepted union select least(l, r), greatest(l, r) from merged where l <> '' and r <> '' and l <> r),
sides as (select a, b from links union select b, a from links),
reach(node, other) as (select a, a from sides union select reach.node, sides.b from reach join sides on reach.other = sides.a)
"""
_P6 = f"""with items as (
  select distinct basket, {bare_id_sql('ref')} as item from (select canonical_id as basket, unnest("references") as ref from papers) where {bare_id_sql('ref')} is not null),
n as (select item, count(*) as n from items group by 1),
total as (select count(distinct canonical_id) as n from papers),
pairs as (select a.item as item_a, b.item as item_b, count(*) as n_ab from items a join items b on a.basket = b.basket and a.item < b.item group by 1, 2 having count(*) >= 5),
scored as (select item_a, item_b, x.n as n_a, y.n as n_b, n_ab, n_ab * total.n / (x.n * y.n) as lift
  from pairs join n x on x.item = item_a join n y on y.item = item_b, total where n_ab * total.n >= 8 * x.n * y.n)
"""

_STAND = "[" + ", ".join(f"'{x}'" for x in survivors.STAND_INS) + "]"
_PLAIN = r"trim(regexp_replace(regexp_replace(lower({0}), '<[^>]*>|&amp;|\\[a-z]+', ' ', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
_NO_MARKS = r"regexp_replace(regexp_replace(lower({0}), '^[\s\p{{P}}]+', ''), '[\s\p{{P}}]+$', '')"
_TOLD = "({0} is not null and regexp_replace({0}, '\\s+', '', 'g') <> '' and " + _NO_MARKS.replace("{0}", "{0}") + " <> '' and not list_contains(" + _STAND.replace("{", "{{").replace("}", "}}") + ", " + _NO_MARKS.replace("{0}", "{0}") + "))"
_A, _T = _PLAIN.format("abstract"), _PLAIN.format("coalesce(title, '')")
_WHOLE = r"(not regexp_matches(regexp_replace(abstract, '(?:</?[a-z:]+>|\s)+$', ''), '(?:\.\.|…|\[\s*\.*\s*\])$') and regexp_matches(regexp_replace(abstract, '(?:</?[a-z:]+>|\s)+$', ''), '[.!?。！？][\x22''”’»)\]]*$'))"
_SAME = f"(length({_T}) > 0 and ({_A} = {_T} or (abs(length({_A}) - length({_T})) <= length({_T}) * 0.15 and levenshtein(left({_A}, 400), left({_T}, 400)) <= length({_T}) * 0.15)))"
_RANK = "case lower(trim({0})) when 'high' then 3 when 'medium' then 2 when 'low' then 1 else 0 end"
_CONF = "coalesce(list_max(list_transform(provenance, lambda p: coalesce(list_max(list_transform(map_entries(p.field_confidence), lambda e: if(lower(trim(e.key)) = '{0}', " + _RANK.format("e.value") + ", 0))), 0))), 0)"
_SRC = "case lower(trim({0})) when 'crossref' then 4 when 'openalex' then 3 when 'semantic_scholar' then 2 when 'arxiv' then 1 else 0 end"
_P7 = _P1 + f""", grp as (select min(other) as group_id, node as record_id from reach group by node),
n as (select * exclude (rn) from (select *, row_number() over (partition by canonical_id order by pos nulls last) as rn from papers where canonical_id is not null) where rn = 1),
m as (select grp.group_id, n.*, count(*) over (partition by grp.group_id) as members, list_max(list_transform(provenance, lambda p: p.fetched_at)) as newest,
  coalesce(nullif(coalesce(list_max(list_transform(provenance, lambda p: {_SRC.format('p.source')})), 0), 0), {_SRC.format("replace(split_part(canonical_id, ':', 1), 'doi', 'crossref')")}) as src from grp join n on n.canonical_id = grp.record_id),
c as (select group_id, 'abstract' as field_name, canonical_id as record_id, {_CONF.format('abstract')} as conf, src, newest from m where members > 1 and {_TOLD.format('abstract')} and {_WHOLE} and not {_SAME}
  union all select group_id, 'venue', canonical_id, {_CONF.format('venue')}, src, newest from m where members > 1 and {_TOLD.format('venue')}
  union all select group_id, 'year', canonical_id, {_CONF.format('year')}, src, newest from m where members > 1 and year between 1950 and 2026)
"""

_P7_BUNDLES = _P7 + f""", b as (select group_id, 0 as i, abstract as v, canonical_id as record_id, {_CONF.format('abstract')} + 1 as c1, src as c2, coalesce(greatest(epoch_us(newest), 0) + 1, 0) as c3
    from m where members > 1 and {_TOLD.format('abstract')} and {_WHOLE} and not {_SAME}
  union all select group_id, 1, venue || chr(1) || year, canonical_id, least({_CONF.format('venue')}, {_CONF.format('year')}) + 1, src, coalesce(greatest(epoch_us(newest), 0) + 1, 0)
    from m where members > 1 and {_TOLD.format('venue')} and year between 1950 and 2026),
v as (select * from (select *, row_number() over (partition by group_id, i, v order by c1 desc, c2 desc, c3 desc, record_id) as rn from b) where rn = 1),
held as (select distinct x.group_id, x.v as vx, y.v as vy from b x join b y on x.group_id = y.group_id and x.record_id = y.record_id and x.i = 0 and y.i = 1),
x as (select * from v where i = 0), y as (select * from v where i = 1),
choices as (
  select x.group_id, x.record_id as rx, y.record_id as ry, x.c1 + y.c1 as c1, x.c2 + y.c2 as c2, x.c3 + y.c3 as c3 from x join y on x.group_id = y.group_id
    where exists (select 1 from held h where h.group_id = x.group_id and h.vx = x.v and h.vy = y.v) or not exists (select 1 from held h where h.group_id = x.group_id and h.vx = x.v)
  union all select group_id, record_id, null, c1, c2, c3 from x
  union all select group_id, null, record_id, c1, c2, c3 from y),
best as (select * from (select *, row_number() over (partition by group_id order by c1 desc, c2 desc, c3 desc, rx nulls last, ry nulls last) as rn from choices) where rn = 1)
"""

SQL = {
    "p2_invariants": "select 0 as disordered, 0 as repeated, 0 as unknown, 0 as open",
    "p5_invariants": "select 0 as disordered, 0 as repeated, 0 as outside, 0 as unknown",
    "p9_invariants": "select window_name, (select count(distinct doc_id) from documents) as documents, 0 as overfull, 0 as split, 0 as lost from (select distinct window_name from context_windows)",
    "p10_invariants": "select 0 as unknown, 0 as repeated, 0 as bare",
    "p8_round_trip": "select kind, count(*) as docs, count(*) as unchanged from documents group by kind",
    "p7_bundles": _P7_BUNDLES + "select group_id, 'abstract' as bundle, rx as record_id from best where rx is not null union all select group_id, 'published', ry from best where ry is not null",
    "p1_found": _P1 + "select min(other) as group_id, node as record_id from reach group by node",
    "p7_found": _P7 + "select group_id, field_name, record_id from (select *, row_number() over (partition by group_id, field_name order by conf desc, src desc, newest desc nulls last, record_id) as rn from c) where rn = 1",
    "p6_found": _P6 + "select item_a, item_b from scored",
    "p6_scores": _P6 + "select * from scored",
}
