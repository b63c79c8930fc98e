"""Branches of a result, what holds them together, and what the result shows of each paper."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Members of a branch that are shown and compared with each other.
SHOWN = 12


def members(results: DataFrame, key: str, branch: str, score: str) -> DataFrame:
    """``results`` with ``branch_rank`` (best score first, the smaller id among equals) and ``branch_size``."""
    w = Window.partitionBy(key, branch).orderBy(F.desc_nulls_last(score), "canonical_id")
    size = results.groupBy(key, branch).agg(F.count(F.lit(1)).alias("branch_size"))
    return results.withColumn("branch_rank", F.row_number().over(w)).join(size, [key, branch])


def shown(m: DataFrame, k: int = SHOWN) -> DataFrame:
    """The first ``k`` members of each branch: the filter on the rank becomes a limit before the shuffle."""
    return m.filter(F.col("branch_rank") <= k)


def title_words(title: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]+"), lambda t: t != ""))


def coherence(m: DataFrame, key: str, branch: str) -> DataFrame:
    """(key, branch, coherence): mean token overlap of the shown members' titles, pair by pair; 0.5 for a single member."""
    s = shown(m).select(key, branch, "branch_rank", title_words(F.col("title")).alias("w"))
    a, b = s.withColumnRenamed("w", "wa").withColumnRenamed("branch_rank", "ra"), s.withColumnRenamed("w", "wb").withColumnRenamed("branch_rank", "rb")
    u = F.size(F.array_union("wa", "wb"))
    j = a.join(b, [key, branch]).filter("ra < rb").groupBy(key, branch).agg(F.avg(F.size(F.array_intersect("wa", "wb")) / F.greatest(u, F.lit(1))).alias("c"))
    return s.select(key, branch).distinct().join(j, [key, branch], "left").select(key, branch, F.coalesce("c", F.lit(0.5)).alias("coherence"))


def labels(m: DataFrame, key: str, branch: str, stop: tuple[str, ...], words: int = 3) -> DataFrame:
    """(key, branch, label): the words most members' titles hold, by count and then alphabet."""
    t = m.select(key, branch, F.explode(F.filter(title_words(F.col("title")), lambda w: (F.length(w) >= 4) & ~w.isin(*stop))).alias("w"))
    c = t.groupBy(key, branch, "w").agg(F.count(F.lit(1)).alias("n"))
    r = c.withColumn("r", F.row_number().over(Window.partitionBy(key, branch).orderBy(F.desc("n"), "w"))).filter(F.col("r") <= words)
    return r.groupBy(key, branch).agg(F.array_sort(F.collect_list(F.struct("r", "w"))).alias("l")).select(key, branch, F.array_join(F.transform("l", lambda x: F.initcap(x["w"])), " ").alias("label"))


def summary(m: DataFrame, key: str, branch: str, score: str) -> DataFrame:
    """(key, branch, size, central, purity): the best member and the mean score, cut where generic titles abound."""
    generic = F.lower("title").rlike("survey of|overview of|review of|state of the art|benchmark|dataset")
    first = F.when(F.col("branch_rank") == 1, F.col("canonical_id"))
    g = m.groupBy(key, branch).agg(F.max("branch_size").alias("size"), F.max(first).alias("central"), F.avg(score).alias("s"), F.avg(F.coalesce(generic, F.lit(False)).cast("double")).alias("g"))
    return g.select(key, branch, "size", "central", F.when(F.col("size") < 2, 1.0).otherwise(F.col("s") * (1 - 0.5 * F.col("g"))).alias("purity"))


def bridges(edges: DataFrame, member: DataFrame, key: str, branch: str) -> DataFrame:
    """(key, left, right, edges), left < right: citations between two branches of one result."""
    of = lambda end, name: member.select(key, F.col("canonical_id").alias(end), F.col(branch).alias(name))
    e = edges.join(of("src", "x"), [key, "src"]).join(of("dst", "y"), [key, "dst"]).filter("x <> y")
    return e.groupBy(key, F.least("x", "y").alias("left"), F.greatest("x", "y").alias("right")).agg(F.count(F.lit(1)).alias("edges"))


def neighbours(edges: DataFrame, titles: DataFrame, k: int = 5) -> DataFrame:
    """(src, rank, dst, title): the first ``k`` cited works of each paper with their titles."""
    w = Window.partitionBy("src").orderBy("ref_pos", "dst")
    top = edges.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return top.join(titles.select(F.col("canonical_id").alias("dst"), "title"), "dst").select("src", "rank", "dst", "title")


def seed_union(*sources: DataFrame) -> DataFrame:
    """(key, source, pos): seeds of several sources without repeats; an earlier source wins, then the earlier position.

    Each source holds (key, source, pos) and its place in the call is its priority.
    """
    out = None
    for i, s in enumerate(sources):
        x = s.select(F.lower(F.trim("key")).alias("key"), "source", "pos", F.lit(i).alias("p")).filter("key is not null and key <> ''")
        out = x if out is None else out.unionByName(x)
    return out.groupBy("key").agg(F.min(F.struct("p", "pos", "source")).alias("m")).select("key", F.col("m.source").alias("source"), F.col("m.pos").alias("pos"))


def placeholders(refs: DataFrame) -> DataFrame:
    """(canonical_id, title, previous): a stand-in record for each missing reference, each pointing to the one before among its paper's.

    ``refs`` holds (src, ref_pos, key) of references that no record answers to.
    """
    w = Window.partitionBy("src").orderBy("ref_pos", "key")
    x = refs.withColumn("previous", F.lag("key").over(w))
    return x.groupBy("key").agg(F.min(F.struct("src", "ref_pos", "previous")).alias("m")).select(F.col("key").alias("canonical_id"), F.concat(F.lit("Pending metadata: "), "key").alias("title"), F.col("m.previous").alias("previous"))


def reasons(semantic: Column, inbound: Column, relation: Column, anchor: Column) -> Column:
    """Why a paper is in the result, as codes."""
    found = F.array_compact(F.array(F.when(semantic >= 0.45, F.lit("query_match")), F.when(inbound >= 8, F.lit("highly_cited")), F.when(relation >= 0.35, F.lit("related_to_anchors")), F.when(anchor, F.lit("anchor"))))
    return F.when(F.size(found) == 0, F.array(F.lit("pool"))).otherwise(found)


def tier(coherence_: Column) -> Column:
    return F.when(coherence_ >= 0.62, "core").when(coherence_ >= 0.45, "near_core").otherwise("peripheral")


def polar(rank: Column, ring: int = 7, inner: float = 70.0, step: float = 55.0) -> tuple[Column, Column]:
    """x and y of a rank on rings of ``ring`` places around the first."""
    i = rank - 2
    r = F.lit(inner) + F.floor(i / ring) * step
    angle = 2 * 3.141592653589793 * (i % ring) / ring
    return F.when(rank == 1, 0.0).otherwise(r * F.cos(angle)), F.when(rank == 1, 0.0).otherwise(r * F.sin(angle))


def greedy_cap(files: DataFrame, limit: int) -> DataFrame:
    """(key, name, size, kept): per key in order of ``pos``, a file is kept if it still fits; later smaller ones may.

    Order matters, so each key's sizes are folded once in order; names and sizes of
    one project's files fit a row.
    """
    g = files.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "size"))).alias("l"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<boolean>").alias("kept"))

    def step(a: Column, x: Column) -> Column:
        fits = a["used"] + x["size"] <= limit
        return F.struct(F.when(fits, a["used"] + x["size"]).otherwise(a["used"]).alias("used"), F.concat(a["kept"], F.array(fits)).alias("kept"))

    folded = g.select("key", "l", F.aggregate("l", start, step).alias("f"))
    return folded.select("key", F.explode(F.arrays_zip("l", "f.kept")).alias("z")).select("key", "z.l.name", "z.l.size", "z.kept")


def purity_report(m: DataFrame, key: str, branch: str) -> DataFrame:
    """(key, branch, score, level, match, contamination, theme): how far a branch's members treat the query.

    Members carry ``matches`` (boolean), ``topical`` and ``purity`` (0..1) and
    ``themes`` (names of strange themes they hold).  The most frequent theme, the first
    by name among equals, is what the branch is contaminated with.
    """
    one = m.groupBy(key, branch).agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce("matches", F.lit(False)).cast("double")).alias("match"), F.avg("topical").alias("t"), F.avg("purity").alias("p"))
    t = m.select(key, branch, F.explode(F.array_distinct("themes")).alias("theme")).groupBy(key, branch, "theme").agg(F.count(F.lit(1)).alias("k"))
    worst = t.groupBy(key, branch).agg(F.max("k").alias("k"), F.min_by("theme", F.struct((-F.col("k")).alias("a"), "theme")).alias("theme"))
    x = one.join(worst, [key, branch], "left").withColumn("contamination", F.coalesce(F.col("k") / F.col("n"), F.lit(0.0)))
    raw = 0.45 * F.col("match") + 0.35 * F.col("t") + 0.20 * F.col("p") - 0.55 * F.col("contamination") - F.when(F.col("match") < 0.25, 0.2).otherwise(0.0)
    x = x.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))
    level = F.when(F.col("score") >= 0.55, "high").when(F.col("score") >= 0.38, "medium").otherwise("low")
    return x.select(key, branch, F.round("score", 4).alias("score"), level.alias("level"), F.round("match", 4).alias("match"), F.round("contamination", 4).alias("contamination"), "theme")


def voted_labels(m: DataFrame, key: str, branch: str, query: Column, stop: tuple[str, ...], words: int = 3) -> DataFrame:
    """(key, branch, label): the words that query (three votes each) and titles (two for a word of the query, else one) vote for.

    Equal votes go by alphabet.  Without any word the branch is 'Query-aligned cluster'.
    """
    found = lambda c: F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[a-z][a-z0-9\-]{3,}"), F.lit(0)), lambda w: ~w.isin(*stop))
    t = m.select(key, branch, query.alias("_q"), F.explode(found(F.col("title"))).alias("w")).select(key, branch, "w", F.when(F.contains(F.lower("_q"), F.col("w")), 2).otherwise(1).alias("v"))
    q = m.select(key, branch, query.alias("_q")).distinct().select(key, branch, F.explode(found(F.col("_q"))).alias("w"), F.lit(3).alias("v"))
    c = t.unionByName(q).groupBy(key, branch, "w").agg(F.sum("v").alias("v"))
    r = c.withColumn("r", F.row_number().over(Window.partitionBy(key, branch).orderBy(F.desc("v"), "w"))).filter(F.col("r") <= words)
    l = r.groupBy(key, branch).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "w"))), lambda x: F.initcap(x["w"])), " ").alias("label"))
    return m.select(key, branch).distinct().join(l, [key, branch], "left").select(key, branch, F.coalesce("label", F.lit("Query-aligned cluster")).alias("label"))


def unexpected_connections(m: DataFrame, edges: DataFrame, key: str, branch: str, most: float = 0.35) -> DataFrame:
    """(key, left, right, overlap): per result the two branches with an edge between them whose titles share the fewest words, ``most`` at the most."""
    s = shown(m).select(key, branch, F.explode(F.filter(title_words(F.col("title")), lambda w: F.length(w) > 3)).alias("w")).distinct()
    bag = s.groupBy(key, branch).agg(F.count(F.lit(1)).alias("n"))
    near = bridges(edges, shown(m), key, branch).select(key, "left", "right")
    common = s.withColumnRenamed(branch, "left").join(s.withColumnRenamed(branch, "right"), [key, "w"]).filter("left < right").groupBy(key, "left", "right").agg(F.count(F.lit(1)).alias("c"))
    x = near.join(common, [key, "left", "right"], "left").join(bag.select(key, F.col(branch).alias("left"), F.col("n").alias("a")), [key, "left"]).join(bag.select(key, F.col(branch).alias("right"), F.col("n").alias("b")), [key, "right"])
    c = F.coalesce("c", F.lit(0))
    x = x.withColumn("overlap", c / (F.col("a") + F.col("b") - c)).filter(F.col("overlap") <= most)
    return x.groupBy(key).agg(F.min(F.struct("overlap", "left", "right")).alias("r")).select(key, "r.left", "r.right", F.col("r.overlap").alias("overlap"))
