"""Entity resolution by identifiers, merge hints and titles, field-wise merging, and its audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.ids import bare_id, blank_to_null
from citeloom.operators.skew import salted_join
from citeloom.operators.stars import contracted
from citeloom.operators.titles import near_titles
from citeloom.staging import Stage

#: Trust in the sources for identifiers.
PRIORITY = {"crossref": 100, "openalex": 80, "semantic_scholar": 70, "arxiv": 60}
KEYS = ("doi", "arxiv_id", "semantic_scholar_id", "openalex_id")


def source_priority(provenance: str = "provenance") -> Column:
    """The highest priority of a record's sources."""

    def p(x: Column) -> Column:
        s = F.lower(F.trim(x["source"]))
        out = F.lit(0)
        for k, v in PRIORITY.items():
            out = F.when(s == k, v).otherwise(out)
        return out

    return F.coalesce(F.array_max(F.transform(provenance, p)), F.lit(0))


def identifier_links(n: DataFrame) -> DataFrame:
    """(a, b): each record with the smallest record that shares an identifier (ids of four characters and less name nothing)."""
    keys = n.select("canonical_id", F.explode(F.array_distinct(F.array(*[bare_id(F.col(c)) for c in KEYS]))).alias("key")).filter("key is not null and length(key) > 4")
    least = keys.groupBy("key").agg(F.min("canonical_id").alias("a"), F.count(F.lit(1)).alias("n"))
    return salted_join(keys, least.select("key", "a"), "key", "inner", spread="canonical_id", counts=least.select("key", "n")).filter("a <> canonical_id").select("a", F.col("canonical_id").alias("b")).distinct()


def hint_links(feedback: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs with any accepted merge hint."""
    x, y = blank_to_null(F.col("left_id")), blank_to_null(F.col("right_id"))
    return feedback.filter("event_type = 'merge_hint' and accepted").select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).filter("a < b").distinct()


def refused_pairs(feedback: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs with any refused event of whatever type, which may not merge directly."""
    x, y = blank_to_null(F.col("left_id")), blank_to_null(F.col("right_id"))
    return feedback.filter("not accepted").select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).filter("a < b").distinct()


def title_links(n: DataFrame, least: float = 0.92) -> DataFrame:
    """(a, b): records whose lower-case titles are equal or have a matching ratio of ``least`` or more.

    Equal titles hang on the smallest of their records; only distinct titles are
    compared, each with every other (see ``titles.near_titles``).
    """
    t = n.select("canonical_id", F.lower("title").alias("t")).filter("trim(t) <> ''")
    reps = Stage(n.sparkSession, "titles").put(t.groupBy("t").agg(F.min("canonical_id").alias("rep")))
    same = salted_join(t, reps, "t", "inner", spread="canonical_id").filter("rep <> canonical_id").select(F.col("rep").alias("a"), F.col("canonical_id").alias("b"))
    return same.unionByName(near_titles(reps, least))


def merged_records(n: DataFrame, feedback: DataFrame, titles: bool = False) -> DataFrame:
    """(record_id, members, title, abstract, venue, doi, references): one row per work.

    Records are linked by identifiers, accepted hints and, with ``titles``, by nearly
    equal titles; refused pairs are cut.  The record with the highest source priority
    (the smallest id among equals) gives the title; empty fields are filled from the
    next; references are united and sorted.  Groups are transitive, which the
    record-by-record scan of a single machine is not always.
    """
    links = identifier_links(n).unionByName(hint_links(feedback))
    links = links.unionByName(title_links(n)) if titles else links
    links = links.distinct().select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).join(refused_pairs(feedback), ["a", "b"], "left_anti")
    ids = n.select("canonical_id")
    links = links.join(ids.withColumnRenamed("canonical_id", "a"), "a", "left_semi").join(ids.withColumnRenamed("canonical_id", "b"), "b", "left_semi")
    labels = contracted(links).select(F.col("big").alias("canonical_id"), F.col("small").alias("label"))
    g = n.join(labels, "canonical_id", "left").withColumn("label", F.coalesce("label", "canonical_id")).withColumn("p", source_priority())
    order = F.struct((-F.col("p")).alias("p"), F.col("canonical_id").alias("id"))
    first = lambda c: F.min_by(c, F.when(blank_to_null(F.col(c)).isNotNull(), order))
    # repeated references fall away before a work's are collected
    refs = g.select("label", F.explode("references").alias("r")).filter("r is not null").distinct().groupBy("label").agg(F.array_sort(F.collect_list("r")).alias("references"))
    one = g.groupBy("label").agg(
        F.min_by("canonical_id", order).alias("record_id"),
        F.count(F.lit(1)).alias("members"),
        F.min_by("title", order).alias("title"),
        first("abstract").alias("abstract"),
        first("venue").alias("venue"),
        first("doi").alias("doi"),
    )
    return one.join(refs, "label", "left").withColumn("references", F.coalesce("references", F.array().cast("array<string>"))).drop("label")


def audit_report(audits: DataFrame) -> DataFrame:
    """Merged, refused and conflicting pairs per run, and the two quality proxies; repeated rows count once."""
    z = lambda c: F.coalesce(F.size(c), F.lit(0))
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(z(c))
    x = audits.groupBy("run_id").agg(F.max(size("merged_pairs")).alias("merged"), F.max(size("rejected_pairs")).alias("rejected"), F.max(size("conflict_log")).alias("conflicts"))
    one = F.lit(1)
    return x.withColumns({"precision_proxy": F.round(F.col("merged") / F.greatest(one, F.col("merged") + F.col("conflicts")), 4), "recall_proxy": F.round(F.col("merged") / F.greatest(one, F.col("merged") + F.col("rejected") + F.col("conflicts")), 4)})
