"""References to records that do not exist.

Distinct non-null foreign keys are anti-joined with the parent keys, and the
orphan keys joined back to the references, so the wide side is shuffled once and
the anti-join sees each key once however often it is cited.  A hot key is salted
in the join back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions.ids import bare_id, blank_to_null
from citeloom.operators.skew import salted_join


def parent_keys(parents: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(key): the distinct bare identifiers in any of ``columns``."""
    return parents.select(F.explode(F.array_distinct(F.array(*[bare_id(F.col(c)) for c in columns]))).alias("key")).filter("key is not null").distinct()


def references(df: DataFrame, table_name: str, source_id: str, ref, period) -> DataFrame:
    """(table_name, period, source_id, ref_id, key): the distinct references of one table, blank ones left out.

    ``ref`` and ``period`` are columns; a null time gives a null period.
    """
    return (
        df.select(F.lit(table_name).alias("table_name"), F.date_format(period, "yyyy-MM").alias("period"), F.col(source_id).alias("source_id"), ref.alias("ref_id"))
        .filter(blank_to_null(F.col("ref_id")).isNotNull())
        .distinct()
        .withColumn("key", bare_id(F.col("ref_id")))
    )


def orphan_references(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """Rows of ``refs`` (with a ``key``) whose key is not in ``parents`` (key).

    A value that is not blank but whose bare identifier is empty (a kind and
    nothing behind it) names no record and is an orphan.  Empty tables give an
    empty result or, without parents, all references.
    """
    counts = refs.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    missing = counts.filter("key is not null").join(parents, "key", "left_anti").select("key")
    found = salted_join(refs, missing, "key", "inner", spread="source_id", counts=counts)
    return found.unionByName(refs.filter("key is null")).drop("key")


def edge_references(edges: DataFrame) -> DataFrame:
    """The references of the citation edges, by month of ``created_at``."""
    return references(edges, "edges", "source_paper_id", F.col("target_paper_id"), F.col("created_at"))


def paper_references(papers: DataFrame) -> DataFrame:
    """The references of the paper records, by month of the record's earliest fetch."""
    first = F.array_min(F.transform("provenance", lambda p: p["fetched_at"]))
    return references(papers.select("canonical_id", first.alias("first_at"), F.explode("references").alias("ref")), "papers", "canonical_id", F.col("ref"), F.col("first_at"))


def orphan_counts(orphans: DataFrame, refs: DataFrame) -> DataFrame:
    """Per table and period: references, orphans, distinct orphan values and the share that is orphaned."""
    o = orphans.groupBy("table_name", "period").agg(F.count(F.lit(1)).alias("orphans"), F.countDistinct("ref_id").alias("orphan_values"))
    r = refs.groupBy("table_name", "period").agg(F.count(F.lit(1)).alias("refs"))
    both = r.alias("r").join(o.alias("o"), F.expr("r.table_name = o.table_name and r.period <=> o.period"), "left")
    n = F.coalesce("o.orphans", F.lit(0))
    return both.select("r.table_name", "r.period", "r.refs", n.alias("orphans"), F.coalesce("o.orphan_values", F.lit(0)).alias("orphan_values"), (n / F.col("r.refs")).alias("orphan_share"))
