"""Sinks: JSON, CSV, Markdown, HTML and BibTeX from result tables.

Every sink is a DataFrame of lines or rows written by Spark; only a leaderboard,
which is a bounded top list, is put together in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.extract import bibtex_escape, cite_key


def write_json(df: DataFrame, path: str, version: int = 1) -> None:
    """One JSON object per row, with the schema version."""
    df.withColumn("schema_version", F.lit(version)).write.mode("overwrite").json(path)


def read_json(spark, path: str, schema: str, version: int = 1) -> DataFrame:
    """Rows of ``write_json``; another version is an error."""
    df = spark.read.schema(schema + ", schema_version int").json(path)
    ok = F.when(F.col("schema_version") == version, True).otherwise(F.raise_error(F.concat(F.lit("unknown schema_version "), F.coalesce(F.col("schema_version").cast("string"), F.lit("null")))).cast("boolean"))
    return df.filter(ok).drop("schema_version")


def write_csv(df: DataFrame, path: str) -> None:
    """A header and the columns in alphabetical order."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("header", True).csv(path)


def leaderboard(df: DataFrame, name: str, score: str, top: int = 30) -> DataFrame:
    """(pos, line): a Markdown table of the ``top`` rows by score, then the mean, least and largest score of all."""
    best = df.select(name, score).orderBy(F.desc_nulls_last(score), name).limit(top)
    rows = best.agg(F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(name).alias("n"), F.col(score).alias("v")))).alias("l"))  # ``top`` rows at most
    lines = rows.select(F.posexplode("l").alias("pos", "r")).select((F.col("pos") + 2).alias("pos"), F.format_string("| %d | %s | %.4f |", F.col("pos") + 1, F.regexp_replace("r.n", r"\|", "/"), "r.v").alias("line"))
    spark = df.sparkSession
    head = spark.createDataFrame([(0, f"| rank | {name} | {score} |"), (1, "|---|---|---|")], "pos int, line string")
    total = df.agg(F.format_string("mean %.4f, least %.4f, largest %.4f", F.avg(score), F.min(score), F.max(score)).alias("line")).select(F.lit(1_000_000).alias("pos"), "line")
    return head.unionByName(lines).unionByName(total).orderBy("pos")


def _row(columns: list[str]) -> Column:
    """A table row of the columns, values escaped."""
    esc = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    return F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), esc(c), F.lit("</td>")) for c in columns], F.lit("</tr>"))


def html_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """(line): a table row per row, values escaped."""
    return df.select(_row(columns).alias("line"))


def html_page(df: DataFrame, title: str, columns: list[str], score: str) -> DataFrame:
    """(html): a page with one table of all rows, the best ``score`` first; for reports of some thousand rows, which one row then holds."""
    esc = lambda x: x.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    ordered = df.select((-F.coalesce(score, F.lit(float("-inf")))).alias("s"), *columns)
    lines = ordered.select("s", _row(columns).alias("line")).agg(F.array_sort(F.collect_list(F.struct("s", "line"))).alias("l"))
    head = f"<!doctype html><html><head><meta charset=\"utf-8\"><title>{esc(title)}</title></head><body><h1>{esc(title)}</h1><table><tr>" + "".join(f"<th>{esc(c)}</th>" for c in columns) + "</tr>"
    return lines.select(F.concat(F.lit(head), F.array_join(F.transform("l", lambda x: x["line"]), ""), F.lit("</table></body></html>")).alias("html"))


def bibtex(nodes: DataFrame) -> DataFrame:
    """(canonical_id, entry): one @misc entry per paper; absent fields are left out."""
    text = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    names = F.filter(F.transform("authors", lambda a: text(a["name"])), lambda x: x.isNotNull())
    field = lambda k, v: F.concat(F.lit(f"  {k} = {{"), v, F.lit("},"))
    lines = F.array_compact(
        F.array(
            F.concat(F.lit("@misc{"), cite_key(F.col("canonical_id")), F.lit(",")),
            field("title", bibtex_escape(F.coalesce(text(F.col("title")), F.lit("Untitled")))),
            field("author", F.when(F.size(names) > 0, F.array_join(F.transform(names, bibtex_escape), " and ")).otherwise("Unknown")),
            field("year", F.col("year").cast("string")),
            field("howpublished", bibtex_escape(text(F.col("venue")))),
            field("doi", bibtex_escape(text(F.col("doi")))),
            field("eprint", bibtex_escape(text(F.col("arxiv_id")))),
            F.lit("}"),
        )
    )
    return nodes.select("canonical_id", F.array_join(lines, "\n").alias("entry"))


def failures(df: DataFrame, score: str, least: float = 0.45, error: str = "error") -> DataFrame:
    """The rows below ``least`` or with an error."""
    return df.filter((F.col(score) < least) | F.col(error).isNotNull())


def atom_entries(spark, path: str) -> DataFrame:
    """(id, title, summary, authors, published) of an Atom feed, the first entry per id without its version.

    Read by Spark's XML reader, an entry a row.
    """
    schema = "id string, title string, summary string, published string, author array<struct<name:string>>"
    e = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    bare = F.regexp_replace(F.element_at(F.split(F.trim("id"), "/"), -1), r"v\d+$", "")
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    x = e.select(bare.alias("id"), squeeze(F.col("title")).alias("title"), squeeze(F.col("summary")).alias("summary"), F.transform("author", lambda a: F.trim(a["name"])).alias("authors"), "published")
    return x.groupBy("id").agg(F.min(F.struct("published", "title", "summary", "authors")).alias("r")).select("id", "r.title", "r.summary", "r.authors", "r.published")


def project_filename(name: Column) -> Column:
    """A file name from a project's name: letters, digits, dot, dash and underscore, 120 characters at most."""
    x = F.regexp_replace(F.trim(name), r"[^0-9A-Za-z._-]+", "_")
    return F.substring(F.when(F.coalesce(x, F.lit("")) == "", "project").otherwise(x), 1, 120)
