"""One object over a session and a folder of tables: what a user of the engine calls first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citeloom.operators import graph, lookup, reading, resolve
from citeloom.sources.stores import FeedbackTable, Projects
from citeloom.staging import Stage, release
from citeloom.tables import table


class Engine:
    """Reading lists, lookups, merging and decisions over the tables of ``folder``.

    Nothing is held but the session and the paths; every method returns a DataFrame.
    ``home`` is where projects and decisions are kept.
    """

    COLUMNS = ("title", "abstract", "year", "venue", "domain", "doi", "arxiv_id", "semantic_scholar_id", "openalex_id", "references", "provenance", "authors")

    def __init__(self, spark: SparkSession, folder: str, home: str | None = None, as_of: int = 2026):
        self.spark, self.folder, self.as_of = spark, folder, as_of
        self.projects = Projects(spark, f"{home or folder}/projects")
        self.decisions = FeedbackTable(spark, f"{home or folder}/decisions")

    def nodes(self) -> DataFrame:
        return graph.nodes(table(self.spark, self.folder, "papers"), *self.COLUMNS)

    def citations(self) -> DataFrame:
        return Stage(self.spark, "citations").put(graph.resolve_references(self.nodes()))

    def reading_lists(self, queries: DataFrame) -> DataFrame:
        """The sections of every query (query_id, query)."""
        n, e = self.nodes(), self.citations()
        return reading.sections(reading.ranked_pool(queries, n, e, graph.degrees(n, e), self.as_of))

    def reports(self, queries: DataFrame) -> DataFrame:
        """The same as text."""
        return reading.report(queries, self.reading_lists(queries), self.nodes())

    def search(self, queries: DataFrame, most: int = 5) -> DataFrame:
        return lookup.title_search(queries, self.nodes(), most)

    def works(self) -> DataFrame:
        """Records merged into works by identifiers, decisions and titles."""
        return resolve.merged_records(self.nodes(), self.decisions.events(), titles=True)

    def close(self) -> int:
        """Removes what the session has staged; write results elsewhere before."""
        return release(self.spark)
