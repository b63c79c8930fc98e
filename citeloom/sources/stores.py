"""Small stores: projects as versioned JSON documents, the log of user decisions as an append-only table."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions.ids import blank_to_null
from citeloom.sources.reports import project_filename

#: Fixed value: the version of a project document.
SCHEMA_VERSION = 1
EVENTS = "event_type string, left_id string, right_id string, accepted boolean, created_at timestamp_ntz"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


class Projects:
    """Projects as ``<folder>/<stem>.json``, wherever Spark can write."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, stem: str) -> str:
        return f"{self.folder}/{stem}.json"

    def save(self, name: str, session: dict) -> str:
        """Writes a project over any of its name; its stem."""
        stem = self.spark.range(1).select(project_filename(F.lit(name))).first()[0]
        doc = {"schema_version": SCHEMA_VERSION, "saved_at": datetime.now(timezone.utc).replace(tzinfo=None).isoformat(), "name": name.strip() or stem, "session": session}
        p, fs = _fs(self.spark, self._path(stem))
        out = fs.create(p, True)
        out.write(bytearray(json.dumps(doc, indent=2, ensure_ascii=False).encode()))
        out.close()
        return stem

    def list(self) -> DataFrame:
        """(stem, name, saved, modified): all projects, the newest first; a broken document goes by its stem."""
        p, fs = _fs(self.spark, self.folder)
        if not fs.exists(p):
            return self.spark.createDataFrame([], "stem string, name string, modified timestamp")
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(self.folder)
        stem = F.regexp_extract("path", r"([^/]+)\.json$", 1)
        name = F.get_json_object(F.decode("content", "UTF-8"), "$.name")
        return files.select(stem.alias("stem"), F.coalesce(blank_to_null(name), stem).alias("name"), F.col("modificationTime").alias("modified")).orderBy(F.desc("modified"), "stem")

    def document(self, stem: str) -> dict:
        """The whole document; FileNotFoundError if there is none."""
        p, fs = _fs(self.spark, self._path(stem))
        if not fs.exists(p):
            raise FileNotFoundError(f"no project {stem!r}")
        row = self.spark.read.format("binaryFile").load(self._path(stem)).select("content").first()
        return json.loads(bytes(row[0]).decode())

    def load(self, stem: str) -> dict:
        """The session of a project of this version."""
        doc = self.document(stem)
        if doc.get("schema_version") != SCHEMA_VERSION:
            raise ValueError(f"project of version {doc.get('schema_version')}, not {SCHEMA_VERSION}")
        if not isinstance(doc.get("session"), dict):
            raise ValueError("project without a session")
        return doc["session"]

    def delete(self, stem: str) -> bool:
        p, fs = _fs(self.spark, self._path(stem))
        return bool(fs.delete(p, False))


class FeedbackTable:
    """The log of decisions: events are appended, read newest first, cleared or replaced as a whole."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, events: DataFrame) -> None:
        """Appends events; the columns may come in any order, others are left out, a missing time is now."""
        e = events if "created_at" in events.columns else events.withColumn("created_at", F.lit(None))
        cols = [F.col(c.split(" ")[0]).cast(c.split(" ")[1]).alias(c.split(" ")[0]) for c in EVENTS.split(", ")]
        now = F.to_timestamp_ntz(F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"))
        e.select(*cols).withColumn("created_at", F.coalesce("created_at", now)).write.mode("append").parquet(self.path)

    def merge_hint(self, left: str, right: str, accepted: bool) -> None:
        self._one("merge_hint", left, right, accepted)

    def bad_citation(self, source: str, target: str) -> None:
        self._one("bad_citation", source, target, False)

    def quality_override(self, label: str, score: float, provider: str, seed: str) -> None:
        self._one("pdf_quality_override", f"{label}:{score:.4f}", f"{provider}:{seed}", True)

    def _one(self, kind: str, left: str, right: str, accepted: bool) -> None:
        self.add(self.spark.createDataFrame([(kind, left, right, accepted)], "event_type string, left_id string, right_id string, accepted boolean"))

    def events(self) -> DataFrame:
        """All events, the newest first."""
        p, fs = _fs(self.spark, self.path)
        if not fs.exists(p):
            return self.spark.createDataFrame([], EVENTS)
        return self.spark.read.schema(EVENTS).parquet(self.path).orderBy(F.desc_nulls_last("created_at"), "event_type", "left_id", "right_id")

    def clear(self) -> None:
        self.spark.createDataFrame([], EVENTS).write.mode("overwrite").parquet(self.path)

    def replace(self, events: DataFrame) -> None:
        """The events instead of what there was."""
        cols = [F.col(c.split(" ")[0]).cast(c.split(" ")[1]).alias(c.split(" ")[0]) for c in EVENTS.split(", ")]
        events.select(*cols).write.mode("overwrite").parquet(self.path)
