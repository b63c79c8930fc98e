"""Cutting lineage with tables written to the folder that all executors share.

Iterative operators and results that are read more than once are written as
Parquet below ``spark.checkpoint.dir``.  The files survive the loss of any
executor and are pruned by column when read again, which a checkpointed RDD is
not.

A staged table is read back with a merge hint: the optimizer takes the compressed
size of the files for the size of the rows, and would broadcast tables that are a
multiple of it in memory.  A side of proven size may still be broadcast by an
explicit hint, which goes before this one.

Results are computed when they are used, so the tables they read stay until
``release`` is called (or, in tests, until the process ends).
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
#: The folders that this process has written, by application.
_WRITTEN: dict[str, list[str]] = {}


def staging_root(spark: SparkSession) -> str:
    """The shared folder; a temporary one, for tests, only where none is set and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _LOCAL:
        _LOCAL[key] = tempfile.mkdtemp(prefix="citeloom-")
        atexit.register(shutil.rmtree, _LOCAL[key], True)
    return f"file://{_LOCAL[key]}"


def release(spark: SparkSession) -> int:
    """Removes every table that this process has staged in the session; results not yet written elsewhere are lost. The number of folders removed."""
    roots = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for r in roots:
        _remove(spark, r)
    return len(roots)


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Stage:
    """Tables written by one run of an operator.

    ``put`` writes a DataFrame and returns it read back; ``drop`` removes a table
    that no later step reads, so that an iteration holds two rounds at most.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{staging_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(self.root)
        self.n = 0

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:04d}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path).hint("merge")
        out._staged_at = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for df in tables:
            path = getattr(df, "_staged_at", None)
            if path:
                _remove(self.spark, path)
