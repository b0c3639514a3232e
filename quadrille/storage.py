"""Cutting lineage in storage that all executors share, and removing what is no longer read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OPEN: list[scratch] = []


def shared_dir(spark: SparkSession) -> str:
    """The application's folder under spark.checkpoint.dir, which all executors share.

    Where that is unset, local mode takes a temporary folder; on a cluster it is an error, as no machine's own folder will do.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="quadrille-")
        shared_dir.own = found
    return f"{found.rstrip('/')}/quadrille-{spark.sparkContext.applicationId}"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def cut(df: DataFrame, scope: scratch | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends there.

    A lost executor then costs a reread and no recomputation. The table goes when the innermost open scratch (or `scope`)
    closes, else with the application's folder when the JVM ends.
    """
    spark = df.sparkSession
    top = shared_dir(spark)
    if getattr(shared_dir, "marked", None) != top:
        p, fs = _path(spark, top)
        fs.deleteOnExit(p)
        shared_dir.marked = top
    path = f"{top}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    scope = scope or (_OPEN[-1] if _OPEN else None)
    if scope:
        scope.paths.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


class scratch:
    """`with scratch() as s:` removes the tables that cut() writes inside, but for those written by s.keep()."""

    def __enter__(self) -> scratch:
        self.paths: list[tuple[SparkSession, str]] = []
        self.outer = _OPEN[-1] if _OPEN else None
        _OPEN.append(self)
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        """cut() whose table outlives this scratch."""
        _OPEN.remove(self)
        try:
            return cut(df, self.outer)
        finally:
            _OPEN.append(self)

    def __exit__(self, *_) -> None:
        _OPEN.remove(self)
        for spark, path in self.paths:
            p, fs = _path(spark, path)
            fs.delete(p, True)
