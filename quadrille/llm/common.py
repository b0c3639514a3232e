"""Shared helpers: reading tables, null texts, the identity of rows, and the memory of Python workers."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import reachable
from ..storage import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return reachable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _scan(df: DataFrame) -> bool:
    """Whether df is one relation, at most filtered and projected, so that each row is one row of it."""
    node = df._jdf.queryExecution().analyzed()
    while node.getClass().getSimpleName() in ("Filter", "Project", "SubqueryAlias"):
        node = node.children().head()
    return node.getClass().getSimpleName() == "LogicalRelation"


def with_row(df: DataFrame) -> tuple[DataFrame, str]:
    """(df with a column that names each row, that column): doc_ids may be null or repeat, rows do not.

    Rows read from files are named by file and place, which need no other pass; other rows are written once with a number.
    """
    name = fresh(df, "_row")
    if _scan(df):
        try:
            return df.withColumn(name, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))), name
        except AnalysisException:  # a source without these
            pass
    return cut(df.withColumn(name, F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("place")))), name


def without(df: DataFrame, row: str, dropped: DataFrame) -> DataFrame:
    """df, which has the column `row`, but for the rows that dropped(row) names; the column goes too."""
    return df.join(dropped.select(row), row, "left_anti").drop(row)


def release() -> None:
    """Give the machine back what this Python worker has freed: it outlives its tasks, and the next one's need comes on top."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # a C library without it
        pass
