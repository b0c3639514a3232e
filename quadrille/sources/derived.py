"""A deterministic point cloud from the events table, in exact integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import reachable

#: The same expressions in both dialects.
COLUMNS = {
    "event_id": "event_id",
    "frame_index": "user_id % 3",
    "x": "((event_id * event_id % 19001) * 31 + event_id * 7919) % 19001 / 100.0E0 - 95.0E0",
    "y": "((event_id * event_id % 18899) * 17 + event_id * 104729) % 18899 / 100.0E0 - 94.0E0",
    "z": "value / 100.0E0",
    "intensity": "event_id % 100 / 100.0E0",
    "cls": "case event_type when 'view' then 0 when 'click' then 0 when 'signup' then 1 when 'purchase' then 2 else 3 end",
}
SQL = "select " + ", ".join(f"{e} as {c}" for c, e in COLUMNS.items()) + " from events"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """World points with point_id, ground and evidence p0..p3; the sensor stands at the origin."""
    events = reachable(spark).read.parquet(f"{sf_dir}/events.parquet")
    rows = events.selectExpr(*(f"{e} as {c}" for c, e in COLUMNS.items())).withColumn("cls", F.col("cls").cast("int"))
    evidence = {f"p{k}": F.when(F.col("cls") == k, 0.88).otherwise(0.04) for k in range(4)}
    return rows.withColumns({"point_id": F.col("event_id"), "ground": F.col("cls") <= 1, **evidence})
