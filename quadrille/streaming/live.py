"""The map as a stream: frames arrive as files of points, the map is a versioned Parquet snapshot.

Each micro-batch fuses its frames in order of frame_index. A frame at or below the last one fused is late and is counted,
not fused. The snapshot's folder is named by batch id, so a batch that runs again after a failure starts from the one
before it and writes the same folder: fusing is exactly once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Settings
from ..operators import grid
from ..storage import _path, cut

#: World points of a stream.
SCHEMA = "frame_index long, point_id long, x double, y double, z double, intensity double, ground boolean, p0 double, p1 double, p2 double, p3 double"


class LiveMap:
    """A map kept under `folder`; poses(frame_index, ox, oy) are looked up by frame."""

    def __init__(self, spark: SparkSession, folder: str, poses: Callable[[int], tuple[float, float]], settings: Settings | None = None):
        self.spark, self.folder, self.poses, self.settings = spark, folder.rstrip("/"), poses, settings or Settings()

    def _batches(self) -> list[int]:
        p, fs = _path(self.spark, self.folder)
        if not fs.exists(p):
            return []
        names = [str(x.getPath().getName()) for x in fs.listStatus(p)]
        done = [n for n in names if n.startswith("batch=") and fs.exists(_path(self.spark, f"{self.folder}/{n}/_SUCCESS")[0])]
        return sorted(int(n.removeprefix("batch=")) for n in done)

    def cells(self, before: int | None = None) -> DataFrame | None:
        """The newest snapshot, or the newest one before a batch."""
        found = [b for b in self._batches() if before is None or b < before]
        return self.spark.read.parquet(f"{self.folder}/batch={found[-1]}") if found else None

    def last_frame(self, before: int | None = None) -> int:
        cells = self.cells(before)
        if cells is None:
            return -1
        last = cells.agg(F.max("as_of")).first()[0]
        return -1 if last is None else last

    def fold(self, rows: DataFrame, batch: int) -> None:
        """Fuse a batch of points, frame by frame."""
        s = self.settings
        rows = cut(rows)
        last, cells = self.last_frame(batch), self.cells(batch)
        cells = cells.drop("as_of") if cells is not None else None
        frames = sorted(r[0] for r in rows.select("frame_index").distinct().collect())  # frames of one micro-batch
        for f in (f for f in frames if f > last):
            sx, sy = self.poses(f)
            m = grid.measure(grid.with_cells(rows.where(F.col("frame_index") == f), s.lod, sx, sy), s.fusion, sx, sy)
            if cells is None:
                made = grid.first_state(m, f, s.fusion)
            else:
                made = grid.fuse(grid.rebalance(cells, s.lod, s.fusion, sx, sy, cut), m, f, s.fusion)
            cells = cut(grid.prune(made, s.lod, s.fusion, sx, sy, f))
            last = f
        if cells is not None:
            cells.withColumn("as_of", F.lit(last).cast("long")).write.mode("overwrite").parquet(f"{self.folder}/batch={batch}")

    def start(self, points: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        writer = points.writeStream.foreachBatch(self.fold).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()


def frames_from(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of Parquet files of points."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def frame_counts(points: DataFrame, ts: str, late: str, size: str) -> DataFrame:
    """Points by tumbling event-time window with a watermark, for monitoring a stream."""
    return points.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w")).agg(F.count("*").alias("points")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "points")
