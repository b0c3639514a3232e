"""The map pipeline over frames, as a facade over the operators."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CELL_BYTES, POINT_BYTES, Settings
from ..functions import geo
from ..operators import grid, navigation, segment
from ..storage import cut, scratch


@dataclass
class FrameResult:
    """What one frame gave: labelled points, verdicts of all cells, linked tiles, seconds by stage."""

    points: DataFrame
    verdicts: DataFrame
    tiles: DataFrame
    cells: DataFrame
    seconds: dict[str, float]

    @property
    def fps(self) -> float:
        return 1 / max(self.seconds["total"], 1e-9)


class MapPipeline:
    """Keeps the map between frames if persistent. Every stage's result is written once, in shared storage."""

    def __init__(self, spark: SparkSession, settings: Settings | None = None, persistent: bool = True):
        self.spark, self.settings, self.persistent = spark, settings or Settings(), persistent
        self.cells: DataFrame | None = None
        self.history: list[dict] = []

    def reset(self) -> None:
        self.cells, self.history = None, []

    def process(self, points: DataFrame, pose: dict) -> FrameResult:
        """One frame's points(frame_index, point_id, x, y, z, intensity, ...) in sensor coordinates and its pose.

        The points are written on entry, as every stage reads them; the map of the frame before goes when the new one stands.
        """
        with scratch() as own:
            return self._process(cut(points), pose, own)

    def _process(self, points: DataFrame, pose: dict, own: scratch) -> FrameResult:
        s, seconds = self.settings, {}
        sx, sy, frame = pose["ox"], pose["oy"], pose["frame_index"]

        def timed(name: str, make, write=cut):
            began = time.perf_counter()
            out = write(make())
            seconds[name] = seconds.get(name, 0.0) + time.perf_counter() - began
            return out

        labelled = timed("inference", lambda: segment.segmenter(s.model)(points, s.vehicle))
        world = to_world(labelled, pose).withColumn("ground", F.col("label") <= 1)
        old = self.cells if self.persistent else None
        if old is not None:
            old = timed("rebalance", lambda: grid.rebalance(old, s.lod, s.fusion, sx, sy, cut))

        def update():
            m = grid.measure(grid.with_cells(world, s.lod, sx, sy), s.fusion, sx, sy)
            return grid.first_state(m, frame, s.fusion) if old is None else grid.fuse(old, m, frame, s.fusion)

        removed = 0
        if self.persistent:
            full = timed("projection", update)
            removed = grid.pruned(full, s.lod, s.fusion, sx, sy, frame).first()["removed"]
            cells = timed("projection", lambda: grid.prune(full, s.lod, s.fusion, sx, sy, frame), own.keep)
        else:
            cells = timed("projection", update, own.keep)
        view = grid.view(cells, s.lod)
        linked = timed("navigation", lambda: navigation.link(navigation.tiles(view, s.vehicle), s.vehicle))
        tiles = timed("navigation", lambda: navigation.reachable(linked, s.vehicle, sx, sy), own.keep)
        verdicts = timed("traversability", lambda: navigation.verdicts(view, tiles, s.vehicle, sx, sy), own.keep)
        found = grid.lookup(world, verdicts, s.lod, ["frame_index", "point_id"], ["passable", "reachable", "known"])
        out = timed("demotion", lambda: navigation.demote(labelled, found, ["frame_index", "point_id"]), own.keep)
        self.cells = cells
        seconds["total"] = sum(seconds.values())
        self.history.append({"frame_index": frame, "removed": removed, **seconds})
        return FrameResult(out, verdicts, tiles, cells, seconds)

    def memory(self, n_points: int = 0) -> DataFrame:
        return grid.memory(self.cells, self.settings.lod, n_points, CELL_BYTES, POINT_BYTES)


def to_world(points: DataFrame, pose: dict) -> DataFrame:
    x, y, z = geo.to_world(yaw=F.lit(float(pose["yaw"])), ox=F.lit(float(pose["ox"])), oy=F.lit(float(pose["oy"])), oz=F.lit(float(pose["oz"])))
    return points.withColumns({"x": x, "y": y, "z": z})
