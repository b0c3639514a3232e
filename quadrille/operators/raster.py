"""Raster operators on relations (frame_index, i, j, ...): cells of a square of `side` x `side`, absent ones unobserved."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.geo import number
from .graph import connected

KEY = ["frame_index", "i", "j"]
# Extent and cell of the ground raster, height of ground-like returns, headroom of the envelope, support radii.
EXTENT, CELL, NEAR_GROUND, HEADROOM = 100.0, 0.5, 0.40, 0.30
SUPPORT = (16.0, 30.0, 50.0, 75.0)


def side(extent: float = EXTENT, cell: float = CELL) -> int:
    return int(2 * extent / cell) + 1


def indices(x="x", y="y", extent: float = EXTENT, cell: float = CELL) -> tuple[Column, Column]:
    """(i, j): row by y, column by x, kept inside."""
    n = side(extent, cell)
    at = lambda v: F.least(F.greatest(((geo.col(v) + extent) / cell).cast("int"), F.lit(0)), F.lit(n - 1))
    return at(y), at(x)


def lowest(points: DataFrame, extent: float = EXTENT, cell: float = CELL) -> DataFrame:
    """(KEY, v, relief): the lowest return of each cell and the spread of those near it."""
    i, j = indices(extent=extent, cell=cell)
    inside = points.where((F.abs("x") < extent) & (F.abs("y") < extent)).select("frame_index", i.alias("i"), j.alias("j"), "z")
    low = F.min("z").over(Window.partitionBy(*KEY))
    near = inside.withColumn("low", low).where(F.col("z") < F.col("low") + number(NEAR_GROUND))
    return near.groupBy(*KEY).agg(F.min("low").alias("v"), (F.max("z") - F.min("low")).alias("relief"))


def fill_nearest(value: np.ndarray, observed: np.ndarray) -> np.ndarray:
    """Every cell takes the value of the nearest observed one, the first by row and column on ties; zeros without any.

    Distances are exact: per column the nearest observed row above or below, then per row the best column.
    """
    h, w = value.shape
    if not observed.any():
        return np.zeros_like(value)
    rows = np.arange(h)[:, None]
    above = np.maximum.accumulate(np.where(observed, rows, -(10**6)), 0)
    below = np.minimum.accumulate(np.where(observed, rows, 10**6)[::-1], 0)[::-1]
    nearest = np.where(rows - above <= below - rows, above, below)
    gap = np.minimum(np.abs(rows - nearest), 10**6).astype(np.int64)
    columns = np.arange(w, dtype=np.int64)
    apart = (columns[:, None] - columns[None, :]) ** 2
    out = np.empty_like(value)
    for r in range(h):
        valid = gap[r] < 10**5
        order = (apart + gap[r][None, :] ** 2) * (h * w) + (np.clip(nearest[r], 0, h - 1) * w + columns)[None, :]
        best = np.where(valid[None, :], order, np.iinfo(np.int64).max).argmin(1)
        out[r] = value[nearest[r][best], best]
    return out


def neighbours(v: np.ndarray) -> np.ndarray:
    """The four neighbours of each cell, the raster's edges being joined."""
    return np.stack([np.roll(v, s, a) for a in (0, 1) for s in (1, -1)])


def envelope(v: np.ndarray, sweeps: int = 2) -> np.ndarray:
    """No cell stands more than the headroom above the median of its neighbours."""
    for _ in range(sweeps):
        v = np.minimum(v, np.median(neighbours(v), 0) + HEADROOM)
    return v


def slope_of(v: np.ndarray, cell: float = CELL) -> np.ndarray:
    gy, gx = np.gradient(v, cell)
    return np.degrees(np.arctan(np.hypot(gx, gy)))


GROUND = "frame_index long, i int, j int, v double, observed boolean, relief double, slope_deg double"


def ground(points: DataFrame, extent: float = EXTENT, cell: float = CELL) -> DataFrame:
    """(KEY, v, observed, relief, slope_deg) for every cell of each frame's ground raster.

    The lowest returns are a relational aggregation; filling, smoothing and slope need the whole raster of a frame, a
    fixed square, and run in one Python call a frame.
    """
    n = side(extent, cell)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        value, relief, seen = np.zeros((n, n)), np.zeros((n, n)), np.zeros((n, n), bool)
        i, j = frame.i.to_numpy(), frame.j.to_numpy()
        value[i, j], relief[i, j], seen[i, j] = frame.v, frame.relief, True
        v = envelope(fill_nearest(value, seen))
        ii, jj = np.divmod(np.arange(n * n), n)
        return pd.DataFrame({"frame_index": frame.frame_index.iloc[0], "i": ii, "j": jj, "v": v.ravel(), "observed": seen.ravel(), "relief": relief.ravel(), "slope_deg": slope_of(v, cell).ravel()})

    return lowest(points, extent, cell).groupBy("frame_index").applyInPandas(run, GROUND)


def around(cells: DataFrame, keep: list[str], wrap: int | None = None) -> DataFrame:
    """Each cell with its four neighbours' places (ni, nj), on a torus of `wrap` cells if given."""
    steps = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1)))))
    to = lambda c, d: F.pmod(F.col(c) + F.col(d), F.lit(wrap)) if wrap else F.col(c) + F.col(d)
    return cells.select(*KEY, *keep, steps.alias("s")).select(*KEY, *keep, to("i", "s.a").alias("ni"), to("j", "s.b").alias("nj"))


def step_height(cells: DataFrame, wrap: int | None = None) -> DataFrame:
    """(KEY, step): the largest difference to a neighbour that exists."""
    there = cells.select("frame_index", F.col("i").alias("ni"), F.col("j").alias("nj"), F.col("v").alias("nv"))
    pairs = around(cells, ["v"], wrap).join(there, ["frame_index", "ni", "nj"], "left")
    return pairs.groupBy(*KEY).agg(F.coalesce(F.max(F.abs(F.col("v") - F.col("nv"))), number(0)).alias("step"))


def dilate(cells: DataFrame, wrap: int | None = None) -> DataFrame:
    """Cells and their neighbours, once each."""
    return cells.select(*KEY).unionByName(around(cells, [], wrap).select("frame_index", F.col("ni").alias("i"), F.col("nj").alias("j"))).distinct()


def support(cells: DataFrame, thresholds: tuple[float, ...] = SUPPORT, extent: float = EXTENT, cell: float = CELL) -> DataFrame:
    """Observed cells, grown once for each threshold where they lie farther out than it."""
    n = side(extent, cell)
    reach = geo.planar_range((F.col("j") + 0.5) * cell - extent, (F.col("i") + 0.5) * cell - extent)
    out = cells.select(*KEY)
    for t in thresholds:
        out = out.unionByName(dilate(out, n).where(reach > t)).distinct()
    return out


def components(cells: DataFrame, max_step: float | None = None, width: int = 1 << 20) -> DataFrame:
    """(KEY, component) of 4-connected cells, cut where v differs by more than max_step; component is its least place."""
    columns = ["v"] if max_step is not None else []
    there = cells.select("frame_index", F.col("i").alias("ni"), F.col("j").alias("nj"), *(F.col(c).alias(f"n{c}") for c in columns))
    place = lambda i, j: (F.col("frame_index") * width + F.col(i)) * width + F.col(j)
    pairs = around(cells, columns).join(there, ["frame_index", "ni", "nj"])
    if max_step is not None:
        pairs = pairs.where(F.abs(F.col("v") - F.col("nv")) <= number(max_step))
    keyed = cells.select(*KEY, place("i", "j").cast("long").alias("node"))
    found = connected(pairs.select(place("i", "j").cast("long").alias("a"), place("ni", "nj").cast("long").alias("b")))
    if found is None:
        return keyed.select(*KEY, F.col("node").alias("component"))
    rooted = keyed.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return rooted.join(rooted.groupBy("root").agg(F.min("node").alias("component")), "root").select(*KEY, "component")


def labelled(mask: np.ndarray, v: np.ndarray | None = None, max_step: float | None = None) -> np.ndarray:
    """Number of each cell's 4-connected component, which is its least place, by hooking and pointer jumping; -1 outside.

    Neighbours whose v differs by more than max_step, if given, are not connected.
    """
    h, w = mask.shape
    place = np.arange(h * w).reshape(h, w)
    right, down = mask[:, :-1] & mask[:, 1:], mask[:-1] & mask[1:]
    if max_step is not None:
        right, down = right & (np.abs(np.diff(v, axis=1)) <= max_step), down & (np.abs(np.diff(v, axis=0)) <= max_step)
    a = np.concatenate([place[:, :-1][right], place[:-1][down]])
    b = np.concatenate([place[:, 1:][right], place[1:][down]])
    up = np.arange(h * w)
    while True:
        low = np.minimum(up[a], up[b])
        before = up.copy()
        np.minimum.at(up, before[a], low)
        np.minimum.at(up, before[b], low)
        while (up[up] != up).any():
            up = up[up]
        if (up == before).all():
            return np.where(mask, up.reshape(h, w), -1)


def grown_parts(cells: DataFrame, extent: float = EXTENT, cell: float = CELL) -> DataFrame:
    """(KEY, component): components of each frame's cells grown by one, for the cells themselves; one Python call a frame's square."""
    n = side(extent, cell)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        mask = np.zeros((n + 2, n + 2), bool)
        i, j = frame.i.to_numpy(), frame.j.to_numpy()
        for a, b in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)):
            mask[i + 1 + a, j + 1 + b] = True
        return frame.assign(component=labelled(mask[1:-1, 1:-1])[i, j])

    return cells.select(*KEY).distinct().groupBy("frame_index").applyInPandas(run, "frame_index long, i int, j int, component long")


def drivable_region(full: DataFrame, max_slope: float, max_step: float, x: float = 0.0, y: float = 0.0, extent: float = EXTENT, cell: float = CELL) -> DataFrame:
    """(KEY) of the passable component that holds (x, y), else of the largest, the first on ties; full is ground().

    Components are found within a frame's square, in one Python call each.
    """
    held = support(full.where("observed"), extent=extent, cell=cell)
    passable = full.where((F.col("slope_deg") <= max_slope) & (F.col("relief") <= max_step)).join(held, KEY, "left_semi").select(*KEY, "v")
    n = side(extent, cell)
    at = tuple(min(max(int((c + extent) / cell), 0), n - 1) for c in (y, x))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        mask, v = np.zeros((n, n), bool), np.zeros((n, n))
        i, j = frame.i.to_numpy(), frame.j.to_numpy()
        mask[i, j], v[i, j] = True, frame.v
        part = labelled(mask, v, max_step)
        ids, sizes = np.unique(part[mask], return_counts=True)
        best = part[at] if mask[at] else ids[sizes.argmax()]
        return frame.loc[part[i, j] == best, KEY]

    return passable.groupBy("frame_index").applyInPandas(run, "frame_index long, i int, j int")
