"""The variable-resolution map: projection, fusion, levels, lookup.

points(frame_index, point_id, x, y, z, intensity, p0..p3, ground) in world coordinates, and
cells(level, ix, iy, z, var, z_min, z_max, inten, n_obs, ev0..ev3, overhead, last_seen). Missing is NULL.

Every operator is block-local: a cell's parents, children and fusion partners share its coarsest ancestor, its block.
Fusion and level changes shuffle by cell; lookup brings points and cells together by block, once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Fusion, Lod
from ..functions import geo
from ..functions.geo import number

KEY = ["level", "ix", "iy"]
EV = ["ev0", "ev1", "ev2", "ev3"]
STATE = ["z", "var", "z_min", "z_max", "inten", "n_obs", *EV, "overhead", "last_seen"]


def with_cells(points: DataFrame, lod: Lod, sx=0.0, sy=0.0) -> DataFrame:
    """points with the leaf cell (level, ix, iy) that holds each, the sensor being at (sx, sy) (columns or numbers)."""
    sx, sy = (F.lit(float(s)) if isinstance(s, (int, float)) else geo.col(s) for s in (sx, sy))
    found = points.withColumn("level", geo.leaf_level("x", "y", sx, sy, lod))
    ix, iy = geo.cell_of("x", "y", "level", lod)
    return found.withColumn("ix", ix).withColumn("iy", iy)


def measure(points: DataFrame, fusion: Fusion, sx=0.0, sy=0.0, by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each cell: what the points in it say. One hash aggregation with partial results."""
    sx, sy = (F.lit(float(s)) if isinstance(s, (int, float)) else geo.col(s) for s in (sx, sy))
    zg = F.when(F.col("ground"), F.col("z"))
    reach = geo.planar_range(F.col("x") - sx, F.col("y") - sy)
    sums = points.groupBy(*by, *KEY).agg(
        F.count("*").alias("n_all"),
        F.count(zg).alias("n_ground"),
        F.avg(zg).alias("mean_z"),
        F.avg(zg * zg).alias("mean_zz"),
        F.min(zg).alias("ground_min"),
        F.max(zg).alias("ground_max"),
        F.min("z").alias("all_min"),
        F.max("z").alias("all_max"),
        F.min(F.when(~F.col("ground"), F.col("z"))).alias("overhead"),
        F.avg("intensity").alias("inten"),
        *(F.sum(f"p{k}").alias(f"ev{k}") for k in range(4)),
        F.avg(reach).alias("reach"),
    )
    spread = F.when(F.col("n_ground") > 1, F.greatest(F.col("mean_zz") - F.col("mean_z") * F.col("mean_z"), number(0))).otherwise(number(0))
    sigma = number(fusion.z_sigma0) + number(fusion.z_sigma_rel) * F.col("reach")
    noise = (sigma * sigma + number(fusion.quantisation_gain) * spread) / F.greatest(F.col("n_ground").cast("double"), number(1))
    return sums.select(
        *by, *KEY, "n_all", "n_ground", F.col("mean_z"), spread.alias("var_in"),
        F.greatest(noise, number(fusion.min_var)).alias("noise"),
        F.coalesce("ground_min", "all_min").alias("z_min"), F.coalesce("ground_max", "all_max").alias("z_max"),
        "overhead", "inten", *EV, "reach",
    )


def first_state(m: DataFrame, frame: Column | int, fusion: Fusion) -> DataFrame:
    """Cells that were not on the map before."""
    frame = F.lit(frame).cast("long") if isinstance(frame, int) else frame.cast("long")
    return m.select(
        *KEY, F.coalesce("mean_z", "z_min").alias("z"), "noise", "z_min", "z_max", "inten", F.col("n_all").alias("n_obs"), *EV, "overhead", frame.alias("last_seen")
    ).withColumnRenamed("noise", "var")


def _known(old, new, fusion: Fusion, frame: Column) -> dict[str, Column]:
    """State of a cell seen again. old and new give a column by name. Process noise is charged on touch alone."""
    prior = old("var") + number(fusion.process_var)
    valid = new("n_ground") > 0
    gain = F.when(valid, prior / (prior + new("noise"))).otherwise(number(0))
    keep = fusion.intensity_keep
    return {
        "z": F.when(valid, old("z") + gain * (new("mean_z") - old("z"))).otherwise(old("z")),
        "var": F.greatest((1 - gain) * prior, number(fusion.min_var)),
        "z_min": F.least(old("z_min"), new("z_min")),
        "z_max": F.greatest(old("z_max"), new("z_max")),
        "inten": number(keep) * old("inten") + number(1 - keep) * new("inten"),
        "n_obs": F.least(old("n_obs") + new("n_all"), F.lit(fusion.max_obs).cast("long")),
        **{e: number(fusion.evidence_keep) * old(e) + new(e) for e in EV},
        "overhead": F.least(old("overhead"), new("overhead")),
        "last_seen": frame,
    }


def fuse(cells: DataFrame, m: DataFrame, frame: Column | int, fusion: Fusion) -> DataFrame:
    """The map after one frame's measurements: a full outer join by cell."""
    frame = F.lit(frame).cast("long") if isinstance(frame, int) else frame.cast("long")
    old = cells.select(*KEY, F.struct(*STATE).alias("o"))
    new = m.select(*KEY, F.struct("n_all", "n_ground", "mean_z", "noise", "z_min", "z_max", "inten", *EV, "overhead").alias("m"))
    both = old.join(new, KEY, "full_outer")
    seen = _known(lambda c: F.col(f"o.{c}"), lambda c: F.col(f"m.{c}"), fusion, frame)
    fresh = {
        "z": F.coalesce("m.mean_z", "m.z_min"), "var": F.col("m.noise"), "n_obs": F.col("m.n_all"), "last_seen": frame,
        **{c: F.col(f"m.{c}") for c in ("z_min", "z_max", "inten", *EV, "overhead")},
    }
    return both.select(
        *KEY,
        *(F.when(F.col("m").isNull(), F.col(f"o.{c}")).when(F.col("o").isNull(), fresh[c]).otherwise(seen[c]).alias(c) for c in STATE),
    )


def replay(measured: DataFrame, fusion: Fusion) -> DataFrame:
    """Fuse many frames at once: measurements(frame_index, KEY, ...) of a fixed sensor place, in frame order per cell.

    A cell's measurements, at most one a frame, are folded in order inside one row; no Python and one shuffle.
    """
    names = ["frame_index", "n_all", "n_ground", "mean_z", "noise", "z_min", "z_max", "inten", *EV, "overhead"]
    ordered = measured.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct(*names))).alias("frames"))
    first = F.col("frames")[0]
    start = F.struct(
        F.coalesce(first["mean_z"], first["z_min"]).alias("z"), first["noise"].alias("var"), first["z_min"].alias("z_min"), first["z_max"].alias("z_max"),
        first["inten"].alias("inten"), first["n_all"].alias("n_obs"), *(first[e].alias(e) for e in EV), first["overhead"].alias("overhead"), first["frame_index"].cast("long").alias("last_seen"),
    )

    def step(state, frame):
        after = _known(lambda c: state[c], lambda c: frame[c], fusion, frame["frame_index"].cast("long"))
        return F.struct(*(after[c].alias(c) for c in STATE))

    rest = F.slice("frames", F.lit(2), F.greatest(F.size("frames") - 1, F.lit(0)))
    return ordered.select(*KEY, F.aggregate(rest, start, step).alias("s")).select(*KEY, *(F.col(f"s.{c}").alias(c) for c in STATE))


def _weighted() -> list[Column]:
    weight = 1 / F.col("var")
    return [
        (F.sum(F.col("z") * weight) / F.sum(weight)).alias("z"),
        (1 / F.sum(weight)).alias("var"),
        F.min("z_min").alias("z_min"),
        F.max("z_max").alias("z_max"),
        F.avg("inten").alias("inten"),
        F.sum("n_obs").alias("n_obs"),
        *(F.sum(e).alias(e) for e in EV),
        F.min("overhead").alias("overhead"),
        F.max("last_seen").alias("last_seen"),
    ]


def coarsen(cells: DataFrame) -> DataFrame:
    """Children to their parents, four to one at most."""
    up = cells.select((F.col("level") + 1).alias("level"), F.shiftright("ix", 1).alias("ix"), F.shiftright("iy", 1).alias("iy"), *STATE)
    return up.groupBy(*KEY).agg(*_weighted())


def refine(cells: DataFrame, fusion: Fusion) -> DataFrame:
    """Cells to their four children; what a child cannot know makes its variance larger."""
    relief = F.col("z_max") - F.col("z_min")
    corners = F.array(*(F.struct((F.col("ix") * 2 + a).alias("ix"), (F.col("iy") * 2 + b).alias("iy")) for a in (0, 1) for b in (0, 1)))
    out = cells.select(
        (F.col("level") - 1).alias("level"), F.explode(corners).alias("child"), "z",
        (F.col("var") + number(fusion.quantisation_gain) * relief * relief).alias("var"), "z_min", "z_max", "inten",
        F.shiftright("n_obs", 2).alias("n_obs"), *((F.col(e) / 4).alias(e) for e in EV), "overhead", "last_seen",
    )
    return out.select("level", "child.ix", "child.iy", *STATE)


def merge(into: DataFrame, moved: DataFrame) -> DataFrame:
    """Cells that moved to a level where some exist already: fused by precision, intensity kept from those there."""
    o, m = (lambda c: F.col(f"o.{c}")), (lambda c: F.col(f"m.{c}"))
    weights = 1 / o("var") + 1 / m("var")
    fused = {
        "z": (o("z") / o("var") + m("z") / m("var")) / weights, "var": 1 / weights, "z_min": F.least(o("z_min"), m("z_min")), "z_max": F.greatest(o("z_max"), m("z_max")),
        "inten": o("inten"), "n_obs": o("n_obs") + m("n_obs"), **{e: o(e) + m(e) for e in EV}, "overhead": F.least(o("overhead"), m("overhead")), "last_seen": F.greatest(o("last_seen"), m("last_seen")),
    }
    both = into.select(*KEY, F.struct(*STATE).alias("o")).join(moved.select(*KEY, F.struct(*STATE).alias("m")), KEY, "full_outer")
    return both.select(*KEY, *(F.when(m("z_min").isNull(), o(c)).when(o("z_min").isNull(), m(c)).otherwise(fused[c]).alias(c) for c in STATE))


def _wanted(lod: Lod, sx: float, sy: float) -> Column:
    """Leaf level at the centre of a cell."""
    size = geo.level_size("level", lod)
    return geo.leaf_level(geo.centre("ix", size), geo.centre("iy", size), F.lit(float(sx)), F.lit(float(sy)), lod)


def rebalance(cells: DataFrame, lod: Lod, fusion: Fusion, sx: float, sy: float, cut=lambda df: df) -> DataFrame:
    """Move cells to the levels that a sensor at (sx, sy) asks for: up from the finest, then down from the coarsest.

    Each step takes the cells of one level that belong elsewhere and merges them one level on; a cell may go on in the
    next step. `cut` may write the map between the two sweeps so that plans stay short.
    """
    def sweep(parts, levels, up):
        for level in levels:
            here = parts[level]
            goes = _wanted(lod, sx, sy) > level if up else _wanted(lod, sx, sy) < level
            moving = here.where(goes)
            moved = coarsen(moving) if up else refine(moving, fusion)
            to = level + (1 if up else -1)
            parts[level] = here.where(~goes)
            parts[to] = merge(parts[to], moved)
        return parts

    split = lambda df: {k: df.where(F.col("level") == k) for k in range(lod.n_levels)}
    join = lambda parts: reduce(DataFrame.unionByName, parts.values())
    risen = cut(join(sweep(split(cells), range(lod.n_levels - 1), True)))
    return cut(join(sweep(split(risen), range(lod.n_levels - 1, 0, -1), False)))


def prune(cells: DataFrame, lod: Lod, fusion: Fusion, sx: float, sy: float, frame: int) -> DataFrame:
    """Cells near enough and seen lately enough."""
    return cells.where(keeps(lod, fusion, sx, sy, frame))


def pruned(cells: DataFrame, lod: Lod, fusion: Fusion, sx: float, sy: float, frame: int) -> DataFrame:
    """(kept, removed): how many cells prune() would leave and take."""
    ok = keeps(lod, fusion, sx, sy, frame)
    return cells.agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("removed"))


def keeps(lod: Lod, fusion: Fusion, sx: float, sy: float, frame: int) -> Column:
    size = geo.level_size("level", lod)
    away = geo.planar_range(geo.centre("ix", size) - float(sx), geo.centre("iy", size) - float(sy))
    return (away <= number(1.05 * lod.max_range)) & (F.lit(frame) - F.col("last_seen") <= fusion.stale_frames)


def view(cells: DataFrame, lod: Lod) -> DataFrame:
    """The flat map: places, sizes, classes."""
    size = geo.level_size("level", lod)
    cls, confidence = geo.best_class(*EV)
    return cells.select(
        *KEY, size.alias("size"), geo.centre("ix", size).alias("cx"), geo.centre("iy", size).alias("cy"), "z", "var", "z_min", "z_max", "n_obs",
        cls.alias("cls"), confidence.alias("confidence"), "overhead", geo.pack("ix", "iy").alias("key"),
    )


def lookup(points: DataFrame, cells: DataFrame, lod: Lod, by: list[str], columns: list[str]) -> DataFrame:
    """Of the cells that hold a point, the finest: points' `by` columns, its level and the cells' columns, null if none.

    A block's cells, at most (4 ** n_levels - 1) / 3, are one array; points and arrays are joined once by block, and a point
    picks its cell within the row.
    """
    bx, by_ = geo.block("level", "ix", "iy", lod)
    # cells know the key alone: rename so that clashing names of points survive
    held = F.struct(F.col("level").alias("l"), F.col("ix").alias("x"), F.col("iy").alias("y"), F.struct(*(F.col(c) for c in columns)).alias("c"))
    blocks = cells.select(bx.cast("long").alias("_bx"), by_.cast("long").alias("_by"), held.alias("_h")).groupBy("_bx", "_by").agg(F.array_sort(F.collect_list("_h"), lambda a, b: a["l"] - b["l"]).alias("_cells"))
    coarse = lod.size(lod.n_levels - 1)
    places = F.array(*(F.struct(geo.index("x", lod.size(k)).alias("x"), geo.index("y", lod.size(k)).alias("y")) for k in range(lod.n_levels)))
    asked = points.select(*by, geo.index("x", coarse).alias("_bx"), geo.index("y", coarse).alias("_by"), places.alias("_at"))
    here = lambda h: (h["x"] == F.get("_at", h["l"])["x"]) & (h["y"] == F.get("_at", h["l"])["y"])
    found = asked.join(blocks, ["_bx", "_by"], "left").select(*by, F.get(F.filter("_cells", here), F.lit(0)).alias("_f"))
    return found.select(*by, F.col("_f.l").alias("level"), *(F.col(f"_f.c.{c}").alias(c) for c in columns))


def memory(cells: DataFrame, lod: Lod, n_points: int, cell_bytes: int, point_bytes: int, height: float = 20.0) -> DataFrame:
    """Bytes of the map beside those of uniform grids, dense voxels and raw points."""
    square = lambda size: round(2 * lod.max_range / size) ** 2
    fine, coarse = square(lod.size(0)) * cell_bytes, square(lod.size(lod.n_levels - 1)) * cell_bytes
    bits = square(lod.size(0)) * round(height / lod.size(0)) // 8
    n = F.count("*") * cell_bytes
    as_long = lambda v: F.lit(v).cast("long")
    return cells.agg(F.count("*").alias("cells"), n.alias("map_bytes")).select(
        "cells", "map_bytes", as_long(fine).alias("uniform_fine_bytes"), as_long(coarse).alias("uniform_coarse_bytes"), as_long(bits).alias("voxel_bytes"), as_long(n_points * point_bytes).alias("raw_points_bytes"),
        F.round(F.lit(float(fine)) / F.greatest("map_bytes", F.lit(1)), 6).alias("reduction"),
    )
