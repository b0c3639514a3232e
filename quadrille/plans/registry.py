"""Queries over the given tables, and the same in SQL written by hand for another engine.

Every query reads whole tables. Doubles are rounded to six digits on both sides, after a nudge of 1e-9 that takes exact
halves, of which means of decimals have many, off the rounding edge.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import CELL_BYTES, POINT_BYTES, Fusion, Lod, Sensor, Vehicle
from ..functions import geo
from ..operators import features, grid, metrics, navigation, raster, segment
from ..sources import boxes, derived, scans, simulator
from ..storage import cut, shared_dir

FINE, WIDE = Lod(), Lod(base_cell=0.5)
FUSION, VEHICLE = Fusion(), Vehicle(nav_cell=8.0)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*((F.round(F.col(c) + F.lit(1e-9), digits) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def query(sql: str | None = None, ints: str = "", doubles: str = "", digits: int = 6):
    """Register a function of (spark, sf_dir); sql gives columns `ints` as they are and `doubles` to be rounded."""

    def wrap(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
        if sql:
            columns = [*ints.split(), *(f"round({c} + 0.000000001e0, {digits}) + 0.0e0 as {c}" for c in doubles.split())]
            ORACLE_SQL[f.__name__] = f"{PRE}select {', '.join(columns)} from ({sql})"
        return f

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- SQL parts


def _d(v: float) -> str:
    return f"{v}e0"


def _dmin(size: float) -> str:
    part = lambda c: f"greatest(floor({c} / {_d(size)}) * {_d(size)}, -floor({c} / {_d(size)}) * {_d(size)} - {_d(size)}, 0.0e0)"
    return f"sqrt({part('x')} * {part('x')} + {part('y')} * {part('y')})"


def _level(lod: Lod) -> str:
    return "case " + " ".join(f"when {_dmin(lod.size(k))} >= {_d(lod.ring_radii[k])} then {k}" for k in range(lod.n_levels - 1, 0, -1)) + " else 0 end"


def _cells(lod: Lod, name: str) -> str:
    size = f"({_d(lod.base_cell)} * (1 << level))"
    return f"""{name}_pts as (select *, {_level(lod)} as level from pts),
{name}_at as (select *, cast(floor(x / {size}) as bigint) as ix, cast(floor(y / {size}) as bigint) as iy from {name}_pts),
{name}_sums as (
  select frame_index, level, ix, iy, count(*) as n_all, count(*) filter (where cls <= 1) as n_ground,
    avg(z) filter (where cls <= 1) as mean_z, avg(z * z) filter (where cls <= 1) as mean_zz,
    min(z) filter (where cls <= 1) as gmin, max(z) filter (where cls <= 1) as gmax, min(z) as amin, max(z) as amax,
    min(z) filter (where cls > 1) as overhead, avg(intensity) as inten, avg(sqrt(x * x + y * y)) as reach,
    sum(case when cls = 0 then 0.88e0 else 0.04e0 end) as ev0, sum(case when cls = 1 then 0.88e0 else 0.04e0 end) as ev1,
    sum(case when cls = 2 then 0.88e0 else 0.04e0 end) as ev2, sum(case when cls = 3 then 0.88e0 else 0.04e0 end) as ev3
  from {name}_at group by all),
{name}_m as (
  select *, coalesce(gmin, amin) as z_min, coalesce(gmax, amax) as z_max,
    case when n_ground > 1 then greatest(mean_zz - mean_z * mean_z, 0e0) else 0e0 end as var_in,
    greatest(((0.02e0 + 0.004e0 * reach) * (0.02e0 + 0.004e0 * reach) + 0.35e0 * case when n_ground > 1 then greatest(mean_zz - mean_z * mean_z, 0e0) else 0e0 end) / greatest(n_ground, 1), 0.0001e0) as noise
  from {name}_sums),
{name}_first as (select frame_index, level, ix, iy, coalesce(mean_z, z_min) as z, noise as var, z_min, z_max, inten, n_all as n_obs, ev0, ev1, ev2, ev3, overhead, frame_index as last_seen from {name}_m)"""


_STATE = "z, var, z_min, z_max, inten, n_obs, ev0, ev1, ev2, ev3, overhead, last_seen"


def _fuse(old: str, new: str, frame: int) -> str:
    """SQL of one fusion step: old state, new measurements."""
    ev = ", ".join(f"case when m.level is null then o.ev{k} when o.level is null then m.ev{k} else 0.85e0 * o.ev{k} + m.ev{k} end as ev{k}" for k in range(4))
    gain = "(case when m.n_ground > 0 then (o.var + 0.0009e0) / (o.var + 0.0009e0 + m.noise) else 0e0 end)"
    pick = lambda c, both, first=None: f"case when m.level is null then o.{c} when o.level is null then {first or 'm.' + c} else {both} end as {c}"
    return f"""select coalesce(o.level, m.level) as level, coalesce(o.ix, m.ix) as ix, coalesce(o.iy, m.iy) as iy,
  {pick('z', f'case when m.n_ground > 0 then o.z + {gain} * (m.mean_z - o.z) else o.z end', 'coalesce(m.mean_z, m.z_min)')},
  {pick('var', f'greatest((1 - {gain}) * (o.var + 0.0009e0), 0.0001e0)', 'm.noise')},
  {pick('z_min', 'least(o.z_min, m.z_min)')}, {pick('z_max', 'greatest(o.z_max, m.z_max)')},
  {pick('inten', '0.7e0 * o.inten + (1 - 0.7e0) * m.inten')}, {pick('n_obs', 'o.n_obs + m.n_all', 'm.n_all')}, {ev},
  {pick('overhead', 'least(o.overhead, m.overhead)')}, {pick('last_seen', str(frame), str(frame))}
from {old} o full outer join {new} m on o.level = m.level and o.ix = m.ix and o.iy = m.iy"""


_VIEW = """select level, ix, iy, {size} as size, (ix + 0.5e0) * {size} as cx, (iy + 0.5e0) * {size} as cy, z, var, z_min, z_max, n_obs,
  case greatest(ev0, ev1, ev2, ev3) when ev0 then 0 when ev1 then 1 when ev2 then 2 else 3 end as cls,
  greatest(ev0, ev1, ev2, ev3) / greatest(ev0 + ev1 + ev2 + ev3, 0.000001e0) as confidence, overhead,
  (((ix + 1048576) & 2097151) << 21) | ((iy + 1048576) & 2097151) as key from {source}"""
_SIZE = "(0.5e0 * (1 << level))"

PRE = f"""with recursive pts as ({derived.SQL}),
{_cells(FINE, 'fine')},
{_cells(WIDE, 'wide')},
map0 as (select level, ix, iy, {_STATE} from wide_first where frame_index = 0),
map1 as ({_fuse('map0', '(select * from wide_m where frame_index = 1)', 1)}),
map2 as ({_fuse('map1', '(select * from wide_m where frame_index = 2)', 2)}),
view2 as ({_VIEW.format(size=_SIZE, source='map2')}),
cover as (
  select v.*, case when f = 1 then cast(floor(cx / 8e0) as bigint) else cast(floor((cx - 0.5e0 * size + 0.000001e0) / 8e0) as bigint) end + a as kx,
              case when f = 1 then cast(floor(cy / 8e0) as bigint) else cast(floor((cy - 0.5e0 * size + 0.000001e0) / 8e0) as bigint) end + b as ky
  from (select *, greatest(cast(round_even(size / 8e0, 0) as bigint), 1) as f, z_max - z_min <= 60.0e0 and n_obs > 0 as ok from view2) v,
       range(0, 4) r1(a), range(0, 4) r2(b) where a < f and b < f),
tile as (
  select kx, ky, avg(z) filter (where ok and cls <= 1) as z, coalesce(max(z) filter (where ok and cls <= 1) - min(z) filter (where ok and cls <= 1), 0e0) as relief, count(*) as n_cells,
    bool_or(ok and cls <= 1) as has_ground from cover group by 1, 2),
tiles as (
  select t.kx, t.ky, any_value(t.z) as z, any_value(t.relief) as relief, any_value(t.has_ground) as has_ground, any_value(t.n_cells) as n_cells,
    coalesce(bool_or(c.cls >= 2 and t.has_ground and c.z_min < t.z + 2.4e0), false) as blocked,
    coalesce(bool_or(c.cls >= 2 and not (t.has_ground and c.z_min < t.z + 2.4e0)), false) as overhead_only
  from tile t join cover c on c.kx = t.kx and c.ky = t.ky group by 1, 2),
probes as (
  select a.kx, a.ky, d, s, b.kx as nx, b.ky as ny, b.z as nz, b.has_ground as ng, row_number() over (partition by a.kx, a.ky, d order by s) as k
  from tiles a, (values (1, 0, 0), (-1, 0, 1), (0, 1, 2), (0, -1, 3)) as dirs(dx, dy, d), range(1, 11) r(s), tiles b where b.kx = a.kx + dx * s and b.ky = a.ky + dy * s),
link as (select kx, ky, d, nx, ny, nz, ng, s * 8e0 as distance from probes where k = 1),
linked as (
  select t.*, coalesce(max(case when t.has_ground and l.ng then abs(t.z - nz) end), 0e0) as step,
    coalesce(max(case when t.has_ground and l.ng then degrees(atan2(abs(t.z - nz), greatest(distance, 0.001e0))) end), 0e0) as slope_deg
  from tiles t left join link l on l.kx = t.kx and l.ky = t.ky group by all),
passed as (select *, has_ground and not blocked and relief <= 60e0 and slope_deg <= 60e0 as passable from linked),
crossed as (
  select l.kx, l.ky, l.nx, l.ny from link l join passed a on a.kx = l.kx and a.ky = l.ky and a.passable join passed b on b.kx = l.nx and b.ky = l.ny and b.passable
  where abs(a.z - b.z) <= 60e0 and degrees(atan2(abs(a.z - b.z), greatest(l.distance, 0.001e0))) <= 60e0 and l.distance <= 2e0 * 8e0 + 0.000001e0),
edge as (select ((kx + 1048576) << 21) | (ky + 1048576) as a, ((nx + 1048576) << 21) | (ny + 1048576) as b from crossed),
node as (select kx, ky, ((kx + 1048576) << 21) | (ky + 1048576) as id from passed where passable),
reach(id, root) as (select id, id from node union select e.b, r.root from reach r join edge e on e.a = r.id),
comp as (select n.kx, n.ky, min(r.root) as component from node n join reach r on r.id = n.id group by 1, 2),
near as (select *, sqrt(((kx + 0.5e0) * 8e0) * ((kx + 0.5e0) * 8e0) + ((ky + 0.5e0) * 8e0) * ((ky + 0.5e0) * 8e0)) as d from comp),
seed as (
  select component from (select component, count(*) filter (where d <= 14e0) as n, min(d) as d0 from near group by 1)
  order by n desc, case when n > 0 then component end nulls last, d0 limit 1),
reached as (select p.*, coalesce(c.component = (select component from seed), false) as reachable from passed p left join comp c on c.kx = p.kx and c.ky = p.ky),
verdict as (
  select v.level, v.ix, v.iy, v.cx, v.cy, v.cls, v.key, v.cls >= 2 and t.blocked as blocked, t.slope_deg, t.step,
    v.z_max - v.z_min <= 60e0 and v.n_obs > 0 and not (v.cls >= 2 and t.blocked) and t.slope_deg <= 60e0 as passable, t.reachable as tile_reachable,
    greatest(t.slope_deg / 60e0, t.step / 60e0, (v.z_max - v.z_min) / 0.15e0) as worst, sqrt(v.cx * v.cx + v.cy * v.cy) <= 45e0 as known
  from view2 v join reached t on t.kx = cast(floor(v.cx / 8e0) as bigint) and t.ky = cast(floor(v.cy / 8e0) as bigint)),
judged as (
  select *, passable and tile_reachable as reachable,
    case when blocked then 0e0 when not (passable and tile_reachable) then least(least(greatest(1 - worst, 0e0), 1e0), 0.15e0) else least(greatest(1 - worst, 0e0), 1e0) end as score,
    case when blocked then case when cls = 3 then 3 else 2 end when passable and tile_reachable then 0 else 1 end as terrain
  from verdict)
"""
#: The derived cloud's heights are not a street's, so the tile queries let vehicles climb.
VEHICLE = Vehicle(max_slope_deg=60.0, max_step_height=60.0, nav_cell=8.0)


# ---- parts of plans


def _points(spark, sf_dir):
    return derived.points(spark, sf_dir)


def _measured(spark, sf_dir, lod=WIDE):
    return grid.measure(grid.with_cells(_points(spark, sf_dir), lod), FUSION, by=("frame_index",))


def _first(spark, sf_dir, frame=0, lod=WIDE):
    return grid.first_state(_measured(spark, sf_dir, lod).where(F.col("frame_index") == frame), frame, FUSION)


def _map(spark, sf_dir):
    """All three frames fused."""
    return cut(grid.replay(_measured(spark, sf_dir), FUSION))


def _view(spark, sf_dir):
    return cut(grid.view(_map(spark, sf_dir), WIDE))


def _linked(spark, sf_dir):
    return navigation.link(navigation.tiles(_view(spark, sf_dir), VEHICLE), VEHICLE)


def _reached(spark, sf_dir):
    return navigation.reachable(cut(_linked(spark, sf_dir)), VEHICLE, 0.0, 0.0)


def _verdicts(spark, sf_dir):
    view = _view(spark, sf_dir)
    linked = cut(navigation.link(navigation.tiles(view, VEHICLE), VEHICLE))
    return navigation.verdicts(view, navigation.reachable(linked, VEHICLE, 0.0, 0.0), VEHICLE, 0.0, 0.0)


# ---- cells and levels


@query("select level, count(*) as cells, sum(n_all)::bigint as points, sum(n_ground) * 1e0 / sum(n_all) as ground_share, avg(mean_z) as mean_z, min(overhead) as overhead from fine_m group by level", "level cells points", "ground_share mean_z overhead")
def foveated_map(spark, sf_dir):
    """Cells, points, ground share, height and lowest overhead by level."""
    m = _measured(spark, sf_dir, FINE)
    return m.groupBy("level").agg(F.count("*").alias("cells"), F.sum("n_all").alias("points"), (F.sum("n_ground") / F.sum("n_all")).alias("ground_share"), F.avg("mean_z").alias("mean_z"), F.min("overhead").alias("overhead"))


_FSIZE = "(0.05e0 * (1 << level))"


@query(f"select event_id, level, ix, iy, (((ix + 1048576) & 2097151) << 21) | ((iy + 1048576) & 2097151) as key, (ix + 0.5e0) * {_FSIZE} as cx, (iy + 0.5e0) * {_FSIZE} as cy, ix >> (4 - level) as block_x, iy >> (4 - level) as block_y from fine_at", "event_id level ix iy key block_x block_y", "cx cy")
def point_cells(spark, sf_dir):
    """Level, cell, key, centre and coarsest ancestor of each point; indices come back out of the key."""
    at = grid.with_cells(_points(spark, sf_dir), FINE)
    keyed = at.withColumn("key", geo.pack("ix", "iy")).withColumn("ix", geo.unpack("key", 1)).withColumn("iy", geo.unpack("key", 0))
    size = geo.level_size("level", FINE)
    bx, by = geo.block("level", "ix", "iy", FINE)
    return keyed.select("event_id", "level", "ix", "iy", "key", geo.centre("ix", size).alias("cx"), geo.centre("iy", size).alias("cy"), bx.alias("block_x"), by.alias("block_y"))


@query("select event_id, sqrt(x * x + y * y) as planar, sqrt(x * x + y * y + z * z) as spatial, ln(1 + sqrt(x * x + y * y)) as log_range, degrees(atan2(y, x)) as bearing, cos(0.3e0) * x - sin(0.3e0) * y + 5e0 as wx, sin(0.3e0) * x + cos(0.3e0) * y - 2e0 as wy, z + 1.73e0 as wz, case when sqrt(x * x + y * y) < 10e0 then 0 when sqrt(x * x + y * y) < 20e0 then 1 when sqrt(x * x + y * y) < 40e0 then 2 when sqrt(x * x + y * y) < 70e0 then 3 when sqrt(x * x + y * y) < 100e0 then 4 end as band from pts", "event_id band", "planar spatial log_range bearing wx wy wz")
def point_geometry(spark, sf_dir):
    """Ranges, bearing, band and world place of each point under one pose."""
    wx, wy, wz = geo.to_world(yaw=F.lit(0.3), ox=F.lit(5.0), oy=F.lit(-2.0), oz=F.lit(1.73))
    r = geo.planar_range()
    return _points(spark, sf_dir).select("event_id", r.alias("planar"), geo.spatial_range().alias("spatial"), F.log1p(r).alias("log_range"), F.degrees(F.atan2("y", "x")).alias("bearing"), wx.alias("wx"), wy.alias("wy"), wz.alias("wz"), geo.band(r).alias("band"))


@query("select event_id, (((((cast(floor(x / 0.45e0) as bigint) + 1048576) & 2097151) << 21) | ((cast(floor(y / 0.45e0) as bigint) + 1048576) & 2097151)) << 21) | ((cast(floor(z / 0.45e0) as bigint) + 1048576) & 2097151) as voxel from pts", "event_id voxel")
def voxel_keys(spark, sf_dir):
    """63-bit key of each point's voxel."""
    return _points(spark, sf_dir).select("event_id", geo.pack(*(geo.index(c, features.VOXEL) for c in "xyz")).alias("voxel"))


_MEASURED = "n_all n_ground", "mean_z var_in noise z_min z_max overhead inten ev0 ev1 ev2 ev3"


@query("select frame_index, level, ix, iy, n_all, n_ground, mean_z, var_in, noise, z_min, z_max, overhead, inten, ev0, ev1, ev2, ev3 from wide_m", "frame_index level ix iy " + _MEASURED[0], _MEASURED[1])
def cell_measurements(spark, sf_dir):
    """What each frame's points say of each cell."""
    return _measured(spark, sf_dir).drop("reach")


_FULL = "level ix iy n_obs last_seen", "z var z_min z_max inten ev0 ev1 ev2 ev3 overhead"


def _two(spark, sf_dir):
    """Frames 0 and 1 fused by a full outer join."""
    return grid.fuse(_first(spark, sf_dir), _measured(spark, sf_dir).where("frame_index = 1"), 1, FUSION)


@query(f"select level, ix, iy, {_STATE} from map2", *_FULL)
def fuse_frames(spark, sf_dir):
    """Frames 1 and 2 fused into the map of frame 0, a full outer join each."""
    return grid.fuse(_two(spark, sf_dir), _measured(spark, sf_dir).where("frame_index = 2"), 2, FUSION)


@query(f"select level, ix, iy, {_STATE} from map2", *_FULL)
def replay_frames(spark, sf_dir):
    """Three frames folded in order inside each cell."""
    return grid.replay(_measured(spark, sf_dir), FUSION)


_UP = "select level + 1 as level, ix >> 1 as ix, iy >> 1 as iy, sum(z / var) / sum(1 / var) as z, 1 / sum(1 / var) as var, min(z_min) as z_min, max(z_max) as z_max, avg(inten) as inten, cast(sum(n_obs) as bigint) as n_obs, sum(ev0) as ev0, sum(ev1) as ev1, sum(ev2) as ev2, sum(ev3) as ev3, min(overhead) as overhead, max(last_seen) as last_seen from {} group by 1, 2, 3"


@query(_UP.format("(select * from map2 where level < 4)"), *_FULL)
def coarsen_cells(spark, sf_dir):
    """Cells to their parents."""
    return grid.coarsen(_map(spark, sf_dir).where("level < 4"))


_DOWN = "select level - 1 as level, 2 * ix + a as ix, 2 * iy + b as iy, z, var + 0.35e0 * (z_max - z_min) * (z_max - z_min) as var, z_min, z_max, inten, n_obs >> 2 as n_obs, ev0 / 4 as ev0, ev1 / 4 as ev1, ev2 / 4 as ev2, ev3 / 4 as ev3, overhead, last_seen from {}, range(0, 2) r1(a), range(0, 2) r2(b)"


@query(_DOWN.format("(select * from map2 where level > 0)"), *_FULL)
def refine_cells(spark, sf_dir):
    """Cells to their children."""
    return grid.refine(_map(spark, sf_dir).where("level > 0"), FUSION)


_MERGE = """select coalesce(o.level, m.level) as level, coalesce(o.ix, m.ix) as ix, coalesce(o.iy, m.iy) as iy,
  case when m.level is null then o.z when o.level is null then m.z else (o.z / o.var + m.z / m.var) / (1 / o.var + 1 / m.var) end as z,
  case when m.level is null then o.var when o.level is null then m.var else 1 / (1 / o.var + 1 / m.var) end as var,
  least(o.z_min, m.z_min) as z_min, greatest(o.z_max, m.z_max) as z_max, coalesce(o.inten, m.inten) as inten, coalesce(o.n_obs, 0) + coalesce(m.n_obs, 0) as n_obs,
  coalesce(o.ev0, 0) + coalesce(m.ev0, 0) as ev0, coalesce(o.ev1, 0) + coalesce(m.ev1, 0) as ev1, coalesce(o.ev2, 0) + coalesce(m.ev2, 0) as ev2, coalesce(o.ev3, 0) + coalesce(m.ev3, 0) as ev3,
  least(o.overhead, m.overhead) as overhead, greatest(o.last_seen, m.last_seen) as last_seen
from {} o full outer join {} m on o.level = m.level and o.ix = m.ix and o.iy = m.iy"""


@query(_MERGE.format("map1", "(select * from wide_first where frame_index = 2)"), *_FULL)
def merge_cells(spark, sf_dir):
    """The map of two frames and that of a third merged by precision."""
    return grid.merge(_two(spark, sf_dir), _first(spark, sf_dir, 2))


@query("select level, ix, iy from map2 where sqrt(((ix + 0.5e0) * (0.5e0 * (1 << level)) - 25e0) * ((ix + 0.5e0) * (0.5e0 * (1 << level)) - 25e0) + ((iy + 0.5e0) * (0.5e0 * (1 << level))) * ((iy + 0.5e0) * (0.5e0 * (1 << level)))) <= 1.05e0 * 100e0 and 26 - last_seen <= 25", "level ix iy")
def prune_cells(spark, sf_dir):
    """Cells left by range and age at frame 26 for a sensor at x = 25."""
    return grid.prune(_map(spark, sf_dir), WIDE, FUSION, 25.0, 0.0, 26).select("level", "ix", "iy")


@query("select count(*) filter (where kept) as kept, count(*) filter (where not kept) as removed from (select sqrt(((ix + 0.5e0) * (0.5e0 * (1 << level)) - 60e0) * ((ix + 0.5e0) * (0.5e0 * (1 << level)) - 60e0) + ((iy + 0.5e0) * (0.5e0 * (1 << level))) * ((iy + 0.5e0) * (0.5e0 * (1 << level)))) <= 1.05e0 * 100e0 and 27 - last_seen <= 25 as kept from map2)", "kept removed")
def pruned_counts(spark, sf_dir):
    """How many cells are left and go by range and age at frame 27 for a sensor at x = 60."""
    return grid.pruned(_map(spark, sf_dir), WIDE, FUSION, 60.0, 0.0, 27)


def _wanted_level(lod: Lod, sx: float, sy: float) -> str:
    """SQL of the level that a sensor at (sx, sy) asks for at the centre of a cell."""
    def away(i: str, s0: float, size: float) -> str:
        low = f"(floor(({i} + 0.5e0) * ({_d(lod.base_cell)} * (1 << level)) / {_d(size)}) * {_d(size)})"
        return f"greatest({low} - {_d(s0)}, {_d(s0)} - ({low} + {_d(size)}), 0.0e0)"

    far = lambda k: f"sqrt({away('ix', sx, lod.size(k))} * {away('ix', sx, lod.size(k))} + {away('iy', sy, lod.size(k))} * {away('iy', sy, lod.size(k))}) >= {_d(lod.ring_radii[k])}"
    return "case " + " ".join(f"when {far(k)} then {k}" for k in range(lod.n_levels - 1, 0, -1)) + " else 0 end"


def _rebalance_sql(lod: Lod, sx: float, sy: float) -> str:
    """The sweeps unrolled: each step takes what belongs elsewhere and merges it one level on."""
    parts, now = [], {}
    for sweep, (levels, step, sign) in enumerate(((range(lod.n_levels - 1), 1, ">"), (range(lod.n_levels - 1, 0, -1), -1, "<"))):
        source = "map2" if not sweep else "(" + " union all ".join(f"select * from {now[k]}" for k in sorted(now)) + ")"
        for k in range(lod.n_levels):
            parts.append(f"s{sweep}_{k} as (select level, ix, iy, {_STATE} from {source} x where level = {k})")
        now = {k: f"s{sweep}_{k}" for k in range(lod.n_levels)}
        for k in levels:
            goes, to = f"({_wanted_level(lod, sx, sy)}) {sign} {k}", k + step
            moving = f"(select * from {now[k]} where {goes})"
            parts.append(f"m{sweep}_{k} as ({(_UP if step > 0 else _DOWN).format(moving)})")
            parts.append(f"g{sweep}_{to} as ({_MERGE.format(now[to], f'm{sweep}_{k}')})")
            parts.append(f"t{sweep}_{k} as (select * from {now[k]} where not ({goes}))")
            now[to], now[k] = f"g{sweep}_{to}", f"t{sweep}_{k}"
    return "with " + ", ".join(parts) + " " + " union all ".join(f"select level, ix, iy, {_STATE} from {now[k]}" for k in sorted(now))


@query(_rebalance_sql(WIDE, 10.0, 4.0), *_FULL)
def rebalance_cells(spark, sf_dir):
    """The map after the sensor moved to (10, 4): whole sweeps up and down the levels."""
    return grid.rebalance(_map(spark, sf_dir), WIDE, FUSION, 10.0, 4.0, cut)


@query("select level, ix, iy, cls, key, size, cx, cy, confidence, z, overhead from view2", "level ix iy cls key", "size cx cy confidence z overhead")
def map_view(spark, sf_dir):
    """The flat map with classes."""
    return _view(spark, sf_dir).select("level", "ix", "iy", "cls", "key", "size", "cx", "cy", "confidence", "z", "overhead")


_LOOKUP = "select p.event_id, min(c.level) as level, arg_min({}, c.level) as {} from pts p left join {} c on c.ix = cast(floor((p.x + 1.5e0) / (0.5e0 * (1 << c.level))) as bigint) and c.iy = cast(floor(p.y / (0.5e0 * (1 << c.level))) as bigint) group by 1"


@query(_LOOKUP.format("c.z", "elevation", "map2"), "event_id level", "elevation")
def elevation_at(spark, sf_dir):
    """Height and level of the finest cell under each point moved by 1.5 m."""
    asked = _points(spark, sf_dir).withColumn("x", F.col("x") + 1.5)
    return grid.lookup(asked, _map(spark, sf_dir), WIDE, ["event_id"], ["z"]).withColumnRenamed("z", "elevation")


@query(f"select count(*) as cells, count(*) * {CELL_BYTES} as map_bytes, 400::bigint * 400 * {CELL_BYTES} as uniform_fine_bytes, 25::bigint * 25 * {CELL_BYTES} as uniform_coarse_bytes, (400::bigint * 400 * 40) // 8 as voxel_bytes, (select count(*) from pts) * {POINT_BYTES} as raw_points_bytes, 400 * 400 * {CELL_BYTES} * 1e0 / greatest(count(*) * {CELL_BYTES}, 1) as reduction from map2", "cells map_bytes uniform_fine_bytes uniform_coarse_bytes voxel_bytes raw_points_bytes", "reduction")
def memory_report(spark, sf_dir):
    """Bytes of the map and of what it replaces."""
    p = _points(spark, sf_dir)
    return grid.memory(_map(spark, sf_dir), WIDE, p.count(), CELL_BYTES, POINT_BYTES)


def _finest(x: str, y: str, cells: str, k: str = "c") -> str:
    return f"{k}.ix = cast(floor(({x}) / (0.5e0 * (1 << {k}.level))) as bigint) and {k}.iy = cast(floor(({y}) / (0.5e0 * (1 << {k}.level))) as bigint)"


@query(f"""select level, ix, iy, dx, dy, step, n_level, n_ix, n_iy, step * {_SIZE} as distance from (
  select a.level, a.ix, a.iy, dx, dy, step, arg_min(c.level, c.level) as n_level, arg_min(c.ix, c.level) as n_ix, arg_min(c.iy, c.level) as n_iy,
    row_number() over (partition by a.level, a.ix, a.iy, dx, dy order by step) as k
  from (select *, (ix + 0.5e0) * {_SIZE} as cx, (iy + 0.5e0) * {_SIZE} as cy, {_SIZE} as size from map2) a, (values (1, 0), (-1, 0), (0, 1), (0, -1)) s(dx, dy), (select cast(r as integer) as step from range(1, 7) r(r)) t, map2 c
  where {_finest('a.cx + dx * step * a.size', 'a.cy + dy * step * a.size', 'map2')}
  group by a.level, a.ix, a.iy, dx, dy, step having not (arg_min(c.level, c.level) = a.level and arg_min(c.ix, c.level) = a.ix and arg_min(c.iy, c.level) = a.iy)) where k = 1""", "level ix iy dx dy step n_level n_ix n_iy", "distance")
def nearest_cells(spark, sf_dir):
    """The first other cell, of any level, within six widths of each cell in four directions."""
    return navigation.nearest_cells(_map(spark, sf_dir), WIDE)


# ---- navigation


@query("select kx, ky, n_cells, has_ground, blocked, overhead_only, z, relief from tiles", "kx ky n_cells has_ground blocked overhead_only", "z relief")
def nav_tiles(spark, sf_dir):
    """Navigation tiles."""
    return navigation.tiles(_view(spark, sf_dir), VEHICLE)


@query("select kx, ky, passable, step, slope_deg from passed", "kx ky passable", "step slope_deg")
def nav_links(spark, sf_dir):
    """Slope, step and passability from the nearest tiles in four directions."""
    return _linked(spark, sf_dir).select("kx", "ky", "passable", "step", "slope_deg")


@query("select kx, ky, nx, ny, distance from link", "kx ky nx ny", "distance")
def nav_edges(spark, sf_dir):
    """Links between tiles."""
    return navigation.edges(_linked(spark, sf_dir)).select("kx", "ky", "nx", "ny", "distance")


@query("select kx, ky, nx, ny from crossed", "kx ky nx ny")
def nav_crossable(spark, sf_dir):
    """Links that a vehicle can take."""
    return navigation.crossable(cut(_linked(spark, sf_dir)), VEHICLE)


@query("select kx, ky, component from comp", "kx ky component")
def nav_components(spark, sf_dir):
    """Connected components of tiles."""
    return navigation.components(cut(_linked(spark, sf_dir)), VEHICLE)


@query("select kx, ky, passable, reachable from reached", "kx ky passable reachable")
def nav_reachable(spark, sf_dir):
    """Tiles that the vehicle can reach."""
    return _reached(spark, sf_dir).select("kx", "ky", "passable", "reachable")


@query("select level, ix, iy, blocked, passable, reachable, known, terrain, score from judged", "level ix iy blocked passable reachable known terrain", "score")
def traversability(spark, sf_dir):
    """Score and verdict of each cell."""
    return _verdicts(spark, sf_dir).select("level", "ix", "iy", "blocked", "passable", "reachable", "known", "terrain", "score")


@query("""select p.event_id, any_value(p.cls) as label, case when any_value(p.cls) = 0 and not coalesce(arg_min((j.reachable and j.passable) or not j.known, j.level), false) then 1 else any_value(p.cls) end as refined_label
from pts p left join judged j on j.ix = cast(floor(p.x / (0.5e0 * (1 << j.level))) as bigint) and j.iy = cast(floor(p.y / (0.5e0 * (1 << j.level))) as bigint) group by 1""", "event_id label refined_label")
def demoted_points(spark, sf_dir):
    """Points whose drivable label the map takes back."""
    p = _points(spark, sf_dir)
    found = grid.lookup(p, _verdicts(spark, sf_dir), WIDE, ["event_id"], ["passable", "reachable", "known"])
    return navigation.demote(p.select("event_id", F.col("cls").alias("label")), found, ["event_id"])


def _relaxed(steps: int) -> str:
    """CTEs r0 .. r<steps>: cheapest ways of at most so many links from each request's start."""
    out = ["r0 as materialized (select request, start as node, 0e0 as cost, 1::bigint as tiles, 0e0 as length, 0e0 as climb from ends)"]
    for k in range(steps):
        more = f"select r.request, l.b, r.cost + l.flat + 6e0 * l.rise, r.tiles + 1, r.length + l.distance, r.climb + l.rise from r{k} r join leg l on l.a = r.node"
        out.append(f"r{k + 1} as materialized (select request, node, min(cost) as cost, arg_min(tiles, cost) as tiles, arg_min(length, cost) as length, arg_min(climb, cost) as climb from (select * from r{k} union all {more}) group by 1, 2)")
    return ", ".join(out)


_GOALS = ((60.0, 0.0), (-60.0, 10.0), (0.0, 70.0), (20.0, -70.0))


def _nearest_usable(x: str, y: str) -> str:
    return f"first(u.id order by ((u.kx + 0.5e0) * 8e0 - {x}) * ((u.kx + 0.5e0) * 8e0 - {x}) + ((u.ky + 0.5e0) * 8e0 - {y}) * ((u.ky + 0.5e0) * 8e0 - {y}), u.kx, u.ky)"


@query(f"""with usable as (select kx, ky, ((kx + 1048576) << 21) | (ky + 1048576) as id, z, 1 + 2.5e0 * least(greatest(slope_deg / 60e0, 0e0), 1e0) as price from reached where passable and reachable),
leg as (select a.id as a, b.id as b, l.distance, l.distance * b.price as flat, abs(b.z - a.z) as rise from link l join usable a on a.kx = l.kx and a.ky = l.ky join usable b on b.kx = l.nx and b.ky = l.ny where abs(b.z - a.z) <= 60e0),
asked(request, gx, gy) as (values {', '.join(f'({i}::bigint, {_d(x)}, {_d(y)})' for i, (x, y) in enumerate(_GOALS))}),
ends as (select request, {_nearest_usable('0e0', '0e0')} as start, {_nearest_usable('any_value_gx', 'any_value_gy')} as goal from (select request, gx as any_value_gx, gy as any_value_gy from asked) q, usable u group by request, any_value_gx, any_value_gy),
{_relaxed(64)}
select r.request, tiles, cost, length, climb from r64 r join ends e on e.request = r.request and e.goal = r.node""", "request tiles", "cost length climb")
def planned_routes(spark, sf_dir):
    """Routes over the map to four goals."""
    goals = spark.createDataFrame([(i, 0.0, 0.0, gx, gy) for i, (gx, gy) in enumerate(_GOALS)], "request long, sx double, sy double, gx double, gy double")
    return navigation.route_summary(navigation.routes(_reached(spark, sf_dir), goals, VEHICLE))


@query("""select kx, ky, count(*) as n, min(level) as finest, max(level) as coarsest from (
  select level, cast(floor((cx - 0.5e0 * size + 0.000001e0) / 2e0) as bigint) + a as kx, cast(floor((cy - 0.5e0 * size + 0.000001e0) / 2e0) as bigint) + b as ky
    from (select *, greatest(cast(round_even(size / 2e0, 0) as bigint), 1) as f from view2) v, range(0, 4) r1(a), range(0, 4) r2(b) where f > 1 and a < f and b < f
  union all select level, cast(floor(cx / 2e0) as bigint), cast(floor(cy / 2e0) as bigint) from view2 where size <= 2e0) group by 1, 2""", "kx ky n finest coarsest")
def covered_tiles(spark, sf_dir):
    """Tiles of 2 m that cells of up to 8 m cover."""
    spread = navigation.cover(_view(spark, sf_dir), 2.0)
    return spread.groupBy("kx", "ky").agg(F.count("*").alias("n"), F.min("level").alias("finest"), F.max("level").alias("coarsest"))


# ---- features


@query("select cast(floor(x / 9e0) as bigint) as vx, cast(floor(y / 9e0) as bigint) as vy, cast(floor(z / 9e0) as bigint) as vz, count(*) as n, covar_pop(x, x) as cxx, covar_pop(y, y) as cyy, covar_pop(z, z) as czz, covar_pop(x, y) as cxy, covar_pop(x, z) as cxz, covar_pop(y, z) as cyz from pts group by 1, 2, 3", "vx vy vz n", "cxx cyy czz cxy cxz cyz")
def voxel_moments(spark, sf_dir):
    """Covariance of the points of each 9 m voxel."""
    return features.moments(_points(spark, sf_dir), (), 9.0)


@query("select event_id, min(z) over w as column_low, max(z) over w - min(z) over w as column_span from pts window w as (partition by floor(x / 6e0), floor(y / 6e0))", "event_id", "column_low column_span")
def column_spans(spark, sf_dir):
    """Lowest point and span of each point's vertical column."""
    return features.columns_of(_points(spark, sf_dir), (), 6.0).select("event_id", "column_low", "column_span")


def _shapes_sql(source: str) -> str:
    """CTEs from (.., n, cxx .. cyz) of `source` to `shape` with the five shape columns: eigenvalues by the cosine rule."""
    w = lambda k, i, j: f"u{k} * u{k} + v{k} * v{k} + w{k} * w{k} as n{k}"
    rows = (("a", "cxy", "cxz"), ("cxy", "b", "cyz"), ("cxz", "cyz", "c"))
    cross = []
    for k, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        (a1, a2, a3), (b1, b2, b3) = rows[i], rows[j]
        cross += [f"{a2} * {b3} - {a3} * {b2} as u{k}", f"{a3} * {b1} - {a1} * {b3} as v{k}", f"abs({a1} * {b2} - {a2} * {b1}) as w{k}"]
    beats = lambda k, *others: " and ".join(f"(n{k} > n{o} or n{k} = n{o} and w{k} >= w{o})" for o in others)
    pick = lambda v: f"case when {beats(0, 1, 2)} then {v}0 when {beats(1, 2)} then {v}1 else {v}2 end"
    return f"""e1 as (select *, (cxx + cyy + czz + 3e-9) / 3 as mean from {source}),
e2 as (select *, cxx + 1e-9 - mean as da, cyy + 1e-9 - mean as db, czz + 1e-9 - mean as dc from e1),
e3 as (select *, sqrt((da * da + db * db + dc * dc + 2 * (cxy * cxy + cxz * cxz + cyz * cyz)) / 6) as p, da * (db * dc - cyz * cyz) - cxy * (cxy * dc - cyz * cxz) + cxz * (cxy * cyz - db * cxz) as det from e2),
e4 as (select *, acos(least(greatest(case when p > 0 then det / (2 * p * p * p) else 1 end, -1e0), 1e0)) / 3 as phi from e3),
e5 as (select *, mean + 2 * p * cos(phi) as high, mean + 2 * p * cos(phi + 2 * pi() / 3) as low from e4),
e6 as (select *, 3 * mean - high - low as mid, cxx + 1e-9 - low as a, cyy + 1e-9 - low as b, czz + 1e-9 - low as c from e5),
e7 as (select *, {', '.join(cross)} from e6),
e8 as (select *, {', '.join(w(k, 0, 0) for k in range(3))}, greatest(high, 1e-12) as top from e7),
shape as (select *, case when n >= 4 then (top - mid) / top else 0e0 end as linearity, case when n >= 4 then (mid - low) / top else 0e0 end as planarity, case when n >= 4 then least(greatest(low / top, 0e0), 1e0) else 1e0 end as scattering,
  case when n >= 4 then case when {pick('n')} > 0 then {pick('w')} / sqrt({pick('n')}) else 1e0 end else 0e0 end as normal_z, case when n >= 4 then sqrt(greatest(low, 0e0)) else 0e0 end as roughness from e8)"""


def _moments_sql(size: str, by: str = "") -> str:
    return f"select {by}cast(floor(x / {size}) as bigint) as vx, cast(floor(y / {size}) as bigint) as vy, cast(floor(z / {size}) as bigint) as vz, count(*) as n, covar_pop(x, x) as cxx, covar_pop(y, y) as cyy, covar_pop(z, z) as czz, covar_pop(x, y) as cxy, covar_pop(x, z) as cxz, covar_pop(y, z) as cyz from pts group by all"


_NORMAL = ", ".join(f"({n} - ({_d(m)})) / {_d(d)} as {n}" for n, m, d in zip(features.NAMES, features.MEAN, features.STD))


@query(f"""with mo as ({_moments_sql('0.45e0', 'frame_index, ')}), {_shapes_sql('mo')},
placed as (select *, cast(floor(x / 0.45e0) as bigint) as vx, cast(floor(y / 0.45e0) as bigint) as vy, cast(floor(z / 0.45e0) as bigint) as vz, min(z) over w as low_z, max(z) over w - min(z) over w as span, sqrt(x * x + y * y) as reach
  from pts window w as (partition by frame_index, floor(x / 1.2e0), floor(y / 1.2e0))),
f as (select t.frame_index, event_id as point_id, t.vx, t.vy, t.vz, t.z as f_z, ln(1 + reach) as f_log_range, intensity as f_intensity, t.z - low_z as f_height, span as f_span, ln(1 + s.n) as f_log_count, linearity as f_linearity, planarity as f_planarity,
  scattering as f_scattering, 1 - normal_z as f_tilt, normal_z as f_normal_z, roughness as f_roughness, atan2(t.z, greatest(reach, 0.001e0)) as f_elevation
  from placed t join shape s on s.frame_index = t.frame_index and s.vx = t.vx and s.vy = t.vy and s.vz = t.vz)
select frame_index, point_id, vx, vy, vz, {_NORMAL} from f""", "frame_index point_id vx vy vz", " ".join(features.NAMES), digits=4)
def point_features(spark, sf_dir):
    """The thirteen features of each point, normalised."""
    return features.normalised(features.features(_points(spark, sf_dir).select("frame_index", "point_id", "x", "y", "z", "intensity"))).drop("x", "y", "z", "intensity")


@query(f"with mo as ({_moments_sql('9e0')}), {_shapes_sql('mo')} select vx, vy, vz, n, linearity, planarity, scattering, normal_z, roughness from shape", "vx vy vz n", "linearity planarity scattering normal_z roughness", digits=4)
def voxel_shapes(spark, sf_dir):
    """Linearity, planarity, scattering, normal and roughness of 9 m voxels, in closed form."""
    return features.shapes(features.moments(_points(spark, sf_dir), (), 9.0)).select("vx", "vy", "vz", "n", "linearity", "planarity", "scattering", "normal_z", "roughness")


@query("select cast(floor(x / 9e0) as bigint) as vx, cast(floor(y / 9e0) as bigint) as vy, cast(floor(z / 9e0) as bigint) as vz, avg(x) as mx, avg(y) as my, avg(z) as mz, max(intensity) as max_intensity from pts group by 1, 2, 3", "vx vy vz", "mx my mz max_intensity")
def voxel_centroids(spark, sf_dir):
    """Mean place and largest intensity of each voxel."""
    return features.centroids(_points(spark, sf_dir), ["intensity"], (), 9.0)


_ZONE = "case when sqrt(x * x + y * y) < 15e0 then 0 when sqrt(x * x + y * y) < 30e0 then 1 else 2 end"
_VOX = "floor(x / 0.45e0), floor(y / 0.45e0), floor(z / 0.45e0)"


@query(f"select event_id, zone = 0 or (n - 1) % case when zone = 1 then 2 else 5 end = 0 or event_id = first as selected from (select event_id, zone, row_number() over (partition by frame_index, zone order by event_id) as n, min(event_id) over (partition by frame_index, {_VOX}) as first from (select *, {_ZONE} as zone from pts))", "event_id selected")
def foveated_selection(spark, sf_dir):
    """Which points a foveated segmenter looks at."""
    return features.foveated(_points(spark, sf_dir), 15.0, 30.0, 2, 5).select("event_id", "selected")


_SHARE = ", ".join(f"case when s then p{k} else coalesce(sum(case when s then p{k} end) over w, 0e0) / greatest(coalesce(sum(case when s then p0 end) over w, 0e0) + coalesce(sum(case when s then p1 end) over w, 0e0) + coalesce(sum(case when s then p2 end) over w, 0e0) + coalesce(sum(case when s then p3 end) over w, 0e0), 0.000001e0) end as p{k}" for k in range(4))
_PROBS = ", ".join(f"case when cls = {k} then 0.88e0 else 0.04e0 end as p{k}" for k in range(4))


@query(f"select event_id, {_SHARE} from (select *, event_id % 2 = 0 as s, {_PROBS} from pts) window w as (partition by frame_index, {_VOX})", "event_id", "p0 p1 p2 p3")
def shared_evidence(spark, sf_dir):
    """Evidence of skipped points from their voxel's selected ones."""
    return features.share_evidence(_points(spark, sf_dir).withColumn("selected", F.col("event_id") % 2 == 0)).select("event_id", "p0", "p1", "p2", "p3")


# ---- metrics

_PRED = "case when event_id % 7 = 0 then (cls + 1) % 4 else cls end"
_BAND = "case when sqrt(x * x + y * y) < 10e0 then 0 when sqrt(x * x + y * y) < 20e0 then 1 when sqrt(x * x + y * y) < 40e0 then 2 when sqrt(x * x + y * y) < 70e0 then 3 when sqrt(x * x + y * y) < 100e0 then 4 end"


def _said(spark, sf_dir):
    return _points(spark, sf_dir).withColumn("gt", F.col("cls")).withColumn("pred", F.when(F.col("event_id") % 7 == 0, (F.col("cls") + 1) % 4).otherwise(F.col("cls"))).withColumn("band", geo.band(geo.planar_range()))


@query(f"select {_BAND} as band, cls as gt, {_PRED} as pred, count(*) as n from pts group by 1, 2, 3", "band gt pred n")
def band_confusion(spark, sf_dir):
    """Confusion by range band."""
    return metrics.confusion(_said(spark, sf_dir), by=("band",))


@query(f"""select cls, tp, fp, fn, points, iou, recall, precision, accuracy, avg(iou) over () as miou from (
  select c as cls, cast(sum(case when gt = c and pred = c then 1 else 0 end) as bigint) as tp, cast(sum(case when gt <> c and pred = c then 1 else 0 end) as bigint) as fp, cast(sum(case when gt = c and pred <> c then 1 else 0 end) as bigint) as fn, count(*) as points,
    sum(case when gt = c and pred = c then 1e0 else 0 end) / greatest(sum(case when gt = c or pred = c then 1e0 else 0 end), 1) as iou,
    sum(case when gt = c and pred = c then 1e0 else 0 end) / greatest(sum(case when gt = c then 1e0 else 0 end), 1) as recall,
    sum(case when gt = c and pred = c then 1e0 else 0 end) / greatest(sum(case when pred = c then 1e0 else 0 end), 1) as precision, avg(case when gt = pred then 1e0 else 0 end) as accuracy
  from (select cls as gt, {_PRED} as pred from pts), (values (0), (1), (2), (3)) v(c) group by 1)""", "cls tp fp fn points", "iou recall precision accuracy miou")
def class_scores(spark, sf_dir):
    """IoU, recall, precision of each class, accuracy and mean IoU."""
    return metrics.scores(metrics.confusion(_said(spark, sf_dir)))


@query("select case when d < 10 then 0 when d < 20 then 1 when d < 40 then 2 when d < 70 then 3 when d < 100 then 4 end as band, count(*) as cells, quantile_cont(size, 0.5) as median_size, sqrt(avg(e * e)) as rmse, avg(abs(e)) as mae, avg(e) as bias, quantile_cont(abs(e), 0.95) as p95_abs from (select v.size, v.z - 0.01e0 * v.cx as e, sqrt(v.cx * v.cx + v.cy * v.cy) as d from view2 v join judged j on j.level = v.level and j.ix = v.ix and j.iy = v.iy where j.passable) where d < 100 group by 1", "band cells", "median_size rmse mae bias p95_abs")
def elevation_errors(spark, sf_dir):
    """Errors of passable cells against a sloping plane, by band."""
    return metrics.elevation_error(_verdicts(spark, sf_dir).where("passable"), F.col("cx") * 0.01, 0.0, 0.0)


@query("select event_type, count(value) as n, avg(value) as mean_ms, quantile_cont(value, 0.95) as p95_ms, 1000 / avg(value) as fps_mean, 1000 / quantile_cont(value, 0.95) as fps_worst from events group by 1", "event_type n", "mean_ms p95_ms fps_mean fps_worst")
def latency_stats(spark, sf_dir):
    """Latency figures of values by type."""
    return metrics.latency(table(spark, sf_dir, "events"), "value", ("event_type",))


@query("""select cls, n, weight from (select cls, n, raw / avg(raw) over () as weight from (
  select c as cls, coalesce(n, 0) as n, 1 / sqrt(greatest(coalesce(n, 0) * 1e0 / sum(coalesce(n, 0)) over (), 0.000001e0)) as raw
  from (values (0), (1), (2), (3)) v(c) left join (select cls, count(*) as n from pts where cls <> 3 group by 1) k on k.cls = c))""", "cls n", "weight")
def class_weights(spark, sf_dir):
    """Weights of classes; class 3 stands for unknown here."""
    return metrics.class_weights(_points(spark, sf_dir).select(F.when(F.col("cls") == 3, 255).otherwise(F.col("cls")).alias("label")))


@query("select cast(l as integer) as level, count(m.level) as cells from range(0, 5) r(l) left join map2 m on m.level = l group by 1", "level cells")
def level_histogram(spark, sf_dir):
    """Cells by level, empty levels included."""
    return metrics.level_histogram(_map(spark, sf_dir), WIDE)


@query("select f.l as fine, c.l as coarse, (select count(*) from (select distinct ix >> (c.l - f.l) as ix, iy >> (c.l - f.l) as iy from map2 where level = f.l) a join map2 m on m.level = c.l and m.ix = a.ix and m.iy = a.iy) as n from (values (0), (1), (2), (3), (4)) f(l), (values (0), (1), (2), (3), (4)) c(l) where f.l < c.l", "fine coarse n")
def ancestor_overlaps(spark, sf_dir):
    """Cells whose ancestor is on the map too."""
    return metrics.overlaps(_map(spark, sf_dir), WIDE)


_RING = f"case level when 1 then 10e0 when 2 then 20e0 when 3 then 40e0 else 70e0 end"
_NEAR = lambda i: f"greatest({i} * {_SIZE}, -{i} * {_SIZE} - {_SIZE}, 0e0)"


def _audit_sql(cells: str) -> str:
    off = lambda i: f"abs({i} * {_SIZE} - round_even({i} * {_SIZE} / 0.5e0, 0) * 0.5e0)"
    return f"""select (select avg(case when level is null then 0e0 else 1e0 end) from found) as points_mapped, (select coalesce(avg(case when level is not null then case when level = leaf then 1e0 else 0e0 end end), 1e0) from found) as leaf_level_consistency,
  (select count(*) from (select distinct a.level as fine, b.level as coarse, b.ix, b.iy from {cells} a join {cells} b on b.level > a.level and b.ix = a.ix >> (b.level - a.level) and b.iy = a.iy >> (b.level - a.level))) as cross_level_overlaps,
  (select count(*) from {cells} where level > 0 and sqrt({_NEAR('ix')} * {_NEAR('ix')} + {_NEAR('iy')} * {_NEAR('iy')}) < {_RING} - 0.000001e0) as ring_violations, (select coalesce(max(greatest({off('ix')}, {off('iy')})), 0e0) from {cells}) as alignment_error
from (select 1)"""


def _found_sql(cells: str) -> str:
    return f"found as (select p.event_id, any_value(p.level) as leaf, min(c.level) as level from wide_pts p left join {cells} c on {_finest('p.x', 'p.y', cells)} group by 1)"


_AUDIT = "cross_level_overlaps ring_violations", "points_mapped leaf_level_consistency alignment_error"


@query(f"with {_found_sql('map2')} {_audit_sql('map2')}", *_AUDIT)
def integrity_audit(spark, sf_dir):
    """The map's invariants, measured."""
    return metrics.audit(_points(spark, sf_dir), _map(spark, sf_dir), WIDE, 0.0, 0.0, ["point_id"])


#: Some cells gone, and parents beside their children, some of them nearer than their level may be.
_DAMAGED = f"damaged as (select level, ix, iy, z from map2 where pmod_(ix + iy, 7) <> 0 union select level + 1, ix >> 1, iy >> 1, max(0e0) from map2 where level < 4 and pmod_(ix * 3 + iy, 11) = 0 group by 1, 2, 3)".replace("pmod_(ix + iy, 7)", "((ix + iy) % 7 + 7) % 7").replace("pmod_(ix * 3 + iy, 11)", "((ix * 3 + iy) % 11 + 11) % 11")


@query(f"with {_DAMAGED}, {_found_sql('damaged')} {_audit_sql('damaged')}", *_AUDIT)
def damaged_audit(spark, sf_dir):
    """The same figures of a map that breaks them."""
    cells = _map(spark, sf_dir).select(*grid.KEY, "z")
    parents = cells.where("level < 4 and pmod(ix * 3 + iy, 11) = 0").select((F.col("level") + 1).alias("level"), F.shiftright("ix", 1).alias("ix"), F.shiftright("iy", 1).alias("iy"), F.lit(0.0).alias("z"))
    return metrics.audit(_points(spark, sf_dir), cut(cells.where("pmod(ix + iy, 7) <> 0").unionByName(parents).distinct()), WIDE, 0.0, 0.0, ["point_id"])


@query("select count(*) as scans, min(n) as points_min, max(n) as points_max, avg(n) as points_mean from (select frame_index, count(*) as n from pts group by 1)", "scans points_min points_max", "points_mean")
def scan_report(spark, sf_dir):
    """Scans and their sizes."""
    return metrics.scan_report(_points(spark, sf_dir), "frame_index")


@query(f"select avg(a) as accuracy from (select frame_index, avg(case when cls = {_PRED} then 1e0 else 0 end) as a from pts group by 1)", "", "accuracy")
def frame_accuracy(spark, sf_dir):
    """Mean over frames of accuracy."""
    return metrics.frame_accuracy(_said(spark, sf_dir))


# ---- rasters

_IJ = "cast(trunc((y + 100e0) / 4e0) as integer) as i, cast(trunc((x + 100e0) / 4e0) as integer) as j"
_LOW = f"select frame_index, i, j, min(z) as v, max(case when z < low + 0.4e0 then z end) - min(z) as relief from (select *, min(z) over (partition by frame_index, i, j) as low from (select frame_index, {_IJ}, z from pts)) group by 1, 2, 3"


def _low(spark, sf_dir):
    return raster.lowest(_points(spark, sf_dir), 100.0, 4.0)


@query(_LOW, "frame_index i j", "v relief")
def ground_cells(spark, sf_dir):
    """Lowest return and relief of each 4 m raster cell."""
    return _low(spark, sf_dir)


_STEPS = "(values (1, 0), (-1, 0), (0, 1), (0, -1)) s(di, dj)"


@query(f"with g as ({_LOW}) select a.frame_index, a.i, a.j, coalesce(max(abs(a.v - b.v)), 0e0) as step from g a, {_STEPS} left join g b on b.frame_index = a.frame_index and b.i = a.i + di and b.j = a.j + dj group by 1, 2, 3", "frame_index i j", "step")
def raster_steps(spark, sf_dir):
    """Largest step to a neighbour."""
    return raster.step_height(_low(spark, sf_dir))


@query(f"with g as ({_LOW}) select frame_index, i, j from g union select frame_index, i + di, j + dj from g, {_STEPS}", "frame_index i j")
def raster_dilated(spark, sf_dir):
    """Observed cells and their neighbours."""
    return raster.dilate(_low(spark, sf_dir))


_PLACE = "(frame_index * 1048576 + i) * 1048576 + j"


@query(f"""with recursive g as (select *, {_PLACE} as id from ({_LOW})),
e as (select a.id as a, b.id as b from g a, {_STEPS} join g b on b.frame_index = a.frame_index and b.i = a.i + di and b.j = a.j + dj where abs(a.v - b.v) <= 0.2e0),
r(id, root) as (select id, id from g union select e.b, r.root from r join e on e.a = r.id)
select frame_index, i, j, min(root) as component from g join r using (id) group by 1, 2, 3""", "frame_index i j component")
def raster_components(spark, sf_dir):
    """4-connected cells, cut at steps of over 0.2 m."""
    return raster.components(cut(_low(spark, sf_dir)), 0.2)


_SIDE = raster.side(100.0, 4.0)
_WRAPPED = f"((a.i + di) % {_SIDE} + {_SIDE}) % {_SIDE} and b.j = ((a.j + dj) % {_SIDE} + {_SIDE}) % {_SIDE}"


@query(f"with g as ({_LOW}) select a.frame_index, a.i, a.j, coalesce(max(abs(a.v - b.v)), 0e0) as step from g a, {_STEPS} left join g b on b.frame_index = a.frame_index and b.i = {_WRAPPED} group by 1, 2, 3", "frame_index i j", "step")
def wrapped_steps(spark, sf_dir):
    """Largest step to a neighbour on a torus."""
    return raster.step_height(_low(spark, sf_dir), _SIDE)


@query(f"with g as ({_LOW}) select frame_index, i, j from g union select frame_index, ((i + di) % {_SIDE} + {_SIDE}) % {_SIDE}, ((j + dj) % {_SIDE} + {_SIDE}) % {_SIDE} from g, {_STEPS}", "frame_index i j")
def wrapped_dilated(spark, sf_dir):
    """Observed cells and their neighbours on a torus."""
    return raster.dilate(_low(spark, sf_dir), _SIDE)


def _swept(source: str) -> str:
    """SQL of one sweep of the envelope: at most the headroom above the middle of the four neighbours, edges joined."""
    return f"select a.frame_index, a.i, a.j, a.seen, a.relief, least(any_value(a.v), (list_sort(list(b.v))[2] + list_sort(list(b.v))[3]) / 2 + 0.30e0) as v from {source} a, {_STEPS} join {source} b on b.frame_index = a.frame_index and b.i = {_WRAPPED} group by 1, 2, 3, 4, 5"


def _ground_sql() -> str:
    at = lambda di, dj, far: f"coalesce((select v from swept2 b where b.frame_index = a.frame_index and b.i = a.i + {di} and b.j = a.j + {dj}), a.v)"
    inside = lambda c: f"(case when a.{c} = 0 or a.{c} = {_SIDE - 1} then 4e0 else 8e0 end)"
    gy = f"(coalesce(d.v, a.v) - coalesce(u.v, a.v)) / {inside('i')}"
    gx = f"(coalesce(r.v, a.v) - coalesce(l.v, a.v)) / {inside('j')}"
    near = lambda k, di, dj: f"left join swept2 {k} on {k}.frame_index = a.frame_index and {k}.i = a.i + {di} and {k}.j = a.j + {dj}"
    return f"""low as ({_LOW}),
spine as (select f.frame_index, cast(a as integer) as i, cast(b as integer) as j from (select distinct frame_index from low) f, range(0, {_SIDE}) x(a), range(0, {_SIDE}) y(b)),
filled as (select s.frame_index, s.i, s.j, arg_min(l.v, ((l.i - s.i) * (l.i - s.i) + (l.j - s.j) * (l.j - s.j))::bigint * 1000000 + l.i * 1000 + l.j) as v, bool_or(l.i = s.i and l.j = s.j) as seen, coalesce(max(case when l.i = s.i and l.j = s.j then l.relief end), 0e0) as relief
  from spine s join low l on l.frame_index = s.frame_index group by 1, 2, 3),
swept1 as ({_swept('filled')}), swept2 as ({_swept('swept1')}),
ground as (select a.frame_index, a.i, a.j, a.v, a.seen as observed, a.relief, degrees(atan(sqrt(({gx}) * ({gx}) + ({gy}) * ({gy})))) as slope_deg
  from swept2 a {near('u', -1, 0)} {near('d', 1, 0)} {near('l', 0, -1)} {near('r', 0, 1)})"""


@query(f"with {_ground_sql()} select * from ground", "frame_index i j observed", "v relief slope_deg")
def ground_raster(spark, sf_dir):
    """The filled and smoothed ground raster of each frame."""
    return raster.ground(_points(spark, sf_dir), 100.0, 4.0)


def _support_sql() -> str:
    parts, now = [], "(select frame_index, i, j from ground where observed)"
    for k, t in enumerate(raster.SUPPORT):
        reach = "sqrt(((j + 0.5e0) * 4e0 - 100e0) * ((j + 0.5e0) * 4e0 - 100e0) + ((i + 0.5e0) * 4e0 - 100e0) * ((i + 0.5e0) * 4e0 - 100e0))"
        more = f"select frame_index, ((i + di) % {_SIDE} + {_SIDE}) % {_SIDE} as i, ((j + dj) % {_SIDE} + {_SIDE}) % {_SIDE} as j from {now} x, {_STEPS}"
        parts.append(f"held{k} as (select frame_index, i, j from {now} y union select frame_index, i, j from ({more}) z where {reach} > {_d(t)})")
        now = f"held{k}"
    return ", ".join(parts)


@query(f"""with recursive {_ground_sql()}, {_support_sql()},
free as (select g.* from ground g join held{len(raster.SUPPORT) - 1} h on h.frame_index = g.frame_index and h.i = g.i and h.j = g.j where slope_deg <= 60e0 and relief <= 60e0),
flood(frame_index, i, j, v) as (
  select frame_index, i, j, v from free where i = 25 and j = 25
  union
  select b.frame_index, b.i, b.j, b.v from flood p, {_STEPS} join free b on b.frame_index = p.frame_index and b.i = p.i + di and b.j = p.j + dj where abs(p.v - b.v) <= 60e0)
select frame_index, i, j from flood""", "frame_index i j")
def drivable_cells(spark, sf_dir):
    """The drivable region of each frame's raster, around the sensor; SQL floods it from there."""
    return raster.drivable_region(cut(raster.ground(_points(spark, sf_dir), 100.0, 4.0)), 60.0, 60.0, extent=100.0, cell=4.0)


@query()
def segmented_points(spark, sf_dir):
    """Labels of the geometric segmenter."""
    p = _points(spark, sf_dir).select("frame_index", "point_id", "x", "y", "z", "intensity")
    return segment.segment(p, VEHICLE).select("frame_index", "point_id", "label", "height")


@query("""select frame_index, component, n, ex, ey, top, base, 2 * sqrt(greatest(h - r, 0e0)) as thickness, 4 * sqrt(greatest(h + r, 0e0)) as length from (
  select *, (cxx + cyy) / 2 as h, sqrt(greatest((cxx + cyy) / 2 * (cxx + cyy) / 2 - (cxx * cyy - cxy * cxy), 0e0)) as r from (
    select frame_index, cls as component, count(*) as n, max(x) - min(x) as ex, max(y) - min(y) as ey, max(z) as top, min(z) as base, avg(x * x) - avg(x) * avg(x) as cxx, avg(y * y) - avg(y) * avg(y) as cyy, avg(x * y) - avg(x) * avg(y) as cxy from pts group by 1, 2))""", "frame_index component n", "ex ey top base thickness length", digits=4)
def cluster_shapes(spark, sf_dir):
    """Shapes of clusters, here of each frame's classes."""
    p = _points(spark, sf_dir).select("frame_index", F.col("cls").alias("component"), "x", "y", F.col("z").alias("height"))
    return segment.clusters(p).drop("dynamic")


# ---- converters, simulator, sinks


@query("select l_orderkey % 300 as raw, case when l_orderkey % 300 in (0, 1, 52) then 1 when l_orderkey % 300 in (11, 12, 13, 15, 16, 17, 18, 19, 20, 21) then 3 when l_orderkey % 300 in (10, 13, 15, 16, 18, 20, 30, 31, 32, 81) then 2 when l_orderkey % 300 in (40, 44, 48, 49, 60) then 0 else 1 end as label, count(*) as n from lineitem group by 1, 2", "raw label n")
def remapped_labels(spark, sf_dir):
    """Raw labels, with an instance number in the high bits, as classes."""
    raw = (F.col("l_orderkey") % 300).alias("raw")
    rows = table(spark, sf_dir, "lineitem").select(raw, geo.remap_label(F.col("l_orderkey") % 300 + F.col("l_linenumber") * 65536).cast("int").alias("label"))
    return rows.groupBy("raw", "label").agg(F.count("*").alias("n"))


@query("""select event_id, x * (1 - 2 * (qy * qy + qz * qz)) + y * 2 * (qx * qy - qz * qw) + z * 2 * (qx * qz + qy * qw) as rx, x * 2 * (qx * qy + qz * qw) + y * (1 - 2 * (qx * qx + qz * qz)) + z * 2 * (qy * qz - qx * qw) as ry, x * 2 * (qx * qz - qy * qw) + y * 2 * (qy * qz + qx * qw) + z * (1 - 2 * (qx * qx + qy * qy)) as rz
from (select *, 0.8e0 as qw, 0.2e0 as qx, 0.4e0 as qy, 0.4e0 as qz from pts)""", "event_id", "rx ry rz")
def rotated_points(spark, sf_dir):
    """Points turned by a quaternion."""
    m = geo.rotation(F.lit(0.8), F.lit(0.2), F.lit(0.4), F.lit(0.4))
    v = [F.col(c) for c in "xyz"]
    return _points(spark, sf_dir).select("event_id", *((m[i][0] * v[0] + m[i][1] * v[1] + m[i][2] * v[2]).alias(f"r{c}") for i, c in enumerate("xyz")))


@query("select p_type, case when starts_with(p_type, 'ECONOMY') or starts_with(p_type, 'SMALL') then 3 when starts_with(p_type, 'STANDARD') then 2 end as cls, count(*) as n from part group by 1, 2", "p_type cls n")
def prefixed_categories(spark, sf_dir):
    """Categories by the beginning of their names."""
    cls = F.when(geo.starts_with_any("p_type", ("ECONOMY", "SMALL")), 3).when(geo.starts_with_any("p_type", ("STANDARD",)), 2)
    return table(spark, sf_dir, "part").select("p_type", cls.alias("cls")).groupBy("p_type", "cls").agg(F.count("*").alias("n"))


_BOXES = [(k, (k * 37) % 150 - 75.0, (k * 53) % 150 - 75.0, 6.0 + k % 5, 9.0 + k % 7, 2 + k % 2) for k in range(40)]


@query(f"""select p.event_id, coalesce(arg_max(b.cls, b.ord), 255) as label from pts p left join (values {', '.join(f'({k}, {_d(x)}, {_d(y)}, {_d(w)}, {_d(h)}, {c})' for k, x, y, w, h, c in _BOXES)}) b(ord, box_x, box_y, w, h, cls)
on abs((p.x - b.box_x) * 0.96e0 + (p.y - b.box_y) * 0.28e0) <= b.w / 2 and abs((p.y - b.box_y) * 0.96e0 - (p.x - b.box_x) * 0.28e0) <= b.h / 2 group by 1""", "event_id label")
def boxed_points(spark, sf_dir):
    """Points labelled by the last turned box that holds them."""
    half = (0.9899494936611665, 0.0, 0.0, 0.1414213562373095)
    rows = [(0, k, c, [x, y, 0.0], [w, h, 1e9], list(half)) for k, x, y, w, h, c in _BOXES]
    made = spark.createDataFrame(rows, "sample_token int, ord int, cls int, centre array<double>, size array<double>, rotation array<double>")
    p = _points(spark, sf_dir).select("event_id", F.lit(0).alias("sample_token"), *(F.col(c).alias(f"g{c}") for c in "xyz"))
    return boxes.label_points(p, made, ["event_id"])


def _metadata(spark, sf_dir) -> dict[str, DataFrame]:
    """A collection's metadata made from the given tables, written as JSON arrays and read again."""
    t = lambda n: table(spark, sf_dir, n)
    made = {
        "sensor": t("region").selectExpr("concat('s', r_regionkey) as token", "if(r_regionkey % 2 = 0, 'LIDAR_TOP', 'CAM') as channel"),
        "calibrated_sensor": t("nation").selectExpr("concat('c', n_nationkey) as token", "concat('s', n_regionkey) as sensor_token", "if(n_nationkey % 2 = 0, array(0.8D, 0.2D, 0.4D, 0.4D), array(0.6D, 0.0D, 0.0D, 0.8D)) as rotation", "array(n_nationkey + 0.5D, 1.5D, 2.5D) as translation"),
        "ego_pose": t("supplier").selectExpr("concat('p', s_suppkey) as token", "array(0.6D, 0.0D, 0.8D, 0.0D) as rotation", "array(s_suppkey % 50 + 0.25D, s_suppkey % 7 - 0.5D, 0.125D) as translation"),
        "sample_data": t("customer").selectExpr("concat('d', c_custkey) as token", "concat('m', c_custkey % 97) as sample_token", "concat('c', c_nationkey) as calibrated_sensor_token", "concat('p', c_custkey % 10 + 1) as ego_pose_token", "c_name as filename", "c_custkey % 2 = 0 as is_key_frame"),
        "sample": t("customer").selectExpr("concat('m', c_custkey % 97) as token", "concat('n', c_custkey % 97 % 12) as scene_token").distinct(),
        "category": t("region").selectExpr("concat('k', r_regionkey) as token", "element_at(array('vehicle.car', 'pedestrian.adult', 'barrier', 'animal', 'debris'), cast(r_regionkey + 1 as int)) as name"),
        "instance": t("nation").selectExpr("concat('i', n_nationkey) as token", "concat('k', n_regionkey) as category_token"),
        "sample_annotation": t("supplier").selectExpr("concat('a', s_suppkey) as token", "concat('m', s_suppkey % 61) as sample_token", "concat('i', s_nationkey) as instance_token", "array(s_suppkey % 13 + 0.5D, s_suppkey % 17 + 0.5D, 0.5D) as translation", "array(2.5D, s_suppkey % 3 + 0.5D, 1.5D) as size", "array(1.0D, 0.0D, 0.0D, 0.0D) as rotation"),
    }
    folder = f"{shared_dir(spark)}/metadata-{uuid.uuid4().hex}"
    for name, rows in made.items():  # a metadata file is an array; these are its rows, some thousand
        rows.agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value")).write.text(f"{folder}/{name}.json")
    return scans.read_json_tables(spark, folder, list(made))


_TURN = lambda q, v: [f"(1 - 2 * ({q}2 * {q}2 + {q}3 * {q}3)) * {v}x + 2 * ({q}1 * {q}2 - {q}3 * {q}0) * {v}y + 2 * ({q}1 * {q}3 + {q}2 * {q}0) * {v}z", f"2 * ({q}1 * {q}2 + {q}3 * {q}0) * {v}x + (1 - 2 * ({q}1 * {q}1 + {q}3 * {q}3)) * {v}y + 2 * ({q}2 * {q}3 - {q}1 * {q}0) * {v}z", f"2 * ({q}1 * {q}3 - {q}2 * {q}0) * {v}x + 2 * ({q}2 * {q}3 + {q}1 * {q}0) * {v}y + (1 - 2 * ({q}1 * {q}1 + {q}2 * {q}2)) * {v}z"]
_CAL, _EGO = _TURN("c", "o"), _TURN("e", "v")


@query(f"""select event_id, token, sample_token, {_EGO[0]} + tx as gx, {_EGO[1]} + ty as gy, {_EGO[2]} + 0.125e0 as gz from (
  select *, {_CAL[0]} + cx as vx, {_CAL[1]} + 1.5e0 as vy, {_CAL[2]} + 2.5e0 as vz, 0.6e0 as e0, 0e0 as e1, 0.8e0 as e2, 0e0 as e3 from (
    select p.event_id, 'd' || c_custkey as token, 'm' || (c_custkey % 97) as sample_token, p.x as ox, p.y as oy, p.z as oz, n_nationkey + 0.5e0 as cx, s_suppkey % 50 + 0.25e0 as tx, s_suppkey % 7 - 0.5e0 as ty,
      case when n_nationkey % 2 = 0 then 0.8e0 else 0.6e0 end as c0, case when n_nationkey % 2 = 0 then 0.2e0 else 0e0 end as c1, case when n_nationkey % 2 = 0 then 0.4e0 else 0e0 end as c2, case when n_nationkey % 2 = 0 then 0.4e0 else 0.8e0 end as c3
    from pts p join customer on c_custkey = p.event_id % 100 + 1 and c_custkey % 2 = 0 join nation on n_nationkey = c_nationkey and n_regionkey % 2 = 0 join supplier on s_suppkey = c_custkey % 10 + 1))""", "event_id token sample_token", "gx gy gz")
def placed_points(spark, sf_dir):
    """Points of a channel's key scans in the world: joins by token, sensor to vehicle to world."""
    placed = boxes.placed_scans(_metadata(spark, sf_dir))
    points = _points(spark, sf_dir).select("event_id", "x", "y", "z", F.concat(F.lit("d"), F.col("event_id") % 100 + 1).alias("token"))
    return boxes.to_global(points.join(placed, "token")).select("event_id", "token", "sample_token", "gx", "gy", "gz")


@query("""select 'm' || (s_suppkey % 61) as sample_token, case n_regionkey when 0 then 3 when 1 then 3 else 2 end as cls, count(*) as n, cast(sum(s_suppkey % 13 + 0.5e0) as double) as sum_x, cast(sum(s_suppkey % 3 + 0.5e0) as double) as sum_w
from supplier join nation on n_nationkey = s_nationkey where n_regionkey <> 3 group by 1, 2""", "sample_token cls n", "sum_x sum_w")
def annotated_boxes(spark, sf_dir):
    """Boxes with a class by sample: instance and category joined by token, others left out."""
    found = boxes.annotations(_metadata(spark, sf_dir))
    return found.groupBy("sample_token", "cls").agg(F.count("*").alias("n"), F.sum(F.col("centre")[0]).alias("sum_x"), F.sum(F.col("size")[1]).alias("sum_w"))


@query("""select (select count(*) from scan) as lidar_keyframes, (select count(distinct sample) from scan where sample in (select s_suppkey % 61 from supplier)) as annotated_samples, (select count(distinct sample % 12) from scan) as sample_scenes,
  (select count(*) from supplier) as sample_annotations, (select count(*) from size) as scans_checked, (select min(n) from size) as points_min, (select avg(n) from size) as points_mean, (select max(n) from size) as points_max, false as point_level_labels
from (select 1)""".join(["with scan as (select c_custkey % 97 as sample from customer join nation on n_nationkey = c_nationkey and n_regionkey % 2 = 0), size as (select frame_index, count(*) as n from pts group by 1) ", ""]), "lidar_keyframes annotated_samples sample_scenes sample_annotations scans_checked points_min points_max point_level_labels", "points_mean")
def collection_report(spark, sf_dir):
    """Keyframes, annotations, scenes and sizes of scans of a collection."""
    sizes = _points(spark, sf_dir).groupBy(F.col("frame_index").alias("scan")).agg(F.count("*").alias("n"))
    return boxes.inspection(_metadata(spark, sf_dir), sizes)


@query("select (select count(*) from (select level, ix, iy from map1 intersect select level, ix, iy from wide_first where frame_index = 2)) as shared, (select count(*) from (select level, ix, iy from map1 except select level, ix, iy from wide_first where frame_index = 2)) as old_only, (select count(*) from (select level, ix, iy from map1 union select level, ix, iy from wide_first where frame_index = 2)) as either", "shared old_only either")
def set_operations(spark, sf_dir):
    """Keys of the map of two frames and of the third's: common, dropped and all."""
    a, b = (df.select(*grid.KEY) for df in (cut(_two(spark, sf_dir)), _first(spark, sf_dir, 2)))
    said = lambda df, name: df.agg(F.count("*").alias(name))
    return said(a.intersect(b), "shared").crossJoin(said(a.join(b, grid.KEY, "left_anti"), "old_only")).crossJoin(said(a.unionByName(b).distinct(), "either"))  # one row each


_STREET = simulator.Street.make(7)


def _height_sql() -> str:
    c = "(1.6e0 * sin(x / 41e0) + 0.7e0 * sin(x / 13e0))"
    u = f"abs(y - {c})"
    clip = lambda v: f"least(greatest({v}, 0e0), 1e0)"
    t, v, n = clip(f"({u} - 4.0e0) / 0.16e0"), clip(f"({u} - 6.2e0) / 1.5e0"), clip(f"{u} / 4.0e0")
    waves = " + ".join(f"cast('{a!r}' as double) * sin(cast('{fx!r}' as double) * x + cast('{fy!r}' as double) * y + cast('{p!r}' as double))" for a, fx, fy, p in _STREET.waves.tolist())
    holes = " + ".join(f"cast('{d!r}' as double) * exp(-((x - cast('{px!r}' as double)) * (x - cast('{px!r}' as double)) + (y - cast('{py!r}' as double)) * (y - cast('{py!r}' as double))) / (0.5e0 * cast('{r!r}' as double) * cast('{r!r}' as double)))" for px, py, r, d in _STREET.potholes.tolist())
    return f"0.30e0 * sin(x / 47e0) + 0.0035e0 * x + {waves} - case when {u} < 4.0e0 then 0.035e0 * {n} * {n} else 0e0 end + 0.16e0 * ({t} * {t} * (3 - 2 * {t})) + {v} * (0.22e0 + 0.10e0 * sin(2.9e0 * x + 3.1e0 * y)) - ({holes})"


@query(f"select event_id, {_height_sql()} as height from (select event_id, x + 100e0 as x, y / 10e0 as y from pts)", "event_id", "height")
def terrain_height(spark, sf_dir):
    """The simulated street's height under points."""
    p = _points(spark, sf_dir).select("event_id", (F.col("x") + 100).alias("x"), (F.col("y") / 10).alias("y"))
    return p.select("event_id", _STREET.height(F.col("x"), F.col("y")).alias("height"), )


_EYE = (30.0, -1.7, 1.9)
_THINGS = ", ".join(f"({r.instance}, {r.kind}, {', '.join(repr(float(getattr(r, c))) + 'e0' if 'e' not in repr(float(getattr(r, c))) else repr(float(getattr(r, c))) for c in 'abcdef')}, {r.label})" for r in _STREET.objects.itertuples())


def _hits_sql() -> str:
    """SQL of the distance along a ray to each primitive: slabs, the side of a cylinder, a sphere."""
    o, d = [_d(v) for v in _EYE], ["dx", "dy", "dz"]
    inverse = [f"(1 / case when abs({v}) < 1e-9 then 1e-9 else {v} end)" for v in d]
    one = [f"(({lo}) - {o[i]}) * {inverse[i]}" for i, lo in enumerate("abc")]
    two = [f"(({hi}) - {o[i]}) * {inverse[i]}" for i, hi in enumerate("def")]
    near = "greatest(" + ", ".join(f"least({x}, {y})" for x, y in zip(one, two)) + ")"
    far = "least(" + ", ".join(f"greatest({x}, {y})" for x, y in zip(one, two)) + ")"
    ex, ey, ez = f"({o[0]} - a)", f"({o[1]} - b)", f"({o[2]} - c)"
    side = lambda r: f"case when {r} > 0 and {o[2]} + {r} * dz >= c and {o[2]} + {r} * dz <= e then {r} end"
    return f"""ray as (select event_id, x / r as dx, y / r as dy, (z / 20e0 - 2e0) / r as dz from (select *, sqrt(x * x + y * y + (z / 20e0 - 2e0) * (z / 20e0 - 2e0)) as r from pts)),
thing(instance, kind, a, b, c, d, e, f, label) as (values {_THINGS}),
met as (select *, {near} as enter, {far} as leave, dx * dx + dy * dy as qa, 2 * (dx * {ex} + dy * {ey}) as qb, {ex} * {ex} + {ey} * {ey} - d * d as qc, 2 * (dx * {ex} + dy * {ey} + dz * {ez}) as sb, {ex} * {ex} + {ey} * {ey} + {ez} * {ez} - d * d as sc from ray, thing),
roots as (select *, case when qa > 1e-9 and qb * qb - 4 * qa * qc > 0 then sqrt(qb * qb - 4 * qa * qc) end as qr, case when sb * sb - 4 * sc > 0 then sqrt(sb * sb - 4 * sc) end as sr from met),
two as (select *, (-qb - qr) / (2 * qa) as c0, (-qb + qr) / (2 * qa) as c1, (-sb - sr) / 2 as s0, (-sb + sr) / 2 as s1 from roots),
hits as (select event_id, instance, label, case kind when 0 then case when leave >= enter and enter > 0 then enter end when 1 then least({side('c0')}, {side('c1')}) else case when s0 > 0 then s0 when s1 > 0 then s1 end end as t from two)"""


@query(f"with {_hits_sql()} select event_id, instance, label, t from (select *, row_number() over (partition by event_id order by t, instance) as k from hits where t < 60e0) where k = 1", "event_id instance label", "t")
def ray_hits(spark, sf_dir):
    """The nearest object that a ray through each point meets within 60 m, in the street at its first moment."""
    down = F.col("z") / 20 - 2
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + down * down)
    eye = [F.lit(v).alias(n) for n, v in zip(("ox", "oy", "oz"), _EYE)]
    cast = _points(spark, sf_dir).select("event_id", F.lit(0).cast("long").alias("frame_index"), *eye, (F.col("x") / r).alias("dx"), (F.col("y") / r).alias("dy"), (down / r).alias("dz"))
    at = spark.createDataFrame([(0, 0.0, *_EYE, 0.0)], "frame_index long, ts double, ox double, oy double, oz double, yaw double")
    things = simulator.in_reach(spark.createDataFrame(_STREET.objects), at, Sensor(), (0.0, 0.0))
    met = simulator.nearest_hit(cast.withColumn("sector", simulator.sector(F.atan2("dy", "dx"))), things)
    return met.where("h.t < 60").select("event_id", F.col("h.instance").cast("long").alias("instance"), F.col("h.label").cast("long").alias("label"), "h.t")


@query()
def simulated_scan(spark, sf_dir):
    """Points of two simulated frames by class, with their mean range."""
    points, _ = simulator.scans(spark, range(2), 7, Sensor(azimuth_steps=256))
    return points.groupBy("frame_index", "label").agg(F.count("*").alias("n"), F.avg(geo.planar_range()).alias("reach"))


@query("select frame_index, count(*) as n, cast(sum(hash_x) as bigint) as sum_x, cast(sum(hash_z) as bigint) as sum_z from (select frame_index, cast(round_even(x * 100, 0) as bigint) as hash_x, cast(least(greatest(round_even(z * 100, 0), -32768), 32767) as bigint) as hash_z from pts) group by 1", "frame_index n sum_x sum_z")
def quantised_points(spark, sf_dir):
    """Sums of the 16-bit centimetres that a payload holds."""
    p = _points(spark, sf_dir).select("frame_index", scans.centimetres("x").alias("x"), scans.centimetres("z").alias("z"))
    return p.groupBy("frame_index").agg(F.count("*").alias("n"), F.sum("x").alias("sum_x"), F.sum("z").alias("sum_z"))


_LITTLE = lambda c: f"to_base64(unhex(string_agg(right(printf('%04X', ((cm_{c} % 65536) + 65536) % 65536), 2) || left(printf('%04X', ((cm_{c} % 65536) + 65536) % 65536), 2), '' order by event_id))) as {c}"
_CM = ", ".join(f"cast(least(greatest(round_even({c} * 100, 0), -32768), 32767) as bigint) as cm_{c}" for c in "xyz")


@query(f"select frame_index, cast(count(*) as integer) as n, {', '.join(map(_LITTLE, 'xyz'))} from (select frame_index, event_id, {_CM} from pts) group by 1", "frame_index n x y z")
def payloads(spark, sf_dir):
    """Base64 payload of each frame."""
    return scans.payload(_points(spark, sf_dir))


_PATH = "select frame_index as request, row_number() over w - 1 as seq, x, y, z, x - lag(x) over w as dx, y - lag(y) over w as dy, z - lag(z) over w as dz, count(*) over (partition by frame_index) as n from pts window w as (partition by frame_index order by event_id)"


def _paths(spark, sf_dir):
    """Each frame's points in order as a route."""
    w = Window.partitionBy("frame_index").orderBy("event_id")
    return _points(spark, sf_dir).select(F.col("frame_index").alias("request"), (F.row_number().over(w) - 1).cast("long").alias("seq"), "x", "y", "z", F.lit(1.5).alias("cost"))


@query(f"select request, count(*) as tiles, 1.5e0 as cost, coalesce(sum(sqrt(dx * dx + dy * dy)), 0e0) as length, coalesce(sum(abs(dz)), 0e0) as climb from ({_PATH}) group by 1", "request tiles", "cost length climb")
def path_summaries(spark, sf_dir):
    """Tiles, length and climb of routes."""
    return navigation.route_summary(_paths(spark, sf_dir))


@query(f"select request, seq, x, y, z from ({_PATH}) where seq % greatest(n // 12, 1) = 0", "request seq", "x y z")
def path_lines(spark, sf_dir):
    """The dozen tiles of each route that a report shows."""
    return navigation.every_nth(_paths(spark, sf_dir)).drop("cost")


@query("select kx, ky, d from (select kx, ky, sqrt(((kx + 0.5e0) * 8e0 - 20e0) * ((kx + 0.5e0) * 8e0 - 20e0) + ((ky + 0.5e0) * 8e0 - 5e0) * ((ky + 0.5e0) * 8e0 - 5e0)) as d from passed where passable) order by d, kx, ky limit 5", "kx ky", "d")
def nearest_tiles(spark, sf_dir):
    """The five passable tiles nearest to a place."""
    d = geo.planar_range((F.col("kx") + 0.5) * 8.0 - 20.0, (F.col("ky") + 0.5) * 8.0 - 5.0)
    return _linked(spark, sf_dir).where("passable").select("kx", "ky", d.alias("d")).orderBy("d", "kx", "ky").limit(5)
