"""Navigation tiles, links, reachability, verdicts and routes.

tiles(kx, ky, z, relief, blocked, has_ground, n_cells, overhead_only), z NULL without ground;
edges(kx, ky, dir, nx, ny, distance) to the nearest tile within `probe` steps in each of four directions.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Lod, Vehicle
from ..functions import geo
from ..functions.geo import number
from ..storage import cut, scratch
from . import grid
from .graph import connected

TILE = ["kx", "ky"]
#: Obstacle classes, the horizon of the verdict, the seed's surroundings and the longest asserted link in tiles. Fixed values.
OBSTACLES, HORIZON, SEED_RADIUS, MAX_LINK, PROBE = (2, 3), 45.0, 14.0, 2.0, 10


def surface_ok(vehicle: Vehicle) -> Column:
    return (F.greatest(F.col("z_max") - F.col("z_min"), number(0)) <= number(vehicle.max_step_height)) & (F.col("n_obs") > 0)


def cover(view: DataFrame, nav_cell: float) -> DataFrame:
    """The view with each tile (kx, ky) that a cell covers: one for fine cells, factor x factor for coarser ones."""
    factor = F.greatest(F.rint(F.col("size") / number(nav_cell)).cast("int"), F.lit(1))
    start = lambda c: F.when(F.col("f") == 1, geo.index(c, nav_cell)).otherwise(F.floor((F.col(c) - 0.5 * F.col("size") + 1e-6) / number(nav_cell)).cast("long"))
    steps = F.transform(F.sequence(F.lit(0), F.col("f") * F.col("f") - 1), lambda k: F.struct(F.floor(k / F.col("f")).cast("long").alias("a"), F.pmod(k, F.col("f")).cast("long").alias("b")))
    spread = view.withColumn("f", factor).withColumn("s", F.explode(steps))
    return spread.withColumn("kx", start("cx") + F.col("s.a")).withColumn("ky", start("cy") + F.col("s.b")).drop("f", "s")


def tiles(view: DataFrame, vehicle: Vehicle) -> DataFrame:
    """Tiles of a view. An obstacle blocks only where it hangs below the clearance over the tile's own ground.

    One shuffle: the second aggregation is over obstacle bases gathered as a minimum, since some obstacle is low exactly
    if the lowest is, and all are exactly if the highest is.
    """
    obstacle = F.col("cls").isin(*OBSTACLES)
    ground = F.when(surface_ok(vehicle) & ~obstacle, F.col("z"))
    base = F.when(obstacle, F.col("z_min"))
    own = cover(view, vehicle.nav_cell).groupBy(*TILE).agg(
        F.avg(ground).alias("z"), (F.max(ground) - F.min(ground)).alias("relief"), F.count("*").alias("n_cells"), F.min(base).alias("low"), F.max(base).alias("high")
    )
    limit = F.col("z") + number(vehicle.clearance_height)
    return own.select(
        *TILE, "z", F.coalesce("relief", number(0)).alias("relief"), F.coalesce(F.col("low") < limit, F.lit(False)).alias("blocked"), F.col("z").isNotNull().alias("has_ground"), "n_cells",
        F.coalesce(F.when(F.col("z").isNull(), F.col("low").isNotNull()).otherwise(F.col("high") >= limit), F.lit(False)).alias("overhead_only"),
    )


def _towards(tile_columns: list[str], probe: int) -> list[tuple[str, int, Column]]:
    """(axis, direction, struct of the next tile in it), null if none is within `probe` steps."""
    out = []
    for along, across in (("kx", "ky"), ("ky", "kx")):
        w = Window.partitionBy(across).orderBy(along)
        for step, shift in ((1, F.lead), (-1, F.lag)):
            other = shift(F.struct(*tile_columns)).over(w)
            gap = F.abs(other[along] - F.col(along))
            out.append((along, step, F.when(gap <= probe, other)))
    return out


def link(tile: DataFrame, vehicle: Vehicle, probe: int = PROBE) -> DataFrame:
    """tiles with slope_deg, step, passable and four links (struct of the other tile and its distance, or null).

    Neighbours are the next rows of a row or column of tiles, so two window sorts replace probing.
    """
    columns = [*TILE, "z", "has_ground"]
    found = tile
    names = []
    for along, step, other in _towards(columns, probe):
        name = f"n_{along}_{'up' if step > 0 else 'down'}"
        names.append(name)
        found = found.withColumn(name, F.when(other.isNotNull(), F.struct(other["kx"].alias("kx"), other["ky"].alias("ky"), other["z"].alias("z"), (F.abs(other[along] - F.col(along)) * number(vehicle.nav_cell)).alias("distance"))))
    dz = lambda n: F.abs(F.col("z") - F.col(f"{n}.z"))
    slope = lambda n: F.degrees(F.atan2(dz(n), F.greatest(F.col(f"{n}.distance"), number(1e-3))))
    found = found.withColumn("step", F.coalesce(F.greatest(*map(dz, names)), number(0))).withColumn("slope_deg", F.coalesce(F.greatest(*map(slope, names)), number(0)))
    passable = F.col("has_ground") & ~F.col("blocked") & (F.col("relief") <= number(vehicle.max_step_height)) & (F.col("slope_deg") <= number(vehicle.max_slope_deg))
    return found.withColumn("passable", passable).withColumn("links", F.array_compact(F.array(*names))).drop(*names)


def edges(linked: DataFrame) -> DataFrame:
    """A row for each link: (kx, ky, z, passable, nx, ny, nz, distance)."""
    return linked.select(*TILE, "z", "passable", F.explode("links").alias("l")).select(*TILE, "z", "passable", F.col("l.kx").alias("nx"), F.col("l.ky").alias("ny"), F.col("l.z").alias("nz"), F.col("l.distance").alias("distance"))


def passable_edges(linked: DataFrame) -> DataFrame:
    """edges() between passable tiles."""
    there = linked.where("passable").select(F.col("kx").alias("nx"), F.col("ky").alias("ny"))
    return edges(linked).where("passable").join(there, ["nx", "ny"])


def _crossed(passable: DataFrame, vehicle: Vehicle, max_link: float) -> DataFrame:
    dz = F.abs(F.col("z") - F.col("nz"))
    ok = (dz <= number(vehicle.max_step_height)) & (F.degrees(F.atan2(dz, F.greatest("distance", number(1e-3)))) <= number(vehicle.max_slope_deg)) & (F.col("distance") <= number(max_link * vehicle.nav_cell + 1e-6))
    return passable.where(ok).select(*TILE, "nx", "ny")


def crossable(linked: DataFrame, vehicle: Vehicle, max_link: float = MAX_LINK) -> DataFrame:
    """Links between passable tiles that a vehicle can take and that are short enough to assert: (kx, ky, nx, ny)."""
    return _crossed(passable_edges(linked), vehicle, max_link)


def components(linked: DataFrame, vehicle: Vehicle, max_link: float = MAX_LINK) -> DataFrame:
    """(kx, ky, component) of passable tiles; component is the least packed key in it."""
    return _components(linked, crossable(linked, vehicle, max_link))


def _components(linked: DataFrame, crossed: DataFrame) -> DataFrame:
    found = connected(crossed.select(geo.pack("kx", "ky").alias("a"), geo.pack("nx", "ny").alias("b")))
    keyed = linked.where("passable").select(*TILE, geo.pack("kx", "ky").alias("node"))
    if found is None:
        return keyed.select(*TILE, F.col("node").alias("component"))
    rooted = keyed.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("node").alias("component"))
    return rooted.join(least, "root").select(*TILE, "component")


def seed_component(parts: DataFrame, nav_cell: float, sx: float, sy: float, radius: float = SEED_RADIUS) -> DataFrame:
    """The component with most tiles near the sensor, else that of the nearest tile; one row, or none without tiles."""
    away = geo.planar_range((F.col("kx") + 0.5) * nav_cell - float(sx), (F.col("ky") + 0.5) * nav_cell - float(sy))
    ranked = parts.withColumn("d", away).groupBy("component").agg(F.sum(F.when(F.col("d") <= radius, 1).otherwise(0)).alias("near"), F.min(F.struct("d", geo.pack("kx", "ky"))).alias("nearest"))
    return ranked.orderBy(F.col("near").desc(), F.when(F.col("near") > 0, F.col("component")).asc_nulls_last(), "nearest").limit(1).select("component")


def reachable(linked: DataFrame, vehicle: Vehicle, sx: float, sy: float) -> DataFrame:
    """linked with `reachable`: connected to where the vehicle is. All false without two passable neighbours."""
    with scratch() as own:
        passable = cut(passable_edges(linked))
        if passable.isEmpty():
            return linked.withColumn("reachable", F.lit(False))
        parts = cut(_components(linked, _crossed(passable, vehicle, MAX_LINK)))
        seed = seed_component(parts, vehicle.nav_cell, sx, sy)
        inside = own.keep(parts.join(F.broadcast(seed), "component", "left_semi").select(*TILE, F.lit(True).alias("reachable")))  # one row
    return linked.join(inside, TILE, "left").withColumn("reachable", F.coalesce("reachable", F.lit(False)))


def verdicts(view: DataFrame, reached: DataFrame, vehicle: Vehicle, sx: float, sy: float, horizon: float = HORIZON) -> DataFrame:
    """The view with blocked, slope_deg, step, passable, reachable, score, terrain and known of each cell."""
    own = reached.select(F.col("kx").alias("_x"), F.col("ky").alias("_y"), F.col("blocked").alias("_b"), "slope_deg", "step", F.col("reachable").alias("_r"))
    at = view.join(own, (geo.index("cx", vehicle.nav_cell) == F.col("_x")) & (geo.index("cy", vehicle.nav_cell) == F.col("_y")))
    relief = F.greatest(F.col("z_max") - F.col("z_min"), number(0))
    at = at.withColumn("blocked", F.col("cls").isin(*OBSTACLES) & F.col("_b"))
    at = at.withColumn("passable", surface_ok(vehicle) & ~F.col("blocked") & (F.col("slope_deg") <= number(vehicle.max_slope_deg)))
    at = at.withColumn("reachable", F.col("_r") & F.col("passable"))
    worst = F.greatest(F.col("slope_deg") / max(vehicle.max_slope_deg, 1e-3), F.col("step") / max(vehicle.max_step_height, 1e-3), relief / max(vehicle.max_roughness * 2.5, 1e-3))
    free = F.least(F.greatest(1 - worst, number(0)), number(1))
    score = F.when(F.col("blocked"), number(0)).when(~F.col("reachable"), F.least(free, number(0.15))).otherwise(free)
    terrain = F.when(F.col("blocked"), F.when(F.col("cls") == 3, 3).otherwise(2)).when(F.col("reachable"), 0).otherwise(1)
    near = geo.planar_range(F.col("cx") - float(sx), F.col("cy") - float(sy)) <= number(horizon)
    return at.withColumn("score", score).withColumn("terrain", terrain).withColumn("known", near).drop("_x", "_y", "_b", "_r")


def demote(labels: DataFrame, found: DataFrame, by: list[str], label: str = "label") -> DataFrame:
    """labels with refined_label: drivable points become rough where the map knows better, and nothing else changes.

    found is lookup() of the points in verdicts(): by, passable, reachable, known, null where no cell is.
    """
    good = F.coalesce((F.col("reachable") & F.col("passable")) | ~F.col("known"), F.lit(False))
    said = labels.join(found.select(*by, good.alias("_good")), by, "left")
    return said.withColumn("refined_label", F.when((F.col(label) == 0) & ~F.coalesce("_good", F.lit(False)), 1).otherwise(F.col(label))).drop("_good")


ROUTE = "seq int, kx long, ky long, x double, y double, z double, cost double, expanded long"


def search(table: pd.DataFrame, nav_cell: float, start: tuple[float, float], goal: tuple[float, float], vehicle: Vehicle, rough: float = 2.5, climb: float = 6.0) -> pd.DataFrame:
    """Best-first search with the straight distance as bound, which no step's cost falls below."""
    columns = [c.split()[0] for c in ROUTE.split(", ")]
    table = table.sort_values(TILE, ignore_index=True)
    if table.empty:
        return pd.DataFrame(columns=columns)
    at = {k: i for i, k in enumerate(zip(table.kx, table.ky))}
    x, y = (table.kx.to_numpy() + 0.5) * nav_cell, (table.ky.to_numpy() + 0.5) * nav_cell
    z = table.z.to_numpy()
    price = 1 + rough * np.clip(table.slope_deg.to_numpy() / max(vehicle.max_slope_deg, 1e-3), 0, 1)
    first, last = (int(((x - px) ** 2 + (y - py) ** 2).argmin()) for px, py in (start, goal))
    best, came, done = {first: 0.0}, {}, set()
    queue = [(0.0, first)]
    while queue:
        here = heapq.heappop(queue)[1]
        if here in done:
            continue
        done.add(here)
        if here == last:
            break
        for n in table.links[here]:
            to = at.get((n["kx"], n["ky"]))
            if to is None or to in done or not (rise := abs(z[to] - z[here])) <= vehicle.max_step_height:
                continue
            cost = best[here] + n["distance"] * price[to] + climb * rise
            if cost < best.get(to, np.inf):
                best[to], came[to] = cost, here
                heapq.heappush(queue, (cost + float(np.hypot(x[to] - x[last], y[to] - y[last])), to))
    if last not in best:
        return pd.DataFrame(columns=columns)
    chain = [last]
    while chain[-1] != first:
        chain.append(came[chain[-1]])
    chain.reverse()
    return pd.DataFrame({"seq": range(len(chain)), "kx": table.kx[chain].to_numpy(), "ky": table.ky[chain].to_numpy(), "x": x[chain], "y": y[chain], "z": z[chain], "cost": [best[i] for i in chain], "expanded": len(done)})


def routes(reached: DataFrame, requests: DataFrame, vehicle: Vehicle, together: int = 256) -> DataFrame:
    """(request, seq, ...) for requests(request, sx, sy, gx, gy): the cheapest route over usable tiles, no rows if none.

    A search is sequential over one map of a few thousand tiles around a vehicle. A map's tiles and some `together` of its
    requests are one cogroup and one Python call; both sides may have a column `map` that tells maps apart.
    """
    maps = "map" in reached.columns and "map" in requests.columns
    hands = max(1, -(-requests.count() // together))
    key = F.col("map").cast("string") if maps else F.lit("")
    usable = reached.where("passable and reachable").select(*TILE, "z", "slope_deg", "links", key.alias("map"), F.explode(F.sequence(F.lit(0), F.lit(hands - 1))).alias("hand"))
    asked = requests.select("request", *(F.col(c).cast("double").alias(c) for c in ("sx", "sy", "gx", "gy")), key.alias("map"), F.pmod(F.xxhash64("request"), F.lit(hands)).cast("int").alias("hand"))
    nav_cell, columns = vehicle.nav_cell, ["request", *(c.split()[0] for c in ROUTE.split(", "))]

    def run(tiles: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        found = []
        for r in wanted.itertuples():
            out = search(tiles, nav_cell, (r.sx, r.sy), (r.gx, r.gy), vehicle)
            out.insert(0, "request", r.request)
            found.append(out)
        found = [x for x in found if len(x)]
        return pd.concat(found) if found else pd.DataFrame(columns=columns)

    return usable.groupBy("map", "hand").cogroup(asked.groupBy("map", "hand")).applyInPandas(run, "request long, " + ROUTE)


def every_nth(found: DataFrame, lines: int = 12) -> DataFrame:
    """The rows of routes() that a report shows: every n-th tile so that about `lines` of each route are left."""
    n = F.count("*").over(Window.partitionBy("request"))
    return found.withColumn("_n", F.greatest(F.floor(n / lines), F.lit(1))).where(F.col("seq") % F.col("_n") == 0).drop("_n")


def nearest_cells(cells: DataFrame, lod: Lod, reach: int = 6) -> DataFrame:
    """(KEY, dx, dy, step, n_level, n_ix, n_iy, distance): in each of four directions the first other cell, of any level.

    A cell looks from its centre at up to `reach` of its own widths; a coarse cell may be met as itself, and is looked past.
    """
    size = geo.level_size("level", lod)
    steps = F.explode(F.array(*(F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy"), F.lit(k).alias("step")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1)) for k in range(1, reach + 1))))
    asks = cells.select(*(F.col(c).alias(f"_{c}") for c in grid.KEY), geo.centre("ix", size).alias("_cx"), geo.centre("iy", size).alias("_cy"), size.alias("_size"), steps.alias("_s"))
    asks = asks.select("_level", "_ix", "_iy", "_size", "_s.dx", "_s.dy", "_s.step", (F.col("_cx") + F.col("_s.dx") * F.col("_s.step") * F.col("_size")).alias("x"), (F.col("_cy") + F.col("_s.dy") * F.col("_s.step") * F.col("_size")).alias("y"))
    keys = ["_level", "_ix", "_iy", "_size", "dx", "dy", "step"]
    met = grid.lookup(asks, cells, lod, keys, ["ix", "iy"]).where("level is not null and not (level = _level and ix = _ix and iy = _iy)")
    first = met.groupBy("_level", "_ix", "_iy", "_size", "dx", "dy").agg(F.min(F.struct("step", "level", "ix", "iy")).alias("f"))
    return first.select(*(F.col(f"_{c}").alias(c) for c in grid.KEY), "dx", "dy", F.col("f.step").alias("step"), F.col("f.level").alias("n_level"), F.col("f.ix").alias("n_ix"), F.col("f.iy").alias("n_iy"), (F.col("f.step") * F.col("_size")).alias("distance"))


def route_summary(found: DataFrame) -> DataFrame:
    """(request, tiles, cost, length, climb) of routes."""
    before = Window.partitionBy("request").orderBy("seq")
    step = lambda c: F.col(c) - F.lag(c).over(before)
    moved = found.withColumn("leg", F.sqrt(step("x") * step("x") + step("y") * step("y"))).withColumn("rise", F.abs(step("z")))
    return moved.groupBy("request").agg(F.count("*").alias("tiles"), F.max("cost").alias("cost"), F.coalesce(F.sum("leg"), number(0)).alias("length"), F.coalesce(F.sum("rise"), number(0)).alias("climb"))
