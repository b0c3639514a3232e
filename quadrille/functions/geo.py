"""Column functions of the coordinate model: levels, cells, keys, distances, transforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Lod

BITS, HALF = 21, 1 << 20
MASK = (1 << BITS) - 1
#: Half-open range bands of the reports. Fixed values.
BANDS = ((0.0, 10.0), (10.0, 20.0), (20.0, 40.0), (40.0, 70.0), (70.0, 100.0))


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(v) -> Column:
    return F.lit(float(v))


def planar_range(x="x", y="y") -> Column:
    x, y = col(x), col(y)
    return F.sqrt(x * x + y * y)


def spatial_range(x="x", y="y", z="z") -> Column:
    x, y, z = col(x), col(y), col(z)
    return F.sqrt(x * x + y * y + z * z)


def to_world(x="x", y="y", z="z", yaw="yaw", ox="ox", oy="oy", oz="oz") -> tuple[Column, Column, Column]:
    """Sensor coordinates turned by yaw about z and moved to the sensor's place."""
    x, y, c, s = col(x), col(y), F.cos(col(yaw)), F.sin(col(yaw))
    return c * x - s * y + col(ox), s * x + c * y + col(oy), col(z) + col(oz)


def index(v, size: float) -> Column:
    """Number of the cell of that size that holds a coordinate."""
    return F.floor(col(v) / number(size)).cast("long")


def centre(i, size) -> Column:
    return (col(i) + number(0.5)) * (number(size) if isinstance(size, (int, float)) else size)


def level_size(level, lod: Lod) -> Column:
    """Cell size of a level column; powers of two are exact."""
    return number(lod.base_cell) * F.pow(number(2), col(level))


def pack(*parts) -> Column:
    """21 bits for each index, the first highest; indices wrap beyond 2 ** 20."""
    out = None
    for p in parts:
        own = (col(p).cast("long") + F.lit(HALF).cast("long")).bitwiseAND(F.lit(MASK).cast("long"))
        out = own if out is None else F.shiftleft(out, BITS).bitwiseOR(own)
    return out


def unpack(key, place: int) -> Column:
    """Index `place` from the right of a packed key."""
    return F.shiftright(col(key), BITS * place).bitwiseAND(F.lit(MASK).cast("long")) - HALF


def nearest_distance(ix, iy, size: float, sx, sy) -> Column:
    """Distance from (sx, sy) to the nearest place of a cell."""
    out = []
    for i, s in ((ix, sx), (iy, sy)):
        low = col(i) * number(size)
        out.append(F.greatest(low - col(s), col(s) - (low + number(size)), number(0)))
    dx, dy = out
    return F.sqrt(dx * dx + dy * dy)


def leaf_level(x, y, sx, sy, lod: Lod) -> Column:
    """The coarsest level whose cell around (x, y) is wholly beyond its ring; the finest otherwise."""
    out = F.lit(0)
    for level in range(1, lod.n_levels):
        size = lod.size(level)
        far = nearest_distance(index(x, size), index(y, size), size, sx, sy) >= number(lod.ring_radii[level])
        out = F.when(far, F.lit(level)).otherwise(out)
    return out


def cell_of(x, y, level, lod: Lod) -> tuple[Column, Column]:
    """(ix, iy) at a level column, one CASE over the levels so that sizes stay literals."""
    out = []
    for v in (x, y):
        c = F.lit(None).cast("long")
        for k in range(lod.n_levels):
            c = F.when(col(level) == k, index(v, lod.size(k))).otherwise(c)
        out.append(c)
    return tuple(out)


def block(level, ix, iy, lod: Lod) -> tuple[Column, Column]:
    """The coarsest ancestor: nothing that happens to a cell leaves it."""
    up = F.lit(lod.n_levels - 1) - col(level)
    return tuple(F.call_function("shiftright", col(i), up.cast("int")) for i in (ix, iy))


def band(distance, bands=BANDS) -> Column:
    """Number of the half-open band of a distance; null outside all."""
    out = F.lit(None).cast("int")
    for k, (low, high) in enumerate(bands):
        out = F.when((col(distance) >= low) & (col(distance) < high), F.lit(k)).otherwise(out)
    return out


def best_class(*evidence) -> tuple[Column, Column]:
    """(class, confidence): the first of the largest evidences, and its share."""
    ev = [col(e) for e in evidence]
    top = F.greatest(*ev)
    cls = F.lit(len(ev) - 1)
    for k in range(len(ev) - 2, -1, -1):
        cls = F.when(ev[k] == top, F.lit(k)).otherwise(cls)
    total = ev[0]
    for e in ev[1:]:
        total = total + e
    return cls, top / F.greatest(total, number(1e-6))


def rotation(w, x, y, z) -> list[list[Column]]:
    """Rotation matrix of a unit quaternion."""
    w, x, y, z = map(col, (w, x, y, z))
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ]


def starts_with_any(c, prefixes) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | col(c).startswith(p)
    return out


# Semantic ids by class; later ones in this order win.
LABELS = (((40, 44, 48, 49, 60), 0), ((10, 13, 15, 16, 18, 20, 30, 31, 32, 81), 2), ((11, 12, 13, 15, 16, 17, 18, 19, 20, 21), 3), ((0, 1, 52), 1))


def remap_label(raw) -> Column:
    """Class of a raw label, whose low 16 bits are the semantic id; 1 for ids not listed."""
    semantic = col(raw).cast("long").bitwiseAND(F.lit(0xFFFF).cast("long"))
    out = F.lit(1)
    for ids, cls in LABELS:
        out = F.when(semantic.isin(*ids), F.lit(cls)).otherwise(out)
    return out
