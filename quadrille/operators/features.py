"""Per-point features from voxels and columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.geo import number

# Grouping sizes, the order of the features, and what normalises them.
VOXEL, COLUMN = 0.45, 1.2
NAMES = ("f_z", "f_log_range", "f_intensity", "f_height", "f_span", "f_log_count", "f_linearity", "f_planarity", "f_scattering", "f_tilt", "f_normal_z", "f_roughness", "f_elevation")
MEAN = (-0.9, 2.7, 0.35, 0.55, 1.6, 2.0, 0.35, 0.45, 0.18, 0.35, 0.65, 0.07, -0.20)
STD = (1.4, 1.0, 0.25, 1.1, 2.2, 1.2, 0.28, 0.28, 0.20, 0.32, 0.32, 0.09, 0.28)


def voxel(size: float = VOXEL) -> list[Column]:
    return [geo.index(c, size).alias(f"v{c}") for c in "xyz"]


def moments(points: DataFrame, by: tuple[str, ...] = (), size: float = VOXEL) -> DataFrame:
    """(by, vx, vy, vz, n, cxx .. cyz): population covariance of the points of each voxel."""
    keyed = points.select(*by, *voxel(size), "x", "y", "z")
    pairs = [("x", "x"), ("y", "y"), ("z", "z"), ("x", "y"), ("x", "z"), ("y", "z")]
    return keyed.groupBy(*by, "vx", "vy", "vz").agg(F.count("*").alias("n"), *(F.covar_pop(a, b).alias(f"c{a}{b}") for a, b in pairs))


def with_eigen(df: DataFrame, names=("cxx", "cyy", "czz", "cxy", "cxz", "cyz"), ridge: float = 1e-9) -> DataFrame:
    """df with _low, _mid, _high, the eigenvalues of a symmetric 3 x 3 matrix in closed form, and _nz, |z| of the lowest's vector.

    One column a step: an expression used twice stays a column of its own, so the plan grows in proportion to the steps.
    """
    xx, yy, zz, xy, xz, yz = names
    c = F.col
    df = df.withColumns({"_a": c(xx) + ridge, "_b": c(yy) + ridge, "_c": c(zz) + ridge})
    df = df.withColumn("_mean", (c("_a") + c("_b") + c("_c")) / 3)
    df = df.withColumns({"_da": c("_a") - c("_mean"), "_db": c("_b") - c("_mean"), "_dc": c("_c") - c("_mean")})
    df = df.withColumn("_p", F.sqrt((c("_da") * c("_da") + c("_db") * c("_db") + c("_dc") * c("_dc") + 2 * (c(xy) * c(xy) + c(xz) * c(xz) + c(yz) * c(yz))) / 6))
    df = df.withColumn("_det", c("_da") * (c("_db") * c("_dc") - c(yz) * c(yz)) - c(xy) * (c(xy) * c("_dc") - c(yz) * c(xz)) + c(xz) * (c(xy) * c(yz) - c("_db") * c(xz)))
    df = df.withColumn("_cos", F.when(c("_p") > 0, c("_det") / (2 * c("_p") * c("_p") * c("_p"))).otherwise(number(1)))
    df = df.withColumn("_phi", F.acos(F.least(F.greatest("_cos", number(-1)), number(1))) / 3)
    df = df.withColumns({"_high": c("_mean") + 2 * c("_p") * F.cos("_phi"), "_low": c("_mean") + 2 * c("_p") * F.cos(c("_phi") + 2 * math.pi / 3)})
    df = df.withColumns({"_mid": 3 * c("_mean") - c("_high") - c("_low"), "_a": c("_a") - c("_low"), "_b": c("_b") - c("_low"), "_c": c("_c") - c("_low")})
    # the lowest's vector is the longest cross product of two rows of the shifted matrix
    rows = [("_a", xy, xz), (xy, "_b", yz), (xz, yz, "_c")]
    for k, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        (a1, a2, a3), (b1, b2, b3) = rows[i], rows[j]
        df = df.withColumns({f"_u{k}": c(a2) * c(b3) - c(a3) * c(b2), f"_v{k}": c(a3) * c(b1) - c(a1) * c(b3), f"_w{k}": F.abs(c(a1) * c(b2) - c(a2) * c(b1))})
        df = df.withColumn(f"_n{k}", c(f"_u{k}") * c(f"_u{k}") + c(f"_v{k}") * c(f"_v{k}") + c(f"_w{k}") * c(f"_w{k}"))
    df = df.withColumn("_longest", F.greatest(*(F.struct(c(f"_n{k}").alias("n"), c(f"_w{k}").alias("w")) for k in range(3))))
    df = df.withColumn("_nz", F.when(c("_longest.n") > 0, c("_longest.w") / F.sqrt(c("_longest.n"))).otherwise(number(1)))
    return df.drop("_a", "_b", "_c", "_mean", "_da", "_db", "_dc", "_p", "_det", "_cos", "_phi", "_longest", *(f"_{x}{k}" for x in "uvwn" for k in range(3)))


def shapes(found: DataFrame) -> DataFrame:
    """moments() with linearity, planarity, scattering, normal_z and roughness; voxels of under four points have none."""
    e = with_eigen(found).withColumn("_high", F.greatest("_high", number(1e-12)))
    or_else = lambda c, v: F.when(F.col("n") >= 4, c).otherwise(number(v))
    low, mid, high = F.col("_low"), F.col("_mid"), F.col("_high")
    return e.select(
        *found.columns, or_else((high - mid) / high, 0).alias("linearity"), or_else((mid - low) / high, 0).alias("planarity"),
        or_else(F.least(F.greatest(low / high, number(0)), number(1)), 1).alias("scattering"), or_else(F.col("_nz"), 0).alias("normal_z"), or_else(F.sqrt(F.greatest(low, number(0))), 0).alias("roughness"),
    )


def columns_of(points: DataFrame, by: tuple[str, ...] = (), size: float = COLUMN) -> DataFrame:
    """points with column_low and column_span of the vertical column each stands in."""
    w = Window.partitionBy(*by, geo.index("x", size), geo.index("y", size))
    return points.withColumn("column_low", F.min("z").over(w)).withColumn("column_span", F.max("z").over(w) - F.col("column_low"))


def features(points: DataFrame, by: tuple[str, ...] = ("frame_index",)) -> DataFrame:
    """points(by, x, y, z, intensity, ...) in sensor coordinates with the thirteen features."""
    shape = shapes(moments(points, by)).select(*by, "vx", "vy", "vz", "n", "linearity", "planarity", "scattering", "normal_z", "roughness")
    at = points.withColumns({f"v{c}": geo.index(c, VOXEL) for c in "xyz"}).join(shape, [*by, "vx", "vy", "vz"])
    at = columns_of(at, by)
    reach = geo.planar_range()
    values = (
        F.col("z"), F.log1p(reach), F.col("intensity"), F.col("z") - F.col("column_low"), F.col("column_span"), F.log1p("n"), F.col("linearity"), F.col("planarity"), F.col("scattering"),
        1 - F.col("normal_z"), F.col("normal_z"), F.col("roughness"), F.atan2(F.col("z"), F.greatest(reach, number(1e-3))),
    )
    return at.select(*points.columns, "vx", "vy", "vz", *(v.cast("double").alias(n) for v, n in zip(values, NAMES)))


def normalised(found: DataFrame) -> DataFrame:
    return found.withColumns({n: (F.col(n) - number(m)) / number(s) for n, m, s in zip(NAMES, MEAN, STD)})


def centroids(points: DataFrame, channels: list[str], by: tuple[str, ...] = (), size: float = VOXEL) -> DataFrame:
    """(by, voxel, mean place, largest of each channel)."""
    keyed = points.select(*by, *voxel(size), "x", "y", "z", *channels)
    return keyed.groupBy(*by, "vx", "vy", "vz").agg(*(F.avg(c).alias(f"m{c}") for c in "xyz"), *(F.max(c).alias(f"max_{c}") for c in channels))


def foveated(points: DataFrame, near: float, middle: float, middle_stride: int, far_stride: int, by: str = "frame_index") -> DataFrame:
    """points with `selected`: all near ones, every n-th in the middle and far zones, and the first of each voxel."""
    if middle_stride <= 1 and far_stride <= 1:
        return points.withColumn("selected", F.lit(True))
    reach = geo.planar_range()
    zone = F.when(reach < near, 0).when(reach < middle, 1).otherwise(2)
    nth = F.row_number().over(Window.partitionBy(by, "zone").orderBy("point_id")) - 1
    first = F.min("point_id").over(Window.partitionBy(by, *voxel()))
    stride = F.when(F.col("zone") == 1, max(middle_stride, 1)).otherwise(max(far_stride, 1))
    return points.withColumn("zone", zone).withColumn("_n", nth).withColumn("_f", first).withColumn("selected", (F.col("zone") == 0) | (F.col("_n") % stride == 0) | (F.col("point_id") == F.col("_f"))).drop("zone", "_n", "_f")


def share_evidence(points: DataFrame, by: tuple[str, ...] = ("frame_index",)) -> DataFrame:
    """Points without evidence of their own (selected false) take the share of their voxel's selected points."""
    w = Window.partitionBy(*by, *voxel())
    sums = {f"_s{k}": F.sum(F.when(F.col("selected"), F.col(f"p{k}"))).over(w) for k in range(4)}
    total = F.greatest(sum((F.coalesce(f"_s{k}", number(0)) for k in range(1, 4)), F.coalesce("_s0", number(0))), number(1e-6))
    return points.withColumns(sums).withColumns({f"p{k}": F.when(F.col("selected"), F.col(f"p{k}")).otherwise(F.coalesce(f"_s{k}", number(0)) / total) for k in range(4)}).drop(*sums)
