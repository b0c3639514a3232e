"""The geometric segmenter: ground from a raster, objects by clusters and shape rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Model, Vehicle
from ..functions.geo import number
from ..storage import cut, scratch
from . import features, raster

BY = ["frame_index", "point_id"]


def footprint(n, sx, sy, sxx, syy, sxy) -> tuple[Column, Column]:
    """(thickness, length) of a cluster seen from above, by its 2 x 2 covariance."""
    mx, my = sx / n, sy / n
    cxx, cyy, cxy = sxx / n - mx * mx, syy / n - my * my, sxy / n - mx * my
    half = (cxx + cyy) / 2
    root = F.sqrt(F.greatest(half * half - (cxx * cyy - cxy * cxy), number(0)))
    return 2 * F.sqrt(F.greatest(half - root, number(0))), 4 * F.sqrt(F.greatest(half + root, number(0)))


def clusters(objects: DataFrame) -> DataFrame:
    """(frame_index, component, shape columns, dynamic) of objects(frame_index, component, x, y, height)."""
    x, y, h = F.col("x"), F.col("y"), F.col("height")
    own = objects.groupBy("frame_index", "component").agg(
        F.count("*").alias("n"), (F.max(x) - F.min(x)).alias("ex"), (F.max(y) - F.min(y)).alias("ey"), F.max(h).alias("top"), F.min(h).alias("base"),
        F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"),
    )
    thickness, length = footprint(*map(F.col, ("n", "sx", "sy", "sxx", "syy", "sxy")))
    foot, small, n, top = F.greatest("ex", "ey"), F.least("ex", "ey"), F.col("n"), F.col("top")
    # fixed values: shapes of a walker, a vehicle and a wall
    walker = (foot < 1.5) & (top > 0.9) & (top < 2.3) & (n > 5)
    vehicle = (foot > 1.6) & (foot < 7.0) & (small < 3.2) & (top > 0.7) & (top < 2.6) & (n > 20)
    shaped = own.withColumn("thickness", thickness).withColumn("length", length)
    wall = (F.col("thickness") < 0.30) & (F.col("length") > 2.5)
    return shaped.withColumn("dynamic", (walker | vehicle) & (F.col("base") < 0.75) & ~wall).drop("sx", "sy", "sxx", "syy", "sxy")


def segment(points: DataFrame, vehicle: Vehicle) -> DataFrame:
    """points(frame_index, point_id, x, y, z, intensity, ...) in sensor coordinates with label and p0..p3.

    Described points are written once, as objects, clusters and the result read them; a frame's components are found within
    its square.
    """
    with scratch() as own:
        at = cut(_described(points, vehicle))
        h = F.col("height")
        objects = at.where(~F.col("on_ground") & (h > 0.25) & (h < 4.0)).select(*BY, "i", "j", "x", "y", "height", "f_scattering")
        named = cut(objects.join(raster.grown_parts(objects), raster.KEY))
        dynamic = clusters(named).where("dynamic").select("frame_index", "component")
        moving = named.join(dynamic, ["frame_index", "component"], "left_semi").where(~((F.col("f_scattering") > 0.30) & (F.col("height") > 2.3))).select(*BY, F.lit(True).alias("_moves"))
        label = F.when((F.col("f_linearity") > 0.85) & (h > 1.2), 2).when(F.col("_moves"), 3).otherwise(F.col("_first"))
        return own.keep(with_evidence(at.join(moving, BY, "left").withColumn("label", label).select(*points.columns, "label", "height")))


def _described(points: DataFrame, vehicle: Vehicle) -> DataFrame:
    """points with the features that rules ask for, the height over the ground raster and the label of ground."""
    i, j = raster.indices()
    described = features.features(points).select(*points.columns, "f_normal_z", "f_roughness", "f_scattering", "f_linearity", i.alias("i"), j.alias("j"))
    ground = raster.ground(points).select(*raster.KEY, F.col("v").alias("_v"), "observed", F.col("relief").alias("_relief"), F.col("slope_deg").alias("_slope"))
    at = described.join(ground, raster.KEY).withColumn("height", F.col("z") - F.col("_v"))
    h = F.col("height")
    at = at.withColumn("on_ground", ((h < 0.20) & (F.col("f_normal_z") > 0.50)) | (h < 0.07))
    rough = F.col("observed") & ((F.col("_relief") > vehicle.max_step_height) | (F.col("_slope") > vehicle.max_slope_deg) | (F.col("f_roughness") > vehicle.max_roughness * 1.8))
    return at.withColumn("_first", F.when(F.col("on_ground"), F.when(rough, 1).otherwise(0)).otherwise(2))


def with_evidence(labelled: DataFrame, sure: float = 0.88, other: float = 0.04) -> DataFrame:
    """p0..p3 from a label: mostly its own class."""
    total = sure + 3 * other
    return labelled.withColumns({f"p{k}": F.when(F.col("label") == k, number(sure / total)).otherwise(number(other / total)) for k in range(4)})


#: Segmenters by name: functions of (points, vehicle). A trained model registers its own.
SEGMENTERS: dict[str, Callable[[DataFrame, Vehicle], DataFrame]] = {"geometric": segment}


def segmenter(model: Model) -> Callable[[DataFrame, Vehicle], DataFrame]:
    """The named architecture for backends auto (the geometric one unless another is registered), numpy and named."""
    if model.backend == "numpy":
        return segment
    if model.architecture in SEGMENTERS:
        return SEGMENTERS[model.architecture]
    if model.backend == "auto":
        return segment
    raise ValueError(f"no segmenter is called {model.architecture!r}")
