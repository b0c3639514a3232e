"""Points labelled by oriented boxes, and the metadata joins that place them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import UNKNOWN
from ..functions import geo

# Beginnings of category names.
DYNAMIC_NAMES = ("vehicle", "pedestrian", "bicycle", "motorcycle", "cyclist")
STATIC_NAMES = ("barrier", "traffic_cone", "construction", "debris")


def category_class(name) -> Column:
    """3 or 2 by the beginning of a category's name, null otherwise."""
    return F.when(geo.starts_with_any(name, DYNAMIC_NAMES), 3).when(geo.starts_with_any(name, STATIC_NAMES), 2)


def _turn(q: Column, v: list[Column], back: bool = False) -> list[Column]:
    m = geo.rotation(q[0], q[1], q[2], q[3])
    at = (lambda i, j: m[j][i]) if back else (lambda i, j: m[i][j])
    return [at(i, 0) * v[0] + at(i, 1) * v[1] + at(i, 2) * v[2] for i in range(3)]


def placed_scans(tables: dict[str, DataFrame], channel: str = "LIDAR_TOP", key_frames: bool = True) -> DataFrame:
    """(token, sample_token, filename, cal_r, cal_t, ego_r, ego_t) of a channel's scans: joins by token."""
    cal = tables["calibrated_sensor"].select(F.col("token").alias("calibrated_sensor_token"), "sensor_token", F.col("rotation").alias("cal_r"), F.col("translation").alias("cal_t"))
    sensor = tables["sensor"].where(F.col("channel") == channel).select(F.col("token").alias("sensor_token"))
    pose = tables["ego_pose"].select(F.col("token").alias("ego_pose_token"), F.col("rotation").alias("ego_r"), F.col("translation").alias("ego_t"))
    rows = tables["sample_data"]
    rows = rows.where("is_key_frame") if key_frames else rows
    found = rows.join(cal, "calibrated_sensor_token").join(sensor, "sensor_token", "left_semi").join(pose, "ego_pose_token")
    return found.select("token", "sample_token", "filename", "cal_r", "cal_t", "ego_r", "ego_t")


def to_global(points: DataFrame) -> DataFrame:
    """points(x, y, z, cal_r, cal_t, ego_r, ego_t, ...) with gx, gy, gz: sensor to vehicle to world."""
    own = _turn(F.col("cal_r"), [F.col("x"), F.col("y"), F.col("z")])
    car = [own[i] + F.col("cal_t")[i] for i in range(3)]
    world = _turn(F.col("ego_r"), car)
    return points.withColumns({f"g{c}": world[i] + F.col("ego_t")[i] for i, c in enumerate("xyz")})


def annotations(tables: dict[str, DataFrame]) -> DataFrame:
    """(sample_token, ord, cls, centre, size, rotation) of boxes with a class; ord is their order in the table."""
    cat = tables["category"].select(F.col("token").alias("category_token"), "name")
    inst = tables["instance"].select(F.col("token").alias("instance_token"), "category_token")
    rows = tables["sample_annotation"].withColumn("ord", F.monotonically_increasing_id())
    return rows.join(inst, "instance_token").join(cat, "category_token").select("sample_token", "ord", category_class("name").alias("cls"), F.col("translation").alias("centre"), "size", "rotation").where("cls is not null")


def label_points(points: DataFrame, boxes: DataFrame, by: list[str], on: str = "sample_token") -> DataFrame:
    """points(by, on, gx, gy, gz) with label: the class of the last box that holds a point, else unknown.

    A range join: equal samples, then the box test within the join; a point meets its own sample's boxes only.
    """
    away = [F.col(f"g{c}") - F.col("centre")[i] for i, c in enumerate("xyz")]
    local = _turn(F.col("rotation"), away, back=True)
    inside = F.lit(True)
    for i in range(3):
        inside = inside & (F.abs(local[i]) <= F.col("size")[i] / 2)
    box = boxes.withColumnRenamed(on, "_on")
    hits = points.join(box, (F.col(on) == F.col("_on")) & inside, "left")
    return hits.groupBy(*by).agg(F.coalesce(F.max_by("cls", "ord"), F.lit(UNKNOWN)).alias("label"))


def inspection(tables: dict[str, DataFrame], sizes: DataFrame, channel: str = "LIDAR_TOP") -> DataFrame:
    """One row on a collection: keyframes, annotations, scans checked and their points, annotated samples, scenes.

    sizes(scan, n) has the number of points of each scan that was read.
    """
    found = placed_scans(tables, channel, key_frames=False)
    said = tables["sample_annotation"].groupBy("sample_token").agg(F.count("*").alias("boxes"))
    scene = tables["sample"].select(F.col("token").alias("sample_token"), "scene_token")
    joined = found.join(said, "sample_token", "left").join(scene, "sample_token", "left")
    one = joined.agg(F.count("*").alias("lidar_keyframes"), F.countDistinct(F.when(F.col("boxes") > 0, F.col("sample_token"))).alias("annotated_samples"), F.countDistinct("scene_token").alias("sample_scenes"))
    two = tables["sample_annotation"].agg(F.count("*").alias("sample_annotations"))
    three = sizes.agg(F.count("*").alias("scans_checked"), F.coalesce(F.min("n"), F.lit(0)).alias("points_min"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("points_mean"), F.coalesce(F.max("n"), F.lit(0)).alias("points_max"))
    return one.crossJoin(two).crossJoin(three).withColumn("point_level_labels", F.lit(False))  # one row each
