"""Confusion, errors, audits, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CLASSES, UNKNOWN, Lod
from ..functions import geo
from ..functions.geo import number
from . import grid


def confusion(rows: DataFrame, truth: str = "gt", said: str = "pred", by: tuple[str, ...] = ()) -> DataFrame:
    return rows.groupBy(*by, F.col(truth).alias("gt"), F.col(said).alias("pred")).agg(F.count("*").alias("n"))


def scores(found: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, cls, tp, fp, fn, iou, recall, precision, accuracy, miou, points) of a confusion; classes that never occur count 0."""
    n, gt, pred = F.col("n"), F.col("gt"), F.col("pred")
    spread = found.withColumn("cls", F.explode(F.array(*map(F.lit, range(len(CLASSES))))))
    part = lambda when: F.sum(F.when(when, n).otherwise(0))
    one = spread.groupBy(*by, "cls").agg(
        part((gt == F.col("cls")) & (pred == F.col("cls"))).alias("tp"), part((gt != F.col("cls")) & (pred == F.col("cls"))).alias("fp"), part((gt == F.col("cls")) & (pred != F.col("cls"))).alias("fn"),
        F.sum(n).alias("points"), part(gt == pred).alias("right"),
    )
    ratio = lambda *below: F.col("tp") / F.greatest(sum(map(F.col, below[1:]), F.col(below[0])), F.lit(1))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    full = one.withColumn("iou", ratio("tp", "fp", "fn")).withColumn("miou", F.avg("iou").over(w))  # four rows a group
    return full.select(*by, "cls", "tp", "fp", "fn", "iou", ratio("tp", "fn").alias("recall"), ratio("tp", "fp").alias("precision"), (F.col("right") / F.greatest("points", F.lit(1))).alias("accuracy"), "miou", "points")


def elevation_error(cells: DataFrame, truth: Column, sx: float, sy: float) -> DataFrame:
    """(band, cells, median_size, rmse, mae, bias, p95_abs) of cells(cx, cy, z, size) against a truth column."""
    e = F.col("z") - truth
    placed = cells.select(geo.band(geo.planar_range(F.col("cx") - float(sx), F.col("cy") - float(sy))).alias("band"), "size", e.alias("e")).where("band is not null")
    return placed.groupBy("band").agg(
        F.count("*").alias("cells"), F.percentile("size", 0.5).alias("median_size"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg(F.abs("e")).alias("mae"), F.avg("e").alias("bias"), F.percentile(F.abs("e"), 0.95).alias("p95_abs")
    )


def latency(rows: DataFrame, column: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, n, mean_ms, p95_ms, fps_mean, fps_worst) of milliseconds."""
    own = rows.groupBy(*by).agg(F.count(column).alias("n"), F.avg(column).alias("mean_ms"), F.percentile(column, 0.95).alias("p95_ms"))
    return own.withColumn("fps_mean", 1000 / F.col("mean_ms")).withColumn("fps_worst", 1000 / F.col("p95_ms"))


def class_weights(labels: DataFrame, label: str = "label") -> DataFrame:
    """(cls, n, weight): inverse roots of class shares over their mean; unknown labels do not count."""
    spine = labels.sparkSession.range(len(CLASSES)).select(F.col("id").cast("int").alias("cls"))
    counts = labels.where(F.col(label) != UNKNOWN).groupBy(F.col(label).cast("int").alias("cls")).agg(F.count("*").alias("n"))
    full = spine.join(F.broadcast(counts), "cls", "left").withColumn("n", F.coalesce("n", F.lit(0)))  # a row a class
    every = Window.partitionBy(F.lit(0))
    raw = 1 / F.sqrt(F.greatest(F.col("n") / F.sum("n").over(every), number(1e-6)))
    return full.withColumn("raw", raw).select("cls", "n", (F.col("raw") / F.avg("raw").over(every)).alias("weight"))


def level_histogram(cells: DataFrame, lod: Lod) -> DataFrame:
    """(level, cells), empty levels included."""
    spine = cells.sparkSession.range(lod.n_levels).select(F.col("id").cast("int").alias("level"))
    counts = cells.groupBy("level").agg(F.count("*").alias("cells"))
    return spine.join(F.broadcast(counts), "level", "left").select("level", F.coalesce("cells", F.lit(0)).alias("cells"))  # a row a level


def overlaps(cells: DataFrame, lod: Lod) -> DataFrame:
    """(fine, coarse, n): ancestors of cells of one level that are cells of a coarser one, counted once each."""
    pairs = [(a, b) for a in range(lod.n_levels) for b in range(a + 1, lod.n_levels)]
    up = F.transform(F.sequence(F.col("level") + 1, F.lit(lod.n_levels - 1)), lambda b: F.struct(b.alias("to"), F.call_function("shiftright", F.col("ix"), b - F.col("level")).alias("ix"), F.call_function("shiftright", F.col("iy"), b - F.col("level")).alias("iy")))
    ancestors = cells.where(F.col("level") < lod.n_levels - 1).select(F.col("level").alias("fine"), F.explode(up).alias("a")).select("fine", F.col("a.to").alias("level"), F.col("a.ix").alias("ix"), F.col("a.iy").alias("iy")).distinct()
    hits = ancestors.join(cells.select(*grid.KEY), grid.KEY, "left_semi").groupBy("fine", F.col("level").alias("coarse")).agg(F.count("*").alias("n"))
    spine = cells.sparkSession.createDataFrame(pairs, "fine int, coarse int")
    return spine.join(F.broadcast(hits), ["fine", "coarse"], "left").select("fine", "coarse", F.coalesce("n", F.lit(0)).alias("n"))


def impure(cells: DataFrame, lod: Lod, sx: float, sy: float) -> DataFrame:
    """Cells nearer to the sensor than their level may be."""
    wrong = F.lit(False)
    for k in range(1, lod.n_levels):
        wrong = wrong | ((F.col("level") == k) & (geo.nearest_distance("ix", "iy", lod.size(k), F.lit(float(sx)), F.lit(float(sy))) < number(lod.ring_radii[k] - 1e-6)))
    return cells.where(wrong)


def alignment(cells: DataFrame, lod: Lod) -> DataFrame:
    """(alignment_error): the largest distance of a cell's corner from the coarsest level's lattice of its own size."""
    size = geo.level_size("level", lod)
    off = lambda i: F.abs(F.col(i) * size - F.rint(F.col(i) * size / number(lod.base_cell)) * number(lod.base_cell))
    return cells.agg(F.coalesce(F.max(F.greatest(off("ix"), off("iy"))), number(0)).alias("alignment_error"))


def audit(points: DataFrame, cells: DataFrame, lod: Lod, sx: float, sy: float, by: list[str]) -> DataFrame:
    """One row: points_mapped, leaf_level_consistency, cross_level_overlaps, ring_violations, alignment_error."""
    leaf = points.select(*by, "x", "y", geo.leaf_level("x", "y", F.lit(float(sx)), F.lit(float(sy)), lod).alias("leaf"))
    found = grid.lookup(leaf, cells, lod, [*by, "leaf"], ["z"])
    one = found.agg(F.avg(F.col("level").isNotNull().cast("double")).alias("points_mapped"), F.coalesce(F.avg((F.col("level") == F.col("leaf")).cast("double")), number(1)).alias("leaf_level_consistency"))
    two = overlaps(cells, lod).agg(F.sum("n").alias("cross_level_overlaps"))
    three = impure(cells, lod, sx, sy).agg(F.count("*").alias("ring_violations"))
    return one.crossJoin(two).crossJoin(three).crossJoin(alignment(cells, lod))  # one row each


def scan_report(points: DataFrame, by: str) -> DataFrame:
    """(scans, points_min, points_mean, points_max) over scans."""
    return points.groupBy(by).agg(F.count("*").alias("n")).agg(F.count("*").alias("scans"), F.min("n").alias("points_min"), F.avg("n").alias("points_mean"), F.max("n").alias("points_max"))


def frame_accuracy(rows: DataFrame, by: str = "frame_index", truth: str = "gt", said: str = "pred") -> DataFrame:
    """(accuracy) as the mean over frames of the share of right labels."""
    return rows.groupBy(by).agg(F.avg((F.col(truth) == F.col(said)).cast("double")).alias("a")).agg(F.avg("a").alias("accuracy"))
