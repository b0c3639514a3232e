"""Readers and writers of scans, metadata and reports.

Binary readers list files with Spark (any store it reads) and parse whole files in Arrow batches, a file a row: files are
single scans of some megabytes. Schema: (scan STRING, point_id LONG, x, y, z DOUBLE, intensity DOUBLE, label INT).
"""

from __future__ import annotations

import io
import json
import posixpath
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..config import CLASSES, UNKNOWN
from ..functions import geo
from ..session import reachable

POINTS = "scan string, point_id long, x double, y double, z double, intensity double, label int"


def _frame(scan: str, xyz: np.ndarray, intensity, label) -> pd.DataFrame:
    n = len(xyz)
    return pd.DataFrame({"scan": scan, "point_id": np.arange(n), "x": xyz[:, 0].astype(float), "y": xyz[:, 1].astype(float), "z": xyz[:, 2].astype(float), "intensity": np.broadcast_to(np.asarray(intensity, float), n), "label": np.broadcast_to(np.asarray(label, "int32"), n)})


def parse_npz(scan: str, content: bytes) -> pd.DataFrame:
    """A labelled scan: arrays xyz (N, 3) and label (N), and intensity (N), 1 if absent."""
    with np.load(io.BytesIO(content)) as held:
        missing = {"xyz", "label"} - set(held.files)
        if missing:
            raise ValueError(f"{scan}: no array {', '.join(sorted(missing))}")
        xyz, label = held["xyz"], held["label"]
        intensity = held["intensity"] if "intensity" in held.files else np.ones(len(xyz), np.float32)
    if xyz.ndim != 2 or xyz.shape[1] != 3 or label.shape != (len(xyz),) or intensity.shape != (len(xyz),):
        raise ValueError(f"{scan}: shapes {xyz.shape}, {label.shape}, {intensity.shape} do not fit")
    label = label.astype(np.int64)
    if not np.isin(label, [*range(len(CLASSES)), UNKNOWN]).all():
        raise ValueError(f"{scan}: labels must be 0 to {len(CLASSES) - 1} or {UNKNOWN}")
    return _frame(scan, xyz, intensity, label)


def parse_floats(width: int) -> Callable[[str, bytes], pd.DataFrame]:
    """Records of `width` 32-bit floats that begin with x, y, z, intensity."""
    def parse(scan: str, content: bytes) -> pd.DataFrame:
        if len(content) % (4 * width):
            raise ValueError(f"{scan}: {len(content)} bytes are no records of {width} floats")
        raw = np.frombuffer(content, "<f4").reshape(-1, width)
        return _frame(scan, raw[:, :3], raw[:, 3], UNKNOWN)

    return parse


def parse_pcd(scan: str, content: bytes, width: int = 5) -> pd.DataFrame:
    """A point cloud file: text lines up to `DATA binary`, then records of floats."""
    mark = content.lower().find(b"data binary")
    end = content.find(b"\n", mark)
    if mark < 0 or end < 0:
        raise ValueError(f"{scan}: no binary data")
    return parse_floats(width)(scan, content[end + 1 :])


def _parsed(files: DataFrame, parse: Callable[[str, bytes], pd.DataFrame]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for scan, content in zip(b.scan, b.content):
                yield parse(scan, bytes(content))

    return files.mapInPandas(run, POINTS)


def files(spark: SparkSession, path: str, pattern: str, every: int = 1) -> DataFrame:
    """(scan, path, content) of matching files, every n-th by name; scan is the name without its extensions."""
    listed = reachable(spark).read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    named = listed.select(F.regexp_extract("path", r"([^/]+?)(\.pcd)?\.[^./]+$", 1).alias("scan"), "path", "content")
    if every <= 1:
        return named
    nth = F.row_number().over(Window.orderBy("path")) - 1  # over names alone: contents are not read for it
    return named.join(named.select("path").withColumn("_n", nth).where(F.col("_n") % every == 0).select("path"), "path", "left_semi").select("scan", "path", "content")


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    return _parsed(files(spark, path, "*.npz"), parse_npz)


def read_floats(spark: SparkSession, path: str, width: int = 4, pattern: str = "*.bin", every: int = 1) -> DataFrame:
    """Plain float scans, of four floats a point in drives, of five in keyframe collections."""
    return _parsed(files(spark, path, pattern, every), parse_floats(width))


def read_pcd(spark: SparkSession, path: str) -> DataFrame:
    return _parsed(files(spark, path, "*.pcd"), parse_pcd)


def read_labelled(spark: SparkSession, scans: str, labels: str, every: int = 1) -> DataFrame:
    """Float scans zipped by name with files of 32-bit labels, remapped to the four classes."""
    points = files(spark, scans, "*.bin", every).select("scan", "content")
    raw = files(spark, labels, "*.label").select("scan", F.col("content").alias("labels"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for scan, content, label in zip(b.scan, b.content, b["labels"]):
                if label is None:
                    raise FileNotFoundError(f"no label file for scan {scan}")
                out = parse_floats(4)(scan, bytes(content))
                ids = np.frombuffer(bytes(label), "<u4")
                if len(ids) != len(out):
                    raise ValueError(f"{scan}: {len(out)} points, {len(ids)} labels")
                yield out.assign(raw=ids.astype(np.int64))

    zipped = points.join(raw, "scan", "left").mapInPandas(run, POINTS + ", raw long")
    return zipped.withColumn("label", geo.remap_label("raw")).drop("raw")


def read_json_tables(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    """Metadata tables, a JSON array a file."""
    return {n: spark.read.option("multiLine", "true").json(f"{path}/{n}.json") for n in names}


class NpzSource(DataSource):
    """`spark.read.format("quadrille_npz").load(path)` for a local folder or file that all executors see."""

    @classmethod
    def name(cls) -> str:
        return "quadrille_npz"

    def schema(self) -> str:
        return POINTS

    def reader(self, schema) -> DataSourceReader:
        return NpzReader(self.options["path"])


class NpzReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        import pathlib

        p = pathlib.Path(self.path)
        return [InputPartition(str(f)) for f in (sorted(p.glob("*.npz")) if p.is_dir() else [p])]

    def read(self, partition):
        with open(partition.value, "rb") as f:
            out = parse_npz(posixpath.basename(partition.value).removesuffix(".npz"), f.read())
        yield from out.itertuples(index=False, name=None)


def write_points(points: DataFrame, path: str, by: str = "frame_index") -> None:
    """Parquet, a folder a frame, points in order."""
    points.repartition(by).sortWithinPartitions(by, "point_id").write.mode("overwrite").partitionBy(by).parquet(path)


def npz_files(points: DataFrame) -> DataFrame:
    """(scan, content): one compressed archive of xyz, intensity and label a scan."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("point_id")
        out = io.BytesIO()
        np.savez_compressed(out, xyz=group[["x", "y", "z"]].to_numpy("float32"), intensity=group.intensity.to_numpy("float32"), label=group.label.to_numpy("uint8"))
        return pd.DataFrame({"scan": [group.scan.iloc[0]], "content": [out.getvalue()]})

    return points.groupBy("scan").applyInPandas(run, "scan string, content binary")


def write_npz(points: DataFrame, folder: str) -> int:
    """Archives in a folder that the executors share, written where they are made; how many."""
    import os

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for b in batches:
            for scan, content in zip(b.scan, b.content):
                part = f"{folder}/.{scan}.{os.getpid()}"
                with open(part, "wb") as f:
                    f.write(content)
                os.replace(part, f"{folder}/{scan}.npz")  # a task that runs twice leaves one whole file
            yield pd.DataFrame({"n": [len(b)]})

    return npz_files(points).mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def markdown(rows: DataFrame, digits: int = 3) -> str:
    """A small result as a table."""
    said = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join(said(v) for v in r) + " |" for r in rows.collect()]) + "\n"


def centimetres(c) -> Column:
    """A length as a 16-bit number of centimetres, halves to even, kept in range."""
    return F.least(F.greatest(F.rint(geo.col(c) * 100), F.lit(-32768.0)), F.lit(32767.0)).cast("short")


def payload(points: DataFrame, columns: tuple[str, ...] = ("x", "y", "z"), by: str = "frame_index") -> DataFrame:
    """(by, n, a base64 text for each column): little-endian 16-bit centimetres in point order, made in the JVM."""
    low = lambda v: F.lpad(F.hex(F.pmod(v.cast("int"), F.lit(65536))), 4, "0")
    little = lambda v: F.concat(F.substring(low(v), 3, 2), F.substring(low(v), 1, 2))
    ordered = points.select(by, F.struct("point_id", *(centimetres(c).alias(c) for c in columns)).alias("p")).groupBy(by).agg(F.array_sort(F.collect_list("p")).alias("p"))
    text = lambda c: F.translate(F.base64(F.unhex(F.array_join(F.transform("p", lambda p: little(p[c])), ""))), "\r\n", "").alias(c)
    return ordered.select(by, F.size("p").alias("n"), *map(text, columns))


def artifact(template: str, data: dict, mark: str = "/*DATA*/") -> str:
    """A page with its data inside."""
    return template.replace(mark, json.dumps(data, separators=(",", ":")).replace("</", "<\\/"))
