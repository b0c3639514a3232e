"""A trained segmenter on the thirteen features: data set, training with history, saving, loading.

The networks of deep-learning frameworks are out of reach here (none is installed); a trained model joins the pipeline
through segment.SEGMENTERS like any other, and this one is MLlib's multinomial logistic regression.
"""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.ml import Pipeline as Stages
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import UNKNOWN, Sensor, Vehicle
from ..sources import simulator
from ..storage import cut, scratch
from . import features, metrics, segment

#: Seconds between the frames of a world in the data set.
APART = 0.7


def dataset(spark: SparkSession, seeds: list[int], frames_per_world: int = 3, sensor: Sensor | None = None) -> DataFrame:
    """(world, frame_index, point_id, label, features): normalised features of simulated scans, each world from its seed."""
    sensor = sensor or Sensor()
    every = max(1, round(APART / sensor.frame_period))
    out = None
    for seed in seeds:  # a plan for each world, none of them run here
        points, _ = simulator.scans(spark, range(0, every * frames_per_world, every), seed, sensor)
        own = described(points).withColumn("world", F.lit(seed))
        out = own if out is None else out.unionByName(own)
    return out.select("world", "frame_index", "point_id", "label", *features.NAMES)


def described(points: DataFrame) -> DataFrame:
    return features.normalised(features.features(points))


def train(data: DataFrame, valid: DataFrame, path: str | None = None, rounds: tuple[int, ...] = (5, 20, 60), by: tuple[float, ...] = (1e-4, 1e-2)) -> tuple[PipelineModel, list[dict]]:
    """(best model, history): one fit for each number of iterations and penalty, judged by mean IoU on `valid`.

    Points of unknown label do not count; classes weigh by the inverse root of their share. With a path, the best model and
    history.json beside it are saved there.
    """
    with scratch():
        known, held = cut(data.where(F.col("label") != UNKNOWN)), cut(valid.where(F.col("label") != UNKNOWN))
        weights = {r["cls"]: r["weight"] for r in metrics.class_weights(known).collect()}  # a row a class
        weighed = known.withColumn("weight", F.element_at(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)), F.col("label").cast("int")))
        best, history = None, []
        for iterations in rounds:
            for penalty in by:
                stages = [VectorAssembler(inputCols=list(features.NAMES), outputCol="described"), LogisticRegression(featuresCol="described", labelCol="label", weightCol="weight", maxIter=iterations, regParam=penalty, family="multinomial")]
                model = Stages(stages=stages).fit(weighed)
                found = metrics.confusion(model.transform(held).withColumn("pred", F.col("prediction").cast("int")), "label", "pred")
                score = metrics.scores(found).first()
                history.append({"iterations": iterations, "penalty": penalty, "miou": score["miou"], "accuracy": score["accuracy"]})
                if best is None or score["miou"] > best[0]:
                    best = (score["miou"], model)
    if path:
        save(best[1], history, path)
    return best[1], history


def save(model: PipelineModel, history: list[dict], path: str) -> None:
    """The model in a folder of any store that Spark writes, its history as JSON lines beside it."""
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(h),) for h in history], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/history")


def load(spark: SparkSession, path: str) -> tuple[PipelineModel, list[dict]]:
    return PipelineModel.load(f"{path}/model"), [json.loads(r["value"]) for r in spark.read.text(f"{path}/history").collect()]


def segmenter(model: PipelineModel):
    """A function of (points, vehicle) for segment.SEGMENTERS: label and p0..p3 from the model's probabilities."""

    def run(points: DataFrame, vehicle: Vehicle) -> DataFrame:
        said = model.transform(described(points)).withColumn("_p", vector_to_array("probability"))
        p = [F.coalesce(F.get("_p", F.lit(k)), F.lit(0.0)).alias(f"p{k}") for k in range(4)]
        return said.select(*points.columns, F.col("prediction").cast("int").alias("label"), *p)

    return run


def register(name: str, model: PipelineModel) -> None:
    """Make the model the architecture of that name."""
    segment.SEGMENTERS[name] = segmenter(model)
