"""Documents to packed training sequences, in stages: (name, function of (spark, docs, sf_dir)).

Every stage decides row by row: null, repeated or missing doc_ids lose no text that has no copy. All but the last return
the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quadrille.llm import decontam, exact_dedup, packing, simhash, toxicity
from quadrille.llm.common import fresh, table
from quadrille.session import reachable
from quadrille.storage import cut, scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score = fresh(docs, "_score")
    return toxicity.scored(docs, model, score).where(f"{score} < 0.3").select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, of the largest doc_id."""
    return exact_dedup.distinct(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a five-word similarity of 0.8 or more one row stays, of the least doc_id."""
    return simhash.distinct(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, in sequences of at most 2048 tokens."""
    return packing.packed(docs, packing.vocabulary_path())


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_exact_copies), ("simhash", drop_near_copies), ("decontamination", drop_contaminated), ("packing", pack)]

ORACLE_SQL = None  # hashing, alignment and a fitted model; the tests hold run() against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written and read again, and its own tables then go."""
    docs = reachable(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with scratch() as own:
            docs = own.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
