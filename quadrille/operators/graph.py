"""Connected components."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import reachable
from ..storage import cut, scratch

#: Up to so many edges, a proven bound of some 300 kB, one task finishes what rounds have left.
SMALL = 20_000


def _closed(edges: DataFrame) -> DataFrame:
    """(node, root) of at most SMALL edges, by union-find in one task; root is the least node."""
    reachable(edges.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for batch in batches:
            for a, b in zip(batch.a.tolist(), batch.b.tolist()):
                low, high = sorted((root(a), root(b)))
                up[high] = low
        nodes = list(up)
        yield pd.DataFrame({"node": pd.Series(nodes, dtype="int64"), "root": pd.Series([root(x) for x in nodes], dtype="int64")})

    return edges.coalesce(1).mapInPandas(run, "node long, root long")


def _through(labels: DataFrame | None, step: DataFrame) -> DataFrame:
    """labels(node, root) followed by step(node, root)."""
    if labels is None:
        return step
    on = step.select(F.col("node").alias("root"), F.col("root").alias("up"))
    return labels.join(on, "root", "left").select("node", F.coalesce("up", "root").alias("root"))


def connected(edges: DataFrame, small: int = SMALL) -> DataFrame | None:
    """(node, root) for every node of edges(a, b), long ids; None without edges.

    In a round, every node takes the neighbour of least random rank as parent if that is below its own, parents are
    followed four steps, and edges move to the ends' parents: their number falls by a constant factor. Hot nodes are
    only met by aggregations with partial results and joins that can be split. At most `small` edges end in one task.
    """
    with scratch() as own:
        labels, rank = None, 0
        edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        while n := edges.count():
            if n <= small:
                return own.keep(_through(labels, cut(_closed(edges))))
            rank += 1
            key = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(rank)).alias("r"), F.col(c).alias("n"))  # noqa: E731, B023
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            parent = cut(both.groupBy("a").agg(F.min(key("b")).alias("m")).select(F.col("a").alias("node"), F.least("m", key("a"))["n"].alias("root")))
            for _ in range(2):
                parent = _through(parent, parent)
            parent = cut(parent)
            labels = cut(_through(labels, parent))
            up = lambda c: parent.select(F.col("node").alias(c), F.col("root").alias(f"p{c}"))  # noqa: E731, B023
            edges = cut(edges.join(up("a"), "a").join(up("b"), "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        return None if labels is None else own.keep(labels)
