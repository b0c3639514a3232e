"""Connected components against union-find."""

import numpy as np
import pytest

from quadrille.operators.graph import connected


def plain(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        up[high] = low
    return {x: root(x) for x in up}


@pytest.mark.parametrize("small", [0, 20_000])
def test_components(spark, small):
    r = np.random.default_rng(small)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [tuple(map(int, x)) for x in r.integers(2000, 2400, (250, 2))] + [(5, 5)]
    got = {x.node: x.root for x in connected(spark.createDataFrame(edges, "a long, b long"), small).collect()}
    want = plain([e for e in edges if e[0] != e[1]])
    sets = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    assert sets(got) == sets(want)


def test_no_edges(spark):
    assert connected(spark.createDataFrame([(1, 1)], "a long, b long")) is None
