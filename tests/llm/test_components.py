"""Connected components against a plain search: chains, stars, loops and nothing at all."""

import numpy as np
import pytest

from sessionloom.llm import components


@pytest.mark.parametrize("seed", range(3))
def test_roots_are_the_least_nodes(spark, seed):
    rng = np.random.default_rng(seed)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 60, (30, 2))] + [(100 + i, 101 + i) for i in range(40)] + [(200 + i, 200) for i in range(50)] + [(7, 7), (300, 301), (301, 300)]
    root = {n: n for p in pairs for n in p}
    while True:
        new = dict(root)
        for a, b in pairs:
            new[a] = new[b] = min(new[a], new[b])
        if new == root:
            break
        root = new
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {n: r for n, r in root.items() if n != r}


def test_no_edges(spark):
    assert components.connected(spark.createDataFrame([], "u long, v long")).count() == 0
