from __future__ import annotations

import random

import pytest

from curatrix.llm.common import components


def _plain(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("kind", ["chain", "star", "random", "empty"])
def test_components(spark, kind):
    rng = random.Random(3)
    edges = {
        "chain": [(i, i + 1) for i in range(40)] + [(100, 99)],
        "star": [(500, i) for i in range(60)] + [(700, 701)],
        "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(50)],
        "empty": [],
    }[kind]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges + [(None, 1), (2, 2)], "a long, b long")).collect()}
    assert got == _plain([(a, b) for a, b in edges if a != b])
