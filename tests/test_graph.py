"""Connected components against union-find."""

import random

from attestry.operators import graph


def test_components_equal_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(300)] + [(5, 5), (2000, 2001), (2001, 2000)]
    edges += [(3000 + ((i * 37) % 211), 3000 + (((i + 1) * 37) % 211)) for i in range(150)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    want = {x: root(x) for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert got == want
    assert graph.components(spark.createDataFrame([(1, 1)], "a bigint, b bigint"), "a", "b").count() == 0
