"""Groups against plain union-find."""

import random

from lawloom.llm.groups import components, grouped


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(160)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 540)] + [(None, 1), (7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    df = spark.createDataFrame(links, "a int, b int")
    assert {r.node: r.group for r in components(df, "a", "b").collect()} == {x: find(x) for x in parent}
    assert components(df.limit(0), "a", "b").count() == 0


def test_grouped(spark):
    members = spark.createDataFrame([("t", "x", 1), ("t", "y", 1), ("t", "a", 2), ("t", "z", 3), ("t", "z", 3)], "tbl string, key string, digest bigint")
    links = spark.createDataFrame([(1, 2), (1, 2)], "a bigint, b bigint")
    assert {tuple(r) for r in grouped(links, members).collect()} == {("t", "x", "a", 1), ("t", "y", "a", 1), ("t", "a", "a", 1), ("t", "z", "z", 0)}
