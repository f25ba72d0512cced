import random

from larkspur.llm.common import connected_components, join_counted


def test_components_against_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, 5000 + k) for k in range(1, 60)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: find(x) for x in parent}


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_join_counted_is_a_join(spark):
    left = [(1, i) for i in range(500)] + [(k, 0) for k in range(2, 40)] + [(99, 1)]
    right = [(1, 500, "hot")] + [(k, 1, f"v{k}") for k in range(2, 40)]
    a, b = spark.createDataFrame(left, "k int, x int"), spark.createDataFrame(right, "k int, n int, v string")
    want = sorted((r.k, r.x, r.v) for r in a.join(b, "k").collect())
    assert sorted((r.k, r.x, r.v) for r in join_counted(a, b, "k", "n").collect()) == want
