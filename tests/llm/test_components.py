import random

from millrace.llm.components import connected_components


def chain(order):
    return list(zip(order, order[1:]))


def woven(n):
    """A path whose ids alternate between the ends: 0, n-1, 1, n-2, ..."""
    return [i // 2 if i % 2 == 0 else n - 1 - i // 2 for i in range(n)]


def test_long_chains(spark):
    """Ascending, descending, least id at the end, and ids woven from both ends: four graphs beside each other."""
    orders = [range(2000), range(1999, -1, -1), [0, *range(1999, 0, -1)], woven(2000)]
    edges = [(a + i * 10_000, b + i * 10_000) for i, order in enumerate(orders) for a, b in chain(list(order))]
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == 8000 and all(r.component == r.node // 10_000 * 10_000 for r in got)


def test_star_of_many_leaves(spark):
    edges = spark.range(1, 10_001).selectExpr("id AS a", "5 AS b")
    got = connected_components(edges).collect()
    assert len(got) == 10_000 and {r.component for r in got} == {1}


def test_random_graph_against_union_find(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(3000), rnd.randrange(3000)) for _ in range(2300)] + [(7, 7), (-5, 9000), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_no_links(spark):
    assert connected_components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0
