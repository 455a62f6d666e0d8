"""Louvain and Leiden on planted partitions, with modularity counted plainly."""

import random

import pytest

from terravane.operators import communities as C


def planted(groups=4, size=7, seed=2):
    rng = random.Random(seed)
    node = lambda g, i: f"n{g}{i:02d}"
    edges = {(node(g, i), node(g, j)) for g in range(groups) for i in range(size) for j in range(i + 1, size) if rng.random() < 0.8}
    edges |= {(node(g, i), node(g, i + 1)) for g in range(groups) for i in range(size - 1)}
    edges |= {(node(g, 0), node((g + 1) % groups, 1)) for g in range(groups)}
    return sorted((a, b, 1.0) for a, b in edges)


def plain_modularity(edges, of, resolution=1.0):
    all_ = 2 * sum(w for *_, w in edges)
    total, inner = {}, 0.0
    for a, b, w in edges:
        inner += 2 * w * (of[a] == of[b])
        for x in (a, b):
            total[of[x]] = total.get(of[x], 0.0) + w
    return inner / all_ - resolution * sum(t * t for t in total.values()) / all_**2


def connected(edges, members):
    near = {}
    for a, b, _ in edges:
        if a in members and b in members:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    seen, todo = set(), [min(members)]
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += near.get(x, ())
    return seen == members


def labels_of(df):
    return {r["id"]: r["community"] for r in df.collect()}


def test_modularity_equals_counting(spark):
    edges = [*planted(), ("loop", "loop", 2.5), ("loop", "n000", 0.5)]
    of = {x: hash(x[:2]) % 3 for a, b, _ in edges for x in (a, b)}
    both = C.both_ways(spark.createDataFrame(edges, "a string, b string, weight double"))
    got = C.modularity(both, spark.createDataFrame(list(of.items()), "id string, community long"))
    assert got == pytest.approx(plain_modularity(edges, of), abs=1e-12)


def test_moves_are_the_best_of_all_neighbours(spark):
    edges = planted(3, 5, 4)
    nodes = sorted({x for a, b, _ in edges for x in (a, b)})
    of = {x: min(y for y in nodes if y[1] == x[1]) if x[-1] in "012" else x for x in nodes}
    both = C.both_ways(spark.createDataFrame(edges, "a string, b string, weight double"))
    labels = spark.createDataFrame(list(of.items()), "id string, community string")
    from pyspark.sql import functions as F

    for node in nodes[::3]:  # one node at a time: the change of modularity decides
        got = labels_of(C.moved(both, labels, F.col("id") == node, 1.0))
        near = {of[node]} | {of[y if x == node else x] for x, y, _ in edges if node in (x, y)}
        best = max(plain_modularity(edges, of | {node: c}) for c in near)
        assert plain_modularity(edges, got) == pytest.approx(best, abs=1e-8)
        assert all(got[x] == of[x] for x in nodes if x != node)


def test_planted_groups_are_found_and_hang_together(spark):
    edges = planted()
    df = spark.createDataFrame(edges, "a string, b string, weight double")
    found = C.louvain(df)
    first, second = labels_of(found), labels_of(C.leiden(df, start=found))
    want = {x: f"n{x[1]}00" for x in first}
    assert first == want and second == want
    assert C.louvain(df.limit(0)).count() == 0


def test_communities_without_an_inner_way_are_split(spark):
    edges = [("a", "b", 1.0), ("c", "d", 1.0), ("b", "x", 1.0), ("x", "c", 1.0)]
    both = C.both_ways(spark.createDataFrame(edges, "a string, b string, weight double"))
    labels = spark.createDataFrame([("a", "q"), ("b", "q"), ("c", "q"), ("d", "q"), ("x", "y")], "id string, community string")
    got = labels_of(C.hanging_together(both, labels))
    assert got["a"] == got["b"] != got["c"] == got["d"] and got["x"] not in (got["a"], got["c"])


def test_leiden_is_no_worse_and_connected_on_a_random_graph(spark):
    rng = random.Random(7)
    edges = sorted({(f"v{min(p):02d}", f"v{max(p):02d}", 1.0) for p in ((rng.randrange(18), rng.randrange(18)) for _ in range(40)) if p[0] != p[1]})
    df = spark.createDataFrame(edges, "a string, b string, weight double")
    start = C.alone(C.both_ways(df))  # every node alone: Leiden's own moves do the work
    first, second = labels_of(start), labels_of(C.leiden(df, start=start))
    assert plain_modularity(edges, second) >= plain_modularity(edges, first) + 0.2
    for c in set(second.values()):
        assert connected(edges, {x for x, y in second.items() if y == c})
