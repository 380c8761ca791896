"""Paths of pairs: against brute force, and walked once for all pairs of a start."""

import random

import pytest

from strandloom.operators import traversal
from strandloom.operators.extend import bridge_paths
from strandloom.operators.graph import Graph
from strandloom.operators.traversal import paths_between, paths_of_pairs


def brute(sizes: dict, steps: dict, pairs: list, max_nodes: int, max_size: int) -> list:
    out = []

    def go(f, t, node, path, size):
        for nxt, dist in steps.get(node, {}).items():
            if nxt == t:
                if size + dist <= max_size:
                    out.append((f, t, path, size + dist))
            elif len(path) < max_nodes and nxt != f and nxt not in path and size + dist + sizes[abs(nxt)] <= max_size:
                go(f, t, nxt, (*path, nxt), size + dist + sizes[abs(nxt)])

    for f, t in pairs:
        go(f, t, f, (), 0)
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_all_paths_of_pairs(spark, seed):
    r = random.Random(seed)
    ids = range(1, 9)
    sizes = {i: r.randint(1, 9) for i in ids}
    end = lambda: r.choice(ids) * r.choice((1, -1))
    links = [(end(), end(), r.randint(-2, 3)) for _ in range(18)]
    steps: dict = {}
    for a, b, dist in links:
        for s, d in ((a, b), (b, a)):
            at = steps.setdefault(-s, {})
            at[d] = min(at.get(d, dist), dist)
    pairs = sorted({(end(), end()) for _ in range(14)} | {(1, 1)})
    nodes = spark.createDataFrame([(i, "A" * n) for i, n in sizes.items()], "node_id long, seq string")
    got = paths_between(nodes, spark.createDataFrame(links, "source long, dest long, dist int"), spark.createDataFrame(pairs, "from_node long, to_node long"), 3, 20)
    assert sorted((x.from_node, x.to_node, tuple(x.path), x.size) for x in got.collect()) == brute(sizes, steps, pairs, 3, 20)


def joined_rows(plan) -> list[int]:
    own = [plan.metrics().get("numOutputRows").get().value()] if "Join" in plan.nodeName() else []
    children = plan.children()
    return own + [n for i in range(children.size()) for n in joined_rows(children.apply(i))]


@pytest.mark.parametrize("bridged", [False, True])
def test_pairs_of_a_start_share_its_walks(spark, bridged):
    n = 60
    links = [(-1, 2, 0)] + [(-2, 100 + i, 0) for i in range(n)] + [(-(100 + i), 200 + i, 0) for i in range(n)]
    ids = [1, 2, *range(100, 100 + n), *range(200, 200 + n)]
    nodes, links = spark.createDataFrame([(i, "A") for i in ids], "node_id long, seq string"), spark.createDataFrame(links, "source long, dest long, dist int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        if bridged:
            got = bridge_paths(spark.createDataFrame([(i, [1, 200 + i]) for i in range(n)], "read_id long, path array<bigint>"), Graph(nodes, links), 2, 100)
        else:
            got = paths_between(nodes, links, spark.createDataFrame([(1, 200 + i) for i in range(n)], "from_node long, to_node long"), 2, 100)
        assert {tuple(x.path) for x in got.collect()} == {(1, 2, 100 + i, 200 + i) if bridged else (2, 100 + i) for i in range(n)}
        assert max(joined_rows(got._jdf.queryExecution().executedPlan())) < 10 * n  # walked by pair it is n * n
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("seed", range(3, 9))
def test_pairs_walked_from_both_ends(spark, seed):
    r = random.Random(seed)
    ids = range(1, 10)
    sizes = {i: r.randint(1, 9) for i in ids}
    end = lambda: r.choice([*ids, 1, 1, 2]) * r.choice((1, -1))
    links = [(end(), end(), r.randint(-8, 3)) for _ in range(22)]
    steps: dict = {}
    for a, b, dist in links:
        for s, d in ((a, b), (b, a)):
            at = steps.setdefault(-s, {})
            at[d] = min(at.get(d, dist), dist)
    pairs = sorted({(end(), end()) for _ in range(30)} | {(1, 1), (1, -1)})
    nodes = spark.createDataFrame([(i, "A" * n) for i, n in sizes.items()], "node_id long, seq string")
    got = paths_of_pairs(nodes, spark.createDataFrame(links, "source long, dest long, dist int"), spark.createDataFrame(pairs, "from_node long, to_node long"), 3, 9)
    want = brute(sizes, steps, pairs, 3, 9)
    assert sorted((x.from_node, x.to_node, tuple(x.path), x.size) for x in got.collect()) == want and any(len(w[2]) > 1 for w in want)


def test_neighbours_of_a_hub_are_not_listed_for_every_pair(spark, monkeypatch):
    n, hub = 60, 1
    links = [(-(100 + i), hub, 0) for i in range(n)] + [(-hub, 200 + i, 0) for i in range(n)] + [(-(200 + i), 300 + i, 0) for i in range(n)]
    ids = [hub, *range(100, 100 + n), *range(200, 200 + n), *range(300, 300 + n)]
    nodes, links = spark.createDataFrame([(i, "A") for i in ids], "node_id long, seq string"), spark.createDataFrame(links, "source long, dest long, dist int")
    kept = []
    if hasattr(traversal, "persisted"):
        write = traversal.persisted
        monkeypatch.setattr(traversal, "persisted", lambda df, name: (kept.append(write(df, name)), kept[-1])[1])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = bridge_paths(spark.createDataFrame([(i, [100 + i, 300 + i]) for i in range(n)], "read_id long, path array<bigint>"), Graph(nodes, links), 2, 100)
        assert {tuple(x.path) for x in got.collect()} == {(100 + i, hub, 200 + i, 300 + i) for i in range(n)}
        rows = [*joined_rows(got._jdf.queryExecution().executedPlan()), *(x.count() for x in kept)]
        assert max(rows) < 10 * n  # walked from one end it is n * n
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
