"""What is reached from a node: as by joins, and without any join."""

import random

import pytest

from strandloom.operators import graph as G


@pytest.mark.parametrize("most", [1 << 22, 1])
def test_reached_within_hops(spark, monkeypatch, most):
    monkeypatch.setattr(G, "LOCAL_STEPS", most)
    r = random.Random(5)
    links = [(-1, i, 0) for i in range(2, 40)] + [(-i, 40 + i % 7, 0) for i in range(2, 40)] + [(r.choice((1, -1)) * r.randint(1, 60), r.choice((1, -1)) * r.randint(1, 60), 0) for _ in range(40)]
    steps: dict = {}
    for a, b, _ in links:
        steps.setdefault(-a, set()).add(b)
        steps.setdefault(-b, set()).add(a)
    starts = [*range(-60, 61), 999]
    for radius in (1, 3):
        want = set()
        for s in starts:
            front = {s}
            for _ in range(radius):
                front = {y for x in front for y in steps.get(x, ())}
                want |= {(s, y) for y in front}
        got = G.fw_reached(spark.createDataFrame(links, "source long, dest long, dist int"), spark.createDataFrame([(s,) for s in starts] * 2, "node long"), radius)
        rows = [tuple(x) for x in got.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want
        if most > 1:
            assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
