"""Threads that others support: without pairing the threads of a hot node."""

import random
from collections import defaultdict

import pytest

from strandloom.operators import partition as P


def supported(threads: dict[int, list[int]], support: int) -> set[int]:
    held = defaultdict(set)
    for t, nodes in threads.items():
        for x in nodes:
            held[x].add(t)
            held[-x].add(-t)
    out = set()
    for t, nodes in threads.items():
        met, unsafe = defaultdict(int), []
        for i, x in enumerate(nodes):
            others = held[x] - {t}
            if i > len(nodes) // 2:
                unsafe.append(sum(met[o] >= support for o in others) < support)
            for o in others:
                met[o] += 1
        if not any(a and b for a, b in zip(unsafe, unsafe[1:])):
            out.add(t)
    return out


@pytest.mark.parametrize("most, least", [(1 << 22, 1), (1 << 22, 64), (1 << 22, 1 << 20), (300, 8), (0, 1)])
def test_supported_threads(spark, monkeypatch, most, least):
    monkeypatch.setattr(P, "LOCAL_THREADS", most)
    monkeypatch.setattr(P, "HOT_THREADS", least)
    r = random.Random(7)
    line = list(range(100, 160))
    threads = {}
    for t in range(1, 161):
        at = r.randrange(40)
        nodes = [x for x in line[at : at + r.randint(1, 16)] if r.random() < 0.8]
        nodes = [r.choice((1, -1)) * r.randint(1, 5) if r.random() < 0.3 else r.randint(1000, 9999) if r.random() < 0.3 else x for x in nodes] or [1]
        threads[t] = nodes if r.random() < 0.5 else [-x for x in reversed(nodes)]
    rows = [(t, i, x, 0, 1) for t, nodes in threads.items() for i, x in enumerate(nodes)]
    df = spark.createDataFrame(rows, "thread_id long, idx int, node long, start_pos int, end_pos int")
    for support in (1, 2, 3):
        want = supported(threads, support)
        got = P.supported_threads(df, df.select("thread_id").distinct(), support)
        assert sorted(x.thread_id for x in got.collect()) == sorted(want) and 0 < len(want) < len(threads)
    part = P.supported_threads(df, df.where("thread_id % 2 = 1").select("thread_id").unionByName(spark.createDataFrame([(999,)], "thread_id long")), 2)
    assert sorted(x.thread_id for x in part.collect()) == sorted(t for t in supported(threads, 2) if t % 2)


def test_threads_of_a_hot_node_do_not_meet_in_a_join(spark):
    """Two thousand threads through one node: as pairs they were four million rows."""
    df = spark.range(1, 2001).selectExpr("id as thread_id", "explode(array(0, 1, 2)) as idx").selectExpr("thread_id", "idx", "cast(7 as long) as node", "0 as start_pos", "1 as end_pos")
    got = P.supported_threads(df, df.select("thread_id").distinct(), 2)
    assert got.count() == 2000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "before" not in plan
