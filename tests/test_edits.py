"""The edit queue: deletions that share an item are accepted at once, in no rounds."""

import random

import pytest

from strandloom.operators import contig as C


def in_order(ops: list) -> set:
    taken: set = set()
    out = set()
    items: dict = {}
    for op, kind, item in ops:
        items.setdefault((op, kind), set()).add(item)
    for (op, kind), mine in sorted(items.items()):
        if kind.endswith("deletion") or not mine & taken:
            taken |= mine
            out.add(op)
    return out


@pytest.mark.parametrize("local_rows", [0, 1 << 16])
def test_deletions_of_one_item_take_no_rounds(spark, monkeypatch, local_rows):
    r = random.Random(3)
    # ends of a hot node (1, -1) that most deletions and some expansions consume
    ops = [(op, "node_deletion", item) for op in range(10, 70) for item in (1, 1000 + op)]
    ops += [(5, "node_expansion", 1), (5, "node_expansion", 1020), (40, "node_expansion", 1), (90, "node_expansion", 1050)]
    ops = [x for x in ops if x[:2] != (40, "node_deletion")] + [(200 + i, "node_expansion", r.randint(5000, 5030)) for i in range(40)]
    calls: list = []
    kept = C.persisted
    monkeypatch.setattr(C, "persisted", lambda df, purpose: (calls.append(purpose), kept(df, purpose))[1])
    df = spark.createDataFrame(ops, "op_id long, kind string, item long")
    assert {x.op_id for x in C.accepted_edits(df, local_rows=local_rows).collect()} == in_order(ops)
    assert len(calls) < 12  # two for each round
