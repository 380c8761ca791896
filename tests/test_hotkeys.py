from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.operators.hotkeys import entry_totals, top_read_per_node

SCHEMA = "store string, read_id long, path_offset int, path array<bigint>"


def brute(rows):
    best, totals, reads = {}, Counter(), Counter()
    for store, rid, _, path in rows:
        if store is None or rid is None:
            continue
        for node, n in Counter(abs(x) for x in path or [] if x).items():
            key = (store, node)
            best[key] = min(best.get(key, (1, 0)), (-n, rid))
            totals[key] += n
            reads[key] += 1
    return {(*k, v[1], -v[0]) for k, v in best.items()}, {(*k, n, reads[k]) for k, n in totals.items()}


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    best, totals = brute(rows)
    assert {tuple(r) for r in top_read_per_node(df).collect()} == best
    assert {tuple(r) for r in entry_totals(df).collect()} == totals


def test_nulls_ties_repeats(spark):
    rows = [("a", 2, None, [5, -5, 0, 7]), ("a", 1, 3, [5, 5]), ("a", 1, 3, [5, 5]), ("b", 9, 0, None), ("b", 8, 0, []), (None, 1, 0, [1]), ("b", None, 0, [1]), ("b", 3, 0, [None, -(1 << 40), 4096, 4095])]
    check(spark, rows)


def test_empty(spark):
    assert top_read_per_node(spark.createDataFrame([], SCHEMA)).count() == 0
    assert entry_totals(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hot_key_and_clashing_columns(spark):
    rows = [("a", i, 0, [1] * (i % 7 + 1) + [i + 2]) for i in range(5000)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' label", "1 id", "2 block", "3 salt", "4 entries").repartition(7)
    got = {(r.store, r.node): (r.read_id, r.entries) for r in top_read_per_node(df).collect()}
    assert got[("a", 1)] == (6, 7) and len(got) == 5001 and got[("a", 100)] == (98, 1)


def test_many_keys_are_flushed(spark, monkeypatch):
    from strandloom.operators import hotkeys

    monkeypatch.setattr(hotkeys, "FLUSH_ROWS", 50)
    rows = [("a", i % 11, 0, [i, 3 * i + 1, 5]) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    run = hotkeys._split_reducer("total", 4)
    parts = [b for batch in df.selectExpr("store label", "read_id id", "path").toArrow().to_batches(20) for b in run(iter([batch]))]
    assert sum(b.num_rows for b in parts) > 2


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 5), st.none(), st.lists(st.integers(-4, 4), max_size=6)), max_size=20))
def test_property(spark, rows):
    check(spark, rows)
