"""Term frequencies and the vote sketch against brute force."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from strandloom.llm import heavy, termfreq

SCHEMA = "term string, owner long, amount int"


def frequencies(spark, rows, schema=SCHEMA):
    return termfreq.term_frequencies(termfreq.owner_pairs(spark.createDataFrame(rows, schema).selectExpr("*", "1 occurrences", "2 presence")))


def test_frequencies(spark):
    rows = [("a", 1, 2), ("a", 1, 3), ("a", None, 4), ("b", None, 1), (None, 5, 9), ("", 7, 1), ("c", 2, None)] + [("hot", i % 50, 1) for i in range(5000)]
    got = frequencies(spark, rows).collect()
    by = {r.term: (r.occurrences, r.presence) for r in got}
    assert by["a"] == (9, 1) and by["b"] == (1, 0) and by["hot"] == (5000, 50) and by[""] == (1, 1) and None not in by
    assert sorted(r.term_id for r in got) == list(range(5))


def test_marks_and_empty(spark):
    assert frequencies(spark, []).count() == 0
    rows = [("r", 1, 1), ("c", 1, 5), ("c", 2, 5), ("c", 3, 5), ("n", 1, 5)]
    marks = {r.term: r.mark for r in termfreq.mark_terms(frequencies(spark, rows), 300).collect()}
    assert marks == {"r": "rare", "c": "common", "n": None}


def test_number_terms_in_many_ranges(spark):
    rows = [(i % 997, i % 13, 1) for i in range(20000)]
    df = termfreq.term_frequencies(termfreq.owner_pairs(spark.createDataFrame(rows, "term long, owner long, amount int")), 23)
    assert sorted(r.term_id for r in df.select("term_id").collect()) == list(range(997))
    want = defaultdict(set)
    for t, o, _ in rows:
        want[t].add(o)
    n = Counter(t for t, _, _ in rows)
    assert {(r.term, r.occurrences, r.presence) for r in df.collect()} == {(t, n[t], len(o)) for t, o in want.items()}


@given(st.lists(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 9)), min_size=1, max_size=30), min_size=1, max_size=5))
def test_sketch_bounds(parts):
    """Bounds hold for cells far too few, however the data are split and merged."""
    truth, whole = Counter(), heavy.VoteSketch(2, 3)
    for part in parts:
        one = heavy.VoteSketch(2, 3)
        items, amounts = map(np.array, zip(*part))
        one.add(items[: len(items) // 2], amounts[: len(items) // 2])
        one.add(items[len(items) // 2 :], amounts[len(items) // 2 :])
        for i, a in part:
            truth[i] += a
        for r in range(2):
            whole.merge(r, np.arange(3), one.total[r], one.item[r], one.surplus[r])
    items = np.arange(31)
    assert (whole.upper(items) >= np.array([truth[i] for i in items])).all()
    cand, lower = whole.candidates()
    assert all(truth[int(c)] >= x for c, x in zip(cand, lower))
    assert whole.total.sum(axis=1).tolist() == [sum(truth.values())] * 2


@pytest.mark.parametrize("cells", [2, 64, 1 << 14])
def test_top_is_exact(spark, cells):
    rng = np.random.default_rng(cells)
    rows = [(int(x), int(a)) for x, a in zip(rng.zipf(1.4, 4000) % 500, rng.integers(1, 6, 4000))] + [(None, 5), (7, None), (7, 0), (7, -3)] + [(1000 + i, 50) for i in range(4)]
    df = spark.createDataFrame(rows, "item long, amount long").selectExpr("*", "1 total", "2 hash_row").repartition(5)
    truth = Counter()
    for i, a in rows:
        if i is not None and a and a > 0:
            truth[i] += a
    want = sorted(truth.items(), key=lambda x: (-x[1], x[0]))[:12]
    assert [tuple(r) for r in heavy.top_items(df, 12, cells=cells).collect()] == want
    for r in heavy.approximate_top(df, 12, cells=cells).collect():
        assert r.at_least <= truth[r.item] <= r.at_most


def test_few_and_none(spark):
    df = spark.createDataFrame([(1, 1), (2, 1)], "item long, amount long")
    assert [r.item for r in heavy.top_items(df, 9).collect()] == [1, 2]
    assert heavy.top_items(df.limit(0), 9).count() == 0 and heavy.approximate_top(df.limit(0), 9).count() == 0
