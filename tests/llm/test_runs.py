import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.llm import runs


def brute(symbols, blank, least):
    """Runs straight from the definition; ``blank`` tells a blank, None equals nothing."""
    out, cur = [], None
    for i, x in enumerate(symbols):
        if blank(x):
            continue
        if cur and x is not None and x == cur[0] and (i - cur[2] == 1 or i - cur[2] == 2 and blank(symbols[i - 1])):
            cur = (x, cur[1], i, cur[3] + 1)
        else:
            if cur and cur[3] >= least:
                out.append(cur[1:])
            cur = (x, i, i, 1) if x is not None else None
    if cur and cur[3] >= least:
        out.append(cur[1:])
    return out


LISTS = "store string, read_id long, path array<bigint>"
TEXTS = "store string, read_id long, seq string"


def check_lists(spark, rows, least=2):
    got = runs.list_runs(spark.createDataFrame(rows, LISTS).selectExpr("*", "1 events", "2 id"), least=least).collect()
    want = {(s, r, *x) for s, r, p in rows for x in brute(p or [], lambda v: v == 0, least)}
    assert len(got) == len(want) and {tuple(x) for x in got} == want


def check_texts(spark, rows, least=3):
    got = runs.text_runs(spark.createDataFrame(rows, TEXTS), least=least).collect()
    fold = lambda t: [c.upper() if c in "acgt" else c for c in t or ""]
    want = {(s, r, *x) for s, r, t in rows for x in brute(fold(t), lambda c: c not in "ACGT", least)}
    assert len(got) == len(want) and {tuple(x) for x in got} == want


def test_lists(spark):
    rows = [("a", 1, [5, 5, 0, 5, 0, 0, 5, -5, 5]), ("a", 2, None), ("a", 3, []), (None, 4, [7, 7]), ("a", None, [7, 0, 7]), ("a", 5, [7, None, 7, 7]), ("a", 6, [0, 0, 0]), ("a", 7, [55296, 55296, 1 << 60, 1 << 60])]
    check_lists(spark, rows + rows[:3])


def test_texts(spark):
    rows = [("a", 1, "AAaNaANNAAA"), ("a", 2, None), ("a", 3, ""), ("b", 4, "ccccß\ncc-c"), ("b", 5, "ACGT" * 5000 + "T" * 20000), ("b", 6, "\U0001f600AAA"), ("b", 7, "NNNN"), ("b", 8, "AxAyA\x00A")]
    check_texts(spark, rows + rows[:2])
    check_texts(spark, rows, 8)


def test_empty(spark):
    assert runs.list_runs(spark.createDataFrame([], LISTS)).count() == 0
    assert runs.text_runs(spark.createDataFrame([], TEXTS)).count() == 0


def test_more_events_than_code_points(spark, monkeypatch):
    import pyarrow as pa

    for limit in (3, 1):
        monkeypatch.setattr(runs, "_SYMBOLS", limit)
        lists = [[1, 1, 2, 0, 2], [3, 3], [9, 8, 7, 7, 0, 7, 1, 0, 0, 1], []]
        batch = pa.RecordBatch.from_arrays([pa.array(["s"] * 4), pa.array(range(4)), pa.array(lists, pa.list_(pa.int64()))], names=["store", "id", "events"])
        out = next(runs._list_runs(2, 0)(iter([batch]))).to_pylist()
        assert [(r["id"], r["first_at"], r["last_at"], r["run_count"]) for r in out] == [(i, *x) for i, p in enumerate(lists) for x in brute(p, lambda v: v == 0, 2)]


@given(st.lists(st.integers(-2, 2), max_size=40))
def test_cycled_codes(values):
    v = np.array(values, dtype=np.int64)
    code = runs._cycled(v, np.zeros(len(v), bool), 0).tolist()
    assert brute(code, lambda x: x == 1, 2) == brute(values, lambda x: x == 0, 2)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.lists(st.integers(-2, 2) | st.none(), max_size=14), max_size=12), st.lists(st.text("aAcN-ß", max_size=20), max_size=12))
def test_property(spark, lists, texts):
    check_lists(spark, [("s", i, p) for i, p in enumerate(lists)] or [("s", 0, None)])
    check_texts(spark, [("s", i, t) for i, t in enumerate(texts)] or [("s", 0, None)])


def test_collapsed(spark):
    df = spark.createDataFrame([("s", 1, [4, 4, 0, 4, 9, 0, 0, 9]), ("t", 1, [4, 4]), ("s", 1, [4, 4, 0, 4, 9, 0, 0, 9]), (None, 2, [3]), ("t", 3, []), ("t", 4, None)], LISTS)
    got = [tuple(r) for r in runs.collapse_runs(df.selectExpr("*", "1 id", "2 extent")).collect()]
    assert sorted(got, key=str) == sorted([("s", 1, 0, 4, 3, 4), ("s", 1, 4, 9, 1, 1), ("s", 1, 7, 9, 1, 1), ("t", 1, 0, 4, 2, 2), (None, 2, 0, 3, 1, 1)], key=str)


EVENTS = "who long, at timestamp, what string, no int"


def check_events(spark, rows, least=2):
    from datetime import datetime, timezone

    base = datetime(2024, 1, 1)
    df = spark.createDataFrame([(w, None if t is None else datetime.fromtimestamp(base.replace(tzinfo=timezone.utc).timestamp() + t), k, n) for w, t, k, n in rows], EVENTS)
    got = runs.event_runs(df.selectExpr("*", "1 place", "2 event"), "who", "at", "what", tie="no", least=least).selectExpr("who", "event", "unix_seconds(first_ts) % 86400 a", "unix_seconds(last_ts) % 86400 b", "run_count", "duration_us div 1000000 d").collect()
    want = []
    for who in {w for w, t, _, _ in rows if w is not None}:
        mine = sorted({(t, n, k or "", k) for w, t, k, n in rows if w == who and t is not None})
        for first, last, n in brute([k if k is not None else "" for *_, k in mine], lambda v: v == "", least):
            want.append((str(who), mine[first][3], mine[first][0], mine[last][0], n, mine[last][0] - mine[first][0]))
    assert sorted(map(tuple, got)) == sorted(want)


def test_event_runs(spark):
    hot = [(1, i, "a" if i < 700 else None if i in (710, 720, 721) else "b", 0) for i in range(900)]
    few = [(2, 5, "x", 1), (2, 5, "x", 2), (2, 6, None, 1), (2, 7, "x", 1), (3, 1, "b", 0), (3, None, "b", 0), (None, 1, "b", 0), (4, 1, None, 0), (5, 1, "b", 0)]
    check_events(spark, hot + few + few[:3])
    check_events(spark, hot + few, least=1)
    assert runs.event_runs(spark.createDataFrame([], EVENTS), "who", "at", "what").count() == 0


def test_event_runs_over_small_batches(spark, monkeypatch):
    import random

    r = random.Random(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        check_events(spark, [(r.randrange(3), i, r.choice(["a", "a", "b", None]), 0) for i in range(300)], least=1)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_event_runs_of_many_kinds(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(runs, "_SYMBOLS", 1)
    kinds = ["a", None, "a", "b", "b", None, None, "b"]
    batch = pa.RecordBatch.from_arrays([pa.array(["e"] * 8), pa.array(range(8)), pa.array([0] * 8), pa.array(kinds)], names=["entity", "us", "tie", "event"])
    assert [(x[1], x[2], x[3], x[4]) for x in runs._batch_runs(batch)] == [("a", 0, 2, 2), ("b", 3, 4, 2), ("b", 7, 7, 1)]
