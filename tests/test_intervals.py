import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.operators.intervals import _carries, merge_ranked, periods_and_gaps

SCHEMA = "thread_id long, node long, start_pos int, end_pos int"


def brute(rows):
    cover = {}
    for t, n, s, e in rows:
        if None not in (t, n, s, e) and e > s:
            cover.setdefault((t, n), set()).update(range(s, e))
    out = set()
    for key, xs in cover.items():
        xs = sorted(xs)
        spans = [[xs[0], xs[0] + 1]]
        for x in xs[1:]:
            if x == spans[-1][1]:
                spans[-1][1] += 1
            else:
                spans.append([x, x + 1])
        out |= {(*key, "period", a, b) for a, b in spans} | {(*key, "gap", p[1], q[0]) for p, q in zip(spans, spans[1:])}
    return out


def check(spark, rows):
    got = periods_and_gaps(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == brute(rows)


def test_cases(spark):
    check(spark, [(1, 5, 0, 10), (1, 5, 10, 12), (1, 5, 3, 4), (1, 5, 20, 30), (1, 5, 20, 30), (1, -5, -7, -2), (None, 5, 0, 1), (1, None, 0, 1), (1, 5, None, 9), (1, 5, 9, None), (2, 5, 4, 4), (2, 5, 6, 3)])


def test_empty_and_types(spark):
    df = periods_and_gaps(spark.createDataFrame([], SCHEMA).selectExpr("*", "1 a", "2 b", "3 s", "'z' span_kind"))
    assert df.count() == 0 and dict(df.dtypes)["from_pos"] == "int"


def test_hot_entity_spans_partitions(spark):
    rows = [(1, 1, 10 * i, 10 * i + (10 if i % 3 else 7)) for i in range(3000)] + [(1, 1, 500, 9000), (0, 1, 0, 5), (2, 1, 0, 5), (1, 0, -5, 40000)]
    check(spark, rows)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 2), st.integers(-30, 30), st.integers(-30, 40)), max_size=40))
def test_property(spark, rows):
    check(spark, rows)


@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 60), st.integers(1, 15)), min_size=1, max_size=60), st.integers(1, 9))
def test_cut_anywhere(rows, parts):
    """Partitions of any cut, with what is handed over, give what the whole gives."""
    rows = sorted((a, 0, s, s + n) for a, s, n in rows)
    whole = list(zip(*(c.tolist() for c in merge_ranked(*map(np.array, zip(*rows))))))
    cut = [rows[i * len(rows) // parts : (i + 1) * len(rows) // parts] for i in range(parts)]

    class Row:
        def __init__(self, pid, part):
            m = merge_ranked(*map(np.array, zip(*part)))
            self.pid, self.fa, self.fb, (self.a, self.b, self.s, self.e) = pid, part[0][0], 0, (int(c[-1]) for c in m)

    handed, goes_on = _carries([Row(i, p) for i, p in enumerate(cut) if p])
    out = []
    for i, p in enumerate(cut):
        if p:
            own = ([handed[i]] if i in handed else []) + p
            m = list(zip(*(c.tolist() for c in merge_ranked(*map(np.array, zip(*own))))))
            out += m[:-1] if i in goes_on else m
    assert out == whole
