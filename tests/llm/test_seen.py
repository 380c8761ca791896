import random

import pytest
from pyspark.sql import functions as F

from strandloom.llm import seen

SCHEMA = "key string, ord long"


def brute(rows, known=()):
    first = {}
    for k, o in rows:
        if k is not None and o is not None:
            first[k] = min(o, first.get(k, o))
    return {o for k, o in rows if k is not None and o is not None and (k in known or o > first[k])}


@pytest.mark.parametrize("batches,fan_out", [(1, 2), (3, 2), (7, 3)])
def test_matches_brute_force(spark, batches, fan_out):
    r = random.Random(batches)
    rows = [(r.choice(["hot", f"k{r.randrange(300)}", None]), i) for i in range(1500)]
    rows += rows[:40] + [("k1", None)]
    known = ["k5", "k6", "unmet", None]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 h", "'x' shard", "2 kmer").repartition(5)
    k = spark.createDataFrame([(x,) for x in known], "key string")
    got = [x.ord for x in seen.seen_before(df, k, batches, fan_out).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, known)
    report = seen.probe_report(df, k, batches, fan_out).collect()
    assert all(x.error_rate == x.wrong_answers == 0 and x.probed == x.fresh + x.verified_hits for x in report)
    assert sum(x.records for x in report) == len({o for key, o in rows if key is not None and o is not None})


def test_wrong_answers_are_counted(spark, monkeypatch):
    """A store that forgot some first records: the report counts them."""
    df = spark.createDataFrame([(f"k{i}", i) for i in range(40)], SCHEMA)
    monkeypatch.setattr(seen.SeenKeys, "firsts", lambda s: s.spark.createDataFrame([(i,) for i in range(30)], "ord long"))
    report = seen.probe_report(df, None, 4, 2).orderBy("batch").collect()
    assert [x.wrong_answers for x in report] == [0, 0, 0, 10] and report[3].error_rate == 1.0


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert seen.seen_before(none, none.select("key")).count() == 0
    assert seen.seen_before(spark.createDataFrame([("a", 1), ("a", 1), ("a", 2)], SCHEMA)).collect()[0].ord == 2


def test_colliding_hashes_are_verified(spark, monkeypatch, tmp_path):
    """Runs in which many keys share a hash: hits count by full key only."""
    import pyarrow as pa

    run = f"file://{tmp_path}/run"
    w = seen._Writer(run, 0)
    w.add(pa.table({"h": [1, 1, 1, 5], "key": ["a", "b", "c", "d"], "ord": [1, 2, 3, 4]}, schema=seen._RUN))
    w.close()
    batch = pa.RecordBatch.from_pydict({"h": [1, 1, 1, 5, 7], "key": ["b", "c", "x", "y", "z"], "ord": [9] * 5, "shard": [0] * 5})
    out = next(seen._ingest([run], f"file://{tmp_path}/out")(iter([batch])))
    assert [c[0].as_py() for c in out.columns] == [0, 5, 3, 4, 2]
    assert seen._Cursor(f"file://{tmp_path}/out", 0).block().column("key").to_pylist() == ["x", "y", "z"]


def test_merge_and_fences(spark, monkeypatch, tmp_path):
    import pyarrow as pa

    monkeypatch.setattr(seen, "BLOCK_ROWS", 4)
    runs, all_keys = [], []
    for i in range(3):
        w = seen._Writer(f"file://{tmp_path}/r{i}", 2)
        hs = sorted(random.Random(i).sample(range(100), 17))
        for at in range(0, 17, 5):
            part = hs[at : at + 5]
            w.add(pa.table({"h": part, "key": [f"{i}-{h}" for h in part], "ord": part}, schema=seen._RUN))
        w.close()
        runs.append(f"file://{tmp_path}/r{i}")
        all_keys += [(h, f"{i}-{h}") for h in hs]
    list(seen._merge(runs, f"file://{tmp_path}/m")(iter([pa.RecordBatch.from_pydict({"id": [2]})])))
    c, got = seen._Cursor(f"file://{tmp_path}/m", 2), []
    assert len(c.fences) > 5
    while (b := c.block()) is not None:
        got += list(zip(b.column("h").to_pylist(), b.column("key").to_pylist()))
    assert [h for h, _ in got] == sorted(h for h, _ in all_keys) and set(got) == set(all_keys)


def test_store_is_reopened(spark):
    s = seen.SeenKeys(spark, fan_out=2)
    for i in range(5):
        p = s.add(spark.range(i * 10, i * 10 + 20).select(F.col("id").cast("string").alias("key"), F.col("id").alias("ord")))
        assert p.fresh == (20 if i == 0 else 10)
    again = seen.SeenKeys(spark, s.path)
    assert again.runs == s.runs and again.firsts().count() == 60 and len(s.runs) < 5
    assert again.add(spark.createDataFrame([("3", 99), ("new", 98)], SCHEMA)).fresh == 1
