"""Seeds by minimizer: the rows of the k-mer join, by fewer rows shuffled."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql.classic.dataframe import DataFrame as Classic

import __spark_entry__ as entry
from strandloom.operators import kmer_counts as K
from strandloom.operators import seeding as S
from strandloom.plans.views import nodes, reads


def _made(spark):
    r = random.Random(11)
    dna = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    back = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    rep = dna(60)
    seqs = [dna(r.randint(5, 150)) + rep * r.randint(0, 2) + dna(20) for _ in range(12)] + ["A" * 120, "ACGT" * 30, back(rep) + dna(40), "", "ACG"]
    texts = []
    for s in seqs:
        for _ in range(3):
            a = r.randrange(max(1, len(s) - 20))
            x = list(s[a : a + r.randint(20, 140)])
            for i in range(len(x)):
                if r.random() < 0.01:
                    x[i] = r.choice("ACGTN")
            texts.append("".join(x) if r.random() < 0.5 else back("".join(x)))
    n = spark.createDataFrame([(i + 1, s) for i, s in enumerate(seqs)], "node_id long, seq string")
    return n, spark.createDataFrame([("a" if i % 2 else "b", i // 2, s) for i, s in enumerate([*texts, None, "T" * 100])], "store string, read_id long, seq string")


@pytest.mark.parametrize("k", [3, 15, 31])
@pytest.mark.parametrize("limit", [2, 4, 1 << 20])
def test_same_seeds_as_by_the_join(spark, k, limit):
    n, r = _made(spark)
    want = K.seed_matches(r, K.frequency_index(n, k, limit), n, k)
    got = S.frequency_seeds(r, n, k, limit)
    assert got.columns == want.columns
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect())) and (got.count() > 0 or k == 3)


def test_far_fewer_rows_are_shuffled(spark, data):
    n, r = nodes(spark, data), reads(spark, data)
    seeds = S.frequency_seeds(r, n, 31, 200).count()
    assert S.seed_runs(r, n, 31, 200).count() < seeds / 4
    assert S.stretches(r, 31, ["store", "read_id"]).count() < S.stretches(r, 31, ["store", "read_id"]).selectExpr("sum(run)").first()[0] / 5


#: Queries on seeds, which joined them k-mer by k-mer.
QUERIES = [
    "best_nodes",
    "turnarounds_truncated",
    "shadowed_filter",
    "paired_linkage",
    "long10x_multilinkage",
    "size_id_filter",
    "perfect_mappings",
    "recruit_reads",
    "sandwiches_cleaned",
    "read_mappings",
    "reads_pathed_extended",
]


@pytest.mark.parametrize("name", QUERIES)
def test_kmers_are_not_joined_one_by_one(spark, data, name, monkeypatch):
    seen = []
    write = Classic.write
    monkeypatch.setattr(Classic, "write", property(lambda self: (seen.append(self), write.fget(self))[1]))
    seen.append(entry.queries()[name](spark, data))
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in seen]
    assert any("head#" in p for p in plans) and not any(re.search(r"Join \[code#", p) for p in plans)
