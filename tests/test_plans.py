"""Plans: rows that a kernel or an explode multiplies are never gathered for a broadcast."""

import re

import pytest
from pyspark.sql import DataFrame
from pyspark.sql.classic.dataframe import DataFrame as Classic

import __spark_entry__ as entry
from strandloom.operators.linkage import haplotype_scores, tag_node_reads
from strandloom.operators.mapping import drop_shadowed

#: Queries that failed by the driver's memory, as the planner took their k-mers, or places near ends, for a few rows.
QUERIES = ["kmer_freq_filtered_index", "kci_upper_median", "count_pattern", "read_mappings", "candidate_counts", "anchor_links", "size_id_filter", "perfect_mappings", "recruit_reads", "sandwiches_cleaned", "turnarounds_truncated", "exact_end_overlaps", "paired_linkage", "best_nodes", "shadowed_filter", "long10x_multilinkage", "reads_pathed_extended", "stats_by_kci"]


def multiplied(plan: str) -> list[str]:
    """Lines of kernels and explodes that stand below a broadcast, with no join between, as a join is sized by the product of its sides."""
    found, above = [], []
    for line in plan.splitlines():
        depth = len(re.match(r"[\s:|+-]*", line).group())
        while above and above[-1][0] >= depth:
            above.pop()
        if re.search(r"MapInArrow|Generate explode\((sequence|filter)", line):
            nearest = next((x for _, x in reversed(above) if "BroadcastExchange" in x or "Join" in x), "")
            if "BroadcastExchange" in nearest:
                found.append(line)
        above.append((depth, line))
    return found


@pytest.mark.parametrize("name", QUERIES)
def test_multiplied_rows_are_not_broadcast(spark, data, name, monkeypatch):
    seen: list[DataFrame] = []
    write = Classic.write
    monkeypatch.setattr(Classic, "write", property(lambda self: (seen.append(self), write.fget(self))[1]))
    seen.append(entry.queries()[name](spark, data))
    assert [x for df in seen for x in multiplied(df._jdf.queryExecution().executedPlan().toString())] == []


def planned(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_blocks_of_a_small_file_are_not_broadcast(spark):
    blocks = spark.createDataFrame([("a", 1, 7, 0, 90, 5), ("a", 1, 8, 10, 80, 3), ("b", 1, 8, 10, 80, 3)], "store string, read_id long, node long, q_start int, q_end int, score long")
    got = drop_shadowed(blocks)
    assert sorted((x.store, x.node) for x in got.collect()) == [("a", 7), ("b", 8)] and "Broadcast" not in planned(got)


def test_nodes_and_tags_of_reads_are_not_broadcast(spark):
    paths = spark.createDataFrame([("a", 1, [5, -6, 5]), ("a", 2, [6]), ("b", 1, [5])], "store string, read_id long, path array<bigint>")
    got = tag_node_reads(paths, spark.createDataFrame([("a", 1, 9), ("a", 2, 9), ("b", 1, 0)], "store string, read_id long, tag long"))
    assert sorted(map(tuple, got.collect())) == [(9, 5, 1), (9, 6, 2)] and "Broadcast" not in planned(got)


def test_neighbours_by_tags_are_not_broadcast(spark):
    hits = spark.createDataFrame([("a", 1, 5, 2), ("a", 1, 6, 3)], "store string, read_id long, node long, hits long")
    got = haplotype_scores(hits, spark.createDataFrame([(5, 5, 1.0), (5, 6, 0.5), (6, 6, 1.0)], "node long, other long, score double"))
    assert sorted((x.node, x.score, x.best) for x in got.collect()) == [(5, 3.5, True), (6, 3.0, False)]
    assert re.search(r"\w+Join\b", planned(got)).group() == "SortMergeJoin"  # the uppermost join
