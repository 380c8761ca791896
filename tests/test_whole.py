"""Queries over the whole tables: hot nodes and rows that an earlier version left out are in the results."""

import random
from collections import Counter

import pytest

from strandloom.operators import extend as E
from strandloom.operators.graph import Graph
from strandloom.plans import graph_queries as GQ
from strandloom.plans import kmer_queries as KQ
from strandloom.plans import mapping_queries as MQ
from tests.oracle import compare, connect

@pytest.fixture(scope="module")
def con(data):
    return connect(data)


def test_thin_links_of_hot_nodes(spark, data):
    assert GQ.thin_links(spark, data).where("abs(source) <= 12 or abs(dest) <= 12").count() > 0


@pytest.mark.parametrize("name", ["thin graph", "fw_reached_r3", "all_paths_fw"])
def test_sql_holds_hot_nodes(name):
    """The SQL that queries are compared with leaves no node out by its id."""
    sql = {"thin graph": GQ.TH, "fw_reached_r3": GQ.SQL["fw_reached_r3"], "all_paths_fw": MQ.SQL["all_paths_fw"]}[name]
    assert "> 12" not in sql and "> 1000" not in sql


def test_all_paths_fw_of_hot_nodes(spark, data):
    hot = {r.node_id for r in spark.read.parquet(f"{data}/repeat_nodes.parquet").collect()}
    assert hot & {abs(r.node) for r in MQ.Q["all_paths_fw"](spark, data).collect()}


def test_seeds_keep_kmers_of_more_than_three_places(spark, monkeypatch):
    nodes = spark.createDataFrame([(i, "ACGTTGCAAGGCTTAACCGGATATCCTGAGG" + "A" * i) for i in range(1, 7)], "node_id long, seq string")
    reads = spark.createDataFrame([("s", "long", 1, "ACGTTGCAAGGCTTAACCGGATATCCTGAGG", 0)], "store string, kind string, read_id long, seq string, tag long")
    for m in (KQ, MQ):
        monkeypatch.setattr(m, "nodes", lambda *_: nodes)
        monkeypatch.setattr(m, "reads", lambda *_: reads)
    assert MQ.seeds(spark, "").count() == KQ.seed_matches(spark, "").count() == 6


def test_homopolymers_of_reads_with_other_letters(spark, data):
    def cut(s):
        return "".join(c for i, c in enumerate(s) if i < 2 or s[i - 2 : i] != c * 2)

    reads = KQ.reads(spark, data)
    want = Counter((r.store, r.read_id, cut(r.seq)) for r in reads.collect())
    got = Counter((r.store, r.read_id, r.seq) for r in KQ.homopolymers_compressed(spark, data).collect())
    assert got == want and any(set(s) - set("ACGT") for _, _, s in got)


def _extended(spark, nodes, links, read, seeds, k=15):
    g = Graph(spark.createDataFrame(nodes, "node_id long, seq string"), spark.createDataFrame(links, "source long, dest long, dist int"))
    seeds = spark.createDataFrame(seeds, "read_id long, read_pos int, node long, node_pos int")
    return [x.path for x in E.path_reads_extended(seeds, spark.createDataFrame([(1, read)], "read_id long, seq string"), g, k).collect()]


def _dna(n):
    r = random.Random(3)
    return "".join(r.choice("ACGT") for _ in range(n))


def test_extension_goes_on_after_many_breaks(spark):
    read = _dna(17 * 20)
    nodes = [(i + 1, read[20 * i : 20 * i + 20]) for i in range(17)]
    assert _extended(spark, nodes, [], read, [(1, 20 * i, i + 1, 0) for i in range(17)]) == [list(range(1, 18))]
