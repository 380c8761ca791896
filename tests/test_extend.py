"""Extension of seeds, checked on a genome with a branch."""

import random

from pyspark.sql import functions as F

from strandloom.operators import contig as C
from strandloom.operators import extend as E
from strandloom.operators import kmer_counts as K
from strandloom.operators import traversal as T
from strandloom.operators.graph import Graph

RC = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s[::-1].translate(RC)


def test_reads_are_pathed(spark):
    r = random.Random(5)
    dna = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    left, a, b, right = dna(60), dna(30), dna(25), dna(60)
    ways = [left + a + right, left + b + right]
    k = 15
    graph = C.de_bruijn(K.count_kmers(spark.createDataFrame([(w,) for w in ways], "seq string"), k).select("code"), k)
    nodes = {x.node_id: x.seq for x in graph.nodes.collect()}
    assert len(nodes) == 4
    reads = [(1, ways[0][20:130]), (2, ways[1][10:140]), (3, rc(ways[0][20:130])), (4, left[5:40]), (5, dna(40)), (6, ways[0][20:40] + "T" * 5 + right[10:50])]
    rd = spark.createDataFrame(reads, "read_id long, seq string")
    seeds = K.seed_matches(rd, K.unique_index(graph.nodes, k), graph.nodes, k)
    got = {x.read_id: (x.path_offset, x.path) for x in E.path_reads_extended(seeds, rd, graph, k).collect()}
    spell = lambda p: [nodes[abs(n)] if n > 0 else rc(nodes[abs(n)]) for n in p]

    def text(p):
        parts = spell(p)
        out = parts[0]
        for x in parts[1:]:
            assert out.endswith(x[: k - 1])
            out += x[k - 1 :]
        return out

    for i in (1, 2, 3, 4):
        off, path = got[i]
        assert text(path)[-off:].startswith(reads[i - 1][1]) if off <= 0 else False
    assert len(got[1][1]) == 3 and got[3][1] == [-x for x in reversed(got[1][1])] and 5 not in got
    assert len(got[6][1]) == 2
    # the part between is bridged where there is one way only
    gone = spark.createDataFrame([(1, [got[1][1][0], got[1][1][2]]), (2, [got[4][1][0], 0]), (3, [got[1][1][0]])], "read_id long, path array<bigint>")
    bridged = {x.read_id: x.path for x in E.bridge_paths(gone, graph, 2, 500).collect()}
    assert bridged[1] == [got[1][1][0], 0, got[1][1][2]] and bridged[2] == [got[4][1][0], 0] and bridged[3] == [got[1][1][0]]
    cut = Graph(graph.nodes.where(F.col("node_id") != abs(got[2][1][1])), graph.remove_nodes(spark.createDataFrame([(abs(got[2][1][1]),)], "node_id long")).links)
    assert {x.read_id: x.path for x in E.bridge_paths(gone, cut, 2, 500).collect()}[1] == got[1][1]
    local = E.local_assembly(spark.createDataFrame([(1, left), (2, left), (3, dna(50))], "read_id long, seq string"), spark.createDataFrame([(left[:20],)], "seq string"), 15)
    assert {x.seq for x in local.nodes.collect()} == {min(left, rc(left))}


def test_match_lists(spark):
    m = spark.createDataFrame([(1, n, 0, 10 * i, 5) for i, n in enumerate([3, 4, -3, 5])] + [(2, 4, 0, 0, 5)], "read_id long, node long, node_position int, read_position int, size int")
    assert [(r.read_id, r.node) for r in E.truncate_turnarounds(m).orderBy("read_id", "read_position").collect()] == [(1, 3), (1, 4), (2, 4)]
    assert {(r.read_id, r.node) for r in E.matches_from_node(m, 4).collect()} == {(1, 4), (1, -3), (1, 5), (2, 4)}


def test_popular_and_groups(spark):
    rows = [(t, i, n, 0, 1) for t, ns in ((1, [1, 2, 3]), (2, [1, 2, 3]), (3, [-3, -2, -1]), (4, [1, 9, 2])) for i, n in enumerate(ns)]
    t = spark.createDataFrame(rows, "thread_id long, idx int, node long, start_pos int, end_pos int")
    best = E.popular_next(t, 0.5, 0.5)
    assert {(r.node, r.other) for r in best.collect()} >= {(1, 2), (2, 3), (-3, -2), (-2, -1)}
    g = E.group_nodes(spark.createDataFrame([(i,) for i in (1, 2, 3, 9)], "node_id long"), best.where("abs(other) <> 9 and abs(node) <> 9"))
    assert [(r.place, r.node) for r in g.where("line = 1").orderBy("place").collect()] == [(0, 1), (1, 2), (2, 3)]


def test_end_to_end(spark):
    nodes = spark.range(1, 6).selectExpr("id node_id", "'ACGT' seq")
    links = spark.createDataFrame([(-1, 2, 0), (-2, 3, 0)], "source long, dest long, dist int")
    t = T.tangles(nodes, links, spark.createDataFrame([(1,), (3,)], "node_id long"))
    walks = spark.createDataFrame([(1, [2, 3]), (-3, [-2, -1])], "node long, path array<bigint>")
    assert {(r.from_node, r.to_node, tuple(r.path)) for r in E.end_to_end(t, walks).collect()} == {(1, 3, (2,)), (-3, -1, (-2,))}
