"""Hand-checkable fixtures of the scalar functions, counters and graph operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import seq as S
from strandloom.functions.kmers import canonical, clean_kmer, pack, rc, unpack
from strandloom.operators import contig as C
from strandloom.operators import graph as G
from strandloom.operators import kmer_counts as K
from strandloom.operators import mapping as M
from strandloom.operators import partition as P
from strandloom.operators import threads as R
from strandloom.operators import traversal as T


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("r")).first().r


def test_scalars(spark):
    assert one(spark, rc, "AcgTN") == "NAcgT"
    assert one(spark, canonical, "TTTT") == "AAAA"
    assert one(spark, S.is_canonical, "ACGT") and not one(spark, S.path_is_canonical, "ACGT")
    assert one(spark, lambda c: unpack(pack(c), 5), "GATTC") == "GATTC"
    assert one(spark, clean_kmer, " \t" + "t" * 31 + "\r") == "A" * 31
    assert one(spark, clean_kmer, "A" * 30 + "N") is None and one(spark, clean_kmer, None) is None and one(spark, clean_kmer, "A" * 31 + "\n") is None
    assert one(spark, lambda c: S.compress_homopolymers(c, 2), "AAAACCGGG") == "AACCGG"
    assert one(spark, S.reverse_path, [1, -2, 3], "array<bigint>") == [-3, 2, -1]
    assert one(spark, lambda c: S.vec_slice(c, 1, -1), [1, 2, 3, 4], "array<bigint>") == [2]
    assert one(spark, S.kmer_fw_neighbours, "ACG") == ["CGA", "CGC", "CGG", "CGT"]
    assert one(spark, S.kmer_bw_neighbours, "ACG") == ["AAC", "CAC", "GAC", "TAC"]
    assert one(spark, S.seq_to_tag, "A" * 15 + "C") == 1 and one(spark, S.seq_to_tag, "N" * 16) == 0
    assert one(spark, S.tag_to_seq, 1, "long") == "A" * 15 + "C"
    assert one(spark, S.ilog2, 1025, "long") == 10


def test_kmers_and_counts(spark):
    t = spark.createDataFrame([(1, "ACGTNACGGT"), (2, None), (3, ""), (4, "acg")], "id long, seq string")
    got = [(r.pos, r.k, r.is_fw) for r in S.kmers(t.where("id = 1"), 4, ["id"]).select("pos", unpack(F.col("code"), 4).alias("k"), "is_fw").orderBy("pos").collect()]
    assert got == [(0, "ACGT", True), (5, "ACGG", True), (6, "ACCG", False)]
    assert S.kmers(t, 3, ["id"]).where("id = 4").count() == 1
    n = K.counts_from(spark.createDataFrame([("AACC",), ("GGTT",)], "seq string"), 4, 2).select(unpack(F.col("code"), 4), "n").collect()
    assert [tuple(r) for r in n] == [("AACC", 2)]
    nodes = spark.createDataFrame([(1, "ACGTACGGATTTCC")], "node_id long, seq string")
    graph = K.count_kmers(nodes, 4)
    kci = K.kci(nodes, "node_id", graph, graph, 1.0, 4).first()
    assert kci.kci in (-1.0, 1.0)
    with pytest.raises(ValueError):
        S.kmers(t, 32, [])


def test_bloom_never_misses():
    b = S.Bloom(1 << 12)
    xs = np.arange(0, 5000, 7)
    b.add(xs)
    assert b.contains(xs).all() and 0 < b.false_positive_rate() < 1


@pytest.fixture(scope="module")
def bubble(spark):
    nodes = spark.createDataFrame([(i, "ACGTTGCA") for i in (1, 2, 3, 4)], "node_id long, seq string")
    links = spark.createDataFrame([(-1, 2, 0), (-1, 3, 0), (-2, 4, 0), (-3, 4, 0)], "source long, dest long, dist int")
    return G.Graph(nodes, links)


def test_lines_keep_one_state(spark, monkeypatch):
    """Of the rounds over a long chain only the last state stays on disk."""
    gone = []
    discard = T.discard
    monkeypatch.setattr(T, "discard", lambda t: (gone.append(t), discard(t))[1])
    n = 20
    nodes = spark.createDataFrame([(i, "ACGT") for i in range(1, n + 1)], "node_id long, seq string")
    links = spark.createDataFrame([(-i, i + 1, -3) for i in range(1, n)], "source long, dest long, dist int")
    assert [r.node for r in T.lines(nodes, links).orderBy("place").collect()] == list(range(1, n + 1))
    assert len(gone) >= 5


def test_bubble_counts_links(spark, bubble):
    """A side linked twice with the same neighbour has no single next node, and what enters there are three links."""
    twice = bubble.add_links(spark.createDataFrame([(-2, 4, 7)], "source long, dest long, dist int"))
    assert G.bubble_sides(twice.nodes, twice.links).isEmpty()


def test_bubble_and_tangle(spark, bubble):
    assert {r.node_id for r in G.bubble_sides(bubble.nodes, bubble.links).collect()} == {2, 3}
    t = T.tangles(bubble.nodes, bubble.links, spark.createDataFrame([(1,), (4,)], "node_id long"))
    assert {tuple(r) for r in t.collect()} == {(2, "internal", 2), (2, "internal", 3), (2, "frontier", -1), (2, "frontier", 4)}
    assert T.classify_tangles(bubble.nodes, bubble.links, t).first()["class"] == "bubble"


def test_chain(spark):
    nodes = spark.createDataFrame([(1, "AAACG"), (2, "ACGTT"), (3, "GTTCA")], "node_id long, seq string")
    links = spark.createDataFrame([(-1, 2, -3), (-2, 3, -3)], "source long, dest long, dist int")
    lines = T.lines(nodes, links)
    assert [tuple(r) for r in lines.orderBy("place").collect()] == [(1, 0, 1), (1, 1, 2), (1, 2, 3)]
    assert T.path_sequences(lines.withColumnRenamed("line", "path_id"), nodes, links, strict=True).first().seq == "AAACGTTCA"
    assert G.mirrored(links).count() == 4 and G.is_sane(G.mirrored(links)).count() == 0
    joined, named = T.join_unitigs(G.Graph(nodes, links))
    assert [r.seq for r in joined.nodes.collect()] == ["AAACGTTCA"] and joined.links.count() == 0


def test_closed_line(spark):
    nodes = spark.createDataFrame([(i, "AC") for i in (5, 6, 7)], "node_id long, seq string")
    links = spark.createDataFrame([(-6, 7, 0), (-7, 5, 0), (-5, 6, 0)], "source long, dest long, dist int")
    assert [tuple(r) for r in T.lines(nodes, links).orderBy("place").collect()] == [(5, 0, 5), (5, 1, 6), (5, 2, 7)]


def test_tip_repeat_medians(spark):
    nodes = spark.range(1, 6).selectExpr("id node_id", "'ACGT' seq")
    tip = spark.createDataFrame([(-1, 2, 0), (-1, 3, 0), (-2, 4, 0)], "source long, dest long, dist int")
    assert {r.node_id for r in G.tips(nodes, tip).collect()} == {3}
    rep = spark.createDataFrame([(-1, 5, 0), (-2, 5, 0), (-5, 3, 0), (-5, 4, 0)], "source long, dest long, dist int")
    assert [tuple(r) for r in G.canonical_repeats(nodes, rep).collect()] == [(5, 2)]
    votes = spark.createDataFrame([(5, 1, 3, 10), (5, 2, 4, 10), (5, 1, 4, 1)], "node long, prev long, next long, votes long")
    solved = C.solve_repeats(votes, G.canonical_repeats(nodes, rep), 4, 1, 10)
    assert {(r.prev, r.next) for r in solved.collect()} == {(1, 3), (2, 4)}
    g = C.expand_repeats(G.Graph(nodes, rep), solved)
    assert {tuple(r) for r in G.mirrored(g.links).select("source", "dest").collect()} == {(-1, 6), (6, -1), (-6, 3), (3, -6), (-2, 7), (7, -2), (-7, 4), (4, -7)}
    many = spark.createDataFrame([(-1, 2, x) for x in (10, 20, 31)] + [(-1, 3, x) for x in (5, 8)] + [(-4, 5, x) for x in (-5, -8)], "source long, dest long, dist int")
    got = {(r.node, r.other): r.dist for r in G.fw_neighbours_by_distance(many, 2).where("node > 0").collect()}
    assert got == {(1, 3): 6, (1, 2): 20, (4, 5): -6}


def test_nstats(spark):
    t = spark.createDataFrame([(x,) for x in (10, 8, 6, 4, 2)], "size int")
    assert {r.point: r.nsize for r in G.nstats(t).collect()} == {25: 10, 50: 8, 75: 6}


@pytest.fixture(scope="module")
def threads(spark):
    rows = []
    for tid, nodes in ((1, [1, 2, 3, 4]), (2, [1, 2, 3]), (3, [-3, -2]), (4, [1, 5, 1, 2])):
        rows += [(tid, i, n, 10 * i, 10 * i + 8) for i, n in enumerate(nodes)]
    return spark.createDataFrame(rows, "thread_id long, idx int, node long, start_pos int, end_pos int")


def test_threads(spark, threads):
    kept = R.drop_repeated(threads)
    assert [r.node for r in kept.where("thread_id = 4").orderBy("idx").collect()] == [5, 2]
    assert {r.thread_id for r in R.node_threads(kept, True).where("node = 2").collect()} == {1, 2, -3, 4}
    shared = {(r.node, r.other): r.shared_threads for r in R.node_thread_neighbours(kept).collect()}
    assert shared[(1, 3)] == 2 and shared[(2, 2)] == 4
    ahead = {(r.thread_id, r.node) for r in R.nodes_after(threads, 2).collect()}
    assert ahead == {(1, 3), (1, 4), (2, 3), (3, 3)}


def test_overlap_classes(spark):
    def walk(tid, nodes):
        return [(tid, i, n, 10 * i, 10 * i + 8) for i, n in enumerate(nodes)]

    rows = walk(1, range(1, 31)) + walk(2, range(17, 51)) + walk(3, [-x for x in range(50, 16, -1)]) + walk(4, [100 + x for x in range(12)] + list(range(10, 20)) + [200 + x for x in range(12)])
    t = spark.createDataFrame(rows, "thread_id long, idx int, node long, start_pos int, end_pos int")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "t1 long, t2 long")
    got = {r.t2: r["class"] for r in R.overlap_class(t, pairs).collect()}
    assert got[2] == "t1_t2" and got[3] == "t1_rt2" and got[4] in ("invalid", "t1_in_t2")


def test_tag_scores(spark):
    from strandloom.operators.linkage import tag_neighbours

    t = spark.createDataFrame([(1, 1, 3), (1, 2, 1), (2, 1, 1), (2, 3, 2)], "tag long, node long, reads long")
    got = {(r.node, r.other): r.score for r in tag_neighbours(t, 0.0).collect()}
    assert got == {(1, 1): 1.0, (1, 2): 0.75, (1, 3): 0.25, (2, 1): 1.0, (2, 2): 1.0, (3, 1): 1.0, (3, 3): 1.0}


def test_blocks_and_shadows(spark):
    m = spark.createDataFrame([(1, n, 10 * i, 10 * i, 5) for i, n in enumerate([7, 7, 8, 7, 9])], "read_id long, node long, node_position int, read_position int, size int")
    assert {(r.node, r["first"], r["last"]) for r in M.valid_blocks(m, 1).collect()} == {(8, 2, 2), (9, 4, 4)}
    b = spark.createDataFrame([(1, 1, 0, 100, 0, 100, 50), (1, 2, 10, 50, 0, 40, 20), (1, 3, 10, 50, 0, 40, 50)], "read_id long, node long, q_start int, q_end int, n_start int, n_end int, score long")
    assert {r.node for r in M.drop_shadowed(b).collect()} == {1, 3}
    s = spark.createDataFrame([(1, 4, 0, 0, 9), (1, 6, 0, 9, 9), (1, 4, 30, 18, 9)], "read_id long, node long, node_position int, read_position int, size int")
    assert {r.node for r in M.clean_sandwiches(s).collect()} == {4}


def test_queue_and_construction(spark):
    ops = spark.createDataFrame([(1, "node_expansion", 5), (1, "node_expansion", -5), (2, "path_detachment", -5), (3, "path_detachment", 9), (4, "node_deletion", 5)], "op_id long, kind string, item long")
    assert {r.op_id for r in C.accepted_edits(ops).collect()} == {1, 3, 4}
    seq = "ACGGTCATTCGGA"
    g = C.de_bruijn(K.count_kmers(spark.createDataFrame([(seq,)], "seq string"), 5).select("code"), 5)
    assert {r.seq for r in g.nodes.collect()} == {min(seq, seq[::-1].translate(str.maketrans("ACGT", "TGCA")))}


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in T.components(e, spark.createDataFrame([(i,) for i in (*range(1, 61), 100, 101, 500)], "id long")).collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and got[101] == 100 and got[500] == 500


def test_transitive_and_order(spark):
    l_ = spark.createDataFrame([(-1, 2, 0), (-1, 3, 0), (-2, 3, 0)], "source long, dest long, dist int")
    assert {tuple(r) for r in G.transitive_links(l_, 2).collect()} == {(1, 3), (-3, -1)}
    coords = spark.createDataFrame([(1, 4, 50), (1, -2, 10)], "order_id long, node long, coord long")
    assert {(r.node, r.pos) for r in P.local_order(coords).collect()} == {(2, -1), (4, 2)}


def test_common_elements_and_medians(spark):
    from strandloom.functions import seq as S

    df = spark.createDataFrame([([1, 2, 2, 3], [2, 3, 3, 9])], "a array<int>, b array<int>")
    assert df.select(S.intersection_size(F.col("a"), F.col("b")).alias("n")).first().n == 2
    rows = [(1, v) for v in (5, 1, 9, 2)] + [(2, v) for v in (7, 7, 8)] + [(3, -3), (3, -4), (3, None), (4, None)]
    t = spark.createDataFrame(rows, "k int, v int")
    assert {r.k: (r.m, r.n) for r in S.upper_medians(t, ["k"], "v", "m", "n").collect()} == {1: (5, 4), 2: (7, 3), 3: (-3, 2)}
    assert {r.k: (r.m, r.n) for r in S.trunc_medians(t, ["k"], "v", "m", "n").collect()} == {1: (3, 4), 2: (7, 3), 3: (-3, 2)}
