"""Repeats, edits, patches, anchors and lines on small planted graphs, against brute force."""

import random

import pytest

from strandloom.operators import contig as C
from strandloom.operators import graph as G
from strandloom.operators import linkage as L
from strandloom.operators import mapping as M
from strandloom.operators import partition as P
from strandloom.operators import threads as R
from strandloom.operators import traversal as T

THREADS = "thread_id long, idx int, node long, start_pos int, end_pos int"


def dna(r, n):
    return "".join(r.choice("ACGT") for _ in range(n))


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def graph(spark, nodes, links):
    return G.Graph(spark.createDataFrame(nodes, "node_id long, seq string"), spark.createDataFrame(links, "source long, dest long, dist int"))


@pytest.fixture(scope="module")
def repeat(spark):
    """Nodes 1 and 2 lead into the repeat 3, which leads to 4 and 5; 1 goes on to 4 and 2 to 5. Node 6 is linked with 5."""
    r = random.Random(1)
    mid = dna(r, 40)
    seqs = [dna(r, 30) + mid[:10], dna(r, 30) + mid[:10], mid, mid[-10:] + dna(r, 30), mid[-10:] + dna(r, 30), dna(r, 50)]
    return graph(spark, [(i + 1, s) for i, s in enumerate(seqs)], [(-1, 3, -10), (-2, 3, -10), (-3, 4, -10), (-3, 5, -10), (-5, 6, 3)])


def ways(df):
    return sorted((x.node, x.prev, x.next) for x in df.collect())


def test_repeats_are_found_and_solved(spark, repeat):
    reps = G.canonical_repeats(repeat.nodes, repeat.links)
    assert [tuple(x) for x in reps.collect()] == [(3, 2)]
    paths = spark.createDataFrame([("s", i, p) for i, p in enumerate([[1, 3, 4]] * 3 + [[-5, -3, -2]] * 4 + [[1, 3, 5]])], "store string, read_id long, path array<bigint>")
    solved = C.solve_repeats(C.path_triples(paths), reps, 2, 3, 2.0)
    assert ways(solved) == [(3, 1, 4), (3, 2, 5)]
    assert ways(C.solve_repeats(C.path_triples(paths), reps, 4, 3, 2.0)) == []
    out = C.expand_repeats(repeat, solved)
    assert out.nodes.count() == 7 and {abs(x.node) for x in G.ends(out.links).where("next_count > 1").collect()} == set()
    sizes = {len(x.seq) for x in T.join_unitigs(out)[0].nodes.collect()}
    assert sizes == {40 + 40 + 40 - 20, 40 + 40 + 40 - 20 + 3 + 50}


def test_repeats_solved_by_pairs(spark, repeat):
    reps = G.canonical_repeats(repeat.nodes, repeat.links)
    rows = []
    for i, (a, b) in enumerate([(1, -4)] * 3 + [(-5, 2)] * 3 + [(1, -5)]):
        rows += [("s", 2 * i + 1, [a]), ("s", 2 * i + 2, [b])]
    rows += [("t", 1, [1, 3]), ("t", 2, [-2])]  # equal ids of another store are another pair
    paths = spark.createDataFrame(rows, "store string, read_id long, path array<bigint>")
    votes = C.paired_votes(repeat.links, reps, paths)
    assert sorted((x.prev, x.next, x.votes) for x in votes.collect()) == [(1, 4, 3), (1, 5, 1), (2, 5, 3)]
    assert ways(C.clear_ways(votes, reps, 2, 1, 2.0)) == [(3, 1, 4), (3, 2, 5)]
    assert ways(C.clear_ways(votes, reps, 2, 0, 2.0)) == [] and ways(C.clear_ways(votes, reps, 4, 1, 2.0)) == []


def test_repeats_solved_by_threads(spark, repeat):
    reps = G.canonical_repeats(repeat.nodes, repeat.links)
    walks = [[1, 3, 4], [1, 4], [-4, -3, -1], [2, 3, 5, 6], [-6, -5, -2], [2, 6], [1]]
    t = spark.createDataFrame([(k, i, n, 10 * i, 10 * i + 9) for k, w in enumerate(walks) for i, n in enumerate(w)], THREADS)
    votes = {(x.prev, x.next): x.votes for x in C.thread_votes(repeat.links, reps, t).collect()}
    assert votes == {(1, 4): 3, (2, 5): 2, (2, 0): 1}
    kci = lambda v: spark.createDataFrame([(i, v if i == 4 else 1.0) for i in range(1, 7)], "node_id long, kci double")
    assert ways(C.solve_repeats_by_threads(repeat.links, reps, t, kci(1.0), 1.5, 1, 2.0)) == [(3, 1, 4), (3, 2, 5)]
    for bad in (-1.0, 2.0):
        assert ways(C.solve_repeats_by_threads(repeat.links, reps, t, kci(bad), 1.5, 1, 2.0)) == []


def in_order(ops):
    taken, out = set(), set()
    for op in sorted({o for o, _, _ in ops}):
        items = {i for o, _, i in ops if o == op}
        if next(k for o, k, _ in ops if o == op).endswith("deletion") or not items & taken:
            out.add(op)
            taken |= items
    return out


def test_edits_are_accepted_in_order(spark):
    r = random.Random(2)
    chain = [(i, "path", x) for i in range(140) for x in (1000 + i, 1001 + i)]
    hot = [(500 + i, "path", 7) for i in range(60)] + [(500 + i, "path", 9000 + i) for i in range(60)]
    mess = [(2000 + i, r.choice(["path", "node_expansion", "node_deletion"]), -5 - r.randrange(60)) for i in range(80) for _ in range(2)]
    kinds = {}
    ops = chain + hot + [(o, kinds.setdefault(o, k), x) for o, k, x in mess]
    df = spark.createDataFrame(ops + ops[:9], "op_id long, kind string, item long").repartition(3)
    want = in_order(ops)
    assert {x.op_id for x in C.accepted_edits(df).collect()} == want
    few = spark.createDataFrame([o for o in ops if o[0] < 12 or 500 <= o[0] < 560], "op_id long, kind string, item long")
    assert {x.op_id for x in C.accepted_edits(few, local_rows=0).collect()} == {o for o in want if o < 12 or 500 <= o < 560}


def test_edits_are_applied(spark, repeat):
    w = spark.createDataFrame([(5, 3, 1, 4), (5, 3, 2, 5)], "op_id long, node long, prev long, next long")
    nodes = spark.createDataFrame([(7, 6)], "op_id long, node_id long")
    links = spark.createDataFrame([(8, -3, 5)], "op_id long, source long, dest long")
    assert {x.op_id for x in C.accepted_edits(C.expansion_items(w).unionByName(C.deletion_items(nodes, repeat.links))).collect()} == {5, 7}
    out = C.apply_edits(repeat, w, links, nodes, spark.createDataFrame([(5,), (7,)], "op_id long"))
    assert {x.node_id for x in out.nodes.collect()} == {1, 2, 4, 5, 7, 8} and out.links.count() == 4


def test_extend_to_repeats(spark):
    """Two nodes end in shared letters (3), which lead to one node (4): the shared part is split."""
    g = graph(spark, [(1, "A" * 30), (2, "C" * 30), (3, "G" * 9), (4, "T" * 30)], [(-1, 3, 0), (-2, 3, 0), (-3, 4, 0)])
    assert ways(C.ways_to_repeats(g, 10)) == [(3, 1, 4), (3, 2, 4)] and ways(C.ways_to_repeats(g, 8)) == []
    # both ways go through the same end of node 4, so one expansion holds them
    out = C.extend_to_repeats(g, 10)
    assert sorted(len(x.seq) for x in out.nodes.collect()) == [9, 9, 30, 30, 30]


def test_tips_are_reconnected_and_patched(spark):
    r = random.Random(3)
    whole = dna(r, 200)
    a, b = whole[:110], rc(whole[80:])
    g = graph(spark, [(1, a), (2, b), (3, dna(r, 60)), (4, dna(r, 50))], [(-3, 1, 2), (-4, 2, 1)])
    paths = spark.createDataFrame([("s", 1, [3, 1]), ("s", 2, [4, 2]), ("s", 3, [1, -2]), ("s", 4, None), ("s", 5, [1]), ("s", 6, [2]), ("t", 7, [1, -2])], "store string, read_id long, path array<bigint>")
    # the pair that begins at node 3 enters at a free end before it leaves at one
    assert [tuple(x) for x in C.tip_connections(g, paths, 2).collect()] == [(1, -2, 3)]
    groups = C.reconnection_groups(g, paths, 1)
    assert sorted(x.node for x in groups.collect()) == [1, 2] and len({x.grp for x in groups.collect()}) == 1
    out, made = C.patch_groups(g, groups)
    assert [tuple(x) for x in made.select("a", "b", "overlap").collect()] == [(1, 2, 30)]
    assert {x.node_id: x.seq for x in out.nodes.collect()}[5] == whole
    assert sorted((x.source, x.dest, x.dist) for x in out.links.collect()) == [(-5, -4, 1), (-3, 5, 2)]


def test_anchor_borders(spark):
    #         dropped before (graph unique)   kept           dropped behind (no fall of coverage)
    rows = [(1, 1, 90), (1, 1, 5), (1, 1, 6), (1, 3, 12), (1, 1, 7), (1, 1, 7), (1, 2, 11), (1, 1, 8), (1, 2, 9)]
    t = spark.createDataFrame([(n, i, g, c) for i, (n, g, c) in enumerate(rows)], "node_id long, pos int, g long, n long")
    got = sorted(tuple(x) for x in C.anchor_runs(t, 2, 40).collect())
    assert got == [(1, 4, 5, 2)]
    assert sorted(tuple(x) for x in C.anchor_runs(t, 2, 40, 1).collect()) == [(1, 4, 4, 1), (1, 5, 5, 1)]
    nodes = spark.createDataFrame([(1, "ACGTTGCAAGGCTTAACC")], "node_id long, seq string")
    g, names = C.anchor_graph(nodes, C.anchor_runs(t, 2, 40, 1), 5)
    assert g.nodes.count() == 2 and [x.dist for x in g.links.collect()] == [1 - 5] and names.count() == 2


def test_paths_are_scored_and_lines_filled(spark):
    r = random.Random(4)
    a, b = dna(r, 60), dna(r, 60)
    noisy = a[:20] + "T" * 3 + a[20:]
    hits = C.path_hits(spark.createDataFrame([(1, "a", a), (1, "b", b)], "group_id int, path_id string, seq string"), spark.createDataFrame([(1, 9, noisy), (2, 9, a)], "group_id int, read_id long, seq string"), 11)
    n = {(x.path_id, x.read_id): x.hits for x in hits.collect()}

    def brute(path, read, k=11):
        last, delta, count = -1, None, 0
        for i in range(len(path) - k + 1):
            for j in range(len(read) - k + 1):
                if path[i : i + k] == read[j : j + k] and j > last and (delta is None or abs(delta - (i - j)) < 63):
                    last, delta, count = j, i - j, count + 1
                    break
        return count

    assert n == {("a", 9): brute(a, noisy)} and brute(a, noisy) == 40
    g = graph(spark, [(i, "A" * 10) for i in range(1, 6)], [(-1, 2, 0), (-1, 3, 0), (-2, 4, 0), (-3, 4, 0), (-4, 5, 0)])
    lines = spark.createDataFrame([(1, 0, 1), (1, 1, 4), (1, 2, 5), (2, 0, 5), (2, 1, 1)], "line long, place int, node long")
    filled = {x.line: x.path for x in C.fill_lines(g, lines, spark.createDataFrame([(-3, 40), (2, 30)], "node long, size int"), 3, 1000).collect()}
    assert filled == {1: [1, 3, 4, 5], 2: [5, 1]}


def test_orders_merge_and_mixed_ones_go(spark):
    walks = [list(range(i, i + 8)) for i in range(1, 40, 2)]
    t = spark.createDataFrame([(k, i, n, 10 * i, 10 * i + 9) for k, w in enumerate(walks) for i, n in enumerate(w)], THREADS)
    order = lambda o, ns, s=1: [(o, s * n, s * 10 * n) for n in ns]
    c = spark.createDataFrame(order(1, range(1, 25)) + order(2, range(12, 40), -1) + order(3, range(200, 230)), "order_id long, node long, coord long")
    merged = P.merge_orders(t, c, R.thread_links(t).select("source", "dest", "dist"), more_than=5, window=8).collect()
    assert {x.order_id for x in merged} == {1, 3} and {x.node for x in merged if x.order_id == 1} == set(range(1, 40))
    assert all(x.coord == 10 * x.node for x in merged if x.order_id == 1)
    mixed = P.mixed_orders(c, R.thread_links(t).select("source", "dest", "dist"), 8)
    assert [x.order_id for x in mixed.collect()] == [3] and P.remove_mixed(c, R.thread_links(t).select("source", "dest", "dist"), 8).select("order_id").distinct().count() == 2


def test_long_chain_of_threads_grows_to_its_end(spark):
    """39 overlapping threads: one more round for each, which nothing cuts off."""
    t = spark.createDataFrame([(k, i, 2 * k + i, 10 * i, 10 * i + 9) for k in range(12) for i in range(4)], THREADS)
    start = spark.createDataFrame([(1, 0, 0), (1, 1, 10)], "order_id long, node long, coord long")
    assert P.grow_orders(t, start, 1, 0.0).count() == 26


def test_classes_are_switched(spark):
    t = spark.createDataFrame([(k, i, n, 0, 1) for k, w in enumerate([[1, 2, 3], [3, -4], [5]]) for i, n in enumerate(w)], THREADS)
    nc = spark.createDataFrame([(n, 2 if n == 2 else 0) for n in range(1, 6)], "node long, class long")
    tc = P.reset_classes(t.selectExpr("thread_id").distinct())
    after, changed = P.switch_classes(nc, spark.createDataFrame([(2, 2), (3, 7), (99, 1)], "node long, class long"), "node")
    assert [x.node for x in changed.collect()] == [3] and {x.node: x["class"] for x in after.collect()}[3] == 7 and after.count() == 5
    assert sorted(x.thread_id for x in P.to_evaluate(t, changed).collect()) == [0, 1]
    assert P.class_of(nc, "node", 2) == 2 and P.class_of(nc, "node", 77) == -1
    nodes, threads, made = P.new_class_from_thread(t, nc, tc, 1)
    assert made == 3 and {x.node for x in nodes.where("class = 3").collect()} == {3, 4} and {x.thread_id for x in threads.where("class = 3").collect()} == {1}


def test_order_from_class(spark):
    walks = [[i, i + 1, i + 2, i + 3] for i in range(1, 8)] + [[-9, -8, -7, -6], [4, 5, 6, 7], [4, 5, 6], [3, 4, 5], [2, 3, 4]]
    t = spark.createDataFrame([(k + 1, i, n, 10 * i, 10 * i + 9) for k, w in enumerate(walks) for i, n in enumerate(w)], THREADS)
    nc = spark.createDataFrame([(n, 1) for n in range(1, 11)], "node long, class long")
    tc = spark.createDataFrame([(k + 1, 1) for k in range(len(walks))], "thread_id long, class long")
    got = {x.node: x.coord for x in P.order_from_class(t, nc, tc, 1).collect()}
    assert set(got) >= set(range(2, 10)) and sorted(got, key=got.get) == sorted(got)
    assert P.order_from_class(t, nc, tc, 2).count() == 0


def brute_best(seeds, hits, k, window=100, ratio=4):
    """M14 straight from its description."""
    half, band, out = window // 2, window // 10, []
    winners, w = {}, 0
    while w * half + window < hits:
        ms = sorted((n, p - q) for q, n, p in seeds if w * half <= q < w * half + window)
        bands = []
        for n, d in ms:
            if bands and bands[-1][0] == n and d - bands[-1][1] < band:
                bands[-1][2] += 1
            else:
                bands.append([n, d, 1])
        top = max((b[2] for b in bands), default=0)
        tops = [b for b in bands if b[2] == top]
        if len(tops) == 1 and top >= band:
            winners[w] = tops[0]
        w += 1
    for n in {b[0] for b in winners.values()}:
        groups = []
        for d in sorted(b[1] for b in winners.values() if b[0] == n):
            if groups and d - groups[-1][-1] < window:
                groups[-1].append(d)
            else:
                groups.append([d])
        for g in groups:
            held = sorted((q, p) for q, m, p in seeds if m == n and min(g) - window <= p - q <= max(g) + window)
            inside = range(held[0][0] // half + 1, held[-1][0] // half + 1)
            won = sum(w in winners and winners[w][0] == n for w in inside)
            lost = sum(w in winners and winners[w][0] != n for w in inside)
            if won > ratio * lost:
                out.append((n, held[0][0], held[-1][0], held[0][1], held[-1][1], len(held)))
    return sorted(out)


def test_reads_are_mapped_to_window_winners(spark):
    r = random.Random(6)
    rows, sizes, want = [], [], {}
    for read in range(4):
        seeds, at = [], 0
        for _ in range(3):
            n, p = r.choice([1, -2, 3]), r.randrange(50)
            for _ in range(r.randrange(200, 500)):
                at += 1
                p += r.choice([1, 1, 1, 2]) if r.random() < 0.2 else 1
                if r.random() < 0.7:
                    seeds.append((at, n, p))
                if r.random() < 0.1:
                    seeds.append((at, 4, r.randrange(400)))
        for store in "ab":
            rows += [(store, read, *s) for s in seeds]
            sizes.append((store, read, at + 40))
        want[read] = brute_best(seeds, at + 40 - 31 + 1, 31)
    got = M.best_nodes(spark.createDataFrame(rows, "store string, read_id long, read_pos int, node long, node_pos int"), spark.createDataFrame(sizes, "store string, read_id long, size int"), 31).collect()
    assert any(want.values())
    for store in "ab":
        for read, rows_ in want.items():
            assert sorted((x.node, x.q_start, x.q_end, x.n_start, x.n_end, x.score) for x in got if x.store == store and x.read_id == read) == rows_


def test_equal_read_ids_of_two_stores_stay_apart(spark):
    """What one store's reads give does not change when another store with the same ids joins."""
    one = [("a", 1, q, n, q + d) for q in range(40) for n, d in ((7, 3), (-8, 50))] + [("a", 2, q, 9, q) for q in range(30)]
    two = [("b", 1, q, 7, q + 90) for q in range(15)] + [("b", 2, q, -9, 200 - q) for q in range(20)]
    schema = "store string, read_id long, read_pos int, node long, node_pos int"
    size = spark.createDataFrame([(s, i, 100) for s in "ab" for i in (1, 2)], "store string, read_id long, size int")
    node_size = spark.createDataFrame([(n, 60) for n in (7, 8, 9)], "node_id long, size int")
    matches = lambda s: M.perfect_matches(s, 31, 35)
    blocks = lambda s: M.alignment_blocks(s, 31)
    for f in (
        matches, blocks, lambda s: M.offset_groups(blocks(s)), lambda s: M.drop_shadowed(blocks(s)), lambda s: M.candidate_counts(s), lambda s: M.path_reads(matches(s)), lambda s: M.valid_blocks(matches(s), 1), lambda s: M.simple_threads(matches(s), node_size, 1),
        lambda s: M.reverse_matches(matches(s), size), lambda s: M.recruited(matches(s), 35, 1), lambda s: M.clean_sandwiches(matches(s)), lambda s: L.mappings_multilinkage(blocks(s), node_size, size),
    ):
        alone, both = (f(spark.createDataFrame(rows, schema)).where("store = 'a'") for rows in (one, one + two))
        assert sorted(map(str, alone.collect())) == sorted(map(str, both.collect()))


def test_small_graph_operations(spark, repeat):
    g, given = repeat.add_nodes(spark.createDataFrame([("TTTTT",), ("ACCCC",)], "seq string"))
    assert {x.seq: x.node_id for x in given.collect()} == {"TTTTT": -7, "ACCCC": 8} and g.nodes.count() == 8
    assert sorted((x.source, x.dest) for x in repeat.disconnect(spark.createDataFrame([(-3,)], "node_id long")).links.collect()) == [(-5, 6)]
    n = {x.node: x.seq for x in G.node_sequence(repeat.nodes, spark.createDataFrame([(1,), (-1,)], "node long")).collect()}
    assert n[-1] == rc(n[1])
    assert G.node_view(repeat.nodes, repeat.links, -3).first().next_count == 2
    for bad in (0, 99):
        with pytest.raises(ValueError):
            G.node_view(repeat.nodes, repeat.links, bad)
    assert G.node_views(repeat.nodes, repeat.links.limit(0), include_disconnected=False).count() == 0
    tri = graph(spark, [(1, "A"), (2, "C"), (3, "G")], [(-1, 2, 0), (-2, 3, 0), (-1, 3, 0)])
    assert sorted((x.source, x.dest) for x in G.remove_transitive_links(tri, 2).links.collect()) == [(-2, 3), (-1, 2)]
    t = spark.createDataFrame([(1, 0, 5, 0, 1), (2, 0, 5, 0, 1)], THREADS)
    assert [x.thread_id for x in R.remove_threads(t, spark.createDataFrame([(-1,), (9,)], "thread_id long")).collect()] == [2]
    tags = spark.createDataFrame([(1, 7), (1, 8), (1, 8), (2, 7)], "node long, tag long")
    assert sorted(x.node_id for x in L.select_by_tags(repeat.nodes, tags, 1, 45, 0, 1).collect()) == [2, 3, 4, 5]
    m = spark.createDataFrame([(1, 1, 3, 9, False)], "read_id long, node long, first_pos int, last_pos int, rev boolean")
    assert tuple(M.flip_mappings(m, spark.createDataFrame([(1, 40)], "node_id long, size int")).first()) == (1, -1, 30, 36, True)


def test_parallels_of_hubs(spark):
    """Many nodes between the same two: counted without pairs; a bubble has just two."""
    links = [(-1, n, 0) for n in range(10, 60)] + [(-n, 2, 0) for n in range(10, 60)] + [(-3, 70, 0), (-3, -71, 0), (-70, 4, 0), (71, 4, 0)]
    g = graph(spark, [(n, "ACGT") for n in (1, 2, 3, 4, *range(10, 60), 70, 71)], links)
    counts = {x.node: (x.parallels, x.lowest) for x in G.parallel_counts(g.links).collect()}
    assert counts[10][0] == 49 and counts[70] == (1, -71) and counts[-71] == (1, 70)
    assert {(x.node, x.parallel) for x in G.parallels(g.nodes, g.links).where("node in (70, -71)").collect()} == {(70, -71), (-71, 70)}
    assert sorted(x.node_id for x in G.bubble_sides(g.nodes, g.links).collect()) == [70, 71]
