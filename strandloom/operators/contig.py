"""Graph cleaning, repeat solving, construction and the edit queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.kmers import canonical, rc, unpack
from strandloom.functions.seq import kmers
from strandloom.operators.graph import Graph, bubble_sides, degrees, ends, mirrored, next_nodes, parallel_counts, tips
from strandloom.operators.mapping import all_paths_fw
from strandloom.operators.traversal import components, connected_components, join_unitigs, paths_between
from strandloom.session import discard, numbered, persisted


def path_triples(paths: DataFrame) -> DataFrame:
    """Votes for passing a node: (node > 0, prev, next, votes), each read passage counted in the node's orientation; gaps break passages."""
    s = F.when(F.size("path") > 2, F.sequence(F.lit(0), F.size("path") - 3))
    at = F.transform(s, lambda i: F.struct(F.get("path", i).alias("a"), F.get("path", i + 1).alias("m"), F.get("path", i + 2).alias("b")))
    t = paths.select(F.explode(at).alias("t")).select("t.*").where("a <> 0 and m <> 0 and b <> 0")
    fw = F.col("m") > 0
    return t.select(F.abs("m").alias("node"), F.when(fw, F.col("a")).otherwise(-F.col("b")).alias("prev"), F.when(fw, F.col("b")).otherwise(-F.col("a")).alias("next")).groupBy("node", "prev", "next").agg(F.count("*").alias("votes"))


def solve_repeats(votes: DataFrame, repeats: DataFrame, support: int, noise: int, snr: float) -> DataFrame:
    """(node, prev, next, votes) of repeats whose ways through are all clear: every prev and every next has one best partner,
    the best partners agree from both sides, and all other pairs stay within the noise.
    """
    v = votes.join(repeats.select(F.col("node_id").alias("node"), "degree"), "node")
    best_p = v.groupBy("node", "prev").agg(F.max(F.struct("votes", (-F.col("next")).alias("n"))).alias("b")).select("node", "prev", (-F.col("b.n")).alias("next"))
    best_n = v.groupBy("node", "next").agg(F.max(F.struct("votes", (-F.col("prev")).alias("p"))).alias("b")).select("node", "next", (-F.col("b.p")).alias("prev"))
    pairs = best_p.join(best_n, ["node", "prev", "next"]).withColumn("chosen", F.lit(True))
    j = v.join(pairs, ["node", "prev", "next"], "left")
    g = j.groupBy("node").agg(F.first("degree").alias("degree"), F.sum(F.col("chosen").isNotNull().cast("int")).alias("k"), F.min(F.when(F.col("chosen"), F.col("votes"))).alias("low"), F.coalesce(F.max(F.when(F.col("chosen").isNull(), F.col("votes"))), F.lit(0)).alias("rest"))
    clear = g.where((F.col("k") == F.col("degree")) & (F.col("low") >= support) & (F.col("rest") <= F.least(F.lit(noise), F.ceil(F.col("low") / F.lit(snr))))).select("node")
    return v.join(pairs.drop("chosen"), ["node", "prev", "next"], "left_semi").join(clear, "node", "left_semi").select("node", "prev", "next", "votes")


def clear_ways(votes: DataFrame, repeats: DataFrame, support: int, noise: int, snr: float) -> DataFrame:
    """(node, prev, next, votes): the best way from each previous node of the repeats (node_id, degree) all of whose sides are clear.

    Every previous and every next node needs a best way of at least ``support`` votes, whose second best has at most ``noise`` and ``snr`` times fewer.
    """
    v = votes.join(repeats.select(F.col("node_id").alias("node"), "degree"), "node")

    def side(end: str, other: str) -> DataFrame:
        w = Window.partitionBy("node", end).orderBy(F.desc("votes"), other)
        t = v.withColumn("rn", F.row_number().over(w)).where("rn <= 2")
        g = t.groupBy("node", end).agg(F.first("degree").alias("degree"), F.max(F.when(F.col("rn") == 1, F.col("votes"))).alias("best"), F.coalesce(F.max(F.when(F.col("rn") == 2, F.col("votes"))), F.lit(0)).alias("second"), F.max(F.when(F.col("rn") == 1, F.col(other))).alias("way"))
        return g.withColumn("ok", (F.col("best") >= support) & (F.col("second") <= noise) & (F.col("second") * F.lit(snr) <= F.col("best")))

    ins, outs = side("prev", "next"), side("next", "prev")
    whole = lambda t: t.groupBy("node").agg(F.min("ok").alias("ok"), F.count("*").alias("n"), F.first("degree").alias("d")).where("ok and n = d").select("node")
    return ins.join(whole(ins), "node", "left_semi").join(whole(outs), "node", "left_semi").select("node", "prev", F.col("way").alias("next"), F.col("best").alias("votes"))


def _repeat_sides(links: DataFrame, repeats: DataFrame) -> DataFrame:
    """(node, side, other): the signed previous and next nodes of repeats, seen from the positive node."""
    step = next_nodes(links).select("node", "next_node").distinct()
    r = repeats.select("node_id").distinct()
    fw = step.join(r, F.col("node") == F.col("node_id"), "left_semi").select("node", F.lit("next").alias("side"), F.col("next_node").alias("other"))
    bw = step.join(r, F.col("node") == -F.col("node_id"), "left_semi").select((-F.col("node")).alias("node"), F.lit("prev").alias("side"), (-F.col("next_node")).alias("other"))
    return fw.unionByName(bw)


def paired_votes(links: DataFrame, repeats: DataFrame, paths: DataFrame) -> DataFrame:
    """Votes of read pairs for the ways through repeats: (node, prev, next, votes).

    A pair (reads 2i-1 and 2i of a store) votes with every combination of a read through the previous and one through the next node.
    Both sides meet by pair, never by node, so a repeat on very many reads stays spread.
    """
    on = paths.select("store", F.floor((F.col("read_id") + 1) / 2).alias("pair"), "read_id", F.explode(F.array_distinct(F.transform("path", F.abs))).alias("n")).where("n <> 0")
    seen = on.groupBy("store", "pair", "n").agg(F.count("*").alias("reads"))
    sides = _repeat_sides(links, repeats)
    at = lambda side: sides.where(F.col("side") == side).select("node", F.col("other").alias(side), F.abs("other").alias("n")).join(seen, "n").select("node", side, "store", "pair", F.col("reads").alias(f"{side}_reads"))
    j = at("prev").join(at("next"), ["node", "store", "pair"]).where("prev <> next")
    return j.groupBy("node", "prev", "next").agg(F.sum(F.col("prev_reads") * F.col("next_reads")).alias("votes"))


def thread_votes(links: DataFrame, repeats: DataFrame, threads: DataFrame) -> DataFrame:
    """Votes of threads for what follows each previous node of a repeat: (node, prev, next, votes), next 0 for any other node.

    Of each thread the first place of the previous node counts that has a successor; the node that follows, or follows behind the repeat itself, gets the vote.
    """
    w = Window.partitionBy("thread_id").orderBy("idx")
    t = threads.select("thread_id", "idx", "node", F.lead("node", 1).over(w).alias("a1"), F.lead("node", 2).over(w).alias("a2"), F.lag("node", 1).over(w).alias("b1"), F.lag("node", 2).over(w).alias("b2"))
    fw = t.where("a1 is not null").select("thread_id", "idx", F.col("node").alias("prev"), F.col("a1").alias("x1"), F.col("a2").alias("x2"))
    bw = t.where("b1 is not null").select("thread_id", "idx", (-F.col("node")).alias("prev"), (-F.col("b1")).alias("x1"), (-F.col("b2")).alias("x2"))
    first = fw.unionByName(bw).groupBy("thread_id", "prev").agg(F.min_by(F.struct("x1", "x2"), "idx").alias("x"))
    sides = _repeat_sides(links, repeats)
    asked = sides.where("side = 'prev'").select("node", F.col("other").alias("prev")).join(first, "prev").select("node", "prev", F.when(F.col("x.x1") == F.col("node"), F.col("x.x2")).otherwise(F.col("x.x1")).alias("to"))
    n = asked.groupBy("node", "prev", "to").agg(F.count("*").alias("votes"))
    known = sides.where("side = 'next'").select("node", F.col("other").alias("to"), F.lit(True).alias("known"))
    return n.join(known, ["node", "to"], "left").select("node", "prev", F.when(F.col("known"), F.col("to")).otherwise(0).alias("next"), "votes").groupBy("node", "prev", "next").agg(F.sum("votes").alias("votes"))


def solve_repeats_by_threads(links: DataFrame, repeats: DataFrame, threads: DataFrame, kcis: DataFrame, max_side_kci: float = 1.5, support: int = 1, snr: float = 5.0) -> DataFrame:
    """(node, prev, next, votes) of repeats with two nodes on either side, all of known coverage (kci not -1) of at most ``max_side_kci``, whose two ways the threads tell apart.

    Each way needs more than ``support`` votes, and ``snr`` times as many as all others of its previous node.
    """
    two = repeats.where("degree = 2")
    sides = _repeat_sides(links, two)
    good = sides.join(kcis.select(F.col("node_id").alias("k"), "kci"), F.abs("other") == F.col("k"), "left").groupBy("node").agg(F.min(F.coalesce((F.col("kci") != -1) & (F.col("kci") <= max_side_kci), F.lit(False))).alias("ok")).where("ok").select("node")
    v = thread_votes(links, two.join(good.withColumnRenamed("node", "node_id"), "node_id", "left_semi"), threads)
    w = Window.partitionBy("node", "prev")
    best = v.withColumn("all", F.sum("votes").over(w)).withColumn("top", F.max(F.struct("votes", "next")).over(w)).where("next <> 0 and next = top.next")
    clear = best.where((F.col("votes") > support) & (F.col("votes") / F.lit(snr) >= F.col("all") - F.col("votes"))).select("node", "prev", "next", "votes")
    both = clear.groupBy("node").agg(F.count("*").alias("n"), F.countDistinct("next").alias("m")).where("n = 2 and m = 2").select("node")
    return clear.join(both, "node", "left_semi")


def through_ranking(votes: DataFrame, most: int = 3) -> DataFrame:
    """The best ways through every node: (node, prev, next, votes, rank)."""
    w = Window.partitionBy("node").orderBy(F.desc("votes"), "prev", "next")
    return votes.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def expand_repeats(graph: Graph, solved: DataFrame) -> Graph:
    """C4: each way through a solved repeat gets a copy of it."""
    from strandloom.operators.graph import expand_nodes

    w = Window.partitionBy("node").orderBy("prev", "next")
    ways = solved.withColumn("grp", F.row_number().over(w))
    sides = F.array(F.struct(F.lit("bw").alias("side"), (-F.col("prev")).alias("other")), F.struct(F.lit("fw").alias("side"), F.col("next").alias("other")))
    groups = ways.select(F.col("node").alias("node_id"), "grp", F.explode(sides).alias("s")).select("node_id", "grp", "s.*")
    return expand_nodes(graph, groups)[0]


def node_path_counts(paths: DataFrame) -> DataFrame:
    """Reads through each unsigned node: (node_id, reads)."""
    e = paths.select("store", "read_id", F.explode(F.array_distinct(F.transform("path", F.abs))).alias("node_id")).where("node_id <> 0")
    return e.groupBy("node_id").agg(F.count("*").alias("reads"))


def bubbles_to_pop(graph: Graph, paths: DataFrame, size: int = 200, support: int = 4, noise: int = 3, snr: float = 10) -> DataFrame:
    """Bubble sides of at most ``size`` with at most ``noise`` reads, whose parallel has at least ``support`` and ``snr`` times as many: (node_id)."""
    c = node_path_counts(paths)
    sides = bubble_sides(graph.nodes, graph.links).join(graph.nodes.where(F.length("seq") <= size).select("node_id"), "node_id")
    n = sides.join(c, "node_id", "left").join(c.select(F.col("node_id").alias("p"), F.col("reads").alias("pr")), F.abs("parallel") == F.col("p"), "left").na.fill(0, ["reads", "pr"])
    return n.where((F.col("reads") <= noise) & (F.col("pr") >= support) & (F.col("pr") >= F.lit(snr) * F.col("reads"))).select("node_id")


def tips_to_clip(graph: Graph, votes: DataFrame, size: int, support: int, noise: int, snr: float) -> DataFrame:
    """Tips whose passage reads reject: (node_id); ``votes`` has (node, other, votes) of steps between neighbours.

    Ayes go from the neighbour to the tip, nays from the neighbour elsewhere.
    """
    t = tips(graph.nodes, graph.links).join(graph.nodes.where(F.length("seq") <= size).select("node_id"), "node_id")
    d = degrees(graph.nodes, graph.links).select("node_id", "only_prev", "only_next")
    at = t.join(d, "node_id").select("node_id", F.coalesce("only_prev", -F.col("only_next")).alias("node"), F.when(F.col("only_prev").isNotNull(), F.col("node_id")).otherwise(-F.col("node_id")).alias("aye"))
    g = at.join(votes, "node").groupBy("node_id").agg(F.coalesce(F.sum(F.when(F.col("other") == F.col("aye"), F.col("votes"))), F.lit(0)).alias("ayes"), F.coalesce(F.sum(F.when(F.col("other") != F.col("aye"), F.col("votes"))), F.lit(0)).alias("nays"))
    return g.where((F.col("ayes") <= noise) & (F.col("ayes") * F.lit(snr) <= F.col("nays")) & (F.col("nays") >= support)).select("node_id")


def clip_tips(graph: Graph, size: int, rounds: int | None = None) -> Graph:
    """Removes tips of at most ``size`` and joins lines, until there are none; with ``rounds`` at most so many times, as the caller asks."""
    while rounds is None or rounds > 0:
        gone = persisted(tips(graph.nodes, graph.links).join(graph.nodes.where(F.length("seq") <= size).select("node_id"), "node_id", "left_semi"), "tips")
        if gone.isEmpty():
            break
        joined, _ = join_unitigs(graph.remove_nodes(gone))
        graph = Graph(persisted(joined.nodes, "graph"), persisted(joined.links, "graph"))
        rounds = None if rounds is None else rounds - 1
    return graph


def low_coverage_nodes(nodes: DataFrame, graph_counts: DataFrame, read_counts: DataFrame, size: int, most: int, k: int) -> DataFrame:
    """Nodes of at most ``size`` all of whose k-mers, or all of whose graph-unique ones if there are any, are counted at most ``most`` times: (node_id)."""
    t = kmers(nodes.where(F.length("seq") <= size), k, ["node_id"], spots=False)
    t = t.join(graph_counts.select("code", F.col("n").alias("g")), "code").join(read_counts.select("code", F.col("n").alias("r")), "code", "left").na.fill(0, ["r"])
    g = t.groupBy("node_id").agg(F.max("r").alias("all_most"), F.max(F.when(F.col("g") == 1, F.col("r"))).alias("unique_most"))
    return g.where((F.col("all_most") <= most) | (F.col("unique_most") <= most)).select("node_id")


def small_unconnected(graph: Graph, size: int) -> DataFrame:
    """Nodes below ``size`` without links: (node_id)."""
    linked = graph.links.select(F.explode(F.array(F.abs("source"), F.abs("dest"))).alias("node_id")).distinct()
    return graph.nodes.where(F.length("seq") < size).join(linked, "node_id", "left_anti").select("node_id")


def ways_to_repeats(graph: Graph, most: int) -> DataFrame:
    """Nodes of at most ``most`` letters with several nodes before and one behind, to be split by what comes before: (node, prev, next).

    ``node`` is signed: of either orientation. Every previous node must lead nowhere else and have at most one parallel.
    """
    step = next_nodes(graph.links).select("node", "next_node").distinct()
    e = ends(graph.links)
    small = graph.nodes.where(F.length("seq") <= most).select("node_id")
    fw = e.where("next_count = 1").select("node", F.col("lowest_next").alias("next"))
    bw = e.where("next_count >= 2").select((-F.col("node")).alias("node"))
    asked = fw.join(bw, "node").join(small, F.abs("node") == F.col("node_id"), "left_semi")
    before = step.select((-F.col("node")).alias("node"), (-F.col("next_node")).alias("prev"))
    beside = parallel_counts(graph.links).select(F.col("node").alias("prev"), "parallels")
    j = asked.join(before, "node").join(e.select(F.col("node").alias("prev"), "next_count"), "prev").join(beside, "prev", "left").na.fill(0, ["parallels"])
    bad = j.where("next_count > 1 or parallels > 1").select("node").distinct()
    return j.join(bad, "node", "left_anti").select("node", "prev", "next")


def small_components(graph: Graph, least_nodes: int, least_node_size: int, least_total: int) -> DataFrame:
    """C17: nodes of components with too few nodes, no node large enough, or too small a total: (node_id)."""
    cc = persisted(connected_components(graph.nodes, graph.links), "cc")
    g = cc.join(graph.nodes.select("node_id", F.length("seq").alias("size")), "node_id").groupBy("component").agg(F.count("*").alias("n"), F.max("size").alias("top"), F.sum("size").alias("total"))
    bad = g.where((F.col("n") < least_nodes) | (F.col("top") < least_node_size) | (F.col("total") < least_total)).select("component")
    return cc.join(bad, "component", "left_semi").select("node_id")


def _end_nodes(graph: Graph) -> DataFrame:
    """(node): signed nodes that nothing follows."""
    both = graph.nodes.select(F.explode(F.array(F.col("node_id"), -F.col("node_id"))).alias("node"))
    return both.join(ends(graph.links).select("node"), "node", "left_anti")


def tip_connections(graph: Graph, paths: DataFrame, least_links: int = 3) -> DataFrame:
    """C11: pairs of ends that read pairs lead from and to: (a, b, pairs), ``a`` a signed node that nothing follows, ``b`` one that nothing precedes.

    The nodes of a pair are those of its first read and then those of its second one walked back. A pair counts if it leaves at one
    end only and enters at one only, and not before it left.
    """
    walk = lambda back: F.transform(F.reverse("path"), lambda x: -x) if back else F.col("path")
    pair = F.floor((F.col("read_id") + 1) / 2).alias("pair")
    first = paths.where("read_id % 2 = 1").select("store", pair, F.lit(0).alias("half"), F.posexplode(walk(False)).alias("place", "node"))
    second = paths.where("read_id % 2 = 0").select("store", pair, F.lit(1).alias("half"), F.posexplode(walk(True)).alias("place", "node"))
    e = first.unionByName(second).where("node <> 0")
    free = _end_nodes(graph)
    out = e.join(free, "node", "left_semi").withColumn("kind", F.lit("out"))
    into = e.join(free.select((-F.col("node")).alias("node")), "node", "left_semi").withColumn("kind", F.lit("in"))
    at = F.struct("half", "place")
    met = out.unionByName(into).groupBy("store", "pair").agg(
        *(F.min(F.when(F.col("kind") == k, F.col("node"))).alias(f"{k}_low") for k in ("out", "in")), *(F.max(F.when(F.col("kind") == k, F.col("node"))).alias(f"{k}_high") for k in ("out", "in")), *(F.min(F.when(F.col("kind") == k, at)).alias(f"{k}_at") for k in ("out", "in"))
    )
    good = met.where("out_low = out_high and in_low = in_high and out_at <= in_at")
    return good.groupBy(F.col("out_low").alias("a"), F.col("in_low").alias("b")).agg(F.count("*").alias("pairs")).where(F.col("pairs") >= least_links)


def reconnection_groups(graph: Graph, paths: DataFrame, more_than: int) -> DataFrame:
    """(grp, node): ends that reads join: a signed node that nothing follows, and the negatives of the nodes that more than ``more_than`` reads have next behind it.

    Groups that share an end are one, named by its least node.
    """
    free = _end_nodes(graph)
    ahead = F.filter("path", lambda x: x != 0)
    votes = all_paths_fw(paths, free).select("node", F.get(ahead, 0).alias("other")).where("other is not null").groupBy("node", "other").agg(F.count("*").alias("votes")).where(F.col("votes") > more_than)
    edges = persisted(votes.select(F.col("node").alias("a"), (-F.col("other")).alias("b")), "groups")
    members = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return components(edges, members).select(F.col("component").alias("grp"), F.col("id").alias("node"))


def patch_groups(graph: Graph, groups: DataFrame, least: int = 15, most: int = 126) -> tuple[Graph, DataFrame]:
    """Joins the two ends of every group that has just two, both free, whose letters overlap exactly by ``least`` to ``most``, by the shortest such overlap.

    The two nodes become one, which gets the links of their other ends. Also gives (a, b, overlap, new_id). A node in two such groups is patched in the group of the least name.
    """
    free = _end_nodes(graph)
    two = groups.groupBy("grp").agg(F.count("*").alias("n"), F.min("node").alias("a"), F.max("node").alias("b")).where("n = 2 and abs(a) <> abs(b)").select("grp", "a", "b")
    two = two.join(free.select(F.col("node").alias("a")), "a", "left_semi").join(free.select(F.col("node").alias("b")), "b", "left_semi")
    # a node patched at one of its ends is gone for another group
    ends_of = two.select("grp", F.explode(F.array(F.abs("a"), F.abs("b"))).alias("n"))
    lost = ends_of.withColumn("rn", F.row_number().over(Window.partitionBy("n").orderBy("grp"))).where("rn > 1").select("grp").distinct()
    two = two.join(lost, "grp", "left_anti")
    seq = lambda end, name, turn: graph.nodes.select(F.col("node_id").alias(f"{name}_id"), F.col("seq").alias(name))
    t = two.join(seq("a", "s1", 1), F.abs("a") == F.col("s1_id")).join(seq("b", "s2", 1), F.abs("b") == F.col("s2_id"))
    # the second node is entered, so it is walked from the other side
    t = t.select("a", "b", F.when(F.col("a") < 0, rc(F.col("s1"))).otherwise(F.col("s1")).alias("s1"), F.when(F.col("b") > 0, rc(F.col("s2"))).otherwise(F.col("s2")).alias("s2"))
    sizes = F.filter(F.sequence(F.lit(least), F.lit(most)), lambda o: (o <= F.length("s1")) & (o <= F.length("s2")) & (F.right("s1", o) == F.substring("s2", F.lit(1), o)))
    t = t.withColumn("overlap", F.get(sizes, 0)).where("overlap is not null")
    last = graph.nodes.agg(F.max("node_id")).first()[0] or 0
    made = numbered(t.select("a", "b", "overlap", F.concat("s1", F.expr("substring(s2, overlap + 1)")).alias("seq")), "rank", "a", "b").withColumn("new_id", F.col("rank") + 1 + F.lit(last)).drop("rank")
    made = persisted(made, "patches")
    moved = mirrored(graph.links).select("source", "dest", "dist")
    new = made.select(F.explode(F.array(F.struct(F.col("a").alias("end"), F.col("new_id").alias("new")), F.struct(F.col("b").alias("end"), (-F.col("new_id")).alias("new")))).alias("x")).select("x.*")
    # what enters the old node now enters the new one; a link between two patched nodes moves at both ends
    entering = moved.join(new, F.col("source") == F.col("end"), "left").select(F.coalesce("new", "source").alias("source"), "dest", "dist", F.col("new").isNotNull().alias("m1"))
    both = entering.join(new, F.col("dest") == F.col("end"), "left").select("source", F.coalesce("new", "dest").alias("dest"), "dist", (F.col("m1") | F.col("new").isNotNull()).alias("moved"))
    fresh = both.where("moved").select(F.least("source", "dest").alias("source"), F.greatest("source", "dest").alias("dest"), "dist").distinct()
    rest = graph.remove_nodes(made.select(F.explode(F.array(F.abs("a"), F.abs("b"))).alias("node_id")))
    nodes = rest.nodes.select("node_id", "seq").unionByName(made.select(F.col("new_id").alias("node_id"), "seq"))
    return Graph(nodes, rest.links.select("source", "dest", "dist").unionByName(fresh)), made.select("a", "b", "overlap", "new_id")


def exact_end_overlaps(nodes: DataFrame, least: int = 15, most: int = 126) -> DataFrame:
    """(source, dest, overlap): ends of different nodes whose letters overlap exactly, the longest per pair.

    Where an overlap of ``n`` letters exists, the ``least`` letters with which the second node begins stand ``n`` letters before the end of the first. Places near
    an end are first kept by a hash of these letters that some node begins with, as three numbers each; only those that are left get their letters and meet the
    nodes, and the rest is compared once they have met. The planner takes the many places of an end for one row, so their joins are hinted to merge.
    """
    both = nodes.where(F.length("seq") >= least).select(F.explode(F.array(F.struct("node_id", "seq"), F.struct((-F.col("node_id")).alias("node_id"), rc(F.col("seq")).alias("seq")))).alias("n")).select("n.*")
    ends_ = both.select((-F.col("node_id")).alias("source"), F.right("seq", F.lit(most)).alias("end"))
    heads = both.select(F.col("node_id").alias("dest"), F.substring("seq", 1, most).alias("head"), F.substring("seq", 1, least).alias("seed"))
    places = ends_.select("source", "end", F.explode(F.sequence(F.lit(least), F.least(F.lit(most), F.length("end")))).alias("overlap"))
    begun = F.substring(F.right("end", F.col("overlap")), 1, least)
    known = heads.select(F.hash("seed").alias("key")).distinct()
    near = places.select("source", "overlap", F.hash(begun).alias("key")).hint("merge").join(known, "key", "left_semi").select("source", "overlap")
    tails = near.hint("merge").join(ends_, "source").select("source", F.right("end", F.col("overlap")).alias("tail"), "overlap").withColumn("seed", F.substring("tail", 1, least))
    j = tails.hint("merge").join(heads, "seed").where("abs(source) <> abs(dest) and source < dest and startswith(head, tail)")
    return j.groupBy("source", "dest").agg(F.max("overlap").alias("overlap"))


def de_bruijn(codes: DataFrame, k: int) -> Graph:
    """B1, B2: the compacted de Bruijn graph of a set of canonical k-mers (column ``code``): nodes are unitigs, links overlap by k - 1.

    A k-mer is a node of the one-step graph; a step joins k-mers overlapping by k - 1. Lines of that graph are the
    unitigs (a closed one begins with its smallest k-mer), numbered by their smallest k-mer's rank.
    """
    texts = codes.select("code", unpack(F.col("code"), k).alias("kmer")).distinct()
    # a node id per k-mer: dense enough for signs, in any order
    named = persisted(texts.select((F.col("code") + 1).alias("node_id"), F.col("kmer").alias("seq")), "dbg")
    both = named.select(F.explode(F.array(F.struct("node_id", "seq"), F.struct((-F.col("node_id")).alias("node_id"), rc(F.col("seq")).alias("seq")))).alias("n")).select("n.*")
    out = both.select((-F.col("node_id")).alias("source"), F.substring("seq", 2, k - 1).alias("part"))
    into = both.select(F.col("node_id").alias("dest"), F.substring("seq", 1, k - 1).alias("part"))
    steps = out.join(into, "part").where("source <= dest").select("source", "dest", F.lit(1 - k).alias("dist")).distinct()
    return join_unitigs(Graph(named, persisted(steps, "dbg")), 2)[0]


def anchor_runs(node_counts: DataFrame, least: int, most: int, longest: int | None = None) -> DataFrame:
    """Runs of positions whose k-mer is unique in the graph and counted ``least`` to ``most`` times: (node_id, first, last, kmers).

    ``node_counts`` has (node_id, pos, g, n). A run is dropped if the k-mer right before or behind it is unique in the graph too, or is counted
    less than 1.5 times as often as the run's outermost one: there the graph may have collapsed. With ``longest``, runs are cut into pieces of at most that many k-mers.
    """
    w = Window.partitionBy("node_id").orderBy("pos")
    near = lambda c, f, step: F.when(f("pos").over(w) == F.col("pos") + step, f(c).over(w))
    t = node_counts.select("node_id", "pos", "g", "n", near("g", F.lag, -1).alias("g0"), near("n", F.lag, -1).alias("n0"), near("g", F.lead, 1).alias("g1"), near("n", F.lead, 1).alias("n1"))
    t = t.where((F.col("g") == 1) & F.col("n").between(least, most)).withColumn("island", F.col("pos") - F.row_number().over(w))
    sharp = lambda g, n: F.col(g).isNull() | ((F.col(g) != 1) & (F.col(n) * 10 >= F.col("n") * 15))
    run = Window.partitionBy("node_id", "island")
    t = t.withColumn("at", F.row_number().over(run.orderBy("pos")) - 1).withColumn("size", F.count("*").over(run))
    judged = t.withColumn("fails", ((F.col("at") == 0) & ~sharp("g0", "n0")) | ((F.col("at") == F.col("size") - 1) & ~sharp("g1", "n1")))
    kept = judged.withColumn("bad", F.max("fails").over(run)).where("not bad")
    piece = F.floor(F.col("at") / longest) if longest else F.lit(0)
    return kept.withColumn("piece", piece).groupBy("node_id", "island", "piece").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("kmers")).select("node_id", "first", "last", "kmers")


def anchor_graph(nodes: DataFrame, runs: DataFrame, k: int) -> tuple[Graph, DataFrame]:
    """A graph whose nodes are the runs, each linked with the next one of its node: also (node_id, first, anchor).

    Anchors are numbered in order of node and position and stored canonically; ``anchor`` is negative where that reversed it. A distance is that between the runs on their node.
    """
    named = numbered(runs.join(nodes.select("node_id", "seq"), "node_id").select("node_id", "first", F.substring("seq", F.col("first") + 1, F.col("last") - F.col("first") + k).alias("seq")), "rank", "node_id", "first")
    named = persisted(named.select("node_id", "first", F.length("seq").alias("size"), canonical(F.col("seq")).alias("kept"), F.when(F.col("seq") == canonical(F.col("seq")), F.col("rank") + 1).otherwise(-F.col("rank") - 1).alias("anchor")), "anchors")
    w = Window.partitionBy("node_id").orderBy("first")
    links = named.select((-F.lag("anchor").over(w)).alias("source"), F.col("anchor").alias("dest"), (F.col("first") - F.lag("first").over(w) - F.lag("size").over(w)).cast("int").alias("dist")).where("source is not null")
    return Graph(named.select(F.abs("anchor").alias("node_id"), F.col("kept").alias("seq")), links), named.select("node_id", "first", "anchor")


#: Rows of a group of edits in conflict that one task decides in order; larger groups are decided in rounds.
LOCAL_EDITS = 1 << 16


def _in_order(rows):
    """The edits of one small group, decided one after another."""
    taken: set = set()
    out = []
    for op, items in rows.sort_values("op_id").groupby("op_id", sort=True):
        mine = set(items["item"])
        if not mine & taken:
            taken |= mine
            out.append(op)
    import pandas as pd

    return pd.DataFrame({"op_id": pd.Series(out, dtype="int64")})


def accepted_edits(ops: DataFrame, local_rows: int = LOCAL_EDITS) -> DataFrame:
    """The edits of a queue that are accepted: (op_id).

    ``ops`` has (op_id, kind, item): the signed ends an edit consumes; an edit of a whole node consumes both of its ends. Kinds ending
    in ``deletion`` are always accepted; any other edit is if no accepted earlier edit consumes one of its items. So what an earlier deletion
    consumes is rejected at once, and deletions never wait for one another. Of the other edits, those that share items, also
    through others, are a group; a group of up to ``local_rows`` rows is decided by one task, and a larger one in rounds by aggregates per
    item, as many as it needs: an edit that comes first for all its items is accepted, and what it shares them with is rejected.
    """
    rows = persisted(ops.select(F.col("op_id").cast("long"), F.col("kind").endswith("deletion").alias("always"), F.col("item").cast("long").alias("item")).distinct(), "edits")
    deleted = rows.where("always").groupBy("item").agg(F.min("op_id").alias("gone"))
    late = rows.where("not always").join(deleted, "item").where("gone < op_id").select("op_id").distinct()
    asked = persisted(rows.where("not always").join(late, "op_id", "left_anti").select("op_id", "item"), "edits")
    a, b = F.col("op_id") * 2, F.xxhash64("item").bitwiseOR(F.lit(1))
    member = asked.select("op_id", a.alias("id")).distinct()
    group = components(asked.select(a.alias("a"), b.alias("b")), member.select("id")).select((F.col("id") / 2).cast("long").alias("op_id"), F.col("component").alias("grp"))
    placed = persisted(asked.join(group, "op_id"), "edits")
    sizes = placed.groupBy("grp").agg(F.count("*").alias("n"))
    small = placed.join(sizes.where(F.col("n") <= local_rows).select("grp"), "grp", "left_semi")
    done = small.groupBy("grp").applyInPandas(lambda t: _in_order(t), "op_id long")
    left = persisted(placed.join(sizes.where(F.col("n") > local_rows).select("grp"), "grp", "left_semi").select("op_id", "item"), "edits")
    parts = [rows.where("always").select("op_id"), done]
    while not left.isEmpty():
        # per item the first edit; one that is first for all of its items is decided
        first = left.groupBy("item").agg(F.min("op_id").alias("first"))
        met = left.join(first, "item").groupBy("op_id").agg(F.min(F.col("op_id") == F.col("first")).alias("leads"))
        won = persisted(met.where("leads").select("op_id"), "edits")
        parts.append(won)
        used = left.join(won, "op_id", "left_semi").select("item").distinct()
        lost = left.join(used, "item", "left_semi").select("op_id").distinct()
        rest = persisted(left.join(lost, "op_id", "left_anti"), "edits")
        discard(left)
        left = rest
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def expansion_items(ways: DataFrame) -> DataFrame:
    """What expansions of nodes consume: (op_id, kind, item), from ways (op_id, node, prev, next): both ends of the node and the ends of its neighbours toward it."""
    items = F.explode(F.array(F.abs("node"), -F.abs("node"), -F.col("prev"), F.col("next")))
    return ways.select("op_id", F.lit("node_expansion").alias("kind"), items.alias("item")).distinct()


def deletion_items(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """What deletions of nodes (op_id, node_id) consume: their two ends and the ends they are linked with."""
    own = nodes.select("op_id", F.explode(F.array("node_id", -F.col("node_id"))).alias("item"))
    there = mirrored(links).join(nodes, F.abs("source") == F.col("node_id")).select("op_id", F.col("dest").alias("item"))
    return own.unionByName(there).distinct().select("op_id", F.lit("node_deletion").alias("kind"), "item")


def apply_edits(graph: Graph, ways: DataFrame, gone_links: DataFrame, gone_nodes: DataFrame, accepted: DataFrame) -> Graph:
    """The graph after the accepted edits of a queue: expansions of nodes (op_id, node, prev, next), deletions of links (op_id, source, dest) and of nodes (op_id, node_id).

    Accepted edits do not touch one another but for deletions, which come last.
    """
    of = lambda t: t.join(accepted, "op_id", "left_semi")
    turn = F.col("node") < 0
    solved = of(ways).select(F.abs("node").alias("node"), F.when(turn, -F.col("next")).otherwise(F.col("prev")).alias("prev"), F.when(turn, -F.col("prev")).otherwise(F.col("next")).alias("next"))
    return apply_deletions(expand_repeats(graph, solved), of(gone_nodes).select("node_id"), of(gone_links).select("source", "dest"))


def apply_deletions(graph: Graph, nodes: DataFrame, links: DataFrame) -> Graph:
    """C17: queued link deletions, then node deletions."""
    return graph.remove_links(links).remove_nodes(nodes)


def extend_to_repeats(graph: Graph, most: int) -> Graph:
    """Every node of :func:`ways_to_repeats` is split into a copy per previous node, as far as the edits allow one another."""
    ways = persisted(ways_to_repeats(graph, most).withColumn("op_id", F.abs("node") * 2 + (F.col("node") < 0).cast("int")), "ways")
    spark = graph.nodes.sparkSession
    ok = accepted_edits(expansion_items(ways))
    return apply_edits(graph, ways, spark.createDataFrame([], "op_id long, source long, dest long"), spark.createDataFrame([], "op_id long, node_id long"), ok)


def path_scores(candidates: DataFrame, hits: DataFrame) -> DataFrame:
    """Of candidate paths (path_id, group_id, node) the one of each group with most matched letters on its nodes, the first on a tie: (group_id, path_id, score).

    ``hits`` has (node, size) and, where matches belong to the reads of a group, its group_id.
    """
    on = ["group_id", "n"] if "group_id" in hits.columns else ["n"]
    h = hits.withColumn("n", F.abs("node")).groupBy(*on).agg(F.sum("size").alias("size"))
    s = candidates.withColumn("n", F.abs("node")).select("group_id", "path_id", "n").distinct().join(h, on, "left").groupBy("group_id", "path_id").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("score"))
    w = Window.partitionBy("group_id").orderBy(F.desc("score"), "path_id")
    return s.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def path_hits(paths: DataFrame, reads: DataFrame, k: int, drift: int = 63) -> DataFrame:
    """How many k-mers of each path lie in line with each read of its group: ([path columns] group_id, path_id, read_id, hits).

    ``paths`` has (group_id, path_id, seq), ``reads`` (group_id, read_id, seq). Along the path, a k-mer takes the read's first place of it that lies behind the last
    place taken, if their difference changed by less than ``drift``. What one path and one read bring together is bounded by their lengths.
    """
    p = kmers(paths, k, ["group_id", "path_id"], canonical_mode=False).select("group_id", "path_id", F.col("pos").alias("ki"), "code")
    r = kmers(reads, k, ["group_id", "read_id"], canonical_mode=False).select("group_id", "read_id", F.col("pos").alias("ri"), "code")
    held = p.join(r, ["group_id", "code"]).groupBy("group_id", "path_id", "read_id").agg(F.array_sort(F.collect_list(F.struct("ki", "ri"))).alias("at"))
    start = F.struct(F.lit(-1).alias("ri"), F.lit(-1).alias("ki"), F.lit(0).alias("n"))

    def take(acc, x):
        near = (acc["n"] == 0) | (F.abs((acc["ki"] - acc["ri"]) - (x["ki"] - x["ri"])) < drift)
        good = (x["ri"] > acc["ri"]) & (x["ki"] != acc["ki"]) & near
        return F.when(good, F.struct(x["ri"].alias("ri"), x["ki"].alias("ki"), (acc["n"] + 1).alias("n"))).otherwise(acc)

    return held.select("group_id", "path_id", "read_id", F.aggregate("at", start, take)["n"].alias("hits"))


def fill_lines(graph: Graph, anchors: DataFrame, hits: DataFrame, max_nodes: int = 100, max_size: int = 10000) -> DataFrame:
    """Lines of anchors (line, place, node) with the best path between each two neighbours put in: (line, path).

    ``hits`` has (node, size): matches of reads. Of several paths the one with most matched letters is taken, the lexically first on a tie; where there is none, the two stand side by side.
    """
    w = Window.partitionBy("line").orderBy("place")
    steps = persisted(anchors.select("line", "place", "node", F.lead("node").over(w).alias("to")), "steps")
    pairs = steps.where("to is not null").select(F.col("node").alias("from_node"), F.col("to").alias("to_node")).distinct()
    found = paths_between(graph.nodes, graph.links, pairs, max_nodes, max_size)
    named = persisted(found.select("from_node", "to_node", "path", F.struct("from_node", "to_node").alias("group_id"), F.concat_ws(",", F.transform("path", lambda x: x.cast("string"))).alias("path_id")), "ways")
    best = path_scores(named.select("group_id", "path_id", F.explode_outer("path").alias("node")), hits).select("group_id", "path_id")
    way = named.join(best, ["group_id", "path_id"], "left_semi").select(F.col("from_node").alias("node"), F.col("to_node").alias("to"), F.col("path").alias("way"))
    j = steps.join(way, ["node", "to"], "left").select("line", F.struct("place", F.concat(F.array("node"), F.coalesce("way", F.array().cast("array<bigint>"))).alias("p")).alias("x"))
    return j.groupBy("line").agg(F.flatten(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["p"])).alias("path"))


def canonical_digest(seq: Column) -> Column:
    """A name for a sequence whatever its strand."""
    return F.md5(canonical(seq))
