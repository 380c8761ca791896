"""Read threads: ordered node positions per thread, (thread_id, idx, node, start_pos, end_pos).

A thread is one read's walk: its rows are bounded by the read, so windows per thread are
small; windows per node are not, and are avoided in favour of aggregates and joins.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.seq import upper_medians


def _by_thread():
    return Window.partitionBy("thread_id").orderBy("idx")


def drop_repeated(threads: DataFrame) -> DataFrame:
    """Without every occurrence of nodes that a thread holds more than once, in either orientation."""
    w = Window.partitionBy("thread_id", F.abs("node"))
    return threads.withColumn("__n", F.count("*").over(w)).where("__n = 1").drop("__n")


def renumber(threads: DataFrame) -> DataFrame:
    """Places counted from 0 without holes."""
    return threads.withColumn("idx", F.row_number().over(_by_thread()) - 1)


def with_least_nodes(threads: DataFrame, least: int) -> DataFrame:
    """Threads of at least ``least`` positions."""
    n = F.count("*").over(Window.partitionBy("thread_id"))
    return threads.withColumn("__n", n).where(F.col("__n") >= least).drop("__n")


def thread_links(threads: DataFrame) -> DataFrame:
    """Links of consecutive positions with their support: (source, dest, dist, thread_id, ordinal)."""
    w = _by_thread()
    t = threads.select("thread_id", "idx", "node", "end_pos", F.lead("node").over(w).alias("nx"), F.lead("start_pos").over(w).alias("ns"), (F.row_number().over(w) - 1).alias("ordinal"))
    return t.where("nx is not null").select((-F.col("node")).alias("source"), F.col("nx").alias("dest"), (F.col("ns") - F.col("end_pos")).alias("dist"), "thread_id", "ordinal")


def remove_threads(threads: DataFrame, gone: DataFrame) -> DataFrame:
    """R2: without the threads of the given ids (column ``thread_id``, of either sign); unknown ids change nothing."""
    g = gone.select(F.abs("thread_id").alias("thread_id")).distinct()
    return threads.join(g, "thread_id", "left_anti")


def thread_info(threads: DataFrame) -> DataFrame:
    """(thread_id, start_node, end_node, link_count); the end is negated, as entered from the other side."""
    g = threads.groupBy("thread_id").agg(F.min_by("node", "idx").alias("start_node"), (-F.max_by("node", "idx")).alias("end_node"), (F.count("*") - 1).alias("link_count"))
    return g


def threads_graph(threads: DataFrame, remove_repeated: bool = False, least_nodes: int = 2) -> tuple[DataFrame, DataFrame]:
    """The links of a set of threads and its (thread_id, start_node, end_node, link_count), without short threads and, if asked for, nodes that a thread holds more than once."""
    t = drop_repeated(threads) if remove_repeated else threads
    kept = with_least_nodes(renumber(t), least_nodes)
    return thread_links(kept), thread_info(kept)


def thread_positions(threads: DataFrame, nodes: DataFrame, reverse: bool = False) -> DataFrame:
    """Positions along the thread summed from node sizes and link distances: (thread_id, place, node, start_pos, end_pos).

    With ``reverse`` the thread is walked from its end; its id and nodes are negated.
    """
    w = _by_thread() if not reverse else Window.partitionBy("thread_id").orderBy(F.desc("idx"))
    near = F.lag("end_pos").over(w) if not reverse else F.lag("start_pos").over(w)
    gap = F.col("start_pos") - near if not reverse else near - F.col("end_pos")
    sized = threads.join(nodes.select(F.col("node_id"), F.length("seq").alias("size")), F.abs("node") == F.col("node_id"))
    t = sized.select("thread_id", "idx", "node", "size", F.coalesce(gap, F.lit(0)).cast("long").alias("gap"), (F.row_number().over(w) - 1).alias("place"))
    w2 = Window.partitionBy("thread_id").orderBy("place")
    start = F.sum(F.col("gap")).over(w2) + F.coalesce(F.sum("size").over(w2.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = -1 if reverse else 1
    return t.select((F.lit(s) * F.col("thread_id")).alias("thread_id"), "place", (F.lit(s) * F.col("node")).alias("node"), start.alias("start_pos"), (start + F.col("size")).alias("end_pos"))


def neighbours_in_thread(threads: DataFrame) -> DataFrame:
    """(thread_id, idx, node, prev_node, next_node), null at the ends."""
    w = _by_thread()
    return threads.select("thread_id", "idx", "node", F.lag("node").over(w).alias("prev_node"), F.lead("node").over(w).alias("next_node"))


def nodes_after(threads: DataFrame, node: int, before: bool = False) -> DataFrame:
    """Nodes after (or before) the first occurrence of a node in every thread, seen in the node's orientation: (thread_id, node)."""
    at = threads.where(F.abs("node") == abs(node)).groupBy("thread_id").agg(F.min("idx").alias("at"), F.min_by("node", "idx").alias("seen"))
    t = threads.join(at, "thread_id")
    turned = F.signum(F.col("seen") * F.lit(node)) < 0
    later = (F.col("idx") > F.col("at")) != (turned if not before else ~turned)
    return t.where((F.col("idx") != F.col("at")) & later).select("thread_id", F.when(turned, -F.col("node")).otherwise(F.col("node")).alias("node"))


def node_threads(threads: DataFrame, oriented: bool = False) -> DataFrame:
    """(node, thread_id): threads of each unsigned node; oriented ones are negative where the node is."""
    s = F.signum("node").cast("long") if oriented else F.lit(1)
    return threads.select(F.abs("node").alias("node"), (s * F.col("thread_id")).alias("thread_id")).distinct()


def node_threadpositions(threads: DataFrame) -> DataFrame:
    """(node, thread_id, position): 1-based places in the thread."""
    return threads.select(F.abs("node").alias("node"), "thread_id", F.row_number().over(_by_thread()).alias("position"))


def node_thread_neighbours(threads: DataFrame) -> DataFrame:
    """(node, other, shared_threads), itself included.

    Pairs are made within a thread, which a read's length bounds; the counts are partially
    aggregated before the shuffle, so a node in very many threads stays spread.
    """
    nt = node_threads(threads)
    return nt.join(nt.select("thread_id", F.col("node").alias("other")), "thread_id").groupBy("node", "other").agg(F.count("*").alias("shared_threads"))


def shared_threads(threads: DataFrame, oriented: bool = True) -> DataFrame:
    """(node, other, shared_threads) where both nodes have the same orientation within the thread."""
    nt = node_threads(threads, oriented)
    pairs = nt.join(nt.select("thread_id", F.col("node").alias("other")), "thread_id").where("node < other")
    return pairs.groupBy("node", "other").agg(F.count("*").alias("shared_threads"))


def support_popping_list(threads: DataFrame, least_supported: int, support: int, inclusive: bool = True) -> DataFrame:
    """(thread_id, node) where at most (or fewer than) ``least_supported`` of the thread's nodes share more than ``support`` threads with the node."""
    nt = node_threads(threads)
    strong = node_thread_neighbours(threads).where((F.col("shared_threads") > support) & (F.col("node") != F.col("other"))).select("node", "other")
    held = nt.join(nt.select("thread_id", F.col("node").alias("other")), "thread_id").join(strong, ["node", "other"], "left_semi").groupBy("thread_id", "node").agg(F.count("*").alias("supported"))
    few = nt.join(held, ["thread_id", "node"], "left").na.fill(0, ["supported"])
    return few.where(F.col("supported") <= least_supported if inclusive else F.col("supported") < least_supported).select("thread_id", "node")


def thread_count_popping_list(threads: DataFrame, most: int | None = None, least: int | None = None) -> DataFrame:
    """(thread_id, node) of nodes on more than ``most`` or fewer than ``least`` threads."""
    nt = node_threads(threads)
    n = nt.groupBy("node").agg(F.count("*").alias("n"))
    bad = n.where((F.col("n") > most) if most is not None else (F.col("n") < least)).select("node")
    return nt.join(bad, "node", "left_semi").select("thread_id", "node")


def pop(threads: DataFrame, popped: DataFrame, least_nodes: int = 2) -> DataFrame:
    """Threads without the popped (thread_id, node), renumbered; threads left with fewer than ``least_nodes`` positions go."""
    p = popped.select("thread_id", F.col("node").alias("__node")).distinct()
    kept = threads.join(p, (threads["thread_id"] == p["thread_id"]) & (F.abs(threads["node"]) == p["__node"]), "left_anti")
    return with_least_nodes(renumber(kept), least_nodes)


def clustering_popping_list(threads: DataFrame, least_shared: int, max_second: float) -> DataFrame:
    """Per node, clusters of its threads that share at least ``least_shared`` nodes; all threads if the second largest exceeds ``max_second`` of the largest, else those outside the largest.

    Up to two shared nodes the clusters are found through pairs of nodes, so a node on very many threads costs each of them its length. More
    shared nodes need every two threads of a node: pop repeat nodes first.
    """
    from strandloom.operators.traversal import components

    nt = node_threads(threads)
    key = lambda t: F.xxhash64("node", t)
    member = nt.withColumn("id", key("thread_id"))
    if least_shared <= 2:
        # threads of a node that hold one more node in common are one cluster: each meets the pair of nodes, not the other threads
        other = nt.select("thread_id", F.col("node").alias("other"))
        through = nt.join(other, "thread_id") if least_shared == 2 else nt.withColumn("other", F.lit(0).cast("long"))
        through = through.where("node <> other")
        edges = through.select(key("thread_id").alias("a"), F.xxhash64("node", F.lit("pair"), "other").alias("b")).distinct()
    else:
        pairs = nt.join(nt.select("node", F.col("thread_id").alias("other")), "node").where("thread_id < other")
        close = pairs.groupBy("thread_id", "other").agg(F.count("*").alias("shared")).where(F.col("shared") >= least_shared).select("thread_id", "other")
        edges = pairs.join(close, ["thread_id", "other"]).select(key("thread_id").alias("a"), key("other").alias("b"))
    cc = components(edges, member.select("id"))
    placed = member.join(cc, "id")
    sizes = placed.groupBy("node", "component").agg(F.count("*").alias("n"))
    w = Window.partitionBy("node").orderBy(F.desc("n"), "component")
    ranked = sizes.withColumn("rank", F.row_number().over(w)).where("rank <= 2")
    two = ranked.groupBy("node").agg(F.max(F.when(F.col("rank") == 1, F.col("n"))).alias("n1"), F.max(F.when(F.col("rank") == 1, F.col("component"))).alias("c1"), F.max(F.when(F.col("rank") == 2, F.col("n"))).alias("n2"))
    judged = placed.join(two, "node")
    return judged.where((F.coalesce("n2", F.lit(0)) > F.lit(max_second) * F.col("n1")) | (F.col("component") != F.col("c1"))).select("thread_id", "node")


def thread_nodesets(threads: DataFrame) -> DataFrame:
    """(thread_id, nodes): the sorted set of signed nodes of each thread."""
    return threads.groupBy("thread_id").agg(F.array_sort(F.collect_set("node")).alias("nodes"))


def subset_positions(threads: DataFrame, nodes: DataFrame) -> DataFrame:
    """Positions of a set of signed nodes in every thread, each thread turned so that most of them agree, and rebased to 0: (thread_id, node, start_pos, end_pos)."""
    s = nodes.select(F.col("node").alias("want")).distinct()
    held = threads.join(s, F.abs("node") == F.abs("want"))
    side = held.groupBy("thread_id").agg(F.sum(F.when(F.col("node") == F.col("want"), 1).otherwise(-1)).alias("vote"), F.min("start_pos").alias("lo"), F.max("end_pos").alias("hi"))
    t = held.join(side, "thread_id").where("vote <> 0 and (node = want) = (vote > 0)")
    fw = F.col("vote") > 0
    return t.select(
        (F.when(fw, 1).otherwise(-1) * F.col("thread_id")).alias("thread_id"), F.when(fw, F.col("node")).otherwise(-F.col("node")).alias("node"),
        F.when(fw, F.col("start_pos") - F.col("lo")).otherwise(F.col("hi") - F.col("end_pos")).alias("start_pos"), F.when(fw, F.col("end_pos") - F.col("lo")).otherwise(F.col("hi") - F.col("start_pos")).alias("end_pos"),
    )


def overlap_class(threads: DataFrame, pairs: DataFrame, skip: int = 10) -> DataFrame:
    """How two threads overlap: (t1, t2, class).

    Shared nodes (unique within each thread) must keep one orientation and one order, and no
    more than ``skip`` positions may lie between two shared ones on both threads; what hangs over at the
    ends (more than ``skip`` positions) tells complete, contained or dovetail; ``rt2`` is the second thread reversed.
    """
    n = threads.groupBy("thread_id").agg(F.count("*").alias("size"))
    u = drop_repeated(threads).join(renumber(threads).select("thread_id", "node", F.col("idx").alias("at")), ["thread_id", "node"]).select("thread_id", "node", "at")
    a = u.select(F.col("thread_id").alias("t1"), F.abs("node").alias("n"), F.col("node").alias("n1"), F.col("at").alias("i"))
    b = u.select(F.col("thread_id").alias("t2"), F.abs("node").alias("n"), F.col("node").alias("n2"), F.col("at").alias("j"))
    sizes = n.select(F.col("thread_id").alias("t2"), F.col("size").alias("s2"))
    shared = pairs.select("t1", "t2").join(a, "t1").join(b, ["t2", "n"]).join(sizes, "t2").withColumn("turned", F.col("n1") != F.col("n2")).withColumn("k", F.when(F.col("turned"), F.col("s2") - 1 - F.col("j")).otherwise(F.col("j")))
    w = Window.partitionBy("t1", "t2").orderBy("i")
    steps = shared.withColumn("di", F.col("i") - F.lag("i").over(w)).withColumn("dk", F.col("k") - F.lag("k").over(w))
    g = steps.groupBy("t1", "t2").agg(
        F.min("turned").alias("all_turned"), F.max("turned").alias("any_turned"), F.min("dk").alias("order"), F.max(F.least("di", "dk")).alias("hole"), F.min("i").alias("b1"), F.max("i").alias("e1"), F.min("k").alias("b2"), F.max("k").alias("e2"), F.first("s2").alias("s2")
    )
    g = g.join(n.select(F.col("thread_id").alias("t1"), F.col("size").alias("s1")), "t1")
    far = lambda c: F.col(c) > skip
    t2 = F.when(F.col("any_turned"), "rt2").otherwise("t2")
    g = g.withColumn("h1", F.col("s1") - 1 - F.col("e1")).withColumn("h2", F.col("s2") - 1 - F.col("e2"))
    bad = (F.col("all_turned") != F.col("any_turned")) | (F.coalesce("order", F.lit(1)) < 0) | (F.coalesce("hole", F.lit(0)) > skip + 1)
    label = (
        F.when(bad, "invalid")
        .when(far("b1") & far("b2") | far("h1") & far("h2"), "invalid")
        .when(~far("b1") & ~far("b2") & ~far("h1") & ~far("h2"), F.concat(F.lit("complete_"), t2))
        .when(~far("b1") & ~far("h1"), F.concat(F.lit("t1_in_"), t2))
        .when(~far("b2") & ~far("h2"), F.concat(t2, F.lit("_in_t1")))
        .when(far("b1") & far("h2"), F.concat(F.lit("t1_"), t2))
        .otherwise(F.concat(t2, F.lit("_t1")))
    )
    return pairs.select("t1", "t2").distinct().join(g.select("t1", "t2", label.alias("class")), ["t1", "t2"], "left").na.fill("no_overlap", ["class"])


def reduced(threads: DataFrame, least_thread_nodes: int, least_node_threads: int) -> DataFrame:
    """The largest part in which every thread has more than ``least_thread_nodes`` + 1 positions (links, strictly) and every node at least ``least_node_threads`` threads."""
    from strandloom.operators.traversal import fixpoint

    def step(t: DataFrame) -> DataFrame:
        n = node_threads(t).groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") >= least_node_threads).select(F.col("node").alias("__node"))
        kept = t.join(n, F.abs("node") == F.col("__node"), "left_semi")
        long_ = kept.groupBy("thread_id").agg(F.count("*").alias("n")).where(F.col("n") - 1 > least_thread_nodes).select("thread_id")
        return kept.join(long_, "thread_id", "left_semi")

    return renumber(fixpoint(threads, step, lambda t: (t.count(),)))


def restricted(threads: DataFrame, nodes: DataFrame) -> DataFrame:
    """Threads reduced to a set of nodes (column ``node``)."""
    return renumber(threads.join(nodes.select(F.abs("node").alias("__node")).distinct(), F.abs("node") == F.col("__node"), "left_semi"))


def proximity(threads: DataFrame, radius: int) -> DataFrame:
    """(node, other, times): nodes at most ``radius`` places apart on a thread. One window of ``radius`` following rows, no self join."""
    w = Window.partitionBy("thread_id").orderBy("idx").rowsBetween(1, radius)
    near = renumber(threads).select("node", F.collect_list("node").over(w).alias("ahead")).select("node", F.explode("ahead").alias("other"))
    a, b = F.abs("node"), F.abs("other")
    return near.where(a != b).groupBy(F.least(a, b).alias("node"), F.greatest(a, b).alias("other")).agg(F.count("*").alias("times"))


def closest_reliable(threads: DataFrame, count: int, least_links: int) -> DataFrame:
    """Per oriented node the reliable ones ahead of it: (node, other, dist, times).

    On each thread the first ``count`` nodes ahead that share at least ``least_links`` threads
    with the node; the distance is the upper median; those seen fewer than ``least_links`` / 2 times go.
    """
    t = renumber(threads)
    back = t.select("thread_id", (-F.col("idx")).alias("idx"), (-F.col("node")).alias("node"), (-F.col("end_pos")).alias("start_pos"), (-F.col("start_pos")).alias("end_pos"))
    both = t.select("thread_id", "idx", "node", "start_pos", "end_pos").withColumn("way", F.lit(1)).unionByName(back.withColumn("way", F.lit(-1)))
    ahead = both.select("thread_id", "way", F.col("idx").alias("j"), F.col("node").alias("other"), F.col("start_pos").alias("s"))
    pairs = both.join(ahead, ["thread_id", "way"]).where("j > idx and abs(node) <> abs(other)")
    linked = pairs.select("node", "other", "thread_id").distinct().groupBy("node", "other").agg(F.count("*").alias("n")).where(F.col("n") >= least_links).select("node", "other")
    w = Window.partitionBy("thread_id", "way", "idx").orderBy("j")
    near = pairs.join(linked, ["node", "other"]).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= count)
    g = upper_medians(near.select("node", "other", (F.col("s") - F.col("end_pos")).alias("gap")), ["node", "other"], "gap", "dist", "times")
    return g.where(F.col("times") >= math.ceil(least_links / 2))


def merge(first: DataFrame, second: DataFrame, least_shared: int) -> DataFrame:
    """Positions of ``second`` whose node shares at least ``least_shared`` of its thread's nodes with the thread in ``first`` and does not overlap them there, added to ``first``."""
    held = first.select("thread_id", F.abs("node").alias("n")).distinct()
    mine = second.join(held.groupBy("thread_id").agg(F.count("*").alias("known")).where(F.col("known") >= least_shared), "thread_id", "left_semi")
    fresh = mine.join(held, (mine["thread_id"] == held["thread_id"]) & (F.abs(mine["node"]) == held["n"]), "left_anti")
    taken = first.select(F.col("thread_id").alias("__t"), F.col("start_pos").alias("__s"), F.col("end_pos").alias("__e"))
    free = fresh.join(taken, (fresh["thread_id"] == F.col("__t")) & (fresh["start_pos"] < F.col("__e")) & (fresh["end_pos"] > F.col("__s")), "left_anti")
    both = first.select("thread_id", "node", "start_pos", "end_pos").unionByName(free.select("thread_id", "node", "start_pos", "end_pos"))
    w = Window.partitionBy("thread_id").orderBy("start_pos", "end_pos", "node")
    return both.withColumn("idx", F.row_number().over(w) - 1)
