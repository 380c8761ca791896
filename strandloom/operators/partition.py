"""Classes of nodes and threads, clusters, and linear orders.

Threads are (thread_id, idx, node, start_pos, end_pos); classes are tables
``node_class`` (node, class) and ``thread_class`` (thread_id, class), 0 meaning none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.seq import upper_medians
from strandloom.operators.graph import next_nodes
from strandloom.operators.threads import node_threads, renumber
from strandloom.operators.traversal import fixpoint
from strandloom.session import discard, persisted, shuffle_width


def node_classes(threads: DataFrame, thread_class: DataFrame, least_votes: int = 2, share: float = 0.6) -> DataFrame:
    """The class most of a node's threads have, with at least ``least_votes`` votes and that share of all its threads, else 0: (node, class); the lower class on a tie."""
    nt = node_threads(threads)
    votes = nt.join(thread_class.where(F.col("class") != 0), "thread_id").groupBy("node", "class").agg(F.count("*").alias("votes"))
    best = votes.groupBy("node").agg(F.max(F.struct("votes", (-F.col("class")).alias("c"))).alias("b"))
    total = nt.groupBy("node").agg(F.count("*").alias("n"))
    good = (F.col("b.votes") >= least_votes) & (F.col("b.votes") >= F.lit(share) * F.col("n"))
    return total.join(best, "node", "left").select("node", F.when(good, -F.col("b.c")).otherwise(0).cast("long").alias("class"))


def p_in_q(threads: DataFrame, node_class: DataFrame, p: int, q: int) -> DataFrame:
    """(thread_id, class) of classes that hold ``p`` of some ``q`` consecutive places of a thread."""
    t = renumber(threads).select("thread_id", "idx", F.abs("node").alias("node")).join(node_class.where(F.col("class") != 0), "node")
    w = Window.partitionBy("thread_id", "class").orderBy("idx")
    return t.withColumn("span", F.col("idx") - F.lag("idx", p - 1).over(w) if p > 1 else F.lit(0)).where(F.col("span") < q).select("thread_id", "class").distinct()


def thread_classes(threads: DataFrame, node_class: DataFrame, p: int = 10, q: int = 12) -> DataFrame:
    """The class of more than half of a thread's places, else the only class with ``p`` in ``q``, else 0: (thread_id, class)."""
    t = threads.select("thread_id", F.abs("node").alias("node")).join(node_class, "node", "left").na.fill(0, ["class"])
    n = t.groupBy("thread_id", "class").agg(F.count("*").alias("n"))
    half = n.groupBy("thread_id").agg(F.sum("n").alias("all"), F.max(F.when(F.col("class") != 0, F.struct("n", (-F.col("class")).alias("c")))).alias("b"))
    runs = p_in_q(threads, node_class, p, q).groupBy("thread_id").agg(F.count("*").alias("k"), F.min("class").alias("only"))
    label = F.when(2 * F.col("b.n") > F.col("all"), -F.col("b.c")).when(F.col("k") == 1, F.col("only")).otherwise(0)
    return half.join(runs, "thread_id", "left").select("thread_id", F.coalesce(label, F.lit(0)).cast("long").alias("class"))


def class_bridges(threads: DataFrame, node_class: DataFrame, p: int, q: int) -> DataFrame:
    """(thread_id, class_a, class_b) of threads with exactly two classes that hold ``p`` in ``q``."""
    g = p_in_q(threads, node_class, p, q).groupBy("thread_id").agg(F.count("*").alias("k"), F.min("class").alias("class_a"), F.max("class").alias("class_b"))
    return g.where("k = 2").select("thread_id", "class_a", "class_b")


def unclassified_threads(threads: DataFrame, node_class: DataFrame, thread_class: DataFrame, least_nodes: int, share: float) -> DataFrame:
    """P5: (thread_id, places, classified): threads of class 0 with enough places, fewer than ceil(share * places) of them on classified nodes."""
    t = threads.select("thread_id", F.abs("node").alias("node")).join(node_class, "node", "left").na.fill(0, ["class"])
    g = t.groupBy("thread_id").agg(F.count("*").alias("places"), F.sum((F.col("class") != 0).cast("int")).cast("long").alias("classified"))
    free = thread_class.where("class = 0").select("thread_id")
    return g.join(free, "thread_id", "left_semi").where((F.col("places") >= least_nodes) & (F.col("classified") < F.ceil(F.lit(share) * F.col("places"))))


def new_partition(threads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, class) and (thread_id, class) of all nodes and threads, none classified yet."""
    nt = node_threads(threads)
    return reset_classes(nt.select("node").distinct()), reset_classes(nt.select("thread_id").distinct())


def switch_classes(classes: DataFrame, changes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The classes after changes (key, class) of known keys, and the keys whose class is another now; ``key`` is ``node`` or ``thread_id``."""
    j = classes.join(changes.select(key, F.col("class").alias("__new")).dropDuplicates([key]), key, "left")
    return j.select(key, F.coalesce("__new", "class").alias("class")), j.where("__new is not null and __new <> class").select(key)


def to_evaluate(threads: DataFrame, changed: DataFrame) -> DataFrame:
    """(thread_id) of the threads through changed nodes (column ``node``), or (node) of the nodes on changed threads (column ``thread_id``)."""
    key = "node" if "node" in changed.columns else "thread_id"
    return node_threads(threads).join(changed.select(key).distinct(), key, "left_semi").select("thread_id" if key == "node" else "node").distinct()


def class_of(classes: DataFrame, key: str, value: int) -> int:
    """The class of a node or thread, -1 if it is unknown."""
    row = classes.where(F.col(key) == value).select("class").first()
    return -1 if row is None else row[0]


#: Threads on hot nodes that go to every task as one array, and the least threads that make a node hot; other nodes send theirs along with each of their places.
LOCAL_THREADS, HOT_THREADS = 1 << 22, 64


def _held_out(name: int, nodes: list[int], lists: list[np.ndarray], packed, ids: np.ndarray, support: int) -> bool:
    """Whether no two places after the middle of a thread follow one another that fewer than ``support`` threads support.

    ``packed`` gives the bits, over ``ids``, of the threads of a hot node, or none; of other nodes ``lists`` has them. Threads met at such a place, and the thread itself, are counted one by
    one (``listed`` and ``hot`` times so far), all others on hot nodes only: bit j of ``level[k]`` tells that ``ids[j]`` was met k times there.
    """
    bits = [packed(x) for x in nodes]
    own, at = np.unique(np.concatenate([*lists, [name]]), return_inverse=True)
    ends = np.cumsum([len(x) for x in lists])
    counts, listed, hot = own != name, np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
    if any(x is not None for x in bits):
        spot = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
        known, word, shift = ids[spot] == own, spot >> 6, (spot & 63).astype(np.uint64)
        level = np.zeros((support + 1, -(-len(ids) // 64)), np.uint64)
        level[0] = ~np.uint64(0)
    alone = False
    for i, m in enumerate(bits):
        late = i > len(nodes) // 2
        if m is None:
            here = at[ends[i] - len(lists[i]) : ends[i]]
            good = late and np.count_nonzero(counts[here] & (listed[here] + hot[here] >= support))
            listed[here] += 1
        else:
            here = known & ((m[word] >> shift) & np.uint64(1) == 1)
            good = late and int(np.bitwise_count(level[support] & m).sum()) - np.count_nonzero(here & (hot >= support)) + np.count_nonzero(here & counts & (listed + hot >= support))
            for k in range(support, 0, -1):
                level[k] |= level[k - 1] & m
            hot += here
        if late and good < support and alone:
            return False
        alone = late and good < support
    return True


def _supported(shared, support: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, offsets, held = shared.value
        ids = np.unique(np.concatenate([held, -held]))
        place = {n: i for i, n in enumerate(hot.tolist())}
        made: dict[int, np.ndarray] = {}
        of = lambda x: held[offsets[place[abs(x)]] : offsets[place[abs(x)] + 1]] * (1 if x > 0 else -1)

        def packed(x: int) -> np.ndarray | None:
            # bits only where they take no more room than the ids
            if x not in made and (i := place.get(abs(x))) is not None and 64 * (offsets[i + 1] - offsets[i]) >= len(ids):
                flags = np.zeros(-(-len(ids) // 64) * 64, np.uint8)
                flags[np.searchsorted(ids, of(x))] = 1
                made[x] = np.packbits(flags, bitorder="little").view(np.uint64)
            return made.get(x)

        none = np.zeros(0, np.int64)
        name, nodes, lists = None, [], []
        for batch in batches:
            names, signed, arrays = (batch.column(batch.schema.get_field_index(c)) for c in ("thread_id", "node", "held"))
            ends, values = arrays.offsets.to_numpy(), arrays.values.to_numpy()
            good = []
            for i, (t, x) in enumerate(zip(names.to_pylist(), signed.to_pylist())):
                if t != name:
                    if nodes and _held_out(name, nodes, lists, packed, ids, support):
                        good.append(name)
                    name, nodes, lists = t, [], []
                nodes.append(x)
                if abs(x) in place:
                    lists.append(none if packed(x) is not None else of(x))
                else:
                    lists.append(values[ends[i] : ends[i + 1]] * (1 if x > 0 else -1))
            yield pa.RecordBatch.from_arrays([pa.array(good, pa.int64())], names=["thread_id"])
        if nodes and _held_out(name, nodes, lists, packed, ids, support):
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64())], names=["thread_id"])

    return run


def supported_threads(threads: DataFrame, asked: DataFrame, support: int) -> DataFrame:
    """Those of the asked threads (column ``thread_id``) whose second half other threads bear out: (thread_id).

    At each of its places another thread that holds the node in the same orientation has been met before at as many places as the two share; it supports the place
    if these are at least ``support``. A thread fails where two places after its middle follow one another that fewer than ``support`` threads support.

    Threads that meet are not paired, which a hot node squares: a thread is judged within its task. The threads of hot nodes, ``LOCAL_THREADS`` at most, go to
    every task, those of another node come with each of its places.
    """
    spark = threads.sparkSession
    held = persisted(node_threads(threads, oriented=True).select("node", F.col("thread_id").cast("long").alias("thread_id")), "held")
    size = held.groupBy("node").agg(F.count("*").alias("n"))
    least, kept = 62, 0  # nodes on 2^least threads or more are hot
    for r in size.groupBy((F.length(F.bin("n")) - 1).alias("power")).agg(F.sum("n").alias("all")).orderBy(F.desc("power")).collect():
        if (kept := kept + r["all"]) > LOCAL_THREADS or 2 ** (r["power"] + 1) <= HOT_THREADS:
            break
        least = r["power"]
    hot = size.where(F.col("n") >= max(HOT_THREADS, 2**least)).select("node")
    t = held.join(hot, "node", "left_semi").toArrow()
    a, b = (t.column(c).to_numpy().astype(np.int64) for c in ("node", "thread_id"))
    order = np.argsort(a, kind="stable")
    names, begin = np.unique(a[order], return_index=True)
    shared = spark.sparkContext.broadcast((names, np.append(begin, len(a)), b[order]))
    few = held.join(hot, "node", "left_anti").groupBy("node").agg(F.collect_list("thread_id").alias("held")).withColumnRenamed("node", "__node")
    mine = threads.join(asked.select("thread_id").distinct(), "thread_id", "left_semi").select(F.col("thread_id").cast("long").alias("thread_id"), "idx", "node")
    met = mine.join(few, F.abs("node") == F.col("__node"), "left").select("thread_id", "idx", "node", F.coalesce("held", F.array().cast("array<bigint>")).alias("held"))
    placed = met.repartition(4 * shuffle_width(spark), "thread_id").sortWithinPartitions("thread_id", "idx").select("thread_id", "node", "held")
    return placed.mapInArrow(_supported(shared, support), "thread_id long").hint("merge")


def new_class_from_thread(threads: DataFrame, node_class: DataFrame, thread_class: DataFrame, thread: int) -> tuple[DataFrame, DataFrame, int]:
    """Gives a thread, and its nodes without a class, the next class that neither nodes nor threads have: (node_class, thread_class, that class)."""
    top = node_class.select("class").unionByName(thread_class.select("class")).agg(F.max("class")).first()[0] or 0
    made = max(0, top) + 1
    free = node_class.where("class = 0").join(node_threads(threads).where(F.col("thread_id") == thread).select("node"), "node", "left_semi")
    nodes, _ = switch_classes(node_class, free.select("node", F.lit(made).cast("long").alias("class")), "node")
    own, _ = switch_classes(thread_class, thread_class.where(F.col("thread_id") == thread).select("thread_id", F.lit(made).cast("long").alias("class")), "thread_id")
    return nodes, own, made


def reset_classes(classes: DataFrame) -> DataFrame:
    """All keys with class 0."""
    return classes.withColumn("class", F.lit(0).cast("long"))


def order_from_class(threads: DataFrame, node_class: DataFrame, thread_class: DataFrame, klass: int, least_threads: int = 7) -> DataFrame:
    """An order of the nodes of a class: (order_id, node, coord).

    The least node of the class with ``least_threads`` threads begins, forward, with its threads of the class. Then nodes that two placed threads hold in one orientation
    and threads that hold two placed nodes are placed, forward where both would do, until none is left; the nodes get coordinates over the placed threads. Empty without such a node.
    """
    mine = node_class.where(F.col("class") == klass).select("node")
    own = thread_class.where(F.col("class") == klass).select("thread_id")
    both = threads.join(own, "thread_id", "left_semi").join(mine.withColumnRenamed("node", "__n"), F.abs("node") == F.col("__n"), "left_semi").select("thread_id", "node").distinct()
    step = persisted(both.unionByName(both.select((-F.col("thread_id")).alias("thread_id"), (-F.col("node")).alias("node"))).distinct(), "class")
    start = node_threads(threads).join(mine, "node", "left_semi").groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") >= least_threads).agg(F.min("node").alias("node")).where("node is not null")

    def fresh(votes: DataFrame, key: str, placed: DataFrame) -> DataFrame:
        new = votes.where("n >= 2").join(placed.select(F.abs(key).alias("__k")).distinct(), F.abs(key) == F.col("__k"), "left_anti")
        return new.groupBy(F.abs(key).alias("__k")).agg(F.max(key).alias(key)).select(key)

    nodes = persisted(start.select("node"), "class")
    runs = persisted(step.join(nodes, "node", "left_semi").select("thread_id").distinct(), "class")
    size = -1
    while (now := nodes.count() + runs.count()) != size:
        size = now
        more = step.join(runs, "thread_id", "left_semi").groupBy("node").agg(F.count("*").alias("n"))
        nodes = persisted(nodes.unionByName(fresh(more, "node", nodes)), "class")
        seen = step.join(nodes, "node", "left_semi").groupBy("thread_id").agg(F.count("*").alias("n"))
        runs = persisted(runs.unionByName(fresh(seen, "thread_id", runs)), "class")
    held = threads.join(runs.select(F.abs("thread_id").alias("thread_id")), "thread_id", "left_semi").join(nodes.select(F.abs("node").alias("__n")), F.abs("node") == F.col("__n"), "left_semi")
    return grow_orders(persisted(held, "class"), start.select(F.lit(klass).cast("long").alias("order_id"), "node", F.lit(0).cast("long").alias("coord")), 1, 0.0)


def propagate(threads: DataFrame, node_class: DataFrame, least_votes: int = 2, share: float = 0.6, p: int = 10, q: int = 12, rounds: int | None = None) -> DataFrame:
    """Node classes after threads and nodes have classified one another until nothing changes: (node, class). A class once given stays, which makes it end."""

    def step(nc: DataFrame) -> DataFrame:
        tc = thread_classes(threads, nc, p, q)
        new = node_classes(threads, tc, least_votes, share).select("node", F.col("class").alias("fresh"))
        return nc.join(new, "node", "full_outer").select("node", F.when(F.coalesce("class", F.lit(0)) != 0, F.col("class")).otherwise(F.coalesce("fresh", F.lit(0))).cast("long").alias("class"))

    return fixpoint(node_class.select("node", F.col("class").cast("long").alias("class")), step, lambda df: (df.where("class <> 0").count(),), rounds)


def grow_cluster(threads: DataFrame, start: DataFrame, least_threads: int = 2, share: float = 0.6, p: int = 3, q: int = 5, rounds: int | None = None) -> DataFrame:
    """P10: nodes (column ``node``) grown from ``start``: a thread is happy with ``p`` of ``q`` places in the cluster, a node with at least max(``least_threads``, share) of its threads happy."""

    def step(cluster: DataFrame) -> DataFrame:
        happy = p_in_q(threads, cluster.withColumn("class", F.lit(1)), p, q).select("thread_id").withColumn("class", F.lit(1))
        new = node_classes(threads, happy, least_threads, share).where("class = 1").select("node")
        return cluster.unionByName(new).distinct()

    return fixpoint(start.select("node").distinct(), step, lambda df: (df.count(),), rounds)


def local_order(coords: DataFrame) -> DataFrame:
    """Ranks of the nodes of each order by coordinate: (order_id, node, coord, pos), pos 1.. and negative for reversed nodes.

    Rows are laid out by range of order and coordinate, so an order as long as a chromosome spreads over tasks; what is added up per order is one count for each of its partitions.
    """
    keys = ["order_id", "coord", "node"]
    t = coords.select("order_id", F.abs("node").alias("node"), "coord", F.signum("node").cast("long").alias("sign"))
    laid = persisted(t.repartitionByRange(shuffle_width(coords.sparkSession), *keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()), "order")
    laid = laid.withColumn("__part", F.shiftright("__at", 33))
    g = laid.groupBy("order_id", "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__low"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("order_id").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = laid.join(g.select("order_id", "__part", "__low", before.alias("__before")), ["order_id", "__part"])
    return placed.select("order_id", "node", "coord", (F.col("sign") * (F.col("__before") + F.col("__at") - F.col("__low") + 1)).alias("pos"))


def place_nodes(threads: DataFrame, coords: DataFrame, least_links: int = 1) -> DataFrame:
    """Coordinates of nodes not yet in an order, from the threads they share with placed ones: (order_id, node, coord, links).

    A placed node of matching orientation puts every other position of its thread at its own coordinate plus their distance on
    the thread; the new coordinate is the upper median over at least ``least_links`` of these.
    """
    known = coords.select("order_id", F.col("node").alias("k"), F.col("coord").alias("kc"))
    at = threads.join(known, F.abs("node") == F.abs("k"))
    turn = F.when(F.col("node") == F.col("k"), 1).otherwise(-1)
    seen = at.select("order_id", "thread_id", "kc", F.when(turn == 1, F.col("start_pos")).otherwise(F.col("end_pos")).alias("ks"), turn.alias("turn"))
    j = seen.join(threads.select("thread_id", "node", "start_pos", "end_pos"), "thread_id")
    coord = F.when(F.col("turn") == 1, F.col("kc") + F.col("start_pos") - F.col("ks")).otherwise(F.col("kc") + F.col("ks") - F.col("end_pos"))
    offers = j.select("order_id", (F.col("turn") * F.col("node")).alias("node"), coord.cast("long").alias("coord"))
    placed = coords.select(F.col("order_id").alias("__o"), F.abs("node").alias("__k"))
    fresh = offers.join(placed, (F.col("order_id") == F.col("__o")) & (F.abs("node") == F.col("__k")), "left_anti")
    g = upper_medians(fresh, ["order_id", "node"], "coord", "coord", "links")
    return g.where(F.col("links") >= least_links)


def happiness(threads: DataFrame, coords: DataFrame) -> DataFrame:
    """Per order and thread the places on placed nodes and their share: (order_id, thread_id, placed, happiness)."""
    total = threads.groupBy("thread_id").agg(F.count("*").alias("n"))
    held = threads.join(coords.select("order_id", F.abs("node").alias("k")).distinct(), F.abs("node") == F.col("k")).groupBy("order_id", "thread_id").agg(F.count("*").alias("placed"))
    return held.join(total, "thread_id").select("order_id", "thread_id", "placed", (F.col("placed") / F.col("n")).alias("happiness"))


def grow_orders(threads: DataFrame, coords: DataFrame, least_links: int = 2, least_happiness: float = 0.3, rounds: int | None = None) -> DataFrame:
    """Orders grown by placing nodes over happy threads until none is added (all orders at once): (order_id, node, coord)."""

    def step(c: DataFrame) -> DataFrame:
        happy = happiness(threads, c).where(F.col("happiness") >= least_happiness).select("order_id", "thread_id")
        offered = place_nodes(threads.join(happy.select("thread_id").distinct(), "thread_id", "left_semi"), c, least_links)
        new = offered.groupBy("order_id", F.abs("node").alias("n")).agg(F.max(F.struct("links", "node", "coord")).alias("b")).select("order_id", F.col("b.node").alias("node"), F.col("b.coord").alias("coord"))
        return c.unionByName(new)

    return fixpoint(coords.select("order_id", "node", F.col("coord").cast("long").alias("coord")), step, lambda df: (df.count(),), rounds)


def shared_order_nodes(coords: DataFrame, least: int = 1) -> DataFrame:
    """(a, b, shared, share): orders that share nodes and the share of the smaller one; candidates for merging."""
    n = coords.select("order_id", F.abs("node").alias("n")).distinct()
    size = n.groupBy("order_id").agg(F.count("*").alias("size"))
    j = n.select(F.col("order_id").alias("a"), "n").join(n.select(F.col("order_id").alias("b"), "n"), "n").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
    j = j.join(size.select(F.col("order_id").alias("a"), F.col("size").alias("sa")), "a").join(size.select(F.col("order_id").alias("b"), F.col("size").alias("sb")), "b")
    return j.select("a", "b", "shared", (F.col("shared") / F.least("sa", "sb")).alias("share"))


def mixed_orders(coords: DataFrame, links: DataFrame, window: int = 50, share: float = 0.2, ahead: int = 8, tail: int = 10) -> DataFrame:
    """(order_id) of orders in which some ``window`` neighbouring places hold at least ``share`` nodes not linked with the next one.

    A node's gap is the number of places, up to ``ahead``, to the first node it is linked with; the last ``tail`` places are not judged, and a window begins at a place that fails.
    """
    w = Window.partitionBy("order_id").orderBy("coord", F.abs("node"))
    t = coords.select("order_id", "node", F.row_number().over(w).alias("at"), F.count("*").over(Window.partitionBy("order_id")).alias("n"), F.lead("node").over(w).alias("nx"))
    linked = next_nodes(links).select("node", F.col("next_node").alias("nx")).distinct().withColumn("linked", F.lit(True))
    judged = t.where(F.col("at") <= F.col("n") - tail).join(linked, ["node", "nx"], "left").withColumn("fails", F.col("linked").isNull())
    run = Window.partitionBy("order_id").orderBy("at").rowsBetween(0, window - 1)
    counted = judged.withColumn("failed", F.sum(F.col("fails").cast("int")).over(run)).withColumn("width", F.count("*").over(run))
    return counted.where(F.col("fails") & (F.col("width") == window) & (F.col("failed") >= F.lit(share * window))).select("order_id").distinct()


def remove_mixed(coords: DataFrame, links: DataFrame, window: int = 50, share: float = 0.2) -> DataFrame:
    """Orders without the mixed ones."""
    return coords.join(mixed_orders(coords, links, window, share), "order_id", "left_anti")


def merge_orders(threads: DataFrame, coords: DataFrame, links: DataFrame | None = None, more_than: int = 100, whole: float = 0.99, window: int = 50, share: float = 0.2) -> DataFrame:
    """Orders merged pairwise as long as two share more than ``more_than`` nodes in one orientation: (order_id, node, coord).

    In each round the pairs that are each other's best (largest share of the smaller order, then least ids) are tried at once: the nodes of the second order are
    placed in the first one by the threads. A merge holds if the two reach ``whole`` of their different nodes and the result is not mixed (judged where ``links`` are given); it
    keeps the lower id. If it fails, an order ``whole`` of whose nodes the other holds is dropped, else the pair is not tried again.
    """
    state = persisted(coords.select("order_id", "node", F.col("coord").cast("long").alias("coord")), "orders")
    failed = persisted(coords.select(F.col("order_id").alias("a"), F.col("order_id").alias("b")).limit(0), "orders")
    while True:
        size = state.groupBy("order_id").agg(F.count("*").alias("size"))
        left, right = state.select(F.col("order_id").alias("a"), "node"), state.select(F.col("order_id").alias("b"), F.col("node").alias("m"))
        both = left.join(right, F.abs("node") == F.abs("m")).where("a < b").groupBy("a", "b", (F.col("node") != F.col("m")).alias("turned")).agg(F.count("*").alias("shared")).where(F.col("shared") > more_than)
        both = both.join(failed, ["a", "b"], "left_anti").join(size.select(F.col("order_id").alias("a"), F.col("size").alias("sa")), "a").join(size.select(F.col("order_id").alias("b"), F.col("size").alias("sb")), "b")
        rated = both.withColumn("rate", F.struct((F.col("shared") / F.least("sa", "sb")).alias("share"), (-F.col("a")).alias("x"), (-F.col("b")).alias("y"), (~F.col("turned")).alias("z")))
        top = rated.select(F.explode(F.array("a", "b")).alias("o"), "rate").groupBy("o").agg(F.max("rate").alias("best"))
        best = rated.join(top.select(F.col("o").alias("a"), F.col("best").alias("ba")), "a").join(top.select(F.col("o").alias("b"), F.col("best").alias("bb")), "b").where("rate = ba and rate = bb")
        pairs = persisted(best.select("a", "b", "turned", "shared", "sa", "sb"), "orders")
        if pairs.isEmpty():
            return state
        mine = state.join(pairs.select(F.col("a").alias("order_id")), "order_id", "left_semi")
        wanted = state.join(pairs.select("a", F.col("b").alias("order_id"), "turned"), "order_id").select("a", F.when(F.col("turned"), -F.col("node")).otherwise(F.col("node")).alias("node"))
        asked = persisted(wanted.select(F.col("a").alias("order_id"), "node"), "orders")

        def place(c: DataFrame, asked: DataFrame = asked) -> DataFrame:
            return c.unionByName(place_nodes(threads, c, 1).join(asked, ["order_id", "node"], "left_semi").select("order_id", "node", "coord"))

        grown = fixpoint(mine, place, lambda df: (df.count(),))
        reached = grown.groupBy(F.col("order_id").alias("a")).agg(F.count("*").alias("n"))
        mixed = mixed_orders(grown, links, window, share).select(F.col("order_id").alias("a"), F.lit(True).alias("mixed")) if links is not None else pairs.select("a").limit(0).withColumn("mixed", F.lit(True))
        fate = persisted(pairs.join(reached, "a").join(mixed, "a", "left").withColumn("good", (F.col("n") >= F.lit(whole) * (F.col("sa") + F.col("sb") - F.col("shared"))) & F.col("mixed").isNull()), "orders")
        merged, lost = fate.where("good"), fate.where("not good")
        inside = lost.where(F.least("sa", "sb") * F.lit(whole) < F.col("shared")).select(F.when(F.col("sa") > F.col("sb"), F.col("b")).otherwise(F.col("a")).alias("order_id"))
        gone = merged.select(F.explode(F.array("a", "b")).alias("order_id")).unionByName(inside).distinct()
        after = state.join(gone, "order_id", "left_anti").unionByName(grown.join(merged.select(F.col("a").alias("order_id")), "order_id", "left_semi"))
        tabu = failed.unionByName(lost.join(inside.select(F.col("order_id").alias("a")), "a", "left_anti").join(inside.select(F.col("order_id").alias("b")), "b", "left_anti").select("a", "b"))
        after, failed = persisted(after, "orders"), persisted(tabu, "orders")
        discard(state)
        state = after


def next_winners(votes: DataFrame, least_total: int = 2, share: float = 0.75) -> DataFrame:
    """Of (node, other, votes), the neighbour with at least that share of all votes for the node: (node, other)."""
    g = votes.groupBy("node").agg(F.sum("votes").alias("total"), F.max(F.struct("votes", (-F.col("other")).alias("o"))).alias("b"))
    return g.where((F.col("total") >= least_total) & (F.col("b.votes") >= F.lit(share) * F.col("total"))).select("node", (-F.col("b.o")).alias("other"))


def stride(winners: DataFrame, starts: DataFrame, steps: int) -> DataFrame:
    """Walks from each start along the winners, at most ``steps`` steps, ending before a node comes twice: (node, path)."""
    state = starts.select("node", F.array("node").alias("path")).withColumn("on", F.lit(True))
    for _ in range(steps):
        w = winners.select(F.col("node").alias("tail"), F.col("other").alias("nxt"))
        j = state.withColumn("tail", F.element_at("path", -1)).join(w, "tail", "left")
        go = F.col("on") & F.col("nxt").isNotNull() & ~F.array_contains("path", F.col("nxt"))
        state = j.select("node", F.when(go, F.concat("path", F.array("nxt"))).otherwise(F.col("path")).alias("path"), F.coalesce(go, F.lit(False)).alias("on"))
    return state.select("node", F.slice("path", 2, steps).alias("path"))
