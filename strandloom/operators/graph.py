"""The distance graph: nodes, signed links, mutation and local topology.

A link (source, dest, dist) joins the end ``source`` of one node to the end ``dest``
of another; links are kept once, :func:`mirrored` gives both copies. From node ``n``
onwards go the links of source ``-n``; node ``n``'s previous nodes are ``-dest`` of
the links of source ``n``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.kmers import canonical, rc
from strandloom.functions.seq import trunc_medians
from strandloom.session import numbered, persisted, shuffle_width

MAX_DISTANCE = 2**31 - 1


def mirrored(links: DataFrame) -> DataFrame:
    """Every link in both directions, in one pass; a link of an end with itself once."""
    both = F.when(F.col("source") == F.col("dest"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    turned = links.withColumn("__turn", F.explode(both))
    rest = [c for c in links.columns if c not in ("source", "dest")]
    turn = F.col("__turn") == 1
    return turned.select(F.when(turn, F.col("dest")).otherwise(F.col("source")).alias("source"), F.when(turn, F.col("source")).otherwise(F.col("dest")).alias("dest"), *rest)


@dataclass(frozen=True)
class Graph:
    """Immutable: every change gives a new graph over new DataFrames. ``nodes`` has node_id, seq; ``links`` source, dest, dist."""

    nodes: DataFrame
    links: DataFrame

    def add_nodes(self, seqs: DataFrame, make_canonical: bool = True) -> tuple[Graph, DataFrame]:
        """G1: appends sequences (column ``seq``) in order of sequence; also gives (seq, node_id), negative where the stored one is reversed."""
        last = self.nodes.agg(F.max("node_id")).first()[0] or 0
        stored = seqs.select("seq", canonical(F.col("seq")).alias("kept") if make_canonical else F.col("seq").alias("kept"))
        made = numbered(stored, "rank", "kept", "seq").select("seq", "kept", (F.lit(last) + F.col("rank") + 1).alias("id"))
        given = made.select("seq", F.when(F.col("seq") == F.col("kept"), F.col("id")).otherwise(-F.col("id")).alias("node_id"))
        return replace(self, nodes=self.nodes.unionByName(made.select(F.col("id").alias("node_id"), F.col("kept").alias("seq")), allowMissingColumns=True)), given

    def remove_nodes(self, gone: DataFrame) -> Graph:
        """Removes nodes (column ``node_id``) with all their links."""
        g = gone.select(F.abs("node_id").alias("__gone")).distinct()
        return Graph(self.nodes.join(g, F.col("node_id") == F.col("__gone"), "left_anti"), _without(self.links, g))

    def disconnect(self, nodes: DataFrame) -> Graph:
        """Removes the links of nodes at both ends."""
        return replace(self, links=_without(self.links, nodes.select(F.abs("node_id").alias("__gone")).distinct()))

    def add_links(self, links: DataFrame) -> Graph:
        """Appends links once each (parallel links stay)."""
        return replace(self, links=self.links.unionByName(links, allowMissingColumns=True))

    def remove_links(self, gone: DataFrame, exact: bool = False) -> Graph:
        """Removes all links between the given ends in either direction; with ``exact`` only those of equal dist (null-safe)."""
        keys = ["source", "dest", *(["dist"] if exact else [])]
        g = mirrored(gone.select(*keys).distinct()).select(*(F.col(c).alias(f"__{c}") for c in keys))
        match = F.lit(True)
        for c in keys:
            match = match & F.col(c).eqNullSafe(F.col(f"__{c}"))
        return replace(self, links=self.links.join(g, match, "left_anti"))


def _without(links: DataFrame, gone: DataFrame) -> DataFrame:
    kept = links.join(gone, F.abs("source") == F.col("__gone"), "left_anti")
    return kept.join(gone, F.abs("dest") == F.col("__gone"), "left_anti")


def next_nodes(links: DataFrame) -> DataFrame:
    """(node, next_node, dist) of both orientations of every node; previous nodes are the next ones of -node, negated."""
    return mirrored(links).select((-F.col("source")).alias("node"), F.col("dest").alias("next_node"), "dist")


def link_summary(links: DataFrame) -> DataFrame:
    """(source, dest, link_count, min_dist) over both copies of the links."""
    return mirrored(links).groupBy("source", "dest").agg(F.count("*").alias("link_count"), F.min("dist").alias("min_dist"))


def is_sane(stored: DataFrame) -> DataFrame:
    """Stored copies (both directions) that lack their mirror: empty for a sane graph."""
    m = stored.select(F.col("source").alias("d"), F.col("dest").alias("s")).distinct()
    return stored.join(m, (F.col("source") == F.col("s")) & (F.col("dest") == F.col("d")), "left_anti")


#: Distinct steps of a graph that go to every task as one array of neighbours; over a larger graph every hop is a join.
LOCAL_STEPS = 1 << 22


def _reached(shared, radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, offsets, to = shared.value
        size = np.diff(offsets)
        seen = np.zeros(len(ids), bool)

        def from_one(at: int) -> np.ndarray:
            front, found = np.array([at]), []
            for _ in range(radius):
                n = size[front]
                ahead = to[np.repeat(offsets[front] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                if len(ahead) * 16 < len(ids):
                    front = np.unique(ahead)
                    front = front[~seen[front]]
                    seen[front] = True
                else:
                    before = seen.copy()
                    seen[ahead] = True
                    front = np.flatnonzero(seen & ~before)
                found.append(front)
                if not len(front):
                    break
            all_ = np.concatenate(found)
            seen[all_] = False
            return all_

        names, parts, counts, rows = [], [], [], 0
        emit = lambda: pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(names, np.int64), counts)), pa.array(ids[np.concatenate(parts)])], names=["start", "node"])
        for batch in batches:
            starts = batch.column(0).to_numpy()
            for name, at in zip(starts, np.searchsorted(ids, starts)):
                if at < len(ids) and ids[at] == name:
                    found = from_one(at)
                    names.append(name)
                    parts.append(found)
                    counts.append(len(found))
                    rows += len(found)
                    if rows >= 1 << 18:
                        yield emit()
                        names, parts, counts, rows = [], [], [], 0
        if parts:
            yield emit()

    return run


def fw_reached(links: DataFrame, starts: DataFrame, radius: int) -> DataFrame:
    """(start, node) reached forward within ``radius`` hops; the start itself only where it is reached again.

    What hot nodes make each start reach is not shuffled: a start is walked within its task, over the distinct steps of the graph as one
    array. A graph of more than ``LOCAL_STEPS`` steps is joined hop by hop.
    """
    spark = links.sparkSession
    step = persisted(next_nodes(links).select("node", "next_node").distinct(), "reach")
    if radius < 1 or step.count() > LOCAL_STEPS:
        return reached_by_joins(step, starts, radius)
    t = step.toArrow()
    a, b = (t.column(c).to_numpy().astype(np.int64) for c in ("node", "next_node"))
    ids = np.unique(np.concatenate([a, b]))
    order = np.argsort(a, kind="stable")
    shared = spark.sparkContext.broadcast((ids, np.searchsorted(a[order], np.append(ids, np.iinfo(np.int64).max)), np.searchsorted(ids, b[order]).astype(np.int32)))
    spread = starts.select(F.col("node").cast("long")).distinct().repartition(8 * shuffle_width(spark), "node")
    return spread.mapInArrow(_reached(shared, radius), "start long, node long").hint("merge")


def reached_by_joins(step: DataFrame, starts: DataFrame, radius: int) -> DataFrame:
    """T3, as :func:`fw_reached`, by a join with the distinct steps (node, next_node) a hop."""
    front = starts.select(F.col("node").alias("start"), "node").distinct()
    found = None
    for _ in range(radius):
        front = front.join(step, "node").select("start", F.col("next_node").alias("node")).distinct()
        found = front if found is None else found.unionByName(front)
    return found.distinct() if found is not None else front.limit(0)


def fw_neighbours_by_distance(links: DataFrame, least: int) -> DataFrame:
    """T5: (node, other, dist, link_count): neighbours with at least ``least`` links and their truncated median distance."""
    g = trunc_medians(next_nodes(links).withColumnRenamed("next_node", "other"), ["node", "other"], "dist", "dist", "link_count")
    return g.where(F.col("link_count") >= least).select("node", "other", "dist", "link_count")


def ends(links: DataFrame) -> DataFrame:
    """(node, next_count, the only next node or null) for both orientations of every linked node; parallel links count once."""
    distinct = next_nodes(links).select("node", "next_node").distinct()
    return distinct.groupBy("node").agg(F.count("*").alias("next_count"), F.min("next_node").alias("lowest_next"))


def degrees(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node_id, prev_count, next_count, only_prev, only_next), 0 and null where there are none; counts of distinct neighbours."""
    e = ends(links)
    fw = e.where("node > 0").select(F.col("node").alias("node_id"), "next_count", F.when(F.col("next_count") == 1, F.col("lowest_next")).alias("only_next"))
    bw = e.where("node < 0").select((-F.col("node")).alias("node_id"), F.col("next_count").alias("prev_count"), F.when(F.col("next_count") == 1, -F.col("lowest_next")).alias("only_prev"))
    return nodes.select("node_id").join(fw, "node_id", "left").join(bw, "node_id", "left").na.fill(0, ["next_count", "prev_count"])


def tips(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes with one neighbour in all, whose neighbour has another link on that side: (node_id)."""
    d = degrees(nodes, links)
    lone = d.where("prev_count + next_count = 1").select("node_id", F.coalesce(-F.col("only_next"), F.col("only_prev")).alias("toward"))
    # leaving the neighbour back toward the node means going forward from -next or from prev
    return lone.join(ends(links).select(F.col("node").alias("toward"), F.col("next_count").alias("back")), "toward").where("back > 1").select("node_id")


def _neighbourhoods(links: DataFrame) -> DataFrame:
    """(node, around): a name for the sets of previous and of next nodes of each oriented node that has both.

    Counts, sums and order-free hashes of the two sets, so nothing but numbers is kept of a hub's neighbours: two sums of 64-bit hashes for each side.
    """
    step = next_nodes(links).select("node", "next_node").distinct()
    names = lambda sign: [F.count("*").alias("n"), *(F.sum(F.xxhash64(F.lit(i), F.lit(sign) * F.col("next_node")).cast("decimal(38,0)")).alias(f"h{i}") for i in range(2))]
    fw = step.groupBy("node").agg(*names(1)).select("node", F.struct("n", "h0", "h1").alias("nexts"))
    bw = step.groupBy("node").agg(*names(-1)).select((-F.col("node")).alias("node"), F.struct("n", "h0", "h1").alias("prevs"))
    return fw.join(bw, "node").select("node", F.struct("prevs", "nexts").alias("around"))


def parallels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, parallel) oriented nodes with equal non-empty sets of previous and of next nodes."""
    s = _neighbourhoods(links)
    return s.join(s.select(F.col("node").alias("parallel"), "around"), "around").where("node <> parallel").select("node", "parallel")


def parallel_counts(links: DataFrame) -> DataFrame:
    """(node, parallels, lowest): how many parallels each oriented node has, if any, and the least one; groups are counted, not paired."""
    s = _neighbourhoods(links)
    g = s.groupBy("around").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high")).where("n > 1")
    least = F.when(F.col("node") == F.col("low"), F.when(F.col("n") == 2, F.col("high"))).otherwise(F.col("low"))
    return s.join(g, "around").select("node", (F.col("n") - 1).alias("parallels"), least.alias("lowest"))


def bubble_sides(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes with exactly one parallel and a single previous and next node, which have just these two between them: (node_id, parallel).

    As in the original, links are counted, so a neighbour linked twice is no single one. Parallels of nodes with one neighbour on either side are those
    with the very same two, so the neighbours themselves are compared, no hashes of them.
    """
    e = next_nodes(links).groupBy("node").agg(F.count("*").alias("n"), F.min("next_node").alias("only"))
    one = e.where("n = 1").select("node", F.col("only").alias("next"))
    lone = one.join(one.select((-F.col("node")).alias("node"), (-F.col("next")).alias("prev")), "node")
    pair = lone.groupBy("prev", "next").agg(F.count("*").alias("times"), F.min("node").alias("low"), F.max("node").alias("high")).where("times = 2")
    two = e.where("n = 2")
    pair = pair.join(two.select(F.col("node").alias("prev")), "prev", "left_semi").join(two.select((-F.col("node")).alias("next")), "next", "left_semi")
    side = pair.select(F.explode(F.array(F.struct(F.col("low").alias("node_id"), F.col("high").alias("parallel")), F.struct(F.col("high").alias("node_id"), F.col("low").alias("parallel")))).alias("s")).select("s.*").where("node_id > 0")
    return nodes.select("node_id").distinct().join(side, "node_id").select("node_id", "parallel")


def canonical_repeats(nodes: DataFrame, links: DataFrame, max_degree: int = 2) -> DataFrame:
    """Nodes of equal degree 2..max on both sides, whose neighbours are single on that side and all different: (node_id, degree)."""
    d = degrees(nodes, links).where((F.col("prev_count") == F.col("next_count")) & F.col("prev_count").between(2, max_degree)).select("node_id", F.col("prev_count").alias("degree"))
    step = next_nodes(links).select("node", "next_node").distinct()
    fw = step.join(d, F.col("node") == F.col("node_id")).select("node_id", "degree", F.col("next_node").alias("toward"), (-F.col("next_node")).alias("back"))
    bw = step.join(d, F.col("node") == -F.col("node_id")).select("node_id", "degree", (-F.col("next_node")).alias("toward"), (-F.col("next_node")).alias("back"))
    # seen from a next node the repeat is its only previous one, seen from a previous node its only next one
    around = fw.unionByName(bw).join(ends(links).select(F.col("node").alias("back"), "next_count"), "back")
    g = around.groupBy("node_id", "degree").agg(F.max("next_count").alias("most"), F.countDistinct(F.abs("toward")).alias("others"), F.max(F.abs("toward") == F.col("node_id")).alias("itself"))
    return g.where("most = 1 and others = 2 * degree and not itself").select("node_id", "degree")


def self_loops(nodes: DataFrame, links: DataFrame, include_circles: bool = False) -> DataFrame:
    """Nodes linked with themselves, which have another neighbour too unless ``include_circles``: (node_id)."""
    g = next_nodes(links).groupBy(F.abs("node").alias("node_id")).agg(F.max(F.abs("next_node") == F.abs("node")).alias("own"), F.max(F.abs("next_node") != F.abs("node")).alias("other"))
    return g.where("own" if include_circles else "own and other").select("node_id")


def connectivity(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes per kind of connection, 0, 1 or N on either side: (connectivity, nodes)."""
    side = lambda c: F.when(F.col(c) > 1, "N").otherwise(F.col(c).cast("string"))
    low, high = F.least(side("prev_count"), side("next_count")), F.greatest(side("prev_count"), side("next_count"))
    return degrees(nodes, links).groupBy(F.concat(low, F.lit("-"), high).alias("connectivity")).agg(F.count("*").alias("nodes"))


def connected_nodes(links: DataFrame) -> DataFrame:
    """Nodes with a link: (node_id)."""
    return links.select(F.explode(F.array(F.abs("source"), F.abs("dest"))).alias("node_id")).distinct()


def nstats(sizes: DataFrame, size: str = "size", points: tuple[int, ...] = (25, 50, 75), by: str | None = None) -> DataFrame:
    """The size at which the larger ones together reach p percent of the total: ([by,] point, nsize).

    Sizes are counted first, so the running sum goes over distinct sizes, not over rows.
    """
    part = [by] if by else []
    counted = sizes.groupBy(*part, size).agg((F.count("*") * F.col(size)).alias("bp"))
    w = Window.partitionBy(*part) if part else Window.partitionBy(F.lit(0))
    run = counted.withColumn("total", F.sum("bp").over(w)).withColumn("reached", F.sum("bp").over(w.orderBy(F.desc(size)).rowsBetween(Window.unboundedPreceding, 0)))
    at = run.withColumn("point", F.explode(F.array(*(F.lit(p) for p in points)))).where(F.col("reached") >= F.floor(F.col("total") * F.col("point") / 100))
    return at.groupBy(*part, "point").agg(F.max(size).alias("nsize"))


def stats_by_kci(nodes: DataFrame, links: DataFrame, kcis: DataFrame) -> DataFrame:
    """Per kci bin and over all: (bin, nodes, bp, tips, repeats, bubble_sides)."""
    k = F.col("kci")
    label = F.when(k.isNull() | (k == -1), "None").when(k < 0.5, "<0.5").when(k <= 1.5, "~1").when(k <= 2.5, "~2").when(k <= 3.5, "~3").otherwise(">3.5")
    flag = lambda df, n: df.select("node_id").distinct().withColumn(n, F.lit(1))
    t = nodes.select("node_id", F.length("seq").alias("size")).join(kcis.select("node_id", "kci"), "node_id", "left").withColumn("bin", label)
    for df, n in ((tips(nodes, links), "tip"), (canonical_repeats(nodes, links, 10), "repeat"), (bubble_sides(nodes, links), "side")):
        t = t.join(flag(df, n), "node_id", "left")
    t = t.na.fill(0, ["tip", "repeat", "side"])
    sums = [F.count("*").alias("nodes"), F.sum("size").cast("long").alias("bp"), F.sum("tip").cast("long").alias("tips"), F.sum("repeat").cast("long").alias("repeats"), F.sum("side").cast("long").alias("bubble_sides")]
    return t.rollup("bin").agg(*sums).na.fill("All", ["bin"])


def transitive_links(links: DataFrame, radius: int) -> DataFrame:
    """Links a -> c that a sibling b of c (a -> b) reaches within ``radius`` hops, while c does not reach b: (node, next_node).

    Every link walks on from its far end, so what is compared at a hub is what its neighbours reach, not every pair of them: c is reached from a sibling
    exactly if a walk a -> b -> ... -> c ends at a neighbour of a.
    """
    step = next_nodes(links).select("node", "next_node").distinct()
    reach = reached_by_joins(step, step.select(F.col("next_node").alias("node")).distinct(), radius)
    walks = step.select("node", F.col("next_node").alias("b")).join(reach.select(F.col("start").alias("b"), F.col("node").alias("c")), "b").where("b <> c")
    there = walks.join(step.select("node", F.col("next_node").alias("c")), ["node", "c"], "left_semi")
    back = there.join(reach.select(F.col("start").alias("c"), F.col("node").alias("b")), ["b", "c"], "left_anti")
    return back.select("node", F.col("c").alias("next_node")).distinct()


def remove_transitive_links(graph: Graph, radius: int) -> Graph:
    """The graph without its transitive links."""
    gone = transitive_links(graph.links, radius).select((-F.col("node")).alias("source"), F.col("next_node").alias("dest"))
    return graph.remove_links(gone)


def expand_nodes(graph: Graph, groups: DataFrame) -> tuple[Graph, DataFrame]:
    """Replaces nodes by copies, one per group of neighbours.

    ``groups`` has (node_id, grp, side, other): the ends ``other`` that the copy ``grp`` keeps on side ``bw`` or ``fw``; the lowest
    group that names an end gets it. Copies are numbered after the last node, in order of (node_id, grp). Also gives (node_id, grp, new_id).
    """
    g = groups.withColumn("rank", F.row_number().over(Window.partitionBy("node_id", "side", "other").orderBy("grp"))).where("rank = 1").drop("rank")
    copies = groups.select("node_id", "grp").distinct()
    last = graph.nodes.agg(F.max("node_id")).first()[0] or 0
    named = numbered(copies, "rank", "node_id", "grp").select("node_id", "grp", (F.col("rank") + 1 + last).alias("new_id"))
    placed = g.join(named, ["node_id", "grp"])
    own = mirrored(graph.links).withColumn("side", F.when(F.col("source") < 0, "fw").otherwise("bw"))
    moved = own.join(placed, (F.abs("source") == F.col("node_id")) & (own["side"] == placed["side"]) & (F.col("dest") == F.col("other"))).select((F.signum("source") * F.col("new_id")).cast("long").alias("source"), "dest", "dist")
    fresh = named.join(graph.nodes, "node_id").select(F.col("new_id").alias("node_id"), "seq")
    rest = graph.remove_nodes(copies.select("node_id").distinct())
    return Graph(rest.nodes.select("node_id", "seq").unionByName(fresh), rest.links.select("source", "dest", "dist").unionByName(moved)), named


def node_views(nodes: DataFrame, links: DataFrame, both: bool = False, include_disconnected: bool = True) -> DataFrame:
    """(node, size, seq, prev_count, next_count) of all nodes, with ``both`` in either orientation, else as stored; without ``include_disconnected`` of linked ones."""
    signs = F.array(F.lit(1), F.lit(-1)) if both else F.array(F.lit(1))
    t = nodes.select("node_id", "seq", F.explode(signs).alias("s")).select((F.col("node_id") * F.col("s")).alias("node"), F.length("seq").alias("size"), F.when(F.col("s") < 0, rc(F.col("seq"))).otherwise(F.col("seq")).alias("seq"))
    n = next_nodes(links).groupBy("node").agg(F.count("*").alias("n"))
    j = t.join(n.select("node", F.col("n").alias("next_count")), "node", "left").join(n.select((-F.col("node")).alias("node"), F.col("n").alias("prev_count")), "node", "left").na.fill(0, ["next_count", "prev_count"])
    j = j if include_disconnected else j.where("next_count + prev_count > 0")
    return j.select("node", "size", "seq", "prev_count", "next_count")


def node_view(nodes: DataFrame, links: DataFrame, node: int) -> DataFrame:
    """The view of one signed node; raises for 0 and for ids that are unknown or deleted."""
    if node == 0 or nodes.where(F.col("node_id") == abs(node)).isEmpty():
        raise ValueError(f"no such node: {node}")
    return node_views(nodes.where(F.col("node_id") == abs(node)), links.where((F.abs("source") == abs(node)) | (F.abs("dest") == abs(node))), both=True).where(F.col("node") == node)


def node_sequence(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, seq, size) of signed ids (column ``node``), reversed where negative."""
    n = ids.join(nodes.select("node_id", "seq"), F.abs("node") == F.col("node_id"))
    return n.select("node", F.when(F.col("node") < 0, rc(F.col("seq"))).otherwise(F.col("seq")).alias("seq"), F.length("seq").alias("size"))


def oldnames_to_nodes(names: DataFrame, node_names: DataFrame) -> DataFrame:
    """Signed ids of lists such as ``a+,b-`` (columns list_id, names): (list_id, place, node). Raises on a name that is unknown or has no sign, when run."""
    parts = names.select("list_id", F.posexplode(F.split("names", ",")).alias("place", "part"))
    said = parts.select("list_id", "place", F.expr("substring(part, 1, length(part) - 1)").alias("name"), F.when(F.col("part").endswith("-"), -1).when(F.col("part").endswith("+"), 1).alias("sign"))
    found = said.join(node_names.select(F.col("name"), "node_id"), "name", "left")
    known = F.when(F.col("sign").isNull() | F.col("node_id").isNull(), F.raise_error(F.concat(F.lit("no such signed node: "), F.col("name"))).cast("long")).otherwise(F.col("sign") * F.col("node_id"))
    return found.select("list_id", "place", known.alias("node"))
