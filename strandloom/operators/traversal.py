"""Walks over the graph: components, lines, paths, tangles.

Fixpoints are driver loops over DataFrames whose lineage is cut by a table written to the
shared folder (which, unlike a checkpoint, also drops the constraints that a planner would
otherwise multiply from round to round); pointer doubling makes the rounds grow with the
logarithm of the longest chain.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.kmers import canonical, rc
from strandloom.operators.graph import Graph, ends, mirrored, next_nodes, parallel_counts
from strandloom.session import discard, persisted

def fixpoint(start: DataFrame, step: Callable[[DataFrame], DataFrame], measure: Callable[[DataFrame], tuple], rounds: int | None = None) -> DataFrame:
    """Repeats ``step`` until ``measure`` (one small row) no longer changes; with ``rounds`` raises after so many. The tables of earlier rounds are deleted.

    ``fixpoint.rounds`` tells how many the last call took.
    """
    state = persisted(start, "step")
    before = measure(state)
    done = 0
    while rounds is None or done < rounds:
        after = persisted(step(state), "step")
        discard(state)
        state, now = after, measure(after)
        done += 1
        if now == before:
            fixpoint.rounds = done
            return state
        before = now
    raise RuntimeError(f"no fixpoint after {rounds} rounds")


fixpoint.rounds = 0


def components(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, component) of undirected edges (a, b); the component is its smallest id.

    Alternating large-star and small-star rounds. The star of a hot vertex is an aggregate
    (a minimum), never a gathered list.
    """

    def large(e: DataFrame) -> DataFrame:
        d = e.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        low = d.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        return d.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))

    def small(e: DataFrame) -> DataFrame:
        d = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = d.groupBy("a").agg(F.min("b").alias("m"))
        return d.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))

    def step(e: DataFrame) -> DataFrame:
        return small(large(e)).where("a <> b").distinct()

    start = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct()
    flat = fixpoint(start, step, lambda e: tuple(e.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()))
    found = flat.select(F.greatest("a", "b").alias("id"), F.least("a", "b").alias("component")).groupBy("id").agg(F.min("component").alias("component"))
    return vertices.select(F.col("id").cast("long")).distinct().join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def connected_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node_id, component) over unsigned nodes."""
    edges = links.select(F.abs("source").alias("a"), F.abs("dest").alias("b"))
    return components(edges, nodes.select(F.col("node_id").alias("id"))).withColumnRenamed("id", "node_id")


def _rooted(before: DataFrame, rounds: int) -> DataFrame:
    """(node, root, place, low): the first node of each node's chain, the steps from it, and the smallest unsigned node so far. The tables of earlier rounds are deleted.

    ``before`` has (node, prev), prev null at a chain's first node. Nodes of closed chains never reach a root; their root has a prev.
    """
    state = persisted(before.select("node", F.coalesce("prev", "node").alias("root"), F.col("prev").isNotNull().cast("long").alias("place"), F.least(F.abs("node"), F.abs("prev")).alias("low")), "step")
    done = -1
    for _ in range(rounds):
        jump = state.select(F.col("node").alias("root"), F.col("root").alias("root2"), F.col("place").alias("place2"), F.col("low").alias("low2"))
        after = persisted(state.join(jump, "root").select("node", F.col("root2").alias("root"), (F.col("place") + F.col("place2")).alias("place"), F.least("low", "low2").alias("low")), "step")
        discard(state)
        state = after
        now = state.agg(F.sum("place")).first()[0]
        if now == done:
            break
        done = now
    return state


def lines(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """T4: maximal chains in which each step is the only one in both directions: (line, place, node).

    ``line`` is the smallest unsigned node of the chain, which stands in it as positive; a node
    without such a step is a line of its own. A closed chain begins with its smallest node.
    """
    one = ends(links).where("next_count = 1").select("node", F.col("lowest_next").alias("nxt"))
    step = one.join(one.select((-F.col("node")).alias("nxt"), (-F.col("nxt")).alias("node")), ["node", "nxt"]).where("abs(node) <> abs(nxt)")
    every = nodes.select(F.explode(F.array(F.col("node_id"), -F.col("node_id"))).alias("node"))
    before = persisted(every.join(step.select(F.col("nxt").alias("node"), F.col("node").alias("prev")), "node", "left"), "step")
    rounds = 2 + math.ceil(math.log2(max(2, before.count())))
    state = _rooted(before, rounds)
    heads = before.where("prev is null").select(F.col("node").alias("root"))
    open_ = state.join(heads, "root", "left_semi")
    closed = state.join(heads, "root", "left_anti")
    if not closed.isEmpty():
        cut = closed.where("node = low").select("node").withColumn("cut", F.lit(True))
        again = persisted(before.join(closed.select("node"), "node", "left_semi").join(cut, "node", "left").select("node", F.when(F.col("cut").isNull(), F.col("prev")).alias("prev")), "step")
        open_ = open_.unionByName(_rooted(again, rounds).join(again.where("prev is null").select(F.col("node").alias("root")), "root", "left_semi"))
    named = open_.groupBy("root").agg(F.min_by("node", F.struct(F.abs("node"), -F.col("node"))).alias("line")).where("line > 0")
    return open_.select("root", "place", "node").join(named, "root").select("line", F.col("place").cast("int").alias("place"), "node")


def line_table(line_nodes: DataFrame, nodes: DataFrame, least_nodes: int = 1, least_size: int = 0) -> DataFrame:
    """T4: (line, node_count, total_size) of lines with enough nodes and size."""
    sized = line_nodes.join(nodes.select("node_id", F.length("seq").alias("size")), F.abs("node") == F.col("node_id"))
    g = sized.groupBy("line").agg(F.count("*").alias("node_count"), F.sum("size").cast("long").alias("total_size"))
    return g.where((F.col("node_count") >= least_nodes) & (F.col("total_size") >= least_size))


def path_sequences(path_nodes: DataFrame, nodes: DataFrame, links: DataFrame, strict: bool = False) -> DataFrame:
    """The sequence of each path: (path_id, seq).

    ``path_nodes`` has (path_id, place, node). A negative distance overlaps: the next
    sequence is appended without its first -dist letters; a positive one fills in N. Of parallel
    links the nearest counts. With ``strict`` an overlap whose letters differ raises.
    """
    near = mirrored(links).groupBy("source", "dest").agg(F.min("dist").alias("dist"))
    w = path_nodes.select("path_id", "place", "node", (F.col("place") - 1).alias("__before"))
    prev = path_nodes.select("path_id", F.col("place").alias("__before"), F.col("node").alias("prev"))
    stepped = w.join(prev, ["path_id", "__before"], "left").join(near, (F.col("source") == -F.col("prev")) & (F.col("dest") == F.col("node")), "left")
    seqs = stepped.join(nodes.select("node_id", "seq"), F.abs("node") == F.col("node_id"))
    parts = seqs.select("path_id", "place", F.when(F.col("node") < 0, rc(F.col("seq"))).otherwise(F.col("seq")).alias("seq"), F.coalesce("dist", F.lit(0)).alias("dist"))
    overlap = F.greatest(-F.col("dist"), F.lit(0))
    # a link overlaps the node before it by its length at most, unless what stands before is longer; then letters of several nodes are compared
    fresh = F.concat(F.repeat(F.lit("N"), F.greatest("dist", F.lit(0))), F.substring("seq", overlap + 1, F.length("seq")))
    if strict:
        kept = F.substring("seq", F.lit(1), overlap)
        held = parts.select("path_id", F.struct("place", fresh.alias("part"), kept.alias("shared")).alias("p")).groupBy("path_id").agg(F.array_sort(F.collect_list("p")).alias("ps"))
        whole = held.select("path_id", "ps", F.array_join(F.transform("ps", lambda x: x["part"]), "").alias("seq"), F.transform("ps", lambda x: F.length(x["part"])).alias("sizes"))
        ends_ = F.aggregate("sizes", F.array().cast("array<int>"), lambda acc, n: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + n)))
        checked = whole.withColumn("ends", ends_)
        bad = F.exists(F.zip_with("ps", F.sequence(F.lit(0), F.size("ps") - 1), lambda p, i: (i > 0) & (F.length(p["shared"]) > 0) & (F.right(F.substring(F.col("seq"), F.lit(1), F.get(F.col("ends"), i - 1)), F.length(p["shared"])) != p["shared"])), lambda x: x)
        return checked.select("path_id", F.when(bad, F.raise_error(F.lit("path overlap differs")).cast("string")).otherwise(F.col("seq")).alias("seq"))
    # only new letters are gathered, and joined once
    held = parts.groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct("place", fresh.alias("part")))).alias("ps"))
    return held.select("path_id", F.array_join(F.transform("ps", lambda x: x["part"]), "").alias("seq"))


def join_unitigs(graph: Graph, least_nodes: int = 2) -> tuple[Graph, DataFrame]:
    """Every line of at least ``least_nodes`` nodes becomes one node; links at its ends move to it.

    The new node keeps the line's number if the sequence is canonical, else its negative stands for it. Also gives (line, node_id).
    """
    all_lines = lines(graph.nodes, graph.links)
    sizes = all_lines.groupBy("line").agg(F.max("place").alias("last")).where(F.col("last") >= least_nodes - 1)
    held = persisted(all_lines.join(sizes, "line"), "step")
    seqs = path_sequences(held.select(F.col("line").alias("path_id"), "place", "node"), graph.nodes, graph.links)
    fresh = seqs.select(F.col("path_id").alias("node_id"), canonical(F.col("seq")).alias("seq"), F.when(F.col("seq") == canonical(F.col("seq")), F.col("path_id")).otherwise(-F.col("path_id")).alias("signed"))
    # the free ends of a line: +first node (entered) and -last node (left)
    first = held.where("place = 0").select(F.col("node").alias("end"), "line", F.lit(1).alias("s"))
    last = held.where("place = last").select((-F.col("node")).alias("end"), "line", F.lit(-1).alias("s"))
    named = first.unionByName(last).join(fresh.select(F.col("node_id").alias("line"), "signed"), "line").select("end", (F.col("s") * F.col("signed")).alias("new_end"))
    inner = held.select(F.abs("node").alias("n")).distinct()
    outer = graph.links.select("source", "dest", "dist")
    for c in ("source", "dest"):
        other = "dest" if c == "source" else "source"
        moved = outer.join(named, F.col(c) == F.col("end"), "left").join(inner, F.abs(c) == F.col("n"), "left")
        # an inner end that is no free end belongs to a link within the line
        outer = moved.where("n is null or new_end is not null").select(F.coalesce("new_end", c).alias(c), other, "dist").select("source", "dest", "dist")
    nodes = graph.nodes.select("node_id", "seq").join(inner, F.col("node_id") == F.col("n"), "left_anti").unionByName(fresh.select("node_id", "seq"))
    return Graph(nodes, outer), fresh.select(F.col("node_id").alias("line"), F.col("signed").alias("node_id"))


def _sized_steps(nodes: DataFrame, links: DataFrame) -> DataFrame:
    return next_nodes(links).groupBy("node", "next_node").agg(F.min("dist").alias("dist")).join(nodes.select("node_id", F.length("seq").alias("node_size")), F.abs("next_node") == F.col("node_id")).select("node", "next_node", "dist", "node_size")


def paths_between(nodes: DataFrame, links: DataFrame, pairs: DataFrame, max_nodes: int, max_size: int, abort_on_loops: bool = False) -> DataFrame:
    """Inner nodes of all paths of a pair (from_node, to_node): (from_node, to_node, path, size).

    The size sums node sizes and link distances of the inner part and is at most ``max_size``; a
    path has at most ``max_nodes`` inner nodes; a direct link is an empty path. A path never repeats an oriented node; with
    ``abort_on_loops`` a pair one of whose walks would do so has no paths, which is told by walks of each pair of its own.
    """
    step = _sized_steps(nodes, links)
    if not abort_on_loops:
        return _paths_by_start(step, pairs, max_nodes, max_size)
    front = pairs.select("from_node", "to_node", F.col("from_node").alias("node"), F.array().cast("array<bigint>").alias("path"), F.lit(0).cast("long").alias("size"))
    found, looped = [], []
    for _ in range(max_nodes + 1):
        grown = front.join(step, "node")
        found.append(grown.where("next_node = to_node").select("from_node", "to_node", "path", (F.col("size") + F.col("dist")).alias("size")))
        on = grown.where((F.size("path") < max_nodes) & (F.col("next_node") != F.col("to_node")))
        again = F.array_contains("path", F.col("next_node")) | (F.col("next_node") == F.col("from_node"))
        looped.append(on.where(again).select("from_node", "to_node"))
        front = on.where(~again).select("from_node", "to_node", F.col("next_node").alias("node"), F.concat("path", F.array("next_node")).alias("path"), (F.col("size") + F.col("dist") + F.col("node_size")).alias("size")).where(F.col("size") <= max_size)
    out, loops = found[0], looped[0]
    for f, x in zip(found[1:], looped[1:]):
        out, loops = out.unionByName(f), loops.unionByName(x)
    return out.where(F.col("size") <= max_size).join(loops.distinct(), ["from_node", "to_node"], "left_anti")


def _paths_by_start(step: DataFrame, pairs: DataFrame, max_nodes: int, max_size: int) -> DataFrame:
    """The paths of :func:`paths_between` with loops left out, by walks from each first node, which all of its pairs share.

    A walk that meets a pair's second node is a path of that pair if it met it for the first time. It goes on as long as its first node has a pair whose
    second node it has not met, so that of a single pair nothing is walked beyond the second node.
    """
    want = pairs.select("from_node", F.col("to_node").alias("next_node"))
    asked = want.distinct().withColumn("met", F.lit(1))
    front = want.groupBy("from_node").agg(F.countDistinct("next_node").alias("left")).select("from_node", F.col("from_node").alias("node"), F.array().cast("array<bigint>").alias("path"), F.lit(0).cast("long").alias("size"), "left")
    found = []
    for hop in range(max_nodes + 1):
        grown = front.join(step, "node").where(~F.array_contains("path", F.col("next_node")))
        reached = grown.select("from_node", "next_node", "path", (F.col("size") + F.col("dist")).alias("size")).where(F.col("size") <= max_size)
        found.append(reached.join(want, ["from_node", "next_node"]).select("from_node", F.col("next_node").alias("to_node"), "path", "size"))
        if hop == max_nodes:
            break
        on = grown.where("next_node <> from_node").withColumn("size", F.col("size") + F.col("dist") + F.col("node_size")).where(F.col("size") <= max_size)
        on = on.select("from_node", "next_node", F.concat("path", F.array("next_node")).alias("path"), "size", "left").join(asked, ["from_node", "next_node"], "left")
        front = on.select("from_node", F.col("next_node").alias("node"), "path", "size", (F.col("left") - F.coalesce("met", F.lit(0))).alias("left")).where("left > 0")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def paths_of_pairs(nodes: DataFrame, links: DataFrame, pairs: DataFrame, max_nodes: int, max_size: int) -> DataFrame:
    """The paths of :func:`paths_between` for pairs that seldom have one: each pair's gap is walked from both ends, a step at a time at the end with fewer neighbours.

    So a hot node is looked up by the pair of nodes that it may link and its neighbours are not listed, unless both ends are hot. Which end
    goes on depends on the two nodes alone, so each path is found once. ``peak`` is the largest size of the right part's beginnings, as those of a path are bounded too.
    """
    step = _sized_steps(nodes, links).withColumnRenamed("node", "x").withColumnRenamed("next_node", "y")
    step = persisted(step.join(nodes.select(F.col("node_id"), F.length("seq").alias("x_size")), F.abs("x") == F.col("node_id")).drop("node_id"), "steps")
    ahead, back = step.groupBy("x").agg(F.count("*").alias("outs")), step.groupBy("y").agg(F.count("*").alias("ins"))
    none, nothing = F.array().cast("array<bigint>"), F.lit(0).cast("long")
    first = pairs.select("from_node", "to_node").distinct()
    state = first.select("*", F.col("from_node").alias("x"), F.col("to_node").alias("y"), none.alias("left"), none.alias("right"), nothing.alias("size"), nothing.alias("rest"), F.lit(None).cast("long").alias("peak"))
    fresh = lambda c: (F.col(c) != F.col("from_node")) & (F.col(c) != F.col("to_node")) & ~F.array_contains("left", F.col(c)) & ~F.array_contains("right", F.col(c))
    names, found = state.columns, []
    for hop in range(max_nodes + 1):
        state = persisted(state.join(ahead, "x").join(back, "y"), "pairs")
        met = state.join(step.select("x", "y", "dist"), ["x", "y"]).where(F.coalesce(F.col("size") + F.col("dist") + F.col("peak"), nothing) <= max_size)
        found.append(met.select("from_node", "to_node", F.concat("left", "right").alias("path"), (F.col("size") + F.col("dist") + F.col("rest")).alias("size")).where(F.col("size") <= max_size))
        if hop == max_nodes:
            break
        on = state.where("outs <= ins").drop("outs", "ins").join(step.select("x", F.col("y").alias("n"), "dist", "node_size"), "x").where(fresh("n"))
        on = on.withColumns({"x": F.col("n"), "left": F.concat("left", F.array("n")), "size": F.col("size") + F.col("dist") + F.col("node_size")}).where(F.col("size") <= max_size)
        off = state.where("outs > ins").drop("outs", "ins").join(step.select("y", F.col("x").alias("n"), "dist", "x_size"), "y").where(fresh("n"))
        peak = F.greatest(F.col("x_size").cast("long"), F.col("x_size") + F.col("dist") + F.col("peak"))
        off = off.withColumns({"y": F.col("n"), "right": F.concat(F.array("n"), "right"), "rest": F.col("x_size") + F.col("dist") + F.col("rest"), "peak": peak})
        state = on.select(*names).unionByName(off.select(*names))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def tangles(nodes: DataFrame, links: DataFrame, anchors: DataFrame) -> DataFrame:
    """(tangle, role, node): parts of the graph around nodes that are no anchors.

    ``anchors`` (node_id) are the large nodes of good coverage, or given ones. An anchor ends a
    tangle at one of its ends (role ``frontier``, the end's sign); one whose two ends lie in the same
    tangle is internal. ``tangle`` is its smallest internal node that is no anchor.
    """
    known = anchors.select(F.col("node_id").alias("anchor")).distinct()

    def vertex(end: str):
        return F.when(F.col("anchor").isNull(), F.abs(end) * 4).otherwise(F.abs(end) * 4 + F.when(F.col(end) > 0, 1).otherwise(2))

    e = links.select("source", "dest").distinct()
    e = e.join(known, F.abs("source") == F.col("anchor"), "left").select("source", "dest", vertex("source").alias("a")).join(known, F.abs("dest") == F.col("anchor"), "left").select("a", vertex("dest").alias("b"))
    small = nodes.select("node_id").join(known, F.col("node_id") == F.col("anchor"), "left_anti")
    v = small.select((F.col("node_id") * 4).alias("id")).unionByName(e.select(F.explode(F.array("a", "b")).alias("id"))).distinct()
    member = components(e, v).select("component", F.floor(F.col("id") / 4).cast("long").alias("n"), (F.col("id") % 4).alias("kind"))
    named = member.where("kind = 0").groupBy("component").agg(F.min("n").alias("tangle"))
    one = member.groupBy("component", "n").agg(F.min("kind").alias("kind"), F.count("*").alias("seen"))
    role = F.when((F.col("kind") == 0) | (F.col("seen") == 2), "internal").otherwise("frontier")
    return one.join(named, "component").select("tangle", role.alias("role"), F.when((role == "frontier") & (F.col("kind") == 2), -F.col("n")).otherwise(F.col("n")).alias("node"))


def classify_tangles(nodes: DataFrame, links: DataFrame, members: DataFrame) -> DataFrame:
    """(tangle, class): debris, complex tip, tip, repeat n:n, bubble, loop or unclassified."""
    nxt = next_nodes(links)
    counts = members.groupBy("tangle").agg(
        F.sum((F.col("role") == "frontier").cast("int")).alias("f"), F.sum((F.col("role") == "internal").cast("int")).alias("i"),
        F.min(F.when(F.col("role") == "internal", F.col("node"))).alias("i0"), F.max(F.when(F.col("role") == "internal", F.col("node"))).alias("i1"), F.min(F.when(F.col("role") == "frontier", F.col("node"))).alias("f0"),
    )
    side = nxt.groupBy("node").agg(F.count("*").alias("n"), F.min("next_node").alias("low"))
    at = lambda end, sign, p: side.select((F.lit(sign) * F.col("node")).alias(end), F.col("n").alias(f"{p}_n"), F.col("low").alias(f"{p}_low"))
    # a node and its different neighbours
    around = nxt.groupBy(F.abs("node").alias("i0")).agg((F.countDistinct(F.abs("next_node")) + F.when(F.max(F.abs("node") == F.abs("next_node")), 0).otherwise(1)).alias("involved"))
    inside = members.where("role = 'internal'").select("tangle", F.col("node").alias("inner"))
    touching = counts.where("f = 1").join(nxt.select((-F.col("node")).alias("f0"), F.abs("next_node").alias("inner")), "f0").join(inside, ["tangle", "inner"], "left_semi").select("tangle").distinct().withColumn("touches", F.lit(True))
    few = counts.where("i between 1 and 2")
    pair = parallel_counts(links).where("node > 0").select("node", F.col("parallels").alias("pn"), F.col("lowest").alias("p0"))
    for end, p in (("i0", "a"), ("i1", "b")):
        few = few.join(at(end, 1, p + "x"), end, "left").join(at(end, -1, p + "p"), end, "left")
    few = few.join(pair.select(F.col("node").alias("i0"), "pn", "p0"), "i0", "left").join(around, "i0", "left").drop("f", "i", "i0", "i1", "f0")
    t = counts.join(few, "tangle", "left").join(touching, "tangle", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    n_n = (F.col("f") == 2 * z("ap_n")) & (z("ap_n") == z("ax_n")) & (F.coalesce("involved", F.lit(1)) == 2 * z("ap_n") + 1)
    loop = lambda p, q: (z(p + "x_n") == 2) & (z(p + "p_n") == 2) & (z(q + "x_n") == 1) & (z(q + "p_n") == 1) & (F.col(q + "x_low") == -F.col(q + "p_low"))
    label = (
        F.when(F.col("f") == 0, "debris")
        .when((F.col("f") == 1) & F.col("touches").isNull(), "complex tip")
        .when((F.col("i") == 1) & (F.col("f") == 2) & (z("ap_n") + z("ax_n") == 1), "tip")
        .when((F.col("i") == 1) & n_n, F.concat(F.lit("repeat "), z("ap_n").cast("string"), F.lit(":"), z("ax_n").cast("string")))
        .when((F.col("i") == 2) & (F.col("f") == 2) & (F.col("pn") == 1) & (F.col("p0") == F.col("i1")), "bubble")
        .when((F.col("i") == 2) & (F.col("f") == 2) & (loop("a", "b") | loop("b", "a")), "loop")
        .otherwise("unclassified")
    )
    return t.select("tangle", label.alias("class"))
