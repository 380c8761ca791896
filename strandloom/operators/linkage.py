"""Linkage between nodes from reads, tags and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.seq import read_key
from strandloom.operators.graph import fw_neighbours_by_distance, next_nodes


def select_by_size(nodes: DataFrame, least: int, most: int = 0) -> DataFrame:
    """L1: nodes of at least ``least`` and (unless 0) at most ``most`` letters: (node_id)."""
    size = F.length("seq")
    return nodes.where((size >= least) if not most else size.between(least, most)).select("node_id")


def tag_node_reads(paths: DataFrame, tags: DataFrame) -> DataFrame:
    """Reads per tag and unsigned node: (tag, node, reads); ``tags`` has (store, read_id, tag), 0 and null are no tags."""
    e = paths.select("store", "read_id", F.explode("path").alias("n")).where("n <> 0").select("store", "read_id", F.abs("n").alias("node")).distinct().hint("merge")
    return e.join(tags.where("tag > 0").select("store", "read_id", "tag").hint("merge"), ["store", "read_id"]).groupBy("tag", "node").agg(F.count("*").alias("reads"))


def node_tags(tag_nodes: DataFrame, more_than: int = 0) -> DataFrame:
    """(node, tag): tags with more than ``more_than`` reads on the node."""
    return tag_nodes.where(F.col("reads") > more_than).select("node", "tag")


def tag_neighbours(tag_nodes: DataFrame, least_score: float, least_mapped: int = 2, most_nodes: int | None = 500, large: DataFrame | None = None) -> DataFrame:
    """M9: (node, other, score): the share of a node's tagged reads whose tag also lies on the other node (itself scores 1).

    Tags with fewer than ``least_mapped`` reads, or ``most_nodes`` nodes or more, take no part, as a tag on very many nodes tells
    nothing; ``None`` counts every tag. Only nodes of ``large`` (node_id), if given, are scored; all nodes count for the tag's number.
    """
    per_tag = tag_nodes.groupBy("tag").agg(F.sum("reads").alias("all"), F.count("*").alias("n")).where(F.col("all") >= least_mapped)
    if most_nodes is not None:
        per_tag = per_tag.where(F.col("n") < most_nodes)
    t = tag_nodes.join(per_tag.select("tag"), "tag", "left_semi")
    if large is not None:
        t = t.join(large.select(F.col("node_id").alias("node")).distinct(), "node", "left_semi")
    shared = t.join(t.select("tag", F.col("node").alias("other")), "tag").groupBy("node", "other").agg(F.sum("reads").alias("shared"))
    own = t.groupBy("node").agg(F.sum("reads").alias("own"))
    return shared.join(own, "node").select("node", "other", (F.col("shared") / F.col("own")).alias("score")).where(F.col("score") >= least_score)


def select_by_tags(nodes: DataFrame, node_tags: DataFrame, least: int, most: int, least_tags: int, most_tags: int) -> DataFrame:
    """Nodes of ``least`` to ``most`` letters with ``least_tags`` to ``most_tags`` tags: (node_id); ``node_tags`` is (node, tag)."""
    n = node_tags.select(F.col("node").alias("node_id"), "tag").distinct().groupBy("node_id").agg(F.count("*").alias("tags"))
    sized = nodes.where(F.length("seq").between(least, most)).select("node_id").join(n, "node_id", "left").na.fill(0, ["tags"])
    return sized.where(F.col("tags").between(least_tags, most_tags)).select("node_id")


def linear_anchors(links: DataFrame, least_links: int = 3, least_transitive: int = 2) -> DataFrame:
    """L2: nodes with neighbours, on both sides of which each neighbour is linked with the next one by at least ``least_transitive`` links: (node_id)."""
    near = fw_neighbours_by_distance(links, least_links)
    w = Window.partitionBy("node").orderBy("dist", "other")
    steps = near.withColumn("then", F.lead("other").over(w))
    n = next_nodes(links).groupBy(F.col("node").alias("other"), F.col("next_node").alias("then")).agg(F.count("*").alias("n"))
    judged = steps.join(n, ["other", "then"], "left").withColumn("ok", F.col("then").isNull() | (F.coalesce("n", F.lit(0)) >= least_transitive))
    return judged.groupBy(F.abs("node").alias("node_id")).agg(F.min("ok").alias("ok")).where("ok").select("node_id")


def nextselected_linkage(links: DataFrame, selected: DataFrame, least_links: int = 1) -> DataFrame:
    """L3: links of each oriented selected node with its nearest selected neighbour, each once: (source, dest, dist)."""
    sel = selected.select("node_id")
    near = fw_neighbours_by_distance(links, least_links).join(sel, F.abs("node") == F.col("node_id"), "left_semi").join(sel, F.abs("other") == F.col("node_id"), "left_semi")
    best = near.groupBy("node").agg(F.min(F.struct("dist", "other")).alias("b")).select((-F.col("node")).alias("s"), F.col("b.other").alias("d"), F.col("b.dist").alias("dist"))
    return best.select(F.least("s", "d").alias("source"), F.greatest("s", "d").alias("dest"), "dist").groupBy("source", "dest").agg(F.min("dist").alias("dist"))


def topology_linkage(links: DataFrame, selected: DataFrame, radius: int) -> DataFrame:
    """L4: selected nodes joined through at most ``radius`` hops over unselected ones: (source, dest, dist 0)."""
    sel = selected.select(F.col("node_id").alias("__s")).distinct()
    step = next_nodes(links).select("node", "next_node").distinct()
    mark = lambda df: df.join(sel, F.abs("node") == F.col("__s"), "left").withColumn("hit", F.col("__s").isNotNull()).drop("__s")
    front = step.join(sel, F.abs("node") == F.col("__s"), "left_semi").select(F.col("node").alias("start"), F.col("next_node").alias("node"))
    found = None
    for i in range(radius):
        m = mark(front.distinct())
        hit = m.where("hit").select("start", "node")
        found = hit if found is None else found.unionByName(hit)
        if i + 1 < radius:
            front = m.where("not hit").join(step, "node").select("start", F.col("next_node").alias("node"))
    ends_ = found.select((-F.col("start")).alias("s"), F.col("node").alias("d"))
    return ends_.select(F.least("s", "d").alias("source"), F.greatest("s", "d").alias("dest"), F.lit(0).alias("dist")).distinct()


def paired_linkage(mapped: DataFrame, least: int, dominance: int = 5) -> DataFrame:
    """Links of nodes joined by read pairs: (source, dest, votes).

    ``mapped`` has (read_id, node signed), mates 2i-1 and 2i, one node per read; a mate points inward. A pair of
    nodes stays in one orientation if no other has more than ``dominance`` times its votes.
    """
    pair = [*read_key(mapped)[:-1], F.floor((F.col("read_id") + 1) / 2).alias("pair")]
    a = mapped.where("read_id % 2 = 1").select(*pair, F.col("node").alias("n1"))
    b = mapped.where("read_id % 2 = 0").select(*pair, F.col("node").alias("n2"))
    j = a.join(b, [*read_key(mapped)[:-1], "pair"]).where("abs(n1) <> abs(n2)").select((-F.col("n1")).alias("s"), (-F.col("n2")).alias("d"))
    votes = j.select(F.when(F.abs("s") < F.abs("d"), F.col("s")).otherwise(F.col("d")).alias("source"), F.when(F.abs("s") < F.abs("d"), F.col("d")).otherwise(F.col("s")).alias("dest")).groupBy("source", "dest").agg(F.count("*").alias("votes"))
    top = F.max("votes").over(Window.partitionBy(F.abs("source"), F.abs("dest")))
    return votes.withColumn("top", top).where((F.col("votes") >= least) & (F.col("top") <= dominance * F.col("votes"))).drop("top")


def shared_read_paths(paths: DataFrame, least_shared: int) -> DataFrame:
    """Ordered node pairs that at least ``least_shared`` reads pass one after the other: (source, dest, reads)."""
    t = paths.select("store", "read_id", F.posexplode("path").alias("place", "node")).where("node <> 0")
    u = t.groupBy("store", "read_id", "node").agg(F.min("place").alias("place"))
    j = u.join(u.select("store", "read_id", F.col("node").alias("other"), F.col("place").alias("later")), ["store", "read_id"]).where("place < later")
    s, d = -F.col("node"), F.col("other")
    return j.select(F.least(s, d).alias("source"), F.greatest(s, d).alias("dest"), "store", "read_id").distinct().groupBy("source", "dest").agg(F.count("*").alias("reads")).where(F.col("reads") >= least_shared)


def mappings_multilinkage(blocks: DataFrame, node_sizes: DataFrame, read_sizes: DataFrame, covered: float = 0.7, merge_gap: int = 500, end_slack: int = 1000) -> DataFrame:
    """Links between all nodes that a long read holds for the most part: (source, dest, dist, read_id).

    Blocks of a read and node whose holes are under ``merge_gap`` are one mapping; it counts if it covers ``covered`` of the
    node, or touches an end of the read (within ``end_slack``). Distances lie between the ends of the mappings.
    """
    key = read_key(blocks)
    w = Window.partitionBy(*key, "node").orderBy("q_start", "q_end")
    t = blocks.withColumn("hole", F.col("q_start") - F.max("q_end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    t = t.withColumn("grp", F.sum((F.col("hole").isNull() | (F.col("hole") >= merge_gap)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    m = t.groupBy(*key, "node", "grp").agg(F.min("q_start").alias("q_start"), F.max("q_end").alias("q_end"), F.min("n_start").alias("n_start"), F.max("n_end").alias("n_end"))
    m = m.join(node_sizes.select("node_id", F.col("size").alias("nsize")), F.abs("node") == F.col("node_id")).join(read_sizes.select(*key, F.col("size").alias("rsize")).hint("merge"), key)
    good = m.where((F.col("n_end") - F.col("n_start") >= covered * F.col("nsize")) | (F.col("q_start") <= end_slack) | (F.col("q_end") >= F.col("rsize") - end_slack)).select(*key, "node", "q_start", "q_end")
    later = good.select(*key, F.col("node").alias("other"), F.col("q_start").alias("s2"), F.col("q_end").alias("e2"))
    j = good.join(later, key).where("(s2 > q_start or (s2 = q_start and e2 > q_end)) and abs(node) <> abs(other)")
    return j.select((-F.col("node")).alias("source"), F.col("other").alias("dest"), (F.col("s2") - F.col("q_end")).alias("dist"), *key)


def paired10x_multilinkage(mapped: DataFrame, neighbours: DataFrame, offsets: DataFrame | None = None) -> DataFrame:
    """Read-pair links of nodes that are also tag neighbours, with the modal distance: (source, dest, dist, pairs).

    ``mapped`` has (read_id, node signed, node_pos): the pair's distance is minus the letters left on both nodes; the most frequent one (the smaller on a tie) stands for the link.
    """
    pair = [*read_key(mapped)[:-1], F.floor((F.col("read_id") + 1) / 2).alias("pair")]
    a = mapped.where("read_id % 2 = 1").select(*pair, F.col("node").alias("n1"), F.col("node_pos").alias("p1"))
    b = mapped.where("read_id % 2 = 0").select(*pair, F.col("node").alias("n2"), F.col("node_pos").alias("p2"))
    j = a.join(b, [*read_key(mapped)[:-1], "pair"]).where("abs(n1) <> abs(n2)").select((-F.col("n1")).alias("source"), (-F.col("n2")).alias("dest"), (-(F.col("p1") + F.col("p2"))).alias("dist"))
    close = neighbours.where("node <> other").select(F.col("node").alias("x"), F.col("other").alias("y"))
    kept = j.join(close, (F.abs("source") == F.col("x")) & (F.abs("dest") == F.col("y")), "left_semi")
    n = kept.groupBy("source", "dest", "dist").agg(F.count("*").alias("pairs"))
    return n.groupBy("source", "dest").agg(F.max(F.struct("pairs", (-F.col("dist")).alias("d"))).alias("m"), F.sum("pairs").cast("long").alias("pairs")).select("source", "dest", (-F.col("m.d")).alias("dist"), "pairs")


def haplotype_scores(read_nodes: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Per read and node, the support of the node's tag neighbours among the read's nodes, and the read's best node: (read_id, node, score, best)."""
    key = read_key(read_nodes)
    a = read_nodes.select(*key, "node", "hits")
    b = read_nodes.select(*key, F.col("node").alias("other"), F.col("hits").alias("other_hits"))
    j = a.join(b, key).join(neighbours.select("node", "other", F.col("score").alias("s")).hint("merge"), ["node", "other"])
    g = j.groupBy(*key, "node").agg(F.sum(F.col("s") * F.col("other_hits")).alias("score"))
    w = Window.partitionBy(*key).orderBy(F.desc("score"), "node")
    return g.withColumn("best", F.row_number().over(w) == 1)


def long10x_multilinkage(blocks: DataFrame, neighbours: DataFrame, node_sizes: DataFrame, read_sizes: DataFrame, **options) -> DataFrame:
    """Links between nodes that a long read holds, from the blocks that linked reads confirm: (source, dest, dist, [store,] read_id).

    Of each read the blocks in its best node by :func:`haplotype_scores` and in that node's tag neighbours stay; the rest is as :func:`mappings_multilinkage`, whose options may be given.
    """
    key = read_key(blocks)
    hits = blocks.groupBy(*key, F.abs("node").alias("node")).agg(F.sum("score").alias("hits"))
    best = haplotype_scores(hits, neighbours).where("best").select(*key, F.col("node").alias("__best"))
    near = neighbours.select(F.col("node").alias("__best"), F.col("other").alias("__other")).unionByName(best.select("__best", F.col("__best").alias("__other"))).distinct()
    kept = blocks.withColumn("__n", F.abs("node")).join(best.join(near.hint("merge"), "__best").select(*key, F.col("__other").alias("__n")).distinct(), [*key, "__n"], "left_semi").drop("__n")
    return mappings_multilinkage(kept, node_sizes, read_sizes, **options)
