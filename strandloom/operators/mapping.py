"""Read mapping on seeds: chains, blocks, perfect matches, read paths.

Seeds are ([store,] read_id, read_pos, node, node_pos) with a signed node. Every store numbers its reads from 1, so a
read is named by store and id wherever a table has the store. Everything per read is
a window or aggregate partitioned by read, whose length bounds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.seq import read_key


def read_mappings(seeds: DataFrame, k: int) -> DataFrame:
    """(read_id, node, first_pos, last_pos, unique_matches, rev), positions on the positive node, from seeds of a unique index."""
    g = seeds.groupBy(*read_key(seeds), "node").agg(F.min("read_pos").alias("first_pos"), (F.max("read_pos") + k - 1).alias("last_pos"), F.count("*").alias("unique_matches"))
    return g.select(*read_key(g), F.abs("node").alias("node"), "first_pos", "last_pos", "unique_matches", (F.col("node") < 0).alias("rev"))


def candidate_counts(seeds: DataFrame, least: int = 1, most: int = 255) -> DataFrame:
    """Hits per read and oriented node, saturating: (read_id, node, hits)."""
    return seeds.groupBy(*read_key(seeds), "node").agg(F.least(F.count("*"), F.lit(most)).alias("hits")).where(F.col("hits") >= least)


def alignment_blocks(seeds: DataFrame, k: int, max_jump: int = 500, max_delta_change: int = 60, least_chain: int = 2, least_size: int = 0) -> DataFrame:
    """Chains of hits of a read in a node: (read_id, node, q_start, q_end, n_start, n_end, score).

    Hits in order of (read_pos, node_pos) form a chain as long as both positions rise by at most
    ``max_jump`` and their difference changes by at most ``max_delta_change``.
    """
    w = Window.partitionBy(*read_key(seeds), "node").orderBy("read_pos", "node_pos")
    dr, dn = F.col("read_pos") - F.lag("read_pos").over(w), F.col("node_pos") - F.lag("node_pos").over(w)
    t = seeds.withColumn("dr", dr).withColumn("dn", dn)
    breaks = F.col("dr").isNull() | (F.col("dr") > max_jump) | (F.col("dn") > max_jump) | (F.col("dn") <= 0) | (F.col("dr") <= 0) | (F.abs(F.col("dn") - F.col("dr")) > max_delta_change)
    t = t.withColumn("chain", F.sum(breaks.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = t.groupBy(*read_key(t), "node", "chain").agg(F.min("read_pos").alias("q_start"), (F.max("read_pos") + k).alias("q_end"), F.min("node_pos").alias("n_start"), (F.max("node_pos") + k).alias("n_end"), F.count("*").alias("score"))
    return g.where((F.col("score") >= least_chain) & (F.col("q_end") - F.col("q_start") >= least_size)).drop("chain")


def drop_shadowed(blocks: DataFrame) -> DataFrame:
    """Blocks that do not lie within a better one of their read (on the read, whatever the node)."""
    key = read_key(blocks)
    other = blocks.select(*(F.col(c).alias(f"__{c}") for c in key), F.col("q_start").alias("s"), F.col("q_end").alias("e"), F.col("score").alias("better"))
    inside = (F.col("s") <= F.col("q_start")) & (F.col("e") >= F.col("q_end")) & (F.col("better") > F.col("score"))
    for c in key:
        inside = inside & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return blocks.join(other.hint("merge"), inside, "left_anti")


def window_winners(seeds: DataFrame, read_sizes: DataFrame, k: int, window: int = 100) -> DataFrame:
    """Per window of a read the oriented node whose band of deltas has most hits in it: ([store,] read_id, win, node, delta, score).

    Windows of ``window`` k-mer positions begin every half window, as long as one lies wholly within the read and another position
    follows. A delta is node less read position; a band opens with the lowest delta that no band holds and spans a tenth of the window. The best band wins if
    no other has as many hits and it has at least a tenth of the window; windows without a winner have no row.
    """
    key = read_key(seeds)
    half, band = window // 2, window // 10
    last = F.floor(F.col("read_pos") / half).cast("int")
    spread = seeds.select(*key, "node", (F.col("node_pos") - F.col("read_pos")).alias("delta"), F.explode(F.when(last > 0, F.array(last, last - 1)).otherwise(F.array(last))).alias("win"))
    ended = read_sizes.select(*key, (F.col("size") - k + 1).alias("__hits"))
    spread = spread.join(ended, key).where(F.col("win") * half + window < F.col("__hits")).groupBy(*key, "win", "node", "delta").agg(F.count("*").cast("int").alias("hits"))
    # hits of one node in one window, as many as it has positions at most: deltas in order, cut into bands
    held = spread.groupBy(*key, "win", "node").agg(F.array_sort(F.collect_list(F.struct("delta", "hits"))).alias("ds"))
    none = F.array().cast("array<struct<delta:int,score:int>>")

    def put(acc, x):
        top = F.element_at(acc, -1)
        fits = (F.size(acc) > 0) & (x["delta"] - F.try_element_at(acc, F.lit(-1))["delta"] < band)
        grown = F.struct(top["delta"].alias("delta"), (top["score"] + x["hits"]).alias("score"))
        return F.when(fits, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(F.struct(x["delta"].cast("int").alias("delta"), x["hits"].alias("score")))))

    bands = held.select(*key, "win", "node", F.explode(F.aggregate("ds", none, put)).alias("b")).select(*key, "win", "node", "b.delta", "b.score")
    best = bands.groupBy(*key, "win").agg(F.max("score").alias("top"))
    tops = bands.join(best, [*key, "win"]).where("score = top").groupBy(*key, "win").agg(F.count("*").alias("tops"), F.first("node").alias("node"), F.first("delta").alias("delta"), F.first("score").alias("score"))
    return tops.where((F.col("tops") == 1) & (F.col("score") >= band)).drop("tops")


def best_nodes(seeds: DataFrame, read_sizes: DataFrame, k: int, window: int = 100, ratio: int = 4) -> DataFrame:
    """Mappings to the nodes that win windows: ([store,] read_id, node, q_start, q_end, n_start, n_end, score).

    Windows won by a node with deltas less than ``window`` apart make one mapping, of all the read's hits in that node whose delta lies at most
    ``window`` beyond theirs. It stays if, of the windows wholly within it, it won more than ``ratio`` times as many as others did.
    One sequence is mapped as a table of one read.
    """
    key = read_key(seeds)
    half = window // 2
    won = window_winners(seeds, read_sizes, k, window)
    w = Window.partitionBy(*key, "node").orderBy("delta", "win")
    step = F.col("delta") - F.lag("delta").over(w)
    grouped = won.withColumn("grp", F.sum((step.isNull() | (step >= window)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    bands = grouped.groupBy(*key, "node", "grp").agg((F.min("delta") - window).alias("lo"), (F.max("delta") + window).alias("hi"))
    hits = seeds.withColumn("delta", F.col("node_pos") - F.col("read_pos")).join(bands, [*key, "node"]).where("delta between lo and hi")
    at = F.struct("read_pos", "node_pos")
    m = hits.groupBy(*key, "node", "grp").agg(F.min(at).alias("a"), F.max(at).alias("b"), F.count("*").alias("score"))
    m = m.select(*key, "node", "grp", F.col("a.read_pos").alias("q_start"), F.col("b.read_pos").alias("q_end"), F.col("a.node_pos").alias("n_start"), F.col("b.node_pos").alias("n_end"), "score")
    judged = m.join(won.select(*key, "win", F.col("node").alias("winner")), key, "left").withColumn("inside", F.col("win").between(F.floor(F.col("q_start") / half) + 1, F.floor(F.col("q_end") / half)))
    n = judged.groupBy(*m.columns).agg(F.sum((F.col("inside") & (F.col("winner") == F.col("node"))).cast("int")).alias("w"), F.sum((F.col("inside") & (F.col("winner") != F.col("node"))).cast("int")).alias("l"))
    return n.where(F.col("w") > ratio * F.col("l")).drop("w", "l", "grp")


def filter_by_size_and_id(blocks: DataFrame, size: int, identity: float) -> DataFrame:
    """Blocks of enough span and identity (hits per 100 positions)."""
    span = F.col("n_end") - F.col("n_start")
    return blocks.where((span >= size) & (100 * F.col("score") / span >= identity))


def offset_groups(blocks: DataFrame, band: int = 200) -> DataFrame:
    """Blocks of a read and node, of both orientations, joined by offset: ([store,] read_id, node, q_start, q_end, n_start, n_end, score).

    A block covers the offsets (read less node position) of its two ends and ``band`` beyond on either side; blocks whose
    offsets overlap are one group, in the orientation of the group's block of least read position. Groups with at least half the best score of their read and
    node stay. A group holds every block whose first offset is not below and whose last one is not above its own; it begins where its lowest node position is and ends where its highest is.
    """
    key = [*read_key(blocks), "unsigned"]
    a, b = F.col("q_start") - F.col("n_start"), F.col("q_end") - F.col("n_end")
    t = blocks.withColumn("unsigned", F.abs("node")).withColumn("o1", a).withColumn("o2", b).withColumn("lo", F.least(a, b) - band).withColumn("hi", F.greatest(a, b) + band)
    w = Window.partitionBy(*key).orderBy("lo", "hi", "q_start", "n_start", "node")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    t = t.withColumn("grp", F.sum((reach.isNull() | (F.col("lo") >= reach)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = t.groupBy(*key, "grp").agg(F.min("lo").alias("g_lo"), F.max("hi").alias("g_hi"), F.sum("score").alias("g_score"), F.min(F.struct("q_start", "q_end", "n_start", "node")).alias("first"))
    best = F.max("g_score").over(Window.partitionBy(*key))
    kept = g.withColumn("best", best).where("2 * g_score >= best").select(*key, "grp", "g_lo", "g_hi", (F.signum(F.col("first.node")).cast("long") * F.col("unsigned")).alias("turned"))
    held = t.drop("grp").join(kept, key).where("o1 >= g_lo and o2 <= g_hi")
    out = held.groupBy(*key, "grp", "turned").agg(F.min(F.struct("n_start", "q_start")).alias("s"), F.max(F.struct("n_end", -F.col("q_start"), "q_end")).alias("e"), F.sum("score").cast("long").alias("score"))
    return out.select(*read_key(blocks), F.col("turned").alias("node"), F.col("s.q_start").alias("q_start"), F.col("e.q_end").alias("q_end"), F.col("s.n_start").alias("n_start"), F.col("e.n_end").alias("n_end"), "score")


def improve_mappings(blocks: DataFrame) -> DataFrame:
    """Shadowed blocks dropped, the rest joined by offset, and again without shadowed ones."""
    return drop_shadowed(offset_groups(drop_shadowed(blocks)))


def perfect_matches(seeds: DataFrame, k: int, least_size: int) -> DataFrame:
    """Maximal co-linear runs of hits: (read_id, node, node_position, read_position, size).

    Hits of a read and oriented node on one diagonal at consecutive read positions are a run. Where runs of different nodes start
    at one read position, the longest stays; if two are equally long, none does.
    """
    w = Window.partitionBy(*read_key(seeds), "node", "diagonal").orderBy("read_pos")
    t = seeds.withColumn("diagonal", F.col("node_pos") - F.col("read_pos"))
    t = t.withColumn("island", F.col("read_pos") - F.row_number().over(w))
    g = t.groupBy(*read_key(seeds), "node", "diagonal", "island").agg(F.min("read_pos").alias("read_position"), F.min("node_pos").alias("node_position"), (F.count("*") + k - 1).cast("int").alias("size"))
    at = Window.partitionBy(*read_key(seeds), "read_position")
    g = g.withColumn("top", F.max("size").over(at)).withColumn("tops", F.sum((F.col("size") == F.max("size").over(at)).cast("int")).over(at))
    return g.where((F.col("size") == F.col("top")) & (F.col("tops") == 1) & (F.col("size") >= least_size)).select(*read_key(seeds), "node", "node_position", "read_position", "size")


def reverse_matches(matches: DataFrame, read_sizes: DataFrame) -> DataFrame:
    """Matches seen on the reverse complement of the read; node positions stay on the positive node."""
    t = matches.join(read_sizes.select(*read_key(matches), F.col("size").alias("rsize")), read_key(matches))
    return t.select(*read_key(t), (-F.col("node")).alias("node"), "node_position", (F.col("rsize") - F.col("read_position") - F.col("size")).alias("read_position"), "size")


def clean_sandwiches(matches: DataFrame, look_ahead: int = 5) -> DataFrame:
    """Without the matches that stand between two matches of one other node at most ``look_ahead`` places apart whose positions rise."""
    w = Window.partitionBy(*read_key(matches)).orderBy("read_position", "size", "node", "node_position")
    before = F.collect_list(F.struct("node", "node_position")).over(w.rowsBetween(-look_ahead, -1))
    after = F.collect_list(F.struct("node", "node_position")).over(w.rowsBetween(1, look_ahead))
    t = matches.withColumn("before", before).withColumn("after", after)
    inside = F.exists("after", lambda a: F.exists(F.slice(F.reverse("before"), 1, 1), lambda b: (a["node"] == b["node"]) & (a["node"] != F.col("node")) & (a["node_position"] > b["node_position"])))
    return t.where(~inside).drop("before", "after")


def recruited(matches: DataFrame, least_size: int, least_count: int, first: int | None = None, last: int | None = None) -> DataFrame:
    """(node, [store,] read_id): reads with enough matches of enough size in an oriented node."""
    kept = matches.where(F.col("size") >= least_size)
    if first is not None:
        kept = kept.where(F.col("read_id").between(first, last))
    return kept.groupBy("node", *read_key(kept)).agg(F.count("*").alias("n")).where(F.col("n") >= least_count).select("node", *read_key(kept))


def valid_blocks(matches: DataFrame, least_count: int, least_bp: int = 0) -> DataFrame:
    """(read_id, node, first, last, matches, bp): places of the nodes whose matches all stand together.

    Nodes with fewer matches or letters than asked for are left out first and do not split others.
    """
    own = Window.partitionBy(*read_key(matches), "node")
    t = matches.withColumn("n", F.count("*").over(own)).withColumn("bp", F.sum("size").over(own)).where((F.col("n") >= least_count) & (F.col("bp") >= least_bp))
    t = t.withColumn("ord", F.row_number().over(Window.partitionBy(*read_key(matches)).orderBy("read_position", "size", "node", "node_position")) - 1)
    g = t.groupBy(*read_key(matches), "node").agg(F.min("ord").alias("first"), F.max("ord").alias("last"), F.count("*").alias("matches"), F.sum("size").cast("long").alias("bp"))
    return g.where(F.col("last") - F.col("first") + 1 == F.col("matches"))


def simple_threads(matches: DataFrame, node_sizes: DataFrame, least_count: int, least_bp: int = 0) -> DataFrame:
    """One thread position per valid block: ([store,] thread_id, idx, node, start_pos, end_pos).

    The position starts where the node's first base falls on the read by the block's first match, and is as long as the node.
    """
    key = read_key(matches)
    b = valid_blocks(matches, least_count, least_bp).select(*key, "node", "first")
    at = matches.groupBy(*key, "node").agg(F.min_by(F.col("read_position") - F.col("node_position"), F.struct("read_position", "size", "node_position")).alias("start_pos"))
    t = b.join(at, [*key, "node"]).join(node_sizes.select("node_id", F.col("size").alias("node_size")), F.abs("node") == F.col("node_id"))
    w = Window.partitionBy(*key).orderBy("first")
    return t.select(*key[:-1], F.col("read_id").alias("thread_id"), (F.row_number().over(w) - 1).alias("idx"), "node", "start_pos", (F.col("start_pos") + F.col("node_size")).alias("end_pos"))


def path_reads(matches: DataFrame) -> DataFrame:
    """M1, M2: the nodes that a read's matches walk through, each run of matches of one node once: (read_id, path_offset, path).

    ``path_offset`` is the place of the first node's first base relative to the read (negative where the read begins inside it).
    """
    w = Window.partitionBy(*read_key(matches)).orderBy("read_position", "size", "node", "node_position")
    t = matches.withColumn("before", F.lag("node").over(w)).where("before is null or before <> node")
    g = t.groupBy(*read_key(t)).agg(F.array_sort(F.collect_list(F.struct("read_position", "size", "node", "node_position"))).alias("m"))
    return g.select(*read_key(g), (F.col("m")[0]["read_position"] - F.col("m")[0]["node_position"]).alias("path_offset"), F.transform("m", lambda x: x["node"]).alias("path"))


def path_fw(path: Column, node: Column) -> Column:
    """What follows the first occurrence of a node in a path, or in the path reversed if only the other orientation occurs; null without either."""
    back = F.transform(F.reverse(path), lambda x: -x)
    after = lambda p: F.slice(p, F.array_position(p, node).cast("int") + 1, F.size(p))
    return F.when(F.array_position(path, node) > 0, after(path)).when(F.array_position(back, node) > 0, after(back))


def paths_in_node(paths: DataFrame) -> DataFrame:
    """M6, D-paths: (store, node, read_id): reads through each unsigned node, negative where they pass it reversed."""
    e = paths.select("store", "read_id", F.explode("path").alias("n")).where("n <> 0")
    return e.select("store", F.abs("n").alias("node"), (F.signum("n").cast("long") * F.col("read_id")).alias("read_id")).distinct()


def all_paths_fw(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """M5: (store, node, read_id, path): for each given signed node and each read through it what lies ahead."""
    through = paths_in_node(paths).select("store", F.col("node").alias("n"), F.abs("read_id").alias("read_id")).distinct()
    wanted = nodes.select("node", F.abs("node").alias("n"))
    return through.join(wanted, "n").join(paths, ["store", "read_id"]).select("store", "node", "read_id", path_fw(F.col("path"), F.col("node")).alias("path")).where("path is not null")


def immediate_neighbours(paths: DataFrame, more_than: int = 10) -> DataFrame:
    """M6: the node that most reads have right before or after each oriented node, with more than ``more_than`` votes: (node, other, votes)."""
    w = F.transform(F.sequence(F.lit(0), F.size("path") - 2), lambda i: F.struct(F.get("path", i).alias("a"), F.get("path", i + 1).alias("b")))
    steps = paths.where("size(path) > 1").select(F.explode(w).alias("s")).select("s.a", "s.b").where("a <> 0 and b <> 0")
    both = steps.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct((-F.col("b")).alias("node"), (-F.col("a")).alias("other")))).alias("s")).select("s.*")
    votes = both.groupBy("node", "other").agg(F.count("*").alias("votes"))
    best = votes.groupBy("node").agg(F.max(F.struct("votes", (-F.col("other")).alias("o"))).alias("b"))
    return best.select("node", (-F.col("b.o")).alias("other"), F.col("b.votes").alias("votes")).where(F.col("votes") > more_than)


def insert_sizes(mappings: DataFrame, most: int = 70000) -> DataFrame:
    """M7: (orientation, d, pairs): insert sizes of mates (2i-1, 2i) on one node, facing (FR) or back to back (RF), from node positions (read_id, node, rev, node_pos)."""
    key = [*read_key(mappings)[:-1], "pair"]
    m = mappings.withColumn("pair", F.floor((F.col("read_id") + 1) / 2))
    a, b = m.where("read_id % 2 = 1"), m.where("read_id % 2 = 0")
    j = a.select(*key, "node", F.col("rev").alias("r1"), F.col("node_pos").alias("p1")).join(b.select(*key, "node", F.col("rev").alias("r2"), F.col("node_pos").alias("p2")), [*key, "node"]).where("r1 <> r2")
    fw, bw = F.when(F.col("r1"), F.col("p2")).otherwise(F.col("p1")), F.when(F.col("r1"), F.col("p1")).otherwise(F.col("p2"))
    return j.select(F.when(bw >= fw, "FR").otherwise("RF").alias("orientation"), F.abs(bw - fw).alias("d")).where(F.col("d") < most).groupBy("orientation", "d").agg(F.count("*").alias("pairs"))


def flip_mappings(mappings: DataFrame, node_sizes: DataFrame) -> DataFrame:
    """Mappings seen from the negative node: positions counted from its other end, orientation turned."""
    t = mappings.join(node_sizes.select(F.col("node_id").alias("node"), "size"), "node")
    return t.select(*read_key(t), (-F.col("node")).alias("node"), (F.col("size") - 1 - F.col("last_pos")).alias("first_pos"), (F.col("size") - 1 - F.col("first_pos")).alias("last_pos"), (~F.col("rev")).alias("rev"))
