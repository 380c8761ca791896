"""Exact extension of seeds through the graph, and what builds on it.

All reads advance together: one round is one join with the nodes and one with the links,
so no subgraph is shipped to a task. Rounds end when no match can go on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.kmers import rc
from strandloom.functions.seq import kmers, read_key
from strandloom.operators.graph import Graph, next_nodes
from strandloom.operators.kmer_counts import counts_from
from strandloom.operators.traversal import lines, paths_of_pairs
from strandloom.session import persisted


def _letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All letters of a batch's texts, and where each text begins and ends."""
    t = column.cast(pa.large_binary())
    offsets = np.frombuffer(t.buffers()[1], np.int64)[t.offset : t.offset + len(t) + 1]
    return np.frombuffer(t.buffers()[2] or b"", np.uint8), offsets[:-1], offsets[1:]


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``m``: the length of the common beginning of the texts ``a`` and ``b``, for all rows at once by letter."""
    for batch in batches:
        if not batch.num_rows:
            continue
        (x, x0, x1), (y, y0, y1) = (_letters(batch.column(batch.schema.get_field_index(c))) for c in ("a", "b"))
        n = np.minimum(x1 - x0, y1 - y0)
        row = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        out = n.copy()
        differ = np.flatnonzero(x[x0[row] + at] != y[y0[row] + at])
        np.minimum.at(out, row[differ], at[differ])
        keep = [c for c in batch.schema.names if c not in ("a", "b")]
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(out.astype(np.int32))], names=[*keep, "m"])


def _ways(seeds: DataFrame, reads: DataFrame, graph: Graph, k: int) -> DataFrame:
    """Every way of every seed as far as it goes: ([store,] read_id, start_pos, first_node, first_pos, path, read_end).

    Rounds end when no match can go on: each takes letters of the read, so its length bounds them. Only the letters that a hop compares are sent to it.
    """
    key = read_key(seeds)
    keep = [*key, "start_pos", "first_node", "path", "node", "first_pos"]
    kinds = {f.name: f.dataType.simpleString() for f in seeds.schema}
    step = next_nodes(graph.links).where(F.col("dist") <= 1 - k).select(F.col("node"), F.col("next_node").alias("nx"), (-F.col("dist")).alias("nj")).distinct()
    texts, rd = graph.nodes.select("node_id", F.col("seq").alias("nseq")), reads.select(*key, F.col("seq").alias("rseq"))
    at = F.col("node_pos").cast("int")
    state = seeds.select(*key, F.col("read_pos").cast("int").alias("start_pos"), F.col("node").alias("first_node"), F.array("node").alias("path"), "node", at.alias("first_pos"), F.col("read_pos").cast("int").alias("i"), at.alias("j"))
    schema = ", ".join(f"{c} {kinds[c]}" for c in key) + ", start_pos int, first_node long, path array<bigint>, node long, first_pos int, i int, j int, size int, rsize int, m int"
    ended = []
    while True:
        far = F.length("nseq") - F.col("j")
        # of the node what lies ahead, of the read as many letters
        node_part = F.when(F.col("node") < 0, rc(F.substring("nseq", F.lit(1), far))).otherwise(F.substring("nseq", F.col("j") + 1, far))
        both = state.join(texts, F.abs("node") == F.col("node_id")).join(rd, key).select(*keep, "i", "j", F.substring("rseq", F.col("i") + 1, far).alias("a"), node_part.alias("b"), F.length("nseq").alias("size"), F.length("rseq").alias("rsize"))
        good = persisted(both.mapInArrow(_prefixes, schema), "extend").where("m > 0")
        ended.append(good.select(*key, "start_pos", "first_node", "first_pos", "path", (F.col("i") + F.col("m")).alias("read_end")))
        going = good.where("j + m = size and i + m < rsize")
        if going.isEmpty():
            break
        state = going.join(step, "node").select(*key, "start_pos", "first_node", F.concat("path", F.array("nx")).alias("path"), F.col("nx").alias("node"), "first_pos", (F.col("i") + F.col("m")).cast("int").alias("i"), F.col("nj").cast("int").alias("j"))
    out = ended[0]
    for e in ended[1:]:
        out = out.unionByName(e)
    return out


def _furthest(ways: DataFrame, *keys: str) -> DataFrame:
    """Per key the ways that reach furthest, by the first and last of their paths, which share what all of them share: (*keys, read_end, low, high, short, first_pos)."""
    top = F.max("read_end").over(Window.partitionBy(*keys))
    return ways.withColumn("top", top).where("read_end = top").groupBy(*keys, "read_end").agg(F.min("path").alias("low"), F.max("path").alias("high"), F.min(F.size("path")).alias("short"), F.min("first_pos").alias("lowest_pos"))


def extend_matches(seeds: DataFrame, reads: DataFrame, graph: Graph, k: int) -> DataFrame:
    """M3: the best exact way of each seed through the graph: ([store,] read_id, start_pos, first_pos, path, read_end).

    ``seeds`` are ([store,] read_id, read_pos, node, node_pos). A match runs along its node and on over links that overlap by at least
    k - 1, as far as letters agree. Per read and start the way reaching furthest wins; of several, what their beginnings share.
    """
    key = read_key(seeds)
    best = _furthest(_ways(seeds, reads, graph, k), *key, "start_pos")
    same = F.zip_with("low", "high", lambda x, y: x.eqNullSafe(y))
    shared = F.least(F.when(F.array_position(same, False) > 0, F.array_position(same, False) - 1).otherwise(F.size("low")), F.col("short")).cast("int")
    return best.select(*key, "start_pos", F.col("lowest_pos").alias("first_pos"), F.slice("low", 1, shared).alias("path"), "read_end").where("size(path) > 0")


def _shared(runs: list[tuple]) -> list[int]:
    low, high, short = min(r[3] for r in runs), max(r[4] for r in runs), min(r[5] for r in runs)
    n = 0
    while n < min(short, len(high)) and low[n] == high[n]:
        n += 1
    return low[:n]


def _one_read(runs: list[tuple]) -> tuple[int, list[int]] | None:
    """Offset and path of a read from its runs (start, last seed, end, low, high, short, diagonal), in order of start."""
    at, path, offset, waiting, active = 0, [], None, 0, []
    while True:
        while waiting < len(runs) and runs[waiting][0] <= at:
            active.append(runs[waiting])
            waiting += 1
        active = [r for r in active if r[1] >= at]
        if not active:
            if waiting == len(runs):
                break
            at = runs[waiting][0]
            continue
        end = max(r[2] for r in active)
        best = [r for r in active if r[2] == end]
        part = _shared(best)
        if not part:  # the ways part at once: the next seed may tell
            at += 1
            continue
        if offset is None:
            offset = -min(r[6] for r in best)
        path += part if not path or path[-1] != part[0] else part[1:]
        at = end
    return None if offset is None else (offset, path)


def _paths_of_reads(key: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(done: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array([d[0][i] for d in done], t) for i, t in enumerate(types)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([d[1] for d in done], pa.int32()), pa.array([d[2] for d in done], pa.list_(pa.int64()))], names=[*key, "path_offset", "path"])

        name, runs, done, types = None, [], [], []
        for batch in batches:
            types = [batch.schema.field(c).type for c in key]
            names = list(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in key)))
            rows = zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("start_pos", "last_pos", "read_end", "low", "high", "short", "diagonal")))
            for n, r in zip(names, rows):
                if n != name:
                    if runs and (found := _one_read(runs)):
                        done.append((name, *found))
                    name, runs = n, []
                runs.append(r)
            if len(done) >= 1 << 12:
                yield emit(done)
                done = []
        if runs and (found := _one_read(runs)):
            done.append((name, *found))
        if done:
            yield emit(done)

    return run


def path_reads_extended(seeds: DataFrame, reads: DataFrame, graph: Graph, k: int) -> DataFrame:
    """M1, M2: read paths by extension: ([store,] read_id, path_offset, path).

    Of each read the first seed is extended, then the first one behind what that matched, and so on; where one part does not
    follow from the other by a link, nothing is put between them; a seed whose furthest ways part at once gives nothing. ``path_offset`` is the place of the first node's first base on the read.

    Seeds of a read that follow one another on one diagonal of a node have one and the same way, so a way is sought once for each such run, for all reads at once;
    which of them a read takes is then told from its runs in order.
    """
    key = read_key(seeds)
    w = Window.partitionBy(*key, "node", "diagonal").orderBy("read_pos")
    t = seeds.distinct().withColumn("diagonal", F.col("node_pos") - F.col("read_pos"))
    t = t.withColumn("island", F.col("read_pos") - F.row_number().over(w))
    runs = persisted(t.groupBy(*key, "node", "diagonal", "island").agg(F.min("read_pos").alias("read_pos"), F.min("node_pos").alias("node_pos"), F.max("read_pos").cast("int").alias("last_pos")).drop("island"), "runs")
    best = _furthest(_ways(runs, reads, graph, k), *key, "start_pos", "first_node", "first_pos")
    named = runs.select(*key, F.col("read_pos").alias("start_pos"), F.col("node").alias("first_node"), F.col("node_pos").alias("first_pos"), "last_pos", "diagonal")
    told = best.join(named, [*key, "start_pos", "first_node", "first_pos"]).select(*key, "start_pos", "last_pos", "read_end", "low", "high", "short", "diagonal")
    kinds = {f.name: f.dataType.simpleString() for f in seeds.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in key) + ", path_offset int, path array<bigint>"
    return told.repartition(*key).sortWithinPartitions(*key, "start_pos", "last_pos", "diagonal").mapInArrow(_paths_of_reads(key), schema)


def bridge_paths(paths: DataFrame, graph: Graph, max_nodes: int = 4, max_size: int = 2000) -> DataFrame:
    """Read paths with unlinked neighbours bridged by the only way between them, else by a gap (0): (read_id, path).

    ``paths`` has (read_id, path); gaps already there stay.
    """
    key = read_key(paths)
    at = F.transform(F.sequence(F.lit(0), F.size("path") - 1), lambda i: F.struct(i.alias("i"), F.get("path", i).alias("a"), F.get("path", i + 1).alias("b")))
    steps = persisted(paths.where("size(path) > 0").select(*key, F.explode(at).alias("s")).select(*key, "s.*"), "steps")
    linked = next_nodes(graph.links).select(F.col("node").alias("a"), F.col("next_node").alias("b")).distinct().withColumn("linked", F.lit(True))
    open_ = steps.where("a <> 0 and b <> 0").select("a", "b").distinct().join(linked, ["a", "b"], "left_anti").select(F.col("a").alias("from_node"), F.col("b").alias("to_node"))
    ways = paths_of_pairs(graph.nodes, graph.links, open_, max_nodes, max_size).groupBy("from_node", "to_node").agg(F.count("*").alias("n"), F.first("path").alias("way"))
    one = ways.where("n = 1").select(F.col("from_node").alias("a"), F.col("to_node").alias("b"), "way")
    j = steps.join(linked, ["a", "b"], "left").join(one, ["a", "b"], "left")
    none = F.array().cast("array<bigint>")
    between = F.when(F.col("b").isNull() | F.col("linked") | (F.col("a") == 0) | (F.col("b") == 0), none).when(F.col("way").isNotNull(), F.col("way")).otherwise(F.array(F.lit(0).cast("long")))
    parts = j.select(*key, F.struct("i", F.concat(F.array("a"), between).alias("p")).alias("x"))
    return parts.groupBy(*key).agg(F.flatten(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["p"])).alias("path"))


def truncate_turnarounds(matches: DataFrame) -> DataFrame:
    """A read's matches up to the first one in a node met before in the other orientation."""
    key = read_key(matches)
    w = Window.partitionBy(*key).orderBy("read_position", "size", "node", "node_position")
    t = matches.withColumn("ord", F.row_number().over(w))
    first = t.groupBy(*key, "node").agg(F.min("ord").alias("at"))
    met = t.join(first.select(*key, (-F.col("node")).alias("node"), F.col("at").alias("before")), [*key, "node"]).where("before < ord").groupBy(*key).agg(F.min("ord").alias("turn"))
    return t.join(met, key, "left").where("turn is null or ord < turn").drop("ord", "turn")


def matches_from_node(matches: DataFrame, node: int) -> DataFrame:
    """A read's matches from its first one in a signed node on."""
    at = matches.where(F.col("node") == node).groupBy(*read_key(matches)).agg(F.min("read_position").alias("at"))
    return matches.join(at, read_key(matches)).where(F.col("read_position") >= F.col("at")).drop("at")


def popular_next(threads: DataFrame, popular: float = 0.5, first: float = 0.8) -> DataFrame:
    """Per signed node the one node that lies ahead on more than ``popular`` of its threads and is the first such on more than ``first`` of them: (node, other).

    Threads count as seen from the node; a thread's first occurrence of a node stands for it. Nodes with no or several such nodes have none.
    """
    t = threads.select("thread_id", "idx", "node").unionByName(threads.select((-F.col("thread_id")).alias("thread_id"), (-F.col("idx")).alias("idx"), (-F.col("node")).alias("node")))
    once = t.groupBy("thread_id", "node").agg(F.min("idx").alias("idx"))
    total = once.groupBy("node").agg(F.count("*").alias("n"))
    ahead = once.join(once.select("thread_id", F.col("node").alias("other"), F.col("idx").alias("j")), "thread_id").where("j > idx and abs(node) <> abs(other)")
    often = ahead.groupBy("node", "other").agg(F.count("*").alias("c")).join(total, "node").where(F.col("c") > F.lit(popular) * F.col("n")).select("node", "other", "n")
    near = ahead.join(often, ["node", "other"]).groupBy("thread_id", "node", "n").agg(F.min_by("other", "j").alias("other"))
    good = near.groupBy("node", "other", "n").agg(F.count("*").alias("f")).where(F.col("f") > F.lit(first) * F.col("n"))
    return good.groupBy("node").agg(F.count("*").alias("k"), F.min("other").alias("other")).where("k = 1").select("node", "other")


def group_nodes(nodes: DataFrame, best: DataFrame) -> DataFrame:
    """C14: chains of nodes that are each other's best neighbours: (line, place, node); ``best`` is (node, other) for signed nodes."""
    back = best.select((-F.col("other")).alias("node"), (-F.col("node")).alias("other"))
    both = best.select("node", "other").join(back, ["node", "other"], "left_semi")
    links = both.select(F.least(-F.col("node"), F.col("other")).alias("source"), F.greatest(-F.col("node"), F.col("other")).alias("dest"), F.lit(0).alias("dist")).distinct()
    return lines(nodes, links)


def end_to_end(members: DataFrame, walks: DataFrame) -> DataFrame:
    """Walks from one frontier of a tangle that reach another: (tangle, from_node, to_node, path), the path being what lies between.

    ``walks`` is (node, path) as :func:`strandloom.operators.partition.stride` gives it; a walk leaves a frontier f as -f and arrives at one as f.
    """
    f = members.where("role = 'frontier'").select("tangle", "node")
    a = f.select("tangle", (-F.col("node")).alias("from_node")).join(walks.select(F.col("node").alias("from_node"), F.col("path").alias("walk")), "from_node")
    hit = a.join(f.select("tangle", F.col("node").alias("to_node")), "tangle").where("abs(from_node) <> abs(to_node) and array_contains(walk, to_node)")
    return hit.select("tangle", "from_node", "to_node", F.slice("walk", 1, (F.array_position("walk", F.col("to_node")) - 1).cast("int")).alias("path"))


def local_assembly(reads: DataFrame, ends: DataFrame, k: int = 21, least: int = 2) -> Graph:
    """The de Bruijn graph of the reads that hold a k-mer of the given sequences (column ``seq``)."""
    from strandloom.operators.contig import de_bruijn

    wanted = kmers(ends, k, [], spots=False).distinct()
    key = read_key(reads)
    ids = kmers(reads, k, key, spots=False).join(wanted, "code", "left_semi").select(*key).distinct()
    return de_bruijn(counts_from(reads.join(ids, key, "left_semi"), k, least).select("code"), k)
