"""K-mer counters, projections and indexes.

Counts group on 2-bit numbers, so partial aggregation runs inside each split and a hot
k-mer reaches the shuffle once per split. Tables of sequences have an id and ``seq``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.seq import kmers, read_key, upper_medians

READ_MOST = 65535


def count_kmers(seqs: DataFrame, k: int, seq: str = "seq", canonical_mode: bool = True) -> DataFrame:
    """(code, n) of all k-mers of the sequences."""
    return kmers(seqs, k, [], seq, canonical_mode, spots=False).groupBy("code").agg(F.count("*").alias("n"))


def counts_from(seqs: DataFrame, k: int, least: int = 1, most: int | None = None) -> DataFrame:
    """K-mers counted at least ``least`` and at most ``most`` times."""
    n = F.col("n")
    counted = count_kmers(seqs, k)
    return counted.where(n >= least if most is None else n.between(least, most))


def count_indexed(index: DataFrame, reads: DataFrame, k: int) -> DataFrame:
    """A3, A4: counts in reads of the k-mers of an index, saturating at 65535; 0 where absent: (code, n).

    Reads are counted before the join, so the join sees each k-mer once from either side.
    """
    counted = count_kmers(reads, k).select("code", F.least("n", F.lit(READ_MOST)).alias("n"))
    return index.select("code").join(counted, "code", "left").na.fill(0, ["n"])


def recount(index: DataFrame, nodes: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """A2: new graph counts of the indexed k-mers, and the graph's k-mers that the index lacks."""
    counted = count_kmers(nodes, k)
    return index.select("code").join(counted, "code", "left").na.fill(0, ["n"]), counted.join(index, "code", "left_anti")


def multicount(index: DataFrame, reads: DataFrame, label: str, names: list[str], k: int) -> DataFrame:
    """A5: one count column per label, in one pass over the reads: (code, *names)."""
    counted = kmers(reads, k, [label], spots=False).groupBy("code").pivot(label, names).agg(F.count(F.lit(1)))
    counted = counted.select("code", *(F.least(F.coalesce(F.col(f"`{n}`"), F.lit(0)), F.lit(READ_MOST)).alias(n) for n in names))
    return index.select("code").join(counted, "code", "left").na.fill(0, names)


def project(seqs: DataFrame, ident: str, counts: DataFrame, k: int) -> DataFrame:
    """Count of each k-mer of each sequence, 0 where not counted: (ident, pos, n)."""
    return kmers(seqs, k, [ident]).join(counts.select("code", "n"), "code", "left").select(ident, "pos", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def kci(nodes: DataFrame, ident: str, graph: DataFrame, reads: DataFrame, peak: float, k: int) -> DataFrame:
    """Per node the upper median of read counts of its k-mers that are unique in the graph, over the peak.

    -1 where ten or fewer such k-mers exist: (ident, unique_kmers, kci).
    """
    unique = graph.where("n = 1").select("code").join(reads.select("code", "n"), "code", "left").na.fill(0, ["n"])
    held = kmers(nodes, k, [ident], spots=False).join(unique, "code")
    median = upper_medians(held, [ident], "n", "m", "unique_kmers")
    known = median.select(ident, "unique_kmers", F.when(F.col("unique_kmers") > 10, F.col("m") / F.lit(float(peak))).otherwise(-1.0).alias("kci"))
    return nodes.select(ident).join(known, ident, "left").na.fill({"unique_kmers": 0, "kci": -1.0})


def spectrum(counts: DataFrame, most: int, graph: DataFrame | None = None, unique: bool = False, present: bool = True) -> DataFrame:
    """Number of k-mers per count, all counts of 0 to ``most`` (the last holds the larger ones): (freq, kmers)."""
    kept = counts
    if graph is not None and (unique or present):
        kept = counts.join(graph.where("n = 1" if unique else "n > 0").select("code"), "code", "left_semi")
    found = kept.groupBy(F.least("n", F.lit(most)).cast("long").alias("freq")).agg(F.count("*").alias("kmers"))
    every = counts.sparkSession.range(most + 1).withColumnRenamed("id", "freq")
    return every.join(found, "freq", "left").na.fill(0, ["kmers"])


def anchor_index(nodes: DataFrame, graph: DataFrame, reads: DataFrame, k: int, least: int, most: int, graph_least: int = 1, graph_most: int = 1) -> DataFrame:
    """Index entries of the k-mers counted ``graph_least`` to ``graph_most`` times in the graph and ``least`` to ``most`` times in reads; ``graph`` and ``reads`` are (code, n)."""
    white = graph.where(F.col("n").between(graph_least, graph_most)).select("code").join(reads.where(F.col("n").between(least, most)).select("code"), "code", "left_semi")
    return whitelist_index(nodes, k, white)


def tag_kmers(reads: DataFrame, k: int, least: int, by_tag: bool = False) -> DataFrame:
    """K-mers occurring at least ``least`` times in tagged reads, or in as many tags: (code, n)."""
    tagged = reads.where("tag > 0")
    if by_tag:
        n = kmers(tagged, k, ["tag"], spots=False).distinct().groupBy("code").agg(F.count("*").alias("n"))
    else:
        n = count_kmers(tagged, k)
    return n.where(F.col("n") >= least)


def tag_readcount(reads: DataFrame) -> DataFrame:
    """Read pairs per non-zero tag; two reads are a pair: (tag, pairs)."""
    return reads.where("tag > 0").groupBy("tag").agg(F.count("*").alias("n")).select("tag", F.floor(F.col("n") / 2).cast("long").alias("pairs"))


def tag_occupancy(reads: DataFrame, most: int = 10000) -> DataFrame:
    """Tags per number of pairs, capped: (pairs, tags)."""
    return tag_readcount(reads).groupBy(F.least("pairs", F.lit(most)).cast("long").alias("pairs")).agg(F.count("*").alias("tags"))


def tag_reads(reads: DataFrame, tag: int) -> DataFrame:
    """The reads of a tag, in order of id."""
    return reads.where(F.col("tag") == tag).select("store", "read_id", "tag").orderBy("read_id")


def count_pattern(nodes: DataFrame, ident: str, filter_counts: DataFrame, values: DataFrame, names: list[str], k: int, most: int, least: int) -> DataFrame:
    """Per node one sign per value count: 1 if every k-mer of the node whose filter count is at most ``most`` is counted at least ``least`` times, else 0.

    Nodes without such a k-mer have an empty pattern: (ident, pattern).
    """
    usable = kmers(nodes, k, [ident], spots=False).join(filter_counts.where(F.col("n") <= most).select("code"), "code")
    held = usable.join(values, "code", "left").na.fill(0, names)
    signs = held.groupBy(ident).agg(F.concat(*(F.when(F.min(F.col(f"`{n}`")) >= least, "1").otherwise("0") for n in names)).alias("pattern"))
    return nodes.select(ident).join(signs, ident, "left").na.fill("", ["pattern"])


def node_kmers(nodes: DataFrame, k: int, ident: str = "node_id") -> DataFrame:
    """All k-mers of nodes as index entries: (code, node, kmer_offset), 1-based, signed by strand."""
    spots = kmers(nodes, k, [ident])
    return spots.select("code", F.col(ident).alias("node"), ((F.col("pos") + 1) * F.when(F.col("is_fw"), 1).otherwise(-1)).alias("kmer_offset"))


def frequency_index(nodes: DataFrame, k: int, limit: int, ident: str = "node_id") -> DataFrame:
    """Index entries of the k-mers occurring fewer than ``limit`` times.

    Counting first and keeping the rare ones by a semi join never gathers the entries of a
    frequent k-mer in one task, as a window would.
    """
    rare = count_kmers(nodes, k).where(F.col("n") < limit).select("code")
    return node_kmers(nodes, k, ident).join(rare, "code", "left_semi")


def whitelist_index(nodes: DataFrame, k: int, codes: DataFrame, ident: str = "node_id") -> DataFrame:
    """Index entries of the k-mers of a whitelist."""
    return node_kmers(nodes, k, ident).join(codes.select("code").distinct(), "code", "left_semi")


def unique_index(nodes: DataFrame, k: int, ident: str = "node_id") -> DataFrame:
    """The only entry of each k-mer that occurs once, by one aggregation: (code, node, kmer_offset)."""
    once = node_kmers(nodes, k, ident).groupBy("code").agg(F.count("*").alias("n"), F.min("node").alias("node"), F.min("kmer_offset").alias("kmer_offset"))
    return once.where("n = 1").drop("n")


def unique_stats(nodes: DataFrame, k: int, ident: str = "node_id") -> DataFrame:
    """Per node its k-mers, those unique in the graph, and whether no read can be mapped to it: (node, total_kmers, unique_kmers, unmappable)."""
    total = kmers(nodes, k, [ident], spots=False).groupBy(F.col(ident).alias("node")).agg(F.count("*").alias("total_kmers"))
    unique = unique_index(nodes, k, ident).groupBy("node").agg(F.count("*").alias("unique_kmers"))
    both = nodes.select(F.col(ident).alias("node")).join(total, "node", "left").join(unique, "node", "left").na.fill(0)
    return both.withColumn("unmappable", F.col("unique_kmers") == 0)


def seed_matches(reads: DataFrame, index: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """Hits of reads in an index, oriented: ([store,] read_id, read_pos, node, node_pos).

    Where the strands agree the node is positive at offset - 1; else it is negative and the
    position counts on its reverse complement: size - offset - k + 1.
    """
    key = read_key(reads)
    hits = kmers(reads, k, key).join(index, "code")
    sized = hits.join(nodes.select(F.col("node_id").alias("node"), F.length("seq").alias("node_size")), "node")
    same = F.col("is_fw") == (F.col("kmer_offset") > 0)
    at = F.abs("kmer_offset")
    return sized.select(
        *key, F.col("pos").alias("read_pos"), F.when(same, F.col("node")).otherwise(-F.col("node")).alias("node"), F.when(same, at - 1).otherwise(F.col("node_size") - at - k + 1).alias("node_pos")
    )
