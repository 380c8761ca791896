"""The driver's tables as the library's domain tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.session import table


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """Active nodes, repeats included: (node_id, seq upper case)."""
    both = table(spark, d, "nodes").unionByName(table(spark, d, "repeat_nodes"))
    return both.where("status = 'Active'").select("node_id", F.upper("seq").alias("seq"))


def reads(spark: SparkSession, d: str) -> DataFrame:
    """Reads with a sequence, rows delivered twice once: (store, kind, read_id, seq upper case, tag)."""
    return table(spark, d, "fastq_reads").distinct().where("length(seq) > 0").withColumn("seq", F.upper("seq"))


def paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "read_paths").distinct().where("size(path) > 0")


def threads(spark: SparkSession, d: str) -> DataFrame:
    """Thread positions with a node and both bounds: (thread_id, idx, node, start_pos, end_pos)."""
    return table(spark, d, "thread_nodes").where("node <> 0 and start_pos is not null and end_pos is not null").distinct()


def unique_threads(spark: SparkSession, d: str) -> DataFrame:
    """Threads without the nodes that they hold more than once (in either orientation)."""
    w = Window.partitionBy("thread_id", F.abs("node"))
    return threads(spark, d).withColumn("times", F.count("*").over(w)).where("times = 1").drop("times")


NODES = "nd as (select node_id, upper(seq) seq from (select * from nodes union all select * from repeat_nodes) where status = 'Active')"
READS = "rd as (select store, kind, read_id, upper(seq) seq, tag from (select distinct * from fastq_reads) where length(seq) > 0)"
PATHS = "ph as (select * from (select distinct * from read_paths) where len(path) > 0)"
THREADS = "th as (select distinct thread_id, idx, node, start_pos, end_pos from thread_nodes where node <> 0 and start_pos is not null and end_pos is not null)"
UNIQUE = f"{THREADS}, ut as (select * from th qualify count(*) over (partition by thread_id, abs(node)) = 1)"


def kmers_sql(name: str, source: str, keep: str, k: int) -> str:
    """A CTE of canonical k-mers with position and strand."""
    return f"""{name}0 as (select {keep}, pos, substr(seq, pos + 1, {k}) w from (select *, unnest(range(0, length(seq) - {k - 1})) pos from {source})),
      {name} as (select {keep}, cast(pos as integer) pos, least(w, reverse(translate(w, 'ACGT', 'TGCA'))) kmer, w <= reverse(translate(w, 'ACGT', 'TGCA')) is_fw from {name}0 where regexp_full_match(w, '[ACGT]+'))"""
