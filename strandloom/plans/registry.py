"""The query modules of the core library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandloom.plans import contig_queries, extend_queries, graph_queries, kmer_queries, mapping_queries, skew_queries, thread_queries

MODULES = [skew_queries, kmer_queries, graph_queries, thread_queries, mapping_queries, contig_queries, extend_queries]


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return kmer_queries.kmer_spectrum_unique(spark, d)
