"""Streaming ingest: k-mer counts of reads as they arrive (nearest to the chunked ingest of read files)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.seq import kmers


def read_stream(spark: SparkSession, folder: str, schema: str = "store string, kind string, read_id long, seq string, tag long") -> DataFrame:
    """Reads from Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def streaming_counts(reads: DataFrame, k: int) -> DataFrame:
    """Running (code, n) of all k-mers so far: a stateful aggregation, partially combined per micro-batch before the shuffle."""
    return kmers(reads, k, [], spots=False).groupBy("code").agg(F.count("*").alias("n"))


def windowed_events(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Records per window of their time, dropping those later than the watermark: (from_ts, n)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("from_ts"), "n")


def run_to_end(counts: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there now and gives the table it left (memory sink, for bounded results)."""
    q = counts.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return counts.sparkSession.table(name)
