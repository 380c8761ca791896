"""FASTA and FASTQ sources and the three read stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.kmers import rc
from strandloom.functions.seq import compress_homopolymers, seq_to_tag
from strandloom.session import numbered, numbered_records


def read_fasta(spark: SparkSession, path: str, min_length: int = 0) -> DataFrame:
    """(record_id from 1, name, comment, seq) of a plain or gzipped FASTA; records count whether kept or not."""
    raw = numbered_records(spark, path, "ord", "\n>").withColumnRenamed("value", "body")
    # only the first record of a file still has the sign before its header
    text = F.regexp_replace(F.when(F.col("first_of_file"), F.regexp_replace("body", "^>", "")).otherwise(F.col("body")), "\r", "")
    head, rest = F.substring_index(text, "\n", 1), F.when(F.locate("\n", text) > 0, F.expr("substring(t, locate('\n', t) + 1)")).otherwise("")
    t = raw.where("trim(body) <> ''").withColumn("t", text).select((F.col("ord") + 1).alias("record_id"), head.alias("head"), F.regexp_replace(rest, "\\s", "").alias("seq"))
    named = t.select("record_id", F.substring_index("head", " ", 1).alias("name"), F.regexp_replace("head", r"^\S*\s?", "").alias("comment"), "seq")
    return named.where(F.length("seq") >= min_length)


def read_fastq(spark: SparkSession, path: str, min_length: int = 0) -> DataFrame:
    """(record_id from 1, name, comment, seq, qual) of a plain or gzipped FASTQ. A record whose header or separator is missing raises, when run."""
    lines = numbered_records(spark, path, "ord", skip_empty=True)
    at = lambda i: F.max(F.when(F.col("ord") % 4 == i, F.regexp_replace("value", "\r$", "")))
    g = lines.groupBy((F.floor(F.col("ord") / 4) + 1).alias("record_id")).agg(at(0).alias("head"), at(1).alias("seq"), at(2).alias("plus"), at(3).alias("qual"))
    good = F.col("head").startswith("@") & F.col("plus").startswith("+") & F.col("qual").isNotNull()
    seq = F.when(good, F.col("seq")).otherwise(F.raise_error(F.lit("malformed FASTQ record")).cast("string"))
    return g.select("record_id", F.expr("substring(split(head, ' ')[0], 2)").alias("name"), F.regexp_replace("head", r"^\S*\s?", "").alias("comment"), seq.alias("seq"), "qual").where(F.length("seq") >= min_length)


def reader_stats(records: DataFrame, kept: DataFrame) -> DataFrame:
    """(total_records, total_bp, kept_records, kept_bp)."""
    count = lambda df, p: df.agg(F.count("*").alias(f"{p}_records"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias(f"{p}_bp"))
    return count(records, "total").join(F.broadcast(count(kept, "kept")))  # one row each


def paired_store(r1: DataFrame, r2: DataFrame, store: str, min_size: int = 0, max_size: int = 1 << 30, rle: int = 0) -> DataFrame:
    """S3: reads of a paired store: (store, kind, read_id, seq, tag). Mates are 2i-1 and 2i; a pair with a read below ``min_size`` goes; longer reads are cut to ``max_size``."""
    pairs = r1.select("record_id", F.col("seq").alias("a")).join(r2.select("record_id", F.col("seq").alias("b")), "record_id").where(F.least(F.length("a"), F.length("b")) >= min_size)
    return _paired(pairs.withColumn("tag", F.lit(None).cast("long")), store, "paired", max_size, rle)


def _paired(pairs: DataFrame, store: str, kind: str, max_size: int, rle: int) -> DataFrame:
    placed = numbered(pairs.select("record_id", "a", "b", "tag"), "rank", "tag", "record_id").withColumn("pair", F.col("rank") + 1)
    shape = lambda c: F.substring(compress_homopolymers(F.col(c), rle) if rle else F.col(c), 1, max_size)
    mates = F.explode(F.array(F.struct((2 * F.col("pair") - 1).alias("read_id"), shape("a").alias("seq")), F.struct((2 * F.col("pair")).alias("read_id"), shape("b").alias("seq"))))
    return placed.select("tag", mates.alias("m")).select(F.lit(store).alias("store"), F.lit(kind).alias("kind"), "m.read_id", "m.seq", "tag")


def linked_store(r1: DataFrame, r2: DataFrame, store: str, layout: str = "raw", read_size: int = 1 << 30) -> DataFrame:
    """Reads of a linked store, pairs in order of tag.

    ``raw``: the tag is the first 16 bases of read 1, whose sequence starts at base 24; ``UCDavis``: it is the first
    16 letters of read 1's name. A tag with another letter than ACGT is 0.
    """
    j = r1.select("record_id", "name", F.col("seq").alias("s1")).join(r2.select("record_id", F.col("seq").alias("b")), "record_id")
    raw = layout == "raw"
    tag = seq_to_tag(F.substring("s1" if raw else "name", 1, 16))
    first = F.substring("s1", 24, 1 << 30) if raw else F.col("s1")
    return _paired(j.select("record_id", first.alias("a"), "b", tag.alias("tag")), store, "linked", read_size, 0)


def long_store(records: DataFrame, store: str, min_size: int = 0, rle: int = 0) -> DataFrame:
    """Reads of a long store: upper case, letters other than ACGT as N, empty and short ones left out, numbered from 1."""
    clean = F.regexp_replace(F.upper("seq"), "[^ACGT]", "N")
    t = records.select("record_id", (compress_homopolymers(clean, rle) if rle else clean).alias("seq")).where((F.length("seq") >= max(1, min_size)))
    ids = numbered(t, "rank", "record_id").select((F.col("rank") + 1).alias("read_id"), "seq")
    return ids.select(F.lit(store).alias("store"), F.lit("long").alias("kind"), "read_id", "seq", F.lit(None).cast("long").alias("tag"))


def read_sequences(reads: DataFrame, ids: DataFrame) -> DataFrame:
    """(read_id, seq, size) of asked ids (negative: reverse complement; unknown or 0: empty)."""
    j = ids.select("read_id").join(reads.select(F.col("read_id").alias("rid"), "seq"), F.abs("read_id") == F.col("rid"), "left")
    seq = F.coalesce(F.when(F.col("read_id") < 0, rc(F.col("seq"))).otherwise(F.col("seq")), F.lit(""))
    return j.select("read_id", seq.alias("seq"), F.length(seq).alias("size"))


def mate(read_id: F.Column, negated: bool = True) -> F.Column:
    """The other read of a pair; negated for paired stores, plain for linked ones; keeps the sign of a reversed read."""
    other = F.when(F.abs(read_id) % 2 == 1, F.abs(read_id) + 1).otherwise(F.abs(read_id) - 1) * F.signum(read_id).cast("long")
    return -other if negated else other


def store_summary(reads: DataFrame) -> DataFrame:
    """S17 view: (store, kind, reads, bp, shortest, longest, tags) of read stores; empty reads count, tag 0 and null are no tags."""
    size = F.coalesce(F.length("seq"), F.lit(0))
    tag = F.when(F.col("tag") > 0, F.col("tag"))
    return reads.groupBy("store", "kind").agg(F.count("*").alias("reads"), F.sum(size).cast("long").alias("bp"), F.min(size).alias("shortest"), F.max(size).alias("longest"), F.countDistinct(tag).alias("tags"))


def tag_comparison(reads: DataFrame, stores: list[str], more_than: int = 5) -> DataFrame:
    """S17 compare: read pairs per tag and store, for tags with more than ``more_than`` pairs in any: (tag, *stores)."""
    n = reads.where("tag > 0").groupBy("tag").pivot("store", stores).agg(F.floor(F.count(F.lit(1)) / 2)).na.fill(0)
    return n.where(F.greatest(*(F.col(f"`{s}`") for s in stores), F.lit(0)) > more_than)


def detected_read_size(records: DataFrame, looked_at: int = 10000) -> int:
    """S17 make: the largest read among the first ``looked_at`` records (a sampling feature)."""
    return records.where(F.col("record_id") <= looked_at).agg(F.coalesce(F.max(F.length("seq")), F.lit(0))).first()[0]


def write_fasta(seqs: DataFrame, path: str, name: str = "name", seq: str = "seq") -> None:
    """K1, K5: one FASTA record per row, as a folder of parts."""
    seqs.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), F.col(seq)).alias("value")).write.text(path)
