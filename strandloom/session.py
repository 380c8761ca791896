"""Session settings, table access and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def build_session(app: str = "strandloom", cores: int | str = "*", shuffle_partitions: int | None = None) -> SparkSession:
    """A local session with the settings the library expects (UTC, AQE on)."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Lazy scan of one table of a data folder."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, named in ``spark.checkpoint.dir``.

    Where the setting is absent on a single machine (tests) a temporary folder is made and set; on a cluster its absence raises,
    as a folder of one machine would lose the rows of the others.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = sc._jsc.sc().getCheckpointDir()
        named = current.get() if current.isDefined() else None
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="strandloom-")
        sc.setCheckpointDir(named)
    elif not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named)
    return named if "://" in named else "file://" + named.removeprefix("file:")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/strandloom/{spark.sparkContext.applicationId}"


def work_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder, in this application's part of it."""
    return f"{_own_dir(spark)}/{purpose}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def persisted(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage and survives lost executors."""
    path = work_path(df.sparkSession, purpose)
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept._kept_at = path
    return kept


def discard(kept: DataFrame) -> None:
    """Deletes what :func:`persisted` wrote; nothing that still reads it may run afterwards."""
    if path := getattr(kept, "_kept_at", None):
        _delete(kept.sparkSession, path)


def clean_up(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application; results that read them must have been taken before."""
    _delete(spark, _own_dir(spark))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """``df`` with a dense number from 0, in order of ``order``.

    Rows are laid out by range once and written; what is added up over partitions is one count each.
    """
    df = df.repartitionByRange(shuffle_width(df.sparkSession), *order).sortWithinPartitions(*order)
    laid = persisted(df.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", 33).alias("__part")
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = laid.groupBy(part).agg(F.count("*").alias("n")).select("__part", before.alias("__before"))
    rows = laid.withColumn("__part", part).join(F.broadcast(offsets), "__part")  # one row per partition
    return rows.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at", "__part", "__before")


def numbered_records(spark: SparkSession, path: str, name: str, line_sep: str | None = None, skip_empty: bool = False) -> DataFrame:
    """Records of text files with a dense number from 0: (``name``, value, first_of_file), files in order of their paths.

    A file's records are numbered in the order of its blocks, however Spark hands the blocks out; a block's own records are
    read one after another in one partition.
    """
    reader = spark.read.option("lineSep", line_sep) if line_sep else spark.read
    rows = reader.text(path).select("value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"))
    if skip_empty:
        rows = rows.where("value <> ''")
    laid = persisted(rows.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    blocks = laid.groupBy("__file", "__start").agg(F.count("*").alias("n"), F.min("__at").alias("__low"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__file", "__start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = blocks.select(F.col("__low"), before.alias("__before"), "n", (F.row_number().over(Window.partitionBy("__file").orderBy("__start")) == 1).alias("__opens"), F.xxhash64("__file", "__start").alias("__block"))
    j = laid.withColumn("__block", F.xxhash64("__file", "__start")).join(F.broadcast(placed), "__block")  # one row per block
    return j.select((F.col("__before") + F.col("__at") - F.col("__low")).alias(name), "value", (F.col("__opens") & (F.col("__at") == F.col("__low"))).alias("first_of_file"))
