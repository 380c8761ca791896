"""Has this key been seen before? A log-structured store of sorted runs.

A store is a folder of immutable runs. A run holds the first occurrences of the keys
that one batch brought, as one file per hash shard, sorted by key hash, in row groups
whose hash minimum and maximum are the block fences. A batch is reduced to its
distinct keys, laid out by shard and hash, and merge-joined with every run: fences
skip blocks, and a hash hit counts only if the full key agrees. When ``fan_out`` runs
of a level exist they are merged into one of the next level. Only blocks are held in
memory, never the earlier keys.

Files are written under a name of their own and then renamed, so a repeated task
leaves the same file; the manifest is written last.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.session import shuffle_width, work_path

BLOCK_ROWS = 1 << 16
_RUN = pa.schema([("h", pa.int64()), ("key", pa.string()), ("ord", pa.int64())])
_STATS = "shard int, probed long, fresh long, hash_hits long, verified_hits long"


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


class _Writer:
    """Writes sorted rows to one shard file; it appears under its final name when closed."""

    def __init__(self, run: str, shard: int) -> None:
        self.fs, base = _filesystem(run)
        self.final = f"{base}/shard-{shard:05d}.parquet"
        self.temporary = f"{base}/_{shard:05d}-{uuid.uuid4().hex}"
        self.out: pq.ParquetWriter | None = None
        self.held: list[pa.Table] = []
        self.rows = 0

    def add(self, rows: pa.Table) -> None:
        self.held.append(rows)
        self.rows += rows.num_rows
        if sum(t.num_rows for t in self.held) >= BLOCK_ROWS:
            self._flush()

    def _flush(self) -> None:
        if self.held and self.rows:
            if self.out is None:
                self.fs.create_dir(self.final.rpartition("/")[0], recursive=True)
                self.sink = self.fs.open_output_stream(self.temporary)
                self.out = pq.ParquetWriter(self.sink, _RUN, compression="zstd", write_statistics=["h"], use_dictionary=False)
            self.out.write_table(pa.concat_tables(self.held), row_group_size=BLOCK_ROWS)
        self.held = []

    def close(self) -> None:
        self._flush()
        if self.out is not None:
            self.out.close()
            self.sink.close()
            self.fs.move(self.temporary, self.final)


class _Cursor:
    """Forward-only reader of one sorted shard file by block fences."""

    def __init__(self, run: str, shard: int) -> None:
        fs, base = _filesystem(run)
        name = f"{base}/shard-{shard:05d}.parquet"
        self.fences: list[tuple[int, int]] = []
        self.file = None
        if fs.get_file_info(name).type == pafs.FileType.File:
            self.file = pq.ParquetFile(fs.open_input_file(name))
            for g in range(self.file.num_row_groups):
                s = self.file.metadata.row_group(g).column(0).statistics
                self.fences.append((s.min, s.max))
        self.next = 0
        self.loaded: list[tuple[int, pa.Table]] = []

    def window(self, low: int, high: int) -> pa.Table | None:
        """The blocks that may hold hashes of [low, high]; calls come in rising order."""
        self.loaded = [x for x in self.loaded if x[0] >= low]
        while self.next < len(self.fences) and self.fences[self.next][0] <= high:
            if self.fences[self.next][1] >= low:
                self.loaded.append((self.fences[self.next][1], self.file.read_row_group(self.next, columns=["h", "key"])))
            self.next += 1
        return pa.concat_tables([t for _, t in self.loaded]) if self.loaded else None

    def block(self) -> pa.Table | None:
        if self.next >= len(self.fences):
            return None
        self.next += 1
        return self.file.read_row_group(self.next - 1)


def _probe(rows: pa.Table, cursor: _Cursor) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by hash: whether a stored row has the hash, and whether one has the key."""
    n = rows.num_rows
    hashed, found = np.zeros(n, bool), np.zeros(n, bool)
    h = rows.column("h").to_numpy()
    stored = cursor.window(int(h[0]), int(h[-1]))
    if stored is None:
        return hashed, found
    sh = stored.column("h").to_numpy()
    left, right = np.searchsorted(sh, h, "left"), np.searchsorted(sh, h, "right")
    hashed = right > left
    at = np.flatnonzero(hashed)
    step = 0
    while len(at):  # one round, unless stored keys share a hash
        same = pc.equal(rows.column("key").take(at), stored.column("key").take(left[at] + step))
        found[at[np.asarray(same)]] = True
        step += 1
        at = at[~found[at] & (left[at] + step < right[at])]
    return hashed, found


def _ingest(runs: list[str], target: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, cursors, out, counts = None, [], None, np.zeros(4, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            if shard is None:
                shard = rows.column("shard")[0].as_py()
                cursors, out = [_Cursor(r, shard) for r in runs], _Writer(target, shard)
            hashed, found = np.zeros(rows.num_rows, bool), np.zeros(rows.num_rows, bool)
            for c in cursors:
                a, b = _probe(rows, c)
                hashed |= a
                found |= b
            out.add(rows.select(["h", "key", "ord"]).filter(pa.array(~found)).cast(_RUN))
            counts += (rows.num_rows, (~found).sum(), hashed.sum(), found.sum())
        if shard is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *(pa.array([int(x)], pa.int64()) for x in counts)], names=["shard", "probed", "fresh", "hash_hits", "verified_hits"])

    return run


def _merge(runs: list[str], target: str):
    """Merges the sorted shard files of ``runs`` block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                cursors = [_Cursor(r, shard) for r in runs]
                held = [c.block() for c in cursors]
                out = _Writer(target, shard)
                while any(t is not None for t in held):
                    # up to the lowest of the last hashes, no later block can bring anything
                    border = min(t.column("h")[-1].as_py() for t in held if t is not None)
                    ready = []
                    for i, t in enumerate(held):
                        if t is not None:
                            n = int(np.searchsorted(t.column("h").to_numpy(), border, "right"))
                            ready.append(t.slice(0, n))
                            held[i] = t.slice(n) if n < t.num_rows else cursors[i].block()
                    rows = pa.concat_tables(ready)
                    out.add(rows.take(np.argsort(rows.column("h").to_numpy(), kind="stable")))
                out.close()
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([out.rows], pa.int64())], names=["shard", "rows"])

    return run


@dataclass
class Probes:
    """What one batch's distinct keys met: those asked, new ones, hits by hash, hits by full key."""

    probed: int
    fresh: int
    hash_hits: int
    verified_hits: int


class SeenKeys:
    """A store of all keys met so far, below ``path`` in a folder that all executors share.

    ``shards`` is fixed when the store is made (default: the session's shuffle partitions).
    Batches must be given in order; within a batch the smallest order number is the first
    occurrence. Null keys are never stored and never seen; a null order number marks keys
    known from outside.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, shards: int | None = None, fan_out: int = 4) -> None:
        self.spark, self.path = spark, path or work_path(spark, "seen")
        self.fs, self.base = _filesystem(self.path)
        self.shards, self.fan_out = shards or shuffle_width(spark), fan_out
        self.levels: list[list[str]] = [[]]
        self.made = 0
        manifest = f"{self.base}/manifest.json"
        if self.fs.get_file_info(manifest).type == pafs.FileType.File:
            with self.fs.open_input_stream(manifest) as f:
                kept = json.loads(f.read())
            self.shards, self.fan_out, self.levels, self.made = kept["shards"], kept["fan_out"], kept["levels"], kept["made"]

    def _save(self) -> None:
        self.fs.create_dir(self.base, recursive=True)
        temporary = f"{self.base}/_manifest-{uuid.uuid4().hex}"
        with self.fs.open_output_stream(temporary) as f:
            f.write(json.dumps({"shards": self.shards, "fan_out": self.fan_out, "levels": self.levels, "made": self.made}).encode())
        self.fs.move(temporary, f"{self.base}/manifest.json")

    def _new_run(self) -> str:
        self.made += 1
        self.fs.create_dir(f"{self.base}/run-{self.made:06d}", recursive=True)
        return f"{self.path}/run-{self.made:06d}"

    @property
    def runs(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def add(self, batch: DataFrame) -> Probes:
        """Takes a batch with ``key`` (string) and ``ord`` (long); new keys enter the store."""
        keys = batch.where("key is not null").groupBy("key").agg(F.min("ord").alias("ord")).withColumn("h", F.xxhash64("key"))
        keys = keys.withColumn("shard", F.pmod(F.shiftrightunsigned("h", 32), F.lit(self.shards)).cast("int"))
        target = self._new_run()
        laid = keys.repartitionById(self.shards, F.col("shard")).sortWithinPartitions("h", "key")
        stats = laid.mapInArrow(_ingest(self.runs, target), _STATS).collect()  # one row per shard
        self.levels[0].append(target)
        self._save()
        self._compact()
        return Probes(*(sum(r[c] for r in stats) for c in ("probed", "fresh", "hash_hits", "verified_hits")))

    def _compact(self) -> None:
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fan_out:
                old, target = self.levels[level], self._new_run()
                self.spark.range(0, self.shards, 1, self.shards).mapInArrow(_merge(old, target), "shard long, rows long").collect()
                self.levels[level] = []
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(target)
                self._save()
                for r in old:
                    self.fs.delete_dir(_filesystem(r)[1])
            level += 1

    def firsts(self) -> DataFrame:
        """Order numbers at which a key was new."""
        schema = "h long, key string, ord long"
        return self.spark.read.schema(schema).parquet(*self.runs).where("ord is not null").select("ord")


def _batched(records: DataFrame, batches: int) -> tuple[DataFrame, int]:
    """The records with ``batch``, the place of their order number in ``batches`` equal ranges, laid out once by batch; and how many batches there are.

    The ranges span all order numbers, whether their key is null or not, so the first scan reads only these.
    """
    low, high = records.agg(F.min("ord"), F.max("ord")).first()
    if low is None:
        low, high, batches = 0, 0, 0
    width = -(-(high - low + 1) // max(1, batches))
    placed = records.where("key is not null and ord is not null").withColumn("batch", F.floor((F.col("ord") - F.lit(low)) / F.lit(width)).cast("int"))
    path = work_path(records.sparkSession, "batches")
    placed.write.partitionBy("batch").parquet(path)
    return records.sparkSession.read.schema("key string, ord long, batch int").parquet(path), batches


def _filled(records: DataFrame, known: DataFrame | None, batches: int, fan_out: int) -> tuple[SeenKeys, list[Probes], DataFrame]:
    laid, n = _batched(records.select(F.col("key").cast("string").alias("key"), F.col("ord").cast("long").alias("ord")), batches)
    store = SeenKeys(records.sparkSession, fan_out=fan_out)
    if known is not None:
        store.add(known.select(F.col("key").cast("string").alias("key"), F.lit(None).cast("long").alias("ord")))
    return store, [store.add(laid.where(F.col("batch") == i)) for i in range(n)], laid


def seen_before(records: DataFrame, known: DataFrame | None = None, batches: int = 4, fan_out: int = 2) -> DataFrame:
    """Order numbers (``ord``) of the records whose key is known or belongs to an earlier record.

    ``records`` has ``key`` and ``ord``; rows with equal ``ord`` are one record. Rows whose
    key or order number is null are no records. ``known`` has ``key``; nulls in it are
    ignored, and it may be empty. Without records the result is empty. Other columns are
    ignored. A record is new exactly if it is the first of its key, so the result is all
    records less the store's first occurrences: a join on ``ord``, which no hot key can skew.
    """
    store, _, laid = _filled(records, known, batches, fan_out)
    every = laid.select("ord").distinct()
    return every.join(store.firsts(), "ord", "left_anti") if store.runs else every.limit(0)


def probe_report(records: DataFrame, known: DataFrame | None = None, batches: int = 4, fan_out: int = 2) -> DataFrame:
    """Per batch: (batch, records, probed, fresh, hash_hits, verified_hits, hash_only_error_rate, wrong_answers, error_rate).

    Probes are the batch's distinct keys; ``hash_only_error_rate`` is the share of them that the hash alone would have
    called seen wrongly. ``wrong_answers`` is measured: the records that the store calls new are compared with the
    first records of their keys, found by an exact aggregate over all keys without the store; ``error_rate`` is
    their share of the batch's records. Nulls, empty tables and other columns as in :func:`seen_before`.
    """
    spark = records.sparkSession
    store, probes, laid = _filled(records, known, batches, fan_out)
    firsts = laid.groupBy("key").agg(F.min("ord").alias("ord"))
    if known is not None:
        firsts = firsts.join(known.select(F.col("key").cast("string").alias("key")).distinct(), "key", "left_anti")
    said = store.firsts().withColumn("said", F.lit(1)) if store.runs else laid.select("ord").limit(0).withColumn("said", F.lit(1))
    wrong = said.join(firsts.select("ord", F.lit(1).alias("true")), "ord", "full_outer").where("said is null or true is null").select("ord").distinct()
    wrong = laid.select("ord", "batch").distinct().join(wrong, "ord", "left_semi").groupBy("batch").agg(F.count("*").alias("wrong_answers"))
    rows = [(i, p.probed, p.fresh, p.hash_hits, p.verified_hits, (p.hash_hits - p.verified_hits) / max(1, p.probed)) for i, p in enumerate(probes)]
    asked = spark.createDataFrame(rows, "batch int, probed long, fresh long, hash_hits long, verified_hits long, hash_only_error_rate double")
    counted = laid.select("ord", "batch").distinct().groupBy("batch").agg(F.count("*").alias("records"))
    out = asked.join(counted, "batch", "left").join(wrong, "batch", "left").na.fill(0, ["records", "wrong_answers"])
    return out.select("batch", "records", "probed", "fresh", "hash_hits", "verified_hits", "hash_only_error_rate", "wrong_answers", (F.col("wrong_answers") / F.greatest("records", F.lit(1))).alias("error_rate"))
