"""Seeds of reads on graph k-mers by minimizer: neither k-mers nor seeds are shuffled one by one.

K-mers in a row that share their minimizer travel as one row of 2-bit letters, of nodes and of reads, to the partition of the minimizer. There the k-mers of
the nodes are counted and looked up; hits in a row on one diagonal leave as one row and become seeds where their read is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.seq import _CODE, _kmer_codes, read_key
from strandloom.session import shuffle_width

HOMES = 1 << 16


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values in a row."""
    n, have = len(x) - width + 1, 1
    while 2 * have <= width:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[width - have : width - have + n])


def reverse_codes(code: np.ndarray, k: int) -> np.ndarray:
    """2-bit numbers of the reverse complements."""
    x = ~code
    for shift, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F)):
        s, m = np.uint64(shift), np.uint64(mask)
        x = ((x >> s) & m) | ((x & m) << s)
    return x.byteswap() >> np.uint64(64 - 2 * k)


def _stretches(k: int, keep: int):
    """Rows (*keep, seq) as (home, *keep, start, run, head, tail): ``run`` k-mers from ``start`` on, as the number of the first and that of the letters behind it."""
    m = max(1, min(13, k - 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(keep).cast(pa.large_binary())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.zeros(0, np.uint8)
            if len(data) < k:
                continue
            begin, size, n = offsets[:-1] - offsets[0], np.diff(offsets), len(data)
            letters = np.concatenate([_CODE[data], np.full(2 * k, 4, np.uint8)])
            bad = np.concatenate([[0], np.cumsum(letters > 3)])
            row = np.repeat(np.arange(len(texts)), size)
            ok = (bad[k : k + n] == bad[:n]) & (np.arange(n) + k <= (begin + size)[row])
            codes = np.minimum(letters, 3).astype(np.uint64)
            short, short_back = _kmer_codes(codes[: n + k - 1], m)
            least = _least(_mixed(np.minimum(short, short_back)), k - m + 1)[:n]
            fresh = ok.copy()
            fresh[1:] &= ~(ok[:-1] & (row[1:] == row[:-1]) & (least[1:] == least[:-1]))
            opened = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
            fresh |= ok & ((np.arange(n) - opened) % (k + 1) == 0)
            at = np.flatnonzero(fresh)
            if not len(at):
                continue
            count = np.add.reduceat(ok.astype(np.int64), at)
            fw = _kmer_codes(codes, k)[0]
            tail = fw[at + k] >> (2 * (k + 1 - count)).astype(np.uint64)
            rows = pa.array(row[at])
            home = (_mixed(least[at]) % np.uint64(HOMES)).astype(np.int32)
            columns = [home, *(batch.column(i).take(rows) for i in range(keep)), (at - begin[row[at]]).astype(np.int32), count.astype(np.int32), fw[at].astype(np.int64), tail.astype(np.int64)]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=["home", *batch.schema.names[:keep], "start", "run", "head", "tail"])

    return run


def stretches(seqs: DataFrame, k: int, keep: list[str]) -> DataFrame:
    """K-mers of every row in stretches of one minimizer: (home, *keep, start, run, head, tail)."""
    rows = seqs.select(*keep, F.coalesce(F.col("seq"), F.lit("")).alias("__seq"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    return rows.mapInArrow(_stretches(k, len(keep)), f"home int, {schema}, start int, run int, head long, tail long").hint("merge")


def _opened(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k-mers of a batch of stretches: their row, place in the sequence, canonical number, and whether that is the forward one."""
    start, run, head, tail = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("start", "run", "head", "tail"))
    run = run.astype(np.int64)
    row = np.repeat(np.arange(len(run)), run)
    j = np.arange(len(row)) - np.repeat(np.cumsum(run) - run, run)
    left = (2 * (run[row] - 1 - j)).astype(np.uint64)
    fw = ((head.view(np.uint64)[row] << (2 * j).astype(np.uint64)) & np.uint64((1 << 2 * k) - 1)) | (tail.view(np.uint64)[row] >> left)
    back = reverse_codes(fw, k)
    return row, start[row] + j, np.minimum(fw, back), fw <= back


def _hits(k: int, limit: int, key: list[str]):
    names = [*key, "node", "read_pos", "node_pos", "run"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, index = [], None
        for batch in batches:
            of_read = batch.column(batch.schema.get_field_index("of_read")).to_numpy(zero_copy_only=False)
            split = int(np.searchsorted(of_read, True))  # the nodes come first
            if split:
                own = batch.slice(0, split)
                row, at, code, is_fw = _opened(own, k)
                node, size = (own.column(own.schema.get_field_index(c)).to_numpy()[row] for c in ("node", "node_size"))
                parts.append((code, node, at, is_fw, size))
            if split == batch.num_rows:
                continue
            if index is None:
                if not parts:
                    continue
                code, *held = (np.concatenate(x) for x in zip(*parts))
                parts.clear()
                order = np.argsort(code, kind="stable")
                every, first, count = np.unique(code[order], return_index=True, return_counts=True)
                rare = count < limit
                index = every[rare], first[rare], count[rare]
                node, at, is_fw, size = (x[order] for x in held)
            codes, first, count = index
            if not len(codes):
                continue
            own = batch.slice(split)
            row, pos, code, forward = _opened(own, k)
            i = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            hit = np.flatnonzero(codes[i] == code)
            i = i[hit]
            n = count[i]
            back = np.repeat(hit, n)
            rank = np.arange(len(back)) - np.repeat(np.cumsum(n) - n, n)
            e = np.repeat(first[i], n) + rank
            row, pos, same = row[back], pos[back], forward[back] == is_fw[e]
            signed, there = np.where(same, node[e], -node[e]), np.where(same, at[e], size[e] - at[e] - k)
            if len(back) > len(hit):  # places of k-mers that have several go by diagonal
                several = n[np.repeat(np.arange(len(n)), n)] > 1
                order = np.flatnonzero(several)
                order = order[np.lexsort((there[order] - pos[order], signed[order], row[order]))]
                order = np.concatenate([np.flatnonzero(~several), order])
                row, pos, signed, there = row[order], pos[order], signed[order], there[order]
            if not len(row):
                continue
            fresh = np.ones(len(row), bool)
            fresh[1:] = (row[1:] != row[:-1]) | (signed[1:] != signed[:-1]) | (pos[1:] != pos[:-1] + 1) | (there[1:] != there[:-1] + 1)
            begin = np.flatnonzero(fresh)
            rows = pa.array(row[begin])
            columns = [*(own.column(own.schema.get_field_index(c)).take(rows) for c in key), pa.array(signed[begin]), pa.array(pos[begin].astype(np.int32)), pa.array(there[begin].astype(np.int32)), pa.array(np.diff(np.append(begin, len(row))).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def seed_runs(reads: DataFrame, nodes: DataFrame, k: int, limit: int) -> DataFrame:
    """Hits in a row on one diagonal: ([store,] read_id, node, read_pos, node_pos, run), read_pos and node_pos of the first; see :func:`frequency_seeds`."""
    key = read_key(reads)
    a = stretches(nodes.withColumn("node_size", F.length("seq")), k, ["node_id", "node_size"])
    b = stretches(reads, k, key)
    kinds = {f.name: f.dataType for f in b.schema}
    shared = ["home", "start", "run", "head", "tail"]
    a = a.select(*shared, *(F.lit(None).cast(kinds[c]).alias(c) for c in key), F.col("node_id").cast("long").alias("node"), "node_size", F.lit(False).alias("of_read"))
    b = b.select(*shared, *key, F.lit(0).cast("long").alias("node"), F.lit(0).alias("node_size"), F.lit(True).alias("of_read"))
    met = a.unionByName(b).repartition(4 * shuffle_width(reads.sparkSession), "home").sortWithinPartitions("of_read")
    schema = ", ".join(f"`{c}` {kinds[c].simpleString()}" for c in key) + ", node long, read_pos int, node_pos int, run int"
    return met.mapInArrow(_hits(k, limit, key), schema).hint("merge")


def frequency_seeds(reads: DataFrame, nodes: DataFrame, k: int, limit: int) -> DataFrame:
    """Seeds on the k-mers that occur fewer than ``limit`` times in the nodes: ([store,] read_id, read_pos, node, node_pos), laid out by read.

    The rows of :func:`strandloom.operators.kmer_counts.seed_matches` with a frequency index of that limit (2 for a unique one).
    """
    key = read_key(reads)
    runs = seed_runs(reads, nodes, k, limit).repartition(*key)
    each = runs.select(*key, "node", "read_pos", "node_pos", F.explode(F.sequence(F.lit(0), F.col("run") - 1)).alias("__j"))
    return each.select(*key, (F.col("read_pos") + F.col("__j")).alias("read_pos"), "node", (F.col("node_pos") + F.col("__j")).alias("node_pos"))
