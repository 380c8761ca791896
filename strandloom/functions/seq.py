"""Sequence, path and small scalar functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.kmers import canonical, rc


def read_key(df: DataFrame) -> list[str]:
    """The columns that name a read: its store and id, as every store numbers its reads from 1; the id alone where a table holds one store."""
    return ["store", "read_id"] if "store" in df.columns else ["read_id"]


def is_canonical(seq: Column) -> Column:
    """a sequence not after its reverse complement; a palindrome is canonical."""
    return seq <= rc(seq)


def path_is_canonical(seq: Column) -> Column:
    """strictly before its reverse complement."""
    return seq < rc(seq)


def tag_to_seq(tag: Column, length: int = 16) -> Column:
    """the letters of a 2-bit packed tag."""
    return F.translate(F.lpad(F.conv(tag.cast("string"), 10, 4), length, "0"), "0123", "ACGT")


def seq_to_tag(seq: Column) -> Column:
    """2-bit packed tag of an ACGT text, 0 if any letter is another one."""
    return F.when(seq.rlike("^[ACGT]+$"), F.conv(F.translate(seq, "ACGT", "0123"), 4, 10).cast("long")).otherwise(F.lit(0).cast("long"))


def kmer_fw_neighbours(kmer: Column) -> Column:
    """the four successors of a k-mer, in letter order."""
    return F.array(*(F.concat(F.substring(kmer, 2, 1 << 20), F.lit(b)) for b in "ACGT"))


def kmer_bw_neighbours(kmer: Column) -> Column:
    """the four predecessors of a k-mer, in letter order."""
    return F.array(*(F.concat(F.lit(b), F.substring(kmer, F.lit(1), F.length(kmer) - 1)) for b in "ACGT"))


def compress_homopolymers(seq: Column, most: int) -> Column:
    """runs of one letter cut to ``most``."""
    return F.regexp_replace(seq, rf"(.)\1{{{most - 1}}}\1+" if most > 1 else r"(.)\1+", "$1" * most)


def reverse_path(path: Column) -> Column:
    """the path walked from its other end."""
    return F.transform(F.reverse(path), lambda x: -x)


def vec_slice(values: Column, start: int, end: int) -> Column:
    """slice with negative indices counted from the last element (``-1`` is size - 2 + 1, as the original has it)."""
    size = F.size(values)
    lo = F.lit(start) if start >= 0 else size - 1 + F.lit(start)
    hi = F.lit(end) if end >= 0 else size - 1 + F.lit(end)
    lo, hi = F.greatest(lo, F.lit(0)), F.least(hi, size)
    return F.when(hi > lo, F.slice(values, lo + 1, hi - lo)).otherwise(F.slice(values, 1, 0))


def intersection_size(a: Column, b: Column) -> Column:
    """distinct common elements of two arrays."""
    return F.size(F.array_intersect(a, b))


def _counted(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct values per key with how many rows come before and up to them, and the rows of the key."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    w = Window.partitionBy(*keys)
    upto = F.sum("__c").over(w.orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    return counted.withColumn("__upto", upto).withColumn("__n", F.sum("__c").over(w))


def upper_medians(df: DataFrame, keys: list[str], value: str, name: str, count: str) -> DataFrame:
    """F16: element n/2 of the sorted non-null values of each key: (*keys, name, count). Values are counted first, so what a key brings together is its distinct values."""
    t = _counted(df, keys, value).where(F.col("__upto") > F.floor(F.col("__n") / 2))
    return t.groupBy(*keys).agg(F.min("__v").alias(name), F.first("__n").alias(count))


def trunc_medians(df: DataFrame, keys: list[str], value: str, name: str, count: str) -> DataFrame:
    """T5: the median of each key; of an even number of values the mean of the middle two, truncated toward zero: (*keys, name, count)."""
    t = _counted(df, keys, value)
    half = F.floor(F.col("__n") / 2)
    upper = F.min(F.when(F.col("__upto") > half, F.col("__v")))
    lower = F.min(F.when(F.col("__upto") >= half, F.col("__v")))
    g = t.groupBy(*keys).agg(upper.alias("__u"), lower.alias("__l"), F.first("__n").alias(count))
    return g.select(*keys, F.when(F.col(count) % 2 == 1, F.col("__u")).otherwise(((F.col("__u") + F.col("__l")) / 2).cast("int")).alias(name), count)


def ilog2(value: Column) -> Column:
    """floor of the binary logarithm of a positive number."""
    return F.length(F.bin(value.cast("long"))) - 1


def _kmer_codes(letters: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """2-bit codes of all windows of ``k`` letters and of their reverse complements.

    Windows of 1, 2, 4 ... letters are joined from two halves; those in ``k``'s binary form are strung together.
    """
    n = len(letters) - k + 1
    part_f, part_r, width = letters, np.uint64(3) - letters, 1
    fw = np.zeros(n, np.uint64)
    back = np.zeros(n, np.uint64)
    done = 0
    while done < k:
        if k & width:
            fw = (fw << np.uint64(2 * width)) | part_f[done : done + n]
            back |= part_r[done : done + n] << np.uint64(2 * done)
            done += width
        if done < k:
            m = len(part_f) - width
            part_f, part_r = (part_f[:m] << np.uint64(2 * width)) | part_f[width:], part_r[:m] | (part_r[width:] << np.uint64(2 * width))
            width *= 2
    return fw, back


_CODE = np.full(256, 4, np.uint8)
for _i, _b in enumerate("ACGT"):
    _CODE[ord(_b)] = _CODE[ord(_b.lower())] = _i


def _windows(k: int, keep: int, is_canonical_mode: bool, spots: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(keep).cast(pa.large_binary())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.zeros(0, np.uint8)
            begin = offsets[:-1] - offsets[0]
            size = np.diff(offsets)
            if len(data) < k:
                continue
            letters = _CODE[data]
            bad = np.concatenate([[0], np.cumsum(letters > 3)])
            n = len(data) - k + 1
            fw, back = _kmer_codes(np.minimum(letters, 3).astype(np.uint64), k)
            row = np.repeat(np.arange(len(texts)), size)[:n]
            ends = (begin + size)[row]
            at = np.arange(n)
            ok = (bad[k:] == bad[:n]) & (at + k <= ends)
            at = at[ok]
            row = row[ok]
            code = (np.minimum(fw, back) if is_canonical_mode else fw)[ok].astype(np.int64)
            rows = pa.array(row)
            columns = [batch.column(i).take(rows) for i in range(keep)]
            names = batch.schema.names[:keep]
            if spots:
                columns += [pa.array((at - begin[row]).astype(np.int32)), pa.array(code), pa.array(fw[ok] <= back[ok])]
                names = [*names, "pos", "code", "is_fw"]
            else:
                columns.append(pa.array(code))
                names = [*names, "code"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def kmers(df: DataFrame, k: int, keep: list[str], seq: str = "seq", canonical_mode: bool = True, spots: bool = True) -> DataFrame:
    """The k-mers (k <= 31) of every row: (*keep, pos, code, is_fw).

    ``code`` is the 2-bit number of the canonical (or, without ``canonical_mode``, forward)
    k-mer, in order of the alphabet; ``pos`` counts from 0; ``is_fw`` tells that the
    forward strand is not after the other. Windows with a letter other than ACGT give none;
    case is ignored. A numpy kernel over whole Arrow batches, without a shuffle. The planner sizes a kernel's rows by its
    input's, some hundred times too small here, so joins of k-mers are hinted to merge: else they are gathered and broadcast.
    """
    if not 1 <= k <= 31:
        raise ValueError("k must be 1 to 31; use long_kmers beyond")
    rows = df.select(*keep, F.coalesce(F.col(seq), F.lit("")).alias("__seq"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    tail = "pos int, code long, is_fw boolean" if spots else "code long"
    return rows.mapInArrow(_windows(k, len(keep), canonical_mode, spots), f"{schema + ', ' if schema else ''}{tail}").hint("merge")


def long_kmers(df: DataFrame, k: int, keep: list[str], seq: str = "seq") -> DataFrame:
    """F5 for k of 32 to 63 (any k): (*keep, pos, kmer), canonical, as text; Spark has no 128-bit number."""
    text = F.upper(F.col(seq))
    spots = F.when(F.length(seq) >= k, F.sequence(F.lit(0), F.length(seq) - k))
    rows = df.select(*keep, text.alias("__seq"), F.explode(spots).alias("pos"))
    kmer = F.substring("__seq", F.col("pos") + 1, F.lit(k))
    return rows.select(*keep, "pos", kmer.alias("kmer")).where(F.col("kmer").rlike("^[ACGT]+$")).withColumn("kmer", canonical(F.col("kmer")))


class Bloom:
    """a Bloom filter with one multiplicative hash; never misses what was added."""

    def __init__(self, bits: int) -> None:
        self.size = bits
        self.bits = np.zeros(-(-bits // 8), np.uint8)

    def _at(self, codes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (np.asarray(codes).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(11)) % np.uint64(self.size)

    def add(self, codes: np.ndarray) -> None:
        at = self._at(codes)
        np.bitwise_or.at(self.bits, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8))

    def contains(self, codes: np.ndarray) -> np.ndarray:
        at = self._at(codes)
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def set_bits(self) -> int:
        return int(np.unpackbits(self.bits).sum())

    def false_positive_rate(self) -> float:
        return self.set_bits() / self.size
