"""Frequency of every distinct term, by dense count arrays over a global integer dictionary.

First the dictionary: the distinct terms fall into ranges by hash, are ranked within
their range, and get their identifier, the rank plus the sizes of the ranges before; so
the identifiers of the collection run from 0 without holes and those of a range are
neighbours. Then terms are encoded: records are reduced to (term, owner) pairs, summed
by term within their split, and meet their range's part of the dictionary, which turns
every term into its identifier. The identifiers index two arrays, occurrences and record
presence, which are kept in blocks of the range and summed as the counts stream in.
The number of ranges follows from the number of pairs, so a range fits a task at any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.session import persisted, shuffle_width

#: Terms that a dictionary range should hold at most; a task holds these and two numbers for each.
RANGE_TERMS = 1 << 20
#: Neighbouring identifiers whose counts are one array.
BLOCK = 1 << 16
_PARTIAL_ROWS = 1 << 18


def _numbers(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy())


def _whole(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column


def _split_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct terms of a split, each once per ``_PARTIAL_ROWS`` rows, with the range they fall into."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def flush() -> pa.RecordBatch:
        t = pa.Table.from_batches(held).group_by(["term", "part"]).aggregate([]).combine_chunks()
        return pa.RecordBatch.from_arrays([_whole(t.column("term")), _whole(t.column("part"))], names=["term", "part"])

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= _PARTIAL_ROWS:
            yield flush()
            held, rows = [], 0
    if rows:
        yield flush()


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct terms of one range in order, with their ranks."""
    part, terms = None, None
    for batch in batches:
        if batch.num_rows:
            part = batch.column("part")[0].as_py()
            found = batch.column("term").unique()
            terms = found if terms is None else pa.concat_arrays([terms, found]).unique()
    if terms is None:
        return
    terms = terms.take(pc.sort_indices(terms))
    for at in range(0, len(terms), BLOCK):
        cut = terms.slice(at, BLOCK)
        yield pa.RecordBatch.from_arrays([cut, pa.array(np.full(len(cut), part, np.int32)), pa.array(at + np.arange(len(cut)))], names=["term", "part", "rank"])


def _ranges(pairs: DataFrame) -> int:
    """Enough ranges for the terms of the pairs, and for the session's tasks."""
    return max(shuffle_width(pairs.sparkSession), -(-pairs.count() // RANGE_TERMS))


def _part(ranges: int) -> F.Column:
    return F.pmod(F.xxhash64("term"), F.lit(ranges)).cast("int")


def dictionary(pairs: DataFrame, ranges: int) -> DataFrame:
    """(term, part, term_id): every distinct non-null term with its number from 0, by range and order; kept in the shared folder."""
    kind = dict(pairs.dtypes)["term"]
    local = pairs.where("term is not null").select("term", _part(ranges).alias("part")).mapInArrow(_split_terms, f"term {kind}, part int")
    laid = persisted(local.repartitionById(ranges, F.col("part")).mapInArrow(_ranked, f"term {kind}, part int, rank long"), "dictionary")
    sizes = dict(laid.groupBy("part").agg(F.count("*")).collect())  # one number per range
    before, run = [], 0
    for p in range(ranges):
        before.append(run)
        run += sizes.get(p, 0)
    offsets = pairs.sparkSession.createDataFrame(list(enumerate(before)), "part int, before long")
    return laid.join(F.broadcast(offsets), "part").select("term", "part", (F.col("before") + F.col("rank")).alias("term_id"))  # one row per range


def _split_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, part, occurrences, presence) of a split, each term once per ``_PARTIAL_ROWS`` rows."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def flush() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        coded = _whole(t.column("term")).dictionary_encode()
        index, size = _numbers(coded.indices).astype(np.int64), len(coded.dictionary)
        sums = []
        for name in ("occurrences", "presence"):
            array = np.zeros(size, np.int64)
            np.add.at(array, index, _numbers(t.column(name)))
            sums.append(pa.array(array))
        part = np.zeros(size, np.int32)
        part[index] = _numbers(t.column("part"))
        return pa.RecordBatch.from_arrays([coded.dictionary, pa.array(part), *sums], names=["term", "part", "occurrences", "presence"])

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= _PARTIAL_ROWS:
            yield flush()
            held, rows = [], 0
    if rows:
        yield flush()


def _range_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range: its dictionary, which comes first and in order of identifiers, then partial counts, which are encoded and summed by identifier."""
    terms: list[pa.Array] = []
    first: int | None = None
    coder: pa.Array | None = None
    blocks: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        ids = batch.column("term_id")
        entries = batch.filter(pc.is_valid(ids))
        if entries.num_rows:
            first = entries.column("term_id")[0].as_py() if first is None else first
            terms.append(entries.column("term"))
        counts = batch.filter(pc.is_null(ids))
        if not counts.num_rows:
            continue
        if coder is None:
            coder = pa.concat_arrays(terms)
            blocks = [(np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.int64)) for _ in range(0, len(coder), BLOCK)]
        code = _numbers(pc.index_in(counts.column("term"), coder)).astype(np.int64)
        for b in np.unique(code // BLOCK):
            at = code // BLOCK == b
            for array, name in zip(blocks[b], ("occurrences", "presence")):
                np.add.at(array, code[at] % BLOCK, _numbers(counts.column(name))[at])
    for b, (occurrences, presence) in enumerate(blocks):
        cut = coder.slice(b * BLOCK, BLOCK)
        n = len(cut)
        yield pa.RecordBatch.from_arrays([cut, pa.array(first + b * BLOCK + np.arange(n)), pa.array(occurrences[:n]), pa.array(presence[:n])], names=["term", "term_id", "occurrences", "presence"])


def owner_pairs(records: DataFrame, amount: str = "amount") -> DataFrame:
    """(term, owner, amount): the amounts summed per pair; a hot term spreads over its owners."""
    return records.groupBy("term", "owner").agg(F.sum(F.col(amount).cast("long")).alias("amount"))


def term_frequencies(pairs: DataFrame, ranges: int | None = None) -> DataFrame:
    """(term, term_id, occurrences, presence) from :func:`owner_pairs`, which is read twice: keep it in a table.

    ``occurrences`` sums the amounts, ``presence`` counts the distinct non-null owners. ``term_id`` runs from 0
    without holes. Null terms are skipped; a term whose owners are all null has presence 0; an empty table
    gives an empty result; other columns are ignored. ``ranges`` bounds the memory of a task, which holds the distinct
    terms of one range, with two numbers each; by default it grows with the pairs.
    """
    kind = dict(pairs.dtypes)["term"]
    ranges = ranges or _ranges(pairs)
    known = dictionary(pairs, ranges)
    rows = pairs.where("term is not null").select("term", _part(ranges).alias("part"), F.col("amount").cast("long").alias("occurrences"), F.col("owner").isNotNull().cast("long").alias("presence"))
    partial = rows.mapInArrow(_split_counts, f"term {kind}, part int, occurrences long, presence long")
    met = known.withColumns({"occurrences": F.lit(None).cast("long"), "presence": F.lit(None).cast("long")}).unionByName(partial.withColumn("term_id", F.lit(None).cast("long")))
    # the dictionary's rows, in order, before the counts
    placed = met.repartitionById(ranges, F.col("part")).sortWithinPartitions(F.col("term_id").asc_nulls_last())
    return placed.mapInArrow(_range_counts, f"term {kind}, term_id long, occurrences long, presence long")


def mark_terms(frequencies: DataFrame, owners: int, rare_at_most: int = 1, common_from: int = 3, common_percent: int = 1) -> DataFrame:
    """Adds ``mark``: ``rare`` up to ``rare_at_most`` occurrences; ``common`` from ``common_from`` owners that are at least ``common_percent`` of ``owners``; else null."""
    common = (F.col("presence") >= common_from) & (F.col("presence") * 100 >= F.lit(owners) * common_percent)
    return frequencies.withColumn("mark", F.when(F.col("occurrences") <= rare_at_most, "rare").when(common, "common"))
