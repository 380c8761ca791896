"""Continuous periods and gaps of overlapping intervals per entity.

Starts and ends are sorted independently within an entity; with both ranked,
a gap lies where start number i+1 exceeds end number i, and the boundaries left
over pair up to periods. Input splits merge what they hold before anything is
shuffled. Rows are then laid out by range over (entity, start), so a hot entity
spreads over many partitions; what one partition must know of those before it
is the last period still open, one row per partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.session import shared_dir, shuffle_width

_LOCAL_ROWS = 1 << 20


def merge_ranked(a: np.ndarray, b: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Disjoint periods, sorted by (a, b, start), of half-open intervals of the entities (a, b)."""
    if not len(a):
        return a, b, start, end
    by_start = np.lexsort((start, b, a))
    by_end = np.lexsort((end, b, a))
    a, b, s, e = a[by_start], b[by_start], start[by_start], end[by_end]  # both orders group entities alike
    opens = np.ones(len(a), bool)
    opens[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (s[1:] > e[:-1])
    closes = np.append(opens[1:], True)
    return a[opens], b[opens], s[opens], e[closes]


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    return tuple(np.asarray(batch.column(i)) for i in range(4))


_NAMES = ["a", "b", "s", "e"]


def _rows(cols: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=_NAMES)


def _merge_split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: list[tuple[np.ndarray, ...]] = []
    size = kept = 0
    for batch in batches:
        parts.append(merge_ranked(*_columns(batch)))
        size += len(parts[-1][0])
        if size > kept + _LOCAL_ROWS:
            parts = [merge_ranked(*map(np.concatenate, zip(*parts)))]
            size = kept = len(parts[0][0])
            if size > _LOCAL_ROWS:  # little overlaps here: hand it on
                yield _rows(parts[0])
                parts, size, kept = [], 0, 0
    if parts:
        yield _rows(merge_ranked(*map(np.concatenate, zip(*parts))))


def _stream(batches: Iterator[pa.RecordBatch], pending: tuple | None) -> Iterator[tuple[tuple[np.ndarray, ...], bool]]:
    """Merged periods of sorted rows, each part ending in the period that is still open; True marks the last part."""
    for batch in batches:
        cols = _columns(batch)
        if not len(cols[0]):
            continue
        if pending is not None:
            cols = tuple(np.insert(c, 0, p) for c, p in zip(cols, pending))
        cols = merge_ranked(*cols)
        pending = tuple(c[-1] for c in cols)
        yield cols, False
    if pending is not None:
        yield tuple(np.array([p], dtype=np.int64) for p in pending), True


def _last_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    first, last = None, None
    for cols, _ in _stream(batches, None):
        first = first if first is not None else (cols[0][0], cols[1][0])
        last = tuple(int(c[-1]) for c in cols)
    if last is not None:
        out = [TaskContext.get().partitionId(), int(first[0]), int(first[1]), *last]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in out], names=["pid", "fa", "fb", "a", "b", "s", "e"])


def _carries(summary: list) -> tuple[dict[int, tuple], set[int]]:
    """Per partition the open period handed in, and the partitions whose last entity goes on in the next."""
    handed: dict[int, tuple] = {}
    goes_on: set[int] = set()
    open_, before = None, None
    for r in sorted(summary, key=lambda r: r.pid):
        if open_ is not None and (r.fa, r.fb) == open_[:2]:
            handed[r.pid] = open_
            goes_on.add(before)
            if (r.a, r.b) == open_[:2] and r.s <= open_[3]:
                open_ = (*open_[:3], max(open_[3], r.e))
            else:
                open_ = (r.a, r.b, r.s, r.e)
        else:
            open_ = (r.a, r.b, r.s, r.e)
        before = r.pid
    return handed, goes_on


def _emit(handed: dict[int, tuple], goes_on: set[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        for (a, b, s, e), last in _stream(batches, handed.get(pid)):
            # all but the last period are closed; a closed one and its successor in the same entity enclose a gap
            n = len(a) - 1
            if last and pid not in goes_on:
                n = len(a)
            if not n:
                continue
            same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
            ga, gb, gs, ge = a[1:][same], b[1:][same], e[:-1][same], s[1:][same]
            kind = pa.array(["period"] * n + ["gap"] * len(ga), pa.string())
            both = [np.concatenate([x[:n], y]) for x, y in ((a, ga), (b, gb), (s, gs), (e, ge))]
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1]), kind, pa.array(both[2]), pa.array(both[3])], names=["a", "b", "span_kind", "s", "e"])

    return run


def periods_and_gaps(df: DataFrame, entity: tuple[str, str] = ("thread_id", "node"), start: str = "start_pos", end: str = "end_pos") -> DataFrame:
    """Periods and gaps of half-open integer intervals per entity: (*entity, span_kind, from_pos, to_pos).

    ``entity`` names two integer columns. A row with a null entity or bound, or whose end
    is not after its start, covers nothing. Touching intervals are one period; repeated and
    nested rows change nothing; an entity without a valid row has no output; an empty
    table gives an empty result; other columns are ignored. Bounds keep the type of ``start``.
    """
    spark = df.sparkSession
    shared_dir(spark)
    kind = dict(df.dtypes)[start]
    names = dict(zip(entity, ("a", "b")))
    rows = df.select(*(F.col(c).cast("long").alias(n) for c, n in names.items()), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e"))
    rows = rows.where("a is not null and b is not null and s is not null and e is not null and e > s")
    schema = "a long, b long, s long, e long"
    laid = rows.mapInArrow(_merge_split, schema).repartitionByRange(shuffle_width(spark), "a", "b", "s").sortWithinPartitions("a", "b", "s").checkpoint()
    summary = laid.mapInArrow(_last_open, "pid long, fa long, fb long, a long, b long, s long, e long").collect()  # one row per partition
    out = laid.mapInArrow(_emit(*_carries(summary)), "a long, b long, span_kind string, s long, e long")
    return out.select(F.col("a").alias(entity[0]), F.col("b").alias(entity[1]), "span_kind", F.col("s").cast(kind).alias("from_pos"), F.col("e").cast(kind).alias("to_pos"))
