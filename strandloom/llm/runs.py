"""Runs of repeated consecutive events, found by one regular expression over symbol strings.

Events of a sequence become one code point each and are joined to a string, on which
``(symbol)(?:blank?\\1){n,}`` matches exactly the longest series of equal symbols that
follow one another directly or around a single blank. Match spans are event positions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.session import persisted, shuffle_width

_OUT = "store string, id long, first_at int, last_at int, run_count int"
# Code points: 0 separates entities, 1 is the blank, 2 an event that equals nothing; symbols follow from 256, around the surrogates.
_BLANK, _STOP, _FIRST, _SURROGATES, _SURROGATE_END = 1, 2, 256, 0xD800, 0xE000
_SYMBOLS = 0x10FFFF - _FIRST - (_SURROGATE_END - _SURROGATES)


def _letters_pattern(symbols: str, least: int) -> re.Pattern:
    return re.compile(rf"([{symbols}])(?:[^{symbols}]?\1){{{max(0, least - 1)},}}", re.S)


def _found(spans: list, rows: list[int] | np.ndarray, store: pa.Array, ident: pa.Array) -> pa.RecordBatch:
    at = pa.array(rows, pa.int64())
    cols = [store.take(at), ident.take(at), *(pa.array(np.asarray(c, dtype=np.int32)) for c in spans)]
    return pa.RecordBatch.from_arrays(cols, names=["store", "id", "first_at", "last_at", "run_count"])


def _letter_runs(symbols: str, least: int):
    pattern = _letters_pattern(symbols, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, rows = [], []
            for i, text in enumerate(batch.column("events").to_pylist()):
                if text:
                    for m in pattern.finditer(text):
                        hit = m.group()
                        spans.append((m.start(), m.end() - 1, hit.count(hit[0])))
                        rows.append(i)
            yield _found(list(zip(*spans)) or [()] * 3, rows, batch.column("store"), batch.column("id"))

    return run


def _points(values: np.ndarray, null: np.ndarray, blank: int) -> np.ndarray | None:
    """Code points of events, or None if there are more distinct ones than code points."""
    distinct, code = np.unique(values, return_inverse=True)
    if len(distinct) > _SYMBOLS:
        return None
    code = code.astype(np.int64) + _FIRST
    code[code >= _SURROGATES] += _SURROGATE_END - _SURROGATES
    code[values == blank] = _BLANK
    code[null] = _STOP
    return code


def _cycled(values: np.ndarray, null: np.ndarray, blank: int) -> np.ndarray:
    """Code points for any number of distinct events: a new one whenever an event differs from the last one that is no blank.

    Only neighbours are ever compared, so a code point may return later in the sequence.
    """
    real = (values != blank) & ~null
    seq = values[real]
    code = np.zeros(len(values), np.int64)
    code[real] = np.cumsum(np.append(False, seq[1:] != seq[:-1])) % 1000 + _FIRST if len(seq) else 0
    code[values == blank] = _BLANK
    code[null] = _STOP
    return code


def _list_runs(least: int, blank: int):
    pattern = re.compile(rf"([^\x00-\x02])(?:\x01?\1){{{max(0, least - 1)},}}", re.S)

    def spans_of(lists: pa.Array) -> np.ndarray:
        """Columns: row, first, last, count."""
        lengths = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
        flat = pc.list_flatten(lists)
        null = np.asarray(pc.is_null(flat))
        values = np.asarray(pc.fill_null(flat, 0), dtype=np.int64)
        code = _points(values, null, blank)
        if code is None:
            half = len(lists) // 2
            if half:
                second = spans_of(lists.slice(half))
                second[:, 0] += half
                return np.concatenate([spans_of(lists.slice(0, half)), second])
            code = _cycled(values, null, blank)
        # one string for all entities: after each stands the separator, which no match crosses
        row = np.repeat(np.arange(len(lists)), lengths)
        text = np.zeros(len(values) + len(lists), np.uint32)
        text[np.arange(len(values)) + row] = code
        begins = np.concatenate([[0], np.cumsum(lengths + 1)])
        found = [(m.start(), m.end() - 1, (hit := m.group()).count(hit[0])) for m in pattern.finditer(text.tobytes().decode("utf-32-le"))]
        first, last, count = np.array(found, dtype=np.int64).reshape(-1, 3).T
        of = np.searchsorted(begins, first, "right") - 1
        return np.stack([of, first - begins[of], last - begins[of], count], axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = spans_of(batch.column("events"))
            yield _found(list(found[:, 1:].T), found[:, 0], batch.column("store"), batch.column("id"))

    return run


def _finish(df: DataFrame, store: str, ident: str) -> DataFrame:
    # repeated rows give repeated runs: removing them here moves runs, not sequences
    return df.distinct().select(F.col("store").alias(store), F.col("id").alias(ident), "first_at", "last_at", "run_count")


def text_runs(df: DataFrame, column: str = "seq", store: str = "store", ident: str = "read_id", least: int = 8, symbols: str = "ACGT") -> DataFrame:
    """Runs of at least ``least`` equal symbols in a text: (store, read_id, first_at, last_at, run_count).

    Case is ignored for the letters of ``symbols``; every other character is a blank, of
    which one may stand between two symbols of a run. Positions are 0-based characters.
    Null and empty texts have no runs; rows repeated whole give one result; rows with a null
    store or id keep it; an empty table gives an empty result; other columns are ignored.
    """
    lower = symbols.lower()
    source = df.select(F.col(store).alias("store"), F.col(ident).cast("long").alias("id"), F.translate(column, lower, symbols).alias("events")).where("events is not null")
    return _finish(source.mapInArrow(_letter_runs(symbols, least), _OUT), store, ident)


def list_runs(df: DataFrame, column: str = "path", store: str = "store", ident: str = "read_id", least: int = 2, blank: int = 0) -> DataFrame:
    """Runs of at least ``least`` equal entries in an array of integers, as :func:`text_runs`.

    An entry equal to ``blank`` is a blank; a null entry equals nothing and ends a run.
    """
    source = df.select(F.col(store).alias("store"), F.col(ident).cast("long").alias("id"), F.col(column).cast("array<long>").alias("events")).where("size(events) > 1")
    return _finish(source.mapInArrow(_list_runs(least, blank), _OUT), store, ident)


def collapse_runs(df: DataFrame, column: str = "path", store: str = "store", ident: str = "read_id", blank: int = 0) -> DataFrame:
    """Every run of any length as one event: (store, read_id, first_at, symbol, run_count, extent), for arrays of integers.

    Blanks inside a run belong to it, other blanks are dropped; ``extent`` counts the places from the first to the last symbol.
    A sequence belongs to its store and id: equal ids of two stores stay apart; rows repeated whole are one. Null and empty
    arrays have no runs; a null store or id is kept; an empty table gives an empty result; other columns are ignored.
    """
    keyed = df.select(F.col(store).alias("store"), F.col(ident).cast("long").alias("id"), F.col(column).cast("array<long>").alias("events")).distinct()
    runs = keyed.where("size(events) > 0").mapInArrow(_list_collapsed(blank), "store string, id long, first_at int, symbol long, run_count int, extent int")
    return runs.withColumnsRenamed({"store": store, "id": ident})


def _list_collapsed(blank: int):
    inner = _list_runs(1, blank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("events")
            numbered = pa.RecordBatch.from_arrays([batch.column("store"), pa.array(np.arange(batch.num_rows)), lists], names=["store", "id", "events"])
            for out in inner(iter([numbered])):
                rows, first = np.asarray(out.column("id")), np.asarray(out.column("first_at"))
                lengths = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
                begins = np.concatenate([[0], np.cumsum(lengths)])
                symbol = pc.list_flatten(lists).take(pa.array(begins[rows] + first))
                extent = np.asarray(out.column("last_at")) - first + 1
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([batch.column("store").take(at), batch.column("id").take(at), pa.array(first), symbol, out.column("run_count"), pa.array(extent, pa.int32())], names=["store", "id", "first_at", "symbol", "run_count", "extent"])

    return run


_EVENT_RUN = "entity string, event string, first_us long, last_us long, run_count long, part int, place long, before int, after int"
_ANY_RUN = re.compile(r"([^\x00-\x02])(?:\x01?\1)*", re.S)
_NAMES = [c.split()[0] for c in _EVENT_RUN.split(", ")]


def _follows(a: list, b: list) -> bool:
    """Whether run ``b`` goes on with run ``a``: same entity and event, and at most one blank in all between them."""
    return a[0] == b[0] and a[1] == b[1] and a[8] + b[7] <= 1


def _joined(a: list, b: list) -> list:
    return [a[0], a[1], a[2], b[3], a[4] + b[4], a[5], a[6], a[7], b[8]]


def _batch_runs(batch: pa.RecordBatch) -> list[list]:
    """The runs of one sorted batch in order: entity, event, first and last time, count, part, place, blanks before and after (2 where the entity changes)."""
    entity = batch.column("entity").dictionary_encode()
    event = batch.column("event").dictionary_encode()
    names, kinds = entity.dictionary.to_pylist(), event.dictionary.to_pylist()
    who = np.asarray(pc.fill_null(entity.indices, -1))
    code = np.asarray(pc.fill_null(event.indices, -1)).astype(np.int64)
    none = np.zeros(len(code), bool)
    points = _points(code, none, -1)
    points = _cycled(code, none, -1) if points is None else points
    change = np.flatnonzero(who[1:] != who[:-1]) + 1
    text = np.insert(points, change, 0).astype(np.uint32)
    place = np.delete(np.arange(len(text)), change + np.arange(len(change)))
    row = np.zeros(len(text), np.int64)
    row[place] = np.arange(len(who))
    us = np.asarray(batch.column("us"))
    string = text.tobytes().decode("utf-32-le")
    out, end = [], 0
    for m in _ANY_RUN.finditer(string):
        gap = string[end : m.start()]
        before = 2 if "\x00" in gap else len(gap)
        if out:
            out[-1][8] = before
        a, b = row[m.start()], row[m.end() - 1]
        hit = m.group()
        out.append([names[who[a]] if who[a] >= 0 else None, kinds[code[a]], int(us[a]), int(us[b]), hit.count(hit[0]), 0, 0, before, 0])
        end = m.end()
    rest = string[end:]
    tail = 2 if "\x00" in rest else len(rest)
    if out:
        out[-1][8] = tail
    else:  # blanks only
        out.append([None, None, 0, 0, 0, 0, 0, min(2, tail), 0])
    return out


def _rows_of(runs: list[list]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array([min(2, r[i]) if i > 6 else r[i] for r in runs], k) for i, k in enumerate(kinds)], names=_NAMES)


def _merged(runs: Iterator[list], open_: list | None = None) -> Iterator[list]:
    """Runs in order, joined where one goes on with the one before; entries of count 0 are blanks between runs."""
    waiting = 0
    for r in runs:
        if r[4] == 0:
            if open_ is None:
                waiting += r[7]
            else:
                open_[8] += r[7]
            continue
        if open_ is None:
            r[7] += waiting
            open_, waiting = r, 0
        elif _follows(open_, r):
            open_ = _joined(open_, r)
        else:
            yield open_
            open_ = r
    yield open_ if open_ is not None else [None, None, 0, 0, 0, 0, 0, waiting, 0]


def _event_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of one partition; place 0 is its first one, place -1 its last one (or only one), which may go on in a neighbour."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    runs = _merged(r for batch in batches if batch.num_rows for r in _batch_runs(batch))
    held: list[list] = []
    place = 0
    last: list | None = None
    for r in runs:
        if last is not None:
            last[5], last[6] = part, place
            held.append(last)
            place += 1
            if len(held) >= 1 << 15:
                yield _rows_of(held)
                held = []
        last = r
    if last is not None and (last[4] or last[7]):
        last[5], last[6] = part, -1
        held.append(last)
    if held:
        yield _rows_of(held)


def _edge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (list(r) for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
    out = [r for r in _merged(rows) if r[4]]
    if out:
        yield _rows_of(out)


def event_runs(df: DataFrame, entity: str, ts: str, event: F.Column | str, tie: str | None = None, least: int = 2) -> DataFrame:
    """Runs of at least ``least`` equal consecutive events of an entity: (entity, event, first_ts, last_ts, run_count, duration_us).

    Rows are single events. ``event`` is a column, or an expression that maps near-identical events to one canonical
    event; null is an unreadable event, one of which may stand within a run. Events are in order of ``ts``, then of ``tie``. Rows without
    an entity or a time are no events; rows repeated whole are one; an empty table gives an empty result; other columns are
    ignored. The rows are laid out by range of entity and time, so an entity with very many events spreads over
    tasks; runs at the edges of partitions, two for each, are joined afterwards.
    """
    spark = df.sparkSession
    canon = F.col(event) if isinstance(event, str) else event
    rows = df.select(F.col(entity).cast("string").alias("entity"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), (F.col(tie) if tie else F.lit(0)).alias("tie"), canon.cast("string").alias("event"))
    rows = rows.where("entity is not null and us is not null").distinct()
    order = ["entity", "us", "tie", "event"]
    laid = rows.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)
    runs = persisted(laid.mapInArrow(_event_spans, _EVENT_RUN), "runs")
    edge = "place <= 0"  # two rows a partition
    # the last run of a partition is written with place -1 and stands behind its others
    edges = runs.where(edge).repartition(1).sortWithinPartitions("part", F.when(F.col("place") < 0, 1).otherwise(0)).mapInArrow(_edge_runs, _EVENT_RUN)
    every = runs.where(f"not ({edge})").unionByName(edges).where(F.col("run_count") >= least)
    at = lambda c: F.timestamp_micros(c).cast(df.schema[ts].dataType)
    return every.select(F.col("entity").alias(entity), "event", at("first_us").alias("first_ts"), at("last_us").alias("last_ts"), "run_count", (F.col("last_us") - F.col("first_us")).alias("duration_us"))
