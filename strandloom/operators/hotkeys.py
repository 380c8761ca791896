"""Per-key results where a few keys hold most records.

Keys are integer ids, so an id is its own dictionary code; string labels are
dictionary-encoded within each input split. Every split scatters its records
into dense arrays over its local codes (``bincount`` / ``maximum.at``), keeps
those as blocks of ``BLOCK`` neighbouring ids, and the blocks of all splits are
reduced block by block. A hot key costs one slot of one block per split, however
many records it holds, so no task ever receives the records of a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 12
BLOCK = 1 << BLOCK_BITS
FLUSH_ROWS = 1 << 20
_PARTS = "label string, block long, salt int, slots binary, counts binary, ids binary"


def _first_of_runs(*keys: np.ndarray) -> np.ndarray:
    """True where a row of already sorted key columns differs from the row before."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return new


def _best(label: np.ndarray, node: np.ndarray, count: np.ndarray, ident: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per (label, node) the row of the largest count; on a tie, of the smallest id."""
    order = np.lexsort((ident, -count, node, label))
    label, node, count, ident = label[order], node[order], count[order], ident[order]
    keep = _first_of_runs(label, node)
    return label[keep], node[keep], count[keep], ident[keep]


def _total(label: np.ndarray, node: np.ndarray, count: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per (label, node) the sums of both measures."""
    order = np.lexsort((node, label))
    label, node, count, rows = label[order], node[order], count[order], rows[order]
    starts = np.flatnonzero(_first_of_runs(label, node))
    if not len(starts):
        return label, node, count, rows
    return label[starts], node[starts], np.add.reduceat(count, starts), np.add.reduceat(rows, starts)


def _scatter(batch: pa.RecordBatch, labels: dict[str, int], how: str) -> tuple[np.ndarray, ...] | None:
    """One batch as (label code, node, measure, id or rows): dense arrays over the batch's own key codes."""
    path = batch.column("path")
    lengths = np.asarray(pc.fill_null(pc.list_value_length(path), 0))
    flat = pc.list_flatten(path)
    row = np.repeat(np.arange(batch.num_rows), lengths)
    valid = np.asarray(pc.is_valid(flat))
    node = np.abs(np.asarray(pc.fill_null(flat, 0), dtype=np.int64))
    named = batch.column("label").dictionary_encode()
    codes = np.array([labels.setdefault(x, len(labels)) for x in named.dictionary.to_pylist()], dtype=np.int64)
    indices = named.indices
    row_label = codes[np.asarray(pc.fill_null(indices, 0))] if len(codes) else np.zeros(batch.num_rows, np.int64)
    row_ok = np.asarray(pc.is_valid(indices)) & np.asarray(pc.is_valid(batch.column("id")))
    ident = np.asarray(pc.fill_null(batch.column("id"), 0), dtype=np.int64)
    use = valid & (node != 0) & row_ok[row]
    row, node = row[use], node[use]
    if not len(row):
        return None
    nodes, local = np.unique(node, return_inverse=True)
    key = row_label[row] * len(nodes) + local
    keys, code = np.unique(key, return_inverse=True)
    # entries of each (row, key): one bincount over the occurring pairs
    pairs, pair_of = np.unique(row * np.int64(len(keys)) + code, return_inverse=True)
    entries = np.bincount(pair_of, minlength=len(pairs)).astype(np.int64)
    pair_row, pair_code = pairs // len(keys), pairs % len(keys)
    first = np.zeros(len(keys), np.int64)
    second = np.zeros(len(keys), np.int64)
    if how == "best":
        # one int64 orders by count, then by smaller id: ids enter by their rank within the batch
        ids, rank = np.unique(ident[pair_row], return_inverse=True)
        np.maximum.at(first, pair_code, entries * (len(ids) + 1) + (len(ids) - rank))
        first, order = np.divmod(first, len(ids) + 1)
        second = ids[len(ids) - order]
    else:
        np.add.at(first, pair_code, entries)
        np.add.at(second, pair_code, 1)
    return keys // len(nodes), nodes[keys % len(nodes)], first, second


def _blocks(names: list[str], merged: tuple[np.ndarray, ...], salt: int) -> pa.RecordBatch:
    """Sorted (label, node, ...) rows as one row per (label, block); only touched slots are stored."""
    label, node, a, b = merged
    block = node >> BLOCK_BITS
    starts = np.flatnonzero(_first_of_runs(label, block))
    ends = np.append(starts[1:], len(label))
    slot = (node & (BLOCK - 1)).astype(np.int16)
    cut = lambda x: [x[s:e].tobytes() for s, e in zip(starts, ends)]
    return pa.RecordBatch.from_arrays(
        [pa.array([names[i] for i in label[starts]], pa.string()), pa.array(block[starts], pa.int64()), pa.array(np.full(len(starts), salt, np.int32)), pa.array(cut(slot), pa.binary()), pa.array(cut(a), pa.binary()), pa.array(cut(b), pa.binary())],
        names=["label", "block", "salt", "slots", "counts", "ids"],
    )


def _split_reducer(how: str, salts: int):
    merge = _best if how == "best" else _total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ctx = TaskContext.get()
        salt = (ctx.partitionId() if ctx else 0) % salts
        labels: dict[str, int] = {}
        parts: list[tuple[np.ndarray, ...]] = []
        size = settled = 0
        for batch in batches:
            part = _scatter(batch, labels, how)
            if part is None:
                continue
            parts.append(part)
            size += len(part[0])
            if size > FLUSH_ROWS + settled:
                merged = merge(*map(np.concatenate, zip(*parts)))
                parts, size = [merged], len(merged[0])
                settled = size
                if size > FLUSH_ROWS:  # many distinct keys: hand them on instead of holding them
                    yield _blocks(list(labels), merged, salt)
                    parts, size, settled = [], 0, 0
        if parts:
            yield _blocks(list(labels), merge(*map(np.concatenate, zip(*parts))), salt)

    return run


def _reduced(how: str, last: bool, names: tuple[str, str, str, str]):
    """Reduces rows sorted by (label, block[, salt]) into dense block arrays, one block held at a time."""

    def dense() -> tuple[np.ndarray, np.ndarray]:
        return np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.int64)

    def add(acc: tuple[np.ndarray, np.ndarray], slot: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        counts, ids = acc
        if how == "best":
            better = (a > counts[slot]) | ((a == counts[slot]) & (b < ids[slot]))
            slot, a, b = slot[better], a[better], b[better]
            counts[slot], ids[slot] = a, b
        else:
            counts[slot] += a
            ids[slot] += b

    def emit(key: tuple, acc: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        counts, ids = acc
        slot = np.flatnonzero(counts)
        label, block = key[0], key[1]
        if last:
            return pa.RecordBatch.from_arrays(
                [pa.array([label] * len(slot), pa.string()), pa.array((block << BLOCK_BITS) + slot, pa.int64()), pa.array(counts[slot]), pa.array(ids[slot])], names=list(names)
            )
        return pa.RecordBatch.from_arrays(
            [pa.array([label], pa.string()), pa.array([block], pa.int64()), pa.array([key[2]], pa.int32()), pa.array([slot.astype(np.int16).tobytes()], pa.binary()), pa.array([counts[slot].tobytes()], pa.binary()), pa.array([ids[slot].tobytes()], pa.binary())],
            names=["label", "block", "salt", "slots", "counts", "ids"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, acc = None, None
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(6)]
            for label, block, salt, slots, counts, ids in zip(*cols):
                k = (label, block) if last else (label, block, salt)
                if k != key:
                    if acc is not None:
                        yield emit(key, acc)
                    key, acc = k, dense()
                add(acc, np.frombuffer(slots, np.int16).astype(np.int64), np.frombuffer(counts, np.int64), np.frombuffer(ids, np.int64))
        if acc is not None:
            yield emit(key, acc)

    return run


def _accumulate(df: DataFrame, label: str, ident: str, path: str, how: str, out: tuple[str, str, str, str], fan_in: int) -> DataFrame:
    spark = df.sparkSession
    splits = df.select(F.col(label).cast("string").alias("label"), F.col(ident).cast("long").alias("id"), F.col(path).cast("array<long>").alias("path"))
    parts = splits.mapInArrow(_split_reducer(how, fan_in), _PARTS)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # first over `fan_in` salted shares of each block, then over the shares: a block that every split touches stays spread
    shared = parts.repartition(width, "label", "block", "salt").sortWithinPartitions("label", "block", "salt").mapInArrow(_reduced(how, False, out), _PARTS)
    schema = f"{out[0]} string, {out[1]} long, {out[2]} long, {out[3]} long"
    return shared.repartition(width, "label", "block").sortWithinPartitions("label", "block").mapInArrow(_reduced(how, True, out), schema)


def top_read_per_node(df: DataFrame, label: str = "store", ident: str = "read_id", path: str = "path", fan_in: int = 64) -> DataFrame:
    """Per label and unsigned node the id whose path holds the node in the most entries: (store, node, read_id, entries).

    On a tie the smallest id wins. Null, zero (gap) and empty paths give nothing; a row
    with a null label or id belongs to no key and is skipped. Repeated rows change nothing,
    as a maximum is taken. An empty table gives an empty result; other columns are ignored.
    """
    return _accumulate(df, label, ident, path, "best", ("store", "node", "entries", "read_id"), fan_in).select("store", "node", "read_id", "entries")


def entry_totals(df: DataFrame, label: str = "store", ident: str = "read_id", path: str = "path", fan_in: int = 64) -> DataFrame:
    """Per label and unsigned node the path entries and the rows that hold it: (store, node, entries, reads).

    Nulls, gaps, empty paths and empty tables as in :func:`top_read_per_node`. Every row
    counts: remove repeated rows first where they are one record.
    """
    return _accumulate(df, label, ident, path, "total", ("store", "node", "entries", "reads"), fan_in)
