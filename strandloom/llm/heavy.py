"""Most frequent items in bounded memory: a majority-vote sketch.

Each of ``rows`` hash rows has ``cells`` cells with a total V, a candidate and its vote
surplus K. Cells merge by vote cancellation: totals add up, the larger surplus less the
smaller one stays. In every cell the candidate occurred between K and (V + K) / 2 times,
anything else at most (V - K) / 2 times. These bounds hold for any order of merging
and any data, so the items whose least upper bound reaches the k-th lower bound
always include the k most frequent ones; only those are counted exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.session import persisted, shuffle_width

#: Odd multipliers of the row hashes.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
_CELL = "hash_row int, cell int, total long, item long, surplus long"


def cell_of(items: np.ndarray, row: int, cells: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = items.astype(np.uint64) * _MIX[row]
        x ^= x >> np.uint64(29)
        x *= _MIX[(row + 1) % len(_MIX)]
    return ((x >> np.uint64(33)) % np.uint64(cells)).astype(np.int64)


class VoteSketch:
    """Arrays of totals, candidates and surpluses; its size is fixed whatever is added."""

    def __init__(self, rows: int, cells: int) -> None:
        self.rows, self.cells = rows, cells
        self.total, self.item, self.surplus = (np.zeros((rows, cells), np.int64) for _ in range(3))

    def add(self, items: np.ndarray, amounts: np.ndarray) -> None:
        """Adds amounts > 0 of items."""
        items, at = np.unique(items, return_inverse=True)
        sums = np.zeros(len(items), np.int64)
        np.add.at(sums, at, amounts)
        for r in range(self.rows):
            cell = cell_of(items, r, self.cells)
            order = np.lexsort((-sums, cell))
            hit, first = np.unique(cell[order], return_index=True)
            total = np.add.reduceat(sums[order], first) if len(first) else np.zeros(0, np.int64)
            best = order[first]
            # all votes of the cell against those of its largest item
            self.merge(r, hit, total, items[best], np.maximum(0, 2 * sums[best] - total))

    def merge(self, r: int, cell: np.ndarray, total: np.ndarray, item: np.ndarray, surplus: np.ndarray) -> None:
        """Merges other cells, each given once, by vote cancellation."""
        mine, held = self.item[r, cell], self.surplus[r, cell]
        same = mine == item
        self.item[r, cell] = np.where(same | (held >= surplus), mine, item)
        self.surplus[r, cell] = np.where(same, held + surplus, np.abs(held - surplus))
        self.total[r, cell] += total

    def upper(self, items: np.ndarray) -> np.ndarray:
        """No item occurred more often."""
        best = None
        for r in range(self.rows):
            c = cell_of(items, r, self.cells)
            v, k = self.total[r, c], self.surplus[r, c]
            bound = np.where(self.item[r, c] == items, (v + k) // 2, (v - k) // 2)
            best = bound if best is None else np.minimum(best, bound)
        return best

    def candidates(self) -> tuple[np.ndarray, np.ndarray]:
        """Items that are candidates anywhere, and how often they occurred at least."""
        voted = self.surplus > 0
        items, at = np.unique(self.item[voted], return_inverse=True)
        lower = np.zeros(len(items), np.int64)
        np.maximum.at(lower, at, self.surplus[voted])
        return items, lower


def _split_sketch(rows: int, cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = VoteSketch(rows, cells)
        for b in batches:
            if b.num_rows:
                sketch.add(np.asarray(b.column("item")), np.asarray(b.column("amount")))
        r, c = np.nonzero(sketch.total)
        yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(sketch.total[r, c]), pa.array(sketch.item[r, c]), pa.array(sketch.surplus[r, c])], names=["hash_row", "cell", "total", "item", "surplus"])

    return run


def _merge_cells(rows: int, cells: int):
    """Merges the cells that reach one task; a task holds only those of its own cell range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = VoteSketch(rows, cells)
        for b in batches:
            row, cell, total, item, surplus = (np.asarray(b.column(i)) for i in range(5))
            key = row.astype(np.int64) * cells + cell
            order = np.argsort(key, kind="stable")
            nth = np.arange(len(key)) - np.searchsorted(key[order], key[order], "left")
            for n in range(int(nth.max(initial=-1)) + 1):  # a cell may come once per split
                at = order[nth == n]
                for r in np.unique(row[at]):
                    own = at[row[at] == r]
                    sketch.merge(int(r), cell[own], total[own], item[own], surplus[own])
        r, c = np.nonzero(sketch.total)
        yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(sketch.total[r, c]), pa.array(sketch.item[r, c]), pa.array(sketch.surplus[r, c])], names=["hash_row", "cell", "total", "item", "surplus"])

    return run


def vote_sketch(df: DataFrame, rows: int = 4, cells: int = 1 << 14) -> VoteSketch:
    """The sketch of ``item``/``amount`` (longs, amount > 0): made per split, merged by cell range, ``rows * cells`` cells to the driver."""
    parts = df.select("item", "amount").mapInArrow(_split_sketch(rows, cells), _CELL)
    width = shuffle_width(df.sparkSession)
    merged = parts.repartition(width, "hash_row", "cell").mapInArrow(_merge_cells(rows, cells), _CELL).toArrow()
    sketch = VoteSketch(rows, cells)
    r, c = (np.asarray(merged.column(n)) for n in ("hash_row", "cell"))
    for name in ("total", "item", "surplus"):
        getattr(sketch, name)[r, c] = np.asarray(merged.column(name))
    return sketch


def _above(sketch: VoteSketch, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(sketch.upper(np.asarray(b.column("item"))) >= least))

    return run


def _usable(df: DataFrame, item: str, amount: str) -> DataFrame:
    return df.select(F.col(item).cast("long").alias("item"), F.col(amount).cast("long").alias("amount")).where("item is not null and amount > 0")


def _floor(sketch: VoteSketch, k: int) -> int:
    """At least k items occurred this often (1 if the sketch knows fewer)."""
    _, lower = sketch.candidates()
    return int(np.sort(lower)[-k]) if len(lower) >= k else 1


def top_items(df: DataFrame, k: int, item: str = "item", amount: str = "amount", rows: int = 4, cells: int = 1 << 14) -> DataFrame:
    """The ``k`` items of the largest total amount, exactly: (item, total); on a tie the smaller item.

    Rows with a null item, or an amount that is null or not above 0, count nowhere. Fewer
    than ``k`` items give all of them, an empty table none; repeated rows count each time;
    other columns are ignored. The sketch leaves few items to count exactly if ``cells``
    exceeds the total divided by the k-th total; with too few cells more are counted, and the
    result is the same.
    """
    kept = persisted(_usable(df, item, amount), "heavy")
    sketch = vote_sketch(kept, rows, cells)
    near = kept.mapInArrow(_above(sketch, _floor(sketch, k)), "item long, amount long")
    return near.groupBy("item").agg(F.sum("amount").alias("total")).orderBy(F.desc("total"), "item").limit(k)


def approximate_top(df: DataFrame, k: int, item: str = "item", amount: str = "amount", rows: int = 4, cells: int = 1 << 14) -> DataFrame:
    """The ``k`` candidates with the largest lower bounds: (item, at_least, at_most), from one pass; nulls as in :func:`top_items`."""
    sketch = vote_sketch(_usable(df, item, amount), rows, cells)
    items, lower = sketch.candidates()
    best = np.lexsort((items, -lower))[:k]
    upper = sketch.upper(items[best])
    return df.sparkSession.createDataFrame([(int(a), int(b), int(c)) for a, b, c in zip(items[best], lower[best], upper)], "item long, at_least long, at_most long")
