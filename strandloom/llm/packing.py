"""Texts packed into containers of fixed capacity, by exact complements.

Items are reduced to a histogram of lengths, at most one entry per token of capacity.
For every length, longest first, the gap up to the capacity is looked up in an index of
single lengths, sums of two and sums of three, and combinations that fill it exactly
are used up as often as all their lengths last. What no combination completes is
packed by best fit. A plan says how often which lengths go together; documents are
then drawn from their length in order of id.

Documents are packed in groups of about ``group_size``, by hash of the id, each in one
task that holds two numbers per document; a group leaves at most its last few
containers part-filled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.tokens import DEFAULT_VOCABULARY, with_sizes
from strandloom.session import persisted

GROUP_SIZE = 1 << 17
_OUT = "container string, container_no long, doc_id long, piece_no int, token_from long, n_tokens long"
Plan = list[tuple[tuple[int, ...], int]]


class _Lengths:
    """Counts by length and the index of the sums of two available lengths."""

    def __init__(self, counts: np.ndarray, capacity: int) -> None:
        self.left, self.capacity = counts.copy(), capacity
        self.gone = 0
        self._index()

    def _index(self) -> None:
        have = (self.left > 0).astype(np.float64)
        size = 1 << int(2 * len(have)).bit_length()
        spectrum = np.fft.rfft(have, size)
        self.pair_sums = np.rint(np.fft.irfft(spectrum * spectrum, size)[: self.capacity + 1]) > 0
        self.gone = 0

    def times(self, combination: tuple[int, ...]) -> int:
        need = np.bincount(combination)
        at = np.flatnonzero(need)
        return int((self.left[at] // need[at]).min())

    def use(self, combination: tuple[int, ...], times: int) -> None:
        for length in combination:
            self.left[length] -= times
            self.gone += self.left[length] == 0
        if self.gone > 64:  # lengths only run out, so an old index offers too much, never too little
            self._index()

    def pairs(self, total: int) -> np.ndarray:
        """First lengths a >= b of available pairs with a + b = total, longest first."""
        if total < 2 or not self.pair_sums[total]:
            return np.zeros(0, np.int64)
        a = np.arange((total + 1) // 2, total)
        return a[(self.left[a] > 0) & (self.left[total - a] > 0)][::-1]

    def fillers(self, gap: int, items: int) -> Iterator[tuple[int, ...]]:
        """Combinations of ``items`` (one to three) lengths that fill the gap."""
        if items == 1:
            if self.left[gap]:
                yield (gap,)
        elif items == 2:
            for a in self.pairs(gap):
                yield (int(a), int(gap - a))
        else:
            firsts = np.arange(gap - 2, 0, -1)
            firsts = firsts[(self.left[firsts] > 0) & self.pair_sums[gap - firsts]]
            for a in firsts:
                if self.left[a]:
                    for b in self.pairs(int(gap - a))[:1]:
                        yield (int(a), int(b), int(gap - a - b))


def pack_plan(counts: np.ndarray, capacity: int) -> Plan:
    """Combinations of lengths and how many containers get each; ``counts[n]`` items have length n <= capacity.

    Where short items are scarce, filling gaps by two or three of them leaves later ones
    open; so the plan with complements of single lengths only is made too, and the one with fewer containers taken.
    """
    return min((_plan(counts, capacity, most) for most in (3, 1)), key=lambda plan: sum(n for _, n in plan))


def _plan(counts: np.ndarray, capacity: int, most: int) -> Plan:
    lengths = _Lengths(np.asarray(counts, dtype=np.int64), capacity)
    plan: Plan = []
    if n := int(lengths.left[capacity]):
        plan.append(((capacity,), n))
        lengths.left[capacity] = 0
    # all gaps that one length fills, then those that two fill, then three: so no gap's only partner goes to a gap with others
    for items in range(1, most + 1):
        for length in range(capacity - 1, 0, -1):
            before = -1
            while lengths.left[length] and lengths.left[length] != before:
                before = int(lengths.left[length])
                for filler in lengths.fillers(capacity - length, items):
                    combination = (length, *filler)
                    if n := lengths.times(combination):
                        plan.append((combination, n))
                        lengths.use(combination, n)
                    if not lengths.left[length]:
                        break
    # best fit, longest first; containers of equal content stay together
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    waiting = np.zeros(capacity + 1, np.int64)
    for length in range(capacity, 0, -1):
        n = int(lengths.left[length])
        while n:
            fits = np.flatnonzero(waiting[length:])
            room = int(fits[0]) + length if len(fits) else capacity
            if len(fits):
                content, m = open_[room].pop()
                waiting[room] -= m
            else:
                content, m = (), -(-n // (capacity // length))
            put = min(n, m)
            if put < m and content:
                open_[room].append((content, m - put))
                waiting[room] += m - put
            open_[room - length].append(((*content, length), put))
            waiting[room - length] += put
            n -= put
    plan += [x for held in open_.values() for x in held]
    return plan


def _assign(doc: np.ndarray, size: np.ndarray, capacity: int) -> tuple[np.ndarray, ...]:
    """(container, document, piece, first token, tokens) for the documents of one group."""
    order = np.argsort(doc, kind="stable")
    doc, size = doc[order], size[order]
    whole, rest = np.divmod(size, capacity)
    # full pieces of long documents have a container each
    owner = np.repeat(np.arange(len(doc)), whole)
    piece = np.arange(len(owner)) - np.repeat(np.cumsum(whole) - whole, whole)
    parts = [(np.arange(len(owner)), doc[owner], piece, piece * capacity, np.full(len(owner), capacity))]
    used = len(owner)
    items = np.flatnonzero(rest)
    items = items[np.argsort(rest[items], kind="stable")]
    counts = np.bincount(rest[items], minlength=capacity + 1)
    begin = np.concatenate([[0], np.cumsum(counts)])[: capacity + 1].copy()
    for combination, n in pack_plan(counts, capacity):
        for length in combination:
            at = items[begin[length] : begin[length] + n]
            begin[length] += n
            parts.append((np.arange(used, used + n), doc[at], whole[at], whole[at] * capacity, rest[at]))
        used += n
    empty = np.flatnonzero(size == 0)
    zeros = np.zeros(len(empty), np.int64)
    parts.append((zeros, doc[empty], zeros, zeros, zeros))
    return tuple(np.concatenate(c) for c in zip(*parts))


def _pack_groups(limits: list[tuple[str, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        task = rows.column("task")[0].as_py()
        group, (name, capacity) = task // len(limits), limits[task % len(limits)]
        no, doc, piece, first, tokens = _assign(rows.column("doc_id").to_numpy(), rows.column("n_tokens").to_numpy(), capacity)
        no = no + (group << 40)
        for at in range(0, len(no), 1 << 16):
            c = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(no[c]), pa.string()), pa.array(no[c]), pa.array(doc[c]), pa.array(piece[c].astype(np.int32)), pa.array(first[c].astype(np.int64)), pa.array(tokens[c].astype(np.int64))],
                names=["container", "container_no", "doc_id", "piece_no", "token_from", "n_tokens"],
            )

    return run


def pack(sizes: DataFrame, limits: list[tuple[str, int]], group_size: int = GROUP_SIZE) -> DataFrame:
    """Every document in a container of each kind: (container, container_no, doc_id, piece_no, token_from, n_tokens).

    ``sizes`` has ``doc_id`` and ``n_tokens``; ``limits`` names each kind with its capacity
    above 0. A document longer than a capacity fills containers of its own and leaves one
    last piece; no other is split. A document without tokens goes to container 0 of its
    group with 0 tokens. Rows with a null id or size, or a size below 0, are no documents;
    equal ids are packed as often as they come; an empty table or no limits give an
    empty result; other columns are ignored.
    """
    rows = sizes.select(F.col("doc_id").cast("long"), F.col("n_tokens").cast("long")).where("doc_id is not null and n_tokens >= 0")
    if not limits or any(c <= 0 for _, c in limits):
        if limits:
            raise ValueError("capacities must be above 0")
        return rows.limit(0).selectExpr("'' container", "0L container_no", "doc_id", "0 piece_no", "0L token_from", "n_tokens")
    groups = max(1, -(-rows.count() // group_size))
    kinds = F.explode(F.array(*(F.lit(i) for i in range(len(limits)))))
    tasks = rows.withColumn("kind", kinds).select("doc_id", "n_tokens", (F.pmod(F.xxhash64("doc_id"), F.lit(groups)) * len(limits) + F.col("kind")).cast("int").alias("task"))
    return tasks.repartitionById(groups * len(limits), F.col("task")).mapInArrow(_pack_groups(limits), _OUT)


def document_sizes(documents: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens), counted once and kept in the shared folder."""
    return persisted(with_sizes(documents, keep={"doc_id": "doc_id"}, vocabulary=vocabulary), "sizes")


def fill_report(packed: DataFrame, limits: list[tuple[str, int]]) -> DataFrame:
    """Per kind: (container, containers, tokens, room, unused_share, least_containers)."""
    capacity = F.create_map(*(F.lit(x) for pair in limits for x in pair))[F.col("container")]
    one = packed.groupBy("container", "container_no").agg(F.sum("n_tokens").alias("tokens"))
    kinds = one.groupBy("container").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"))
    room = F.col("containers") * capacity
    return kinds.select("container", "containers", "tokens", room.cast("long").alias("room"), (1 - F.col("tokens") / room).alias("unused_share"), F.ceil(F.col("tokens") / capacity).alias("least_containers"))
