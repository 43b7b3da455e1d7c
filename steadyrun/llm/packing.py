"""Operator 8: best-fit packing after Martello-Toth dominance reduction.

Pieces of documents differ, for packing, in their lengths only, so the instance is the number of pieces of
each length: at most ``capacity`` numbers, whatever the size of the corpus. The plan made from it says which
ranks of each length go to which sequences; pieces get their rank, and with it their place, on the executors.

Reduction: the longest piece j leaves room r. A set with j dominates all other sets with j if each of them
fits, piece by piece, into its members. So j is fixed
- alone, if no piece fits into r;
- with a piece of length r exactly;
- with the longest piece that fits, if no two fit, or if it is as long as any two that fit;
- with two pieces, if no three fit and the two are at least as long as the longer and the shorter of any two.
What is left is packed best-fit, longest first, equal pieces and equal bins at once.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from steadyrun.llm.tokens import encoder
from steadyrun.sources.scratch import stored

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, nth long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class Bins:
    """Bins that hold the same lengths, counted."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.groups: list[tuple[tuple[int, ...], int]] = []

    def fix(self, lengths: tuple[int, ...], times: int) -> None:
        if times:
            self.groups.append((lengths, times))


class Stock:
    """The pieces that are left: lengths in order, and how many of each."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {k: v for k, v in counts.items() if v > 0}
        self.lengths = sorted(self.counts)

    def take(self, length: int, times: int) -> None:
        self.counts[length] -= times
        if not self.counts[length]:
            del self.counts[length]
            del self.lengths[bisect_left(self.lengths, length)]

    def smallest(self, n: int) -> list[int]:
        out: list[int] = []
        for length in self.lengths:
            out += [length] * min(self.counts[length], n - len(out))
            if len(out) == n:
                break
        return out

    def longest_within(self, room: int) -> int | None:
        k = bisect_right(self.lengths, room)
        return self.lengths[k - 1] if k else None

    def pairs(self, room: int) -> tuple[int, int]:
        """Over all two pieces that fit into ``room`` together: the largest sum, and the largest shorter one."""
        best_sum, best_short, hi = 0, 0, len(self.lengths) - 1
        for lo, short in enumerate(self.lengths):
            if 2 * short > room:
                break
            while self.lengths[hi] + short > room:
                hi -= 1
            if hi > lo or self.counts[short] > 1:
                best_sum = max(best_sum, short + self.lengths[hi] if hi > lo else 2 * short)
                partner = short if self.counts[short] > 1 else self.lengths[lo + 1]
                if short + partner <= room:
                    best_short = short
        return best_sum, best_short


def _dominating(stock: Stock, room: int) -> tuple[int, ...] | None:
    """The pieces that go with one that leaves ``room``, if some set dominates all others."""
    few = stock.smallest(3)
    if not few or few[0] > room:
        return ()
    if room in stock.counts:
        return (room,)
    longest = stock.longest_within(room)
    if len(few) < 2 or few[0] + few[1] > room:
        return (longest,)
    if len(few) == 3 and sum(few) <= room:
        return None
    best_sum, best_short = stock.pairs(room)
    if longest >= best_sum:
        return (longest,)
    rest = room - longest
    if best_short and best_short <= rest and (best_short != longest or stock.counts[longest] > 1):
        return (longest, best_short)
    return None


def reduce_instance(stock: Stock, bins: Bins) -> None:
    """Fix dominating sets until no piece has one; ``stock`` keeps the rest."""
    changed = True
    while changed:
        changed = False
        for length in sorted(stock.counts, reverse=True):
            while stock.counts.get(length):
                stock.take(length, 1)
                others = _dominating(stock, bins.capacity - length)
                times = 0
                if others is not None:
                    need = {x: others.count(x) for x in others}
                    need[length] = need.get(length, 0)
                    times = min([1 + stock.counts.get(length, 0) // (1 + need[length])] + [
                        stock.counts[x] // n for x, n in need.items() if n and x != length
                    ])
                    if need[length]:
                        times = min(times, (1 + stock.counts.get(length, 0)) // (1 + need[length]))
                stock.counts[length] = stock.counts.get(length, 0) + 1
                if stock.counts[length] == 1:
                    insort(stock.lengths, length)
                if not times:
                    break
                bins.fix((length, *others), times)
                for x in (length, *others):
                    stock.take(x, times)
                changed = True


def best_fit(stock: Stock, bins: Bins) -> None:
    """Pack the rest longest first, each piece into the bin with the least room that takes it."""
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []

    def put(room: int, held: tuple[int, ...], times: int) -> None:
        if times:
            if room not in open_bins:
                insort(rooms, room)
            open_bins.setdefault(room, []).append((held, times))

    for length in sorted(stock.counts, reverse=True):
        left = stock.counts[length]
        for room in rooms[bisect_left(rooms, length) :]:
            if not left:
                break
            each, groups = room // length, open_bins.pop(room)
            del rooms[bisect_left(rooms, room)]
            for held, times in groups:
                full = min(times, left // each)
                put(room - each * length, held + (length,) * each, full)
                left -= full * each
                part = left if full < times and left else 0
                if part:
                    put(room - part * length, held + (length,) * part, 1)
                    left = 0
                put(room, held, times - full - bool(part))
        each = bins.capacity // length
        put(bins.capacity - each * length, (length,) * each, left // each)
        if left % each:
            put(bins.capacity - left % each * length, (length,) * (left % each), 1)
    for groups in open_bins.values():
        for held, times in groups:
            bins.fix(held, times)


def plan(counts: dict[int, int], capacity: int) -> dict[int, np.ndarray]:
    """Per length, rows (first rank, first sequence, offset): rank k >= first goes to sequence + (k - first)."""
    bins, stock = Bins(capacity), Stock(counts)
    reduce_instance(stock, bins)
    best_fit(stock, bins)
    used: dict[int, int] = {}
    slots: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for lengths, times in bins.groups:
        offset = 0
        for length in lengths:
            first = used.get(length, 0)
            slots.setdefault(length, []).append((first, sequence, offset))
            used[length] = first + times
            offset += length
        sequence += times
    return {length: np.array(rows, np.int64) for length, rows in slots.items()}


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, added_tokens: bool = False) -> DataFrame:
    """The pieces of every document; ``nth`` counts the pieces of a length within a task, ``part``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, part = encoder(tokenizer, added_tokens), end_id.to_bytes(4, "little"), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                ids = encode(text.as_py()) + end
                key = doc_id.as_py()
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    piece = ids[at : at + 4 * capacity]
                    length = len(piece) // 4
                    rows.append((key, k, at // 4, length, zlib.crc32(piece), part, int(seen[length])))
                    seen[length] += 1
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, PIECES)


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, added_tokens: bool = False
) -> DataFrame:
    """Where each piece of each document (columns doc_id and text) goes.

    A document is its ids and one ``end_id``; only longer ones are cut, into pieces of ``capacity`` ids. A
    null text counts as empty, so it is one piece of one id. A row without doc_id, or with one that others
    have too, is packed like any other. Other columns are ignored; an empty table gives no rows.
    ``added_tokens``: see ``tokens.Encoder``.
    """
    cut = stored(pieces(docs, tokenizer, capacity, end_id, added_tokens), "pieces")
    per_part = stored(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = plan(counts, capacity)

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(bases, ["part", "length"]).select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
        (F.col("base") + F.col("nth")).alias("rank"),
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                own = slots[int(length[rows[0]])]
                at = np.searchsorted(own[:, 0], rank[rows], side="right") - 1
                sequence[rows] = own[at, 1] + rank[rows] - own[at, 0]
                offset[rows] = own[at, 2]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, PLACED)
