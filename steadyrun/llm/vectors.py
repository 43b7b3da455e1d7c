"""Integer vectors in packed segments, and blocks of queries that meet them.

A component x counts as floor(256 x). Rows are dealt evenly into segments of bounded size, each packed by the
task that holds it; queries into blocks. Every block meets every segment in a group of its own, whose size does
not depend on the data: a stated query set against all rows, in blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from steadyrun.sources.scratch import stored

SCALE = 256
LOWEST = np.iinfo(np.int64).min
HIGHEST = np.iinfo(np.int64).max
PENDING = 1 << 20
EXACT = float(1 << 53)


def usable(vector: Column) -> Column:
    """True where neither the vector nor a component is null, and all components are finite."""
    parts = vector.cast("array<double>")
    bad = F.exists(parts, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return parts.isNotNull() & ~bad


def matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """floor(256 x) of all components, a row per vector; shorter ones are filled up with zeros."""
    held = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = np.asarray(held.value_lengths(), np.int64)
    values = np.floor(np.asarray(held.flatten(), np.float64) * SCALE)
    if len(values) and np.abs(values).max() >= EXACT:
        raise OverflowError("a component is too large for an exact score")
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = values
    return out


def to_bytes(x: np.ndarray) -> bytes:
    small = np.abs(x).max(initial=0) < 2**31
    return x.astype("<i4" if small else "<i8").tobytes()


def from_bytes(data: bytes, rows: int, width: int) -> np.ndarray:
    """The matrix packed by ``to_bytes``, as doubles."""
    kind = "<i4" if len(data) == 4 * rows * width else "<i8"
    return np.frombuffer(data, kind).reshape(rows, width).astype(np.float64)


def longs(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i8")


def widened(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows; too large ones for a long fail."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(a.shape[1], 1)
    if most < EXACT:
        return (a @ b.T).astype(np.int64)
    if most < 2.0**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    raise OverflowError("a score is too large for a long")


class Best:
    """The k best (score, id) of every slot: higher scores first, then smaller ids.

    ``floor`` has per slot a score that k others are known to reach, so lower ones are of no use.
    """

    def __init__(self, slots: int, k: int, floor: np.ndarray | None = None):
        self.k = k
        self.scores = np.full((slots, k), LOWEST)
        self.ids = np.full((slots, k), HIGHEST)
        self.sizes = np.zeros(slots, np.int64)
        self.floor = np.full(slots, LOWEST) if floor is None else floor
        self.pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def least(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The (score, id) that a candidate of these slots must not fall behind."""
        score, ident = self.scores[slots, -1], self.ids[slots, -1]
        held = (self.sizes[slots] == self.k) & (score >= self.floor[slots])
        return np.where(held, score, self.floor[slots]), np.where(held, ident, HIGHEST)

    def offer(self, slots: np.ndarray, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """Scores of some slots (rows) with some ids (columns), where ``allowed``."""
        for at in range(0, len(slots), max(1, PENDING // max(len(ids), 1))):
            part = slice(at, at + max(1, PENDING // max(len(ids), 1)))
            score, ident = self.least(slots[part])
            here = scores[part]
            good = (here > score[:, None]) | ((here == score[:, None]) & (ids <= ident[:, None]))
            row, column = np.nonzero(good & allowed[part])
            if len(row):
                self.pending.append((slots[part][row], here[row, column], ids[column]))
                self.waiting += len(row)
            if self.waiting > PENDING:
                self.merge()

    def merge(self) -> None:
        if not self.pending:
            return
        touched = np.unique(np.concatenate([p[0] for p in self.pending]))
        old = np.repeat(touched, self.k), self.scores[touched].ravel(), self.ids[touched].ravel()
        filled = (np.arange(self.k) < self.sizes[touched][:, None]).ravel()
        parts = [*self.pending, tuple(x[filled] for x in old)]
        slot, score, ident = (np.concatenate([p[k] for p in parts]) for k in range(3))
        order = np.lexsort((ident, -score, slot))
        slot, score, ident = slot[order], score[order], ident[order]
        first = np.searchsorted(slot, touched)
        rank = np.arange(len(slot)) - np.repeat(first, np.diff(np.append(first, len(slot))))
        stays = rank < self.k
        slot, score, ident, rank = slot[stays], score[stays], ident[stays], rank[stays]
        self.scores[slot, rank], self.ids[slot, rank] = score, ident
        self.sizes[touched] = np.minimum(np.diff(np.append(first, len(order))), self.k)
        self.pending, self.waiting = [], 0

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slot, id, score) of all that is held."""
        self.merge()
        slot, rank = np.nonzero(np.arange(self.k) < self.sizes[:, None])
        return slot, self.ids[slot, rank], self.scores[slot, rank]


def by_group(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, places that have it) for every key."""
    order = np.argsort(keys, kind="stable")
    found, first = np.unique(keys[order], return_index=True)
    for key, places in zip(found.tolist(), np.split(order, first[1:]), strict=True) if len(found) else ():
        yield key, places


def parts_of(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def dealt(
    rows: DataFrame, parts: int, pack: Callable[[int, pa.Table], Iterator[dict[str, list]]], schema: str, label: str
) -> DataFrame:
    """``rows`` dealt evenly into parts, each turned into packed rows by ``pack(number of the part, its rows)``.

    Written to the shared folder, so all that read it see the same parts.
    """
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held).rename_columns(names)
            for columns in pack(TaskContext.get().partitionId(), table):
                yield pa.RecordBatch.from_pydict(columns)

    return stored(rows.repartition(parts).mapInArrow(run, schema), label)


QUERY_BLOCK = "qblock int, ids binary, labels binary, rows int, width int, x binary"


def query_blocks(rows: DataFrame, parts: int) -> DataFrame:
    """Blocks of queries (id, label, vector); label may be null."""

    def pack(number: int, table: pa.Table) -> Iterator[dict[str, list]]:
        x = matrix(table.column("vector"))
        labels = np.asarray(table.column("label").fill_null(0), np.int64)
        yield {
            "qblock": pa.array([number], pa.int32()), "ids": [np.asarray(table.column("id"), np.int64).tobytes()],
            "labels": [labels.tobytes()], "rows": pa.array([len(x)], pa.int32()),
            "width": pa.array([x.shape[1]], pa.int32()), "x": [to_bytes(x)],
        }

    return dealt(rows, parts, pack, QUERY_BLOCK, "queries")


def meetings(
    queries: DataFrame, blocks: int, segments: DataFrame, parts: int, work: Callable[[dict, list[dict]], dict[str, np.ndarray]],
    schema: str, which: Column | None = None,
) -> DataFrame:
    """``work(query block, packed rows of a segment)`` for every block and segment, or those where ``which`` holds.

    ``which`` is a condition on qblock and segment.
    """
    which = F.lit(True) if which is None else which
    left = queries.withColumn("segment", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).where(which)
    right = segments.withColumn("qblock", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).where(which)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return empty
        return pa.Table.from_pydict(work(left.to_pylist()[0], right.to_pylist()), schema=empty.schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    empty = to_arrow_schema(StructType.fromDDL(schema)).empty_table()
    keys = ["qblock", "segment"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)
