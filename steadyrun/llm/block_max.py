"""Operator 12: exact top-k search by block-at-a-time pruning.

Each dimension is a term. Within a segment rows are ordered by halving along the widest dimension, and cut into
blocks of consecutive rows; a block keeps its rows as a forward index and the largest and smallest value of every
term. A query's bound for a block is the sum of the terms' largest contributions. A query takes blocks in the
order of its bounds and stops where they fall below its k-th score.

Blocks are taken in rounds of doubling length, and those that several queries want in a round are scored at once;
a query's next round begins only if its next bound reaches its k-th score, and within a round blocks below it
are left out. Every block of queries first searches one segment; the k-th scores found there are where the
search of the others starts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from steadyrun.llm.vectors import (
    LOWEST, Best, by_group, dealt, from_bytes, longs, matrix, meetings, parts_of, products, query_blocks,
    to_bytes, usable, widened,
)
from steadyrun.sources.scratch import stored

SEGMENT = "segment int, block int, ids binary, rows int, width int, x binary, high binary, low binary"
FOUND = "qblock int, slot int, query_id long, vec_id long, score long"


def ranges(x: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Row numbers in blocks of at most ``size``, by halving along the widest dimension."""
    open_ = [np.arange(len(x))]
    while open_:
        rows = open_.pop()
        if len(rows) <= size:
            yield rows
            continue
        spread = x[rows].max(axis=0) - x[rows].min(axis=0)
        half = -(-len(rows) // (2 * size)) * size
        order = np.argpartition(x[rows, spread.argmax()], half) if x.shape[1] else np.arange(len(rows))
        open_ += [rows[order[half:]], rows[order[:half]]]


def block_segments(rows: DataFrame, parts: int, block_rows: int) -> DataFrame:
    """The forward indexes and term maxima of all blocks of all segments."""

    def pack(number: int, table: pa.Table) -> Iterator[dict[str, list]]:
        x, ids = matrix(table.column("vector")), np.asarray(table.column("id"), np.int64)
        for k, chosen in enumerate(ranges(x, block_rows)):
            chosen = chosen[np.argsort(ids[chosen], kind="stable")]
            here = x[chosen]
            yield {
                "segment": pa.array([number], pa.int32()), "block": pa.array([k], pa.int32()),
                "ids": [ids[chosen].tobytes()], "rows": pa.array([len(here)], pa.int32()),
                "width": pa.array([x.shape[1]], pa.int32()), "x": [to_bytes(here)],
                "high": [to_bytes(here.max(axis=0))], "low": [to_bytes(here.min(axis=0))],
            }

    return dealt(rows, parts, pack, SEGMENT, "blocks")


def searched(ids: np.ndarray, queries: np.ndarray, blocks: list[dict], k: int, floor: np.ndarray | None = None) -> Best:
    """The k best rows of some blocks for every query; rows with the query's own id are left out."""
    top = Best(len(queries), k, floor)
    width = max(queries.shape[1], blocks[0]["width"])
    queries = widened(queries, width)
    held = [(longs(b["ids"]), widened(from_bytes(b["x"], b["rows"], b["width"]), width)) for b in blocks]
    high, low = (widened(np.concatenate([from_bytes(b[c], 1, b["width"]) for b in blocks]), width) for c in ("high", "low"))
    bounds = products(np.maximum(queries, 0), high) + products(np.minimum(queries, 0), low)
    order = np.argsort(-bounds, axis=1, kind="stable")
    live, at, step = np.arange(len(queries)), 0, 4
    while at < len(blocks) and len(live):
        taken = order[live, at : at + step]
        wanted = bounds[live[:, None], taken] >= top.least(live)[0][:, None]
        query, block = np.repeat(live, taken.shape[1])[wanted.ravel()], taken.ravel()[wanted.ravel()]
        for b, places in by_group(block):
            there, x = held[b]
            some = query[places]
            top.offer(some, products(queries[some], x), there, there[None, :] != ids[some][:, None])
        top.merge()
        at, step = at + step, 2 * step
        if at < len(blocks):
            live = live[bounds[live, order[live, at]] >= top.least(live)[0]]
    return top


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    segment_rows: int = 1 << 15,
    query_rows: int = 1 << 12,
    block_rows: int = 64,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows with the highest inner products (all, if fewer) per query row.

    ``vectors`` has vec_id and embedding; ``is_query`` is a condition on its columns. Ties go to the smaller
    vec_id. Rows without vec_id, and vectors that are null or hold null or non-finite components, take no part.
    Rows that repeat a vec_id are rows like others, but none with the query's own id is given to it; a repeated
    query row gets its rows again. Of vectors of different lengths the shorter one ends in zeros. Other columns
    are ignored; an empty table gives no rows. A score beyond 2^62, also that of a query with itself, fails the job.

    A task holds ``segment_rows`` vectors and ``query_rows`` queries at most.
    """
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vector"),
        F.lit(None).cast("long").alias("label"), is_query.alias("asks"),
    ).where(F.col("id").isNotNull() & usable(F.col("vector")))
    total, asking = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    parts, blocks = parts_of(total, segment_rows), parts_of(asking, query_rows)
    segments = block_segments(rows.select("id", "vector"), parts, block_rows)
    queries = query_blocks(rows.where("asks").select("id", "label", "vector"), blocks)

    def work(block: dict, held: list[dict]) -> dict[str, np.ndarray]:
        ids, floor = longs(block["ids"]), np.full(block["rows"], LOWEST)
        for slot, score in block.get("floors") or ():
            floor[slot] = score
        x = from_bytes(block["x"], block["rows"], block["width"])
        slot, found, score = searched(ids, x, held, k, floor).rows()
        return {"qblock": np.full(len(slot), block["qblock"]), "slot": slot, "query_id": ids[slot], "vec_id": found, "score": score}

    own = F.pmod("qblock", F.lit(parts)) == F.col("segment")
    seeds = stored(meetings(queries, blocks, segments, parts, work, FOUND, own), "seeds")
    kth = seeds.groupBy("qblock", "slot").agg(F.min("score").alias("score"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k)
    # A block of queries has ``query_rows`` slots at most.
    floors = kth.groupBy("qblock").agg(F.collect_list(F.array(F.col("slot").cast("long"), "score")).alias("floors"))
    rest = meetings(queries.join(floors, "qblock", "left"), blocks, segments, parts, work, FOUND, ~own)
    best = Window.partitionBy("qblock", "slot").orderBy(F.desc("score"), "vec_id")
    ranked = seeds.union(rest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
