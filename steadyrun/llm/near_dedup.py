"""Operator 4: near-duplicate groups by min-max hashing.

Each permutation of the shingle hashes keeps its minimum and its maximum, so 80 permutations give a signature
of 160 values. Bands of five values (the minima of five permutations, or their maxima) put documents into
buckets; a pair of similarity 0.85 misses all 32 bands once in 10^8, one of 0.8 once in 10^5.

Links are confirmed on full shingle sets, and no bucket is expanded into all its pairs:

1. documents with equal sets form one class at once;
2. every class of a bucket is compared with the bucket's smallest and largest class;
3. components of the confirmed links are taken; members of a bucket that still holds several are compared in
   blocks of bounded size, counting common shingles as a product of bit matrices. Only links come out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from steadyrun.llm.graph import components
from steadyrun.sources.scratch import stored

SIGNATURES = "doc_id long, node binary, n_shingles long, bands array<long>"
SETS = "doc_id long, node binary, shingles array<long>"
BLOCK = 1 << 14
MEMBERS = 256
ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text.

    Words are runs of anything but the six ASCII white-space characters, A-Z in lower case. A text of fewer
    words than ``width`` is one shingle; null, empty and blank texts have none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    n = len(words) - width + 1
    out = hashes[:n].copy()
    for k in range(1, width):
        out = mixed(out * ODD + hashes[k : n + k])
    return np.unique(out)


def band_keys(found: np.ndarray, factors: np.ndarray, shifts: np.ndarray, rows: int) -> np.ndarray:
    """One key per band: per ``rows`` permutations one of their minima and one of their maxima."""
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(len(factors), np.uint64)
    for at in range(0, len(found), BLOCK):
        values = mixed(found[at : at + BLOCK][None, :] * factors[:, None] + shifts[:, None])
        np.minimum(low, values.min(axis=1), out=low)
        np.maximum(high, values.max(axis=1), out=high)
    grid = np.stack([low.reshape(-1, rows), high.reshape(-1, rows)], axis=1).reshape(-1, rows)
    keys = np.arange(1, len(grid) + 1, dtype=np.uint64) * ODD
    for k in range(rows):
        keys = mixed(keys * ODD + grid[:, k])
    return keys


def _node(found: np.ndarray) -> bytes | None:
    return hashlib.md5(found.tobytes()).digest() if len(found) else None


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def signatures(docs: DataFrame, width: int, bands: int, rows: int, seed: int) -> DataFrame:
    rng = np.random.default_rng(seed)
    factors = rng.integers(0, 1 << 63, bands * rows // 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 1 << 63, bands * rows // 2, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, counts, keys = [], [], []
            for text in batch.column("text"):
                found = shingles(text.as_py(), width)
                nodes.append(_node(found))
                counts.append(len(found))
                keys.append(band_keys(found, factors, shifts, rows).view(np.int64) if len(found) else [])
            ids = batch.column("doc_id")
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(nodes, pa.binary()), pa.array(counts, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "node", "n_shingles", "bands"],
            )

    return _texts(docs).mapInArrow(run, SIGNATURES)


def _sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py(), width) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([_node(x) for x in found], pa.binary()),
                    pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64())),
                ],
                names=["doc_id", "node", "shingles"],
            )

    return _texts(docs).mapInArrow(run, SETS)


def _number(doc_id: Column) -> Column:
    """A class is named by its smallest doc_id, or by a negative number from its set where all ids are null."""
    return F.coalesce(doc_id, -1 - F.conv(F.substring(F.hex("node"), 1, 15), 16, 10).cast("long"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    left = sets.select(F.col("number").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("number").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("x", "y"))
    both = both.select("a", "b", shared.alias("shared"), (F.size("x") + F.size("y")).alias("sizes"))
    return both.where(f"100 * shared >= {percent} * (sizes - shared)").select("a", "b").distinct()


def _open_blocks(named: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, dealt into pairs of blocks.

    Every two members of a bucket that may still be linked meet in one pair of blocks (i, j), i <= j, of about
    ``2 * MEMBERS`` rows, whatever the size of the bucket. The largest component has blocks of its own, which
    meet those of the other members only. Buckets of two or three classes are settled by their two ends, and
    of buckets with the same members one is enough.
    """
    sizes = named.groupBy("key", "component").agg(
        F.count(F.lit(1)).alias("size"), F.sum(F.xxhash64("number").cast("decimal(20,0)")).alias("mark")
    )
    totals = sizes.groupBy("key").agg(
        F.count(F.lit(1)).alias("parts"),
        F.sum("size").alias("size"),
        F.sum("mark").alias("mark"),
        F.max(F.struct("size", "component")).alias("most"),
    )
    one_of = totals.where("parts > 1 and size > 3").groupBy("size", "mark")
    keys = one_of.agg(F.min(F.struct("key", "most")).alias("k")).select("k.key", "k.most", "size")
    inner = F.ceil(F.col("most.size") / MEMBERS).cast("int")
    outer = F.ceil((F.col("size") - F.col("most.size")) / MEMBERS).cast("int")
    blocks = keys.select("key", F.col("most.component").alias("largest"), inner.alias("inner"), outer.alias("outer"))
    dealt = named.join(blocks, "key")
    spot, outside = F.xxhash64("number"), F.col("component") != F.col("largest")
    own = F.when(outside, F.col("inner") + F.pmod(spot, F.col("outer"))).otherwise(F.pmod(spot, F.col("inner")))
    first = F.when(outside, F.lit(0)).otherwise(F.col("inner"))
    met = F.explode(F.sequence(first, F.col("inner") + F.col("outer") - 1))
    dealt = dealt.select("key", "number", "component", own.cast("int").alias("own"), met.alias("met"))
    return dealt.select(
        "key", F.least("own", "met").alias("i"), F.greatest("own", "met").alias("j"), "own", "number", "component"
    )


def _shared(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The number of common values of every two of ``n`` sets, given as (owner, value) pairs."""
    _, column, counts = np.unique(values, return_inverse=True, return_counts=True)
    often = counts[column] > 1
    owner, column = owner[often], column[often]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((n, n), np.float64)
    last = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, last, 2048):
        lo, hi = np.searchsorted(column, [at, at + 2048])
        part = np.zeros((n, 2048), np.float32)
        part[owner[lo:hi], column[lo:hi] - at] = 1
        out += part @ part.T
    return out


def _confirmed_in_blocks(dealt: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links between different components among the rows of each pair of blocks."""

    def run(table: pa.Table) -> pa.Table:
        own, component = table.column("own").to_numpy(), table.column("component").to_numpy()
        number = table.column("number").to_numpy()
        held = table.column("shingles").combine_chunks()
        size = np.diff(held.offsets.to_numpy()).astype(np.int64)
        values = held.flatten().to_numpy()
        shared = _shared(np.repeat(np.arange(len(own)), size), values, len(own))
        reach = 100 * shared >= percent * (size[:, None] + size[None, :] - shared)
        reach &= component[:, None] != component[None, :]
        if table.column("i")[0].as_py() != table.column("j")[0].as_py():
            reach &= own[:, None] != own[None, :]
        x, y = np.nonzero(np.triu(reach, 1))
        low, high = np.minimum(number[x], number[y]), np.maximum(number[x], number[y])
        return pa.table({"a": pa.array(low, pa.int64()), "b": pa.array(high, pa.int64())})

    rows = dealt.join(sets, "number").select("key", "i", "j", "own", "number", "component", "shingles")
    return rows.groupBy("key", "i", "j").applyInArrow(run, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame,
    width: int = 5,
    percent: int = 80,
    bands: int = 32,
    rows: int = 5,
    seed: int = 20,
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs`` (columns doc_id and text).

    Two documents are linked when ``100 * |intersection| >= percent * |union|`` of their shingle sets.
    component_id is the smallest doc_id that links reach, kept marks the rows that have it.

    Null, empty and blank texts have no shingles and no links. Rows that repeat a doc_id with another text are
    told apart by their texts: each has the component of its own text, so a doc_id may be in two. Rows without doc_id take part; their component_id is null, and they are
    kept, where no row of their component has one. Other columns are ignored; an empty table gives no rows.
    """
    if bands % 2:
        raise ValueError("bands come in twos: one of minima, one of maxima")
    sig = stored(signatures(docs, width, bands, rows, seed), "signatures")
    some = sig.where("node is not null")
    firsts = some.groupBy("node").agg(F.min("doc_id").alias("first_id"))
    classes = stored(firsts.select("node", "first_id", _number(F.col("first_id")).alias("number")), "classes")

    reps = some.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.any_value("bands").alias("bands"))
    members = reps.select(_number(F.col("first_id")).alias("number"), F.explode("bands").alias("key"))
    ends = members.groupBy("key").agg(F.min("number").alias("low"), F.max("number").alias("high")).where("low < high")
    buckets = stored(members.join(ends, "key"), "buckets")

    wanted = buckets.select("number").distinct()
    first_ids = classes.join(wanted, "number", "left_semi").select(F.col("first_id").alias("wanted_id")).distinct()
    # Always by shuffle: each text moves once, and the plan is the same at every size.
    first_ids = first_ids.hint("merge")
    chosen = docs.select("doc_id", "text").join(first_ids, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi")
    found = _sets(chosen, width).where("node is not null")
    sets = stored(found.select(_number(F.col("doc_id")).alias("number"), "node", "shingles").dropDuplicates(["number", "node"]).drop("node"), "sets")

    low = buckets.where("number > low").select(F.col("low").alias("a"), F.col("number").alias("b"))
    high = buckets.where("number < high").select(F.col("number").alias("a"), F.col("high").alias("b"))
    seen = stored(low.union(high).distinct(), "pairs")
    links = stored(_confirmed(seen, sets, percent), "links")
    stars = stored(components(links), "stars")

    named = buckets.select("key", "number").join(stars.withColumnRenamed("node", "number"), "number", "left")
    named = named.select("key", "number", F.coalesce("component", "number").alias("component"))
    more = stored(_confirmed_in_blocks(_open_blocks(named), sets, percent), "links")
    labels = components(stars.toDF("a", "b").union(more))

    least = classes.join(labels.withColumnRenamed("node", "number"), "number", "left")
    least = least.select("node", "first_id", F.coalesce("component", "number").alias("component"))
    roots = least.groupBy("component").agg(F.min("first_id").alias("component_id"))
    known = least.join(roots, "component").select("node", "component_id")
    out = sig.select("doc_id", "node", "n_shingles").join(known, "node", "left")
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id")).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )
