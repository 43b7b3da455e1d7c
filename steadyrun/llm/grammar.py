"""Operator 1: token ids in grammar-compressed shards (Re-Pair).

Documents are dealt in ascending doc_id order; each task encodes its texts and closes a shard at the first end
of a document after ``shard_size`` ids. In a shard, frequent pairs of neighbouring symbols are replaced by new
symbols, round after round until none is left that is frequent (``least_uses`` times or more, as a rule costs as much
as it saves below that). A round counts all pairs that may be frequent, takes at most ``most_rules`` of them, the most
frequent ones, and replaces them; where two overlap, the more frequent one.

The file format is a table, one row per shard, written by Spark's committed writers, so a lost executor leaves
no half file and any store will do:

    part, shard     place in the order: the writing task, the shard within it
    part_start      ids of the same task before this shard
    n_ids           ids of the shard
    doc_ids         the documents in order
    doc_ids_count   ids of each, end id included
    alphabet        symbols below it are ids, symbol ``alphabet + k`` is rule k
    rounds          number of rules after each round
    rules           pairs of symbols, unsigned 32-bit little-endian
    lengths         expansion length of each rule, unsigned 32-bit little-endian
    low, high       the symbols: 16 low bits each, then each higher bit as a packed plane
    n_symbols       number of symbols
    samples         ids before every ``SAMPLE``-th symbol, unsigned 32-bit little-endian

``samples`` and ``lengths`` give random access: ``slice_ids`` expands only the symbols that cover a range.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from steadyrun.llm.tokens import encoder

SHARDS = (
    "part int, shard int, part_start long, n_ids long, doc_ids array<long>, doc_ids_count array<long>, "
    "alphabet int, rounds array<int>, rules binary, lengths binary, low binary, high binary, n_symbols long, "
    "samples binary"
)
READ = "part int, part_start long, in_shard long, doc_id long, n_tokens long, ids_crc32 long"
SAMPLE = 1024


def _replaced(
    symbols: np.ndarray, live: np.ndarray, first_new: int, most_rules: int, least_uses: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """One round: the shorter symbols, where pairs may still be frequent, and the new rules; None if no pair is frequent.

    ``live`` has every place of every pair that may be frequent, so sorting the pairs there counts them exactly.
    """
    n, m = len(symbols), len(live)
    every = m == n - 1
    left, right = (symbols[:-1], symbols[1:]) if every else (symbols[live], symbols[live + 1])
    wide, narrow = np.uint64(int(symbols.max()).bit_length()), np.uint64(m.bit_length())
    keys = left.astype(np.uint64) << wide | right
    if 2 * wide + narrow <= 64:
        # The pair in the high bits and its place in the low ones: far quicker to sort than places by pair.
        keys <<= narrow
        keys |= np.arange(m, dtype=np.uint64)
        keys.sort()
        places = keys & ((np.uint64(1) << narrow) - np.uint64(1))
        keys >>= narrow
    else:
        places = np.argsort(keys, kind="stable")
        keys = keys[places]
    counts = np.diff(np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [m]]))
    frequent = counts >= least_uses
    at, counts = places[np.repeat(frequent, counts)].astype(np.int64), counts[frequent]
    if not len(at):
        return None
    at = at if every else live[at]
    pair = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    again = np.zeros(n, bool)
    again[at] = True
    # Of a run of one symbol every second place is a use.
    next_to = np.flatnonzero((at[1:] == at[:-1] + 1) & (pair[1:] == pair[:-1])) + 1
    if len(next_to):
        starts = np.flatnonzero(np.diff(next_to, prepend=-2) != 1)
        inside = np.arange(len(next_to)) - np.repeat(starts, np.diff(np.append(starts, len(next_to))))
        overlaps = next_to[inside % 2 == 0]
        counts = counts - np.bincount(pair[overlaps], minlength=len(counts))
        at = np.delete(at, overlaps)
    # Where pairs overlap the more frequent one is replaced; the others wait for the next round.
    rank = np.empty(len(counts), np.int32)
    rank[np.argsort(counts, kind="stable")] = np.arange(1, len(counts) + 1)
    rank[(counts < least_uses) | (rank <= len(counts) - most_rules)] = 0
    claims = np.zeros(n + 2, np.int32)
    claims[at + 1] = np.repeat(rank, counts)
    own = claims[1:-1]
    at = np.flatnonzero((own > claims[:-2]) & (own > claims[2:]))
    enough = np.bincount(own[at], minlength=len(counts) + 1) >= least_uses
    at = at[enough[own[at]]]
    if not len(at):
        return None
    number = np.cumsum(enough, dtype=np.uint32) - np.uint32(1)
    new = number[own[at]]
    rules = np.empty((int(enough.sum()), 2), np.uint32)
    rules[new, 0], rules[new, 1] = symbols[at], symbols[at + 1]
    out = symbols.copy()
    out[at] = new + np.uint32(first_new)
    stays = np.ones(n, bool)
    stays[at + 1] = False
    again[at] = True
    again[at[at > 0] - 1] = True
    out, live = out[stays], np.flatnonzero(again[stays])
    return out, live[live < len(out) - 1], rules


def compress(
    ids: np.ndarray, alphabet: int, rounds: int | None, most_rules: int, least_uses: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """The symbols, the rules (pairs), their expansion lengths, and the number of rules after each round."""
    symbols, rules, ends = ids.astype(np.uint32), np.empty((0, 2), np.uint32), []
    lengths, live = np.ones(alphabet, np.uint32), np.arange(len(ids) - 1)
    while len(live) and (rounds is None or len(ends) < rounds):
        done = _replaced(symbols, live, alphabet + len(rules), most_rules, least_uses)
        if done is None:
            break
        symbols, live, new = done
        lengths = np.append(lengths, lengths[new[:, 0]] + lengths[new[:, 1]])
        rules = np.concatenate([rules, new])
        ends.append(len(rules))
    return symbols, rules, lengths[alphabet:], ends


def expand(symbols: np.ndarray, rules: np.ndarray, alphabet: int, ends: list[int]) -> np.ndarray:
    """The ids that a few symbols stand for, the rules of the last round being undone first."""
    for k in range(len(ends) - 1, -1, -1):
        first = alphabet + (ends[k - 1] if k else 0)
        is_rule = symbols >= first
        if not is_rule.any():
            continue
        place = np.cumsum(is_rule) + np.arange(len(symbols)) - is_rule
        out = np.empty(len(symbols) + int(is_rule.sum()), np.uint32)
        found = symbols[is_rule] - alphabet
        out[place[~is_rule]] = symbols[~is_rule]
        out[place[is_rule]] = rules[found, 0]
        out[place[is_rule] + 1] = rules[found, 1]
        symbols = out
    return symbols


def expand_all(symbols: np.ndarray, rules: np.ndarray, alphabet: int, ends: list[int]) -> np.ndarray:
    """As ``expand`` for many symbols: what each rule stands for is written out once, round by round."""
    ids, size = np.arange(alphabet, dtype=np.uint32), np.ones(alphabet, np.int64)
    start = np.arange(alphabet)

    def looked_up(found: np.ndarray) -> np.ndarray:
        sizes = size[found]
        after = np.cumsum(sizes)
        shift = np.repeat(start[found] - (after - sizes), sizes)
        shift += np.arange(len(shift))
        return ids[shift]

    for first, last in zip([0, *ends], ends):
        pairs = rules[first:last]
        more = looked_up(pairs.ravel())
        sizes = size[pairs].sum(axis=1)
        start = np.append(start, len(ids) + np.cumsum(sizes) - sizes)
        ids, size = np.append(ids, more), np.append(size, sizes)
    return looked_up(symbols)


def _planes(symbols: np.ndarray) -> tuple[bytes, bytes]:
    high = symbols >> 16
    bits = int(high.max()).bit_length() if len(high) else 0
    return symbols.astype("<u2").tobytes(), b"".join(np.packbits((high >> b & 1).astype(bool)).tobytes() for b in range(bits))


def _symbols(low: bytes, high: bytes, n: int, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Symbols ``start`` to ``stop``; ``start`` is a multiple of eight."""
    stop = n if stop is None else min(stop, n)
    out = np.frombuffer(low, "<u2")[start:stop].astype(np.uint32)
    width = (n + 7) // 8
    for b in range(len(high) // width if width else 0):
        plane = np.frombuffer(high, np.uint8)[b * width + start // 8 : b * width + (stop + 7) // 8]
        out |= np.unpackbits(plane)[: stop - start].astype(np.uint32) << np.uint32(16 + b)
    return out


def _u32(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4")


def shard_ids(row: dict[str, Any]) -> np.ndarray:
    """All ids of one row of the file format."""
    symbols = _symbols(row["low"], row["high"], row["n_symbols"])
    return expand_all(symbols, _u32(row["rules"]).reshape(-1, 2), row["alphabet"], row["rounds"])


def slice_ids(row: dict[str, Any], start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a shard; only the symbols around them are expanded."""
    samples, alphabet = _u32(row["samples"]), row["alphabet"]
    if stop <= start or not len(samples):
        return np.empty(0, np.uint32)
    first = max(int(np.searchsorted(samples, start, side="right")) - 1, 0)
    last = int(np.searchsorted(samples, stop, side="left"))
    symbols = _symbols(row["low"], row["high"], row["n_symbols"], first * SAMPLE, last * SAMPLE)
    lengths = np.ones(len(symbols), np.int64)
    is_rule = symbols >= alphabet
    lengths[is_rule] = _u32(row["lengths"])[symbols[is_rule] - alphabet]
    after = int(samples[first]) + np.cumsum(lengths)
    lo, hi = np.searchsorted(after, start, side="right"), np.searchsorted(after, stop, side="left") + 1
    begins = int(after[lo] - lengths[lo])
    ids = expand(symbols[lo:hi], _u32(row["rules"]).reshape(-1, 2), alphabet, row["rounds"])
    return ids[start - begins : stop - begins]


def document_ids(row: dict[str, Any], k: int) -> np.ndarray:
    """The ids of the k-th document of a shard, its end id included."""
    ends = np.cumsum(row["doc_ids_count"])
    return slice_ids(row, int(ends[k] - row["doc_ids_count"][k]), int(ends[k]))


def shards(
    docs: DataFrame,
    tokenizer: str,
    alphabet: int,
    end_id: int = 0,
    shard_size: int = 1 << 21,
    rounds: int | None = None,
    most_rules: int = 1 << 14,
    least_uses: int = 8,
    added_tokens: bool = False,
) -> DataFrame:
    """The rows of the file format for ``docs`` (columns doc_id and text).

    Order: doc_id ascending, rows without one first; rows that repeat a doc_id follow a hash of their text, so
    even one repeated id is spread over tasks. A null text counts as empty and is its end id alone. Other
    columns are ignored; an empty table gives no rows. ``rounds``: stop after so many, None: when no pair is frequent.
    ``added_tokens``: see ``tokens.Encoder``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, part = encoder(tokenizer, added_tokens), end_id.to_bytes(4, "little"), TaskContext.get().partitionId()
        names: list[int | None] = []
        sizes: list[int] = []
        held: list[bytes] = []
        shard, part_start, n_ids = 0, 0, 0

        def close() -> pa.RecordBatch:
            symbols, rules, lengths, ends = compress(
                np.frombuffer(b"".join(held), "<u4"), alphabet, rounds, most_rules, least_uses
            )
            spans = np.ones(len(symbols), np.int64)
            spans[symbols >= alphabet] = lengths[symbols[symbols >= alphabet] - alphabet]
            samples = (np.cumsum(spans) - spans)[::SAMPLE].astype("<u4").tobytes()
            low, high = _planes(symbols)
            row = dict(
                part=part, shard=shard, part_start=part_start, n_ids=n_ids, doc_ids=names, doc_ids_count=sizes,
                alphabet=alphabet, rounds=ends, rules=rules.astype("<u4").tobytes(),
                lengths=lengths.astype("<u4").tobytes(), low=low, high=high, n_symbols=len(symbols), samples=samples,
            )
            kinds = dict(
                part=pa.int32(), shard=pa.int32(), doc_ids=pa.list_(pa.int64()), doc_ids_count=pa.list_(pa.int64()),
                alphabet=pa.int32(), rounds=pa.list_(pa.int32()), rules=pa.binary(), lengths=pa.binary(),
                low=pa.binary(), high=pa.binary(), samples=pa.binary(),
            )
            return pa.RecordBatch.from_arrays(
                [pa.array([v], kinds.get(k, pa.int64())) for k, v in row.items()], names=list(row)
            )

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                ids = encode(text.as_py()) + end
                names.append(doc_id.as_py())
                sizes.append(len(ids) // 4)
                held.append(ids)
                n_ids += len(ids) // 4
                if n_ids >= shard_size:
                    yield close()
                    shard, part_start, n_ids = shard + 1, part_start + n_ids, 0
                    names, sizes, held = [], [], []
        if held:
            yield close()

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    return texts.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, SHARDS)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document of written shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data = shard_ids(row).astype("<u4").tobytes()
                sizes = np.array(row["doc_ids_count"], np.int64)
                ends = np.cumsum(sizes)
                sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends - sizes, ends, strict=True)]
                n = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["part"]] * n, pa.int32()), pa.array([row["part_start"]] * n, pa.int64()),
                        pa.array(ends - sizes), pa.array(row["doc_ids"], pa.int64()), pa.array(sizes),
                        pa.array(sums, pa.int64()),
                    ],
                    names=["part", "part_start", "in_shard", "doc_id", "n_tokens", "ids_crc32"],
                )

    files = spark.read.schema(SHARDS).parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    # One row per writing task.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    out = files.mapInArrow(run, READ).join(bases, "part")
    start = (F.col("base") + F.col("part_start") + F.col("in_shard")).alias("start")
    return out.select("doc_id", start, "n_tokens", "ids_crc32")
