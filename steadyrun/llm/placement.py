"""Operator 2: shards by a permutation-filled lookup table.

Each shard prefers the slots of a table of prime size in an order of its own: an offset and a step taken from
a hash of its name. The shards take turns; a shard whose turn it is claims the first free slot in its order.
So shards differ by one slot at most (in proportion to their weights), and when one is added or removed few
other slots change hands. A row finds its shard by one look into the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

MOST_SLOTS = 1 << 20


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], size: int = 65537, weights: Mapping[str, int] | None = None) -> list[str]:
    """The shard of each slot. ``weights`` gives a shard that many turns in a row (1 where not named).

    The order in which shards are listed doesn't matter. ``size`` is a prime of at most ``MOST_SLOTS``, no less
    than the number of turns in a round.
    """
    names = sorted(set(shards))
    turns = [(weights or {}).get(name, 1) for name in names]
    if not names or min(turns) < 1:
        raise ValueError("there must be a shard, and each must have a turn")
    if not _is_prime(size) or not sum(turns) <= size <= MOST_SLOTS:
        raise ValueError(f"the table needs a prime number of slots from {sum(turns)} to {MOST_SLOTS}")
    table: list[str | None] = [None] * size
    place, step = [], []
    for name in names:
        digest = hashlib.sha256(name.encode("utf-8", "surrogatepass")).digest()
        place.append(int.from_bytes(digest[:8], "big") % size)
        step.append(int.from_bytes(digest[8:16], "big") % (size - 1) + 1 if size > 2 else 1)
    free = size
    while free:
        for k, name in enumerate(names):
            for _ in range(min(turns[k], free)):
                while table[place[k]] is not None:
                    place[k] = (place[k] + step[k]) % size
                table[place[k]] = name
                free -= 1
    return table


def placed(
    df: DataFrame,
    key: Column,
    shards: Sequence[str],
    size: int = 65537,
    weights: Mapping[str, int] | None = None,
    spread_by: Column | None = None,
) -> DataFrame:
    """``df`` with columns slot and shard, by the hash of ``key``.

    Equal keys go to the same shard. Rows without a key are placed by ``spread_by``, or all together where that
    is not given or null too. Columns of ``df`` named slot or shard are replaced; an empty table stays empty.
    """
    table = lookup_table(shards, size, weights)
    rows = [(k, name) for k, name in enumerate(table)]
    # At most MOST_SLOTS short rows.
    known = df.sparkSession.createDataFrame(rows, "__slot int, __shard string")
    other = spread_by.cast("string") if spread_by is not None else F.lit(None).cast("string")
    kind = F.when(key.isNotNull(), "key").when(other.isNotNull(), "other").otherwise("none")
    hashed = F.xxhash64(kind, F.coalesce(key.cast("string"), other, F.lit("")))
    slotted = df.withColumn("__own", F.pmod(hashed, F.lit(size)).cast("int"))
    out = slotted.join(F.broadcast(known), F.col("__own") == F.col("__slot"), "left")
    kept = [c for c in df.columns if c not in ("slot", "shard")]
    return out.select(*kept, F.col("__own").alias("slot"), F.col("__shard").alias("shard"))


def write_shards(df: DataFrame, path: str, tasks_per_shard: int = 8) -> None:
    """Writes placed rows as one folder per shard, each by up to ``tasks_per_shard`` tasks."""
    salt = F.pmod(F.xxhash64(*[c for c in df.columns if c != "shard"]), F.lit(tasks_per_shard))
    df.repartition(F.col("shard"), salt).write.partitionBy("shard").parquet(path)
