"""Operator 5: benchmark passages in documents, by the q-gram lemma.

Both sides are lower-cased, runs of white space being one space. A passage of m characters may differ from an
item by k = min(0.1 m, (m - q) / q) edits. Such a region shares at least m - q + 1 - k q of the item's q-grams,
on diagonals (place in the document less place in the item) that span k + 1 values, so all of them lie in one
of the bands of 2 (k + 1) diagonals that begin at every multiple of k + 1. A band's count is that of the places
of the item that it has shared q-grams for, so a repetitive text doesn't reach the bound by its repeats. Bands
that reach it, neighbours as one, are verified by banded alignment: the whole item against any stretch of the
document along the band, given up as soon as all diagonals need too many edits.

The index of the items is broadcast in blocks of bounded size, one at a time; every block meets all documents.
Q-grams of more than ``COMMON`` places are left out, and the bounds of the items that hold them lowered by as
many, where a bound stays positive. Items of fewer than q characters are found as whole words, without edits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from steadyrun.sources.scratch import stored

BASE = np.uint64(0x100000001B3)
ODD = np.uint64(0x9E3779B97F4A7C15)
FILTER_BITS = 22
COMMON = 64
STRETCH = 1 << 20
FAR = 1 << 20


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _grams(points: np.ndarray, q: int) -> np.ndarray:
    wide = points.astype(np.uint64)
    n = len(wide) - q + 1
    out = wide[:n].copy()
    for k in range(1, q):
        out *= BASE
        out += wide[k : n + k]
    return out * ODD


def aligned(
    item: np.ndarray, text: np.ndarray, low: int, width: int, anchored: bool = False, most: int = FAR
) -> tuple[int, int]:
    """The least edits between ``item`` and a stretch of ``text``, and where the stretch ends.

    Only diagonals ``low`` to ``low + width - 1`` are looked at. The stretch may begin anywhere, or at 0 where
    it is anchored. Where more than ``most`` edits are needed, the number is only known to be above it.
    """
    n, spots = len(text), np.arange(width)
    padded = np.concatenate([text, [0]]).astype(np.int64)
    place = low + spots
    row = np.where((place >= 0) & (place <= n) & ((place == 0) | (not anchored)), 0, FAR)
    for i, char in enumerate(item.tolist(), start=1):
        place = low + i + spots
        inside = (place >= 0) & (place <= n)
        there = padded[np.clip(place - 1, 0, n)]
        step = row + ((there != char) | (place < 1))
        step[:-1] = np.minimum(step[:-1], row[1:] + 1)
        step = np.where(inside, step, FAR)
        row = np.where(inside, np.minimum.accumulate(step - spots) + spots, FAR)
        # Edits only grow along an item.
        if i % 8 == 0 and row.min() > most:
            return int(row.min()), 0
    best = int(row.argmin())
    return int(row[best]), low + len(item) + best


class Index:
    """The q-grams of some items, with what the lemma needs of each item."""

    def __init__(self, items: list[tuple[int, str]], q: int, rate: float):
        self.q = q
        texts = [(item_id, normal(text)) for item_id, text in items]
        self.short: dict[tuple[str, ...], list[int]] = {}
        for item_id, text in texts:
            if 0 < len(text) < q:
                self.short.setdefault(tuple(text.split(" ")), []).append(item_id)
        self.items = [(item_id, text, _points(text)) for item_id, text in texts if len(text) >= q]
        sizes = np.array([len(p) for _, _, p in self.items], np.int64)
        self.edits = np.minimum(np.floor(rate * sizes), (sizes - q) // q).astype(np.int64)
        self.bounds = sizes - q + 1 - self.edits * q
        keys = [_grams(p, q) for _, _, p in self.items]
        key = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        place = np.concatenate([np.arange(len(k)) for k in keys]) if keys else np.empty(0, np.int64)
        _, which, counts = np.unique(key, return_inverse=True, return_counts=True)
        common = counts[which] > COMMON
        spare = np.bincount(item[common], minlength=len(keys))
        lowered = self.bounds - spare >= 1
        self.bounds = np.where(lowered, self.bounds - spare, self.bounds)
        stays = ~(common & lowered[item]) if len(item) else common
        order = np.argsort(key[stays], kind="stable")
        self.item, self.place = item[stays][order], place[stays][order]
        self.keys, self.first = np.unique(key[stays][order], return_index=True)
        self.last = np.append(self.first[1:], len(order))
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.keys >> np.uint64(64 - FILTER_BITS)] = True
        self.overlap = int(sizes.max() + 6 * self.edits.max() + 2 * q) if len(sizes) else 0

    def _bands(self, points: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, first diagonal, number of diagonals) of the bands that reach the item's bound."""
        grams = _grams(points, self.q)
        spots = np.flatnonzero(self.filter[grams >> np.uint64(64 - FILTER_BITS)])
        at = np.minimum(np.searchsorted(self.keys, grams[spots]), len(self.keys) - 1)
        found = self.keys[at] == grams[spots]
        spots, at = spots[found], at[found]
        n = self.last[at] - self.first[at]
        if not n.sum():
            return []
        entry = np.repeat(self.first[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        item, place = self.item[entry], self.place[entry]
        band = (np.repeat(spots, n) - place) // (self.edits[item] + 1)
        code = item * np.int64(4 * FAR) + band + FAR
        codes, group = np.unique(np.concatenate([code, code - 1]), return_inverse=True)
        # Places of the item are told apart only where there are enough shared q-grams.
        enough = np.bincount(group) >= self.bounds[codes // (4 * FAR)]
        kept = enough[group]
        long = int(self.place.max()) + 1
        apart = np.unique(group[kept] * long + np.concatenate([place, place])[kept]) // long
        full = codes[np.bincount(apart, minlength=len(codes)) >= self.bounds[codes // (4 * FAR)]]
        starts = np.flatnonzero(np.diff(full, prepend=-2) != 1)
        runs = np.diff(np.append(starts, len(full)))
        out = []
        for first, run in zip(full[starts].tolist(), runs.tolist(), strict=True):
            k, band = divmod(first, 4 * FAR)
            width = int(self.edits[k]) + 1
            out.append((k, (band - FAR) * width, (run + 1) * width))
        return out

    def _verified(self, k: int, first: int, wide: int, text: str, points: np.ndarray) -> tuple[int, int, int] | None:
        """(edits, start, end) of the best stretch along ``wide`` diagonals."""
        _, item, want = self.items[k]
        edits, m = int(self.edits[k]), len(want)
        low, width = first - edits, wide + 2 * edits
        exact = text.find(item, max(low, 0), max(low + width + m, 0))
        if exact >= 0:
            return 0, exact, exact + m
        if not edits:
            return None
        lo, hi = max(low, 0), max(low + width + m, 0)
        found, end = aligned(want, points[lo:hi], low - lo, width, most=edits)
        if found > edits:
            return None
        _, back = aligned(want[::-1], points[lo : lo + end][::-1], -edits, 2 * edits + 1, anchored=True)
        return found, lo + end - back, lo + end

    def _short_items(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """Items too short for a q-gram, as whole words."""
        if not self.short:
            return
        words = text.split(" ")
        for size in sorted({len(w) for w in self.short}):
            for found in self.short.keys() & set(zip(*(words[k:] for k in range(size)))):
                item = " ".join(found)
                at = f" {text} ".index(f" {item} ")
                for item_id in self.short[found]:
                    yield item_id, 0, at, at + len(item)

    def search(self, text: str | None) -> list[int]:
        """item_id, edits, start and end (in the normal form) of each item found, one after the other."""
        text = normal(text)
        best: dict[int, tuple[int, int, int]] = {}
        for at in range(0, max(len(text) - self.q + 1, 0) if len(self.keys) else 0, STRETCH):
            part = text[at : at + STRETCH + self.overlap]
            points = _points(part)
            for k, first, wide in self._bands(points):
                if best.get(k, (1,))[0] == 0:
                    continue
                found = self._verified(k, first, wide, part, points)
                if found:
                    moved = (found[0], found[1] + at, found[2] + at)
                    best[k] = min(best.get(k, moved), moved)
        rows = sorted([*((self.items[k][0], *found) for k, found in best.items()), *self._short_items(text)])
        return [x for row in rows for x in row]


def _searching(shared: Broadcast) -> Callable[[Column], Column]:
    """``shared`` holds an index as pickled by value."""

    @F.pandas_udf("array<long>")
    def search(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = cloudpickle.loads(shared.value)
        for part in texts:
            yield pd.Series([index.search(t) for t in part], dtype=object)

    return search


def _blocks(items: DataFrame, q: int, rate: float, block_chars: int) -> tuple[int, Callable[[int], Broadcast]]:
    """The number of blocks of items, and what broadcasts the index of one of them."""
    spark = items.sparkSession
    known = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("body"))
    known = known.where("item_id is not null and body is not null").distinct()
    chars = known.agg(F.sum(F.length("body"))).first()[0] or 0
    blocks = -(-chars // block_chars) or 1

    def shared(k: int) -> Broadcast:
        part = known.where(F.pmod(F.xxhash64("item_id", "body"), F.lit(blocks)) == k)
        rows = sorted((r["item_id"], r["body"]) for r in part.toLocalIterator())
        return spark.sparkContext.broadcast(cloudpickle.dumps(Index(rows, q, rate)))

    return blocks, shared


def with_found_items(
    docs: DataFrame, items: DataFrame, text: str, name: str, q: int = 8, rate: float = 0.1, block_chars: int = 2_000_000
) -> DataFrame:
    """``docs`` with a column ``name``, array<long>: item_id, edits, start, end of every item of ``items`` (item_id,
    text) in the column ``text``, one after the other.

    Items are taken in blocks of about ``block_chars`` characters (a longer item is a block of its own). The index
    of one block is held at a time: with several, the rows are written once, each block searches them in a job of
    its own, and what it finds is written. Items without id or text are found nowhere; of items with the same text
    each is found. Null, empty and blank texts hold nothing. A column that has the name of the result is replaced.
    """
    body = F.col(text).cast("string")
    blocks, shared = _blocks(items, q, rate, block_chars)
    if blocks == 1:
        return docs.withColumn(name, _searching(shared(0))(body))
    rows = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "searched")
    parts = []
    for k in range(blocks):
        index = shared(k)
        found = rows.select("__row", _searching(index)(body).alias("__found")).where(F.size("__found") > 0)
        parts.append(stored(found, "found"))
        index.destroy()
    # At most all items for one row.
    every = reduce(DataFrame.union, parts).groupBy("__row").agg(F.flatten(F.collect_list("__found")).alias("__found"))
    joined = rows.drop(name).join(every, "__row", "left")
    nothing = F.array().cast("array<long>")
    return joined.withColumn(name, F.coalesce("__found", nothing)).select(*[c for c in docs.columns if c != name], name)


def contamination(docs: DataFrame, items: DataFrame, **settings) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): the items found, the least edits, where that is, and kept.

    Extra columns are ignored; rows that repeat are rows like others; an empty table gives no rows, and without
    items everything is kept.
    """
    texts = docs.select("doc_id", F.col("text").alias("body"))
    found = with_found_items(texts, items, "body", "found", **settings).drop("body")
    count = (F.size("found") / 4).cast("int")
    rows = F.transform(
        F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")),
        lambda k: F.struct(
            F.get("found", 4 * k + 1).alias("edits"), F.get("found", 4 * k).alias("item_id"),
            F.get("found", 4 * k + 2).alias("start"), F.get("found", 4 * k + 3).alias("end"),
        ),
    )
    best = F.array_min("hits")
    hits = found.select("doc_id", rows.alias("hits"))
    return hits.select(
        "doc_id", F.transform("hits", lambda h: h["item_id"]).alias("items"), best["edits"].alias("least_edits"),
        best["start"].alias("region_start"), best["end"].alias("region_end"), (F.size("hits") == 0).alias("kept"),
    )
