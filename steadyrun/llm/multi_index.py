"""Operator 11: hard negatives from an inverted multi-index.

Two codebooks, one for each half of the dimensions, are fitted on a bounded sample. A segment keeps its rows in
cells (code of the first half, code of the second half), and for every code the largest distance of its rows to
the code's centre. A half's score with any row of a code is at most the score with the centre plus the length of
the anchor's half times that distance, so the sum of two half bounds holds for a cell. Per anchor a heap walks the
grid of codes in the order of these sums (the multi-sequence algorithm).

The walk serves two searches: the positives (rows of the anchor's label), which end when the k-th score is above
the next bound, and per positive a window of scores, certified when it is full above the next bound or the next
bound is below the window. Cells are taken in rounds of doubling length, and those that several anchors reach in
a round are scored at once. Results are exact, whatever the codebooks.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from steadyrun.llm.vectors import (
    HIGHEST, LOWEST, Best, by_group, dealt, from_bytes, longs, matrix, meetings, parts_of, products, query_blocks,
    to_bytes, usable, widened,
)
from steadyrun.sources.scratch import stored

SEGMENT = "segment int, first int, second int, ids binary, labels binary, rows int, width int, x binary, radii binary"
POSITIVES = "qblock int, slot int, anchor_id long, positive_id long, positive_score long"
NEGATIVES = "qblock int, slot int, place int, anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"


def halves(x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    x = widened(x, width)
    return x[:, : width // 2], x[:, width // 2 :]


def fitted(x: np.ndarray, codes: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """Centres of the rows of ``x`` by Lloyd's rounds."""
    if not x.size:
        return np.zeros((1, x.shape[1]))
    distinct = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    centres = distinct[rng.permutation(len(distinct))[:codes]]
    for _ in range(rounds):
        code = nearest(x, centres)
        counts = np.bincount(code, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, code, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * (x @ centres.T)).argmin(axis=1)


def multi_segments(rows: DataFrame, parts: int, centres: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """The cells of all segments; radii are those of the cell's two codes in the segment."""
    width = centres[0].shape[1] + centres[1].shape[1]

    def pack(number: int, table: pa.Table) -> Iterator[dict[str, list]]:
        x, ids, labels = matrix(table.column("vector")), *(np.asarray(table.column(c), np.int64) for c in ("id", "label"))
        if x.shape[1] > width:
            raise ValueError("vectors are longer than those of the sample")
        codes, radii = [], []
        for half, centre in zip(halves(x, width), centres, strict=True):
            code = nearest(half, centre)
            far = np.sqrt(((half - centre[code]) ** 2).sum(axis=1))
            radius = np.zeros(len(centre))
            np.maximum.at(radius, code, far)
            codes.append(code)
            radii.append(radius)
        for key, places in by_group(codes[0] * len(centres[1]) + codes[1]):
            places = places[np.lexsort((ids[places], labels[places]))]
            i, j = divmod(key, len(centres[1]))
            yield {
                "segment": pa.array([number], pa.int32()), "first": pa.array([i], pa.int32()),
                "second": pa.array([j], pa.int32()), "ids": [ids[places].tobytes()], "labels": [labels[places].tobytes()],
                "rows": pa.array([len(places)], pa.int32()), "width": pa.array([x.shape[1]], pa.int32()),
                "x": [to_bytes(x[places])], "radii": [np.array([radii[0][i], radii[1][j]]).tobytes()],
            }

    return dealt(rows, parts, pack, SEGMENT, "cells")


def multi_sequence(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(bound, i, j) of the whole grid by falling bound = first[i] + second[j]."""
    a, b = np.argsort(-first, kind="stable").tolist(), np.argsort(-second, kind="stable").tolist()
    high, wide = first[a].tolist(), second[b].tolist()
    heap = [(-(high[0] + wide[0]), 0, 0)] if a and b else []
    while heap:
        bound, i, j = heapq.heappop(heap)
        yield -bound, a[i], b[j]
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (-(high[i + 1] + wide[0]), i + 1, 0))
        if j + 1 < len(b):
            heapq.heappush(heap, (-(high[i] + wide[j + 1]), i, j + 1))


class Cells:
    """A segment's cells, for walks of a block of anchors."""

    def __init__(self, packed: list[dict], centres: tuple[np.ndarray, np.ndarray], anchors: np.ndarray):
        width = centres[0].shape[1] + centres[1].shape[1]
        self.anchors = widened(anchors, width)
        self.cells = {
            (c["first"], c["second"]): (
                longs(c["ids"]), longs(c["labels"]), widened(from_bytes(c["x"], c["rows"], c["width"]), width)
            )
            for c in packed
        }
        radii = [{}, {}]
        for c in packed:
            for side, (name, radius) in enumerate(zip(("first", "second"), np.frombuffer(c["radii"]), strict=True)):
                radii[side][c[name]] = float(radius)
        self.codes, self.bounds = [], []
        for half, centre, known in zip(halves(self.anchors, width), centres, radii, strict=True):
            codes = sorted(known)
            far = np.array([known[c] for c in codes])
            length = np.sqrt((half**2).sum(axis=1))
            bound = half @ centre[codes].T + length[:, None] * far
            # A little above, for rounding.
            self.bounds.append(bound + np.abs(bound).max(initial=0) * 1e-9 + 1)
            self.codes.append(codes)

    def walk(
        self,
        goal: Callable[[np.ndarray], np.ndarray],
        score: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], None],
        settle: Callable[[], None],
    ) -> None:
        """Every anchor takes cells until its next bound is below ``goal``.

        ``score(anchors, ids, labels, rows)`` is called with anchors that reach a cell, ``settle()`` after a round.
        """
        n = len(self.anchors)
        walks = [multi_sequence(self.bounds[0][a], self.bounds[1][a]) for a in range(n)]
        ahead = [next(w, None) for w in walks]
        live, step = np.arange(n), 4
        while len(live):
            bound = np.array([ahead[a][0] if ahead[a] else -np.inf for a in live])
            live = live[bound >= goal(live)]
            cell, anchor = [], []
            for a in live.tolist():
                for _ in range(step):
                    if ahead[a] is None:
                        break
                    key = self.codes[0][ahead[a][1]], self.codes[1][ahead[a][2]]
                    ahead[a] = next(walks[a], None)
                    if key in self.cells:
                        cell.append(key[0] << 32 | key[1])
                        anchor.append(a)
            live = live[[ahead[a] is not None for a in live]] if len(live) else live
            anchor_of = np.array(anchor, np.int64)
            for key, places in by_group(np.array(cell, np.int64)):
                score(anchor_of[places], *self.cells[key >> 32, key & 0xFFFFFFFF])
            settle()
            step *= 2


def positives(cells: Cells, ids: np.ndarray, labels: np.ndarray, k: int) -> Best:
    """The k best other rows of each anchor's label."""
    top = Best(len(ids), k)

    def score(anchors: np.ndarray, there: np.ndarray, marks: np.ndarray, x: np.ndarray) -> None:
        for label, places in by_group(labels[anchors]):
            lo, hi = np.searchsorted(marks, label), np.searchsorted(marks, label, "right")
            if lo < hi:
                some = anchors[places]
                found = products(cells.anchors[some], x[lo:hi])
                top.offer(some, found, there[lo:hi], there[None, lo:hi] != ids[some][:, None])

    cells.walk(lambda live: top.least(live)[0], score, top.merge)
    return top


def negatives(cells: Cells, labels: np.ndarray, slot: np.ndarray, reach: np.ndarray, k: int, low: int, high: int) -> Best:
    """The k best rows of other labels within each window; window w is that of anchor slot[w] and score reach[w]."""
    top = Best(len(slot), k)
    # The smallest score within: ceil(low * reach / 100).
    least = -((-low * reach) // 100)
    dead = low * reach > high * reach
    windows = {a: places for a, places in by_group(slot)}
    most = max((len(w) for w in windows.values()), default=0)
    table = np.full((len(labels), max(most, 1)), -1)
    for a, places in windows.items():
        table[a, : len(places)] = places[~dead[places]].tolist() + [-1] * int(dead[places].sum())

    def goal(live: np.ndarray) -> np.ndarray:
        chosen = table[live]
        need = np.maximum(top.least(chosen.ravel())[0].reshape(chosen.shape), least[chosen]) if len(slot) else chosen
        return np.where(chosen < 0, HIGHEST, need).min(axis=1).astype(np.float64)

    def score(anchors: np.ndarray, there: np.ndarray, marks: np.ndarray, x: np.ndarray) -> None:
        found = products(cells.anchors[anchors], x)
        if np.abs(found).max(initial=0) > HIGHEST // 200:
            raise OverflowError("a score is too large for a window in percent")
        other = marks[None, :] != labels[anchors][:, None]
        for place in range(most):
            window = table[anchors, place]
            some = window >= 0
            window, scores = window[some], found[some]
            want = reach[window][:, None]
            inside = (low * want <= 100 * scores) & (100 * scores <= high * want)
            top.offer(window, scores, there, inside & other[some])

    cells.walk(goal, score, top.merge)
    return top


def hard_negatives(
    vectors: DataFrame,
    label: Column,
    is_anchor: Column,
    positives_each: int = 5,
    negatives_each: int = 10,
    low: int = 30,
    high: int = 90,
    codes: int = 16,
    fit_rows: int = 1 << 13,
    segment_rows: int = 1 << 15,
    anchor_rows: int = 1 << 11,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id and embedding; ``label`` and ``is_anchor`` are expressions on its columns. An anchor's
    positives are the ``positives_each`` other rows of its label with the highest inner products (all, if fewer).
    For each, the first ``negatives_each`` rows of other labels whose score is within ``low`` to ``high`` percent
    of the positive's are returned (all, if fewer). Ties go to the smaller vec_id.

    Rows with a null vec_id or label, a null vector, or null or non-finite components take no part. Rows that
    repeat a vec_id are rows like others, but none with the anchor's own id is its positive; a repeated anchor row
    gets its rows again. The shorter of two vectors ends in zeros; other columns are ignored; an empty table gives
    no rows. A window of a negative positive score is empty. A score beyond 2^55, also that of an anchor with itself, fails the job.

    The codebooks of ``codes`` centres are fitted on the ``fit_rows`` rows with the smallest hashes; they change
    the speed only. A task holds ``segment_rows`` vectors and ``anchor_rows`` anchors at most.
    """
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vector"),
        label.cast("long").alias("label"), is_anchor.alias("asks"),
    ).where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector")))
    total, asking, longest = rows.agg(F.count(F.lit(1)), F.count_if("asks"), F.max(F.size("vector"))).first()
    parts, blocks = parts_of(total, segment_rows), parts_of(asking, anchor_rows)
    sample = rows.orderBy(F.xxhash64("id", "vector"), "id").limit(fit_rows).select("vector").toArrow()
    centres = tuple(fitted(half, codes) for half in halves(matrix(sample.column("vector")), longest or 0))
    segments = multi_segments(rows.select("id", "label", "vector"), parts, centres)
    anchors = query_blocks(rows.where("asks").select("id", "label", "vector"), blocks)

    def first_work(block: dict, held: list[dict]) -> dict[str, np.ndarray]:
        ids, labels = longs(block["ids"]), longs(block["labels"])
        cells = Cells(held, centres, from_bytes(block["x"], block["rows"], block["width"]))
        slot, found, score = positives(cells, ids, labels, positives_each).rows()
        return {
            "qblock": np.full(len(slot), block["qblock"]), "slot": slot, "anchor_id": ids[slot], "positive_id": found,
            "positive_score": score,
        }

    def second_work(block: dict, held: list[dict]) -> dict[str, np.ndarray]:
        ids, labels = longs(block["ids"]), longs(block["labels"])
        slot, place, partner, reach = np.array(block["windows"], np.int64).T
        cells = Cells(held, centres, from_bytes(block["x"], block["rows"], block["width"]))
        window, found, score = negatives(cells, labels, slot, reach, negatives_each, low, high).rows()
        return {
            "qblock": np.full(len(window), block["qblock"]), "slot": slot[window], "place": place[window],
            "anchor_id": ids[slot[window]], "positive_id": partner[window], "negative_id": found,
            "positive_score": reach[window], "negative_score": score,
        }

    best = Window.partitionBy("qblock", "slot").orderBy(F.desc("positive_score"), "positive_id")
    met = meetings(anchors, blocks, segments, parts, first_work, POSITIVES).withColumn("place", F.row_number().over(best))
    wanted = stored(met.where(F.col("place") <= positives_each), "positives")
    # A block of anchors has ``anchor_rows`` times ``positives_each`` windows at most.
    window = F.array(*[F.col(c).cast("long") for c in ("slot", "place", "positive_id", "positive_score")])
    windows = wanted.groupBy("qblock").agg(F.collect_list(window).alias("windows"))
    found = meetings(anchors.join(windows, "qblock"), blocks, segments, parts, second_work, NEGATIVES)
    nearest_first = Window.partitionBy("qblock", "slot", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(nearest_first)).where(F.col("rank") <= negatives_each)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
