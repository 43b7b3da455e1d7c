"""Operator 6: quality grades by ordinal cumulative-link regression on hashed text.

P(grade <= k) = logistic(threshold_k - score), with one score per text, the sum of the weights of its hashed
features, and ordered thresholds. The expected grade and the tail probability P(grade >= best) are for
selection.

Features, each present or absent: the words (letters in lower case, edge punctuation cut off) and their first
four and five letters, which inflected and compounded forms share; for each shape
of a word (letter cases, digits, symbols as they are) the tenth of the words that have it; the tenth of the
words that repeat the one before; the order of magnitude of the length.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from steadyrun.llm.tokens import per_worker
from steadyrun.sources.scratch import stored

BITS = 18
KNOWN_WORDS = 200_000
SCORED = StructType([StructField(n, DoubleType()) for n in ("expected_grade", "tail_prob", "pass_prob")])


def _slot(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> (64 - BITS)


def _shape(word: str) -> str:
    word = re.sub(r"\d+", "9", word)
    word = re.sub(r"[^\W\d_]+", lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "a", word)
    return word[:6]


class _Words(dict):
    """word -> (slots of the word and its beginnings, its shape)"""

    def __missing__(self, word: str) -> tuple[tuple[int, ...], str]:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        bare = word.strip(".,;:!?\"'()[]{}<>|#*$%&").lower()
        names = [f"w {bare}"] if bare else []
        names += [f"p {bare[:k]}" for k in (4, 5) if len(bare) > k]
        found = self[word] = (tuple(map(_slot, names)), sys.intern(_shape(word)))
        return found


def features(text: str | None) -> np.ndarray:
    """Sorted distinct slots of a text; null and blank texts have the slot of the empty length only."""
    known = per_worker("ordinal words", _Words)
    words = (text or "").split()
    found = [known[w] for w in words]
    slots = set(chain.from_iterable(s for s, _ in set(found)))
    shapes = Counter(shape for _, shape in found)
    n = len(words)
    slots.update(_slot(f"s {shape} {-(-10 * k // n)}") for shape, k in shapes.items())
    if n:
        again = sum(a == b for a, b in zip(words, words[1:], strict=False))
        slots.add(_slot(f"r {-(-10 * again // n)}"))
    slots.add(_slot(f"n {n.bit_length()}"))
    return np.array(sorted(slots), np.int32)


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def grades(self, text: str | None) -> tuple[float, float, float]:
        """Expected grade, P(grade >= best), P(grade >= 1)."""
        score = float(self.weights[features(text)].sum())
        tails = 1 / (1 + np.exp(np.clip(self.thresholds - score, -50, 50)))
        return float(tails.sum()), float(tails[-1]), float(tails[0])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def telling(
    cols: np.ndarray, grades: np.ndarray, texts: np.ndarray, least_docs: int, least_z: float, least_phi: float
) -> np.ndarray:
    """Which slots are in ``least_docs`` texts and tell on which side of some cut of the grades a text is.

    cols, grades: the slots of all texts, and the grade of the text of each. texts: the number of each grade.
    The correlation of slot and side must be no chance (``least_z`` deviations) and not small (``least_phi``).
    Without this, thousands of words that say little add up to noise in a long text.
    """
    found = np.stack([np.bincount(cols[grades == g], minlength=1 << BITS) for g in range(len(texts))])
    total, n = found.sum(axis=0), texts.sum()
    share = total / n
    out = np.zeros(1 << BITS, bool)
    for cut in range(1, len(texts)):
        above, n_above = found[cut:].sum(axis=0), texts[cut:].sum()
        if 0 < n_above < n:
            spread = np.sqrt(np.maximum(share * (1 - share), 1e-12) * n_above * (n - n_above) / n)
            out |= np.abs(above - share * n_above) >= max(least_z, least_phi * np.sqrt(n)) * spread
    return out & (total >= least_docs)


def fit_rows(
    slots: list[np.ndarray],
    grades: np.ndarray,
    n_grades: int,
    penalty: float,
    least_docs: int,
    least_z: float,
    least_phi: float,
    steps: int,
) -> Model:
    """Weights and thresholds that minimise the penalised log loss, by full-batch steps (Adam)."""
    rows = np.repeat(np.arange(len(slots)), [len(s) for s in slots])
    cols = np.concatenate(slots) if slots else np.empty(0, np.int32)
    often = telling(cols, grades[rows], np.bincount(grades, minlength=n_grades), least_docs, least_z, least_phi)
    rows, cols = rows[often[cols]], cols[often[cols]]
    used, cols = np.unique(cols, return_inverse=True)
    n, k = len(grades), n_grades - 1
    # Start: thresholds at the grades' own shares; gaps are kept positive through their logarithms.
    below = np.array([(grades <= g).sum() + 0.5 * (g + 1) for g in range(k)]) / (n + 0.5 * n_grades)
    start = np.log(below / (1 - below))
    params = np.concatenate([np.zeros(len(used)), start[:1], np.log(np.maximum(np.diff(start), 0.1))])
    mean, square = np.zeros_like(params), np.zeros_like(params)
    at = np.arange(n)
    for step in range(1, steps + 1):
        weights, raw = params[: len(used)], params[len(used) :]
        theta = np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))
        score = np.bincount(rows, weights[cols], minlength=n)
        below = _logistic(theta[None, :] - score[:, None])
        edges = np.concatenate([np.zeros((n, 1)), below, np.ones((n, 1))], axis=1)
        slope = np.concatenate([np.zeros((n, 1)), below * (1 - below), np.zeros((n, 1))], axis=1)
        prob = np.maximum(edges[at, grades + 1] - edges[at, grades], 1e-12)
        up, down = slope[at, grades + 1] / prob, slope[at, grades] / prob
        by_theta = np.array([(down[grades == g + 1].sum() - up[grades == g].sum()) for g in range(k)])
        by_raw = np.cumsum(by_theta[::-1])[::-1] * np.concatenate([[1.0], np.exp(raw[1:])])
        by_weight = np.bincount(cols, (up - down)[rows], minlength=len(used)) + penalty * weights
        slope_all = np.concatenate([by_weight, by_raw])
        mean = 0.9 * mean + 0.1 * slope_all
        square = 0.99 * square + 0.01 * slope_all**2
        rate = 0.1 * min(1.0, 2 * (1 - step / (steps + 1)))
        params = params - rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    raw = params[len(used) :]
    full = np.zeros(1 << BITS, np.float32)
    full[used] = params[: len(used)]
    return Model(full, np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])])))


def fit(
    docs: DataFrame,
    ratings: DataFrame,
    n_grades: int = 3,
    most_rows: int = 20_000,
    penalty: float = 0.1,
    least_docs: int = 5,
    least_z: float = 4.0,
    least_phi: float = 0.09,
    steps: int = 400,
) -> Model | None:
    """A model from ``docs`` (doc_id, text) and ``ratings`` (doc_id, grade from 0 to ``n_grades - 1``).

    Fitting takes at most about ``most_rows`` rated documents, chosen by a hash of the doc_id. Spark counts
    their slots; the driver gets the telling ones, of which there are ``2 ** BITS`` at most. A document rated several times counts
    with its lowest grade; of several rows with its doc_id the text with the smallest md5 counts. Ratings without doc_id or grade are ignored. Without a rated document there is no
    model.
    """
    rated = ratings.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    total = rated.count()
    share = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("ordinal")), F.lit(1_000_000))
    rated = rated.where(share < int(1_000_000 * min(1.0, most_rows / max(total, 1))))
    if total <= most_rows:
        rated = rated.limit(most_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("grade"), pa.array(found, pa.list_(pa.int32()))],
                names=["doc_id", "grade", "slots"],
            )

    # At most ``most_rows`` rows of two numbers.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(rated.select("doc_id", F.col("grade").cast("int").alias("grade"))), "doc_id")
    # One text of each rated document, however many rows repeat its doc_id.
    own = F.min_by("text", F.struct(F.md5("text")))
    chosen = rows.groupBy("doc_id").agg(F.min("grade").alias("grade"), own.alias("text"))
    seen = stored(chosen.mapInArrow(run, "doc_id long, grade int, slots array<int>"), "rated")
    sizes = {r["grade"]: r["n"] for r in seen.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    texts_of = np.array([sizes.get(g, 0) for g in range(n_grades)])
    kept = _telling_slots(seen, texts_of, least_docs, least_z, least_phi)

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.intersect1d(s.values.to_numpy(), kept).astype("<i4").tobytes() for s in batch.column("slots")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("grade"), pa.array(own, pa.binary())],
                names=["doc_id", "grade", "slots"],
            )

    rows = seen.mapInArrow(narrowed, "doc_id long, grade int, slots binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["slots"])))
    slots = [np.frombuffer(r["slots"], "<i4") for r in rows]
    grades = np.array([r["grade"] for r in rows])
    return fit_rows(slots, grades, n_grades, penalty, least_docs, least_z, least_phi, steps)


def _telling_slots(
    seen: DataFrame, texts: np.ndarray, least_docs: int, least_z: float, least_phi: float
) -> np.ndarray:
    """The slots that ``telling`` keeps, counted by Spark; the driver gets those only."""
    slots = seen.select("grade", F.explode("slots").alias("slot")).groupBy("slot")
    found = slots.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("grade") >= g).alias(f"above{g}") for g in range(1, len(texts))])
    n, told = int(texts.sum()), F.lit(False)
    share = F.col("total") / n
    for cut in range(1, len(texts)):
        above = int(texts[cut:].sum())
        if 0 < above < n:
            spread = F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) * (above * (n - above) / n))
            told = told | (F.abs(F.col(f"above{cut}") - share * above) >= max(least_z, least_phi * n**0.5) * spread)
    rows = found.where(told & (F.col("total") >= least_docs)).select("slot").collect()
    return np.array(sorted(r["slot"] for r in rows), np.int32)


def scored(docs: DataFrame, model: Model | None, text: Column, name: str = "scored") -> DataFrame:
    """``docs`` with a struct column ``name``: expected_grade, tail_prob (best grade) and pass_prob (grade >= 1).

    Null and blank texts are scored by their empty length alone. Without a model the three are null. Rows that
    repeat are scored alike, an empty table gives no rows, and a column that has the name of the result is replaced.
    """
    if model is None:
        return docs.withColumn(name, F.lit(None).cast(SCORED))
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))

    @F.pandas_udf(SCORED)
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        held = Model(*shared.value)
        for part in texts:
            yield pd.DataFrame([held.grades(t) for t in part], columns=SCORED.names, dtype=float)

    return docs.withColumn(name, score(text.cast("string")))


def grade(quality: Column, toxic: Column) -> Column:
    """0 poor, 1 good but toxic, 2 good; null where the quality is."""
    return F.when(quality == 0, 0).when(F.coalesce(toxic, F.lit(0)) > 0, 1).when(quality > 0, 2)


def accepted(scores: Column, least_tail: float) -> Column:
    """Whether the best grade is likely enough; without a model everything is accepted."""
    return F.coalesce(scores["tail_prob"] >= least_tail, F.lit(True))
