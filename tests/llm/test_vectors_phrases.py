"""Hard negatives (op11), exact top-k (op12) and collocations (op13) against plain versions."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from steadyrun.llm import block_max, collocations, multi_index, vectors

VECTORS = "vec_id long, embedding array<double>, label int, score string, slot int, id int"


def whole(x):
    """The vector as whole numbers, or None where it takes no part."""
    if x is None or any(v is None or not math.isfinite(v) for v in x):
        return None
    return [math.floor(256 * v) for v in x]


def product(a, b):
    return sum(x * y for x, y in zip(a, b))


def plain_top(rows, k, asks):
    held = [(i, whole(x)) for i, x, _ in rows if i is not None and whole(x) is not None]
    out = []
    for i, x in held:
        if asks(i):
            best = sorted((-product(x, y), j) for j, y in held if j != i)[:k]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(best, 1)]
    return sorted(out)


def plain_negatives(rows, asks, k=5, m=10, low=30, high=90):
    held = [(i, whole(x), label) for i, x, label in rows if None not in (i, label) and whole(x) is not None]
    out = []
    for i, x, label in held:
        if asks(i):
            scores = [(-product(x, y), j, other) for j, y, other in held]
            for p, partner, _ in sorted(s for s in scores if s[2] == label and s[1] != i)[:k]:
                within = sorted(s[:2] for s in scores if s[2] != label and low * -p <= 100 * -s[0] <= high * -p)[:m]
                out += [(i, partner, rank, j, -p, -s) for rank, (s, j) in enumerate(within, 1)]
    return sorted(out)


def made(seed, n, width, spread=1.0):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    rows = []
    for i in range(n):
        c = rnd.choice(centres)
        rows.append((i - 20, [spread * (v + rnd.gauss(0, 0.3)) for v in c], rnd.choice([0, 1, 2, None])))
    copy = rows[10][1]
    rows += [(1000 + i, copy, i % 3) for i in range(n // 3)]
    rows += [(2000, None, 1), (2001, [None] * width, 1), (2002, [math.nan] * width, 1), (2003, [math.inf] * width, 0)]
    rows += [(None, copy, 1), (2004, [], 1), (2005, [0.0] * width, 2), (2006, copy[:1], 0), rows[0], rows[0], rows[5]]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], VECTORS).repartition(3)


@pytest.mark.parametrize("sizes", [{}, {"segment_rows": 40, "query_rows": 7, "block_rows": 4}])
def test_top_k_equals_plain_search(spark, sizes):
    rows = made(3, 150, 7)
    got = block_max.top_k(frame(spark, rows), F.col("vec_id") % 5 == 0, 6, **sizes)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == plain_top(rows, 6, lambda i: i % 5 == 0)


def test_top_k_of_few_rows(spark):
    rows = [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (5, [-1.0, 0.5], 1)]
    got = block_max.top_k(frame(spark, rows), F.col("vec_id") % 5 == 0).collect()
    assert sorted(map(tuple, got)) == plain_top(rows, 5, lambda i: i % 5 == 0)
    assert block_max.top_k(frame(spark, rows), F.col("vec_id") < 0).count() == 0
    assert block_max.top_k(frame(spark, rows).where("false"), F.col("vec_id") % 5 == 0).count() == 0
    assert block_max.top_k(frame(spark, rows[:1]), F.col("vec_id") == 0).count() == 0


def test_top_k_leaves_blocks_out():
    """On rows in tight groups most blocks are never scored."""
    rng = np.random.default_rng(1)
    x = np.floor(256 * (rng.normal(size=(32, 1, 8)) * 4 + rng.normal(size=(32, 64, 8)) * 0.05)).reshape(-1, 8)
    blocks = []
    for rows in block_max.ranges(x, 16):
        here = x[rows]
        packed = {c: vectors.to_bytes(v) for c, v in (("x", here), ("high", here.max(axis=0)), ("low", here.min(axis=0)))}
        blocks.append({"ids": rows.astype(np.int64).tobytes(), "rows": len(rows), "width": 8, **packed})
    assert sorted(np.concatenate([vectors.longs(b["ids"]) for b in blocks])) == list(range(len(x)))
    asked = []
    real = vectors.Best.offer

    def counted(self, slots, scores, ids, allowed):
        asked.append(scores.size)
        return real(self, slots, scores, ids, allowed)

    vectors.Best.offer = counted
    try:
        slot, found, score = block_max.searched(np.arange(-9, -1), x[::256], blocks, 5).rows()
    finally:
        vectors.Best.offer = real
    assert len(slot) == 40 and sum(asked) < 8 * len(x) / 4


def test_large_components_stay_exact(spark):
    rows = [(0, [2.0**20, 3.0], 1), (1, [100.0, 2.0**-8], 1), (2, [100.0, 0.0], 1), (3, [99.5, 5.0], 1)]
    got = block_max.top_k(frame(spark, rows), F.col("vec_id") == 0, 3).collect()
    assert sorted(map(tuple, got)) == plain_top(rows, 3, lambda i: i == 0)
    with pytest.raises(Exception, match="too large"):
        block_max.top_k(frame(spark, [(0, [2.0**44], 1), (1, [2.0**44], 1)]), F.col("vec_id") == 0).collect()


@pytest.mark.parametrize("sizes", [{}, {"segment_rows": 40, "anchor_rows": 5, "codes": 3, "fit_rows": 30}])
@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_hard_negatives_equal_plain_mining(spark, sizes, spread):
    rows = made(7, 150, 6, spread)
    got = multi_index.hard_negatives(frame(spark, rows), F.col("label"), F.col("vec_id") % 4 == 0, **sizes)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = plain_negatives(rows, lambda i: i % 4 == 0)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 300


def test_hard_negatives_of_few_rows(spark):
    rows = [(0, [1.0], 1), (4, [-2.0], 1), (5, [0.5], 2), (6, [0.9], 2), (7, [], 2)]
    got = multi_index.hard_negatives(frame(spark, rows), F.col("label"), F.col("vec_id") % 4 == 0).collect()
    assert sorted(map(tuple, got)) == plain_negatives(rows, lambda i: i % 4 == 0)
    for some in (frame(spark, rows).where("false"), frame(spark, rows[4:])):
        assert multi_index.hard_negatives(some, F.col("label"), F.col("vec_id") % 4 == 0).count() == 0


def test_multi_sequence_is_sorted_and_whole():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 9, 7).astype(float), rng.integers(0, 9, 5).astype(float)
    got = list(multi_index.multi_sequence(a, b))
    assert [s for s, _, _ in got] == sorted((a[:, None] + b).ravel(), reverse=True)
    assert sorted((i, j) for _, i, j in got) == [(i, j) for i in range(7) for j in range(5)]
    assert all(s == a[i] + b[j] for s, i, j in got)
    assert list(multi_index.multi_sequence(a[:0], b)) == []


def plain_collocations(rows, least, longest, first):
    counts, totals, out = {}, Counter(), []
    for text, lang in rows:
        lang = "und" if lang is None else lang
        held = counts.setdefault(lang, Counter())
        lower = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                held.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    for lang, held in counts.items():
        found = {p: a for p, a in held.items() if len(p) >= 2 and a >= least}
        inner = {p[i:j] for p in found for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and found[p[i:j]] <= found[p]}
        scored = []
        for p, a in found.items():
            if p not in inner:
                cuts = [(1000 * a * totals[lang] // (held[p[:k]] * held[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                scored.append((-score, -a, " ".join(p).encode(), held[p[:k]], held[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:first], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


def worded(seed, n):
    rnd = random.Random(seed)
    words = ["a", "b", "A", "Ä", "ä", "c d", "e", "f'g", "\x01", "é", "-", "日本", "h1"]
    text = lambda: "".join(rnd.choice(words) + rnd.choice([" ", " ", "  ", "\t", " ", ", ", "\n", ". ", " "]) for _ in range(rnd.randint(0, 60)))
    return [(text(), rnd.choice(["en", "de", None])) for _ in range(n)]


@pytest.mark.parametrize("settings", [{}, {"range_rows": 9}, {"longest": 2}, {"longest": 3, "range_rows": 50}, {"first": 3}])
def test_collocations_equal_plain_counting(spark, settings):
    rows = worded(2, 300) + [(None, "en"), ("", "fr"), ("...", None), ("a a a a a a a a a", "x\x01"), ("one", "one")]
    rows += [("the same line stands here, the same line", "en")] * 80
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "text string, lang string, n int, phrase string").repartition(4)
    got = collocations.collocations(df, least=3, **settings)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    plain = {"least": 3, "longest": 5, "first": 2000} | {k: v for k, v in settings.items() if k != "range_rows"}
    assert sorted(map(tuple, got.collect())) == plain_collocations(rows, **plain)


def test_collocations_of_long_texts_in_small_stretches(spark, monkeypatch):
    monkeypatch.setattr(collocations, "HELD", 50)
    monkeypatch.setattr(collocations, "STRETCH", 16)
    monkeypatch.setattr(collocations, "KEYS", 30)
    rows = [(" ".join(t for t, _ in worded(seed, 40)), "en") for seed in range(6)] + [("w " * 70_000 + "v", "en")]
    df = spark.createDataFrame(rows, "text string, lang string")
    assert sorted(map(tuple, collocations.collocations(df, least=4, range_rows=100).collect())) == plain_collocations(rows, 4, 5, 2000)


def test_collocations_of_nothing(spark):
    df = spark.createDataFrame([(None, None), ("one", "en")], "text string, lang string")
    assert collocations.collocations(df, least=1).count() == 0
    assert collocations.collocations(df.where("false")).count() == 0


def test_exact_scores_beyond_64_bits(spark):
    counts = spark.createDataFrame([("en", p, n) for p, n in (("a ", 9 * 10**14), ("b ", 7 * 10**14), ("a b ", 6 * 10**14))], "lang string, phrase string, n long")
    got = {r.phrase: (r.n, r.above, r.extended) for r in collocations.lockstep(counts, 10).collect()}
    assert got == {"a ": (9 * 10**14, [], 6 * 10**14), "b ": (7 * 10**14, [], 0), "a b ": (6 * 10**14, [9 * 10**14], 0)}
