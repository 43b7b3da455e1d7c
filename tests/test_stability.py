"""Cells and rates against a plain loop, golden numbers, and properties."""

import random

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from steadyrun.functions import stats
from steadyrun.functions.quantiles import exact_percentiles
from steadyrun.functions.spread import in_ranges, positions, ranks, running_totals
from steadyrun.operators import crossrun, inference, stability
from steadyrun.plans import q_stability

SCHEMA = "model_name string, problem_id string, strategy string, trial_index int, status string, latency_ms double, at int"


def make_rows(seed=3, copies=True):
    rng = random.Random(seed)
    rows = []
    for m in ("a", "b"):
        for p in range(12):
            for s in ("detailed", "with_prompt", "minimal", None, ""):
                n = rng.choice([1, 2, 5, 9])
                rate = rng.random()
                for t in sorted(rng.sample(range(12), n)):
                    status = "Accepted" if rng.random() < rate else rng.choice(["Wrong Answer", "accepted", None])
                    rows.append((m, f"p{p}", s, t, status, rng.choice([0.0, None, 5.0, 7.5, 12.0]), 0))
                    if copies and rng.random() < 0.2:
                        rows.append((m, f"p{p}", s, t, "Accepted", 1.0, 1))
    return rows


def label(s):
    return {"with_prompt": "detailed", "without_prompt": "minimal"}.get(s or "default", s or "default")


def brute(rows):
    seen, cells = set(), {}
    for m, p, s, t, status, _, _ in sorted(rows, key=lambda r: (r[3], r[6], r[4] or "")):
        key = (m, p, label(s))
        if (key, t) in seen:
            continue
        seen.add((key, t))
        c = cells.setdefault(key, {"n": 0, "a": 0, "fp": 0, "first": 0})
        ok = status == "Accepted"
        c["n"] += 1
        c["a"] += ok
        c["fp"] = int(ok) if t == 0 else c["fp"]
        if ok and not c["first"]:
            c["first"] = c["n"]
    return {k: (c["n"], c["a"], c["fp"], c["first"]) for k, c in cells.items()}


def prepared(spark, rows):
    df = stability.with_labels(spark.createDataFrame(rows, SCHEMA))
    return stability.dedupe_trials(df, [F.col("at"), F.col("status")])


@pytest.mark.parametrize("span", [1, 3, 4096])
def test_cells_equal_a_loop(spark, monkeypatch, span):
    """Short spans put every cell through the step that long cells take."""
    monkeypatch.setattr(stability, "SPAN", span)
    # Copies of one attempt differ only in ``at``; both prompt spellings share no index here.
    rows = [r for r in make_rows() if r[2] != "with_prompt" and r[2] != ""]
    got = {
        (r.model_name, r.problem_id, r.strategy): (r.n, r.a, r.first_pass, r.first_accepted)
        for r in stability.cells(prepared(spark, rows)).collect()
    }
    assert got == brute(rows)


def test_counts_equal_cells(spark):
    trials = prepared(spark, make_rows())
    a = stability.cells(trials).drop("first_accepted").collect()
    assert sorted(a) == sorted(stability.cell_counts(trials).collect())


def test_hot_cell_and_copies(spark):
    """One cell with a third of all rows, one attempt copied thousands of times."""
    hot = spark.range(30000).select(
        F.lit("m").alias("model_name"), F.lit("hot").alias("problem_id"), F.lit("detailed").alias("strategy"),
        F.col("id").cast("int").alias("trial_index"),
        F.when(F.col("id") >= 20000, "Accepted").otherwise("Wrong Answer").alias("status"),
    )
    copied = spark.range(30000).select(
        F.lit("m").alias("model_name"), F.lit("copied").alias("problem_id"), F.lit("detailed").alias("strategy"),
        F.lit(0).alias("trial_index"), F.lit("Accepted").alias("status"),
    )
    trials = stability.dedupe_trials(stability.with_labels(hot.unionByName(copied)), [F.col("status")])
    got = {r.problem_id: (r.n, r.a, r.first_pass, r.first_accepted) for r in stability.cells(trials).collect()}
    assert got == {"hot": (30000, 10000, 0, 20001), "copied": (1, 1, 1, 1)}


def test_missing_index_comes_last(spark):
    rows = [("m", "p", "minimal", None, "Accepted", 1.0, 0), ("m", "p", "minimal", 4, "Wrong Answer", 1.0, 0)]
    row = stability.cells(stability.with_labels(spark.createDataFrame(rows, SCHEMA))).first()
    assert (row.n, row.a, row.first_pass, row.first_accepted) == (2, 1, 0, 2)


def test_log_without_index(spark):
    rows = [("m", "p", "minimal", None, st, 1.0, at) for at, st in ((3, "Accepted"), (1, "x"), (2, "x"))]
    trials = stability.with_labels(spark.createDataFrame(rows, SCHEMA))
    with pytest.raises(Exception, match="number_trials"):
        stability.dedupe_trials(trials, [F.col("at")]).collect()
    numbered = stability.number_trials(trials, [F.col("at")])
    row = stability.cells(stability.dedupe_trials(numbered, [F.col("at")])).first()
    assert (row.n, row.a, row.first_pass, row.first_accepted) == (3, 1, 0, 3)


def test_empty_input(spark):
    trials = stability.with_labels(spark.createDataFrame([], SCHEMA))
    assert stability.stability_summary(trials, ["model_name"]).count() == 0
    row = stability.with_intervals(stability.cell_totals(stability.cells(trials), [])).first()
    assert row.total_problems == 0 and row.run_level_pass_rate == 0.0 and tuple(row.run_level_ci_95) == (0.0, 0.0)


def test_four_run_file(spark):
    """Two attempts per prompt of one problem: two problem-prompt cells, not one problem."""
    rows = [("m", "1", s, i, st, 0.0, 0) for s, sts in (("with_prompt", ["Accepted"] * 2), ("without_prompt", ["Accepted", "Wrong Answer"])) for i, st in enumerate(sts)]
    trials = stability.with_labels(spark.createDataFrame(rows, SCHEMA))
    cells = stability.cells(trials)
    total = stability.cell_totals(cells, []).first()
    assert (total.total_runs, total.total_problems, total.accepted_runs) == (4, 2, 3)
    by = {r.strategy: r for r in stability.cell_totals(cells, ["strategy"]).collect()}
    assert (by["detailed"].accepted_runs, by["minimal"].accepted_runs) == (2, 1)
    assert by["detailed"].pass_at_1 == by["minimal"].pass_at_1 == 100.0


def test_properties(spark):
    cells = stability.cells(prepared(spark, make_rows(seed=11)))
    for r in stability.with_intervals(stability.cell_totals(cells, ["model_name", "strategy"])).collect():
        assert r.pass_at_1 <= r.pass_at_3 <= r.pass_at_5 <= 100
        assert 0 <= r.average_variance <= 0.25
        assert r.average_variance_unbiased >= r.average_variance
        for ci, value in (
            (r.run_level_ci_95, r.run_level_pass_rate), (r.perfect_stability_ci_95, r.perfect_stability_rate),
        ):
            assert 0 <= ci.lo <= value + 1e-9 and value - 1e-9 <= ci.hi <= 100 + 1e-9


@pytest.mark.parametrize(
    "s, n, lo, hi", [(588, 1000, 55.72, 61.81), (97, 200, 41.67, 55.39), (121, 200, 53.59, 67.02), (0, 0, 0, 0)]
)
def test_wilson_golden(spark, s, n, lo, hi):
    ci = spark.range(1).select(stats.wilson(F.lit(s), F.lit(n)).alias("c")).first().c
    assert (round(ci.lo, 2), round(ci.hi, 2)) == (lo, hi)


def test_percentiles_equal_numpy(spark):
    rng = random.Random(5)
    rows = [(g, rng.choice([rng.gauss(0, 50), float(round(rng.expovariate(0.01))), 42.0, 42.0, 1e9, None])) for g in "ab" for _ in range(700)]
    rows += [("c", 3.5), (None, 1.0), (None, 2.0)]
    # Crowded: thousands of values that share two logarithmic bins.
    rows += [("d", rng.uniform(1000, 1002)) for _ in range(4000)] + [("e", -1e300), ("e", 1e300), ("e", 0.0)]
    probs = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    out = exact_percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", probs)
    for r in out.collect():
        values = [v for g, v in rows if g == r.g and v is not None]
        assert np.allclose([r[p] for p in probs], np.percentile(values, [q * 100 for q in probs.values()]))


@pytest.mark.parametrize("ranges", [None, 1, 7, 40])
def test_positions_and_running_totals(spark, ranges):
    rng = random.Random(2)
    rows = [(rng.choice(["x", "x", "x", "y", None]), i, rng.choice([None, *range(100)]), rng.randrange(5)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i int, o int, v int").repartition(6)
    out = running_totals(df, ["k"], [F.col("o"), F.col("i")], {"t": F.col("v"), "u": -F.col("v")}, ranges)
    out = positions(out, [], [F.desc("k"), F.col("o"), F.col("i")], "pos", ranges)
    assert out.columns == ["k", "i", "o", "v", "t", "u", "pos"]
    want, run = {}, {}
    for k, i, o, v in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[1])):
        run[k] = run.get(k, 0) + v
        want[i] = [run[k]]
    for pos, r in enumerate(sorted(rows, key=lambda r: (r[0] is None, -ord(r[0] or "a"), r[2] is not None, r[2] or 0, r[1])), 1):
        want[r[1]].append(pos)
    assert {r.i: [r.t, r.pos] for r in out.collect()} == want
    assert all(r.t == -r.u for r in out.collect())


def test_a_hot_order_value_is_spread_over_ranges(spark):
    # Of 8,000 rows half have one key and one order value; only a hash tells them apart.
    rows = [("hot", 5, i) for i in range(4000)] + [(f"k{i % 9}", i % 50, i) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, o int, i int").repartition(8)
    cut = in_ranges(df, ["k"], [F.col("o")], 16)
    sizes = {r["__range"]: r["count"] for r in cut.groupBy("__range").count().collect()}
    assert len(sizes) >= 14 and max(sizes.values()) < 1500
    hot = {r["__range"] for r in cut.where("k = 'hot'").select("__range").distinct().collect()}
    assert len(hot) >= 6
    got = positions(df, ["k"], [F.col("o")], "pos", 16)
    assert sorted(r.pos for r in got.where("k = 'hot'").collect()) == list(range(1, 4001))
    for k in range(9):
        own = sorted((r.o, r.pos) for r in got.where(F.col("k") == f"k{k}").collect())
        assert [p for _, p in own] == list(range(1, len(own) + 1))


def test_ranks(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, 1.5, 2.5, 3.5, -1.0])) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, i int, x double")
    w = Window.partitionBy("k").orderBy(F.desc_nulls_last("x"))
    want = df.select("i", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("d")).collect()
    got = ranks(df, ["k"], "x", ("r", "d"), 5).select("i", "r", "d").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert positions(df.where("false"), ["k"], [F.col("i")], "pos").count() == 0


def test_bootstrap_close_to_plain(spark):
    rng = np.random.default_rng(1)
    values = rng.choice([0.0, 0.16, 0.24], size=300, p=[0.6, 0.25, 0.15])
    plain = [rng.choice(values, size=300).mean() for _ in range(4000)]
    lo, hi = np.percentile(plain, [2.5, 97.5])
    df = spark.createDataFrame([("g", float(v)) for v in values], "g string, v double").repartition(5)
    out = inference.bootstrap_mean(df, ["g"], "v", replicates=2000).first()
    again = inference.bootstrap_mean(df.repartition(3), ["g"], "v", replicates=2000).first()
    assert out.replicates == again.replicates == 2000
    assert np.allclose([out.lo, out.hi], [again.lo, again.hi], rtol=1e-12)
    assert abs(out.lo - lo) < 0.002 and abs(out.hi - hi) < 0.002


def test_bootstrap_of_many_distinct_values(spark):
    rng = np.random.default_rng(2)
    values = rng.normal(5, 1, 2000)
    df = spark.createDataFrame([(None, float(v)) for v in values] + [("one", 2.0), ("none", None)], "g string, v double")
    out = {r.g: r for r in inference.bootstrap_mean(df, ["g"], "v", replicates=200).collect()}
    assert set(out) == {None, "one"} and (out["one"].lo, out["one"].hi) == (2.0, 2.0)
    error = 1.96 * values.std() / np.sqrt(len(values))
    assert abs(out[None].lo - (values.mean() - error)) < 0.2 * error and abs(out[None].hi - (values.mean() + error)) < 0.2 * error
    whole = inference.bootstrap_mean(df.where("g is null"), [], "v", replicates=100).first()
    assert whole.replicates == 100 and whole.lo < values.mean() < whole.hi


def test_summary_with_variance_interval(spark):
    rows = [(m, f"p{p}", "detailed", t, int((p + t) % 3 > 0), 5.0) for m in ("a", None) for p in range(40) for t in range(5)]
    df = spark.createDataFrame(rows, "model_name string, problem_id string, strategy string, trial_index int, accepted int, latency_ms double")
    summary = inference.with_variance_interval(
        stability.stability_summary(df, ["model_name"]), stability.cell_counts(df), ["model_name"], replicates=200
    )
    got = summary.collect()
    assert len(got) == 2
    assert all(r.average_variance_ci_95.lo <= r.average_variance <= r.average_variance_ci_95.hi for r in got)
    board = crossrun.leaderboard(summary.withColumn("prompt_type", F.lit("detailed")))
    assert "AV 95% CI" in board.columns and board.first()["AV 95% CI"].startswith("[0.")


def test_summary_counts_its_cells_once(spark, sf, monkeypatch):
    made = []
    plain = stability.cells
    monkeypatch.setattr(stability, "cells", lambda trials: made.append(1) or plain(trials))
    monkeypatch.setattr(stability, "cell_counts", lambda trials: pytest.fail("attempts are counted a second time"))
    rows = q_stability.summary_rows(spark, sf)
    assert made == [1] and {"average_variance_ci_95", "p50_latency_ms", "pass_at_5"} <= set(rows.columns)
