"""Published numbers of a 16-model study, tests and tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from steadyrun.functions import render, stats
from steadyrun.operators import crossrun, inference

# Model, prompt, run-level pass rate, perfect stability rate, variance x 100, reasoning model.
CONFIGS = [
    ("gpt-4.1", 59.6, 47.5, 4.36, 59.2, 49.0, 4.08, False),
    ("gpt-4.1-mini", 58.4, 50.0, 3.28, 59.2, 47.0, 4.48, False),
    ("o4-mini", 86.2, 75.0, 3.36, 85.6, 69.0, 5.20, True),
    ("sonnet-4.5", 52.8, 43.0, 3.36, 51.4, 47.0, 1.68, False),
    ("haiku-4.5", 41.2, 35.0, 2.40, 40.8, 34.0, 2.00, False),
    ("gemini-3.1-pro", 86.2, 75.0, 3.36, 85.8, 74.0, 3.92, False),
    ("gemini-3-flash", 80.8, 67.0, 5.28, 83.2, 70.0, 4.40, False),
    ("gemini-3.1-flash-lite", 69.2, 53.0, 5.28, 63.6, 50.0, 5.44, False),
    ("gemini-2.5-flash", 53.8, 36.0, 7.04, 48.2, 33.0, 5.84, False),
    ("gemini-2.5-flash-think", 71.6, 58.0, 4.64, 74.4, 57.0, 4.72, True),
    ("qwq-plus", 72.8, 59.0, 4.80, 72.6, 58.0, 4.72, True),
    ("qwen-plus", 63.4, 52.0, 4.72, 61.2, 51.0, 4.64, False),
    ("qwen-max", 30.6, 26.0, 2.24, 30.4, 25.0, 2.24, False),
    ("qwen-turbo", 34.4, 32.0, 0.88, 30.8, 28.0, 1.04, False),
    ("deepseek-r1", 84.2, 74.0, 3.76, 84.4, 75.0, 3.20, True),
    ("deepseek-v3.2", 48.4, 36.0, 5.52, 47.6, 38.0, 4.00, False),
]


@pytest.fixture(scope="module")
def configs(spark):
    rows = [
        (m, p, *values, r)
        for m, *six, r in CONFIGS
        for p, values in (("detailed", six[:3]), ("minimal", six[3:]))
    ]
    schema = "model_name string, prompt_type string, rlpr double, psr double, av double, is_reasoning boolean"
    return spark.createDataFrame(rows, schema).withColumn("gap", F.col("rlpr") - F.col("psr"))


def test_regression(configs):
    fit = inference.linear_fit(configs, "rlpr", "gap").first()
    assert (round(fit.slope, 4), round(fit.intercept, 4), round(fit.r2, 4)) == (0.144, 2.0168, 0.3969)
    assert fit.n == 32 and 0 < fit.p < 0.001


def test_residuals_and_permutation(configs):
    rows = inference.residuals(configs, "rlpr", "gap")
    means = {r.is_reasoning: r.m for r in rows.groupBy("is_reasoning").agg(F.avg("residual").alias("m")).collect()}
    assert round(means[True], 4) == -0.039 and round(means[False], 4) == 0.013
    test = inference.permutation_test(rows, ["model_name", "prompt_type"], "is_reasoning", "residual", 3000).first()
    assert abs(test.p - 0.9675) < 0.015 and round(test.observed, 3) == -0.052


def test_types_gaps_winners_correlation(configs):
    av = {r.is_reasoning: (round(r.mean_av, 2), r.models) for r in crossrun.av_by_type(configs).collect()}
    assert av == {True: (4.3, 4), False: (3.81, 12)}
    gaps = crossrun.gaps(configs)
    top = gaps.where("is_largest").first()
    assert (top.model_name, top.prompt_type, round(top.gap, 1)) == ("gemini-2.5-flash", "detailed", 17.8)
    wins = crossrun.prompt_winners(configs).first()
    assert (wins.detailed_wins, wins.minimal_wins, wins.ties) == (11, 5, 0)
    assert round(wins.mean_abs_difference, 2) == 2.28
    assert round(configs.agg(F.corr("rlpr", "psr")).first()[0], 3) == 0.979


def test_reversals_equal_pairs(configs):
    rows = configs.collect()
    want = {
        (a.prompt_type, a.model_name)
        for a in rows
        for b in rows
        if a.prompt_type == b.prompt_type and a.rlpr > b.rlpr and a.psr < b.psr
    }
    rows = crossrun.rank_reversals(configs).collect()
    got = {(r.prompt_type, r.model_name) for r in rows}
    assert got == want and got
    for r in rows:
        rivals = [b for b in configs.collect() if b.prompt_type == r.prompt_type and b.rlpr < r.rlpr and b.psr > r.psr]
        assert r.reversals == len(rivals) and r.rival_psr == max(b.psr for b in rivals)


def test_dominating_points(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "a", None]), rng.choice([None, *range(12)]), rng.choice([None, *range(9)])) for _ in range(150)]
    df = spark.createDataFrame(rows, "k string, x int, y int").repartition(4)
    got = {(r.k, r.x, r.y): r.n for r in crossrun.dominating(df, ["k"], "x", "y", "n").collect()}
    want = {
        (k, x, y): sum(k == l and u is not None and v is not None and u < x and v > y for l, u, v in rows)
        for k, x, y in rows if x is not None and y is not None
    }
    assert got == want and max(want.values()) > 20
    assert crossrun.dominating(df.where("false"), ["k"], "x", "y", "n").count() == 0


def test_p_values(spark):
    def t(x, df):
        return spark.range(1).select(stats.t_pvalue(F.lit(x), F.lit(df)).alias("p")).first().p

    assert abs(t(2.042272, 30.0) - 0.05) < 1e-6
    assert abs(t(-12.706205, 1.0) - 0.05) < 1e-6
    assert abs(t(1.959966, 1e7) - 0.05) < 1e-5
    assert t(0.0, 5.0) == 1.0
    for df in (1e11, 1e15):
        for x in (0.01, 1.0, 2.5, 6.0):
            limit = math.erfc(x / math.sqrt(2))
            assert abs(t(x, df) - limit) < 1e-9 * limit + 1e-12
    for n in (10**8, 10**12):
        low = n // 2 - int(math.sqrt(n) / 2)
        limit = math.erfc((n / 2 - low - 0.5) / math.sqrt(n / 4) / math.sqrt(2))
        big = spark.createDataFrame([(low, n - low)], "b long, c long")
        assert abs(big.select(stats.mcnemar_pvalue(F.col("b"), F.col("c")).alias("p")).first().p - limit) < 1e-8

    pairs = [(0, 0, 1.0), (4, 4, 1.0), (1, 6, 0.125), (0, 5, 0.0625), (4, 8, 0.3876953125)]
    df = spark.createDataFrame([(b, c) for b, c, _ in pairs], "b int, c int").coalesce(1)
    got = [r.p for r in df.select(stats.mcnemar_pvalue(F.col("b"), F.col("c")).alias("p")).collect()]
    assert all(abs(g - w) < 1e-12 for g, (_, _, w) in zip(got, pairs))


def test_mcnemar_pairs(spark):
    rows = [("m", "p1", "detailed", 5, 5), ("m", "p1", "minimal", 5, 4), ("m", "p2", "detailed", 5, 0),
            ("m", "p2", "minimal", 5, 5), ("m", "p3", "detailed", 5, 5)]
    cells = spark.createDataFrame(rows, "model_name string, problem_id string, strategy string, n int, a int")
    out = inference.mcnemar(cells, ["model_name"]).first()
    assert (out.pairs, out.b_only, out.c_only, out.p) == (2, 1, 1, 1.0)


SUMMARY = (
    "seq int, experiment_name string, model_name string, prompt_type string, dataset string, num_problems int, "
    "stability_runs int, generation_mode string, temperature double, top_p double, max_tokens int, "
    "run_level_pass_rate double, run_level_ci_95 struct<lo: double, hi: double>"
)


def summary_rows(spark):
    base = ("m", "detailed", "main", 100, 5, None, 0.3, 0.9, 4096)
    return spark.createDataFrame(
        [
            (1, "20250101_000000_x", *base, 10.0, (9.0, 11.0)),
            (2, "20250201_000000_x", *base, 20.0, (19.111, 21.0)),
            (3, "20250201_000000_y", *base, 30.0, None),
            (4, "20250101_000000_z", "m_2", "minimal", None, None, None, "replay", None, None, None, 66.666, (0.5, 99.0)),
            (5, "20250301_000000_z", "m", "standard", "main", 100, 5, None, 0.3, 0.9, 4096, 50.0, None),
        ],
        SUMMARY,
    )


def test_dedupe_and_eligibility(spark):
    latest = crossrun.dedupe_summaries(crossrun.load_summaries(summary_rows(spark)))
    assert sorted(r.seq for r in latest.collect()) == [2, 4]
    assert [r.seq for r in crossrun.paper_eligible(latest).collect()] == [2]
    again = latest.unionByName(latest)
    assert crossrun.dedupe_summaries(again).count() == 2


def test_leaderboard_text(spark):
    latest = crossrun.dedupe_summaries(crossrun.load_summaries(summary_rows(spark)))
    board = crossrun.leaderboard(latest)
    rows = {r.row_no: r for r in board.collect()}
    assert rows[1]["Run-Level Pass Rate"] == 66.67 and rows[2]["RLPR 95% CI"] == "[19.11, 21.0]"
    md = [r.line for r in crossrun.leaderboard_markdown(board).orderBy("line_no").collect()]
    assert md[0].startswith("| Model | Prompt | Dataset |") and md[1].startswith("| --- |")
    assert md[2] == "| m_2 | minimal | None | None | None | replay | 66.67 | [0.5, 99.0] |"
    tex = [r.line for r in crossrun.leaderboard_latex(board).orderBy("line_no").collect()]
    assert tex[0] == "\\begin{tabular}{llllllll}" and tex[-1] == "\\end{tabular}"
    assert tex[4].startswith("m\\_2 & minimal & None") and tex[4].endswith("\\\\")


def test_latex_escapes_braces_of_earlier_escapes(spark):
    got = spark.range(1).select(render.latex_escape(F.lit("a\\b_{%}")).alias("x")).first().x
    assert got == "a\\textbackslash\\{\\}b\\_\\{\\%\\}"


def test_interval_text(spark):
    lit, none = F.lit, F.lit(None).cast("double")
    row = spark.range(1).select(
        render.interval_text(lit(1.0), lit(2.5), 1, "%").alias("a"), render.interval_text(none, lit(1.0)).alias("b")
    ).first()
    assert tuple(row) == ("[1.0%, 2.5%]", "N/A")
