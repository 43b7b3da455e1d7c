"""Operator 7: base quality rules and robust multivariate outliers, in DataFrame functions only.

Per group (language and source) the minimum covariance determinant estimate of four transformed statistics is
found by concentration steps: distances from the present centre and scatter, the ``support`` share of rows
nearest to it, their mean and covariance, and again. Two fixed starts (medians with absolute deviations, and
mean with covariance of all rows) run side by side and the smaller determinant wins. The estimate is scaled to
be consistent, reweighted once, and a document whose distance exceeds the cutoff is rejected.

Each step is one map-side combined aggregate of rows into groups; a row is joined only to the few numbers of
its group. The nearest rows come from counts of distances in fine logarithmic bins, so no group is sorted.
Groups of fewer than ``least_rows`` rows are estimated together per language, then all together.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from steadyrun.functions.codetext import let
from steadyrun.sources.scratch import stored

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
P = 4
X = [f"x{i}" for i in range(P)]
CELLS = [(i, j) for i in range(P) for j in range(i + 1)]


def _repeated_words(words: Column) -> Column:
    """Words that lie in some window of three words which the text holds twice or more."""

    def covered(windows: Column) -> Column:
        def positions(ordered: Column) -> Column:
            def twin(s: Column, k: Column) -> Column:
                def same(at: Column) -> Column:
                    return F.coalesce(F.get(ordered, at)["h"] == s["h"], F.lit(False))

                return same(k - 1) | same(k + 1)

            return F.sort_array(F.transform(F.filter(ordered, twin), lambda s: s["k"]))

        marked = F.sort_array(F.transform(windows, lambda h, k: F.struct(h.alias("h"), k.alias("k"))))
        starts = let(marked, positions)
        gaps = let(
            starts,
            lambda at: F.aggregate(
                F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3)))),
                F.lit(0).cast("bigint"),
                lambda a, b: a + b,
            ),
        )
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("bigint")).otherwise(gaps)

    def windows(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - 3)
        return F.transform(places, lambda k: F.xxhash64(F.get(w, k), F.get(w, k + 1), F.get(w, k + 2)))

    return F.when(F.size(words) < 4, F.lit(0).cast("bigint")).otherwise(let(windows(words), covered))


def statistics(text: Column) -> Column:
    """A struct of the counts of a text; null counts as empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    blank = F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")

    def counted(w: Column) -> Column:
        return F.struct(F.size(w).cast("bigint").alias("n_words"), _repeated_words(w).alias("n_repeat_words"))

    by_words = let(words, counted)
    chars = let(
        blank,
        lambda b: F.struct(
            F.length(b).cast("bigint").alias("word_chars"),
            (F.length(b) - F.length(F.translate(b, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
            (F.length(b) - F.length(F.translate(b, UPPER, ""))).cast("bigint").alias("n_upper"),
        ),
    )
    duplicates = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint"))
    return F.struct(by_words.alias("words"), chars.alias("chars"), duplicates.alias("n_dup_lines"))


def transformed(df: DataFrame) -> DataFrame:
    """The four statistics on scales where ordinary texts are alike, shares being drawn to 0 in short texts."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return df.withColumns(
        {
            "x0": F.log((F.col("word_chars") + 50) / (n + 10)),
            "x1": F.log(0.02 + F.col("n_symbols") / (n + 20)),
            "x2": F.log(0.05 + F.col("n_repeat_words") / (n + 100)),
            "x3": F.log(0.02 + F.col("n_upper") / (F.col("word_chars") + 50)),
        }
    )


def _chi2_cdf(x: float, df: int) -> float:
    """For even degrees of freedom."""
    term, total = 1.0, 1.0
    for k in range(1, df // 2):
        term *= x / 2 / k
        total += term
    return 1 - math.exp(-x / 2) * total


def _chi2_quantile(p: float, df: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2_cdf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


def _consistency(share: float) -> float:
    """The factor that makes the covariance of the nearest ``share`` of normal rows that of all."""
    return share / _chi2_cdf(_chi2_quantile(share, P), P + 2) if share < 1 else 1.0


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Count, mean and covariance of each group: n, m0.., c00, c10, c11.."""
    means = [F.avg(x).alias(f"m{i}") for i, x in enumerate(X)]
    cells = [F.covar_pop(X[i], X[j]).alias(f"c{i}{j}") for i, j in CELLS]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *means, *cells)


def _factored(groups: DataFrame, floors: list[float]) -> DataFrame:
    """Adds the inverse Cholesky factor w of the covariance, its diagonal being raised by the floors, and the
    logarithm of the determinant."""
    out = groups
    for i, j in CELLS:
        value = F.col(f"c{i}{j}") + (floors[i] ** 2 if i == j else 0.0)
        for k in range(j):
            value = value - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(value, F.lit(1e-12))) if i == j else value / F.col(f"l{j}{j}"))
    for j in range(P):
        out = out.withColumn(f"w{j}{j}", 1 / F.col(f"l{j}{j}"))
        for i in range(j + 1, P):
            total = F.col(f"l{i}{j}") * F.col(f"w{j}{j}")
            for k in range(j + 1, i):
                total = total + F.col(f"l{i}{k}") * F.col(f"w{k}{j}")
            out = out.withColumn(f"w{i}{j}", -total / F.col(f"l{i}{i}"))
    logs = [F.log(f"l{i}{i}") for i in range(P)]
    out = out.withColumn("log_det", sum(logs[1:], logs[0]))
    return out.drop(*[f"{a}{i}{j}" for a in "lc" for i, j in CELLS])


def _distance() -> Column:
    """Squared Mahalanobis distance of a row joined to its group."""
    total = F.lit(0.0)
    for i in range(P):
        z = F.lit(0.0)
        for j in range(i + 1):
            z = z + F.col(f"w{i}{j}") * (F.col(X[j]) - F.col(f"m{j}"))
        total = total + z * z
    return total


def _cut(rows: DataFrame, keys: list[str], value: Column, share: float, fineness: int) -> DataFrame:
    """Per group the bin of ``value`` at which ``share`` of the rows is reached: keys and cut.

    Bins are 1 / fineness wide, so a group has as many rows here as its values have bins.
    """
    counts = rows.groupBy(*keys, F.floor(value * fineness).alias("bin")).agg(F.count(F.lit(1)).alias("rows"))
    upto = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = counts.withColumns({"upto": F.sum("rows").over(upto), "all": F.sum("rows").over(Window.partitionBy(*keys))})
    return sums.where(F.col("upto") >= share * F.col("all")).groupBy(*keys).agg(F.min("bin").alias("cut"))


def _log_distance() -> Column:
    return F.log(F.col("d2") + 1e-9)


def _medians(rows: DataFrame, values: list[Column], fineness: int = 256) -> DataFrame:
    """Per group the medians of several columns, to 1 / fineness."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), v.alias("v")) for i, v in enumerate(values)]))
    long = rows.select("g", each.alias("e")).select("g", "e.i", "e.v")
    cuts = _cut(long, ["g", "i"], F.col("v"), 0.5, fineness)
    middle = [F.max(F.when(F.col("i") == i, (F.col("cut") + 0.5) / fineness)).alias(f"v{i}") for i in range(len(values))]
    return cuts.groupBy("g").agg(*middle)


def _starts(rows: DataFrame, floors: list[float]) -> DataFrame:
    """The two starts of each group, factored."""
    middle = _medians(rows, [F.col(x) for x in X]).select("g", *[F.col(f"v{i}").alias(f"m{i}") for i in range(P)])
    off = _medians(rows.join(middle, "g"), [F.abs(F.col(x) - F.col(f"m{i}")) for i, x in enumerate(X)])
    cells = [
        (F.pow(1.4826 * F.col(f"v{i}"), 2) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in CELLS
    ]
    robust = middle.join(off, "g").select("g", F.lit(0).alias("start"), *[f"m{i}" for i in range(P)], *cells)
    plain = _moments(rows, ["g"]).select("g", F.lit(1).alias("start"), *robust.columns[2:])
    return _factored(robust.union(plain), floors)


def estimates(
    rows: DataFrame, support: float = 0.75, steps: int = 5, floors: tuple[float, ...] = (0.05, 0.25, 0.25, 0.15)
) -> DataFrame:
    """Per group g of ``rows`` (g, x0..): centre m0.. and inverse factor w00.. of the reweighted estimate.

    ``floors`` are standard deviations added to each statistic, so that one which nearly all rows share does
    not make every other value an outlier.
    """
    floors = list(floors)
    now = stored(_starts(rows, floors), "scatter")
    for _ in range(steps):
        near = rows.join(now, "g").select("g", "start", *X, _distance().alias("d2"))
        # One row per group and start; written, so its size is known and a large group's rows stay where they are.
        cuts = stored(_cut(near, ["g", "start"], _log_distance(), support, 32), "cuts")
        chosen = near.join(cuts, ["g", "start"]).where(F.floor(_log_distance() * 32) <= F.col("cut"))
        now = stored(_factored(_moments(chosen, ["g", "start"]), floors), "scatter")
    best = now.groupBy("g").agg(F.min(F.struct("log_det", "start")).alias("best"))
    raw = now.join(best, "g").where("start = best.start")
    near = rows.join(raw, "g").select("g", *X, _distance().alias("d2"))
    kept = near.where(F.col("d2") <= _chi2_quantile(0.975, P) * _consistency(support))
    scale = _consistency(0.975)
    moments = _moments(kept, ["g"])
    return stored(_factored(moments.withColumns({f"c{i}{j}": F.col(f"c{i}{j}") * scale for i, j in CELLS}), floors), "scatter")


def _grouped(df: DataFrame, least_rows: int) -> DataFrame:
    """Adds g, the group a row is estimated with. Nulls are a language or source like others."""

    def text(name: str) -> Column:
        return F.coalesce(F.concat(F.lit("="), F.col(name)), F.lit("null"))

    named = df.withColumns({"g_lang": text("lang"), "g_source": text("source")})
    usable = named.where("not base_failed")
    sizes = usable.groupBy("g_lang", "g_source").agg(F.count(F.lit(1)).alias("rows"))
    small = sizes.where(F.col("rows") < least_rows).groupBy("g_lang").agg(F.sum("rows").alias("rows_of_lang"))
    sizes = sizes.join(small, "g_lang", "left")
    own = F.concat("g_lang", F.lit("\n"), "g_source")
    g = F.when(F.col("rows") >= least_rows, own).when(F.col("rows_of_lang") >= least_rows, F.col("g_lang"))
    groups = sizes.select("g_lang", "g_source", F.coalesce(g, F.lit("all")).alias("g"))
    return named.join(groups, ["g_lang", "g_source"], "left").drop("g_lang", "g_source")


def robust_outliers(
    docs: DataFrame, support: float = 0.75, tail: float = 1e-6, least_rows: int = 200, steps: int = 5
) -> DataFrame:
    """Counts, base rules and the robust verdict for every row of ``docs`` (doc_id, text, lang, source).

    base_failed: fewer than 50 words, or more than half of the words in repeated windows of three. kept is
    false for those, and for rows whose squared robust distance exceeds the chi-square quantile that normal
    rows exceed with probability ``tail``. Rows that fail the base rules don't enter the estimates.

    A null text counts as empty and so fails; null languages and sources are groups of their own; rows that
    repeat, or have no doc_id, are rows like others; other columns are ignored; an empty table gives no rows.
    """
    counted = docs.select("doc_id", "lang", "source", statistics(F.col("text")).alias("s"))
    flat = counted.select(
        "doc_id", "lang", "source", "s.words.n_words", "s.chars.word_chars", "s.chars.n_symbols", "s.n_dup_lines",
        "s.words.n_repeat_words", "s.chars.n_upper",
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = stored(transformed(flat.withColumn("base_failed", failed)), "statistics")
    rows = stored(_grouped(rows, least_rows), "statistics")
    found = estimates(rows.where("not base_failed").select("g", *X), support, steps)
    judged = rows.join(found, "g", "left").withColumn("distance", _distance())
    inside = F.coalesce(F.col("distance") <= _chi2_quantile(1 - tail, P), F.lit(True))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & inside).alias("kept"), "distance",
    )
