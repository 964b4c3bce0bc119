"""Significance tests: distributed sufficient statistics, then a p-value per group row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelens.functions import distributions as dist
from scorelens.operators.ranks import ordered_index, value_ranks
from scorelens.storage import join_on, materialize


def t_statistic(deltas: DataFrame, by: list[str], value: str = "delta") -> DataFrame:
    """One-sample t against 0. Equal values other than 0 give an infinite t, all zeros give NULL."""
    d = F.col(value)
    error = F.stddev_samp(d) / F.sqrt(F.count(d))
    infinite = F.when(F.avg(d) > 0, F.lit(float("inf"))).when(F.avg(d) < 0, F.lit(float("-inf")))
    return deltas.groupBy(*by).agg(
        F.count(d).alias("n"),
        F.avg(d).alias("mean"),
        F.when(F.min(d) == F.max(d), F.when(F.count(d) > 1, infinite)).otherwise(
            F.try_divide(F.avg(d), F.nullif(error, F.lit(0.0)))
        ).alias("t"),
        (F.count(d) - 1).alias("df"),
    )


def t_test(deltas: DataFrame, by: list[str], value: str = "delta", *, alternative: str = "two-sided") -> DataFrame:
    """t test of mean 0 with significance flags at .01 and .05; ``greater`` halves the tail on the side of t."""
    stats = t_statistic(deltas, by, value)
    p = dist.student_p(F.col("t"), F.col("df").cast("double"))
    stats = stats.withColumn("p_value", F.nanvl(p, F.lit(None).cast("double")))
    if alternative == "greater":
        half = F.col("p_value") / 2
        stats = stats.withColumn("p_value", F.when(F.col("t") > 0, half).otherwise(1 - half))
    return stats.withColumn("significant_01", F.col("p_value") < 0.01).withColumn(
        "significant_05", F.col("p_value") < 0.05
    )


def wilcoxon_statistic(deltas: DataFrame, by: list[str], value: str = "delta") -> DataFrame:
    """Signed-rank sums of the non-zero differences, with the tie term and the number of zeros.

    Zeros are ranked with the rest, where they come first, and their number is taken off every rank afterwards, so
    one ordered table is enough.
    """
    d = F.col(value)
    ranked = value_ranks(
        deltas.where(d.isNotNull()).select(*by, F.abs(d).alias("_a"), (d > 0).cast("int").alias("_up")),
        by,
        "_a",
        {"up": F.col("_up")},
    )
    n, up, moved = F.col("n"), F.col("up"), F.col("_a") > 0

    def total(x: Column) -> Column:
        return F.coalesce(F.sum(F.when(moved, x)), F.lit(0))

    size = n.cast("double")
    sums = ranked.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(~moved, n)), F.lit(0)).alias("zeros"),
        total(n).alias("n"),
        total(up).alias("_ups"),
        total(F.col("avg_rank") * up).alias("_up_ranks"),
        total(F.col("avg_rank") * (n - up)).alias("_down_ranks"),
        total(size * size * size - size).cast("double").alias("tie_term"),
    )
    zeros, ups = F.col("zeros"), F.col("_ups")
    return (
        sums.withColumn("w_plus", (F.col("_up_ranks") - zeros * ups).cast("double"))
        .withColumn("w_minus", (F.col("_down_ranks") - zeros * (F.col("n") - ups)).cast("double"))
        .withColumn("statistic", F.least("w_plus", "w_minus"))
        .drop("_ups", "_up_ranks", "_down_ranks")
    )


def wilcoxon_test(
    deltas: DataFrame, by: list[str], value: str = "delta", *, alternative: str = "two-sided", min_rows: int = 0
) -> DataFrame:
    """Signed-rank test; a group without non-zero differences has statistic 0 and p-value 1.

    ``greater`` tests the upper tail of W+ and leaves the p-value NULL below ``min_rows`` rows.
    """
    stats = wilcoxon_statistic(deltas, by, value)
    test = dist.wilcoxon_greater if alternative == "greater" else dist.wilcoxon_two_sided
    p = test("n", "w_plus", "tie_term", "zeros")
    out = stats.withColumn("p_value", p)
    if alternative == "greater":
        out = out.withColumn("statistic", F.col("w_plus"))
    if min_rows:
        out = out.withColumn("p_value", F.when(F.col("n") + F.col("zeros") >= min_rows, F.col("p_value")))
    return out.withColumn("significant_01", F.col("p_value") < 0.01).withColumn(
        "significant_05", F.col("p_value") < 0.05
    )


def shapiro_test(deltas: DataFrame, by: list[str], value: str = "delta", *, key: str = "prompt_id") -> DataFrame:
    """Shapiro-Wilk over all rows of each group; ``p_reliable`` is false above 5000 rows, where the p-value
    approximation was not fitted."""
    rows = deltas.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_x"), key)
    sizes = materialize(
        rows.groupBy(*by).agg(F.count("*").alias("n"), (F.var_pop("_x") * F.count("*")).alias("squares")), "sizes"
    )
    placed = join_on(ordered_index(rows, by, ["_x", key], "_i"), sizes, by)
    placed = placed.withColumn("_m", dist.normal_quantile((F.col("_i") - 0.375) / (F.col("n") + 0.25)))

    def at(position: Column) -> Column:
        return F.max(F.when(F.col("_i") == position, F.col("_x")))

    sums = placed.groupBy(*by).agg(
        F.max("n").alias("n"),
        F.sum(F.col("_m") * F.col("_m")).alias("m2"),
        F.sum(F.col("_m") * F.col("_x")).alias("mx"),
        F.max("squares").alias("squares"),
        at(F.lit(1)).alias("first"),
        F.coalesce(at(F.lit(2)), at(F.lit(1))).alias("second"),
        F.coalesce(at(F.col("n") - 1), at(F.lit(1))).alias("next_last"),
        at(F.col("n")).alias("last"),
    )
    tested = sums.withColumn(
        "_t", dist.shapiro_udf("n", "m2", "mx", "squares", "first", "second", "next_last", "last")
    )
    return tested.select(
        *by,
        "n",
        F.nanvl(F.col("_t.w"), F.lit(None)).alias("w"),
        F.nanvl(F.col("_t.p"), F.lit(None)).alias("p_value"),
        (F.col("_t.p") > 0.05).alias("normal"),
        (F.col("n") <= 5000).alias("p_reliable"),
    )


def mann_whitney_statistic(samples: DataFrame, by: list[str], value: str, first: Column) -> DataFrame:
    """U of the rows where ``first`` holds against the others, with the tie term.

    Rows without a value (NULL or NaN) or with an unknown side take no part.
    """
    samples = samples.where(first.isNotNull() & F.col(value).isNotNull() & ~F.isnan(value))
    ranked = value_ranks(
        samples.select(*by, value, first.cast("int").alias("_first")), by, value, {"first": F.col("_first")}
    )
    n = F.col("n").cast("double")
    sums = ranked.groupBy(*by).agg(
        F.sum("first").alias("n1"),
        F.sum(F.col("n") - F.col("first")).alias("n2"),
        F.sum(F.col("avg_rank") * F.col("first")).alias("rank_sum"),
        F.sum(n * n * n - n).alias("tie_term"),
    )
    n1 = F.col("n1").cast("double")
    return sums.withColumn("u", F.col("rank_sum") - n1 * (n1 + 1) / 2)


def mann_whitney_test(samples: DataFrame, by: list[str], value: str, first: Column) -> DataFrame:
    """One-sided test that the first sample is greater (normal form with tie and continuity correction)."""
    stats = mann_whitney_statistic(samples, by, value, first)
    p = dist.mann_whitney_p("n1", "n2", "u", "tie_term")
    return stats.withColumn("p_value", F.nanvl(p, F.lit(None).cast("double")))


def cohens_d(paired: DataFrame, by: list[str], *, base: str = "base_value", value: str = "score") -> DataFrame:
    """Difference of means over the pooled sample spread; 0 when there is none."""
    b, m = F.col(base), F.col(value)
    nb, nm = F.count(b), F.count(m)
    pooled = F.sqrt(
        F.try_divide((nb - 1) * F.var_samp(b) + (nm - 1) * F.var_samp(m), F.nullif(nb + nm - 2, F.lit(0)))
    )
    return paired.groupBy(*by).agg(
        F.count(m).alias("n"),
        F.coalesce(F.try_divide(F.avg(b) - F.avg(m), F.nullif(pooled, F.lit(0.0))), F.lit(0.0)).alias("cohens_d"),
    )


#: Fewest rows of a group for a p-value in ``significance_table``.
MIN_ROWS = 10
_TEST_NAMES = {"wilcoxon": "wilcoxon", "t_test": "t_test", "mann_whitney": "mann_whitney", "mannwhitney": "mann_whitney"}


def significance_table(
    paired: DataFrame, by: list[str], *, tests: tuple[str, ...] = ("wilcoxon",), confidence: float = 0.95,
    correction: str | None = None,
) -> DataFrame:
    """One row per group and test: statistic, one-sided p-value, significance, effect size, means, spreads, n.

    With a ``correction`` the p-values of each test are adjusted over its groups, and the adjusted one decides.

    ``paired`` has ``base_value`` and ``score``; positive differences mean improvement. Known tests are ``wilcoxon``,
    ``t_test`` and ``mann_whitney``; another name means the signed-rank test, and the row says so. Groups of fewer than
    ``MIN_ROWS`` rows have no p-value.
    """
    tests = tuple(dict.fromkeys(_TEST_NAMES.get(t, "wilcoxon") for t in tests))
    deltas = paired.withColumn("delta", F.col("base_value") - F.col("score"))
    facts = join_on(
        paired.groupBy(*by).agg(
            F.avg("base_value").alias("base_mean"),
            F.avg("score").alias("model_mean"),
            F.stddev_pop("base_value").alias("base_std"),
            F.stddev_pop("score").alias("model_std"),
        ),
        cohens_d(paired, by),
        by,
    )

    def run(test: str) -> DataFrame:
        if test == "t_test":
            found = t_test(deltas, by, alternative="greater").withColumnRenamed("t", "statistic")
        elif test == "mann_whitney":
            sides = paired.select(
                *by,
                F.inline(
                    F.array(
                        F.struct(F.lit(1).alias("_base"), F.col("base_value").alias("_v")),
                        F.struct(F.lit(0).alias("_base"), F.col("score").alias("_v")),
                    )
                ),
            )
            found = mann_whitney_test(sides, by, "_v", F.col("_base") == 1).withColumnRenamed("u", "statistic")
        else:
            found = wilcoxon_test(deltas, by, alternative="greater")
        return found.select(*by, F.lit(test).alias("test"), F.col("statistic").cast("double"), "p_value")

    results = reduce(lambda a, b: a.unionByName(b), [run(t) for t in tests])
    enough = facts.where(F.col("n") >= MIN_ROWS).select(*by, F.lit(True).alias("_enough"))
    results = join_on(results, enough, by, "left").withColumn("p_value", F.when(F.col("_enough"), F.col("p_value"))).drop("_enough")
    p = "p_value"
    if correction:
        results, p = adjust_p_values(results, ["test"], key=by, method=correction), "p_adjusted"
    return join_on(results, facts, by).withColumn("significant", F.col(p) < 1 - confidence)


def adjust_p_values(
    tests: DataFrame, family: list[str], p: str = "p_value", *, key: list[str], method: str = "holm"
) -> DataFrame:
    """Correct the p-values of a family of tests (bonferroni, holm, or fdr); there is one row per test.

    A NULL p-value is no member of the family and stays NULL.
    """
    whole = Window.partitionBy(*family)
    upward = whole.orderBy(F.col(p).asc_nulls_last(), *key)
    known = F.col(p).isNotNull()
    m = F.count(p).over(whole)
    place = F.row_number().over(upward)
    if method == "bonferroni":
        return tests.withColumn("p_adjusted", F.when(known, F.least(F.lit(1.0), F.col(p) * m)))
    if method == "holm":
        stepped = tests.withColumn("_step", F.when(known, F.least(F.lit(1.0), F.col(p) * (m - place + 1))))
        running = upward.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return stepped.withColumn("p_adjusted", F.when(known, F.max("_step").over(running))).drop("_step")
    stepped = tests.withColumn("_step", F.when(known, F.least(F.lit(1.0), F.col(p) * m / place)))
    running = upward.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return stepped.withColumn("p_adjusted", F.when(known, F.min("_step").over(running))).drop("_step")
