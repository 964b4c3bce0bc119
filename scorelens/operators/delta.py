"""Baseline deltas and improvement statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelens.functions.numeric import biased_skewness, count_if, rate
from scorelens.operators.quantiles import profile
from scorelens.storage import join_on, materialize

SAMPLE_KEYS = ["prompt_id", "text_type", "classifier", "label"]


def with_baseline(
    scores: DataFrame,
    *,
    keys: list[str] = SAMPLE_KEYS,
    model_col: str = "model",
    baseline: str = "base",
    value: str = "score",
) -> DataFrame:
    """Every non-baseline row with the baseline value of the same sample.

    One equi-join on the sample keys serves all models; NULL keys match each other. The baseline side is written first
    with one row per sample, the mean of repeats, so repeated samples cannot multiply and the join's sides are plain
    tables, of which AQE can split a hot key. It grows with the samples and its file is far smaller than its rows, so it
    asks for a merge join and is never broadcast. Rows without a baseline value are dropped; ``unmatched`` counts them.
    """
    is_base = F.col(model_col) == baseline
    base = scores.where(is_base & F.col(value).isNotNull()).groupBy(*keys).agg(F.avg(value).alias("base_value"))
    return join_on(scores.where(~is_base & F.col(value).isNotNull()), materialize(base, "baseline").hint("merge"), keys)


def unmatched(
    scores: DataFrame, *, keys: list[str] = SAMPLE_KEYS, model_col: str = "model", baseline: str = "base", value: str = "score"
) -> DataFrame:
    """(model, rows, unmatched): rows of each model other than the baseline, and those without a baseline value."""
    is_base = F.col(model_col) == baseline
    known = scores.where(is_base & F.col(value).isNotNull()).select(*keys).distinct().withColumn("_known", F.lit(1))
    rows = scores.where(~is_base & F.col(value).isNotNull()).groupBy(model_col, *keys).agg(F.count("*").alias("_n"))
    joined = join_on(rows, known.hint("merge"), keys, "left")
    return joined.groupBy(model_col).agg(
        F.sum("_n").alias("rows"), F.sum(F.when(F.col("_known").isNull(), F.col("_n")).otherwise(0)).alias("unmatched")
    )


def baseline_delta(
    scores: DataFrame,
    *,
    keys: list[str] = SAMPLE_KEYS,
    model_col: str = "model",
    baseline: str = "base",
    value: str = "score",
    direction: str = "baseline_minus",
    text_types: tuple[str, ...] = ("output", "full_text"),
) -> DataFrame:
    """Per-sample ``delta`` against the baseline within one text type.

    ``baseline_minus`` suits toxicity scores and ``minus_baseline`` suits rewards; positive is better in both.
    """
    if text_types and "text_type" in scores.columns:
        scores = scores.where(F.col("text_type").isin(*text_types))
    paired = with_baseline(scores, keys=keys, model_col=model_col, baseline=baseline, value=value)
    sign = {"baseline_minus": F.col("base_value") - F.col(value), "minus_baseline": F.col(value) - F.col("base_value")}
    return paired.withColumn("delta", sign[direction])


def delta_name(model: Column, series: Column, baseline: str = "base") -> Column:
    return F.concat(F.lit("delta_"), model, F.lit(f"_vs_{baseline}_"), series)


def improvement_stats(
    deltas: DataFrame, by: list[str], value: str = "delta", *, threshold: float = 0.05, approx: bool = False
) -> DataFrame:
    """Spread, counts and rates of improvement, quartiles, skewness and standardized mean of deltas."""
    d = F.col(value)
    mean, std = F.avg(d), F.stddev_pop(d)
    aggregates = [
        F.count(d).alias("n"),
        mean.alias("mean"),
        std.alias("std"),
        F.min(d).alias("min"),
        F.max(d).alias("max"),
        count_if(d > threshold).alias("improved"),
        count_if(d < -threshold).alias("regressed"),
        count_if(F.abs(d) <= threshold).alias("neutral"),
        rate(d > threshold, d).alias("improved_rate"),
        rate(d < -threshold, d).alias("regressed_rate"),
        rate(F.abs(d) <= threshold, d).alias("neutral_rate"),
        biased_skewness(d, min_rows=3).alias("skewness"),
        F.when(std > 0, F.try_divide(mean, F.nullif(std, F.lit(0.0)))).otherwise(0.0).alias("effect_size"),
    ]
    wanted = {"median": 0.5, "p25": 0.25, "p75": 0.75}
    if approx:
        sketch = [F.percentile_approx(value, p).alias(name) for name, p in wanted.items()]
        return deltas.groupBy(*by).agg(*aggregates, *sketch)
    return profile(deltas, by, value, aggregates, wanted)


def comparison(paired: DataFrame, by: list[str], *, base: str = "base_value", value: str = "score") -> DataFrame:
    """Difference of means and of spreads, with strict improvement counts, from rows with their baseline."""
    b, m = F.col(base), F.col(value)
    return paired.groupBy(*by).agg(
        F.avg(b).alias("base_mean"),
        F.avg(m).alias("model_mean"),
        (F.avg(b) - F.avg(m)).alias("mean_improvement"),
        (F.stddev_pop(b) - F.stddev_pop(m)).alias("std_difference"),
        count_if(m < b).alias("improved"),
        count_if(m > b).alias("regressed"),
        rate(m < b).alias("improved_rate"),
        rate(m > b).alias("regressed_rate"),
    )


def summary(deltas: DataFrame, *, value: str = "delta", threshold: float = 0.05) -> DataFrame:
    """One row: models, comparisons, best and worst model by mean delta, overall rate and mean."""
    d = F.col(value)
    series = deltas.groupBy("model", "classifier", "label", "text_type").agg(
        F.sum(d).alias("total"), F.count(d).alias("n"), count_if(d > threshold).alias("better")
    )
    models = series.groupBy("model").agg(
        F.sum("total").alias("total"),
        F.sum("n").alias("n"),
        F.sum("better").alias("better"),
        F.count("*").alias("comparisons"),
    )
    mean = F.col("total") / F.col("n")
    return models.agg(
        F.count("*").alias("models"),
        F.sum("comparisons").alias("comparisons"),
        F.min(F.struct((-mean).alias("m"), F.col("model").alias("name")))["name"].alias("best_model"),
        F.min(F.struct(mean.alias("m"), F.col("model").alias("name")))["name"].alias("worst_model"),
        (F.sum("better") / F.sum("n")).alias("improvement_rate"),
        (F.sum("total") / F.sum("n")).alias("mean_improvement"),
    )


def category_analysis(paired: DataFrame, by: list[str], *, threshold: float = 0.05) -> DataFrame:
    """Means, sample spreads, improvement and counts per label."""
    b, m = F.col("base_value"), F.col("score")
    d = b - m
    return paired.groupBy(*by).agg(
        F.avg(b).alias("base_mean"),
        F.avg(m).alias("model_mean"),
        F.stddev_samp(b).alias("base_std"),
        F.stddev_samp(m).alias("model_std"),
        F.avg(d).alias("improvement"),
        count_if(d > threshold).alias("improved"),
        count_if(d < -threshold).alias("worse"),
    )


def high_score_comparison(paired: DataFrame, by: list[str], *, high: float = 0.7) -> DataFrame:
    """Means and counts of high scores on both sides, with their reduction."""
    b, m = F.col("base_value"), F.col("score")
    return paired.groupBy(*by).agg(
        F.avg(b).alias("base_mean"),
        F.avg(m).alias("model_mean"),
        (F.avg(b) - F.avg(m)).alias("improvement"),
        count_if(b > high).alias("base_high"),
        count_if(m > high).alias("model_high"),
        (count_if(b > high) - count_if(m > high)).alias("high_reduction"),
    )


def change_counts(deltas: DataFrame, by: list[str], value: str = "delta", *, threshold: float = 0.05) -> DataFrame:
    """Improved and regressed rows with their share of all rows, and the mean."""
    d = F.col(value)
    improved, regressed = count_if(d > threshold), count_if(d < -threshold)
    return deltas.groupBy(*by).agg(
        F.count("*").alias("n"),
        improved.alias("improved"),
        regressed.alias("regressed"),
        (100.0 * improved / F.count("*")).alias("improved_percent"),
        (100.0 * regressed / F.count("*")).alias("regressed_percent"),
        F.avg(d).alias("mean"),
    )


def grouped_improvement(
    deltas: DataFrame, families: dict[str, list[str]], value: str = "delta", *, threshold: float = 0.01
) -> DataFrame:
    """Pooled mean, spread and positive rate for several groupings in one pass.

    ``families`` maps a family name to its grouping columns; the result has ``family``, ``name`` (the group's
    values) and the statistics.
    """
    columns = sorted({c for cs in families.values() for c in cs})
    d = F.col(value)
    grouped = deltas.groupingSets([[F.col(c) for c in cs] for cs in families.values()], *columns).agg(
        F.count(d).alias("n"),
        F.avg(d).alias("mean"),
        F.stddev_samp(d).alias("std"),
        F.stddev_pop(d).alias("std_pop"),
        count_if(d > threshold).alias("improved"),
        count_if(d < -threshold).alias("regressed"),
        rate(d > threshold, d).alias("improved_rate"),
        F.grouping_id().alias("_set"),
    )
    # grouping_id sets a bit for each column that is aggregated away, first column highest
    cases = F.lit(None).cast("string")
    for family, cs in families.items():
        bits = sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in cs)
        cases = F.when(F.col("_set") == bits, F.lit(family)).otherwise(cases)
    name = F.coalesce(F.nullif(F.concat_ws("/", *columns), F.lit("")), F.lit("all"))
    return grouped.select(cases.alias("family"), name.alias("name"), *[
        c for c in grouped.columns if c not in (*columns, "_set")
    ])


def best_of(grouped: DataFrame, family: str) -> DataFrame:
    """Best and most consistent member of one family; ties go to the first name."""
    return grouped.where(F.col("family") == family).groupBy("family").agg(
        F.min(F.struct((-F.col("mean")).alias("m"), F.col("name").alias("name")))["name"].alias("best"),
        F.min(F.struct(F.col("std").alias("m"), F.col("name").alias("name")))["name"].alias("most_consistent"),
    )


def confidence_interval(deltas: DataFrame, by: list[str], value: str = "delta", *, z: float = 1.96) -> DataFrame:
    """Normal 95 % interval of the mean."""
    d = F.col(value)
    half = F.lit(z) * F.stddev_samp(d) / F.sqrt(F.count(d))
    return deltas.groupBy(*by).agg(
        F.count(d).alias("n"),
        F.avg(d).alias("mean"),
        (F.avg(d) - half).alias("ci_low"),
        (F.avg(d) + half).alias("ci_high"),
    )


def progression(deltas: DataFrame, by: list[str], value: str = "delta", *, threshold: float = 0.01) -> DataFrame:
    """Mean, sample spread and positive count per epoch; ``deltas`` has an ``epoch`` column."""
    d = F.col(value)
    return deltas.where(F.col("epoch").isNotNull()).groupBy(*by, "epoch").agg(
        F.avg(d).alias("mean"),
        F.stddev_samp(d).alias("std"),
        count_if(d > threshold).alias("positive"),
        F.count(d).alias("n"),
    )


def total_reduction(points: DataFrame, by: list[str], mean: str = "mean") -> DataFrame:
    """First minus last epoch mean, and percent of the first; 0 percent unless the first is positive."""
    first, last = F.min_by(mean, "epoch"), F.max_by(mean, "epoch")
    return points.groupBy(*by).agg(
        first.alias("first_mean"),
        last.alias("last_mean"),
        (first - last).alias("reduction"),
        F.when(first > 0, 100.0 * F.try_divide(first - last, first)).otherwise(0.0).alias("reduction_percent"),
    )


def overall_ranking(deltas: DataFrame, value: str = "delta") -> DataFrame:
    """Mean over classifiers of each model's mean delta, best first."""
    per_classifier = deltas.groupBy("model", "classifier").agg(F.avg(value).alias("mean"))
    return (
        per_classifier.groupBy("model")
        .agg(F.avg("mean").alias("overall"), F.count("*").alias("classifiers"))
        .orderBy(F.desc("overall"), "model")
    )


def pair_difference(pairs: DataFrame, by: list[str], *, original: str = "original", detoxified: str = "detoxified",
                    ) -> DataFrame:
    """Statistics of detoxified minus original rewards."""
    d = F.col(detoxified) - F.col(original)
    rows = pairs.withColumn("_d", d)
    mean, std = F.avg("_d"), F.stddev_pop("_d")
    return profile(
        rows,
        by,
        "_d",
        [
            mean.alias("mean_difference"),
            std.alias("std_difference"),
            (100.0 * rate(F.col("_d") > 0)).alias("percent_improved"),
            F.when(std > 0, F.try_divide(mean, F.nullif(std, F.lit(0.0)))).otherwise(0.0).alias("effect_size"),
        ],
        {"median_difference": 0.5},
    )


def side_comparison(pairs: DataFrame, by: list[str], *, original: str = "original", modified: str = "detoxified",
                    ) -> DataFrame:
    """Means and spreads of both sides, their difference, and how often the modified side wins."""
    o, m = F.col(original), F.col(modified)
    return pairs.groupBy(*by).agg(
        F.avg(o).alias("original_mean"),
        F.avg(m).alias("modified_mean"),
        F.stddev_pop(o).alias("original_std"),
        F.stddev_pop(m).alias("modified_std"),
        (F.avg(m) - F.avg(o)).alias("mean_difference"),
        rate(m > o).alias("win_rate"),
    )


def with_pair_improvements(variants: DataFrame) -> DataFrame:
    """Add improvements and prompt contributions to rows with one score column per text variant."""
    return variants.withColumns(
        {
            "output_improvement": F.col("detoxified_output") - F.col("original_output"),
            "prompt_output_improvement": F.col("prompt_detoxified") - F.col("prompt_original"),
            "prompt_contribution_original": F.col("prompt_original") - F.col("original_output"),
            "prompt_contribution_detoxified": F.col("prompt_detoxified") - F.col("detoxified_output"),
        }
    )
