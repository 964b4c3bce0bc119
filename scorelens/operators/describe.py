"""Descriptive statistics of scores, label maps, text lengths and reward streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelens.functions.labels import primary_score
from scorelens.functions.numeric import biased_skewness, count_if, is_bad, rate, sanitize
from scorelens.operators.quantiles import profile
from scorelens.storage import join_on

RATE_THRESHOLDS = {"high": 0.7, "medium": 0.4, "low": 0.1}
QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
DISTRIBUTION = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


def std(value: Column, ddof: int) -> Column:
    return F.stddev_pop(value) if ddof == 0 else F.stddev_samp(value)


def basic_aggregates(value: str, *, ddof: int = 0) -> list[Column]:
    v = F.col(value)
    return [
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        std(v, ddof).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    ]


def shape_aggregates(value: str) -> list[Column]:
    """Biased skewness and excess kurtosis; NULL for constant values."""
    return [F.skewness(value).alias("skewness"), F.kurtosis(value).alias("kurtosis")]


def threshold_aggregates(value: str, thresholds: dict[str, float] = RATE_THRESHOLDS) -> list[Column]:
    v = F.col(value)
    return [rate(v > t, v).alias(f"{name}_rate") for name, t in thresholds.items()] + [
        count_if(v > t).alias(f"{name}_count") for name, t in thresholds.items()
    ]


def describe(
    df: DataFrame,
    by: list[str],
    value: str = "score",
    *,
    ddof: int = 0,
    percentiles: dict[str, float] | None = None,
    shape: bool = False,
    thresholds: dict[str, float] | None = None,
    approx: bool = False,
) -> DataFrame:
    """Count, mean, spread, extremes and, on request, percentiles, shape and threshold rates per group.

    Percentiles are exact for groups of any size; ``approx`` takes them from one sketch instead.
    """
    aggregates = basic_aggregates(value, ddof=ddof)
    aggregates += shape_aggregates(value) if shape else []
    aggregates += threshold_aggregates(value, thresholds) if thresholds else []
    percentiles = percentiles or {}
    if approx:
        aggregates += [F.percentile_approx(value, p).alias(name) for name, p in percentiles.items()]
        return df.groupBy(*by).agg(*aggregates)
    return profile(df, by, value, aggregates, percentiles)


def summary_table(scores: DataFrame, by: list[str], value: str = "score", **options) -> DataFrame:
    """All statistics of one (model, classifier) row: basic, distribution and threshold rates."""
    return describe(
        scores,
        by,
        value,
        percentiles={"median": 0.5, **DISTRIBUTION},
        shape=True,
        thresholds=RATE_THRESHOLDS,
        **options,
    )


def with_missing_groups(stats: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Zero-filled statistics for the expected groups that have no rows."""
    numbers = [f.name for f in stats.schema.fields if f.name not in keys]
    return join_on(expected.select(*keys), stats, keys, "left").fillna(0, subset=numbers)


def pooled_metrics(scores: DataFrame, outer: str, inner: str, value: str = "score") -> DataFrame:
    """Statistics per ``outer``, pooled and broken down by ``inner`` (NULL in the pooled row)."""
    return scores.groupingSets([[F.col(outer)], [F.col(outer), F.col(inner)]], outer, inner).agg(
        *basic_aggregates(value), *threshold_aggregates(value)
    )


def label_map_summary(
    classified: DataFrame, by: list[str] = ["model", "classifier", "text_type"], labels: str = "labels"
) -> DataFrame:
    """Mean, spread and extremes per label; an empty map is left out and a missing label counts as 0.

    The zeros are added algebraically to the statistics of the present values, so no (row x label) product is
    built. Every map has one first entry, which counts its row: labels and counts come from one pass.
    """
    filled = classified.where(F.col(labels).isNotNull() & (F.size(labels) > 0))
    present = (
        filled.select(*by, F.posexplode(labels).alias("_place", "label", "score"))
        .groupBy(*by, "label")
        .agg(
            F.count("score").alias("k"),
            F.avg("score").alias("m"),
            F.var_pop("score").alias("v"),
            F.min("score").alias("lo"),
            F.max("score").alias("hi"),
            count_if(F.col("_place") == 0).alias("_rows"),
        )
    )
    # one row per label by now
    joined = present.withColumn("n", F.sum("_rows").over(Window.partitionBy(*by)))
    n, k, m, v = F.col("n"), F.col("k"), F.col("m"), F.col("v")
    squares = k * v + (k * (n - k) / n) * m * m
    return joined.select(
        *by,
        "label",
        "n",
        (k * m / n).alias("mean"),
        F.sqrt(squares / n).alias("std"),
        F.when(k < n, F.least("lo", F.lit(0.0))).otherwise(F.col("lo")).alias("min"),
        F.when(k < n, F.greatest("hi", F.lit(0.0))).otherwise(F.col("hi")).alias("max"),
    )


def compare_two_models(
    label_summary: DataFrame, model: str, *, baseline: str = "base", by: list[str] = ["classifier", "text_type", "label"]
) -> DataFrame:
    """Improvement and percent of a model over the baseline per label, from ``label_map_summary`` rows."""
    is_base, is_model = F.col("model") == baseline, F.col("model") == model
    base = F.max(F.when(is_base, F.col("mean")))
    other = F.max(F.when(is_model, F.col("mean")))
    return (
        label_summary.where(is_base | is_model)
        .groupBy(*by)
        .agg(base.alias("base_mean"), other.alias("model_mean"))
        .where(F.col("base_mean").isNotNull() & F.col("model_mean").isNotNull())
        .withColumn("improvement", F.col("base_mean") - F.col("model_mean"))
        .withColumn(
            "improvement_percent",
            F.when(F.col("base_mean") > 0, 100.0 * F.try_divide("improvement", "base_mean")).otherwise(0.0),
        )
    )


def delta_metrics(deltas: DataFrame, by: list[str], value: str = "delta", *, threshold: float = 0.01) -> DataFrame:
    """Mean, sample spread and counts of positive and negative deltas."""
    d = F.col(value)
    return deltas.groupBy(*by).agg(
        F.avg(d).alias("mean"),
        F.stddev_samp(d).alias("std"),
        count_if(d > threshold).alias("positive"),
        count_if(d < -threshold).alias("negative"),
        F.count(d).alias("total"),
        rate(d > threshold, d).alias("positive_rate"),
    )


def inventory(scores: DataFrame) -> DataFrame:
    """Numbers of prompts, models, classifiers, labels and score rows.

    Two plain aggregates instead of one with four distinct counts, which would multiply the rows before the shuffle.
    """
    prompts = scores.groupBy("prompt_id").agg(F.count("*").alias("k"))
    prompts = prompts.agg(F.count("prompt_id").alias("prompts"), F.coalesce(F.sum("k"), F.lit(0)).alias("rows"))
    series = scores.groupBy("model", "classifier", "label").agg(F.lit(1).alias("k")).agg(
        F.count_distinct("model").alias("models"),
        F.count_distinct("classifier").alias("classifiers"),
        F.count_distinct("classifier", "label").alias("series"),
    )
    one = F.lit(0).alias("_all")
    both = join_on(prompts.select("*", one), series.select("*", one), ["_all"])
    return both.select("prompts", "models", "classifiers", "series", "rows")


def dataset_analysis(records: DataFrame, by: list[str], text: str = "output") -> DataFrame:
    """Size, empty outputs and output length statistics of a generated dataset."""
    length = F.length(F.coalesce(F.col(text), F.lit("")))
    return records.groupBy(*by).agg(
        F.count("*").alias("total_samples"),
        count_if(length == 0).alias("empty_count"),
        (100.0 * rate(length == 0)).alias("empty_percent"),
        F.avg(length).alias("length_avg"),
        F.min(length).cast("bigint").alias("length_min"),
        F.max(length).cast("bigint").alias("length_max"),
        F.stddev_pop(length).alias("length_std"),
    )


def primary_metrics(classified: DataFrame, by: list[str] = ["model", "classifier", "text_type"]) -> DataFrame:
    """Basic statistics of the primary label's score per text type."""
    scored = classified.withColumn("_s", primary_score(F.col("classifier"), F.col("labels")))
    return scored.groupBy(*by).agg(*basic_aggregates("_s"))


def epoch_statistics(
    tracking: DataFrame, values: list[str] = ["raw_toxicity", "softmax_toxicity"], *, by: list[str] = ["epoch"]
) -> DataFrame:
    """Per numeric epoch statistics; labels such as 'initial' are left out."""
    numeric = tracking.withColumn("epoch", F.col("epoch").try_cast("int")).where(F.col("epoch").isNotNull())
    aggregates = []
    for v in values:
        aggregates += [
            F.avg(v).alias(f"{v}_mean"),
            F.stddev_samp(v).alias(f"{v}_std"),
            F.min(v).alias(f"{v}_min"),
            F.max(v).alias(f"{v}_max"),
        ]
    return numeric.groupBy(*by).agg(*aggregates)


def reward_batch_stats(rewards: DataFrame, by: list[str], value: str = "reward", *, fill: float = 0.0) -> DataFrame:
    """Mean and sample spread after replacing NaN and infinities, which are counted before."""
    raw = F.col(value)
    clean = sanitize(raw, fill)
    return rewards.groupBy(*by).agg(
        F.avg(clean).alias("mean"),
        F.stddev_samp(clean).alias("std"),
        count_if(is_bad(raw)).alias("bad_count"),
        F.count("*").alias("n"),
    )


def skewness_of(df: DataFrame, by: list[str], value: str = "delta") -> DataFrame:
    """Biased skewness; 0 for fewer than three rows or constant values."""
    return df.groupBy(*by).agg(biased_skewness(F.col(value), min_rows=3).alias("skewness"))


def text_type_drop(label_summary: DataFrame, *, first: str = "prompt", second: str = "output") -> DataFrame:
    """Mean prompt score minus mean output score per label, from ``label_map_summary`` rows."""
    a = F.max(F.when(F.col("text_type") == first, F.col("mean")))
    b = F.max(F.when(F.col("text_type") == second, F.col("mean")))
    return label_summary.groupBy("model", "classifier", "label").agg(
        a.alias("prompt_mean"), b.alias("output_mean"), (a - b).alias("drop")
    )
