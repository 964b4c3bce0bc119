"""Summaries and comparisons of many (experiment, split) results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorelens.functions.numeric import count_if, rate, relative_change
from scorelens.operators.quantiles import profile
from scorelens.storage import join_on


def experiment_grid(
    spark: SparkSession, sizes: list[str], thresholds: list[float], input_types: list[str]
) -> DataFrame:
    """Every (size, threshold, input type) with its key and the order of its size."""
    rows = [
        (f"{s}_{i}_{t}", s, n, float(t), i)
        for n, s in enumerate(sizes)
        for t in thresholds
        for i in input_types
    ]
    return spark.createDataFrame(
        rows, "experiment string, model_size string, size_order int, toxicity_threshold double, input_type string"
    )


def grid_coverage(grid: DataFrame, samples: DataFrame) -> DataFrame:
    """The grid with the number of samples present for each experiment, 0 for a missing one."""
    counts = samples.groupBy("experiment").agg(F.count("*").alias("samples"))
    return join_on(grid, counts, ["experiment"], "left").fillna(0, subset=["samples"])


def with_improvement(samples: DataFrame, *, original: str = "original", detoxified: str = "detoxified") -> DataFrame:
    o, d = F.col(original), F.col(detoxified)
    return samples.withColumn("improvement", d - o).withColumn("relative_improvement", relative_change(o, d))


def split_summary(samples: DataFrame, by: list[str] = ["experiment", "split"]) -> DataFrame:
    """Fifteen statistics of scores and improvements per group."""
    i = F.col("improvement")
    return profile(
        samples,
        by,
        "improvement",
        [
            F.avg("original").alias("mean_original_score"),
            F.avg("detoxified").alias("mean_detoxified_score"),
            F.avg(i).alias("mean_improvement"),
            F.avg("relative_improvement").alias("mean_relative_improvement"),
            F.stddev_pop("original").alias("std_original_score"),
            F.stddev_pop("detoxified").alias("std_detoxified_score"),
            F.stddev_pop(i).alias("std_improvement"),
            F.min(i).alias("min_improvement"),
            F.max(i).alias("max_improvement"),
            count_if(i > 0).alias("positive_improvements"),
            F.count(i).alias("total_samples"),
            rate(i > 0, i).alias("improvement_rate"),
        ],
        {"median_improvement": 0.5, "q25_improvement": 0.25, "q75_improvement": 0.75},
    )


def comparison_table(samples: DataFrame, experiments: DataFrame) -> DataFrame:
    """One row per experiment and split with the settings of the experiment."""
    return join_on(split_summary(samples), experiments, ["experiment"])


def comparable(table: DataFrame, within: list[str], across: str, expected: int = 2) -> DataFrame:
    """Rows of the groups in which all values of ``across`` exist; the table has one row per experiment and split."""
    group = Window.partitionBy(*within)
    return table.withColumn("_n", F.size(F.collect_set(across).over(group))).where(F.col("_n") == expected).drop("_n")


def consistent_improvers(
    samples: DataFrame,
    set_cols: list[str],
    *,
    key: str = "sample_id",
    model: str = "experiment",
    value: str = "improvement",
    min_rate: float = 0.75,
) -> DataFrame:
    """Samples that improve in enough of the models of a set, with their mean, spread and per-model values.

    Repeated values of a sample and model are averaged first, so a sample collects one value per model.
    """
    v = F.col(value)
    return (
        samples.groupBy(*set_cols, key, model)
        .agg(F.avg(v).alias(value))
        .groupBy(*set_cols, key)
        .agg(
            rate(v > 0, v).alias("improvement_rate"),
            F.avg(v).alias("mean_improvement"),
            F.stddev_pop(v).alias("std_improvement"),
            F.count(v).alias("models"),
            F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(model), v)))).alias("improvements"),
        )
        .where(F.col("improvement_rate") >= min_rate)
    )


def consistency_totals(
    samples: DataFrame, set_cols: list[str], *, key: str = "sample_id", model: str = "experiment", value: str = "improvement",
    min_rate: float = 0.75,
) -> DataFrame:
    """Per set and model: samples, samples that improve, and of the set all samples and consistent improvers."""
    v = F.col(value)
    per_model = samples.groupBy(*set_cols, key, model).agg(F.avg(v).alias(value))
    per_sample = per_model.groupBy(*set_cols, key).agg(rate(v > 0, v).alias("_rate"))
    totals = per_sample.groupBy(*set_cols).agg(
        F.count("*").alias("total_samples"), F.count(F.when(F.col("_rate") >= min_rate, 1)).alias("total_consistent_improvers")
    )
    models = per_model.groupBy(*set_cols, model).agg(F.count(v).alias("model_samples"), F.count(F.when(v > 0, 1)).alias("model_improvers"))
    if not set_cols:
        return models.crossJoin(F.broadcast(totals))  # one row
    return join_on(models, totals, set_cols)


def improvement_trend(summary: DataFrame, by: list[str], *, order: str = "size_order",
                      mean: str = "mean_improvement") -> DataFrame:
    """Compare the last with the first mean in configuration order."""
    first, last = F.min_by(mean, order), F.max_by(mean, order)
    trend = (
        F.when((F.count(mean) > 1) & (last > first), "increasing")
        .when((F.count(mean) > 1) & (last < first), "decreasing")
        .otherwise("stable")
    )
    return summary.groupBy(*by).agg(first.alias("first_mean"), last.alias("last_mean"), trend.alias("trend"))
