"""Best and worst changes, ranks and trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelens.operators.ranks import ordered_index


def top_changes(
    deltas: DataFrame,
    by: list[str],
    value: str = "delta",
    n: int = 10,
    *,
    key: str = "prompt_id",
    largest: bool = True,
    min_abs: float | None = 0.05,
) -> DataFrame:
    """The ``n`` largest (or smallest) changes of each group beyond ``min_abs``; ties go to the lower key.

    Spark limits each group inside the map tasks before the shuffle, so a huge group sends only ``n`` rows per task.
    """
    v = F.col(value)
    if min_abs is not None:
        deltas = deltas.where(v > min_abs if largest else v < -min_abs)
    order = [v.desc_nulls_last() if largest else v.asc_nulls_last(), F.col(key)]
    if not by:
        return deltas.orderBy(*order).limit(n)
    window = Window.partitionBy(*by).orderBy(*order)
    return deltas.withColumn("place", F.row_number().over(window)).where(F.col("place") <= n)


def extremes(rows: DataFrame, by: list[str], value: str, n: int = 20, *, key: str = "sample_id") -> DataFrame:
    """Top and bottom ``n`` rows of each group with ``side`` and ``place``."""
    top = top_changes(rows, by, value, n, key=key, min_abs=None).withColumn("side", F.lit("top"))
    bottom = top_changes(rows, by, value, n, key=key, largest=False, min_abs=None).withColumn("side", F.lit("bottom"))
    return top.unionByName(bottom)


def improvement_rank(rows: DataFrame, by: list[str], value: str, *, key: str = "sample_id") -> DataFrame:
    """1-based position of every row in its group, greatest first, for groups of any size."""
    return ordered_index(rows, by, [F.col(value).desc(), F.col(key)], "improvement_rank")


def trajectories(points: DataFrame, by: list[str], value: str = "score", *, threshold: float = 0.05) -> DataFrame:
    """Per-prompt scores over epochs, their average, and the class of the final change (first minus last).

    Repeated scores of a prompt and epoch are averaged first, so a trajectory has one entry per epoch.
    """
    points = points.groupBy(*by, "epoch").agg(F.avg(value).alias(value))
    first, last = F.min_by(value, "epoch"), F.max_by(value, "epoch")
    change = F.col("first_score") - F.col("last_score")
    return (
        points.groupBy(*by)
        .agg(
            F.sort_array(F.collect_list(F.struct("epoch", value))).alias("trajectory"),
            first.alias("first_score"),
            last.alias("last_score"),
            F.avg(value).alias("mean_score"),
        )
        .withColumn("change", change)
        .withColumn(
            "outcome",
            F.when(change > threshold, "improved").when(change < -threshold, "regressed").otherwise("flat"),
        )
    )


def first_last_change(points: DataFrame, by: list[str], value: str = "score") -> DataFrame:
    """First and last epoch score of each prompt, their difference and percent of the first."""
    first, last = F.min_by(value, "epoch"), F.max_by(value, "epoch")
    return points.groupBy(*by).agg(
        first.alias("first_score"),
        last.alias("last_score"),
        (first - last).alias("change"),
        F.when(first > 0, 100.0 * F.try_divide(first - last, first)).otherwise(0.0).alias("change_percent"),
    )
