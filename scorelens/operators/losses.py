"""Loss metrics and reward normalization over tables of pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelens.functions.losses import METHODS, mean_loss
from scorelens.operators.metrics import evaluation_row
from scorelens.storage import attach_stats, join_on


def pair_sides(rewards: DataFrame, keys: list[str], *, side: str = "side", reward: str = "reward") -> DataFrame:
    """Long rewards as one row per pair with ``original`` and ``detoxified``, the means of repeats."""
    wide = rewards.groupBy(*keys).agg(
        F.avg(F.when(F.col(side) == "original", F.col(reward))).alias("original"),
        F.avg(F.when(F.col(side) == "detoxified", F.col(reward))).alias("detoxified"),
    )
    return wide.where(F.col("original").isNotNull() & F.col("detoxified").isNotNull())


def pairwise_loss(pairs: DataFrame, by: list[str], methods: list[str] = list(METHODS), **params) -> DataFrame:
    """Mean loss of each method per group, in one pass."""
    o, d = F.col("original"), F.col("detoxified")
    return pairs.groupBy(*by).agg(*[mean_loss(m, o, d, **params).alias(m) for m in methods])


def zscore(df: DataFrame, by: list[str], value: str = "reward", name: str = "normalized") -> DataFrame:
    """Standardize within each batch; only centre when there is no spread, keep a single row as it is.

    Batches are small, so one shuffle by batch and a window do; without ``by`` the whole table is one batch, whose
    statistics are joined instead.
    """
    stats = {"_mean": F.avg(value), "_std": F.stddev_samp(value), "_n": F.count(value)}
    if by:
        rows = df.withColumns({name_: f.over(Window.partitionBy(*by)) for name_, f in stats.items()})
    else:
        rows = attach_stats(df, by, *[f.alias(name_) for name_, f in stats.items()])
    centred = F.col(value) - F.col("_mean")
    scaled = (
        F.when(F.col("_n") <= 1, F.col(value))
        .when(F.col("_std") > 1e-8, centred / F.col("_std"))
        .otherwise(centred)
    )
    return rows.withColumn(name, scaled).drop("_mean", "_std", "_n")


def metric_history(rewards: DataFrame, by: list[str], *, pair_keys: list[str], method: str = "max_margin") -> DataFrame:
    """Evaluation metrics and loss per group and epoch."""
    group = [*by, "epoch"]
    loss = pairwise_loss(pair_sides(rewards, [*group, *pair_keys]), group, [method]).withColumnRenamed(method, "loss")
    return reduce(lambda a, b: join_on(a, b, group), [evaluation_row(rewards, group), loss])
