"""Scorer evaluation: accuracy, F1, ROC-AUC, PR-AUC, rank correlations and similarity matrices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelens.functions.numeric import count_if, rate, safe_corr
from scorelens.operators import matrices
from scorelens.operators.ranks import join_hot_values, ordered_crossings, ordered_index, value_ranks
from scorelens.storage import attach_stats, join_on, materialize


def toxic_label(side: str = "side", *, positive: str = "original") -> Column:
    """1 for the positive class, by default the original (toxic) side."""
    return (F.col(side) == positive).cast("int")


def mean_threshold_predictions(
    rewards: DataFrame, by: list[str], reward: str = "reward", *, positive: str = "original"
) -> DataFrame:
    """Predict the positive class by comparing each reward with the mean of its group.

    The original side is predicted at or below the mean, the detoxified side above it.
    """
    rows = attach_stats(rewards, by, F.avg(reward).alias("mean_reward"))
    low = F.col(reward) <= F.col("mean_reward")
    return rows.withColumn("prediction", (low if positive == "original" else ~low).cast("int"))


def confusion_metrics(
    predictions: DataFrame, by: list[str], *, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Confusion counts, accuracy and F1; F1 is 0 without positives on either side."""
    y, p = F.col(label), F.col(prediction)
    tp, fp = count_if((y == 1) & (p == 1)), count_if((y == 0) & (p == 1))
    tn, fn = count_if((y == 0) & (p == 0)), count_if((y == 1) & (p == 0))
    return predictions.groupBy(*by).agg(
        tp.alias("tp"),
        fp.alias("fp"),
        tn.alias("tn"),
        fn.alias("fn"),
        F.try_divide(tp + tn, tp + fp + tn + fn).alias("accuracy"),
        F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"),
    )


def ranking_metrics(
    df: DataFrame, by: list[str], score: str, label: str = "label", *, low_is_positive: bool = True
) -> DataFrame:
    """ROC-AUC (ties count half) and trapezoid PR-AUC of a score from one ordered table of distinct values.

    With ``low_is_positive`` the ranking score is the negated reward. Both areas are sums over distinct values,
    so only their running counts are needed. Rows without a label or a score (NULL or NaN) take no part.
    """
    df = df.where(F.col(label).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score))
    s = F.col(score) if low_is_positive else -F.col(score)
    ranked = value_ranks(
        df.select(*by, s.alias("_s"), F.col(label).alias("_y")), by, "_s", {"pos": F.col("_y")}
    )
    pos, n = F.col("pos"), F.col("n")
    precision = F.col("pos_through") / F.col("n_through")
    before = F.coalesce(
        F.try_divide(F.col("pos_through") - pos, F.nullif(F.col("n_through") - n, F.lit(0))), F.lit(1.0)
    )
    sums = ranked.groupBy(*by).agg(
        F.sum("pos").alias("positives"),
        F.sum(n - pos).alias("negatives"),
        F.sum(pos * F.col("avg_rank")).alias("_rank_sum"),
        F.sum(pos * (precision + before) / 2).alias("_area"),
    )
    p = F.col("positives").cast("double")
    u = F.col("_rank_sum") - p * (p + 1) / 2
    area = F.try_divide(u, F.nullif(p * F.col("negatives"), F.lit(0.0)))
    return sums.select(
        *by,
        "positives",
        "negatives",
        (1 - area).alias("roc_auc"),
        F.try_divide("_area", F.nullif(p, F.lit(0.0))).alias("pr_auc"),
    )


def classification_report(
    rewards: DataFrame, by: list[str], reward: str = "reward", *, side: str = "side", positive: str = "original"
) -> DataFrame:
    """Accuracy, F1, ROC-AUC and PR-AUC per group for rewards with a side."""
    labelled = rewards.withColumn("label", toxic_label(side, positive=positive))
    hard = confusion_metrics(mean_threshold_predictions(labelled, by, reward, positive=positive), by)
    soft = ranking_metrics(labelled, by, reward, low_is_positive=positive == "original")
    return join_on(hard, soft, by)


def pearson(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*by).agg(safe_corr(x, y).alias("pearson"))


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Pearson correlation of average ranks; both columns are ranked from one stored table."""
    ranked = both = materialize(
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("_x"), F.col(y).alias("_y")), "points"
    )
    for value, name in (("_x", "_rx"), ("_y", "_ry")):
        places = value_ranks(both, by, value).select(*by, value, "n", F.col("avg_rank").alias(name))
        ranked = join_hot_values(ranked, materialize(places, "ranks"), [*by, value], name)
    return ranked.groupBy(*by).agg(safe_corr("_rx", "_ry").alias("spearman"))


def kendall(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Kendall tau-b without building pairs.

    Points are pre-aggregated with their counts. A point is discordant with the earlier points (by x, then y) of greater
    y, which ``ordered_crossings`` counts by the digits of the dense rank of y.
    """
    points = materialize(
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(*by, F.col(x).alias("_x"), F.col(y).alias("_y"))
        .agg(F.count("*").alias("_w")),
        "points",
    )

    def ties(columns: list[str], name: str) -> DataFrame:
        t = F.sum("_w").cast("double")
        sizes = points.groupBy(*by, *columns).agg((t * (t - 1) / 2).alias("_t"))
        return sizes.groupBy(*by).agg(F.sum("_t").alias(name))

    y_ranks = ordered_index(points.groupBy(*by, "_y").agg(F.count("*").alias("n")), by, ["_y"], "_r")
    y_ranks = materialize(y_ranks, "y_ranks")
    top = y_ranks.agg(F.max("_r")).first()[0] or 1
    ranked = join_hot_values(points, y_ranks, [*by, "_y"], "_r")
    discordant = ordered_crossings(ranked, by, ["_x", "_r"], "_r", "_w", int(top)).withColumnRenamed("crossings", "discordant")
    size = F.sum("_w").cast("double")
    parts = points.groupBy(*by).agg(F.sum("_w").alias("n"), (size * (size - 1) / 2).alias("pairs"))
    for part in (ties(["_x"], "ties_x"), ties(["_y"], "ties_y"), ties(["_x", "_y"], "ties_xy")):
        parts = join_on(parts, part, by)
    parts = join_on(parts, discordant, by, "left").fillna(0.0, subset=["discordant"])
    concordant = (
        F.col("pairs") - F.col("ties_x") - F.col("ties_y") + F.col("ties_xy") - F.col("discordant")
    )
    scale = F.sqrt((F.col("pairs") - F.col("ties_x")) * (F.col("pairs") - F.col("ties_y")))
    return parts.select(
        *by,
        "n",
        F.try_divide(concordant - F.col("discordant"), F.nullif(scale, F.lit(0.0))).alias("kendall"),
    )


def correlations(
    df: DataFrame, by: list[str], x: str, y: str, methods: tuple[str, ...] = ("pearson", "spearman", "kendall")
) -> DataFrame:
    """The chosen correlation coefficients of two columns per group."""
    known = {"pearson": pearson, "spearman": spearman, "kendall": kendall}
    tables = [known[m](df, by, x, y).select(*by, m) for m in methods]
    return reduce(lambda a, b: join_on(a, b, by), tables)


def agreement(
    rewards: DataFrame, by: list[str], learned: str = "reward", truth: str = "true_reward"
) -> DataFrame:
    """Accuracy and F1 of the learned predictions against those of the true reward, both mean-thresholded."""
    rows = attach_stats(rewards, by, F.avg(learned).alias("_ml"), F.avg(truth).alias("_mt"))
    marked = rows.withColumn("label", (F.col(truth) <= F.col("_mt")).cast("int")).withColumn(
        "prediction", (F.col(learned) <= F.col("_ml")).cast("int")
    )
    return confusion_metrics(marked, by).select(
        *by, F.col("accuracy").alias("agreement_accuracy"), F.col("f1").alias("agreement_f1")
    )


def reward_means(rewards: DataFrame, by: list[str], reward: str = "reward", side: str = "side") -> DataFrame:
    """Mean and spread of both sides and the difference of the means."""
    o = F.when(F.col(side) == "original", F.col(reward))
    d = F.when(F.col(side) == "detoxified", F.col(reward))
    return rewards.groupBy(*by).agg(
        F.avg(o).alias("avg_original"),
        F.avg(d).alias("avg_detoxified"),
        F.stddev_pop(o).alias("std_original"),
        F.stddev_pop(d).alias("std_detoxified"),
        (F.avg(d) - F.avg(o)).alias("reward_difference"),
    )


def evaluation_row(
    rewards: DataFrame, by: list[str], *, truth: str | None = None, positive: str = "original"
) -> DataFrame:
    """One row of all metrics per group, e.g. per (model, split) or (model, split, epoch).

    With ``truth`` the correlations and the agreement are against that column. The rewards are written once, since every
    metric reads them.
    """
    used = dict.fromkeys([*by, "side", "reward", *([truth] if truth else [])])
    rewards = materialize(rewards.select(*used), "rewards")
    tables = [classification_report(rewards, by, positive=positive), reward_means(rewards, by)]
    if truth:
        tables += [correlations(rewards, by, "reward", truth), agreement(rewards, by, truth=truth)]
    return reduce(lambda a, b: join_on(a, b, by), tables)


def flat_metrics(rows: DataFrame, key: list[str], splits: list[str], metrics: list[str]) -> DataFrame:
    """One column per ``{split}_{metric}``."""
    columns = [
        F.max(F.when(F.col("split") == s, F.col(m))).alias(f"{s}_{m}") for s in splits for m in metrics
    ]
    return rows.groupBy(*key).agg(*columns)


def correlation_matrix(wide: DataFrame, names: list[str]) -> DataFrame:
    """Pearson correlation of every two columns over the rows where both are present."""
    return matrices.pairwise(wide, names, matrices.pearson(), "correlation", centred=True)


def cosine_matrix(weights: DataFrame, names: list[str], *, dim: str = "dim", name: str = "name",
                  value: str = "value") -> DataFrame:
    """Cosine similarity of the named vectors given as (name, dim, value) rows; at least two are required."""
    if len(names) < 2:
        raise ValueError("cosine_matrix needs at least two vectors")
    wide = weights.groupBy(dim).pivot(name, names).agg(F.sum(value)).fillna(0.0)
    return matrices.pairwise(wide, [str(n) for n in names], matrices.cosine(), "cosine")


def centroid_weights(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """Mean vector per label as (name, dim, value) rows."""
    entries = vectors.select(F.col(label).cast("string").alias("name"), F.posexplode(vector).alias("dim", "value"))
    return entries.groupBy("name", "dim").agg(F.avg(F.col("value").cast("double")).alias("value"))
