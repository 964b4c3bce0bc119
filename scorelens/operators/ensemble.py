"""Ensembles of reward models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelens.functions.text import shorten
from scorelens.operators.metrics import classification_report, ranking_metrics, toxic_label
from scorelens.storage import join_on, materialize

SAMPLE = ["sample_id", "side"]
METHODS = ["mean", "median", "max", "min"]


def members_of(rewards: DataFrame, keys: list[str] = SAMPLE, value: str = "reward") -> DataFrame:
    """(keys, members): one row a sample with its (model_id, reward) pairs in order; ensembles are expressions over them."""
    member = F.when(F.col(value).isNotNull(), F.struct("model_id", F.col(value).cast("double").alias("reward")))
    return rewards.groupBy(*keys).agg(F.sort_array(F.collect_list(member)).alias("members"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v)


def _simple(members: Column) -> list[Column]:
    """Mean, median, maximum and minimum of the members' rewards; NULL without any."""
    given = F.transform(members, lambda m: m["reward"])  # added up in the order of the models
    values = F.sort_array(given)
    n = F.size(members)
    middle = (F.get(values, F.floor((n - 1) / 2).cast("int")) + F.get(values, F.floor(n / 2).cast("int"))) / 2
    return [
        F.when(n > 0, c).alias(name)
        for name, c in zip(METHODS, [_sum(given) / n, middle, F.array_max(values), F.array_min(values)])
    ]


def _weighted(members: Column, weights: dict[str, float]) -> Column:
    """Mean of the rewards of the models that have a weight; NULL if there is none."""
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    known = F.filter(members, lambda m: m["model_id"].isin(*weights))
    weight = _sum(F.transform(known, lambda m: F.element_at(table, m["model_id"])))
    total = _sum(F.transform(known, lambda m: F.element_at(table, m["model_id"]) * m["reward"]))
    return F.try_divide(total, F.nullif(weight, F.lit(0.0)))


def combine(rewards: DataFrame, keys: list[str] = SAMPLE, value: str = "reward") -> DataFrame:
    """Mean, median, maximum and minimum over the models of each sample."""
    return members_of(rewards, keys, value).select(*keys, *_simple(F.col("members")))


def as_rows(combined: DataFrame, keys: list[str] = SAMPLE, methods: list[str] = METHODS) -> DataFrame:
    """Ensemble columns as (keys, model_id, reward) rows."""
    entries = F.array(
        *[F.struct(F.lit(f"ensemble_{m}").alias("model_id"), F.col(m).alias("reward")) for m in methods]
    )
    return combined.select(*keys, F.inline(entries))


def auc_weights(rewards: DataFrame, *, fit_on: Column | None = None) -> DataFrame:
    """One weight per model in proportion to its ROC-AUC, fitted on all rows or those where ``fit_on`` holds."""
    rows = rewards if fit_on is None else rewards.where(fit_on)
    scored = ranking_metrics(rows.withColumn("label", toxic_label()), ["model_id"], "reward")
    scored = materialize(scored.select("model_id", "roc_auc"), "auc")
    total = scored.agg(F.sum("roc_auc")).first()[0]
    return scored.select("model_id", (F.col("roc_auc") / F.lit(total)).alias("weight"))


def weighted(
    rewards: DataFrame, weights: DataFrame, keys: list[str] = SAMPLE, value: str = "reward"
) -> DataFrame:
    """Weighted mean over the models of each sample; weights are normalized over the models present."""
    w = F.col("weight")
    return (
        join_on(rewards, weights, ["model_id"])
        .groupBy(*keys)
        .agg((F.sum(w * F.col(value)) / F.sum(w)).alias("weighted"))
    )


def user_weighted(
    rewards: DataFrame, weights: dict[str, float] | None, keys: list[str] = SAMPLE, value: str = "reward"
) -> DataFrame:
    """Weighted mean with given weights; without weights all models count the same."""
    w = F.lit(1.0)
    if weights:
        w = F.lit(None).cast("double")
        for model, number in weights.items():
            w = F.when(F.col("model_id") == model, F.lit(float(number))).otherwise(w)
    present = rewards.withColumn("_w", w).where(F.col("_w").isNotNull())
    return present.groupBy(*keys).agg((F.sum(F.col("_w") * F.col(value)) / F.sum("_w")).alias("weighted"))


def with_ensembles(rewards: DataFrame) -> DataFrame:
    """Member rewards plus one pseudo model per ensemble method.

    The rewards are stored once; one aggregate by sample serves all methods. There is one weight a model.
    """
    stored = materialize(rewards.select(*SAMPLE, "model_id", "reward"), "rewards")
    weights = {r["model_id"]: r["weight"] for r in auc_weights(stored).collect() if r["weight"] is not None}
    found = _simple(F.col("members"))
    if weights:
        found.append(_weighted(F.col("members"), weights).alias("weighted"))
    combined = members_of(stored).select(*SAMPLE, *found)
    rows = as_rows(combined, SAMPLE, [*METHODS, *["weighted"] * bool(weights)])
    return stored.select(*SAMPLE, "model_id", "reward").unionByName(rows)


def leaderboard(rewards: DataFrame) -> DataFrame:
    """Accuracy, F1, ROC-AUC and PR-AUC of every member and every ensemble method."""
    report = classification_report(materialize(with_ensembles(rewards), "ensembles"), ["model_id"])
    return report.select("model_id", "accuracy", "f1", "roc_auc", "pr_auc")


def best_method(board: DataFrame) -> DataFrame:
    """Best ensemble and best member by ROC-AUC; ties go to the first name."""
    kind = F.when(F.col("model_id").startswith("ensemble_"), "ensemble").otherwise("member")
    best = F.min(F.struct((-F.col("roc_auc")).alias("m"), "model_id"))
    return board.groupBy(kind.alias("kind")).agg(
        best["model_id"].alias("best_model"),
        F.max("roc_auc").alias("roc_auc"),
        F.avg("roc_auc").alias("mean_roc_auc"),
        F.count("*").alias("models"),
    )


def score_table(
    rewards: DataFrame, texts: DataFrame, models: list[str], *, text: str = "text", limit: int = 1000,
    keys: list[str] = SAMPLE,
) -> DataFrame:
    """One row per sample side with the shortened text, its attributes and one column per model.

    Rewards without a text keep their row.
    """
    wide = rewards.groupBy(*keys).pivot("model_id", models).agg(F.max("reward"))
    return wide.join(texts.withColumn(text, shorten(F.col(text), limit)), "sample_id", "left")


def prediction_records(rewards: DataFrame, keys: list[str] = SAMPLE) -> DataFrame:
    """Sorted individual predictions, one per model, and the equal-weight ensemble score of each sample."""
    per_model = rewards.groupBy(*keys, "model_id").agg(F.avg("reward").alias("reward"))
    return per_model.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("model_id", "reward"))).alias("predictions"),
        F.avg("reward").alias("ensemble"),
    )


def ensemble(
    rewards: DataFrame, method: str = "mean", keys: list[str] = SAMPLE, *, weights: dict[str, float] | None = None
) -> DataFrame:
    """Ensemble reward of each sample by mean, median, max, min, ``weighted`` (given) or ``auc_weighted``."""
    if method == "weighted":
        return user_weighted(rewards, weights, keys).withColumnRenamed("weighted", "reward")
    if method == "auc_weighted":
        return weighted(rewards, auc_weights(rewards), keys).withColumnRenamed("weighted", "reward")
    return combine(rewards, keys).select(*keys, F.col(method).alias("reward"))
