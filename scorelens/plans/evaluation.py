"""End-to-end evaluations: generations or rewards in, result tables out.

Each function writes the table that all its results share once and returns lazy result tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelens import schemas
from scorelens.functions.labels import normalize_map
from scorelens.functions.text import epoch_of, full_text
from scorelens.operators import delta, describe, ensemble, experiments, hypothesis, losses, metrics, pairing, topk
from scorelens.operators.reshape import explode_labels
from scorelens.operators.scoring import score_texts
from scorelens.storage import materialize

SERIES = ["model", "text_type", "classifier", "label"]


def classify_generations(generations: DataFrame, scorers: list[str], *, dedupe: bool | None = None) -> DataFrame:
    """Label maps of the prompt, the output and the full text of every generation.

    With batch scorers a prompt that all models share is scored once.
    """
    schemas.require(generations, "prompt_id", "model", "prompt", "output")
    prompt, output = F.col("prompt"), F.col("output")
    texts = {"prompt": prompt, "output": output, "full_text": full_text(prompt, output, strip_result=True)}
    rows = generations.select(
        "prompt_id",
        "model",
        F.inline(F.array(*[F.struct(F.lit(t).alias("text_type"), c.alias("text")) for t, c in texts.items()])),
    )
    return score_texts(rows, "text", scorers, dedupe=dedupe).drop("text")


def scores_of(classified: DataFrame) -> DataFrame:
    """Label maps as score rows with normal label names."""
    named = classified.withColumn("labels", normalize_map(F.col("classifier"), F.col("labels")))
    return explode_labels(named.select("prompt_id", "model", "text_type", "classifier", "labels"))


def evaluate_models(scores: DataFrame, *, baseline: str = "base") -> dict[str, DataFrame]:
    """All metric families of a score table: statistics, deltas, tests, rankings, progression and extremes."""
    schemas.require(scores, *schemas.SCORES.fieldNames())
    scores = materialize(scores.select(*schemas.SCORES.fieldNames()), "scores")
    paired = materialize(
        delta.baseline_delta(scores, baseline=baseline).withColumn("epoch", epoch_of(F.col("model"))), "paired"
    )
    return {
        "model_metrics": describe.pooled_metrics(scores, "model", "classifier"),
        "classifier_metrics": describe.pooled_metrics(scores, "classifier", "model"),
        "summary_table": describe.summary_table(scores, ["model", "classifier"]),
        "deltas": paired,
        "improvement": delta.improvement_stats(paired, SERIES),
        "comparison": delta.comparison(paired, SERIES),
        "t_test": hypothesis.t_test(paired, SERIES),
        "wilcoxon": hypothesis.wilcoxon_test(paired, SERIES),
        "normality": hypothesis.shapiro_test(paired, SERIES),
        "summary": delta.summary(paired),
        "ranking": delta.overall_ranking(paired),
        "progression": delta.progression(paired, ["classifier", "text_type", "label"]),
        "best_improvements": topk.top_changes(paired, SERIES),
        "worst_regressions": topk.top_changes(paired, SERIES, largest=False),
    }


def evaluate_rewards(rewards: DataFrame, *, truth: str | None = None, ratio: float = 0.8) -> dict[str, DataFrame]:
    """Reward model report: metrics per split, ensembles, pair differences and losses."""
    schemas.require(rewards, "sample_id", "side", "model_id", "reward")
    rewards = materialize(pairing.split_by_hash(rewards, "sample_id", ratio), "rewards")
    pairs = losses.pair_sides(rewards, ["sample_id", "model_id"])
    board = materialize(ensemble.leaderboard(rewards), "board")
    return {
        "evaluation": metrics.evaluation_row(rewards, ["model_id", "split"], truth=truth),
        "leaderboard": board,
        "best": ensemble.best_method(board),
        "quartiles": describe.describe(rewards, ["model_id"], "reward", ddof=1, percentiles=describe.QUARTILES),
        "differences": delta.pair_difference(pairs, ["model_id"]),
        "losses": losses.pairwise_loss(pairs, ["model_id"]),
        "ensemble": ensemble.combine(rewards),
    }


def compare_experiments(samples: DataFrame, dimension: DataFrame) -> dict[str, DataFrame]:
    """Comparison of (experiment, split) results with original and detoxified scores per sample."""
    schemas.require(samples, "sample_id", "split", "experiment", "original", "detoxified")
    rows = materialize(experiments.with_improvement(samples), "samples")
    groups = ["experiment", "split"]
    table = materialize(experiments.comparison_table(rows, dimension), "comparison")
    tests = pairing.with_experiment(rows.where("split = 'test'"), dimension)
    return {
        "comparison": table,
        "input_types": experiments.comparable(table, ["model_size", "toxicity_threshold"], "input_type"),
        "thresholds": experiments.comparable(table, ["model_size", "input_type"], "toxicity_threshold"),
        "extremes": topk.extremes(rows, groups, "improvement"),
        "ranks": topk.improvement_rank(rows, groups, "improvement"),
        "consistent_per_set": experiments.consistent_improvers(tests, ["input_type", "toxicity_threshold"]),
        "consistent": experiments.consistent_improvers(tests, []),
        "trend": experiments.improvement_trend(
            table.where("split = 'test'"), ["input_type", "toxicity_threshold"]
        ),
    }
