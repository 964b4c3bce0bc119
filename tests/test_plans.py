"""End-to-end evaluations."""

import os

import pytest
from pyspark.sql import functions as F

from scorelens import schemas
from scorelens.operators import ensemble, hypothesis, pairing
from scorelens.plans import evaluation
from scorelens.plans import scenario as sc

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def test_evaluate_models_is_consistent(spark):
    tables = evaluation.evaluate_models(sc.scores(spark, SF_DIR, primary=True))
    improvement = tables["improvement"].collect()
    assert len(improvement) == 5 * 2 * 3
    n = tables["deltas"].count()
    assert n == sum(r["n"] for r in improvement) == 200 * 30
    summary = tables["summary"].first()
    assert summary["best_model"] == "detox_epoch_100" == tables["ranking"].first()["model"]
    assert summary["comparisons"] == 30
    assert {r["epoch"] for r in tables["progression"].collect()} == {20, 40, 60, 80, 100}
    places = tables["best_improvements"].groupBy(*evaluation.SERIES).agg(F.max("place").alias("p")).collect()
    assert max(r["p"] for r in places) == 10
    tests = {(r["model"], r["text_type"], r["classifier"]): r for r in tables["t_test"].collect()}
    assert tests[("detox_epoch_100", "output", "toxic_bert")]["significant_01"]
    assert tables["normality"].count() == tables["wilcoxon"].count() == 30
    assert tables["model_metrics"].where("classifier is null").count() == 6


def test_evaluate_rewards(spark):
    tables = evaluation.evaluate_rewards(sc.rewards(spark, SF_DIR), truth="true_reward")
    assert tables["evaluation"].count() == 10 and tables["leaderboard"].count() == 10
    best = {r["kind"]: r["best_model"] for r in tables["best"].collect()}
    assert best["member"] == "seed_46" and set(best) == {"member", "ensemble"}
    assert tables["losses"].count() == tables["differences"].count() == tables["quartiles"].count() == 5
    assert tables["ensemble"].count() == 400


def test_compare_experiments(spark):
    tables = evaluation.compare_experiments(sc.samples(spark, SF_DIR), sc.experiment_dimension(spark))
    assert tables["comparison"].count() == 32 == tables["input_types"].count() == tables["thresholds"].count()
    assert tables["ranks"].count() == 200 * 16
    assert {r["trend"] for r in tables["trend"].collect()} <= {"increasing", "decreasing", "stable"}
    assert tables["extremes"].where("side = 'top'").count() == 32 * 20


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="side"):
        schemas.require(spark.range(1), "id", "side")


def test_dispatchers(spark):
    rewards = sc.rewards(spark, SF_DIR)
    for method in ("mean", "median", "max", "min", "weighted", "auc_weighted"):
        assert ensemble.ensemble(rewards, method).count() == 400
    ids = spark.range(100).withColumnRenamed("id", "k")
    for by in ("hash", "order"):
        assert pairing.split(ids, "k", 0.3, by=by).where("split = 'train'").count() == 30
    words = ids.select(F.format_string("%03d", "k").alias("w"))
    assert sorted(r["w"] for r in pairing.split(words, "w", 0.05, by="order").where("split = 'train'").collect()) == [f"{i:03d}" for i in range(5)]


def test_corrected_significance(spark):
    rows = [(g, i, 0.5 + 0.01 * i * s, 0.4) for g, s in (("a", 1), ("b", 2)) for i in range(12)]
    df = spark.createDataFrame(rows, "g string, prompt_id int, base_value double, score double")
    got = hypothesis.significance_table(df, ["g"], correction="bonferroni").collect()
    assert all(r["p_adjusted"] == pytest.approx(2 * r["p_value"]) and r["significant"] for r in got)
