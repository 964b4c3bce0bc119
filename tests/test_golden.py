"""Hand-computed values on small literal frames."""

import math

import pytest
from pyspark.sql import functions as F

from scorelens.operators import delta, describe, experiments, losses, plotdata, reshape, topk

KEYS = ["prompt_id", "text_type", "classifier", "label"]
LISTS = {
    ("roberta", "toxic"): ([0.8, 0.7, 0.9], [0.3, 0.4, 0.5]),
    ("toxic_bert", "toxic"): ([0.7, 0.6, 0.8], [0.2, 0.3, 0.4]),
    ("toxic_bert", "severe_toxic"): ([0.2, 0.1, 0.3], [0.05, 0.1, 0.15]),
    ("toxic_bert", "obscene"): ([0.1, 0.05, 0.15], [0.02, 0.05, 0.08]),
}


@pytest.fixture(scope="module")
def scores(spark):
    rows = []
    for (classifier, label), sides in LISTS.items():
        for model, values in zip(("base", "detoxified"), sides):
            rows += [(i, model, "output", classifier, label, v) for i, v in enumerate(values)]
    return spark.createDataFrame(
        rows, "prompt_id bigint, model string, text_type string, classifier string, label string, score double")


def test_deltas_and_improvement(scores):
    deltas = delta.baseline_delta(scores)
    got = {(r["classifier"], r["label"]): r for r in delta.improvement_stats(deltas, ["classifier", "label"]).collect()}
    roberta = got[("roberta", "toxic")]
    assert roberta["mean"] == pytest.approx(0.4) and roberta["std"] == pytest.approx(math.sqrt(0.02 / 3))
    assert (roberta["improved"], roberta["regressed"], roberta["neutral"]) == (3, 0, 0)
    assert roberta["effect_size"] == pytest.approx(0.4 / math.sqrt(0.02 / 3))
    severe = got[("toxic_bert", "severe_toxic")]
    assert severe["mean"] == pytest.approx(0.1) and (severe["improved"], severe["neutral"]) == (2, 1)
    for row in got.values():
        assert row["improved"] + row["regressed"] + row["neutral"] == row["n"] == 3
        assert row["improved_rate"] + row["regressed_rate"] + row["neutral_rate"] == pytest.approx(1.0)


def test_direction_of_deltas(scores):
    a = delta.baseline_delta(scores).groupBy().sum("delta").first()[0]
    b = delta.baseline_delta(scores, direction="minus_baseline").groupBy().sum("delta").first()[0]
    assert a == pytest.approx(-b) and a > 0


def test_constant_and_short_deltas_have_no_skewness_or_effect(spark):
    df = spark.createDataFrame([("c", 0.1)] * 4 + [("s", 0.1), ("s", 0.5)], "g string, delta double")
    got = {r["g"]: r for r in delta.improvement_stats(df, ["g"]).collect()}
    assert got["c"]["skewness"] == 0.0 and got["c"]["effect_size"] == 0.0 and got["s"]["skewness"] == 0.0


def test_text_types_are_compared_within_themselves_and_prompts_are_left_out(spark):
    rows = [(1, m, t, "c", "toxic", v) for m, t, v in [
        ("base", "output", 0.9), ("base", "full_text", 0.5), ("base", "prompt", 0.3),
        ("m", "output", 0.4), ("m", "full_text", 0.4), ("m", "prompt", 0.3), ("no_base", "other", 0.1)]]
    df = spark.createDataFrame(rows, "prompt_id int, model string, text_type string, classifier string, label string, score double")
    got = {r["text_type"]: round(r["delta"], 6) for r in delta.baseline_delta(df).collect()}
    assert got == {"output": 0.5, "full_text": 0.1}


def five_rows(spark):
    rows = [("a", 0.5), ("b", 0.3), ("c", 0.4), ("d", 0.4), ("e", 0.5), ("f", -0.2), ("g", 0.01)]
    return spark.createDataFrame(rows, "prompt_id string, delta double")


def test_ties_in_top_changes_go_to_the_lower_key(spark):
    df = five_rows(spark)
    assert [r["prompt_id"] for r in topk.top_changes(df, [], n=3).collect()] == ["a", "e", "c"]
    assert [r["prompt_id"] for r in topk.top_changes(df, [], n=3, largest=False).collect()] == ["f"]
    grouped = topk.top_changes(df.withColumn("m", F.lit("x")), ["m"], n=3).orderBy("place")
    assert [r["prompt_id"] for r in grouped.collect()] == ["a", "e", "c"]


def test_linear_frame_closed_form(spark):
    rows = []
    for i in range(5):
        rows += [(i, "base", "output", "roberta_toxicity", "toxic", 0.8 - 0.1 * i), (i, "m", "output", "roberta_toxicity", "toxic", 0.3 - 0.05 * i)]
    df = spark.createDataFrame(rows, "prompt_id int, model string, text_type string, classifier string, label string, score double")
    row = delta.improvement_stats(delta.baseline_delta(df), ["model"]).first()
    # deltas are 0.5 - 0.05 i
    assert row["mean"] == pytest.approx(0.4) and row["median"] == pytest.approx(0.4)
    assert row["p25"] == pytest.approx(0.35) and row["p75"] == pytest.approx(0.45)
    assert row["skewness"] == pytest.approx(0.0, abs=1e-9)


def test_label_map_cases(spark):
    """NULL map, empty map, missing label and NaN score are four different things."""
    rows = [("m", "c", "output", {"toxic": 0.8, "threat": 0.2}), ("m", "c", "output", {"toxic": 0.4}), ("m", "c", "output", {}), ("m", "c", "output", None)]
    df = spark.createDataFrame(rows, "model string, classifier string, text_type string, labels map<string,double>")
    got = {r["label"]: r for r in describe.label_map_summary(df).collect()}
    assert got["toxic"]["n"] == got["threat"]["n"] == 2
    assert got["toxic"]["mean"] == pytest.approx(0.6) and got["threat"]["mean"] == pytest.approx(0.1)
    assert got["threat"]["std"] == pytest.approx(0.1) and got["threat"]["min"] == 0.0 and got["toxic"]["min"] == 0.4


def test_bad_rewards_are_counted_before_they_are_replaced(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", float("-inf")), ("a", 2.0)], "g string, reward double")
    row = describe.reward_batch_stats(df, ["g"]).first()
    assert (row["mean"], row["bad_count"], row["n"]) == (0.75, 2, 4)


def test_reduction_percent_needs_a_positive_first(spark):
    df = spark.createDataFrame([("a", 0, 0.5), ("a", 20, 0.4), ("a", 100, 0.1), ("z", 0, 0.0), ("z", 20, 0.2)], "c string, epoch int, mean double")
    got = {r["c"]: r for r in delta.total_reduction(df, ["c"]).collect()}
    assert got["a"]["reduction"] == pytest.approx(0.4) and got["a"]["reduction_percent"] == pytest.approx(80.0)
    assert got["z"]["reduction_percent"] == 0.0


def test_losses_by_hand(spark):
    df = spark.createDataFrame([("g", 0.0, 0.05), ("g", 1.0, 0.5)], "g string, original double, detoxified double")
    row = losses.pairwise_loss(df, ["g"]).first()
    assert row["max_margin"] == pytest.approx((0.05 + 0.6) / 2)
    assert row["asymmetric_margin"] == pytest.approx((-0.05 + 1.0) / 2)
    assert row["confidence_margin"] == pytest.approx(((0.1 + 0.025 - 0.05) + (0.1 + 0.25 + 0.5)) / 2)
    assert row["max_entropy"] == pytest.approx((math.log1p(math.exp(-0.5)) + math.log1p(math.exp(5.0))) / 2)


def test_losses_with_missing_numbers(spark):
    df = spark.createDataFrame([("g", float("nan"), 1.0), ("g", 0.0, 0.0)], "g string, original double, detoxified double")
    row = losses.pairwise_loss(df, ["g"]).first()
    assert row["max_margin"] == pytest.approx(0.05) and row["asymmetric_margin"] == 0.0 and row["max_entropy"] == 1.0


def test_entropy_loss_does_not_overflow(spark):
    df = spark.createDataFrame([("g", 1000.0, -1000.0)], "g string, original double, detoxified double")
    assert losses.pairwise_loss(df, ["g"], ["max_entropy"]).first()["max_entropy"] == pytest.approx(20000.0)


def test_zscore_cases(spark):
    rows = [("n", 1.0), ("n", 3.0), ("flat", 5.0), ("flat", 5.0), ("one", 7.0)]
    got = {}
    for r in losses.zscore(spark.createDataFrame(rows, "g string, reward double"), ["g"]).collect():
        got.setdefault(r["g"], []).append(round(r["normalized"], 6))
    assert sorted(got["n"]) == [-0.707107, 0.707107] and got["flat"] == [0.0, 0.0] and got["one"] == [7.0]


def test_histogram_keeps_every_row(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (0, 1, 2, 3, 10, 10)] + [("c", 2.0), ("c", 2.0), ("c", None)], "g string, x double")
    rows = plotdata.histogram(df, ["g"], "x", 5).collect()
    counts = {g: [r["count"] for r in sorted(rows, key=lambda r: r["bin"]) if r["g"] == g] for g in "ac"}
    assert counts == {"a": [2, 2, 0, 0, 2], "c": [0, 0, 2, 0, 0]}


def test_density_integrates_to_one(spark):
    df = spark.range(2000).select(F.lit("g").alias("g"), F.sqrt("id").alias("x"))
    rows = sorted(plotdata.density(df, ["g"], "x").collect(), key=lambda r: r["point"])
    area = sum((b["x"] - a["x"]) * (a["density"] + b["density"]) / 2 for a, b in zip(rows, rows[1:]))
    assert area == pytest.approx(1.0, abs=0.01)


def test_consistent_improvers(spark):
    rows = [("a", e, v) for e, v in zip("wxyz", (1.0, 1.0, 1.0, -1.0))] + [("b", e, v) for e, v in zip("wxyz", (1.0, 1.0, 0.0, -1.0))]
    rows += [("c", "w", 2.0)]
    df = spark.createDataFrame(rows, "sample_id string, experiment string, improvement double")
    got = {r["sample_id"]: r for r in experiments.consistent_improvers(df, []).collect()}
    assert set(got) == {"a", "c"} and got["a"]["improvement_rate"] == 0.75 and got["a"]["mean_improvement"] == 0.5
    assert got["a"]["improvements"]["z"] == -1.0 and got["c"]["models"] == 1


def test_wide_names_with_and_without_prefix_and_aliases():
    columns = ["prompt", "output_base", "output_detox_epoch_20_roberta_toxicity_score", "base_roberta_toxicity_score", "prompt_roberta_toxicity_score",
               "full_detox_epoch_20_roberta_toxicity_score", "base_toxic_bert_identity_hate_score", "delta_x_vs_base_roberta_toxicity_score",
               "output_base_toxic_bert_severe_toxic"]
    found = {f["column"]: (f["text_type"], f["model"], f["classifier"], f["label"]) for f in reshape.discover(columns, ["roberta_toxicity", "toxic_bert"])}
    assert found == {
        "output_detox_epoch_20_roberta_toxicity_score": ("output", "detox_epoch_20", "roberta_toxicity", ""),
        "base_roberta_toxicity_score": ("output", "base", "roberta_toxicity", ""),
        "prompt_roberta_toxicity_score": ("prompt", "prompt", "roberta_toxicity", ""),
        "full_detox_epoch_20_roberta_toxicity_score": ("full_text", "detox_epoch_20", "roberta_toxicity", ""),
        "base_toxic_bert_identity_hate_score": ("output", "base", "toxic_bert", "identity_attack"),
        "output_base_toxic_bert_severe_toxic": ("output", "base", "toxic_bert", "severe_toxic"),
    }


def test_approximate_statistics_are_close(spark):
    df = spark.range(10000).select(F.lit("g").alias("g"), (F.col("id") / 10000).alias("score"))
    row = describe.describe(df, ["g"], percentiles={"median": 0.5}, approx=True).first()
    assert row["median"] == pytest.approx(0.5, abs=0.001)
