"""Cases that once gave wrong answers: missing p-values, labels, baselines and sides, repeats, no spread."""

import math

import pytest
from pyspark.sql import functions as F

from scorelens.functions import distributions as dist
from scorelens.operators import delta, metrics, pairing, reshape
from scorelens.operators import hypothesis as hy
from scorelens.operators.scoring import register_scorer
from scorelens.streaming.monitor import run_available, score_stream


@pytest.mark.parametrize("method,expected", [("holm", (None, 0.02, 0.04)), ("fdr", (None, 0.02, 0.04)), ("bonferroni", (None, 0.02, 0.08))])
def test_missing_p_values_are_no_members_of_the_family(spark, method, expected):
    df = spark.createDataFrame([("f", "a", None), ("f", "b", 0.01), ("f", "c", 0.04)], "family string, name string, p_value double")
    got = {r["name"]: r["p_adjusted"] for r in hy.adjust_p_values(df, ["family"], key=["name"], method=method).collect()}
    assert got["a"] is None and (got["b"], got["c"]) == pytest.approx(expected[1:])


def test_unlabelled_rows_take_no_part_in_areas(spark):
    rows = [("g", 0.1, 0), ("g", 0.2, None), ("g", 0.3, None), ("g", 0.4, 1), ("g", float("nan"), 1), ("g", None, 0)]
    df = spark.createDataFrame(rows, "g string, score double, label int")
    (row,) = metrics.ranking_metrics(df, ["g"], "score", low_is_positive=False).collect()
    assert (row["positives"], row["negatives"], row["roc_auc"], row["pr_auc"]) == (1, 1, 1.0, 1.0)
    sides = df.select("g", "score", (F.col("label") == 1).alias("first"))
    (row,) = hy.mann_whitney_statistic(sides, ["g"], "score", F.col("first")).collect()
    assert (row["n1"], row["n2"], row["u"]) == (1, 1, 1.0)


def test_rank_sum_by_its_name_and_no_p_value_of_few_rows(spark):
    rows = [(g, i, 0.5 + 0.01 * i, 0.4) for g, n in (("few", 6), ("many", 12)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, prompt_id int, base_value double, score double")
    got = {(r["g"], r["test"]): r for r in hy.significance_table(df, ["g"], tests=("mann_whitney", "t_test", "wilcoxon"), correction="holm").collect()}
    assert got["few", "mann_whitney"]["statistic"] == 36.0 and got["many", "mann_whitney"]["statistic"] == 144.0
    assert all(got["few", t]["p_value"] is None and got["few", t]["p_adjusted"] is None for t in ("mann_whitney", "t_test", "wilcoxon"))
    assert all(got["many", t]["p_adjusted"] < 0.001 for t in ("mann_whitney", "t_test", "wilcoxon"))


def test_split_keeps_the_rows_of_a_key_together(spark):
    rows = spark.range(11).withColumn("side", F.explode(F.array(F.lit("a"), F.lit("b"))))
    got = {}
    for r in pairing.split_by_hash(rows, "id", 0.8).collect():
        got.setdefault(r["id"], set()).add(r["split"])
    assert all(len(s) == 1 for s in got.values())
    assert sum(s == {"train"} for s in got.values()) == 8
    unique = {r["id"]: r["split"] for r in pairing.split_by_hash(spark.range(11), "id", 0.8, unique=True).collect()}
    assert unique == {k: min(v) for k, v in got.items()}


def test_baseline_of_null_labels_repeats_and_unmatched_rows(spark):
    rows = [(1, "base", "output", "c", None, 0.9), (1, "base", "output", "c", None, 0.1), (1, "m", "output", "c", None, 0.4), (2, "m", "output", "c", "x", 0.4)]
    df = spark.createDataFrame(rows, "prompt_id int, model string, text_type string, classifier string, label string, score double")
    (row,) = delta.with_baseline(df).collect()
    assert row["base_value"] == pytest.approx(0.5) and row["label"] is None
    assert [tuple(r) for r in delta.unmatched(df).collect()] == [("m", 2, 1)]
    wide = reshape.to_wide(df.where("prompt_id = 1"), ["prompt_id"], ["base", "m"], name="model")
    assert wide.first()["base"] == pytest.approx(0.5)


def test_equal_deltas_are_significant(spark):
    rows = [("up", 0.5)] * 12 + [("down", -0.5)] * 12 + [("zero", 0.0)] * 12 + [("one", 0.5)]
    df = spark.createDataFrame(rows, "g string, delta double")
    got = {r["g"]: r for r in hy.t_test(df, ["g"]).collect()}
    assert got["up"]["t"] == math.inf and got["down"]["t"] == -math.inf
    assert got["up"]["p_value"] == got["down"]["p_value"] == 0.0 and got["up"]["significant_01"]
    assert got["zero"]["t"] is None and got["one"]["p_value"] is None
    one_sided = {r["g"]: r["p_value"] for r in hy.t_test(df, ["g"], alternative="greater").collect()}
    assert one_sided["up"] == 0.0 and one_sided["down"] == 1.0


def test_stream_keeps_arrivals_without_baseline_and_takes_batch_scorers(spark, tmp_path):
    def load():
        return lambda texts: [{"toxic": len(t) / 10} for t in texts]

    register_scorer("by_length", load, ["toxic"], "toxic")
    spark.createDataFrame([(1, "m", "abcde"), (2, "m", "ab")], "prompt_id int, model string, output string").withColumn(
        "ts", F.timestamp_seconds(F.lit(1_700_000_000))).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    baseline = spark.createDataFrame([(1, 0.9)], "prompt_id int, base_value double")
    got = {r["prompt_id"]: r for r in run_available(score_stream(stream, baseline, "by_length"), "arrivals").collect()}
    assert got[1]["delta"] == pytest.approx(0.4) and got[2]["delta"] is None and got[2]["score"] == pytest.approx(0.2)


@pytest.mark.parametrize("t,df,expected", [(0.01, 1e11, 0.9920213), (0.5, 1e13, 0.6170751), (2.0, 1e15, 0.0455003), (1.96, 1e3, 0.0502730), (1.96, 1e7, 0.0499958)])
def test_tails_with_many_degrees_of_freedom(t, df, expected):
    assert dist.student_two_sided(t, df) == pytest.approx(expected, abs=1e-6)


def test_tail_is_smooth_where_the_form_changes():
    assert dist.student_two_sided(1.3, 1e5) == pytest.approx(dist.student_two_sided(1.3, 1e5 * (1 + 1e-9)), abs=1e-9)


def test_normal_quantile_is_built_in_arithmetic(spark):
    from statistics import NormalDist

    p = [1e-300, 1e-20, 1e-9, 0.001, 0.05, 0.0750001, 0.3, 0.5, 0.77, 0.925, 0.99, 1 - 1e-12]
    rows = spark.createDataFrame([(x,) for x in p], "p double").select("p", dist.normal_quantile(F.col("p")).alias("z")).collect()
    for r in rows:
        assert r["z"] == pytest.approx(NormalDist().inv_cdf(r["p"]), rel=1e-9, abs=1e-12)
