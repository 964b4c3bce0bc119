import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelens.functions import distributions as dist
from scorelens.operators import hypothesis as hy


def frame(spark, groups):
    rows = [(g, i, float(x)) for g, xs in groups.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "g string, prompt_id int, delta double").repartition(3)


def by_group(df):
    return {r["g"]: r for r in df.collect()}


def test_student_tables():
    assert dist.student_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert dist.student_two_sided(2.750, 30) == pytest.approx(0.01, abs=1e-4)
    assert dist.student_two_sided(0.0, 7) == pytest.approx(1.0)


def test_t_test_golden(spark):
    got = by_group(hy.t_test(frame(spark, {"a": [0.5, 0.3, 0.4], "flat": [1.0, 1.0, 1.0], "one": [2.0]}), ["g"]))
    assert got["a"]["t"] == pytest.approx(6.9282, abs=1e-4) and got["a"]["df"] == 2
    assert got["a"]["p_value"] == pytest.approx(0.0202, abs=1e-4)
    assert got["a"]["significant_05"] and not got["a"]["significant_01"]
    assert got["flat"]["t"] == float("inf") and got["flat"]["p_value"] == 0.0 and got["one"]["p_value"] is None


def brute_wilcoxon(d, greater):
    """Exact p-value over all sign patterns."""
    d = np.asarray(d)
    ranks = np.argsort(np.argsort(np.abs(d))) + 1
    w = ranks[d > 0].sum()
    total = ranks.sum()
    sums = [sum(r for r, s in zip(ranks, signs) if s) for signs in itertools.product((0, 1), repeat=len(d))]
    if greater:
        return w, np.mean([s >= w for s in sums])
    low = min(w, total - w)
    return w, min(1.0, 2 * np.mean([s <= low for s in sums]))


def test_wilcoxon_equals_all_sign_patterns(spark):
    rng = np.random.default_rng(2)
    groups = {"a": rng.normal(0.4, 1, 9), "b": rng.normal(-0.3, 1, 10), "c": rng.normal(1, 1, 6)}
    two = by_group(hy.wilcoxon_test(frame(spark, groups), ["g"]))
    one = by_group(hy.wilcoxon_test(frame(spark, groups), ["g"], alternative="greater"))
    for g, d in groups.items():
        w, p = brute_wilcoxon(d, False)
        assert two[g]["w_plus"] == w and two[g]["p_value"] == pytest.approx(p)
        assert one[g]["p_value"] == pytest.approx(brute_wilcoxon(d, True)[1])


def test_wilcoxon_table_value():
    assert dist.wilcoxon_p(10, 47.0, 0.0, 0, "two-sided") == pytest.approx(0.0488, abs=1e-4)


def test_wilcoxon_ties_zeros_and_empty(spark):
    d = [1.0, 1.0, -1.0, 2.0, 0.0, 3.0, -2.0, 0.0]
    got = by_group(hy.wilcoxon_test(frame(spark, {"t": d, "zero": [0.0, 0.0]}), ["g"]))
    nonzero = [x for x in d if x]
    ranks = {1.0: 2.0, 2.0: 4.5, 3.0: 6.0}
    w = sum(ranks[abs(x)] for x in nonzero if x > 0)
    assert got["t"]["w_plus"] == w and got["t"]["zeros"] == 2 and got["t"]["tie_term"] == (27 - 3) + (8 - 2)
    n = len(nonzero)
    var = n * (n + 1) * (2 * n + 1) / 24 - got["t"]["tie_term"] / 48
    z = (w - n * (n + 1) / 4) / math.sqrt(var)
    assert got["t"]["p_value"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))
    assert (got["zero"]["statistic"], got["zero"]["p_value"]) == (0.0, 1.0)
    assert by_group(hy.wilcoxon_test(frame(spark, {"t": d}), ["g"], alternative="greater", min_rows=10))["t"]["p_value"] is None


def test_shapiro_published_value(spark):
    sample = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    rng = np.random.default_rng(1)
    groups = {"published": sample, "three": [1.0, 2.0, 4.0], "two": [1.0, 2.0], "five": [1.0, 2.0, 3.0, 4.0, 5.0],
              "normal": rng.normal(size=500), "skewed": np.exp(rng.normal(size=500))}
    got = by_group(hy.shapiro_test(frame(spark, groups), ["g"]))
    assert got["published"]["w"] == pytest.approx(0.7888, abs=1e-4)
    assert got["published"]["p_value"] == pytest.approx(0.0067, abs=1e-4)
    assert got["two"]["w"] is None
    assert got["three"]["w"] == pytest.approx(0.9643, abs=1e-4)
    assert got["five"]["w"] == pytest.approx(0.9868, abs=1e-3)
    assert got["normal"]["p_value"] > 0.05 > got["skewed"]["p_value"] and got["normal"]["p_reliable"]


def test_mann_whitney(spark):
    rng = np.random.default_rng(4)
    a, b = np.round(rng.normal(0.5, 1, 30), 1), np.round(rng.normal(0, 1, 25), 1)
    rows = [("g", 1, float(x)) for x in a] + [("g", 0, float(x)) for x in b]
    df = spark.createDataFrame(rows, "g string, side int, x double")
    got = hy.mann_whitney_test(df, ["g"], "x", F.col("side") == 1).first()
    u = sum((p > q) + 0.5 * (p == q) for p in a for q in b)
    assert got["u"] == pytest.approx(u) and (got["n1"], got["n2"]) == (30, 25)
    counts = np.unique(np.concatenate([a, b]), return_counts=True)[1].astype(float)
    ties, n = (counts**3 - counts).sum(), 55
    sd = math.sqrt(30 * 25 / 12 * (56 - ties / (n * (n - 1))))
    assert got["p_value"] == pytest.approx(0.5 * math.erfc((u - 375 - 0.5) / sd / math.sqrt(2)))


def test_cohens_d_and_constant(spark):
    rows = [("a", 0.8, 0.3), ("a", 0.7, 0.4), ("a", 0.9, 0.5), ("c", 1.0, 1.0), ("c", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, base_value double, score double")
    got = by_group(hy.cohens_d(df, ["g"]))
    assert got["a"]["cohens_d"] == pytest.approx(0.4 / 0.1) and got["c"]["cohens_d"] == 0.0


def test_corrections(spark):
    p = {"a": 0.01, "b": 0.04, "c": 0.03, "d": 0.005}
    df = spark.createDataFrame([("f", k, v) for k, v in p.items()], "family string, name string, p_value double")

    def adjusted(method):
        rows = hy.adjust_p_values(df, ["family"], key=["name"], method=method).collect()
        return {r["name"]: r["p_adjusted"] for r in rows}

    assert adjusted("bonferroni") == pytest.approx({"a": 0.04, "b": 0.16, "c": 0.12, "d": 0.02})
    assert adjusted("holm") == pytest.approx({"a": 0.03, "b": 0.06, "c": 0.06, "d": 0.02})
    assert adjusted("fdr") == pytest.approx({"a": 0.02, "b": 0.04, "c": 0.04, "d": 0.02})


def test_unknown_test_is_signed_rank(spark):
    rows = [("g", i, 0.5 + 0.01 * i, 0.4) for i in range(12)]
    df = spark.createDataFrame(rows, "g string, prompt_id int, base_value double, score double")
    got = {r["test"]: r for r in hy.significance_table(df, ["g"], tests=("other", "t_test", "mann_whitney", "mannwhitney")).collect()}
    assert set(got) == {"wilcoxon", "t_test", "mann_whitney"}
    assert got["wilcoxon"]["p_value"] == pytest.approx(2.0**-12) and got["mann_whitney"]["statistic"] == 144
    assert all(r["significant"] for r in got.values())
