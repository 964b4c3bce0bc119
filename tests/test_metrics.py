import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scorelens.operators import ensemble, metrics


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(11)
    rows = []
    for g, n in (("small", 12), ("ties", 200), ("mixed", 300)):
        y = rng.integers(0, 2, n)
        s = rng.normal(size=n) + y * 0.5
        if g == "ties":
            s = np.round(s)
        rows.append(pd.DataFrame({"g": g, "i": np.arange(n), "s": s, "t": np.round(s + rng.normal(size=n), 1), "y": y}))
    # one group of a single class
    rows.append(pd.DataFrame({"g": "one_class", "i": range(4), "s": [1.0, 2, 3, 4], "t": [1.0, 1, 1, 1], "y": 1}))
    return pd.concat(rows, ignore_index=True)


@pytest.fixture(scope="module")
def df(spark, frame):
    return spark.createDataFrame(frame).persist()


def brute_auc(s, y):
    pos, neg = s[y == 1], s[y == 0]
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


def brute_pr(s, y):
    precision, recall = [1.0], [0.0]
    for threshold in sorted(set(s), reverse=True):
        chosen = s >= threshold
        precision.append(y[chosen].mean())
        recall.append(y[chosen].sum() / y.sum())
    return sum((r1 - r0) * (p0 + p1) / 2 for r0, r1, p0, p1 in zip(recall, recall[1:], precision, precision[1:]))


@pytest.mark.parametrize("low", [True, False])
def test_areas_equal_brute_force(df, frame, low):
    got = {r["g"]: r for r in metrics.ranking_metrics(df, ["g"], "s", "y", low_is_positive=low).collect()}
    for g, rows in frame.groupby("g"):
        s, y = (-rows.s if low else rows.s).to_numpy(), rows.y.to_numpy()
        if g == "one_class":
            assert got[g]["roc_auc"] is None and got[g]["pr_auc"] == pytest.approx(1.0)
            continue
        assert got[g]["roc_auc"] == pytest.approx(brute_auc(s, y))
        assert got[g]["pr_auc"] == pytest.approx(brute_pr(s, y))


def brute_tau(x, y):
    c = d = tx = ty = 0
    for i, j in itertools.combinations(range(len(x)), 2):
        a, b = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
        c, d, tx, ty = c + (a * b > 0), d + (a * b < 0), tx + (a == 0), ty + (b == 0)
    n0 = len(x) * (len(x) - 1) / 2
    scale = np.sqrt((n0 - tx) * (n0 - ty))
    return (c - d) / scale if scale else None


def test_correlations_equal_brute_force(df, frame):
    got = {r["g"]: r for r in metrics.correlations(df, ["g"], "s", "t").collect()}
    for g, rows in frame.groupby("g"):
        if g == "one_class":
            # a constant side has no correlation
            assert got[g]["pearson"] is None and got[g]["spearman"] is None and got[g]["kendall"] is None
            continue
        assert got[g]["pearson"] == pytest.approx(np.corrcoef(rows.s, rows.t)[0, 1])
        assert got[g]["spearman"] == pytest.approx(np.corrcoef(rows.s.rank(), rows.t.rank())[0, 1])
        assert got[g]["kendall"] == pytest.approx(brute_tau(rows.s.to_numpy(), rows.t.to_numpy()))


def test_f1_is_zero_without_positives(spark):
    df = spark.createDataFrame([("a", 0, 0), ("a", 0, 0)], "g string, label int, prediction int")
    row = metrics.confusion_metrics(df, ["g"]).first()
    assert (row["accuracy"], row["f1"]) == (1.0, 0.0)


def test_positive_class_changes_f1_only(spark):
    rows = [(i, side, "m", float(r)) for i, (side, r) in enumerate(
        [("original", -1), ("original", 2), ("detoxified", 1), ("detoxified", 3), ("detoxified", -2)])]
    df = spark.createDataFrame(rows, "sample_id int, side string, model_id string, reward double")
    a = metrics.classification_report(df, ["model_id"]).first()
    b = metrics.classification_report(df, ["model_id"], positive="detoxified").first()
    assert a["accuracy"] == b["accuracy"] and a["roc_auc"] == pytest.approx(b["roc_auc"])
    assert a["f1"] != b["f1"]


def test_cosine_needs_two_vectors(spark):
    df = spark.createDataFrame([("a", 0, 1.0)], "name string, dim int, value double")
    with pytest.raises(ValueError):
        metrics.cosine_matrix(df, ["a"])


def test_cosine_matrix(spark):
    rows = [("a", 0, 1.0), ("a", 1, 0.0), ("b", 0, 1.0), ("b", 1, 1.0), ("z", 0, 0.0), ("z", 1, 0.0)]
    df = spark.createDataFrame(rows, "name string, dim int, value double")
    got = {(r["i"], r["j"]): r["cosine"] for r in metrics.cosine_matrix(df, ["a", "b", "z"]).collect()}
    assert got[("a", "b")] == pytest.approx(np.sqrt(0.5)) == got[("b", "a")]
    assert got[("a", "a")] == pytest.approx(1.0) and got[("z", "a")] is None and len(got) == 9


def test_ensemble_weights_sum_to_one_and_can_be_fitted_on_a_part(spark):
    rng = np.random.default_rng(0)
    rows = [(i, side, m, float(rng.normal() + (side == "detoxified") * k)) for i in range(40)
            for side in ("original", "detoxified") for k, m in enumerate(("a", "b"))]
    df = spark.createDataFrame(rows, "sample_id int, side string, model_id string, reward double")
    weights = {r["model_id"]: r["weight"] for r in ensemble.auc_weights(df).collect()}
    assert sum(weights.values()) == pytest.approx(1.0) and weights["b"] > weights["a"]
    part = ensemble.auc_weights(df, fit_on=F.col("sample_id") < 20)
    assert part.count() == 2
