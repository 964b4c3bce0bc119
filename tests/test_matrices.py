"""Blocked matrices against numpy over pairwise-complete rows."""

import math

import numpy as np
import pytest

from scorelens.operators import matrices, metrics


def table(spark, values, parts=3):
    names = [f"c{k}" for k in range(values.shape[1])]
    rows = [tuple(None if v is None else float(v) for v in row) for row in values.tolist()]
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(parts), names


def expected(values, a, b):
    pairs = [(x, y) for x, y in zip(values[:, a], values[:, b]) if x is not None and y is not None]
    if len(pairs) < 2:
        return None
    x, y = (np.array(side, dtype=float) for side in zip(*pairs))
    if np.ptp(x) == 0 or np.ptp(y) == 0:
        return None
    return float(np.corrcoef(x, y)[0, 1])


@pytest.mark.parametrize("block", [2, 3, 512])
def test_pairwise_complete_correlations(spark, monkeypatch, block):
    monkeypatch.setattr(matrices, "BLOCK", block)
    rng = np.random.default_rng(5)
    plain = rng.normal(size=(300, 7))
    plain[:, 1] = plain[:, 0] * 0.7 + plain[:, 1] * 0.3
    plain[:, 2] = plain[:, 2] * 1e-3 + 1e6  # small variance of large values
    plain[:, 3] = 0.1  # constant
    values = plain.astype(object)
    values[rng.random(values.shape) < 0.2] = None
    values[:, 6] = None
    df, names = table(spark, values)
    got = {(r["i"], r["j"]): r["correlation"] for r in metrics.correlation_matrix(df, names).collect()}
    assert len(got) == 49
    for a in range(7):
        for b in range(7):
            want, have = expected(values, a, b), got[f"c{a}", f"c{b}"]
            assert (want is None) == (have is None), (a, b, want, have)
            assert want is None or have == pytest.approx(want, abs=1e-9)


def test_nan_stays_in_its_pairs(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, 1.0, float("nan")), (3.0, 5.0, None), (4.0, 1.0, 9.0)], "a double, b double, c double")
    got = {(r["i"], r["j"]): r["correlation"] for r in metrics.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert math.isnan(got["a", "c"]) and math.isnan(got["c", "c"]) and got["a", "b"] == pytest.approx(float(np.corrcoef([1, 2, 3, 4], [2, 1, 5, 1])[0, 1]))


def test_empty_table_and_no_columns(spark):
    df = spark.createDataFrame([], "a double, b double")
    assert {(r["i"], r["j"], r["correlation"]) for r in metrics.correlation_matrix(df, ["a", "b"]).collect()} == {(x, y, None) for x in "ab" for y in "ab"}
    assert metrics.correlation_matrix(df, []).collect() == []


def test_five_hundred_columns_in_one_scan(spark, monkeypatch):
    rng = np.random.default_rng(6)
    values = rng.normal(size=(200, 500))
    df, names = table(spark, values)
    scans, plain = [], matrices._block_sums
    monkeypatch.setattr(matrices, "_block_sums", lambda *a: scans.append(plain(*a)) or scans[-1])
    got = metrics.correlation_matrix(df, names)
    text = scans[0]._jdf.queryExecution().executedPlan().toString()
    assert len(scans) == 1 and len(text) < 20_000
    want = np.corrcoef(values.T)
    rows = got.collect()
    assert len(rows) == 250_000
    assert max(abs(r["correlation"] - want[int(r["i"][1:]), int(r["j"][1:])]) for r in rows) < 1e-9


def test_cosine_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(matrices, "BLOCK", 2)
    rng = np.random.default_rng(8)
    heads = rng.normal(size=(5, 30))
    df = spark.createDataFrame([(f"h{k}", d, float(heads[k, d])) for k in range(5) for d in range(30)], "name string, dim int, value double")
    unit = heads / np.linalg.norm(heads, axis=1)[:, None]
    for r in metrics.cosine_matrix(df, [f"h{k}" for k in range(5)]).collect():
        assert r["cosine"] == pytest.approx(float(unit[int(r["i"][1])] @ unit[int(r["j"][1])]))
