import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelens.operators.quantiles import exact_percentiles, profile

WANTED = {"p0": 0.0, "p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p100": 1.0}


def groups():
    rng = np.random.default_rng(5)
    return {
        "normal": rng.normal(size=4000),
        "heavy_tail": np.exp(rng.normal(size=4000) * 6),
        "ties": rng.integers(0, 4, size=4000).astype(float),
        # one value holds most rows
        "hot_value": np.concatenate([np.full(3000, 0.5), rng.normal(size=500)]),
        "constant": np.full(1500, 2.0),
        "one": np.array([3.5]),
        "two": np.array([1.0, 2.0]),
        "seven": rng.normal(size=7),
    }


@pytest.fixture(scope="module")
def data(spark):
    rows = [(g, float(x)) for g, xs in groups().items() for x in xs]
    rows += [("normal", None), ("normal", float("nan"))]
    return spark.createDataFrame(rows, "g string, x double").repartition(5).persist()


@pytest.mark.parametrize(
    "options",
    [{}, {"accuracy": 100}, {"accuracy": 100, "keep_rows": 60, "grid": 16}, {"accuracy": 20, "keep_rows": 2, "grid": 8}],
)
def test_equal_to_numpy(data, options):
    got = {r["g"]: r for r in exact_percentiles(data, ["g"], "x", WANTED, **options).collect()}
    assert set(got) == set(groups())
    for g, xs in groups().items():
        for name, f in WANTED.items():
            assert got[g][name] == pytest.approx(np.percentile(xs, 100 * f), abs=1e-12, rel=1e-12), (g, name)


def test_whole_table_and_aggregates(data):
    rows = profile(data, [], "x", [F.count("*").alias("n")], {"median": 0.5}).collect()
    everything = np.concatenate(list(groups().values()))
    assert rows[0]["n"] == len(everything) + 2
    assert rows[0]["median"] == pytest.approx(np.median(everything))


def test_group_of_missing_values_keeps_its_row(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0)], "g string, x double")
    got = {r["g"]: r["median"] for r in exact_percentiles(df, ["g"], "x", {"median": 0.5}).collect()}
    assert got == {"a": None, "b": 1.0}


def test_null_group_key(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("b", 1.0)], "g string, x double")
    got = {r["g"]: r["median"] for r in exact_percentiles(df, ["g"], "x", {"median": 0.5}).collect()}
    assert got == {None: 2.0, "b": 1.0}


def test_few_passes_over_values_of_any_spread(spark, monkeypatch):
    from scorelens.operators import quantiles

    rng = np.random.default_rng(1)
    values = 10.0 ** rng.uniform(-125, 125, size=20_000)
    values[:5000] = 1e-100  # a value with a quarter of the rows
    df = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(4)
    passes = []
    narrow = quantiles._narrow
    monkeypatch.setattr(quantiles, "_narrow", lambda *a: passes.append(1) or narrow(*a))
    row = exact_percentiles(df, [], "x", WANTED, accuracy=100, keep_rows=200, grid=50).first()
    for name, f in WANTED.items():
        assert row[name] == pytest.approx(np.percentile(values, 100 * f), rel=1e-12)
    assert 1 <= len(passes) <= 3  # with the sketch at most four


def test_no_window_over_a_whole_group(data):
    text = exact_percentiles(data, ["g"], "x", WANTED)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in text.splitlines() if "windowspecdefinition" in line]
    assert windows and all("_segment" in line.split("windowspecdefinition(")[1].split("_rep")[0] for line in windows)
