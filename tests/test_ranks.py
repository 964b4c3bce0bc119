import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scorelens.operators import ranks


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    n = 3000
    pdf = pd.DataFrame({"key": np.arange(n), "x": np.round(rng.normal(size=n), 1)})
    # one group and one value each hold more than a third of the rows
    pdf["g"] = np.where(rng.random(n) < 0.6, "hot", rng.integers(0, 5, n).astype(str))
    pdf.loc[rng.random(n) < 0.4, "x"] = 0.0
    pdf["w"] = rng.integers(0, 9, n)
    return pdf.sample(frac=1, random_state=1)


@pytest.fixture(scope="module")
def df(spark, frame):
    return spark.createDataFrame(frame).repartition(6).persist()


def test_positions(df, frame):
    got = ranks.ordered_index(df, ["g"], [F.col("x").desc(), "key"], "position").toPandas()
    want = frame.sort_values(["g", "x", "key"], ascending=[True, False, True])
    want["position"] = want.groupby("g").cumcount() + 1
    merged = got.merge(want[["key", "position"]], on="key")
    assert len(got) == len(frame)
    assert (merged.position_x == merged.position_y).all()


def test_positions_without_groups_and_with_null_key(spark, df, frame):
    got = ranks.ordered_index(df, [], ["key"]).select("key", "position").toPandas()
    assert (got.position == got.key + 1).all()
    nulls = spark.createDataFrame([(None, 2), (None, 1), ("a", 5)], "g string, key int")
    rows = {(r["g"], r["key"]): r["position"] for r in ranks.ordered_index(nulls, ["g"], ["key"]).collect()}
    assert rows == {(None, 1): 1, (None, 2): 2, ("a", 5): 1}


def test_running_totals(df, frame):
    got = ranks.running_totals(df, ["g"], ["x", "key"], {"total": "w"}).select("key", "total").toPandas()
    want = frame.sort_values(["g", "x", "key"])
    want["total"] = want.groupby("g").w.cumsum()
    merged = got.merge(want[["key", "total"]], on="key")
    assert len(merged) == len(frame) and (merged.total_x == merged.total_y).all()


def test_average_rank(df, frame):
    got = ranks.avg_rank(df, ["g"], "x").select("key", "avg_rank").toPandas()
    want = frame.assign(rank=frame.groupby("g").x.rank())
    merged = got.merge(want[["key", "rank"]], on="key")
    assert len(merged) == len(frame) and np.allclose(merged.avg_rank, merged["rank"])


def test_hot_values_take_the_broadcast_way_and_stay_whole(df, frame):
    table = ranks.value_ranks(df, ["g"], "x").select("g", "x", "n", "avg_rank")
    joined = ranks.join_hot_values(df, table, ["g", "x"], "avg_rank", hot_rows=100)
    got = joined.select("key", "avg_rank").toPandas().merge(
        frame.assign(rank=frame.groupby("g").x.rank())[["key", "rank"]], on="key")
    assert len(got) == len(frame) and np.allclose(got.avg_rank, got["rank"])


def test_missing_values_have_no_rank(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 1.0), ("a", -0.0), ("a", 0.0)], "g string, x double")
    got = sorted((r["x"], r["avg_rank"]) for r in ranks.avg_rank(df, ["g"], "x").collect() if r["x"] is not None)
    assert [rank for _, rank in got] == [1.5, 1.5, 3.5, 3.5]
    assert [r["avg_rank"] for r in ranks.avg_rank(df, ["g"], "x").where("x is null").collect()] == [None]


def test_totals_go_on_over_partitions_and_batches(spark):
    rng = np.random.default_rng(8)
    n = 5000
    pdf = pd.DataFrame({"key": np.arange(n), "w": rng.integers(-5, 9, n), "x": rng.normal(size=n)})
    # one group spans most partitions, others end inside them; NULL and NaN are groups of their own
    pdf["g"] = np.where(pdf.key < 3500, 1.5, np.where(pdf.key % 3 == 0, np.nan, pdf.key.astype(float)))
    df = spark.createDataFrame(pdf).withColumn("g", F.when(F.col("key") % 7 != 5, F.col("g"))).withColumn("h", F.when(F.col("key") % 2 == 0, "a"))
    frame = df.toPandas()
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(conf)
    spark.conf.set(conf, 64)
    try:
        got = ranks.running_totals(df.repartition(7), ["g", "h"], ["key"], {"tw": "w", "tx": "x"}).toPandas().sort_values("key")
    finally:
        spark.conf.set(conf, before)
    null = df.select("key", F.col("g").isNull().alias("null")).toPandas().set_index("key")["null"]
    name = [("null" if null[k] else "nan" if g != g else g, h) for k, g, h in zip(frame.key, frame.g, frame.h)]
    want = frame.assign(name=list(map(str, name))).sort_values("key")
    assert list(got.tw) == list(want.groupby("name").w.cumsum())
    assert np.allclose(got.tx, want.groupby("name").x.cumsum())


def test_ranks_shuffle_for_the_aggregate_and_the_order_only(spark, monkeypatch):
    plans = []
    write = ranks.materialize

    def noted(df, *a, **k):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, *a, **k)

    monkeypatch.setattr(ranks, "materialize", noted)
    df = spark.range(20_000).select(F.lit("g").alias("g"), F.rand(3).alias("x"))
    result = ranks.value_ranks(df, ["g"], "x")
    assert plans[0].count("Exchange hashpartitioning") == 1 and plans[0].count("Exchange rangepartitioning") == 1
    after = result._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in after and "Exchange rangepartitioning" not in after
    assert result.agg(F.max("avg_rank")).first()[0] == 20_000
