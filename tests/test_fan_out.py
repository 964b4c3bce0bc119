"""Few bytes that become many rows: neither one task nor a broadcast may hold them."""

import pytest
from pyspark.sql import functions as F

from scorelens.operators import delta, pairing, scoring
from scorelens.plans import scenario as sc


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.fixture
def scores(spark):
    rows = [(i, "output", "c", None if i % 3 == 0 else "toxic", m, i / 10) for i in range(8) for m in ("base", "tuned")]
    return spark.createDataFrame(rows, "prompt_id long, text_type string, classifier string, label string, model string, score double")


def test_ids_are_not_merged_into_one_task(spark, tmp_path):
    ids = spark.range(60_000).select(F.expr("if(id % 100 = 0, null, id div 2)").alias("doc_id"), F.lit("x").alias("text"))
    ids.write.parquet(f"{tmp_path}/documents.parquet")
    found = sc.ids(spark, str(tmp_path), "prompt_id")
    assert found.select(F.spark_partition_id()).distinct().count() >= 6
    assert found.count() == 60_000 and found.where("prompt_id is null").count() == 600


def test_no_ids_and_few_ids(spark, tmp_path):
    for rows in (0, 3):
        spark.range(rows).select(F.col("id").alias("doc_id")).write.parquet(f"{tmp_path}/{rows}/documents.parquet")
        assert sc.ids(spark, f"{tmp_path}/{rows}", "prompt_id").count() == rows


def test_baseline_is_not_broadcast(scores):
    joined = delta.with_baseline(scores)
    text = final_plan(joined)
    assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text
    assert joined.count() == 8 and joined.where("score = base_value").count() == 8


def test_known_baselines_are_not_broadcast(scores):
    gone = delta.unmatched(scores.where("not (model = 'base' and prompt_id < 2)"))
    assert "BroadcastHashJoin" not in final_plan(gone)
    assert [tuple(r) for r in gone.collect()] == [("tuned", 8, 2)]


def test_experiments_are_the_broadcast_side(spark):
    results = spark.range(1000).select(F.concat(F.lit("e"), F.col("id") % 3).alias("experiment"), "id")
    experiments = spark.createDataFrame([("e0", 1), ("e1", 2)], "experiment string, size int")
    joined = pairing.with_experiment(results, experiments)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "BuildRight" in plan  # before anything has run
    assert joined.count() == 667


def test_words_are_cut_once(spark):
    texts = spark.createDataFrame([("Stupid idiot, kill the trash",), ("",), (None,), ("fine words",)], "text string")
    scored = texts.select(scoring.lexical_scores(F.col("text")).alias("labels"))
    assert scored._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    zero = {"toxic": 0.0, "insult": 0.0, "threat": 0.0}
    assert [r[0] for r in scored.collect()] == [{"toxic": 0.6, "insult": 0.4, "threat": 0.2}, zero, zero, zero]
