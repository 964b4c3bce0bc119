"""Physical plans keep the properties the operators rely on at scale."""

import os

import pytest
from pyspark.sql import functions as F

from scorelens import storage
from scorelens.operators import delta, describe, losses, pairing, prompts, scoring, topk
from scorelens.plans import scenario as sc

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def scores(spark):
    return storage.materialize(sc.scores(spark, SF_DIR), "scores")


def test_filters_and_columns_reach_the_scan(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    text = plan(prompts.select_prompts(docs, key="doc_id", score="n_chars", min_score=100, max_score=5000).select("doc_id"))
    assert "GreaterThanOrEqual(n_chars,100)" in text and "LessThanOrEqual(n_chars,5000)" in text
    assert "ReadSchema: struct<doc_id:bigint,n_chars:bigint>" in text and "Exchange" not in text


def test_top_k_is_one_bounded_step(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert "TakeOrderedAndProject" in plan(prompts.select_prompts(docs, key="doc_id", score="n_chars", top_k=5))


def test_top_changes_limit_groups_before_the_shuffle(scores):
    text = plan(topk.top_changes(scores.withColumnRenamed("score", "delta"), ["model", "classifier"]))
    before = text[text.index("Exchange"):]
    assert "WindowGroupLimit" in before and "Partial" in before


def test_native_scoring_has_no_shuffle_and_no_python(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    text = plan(scoring.score_texts(docs, "text", ["lexical"]))
    assert "Exchange" not in text and "Python" not in text


def test_statistics_shuffle_once_after_a_partial_aggregate(scores):
    text = plan(describe.describe(scores, ["model", "classifier"], shape=True, thresholds={"high": 0.7}))
    assert text.count("Exchange") == 1 and "partial_avg" in text[text.index("Exchange"):]


def test_deltas_do_not_cross_join(scores):
    text = plan(delta.comparison(delta.with_baseline(scores), ["model", "classifier"]))
    assert "Cartesian" not in text and "NestedLoop" not in text


def test_split_is_a_projection(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id")
    text = plan(pairing.split_by_hash(docs, "doc_id", unique=True))
    assert "Exchange" not in text and "Window" not in text and "Join" not in text


def test_losses_read_two_columns_per_group(spark):
    df = spark.range(10).select(F.lit("m").alias("g"), F.col("id").cast("double").alias("original"), F.lit(1.0).alias("detoxified"), F.lit("text").alias("t"))
    path = storage.scratch_path(spark, "pairs")
    df.write.parquet(path)
    assert "ReadSchema: struct<g:string,original:double,detoxified:double>" in plan(losses.pairwise_loss(spark.read.parquet(path), ["g"]))


def test_repeated_samples_do_not_multiply(spark):
    rows = [(1, m, "output", "c", "toxic", s) for m, s in [("base", 0.9)] * 3 + [("m", 0.4)] * 2]
    df = spark.createDataFrame(rows, "prompt_id int, model string, text_type string, classifier string, label string, score double")
    assert delta.with_baseline(df).count() == 2


def test_written_tables_can_be_dropped(spark, tmp_path):
    kept = list(storage._WRITTEN)
    storage._WRITTEN.clear()
    table = storage.materialize(spark.range(3), "dropped")
    path = storage._WRITTEN[0]
    assert table.count() == 3
    storage.drop_materialized(spark)
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files)
    storage._WRITTEN.extend(kept)


def test_ensembles_need_one_exchange_by_sample(spark, monkeypatch):
    from scorelens.operators import ensemble

    df = storage.materialize(spark.range(600).select(
        (F.col("id") % 100).alias("sample_id"), F.when(F.col("id") % 200 < 100, "original").otherwise("detoxified").alias("side"),
        F.concat(F.lit("m"), (F.col("id") % 3).cast("string")).alias("model_id"), F.rand(1).alias("reward")))
    text = plan(ensemble.with_ensembles(df))
    assert text.count("Exchange") == 1 and "Join" not in text


def test_threads_own_their_tables(spark):
    import threading

    opened, closed, found = threading.Event(), threading.Event(), []

    def other():
        opened.wait(60)
        table = storage.materialize(spark.range(5), "other")
        found.append(table)
        closed.set()

    thread = threading.Thread(target=other)
    thread.start()
    with storage.Scratch(spark) as scratch:
        opened.set()
        closed.wait(60)
        mine = storage.materialize(spark.range(7), "mine")
        with storage.Scratch(spark):
            kept = scratch.keep(mine, "kept")
        assert mine.count() == 7
    thread.join()
    assert found[0].count() == 5 and kept.count() == 7
