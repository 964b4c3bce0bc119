import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelens.functions.numeric import value_head
from scorelens.operators import losses, reward_head, scoring
from scorelens.sources import readers, writers
from scorelens.storage import scratch_path
from scorelens.streaming import monitor


def test_json_layouts(spark, tmp_path):
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a.jsonl").write_text('{"text": "one"}\n{"output": "two"}\n"three"\nbroken\n\n{"text": null, "output": "four"}\n')
    assert sorted(r["text"] for r in readers.read_json_texts(spark, str(tmp_path / "lines")).collect()) == ["four", "one", "three", "two"]
    (tmp_path / "array.json").write_text('[\n {"text": "one"},\n {"output": "two"},\n "three"]')
    assert sorted(r["text"] for r in readers.read_json_texts(spark, str(tmp_path / "array.json"), layout="array").collect()) == ["one", "three", "two"]
    (tmp_path / "object.json").write_text('{"texts": ["x", "y"]}')
    assert sorted(r["text"] for r in readers.read_json_texts(spark, str(tmp_path / "object.json"), layout="object").collect()) == ["x", "y"]


def test_text_lines(spark, tmp_path):
    (tmp_path / "t.txt").write_text(" a \n\n\t\nb\n")
    assert [r["text"] for r in readers.read_text_lines(spark, str(tmp_path / "t.txt")).collect()] == ["a", "b"]


def test_csv_round_trip_keeps_quotes_breaks_maps_and_missing(spark):
    rows = [(1, 'a "b", c\nd', {"toxic": 0.5}), (2, "", {}), (3, None, None)]
    df = spark.createDataFrame(rows, "k int, t string, m map<string,double>")
    path = scratch_path(spark, "test")
    writers.write_csv(df, path)
    got = {r["k"]: (r["t"], r["m"]) for r in readers.read_results_csv(spark, path, "k int, t string, m string").collect()}
    assert got[1] == ('a "b", c\nd', '{"toxic":0.5}') and got[3] == (None, None)
    assert got[2][0] in ("", None) and got[2][1] == "{}"


def test_no_text_column_is_an_error(spark):
    with pytest.raises(ValueError):
        readers.resolve_text(spark.range(1))


def test_cache_reads_until_forced(spark):
    folder = scratch_path(spark, "cache")
    calls = []

    def build():
        calls.append(1)
        return spark.range(len(calls))

    assert readers.cached(spark, folder, "x", build).count() == 1
    assert readers.cached(spark, folder, "x", build).count() == 1
    assert readers.cached(spark, folder, "x", build, force=True).count() == 2
    assert readers.cached(spark, folder, "x", build).count() == 2 and len(calls) == 2


def test_each_distinct_text_is_scored_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def load():
        def predict(texts):
            seen.add(len(texts))
            return [{"toxic": float(len(t))} for t in texts]

        return predict

    scoring.register_scorer("counting", load, ["toxic"], "toxic")
    df = spark.createDataFrame([(i, "same" if i % 2 else f"t{i}") for i in range(40)] + [(99, None)], "k int, t string").repartition(5)
    rows = scoring.score_texts(df, "t", ["counting"]).collect()
    assert len(rows) == 40 and seen.value == 21
    assert all(r["labels"]["toxic"] == len(r["t"]) for r in rows)


def test_failing_text_gets_the_fallback_alone(spark):
    def load():
        def predict(texts):
            if any(t == "bad" for t in texts):
                raise RuntimeError("scorer failed")
            return [{"toxic": 0.25} for _ in texts]

        return predict

    scoring.register_scorer("fragile", load, ["toxic"], "toxic", fallback=scoring.SAFE_FALLBACK)
    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "fine")], "k int, t string").coalesce(1)
    got = {r["k"]: (r["labels"], r["failed"]) for r in scoring.score_texts(df, "t", ["fragile"]).collect()}
    assert got == {1: ({"toxic": 0.25}, False), 2: ({"safe": 1.0, "unsafe": 0.0}, True), 3: ({"toxic": 0.25}, False)}


def test_variants_native_and_batch_way_agree(spark):
    df = spark.createDataFrame([(1, "you", "are stupid", "are kind"), (2, "", "idiot", "fine")], "sample_id int, prompt string, original_output string, detoxified_output string")
    native = {tuple(r) for r in scoring.score_variants(df, "lexical").collect()}
    assert native == {tuple(r) for r in scoring.score_variants(df, "lexical", dedupe=True).collect()}


@pytest.mark.parametrize("loss", ["max_entropy", "max_margin"])
def test_reward_head_is_not_beaten_nearby(spark, loss):
    rng = np.random.default_rng(7)
    o = rng.normal(size=(300, 4))
    d = o + rng.normal([0.05, -0.02, 0.0, 0.03], 0.2, size=(300, 4))
    df = spark.createDataFrame([(o[i].tolist(), d[i].tolist()) for i in range(300)], "o array<double>, d array<double>").coalesce(1).persist()
    w = np.array(reward_head.fit_reward_head(df, "o", "d", loss))

    def mean(weights):
        x = (d - o) @ weights
        return np.logaddexp(0, -x / 0.1).mean() if loss == "max_entropy" else np.maximum(0.1 - x, 0).mean()

    best = mean(w)
    assert all(mean(w + rng.normal(size=4) * 0.05 * (np.abs(w).max() + 0.1)) >= best - 1e-4 for _ in range(100))
    scored = df.select(value_head(F.col("o"), list(w)).alias("original"), value_head(F.col("d"), list(w)).alias("detoxified"))
    assert losses.pairwise_loss(scored, [], [loss]).first()[loss] == pytest.approx(best)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, "m" if i % 3 else "n", float("nan") if i % 10 == 0 else i / 7) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, model string, reward double").select(
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("i") * 60).alias("ts"), "model", "reward")
    path = str(tmp_path / "events")
    df.repartition(4).write.parquet(path)
    batch = monitor.reward_monitor(df)
    stream = monitor.run_available(monitor.reward_monitor(spark.readStream.schema(df.schema).parquet(path)), "test")
    last = df.agg(F.max("ts")).first()[0]
    closed = batch.where(F.col("window_end") <= F.lit(last) - F.expr("interval 10 minutes"))

    def values(x):
        return sorted((r["window_start"], r["model"], round(r["mean"], 9), round(r["std"] or 0, 9), r["bad_count"], r["n"]) for r in x.collect())

    assert values(stream) == values(closed) and len(values(stream)) > 5
