"""Frames by folder, label summaries in one pass, and streams whose two sides arrive in any order."""

from pyspark.sql import functions as F

from scorelens.operators import describe, reshape
from scorelens.sources import readers, writers
from scorelens.streaming import monitor


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_scan_for_all_models_and_folders_are_pruned(spark, tmp_path):
    path = str(tmp_path / "frames")
    writers.write_frames(spark.createDataFrame([(1, 0.5, "base")], "k int, score double, model string"), path, ["model"])
    writers.write_frames(spark.createDataFrame([(1, 0.2, "x", "1e5"), (2, 0.1, "y", "a b/c")], "k int, score double, extra string, model string"), path, ["model"])
    frames = readers.read_frames(spark, path, {"model": "string"})
    assert plan(frames).count("FileScan") == 1 and "Union" not in plan(frames)
    assert {tuple(r) for r in frames.select("k", "score", "extra", "model").collect()} == {
        (1, 0.5, None, "base"), (1, 0.2, "x", "1e5"), (2, 0.1, "y", "a b/c")}
    chosen = frames.where("model = 'base'")
    filters = plan(chosen).split("PartitionFilters:")[1].split("]")[0]
    assert "base" in filters
    assert [tuple(r) for r in chosen.collect()] == [(1, 0.5, None, "base")]


def test_epochs_are_numbered_in_training_order(spark):
    rows = spark.createDataFrame([(60,), (0,), (20,), (60,), (None,)], "epoch int")
    assert sorted((tuple(r) for r in reshape.number_epochs(rows).collect()), key=str) == [(0, 0), (20, 1), (60, 2), (60, 2), (None, None)]
    assert reshape.number_epochs(rows.limit(0)).collect() == []


def test_label_summary_reads_its_input_once(spark, tmp_path):
    path = str(tmp_path / "maps")
    rows = [("m", {"toxic": 0.5, "insult": None}), ("m", {"insult": 0.2}), ("m", {}), ("m", None), (None, {"toxic": 1.0})]
    spark.createDataFrame(rows, "model string, labels map<string,double>").write.parquet(path)
    summary = describe.label_map_summary(spark.read.parquet(path), ["model"])
    assert plan(summary).count("FileScan") == 1
    got = {(r["model"], r["label"]): (r["n"], r["mean"], r["min"], r["max"]) for r in summary.collect()}
    assert got == {("m", "toxic"): (2, 0.25, 0.0, 0.5), ("m", "insult"): (2, 0.1, 0.0, 0.2), (None, "toxic"): (1, 1.0, 1.0, 1.0)}


def _scored(spark, folder, generations, baselines):
    """Every list of rows is one file; files arrive one after another on both sides."""
    kinds = {"g": "prompt_id int, model string, output string, t long", "b": "prompt_id int, base_value double, t long"}
    sides = {}
    for side, files in (("g", generations), ("b", baselines)):
        for k, rows in enumerate(files):
            spark.createDataFrame(rows, kinds[side]).coalesce(1).write.mode("append").parquet(f"{folder}/{side}")
        ts = "ts" if side == "g" else "base_ts"
        stream = spark.readStream.schema(kinds[side]).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{side}")
        sides[side] = stream.withColumn(ts, F.timestamp_seconds(F.lit(1_700_000_000) + F.col("t"))).drop("t")
    scored = monitor.score_stream_with_late_baseline(sides["g"], sides["b"])
    return {(r["prompt_id"], r["model"]): (r["base_value"], r["delta"]) for r in monitor.run_available(scored, "late").where("prompt_id >= 0").collect()}


def test_baseline_before_and_after_its_generation(spark, tmp_path):
    end = 100_000
    got = _scored(
        spark, str(tmp_path),
        [[(1, "m", "fine", 0), (1, "n", "fine", 10), (2, "m", "fine", 20), (1, "m", "fine", 5)], [(3, "m", "fine", 900)], [(4, "m", "fine", 1000)], [(-1, "end", "", end)], [(-2, "end", "", end)]],
        [[(3, 0.75, 100)], [(1, 0.5, 800), (1, 0.5, 800)], [(4, 0.25, 1000 + 7200)], [(-1, 0.0, end)], [(-2, 0.0, end)]],
    )
    score = 0.5 - got[1, "m"][1]
    assert got == {
        (1, "m"): (0.5, 0.5 - score), (1, "n"): (0.5, 0.5 - score), (3, "m"): (0.75, 0.75 - score),
        (2, "m"): (None, None), (4, "m"): (None, None),  # none, and one beyond the wait
    }


def test_open_windows_are_shown_and_updated(spark, tmp_path):
    path = str(tmp_path / "events")
    for k in range(3):
        rows = [(k * 600 + i, "m", float(k)) for i in range(10)]
        df = spark.createDataFrame(rows, "t long, model string, reward double").select(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("t")).alias("ts"), "model", "reward")
        df.coalesce(1).write.mode("append").parquet(path)
    stream = monitor.reward_monitor(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path))
    shown = monitor.run_updates(stream, "open", ["window_start", "window_end", "model"])
    batch = monitor.reward_monitor(spark.read.parquet(path))
    key = ["window_start", "window_end", "model", "n", "mean"]
    assert sorted(map(tuple, shown.select(key).collect())) == sorted(map(tuple, batch.select(key).collect()))
