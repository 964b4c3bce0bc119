"""Structured Streaming forms of the live accumulations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelens.functions.numeric import count_if, is_bad, sanitize
from scorelens.operators.scoring import batch_scorer_udf, scorer
from scorelens.storage import scratch_path


def reward_monitor(
    rewards: DataFrame, *, window: str = "1 hour", delay: str = "10 minutes", ts: str = "ts",
    model: str = "model", value: str = "reward",
) -> DataFrame:
    """Windowed mean, spread and count of bad rewards per model; the same code serves a stream or a table."""
    raw = F.col(value)
    clean = sanitize(raw)
    source = rewards.withWatermark(ts, delay) if rewards.isStreaming else rewards
    return (
        source.groupBy(F.window(ts, window).alias("w"), model)
        .agg(
            F.avg(clean).alias("mean"),
            F.stddev_samp(clean).alias("std"),
            count_if(is_bad(raw)).alias("bad_count"),
            F.count("*").alias("n"),
        )
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), model,
                "mean", "std", "bad_count", "n")
    )


def score_stream(
    generations: DataFrame,
    baseline: DataFrame,
    scorer_name: str = "lexical",
    *,
    keys: list[str] = ["prompt_id", "model"],
    text: str = "output",
    ts: str = "ts",
    delay: str = "10 minutes",
) -> DataFrame:
    """Score arriving generations once per (prompt, model) and subtract them from a static baseline score.

    Copies of a generation inside the watermark delay are dropped before scoring. An arrival without a baseline
    keeps its score and has a NULL delta. Batch scorers run in their Pandas UDF.
    """
    s = scorer(scorer_name)
    fresh = generations.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)
    labels = s.column(F.col(text)) if s.column is not None else batch_scorer_udf(s)(F.col(text))["labels"]
    scored = fresh.withColumn("score", F.coalesce(F.try_element_at(labels, F.lit(s.primary_label)), F.lit(0.0)))
    return scored.join(baseline.select("prompt_id", "base_value"), "prompt_id", "left").withColumn(
        "delta", F.col("base_value") - F.col("score")
    )


def score_stream_with_late_baseline(
    generations: DataFrame,
    baseline: DataFrame,
    scorer_name: str = "lexical",
    *,
    keys: list[str] = ["prompt_id", "model"],
    text: str = "output",
    ts: str = "ts",
    delay: str = "10 minutes",
    wait: str = "1 hour",
) -> DataFrame:
    """As ``score_stream``, with a stream of baseline scores (prompt_id, base_value, base_ts) in any order.

    A generation meets the baseline of its prompt whose time lies within ``wait`` before or after its own, whichever
    of the two arrives first. Once the watermark has passed that span it comes out with a NULL delta, and the state
    of both sides is dropped. Repeated baselines inside ``delay`` count once.
    """
    s = scorer(scorer_name)
    fresh = generations.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)
    labels = s.column(F.col(text)) if s.column is not None else batch_scorer_udf(s)(F.col(text))["labels"]
    scored = fresh.withColumn("score", F.coalesce(F.try_element_at(labels, F.lit(s.primary_label)), F.lit(0.0)))
    known = baseline.select(F.col("prompt_id").alias("_prompt"), "base_value", F.col("base_ts").alias("_base_ts"))
    known = known.withWatermark("_base_ts", delay).dropDuplicatesWithinWatermark(["_prompt"])
    span = F.expr(f"prompt_id = _prompt AND _base_ts BETWEEN {ts} - INTERVAL {wait} AND {ts} + INTERVAL {wait}")
    return scored.join(known, span, "left").drop("_prompt", "_base_ts").withColumn("delta", F.col("base_value") - F.col("score"))


def run_updates(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Process all available input in update mode and read the latest row of every key, open windows included.

    Every batch writes the keys it changed into its own folder; a batch that is run again replaces its folder.
    """
    spark = stream.sparkSession
    out = scratch_path(spark, name)

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    query = (
        stream.writeStream.outputMode("update")
        .option("checkpointLocation", scratch_path(spark, f"{name}-state"))
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)
    written = spark.read.schema(f"{kinds}, batch long").parquet(out)
    latest = written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_latest"))
    return latest.select(*keys, "_latest.*")


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Process all available input into a Parquet folder with its own checkpoint, and read the folder."""
    spark = stream.sparkSession
    out = scratch_path(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", scratch_path(spark, f"{name}-state"))
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
