"""Queries for readers and sinks (A): the tables are written in each format and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelens.operators import losses, metrics, pairing
from scorelens.operators.experiments import consistent_improvers, split_summary, with_improvement
from scorelens.plans import scenario as sc
from scorelens.plans.registry import query
from scorelens.plans.scenario import rounded, tidy, with_tables
from scorelens.sources import readers, writers
from scorelens.storage import scratch_path

_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


@query("a1_json_texts", """SELECT CASE WHEN doc_id % 3 = 0 THEN lang ELSE text END AS text, count(*) AS n FROM documents
  WHERE doc_id % 10 <> 9 GROUP BY 1""")
def a1(spark, d):
    """Records with text, records with output only, plain strings, and broken lines."""
    docs = sc.table(spark, d, "documents")
    line = (
        F.when(F.col("doc_id") % 10 == 9, F.lit('{"text": broken'))
        .when(F.col("doc_id") % 3 == 0, F.to_json(F.struct(F.col("lang").alias("output"))))
        .when(F.col("doc_id") % 3 == 1, F.to_json(F.struct(F.col("text"))))
        .otherwise(F.expr("substring(to_json(array(text)), 2, length(to_json(array(text))) - 2)"))
    )
    path = scratch_path(spark, "texts")
    docs.select(line.alias("value")).write.text(path)
    return readers.read_json_texts(spark, path).groupBy("text").agg(F.count("*").alias("n"))


@query("a1_json_array", "SELECT text, count(*) AS n FROM conversations GROUP BY ALL")
def a1_array(spark, d):
    """One JSON array of up to 64 turns of a conversation per line."""
    rows = sc.table(spark, d, "conversations")
    arrays = rows.groupBy("conv_id", F.expr("turn div 64").alias("part")).agg(
        F.to_json(F.collect_list(F.struct("text"))).alias("value")
    )
    path = scratch_path(spark, "arrays")
    arrays.select("value").write.text(path)
    read = readers.read_json_texts(spark, path, layout="array", whole_file=False)
    return read.groupBy("text").agg(F.count("*").alias("n"))


@query("a2_text_lines", f"""SELECT text, count(*) AS n FROM (SELECT {_STRIP.format('line')} AS text
  FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)) WHERE length(text) > 0 GROUP BY ALL""")
def a2(spark, d):
    path = scratch_path(spark, "lines")
    sc.table(spark, d, "documents").select("text").write.text(path)
    return readers.read_text_lines(spark, path).groupBy("text").agg(F.count("*").alias("n"))


@query("a3_csv_results", rounded("prompt_id output", "base_score", "SELECT doc_id AS prompt_id, text AS output, n_chars / 1000.0 AS base_score FROM documents"))
def a3(spark, d):
    path = scratch_path(spark, "csv")
    frame = sc.table(spark, d, "documents").select(
        F.col("doc_id").alias("prompt_id"), F.col("text").alias("output"), (F.col("n_chars") / 1000.0).alias("base_score"))
    writers.write_csv(frame, path)
    return tidy(readers.read_results_csv(spark, path, "prompt_id bigint, output string, base_score double"))


@query("a4_parquet", "SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ALL")
def a4(spark, d):
    docs = readers.read_parquet(spark, f"{d}/documents.parquet", ["lang", "source", "n_chars"])
    return docs.groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


_BY_MODEL = with_tables("primary_scores", rounded("model classifier n", "mean",
  "SELECT model, classifier, count(*) AS n, avg(score) AS mean FROM primary_scores WHERE text_type = 'output' GROUP BY ALL"))


@query("a5_records_by_model", _BY_MODEL)
def a5(spark, d):
    """JSON records in one folder per model, regrouped by the folder."""
    path = scratch_path(spark, "records")
    scores = sc.scores(spark, d, primary=True, text_types=["output"])
    writers.write_records(scores.select("prompt_id", "model", "classifier", "score"), path, partition_by=["model"])
    read = readers.read_records(spark, path, "prompt_id bigint, classifier string, score double, model string")
    return tidy(read.groupBy("model", "classifier").agg(F.count("*").alias("n"), F.avg("score").alias("mean")))


@query("a6_text_column", "SELECT doc_id, text FROM documents UNION ALL SELECT -1 - page_id, coalesce(html, '') FROM pages")
def a6(spark, d):
    docs = readers.resolve_text(sc.table(spark, d, "documents").withColumnRenamed("text", "output"))
    pages = sc.table(spark, d, "pages").select((-1 - F.col("page_id")).alias("doc_id"), F.col("html").alias("output"))
    fallback = pages.withColumn("text", readers.first_text(pages, "text", "output"))
    return docs.select("doc_id", "text").unionByName(fallback.select("doc_id", "text"))


_MAP_ROUND_TRIP = with_tables("label_scores", rounded("prompt_id model classifier label", "score",
  "SELECT prompt_id, model, classifier, label, score FROM label_scores WHERE text_type = 'output'"))


def outputs(spark, d):
    return sc.classifications(spark, d, text_types=["output"]).select("prompt_id", "model", "classifier", "labels")


@query("a7_csv_map_columns", _MAP_ROUND_TRIP)
def a7(spark, d):
    from scorelens.functions.labels import parse_label_map
    from scorelens.operators.reshape import explode_labels

    path = scratch_path(spark, "maps")
    writers.write_csv(outputs(spark, d), path, partition_by=["model"])
    read = readers.read_results_csv(spark, path, "prompt_id bigint, classifier string, labels string, model string")
    return tidy(explode_labels(read.withColumn("labels", parse_label_map(F.col("labels")))).select("prompt_id", "model", "classifier", "label", "score"))


@query("a8_json_records", _MAP_ROUND_TRIP)
def a8(spark, d):
    from scorelens.operators.reshape import explode_labels

    path = scratch_path(spark, "json")
    writers.write_records(outputs(spark, d), path, partition_by=["model"])
    read = readers.read_records(spark, path, "prompt_id bigint, classifier string, labels map<string,double>, model string")
    return tidy(explode_labels(read).select("prompt_id", "model", "classifier", "label", "score"))


@query("a8_metric_tree", with_tables("primary_scores", rounded("model classifier n", "mean",
  "SELECT model, classifier, count(*) AS n, avg(score) AS mean FROM primary_scores WHERE text_type = 'output' GROUP BY ALL")))
def a8_tree(spark, d):
    scores = sc.scores(spark, d, primary=True, text_types=["output"])
    stats = scores.groupBy("model", "classifier").agg(F.count("*").alias("n"), F.avg("score").alias("mean"))
    path = scratch_path(spark, "trees")
    writers.metric_tree(stats, ["model", "classifier"]).write.json(path)
    read = spark.read.schema("model string, classifier string, tree string").json(path)
    tree = F.from_json("tree", "n bigint, mean double")
    return tidy(read.select("model", "classifier", tree["n"].alias("n"), tree["mean"].alias("mean")))


@query("a9_dataset_cache", "SELECT doc_id, text FROM documents")
def a9(spark, d):
    folder = scratch_path(spark, "cache")

    def build():
        return sc.table(spark, d, "documents").select("doc_id", "text")

    readers.cached(spark, folder, "texts", build)
    return readers.cached(spark, folder, "texts", lambda: spark.createDataFrame([], "doc_id bigint, text string"))


@query("a10_row_index", "SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS sample_index FROM lineitem")
def a10(spark, d):
    lines = sc.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return pairing.assign_index(lines, order).select("l_orderkey", "l_linenumber", "l_partkey", "sample_index")


@query("a11_pairs_sink", with_tables("reward_pairs", rounded("sample_id model_id", "original detoxified", "SELECT * FROM reward_pairs")))
def a11(spark, d):
    pairs = losses.pair_sides(sc.rewards(spark, d), ["sample_id", "model_id"])
    csv, records = scratch_path(spark, "pairs"), scratch_path(spark, "pairs")
    even = F.col("sample_id") % 2 == 0
    writers.write_pairs(pairs.where(even), csv)
    writers.write_pairs(pairs.where(~even), records, fmt="json")
    schema = "sample_id bigint, model_id string, original double, detoxified double"
    return tidy(readers.read_results_csv(spark, csv, schema).unionByName(readers.read_records(spark, records, schema)))


@query("a12_flat_metrics", with_tables("rewards doc_split", rounded("model_id", "train_avg_original train_avg_detoxified test_avg_original test_avg_detoxified", """
  SELECT model_id, """ + ", ".join(f"avg(reward) FILTER (split = '{s}' AND side = '{x}') AS {s}_avg_{x}" for s in ("train", "test") for x in ("original", "detoxified")) +
  " FROM rewards JOIN doc_split USING (sample_id) GROUP BY model_id")))
def a12(spark, d):
    rows = pairing.split_by_hash(sc.rewards(spark, d).drop("true_reward"), "sample_id", 0.8)
    means = metrics.reward_means(rows, ["model_id", "split"])
    path = scratch_path(spark, "flat")
    names = ["avg_original", "avg_detoxified"]
    writers.write_flat_metrics(means, path, ["model_id"], ["train", "test"], names)
    schema = "model_id string, " + ", ".join(f"{s}_{m} double" for s in ("train", "test") for m in names)
    return tidy(readers.read_results_csv(spark, path, schema))


@query("a13_generations_per_epoch", with_tables("tracking", rounded("epoch n", "toxicity", """SELECT epoch::INTEGER AS epoch, count(*) AS n, avg(raw_toxicity) AS toxicity
  FROM tracking WHERE try_cast(epoch AS INTEGER) IS NOT NULL GROUP BY 1""")))
def a13(spark, d):
    rows = sc.tracking(spark, d).where(F.col("epoch").try_cast("int").isNotNull()).select(
        "epoch", F.col("prompt_idx").cast("string").alias("query"), F.col("epoch").alias("response"), F.col("raw_toxicity").alias("toxicity"))
    path = scratch_path(spark, "generations")
    writers.write_generations(rows, path)
    read = readers.read_records(spark, path, "query string, response string, toxicity double, epoch int")
    return tidy(read.groupBy("epoch").agg(F.count("*").alias("n"), F.avg("toxicity").alias("toxicity")))


@query("a14_experiment_results", with_tables("samples", rounded("family experiment split n", "mean", """
  SELECT 'samples' AS family, experiment, split, count(*) AS n, avg(improvement) AS mean FROM samples GROUP BY ALL
  UNION ALL SELECT 'summary', experiment, split, count(*), avg(improvement) FROM samples GROUP BY ALL
  UNION ALL SELECT 'improvers', experiment, 'all', count(*), avg(improvement) FROM samples WHERE split = 'test' AND sample_id IN (
    SELECT sample_id FROM samples WHERE split = 'test' GROUP BY sample_id HAVING avg((improvement > 0)::INT) >= 0.75) GROUP BY ALL""")))
def a14(spark, d):
    samples = with_improvement(sc.samples(spark, d))
    path = scratch_path(spark, "results")
    writers.write_experiment_results(path, {
        "samples": samples,
        "summary": split_summary(samples),
        "improvers": consistent_improvers(samples.where("split = 'test'"), []),
    })
    rows = readers.read_records(spark, f"{path}/samples", "improvement double, experiment string, split string")
    means = rows.groupBy("experiment", "split").agg(F.count("*").alias("n"), F.avg("improvement").alias("mean"))
    summary = readers.read_records(spark, f"{path}/summary", "total_samples bigint, mean_improvement double, experiment string, split string")
    improvers = readers.read_records(spark, f"{path}/improvers", "improvements map<string,double>")
    improvers = improvers.select(F.explode("improvements").alias("experiment", "v")).groupBy("experiment").agg(F.count("*").alias("n"), F.avg("v").alias("mean"))
    return tidy(
        means.select(F.lit("samples").alias("family"), "experiment", "split", "n", "mean")
        .unionByName(summary.select(F.lit("summary").alias("family"), "experiment", "split", F.col("total_samples").alias("n"), F.col("mean_improvement").alias("mean")))
        .unionByName(improvers.select(F.lit("improvers").alias("family"), "experiment", F.lit("all").alias("split"), "n", "mean"))
    )
