"""Queries for descriptive statistics (G) and deltas (H)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelens.functions.text import epoch_of
from scorelens.operators import delta, describe, reshape
from scorelens.operators.scoring import score_variants
from scorelens.plans import scenario as sc
from scorelens.plans.registry import query
from scorelens.plans.scenario import rounded, tidy, with_tables
from scorelens.storage import materialize

SERIES = ["model", "text_type", "classifier", "label"]


def primary(spark, d, text_types=["output"]):
    return sc.scores(spark, d, primary=True, text_types=text_types)


def paired(spark, d, primary_only=True, text_types=["output", "full_text"]):
    scores = sc.scores(spark, d, primary=primary_only, text_types=text_types)
    return delta.with_baseline(scores)


def deltas(spark, d, primary_only=True, text_types=["output"]):
    scores = sc.scores(spark, d, primary=primary_only, text_types=text_types)
    return delta.baseline_delta(scores, text_types=tuple(text_types))


_STATS = "n::BIGINT AS n, mean, std, min, max"


@query("g1_basic_statistics", with_tables("scores", rounded("model text_type classifier label n", "mean std min max median", """
  SELECT model, text_type, classifier, label, count(*) AS n, avg(score) AS mean, stddev_pop(score) AS std, min(score) AS min,
    max(score) AS max, quantile_cont(score, 0.5) AS median FROM scores GROUP BY ALL""")))
def g1(spark, d):
    return tidy(describe.describe(sc.scores(spark, d), SERIES, percentiles={"median": 0.5}))


_SKEW = "coalesce((avg(x*x*x) - 3*avg(x)*avg(x*x) + 2*avg(x)*avg(x)*avg(x)) / nullif(power(stddev_pop(x), 3), 0), 0)"


def moments(x: str) -> str:
    return f"""(avg(({x})^3) - 3*avg({x})*avg(({x})^2) + 2*avg({x})^3) / nullif(stddev_pop({x})^3, 0)"""


@query("g2_distribution_statistics", with_tables("primary_scores", rounded("model text_type classifier", "p25 p50 p75 p95 skewness kurtosis", f"""
  SELECT model, text_type, classifier, quantile_cont(score, 0.25) AS p25, quantile_cont(score, 0.5) AS p50, quantile_cont(score, 0.75) AS p75,
    quantile_cont(score, 0.95) AS p95, {moments('score')} AS skewness, kurtosis_pop(score) AS kurtosis FROM primary_scores GROUP BY ALL""")))
def g2(spark, d):
    by = ["model", "text_type", "classifier"]
    stats = describe.describe(primary(spark, d, sc.TEXT_TYPES), by, percentiles=describe.DISTRIBUTION, shape=True)
    return tidy(stats.drop("n", "mean", "std", "min", "max"))


@query("g2_lineitem_percentiles", rounded("l_returnflag l_linestatus", "p25 p50 p75 p95 skewness kurtosis", f"""
  SELECT l_returnflag, l_linestatus, quantile_cont(l_extendedprice, 0.25) AS p25, quantile_cont(l_extendedprice, 0.5) AS p50,
    quantile_cont(l_extendedprice, 0.75) AS p75, quantile_cont(l_extendedprice, 0.95) AS p95,
    {moments('l_extendedprice')} AS skewness, kurtosis_pop(l_extendedprice) AS kurtosis FROM lineitem GROUP BY ALL"""))
def g2_lineitem(spark, d):
    stats = describe.describe(sc.table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice",
                              percentiles=describe.DISTRIBUTION, shape=True)
    return tidy(stats.drop("n", "mean", "std", "min", "max"))


_RATES = """avg((score > 0.7)::INT) AS high_rate, avg((score > 0.4)::INT) AS medium_rate, avg((score > 0.1)::INT) AS low_rate,
  count(*) FILTER (score > 0.7) AS high_count, count(*) FILTER (score > 0.4) AS medium_count, count(*) FILTER (score > 0.1) AS low_count"""


@query("g3_threshold_rates", with_tables("scores", rounded("model text_type classifier label high_count medium_count low_count", "high_rate medium_rate low_rate",
  f"SELECT model, text_type, classifier, label, {_RATES} FROM scores GROUP BY ALL")))
def g3(spark, d):
    return tidy(sc.scores(spark, d).groupBy(*SERIES).agg(*describe.threshold_aggregates("score")))


@query("g4_empty_groups", with_tables("primary_scores", rounded("model classifier n", "mean std min max", """
  SELECT m.model, c.classifier, coalesce(n, 0) AS n, coalesce(mean, 0) AS mean, coalesce(std, 0) AS std, coalesce(min, 0) AS min, coalesce(max, 0) AS max
  FROM (SELECT DISTINCT model FROM primary_scores) m CROSS JOIN (SELECT DISTINCT classifier FROM primary_scores) c
  LEFT JOIN (SELECT model, classifier, count(*) AS n, avg(score) AS mean, stddev_pop(score) AS std, min(score) AS min, max(score) AS max
    FROM primary_scores WHERE text_type = 'output' AND NOT (model = 'base' AND classifier = 'toxic_bert') GROUP BY ALL) s
  ON s.model = m.model AND s.classifier = c.classifier""")))
def g4(spark, d):
    scores = primary(spark, d).where("not (model = 'base' and classifier = 'toxic_bert')")
    expected = spark.createDataFrame([(m[0], c) for m in sc.MODELS for c in sc.CLASSIFIERS], "model string, classifier string")
    by = ["model", "classifier"]
    return tidy(describe.with_missing_groups(describe.describe(scores, by), expected, by))


_POOL = f"count(*) AS n, avg(score) AS mean, stddev_pop(score) AS std, min(score) AS min, max(score) AS max, {_RATES}"
_POOL_NUMBERS = "mean std min max high_rate medium_rate low_rate"
_POOL_KEYS = "n high_count medium_count low_count"


@query("g5_model_metrics", with_tables("scores", rounded(f"model classifier {_POOL_KEYS}", _POOL_NUMBERS, f"""
  SELECT model, classifier, {_POOL} FROM scores WHERE text_type = 'output' GROUP BY GROUPING SETS ((model), (model, classifier))""")))
def g5(spark, d):
    return tidy(describe.pooled_metrics(sc.scores(spark, d, text_types=["output"]), "model", "classifier"))


@query("g6_classifier_metrics", with_tables("scores", rounded(f"model classifier {_POOL_KEYS}", _POOL_NUMBERS, f"""
  SELECT model, classifier, {_POOL} FROM scores WHERE text_type = 'output' GROUP BY GROUPING SETS ((classifier), (classifier, model))""")))
def g6(spark, d):
    return tidy(describe.pooled_metrics(sc.scores(spark, d, text_types=["output"]), "classifier", "model"))


@query("g7_summary_table", with_tables("scores", rounded(f"model classifier {_POOL_KEYS}", _POOL_NUMBERS + " median p25 p50 p75 p95 skewness kurtosis", f"""
  SELECT model, classifier, {_POOL}, quantile_cont(score, 0.5) AS median, quantile_cont(score, 0.25) AS p25, quantile_cont(score, 0.5) AS p50,
  quantile_cont(score, 0.75) AS p75, quantile_cont(score, 0.95) AS p95, {moments('score')} AS skewness, kurtosis_pop(score) AS kurtosis
  FROM scores WHERE text_type = 'output' GROUP BY ALL""")))
def g7(spark, d):
    return tidy(describe.summary_table(sc.scores(spark, d, text_types=["output"]), ["model", "classifier"]))


_LINE_SUMMARY = _RATES.replace("score >", "l_discount * 10 >")


@query("g7_lineitem_summary", rounded(f"l_returnflag l_linestatus {_POOL_KEYS}", _POOL_NUMBERS + " median p25 p50 p75 p95 skewness kurtosis", f"""
  SELECT l_returnflag, l_linestatus, {_POOL}, quantile_cont(score, 0.5) AS median, quantile_cont(score, 0.25) AS p25, quantile_cont(score, 0.5) AS p50,
  quantile_cont(score, 0.75) AS p75, quantile_cont(score, 0.95) AS p95, {moments('score')} AS skewness, kurtosis_pop(score) AS kurtosis
  FROM (SELECT l_returnflag, l_linestatus, l_extendedprice / 110000::DOUBLE AS score FROM lineitem) GROUP BY ALL"""))
def g7_lineitem(spark, d):
    scores = sc.table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", (F.col("l_extendedprice") / 110000.0).alias("score"))
    return tidy(describe.summary_table(scores, ["l_returnflag", "l_linestatus"]))


_LABEL_STATS = """SELECT model, classifier, text_type, label, count(*) AS n, avg(score) AS mean, stddev_pop(score) AS std,
  min(score) AS min, max(score) AS max FROM filled GROUP BY ALL"""


@query("g8_label_map_summary", with_tables("filled", rounded("model classifier text_type label n", "mean std min max", _LABEL_STATS)))
def g8(spark, d):
    return tidy(describe.label_map_summary(sc.classifications(spark, d)))


@query("g9_two_model_comparison", with_tables("filled", rounded("classifier text_type label", "base_mean model_mean improvement improvement_percent", f"""
  SELECT classifier, text_type, label, b.mean AS base_mean, m.mean AS model_mean, b.mean - m.mean AS improvement,
    CASE WHEN b.mean > 0 THEN 100.0 * (b.mean - m.mean) / b.mean ELSE 0.0 END AS improvement_percent
  FROM (SELECT * FROM ({_LABEL_STATS}) WHERE model = 'base') b JOIN (SELECT * FROM ({_LABEL_STATS}) WHERE model = 'detox_epoch_100') m
  USING (classifier, text_type, label)""")))
def g9(spark, d):
    summary = describe.label_map_summary(sc.classifications(spark, d))
    return tidy(describe.compare_two_models(summary, "detox_epoch_100"))


@query("g10_column_basic_metrics", with_tables("scores", rounded("model classifier label n", "mean std min max median", """
  SELECT model, classifier, label, count(score) AS n, avg(score) AS mean, stddev_samp(score) AS std, min(score) AS min, max(score) AS max,
    quantile_cont(score, 0.5) AS median FROM (SELECT * REPLACE (CASE WHEN prompt_id % 7 <> 0 THEN score END AS score) FROM scores)
    WHERE text_type = 'output' GROUP BY ALL""")))
def g10(spark, d):
    scores = sc.scores(spark, d, text_types=["output"]).withColumn("score", F.when(F.col("prompt_id") % 7 != 0, F.col("score")))
    return tidy(describe.describe(scores, ["model", "classifier", "label"], ddof=1, percentiles={"median": 0.5}))


@query("g11_column_delta_metrics", with_tables("paired", rounded("model classifier label positive negative total", "mean std positive_rate", """
  SELECT model, classifier, label, avg(delta) AS mean, stddev_samp(delta) AS std, count(*) FILTER (delta > 0.01) AS positive,
    count(*) FILTER (delta < -0.01) AS negative, count(delta) AS total, avg((delta > 0.01)::INT) AS positive_rate
  FROM paired WHERE text_type = 'output' GROUP BY ALL""")))
def g11(spark, d):
    return tidy(describe.delta_metrics(deltas(spark, d, False), ["model", "classifier", "label"]))


@query("g12_inventory", with_tables("scores", """SELECT count(DISTINCT prompt_id) AS prompts, count(DISTINCT model) AS models,
  count(DISTINCT classifier) AS classifiers, count(DISTINCT (classifier, label)) AS series, count(*) AS rows FROM scores"""))
def g12(spark, d):
    return describe.inventory(sc.scores(spark, d))


@query("g13_dataset_analysis", rounded("lang total_samples empty_count length_min length_max", "empty_percent length_avg length_std", """
  SELECT lang, count(*) AS total_samples, count(*) FILTER (length(t) = 0) AS empty_count, 100.0 * avg((length(t) = 0)::INT) AS empty_percent,
    avg(length(t)) AS length_avg, min(length(t)) AS length_min, max(length(t)) AS length_max, stddev_pop(length(t)) AS length_std
  FROM (SELECT lang, CASE WHEN doc_id % 13 = 0 THEN '' ELSE text END AS t FROM documents) GROUP BY ALL"""))
def g13(spark, d):
    docs = sc.table(spark, d, "documents").select(
        "lang", F.when(F.col("doc_id") % 13 == 0, F.lit("")).otherwise(F.col("text")).alias("output"))
    return tidy(describe.dataset_analysis(docs, ["lang"]))


@query("g14_model_quartiles", with_tables("rewards", rounded("model_id n", "mean std min max q1 median q3", """
  SELECT model_id, count(*) AS n, avg(reward) AS mean, stddev_samp(reward) AS std, min(reward) AS min, max(reward) AS max,
    quantile_cont(reward, 0.25) AS q1, quantile_cont(reward, 0.5) AS median, quantile_cont(reward, 0.75) AS q3 FROM rewards GROUP BY ALL""")))
def g14(spark, d):
    return tidy(describe.describe(sc.rewards(spark, d), ["model_id"], "reward", ddof=1, percentiles=describe.QUARTILES))


_IS_PRIMARY = "label = CASE classifier WHEN 'dynabench_hate' THEN 'hate' ELSE 'toxic' END"


@query("g15_primary_metrics", with_tables("scores", rounded("model classifier text_type n", "mean std min max", f"""
  SELECT model, classifier, text_type, count(*) AS n, avg(s) AS mean, stddev_pop(s) AS std, min(s) AS min, max(s) AS max
  FROM (SELECT *, CASE WHEN prompt_id % 11 = 0 THEN 0.0 ELSE score END AS s FROM scores WHERE {_IS_PRIMARY}) GROUP BY ALL""")))
def g15(spark, d):
    return tidy(describe.primary_metrics(sc.classifications(spark, d)))


@query("g16_category_metrics", with_tables("filled", rounded("model classifier label n", "mean std min max",
  f"SELECT * EXCLUDE (text_type) FROM ({_LABEL_STATS}) WHERE text_type = 'output'")))
def g16(spark, d):
    outputs = sc.classifications(spark, d, text_types=["output"])
    return tidy(describe.label_map_summary(outputs, ["model", "classifier"]))


@query("g17_epoch_statistics", with_tables("tracking", rounded("epoch", " ".join(f"{v}_{s}" for v in ("raw_toxicity", "softmax_toxicity") for s in ("mean", "std", "min", "max")), """
  SELECT try_cast(epoch AS INTEGER) AS epoch, """ + ", ".join(
    f"avg({v}) AS {v}_mean, stddev_samp({v}) AS {v}_std, min({v}) AS {v}_min, max({v}) AS {v}_max" for v in ("raw_toxicity", "softmax_toxicity")) +
  " FROM tracking WHERE try_cast(epoch AS INTEGER) IS NOT NULL GROUP BY 1")))
def g17(spark, d):
    return tidy(describe.epoch_statistics(sc.tracking(spark, d)))


@query("g18_batch_reward_stats", with_tables("reward_events", rounded("epoch model bad_count n", "mean std", """
  SELECT epoch, model, avg(clean) AS mean, stddev_samp(clean) AS std, count(*) FILTER (bad) AS bad_count, count(*) AS n FROM reward_events GROUP BY epoch, model""")))
def g18(spark, d):
    return tidy(describe.reward_batch_stats(sc.reward_events(spark, d), ["epoch", "model"]))


@query("g19_average_eval_toxicity", with_tables("primary_scores", rounded("epoch classifier", "mean_toxicity",
  "SELECT epoch, classifier, avg(score) AS mean_toxicity FROM primary_scores WHERE text_type = 'output' GROUP BY epoch, classifier")))
def g19(spark, d):
    return tidy(primary(spark, d).groupBy("epoch", "classifier").agg(F.avg("score").alias("mean_toxicity")))


@query("g20_score_column_profile", with_tables("primary_scores", rounded("text_type model classifier", "mean std", """
  SELECT text_type, CASE WHEN text_type = 'prompt' THEN 'prompt' ELSE model END AS model, classifier, avg(score) AS mean, stddev_samp(score) AS std
  FROM primary_scores WHERE text_type <> 'prompt' OR model = 'base' GROUP BY ALL""")))
def g20(spark, d):
    long = reshape.to_long(wide_scores(spark, d), ["prompt_id"], sc.CLASSIFIERS)
    return tidy(long.groupBy("text_type", "model", "classifier").agg(F.avg("score").alias("mean"), F.stddev_samp("score").alias("std")))


def wide_scores(spark, d) -> DataFrame:
    """Wide frame with output_, full_ and prompt_ score columns."""
    scores = primary(spark, d, sc.TEXT_TYPES).where("text_type <> 'prompt' or model = 'base'")
    name = (
        F.when(F.col("text_type") == "prompt", F.concat_ws("_", F.lit("prompt"), "classifier", F.lit("score")))
        .when(F.col("text_type") == "output", F.concat_ws("_", F.lit("output"), "model", "classifier", F.lit("score")))
        .otherwise(F.concat_ws("_", F.lit("full"), "model", "classifier", F.lit("score")))
    )
    names = [f"prompt_{c}_score" for c in sc.CLASSIFIERS] + [
        f"{p}_{m[0]}_{c}_score" for p in ("output", "full") for m in sc.MODELS for c in sc.CLASSIFIERS
    ]
    return reshape.to_wide(scores.withColumn("name", name), ["prompt_id"], names)


# ---- deltas --------------------------------------------------------------------------------------------------

@query("h1_deltas", with_tables("paired", rounded("prompt_id name text_type", "delta", """
  SELECT prompt_id, text_type, 'delta_' || model || '_vs_base_' || classifier || '_' || label AS name, delta FROM paired""")))
def h1(spark, d):
    rows = deltas(spark, d, False, ["output", "full_text"])
    name = delta.delta_name(F.col("model"), F.concat_ws("_", "classifier", "label"))
    return tidy(rows.select("prompt_id", "text_type", name.alias("name"), "delta"))


_IMPROVEMENT = f"""count(*) AS n, avg(delta) AS mean, stddev_pop(delta) AS std, min(delta) AS min, max(delta) AS max,
  count(*) FILTER (delta > 0.05) AS improved, count(*) FILTER (delta < -0.05) AS regressed, count(*) FILTER (abs(delta) <= 0.05) AS neutral,
  avg((delta > 0.05)::INT) AS improved_rate, avg((delta < -0.05)::INT) AS regressed_rate, avg((abs(delta) <= 0.05)::INT) AS neutral_rate,
  CASE WHEN count(*) < 3 THEN 0.0 ELSE coalesce({moments('delta')}, 0.0) END AS skewness,
  CASE WHEN stddev_pop(delta) > 0 THEN avg(delta) / stddev_pop(delta) ELSE 0.0 END AS effect_size,
  quantile_cont(delta, 0.5) AS median, quantile_cont(delta, 0.25) AS p25, quantile_cont(delta, 0.75) AS p75"""
_IMPROVEMENT_NUMBERS = "mean std min max improved_rate regressed_rate neutral_rate skewness effect_size median p25 p75"


@query("h2_improvement_stats", with_tables("primary_paired", rounded("model classifier n improved regressed neutral", _IMPROVEMENT_NUMBERS, f"""
  SELECT model, classifier, {_IMPROVEMENT} FROM primary_paired WHERE text_type = 'output' GROUP BY ALL""")))
def h2(spark, d):
    """The deltas are written once, since exact quartiles read them twice."""
    rows = materialize(deltas(spark, d).select("model", "classifier", "delta"), "deltas")
    return tidy(delta.improvement_stats(rows, ["model", "classifier"]))


@query("h3_skewness", with_tables("paired", rounded("model classifier label text_type", "skewness", f"""
  SELECT model, classifier, label, text_type, CASE WHEN count(*) < 3 THEN 0.0 ELSE coalesce({moments('delta')}, 0.0) END AS skewness FROM paired GROUP BY ALL""")))
def h3(spark, d):
    rows = deltas(spark, d, False, ["output", "full_text"])
    return tidy(describe.skewness_of(rows, ["model", "classifier", "label", "text_type"]))


@query("h4_comparison", with_tables("paired", rounded("model text_type classifier label improved regressed", "base_mean model_mean mean_improvement std_difference improved_rate regressed_rate", """
  SELECT model, text_type, classifier, label, avg(base_value) AS base_mean, avg(score) AS model_mean, avg(base_value) - avg(score) AS mean_improvement,
    stddev_pop(base_value) - stddev_pop(score) AS std_difference, count(*) FILTER (score < base_value) AS improved,
    count(*) FILTER (score > base_value) AS regressed, avg((score < base_value)::INT) AS improved_rate, avg((score > base_value)::INT) AS regressed_rate
  FROM paired GROUP BY ALL""")))
def h4(spark, d):
    return tidy(delta.comparison(paired(spark, d, False), SERIES))


@query("h5_summary", with_tables("paired", rounded("models comparisons best_model worst_model", "improvement_rate mean_improvement", """
  WITH m AS (SELECT model, avg(delta) AS mean, count(DISTINCT (classifier, label, text_type)) AS c FROM paired GROUP BY model)
  SELECT (SELECT count(*) FROM m) AS models, (SELECT sum(c)::BIGINT FROM m) AS comparisons,
    (SELECT model FROM m ORDER BY mean DESC, model LIMIT 1) AS best_model, (SELECT model FROM m ORDER BY mean, model LIMIT 1) AS worst_model,
    avg((delta > 0.05)::INT) AS improvement_rate, avg(delta) AS mean_improvement FROM paired""")))
def h5(spark, d):
    return tidy(delta.summary(deltas(spark, d, False, ["output", "full_text"])))


@query("h6_category_analysis", with_tables("paired", rounded("model label improved worse", "base_mean model_mean base_std model_std improvement", """
  SELECT model, label, avg(base_value) AS base_mean, avg(score) AS model_mean, stddev_samp(base_value) AS base_std, stddev_samp(score) AS model_std,
    avg(delta) AS improvement, count(*) FILTER (delta > 0.05) AS improved, count(*) FILTER (delta < -0.05) AS worse
  FROM paired WHERE text_type = 'output' AND classifier = 'toxic_bert' GROUP BY ALL""")))
def h6(spark, d):
    rows = paired(spark, d, False, ["output"]).where("classifier = 'toxic_bert'")
    return tidy(delta.category_analysis(rows, ["model", "label"]))


@query("h7_cross_classifier", with_tables("primary_paired", rounded("model classifier base_high model_high high_reduction", "base_mean model_mean improvement", """
  SELECT model, classifier, avg(base_value) AS base_mean, avg(score) AS model_mean, avg(base_value) - avg(score) AS improvement,
    count(*) FILTER (base_value > 0.7) AS base_high, count(*) FILTER (score > 0.7) AS model_high,
    count(*) FILTER (base_value > 0.7) - count(*) FILTER (score > 0.7) AS high_reduction
  FROM primary_paired WHERE text_type = 'output' GROUP BY ALL""")))
def h7(spark, d):
    return tidy(delta.high_score_comparison(paired(spark, d, text_types=["output"]), ["model", "classifier"]))


@query("h8_change_counts", with_tables("primary_paired", rounded("model classifier n improved regressed", "improved_percent regressed_percent mean", """
  SELECT model, classifier, count(*) AS n, count(*) FILTER (delta > 0.05) AS improved, count(*) FILTER (delta < -0.05) AS regressed,
    100.0 * avg((delta > 0.05)::INT) AS improved_percent, 100.0 * avg((delta < -0.05)::INT) AS regressed_percent, avg(delta) AS mean
  FROM primary_paired WHERE text_type = 'output' GROUP BY ALL""")))
def h8(spark, d):
    return tidy(delta.change_counts(deltas(spark, d), ["model", "classifier"]))


_FAMILY = """count(*) AS n, avg(delta) AS mean, stddev_samp(delta) AS std, stddev_pop(delta) AS std_pop, count(*) FILTER (delta > 0.01) AS improved,
  count(*) FILTER (delta < -0.01) AS regressed, avg((delta > 0.01)::INT) AS improved_rate FROM paired WHERE text_type = 'output'"""
_FAMILY_KEYS, _FAMILY_NUMBERS = "family name n improved regressed", "mean std std_pop improved_rate"


@query("h9_model_summary", with_tables("paired", rounded(_FAMILY_KEYS, _FAMILY_NUMBERS, f"""
  SELECT 'model' AS family, model AS name, {_FAMILY} GROUP BY model UNION ALL SELECT 'classifier', classifier, {_FAMILY} GROUP BY classifier
  UNION ALL SELECT 'label', label, {_FAMILY} GROUP BY label""")))
def h9(spark, d):
    rows = deltas(spark, d, False)
    return tidy(delta.grouped_improvement(rows, {"model": ["model"], "classifier": ["classifier"], "label": ["label"]}))


@query("h9_best_members", with_tables("paired", f"""
  WITH g AS (SELECT 'model' AS family, model AS name, {_FAMILY} GROUP BY model UNION ALL SELECT 'label', label, {_FAMILY} GROUP BY label)
  SELECT family, arg_min(name, (-mean, name)) AS best, arg_min(name, (std, name)) AS most_consistent FROM g GROUP BY family"""))
def h9_best(spark, d):
    """The groups are written once, since both families read them."""
    grouped = materialize(delta.grouped_improvement(deltas(spark, d, False), {"model": ["model"], "label": ["label"]}), "grouped")
    return delta.best_of(grouped, "model").unionByName(delta.best_of(grouped, "label"))


@query("h10_statistical_summary", with_tables("paired", rounded(_FAMILY_KEYS, _FAMILY_NUMBERS, f"""
  SELECT 'series' AS family, classifier || '/' || model AS name, {_FAMILY} GROUP BY ALL UNION ALL SELECT 'overall', 'all', {_FAMILY}""")))
def h10(spark, d):
    return tidy(delta.grouped_improvement(deltas(spark, d, False), {"series": ["model", "classifier"], "overall": []}))


@query("h11_confidence_interval", with_tables("primary_paired", rounded("model classifier n", "mean ci_low ci_high", """
  SELECT model, classifier, count(*) AS n, avg(delta) AS mean, avg(delta) - 1.96 * stddev_samp(delta) / sqrt(count(*)) AS ci_low,
    avg(delta) + 1.96 * stddev_samp(delta) / sqrt(count(*)) AS ci_high FROM primary_paired WHERE text_type = 'output' GROUP BY ALL""")))
def h11(spark, d):
    return tidy(delta.confidence_interval(deltas(spark, d), ["model", "classifier"]))


_EPOCHS = "SELECT classifier, epoch, avg(delta) AS mean, stddev_samp(delta) AS std, count(*) FILTER (delta > 0.01) AS positive, count(*) AS n FROM primary_paired WHERE text_type = 'output' GROUP BY ALL"


def epoch_points(spark, d):
    rows = deltas(spark, d).drop("epoch").withColumn("epoch", epoch_of(F.col("model")))
    return delta.progression(rows, ["classifier"])


@query("h12_epoch_progression", with_tables("primary_paired", rounded("classifier epoch positive n", "mean std", _EPOCHS)))
def h12(spark, d):
    return tidy(epoch_points(spark, d))


@query("h13_total_reduction", with_tables("primary_scores", rounded("classifier", "first_mean last_mean reduction reduction_percent", """
  SELECT classifier, f AS first_mean, l AS last_mean, f - l AS reduction, CASE WHEN f > 0 THEN 100.0 * (f - l) / f ELSE 0.0 END AS reduction_percent
  FROM (SELECT classifier, avg(score) FILTER (epoch = 0) AS f, avg(score) FILTER (epoch = 100) AS l FROM primary_scores WHERE text_type = 'output' GROUP BY classifier)""")))
def h13(spark, d):
    means = primary(spark, d).groupBy("classifier", "epoch").agg(F.avg("score").alias("mean"))
    return tidy(delta.total_reduction(means, ["classifier"]))


@query("h14_overall_ranking", with_tables("primary_paired", rounded("model classifiers", "overall", """
  SELECT model, avg(mean) AS overall, count(*) AS classifiers FROM (SELECT model, classifier, avg(delta) AS mean FROM primary_paired
  WHERE text_type = 'output' GROUP BY ALL) GROUP BY model""")))
def h14(spark, d):
    return tidy(delta.overall_ranking(deltas(spark, d)))


def reward_pairs(spark, d):
    from scorelens.operators.losses import pair_sides

    return pair_sides(sc.rewards(spark, d), ["sample_id", "model_id"])


@query("h15_pair_difference", with_tables("reward_pairs", rounded("model_id", "mean_difference std_difference percent_improved effect_size median_difference", """
  SELECT model_id, avg(d) AS mean_difference, stddev_pop(d) AS std_difference, 100.0 * avg((d > 0)::INT) AS percent_improved,
    avg(d) / stddev_pop(d) AS effect_size, quantile_cont(d, 0.5) AS median_difference
  FROM (SELECT model_id, detoxified - original AS d FROM reward_pairs) GROUP BY ALL""")))
def h15(spark, d):
    return tidy(delta.pair_difference(reward_pairs(spark, d), ["model_id"]))


@query("h16_side_comparison", with_tables("reward_pairs", rounded("model_id", "original_mean modified_mean original_std modified_std mean_difference win_rate", """
  SELECT model_id, avg(original) AS original_mean, avg(detoxified) AS modified_mean, stddev_pop(original) AS original_std, stddev_pop(detoxified) AS modified_std,
    avg(detoxified) - avg(original) AS mean_difference, avg((detoxified > original)::INT) AS win_rate FROM reward_pairs GROUP BY ALL""")))
def h16(spark, d):
    return tidy(delta.side_comparison(reward_pairs(spark, d), ["model_id"]))


_LEX = "('worthless', 'stupid', 'idiot', 'hate', 'garbage', 'trash', 'pathetic', 'disgusting')"


def lexical_sql(text: str, words: str = _LEX) -> str:
    tokens = f"regexp_extract_all(lower({text}), '[a-z]+')"
    return f"coalesce(len(list_filter({tokens}, lambda t: t IN {words}))::DOUBLE / nullif(len({tokens}), 0), 0.0)"


_VARIANTS = f"""SELECT sample_id, {lexical_sql('prompt')} AS prompt_only,
  {lexical_sql("CASE WHEN prompt = '' THEN original_output ELSE prompt || ' ' || original_output END")} AS prompt_original,
  {lexical_sql("CASE WHEN prompt = '' THEN detoxified_output ELSE prompt || ' ' || detoxified_output END")} AS prompt_detoxified,
  {lexical_sql('original_output')} AS original_output, {lexical_sql('detoxified_output')} AS detoxified_output FROM pairs"""
_VARIANT_NUMBERS = "prompt_only prompt_original prompt_detoxified original_output detoxified_output"
_IMPROVED_VARIANTS = f"""SELECT *, detoxified_output - original_output AS output_improvement, prompt_detoxified - prompt_original AS prompt_output_improvement,
  prompt_original - original_output AS prompt_contribution_original, prompt_detoxified - detoxified_output AS prompt_contribution_detoxified FROM ({_VARIANTS})"""


@query("h17_pair_improvements", with_tables("pairs", rounded("sample_id", _VARIANT_NUMBERS + """ output_improvement prompt_output_improvement
  prompt_contribution_original prompt_contribution_detoxified""", _IMPROVED_VARIANTS)))
def h17(spark, d):
    return tidy(delta.with_pair_improvements(score_variants(sc.pairs(spark, d), "lexical")))


@query("h19_prompt_output_drop", with_tables("filled", rounded("model classifier label", "prompt_mean output_mean drop", f"""
  SELECT model, classifier, label, p.mean AS prompt_mean, o.mean AS output_mean, p.mean - o.mean AS drop
  FROM (SELECT * FROM ({_LABEL_STATS}) WHERE text_type = 'prompt') p JOIN (SELECT * FROM ({_LABEL_STATS}) WHERE text_type = 'output') o
  USING (model, classifier, label)""")))
def h19(spark, d):
    return tidy(describe.text_type_drop(describe.label_map_summary(sc.classifications(spark, d))))
