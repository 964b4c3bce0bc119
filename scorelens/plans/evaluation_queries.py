"""Queries for significance tests (I), ranks and metrics (R, J), ensembles (K) and losses (L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelens.functions import distributions as dist
from scorelens.operators import ensemble, hypothesis, losses, metrics, ranks
from scorelens.operators.pairing import split_by_hash
from scorelens.plans import scenario as sc
from scorelens.plans.registry import query
from scorelens.plans.scenario import rounded, tidy, u, with_tables
from scorelens.plans.statistics_queries import deltas, paired, primary, reward_pairs

MC = ["model", "classifier"]


def out_deltas(spark, d):
    return deltas(spark, d)


@query("i1_t_statistic", with_tables("primary_paired", rounded("model classifier n df", "mean t", """
  SELECT model, classifier, count(*) AS n, avg(delta) AS mean, avg(delta) / (stddev_samp(delta) / sqrt(count(*))) AS t, count(*) - 1 AS df
  FROM primary_paired WHERE text_type = 'output' GROUP BY ALL""")))
def i1(spark, d):
    return tidy(hypothesis.t_statistic(out_deltas(spark, d), MC))


# reward differences per model and half of the samplesuage, shifted so that p-values of all sizes appear
ML = ["model_id", "half"]
_SHIFTED = "SELECT model_id, (sample_id % 2)::INTEGER AS half, sample_id, original + 0.25 AS base_value, detoxified AS score, detoxified - (original + 0.25) AS delta FROM reward_pairs"


def shifted(spark, d):
    half = (F.col("sample_id") % 2).cast("int").alias("half")
    return reward_pairs(spark, d).select(
        "model_id", half, "sample_id", (F.col("original") + 0.25).alias("base_value"), F.col("detoxified").alias("score"),
    ).withColumn("delta", F.col("score") - F.col("base_value"))


def integral(density: str, end: str, steps: int = 4000) -> str:
    """Simpson's rule from 0 to ``end`` for a density in x."""
    f = density.replace("x", f"(i * {end} / {steps})")
    weight = f"CASE WHEN i = 0 OR i = {steps} THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END"
    return f"(list_sum(list_transform(range(0, {steps + 1}), lambda i: ({weight})::DOUBLE * ({f}))) * {end} / {3 * steps})"


def normal_tail(z: str) -> str:
    """Upper tail of the standard normal distribution."""
    half = integral("0.3989422804014327 * pow(2.718281828459045, -0.5 * x * x)", f"least(abs({z}), 12.0)")
    return f"CASE WHEN {z} >= 0 THEN 0.5 - {half} ELSE 0.5 + {half} END"


def student_both_tails(t: str, df: str) -> str:
    scale = f"exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt({df} * 3.141592653589793)"
    return f"1 - 2 * {scale} * {integral(f'pow(1 + x * x / {df}, -({df} + 1) / 2.0)', f'abs({t})')}"


_T = "SELECT model_id, half, count(*) AS n, avg(delta) AS mean, avg(delta) / (stddev_samp(delta) / sqrt(count(*))) AS t, count(*) - 1 AS df FROM shifted GROUP BY ALL"
_T_TWO = f"SELECT *, greatest({student_both_tails('t', 'df')}, 0.0) AS p_value FROM (SELECT * REPLACE (t::DOUBLE AS t) FROM ({_T}))"
_T_ONE = f"SELECT * REPLACE (CASE WHEN t > 0 THEN p_value / 2 ELSE 1 - p_value / 2 END AS p_value) FROM ({_T_TWO})"
_FLAGS = "p_value < 0.01 AS significant_01, p_value < 0.05 AS significant_05"


def on_shifted(body: str) -> str:
    return with_tables("reward_pairs", f"WITH shifted AS ({_SHIFTED}) {body}")


@query("i1_t_test", on_shifted(rounded("model_id half n df significant_01 significant_05", "mean t p_value", f"SELECT *, {_FLAGS} FROM ({_T_TWO})")))
def i1_p(spark, d):
    return tidy(hypothesis.t_test(shifted(spark, d), ML))


_SIGNED = """SELECT model, classifier, sum((delta > 0)::INT * r) AS w_plus, sum((delta < 0)::INT * r) AS w_minus, count(*) AS n FROM (
  SELECT *, rank() OVER (PARTITION BY model, classifier ORDER BY abs(delta)) + (count(*) OVER (PARTITION BY model, classifier, abs(delta)) - 1) / 2.0 AS r
  FROM primary_paired WHERE text_type = 'output' AND delta <> 0) GROUP BY ALL"""
_TIES = """SELECT model, classifier, sum(t * t * t - t)::DOUBLE AS tie_term FROM (SELECT model, classifier, count(*) AS t FROM primary_paired
  WHERE text_type = 'output' AND delta <> 0 GROUP BY model, classifier, abs(delta)) GROUP BY ALL"""


@query("i2_wilcoxon_statistic", with_tables("primary_paired", rounded("model classifier n zeros", "w_plus w_minus tie_term statistic", f"""
  SELECT *, least(w_plus, w_minus) AS statistic FROM ({_SIGNED}) JOIN ({_TIES}) USING (model, classifier)
  JOIN (SELECT model, classifier, count(*) FILTER (delta = 0) AS zeros FROM primary_paired WHERE text_type = 'output' GROUP BY ALL) USING (model, classifier)""")))
def i2(spark, d):
    return tidy(hypothesis.wilcoxon_statistic(out_deltas(spark, d), MC))


_W = """SELECT *, (w_plus - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - tie_term / 48.0) AS z FROM (
  SELECT model_id, half, sum((delta > 0)::INT * r) AS w_plus, sum((delta < 0)::INT * r) AS w_minus, count(*) AS n FROM (
    SELECT *, rank() OVER (PARTITION BY model_id, half ORDER BY abs(delta)) + (count(*) OVER (PARTITION BY model_id, half, abs(delta)) - 1) / 2.0 AS r
    FROM shifted WHERE delta <> 0) GROUP BY ALL)
  JOIN (SELECT model_id, half, sum(t * t * t - t)::DOUBLE AS tie_term FROM (SELECT model_id, half, count(*) AS t FROM shifted WHERE delta <> 0
    GROUP BY model_id, half, abs(delta)) GROUP BY ALL) USING (model_id, half)
  JOIN (SELECT model_id, half, count(*) FILTER (delta = 0) AS zeros FROM shifted GROUP BY ALL) USING (model_id, half)"""
_W_TWO = f"SELECT * EXCLUDE (z), least(w_plus, w_minus) AS statistic, least(1.0, 2 * ({normal_tail('abs(z)')})) AS p_value FROM ({_W})"
_W_ONE = f"SELECT * EXCLUDE (z), w_plus AS statistic, {normal_tail('z')} AS p_value FROM ({_W})"
_W_KEYS, _W_NUMBERS = "model_id half n zeros significant_01 significant_05", "w_plus w_minus tie_term statistic p_value"


@query("i2_wilcoxon_test", on_shifted(rounded(_W_KEYS, _W_NUMBERS, f"SELECT *, {_FLAGS} FROM ({_W_TWO})")))
def i2_p(spark, d):
    return tidy(hypothesis.wilcoxon_test(shifted(spark, d), ML))


def _normal_scores(rounds: int = 8) -> str:
    """(n, i, m): expected normal scores by Newton steps on the logarithm of the lower tail."""
    rows = """SELECT n, i, least(q, 1 - q) AS p, CASE WHEN q < 0.5 THEN 1.0 ELSE -1.0 END AS sign FROM (
      SELECT n, i, (i - 0.375) / (n + 0.25) AS q FROM (SELECT DISTINCT n FROM sizes) s, LATERAL (SELECT unnest(range(1, n + 1)) AS i))"""
    step = f"SELECT *, ln(p / (1 - p)) / 1.702 AS z FROM ({rows})"
    for _ in range(rounds):
        step = f"SELECT * EXCLUDE (tail) REPLACE (z - ln(tail / p) * tail / (0.3989422804014327 * exp(-0.5 * z * z)) AS z) FROM (SELECT *, {normal_tail('abs(z)')} AS tail FROM ({step}))"
    return f"SELECT n, i, sign * z AS m FROM ({step})"


def _polynomial(coefficients: tuple, x: str) -> str:
    return "(" + " + ".join(f"({c!r})::DOUBLE * pow({x}, {i})" for i, c in enumerate(coefficients)) + ")"


_SHAPIRO = f"""WITH rows AS (SELECT *, row_number() OVER (PARTITION BY model, classifier ORDER BY delta, prompt_id) AS i FROM primary_paired WHERE text_type = 'output'),
  sizes AS (SELECT model, classifier, count(*) AS n, var_pop(delta) * count(*) AS squares FROM rows GROUP BY ALL),
  scores AS ({_normal_scores()}),
  sums AS (SELECT model, classifier, n, squares, sum(m * m) AS m2, sum(m * delta) AS mx, max(m) AS ml, max(m) FILTER (i = n - 1) AS mn,
    max(delta) FILTER (i = 1) AS x1, max(delta) FILTER (i = 2) AS x2, max(delta) FILTER (i = n - 1) AS y2, max(delta) FILTER (i = n) AS y1
    FROM rows JOIN sizes USING (model, classifier) JOIN scores USING (n, i) GROUP BY ALL),
  ends AS (SELECT *, ml / sqrt(m2) + {_polynomial(dist._C1, '(1 / sqrt(n))')} AS al, mn / sqrt(m2) + {_polynomial(dist._C2, '(1 / sqrt(n))')} AS an FROM sums),
  stats AS (SELECT *, pow((mx - ml * (y1 - x1) - mn * (y2 - x2)) / sqrt((m2 - 2 * ml * ml - 2 * mn * mn) / (1 - 2 * al * al - 2 * an * an)) + al * (y1 - x1) + an * (y2 - x2), 2) / squares AS w FROM ends),
  zs AS (SELECT *, (ln(1 - w) - {_polynomial(dist._LARGE_MEAN, 'ln(n)')}) / exp({_polynomial(dist._LARGE_LOG_SD, 'ln(n)')}) AS z FROM stats),
  ps AS (SELECT *, {normal_tail('z')} AS p_value FROM zs)
  SELECT model, classifier, n, w, p_value, p_value > 0.05 AS normal, n <= 5000 AS p_reliable FROM ps"""


@query("i3_shapiro_test", with_tables("primary_paired", rounded("model classifier n normal p_reliable", "w p_value", _SHAPIRO)))
def i3(spark, d):
    return tidy(hypothesis.shapiro_test(out_deltas(spark, d), MC))


@query("i4_wilcoxon_greater", on_shifted(rounded(_W_KEYS, _W_NUMBERS, f"SELECT *, {_FLAGS} FROM ({_W_ONE})")))
def i4(spark, d):
    return tidy(hypothesis.wilcoxon_test(shifted(spark, d), ML, alternative="greater", min_rows=10))


@query("i5_paired_t_greater", on_shifted(rounded("model_id half n df significant_01 significant_05", "mean t p_value", f"SELECT *, {_FLAGS} FROM ({_T_ONE})")))
def i5(spark, d):
    return tidy(hypothesis.t_test(shifted(spark, d), ML, alternative="greater"))


@query("i6_mann_whitney_statistic", with_tables("rewards", rounded("model_id n1 n2", "rank_sum tie_term u", """
  SELECT *, rank_sum - n1 * (n1 + 1) / 2.0 AS u FROM (SELECT model_id, count(*) FILTER (side = 'detoxified') AS n1, count(*) FILTER (side <> 'detoxified') AS n2,
    sum(r) FILTER (side = 'detoxified') AS rank_sum FROM (SELECT *, rank() OVER (PARTITION BY model_id ORDER BY reward)
      + (count(*) OVER (PARTITION BY model_id, reward) - 1) / 2.0 AS r FROM rewards) GROUP BY model_id)
  JOIN (SELECT model_id, sum(t * t * t - t)::DOUBLE AS tie_term FROM (SELECT model_id, count(*) AS t FROM rewards GROUP BY model_id, reward) GROUP BY model_id) USING (model_id)""")))
def i6(spark, d):
    return tidy(hypothesis.mann_whitney_statistic(sc.rewards(spark, d), ["model_id"], "reward", F.col("side") == "detoxified"))


def _mann_whitney(first: str) -> str:
    """First side against the other over the shifted pairs, one-sided."""
    return f"""SELECT model_id, half, n1, n2, rank_sum, tie_term, u, {normal_tail('zz')} AS p_value FROM (
      SELECT *, (u - n1 * n2 / 2.0 - 0.5) / sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - tie_term / ((n1 + n2) * (n1 + n2 - 1.0)))) AS zz FROM (
        SELECT *, rank_sum - n1 * (n1 + 1) / 2.0 AS u FROM (
          SELECT model_id, half, count(*) FILTER ({first}) AS n1, count(*) FILTER (NOT {first}) AS n2, sum(r) FILTER ({first}) AS rank_sum FROM (
            SELECT *, rank() OVER (PARTITION BY model_id, half ORDER BY v) + (count(*) OVER (PARTITION BY model_id, half, v) - 1) / 2.0 AS r FROM both_sides) GROUP BY ALL)
        JOIN (SELECT model_id, half, sum(t * t * t - t)::DOUBLE AS tie_term FROM (SELECT model_id, half, count(*) AS t FROM both_sides GROUP BY model_id, half, v) GROUP BY ALL)
        USING (model_id, half)))"""


_BOTH = "both_sides AS (SELECT model_id, half, true AS is_base, base_value AS v FROM shifted UNION ALL SELECT model_id, half, false, score FROM shifted)"


@query("i6_mann_whitney_test", with_tables("reward_pairs", f"WITH shifted AS ({_SHIFTED}), {_BOTH} " + rounded("model_id half n1 n2", "rank_sum tie_term u p_value", _mann_whitney("(NOT is_base)"))))
def i6_p(spark, d):
    """Are detoxified rewards greater than the shifted original ones?"""
    rows = shifted(spark, d)
    sides = rows.select(*ML, F.lit(0).alias("mine"), F.col("base_value").alias("v")).unionByName(
        rows.select(*ML, F.lit(1).alias("mine"), F.col("score").alias("v")))
    return tidy(hypothesis.mann_whitney_test(sides, ML, "v", F.col("mine") == 1))


@query("i7_cohens_d", with_tables("primary_paired", rounded("model classifier n", "cohens_d", """
  SELECT model, classifier, count(*) AS n, (avg(base_value) - avg(score)) / sqrt(((count(*) - 1) * var_samp(base_value) + (count(*) - 1) * var_samp(score)) / (2 * count(*) - 2)) AS cohens_d
  FROM primary_paired WHERE text_type = 'output' GROUP BY ALL""")))
def i7(spark, d):
    return tidy(hypothesis.cohens_d(paired(spark, d, text_types=["output"]), MC))


_FACTS = """SELECT model_id, half, avg(base_value) AS base_mean, avg(score) AS model_mean, stddev_pop(base_value) AS base_std, stddev_pop(score) AS model_std, count(*) AS n,
  (avg(base_value) - avg(score)) / sqrt((var_samp(base_value) + var_samp(score)) / 2) AS cohens_d FROM shifted GROUP BY ALL"""


@query("i8_significance_table", with_tables("reward_pairs", f"WITH shifted AS (SELECT * REPLACE (base_value - score AS delta) FROM ({_SHIFTED})), {_BOTH} " + rounded(
    "model_id half test n significant", "statistic p_value base_mean model_mean base_std model_std cohens_d", f"""
  SELECT *, p_value < 0.05 AS significant FROM (SELECT model_id, half, 'wilcoxon' AS test, statistic::DOUBLE AS statistic, p_value FROM ({_W_ONE})
    UNION ALL SELECT model_id, half, 't_test', t, p_value FROM ({_T_ONE}) UNION ALL SELECT model_id, half, 'mann_whitney', u, p_value FROM ({_mann_whitney('is_base')}))
  JOIN ({_FACTS}) USING (model_id, half)""")))
def i8(spark, d):
    """Positive differences mean that the original side is greater."""
    rows = shifted(spark, d).drop("delta")
    return tidy(hypothesis.significance_table(rows, ML, tests=("wilcoxon", "t_test", "mann_whitney")))


_P = f"SELECT source, lang, avg({u(repr('pv'), 'doc_id')}) / 4 AS p_value FROM documents GROUP BY ALL"
_PLACED = f"SELECT *, row_number() OVER (PARTITION BY source ORDER BY p_value, lang) AS i, count(*) OVER (PARTITION BY source) AS m FROM ({_P})"


def p_values(spark, d):
    from scorelens.functions.text import hash_unit

    draw = hash_unit(F.lit("pv"), F.col("doc_id").cast("string"))
    return sc.table(spark, d, "documents").groupBy("source", "lang").agg((F.avg(draw) / 4).alias("p_value"))


@query("i9_bonferroni", rounded("source lang", "p_value p_adjusted", f"SELECT source, lang, p_value, least(1.0, p_value * m) AS p_adjusted FROM ({_PLACED})"))
def i9_bonferroni(spark, d):
    return tidy(hypothesis.adjust_p_values(p_values(spark, d), ["source"], key=["lang"], method="bonferroni"))


@query("i9_holm", rounded("source lang", "p_value p_adjusted", f"""SELECT source, lang, p_value,
  max(least(1.0, p_value * (m - i + 1))) OVER (PARTITION BY source ORDER BY i ROWS UNBOUNDED PRECEDING) AS p_adjusted FROM ({_PLACED})"""))
def i9_holm(spark, d):
    return tidy(hypothesis.adjust_p_values(p_values(spark, d), ["source"], key=["lang"], method="holm"))


@query("i9_fdr", rounded("source lang", "p_value p_adjusted", f"""SELECT source, lang, p_value,
  min(least(1.0, p_value * m / i)) OVER (PARTITION BY source ORDER BY i DESC ROWS UNBOUNDED PRECEDING) AS p_adjusted FROM ({_PLACED})"""))
def i9_fdr(spark, d):
    return tidy(hypothesis.adjust_p_values(p_values(spark, d), ["source"], key=["lang"], method="fdr"))


_GAP_P = f"SELECT source, lang, CASE WHEN lang <> 'de' THEN p_value END AS p_value FROM ({_P})"
_GAP_PLACED = f"SELECT *, row_number() OVER (PARTITION BY source ORDER BY p_value NULLS LAST, lang) AS i, count(p_value) OVER (PARTITION BY source) AS m FROM ({_GAP_P})"


@query("i9_missing_p_values", rounded("source lang", "p_value bonferroni holm fdr", f"""SELECT source, lang, p_value,
  CASE WHEN p_value IS NOT NULL THEN least(1.0, p_value * m) END AS bonferroni,
  CASE WHEN p_value IS NOT NULL THEN max(CASE WHEN p_value IS NOT NULL THEN least(1.0, p_value * (m - i + 1)) END) OVER (PARTITION BY source ORDER BY i ROWS UNBOUNDED PRECEDING) END AS holm,
  CASE WHEN p_value IS NOT NULL THEN min(CASE WHEN p_value IS NOT NULL THEN least(1.0, p_value * m / i) END) OVER (PARTITION BY source ORDER BY i DESC ROWS UNBOUNDED PRECEDING) END AS fdr
  FROM ({_GAP_PLACED})"""))
def i9_missing(spark, d):
    """Tests without a p-value are no members of their family."""
    rows = p_values(spark, d).withColumn("p_value", F.when(F.col("lang") != "de", F.col("p_value")))
    for method in ("bonferroni", "holm", "fdr"):
        rows = hypothesis.adjust_p_values(rows, ["source"], key=["lang"], method=method).withColumnRenamed("p_adjusted", method)
    return tidy(rows)


# ---- ranks and metrics ---------------------------------------------------------------------------------------

@query("r1_average_rank", with_tables("rewards", rounded("sample_id side model_id", "avg_rank", """
  SELECT sample_id, side, model_id, rank() OVER (PARTITION BY model_id ORDER BY reward) + (count(*) OVER (PARTITION BY model_id, reward) - 1) / 2.0 AS avg_rank FROM rewards""")))
def r1(spark, d):
    rows = sc.rewards(spark, d).select("sample_id", "side", "model_id", "reward")
    return tidy(ranks.avg_rank(rows, ["model_id"], "reward").drop("reward"))


@query("r1_lineitem_rank", rounded("l_returnflag l_quantity n", "avg_rank", """
  SELECT l_returnflag, l_quantity, count(*) AS n, avg(r) AS avg_rank FROM (SELECT *, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity)
    + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS r FROM lineitem) GROUP BY ALL"""))
def r1_lineitem(spark, d):
    rows = sc.table(spark, d, "lineitem").select("l_returnflag", "l_quantity")
    ranked = ranks.avg_rank(rows, ["l_returnflag"], "l_quantity")
    return tidy(ranked.groupBy("l_returnflag", "l_quantity").agg(F.count("*").alias("n"), F.avg("avg_rank").alias("avg_rank")))


def split_rewards(spark, d):
    return split_by_hash(sc.rewards(spark, d), "sample_id", 0.8)


_SPLIT = """SELECT r.*, s.split, (side = 'original')::INT AS label FROM rewards r JOIN doc_split s USING (sample_id)"""
_PREDICTED = f"SELECT *, (reward <= avg(reward) OVER (PARTITION BY model_id, split))::INT AS prediction FROM ({_SPLIT})"


@query("j1_mean_threshold_prediction", with_tables("rewards", """
  SELECT sample_id, side, model_id, (reward <= avg(reward) OVER (PARTITION BY model_id))::INTEGER AS prediction FROM rewards"""))
def j1(spark, d):
    return metrics.mean_threshold_predictions(sc.rewards(spark, d), ["model_id"]).select("sample_id", "side", "model_id", "prediction")


_CONFUSION = """count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label = 0 AND prediction = 1) AS fp,
  count(*) FILTER (label = 0 AND prediction = 0) AS tn, count(*) FILTER (label = 1 AND prediction = 0) AS fn"""
_F1 = "(tp + tn)::DOUBLE / (tp + fp + tn + fn) AS accuracy, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS f1"


@query("j2_accuracy_f1", with_tables("rewards doc_split", rounded("model_id split tp fp tn fn", "accuracy f1", f"""
  SELECT *, {_F1} FROM (SELECT model_id, split, {_CONFUSION} FROM ({_PREDICTED}) GROUP BY model_id, split)""")))
def j2(spark, d):
    by = ["model_id", "split"]
    rows = split_rewards(spark, d).withColumn("label", metrics.toxic_label())
    return tidy(metrics.confusion_metrics(metrics.mean_threshold_predictions(rows, by), by))


@query("j2_detoxified_positive", with_tables("rewards", rounded("model_id tp fp tn fn", "accuracy f1", f"""
  SELECT *, {_F1} FROM (SELECT model_id, {_CONFUSION} FROM (SELECT model_id, (side = 'detoxified')::INT AS label,
    (reward > avg(reward) OVER (PARTITION BY model_id))::INT AS prediction FROM rewards) GROUP BY model_id)""")))
def j2_positive(spark, d):
    rows = sc.rewards(spark, d).withColumn("label", metrics.toxic_label(positive="detoxified"))
    predicted = metrics.mean_threshold_predictions(rows, ["model_id"], positive="detoxified")
    return tidy(metrics.confusion_metrics(predicted, ["model_id"]))


def auc_sql(source: str, by: str, score: str, label: str) -> str:
    """Both areas of a score where greater means positive."""
    return f"""SELECT {by}, p AS positives, n AS negatives, (rs - p * (p + 1) / 2.0) / (p * n) AS roc_auc, area / p AS pr_auc FROM (
      SELECT {by}, sum(y)::BIGINT AS p, (sum(c) - sum(y))::BIGINT AS n, sum(y * (below + (c + 1) / 2.0)) AS rs,
        sum(y * (tp / k::DOUBLE + coalesce((tp - y) / nullif(k - c, 0)::DOUBLE, 1.0)) / 2) AS area
      FROM (SELECT *, sum(c) OVER (PARTITION BY {by} ORDER BY s) - c AS below, sum(c) OVER (PARTITION BY {by} ORDER BY s DESC) AS k,
              sum(y) OVER (PARTITION BY {by} ORDER BY s DESC) AS tp
            FROM (SELECT {by}, {score} AS s, count(*) AS c, sum({label}) AS y FROM ({source}) GROUP BY ALL)) GROUP BY {by})"""


@query("j3_roc_auc", with_tables("rewards doc_split", rounded("model_id split positives negatives", "roc_auc", auc_sql(_SPLIT, "model_id, split", "-reward", "label"))))
def j3(spark, d):
    rows = split_rewards(spark, d).withColumn("label", metrics.toxic_label())
    return tidy(metrics.ranking_metrics(rows, ["model_id", "split"], "reward").drop("pr_auc"))


_LABELLED = f"SELECT l.toxic, floor(50 * ({u(repr('q'), 'doc_id')} + 0.3 * l.toxic)) / 50 AS score, d.source FROM documents d JOIN labels l USING (doc_id)"


def labelled(spark, d):
    from scorelens.functions.text import hash_unit

    docs = sc.table(spark, d, "documents").select("doc_id", "source").join(sc.table(spark, d, "labels"), "doc_id")
    draw = hash_unit(F.lit("q"), F.col("doc_id").cast("string"))
    return docs.select("source", "toxic", (F.floor((draw + 0.3 * F.col("toxic")) * 50) / 50).alias("score"))


@query("j3_roc_auc_labels", with_tables("", rounded("g positives negatives", "roc_auc pr_auc", auc_sql(f"SELECT *, 1 AS g FROM ({_LABELLED})", "g", "score", "toxic"))))
def j3_labels(spark, d):
    """Unbalanced classes with heavy ties."""
    rows = labelled(spark, d).withColumn("g", F.lit(1))
    return tidy(metrics.ranking_metrics(rows, ["g"], "score", "toxic", low_is_positive=False))


@query("j4_pr_auc", with_tables("rewards doc_split", rounded("model_id split positives negatives", "pr_auc", auc_sql(_SPLIT, "model_id, split", "-reward", "label"))))
def j4(spark, d):
    rows = split_rewards(spark, d).withColumn("label", metrics.toxic_label())
    return tidy(metrics.ranking_metrics(rows, ["model_id", "split"], "reward").drop("roc_auc"))


@query("j5_pearson", with_tables("rewards", rounded("model_id", "pearson", "SELECT model_id, corr(reward, true_reward) AS pearson FROM rewards GROUP BY model_id")))
def j5(spark, d):
    return tidy(metrics.pearson(sc.rewards(spark, d), ["model_id"], "reward", "true_reward"))


def _rank(column: str) -> str:
    return f"rank() OVER (PARTITION BY model_id ORDER BY {column}) + (count(*) OVER (PARTITION BY model_id, {column}) - 1) / 2.0"


@query("j6_spearman", with_tables("rewards", rounded("model_id", "spearman", f"""
  SELECT model_id, corr(rx, ry) AS spearman FROM (SELECT model_id, {_rank('reward')} AS rx, {_rank('true_reward')} AS ry FROM rewards) GROUP BY model_id""")))
def j6(spark, d):
    return tidy(metrics.spearman(sc.rewards(spark, d), ["model_id"], "reward", "true_reward"))


_TAU = """SELECT model_id, n, (c - dd) / sqrt((pairs - tx) * (pairs - ty)) AS kendall FROM (
  SELECT a.model_id, sum((sign(a.reward - b.reward) * sign(a.true_reward - b.true_reward) > 0)::INT)::DOUBLE AS c,
    sum((sign(a.reward - b.reward) * sign(a.true_reward - b.true_reward) < 0)::INT)::DOUBLE AS dd, count(*)::DOUBLE AS pairs,
    sum((a.reward = b.reward)::INT)::DOUBLE AS tx, sum((a.true_reward = b.true_reward)::INT)::DOUBLE AS ty
  FROM rewards a JOIN rewards b ON a.model_id = b.model_id AND (a.sample_id < b.sample_id OR (a.sample_id = b.sample_id AND a.side < b.side)) GROUP BY a.model_id)
  JOIN (SELECT model_id, count(*) AS n FROM rewards GROUP BY model_id) USING (model_id)"""


@query("j7_kendall", with_tables("rewards", rounded("model_id n", "kendall", _TAU)))
def j7(spark, d):
    return tidy(metrics.kendall(sc.rewards(spark, d), ["model_id"], "reward", "true_reward"))


_AGREE = f"""SELECT model_id, accuracy AS agreement_accuracy, f1 AS agreement_f1 FROM (SELECT *, {_F1} FROM (SELECT model_id, {_CONFUSION} FROM (
  SELECT model_id, (true_reward <= avg(true_reward) OVER (PARTITION BY model_id))::INT AS label, (reward <= avg(reward) OVER (PARTITION BY model_id))::INT AS prediction
  FROM rewards) GROUP BY model_id))"""


@query("j8_agreement", with_tables("rewards", rounded("model_id", "agreement_accuracy agreement_f1", _AGREE)))
def j8(spark, d):
    return tidy(metrics.agreement(sc.rewards(spark, d), ["model_id"]))


_MEANS = """SELECT model_id, avg(reward) FILTER (side = 'original') AS avg_original, avg(reward) FILTER (side = 'detoxified') AS avg_detoxified,
  stddev_pop(reward) FILTER (side = 'original') AS std_original, stddev_pop(reward) FILTER (side = 'detoxified') AS std_detoxified,
  avg(reward) FILTER (side = 'detoxified') - avg(reward) FILTER (side = 'original') AS reward_difference FROM rewards GROUP BY model_id"""
_MEAN_NAMES = "avg_original avg_detoxified std_original std_detoxified reward_difference"


@query("j9_reward_means", with_tables("rewards", rounded("model_id", _MEAN_NAMES, _MEANS)))
def j9(spark, d):
    return tidy(metrics.reward_means(sc.rewards(spark, d), ["model_id"]))


_ONE = "SELECT *, (side = 'original')::INT AS label FROM rewards"
_FULL = f"""SELECT * FROM (SELECT *, {_F1} FROM (SELECT model_id, {_CONFUSION} FROM (SELECT *, (reward <= avg(reward) OVER (PARTITION BY model_id))::INT AS prediction FROM ({_ONE})) GROUP BY model_id))
  JOIN ({auc_sql(_ONE, 'model_id', '-reward', 'label')}) USING (model_id) JOIN ({_MEANS}) USING (model_id)
  JOIN (SELECT model_id, corr(reward, true_reward) AS pearson FROM rewards GROUP BY model_id) USING (model_id)
  JOIN (SELECT model_id, corr(rx, ry) AS spearman FROM (SELECT model_id, {_rank('reward')} AS rx, {_rank('true_reward')} AS ry FROM rewards) GROUP BY model_id) USING (model_id)
  JOIN ({_TAU}) USING (model_id) JOIN ({_AGREE}) USING (model_id)"""


@query("j10_evaluation_row", with_tables("rewards", rounded("model_id tp fp tn fn positives negatives",
    f"accuracy f1 roc_auc pr_auc {_MEAN_NAMES} pearson spearman kendall agreement_accuracy agreement_f1", _FULL)))
def j10(spark, d):
    return tidy(metrics.evaluation_row(sc.rewards(spark, d), ["model_id"], truth="true_reward"))


_MATRIX_NAMES = [*sc.SEED_NAMES, "toxicity", "insult"]


@query("j11_correlation_matrix", with_tables("rewards prompts", rounded("i j", "correlation", """
  WITH sides AS (SELECT DISTINCT side FROM rewards), long AS (SELECT sample_id, side, model_id AS name, reward AS v FROM rewards
    UNION ALL SELECT prompt_id, side, 'toxicity', toxicity FROM prompts, sides WHERE toxicity IS NOT NULL
    UNION ALL SELECT prompt_id, side, 'insult', insult FROM prompts, sides WHERE insult IS NOT NULL)
  SELECT a.name AS i, b.name AS j, corr(a.v, b.v) AS correlation FROM long a JOIN long b USING (sample_id, side) GROUP BY ALL""")))
def j11(spark, d):
    """Seeds against seeds and prompt attributes."""
    wide = sc.rewards(spark, d).groupBy("sample_id", "side").pivot("model_id", sc.SEED_NAMES).agg(F.max("reward"))
    attributes = sc.prompts(spark, d).select(F.col("prompt_id").alias("sample_id"), "prompt.toxicity", "prompt.insult")
    return tidy(metrics.correlation_matrix(wide.join(attributes, "sample_id"), _MATRIX_NAMES))


@query("j11_label_correlation", with_tables("scores", rounded("i j", "correlation", """
  SELECT a.label AS i, b.label AS j, corr(a.score, b.score) AS correlation FROM scores a JOIN scores b USING (prompt_id, model, text_type, classifier)
  WHERE classifier = 'toxic_bert' AND text_type = 'output' GROUP BY ALL""")))
def j11_labels(spark, d):
    from scorelens.functions.labels import TOXIC_LABELS

    rows = sc.scores(spark, d, text_types=["output"]).where("classifier = 'toxic_bert'")
    wide = rows.groupBy("prompt_id", "model").pivot("label", TOXIC_LABELS).agg(F.max("score"))
    return tidy(metrics.correlation_matrix(wide, TOXIC_LABELS))


@query("j12_cosine_matrix", rounded("i j", "cosine", """
  WITH w AS (SELECT label::VARCHAR AS name, dim, avg(embedding[dim]::DOUBLE) AS v FROM embeddings, range(1, 65) t(dim) GROUP BY ALL)
  SELECT a.name AS i, b.name AS j, sum(a.v * b.v) / (sqrt(sum(a.v * a.v)) * sqrt(sum(b.v * b.v))) AS cosine FROM w a JOIN w b USING (dim) GROUP BY ALL"""))
def j12(spark, d):
    """Mean vector of each label as a head; the heads are compared pairwise."""
    weights = metrics.centroid_weights(sc.table(spark, d, "embeddings"))
    return tidy(metrics.cosine_matrix(weights, [str(i) for i in range(10)]))


# ---- ensembles -----------------------------------------------------------------------------------------------

_COMBINED = "SELECT sample_id, side, avg(reward) AS mean, median(reward) AS median, max(reward) AS max, min(reward) AS min FROM rewards GROUP BY ALL"


@query("k1_combine", with_tables("rewards", rounded("sample_id side", "mean median max min", _COMBINED)))
def k1(spark, d):
    return tidy(ensemble.combine(sc.rewards(spark, d)))


_AUC = auc_sql(_ONE, "model_id", "-reward", "label")
_WEIGHTED = f"SELECT sample_id, side, sum(weight * reward) / sum(weight) AS weighted FROM rewards JOIN (SELECT model_id, roc_auc AS weight FROM ({_AUC})) USING (model_id) GROUP BY sample_id, side"


@query("k2_auc_weighted", with_tables("rewards", rounded("sample_id side", "weighted", _WEIGHTED)))
def k2(spark, d):
    rows = sc.rewards(spark, d)
    return tidy(ensemble.weighted(rows, ensemble.auc_weights(rows)))


@query("k3_user_weighted", with_tables("rewards", rounded("sample_id side", "weighted", """SELECT sample_id, side, sum(w * reward) / sum(w) AS weighted
  FROM (SELECT *, CASE model_id WHEN 'seed_42' THEN 0.5 WHEN 'seed_43' THEN 2.0 WHEN 'seed_46' THEN 1.0 END AS w FROM rewards) WHERE w IS NOT NULL GROUP BY sample_id, side""")))
def k3(spark, d):
    return tidy(ensemble.user_weighted(sc.rewards(spark, d), {"seed_42": 0.5, "seed_43": 2.0, "seed_46": 1.0}))


_ENSEMBLES = f"""SELECT sample_id, side, model_id, reward FROM rewards UNION ALL SELECT sample_id, side, 'ensemble_weighted', weighted FROM ({_WEIGHTED})
  UNION ALL """ + " UNION ALL ".join(f"SELECT sample_id, side, 'ensemble_{m}', {m} FROM ({_COMBINED})" for m in ensemble.METHODS)
_BOARD_SOURCE = f"SELECT *, (side = 'original')::INT AS label FROM ({_ENSEMBLES})"
_BOARD = f"""SELECT model_id, accuracy, f1, roc_auc, pr_auc FROM (SELECT *, {_F1} FROM (SELECT model_id, {_CONFUSION} FROM (
  SELECT *, (reward <= avg(reward) OVER (PARTITION BY model_id))::INT AS prediction FROM ({_BOARD_SOURCE})) GROUP BY model_id))
  JOIN ({auc_sql(_BOARD_SOURCE, 'model_id', '-reward', 'label')}) USING (model_id)"""


@query("k4_leaderboard", with_tables("rewards", rounded("model_id", "accuracy f1 roc_auc pr_auc", _BOARD)))
def k4(spark, d):
    return tidy(ensemble.leaderboard(sc.rewards(spark, d)))


@query("k5_best_method", with_tables("rewards", rounded("kind best_model models", "roc_auc mean_roc_auc", f"""
  SELECT CASE WHEN starts_with(model_id, 'ensemble_') THEN 'ensemble' ELSE 'member' END AS kind, arg_min(model_id, (-roc_auc, model_id)) AS best_model,
    max(roc_auc) AS roc_auc, avg(roc_auc) AS mean_roc_auc, count(*) AS models FROM ({_BOARD}) GROUP BY 1""")))
def k5(spark, d):
    return tidy(ensemble.best_method(ensemble.leaderboard(sc.rewards(spark, d))))


@query("k6_score_table", with_tables("rewards prompts", rounded("sample_id side text", "toxicity insult " + " ".join(sc.SEED_NAMES), """
  SELECT sample_id, side, CASE WHEN length(text) > 1000 THEN substr(text, 1, 1000) || '...' ELSE text END AS text, toxicity, insult, """ + ", ".join(
    f"max(reward) FILTER (model_id = '{s}') AS {s}" for s in sc.SEED_NAMES) + " FROM rewards JOIN prompts ON prompt_id = sample_id GROUP BY sample_id, side, text, toxicity, insult")))
def k6(spark, d):
    texts = sc.prompts(spark, d).select(F.col("prompt_id").alias("sample_id"), "prompt.text", "prompt.toxicity", "prompt.insult")
    return tidy(ensemble.score_table(sc.rewards(spark, d), texts, sc.SEED_NAMES))


@query("k7_prediction_records", with_tables("rewards", rounded("sample_id side predictions", "ensemble", """
  SELECT sample_id, side, avg(reward) AS ensemble, string_agg(model_id || '=' || round(reward * 1000)::BIGINT, ' ' ORDER BY model_id) AS predictions
  FROM rewards GROUP BY sample_id, side""")))
def k7(spark, d):
    """All predictions of a sample, in thousandths."""
    records = ensemble.prediction_records(sc.rewards(spark, d))
    shown = F.transform("predictions", lambda p: F.concat(p["model_id"], F.lit("="), F.round(p["reward"] * 1000).cast("bigint").cast("string")))
    return tidy(records.select("sample_id", "side", "ensemble", F.array_join(shown, " ").alias("predictions")))


# ---- losses --------------------------------------------------------------------------------------------------

_X = "(detoxified - original)"
_LOSSES = {
    "max_margin": f"avg(greatest(0.1 - {_X}, 0.0))",
    "asymmetric_margin": f"avg(CASE WHEN {_X} > 0 THEN -1.0 * {_X} ELSE -2.0 * {_X} END)",
    "confidence_margin": f"avg(greatest(0.1 + 0.5 * abs({_X}) - {_X}, 0.0))",
    "max_entropy": f"avg(greatest(-{_X} / 0.1, 0.0) + ln(1 + exp(-abs({_X} / 0.1))))",
}


def _loss_query(number: int, method: str) -> None:
    sql = with_tables("reward_pairs", rounded("model_id", method, f"SELECT model_id, {_LOSSES[method]} AS {method} FROM reward_pairs GROUP BY model_id"))

    @query(f"l{number}_{method}", sql)
    def run(spark, d):
        return tidy(losses.pairwise_loss(reward_pairs(spark, d), ["model_id"], [method]))


for _i, _method in enumerate(_LOSSES, 1):
    _loss_query(_i, _method)


@query("l5_loss_by_method", with_tables("reward_pairs", rounded("model_id", "max_margin asymmetric_margin confidence_margin max_entropy unknown", "SELECT model_id, " + ", ".join(
    f"{e} AS {m}" for m, e in {**_LOSSES, "unknown": _LOSSES["max_margin"]}.items()) + " FROM reward_pairs GROUP BY model_id")))
def l5(spark, d):
    return tidy(losses.pairwise_loss(reward_pairs(spark, d), ["model_id"], [*_LOSSES, "unknown"]))


@query("l6_zscore", with_tables("rewards", rounded("sample_id side model_id", "normalized", """
  SELECT sample_id, side, model_id, CASE WHEN count(*) OVER w <= 1 THEN reward WHEN stddev_samp(reward) OVER w > 1e-8 THEN (reward - avg(reward) OVER w) / stddev_samp(reward) OVER w
    ELSE reward - avg(reward) OVER w END AS normalized FROM rewards WINDOW w AS (PARTITION BY model_id, sample_id // 32)""")))
def l6(spark, d):
    rows = sc.rewards(spark, d).withColumn("batch_id", F.expr("sample_id div 32"))
    return tidy(losses.zscore(rows, ["model_id", "batch_id"]).select("sample_id", "side", "model_id", "normalized"))


def vector_pairs(spark, d):
    vectors = sc.table(spark, d, "embeddings").select(F.expr("vec_id div 2").alias("sample_id"), "vec_id", "embedding")
    left = vectors.where("vec_id % 2 = 0").select("sample_id", F.col("embedding").alias("original"))
    right = vectors.where("vec_id % 2 = 1").select("sample_id", F.col("embedding").alias("detoxified"))
    return left.join(right, "sample_id")


def _newton_sql(steps: int = 6, size: int = 64, ridge: float = 1e-6) -> str:
    """Newton steps for the max-entropy loss, each with its own gradient, Hessian and elimination; losses before and after."""
    dims = f"range(1, {size + 1})"
    parts = [f"""x AS MATERIALIZED (SELECT list_transform({dims}, lambda i: (d.embedding[i]::DOUBLE - o.embedding[i]::DOUBLE) / 0.1) AS x
      FROM embeddings o JOIN embeddings d ON o.vec_id % 2 = 0 AND d.vec_id = o.vec_id + 1)""",
             f"w0 AS MATERIALIZED (SELECT list_transform({dims}, lambda i: 0.0::DOUBLE) AS w)"]
    for k in range(steps):
        parts += [
            f"p{k} AS MATERIALIZED (SELECT x, 1 / (1 + exp(list_dot_product(x, w))) AS p FROM x, w{k})",
            f"""g{k} AS MATERIALIZED (SELECT i, -avg(p * x[i]) + {ridge} * any_value(w[i]) AS g FROM p{k}, w{k}, {dims} AS a(i) GROUP BY i)""",
            f"""h{k} AS MATERIALIZED (SELECT i, j, avg(p * (1 - p) * x[i] * x[j]) + CASE WHEN i = j THEN {ridge} ELSE 0 END AS h
              FROM p{k}, {dims} AS a(i), {dims} AS b(j) GROUP BY i, j)""",
            f"""m{k} AS MATERIALIZED (SELECT list(row ORDER BY i) AS m FROM (
              SELECT i, list_append(list(h ORDER BY j), any_value(g)) AS row FROM h{k} JOIN g{k} USING (i) GROUP BY i))""",
            f"""e{k} AS MATERIALIZED (SELECT list_reduce({dims}, lambda m, k: list_transform(m, lambda row, i: CASE WHEN i = k
              THEN list_transform(row, lambda v: v / row[k])
              ELSE list_transform(row, lambda v, j: v - row[k] / m[k][k] * m[k][j]) END), m) AS m FROM m{k})""",
            f"w{k + 1} AS MATERIALIZED (SELECT list_transform({dims}, lambda i: w[i] - m[i][{size + 1}]) AS w FROM w{k}, e{k})",
        ]
    loss = "SELECT '{}' AS head, avg(greatest(-z, 0.0) + ln(1 + exp(-abs(z)))) AS max_entropy FROM (SELECT list_dot_product(x, w) AS z FROM x, {})"
    return f"WITH {', '.join(parts)} {loss.format('fitted', f'w{steps}')} UNION ALL {loss.format('zero', 'w0')}"


@query("l7_reward_head", rounded("head", "max_entropy", _newton_sql()))
def l7(spark, d):
    """Loss before and after the fit, scored over all pairs."""
    from scorelens.functions.numeric import value_head
    from scorelens.operators.reward_head import fit_reward_head

    pairs = vector_pairs(spark, d)
    weights = fit_reward_head(pairs, "original", "detoxified")
    scored = pairs.select("sample_id", value_head(F.col("original"), weights).alias("original"), value_head(F.col("detoxified"), weights).alias("detoxified"))
    fitted = losses.pairwise_loss(scored, [], ["max_entropy"]).withColumn("head", F.lit("fitted"))
    zero = losses.pairwise_loss(scored.withColumns({"original": F.lit(0.0), "detoxified": F.lit(0.0)}), [], ["max_entropy"]).withColumn("head", F.lit("zero"))
    return tidy(fitted.unionByName(zero))


@query("l8_metric_history", with_tables("rewards", rounded("model_id epoch tp fp tn fn positives negatives", f"accuracy f1 roc_auc pr_auc {_MEAN_NAMES} loss", f"""
  WITH r AS (SELECT *, (sample_id % 4 * 20)::INTEGER AS epoch, (side = 'original')::INT AS label FROM rewards)
  SELECT * FROM (SELECT *, {_F1} FROM (SELECT model_id, epoch, {_CONFUSION} FROM (SELECT *, (reward <= avg(reward) OVER (PARTITION BY model_id, epoch))::INT AS prediction FROM r) GROUP BY model_id, epoch))
  JOIN ({auc_sql('SELECT * FROM r', 'model_id, epoch', '-reward', 'label')}) USING (model_id, epoch)
  JOIN ({_MEANS.replace('SELECT model_id', 'SELECT model_id, epoch').replace('FROM rewards GROUP BY model_id', 'FROM r GROUP BY model_id, epoch')}) USING (model_id, epoch)
  JOIN (SELECT model_id, epoch, {_LOSSES['max_margin']} AS loss FROM (SELECT model_id, epoch, sample_id, max(reward) FILTER (side = 'original') AS original,
    max(reward) FILTER (side = 'detoxified') AS detoxified FROM r GROUP BY ALL) GROUP BY model_id, epoch) USING (model_id, epoch)""")))
def l8(spark, d):
    rows = sc.rewards(spark, d).withColumn("epoch", (F.col("sample_id") % 4 * 20).cast("int"))
    return tidy(losses.metric_history(rows, ["model_id"], pair_keys=["sample_id"]))
