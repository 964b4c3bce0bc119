"""Queries for scoring (D), reshaping (E) and joins and splits (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelens.functions import numeric as num
from scorelens.functions.text import epoch_of
from scorelens.operators import delta, metrics, pairing, reshape, scoring
from scorelens.plans import evaluation
from scorelens.plans import scenario as sc
from scorelens.plans.registry import query
from scorelens.plans.scenario import rounded, tidy, with_tables
from scorelens.plans.statistics_queries import (
    _LEX, _VARIANT_NUMBERS, _VARIANTS, deltas, lexical_sql, paired, primary, wide_scores,
)

from scorelens.sources import readers, writers
from scorelens.storage import materialize, scratch_path

def word_list(label: str) -> str:
    return "(" + ", ".join(f"'{w}'" for w in scoring.LEXICON[label]) + ")"


def _length_loader():
    """Example batch scorer: no model file, two labels from simple counts."""

    def predict(texts):
        out = []
        for text in texts:
            if not text:
                raise ValueError("empty text")
            upper = sum(1 for c in text if "A" <= c <= "Z") / len(text)
            out.append({"toxic": upper, "neutral": 1.0 - upper})
        return out

    return predict


scoring.register_scorer("upper_share", _length_loader, ["toxic", "neutral"], "toxic", fallback=scoring.SAFE_FALLBACK)

_LEX_ROWS = " UNION ALL ".join(f"SELECT doc_id, '{label}' AS label, {lexical_sql('text', word_list(label))} AS score FROM documents" for label in scoring.LEXICON)


@query("d1_bulk_classify", rounded("doc_id label", "score", _LEX_ROWS))
def d1(spark, d):
    docs = sc.table(spark, d, "documents").select("doc_id", "text")
    scored = scoring.score_texts(docs, "text", ["lexical"])
    return tidy(reshape.explode_labels(scored.select("doc_id", "labels")))


@query("d1_batch_scorer", rounded("doc_id label failed", "score", """
  SELECT doc_id, l.label, false AS failed, CASE l.label WHEN 'toxic' THEN up ELSE 1.0 - up END AS score
  FROM (SELECT doc_id, length(regexp_replace(text, '[^A-Z]', '', 'g'))::DOUBLE / length(text) AS up FROM documents WHERE length(text) > 0)
  CROSS JOIN (VALUES ('toxic'), ('neutral')) l(label)
  UNION ALL SELECT doc_id, 'safe', true, 1.0 FROM documents WHERE length(text) = 0"""))
def d1_batch(spark, d):
    docs = sc.table(spark, d, "documents").select("doc_id", "text")
    scored = scoring.score_texts(docs, "text", ["upper_share"])
    return tidy(scored.select("doc_id", "failed", F.explode("labels").alias("label", "score")))


@query("d1_classify_generations", with_tables("pairs", rounded("prompt_id model text_type label", "score", " UNION ALL ".join(
    f"SELECT sample_id AS prompt_id, '{m}' AS model, '{t}' AS text_type, '{label}' AS label, {lexical_sql(text, word_list(label))} AS score FROM pairs"
    for m, output in (("base", "original_output"), ("tuned", "detoxified_output"))
    for t, text in (("prompt", "prompt"), ("output", output), ("full_text", f"prompt || ' ' || {output}"))
    for label in scoring.LEXICON))))
def d1_generations(spark, d):
    """Prompt, output and full text of two models, classified and exploded to score rows."""
    pairs = sc.pairs(spark, d)
    generations = pairs.select(F.col("sample_id").alias("prompt_id"), "prompt", F.inline(F.array(
        F.struct(F.lit("base").alias("model"), F.col("original_output").alias("output")),
        F.struct(F.lit("tuned").alias("model"), F.col("detoxified_output").alias("output")))))
    scores = evaluation.scores_of(evaluation.classify_generations(generations, ["lexical"]))
    return tidy(scores.select("prompt_id", "model", "text_type", "label", "score"))


@query("d2_score_variants", with_tables("pairs", rounded("sample_id", _VARIANT_NUMBERS, _VARIANTS)))
def d2(spark, d):
    return tidy(scoring.score_variants(sc.pairs(spark, d), "lexical"))


def heads() -> dict[str, list[float]]:
    return {f"seed_{s}": [round(((i * (s + 3)) % 61) / 61 - 0.5, 6) for i in range(64)] for s in range(42, 47)}


@query("d3_score_with_models", rounded("vec_id model_id", "reward", " UNION ALL ".join(
    f"SELECT vec_id, '{name}' AS model_id, list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * {w}[i]::DOUBLE)) AS reward FROM embeddings"
    for name, w in heads().items())))
def d3(spark, d):
    vectors = sc.table(spark, d, "embeddings").select("vec_id", "embedding")
    return tidy(scoring.score_with_models(vectors, "embedding", heads()).select("vec_id", "model_id", "reward"))


@query("d4_score_once", rounded("doc_id classifier", "score", f"""
  SELECT doc_id, 'lexical' AS classifier, {lexical_sql('text', word_list('toxic'))} AS score FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT doc_id, 'upper_share', length(regexp_replace(text, '[^A-Z]', '', 'g'))::DOUBLE / nullif(length(text), 0) FROM documents WHERE text IS NOT NULL"""))
def d4(spark, d):
    """Two scorers over texts with copies; every distinct text is scored once."""
    docs = sc.table(spark, d, "documents").select("doc_id", "text")
    scored = scoring.score_texts(docs, "text", ["lexical", "upper_share"])
    return tidy(scored.select("doc_id", "classifier", F.try_element_at("labels", F.lit("toxic")).alias("score")))


@query("d5_safe_fallback", rounded("doc_id failed", "safe", """SELECT doc_id, (doc_id % 10 = 0 OR text = '') AS failed, CASE WHEN doc_id % 10 = 0 OR text = '' THEN 1.0 END AS safe FROM documents WHERE text IS NOT NULL"""))
def d5(spark, d):
    """Empty texts make the scorer fail and get the safe labels."""
    docs = sc.table(spark, d, "documents").where("text is not null").select(
        "doc_id", F.when(F.col("doc_id") % 10 == 0, F.lit("")).otherwise(F.col("text")).alias("text"))
    scored = scoring.score_texts(docs, "text", ["upper_share"])
    return tidy(scored.select("doc_id", "failed", F.try_element_at("labels", F.lit("safe")).alias("safe")))


@query("d6_binary_prediction", with_tables("primary_scores", "SELECT prompt_id, model, classifier, (score >= 0.5)::INTEGER AS prediction FROM primary_scores WHERE text_type = 'output'"))
def d6(spark, d):
    return primary(spark, d).select("prompt_id", "model", "classifier", num.binary_prediction(F.col("score")).alias("prediction"))


@query("d7_scoring_summary", rounded("source", "mean std min max", f"""SELECT source, avg(s) AS mean, stddev_pop(s) AS std, min(s) AS min, max(s) AS max
  FROM (SELECT source, {lexical_sql('text')} AS s FROM documents) GROUP BY source"""))
def d7(spark, d):
    docs = sc.table(spark, d, "documents").select("source", "text")
    score = F.col("labels")["toxic"]
    return tidy(scoring.scoring_summary(scoring.score_texts(docs, "text", ["lexical"]).withColumn("score", score), ["source"]))


# ---- reshape -------------------------------------------------------------------------------------------------

@query("e1_comprehensive_union", with_tables("primary_scores", rounded("prompt_id model classifier extra", "score", """
  SELECT prompt_id, model, classifier, score, CASE WHEN model = 'base' THEN NULL ELSE 'tuned' END AS extra FROM primary_scores
  WHERE text_type = 'output'""")))
def e1(spark, d):
    """Frames of one folder per model, the base without the column ``extra``, read in one scan."""
    scores = materialize(primary(spark, d).select("prompt_id", "classifier", "score", "model"), "scores")
    path = scratch_path(spark, "models")
    writers.write_frames(scores.where("model = 'base'"), path, ["model"])
    writers.write_frames(scores.where("model <> 'base'").withColumn("extra", F.lit("tuned")), path, ["model"])
    return tidy(readers.read_frames(spark, path, {"model": "string"}))


@query("e1_union_of_loose_frames", with_tables("primary_scores", rounded("prompt_id model classifier extra", "score", """
  SELECT prompt_id, model, classifier, score, CASE WHEN model = 'base' THEN NULL ELSE 'tuned' END AS extra FROM primary_scores
  WHERE text_type = 'output'""")))
def e1_loose(spark, d):
    """Frames that come from different places."""
    scores = primary(spark, d).select("prompt_id", "classifier", "score", F.col("model").alias("m"))
    frames = {m[0]: scores.where(F.col("m") == m[0]).drop("m") for m in sc.MODELS}
    frames = {m: df if m == "base" else df.withColumn("extra", F.lit("tuned")) for m, df in frames.items()}
    return tidy(reshape.union_models(frames))


@query("e1_models_by_folder", with_tables("primary_scores", rounded("prompt_id classifier model", "score", """
  SELECT prompt_id, classifier, model, score FROM primary_scores WHERE text_type = 'output' AND model IN ('base', 'detox_epoch_40')""")))
def e1_folders(spark, d):
    """Two of the models; the folders of the others are not read."""
    path = scratch_path(spark, "models")
    writers.write_frames(primary(spark, d).select("prompt_id", "classifier", "score", "model"), path, ["model"])
    return tidy(readers.read_frames(spark, path, {"model": "string"}).where(F.col("model").isin("base", "detox_epoch_40")))


@query("e2_schema_discovery", with_tables("primary_scores", """SELECT CASE text_type WHEN 'prompt' THEN 'prompt_' || classifier || '_score'
  WHEN 'output' THEN 'output_' || model || '_' || classifier || '_score' ELSE 'full_' || model || '_' || classifier || '_score' END AS "column",
  text_type, CASE text_type WHEN 'prompt' THEN 'prompt' ELSE model END AS model, classifier, '' AS label, count(score) AS cells FROM primary_scores
  WHERE text_type <> 'prompt' OR model = 'base' GROUP BY ALL"""))
def e2(spark, d):
    return reshape.discovered_columns(wide_scores(spark, d), sc.CLASSIFIERS)


@query("e3_wide_to_long", with_tables("primary_scores", rounded("prompt_id model text_type classifier label", "score", """
  SELECT prompt_id, CASE text_type WHEN 'prompt' THEN 'prompt' ELSE model END AS model, text_type, classifier, '' AS label, score FROM primary_scores
  WHERE text_type <> 'prompt' OR model = 'base'""")))
def e3(spark, d):
    return tidy(reshape.to_long(wide_scores(spark, d), ["prompt_id"], sc.CLASSIFIERS))


_WIDE_NAMES = [f"output_{m[0]}_{c}_score" for m in sc.MODELS for c in sc.CLASSIFIERS]


@query("e4_long_to_wide", with_tables("primary_scores", rounded("prompt_id", " ".join(_WIDE_NAMES), "SELECT prompt_id, " + ", ".join(
    f"max(score) FILTER (model = '{m[0]}' AND classifier = '{c}') AS output_{m[0]}_{c}_score" for m in sc.MODELS for c in sc.CLASSIFIERS) +
    " FROM primary_scores WHERE text_type = 'output' GROUP BY prompt_id")))
def e4(spark, d):
    scores = primary(spark, d).withColumn("name", F.concat_ws("_", "text_type", "model", "classifier", F.lit("score")))
    return tidy(reshape.to_wide(scores, ["prompt_id"], _WIDE_NAMES))


@query("e5_map_to_rows", with_tables("label_scores", rounded("prompt_id model text_type classifier label", "score", "SELECT prompt_id, model, text_type, classifier, label, score FROM label_scores")))
def e5(spark, d):
    return tidy(reshape.explode_labels(sc.classifications(spark, d).drop("epoch")))


@query("e6_epoch_union", with_tables("primary_scores", rounded("sample_index epoch epoch_index classifier", "score", """
  SELECT prompt_id AS sample_index, epoch, (epoch // 20)::INTEGER AS epoch_index, classifier, score FROM primary_scores WHERE text_type = 'output'""")))
def e6(spark, d):
    """One folder per epoch, one scan for all of them."""
    path = scratch_path(spark, "epochs")
    writers.write_frames(primary(spark, d).select(F.col("prompt_id").alias("sample_index"), "epoch", "classifier", "score"), path, ["epoch"])
    rows = reshape.number_epochs(readers.read_frames(spark, path, {"epoch": "int"}))
    return tidy(rows.orderBy("epoch", "sample_index"))


@query("e7_heatmap_pivot", with_tables("primary_paired", rounded("model", " ".join(sc.CLASSIFIERS), "SELECT model, " + ", ".join(
    f"coalesce(avg(delta) FILTER (classifier = '{c}' AND NOT (model = 'detox_epoch_20' AND classifier = 'toxic_bert')), 0) AS {c}" for c in sc.CLASSIFIERS) +
    " FROM primary_paired WHERE text_type = 'output' GROUP BY model")))
def e7(spark, d):
    rows = deltas(spark, d).where("not (model = 'detox_epoch_20' and classifier = 'toxic_bert')")
    return tidy(reshape.heatmap(rows, "model", "classifier", sc.CLASSIFIERS, "delta"))


@query("e8_column_classes", with_tables("primary_scores", """SELECT 'score' AS class, 39::BIGINT AS columns, count(score) AS cells FROM primary_scores WHERE text_type <> 'prompt' OR model = 'base'
  UNION ALL SELECT 'prompt', 1, count(*) FROM documents"""))
def e8(spark, d):
    return reshape.column_classes(wide_scores(spark, d))


@query("e9_missing_profile", with_tables("prompts", " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS nulls FROM prompts) WHERE nulls > 0" for c in ("prompt_id", *sc.ATTRIBUTES))))
def e9(spark, d):
    return reshape.missing_profile(sc.prompts(spark, d).select("prompt_id", *[f"prompt.{a}" for a in sc.ATTRIBUTES]))


_MODEL_NAMES = [m[0] for m in sc.MODELS]


@query("e10_score_matrix", with_tables("primary_scores", rounded("prompt_id", " ".join(_MODEL_NAMES), "SELECT prompt_id, " + ", ".join(
    f"max(score) FILTER (model = '{m}') AS {m}" for m in _MODEL_NAMES) + " FROM primary_scores WHERE text_type = 'output' AND classifier = 'toxic_bert' AND prompt_id < 20 GROUP BY prompt_id")))
def e10(spark, d):
    rows = primary(spark, d).where("classifier = 'toxic_bert'")
    return tidy(reshape.score_matrix(rows, _MODEL_NAMES))


# ---- joins and splits ----------------------------------------------------------------------------------------

def sample_ids(spark, d):
    return sc.table(spark, d, "documents").select(F.col("doc_id").alias("sample_id"))


def corpora(spark, d):
    """Two corpora of unequal length: all documents, and the labels of some of them."""
    left = sc.table(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), "n_chars")
    right = sc.table(spark, d, "labels").select(F.col("doc_id").alias("sample_id"), "quality", "toxic")
    return left, right


@query("f1_pair_join", "SELECT doc_id AS sample_id, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)")
def f1(spark, d):
    return pairing.pair(*corpora(spark, d))


@query("f1_conversation_pairs", """SELECT a.conv_id, a.turn, a.text AS prompt, b.text AS output FROM conversations a JOIN conversations b
  ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'""")
def f1_conversations(spark, d):
    """A user turn and the assistant turn that follows it."""
    turns = sc.table(spark, d, "conversations")
    prompts = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    answers = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    return prompts.join(answers, ["conv_id", "turn"])


@query("f1_unmatched_counts", """SELECT count(*) FILTER (d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL) AS paired, count(*) FILTER (l.doc_id IS NULL) AS left_only,
  count(*) FILTER (d.doc_id IS NULL) AS right_only FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id""")
def f1_counts(spark, d):
    return pairing.pair_counts(*corpora(spark, d))


@query("f2_baseline_join", with_tables("paired", rounded("prompt_id model text_type classifier label", "score base_value", "SELECT prompt_id, model, text_type, classifier, label, score, base_value FROM paired")))
def f2(spark, d):
    return tidy(paired(spark, d, False).drop("epoch"))


@query("f3_ordered_split", "SELECT doc_id AS sample_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= floor(0.8 * count(*) OVER ()) THEN 'train' ELSE 'test' END AS split FROM documents")
def f3(spark, d):
    return pairing.split_by_order(sample_ids(spark, d), "sample_id", 0.8)


@query("f4_seeded_split", with_tables("doc_split", "SELECT * FROM doc_split"))
def f4(spark, d):
    return pairing.split_by_hash(sample_ids(spark, d), "sample_id", 0.8, unique=True)


@query("f4_threshold_split", f"SELECT doc_id AS sample_id, CASE WHEN {sc.u(repr('42'), 'doc_id')} < 0.8 THEN 'train' ELSE 'test' END AS split FROM documents")
def f4_threshold(spark, d):
    return pairing.split_by_threshold(sample_ids(spark, d), "sample_id", 0.8)


@query("f5_held_out_split", """SELECT doc_id AS sample_id, CASE WHEN row_number() OVER (ORDER BY md5(concat_ws(':', '7', doc_id)), doc_id) <= floor(0.9 * count(*) OVER ())
  THEN 'train' ELSE 'test' END AS split FROM documents""")
def f5(spark, d):
    return pairing.split_by_hash(sample_ids(spark, d), "sample_id", 0.9, seed=7, unique=True)


@query("f6_identical_pairs", with_tables("pairs", rounded("identical pairs", "percent", """SELECT count(*) FILTER (original_output = detoxified_output) AS identical,
  count(*) AS pairs, 100.0 * avg((original_output = detoxified_output)::INT) AS percent FROM pairs""")))
def f6(spark, d):
    return tidy(pairing.identical_pairs(sc.pairs(spark, d)))


_GAPS = """SELECT prompt_id, model, text_type, classifier, CASE WHEN prompt_id % 7 = 0 THEN NULL ELSE label END AS label, score
  FROM scores WHERE text_type = 'output' AND NOT (model = 'base' AND prompt_id % 5 = 0)"""


def gaps(spark, d):
    """Scores with NULL labels, and without the baseline of every fifth prompt."""
    rows = sc.scores(spark, d, text_types=["output"]).where(~((F.col("model") == "base") & (F.col("prompt_id") % 5 == 0)))
    return rows.withColumn("label", F.when(F.col("prompt_id") % 7 != 0, F.col("label"))).drop("epoch")


@query("f2_unmatched_rows", with_tables("scores", f"""WITH g AS ({_GAPS}) SELECT model, count(*) AS rows, count(*) FILTER (NOT EXISTS (SELECT 1 FROM g b
  WHERE b.model = 'base' AND b.prompt_id = g.prompt_id AND b.classifier = g.classifier AND b.label IS NOT DISTINCT FROM g.label)) AS unmatched
  FROM g WHERE model <> 'base' GROUP BY model"""))
def f2_unmatched(spark, d):
    """Rows of each model that have no baseline."""
    from scorelens.operators.delta import unmatched

    return unmatched(gaps(spark, d))


@query("f2_null_labels", with_tables("scores", rounded("model classifier label n", "base_mean score_mean", f"""
  SELECT model, classifier, label, count(*) AS n, avg(base_value) AS base_mean, avg(score) AS score_mean FROM (
    SELECT g.*, b.base_value FROM ({_GAPS}) g JOIN (SELECT prompt_id, classifier, label, avg(score) AS base_value FROM ({_GAPS}) WHERE model = 'base' GROUP BY ALL) b
      ON b.prompt_id = g.prompt_id AND b.classifier = g.classifier AND b.label IS NOT DISTINCT FROM g.label WHERE g.model <> 'base')
  GROUP BY model, classifier, label""")))
def f2_null_labels(spark, d):
    """NULL labels match each other; several of one sample count as repeats."""
    from scorelens.operators.delta import with_baseline

    rows = with_baseline(gaps(spark, d))
    return tidy(rows.groupBy("model", "classifier", "label").agg(
        F.count("*").alias("n"), F.avg("base_value").alias("base_mean"), F.avg("score").alias("score_mean")))


@query("f7_experiment_join", with_tables("samples", rounded("experiment model_size size_order input_type n", "toxicity_threshold mean", """
  SELECT experiment, model_size, size_order, input_type, toxicity_threshold, count(*) AS n, avg(improvement) AS mean FROM samples JOIN experiments USING (experiment) GROUP BY ALL""")))
def f7(spark, d):
    from scorelens.operators.experiments import with_improvement

    joined = pairing.with_experiment(with_improvement(sc.samples(spark, d)), sc.experiment_dimension(spark))
    keys = ["experiment", "model_size", "size_order", "input_type", "toxicity_threshold"]
    return tidy(joined.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("improvement").alias("mean")))


@query("f8_cross_experiment_samples", with_tables("samples", rounded("sample_id experiments", "mean_improvement", """
  SELECT sample_id, count(*) AS experiments, avg(improvement) AS mean_improvement FROM samples GROUP BY sample_id""")))
def f8(spark, d):
    from scorelens.operators.experiments import with_improvement

    return tidy(with_improvement(sc.samples(spark, d)).groupBy("sample_id").agg(
        F.count("*").alias("experiments"), F.avg("improvement").alias("mean_improvement")))




@query("f9_model_pairs", with_tables("rewards", rounded("i j", "correlation", """
  SELECT a.model_id AS i, b.model_id AS j, corr(a.reward, b.reward) AS correlation FROM rewards a JOIN rewards b USING (sample_id, side) GROUP BY ALL""")))
def f9(spark, d):
    wide = sc.rewards(spark, d).groupBy("sample_id", "side").pivot("model_id", sc.SEED_NAMES).agg(F.max("reward"))
    return tidy(metrics.correlation_matrix(wide, sc.SEED_NAMES))


@query("f10_complete_pairs", with_tables("primary_paired", rounded("prompt_id model classifier quality", "base_value score", """
  SELECT prompt_id, model, classifier, base_value, score, quality FROM primary_paired JOIN labels ON doc_id = prompt_id WHERE text_type = 'output'""")))
def f10(spark, d):
    """Only labelled documents have a quality; rows without one are left out."""
    labels = sc.table(spark, d, "labels").select(F.col("doc_id").alias("prompt_id"), "quality")
    rows = paired(spark, d, text_types=["output"]).join(labels, "prompt_id", "left")
    complete = pairing.complete_pairs(rows, "base_value", "score", "quality")
    return tidy(complete.select("prompt_id", "model", "classifier", "quality", "base_value", "score"))


@query("f11_shuffled_batches", """SELECT doc_id AS sample_id, ((row_number() OVER (ORDER BY md5(concat_ws(':', '3', doc_id)), doc_id) - 1) // 16)::BIGINT AS batch_id FROM documents""")
def f11(spark, d):
    return pairing.shuffled_batches(sample_ids(spark, d), "sample_id", 16, seed=3)
