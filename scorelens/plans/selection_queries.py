"""Queries for prompt selection (B) and scalar functions (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelens.functions import labels as lab
from scorelens.functions import numeric as num
from scorelens.functions import text as tx
from scorelens.operators import prompts as pr
from scorelens.operators import reshape
from scorelens.plans import scenario as sc
from scorelens.plans.registry import query
from scorelens.plans.scenario import rounded, tidy, u, with_tables

_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def chosen(selected):
    return selected.select("prompt_id", F.col("prompt.text").alias("text"), F.col("prompt.toxicity").alias("toxicity"))


def selection(where: str, tail: str = "") -> str:
    return with_tables("prompts", rounded("prompt_id text", "toxicity", f"SELECT prompt_id, text, toxicity FROM prompts WHERE {where} {tail}"))


@query("b1_threshold_first_n", selection("toxicity >= 0.5", "ORDER BY prompt_id LIMIT 100"))
def b1(spark, d):
    return tidy(chosen(pr.select_prompts(sc.prompts(spark, d), min_score=0.5, limit=100)))


@query("b2_strict_threshold_first_n", selection("toxicity > 0.8", "ORDER BY prompt_id LIMIT 100"))
def b2(spark, d):
    return tidy(chosen(pr.select_prompts(sc.prompts(spark, d), min_score=0.8, inclusive=False, limit=100)))


@query("b3_any_metric_threshold", selection("toxicity > 0.9 OR insult > 0.9 OR threat > 0.9", "ORDER BY prompt_id LIMIT 500"))
def b3(spark, d):
    any_of = ["prompt.toxicity", "prompt.insult", "prompt.threat"]
    return tidy(chosen(pr.select_prompts(sc.prompts(spark, d), any_of=any_of, min_score=0.9, inclusive=False, limit=500)))


@query("b4_range_filter", selection("toxicity BETWEEN 0.3 AND 0.7"))
def b4(spark, d):
    return tidy(chosen(pr.select_prompts(sc.prompts(spark, d), min_score=0.3, max_score=0.7)))


@query("b5_top_k", selection("true", "ORDER BY insult DESC NULLS LAST, prompt_id LIMIT 50"))
def b5(spark, d):
    return tidy(chosen(pr.select_prompts(sc.prompts(spark, d), score="prompt.insult", top_k=50)))


@query("b6_seeded_sample", selection("true", "ORDER BY md5(concat_ws(':', '7', prompt_id)), prompt_id LIMIT 60"))
def b6(spark, d):
    return tidy(chosen(pr.select_prompts(sc.prompts(spark, d), sample=60, seed=7)))


@query("b7_first_n", selection("true", "ORDER BY prompt_id LIMIT 100"))
def b7(spark, d):
    return tidy(chosen(pr.select_prompts(sc.prompts(spark, d), limit=100)))


@query("b8_clean_text", f"SELECT doc_id, {_STRIP.format('t')} AS text FROM (SELECT doc_id, CASE WHEN doc_id % 19 = 0 THEN chr(9) || ' ' ELSE '  ' || text || chr(10) END AS t FROM documents) WHERE length({_STRIP.format('t')}) > 0")
def b8(spark, d):
    docs = sc.table(spark, d, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 19 == 0, F.lit("\t ")).otherwise(F.concat(F.lit("  "), "text", F.lit("\n"))).alias("text"))
    return pr.clean_text(docs, "text", key="doc_id")


@query("b9_distinct_first", f"SELECT min(doc_id) AS doc_id, t AS text FROM (SELECT doc_id, {_STRIP.format('text')} AS t FROM documents) WHERE length(t) > 0 GROUP BY t")
def b9(spark, d):
    return pr.clean_text(sc.table(spark, d, "documents").select("doc_id", "text"), "text", key="doc_id", distinct=True)


@query("b10_length_bounds", rf"SELECT doc_id, t AS text FROM (SELECT doc_id, regexp_replace({_STRIP.format('text')}, '\s+', ' ', 'g') AS t FROM documents) WHERE length(t) BETWEEN 50 AND 2000")
def b10(spark, d):
    docs = sc.table(spark, d, "documents").select("doc_id", "text")
    return pr.clean_text(docs, "text", key="doc_id", normalize_ws=True, min_len=50, max_len=2000)


@query("b11_selection_summary", with_tables("prompts", rounded("n", "mean min max",
  "SELECT count(*) AS n, avg(toxicity) AS mean, min(toxicity) AS min, max(toxicity) AS max FROM prompts WHERE insult >= 0.5")))
def b11(spark, d):
    return tidy(pr.selection_summary(pr.select_prompts(sc.prompts(spark, d), score="prompt.insult", min_score=0.5)))


@query("b12_eval_sample", selection("true", "ORDER BY md5(concat_ws(':', '42', prompt_id)), prompt_id LIMIT 100"))
def b12(spark, d):
    return tidy(chosen(pr.select_prompts(sc.prompts(spark, d), sample=100)))


@query("b13_max_samples", "SELECT doc_id, text FROM documents WHERE length(text) > 0 ORDER BY doc_id LIMIT 400")
def b13(spark, d):
    docs = sc.table(spark, d, "documents").select("doc_id", "text").where(F.length("text") > 0)
    return pr.select_prompts(docs, key="doc_id", limit=400)


_TEMPLATES = ["Write about topic {index}.", "Say something on {index}", "Continue story {index}:"]


@query("b14_templates", f"""SELECT doc_id AS index, replace(t[(('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 3)::INT + 1], '{{index}}', doc_id::VARCHAR) AS prompt
  FROM documents, (SELECT {_TEMPLATES} AS t)""")
def b14(spark, d):
    rows = sc.table(spark, d, "documents").select(F.col("doc_id").alias("index"))
    return pr.expand_templates(rows, _TEMPLATES)


# ---- scalar functions ----------------------------------------------------------------------------------------

@query("c1_full_text", with_tables("pairs", """SELECT sample_id, CASE WHEN prompt = '' THEN original_output ELSE prompt || ' ' || original_output END AS full_text,
  CASE WHEN prompt = '' THEN original_output ELSE prompt || original_output END AS joined FROM pairs"""))
def c1(spark, d):
    p, o = F.col("prompt"), F.col("original_output")
    return sc.pairs(spark, d).select("sample_id", tx.full_text(p, o).alias("full_text"), tx.full_text(p, o, sep="").alias("joined"))


@query("c2_text_variants", with_tables("pairs", """SELECT sample_id, 'prompt_only' AS variant, prompt AS text FROM pairs
  UNION ALL SELECT sample_id, 'prompt_original', CASE WHEN prompt = '' THEN original_output ELSE prompt || ' ' || original_output END FROM pairs
  UNION ALL SELECT sample_id, 'prompt_detoxified', CASE WHEN prompt = '' THEN detoxified_output ELSE prompt || ' ' || detoxified_output END FROM pairs
  UNION ALL SELECT sample_id, 'original_output', original_output FROM pairs UNION ALL SELECT sample_id, 'detoxified_output', detoxified_output FROM pairs"""))
def c2(spark, d):
    from scorelens.operators.pairing import compose_variants

    return compose_variants(sc.pairs(spark, d))


@query("c3_prompt_removal", with_tables("pairs", f"""SELECT sample_id, {_STRIP.format("CASE WHEN strpos(c, prompt) > 0 THEN substr(c, 1, strpos(c, prompt) - 1) || substr(c, strpos(c, prompt) + length(prompt)) ELSE c END")} AS output
  FROM (SELECT sample_id, prompt, CASE WHEN sample_id % 3 = 0 THEN original_output ELSE prompt || ' ' || detoxified_output END AS c FROM pairs)"""))
def c3(spark, d):
    completion = F.when(F.col("sample_id") % 3 == 0, F.col("original_output")).otherwise(F.concat("prompt", F.lit(" "), "detoxified_output"))
    return sc.pairs(spark, d).select("sample_id", tx.remove_prompt(completion, F.col("prompt")).alias("output"))


@query("c4_display_text", "SELECT doc_id, " + ", ".join(
    f"CASE WHEN length(text) > {n} THEN substr(text, 1, {n}) || '...' ELSE text END AS text_{n}" for n in (1000, 100, 50)) + " FROM documents")
def c4(spark, d):
    return sc.table(spark, d, "documents").select("doc_id", *[tx.shorten(F.col("text"), n).alias(f"text_{n}") for n in (1000, 100, 50)])


@query("c5_label_normalisation", with_tables("primary_scores", rounded("prompt_id classifier label", "score", """
  SELECT prompt_id, classifier, CASE classifier WHEN 'toxic_bert' THEN 'identity_attack' WHEN 'roberta_toxicity' THEN 'toxic' ELSE 'hate' END AS label, score
  FROM primary_scores WHERE model = 'base' AND text_type = 'output'
  UNION ALL SELECT prompt_id, classifier, CASE classifier WHEN 'toxic_bert' THEN 'obscene' WHEN 'roberta_toxicity' THEN 'neutral' ELSE 'not_hate' END, 1.0 - score
  FROM primary_scores WHERE model = 'base' AND text_type = 'output'""")))
def c5(spark, d):
    """Raw upper-case labels; two names of one label keep the last score."""
    s = F.col("score")

    def entries(*rows):
        return F.array(*[F.struct(F.lit(n).alias("label"), v.alias("score")) for n, v in rows])

    raw = (
        F.when(F.col("classifier") == "toxic_bert", entries(("Identity_Hate", s), ("OBSCENE", 1.0 - s)))
        .when(F.col("classifier") == "roberta_toxicity", entries(("LABEL_NEUTRAL", 1.0 - s), ("Toxic", s - 5.0), ("very_toxic", s)))
        .otherwise(entries(("nothate", 1.0 - s), ("HATE", s)))
    )
    scores = sc.scores(spark, d, primary=True, text_types=["output"]).where("model = 'base'")
    maps = scores.select("prompt_id", "classifier", lab.normalize_labels(F.col("classifier"), raw).alias("labels"))
    return tidy(reshape.explode_labels(maps))


_NAMES = """SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'base' WHEN 1 THEN 'detox_epoch_' || (doc_id % 100) WHEN 2 THEN source || '-pythia-70m-checkpoint-' || (doc_id % 50)
  WHEN 3 THEN source || '-epoch-' || (doc_id % 30) WHEN 4 THEN lang || '-reward-' || (doc_id % 40) WHEN 5 THEN lang || '-' || (doc_id % 60) || '-seed' WHEN 6 THEN source || '-roberta-large'
  WHEN 7 THEN 'unitary/toxic-bert-' || lang ELSE 'EleutherAI/pythia-410m' END AS name FROM documents"""


def names(spark, d):
    i, s, g = F.col("doc_id"), F.col("source"), F.col("lang")

    def number(n):
        return (i % n).cast("string")

    case = (
        F.when(i % 9 == 0, F.lit("base"))
        .when(i % 9 == 1, F.concat(F.lit("detox_epoch_"), number(100)))
        .when(i % 9 == 2, F.concat(s, F.lit("-pythia-70m-checkpoint-"), number(50)))
        .when(i % 9 == 3, F.concat(s, F.lit("-epoch-"), number(30)))
        .when(i % 9 == 4, F.concat(g, F.lit("-reward-"), number(40)))
        .when(i % 9 == 5, F.concat(g, F.lit("-"), number(60), F.lit("-seed")))
        .when(i % 9 == 6, F.concat(s, F.lit("-roberta-large")))
        .when(i % 9 == 7, F.concat(F.lit("unitary/toxic-bert-"), g))
        .otherwise(F.lit("EleutherAI/pythia-410m"))
    )
    return sc.table(spark, d, "documents").select("doc_id", case.alias("name"))


@query("c6_epoch_extraction", f"""SELECT doc_id, name, CASE WHEN name = 'base' THEN 0 ELSE coalesce({', '.join(
    f"try_cast(nullif(regexp_extract(name, '{p}', 1), '') AS INTEGER)" for p in tx.EPOCH_PATTERNS)}) END AS epoch FROM ({_NAMES})""")
def c6(spark, d):
    return names(spark, d).withColumn("epoch", tx.epoch_of(F.col("name")))


@query("c7_base_model_name", rf"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(name, '-checkpoint-\d+$', ''), '-epoch-\d+$', ''), '-\d+$', '') AS base FROM ({_NAMES})")
def c7(spark, d):
    return names(spark, d).select("doc_id", tx.base_model_name(F.col("name")).alias("base"))


_DATASET = """SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN source ELSE 'EleutherAI_Pythia-' || (CASE doc_id % 3 WHEN 0 THEN '70m' WHEN 1 THEN '410m' ELSE '1b' END) || '_' || n_chars || '_samples_temp0p' || (doc_id % 10) || '_tox0p'
  || (doc_id % 7) || '_original' END AS name FROM documents"""


@query("c8_dataset_name_parse", f"""SELECT doc_id, coalesce(nullif(regexp_extract(lower(name), 'pythia-(\\d+[mb])', 1), ''), 'unknown') AS model_size,
  coalesce(replace(nullif(regexp_extract(lower(name), 'tox(\\d+p\\d+)', 1), ''), 'p', '.'), 'unknown') AS toxicity_threshold,
  coalesce(replace(nullif(regexp_extract(lower(name), 'temp(\\d+p\\d+)', 1), ''), 'p', '.'), 'unknown') AS temperature,
  coalesce(nullif(regexp_extract(lower(name), '(\\d+)_samples', 1), ''), 'unknown') AS sample_count FROM ({_DATASET})""")
def c8(spark, d):
    i = F.col("doc_id")
    size = F.when(i % 3 == 0, "70m").when(i % 3 == 1, "410m").otherwise("1b")
    built = F.concat(F.lit("EleutherAI_Pythia-"), size, F.lit("_"), F.col("n_chars").cast("string"), F.lit("_samples_temp0p"),
                     (i % 10).cast("string"), F.lit("_tox0p"), (i % 7).cast("string"), F.lit("_original"))
    name = F.when(i % 5 == 4, F.col("source")).otherwise(built)
    fields = tx.dataset_fields(name)
    return sc.table(spark, d, "documents").select("doc_id", fields.alias("f")).select("doc_id", "f.*")


@query("c9_dataset_name_build", """SELECT doc_id, replace('org/' || source, '/', '_') || '_' || n_chars || '_samples_temp0p7_tox0p' || (doc_id % 9 + 1) ||
  CASE WHEN doc_id % 2 = 0 THEN '_original' ELSE '_detoxified' END AS name FROM documents""")
def c9(spark, d):
    i = F.col("doc_id")
    name = tx.dataset_name(F.concat(F.lit("org/"), "source"), F.col("n_chars"), F.lit("0.7"), F.concat(F.lit("0."), (i % 9 + 1).cast("string")), i % 2 == 0)
    return sc.table(spark, d, "documents").select("doc_id", name.alias("name"))


def _class_sql(classes, default):
    return "CASE " + " ".join(
        f"WHEN {' OR '.join(f'''contains(lower(name), '{w}')''' for w in words)} THEN '{c}'" for c, words in classes) + f" ELSE '{default}' END"


@query("c10_model_family", f"""SELECT doc_id, {_class_sql(tx.FAMILY_KEYWORDS, 'sequence_classification')} AS family, {_class_sql(tx.SIZE_KEYWORDS, 'small_models')} AS size_class,
  ({' OR '.join(f"contains(lower(name), '{w}')" for w in tx.MULTI_LABEL_KEYWORDS)}) AS multi_label FROM ({_NAMES})""")
def c10(spark, d):
    n = F.col("name")
    return names(spark, d).select("doc_id", tx.model_family(n).alias("family"), tx.size_class(n).alias("size_class"), tx.is_multi_label(n).alias("multi_label"))


@query("c11_primary_score", with_tables("scores", rounded("prompt_id model text_type classifier", "score", """
  SELECT prompt_id, model, text_type, classifier, CASE WHEN prompt_id % 11 = 0 THEN 0.0 ELSE score END AS score FROM scores
  WHERE label = CASE classifier WHEN 'dynabench_hate' THEN 'hate' ELSE 'toxic' END""")))
def c11(spark, d):
    score = lab.primary_score(F.col("classifier"), F.col("labels"))
    return tidy(sc.classifications(spark, d).select("prompt_id", "model", "text_type", "classifier", score.alias("score")))


@query("c12_detailed_scores", with_tables("scores", rounded("prompt_id model series", "score", """
  SELECT prompt_id, model, 'output_' || classifier || CASE WHEN classifier = 'toxic_bert' THEN '_' || label ELSE '' END AS series,
    CASE WHEN prompt_id % 11 = 0 OR (prompt_id % 5 = 0 AND label = 'threat') THEN 0.0 ELSE score END AS score FROM scores
  WHERE text_type = 'output' AND label NOT IN ('neutral', 'not_hate')""")))
def c12(spark, d):
    rows = sc.classifications(spark, d).where("text_type = 'output'")
    series = lab.detailed_scores(F.col("classifier"), F.col("text_type"), F.col("labels"))
    return tidy(rows.select("prompt_id", "model", F.inline(series)).select("prompt_id", "model", "series", "score"))


@query("c13_dict_text", rounded("doc_id", "toxic neutral", f"""SELECT doc_id, CASE doc_id % 4 WHEN 3 THEN NULL ELSE n_chars / 1000.0 END AS toxic,
  CASE doc_id % 4 WHEN 0 THEN 0.5 END AS neutral FROM documents"""))
def c13(spark, d):
    """Printed dicts with numbers, None and broken text, and a map written and read back."""
    i, toxic = F.col("doc_id"), (F.col("n_chars") / 1000.0)
    printed = (
        F.when(i % 4 == 0, F.concat(F.lit("{'toxic': "), toxic.cast("string"), F.lit(", 'neutral': 0.5}")))
        .when(i % 4 == 1, F.concat(F.lit("{'toxic': "), toxic.cast("string"), F.lit(", 'neutral': None}")))
        .when(i % 4 == 2, lab.label_map_text(F.create_map(F.lit("toxic"), toxic)))
        .otherwise(F.lit("{'toxic': "))
    )
    parsed = lab.parse_label_map(printed)
    return tidy(sc.table(spark, d, "documents").select("doc_id", F.try_element_at(parsed, F.lit("toxic")).alias("toxic"),
                                                       F.try_element_at(parsed, F.lit("neutral")).alias("neutral")))


@query("c14_sanitise", with_tables("reward_events", rounded("event_id bad", "reward toxicity",
  "SELECT event_id, bad::INTEGER AS bad, clean AS reward, CASE WHEN bad THEN 0.5 ELSE clean END AS toxicity FROM reward_events")))
def c14(spark, d):
    r = F.col("reward")
    return tidy(sc.reward_events(spark, d).select(
        "event_id", num.is_bad(r).cast("int").alias("bad"), num.sanitize(r).alias("reward"), num.sanitize(r, 0.5).alias("toxicity")))


@query("c15_logits_score", rounded("vec_id", "single toxicity reward", """SELECT vec_id, embedding[1]::DOUBLE AS single,
  1 / (1 + exp(-(embedding[1]::DOUBLE))) AS toxicity, embedding[1]::DOUBLE AS reward FROM embeddings"""))
def c15(spark, d):
    vector = F.transform("embedding", lambda x: x.cast("double"))
    two, one = F.slice(vector, 1, 2), F.slice(vector, 1, 1)
    return tidy(sc.table(spark, d, "embeddings").select(
        "vec_id", num.logits_score(one).alias("single"), num.logits_score(two).alias("toxicity"), num.logits_score(two, as_reward=True).alias("reward")))


@query("c16_reward_inversion", with_tables("rewards", rounded("sample_id side model_id", "toxicity", "SELECT sample_id, side, model_id, -reward AS toxicity FROM rewards")))
def c16(spark, d):
    return tidy(sc.rewards(spark, d).select("sample_id", "side", "model_id", num.toxicity_of_reward(F.col("reward")).alias("toxicity")))


@query("c17_relative_change", with_tables("samples", rounded("sample_id experiment", "relative_improvement", "SELECT sample_id, experiment, relative_improvement FROM samples")))
def c17(spark, d):
    change = num.relative_change(F.col("original"), F.col("detoxified"))
    return tidy(sc.samples(spark, d).select("sample_id", "experiment", change.alias("relative_improvement")))


@query("c18_clip", rounded("l_orderkey l_linenumber l_partkey", "score", "SELECT l_orderkey, l_linenumber, l_partkey, greatest(0.0, least(1.0, l_extendedprice / 50000.0 - 0.1)) AS score FROM lineitem"))
def c18(spark, d):
    return tidy(sc.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", num.clip(F.col("l_extendedprice") / 50000.0 - 0.1).alias("score")))


_POOLED = "first second third fourth".split()


@query("c19_masked_mean_pooling", rounded("vec_id", " ".join(_POOLED), "SELECT vec_id, " + ", ".join(f"""
  coalesce(list_sum(list_transform(range(0, 16), lambda k: CASE WHEN (vec_id + k) % 3 <> 0 THEN embedding[4*k+{i + 1}]::DOUBLE ELSE 0.0 END)), 0.0)
    / greatest(list_sum(list_transform(range(0, 16), lambda k: CASE WHEN (vec_id + k) % 3 <> 0 THEN 1.0::DOUBLE ELSE 0.0 END)), 1.0) AS {name}"""
  for i, name in enumerate(_POOLED)) + " FROM embeddings"))
def c19(spark, d):
    """The 64 numbers are read as 16 token vectors of width 4."""
    tokens = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.slice("embedding", k * 4 + 1, 4))
    mask = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: ((F.col("vec_id") + k) % 3 != 0).cast("int"))
    rows = sc.table(spark, d, "embeddings").select("vec_id", num.masked_mean(tokens, mask).alias("pooled"))
    return tidy(rows.select("vec_id", *[F.col("pooled")[i].alias(name) for i, name in enumerate(_POOLED)]))


_HEAD = [round(((i * 37) % 64) / 64 - 0.5, 6) for i in range(64)]


@query("c20_value_head", rounded("vec_id", "reward", f"SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * {_HEAD}[i]::DOUBLE)) AS reward FROM embeddings"))
def c20(spark, d):
    return tidy(sc.table(spark, d, "embeddings").select("vec_id", num.value_head(F.col("embedding"), _HEAD).alias("reward")))
