"""Evaluation tables derived from the given Parquet tables, in Spark and as SQL with the same values.

The given tables hold texts but no scores, so scores are drawn per row from md5 hashes of the row's keys. Both
forms do the same arithmetic in the same order and cut scores to three decimals, which also produces ties.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelens.functions.labels import CLASSIFIER_LABELS, PRIMARY_LABEL
from scorelens.functions.text import hash_unit
from scorelens.operators.pairing import split_by_hash
from scorelens.operators.prompts import ATTRIBUTES

MODELS = [
    ("base", 0, 1.0), ("detox_epoch_20", 20, 0.88), ("detox_epoch_40", 40, 0.76),
    ("detox_epoch_60", 60, 0.64), ("detox_epoch_80", 80, 0.52), ("detox_epoch_100", 100, 0.4),
]
TEXT_TYPES = ["output", "full_text", "prompt"]
SERIES = [(c, label) for c, labels in CLASSIFIER_LABELS.items() for label in labels]
PRIMARY = list(PRIMARY_LABEL.items())
CLASSIFIERS = list(CLASSIFIER_LABELS)
TUNED = [m for m, _, _ in MODELS if m != "base"]
SEEDS = [("seed_42", 0.05), ("seed_43", 0.15), ("seed_44", 0.3), ("seed_45", 0.45), ("seed_46", 0.6)]
SEED_NAMES = [s for s, _ in SEEDS]
SIZES = [("70m", 0.05), ("160m", 0.1), ("410m", 0.2), ("1b", 0.3)]
THRESHOLDS = [(0.3, 0.02), (0.8, 0.08)]
INPUT_TYPES = [("prompt_output", 0.0), ("output_only", 0.04)]
EXPERIMENTS = [
    (f"{s}_{i}_{t}", s, n, t, i, round(a + b + c, 2))
    for n, (s, a) in enumerate(SIZES)
    for t, b in THRESHOLDS
    for i, c in INPUT_TYPES
]
TRACKED_EPOCHS = ["initial", "0", "20", "40", "60", "80", "100", "final"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def structs(rows: list[tuple], names: list[str]) -> Column:
    """Literal array of structs, for a fan-out without a join."""
    return F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names)]) for row in rows])


#: Ids in one task, each of which fans out to up to 180 rows there.
IDS_PER_TASK = 10_000


def ids(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Document ids under a new name, spread evenly over as many tasks as their number asks for.

    Only 8 bytes per row move, ahead of a fan-out of up to 180 hashed rows each. The number of partitions is given, as
    adaptive execution would otherwise merge them by the size of the ids; it goes down for few ids only.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias(name))
    rows = docs.count()  # from the Parquet footers
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(math.ceil(rows / IDS_PER_TASK), min(width, math.ceil(10 * rows / IDS_PER_TASK)), 1)
    return docs.repartition(parts, name)


def cut3(x: Column) -> Column:
    return F.floor(x * 1000) / F.lit(1000.0)


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested prompt records; attributes are NULL for every 17th document."""
    docs = table(spark, sf_dir, "documents")
    attributes = [
        F.when(F.col("doc_id") % 17 != 0, hash_unit(F.lit(a), F.col("doc_id").cast("string"))).alias(a)
        for a in ATTRIBUTES
    ]
    return docs.select(
        F.col("doc_id").alias("prompt_id"),
        F.struct(F.col("text"), *attributes).alias("prompt"),
        F.struct(F.col("text")).alias("continuation"),
    )


def scores(
    spark: SparkSession, sf_dir: str, *, primary: bool = False, text_types: list[str] = TEXT_TYPES
) -> DataFrame:
    """The central fact table: prompt_id, model, epoch, text_type, classifier, label, score."""
    doc = F.col("prompt_id").cast("string")
    series = PRIMARY if primary else SERIES
    rows = (
        ids(spark, sf_dir, "prompt_id")
        .select("prompt_id", F.inline(structs(series, ["classifier", "label"])))
        .withColumn("b", F.lit(0.2) + F.lit(0.8) * hash_unit(F.lit("b"), "classifier", "label", doc))
        .withColumn("p", F.lit(0.3) * hash_unit(F.lit("p"), "classifier", "label", doc))
        .select("*", F.inline(structs(MODELS, ["model", "epoch", "decay"])))
    )
    noise = hash_unit(F.lit("n"), "model", "classifier", "label", doc)
    tuned = F.greatest(
        F.lit(0.0), F.least(F.lit(1.0), F.col("b") * F.col("decay") + F.lit(0.2) * (noise - F.lit(0.5)))
    )
    rows = rows.withColumn("o", F.when(F.col("epoch") == 0, F.col("b")).otherwise(tuned))
    value = {"output": F.col("o"), "full_text": F.lit(0.9) * F.col("o"), "prompt": F.col("p")}
    typed = F.array(
        *[F.struct(F.lit(t).alias("text_type"), cut3(value[t]).alias("score")) for t in text_types]
    )
    return rows.select("prompt_id", "model", "epoch", "classifier", "label", F.inline(typed))


def classifications(spark: SparkSession, sf_dir: str, *, text_types: list[str] = TEXT_TYPES) -> DataFrame:
    """Label maps of ``scores``: every 11th prompt has an empty map, every 5th lacks the label 'threat'.

    The labels of a classifier are columns, one for each place, so scores are plain expressions; lambdas over arrays would
    be interpreted for every row.
    """
    doc = F.col("prompt_id").cast("string")
    places = range(max(len(labels) for labels in CLASSIFIER_LABELS.values()))

    def listed(wanted) -> Column:
        rows = []
        for classifier, labels in CLASSIFIER_LABELS.items():
            names = [x for x in labels if wanted(x)]
            columns = [F.lit(names[i] if i < len(names) else None).cast("string").alias(f"l{i}") for i in places]
            found = F.array(*[F.lit(x) for x in names]).cast("array<string>")
            rows.append(F.struct(F.lit(classifier).alias("classifier"), found.alias("names"), *columns))
        return F.array(*rows)

    without = F.when(F.col("prompt_id") % 5 == 0, listed(lambda x: x != "threat")).otherwise(listed(lambda x: True))
    labels = F.when(F.col("prompt_id") % 11 != 0, without).otherwise(listed(lambda x: False))

    def drawn(kind: str, i: int, *more: str) -> Column:
        return hash_unit(F.lit(kind), *more, "classifier", f"l{i}", doc)

    def present(i: int, value: Column) -> Column:
        return F.when(F.col(f"l{i}").isNotNull(), value)

    rows = ids(spark, sf_dir, "prompt_id").select("prompt_id", F.inline(labels))
    rows = rows.withColumns({f"b{i}": present(i, F.lit(0.2) + F.lit(0.8) * drawn("b", i)) for i in places})
    rows = rows.withColumns({f"p{i}": present(i, F.lit(0.3) * drawn("p", i)) for i in places})
    rows = rows.select("*", F.inline(structs(MODELS, ["model", "epoch", "decay"])))

    def output(i: int) -> Column:
        noise = drawn("n", i, "model")
        b = F.col(f"b{i}")
        tuned = F.greatest(F.lit(0.0), F.least(F.lit(1.0), b * F.col("decay") + F.lit(0.2) * (noise - F.lit(0.5))))
        return present(i, F.when(F.col("epoch") == 0, b).otherwise(tuned))

    rows = rows.withColumns({f"o{i}": output(i) for i in places})

    def entries(value) -> Column:
        return F.map_from_arrays("names", F.slice(F.array(*[cut3(value(i)) for i in places]), F.lit(1), F.size("names")))

    values = {
        "output": lambda i: F.col(f"o{i}"), "full_text": lambda i: F.lit(0.9) * F.col(f"o{i}"), "prompt": lambda i: F.col(f"p{i}")
    }
    typed = F.array(
        *[F.struct(F.lit(t).alias("text_type"), entries(values[t]).alias("labels")) for t in text_types]
    )
    return rows.select("prompt_id", "model", "epoch", "classifier", F.inline(typed))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three documents in a row as prompt, original output and detoxified output, all whole."""
    docs = table(spark, sf_dir, "documents").select(F.expr("doc_id div 3").alias("sample_id"), "doc_id", "text")
    parts = [
        docs.where(F.col("doc_id") % 3 == k).select("sample_id", F.col("text").alias(name))
        for k, name in enumerate(("prompt", "original_output", "detoxified_output"))
    ]
    return parts[0].join(parts[1], "sample_id").join(parts[2], "sample_id")


def rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewards of five seeds for both sides of each sample, with a true reward."""
    doc = F.col("sample_id").cast("string")
    rows = (
        ids(spark, sf_dir, "sample_id")
        .select("sample_id", F.inline(structs([("original", 0.0), ("detoxified", 1.0)], ["side", "better"])))
        .withColumn(
            "true_reward",
            cut3(F.lit(2.0) * hash_unit(F.lit("t"), "side", doc) - F.lit(1.0) + F.lit(0.4) * F.col("better")),
        )
        .select("*", F.inline(structs(SEEDS, ["model_id", "shift"])))
    )
    noise = F.lit(2.0) * hash_unit(F.lit("r"), "model_id", "side", doc) - F.lit(1.0)
    reward = cut3(F.lit(0.5) * F.col("true_reward") + F.lit(0.5) * noise + F.col("shift") * F.col("better"))
    return rows.select("sample_id", "side", "model_id", reward.alias("reward"), "true_reward")


def experiment_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [e[:5] for e in EXPERIMENTS],
        "experiment string, model_size string, size_order int, toxicity_threshold double, input_type string",
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Original and detoxified scores of each sample in each experiment, with an exact 80/20 split."""
    split = split_by_hash(ids(spark, sf_dir, "sample_id"), "sample_id", 0.8, unique=True)
    rows = split.select("sample_id", "split", F.inline(structs([(e[0], e[5]) for e in EXPERIMENTS], ["experiment", "gain"])))
    doc = F.col("sample_id").cast("string")
    original = F.when(F.col("sample_id") % 50 == 0, F.lit(0.0)).otherwise(
        cut3(F.lit(2.0) * hash_unit(F.lit("o"), "experiment", doc) - F.lit(1.0))
    )
    rows = rows.withColumn("original", original)
    change = F.lit(0.5) * (hash_unit(F.lit("c"), "experiment", doc) - F.lit(0.5)) + F.col("gain")
    return rows.withColumn("detoxified", cut3(F.col("original") + change)).drop("gain")


def tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("prompt_idx").cast("string")
    rows = ids(spark, sf_dir, "prompt_idx").select(
        "prompt_idx", F.explode(F.array(*[F.lit(e) for e in TRACKED_EPOCHS])).alias("epoch")
    )
    return rows.withColumn("raw_toxicity", cut3(hash_unit(F.lit("raw"), "epoch", doc))).withColumn(
        "softmax_toxicity", cut3(hash_unit(F.lit("soft"), "epoch", doc))
    )


def reward_events(spark: SparkSession, sf_dir: str, *, stream: bool = False) -> DataFrame:
    """Events as rewards, with NaN for every 50th and infinity for every 77th."""
    schema = table(spark, sf_dir, "events").schema
    if stream:
        source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    else:
        source = spark.read.schema(schema).parquet(f"{sf_dir}/events.parquet")
    value = (
        F.when(F.col("event_id") % 50 == 0, F.lit(float("nan")))
        .when(F.col("event_id") % 77 == 0, F.lit(float("inf")))
        .otherwise(F.col("value"))
    )
    return source.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("model"),
        (F.col("user_id") % 5).cast("int").alias("epoch"),
        value.alias("reward"),
    )


# ---- the same tables as SQL ----------------------------------------------------------------------------------

def u(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8))::BIGINT::DOUBLE / 4294967295::DOUBLE)"


def rows_of(rows: list[tuple], names: list[str]) -> str:
    def literal(v):
        if isinstance(v, str):
            return f"'{v}'"
        return f"{v}::DOUBLE" if isinstance(v, float) else str(v)

    values = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return f"(VALUES {values}) AS v({', '.join(names)})"


def _scores_sql(series: list[tuple]) -> str:
    b = u("'b'", "classifier", "label", "doc_id")
    p = u("'p'", "classifier", "label", "doc_id")
    n = u("'n'", "model", "classifier", "label", "doc_id")
    return f"""
    SELECT prompt_id, model, epoch, text_type, classifier, label,
      floor(1000 * CASE text_type WHEN 'output' THEN o WHEN 'full_text' THEN 0.9 * o ELSE p END) / 1000 AS score
    FROM (SELECT *, CASE WHEN epoch = 0 THEN b
                    ELSE greatest(0.0, least(1.0, b * decay + 0.2 * ({n} - 0.5))) END AS o
          FROM (SELECT doc_id, doc_id AS prompt_id, classifier, label, model, epoch, decay,
                  0.2 + 0.8 * {b} AS b, 0.3 * {p} AS p
                FROM documents CROSS JOIN (SELECT * FROM {rows_of(series, ['classifier', 'label'])}) s
                CROSS JOIN (SELECT * FROM {rows_of(MODELS, ['model', 'epoch', 'decay'])}) m))
    CROSS JOIN (VALUES ('output'), ('full_text'), ('prompt')) t(text_type)"""


def _paired_sql(source: str) -> str:
    return f"""
    SELECT s.*, b.score AS base_value, b.score - s.score AS delta FROM {source} s
    JOIN {source} b ON b.model = 'base' AND s.prompt_id = b.prompt_id AND s.text_type = b.text_type
      AND s.classifier = b.classifier AND s.label = b.label
    WHERE s.model <> 'base' AND s.text_type <> 'prompt'"""


CTES: dict[str, tuple[list[str], str]] = {
    "prompts": ([], "SELECT doc_id AS prompt_id, text, " + ", ".join(
        f"CASE WHEN doc_id % 17 <> 0 THEN {u(repr(a), 'doc_id')} END AS {a}" for a in ATTRIBUTES) + " FROM documents"),
    "scores": ([], _scores_sql(SERIES)),
    "primary_scores": ([], _scores_sql(PRIMARY)),
    "paired": (["scores"], _paired_sql("scores")),
    "primary_paired": (["primary_scores"], _paired_sql("primary_scores")),
    "label_scores": (["scores"], "SELECT * FROM scores WHERE prompt_id % 11 <> 0 AND NOT (prompt_id % 5 = 0 AND label = 'threat')"),
    # every label of a non-empty map, a missing one as 0
    "filled": (["scores"], """SELECT prompt_id, model, epoch, text_type, classifier, label,
        CASE WHEN prompt_id % 5 = 0 AND label = 'threat' THEN 0.0 ELSE score END AS score
        FROM scores WHERE prompt_id % 11 <> 0"""),
    "pairs": ([], """SELECT a.doc_id // 3 AS sample_id, a.text AS prompt, b.text AS original_output,
        c.text AS detoxified_output FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1
        JOIN documents c ON c.doc_id = a.doc_id + 2 WHERE a.doc_id % 3 = 0"""),
    "rewards": ([], f"""
    SELECT sample_id, side, model_id, true_reward,
      floor(1000 * (0.5 * true_reward + 0.5 * (2.0 * {u("'r'", 'model_id', 'side', 'sample_id')} - 1.0) + shift * better)) / 1000 AS reward
    FROM (SELECT doc_id AS sample_id, side, better,
            floor(1000 * (2.0 * {u("'t'", 'side', 'doc_id')} - 1.0 + 0.4 * better)) / 1000 AS true_reward
          FROM documents CROSS JOIN (SELECT * FROM {rows_of([('original', 0.0), ('detoxified', 1.0)], ['side', 'better'])}) s)
    CROSS JOIN (SELECT * FROM {rows_of(SEEDS, ['model_id', 'shift'])}) m"""),
    "reward_pairs": (["rewards"], """SELECT sample_id, model_id, max(CASE WHEN side = 'original' THEN reward END) AS original,
        max(CASE WHEN side = 'detoxified' THEN reward END) AS detoxified FROM rewards GROUP BY ALL"""),
    "experiments": ([], f"SELECT * FROM {rows_of(EXPERIMENTS, ['experiment', 'model_size', 'size_order', 'toxicity_threshold', 'input_type', 'gain'])}"),
    "doc_split": ([], """SELECT doc_id AS sample_id, CASE WHEN row_number() OVER (ORDER BY md5(concat_ws(':', '42', doc_id)), doc_id)
        <= floor(0.8 * count(*) OVER ()) THEN 'train' ELSE 'test' END AS split FROM documents"""),
    "samples": (["experiments", "doc_split"], f"""
    SELECT sample_id, split, experiment, original, detoxified, detoxified - original AS improvement,
      CASE WHEN original = 0 THEN 0.0 ELSE (detoxified - original) / abs(original) END AS relative_improvement
    FROM (SELECT *, floor(1000 * (original + (0.5 * ({u("'c'", 'experiment', 'sample_id')} - 0.5) + gain))) / 1000 AS detoxified
          FROM (SELECT sample_id, split, experiment, gain, CASE WHEN sample_id % 50 = 0 THEN 0.0
                  ELSE floor(1000 * (2.0 * {u("'o'", 'experiment', 'sample_id')} - 1.0)) / 1000 END AS original
                FROM doc_split CROSS JOIN experiments))"""),
    "tracking": ([], f"""SELECT doc_id AS prompt_idx, epoch, floor(1000 * {u("'raw'", 'epoch', 'doc_id')}) / 1000 AS raw_toxicity,
        floor(1000 * {u("'soft'", 'epoch', 'doc_id')}) / 1000 AS softmax_toxicity
        FROM documents CROSS JOIN (SELECT * FROM {rows_of([(e,) for e in TRACKED_EPOCHS], ['epoch'])}) e"""),
    "reward_events": ([], """SELECT event_id, ts, event_type AS model, (user_id % 5)::INTEGER AS epoch,
        (event_id % 50 = 0 OR event_id % 77 = 0) AS bad,
        CASE WHEN event_id % 50 = 0 OR event_id % 77 = 0 THEN 0.0 ELSE value END AS clean FROM events"""),
}


def with_tables(names: str, body: str) -> str:
    """SQL text with the named scenario tables in front of ``body``."""
    order: list[str] = []

    def need(name: str) -> None:
        for dependency in CTES[name][0]:
            need(dependency)
        if name not in order:
            order.append(name)

    for name in names.split():
        need(name)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in order) + f"\nSELECT * FROM ({body}) AS result"


# means of three-decimal scores often end in an exact 5 at the seventh digit; this moves them off the half, so
# that the last bit of a float sum does not decide the rounding
NUDGE = 3.3e-10


def rounded(keys: str, numbers: str, body: str) -> str:
    """Select keys as they are and numbers to six digits."""
    columns = keys.split() + [f"round({n}::DOUBLE + {NUDGE}::DOUBLE, 6) AS {n}" for n in numbers.split()]
    return f"SELECT {', '.join(columns)} FROM ({body}) AS q"


def tidy(df: DataFrame) -> DataFrame:
    """Spark side of ``rounded``: all double columns to six digits."""
    return df.selectExpr(
        *[
            f"round(cast(`{c}` as double) + {NUDGE}D, 6) as `{c}`" if kind in ("double", "float") else f"`{c}`"
            for c, kind in df.dtypes
        ]
    )
