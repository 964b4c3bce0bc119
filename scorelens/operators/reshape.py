"""Unions, schema discovery, unpivots, pivots and column profiles."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelens.functions.labels import LABEL_ALIASES, TOXIC_LABELS


def union_models(frames: dict[str, DataFrame], *, name: str = "model") -> DataFrame:
    """Stack per-model frames with a model column; a column missing in one frame is NULL there."""
    tagged = [df.withColumn(name, F.lit(model)) for model, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def union_epochs(frames: dict[int, DataFrame]) -> DataFrame:
    """Stack per-epoch frames with the epoch and its index in training order."""
    tagged = [
        frames[epoch].withColumn("epoch", F.lit(epoch)).withColumn("epoch_index", F.lit(i))
        for i, epoch in enumerate(sorted(frames))
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def number_epochs(rows: DataFrame, epoch: str = "epoch") -> DataFrame:
    """Add each epoch's index in training order. The list of epochs, one per checkpoint, is all the driver sees."""
    order = sorted(r[0] for r in rows.where(F.col(epoch).isNotNull()).select(epoch).distinct().collect())
    known = F.array(*[F.lit(e) for e in order]) if order else F.array().cast(f"array<{rows.schema[epoch].dataType.simpleString()}>")
    return rows.withColumn("epoch_index", (F.array_position(known, F.col(epoch)) - 1).cast("int"))


def discover(columns: list[str], classifiers: list[str]) -> list[dict]:
    """Parse wide score column names into (column, text_type, model, classifier, label).

    ``output_{model}_{classifier}[_{label}][_score]``, ``full_``/``full_text_`` and ``prompt_{classifier}`` forms
    are understood, and a missing ``output_`` prefix means output. The whole model name is kept.
    """
    labels = sorted([*TOXIC_LABELS, *LABEL_ALIASES, "neutral", "hate", "not_hate"], key=len, reverse=True)
    known = sorted(classifiers, key=len, reverse=True)
    found = []
    for column in columns:
        if column.startswith("delta_"):
            continue
        name = re.sub(r"_score$", "", column)
        text_type = "output"
        for prefix, kind in (("full_text_", "full_text"), ("full_", "full_text"), ("output_", "output"),
                             ("prompt_", "prompt")):
            if name.startswith(prefix):
                name, text_type = name[len(prefix):], kind
                break
        for classifier in known:
            match = re.fullmatch(rf"(?:(?P<model>.+)_)?{re.escape(classifier)}(?:_(?P<label>{'|'.join(labels)}))?", name)
            if match and (match["model"] or text_type == "prompt"):
                label = match["label"] or ""
                found.append(
                    {
                        "column": column,
                        "text_type": text_type,
                        "model": match["model"] or "prompt",
                        "classifier": classifier,
                        "label": LABEL_ALIASES.get(label, label),
                    }
                )
                break
    return found


def to_long(wide: DataFrame, keys: list[str], classifiers: list[str]) -> DataFrame:
    """Wide score columns as (keys, model, text_type, classifier, label, score) rows."""
    parsed = discover(wide.columns, classifiers)
    entries = F.array(
        *[
            F.struct(
                *[F.lit(p[k]).alias(k) for k in ("model", "text_type", "classifier", "label")],
                F.col(f"`{p['column']}`").cast("double").alias("score"),
            )
            for p in parsed
        ]
    )
    return wide.select(*keys, F.inline(entries))


def to_wide(
    scores: DataFrame, keys: list[str], names: list[str], *, name: str = "name", value: str = "score"
) -> DataFrame:
    """One row per key with one column per listed name; repeats give their mean."""
    return scores.groupBy(*keys).pivot(name, names).agg(F.avg(value))


def series_name(*, score_suffix: bool = True):
    """Wide column name of a long score row."""
    parts = F.concat_ws("_", "text_type", "model", "classifier", "label")
    return F.concat(parts, F.lit("_score")) if score_suffix else parts


def explode_labels(classified: DataFrame, map_col: str = "labels") -> DataFrame:
    """Label maps as (label, score) rows."""
    rest = [c for c in classified.columns if c != map_col]
    return classified.select(*rest, F.explode(map_col).alias("label", "score"))


def heatmap(
    rows: DataFrame, row: str, column: str, columns: list[str], value: str, *, fill: float | None = 0.0
) -> DataFrame:
    """Mean of ``value`` as a row x column matrix with listed columns."""
    matrix = rows.groupBy(row).pivot(column, columns).agg(F.avg(value))
    return matrix if fill is None else matrix.fillna(fill, subset=columns)


# fixed values: name classes of result columns, first match wins
COLUMN_CLASSES = [
    ("delta", r"^delta_"), ("score", r"_score$"), ("output", r"^output_"), ("full", r"^full_"), ("prompt", r"^prompt")
]


def column_class(column: str) -> str:
    return next((name for name, rule in COLUMN_CLASSES if re.search(rule, column)), "other")


def _per_column(df: DataFrame, columns: dict[str, tuple], names: list[str]) -> DataFrame:
    """One row per column with its literal attributes and its number of non-NULL cells, from one aggregate."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in columns])
    entries = [
        F.struct(
            F.lit(c).alias("column"),
            *[F.lit(v).alias(n) for v, n in zip(values, names)],
            F.col(f"`{c}`").alias("cells"),
        )
        for c, values in columns.items()
    ]
    return counts.select(F.inline(F.array(*entries)))


def column_classes(df: DataFrame) -> DataFrame:
    """Number of columns and of non-NULL cells per name class."""
    rows = _per_column(df, {c: (column_class(c),) for c in df.columns}, ["class"])
    return rows.groupBy("class").agg(F.count("*").alias("columns"), F.sum("cells").alias("cells"))


def discovered_columns(df: DataFrame, classifiers: list[str]) -> DataFrame:
    """Score columns found by name, with their parts and their number of non-NULL cells."""
    names = ["text_type", "model", "classifier", "label"]
    return _per_column(df, {f["column"]: tuple(f[n] for n in names) for f in discover(df.columns, classifiers)}, names)


def missing_profile(df: DataFrame) -> DataFrame:
    """Columns that hold NULLs, with their number, from one aggregate."""
    counts = df.agg(*[F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(c) for c in df.columns])
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("nulls")) for c in df.columns])
    return counts.select(F.inline(entries)).where("nulls > 0")


def score_matrix(
    scores: DataFrame, models: list[str], *, key: str = "prompt_id", first: int = 20, value: str = "score"
) -> DataFrame:
    """Scores of the first prompts by model."""
    return scores.where(F.col(key) < first).groupBy(key).pivot("model", models).agg(F.max(value))
