"""Prompt selection: filters, top-k, seeded samples, cleaning and templates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelens.functions.numeric import at_least
from scorelens.functions.text import strip

# fixed values: attributes of a prompt record
ATTRIBUTES = [
    "toxicity", "severe_toxicity", "insult", "threat", "identity_attack",
    "profanity", "sexually_explicit", "flirtation",
]


def hash_order(key: str, seed: int) -> list:
    """Seeded random order that depends only on the key."""
    return [F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), F.col(key)]


def select_prompts(
    prompts: DataFrame,
    *,
    key: str = "prompt_id",
    score: str = "prompt.toxicity",
    min_score: float | None = None,
    max_score: float | None = None,
    inclusive: bool = True,
    any_of: list[str] | None = None,
    top_k: int | None = None,
    sample: int | None = None,
    seed: int = 42,
    limit: int | None = None,
) -> DataFrame:
    """Prompts by score range, any-attribute threshold, top-k, seeded sample or first rows in key order.

    Filters reach the scan, and every limited form is a distributed top-k on a unique order. A NULL score fails
    every threshold and sorts last.
    """
    out = prompts
    if any_of:
        out = out.where(
            F.coalesce(reduce(lambda a, b: a | b, [F.coalesce(at_least(F.col(c), min_score, inclusive=inclusive), F.lit(False))
                                                   for c in any_of]), F.lit(False))
        )
    elif min_score is not None:
        out = out.where(at_least(F.col(score), min_score, inclusive=inclusive))
    if max_score is not None:
        out = out.where(F.col(score) <= max_score)
    if top_k is not None:
        return out.orderBy(F.col(score).desc_nulls_last(), key).limit(top_k)
    if sample is not None:
        return out.orderBy(*hash_order(key, seed)).limit(sample)
    if limit is not None:
        return out.orderBy(key).limit(limit)
    return out


def clean_text(
    df: DataFrame,
    col: str,
    *,
    key: str,
    normalize_ws: bool = False,
    min_len: int | None = None,
    max_len: int | None = None,
    distinct: bool = False,
) -> DataFrame:
    """Strip, drop blank, bound the length and keep the first occurrence of each text.

    De-duplication aggregates on the text, combining map-side, so many copies of one text meet in one small row.
    """
    text = strip(F.col(col))
    if normalize_ws:
        text = F.regexp_replace(text, r"\s+", " ")
    out = df.withColumn(col, text).where(F.length(col) > 0)
    if min_len is not None:
        out = out.where(F.length(col) >= min_len)
    if max_len is not None:
        out = out.where(F.length(col) <= max_len)
    return distinct_first(out, col, key=key) if distinct else out


def distinct_first(df: DataFrame, col: str, *, key: str) -> DataFrame:
    """(key, text) of the first occurrence of each text in key order."""
    return df.groupBy(col).agg(F.min(key).alias(key)).select(key, col)


def selection_summary(df: DataFrame, score: str = "prompt.toxicity") -> DataFrame:
    """Size and mean, least and greatest attribute of the selected rows."""
    return df.agg(
        F.count("*").alias("n"), F.avg(score).alias("mean"), F.min(score).alias("min"), F.max(score).alias("max")
    )


def expand_templates(rows: DataFrame, templates: list[str], *, index: str = "index") -> DataFrame:
    """Fill ``{index}`` in a template picked by the hash of the row's index."""
    choices = F.array(*[F.lit(t) for t in templates])
    digest = F.substring(F.md5(F.col(index).cast("string")), 1, 8)
    pick = F.pmod(F.conv(digest, 16, 10).cast("bigint"), F.lit(len(templates))).cast("int")
    return rows.withColumn(
        "prompt", F.replace(F.get(choices, pick), F.lit("{index}"), F.col(index).cast("string"))
    )


def template_prompts(spark: SparkSession, num_prompts: int, templates: list[str]) -> DataFrame:
    """``num_prompts`` prompts from templates."""
    return expand_templates(spark.range(num_prompts).withColumnRenamed("id", "index"), templates)
