"""Bulk scoring of texts with pluggable scorers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelens.functions.text import text_variants
from scorelens.operators.ranks import join_hot_values
from scorelens.storage import materialize

SAFE_FALLBACK = {"safe": 1.0, "unsafe": 0.0}


@dataclass(frozen=True)
class Scorer:
    """A named scorer.

    ``column`` maps a text column to a ``map<string,double>`` column inside the JVM. Otherwise ``load`` is called
    once per Python worker stream and returns a function from a list of texts to a list of label dicts.
    """

    name: str
    labels: tuple[str, ...]
    primary_label: str
    column: Callable[[Column], Column] | None = None
    load: Callable[[], Callable[[list[str]], list[dict[str, float]]]] | None = None
    fallback: dict[str, float] = field(default_factory=dict)


_SCORERS: dict[str, Scorer] = {}


def register_scorer(
    name: str,
    fn: Callable,
    labels: list[str],
    primary_label: str,
    *,
    native: bool = False,
    fallback: dict[str, float] | None = None,
) -> Scorer:
    """Register a native (Column) scorer, or a loader of a batch function."""
    scorer = Scorer(
        name,
        tuple(labels),
        primary_label,
        column=fn if native else None,
        load=None if native else fn,
        fallback=fallback or {},
    )
    _SCORERS[name] = scorer
    return scorer


def scorer(name: str) -> Scorer:
    return _SCORERS[name]


# example word lists of the shipped lexical scorer
LEXICON = {
    "toxic": ["worthless", "stupid", "idiot", "hate", "garbage", "trash", "pathetic", "disgusting"],
    "insult": ["stupid", "idiot", "pathetic", "worthless"],
    "threat": ["kill", "hurt", "destroy", "die"],
}


def lexical_scores(text: Column) -> Column:
    """Share of listed words among the words of the whole text, per label; computed by built-in functions."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]+"), F.lit(0))

    every = sorted({w for listed in LEXICON.values() for w in listed})

    def share(counted: Column, listed: list[str]) -> Column:
        hits = F.size(F.filter(counted["hits"], lambda w: w.isin(*listed)))
        return F.coalesce(F.try_divide(hits.cast("double"), counted["words"]), F.lit(0.0))

    # arrays of one, so that the text is cut into words once, and its words are looked up once for all labels
    counted = F.transform(F.array(found), lambda words: F.struct(
        F.size(words).alias("words"), F.filter(words, lambda w: w.isin(*every)).alias("hits")))
    return F.transform(counted, lambda c: F.create_map(
        *[x for label, listed in LEXICON.items() for x in (F.lit(label), share(c, listed))]))[0]


register_scorer("lexical", lexical_scores, list(LEXICON), "toxic", native=True)


def batch_scorer_udf(scorer_: Scorer):
    """Pandas UDF from texts to (labels, failed): the model is loaded once per worker stream.

    A batch that fails is retried text by text, so one bad text only loses its own scores.
    """
    load, fallback = scorer_.load, dict(scorer_.fallback)

    @F.pandas_udf("struct<labels map<string,double>, failed boolean>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predict = load()

        def one(text: str):
            try:
                return predict([text])[0], False
            except Exception:
                return fallback, True

        for texts in batches:
            values = texts.tolist()
            try:
                results = [(scores, False) for scores in predict(values)]
            except Exception:
                results = [one(text) for text in values]
            yield pd.DataFrame({"labels": [r[0] for r in results], "failed": [r[1] for r in results]})

    return run


def _scored(df: DataFrame, text_col: str, scorers: list[Scorer]) -> DataFrame:
    out = df
    for s in scorers:
        if s.column is not None:
            result = F.struct(s.column(F.col(text_col)).alias("labels"), F.lit(False).alias("failed"))
        else:
            result = batch_scorer_udf(s)(F.col(text_col))
        out = out.withColumn(f"_result_{s.name}", result)
    return out


def _result_rows(table: DataFrame, columns: list[str], chosen: list[Scorer]) -> DataFrame:
    entries = [
        F.struct(
            F.lit(s.name).alias("classifier"),
            F.col(f"_result_{s.name}.labels").alias("labels"),
            F.col(f"_result_{s.name}.failed").alias("failed"),
        )
        for s in chosen
    ]
    return table.select(*columns, F.inline(F.array(*entries)))


def score_texts(df: DataFrame, text_col: str, scorers: list[str], *, dedupe: bool | None = None) -> DataFrame:
    """(row, classifier, labels, failed) for every text and scorer.

    Native scorers alone are a projection without a shuffle. With a batch scorer (or ``dedupe``) each distinct
    text is scored once: texts are grouped by content, combining map-side so that copies meet in one row, and the
    results are written once under the SHA-256 of the text. Rows pick them up by that digest, so texts move once
    and a text with very many copies is joined by broadcast. A NULL text gets no row.
    """
    chosen = [_SCORERS[name] for name in scorers]
    if dedupe is None:
        dedupe = any(s.column is None for s in chosen)
    present = df.where(F.col(text_col).isNotNull())
    if not dedupe:
        return _result_rows(_scored(present, text_col, chosen), df.columns, chosen)
    keyed = present.withColumn("_digest", F.sha2(text_col, 256))
    texts = keyed.groupBy("_digest", text_col).agg(F.count("*").alias("n"))
    results = [f"_result_{s.name}" for s in chosen]
    scored = materialize(_scored(texts, text_col, chosen).select("_digest", "n", F.struct(*results).alias("_results")), "scored")
    joined = join_hot_values(keyed, scored, ["_digest"], "_results")
    return _result_rows(joined.select(*df.columns, "_results.*"), df.columns, chosen)


VARIANTS = ["prompt_only", "prompt_original", "prompt_detoxified", "original_output", "detoxified_output"]


def score_variants(pairs: DataFrame, scorer_name: str, *, key: str = "sample_id", dedupe: bool | None = None) -> DataFrame:
    """Primary score of the five text variants of each pair, one column per variant, from one scoring pass.

    A native scorer is applied to the five texts side by side, without a shuffle.
    """
    s = _SCORERS[scorer_name]
    variants = text_variants(F.col("prompt"), F.col("original_output"), F.col("detoxified_output"))

    def primary(labels: Column) -> Column:
        return F.coalesce(F.try_element_at(labels, F.lit(s.primary_label)), F.lit(0.0))

    if s.column is not None and not dedupe:
        return pairs.select(key, *[primary(s.column(variants[i]["text"])).alias(v) for i, v in enumerate(VARIANTS)])
    long = pairs.select(key, F.inline(variants))
    scored = score_texts(long, "text", [scorer_name], dedupe=dedupe)
    return scored.groupBy(key).pivot("variant", VARIANTS).agg(F.avg(primary(F.col("labels"))))


def score_with_models(df: DataFrame, vector: str, heads: dict[str, list[float]]) -> DataFrame:
    """Reward of every linear head for every row, as (row, model_id, reward)."""
    def reward(weights: list[float]) -> Column:
        products = F.zip_with(vector, F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a.cast("double") * b)
        return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)

    entries = F.array(
        *[F.struct(F.lit(name).alias("model_id"), reward(w).alias("reward")) for name, w in heads.items()]
    )
    return df.select("*", F.inline(entries))


def scoring_summary(df: DataFrame, by: list[str], value: str = "score") -> DataFrame:
    """Mean, spread (ddof 0) and extremes of scores."""
    return df.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")
    )
