"""Query of the quality classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelens.llm.registry import query, table
from scorelens.llm.weak_quality import KEEP_SCORE, fit_quality, score_quality


@query("op1_quality_classifier")
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, fit_quality(docs), "score")
    return scored.select("doc_id", "score", (F.col("score") >= KEEP_SCORE).alias("kept"))
