"""Query of the n-gram Jaccard join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scorelens.llm.ngram_join import similar_components
from scorelens.llm.registry import query, table


@query("op7_ngram_jaccard_join")
def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents over 4-word shingles at a Jaccard similarity of 0.85."""
    return similar_components(table(spark, sf_dir, "documents"), n=4, similarity=0.85)
