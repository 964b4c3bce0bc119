"""Query of the quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scorelens.llm.isolation_rules import quality_rules
from scorelens.llm.registry import query, table
from scorelens.llm.rule_statistics import COUNTS


@query("op6_quality_rules")
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    judged = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *COUNTS, "base_failed", "kept", "score")
