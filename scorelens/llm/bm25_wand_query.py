"""Query of the benchmark decontamination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scorelens.llm.bm25_wand import find_leaks
from scorelens.llm.registry import query, table


@query("op8_benchmark_decontamination")
def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold test items, with the items."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
