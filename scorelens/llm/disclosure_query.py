"""Query of the sanitisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelens.llm.disclosure import KINDS, sanitise
from scorelens.llm.registry import query, table


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def digest(docs: DataFrame) -> DataFrame:
    """Counts, digest and list of the spans of every document."""
    counts = [_count(k.name) for k in KINDS]
    return sanitise(docs.select("doc_id", "text")).select(
        "doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("found").alias("spans")
    )


@query("op2_pii_disclosure")
def op2_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms in every document."""
    return digest(table(spark, sf_dir, "documents"))
