"""Query of the Hilbert-curve sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelens.llm.hilbert_shards import read_shards, text_crc, write_shards
from scorelens.llm.registry import query, table
from scorelens.storage import scratch_path

SHARDS = 40


def placement(docs: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """Write the shards, and read every document's place back from the files."""
    spark = docs.sparkSession
    path = scratch_path(spark, "shards")
    schema = write_shards(docs, path, n_shards)
    return read_shards(spark, path, schema).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        text_crc().alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("_shard").cast("int").alias("shard"),
        F.col("_slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("_curve").alias("curve_index"),
    )


@query("op3_hilbert_sharding")
def op3_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard, slot and checksum of every document in 40 runs of the curve."""
    return placement(table(spark, sf_dir, "documents"))
