"""Query of the byte-level BPE operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelens.llm.bpe import encode_and_decode
from scorelens.llm.registry import query, table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def digest(docs: DataFrame) -> DataFrame:
    """Token count and digests of the ids and of the decoded bytes of every document."""
    return encode_and_decode(docs, VOCABULARY).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


@query("op5_byte_level_bpe")
def op5_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document, then decode the ids."""
    return digest(table(spark, sf_dir, "documents"))
