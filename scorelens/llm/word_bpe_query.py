"""Query of the distinct-word BPE operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelens.llm.registry import query, table
from scorelens.llm.word_bpe import encode_and_decode

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def digest(docs: DataFrame, **options) -> DataFrame:
    """Token count and digests of the ids and of the decoded text of every document."""
    return encode_and_decode(docs, VOCABULARY, **options).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op13_bpe_word_table")
def op13_bpe_word_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document, then decode the ids."""
    return digest(table(spark, sf_dir, "documents"))
