"""From raw documents to token ids: five stages, each with one of the operators of ``scorelens.llm``.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelens.llm.bm25_wand import drop_leaks
from scorelens.llm.bpe import encode_and_decode
from scorelens.llm.bpe_query import VOCABULARY
from scorelens.llm.disclosure import sanitise
from scorelens.llm.ngram_join import similar_components
from scorelens.llm.weak_quality import keep_good
from scorelens.storage import materialize

#: Of the near-duplicate stage: words a shingle, and least similarity.
SHINGLE_WORDS, SIMILARITY = 5, 0.8


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_good(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of smallest id stays.

    A document is an id with a text: rows of one id with different texts are different documents, and of equal rows
    one stays, by a fixed order of their other columns. Documents without words or without an id all stay.
    """
    row = F.xxhash64("doc_id", F.col("text").cast("string"))
    known = docs.filter("doc_id is not null").withColumn("_row", row)
    groups = similar_components(known, n=SHINGLE_WORDS, similarity=SIMILARITY, key="_row")
    named = known.select("doc_id", "_row").join(groups.select(F.col("doc_id").alias("_row"), "component_id").distinct(), "_row")
    # rows without words have no group but their own
    smallest = named.groupBy("component_id").agg(F.min(F.struct("doc_id", "_row")).alias("kept"))
    first = materialize(smallest.select("kept.doc_id", "kept._row"), "first")
    others = [c for c in docs.columns if c != "text"]
    order = F.to_json(F.struct(*others))
    kept = known.join(first, ["doc_id", "_row"], "left_semi").groupBy("doc_id", "_row").agg(
        F.min_by(F.struct(*docs.columns), order).alias("document")
    )
    return kept.select("document.*").unionByName(docs.filter("doc_id is null"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that give it away are masked; ``n_chars`` follows the text."""
    clean = sanitise(docs).withColumn("text", F.col("sanitised"))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and a digest of the bytes they decode to."""
    return encode_and_decode(docs, VOCABULARY).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded"), 256).alias("decoded_sha256")
    )


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("PII", pii),
    ("byte-level BPE", byte_level_bpe),
]

#: The classifier and the merges have no SQL form; the tests hold each stage against its operator's brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, "stage")
    return docs
