"""Corpus pipeline: toxicity, quality rules, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows it is given; its result is
written as Parquet and read again for the next stage. All but the last return the columns
of documents. An empty table passes through empty; rows with the same id are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm import minhash, packing, quality, secrets, toxicity
from heddle.llm.common import new_path, table
from heddle.llm.queries import WORD_TOKENIZER

QUALITY_POLICY = "web-1"
SIMILARITY = 80


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5; the model learns from the labels outside its hold-out fold."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score(F.col("text"), model) < 0.5)


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule of the policy; null and empty texts have too few words and go."""
    return quality.filter_documents(docs, QUALITY_POLICY)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at SIMILARITY per cent or more; texts without words all stay."""
    return minhash.deduplicate(docs, SIMILARITY)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets masked, n_chars counted anew."""
    masked = secrets.redact(docs, path_col="source")
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document; a null or empty text is one piece of the end id."""
    return packing.digests(packing.pieces(docs, WORD_TOKENIZER))


STAGES = [
    ("toxicity", reject_toxic),
    ("quality_rules", reject_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("packing", pack),
]

#: No stage but the quality rules can be said in SQL; the tests hold the rest against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents`` after all stages."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
