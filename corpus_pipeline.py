"""Five stages from raw documents to token ids; each is written as Parquet and reread by the next.

The first four return the columns of `documents`; the last returns the ids of each mixed row.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskfold.llm import bpe, jaccard, mix, quality, secrets
from maskfold.llm.text import free_name
from maskfold.plans.materialise import materialise, scope


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    stats = materialise(quality.statistics(docs.select("doc_id", "text")), "stats")
    model = quality.fit(stats, _labels(spark, sf_dir))
    name = free_name(docs, "quality_score")
    return quality.score_texts(docs, model, out=name).where(F.col(name) >= 0.5).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group joined by links of five-word shingles at 0.8 or more."""
    return jaccard.keep_one(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, found secrets replaced by a mark."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: rows repeated by whole epochs and by sampling."""
    return mix.mix(docs, mix.label_weights(_labels(spark, sf_dir)))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids per mixed row, as little-endian 32-bit integers."""
    import public_tokenizers as P

    ids = bpe.encode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    return ids.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_classifier", keep_good),
    ("ngram_jaccard_join", drop_near_copies),
    ("secret_scan", hide_secrets),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode),
]
#: the classifier and the tokenizer have no SQL form; tests/llm holds the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scope(spark):  # a stage's own intermediate tables go when its result is written
            docs = materialise(stage(spark, docs, sf_dir), name, keep=True)
    return docs
