"""A corpus pipeline in four stages: quality classifier, n-gram Jaccard join, secret scan, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hanagram.llm import kneser_ney, secret_cost, shingle_product, square_packing
from hanagram.llm.common import written
from hanagram.llm.queries import table, trusted

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return kneser_ney.kept(docs, trusted(spark, sf_dir)).select(*COLUMNS)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, 0.8) the document of the least id stays."""
    return shingle_product.one_of_each(docs, k=5, percent=80).select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; the documents stay."""
    return secret_cost.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become pieces of sequences of 4096 tokens."""
    return square_packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [("quality_classifier", quality_classifier), ("jaccard_join", jaccard_join), ("secret_scan", secret_scan), ("packing", packing)]

#: Perplexity, components and packing are beyond SQL: the pipeline is tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
