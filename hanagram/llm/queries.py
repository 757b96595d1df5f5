"""The operators as queries over the standard tables, and their SQL where SQL can express one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bit_sliced, block_extract, bpe_replay, chat_perspectives, kneser_ney, secret_cost, shingle_product, spot_signatures, square_packing, warc_members


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that people labelled good."""
    return table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def op1_quality_classifier(spark, sf_dir):
    return kneser_ney.classify(table(spark, sf_dir, "documents"), trusted(spark, sf_dir))


def op2_bpe_replay(spark, sf_dir):
    return bpe_replay.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_secret_cost(spark, sf_dir):
    return secret_cost.scan(table(spark, sf_dir, "documents"))


def op4_chat_perspectives(spark, sf_dir):
    return chat_perspectives.perspectives(table(spark, sf_dir, "conversations"))


def op5_block_extract(spark, sf_dir):
    return block_extract.extract(table(spark, sf_dir, "pages"))


def op6_square_packing(spark, sf_dir):
    return square_packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_bit_sliced(spark, sf_dir):
    return bit_sliced.search(table(spark, sf_dir, "embeddings"))


def op8_warc_members(spark, sf_dir):
    return warc_members.archived(table(spark, sf_dir, "pages"))


def op9_spot_signatures(spark, sf_dir):
    return spot_signatures.against_next(table(spark, sf_dir, "documents"))


def op10_shingle_product(spark, sf_dir):
    return shingle_product.grouped(table(spark, sf_dir, "documents"), k=4, percent=85)


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_bpe_replay, op3_secret_cost, op4_chat_perspectives, op5_block_extract, op6_square_packing, op7_bit_sliced, op8_warc_members, op9_spot_signatures, op10_shingle_product)}

#: For DuckDB; the others are tested against brute-force versions.
ORACLE_SQL = {"op4_chat_perspectives": chat_perspectives.ORACLE_SQL}
