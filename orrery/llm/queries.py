"""The queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bottomk, embeddings, lm, mixing, oracles, packing, quality, simhash, suffixes, toxicity, warc
from .common import crc_of_id, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def _classified(scores: DataFrame, held_out) -> DataFrame:
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), crc_of_id() % 3 == 1
    return _classified(quality.with_scores(docs, quality.train(docs, table(spark, sf_dir, "labels"), ~held_out)), held_out)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), crc_of_id() % 5 == 0
    return _classified(toxicity.with_scores(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out)), held_out)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), crc_of_id() % 10 == 0, vocabulary("byte_bpe_multi_50k.tiktoken"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removals(table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottomk.edits(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_simhash, op3_warc, op4_quality, op5_toxicity, op6_mixing, op7_lm, op8_embeddings, op9_suffixes, op10_fingerprints)}


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": oracles.WARC, "op8_embeddings": oracles.EMBEDDINGS, "op9_suffixes": oracles.SUFFIXES}
