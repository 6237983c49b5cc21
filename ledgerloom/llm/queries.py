"""Thin queries over the operators, as ``__spark_entry__.py`` registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, media, neardup, oracles, packing, sharding, suffixdedup, token_counts, toxicity, warc
from .common import id_hash, stored, table

SHARDS = 24


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    volumes = stored(warc.write_volumes(warc.revisits(table(spark, sf_dir, "pages"))), "warc", compression="none")
    found = warc.read_volumes(volumes, with_payload=False)
    return found.where("gap is null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = langid.fit(docs.where(id_hash("doc_id") % 4 != 2))
    found = langid.predict(docs, net)
    return found.withColumn("held_out", id_hash("doc_id") % 4 == 2)


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove_repeats(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_records(table(spark, sf_dir, "documents"), SHARDS)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.predict(docs, toxicity.fit(docs, training_labels(spark, sf_dir)))
    return found.withColumn("held_out", id_hash("doc_id") % 5 == 0)


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where(id_hash("doc_id") % 5 != 0)


QUERIES = (
    op1_media,
    op2_token_counts,
    op3_packing,
    op4_warc,
    op5_langid,
    op6_minhash,
    op7_suffix_dedup,
    op8_decontamination,
    op9_sharding,
    op10_toxicity,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": oracles.OP4, "op6_minhash": oracles.OP6, "op7_suffix_dedup": oracles.OP7, "op9_sharding": oracles.OP9}
