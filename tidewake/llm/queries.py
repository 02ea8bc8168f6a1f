"""The queries of this subpackage, each over its whole table with production parameters, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm import bigru, bpe, chat, codebooks, contextmix, dartminhash, divergence, fingerprints, flatgraph, licenses, mixing, nndescent, warc
from tidewake.llm.common import read_table
from tidewake.llm.oracles import ORACLE_SQL  # noqa: F401


def op1_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(read_table(spark, sf_dir, "pages"), min_bytes=0)
    return warc.read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_chat_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "\\### Assistant: </turn> ok"
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    records = chat.conversation_json(chat.conversation_records(rows.unionByName(planted)))
    return chat.chat_digest(chat.format_turns(chat.canonical_turns(records, "record")))


def op3_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dartminhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op4_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_schedule(read_table(spark, sf_dir, "documents"), max_repeats=2.0)


def op6_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.nearest(read_table(spark, sf_dir, "embeddings"), k=20)


def op7_bigru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bigru.identify(read_table(spark, sf_dir, "documents"))


def op8_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents"))


def op9_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contextmix.score(read_table(spark, sf_dir, "documents"))


def op10_flat_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatgraph.near_vectors(read_table(spark, sf_dir, "embeddings"))


def op11_improbable_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(read_table(spark, sf_dir, "documents"))


def op12_kd_codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.compress(read_table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_bundles": op1_warc_bundles,
    "op2_chat_fingerprint": op2_chat_fingerprint,
    "op3_dart_minhash": op3_dart_minhash,
    "op4_bpe_chunks": op4_bpe_chunks,
    "op5_temperature_mix": op5_temperature_mix,
    "op6_nn_descent": op6_nn_descent,
    "op7_bigru_language": op7_bigru_language,
    "op8_license_dice": op8_license_dice,
    "op9_context_mixing": op9_context_mixing,
    "op10_flat_graph": op10_flat_graph,
    "op11_improbable_features": op11_improbable_features,
    "op12_kd_codebooks": op12_kd_codebooks,
    "op13_source_divergence": op13_source_divergence,
}

