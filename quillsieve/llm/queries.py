"""The opN_ queries: each applies one operator to the whole of its table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsieve.llm import itq_dedup, language_bayes, license_tfidf, oracles, pii_weak, quality_cnn, rendezvous, secret_automaton, sentencepiece_topk, simhash_golay, suffix_decontam


#: Path of the SentencePiece model, read on the driver: a setting, or the model of this machine.
PIECE_MODEL = os.environ.get("QUILLSIEVE_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str, model_file: str = PIECE_MODEL) -> DataFrame:
    """Two samples of each document, and whether each decodes to the text it came from."""
    pieces = sentencepiece_topk.load_pieces(model_file)
    return sentencepiece_topk.sample_encodings(table(spark, sf_dir, "documents"), pieces, k=2, keep=["doc_id"], decodes="decodes")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_automaton.find_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = [r.name for r in secret_automaton.BASE_RULES]
    return found.select(
        "doc_id",
        *[secret_automaton.kind_count("spans", k).alias(f"n_{k}") for k in base],
        F.sha2(secret_automaton.span_text("spans", base), 256).alias("base_sha256"),
        secret_automaton.span_text("spans").alias("spans"),
    )


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents has no paths: a row lies at <its source>/<thousand>/<id>.txt, each eighth one as a file named LICENSE."""
    documents = table(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 8 == 0, "LICENSE").otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", "source", F.expr("doc_id div 1000").cast("string"), name)
    return license_tfidf.scan_licenses(documents.select("doc_id", "text", path.alias("path")))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_decontam.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = language_bayes.fit(documents.filter(~language_bayes.held_out("doc_id")))
    found = language_bayes.identify(documents, model, keep=["doc_id"])
    return found.select("doc_id", language_bayes.held_out("doc_id").alias("held_out"), "lang_pred", F.round("score", 6).alias("score"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    network = quality_cnn.train(documents, table(spark, sf_dir, "labels"))
    found = quality_cnn.score_quality(documents, network, keep=["doc_id"])
    return found.select("doc_id", (quality_cnn.split_of(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_golay.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_weak.find_pii(table(spark, sf_dir, "documents"))
    base = found.withColumn("__base", F.filter("spans", lambda s: s["base"]))
    return base.select(
        "doc_id",
        *[secret_automaton.kind_count("__base", k).alias(f"n_{k}") for k in pii_weak.BASE],
        F.sha2(secret_automaton.span_text("__base"), 256).alias("base_sha256"),
        secret_automaton.span_text("spans").alias("spans"),
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = rendezvous.shard_documents(table(spark, sf_dir, "documents"), shards=24)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_secrets": op2_secrets,
    "op3_embeddings": op3_embeddings,
    "op4_licenses": op4_licenses,
    "op5_decontamination": op5_decontamination,
    "op6_language": op6_language,
    "op7_quality": op7_quality,
    "op8_simhash": op8_simhash,
    "op9_pii": op9_pii,
    "op10_sharding": op10_sharding,
}
ORACLES = oracles.ORACLES
