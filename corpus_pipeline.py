"""The corpus pipeline: documents in, packed training ids out; each stage works on all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsieve.llm import pii_weak, quality_cnn, sentencepiece_topk, simhash_golay, suffix_decontam
from quillsieve.llm.common import materialize, sweep, written
from quillsieve.llm.queries import PIECE_MODEL, table
from quillsieve.session import ship_package

#: Documents below this probability of label 1 are rejected.
QUALITY = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality network, trained on labels of these documents, rejects."""
    ship_package(spark)
    network = quality_cnn.train(docs, table(spark, sf_dir, "labels"))
    scored = quality_cnn.score_quality(docs, network, keep=docs.columns, out="__score")
    return scored.filter(F.col("__score") >= QUALITY).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, of the smallest id, of each group linked by a similarity of 0.8 over five-word shingles."""
    ship_package(spark)
    return simhash_golay.drop_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item."""
    ship_package(spark)
    return suffix_decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; n_chars follows the text."""
    redacted = pii_weak.redact_pii(docs)
    if "n_chars" not in docs.columns:
        return redacted
    return redacted.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each document and sampled segmentation: doc_id, source, lang, sample, ids and scores."""
    ship_package(spark)
    pieces = sentencepiece_topk.load_pieces(PIECE_MODEL)
    sampled = sentencepiece_topk.sample_encodings(docs, pieces, k=2, keep=["doc_id", "lang", "source"])
    return sampled.select("doc_id", "lang", "source", F.posexplode_outer("samples").alias("sample", "s")).select("doc_id", "lang", "source", "sample", "s.*")


STAGES = [
    ("quality", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("encoding", encoding),
]

#: The stages' models and fingerprints are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    before = written()
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        # all that the stage and those before it have written has served
        sweep(spark, before, docs)
    return docs
