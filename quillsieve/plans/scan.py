"""Whole scans: a table of texts to findings and their roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsieve.functions.paths import ai_kind, of_kind
from quillsieve.operators.blocks import with_block_hits, with_yaml_hits
from quillsieve.operators.hits import findings, hit, prepared
from quillsieve.operators.lines import with_line_hits, with_segment_hits
from quillsieve.policy import ScanPolicy
from quillsieve.schemas import FINDING_COLUMNS


def path_hits(filename: Column) -> Column:
    """The one hit of a file at a path of an AI tool; null for others."""
    kind = ai_kind(filename)
    one = lambda k: hit(detector=F.lit("path"), rank=F.lit(0), line=F.lit(1), pattern_id=F.concat(F.lit("ai_path_"), k), description=of_kind(k, 2), severity=of_kind(k, 3), match=filename, context=F.concat(F.lit("ai_path_category="), k, F.lit("_path")))
    return F.when(kind.isNotNull(), F.transform(F.array(kind), one))


def detect_ai_paths(df: DataFrame) -> DataFrame:
    """One finding for each file at a path of an AI tool."""
    return findings(df, [path_hits(F.col("filename"))], ScanPolicy())


def scan_text(files: DataFrame, policy: ScanPolicy = ScanPolicy(), custom: tuple = ()) -> DataFrame:
    """All findings in a table (filename, text, is_deleted, commit_sha1): every detector on every text within the size limit.

    Null texts have no findings but those of their path. The texts are read once: each detector adds an
    array of hits to its row, and one explode makes findings of them all. Nothing shuffles, but for an
    input of fewer parts than cores.
    """
    whole = files.filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= policy.max_blob_bytes)
    rows = with_line_hits(prepared(whole), policy, custom)
    rows = with_yaml_hits(with_block_hits(with_segment_hits(rows, policy), policy), policy)
    return findings(rows, [path_hits(F.col("filename")), *[F.col(f"{d}_hits") for d in ("line", "segment", "block", "yaml")]], policy).select(*FINDING_COLUMNS)


def as_files(df: DataFrame, name, text: str = "text") -> DataFrame:
    """A table of texts in the form that scans take."""
    return df.select(name.alias("filename"), F.col(text).alias("text"), F.lit(False).alias("is_deleted"), F.lit(None).cast("string").alias("commit_sha1"))
