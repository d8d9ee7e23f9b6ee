"""What all text detectors share: prepared texts, arrays of hits, and the findings made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsieve.functions import text as X
from quillsieve.functions.gates import lowered
from quillsieve.policy import ScanPolicy
from quillsieve.schemas import FINDING_COLUMNS

#: ``around`` is the text whose words lower the confidence (null: none looked at), ``note`` what is said where they do not.
HIT = "struct<detector:string,rank:int,line:int,pattern_id:string,description:string,severity:string,match:string,context:string,around:string,note:string>"
FIELDS = ("detector", "rank", "line", "pattern_id", "description", "severity", "match", "context", "around", "note")
NONE = f"cast(array() AS array<{HIT}>)"
AROUND = 3


def hit(**values: Column) -> Column:
    """A hit; what is not given is null."""
    return F.struct(*[values.get(f, F.lit(None)).alias(f) for f in FIELDS]).cast(HIT)


def spread(df: DataFrame) -> DataFrame:
    """The rows on every core where the input has fewer parts than cores: a large file of one row group is one part."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if not df.isStreaming and df.rdd.getNumPartitions() < cores else df


def prepared(df: DataFrame) -> DataFrame:
    """The texts of a table (filename, text, is_deleted, commit_sha1) with ``low`` and ``lines``, which all detectors read."""
    text = F.col("text")
    rows = spread(df.select("filename", "is_deleted", "commit_sha1", "text"))
    return rows.withColumns({"low": lowered(text), "lines": F.coalesce(X.lines_of(text), F.expr("cast(array() AS array<string>)"))})


def around(lines: Column, at: Column) -> Column:
    """The lines around a zero-based one, as one text."""
    return F.array_join(X.window_of(lines, at, AROUND), " ")


def findings(rows: DataFrame, hits: list[Column], policy: ScanPolicy) -> DataFrame:
    """Findings of the arrays of hits, with their detector and rank: one explode of what was found, nothing of the texts is carried."""
    found = rows.select("filename", "is_deleted", "commit_sha1", F.explode(F.concat(*[F.coalesce(h, F.expr(NONE)) for h in hits])).alias("h")).select("filename", "is_deleted", "commit_sha1", "h.*")
    reason = found.withColumn("reason", X.confidence(F.col("around"), policy.keywords))
    lower = F.col("reason").isNotNull()
    return reason.withColumns({"severity": F.when(lower, X.lowered(F.col("severity"))).otherwise(F.col("severity")), "confidence_adjustment": F.coalesce("reason", "note")}).select(*FINDING_COLUMNS, "detector", "rank")
