"""The tables that operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

FINDING = T.StructType(
    [
        T.StructField("filename", T.StringType()),
        T.StructField("line", T.IntegerType()),
        T.StructField("pattern_id", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("match", T.StringType()),
        T.StructField("context", T.StringType()),
        T.StructField("is_deleted", T.BooleanType()),
        T.StructField("commit_sha1", T.StringType()),
        T.StructField("confidence_adjustment", T.StringType()),
    ]
)
FINDING_COLUMNS = FINDING.fieldNames()
PATTERNS = T.StructType([T.StructField(n, T.StringType(), False) for n in ("id", "severity", "description", "regex")])
FILES = T.StructType([T.StructField("filename", T.StringType()), T.StructField("text", T.StringType()), T.StructField("is_deleted", T.BooleanType()), T.StructField("commit_sha1", T.StringType())])
