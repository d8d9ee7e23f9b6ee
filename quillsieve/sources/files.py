"""Directories, target lists and pattern files."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Limits on a file of custom patterns.
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")
MAX_PATTERNS, MAX_ID, MAX_DESCRIPTION, MAX_REGEX, MAX_GROUPS, MAX_BRANCHES = 100, 100, 500, 1000, 20, 15


def read_directory(spark: SparkSession, root: str, max_bytes: int = 4 << 20) -> DataFrame:
    """(path, length, content) of the files under a directory that are within the limit; larger ones are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.filter(F.col("length") <= max_bytes).select("path", "length", "content")


def as_text(files: DataFrame, root: str = "") -> DataFrame:
    """Files as texts: bytes that are no UTF-8 become U+FFFD; the filename is the path below ``root``."""
    name = F.when(F.contains("path", F.lit(root.rstrip("/") + "/")), F.substring_index("path", root.rstrip("/") + "/", -1)).otherwise(F.col("path")) if root else F.col("path")
    return files.select(name.alias("filename"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.lit(False).alias("is_deleted"), F.lit(None).cast("string").alias("commit_sha1"))


TARGET = "struct<url:string,fuzz:boolean,token:string,provider:string,repos:array<string>,selectors:array<string>,dir:string>"


def read_targets(lines: DataFrame, column: str = "value") -> DataFrame:
    """(kind, url, dir, token, provider, selectors, fuzz) of the lines of a target list.

    Blank lines and those that start with # are none; a JSON object is what its keys say, any other
    line is a URL. Selectors are those of both keys, each once.
    """
    rows = lines.select(F.trim(column).alias("line")).filter((F.col("line") != "") & ~F.startswith("line", F.lit("#")))
    j = F.from_json("line", TARGET)
    parsed = rows.select("line", F.when(F.startswith("line", F.lit("{")), j).alias("j"))
    kind = F.when(F.col("j.token").isNotNull(), "token").when(F.col("j.dir").isNotNull(), "dir").otherwise("url")
    both = F.array_distinct(F.concat(F.coalesce("j.repos", F.array().cast("array<string>")), F.coalesce("j.selectors", F.array().cast("array<string>"))))
    return parsed.select(kind.alias("kind"), F.when(kind == "url", F.coalesce("j.url", "line")).alias("url"), F.col("j.dir").alias("dir"), F.col("j.token").alias("token"), F.col("j.provider").alias("provider"), both.alias("selectors"), F.coalesce("j.fuzz", F.lit(False)).alias("fuzz"))


def load_patterns(path: str) -> tuple[tuple[str, str, str, str], ...]:
    """(id, severity, description, regex) of a JSON file {"patterns": [...]}, checked on the driver."""
    return check_patterns(json.loads(Path(path).read_text())["patterns"])


def check_patterns(rows: list[dict]) -> tuple[tuple[str, str, str, str], ...]:
    if not 1 <= len(rows) <= MAX_PATTERNS:
        raise ValueError(f"1 to {MAX_PATTERNS} patterns are allowed")
    out = []
    for row in rows:
        pid, severity, description, regex = (row.get(k) for k in ("id", "severity", "description", "regex"))
        if not pid or not regex or len(pid) > MAX_ID or len(description or "") > MAX_DESCRIPTION or len(regex) > MAX_REGEX:
            raise ValueError(f"pattern {pid!r}: a field is missing or too long")
        if severity not in SEVERITIES:
            raise ValueError(f"pattern {pid!r}: unknown severity {severity!r}")
        if regex.count("(") > MAX_GROUPS or regex.count("|") > MAX_BRANCHES or re.search(r"\([^()]*[+*][^()]*\)[+*]", regex):
            raise ValueError(f"pattern {pid!r}: too costly")
        re.compile(regex)
        out.append((pid, severity, description or "", regex))
    return tuple(out)
