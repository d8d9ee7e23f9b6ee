"""Metadata files of a repository's control directory, and what they say of branches, packs and submodules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsieve.functions.text import trim
from quillsieve.sources.git import ini_entries, packed_refs

# The files of a control directory that are read, in the order in which they are asked for.
META_FILES = (
    "HEAD", "config", "packed-refs", "index", "logs/HEAD", "COMMIT_EDITMSG", "ORIG_HEAD", "FETCH_HEAD", "MERGE_HEAD", "CHERRY_PICK_HEAD", "SQUASH_MSG", "REBASE_HEAD", "rebase-merge/head-name", "config.worktree", "shallow",
    "description", "info/exclude",
    "refs/heads/master", "refs/heads/main", "refs/heads/develop", "refs/heads/dev", "refs/heads/staging", "refs/heads/production", "refs/heads/release", "refs/heads/hotfix", "refs/heads/test", "refs/heads/beta",
    "refs/heads/feature", "refs/heads/fix", "refs/heads/next", "refs/heads/trunk",
    "refs/tags/latest", "refs/tags/v1", "refs/tags/v2", "refs/tags/v1.0", "refs/tags/v1.0.0", "refs/tags/v2.0.0",
    "refs/remotes/origin/HEAD", "refs/remotes/origin/master", "refs/remotes/origin/main", "refs/remotes/origin/develop", "refs/remotes/origin/staging", "refs/remotes/origin/production",
    "refs/remotes/upstream/HEAD", "refs/remotes/upstream/main", "refs/stash",
    "logs/refs/heads/master", "logs/refs/heads/main", "logs/refs/heads/develop", "logs/refs/remotes/origin/HEAD",
    "objects/info/packs", "info/refs", "info/refs?service=git-upload-pack", "refs/wip/index/refs/heads/master", "refs/wip/wtree/refs/heads/master", ".gitmodules", ".gitattributes",
)
MAX_BRANCHES = 20


def metadata_table(spark: SparkSession) -> DataFrame:
    """(seq, path) of the metadata files."""
    return spark.createDataFrame(list(enumerate(META_FILES)), "seq int, path string")


def read_metadata(spark: SparkSession, root: str) -> DataFrame:
    """(seq, path, content) of the metadata files that a control directory has; nothing else in it is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.regexp_replace(F.substring_index("path", root.rstrip("/") + "/", -1), "^/", "").alias("path"), "content")
    return metadata_table(spark).join(files, "path").select("seq", "path", "content")


def pack_names(text: Column) -> Column:
    """The hashes of the packs that objects/info/packs lists."""
    return F.regexp_extract_all(text, F.lit(r"P\s+pack-([0-9a-f]{40})\.pack"), F.lit(1))


def info_refs(files: DataFrame, text: str = "text") -> DataFrame:
    """(path, sha1, ref_name) of the tab-separated lines of info/refs files (path, text)."""
    parts = F.split("line", "\t", 2)
    lines = files.select("path", F.explode(F.split(F.col(text), r"\r?\n", -1)).alias("line")).filter(F.contains("line", F.lit("\t")))
    return lines.select("path", trim(parts[0]).alias("sha1"), trim(parts[1]).alias("ref_name"))


def branches(refs: DataFrame) -> DataFrame:
    """(path, branch) of the heads among references (path, ref_name), each once."""
    return refs.filter(F.startswith("ref_name", F.lit("refs/heads/"))).select("path", F.substring("ref_name", 12, 4096).alias("branch")).distinct()


def config_branches(entries: DataFrame) -> DataFrame:
    """(path, branch) of the branch sections among INI entries, each once."""
    return entries.filter(F.startswith("section", F.lit("branch."))).select("path", F.substring("section", 8, 4096).alias("branch")).distinct()


def submodules(entries: DataFrame) -> DataFrame:
    """(path, section, url) of the submodules among INI entries; of a file each url once, of its first section."""
    rows = entries.filter(F.startswith("section", F.lit("submodule.")) & (F.col("key") == "url"))
    return rows.groupBy("path", F.col("value").alias("url")).agg(F.min("section").alias("section")).select("path", "section", "url")


def all_branches(files: DataFrame) -> DataFrame:
    """(branch) named by packed references, info/refs, configurations and loose heads of metadata files (path, text), each once and sorted, ``MAX_BRANCHES`` at most."""
    named = branches(packed_refs(files.filter("path = 'packed-refs'"))).union(branches(info_refs(files.filter("path = 'info/refs'")))).union(config_branches(ini_entries(files.filter("path = 'config'"))))
    loose = files.filter(F.startswith("path", F.lit("refs/heads/"))).select("path", F.substring("path", 12, 4096).alias("branch"))
    return named.union(loose).select("branch").distinct().orderBy("branch").limit(MAX_BRANCHES)


def listed_hashes(files: DataFrame) -> DataFrame:
    """(sha1) named by references, logs and operation heads of metadata files (path, text), each once; not the null hash."""
    heads = ("HEAD", "packed-refs", "ORIG_HEAD", "FETCH_HEAD", "MERGE_HEAD", "CHERRY_PICK_HEAD", "REBASE_HEAD", "shallow")
    told = files.filter(F.col("path").isin(*heads) | F.startswith("path", F.lit("refs/")) | F.startswith("path", F.lit("logs/")) | F.startswith("path", F.lit("info/refs")))
    found = told.select(F.explode(F.regexp_extract_all("text", F.lit(r"\b([0-9a-f]{40})\b"), F.lit(1))).alias("sha1"))
    return found.filter(F.col("sha1") != "0" * 40).distinct()
