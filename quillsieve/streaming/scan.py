"""Incremental scans: files as a stream, findings and outcomes appended, resumed by checkpoints."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from quillsieve.operators.outcomes import accumulated
from quillsieve.plans.scan import scan_text
from quillsieve.policy import ScanPolicy
from quillsieve.schemas import FILES
from quillsieve.streaming import manifest


def fingerprint(policy: ScanPolicy, patterns: tuple = ()) -> str:
    """SHA-256 of all that decides findings: a checkpoint of another fingerprint is not resumed."""
    return hashlib.sha256(json.dumps([asdict(policy), list(patterns)], sort_keys=True).encode()).hexdigest()


def outcome_rows(batch: DataFrame, policy: ScanPolicy) -> DataFrame:
    """(filename, outcome, reason, bytes) of texts: scanned, failed (unreadable) or skipped (oversized)."""
    size = F.octet_length("text")
    outcome = F.when(F.col("text").isNull(), "failed").when(size > policy.max_blob_bytes, "skipped").otherwise("scanned")
    reason = F.when(F.col("text").isNull(), "unreadable").when(size > policy.max_blob_bytes, "oversized")
    return batch.select("filename", outcome.alias("outcome"), reason.alias("reason"), F.coalesce(size, F.lit(0)).cast("long").alias("bytes"))


class Ended(RuntimeError):
    """A scan has found what it was to stop at."""


def start_scan(spark: SparkSession, source: str, target: str, checkpoint: str, policy: ScanPolicy = ScanPolicy(), custom: tuple = (), files_per_batch: int = 1000, anew: bool = True, key: bytes | None = None, stop_on_critical: bool = False, max_findings: int = 0) -> StreamingQuery:
    """Scans the Parquet files (see ``FILES``) of a folder that are not done yet, and ends.

    Findings go to ``target``/findings and one row for each file to ``target``/outcomes, both by batch, so
    that a repeated batch replaces itself. Progress lies under the policy's fingerprint, which the
    checkpoint's manifest names (sealed where a ``key`` is given). With another policy or other patterns
    the scan starts anew, or is refused with ``manifest.Mismatch`` where ``anew`` is false. Failed batches
    are not marked as done, and only files that were scanned count as such: see ``unfinished``. A scan that
    is to stop ends before the batch after the one that gave it reason to; that batch is left for later.
    """
    mark = fingerprint(policy, custom)
    known = manifest.read(spark, f"{checkpoint}/manifest.json", key)
    if known and known["fingerprint"] != mark and not anew:
        raise manifest.Mismatch("the checkpoint is of a scan with another policy or other patterns")
    manifest.write(spark, f"{checkpoint}/manifest.json", {"fingerprint": mark, "policy": asdict(policy), "patterns": [list(p) for p in custom]}, key)
    files = spark.readStream.schema(FILES).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    state = {"findings": 0, "ended": False}

    def append(batch: DataFrame, number: int) -> None:
        if state["ended"]:
            raise Ended(f"{state['findings']} findings")
        at = f"{target}/findings/scan={mark[:16]}/batch={number}"
        scan_text(batch, policy, custom).write.mode("overwrite").parquet(at)
        outcome_rows(batch, policy).write.mode("overwrite").parquet(f"{target}/outcomes/scan={mark[:16]}/batch={number}")
        if stop_on_critical or max_findings:
            got = spark.read.parquet(at).agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "CRITICAL").alias("c")).first()
            state["findings"] += got["n"]
            state["ended"] = bool(stop_on_critical and got["c"]) or bool(max_findings and state["findings"] >= max_findings)

    return files.writeStream.foreachBatch(append).option("checkpointLocation", f"{checkpoint}/{mark}").trigger(availableNow=True).start()


def run_scan(*args, **options) -> bool:
    """``start_scan`` to its end; whether all that was there is done (false: it stopped early)."""
    query = start_scan(*args, **options)
    try:
        query.awaitTermination()
    except Exception as e:
        if "Ended" in str(e):
            return False
        raise
    return True


def outcomes(spark: SparkSession, target: str, mark: str | None = None) -> DataFrame:
    """All outcomes of a target's scans, or of those of one fingerprint."""
    rows = spark.read.parquet(f"{target}/outcomes")
    return rows if mark is None else rows.filter(F.col("scan") == mark[:16])


def unfinished(files: DataFrame, done: DataFrame) -> DataFrame:
    """The files without an outcome ``scanned``: failed and skipped ones are tried again."""
    return files.join(done.filter("outcome = 'scanned'").select("filename"), "filename", "left_anti").select(files.columns)


def scan_state(done: DataFrame) -> DataFrame:
    """One row of all that is done so far, from the outcomes: of a file tried more than once its best outcome counts."""
    rank = F.when(F.col("outcome") == "scanned", 0).when(F.col("outcome") == "skipped", 1).otherwise(2)
    last = done.groupBy("filename").agg(F.min_by(F.struct("outcome", "reason", "bytes"), rank).alias("o")).select("o.*")
    return accumulated(last.withColumn("tech", F.array().cast("array<string>")))


def first_views(entries: DataFrame, late: str = "1 hour") -> DataFrame:
    """Of a stream of history entries (repo, path, blob_sha, commit_sha, status, ts) the first of each view, within the watermark.

    Removed entries without a blob are none. The state holds the views of the watermark's span only.
    """
    kept = entries.filter(~((F.col("status") == "removed") & F.col("blob_sha").isNull()))
    keyed = kept.withColumn("view_key", F.concat_ws(":", "path", F.coalesce("blob_sha", "commit_sha")))
    return keyed.withWatermark("ts", late).dropDuplicatesWithinWatermark(["repo", "view_key"])


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Windowed counts of an event stream (ts, event_type); an addition without a counterpart in file scans."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
