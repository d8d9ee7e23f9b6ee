"""Resumed, refused and ended scans."""

import hashlib

import pytest

from quillsieve.policy import ScanPolicy
from quillsieve.schemas import FILES
from quillsieve.streaming import manifest, scan

KEY = "AKIA" + hashlib.sha256(b"seed").hexdigest()[:16].upper()


def put(spark, folder, rows):
    spark.createDataFrame([(n, t, False, None) for n, t in rows], FILES).coalesce(1).write.mode("append").parquet(folder)


def test_another_policy_is_refused_or_starts_anew(spark, tmp_path):
    source, target, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    put(spark, source, [("a", f"k {KEY}"), ("b", None)])
    assert scan.run_scan(spark, source, target, marks, key=b"k1")
    with pytest.raises(manifest.Mismatch):
        scan.start_scan(spark, source, target, marks, ScanPolicy(exhaustive=True), anew=False, key=b"k1")
    with pytest.raises(manifest.Mismatch):
        scan.start_scan(spark, source, target, marks, key=b"k2")
    assert scan.run_scan(spark, source, target, marks, ScanPolicy(exhaustive=True), key=b"k1")
    done = scan.outcomes(spark, target, scan.fingerprint(ScanPolicy()))
    assert {(r["filename"], r["outcome"]) for r in done.collect()} == {("a", "scanned"), ("b", "failed")}
    files = spark.read.schema(FILES).parquet(source)
    assert [r["filename"] for r in scan.unfinished(files, done).collect()] == ["b"]
    state = scan.scan_state(scan.outcomes(spark, target)).first()
    assert (state["blobs_scanned"], state["blobs_failed"]) == (1, 1)


def test_manifests_are_sealed(spark, tmp_path):
    path = str(tmp_path / "m" / "manifest.json")
    assert manifest.read(spark, path) is None
    manifest.write(spark, path, {"fingerprint": "x", "n": 1}, b"key")
    assert manifest.read(spark, path, b"key") == {"fingerprint": "x", "n": 1}
    text = (tmp_path / "m" / "manifest.json").read_text()
    (tmp_path / "m" / "manifest.json").write_text(text.replace('"n":1', '"n":2'))
    (tmp_path / "m" / ".manifest.json.crc").unlink(missing_ok=True)
    with pytest.raises(manifest.Mismatch):
        manifest.read(spark, path, b"key")
    assert manifest.drop_old(spark, str(tmp_path), 0) == 0 and manifest.drop_old(spark, str(tmp_path), 10**15) == 1


def test_a_scan_ends_early_and_goes_on(spark, tmp_path):
    source, target, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    for name in "abc":
        put(spark, source, [(name, f"k {KEY}")])
    assert not scan.run_scan(spark, source, target, marks, files_per_batch=1, stop_on_critical=True)
    first = spark.read.parquet(f"{target}/findings").count()
    assert first == 1
    assert scan.run_scan(spark, source, target, marks, files_per_batch=1)
    assert spark.read.parquet(f"{target}/findings").count() == 3


def test_views_of_a_stream(spark, tmp_path):
    rows = [("r", "f", "b1", "c1", "added"), ("r", "f", "b1", "c2", "modified"), ("r", "g", None, "c1", "removed"), ("r", "g", None, "c3", "added")]
    spark.createDataFrame(rows, "repo string, path string, blob_sha string, commit_sha string, status string").selectExpr("*", "timestamp'2020-01-01 00:00:00' AS ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("repo string, path string, blob_sha string, commit_sha string, status string, ts timestamp").parquet(str(tmp_path / "in"))
    query = scan.first_views(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "marks")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r["view_key"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"f:b1", "g:c3"}
