"""Manifests of scans: what a checkpoint was made with, sealed by a key, so that only the same scan resumes it."""

from __future__ import annotations

import hashlib
import hmac
import json

from pyspark.sql import SparkSession

# The largest manifest and the days after which an unfinished scan's is dropped.
MAX_BYTES, KEPT_DAYS = 10 << 20, 7


class Mismatch(RuntimeError):
    """The checkpoint belongs to another scan, or its manifest was changed."""


def canonical(document: dict) -> bytes:
    return json.dumps(document, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def seal(document: dict, key: bytes) -> str:
    """HMAC-SHA256 of a document's canonical form."""
    return hmac.new(key, canonical(document), hashlib.sha256).hexdigest()


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def write(spark: SparkSession, path: str, document: dict, key: bytes | None = None) -> None:
    """Writes a manifest beside the one that is there and puts it in its place, so that a lost driver leaves the old or the new one."""
    body = canonical(document if key is None else {**document, "mac": seal(document, key)})
    if len(body) > MAX_BYTES:
        raise ValueError("manifest too large")
    fs, at = _path(spark, path)
    _, part = _path(spark, f"{path}.part")
    out = fs.create(part, True)
    out.write(bytearray(body))
    out.close()
    fs.delete(at, False)
    fs.rename(part, at)


def read(spark: SparkSession, path: str, key: bytes | None = None) -> dict | None:
    """The manifest at a path, None if there is none; one that its seal does not fit is a ``Mismatch``.

    A manifest without a seal, as written without a key, is taken as it is.
    """
    fs, at = _path(spark, path)
    if not fs.exists(at):
        _, part = _path(spark, f"{path}.part")
        if not fs.exists(part):
            return None
        # the driver was lost between the two steps of a write
        fs.rename(part, at)
    if fs.getFileStatus(at).getLen() > MAX_BYTES:
        raise Mismatch("manifest too large")
    document = json.loads(spark.read.option("wholetext", True).text(path).first()[0])
    mac = document.pop("mac", None)
    if mac is not None and (key is None or not hmac.compare_digest(mac, seal(document, key))):
        raise Mismatch("the manifest's seal does not fit")
    return document


def drop_old(spark: SparkSession, folder: str, now_ms: int, days: int = KEPT_DAYS) -> int:
    """Deletes the scan folders directly under ``folder`` that nothing has touched for so many days; their number."""
    fs, at = _path(spark, folder)
    if not fs.exists(at):
        return 0
    old = [s.getPath() for s in fs.listStatus(at) if s.isDirectory() and max([s.getModificationTime(), *[x.getModificationTime() for x in fs.listStatus(s.getPath())]]) < now_ms - days * 86_400_000]
    for path in old:
        fs.delete(path, True)
    return len(old)
