"""Binary content: what it is, its printable strings, archives in it, and secrets in those."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections import Counter
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quillsieve.functions.text import is_placeholder, let, lowered
from quillsieve.patterns import CONTEXT_KEYWORDS, LINE_PATTERNS
from quillsieve.policy import ScanPolicy

# First bytes of formats, limits on archives, names of ELF sections, the patterns tried on strings.
MAGIC = ((b"SQLite format 3\0", "sqlite"), (b"PK\x03\x04", "zip"), (b"\x1f\x8b", "gzip"), (b"\x7fELF", "elf"))
MAX_ENTRIES, MAX_ENTRY, MAX_TOTAL, MAX_RATIO, MAX_DEPTH = 500, 10 << 20, 100 << 20, 1000, 8
ELF_SECTIONS = (".rodata", ".data", ".text", ".strtab", ".dynstr", ".comment")
STRING_PATTERNS = (
    ("aws_key_id", r"\b(AKIA|ABIA|ACCA|ASIA)[A-Z0-9]{16}\b"),
    ("gcp_api_key", r"\bAIza[0-9A-Za-z\-_]{35}\b"),
    ("github_pat", r"ghp_[A-Za-z0-9]{36}"),
    ("stripe_sk", r"sk_(live|test)_[A-Za-z0-9]{24,}"),
)
UNSUPPORTED = (".tar", ".tgz", ".bz2", ".xz", ".7z", ".rar", ".zst")
LABELS = {"sqlite": "SQLite", "zip": "ZIP", "elf": "ELF"}
PRINTABLE = re.compile(rb"[\x20-\x7e]{4,}")


def content_kind(content: Column, path: Column) -> Column:
    """struct<kind, confidence>: by magic, then by extension, then binary if the first 8192 bytes hold over 10 NULs."""
    kind = F.lit(None).cast("string")
    for magic, name in reversed(MAGIC):
        kind = F.when(F.startswith(content, F.lit(bytearray(magic))), name).otherwise(kind)
    name = F.lower(F.substring_index(path, ".", -1))
    by_name = F.when(name.isin("db", "sqlite", "sqlite3"), "sqlite").when(name.isin("zip", "jar", "war", "apk"), "zip").when(name == "gz", "gzip").when(name.isin("so", "elf"), "elf")
    probe = F.hex(F.substring(content, 1, 8192))
    nuls = F.size(F.filter(F.regexp_extract_all(probe, F.lit(".."), F.lit(0)), lambda b: b == "00"))
    found = F.coalesce(kind, by_name, F.when(nuls > 10, "binary"), F.lit("text"))
    return F.struct(found.alias("kind"), F.when(kind.isNotNull(), "magic").when(by_name.isNotNull(), "extension").otherwise("content").alias("confidence"))


def kind_of(data: bytes) -> str:
    return next((name for magic, name in MAGIC if data.startswith(magic)), "unknown")


def strings_of(data: bytes) -> list[str]:
    return [m.decode("ascii") for m in PRINTABLE.findall(data)]


def elf_strings(data: bytes) -> list[str]:
    """Strings of the named sections of an ELF file; of the whole file if it has none or is malformed."""
    try:
        wide, order = data[4] == 2, "<" if data[5] == 1 else ">"
        if wide:
            table = struct.unpack_from(order + "Q", data, 40)[0]
            size, count, names = struct.unpack_from(order + "HHH", data, 58)
        else:
            table = struct.unpack_from(order + "I", data, 32)[0]
            size, count, names = struct.unpack_from(order + "HHH", data, 46)
        sections = []
        for i in range(count):
            at = table + i * size
            name = struct.unpack_from(order + "I", data, at)[0]
            place, length = struct.unpack_from(order + ("QQ" if wide else "II"), data, at + (24 if wide else 16))
            sections.append((name, place, length))
        base = sections[names][1]
        chosen = []
        for name, place, length in sections:
            end = data.index(b"\0", base + name)
            if data[base + name : end].decode("ascii", "replace") in ELF_SECTIONS:
                chosen.append(data[place : place + length])
        if chosen:
            return list(dict.fromkeys(s for part in chosen for s in strings_of(part)))
    except (struct.error, IndexError, ValueError):
        pass
    return list(dict.fromkeys(strings_of(data)))


def zip_entries(data: bytes, issues: Counter) -> Iterator[tuple[str, bytes]]:
    """Entries of an archive within the limits; what is left out is counted by reason."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            infos = archive.infolist()
            if len(infos) > MAX_ENTRIES:
                issues["entry_count"] += 1
            total = 0
            for info in infos[:MAX_ENTRIES]:
                if info.is_dir():
                    continue
                if info.filename.startswith("/") or ".." in info.filename.replace("\\", "/").split("/"):
                    issues["traversal"] += 1
                    continue
                if info.file_size > MAX_ENTRY:
                    issues["entry_size"] += 1
                    continue
                with archive.open(info) as f:
                    body = f.read(MAX_ENTRY + 1)
                if len(body) > MAX_ENTRY:
                    issues["entry_size"] += 1
                    continue
                total += len(body)
                if total > MAX_TOTAL:
                    issues["expansion_size"] += 1
                    return
                yield info.filename, body
    except (zipfile.BadZipFile, zlib.error, EOFError, OSError, RuntimeError, NotImplementedError, ValueError):
        issues["malformed"] += 1


def gunzip(data: bytes, issues: Counter) -> bytes | None:
    try:
        machine = zlib.decompressobj(31)
        out = machine.decompress(data, MAX_TOTAL + 1)
    except zlib.error:
        issues["malformed"] += 1
        return None
    if len(out) > MAX_TOTAL or len(out) > MAX_RATIO * max(1, len(data)):
        issues["expansion_size"] += 1
        return None
    return out


def strings_within(path: str, data: bytes, limit: int, issues: Counter, depth: int = 0) -> Iterator[tuple[str, str]]:
    """(string, context) of everything printable in a binary and the archives in it."""
    if len(data) > limit:
        issues["scan_size"] += 1
        return
    kind = kind_of(data)
    if kind == "zip":
        if depth >= MAX_DEPTH:
            issues["depth"] += 1
            return
        for name, body in zip_entries(data, issues):
            yield from strings_within(f"{path}!{name}", body, limit, issues, depth + 1)
        return
    if kind == "gzip":
        if depth >= MAX_DEPTH:
            issues["depth"] += 1
        elif (body := gunzip(data, issues)) is not None:
            yield from strings_within(f"{path}!gz", body, max(limit, len(body)), issues, depth + 1)
    if kind == "unknown" and path.lower().endswith(UNSUPPORTED):
        issues["unsupported_format"] += 1
    found = elf_strings(data) if kind == "elf" else list(dict.fromkeys(strings_of(data))) if kind == "sqlite" else strings_of(data)
    for s in found:
        yield s, f"{LABELS.get(kind, 'Binary')}: {path}"


def scan_binaries(files: DataFrame, custom: tuple[tuple[str, str, str, str], ...] = (), limit: int = 4 << 20) -> DataFrame:
    """(filename, findings, issues) of binary files (filename, content).

    findings are (pattern_id, match, context): of each string the first hit of the registered patterns and
    all hits of the custom ones; issues count what of archives was left out. Null content has neither.
    """
    wanted = StructType.fromDDL("filename string, findings array<struct<pattern_id:string,match:string,context:string>>, issues map<string,int>")

    def run(batches):
        first = [(i, re.compile(r)) for i, r in STRING_PATTERNS]
        more = [(i, re.compile(r)) for i, _, _, r in custom]
        kind = to_arrow_schema(wanted)
        for batch in batches:
            names, found, left = batch.column(0).to_pylist(), [], []
            for name, content in zip(names, batch.column(1).to_pylist()):
                issues: Counter = Counter()
                hits = []
                for s, context in strings_within(name or "", content or b"", limit, issues):
                    hit = next(((i, m[0], context) for i, rx in first if (m := rx.search(s))), None)
                    if hit:
                        hits.append(hit)
                    hits += [(i, m[0], context) for i, rx in more for m in rx.finditer(s)]
                found.append([{"pattern_id": i, "match": m, "context": c} for i, m, c in hits])
                left.append(list(issues.items()))
            yield pa.RecordBatch.from_arrays([pa.array(names, kind.field(0).type), pa.array(found, kind.field(1).type), pa.array(left, kind.field(2).type)], schema=kind)

    return files.select("filename", "content").mapInArrow(run, wanted)


def high_entropy_region(data: bytes) -> bool:
    """Whether a region looks compressed or encrypted: over 7.5 bits a byte in its first 4096 bytes, 16 at least."""
    if len(data) < 16:
        return False
    part = data[:4096]
    return -sum(n / len(part) * log2(n / len(part)) for n in Counter(part).values()) > 7.5


def binary_confidence(context: Column, extra: tuple[str, ...] = ()) -> Column:
    """Why a finding in a binary is less sure, from its context; comments say nothing there. Null if it is not."""
    words = F.split(F.lit("\x01".join((*CONTEXT_KEYWORDS, *extra))), "\x01")

    def weigh(low):
        found = F.filter(words, lambda k: F.contains(low, F.lower(k)))
        one = F.concat(F.lit("possible placeholder: '"), F.get(found, F.lit(0)), F.lit("' in binary string"))
        return F.when(F.size(found) >= 2, "likely placeholder: 2+ keywords in binary string").when(F.size(found) == 1, one)

    return let(F.lower(context), weigh)


# What a finding of a pattern without words of its own is called, by the kind of the binary.
FALLBACK = {"zip": "ZIP Secret", "elf": "ELF Secret", "gzip": "GZIP Secret"}


def repository_findings(scanned: DataFrame, objects: DataFrame, policy: ScanPolicy = ScanPolicy(), custom: tuple[tuple[str, str, str, str], ...] = ()) -> DataFrame:
    """Findings in binaries of a repository, given scans (filename, findings) and objects (filename, sha1, is_deleted, kind).

    A pattern's words are those of the custom one of its id, else of the built-in one, else generic and
    HIGH. Placeholders go unless the policy is exhaustive. The context lowers the severity except in
    archives of entries and executables.
    """
    rows = scanned.join(objects, "filename").select("filename", "sha1", "is_deleted", "kind", F.explode("findings").alias("f")).select("filename", "sha1", "is_deleted", "kind", "f.*")
    if not policy.exhaustive:
        rows = rows.filter(~is_placeholder(F.col("match")))
    known = {**{p[0]: (p[1], p[2]) for p in LINE_PATTERNS}, **{p[0]: (p[1], p[2]) for p in custom}}
    words = rows.sparkSession.createDataFrame([(i, s, d) for i, (s, d) in known.items()], "pattern_id string, known_severity string, known_description string")
    fallback = F.lit("Binary Secret")
    for kind, said in FALLBACK.items():
        fallback = F.when(F.col("kind") == kind, said).otherwise(fallback)
    told = rows.join(F.broadcast(words), "pattern_id", "left").withColumn("reason", F.when(F.col("kind").isin("zip", "elf"), F.lit(None).cast("string")).otherwise(binary_confidence(F.col("context"), policy.keywords)))
    severity = F.coalesce("known_severity", F.lit("HIGH"))
    return told.select(
        "filename", F.lit(1).alias("line"), "pattern_id", F.coalesce("known_description", fallback).alias("description"), F.when(F.col("reason").isNotNull(), lowered(severity)).otherwise(severity).alias("severity"),
        "match", "context", "is_deleted", F.col("sha1").alias("commit_sha1"), F.col("reason").alias("confidence_adjustment"),
    )


def binary_findings(scanned: DataFrame, custom: tuple[tuple[str, str, str, str], ...] = ()) -> DataFrame:
    """Findings in the form of the text detectors: custom patterns keep their words, others are HIGH and generic."""
    rows = scanned.select("filename", F.explode("findings").alias("f"))
    severity, description = F.lit("HIGH"), F.lit("Secret found in binary content")
    for pid, sev, desc, _ in custom:
        severity = F.when(F.col("f.pattern_id") == pid, sev).otherwise(severity)
        description = F.when(F.col("f.pattern_id") == pid, desc).otherwise(description)
    return rows.select("filename", F.lit(1).alias("line"), "f.pattern_id", description.alias("description"), severity.alias("severity"), "f.match", "f.context")
