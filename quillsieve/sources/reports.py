"""Reports: JSON, SARIF, CSV, NDJSON, Markdown and HTML, as tables of lines and as files; envelopes, telemetry, saved sources."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsieve.functions.paths import ai_metadata, strict_path
from quillsieve.functions.text import SEVERITIES, csv_cell, html_escape, markdown_escape, sarif_level, severity_rank
from quillsieve.operators.rollup import report_rows, risk_label, sarif_rules

TOOL, VERSION = "quillsieve", "0.2.0"
MAX_CONTRIBUTORS = 50
# Marks and colours of the severities, the points and cap of each, and what is said of partial exposure.
MARKS = (("CRITICAL", "\U0001f534"), ("HIGH", "\U0001f7e1"), ("MEDIUM", "\U0001f7e0"), ("LOW", "\U0001f535"))
COLOURS = (("CRITICAL", "#ff4444"), ("HIGH", "#ff8800"), ("MEDIUM", "#ffbb00"), ("LOW", "#4488ff"))
POINTS = (("CRITICAL", 20, 60), ("HIGH", 10, 30), ("MEDIUM", 5, 15))
PARTIAL = "Metadata files are accessible, but objects cannot be fetched: the server blocks them or answers with something else."
CSV_HEAD = "file,line,severity,type,description,match,deleted,ai_related,ai_category,ai_tags"


def _of(severity: Column, table, other: str) -> Column:
    out = F.lit(other)
    for name, value in table:
        out = F.when(severity == name, value).otherwise(out)
    return out


def _ai(findings: DataFrame) -> DataFrame:
    return findings.withColumn("__ai", ai_metadata(F.col("pattern_id"), F.col("filename")))


def ndjson_lines(findings: DataFrame) -> DataFrame:
    """(value) a JSON object for each finding."""
    rows = report_rows(findings)
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def csv_lines(findings: DataFrame) -> DataFrame:
    """(value) a CSV line for each finding: texts quoted, numbers and booleans bare."""
    cell = lambda c: csv_cell(F.coalesce(F.col(c), F.lit("")))
    return _ai(findings).select(
        F.concat_ws(
            ",", cell("filename"), F.col("line").cast("string"), cell("severity"), cell("pattern_id"), cell("description"), cell("match"), F.col("is_deleted").cast("string"), F.col("__ai.ai_related").cast("string"),
            csv_cell(F.coalesce("__ai.ai_category", F.lit(""))), csv_cell(F.array_join("__ai.ai_tags", "|")),
        ).alias("value")
    )


def markdown_lines(findings: DataFrame) -> DataFrame:
    """(value) a row of the Markdown table for each finding."""
    cell = lambda c: markdown_escape(F.coalesce(F.col(c), F.lit("")))
    ai = F.when(F.col("__ai.ai_related"), F.concat(F.lit("\u2705 "), F.coalesce("__ai.ai_category", F.lit("ai")))).otherwise("\u2014")
    mark = F.concat(_of(F.col("severity"), MARKS, "\u26aa"), F.lit(" "), cell("severity"))
    match = F.concat(F.lit("`"), markdown_escape(F.left("match", F.lit(60))), F.lit("`"))
    return _ai(findings).select(F.concat(F.lit("| "), F.concat_ws(" | ", mark, cell("pattern_id"), cell("filename"), F.col("line").cast("string"), markdown_escape(ai), match), F.lit(" |")).alias("value"))


def html_lines(findings: DataFrame) -> DataFrame:
    """(value) a row of the HTML table for each finding."""
    cell = lambda c: html_escape(F.coalesce(F.col(c), F.lit("")))
    ai = F.when(F.col("__ai.ai_related"), F.coalesce("__ai.ai_category", F.lit("ai"))).otherwise("no")
    cells = F.concat_ws("</td><td>", cell("pattern_id"), cell("filename"), F.col("line").cast("string"), html_escape(ai))
    return _ai(findings).select(F.concat(F.lit("<tr><td style='color:"), _of(F.col("severity"), COLOURS, "#888888"), F.lit("'>"), cell("severity"), F.lit("</td><td>"), cells, F.lit("</td><td><code>"), html_escape(F.left("match", F.lit(80))), F.lit("</code></td></tr>")).alias("value"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """(value) a SARIF result for each finding."""
    place = F.struct(F.struct(F.struct(F.col("filename").alias("uri")).alias("artifactLocation"), F.struct(F.greatest("line", F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))
    return findings.select(F.to_json(F.struct(F.col("pattern_id").alias("ruleId"), sarif_level(F.col("severity")).alias("level"), F.struct(F.col("description").alias("text")).alias("message"), F.array(place).alias("locations"))).alias("value"))


def sarif_rule_lines(findings: DataFrame) -> DataFrame:
    rules = sarif_rules(findings)
    return rules.orderBy("pattern_id").select(F.to_json(F.struct(F.col("pattern_id").alias("id"), F.struct(F.col("description").alias("text")).alias("shortDescription"), F.struct("level").alias("defaultConfiguration"))).alias("value"))


def result_summary(findings: DataFrame) -> DataFrame:
    """One row: risk_score, risk_label, secrets_total, ai_findings_total, ai_category_counts, severity_counts (zeros too).

    Findings are counted by severity and category first; those few rows make the rest.
    """
    kinds = _ai(findings).groupBy("severity", F.when(F.col("__ai.ai_related"), F.coalesce("__ai.ai_category", F.lit("ai"))).alias("ai")).agg(F.count("*").alias("n"))
    of = lambda s: F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("n"))), F.lit(0))
    points = F.lit(0)
    for s, each, cap in POINTS:
        points = points + F.least(of(s) * each, F.lit(cap))
    totals = kinds.agg(F.least(points, F.lit(100)).cast("int").alias("risk_score"), F.coalesce(F.sum("n"), F.lit(0)).alias("secrets_total"), F.coalesce(F.sum(F.when(F.col("ai").isNotNull(), F.col("n"))), F.lit(0)).alias("ai_findings_total"), F.struct(*[of(s).alias(s) for s in SEVERITIES]).alias("severity_counts"))
    per = kinds.filter("ai IS NOT NULL").groupBy("ai").agg(F.sum("n").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ai", "n")))).alias("ai_category_counts"))
    return totals.crossJoin(per).select("risk_score", risk_label(F.col("risk_score")).alias("risk_label"), "secrets_total", "ai_findings_total", "ai_category_counts", "severity_counts")


def telemetry(findings_total: int, scan: dict | None = None) -> dict:
    """What a scan says of itself; the same object in every format."""
    s = scan or {}
    return {
        "schema_version": 1,
        "findings_total": findings_total,
        "blobs_scanned": s.get("blobs_scanned", 0),
        "blobs_failed": s.get("blobs_failed", 0),
        "bytes_scanned": s.get("bytes_scanned", 0),
        "elapsed_s": round(s.get("elapsed_s", 0.0), 2),
        "tech_stack": s.get("tech_stack", []),
        "files_saved": s.get("files_saved", 0),
        "files_save_failed": s.get("files_save_failed", 0),
        "object_sources": s.get("object_sources"),
        "cache": {"hits": s.get("cache_hits", 0), "misses": s.get("cache_misses", 0), "stats": s.get("cache_stats")},
        "rate_limit": {"allowed": s.get("rate_limit_allowed", 0), "dropped": s.get("rate_limit_dropped", 0), "wait_ms": s.get("rate_limit_wait_ms", 0)},
        "retry": s.get("retry"),
        "outcomes": s.get("outcomes"),
    }


def _result(findings: DataFrame, scan: dict | None, listed: bool) -> dict:
    """The result of a report but for its findings, which are written one partition at a time."""
    r = result_summary(findings).first().asDict(recursive=True)
    s = telemetry(r["secrets_total"], scan)
    out = {k: r[k] for k in ("risk_score", "secrets_total", "ai_findings_total")} | {"ai_category_counts": r["ai_category_counts"], "severity_counts": r["severity_counts"], "tech_stack": s["tech_stack"]}
    if listed:
        people = (scan or {}).get("contributors", [])[:MAX_CONTRIBUTORS]
        out |= {"commit_count": (scan or {}).get("commit_count", 0), "contributors": [{"name": n, "email": e} for n, e in people]}
    return out | {k: s[k] for k in ("blobs_scanned", "bytes_scanned", "elapsed_s", "files_saved", "files_save_failed", "cache", "rate_limit", "retry", "object_sources", "outcomes")}


def exposure_envelope(findings: DataFrame, target: str, timestamp: str, detection: dict | None = None, mapped: dict | None = None, scan: dict | None = None) -> dict:
    """The JSON report of an exposed repository, without its findings."""
    out = {"tool": TOOL, "version": VERSION, "timestamp": timestamp, "target": target}
    if detection:
        url = detection.get("git_url", "")
        path = url[len(target) :].lstrip("/") if url.startswith(target) else ""
        out["detection"] = {"git_url": url, "git_path": path, **{k: detection.get(k) for k in ("confidence", "label", "listing", "server", "branch", "remote_url")}}
    if mapped:
        out["map"] = {k: mapped.get(k) for k in ("total_sha1s", "blob_sha1s", "commit_sha1s", "branches", "remote_urls", "pack_count", "estimated_files", "estimated_bytes", "size_human")}
    return out | {"result": _result(findings, scan, True)}


def token_envelope(findings: DataFrame, login: str, repositories: int, timestamp: str, provider: str | None = None, selectors: list[str] | None = None, scan: dict | None = None) -> dict:
    """The JSON report of a scan by an access token, without its findings."""
    out = {"tool": TOOL, "version": VERSION, "mode": "token", "timestamp": timestamp, "token_user": login, "provider": provider, "repo_count": repositories, "scope": {"selectors": selectors}}
    return out | {"result": _result(findings, scan, False)}


def partial_report(target: str, timestamp: str, detection: dict, mapped: dict) -> dict:
    """The report of a repository whose metadata can be read but whose objects cannot."""
    return {
        "target": target,
        "timestamp": timestamp,
        "tool": TOOL,
        "version": VERSION,
        "detection": {"confidence": detection.get("confidence"), "label": "PARTIAL", "original_label": detection.get("label"), "git_url": detection.get("git_url"), "exposure_type": "metadata_only"},
        "map": {"metadata_accessible": True, "objects_accessible": False, "blob_sha1s_found": mapped.get("blob_sha1s", 0), "branches": mapped.get("branches", []), "remote_urls": mapped.get("remote_urls", [])},
        "result": {"blobs_scanned": 0, "findings": [], "severity_counts": dict.fromkeys(SEVERITIES, 0), "note": PARTIAL},
    }


OUTCOME = ("target", "target_type", "status", "report_path", "findings_count", "risk_score", "error_code", "error")


def aggregate_lines(outcomes: DataFrame) -> DataFrame:
    """(seq, value) a JSON object for each target's outcome, for a report in the order of the input (seq)."""
    return outcomes.select("seq", F.to_json(F.struct(*OUTCOME), {"ignoreNullFields": "false"}).alias("value"))


def write_aggregate(outcomes: DataFrame, path: str, total_targets: int, timestamp: str, fanout: dict | None = None) -> None:
    """One file with the outcomes (seq, target, ...) of all targets in the order of the input."""
    head = {"tool": TOOL, "version": VERSION, "timestamp": timestamp, "total_targets": total_targets, "scanned_targets": outcomes.count()} | ({"target_fanout": fanout} if fanout else {})
    with _private(path) as out:
        out.write(json.dumps(head)[:-1] + ', "results": [')
        _rows(out, aggregate_lines(outcomes).orderBy("seq").select("value"), ",")
        out.write("]}")


def write_json(document: dict, path: str) -> None:
    with _private(path) as out:
        json.dump(document, out, indent=2, ensure_ascii=False)


def write_report(findings: DataFrame, path: str, format: str = "ndjson", target: str = "", envelope: dict | None = None, scan: dict | None = None) -> None:
    """One file on the driver for people to read, gravest first, readable by its owner only.

    Rows come one partition at a time. A JSON report takes its ``envelope`` (see ``exposure_envelope``);
    a CSV has its telemetry in a second file, ``path``.meta.json. For reports of any size write the
    lines' table itself with ``write.text``.
    """
    ordered = findings.orderBy(severity_rank(F.col("severity")), "filename", "line", "pattern_id", "match")
    said = {} if format in ("json", "sarif") else telemetry(findings.count(), scan)
    record = json.dumps({f"_{TOOL}": {"record_type": "metadata", "telemetry": said}}, ensure_ascii=False)
    with _private(path) as out:
        if format == "sarif":
            rules = ",".join(r["value"] for r in sarif_rule_lines(findings).toLocalIterator())
            out.write('{"version":"2.1.0","runs":[{"tool":{"driver":{"name":"' + TOOL + '","rules":[' + rules + ']}},"results":[')
            _rows(out, sarif_results(ordered), ",")
            out.write("]}]}")
        elif format == "json":
            head = envelope or {"tool": TOOL, "version": VERSION, "target": target, "result": _result(findings, scan, True)}
            # the findings are the last key of the result, which is the last key of the report
            out.write(json.dumps(head, ensure_ascii=False)[:-2] + ', "findings": [')
            _rows(out, ndjson_lines(ordered), ",")
            out.write("]}}")
        elif format == "ndjson":
            out.write(record + "\n")
            _rows(out, ndjson_lines(ordered), "\n")
            out.write("\n")
        elif format == "csv":
            out.write(CSV_HEAD + "\n")
            _rows(out, csv_lines(ordered), "\n")
            out.write("\n")
        elif format == "markdown":
            out.write(f"# {TOOL} report\n\n**Target:** {_plain_markdown(target)}\n\n## Scan metadata\n\n| Metric | Value |\n|--------|-------|\n")
            out.write(f"| Scan telemetry | `{_plain_markdown(json.dumps(said, ensure_ascii=False))}` |\n\n| Severity | Type | File | Line | AI | Match |\n|----------|------|------|------|----|-------|\n")
            _rows(out, markdown_lines(ordered), "\n")
            out.write("\n")
        elif format == "html":
            out.write(f'<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>{TOOL} report</title></head><body>\n<h1>{TOOL} report</h1>\n<p><strong>Target:</strong> {_plain_html(target)}</p>\n')
            out.write(f"<section><h2>Scan metadata</h2><pre>{_plain_html(json.dumps(said, indent=2, ensure_ascii=False))}</pre></section>\n<table><thead><tr><th>Severity</th><th>Type</th><th>File</th><th>Line</th><th>AI</th><th>Match</th></tr></thead>\n<tbody>")
            _rows(out, html_lines(ordered), "\n")
            out.write("</tbody></table>\n</body></html>\n")
        else:
            raise ValueError(f"unknown format {format!r}")
    if format == "csv":
        write_json(json.loads(record), f"{path}.meta.json")


def _plain_markdown(x: str) -> str:
    return "".join({"|": "\\|", "`": "\\`", "[": "\\[", "]": "\\]", "\\": "\\\\", "\n": " ", "\r": " "}.get(c, c) for c in x)


def _plain_html(x: str) -> str:
    return "".join({"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#39;", "=": "&#61;"}.get(c, c) for c in x)


def _private(path: str):
    """A file that only its owner may read."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    handle = os.open(path, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600)
    os.fchmod(handle, 0o600)
    return os.fdopen(handle, "w", encoding="utf-8")


def _rows(out, lines: DataFrame, between: str) -> None:
    for n, row in enumerate(lines.toLocalIterator()):
        out.write((between if n else "") + row["value"])


def terminal_lines(findings: DataFrame, width: int = 40) -> list[str]:
    """The summary that a terminal shows: a bar for each severity, the score and its label."""
    r = result_summary(findings).first()
    most = max(1, *(r["severity_counts"][s] for s in SEVERITIES))
    bars = [f"{s:<9}{'#' * -(-width * r['severity_counts'][s] // most):<{width}} {r['severity_counts'][s]}" for s in SEVERITIES]
    return [f"Findings {r['secrets_total']}, about AI tools {r['ai_findings_total']}", *bars, f"Risk {r['risk_score']}/100 {r['risk_label']}"]


def saved_paths(objects: DataFrame, paths: DataFrame) -> DataFrame:
    """(sha1, path, link_of): where the objects of a repository are saved.

    Of an object's safe paths (sha1, paths) the first is its file and the others link to it; one without
    a safe path lies at _unreferenced/xx/rest.
    """
    safe = F.filter(F.coalesce("paths", F.array().cast("array<string>")), lambda p: strict_path(p).isNotNull())
    lone = F.concat(F.lit("_unreferenced/"), F.left("sha1", F.lit(2)), F.lit("/"), F.substring("sha1", 3, 64))
    rows = objects.select("sha1").distinct().join(paths, "sha1", "left").withColumn("all", safe).withColumn("all", F.when(F.size("all") > 0, F.col("all")).otherwise(F.array(lone)))
    return rows.select("sha1", F.posexplode("all").alias("n", "path"), F.col("all")[0].alias("first")).select("sha1", "path", F.when(F.col("n") > 0, F.col("first")).alias("link_of"))


def save_sources(objects: DataFrame, places: DataFrame, root: str) -> tuple[int, int]:
    """Writes objects (sha1, content) to their places under a folder of the driver, one partition at a time; (saved, failed)."""
    saved = failed = 0
    files = places.filter("link_of IS NULL").join(objects, "sha1").select("path", "content")
    for kind, rows in (("file", files), ("link", places.filter("link_of IS NOT NULL").select("path", "link_of"))):
        for row in rows.toLocalIterator():
            at = Path(root, row["path"])
            try:
                at.parent.mkdir(parents=True, exist_ok=True)
                if kind == "file":
                    at.write_bytes(bytes(row["content"]))
                elif not at.exists():
                    os.link(Path(root, row["link_of"]), at)
                saved += 1
            except OSError:
                failed += 1
    return saved, failed
