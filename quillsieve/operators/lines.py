"""Line detectors: registered and custom patterns, entropy, segments of minified lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsieve.functions import text as X
from quillsieve.functions.gates import lowered, may_match, pattern_table
from quillsieve.operators.hits import around, findings, hit, prepared
from quillsieve.patterns import ENTROPY_VALUE, ENTROPY_WORD, ENTROPY_WORDS, LINE_PATTERNS
from quillsieve.policy import ScanPolicy

def pattern_matches(rows: str, active: str) -> Column:
    """All matches of the patterns in the array ``active`` in rows (at, line, low).

    One pattern after another, so each regex is compiled once for a text, and only on the rows that hold its literals.
    """

    def of(p):
        tried = F.filter(rows, lambda r: may_match(p, r["line"], r["low"]))
        one = lambda r, m: F.struct(r["at"].alias("at"), r["line"].alias("line"), p["rank"].alias("rank"), p["id"].alias("pattern_id"), p["description"].alias("description"), p["severity"].alias("severity"), m.alias("match"))
        return F.flatten(F.transform(tried, lambda r: F.transform(F.regexp_extract_all(r["line"], p["regex"], F.lit(0)), lambda m: one(r, m))))

    return F.flatten(F.transform(active, of))


def numbered_lines(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the zero-based ``at`` and ``line`` of each line; texts without lines give no row."""
    return df.select("*", F.posexplode(X.lines_of(F.col(text_col))).alias("at", "line"))


def with_line_hits(rows: DataFrame, policy: ScanPolicy, custom: tuple[tuple[str, str, str, str], ...] = ()) -> DataFrame:
    """Adds the array ``line_hits`` to prepared texts.

    A text is searched once for each pattern's literals; only the patterns that may match go on to its
    lines, and lines are looked at only where one may. Entropy counts on lines without a kept match.
    """
    own = [*LINE_PATTERNS, *custom]
    text, low = F.col("text"), F.col("low")
    marked = rows.withColumn("active", F.filter(pattern_table(own, X.java_regex), lambda p: may_match(p, text, low)))
    marked = marked.withColumn("quoted", (F.contains(text, F.lit("'")) | F.contains(text, F.lit('"'))) & X.contains_any(low, ENTROPY_WORDS))
    short = F.filter(F.transform("lines", lambda line, at: F.struct(at.alias("at"), line.alias("line"), lowered(line).alias("low"))), lambda r: F.octet_length(r["line"]) <= policy.max_line_bytes)
    cut = marked.withColumn("short", F.when(F.col("quoted") | (F.size("active") > 0), short))
    tried = cut.withColumn("matches", pattern_matches("short", "active"))
    if not policy.exhaustive:
        tried = tried.withColumn("matches", F.filter("matches", lambda m: ~X.is_placeholder(m["match"])))

    def dense(at):
        line = F.get("lines", at)
        scored = F.transform(F.regexp_extract_all(line, F.lit(ENTROPY_VALUE), F.lit(1)), lambda v: F.struct(v.alias("match"), X.entropy(v).alias("bits")))
        kept = F.filter(scored, lambda s: s["bits"] >= policy.entropy_threshold)
        if not policy.exhaustive:
            kept = F.filter(kept, lambda s: ~X.is_placeholder(s["match"]) & ~X.is_code_asset(s["match"]))
        return F.transform(kept, lambda s: F.struct(at.alias("at"), line.alias("line"), F.lit(len(own)).alias("rank"), F.lit("high_entropy_secret").alias("pattern_id"), F.format_string("High-entropy secret (%.2f bits/char)", s["bits"]).alias("description"), F.lit("HIGH").alias("severity"), s["match"].alias("match")))

    worded = F.filter("short", lambda r: r["line"].rlike("['\"]") & r["line"].rlike(X.java_regex(ENTROPY_WORD)))
    alone = F.array_except(F.transform(worded, lambda r: r["at"]), F.transform("matches", lambda m: m["at"]))
    found = tried.withColumn("alone", F.when(F.col("quoted"), alone)).withColumn("found", F.concat("matches", F.flatten(F.transform(F.coalesce("alone", F.array().cast("array<int>")), dense))))
    made = lambda m: hit(detector=F.lit("line"), rank=m["rank"], line=m["at"] + 1, pattern_id=m["pattern_id"], description=m["description"], severity=m["severity"], match=m["match"], context=X.context_text(F.col("lines"), m["at"]), around=around(F.col("lines"), m["at"]))
    return found.withColumn("line_hits", F.transform("found", made)).drop("active", "quoted", "short", "matches", "alone", "found")


def with_segment_hits(rows: DataFrame, policy: ScanPolicy) -> DataFrame:
    """Adds the array ``segment_hits`` to prepared texts: hits in the segments of minified lines of JavaScript-family files.

    Placeholders are always dropped. Of a line the first 200 segments count.
    """
    script = F.substring_index("filename", ".", -1).isin("js", "ts", "jsx", "tsx", "mjs", "cjs")
    long_ = F.filter(F.transform("lines", lambda line, at: F.struct(at.alias("at"), line.alias("line"))), lambda r: F.octet_length(r["line"]).between(policy.max_line_bytes + 1, policy.max_minified_bytes))
    parts = lambda r: F.transform(F.slice(F.split(r["line"], "[;{},]", -1), 1, 200), lambda s: X.let(X.trim(s), lambda x: F.struct(r["at"].alias("at"), x.alias("line"), lowered(x).alias("low"))))
    cut = rows.withColumn("segments", F.when(script, F.filter(F.flatten(F.transform(long_, parts)), lambda s: F.octet_length(s["line"]).between(10, 2000))))
    cut = cut.withColumn("active", F.when(F.size("segments") > 0, F.filter(pattern_table(LINE_PATTERNS, X.java_regex), lambda p: may_match(p, F.col("text"), F.col("low")))))
    tried = cut.withColumn("matches", F.filter(pattern_matches("segments", "active"), lambda m: ~X.is_placeholder(m["match"])))

    def made(m):
        # what the lines around say replaces what the segment says; each lowers the severity
        lower = lambda w: F.when(w.isNotNull(), X.lowered(m["severity"])).otherwise(m["severity"])
        one = lambda w: hit(detector=F.lit("segment"), rank=m["rank"], line=m["at"] + 1, pattern_id=m["pattern_id"], description=m["description"], severity=lower(w), match=m["match"], context=F.concat(F.lit("[minified] "), F.left(m["line"], F.lit(200))), around=around(F.col("lines"), m["at"]), note=F.concat(F.lit("[minified] "), w))
        return X.let(X.confidence(m["line"], policy.keywords), one)

    return tried.withColumn("segment_hits", F.transform("matches", made)).drop("segments", "active", "matches")


def detect_lines(df: DataFrame, policy: ScanPolicy = ScanPolicy(), custom: tuple[tuple[str, str, str, str], ...] = ()) -> DataFrame:
    """Findings of the line detectors in a table (filename, text, is_deleted, commit_sha1).

    Lines over ``max_line_bytes`` are skipped here (see ``detect_segments``). Entropy findings come only
    from lines without a pattern hit. Null and empty texts have no lines.
    """
    rows = with_line_hits(prepared(df), policy, custom)
    return findings(rows, [F.col("line_hits")], policy)


def detect_segments(df: DataFrame, policy: ScanPolicy = ScanPolicy()) -> DataFrame:
    """Findings in the segments of minified lines of JavaScript-family files; see ``with_segment_hits``."""
    return findings(with_segment_hits(prepared(df), policy), [F.col("segment_hits")], policy)
