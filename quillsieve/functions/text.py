"""Text rules as column expressions: lines, entropy, placeholders, context, escapes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillsieve.patterns import CONTEXT_KEYWORDS, PLACEHOLDERS

# Severities from the gravest, and what each is lowered to.
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
LOWERED = (("CRITICAL", "HIGH"), ("HIGH", "MEDIUM"), ("MEDIUM", "LOW"))
# Comment markers that lower confidence.
COMMENT_MARKS = ("# ", "// ", "/* ", "-- ", "; ", "REM ")


def lines_of(text: Column) -> Column:
    """The lines of a text: parted at newlines, one carriage return off each end, no empty last line."""
    parts = F.split(text, "\n", -1)
    kept = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.transform(kept, lambda x: F.when(F.endswith(x, F.lit("\r")), F.left(x, F.length(x) - 1)).otherwise(x))


def let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it is named there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, merge, zero: Column, depth: int = 2, width: int = 32) -> Column:
    """Of each element the fold of all before it, in nearly linear time: folds of blocks, then folds within a block."""
    if not depth:
        return let(values, lambda all_: F.transform(all_, lambda _, i: F.aggregate(F.slice(all_, F.lit(1), i), zero, lambda a, x: merge(a, x))))

    def parted(blocks):
        firsts = running(F.transform(blocks, lambda b: F.aggregate(b, zero, lambda a, x: merge(a, x))), merge, zero, depth - 1, width)
        within = lambda b, first: F.transform(b, lambda _, i: merge(first, F.aggregate(F.slice(b, F.lit(1), i), zero, lambda a, x: merge(a, x))))
        return let(firsts, lambda at: F.flatten(F.transform(blocks, lambda b, k: within(b, F.get(at, k)))))

    cut = lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / width).cast("int")), lambda k: F.slice(all_, F.greatest(k, F.lit(0)) * width + 1, F.lit(width)))
    return F.when(F.size(values) == 0, values).otherwise(let(let(values, cut), parted))


def pieces_of(text: Column, width: int = 4096) -> Column:
    """A text in pieces of so many code points, for ``cut_out``."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{width}}}"), F.lit(0))


def cut_out(pieces: Column, start: Column, end: Column, width: int = 4096) -> Column:
    """The code points from ``start`` to ``end`` (exclusive), without a walk over all that stands before them."""
    first = F.floor(start / width).cast("int")
    near = F.array_join(F.slice(pieces, first + 1, F.floor(end / width).cast("int") - first + 1), "")
    return F.substring(near, (start - first * width + 1).cast("int"), (end - start).cast("int"))


def any_of(words) -> str:
    """A regex for any of some literal words."""
    return "|".join(re.sub(r"([^\w\s])", r"\\\1", w) for w in words)


def java_regex(pattern: str) -> str:
    """A pattern of the Unicode-aware linear-time dialect in Java's: classes, line ends, case folding and final anchors."""
    folded = pattern.startswith("(?i)")
    rest = pattern[4:] if folded else pattern
    rest = re.sub(r"(?<!\\)\$(?=$|\))", r"\\z", rest)
    return ("(?iuUd)" if folded else "(?Ud)") + rest


def entropy(text: Column) -> Column:
    """Shannon entropy of a text's bytes in bits; 0 below four bytes."""

    def bits(value):
        size = F.octet_length(value)
        hexed = F.hex(F.encode(value, "UTF-8"))
        codes = F.regexp_extract_all(hexed, F.lit(".."), F.lit(0))
        shares = let(codes, lambda all_: F.transform(F.array_distinct(all_), lambda c: F.size(F.filter(all_, lambda x: x == c)).cast("double") / F.size(all_)))
        return F.when(size >= 4, F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p))).otherwise(0.0)

    return let(text, bits)


def contains_any(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def is_placeholder(value: Column) -> Column:
    return value.rlike(any_of(PLACEHOLDERS))


def window_of(lines: Column, at: Column, radius: int) -> Column:
    """The lines up to ``radius`` around the zero-based line ``at``."""
    first = F.greatest(at - radius, F.lit(0))
    return F.slice(lines, first + 1, F.least(at + radius + 1, F.size(lines)) - first)


def context_text(lines: Column, at: Column) -> Column:
    return F.array_join(F.transform(window_of(lines, at, 2), trim), " | ")


def trim(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+\z", "")


def confidence(window: Column, extra: tuple[str, ...] = ()) -> Column:
    """Why a finding is less sure, from the text around it; null if it is not."""
    words = F.split(F.lit("\x01".join((*CONTEXT_KEYWORDS, *extra))), "\x01")

    def weigh(w):
        found = let(F.lower(w), lambda low: F.filter(words, lambda k: F.contains(low, F.lower(k))))
        note = w.rlike(any_of(COMMENT_MARKS))

        def worded(f):
            one = F.concat(F.lit("possible placeholder: '"), F.get(f, F.lit(0)), F.when(note, "' + comment").otherwise("' found nearby"))
            two = F.when(note, "likely placeholder: 2+ keywords + comment").otherwise("likely placeholder: 2+ keywords found")
            return F.when(F.size(f) >= 2, two).when(F.size(f) == 1, one).when(note, "context: comment only (reduced confidence)")

        return let(found, worded)

    return let(window, weigh)


def lowered(severity: Column) -> Column:
    out = severity
    for high, low in reversed(LOWERED):
        out = F.when(severity == high, low).otherwise(out)
    return out


def severity_rank(severity: Column) -> Column:
    out = F.lit(99)
    for i, s in enumerate(SEVERITIES):
        out = F.when(severity == s, i).otherwise(out)
    return out


def line_number(text: Column, offset: Column) -> Column:
    """Line number reported for a match that starts at a code-point offset: one more than the lines before it."""
    before = F.left(text, offset.cast("int"))
    breaks = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))
    return (breaks + F.when((F.length(before) > 0) & ~F.endswith(before, F.lit("\n")), 1).otherwise(0) + 1).cast("int")


def is_code_asset(value: Column) -> Column:
    low = F.lower(value)
    place = F.contains(low, F.lit("/static/")) | F.contains(low, F.lit("/chunks/")) | F.startswith(low, F.lit("static/")) | F.startswith(low, F.lit("assets/"))
    return low.rlike(r"\.(cjs|css|jsx?|map|mjs|tsx?)\z") & low.rlike(r"[/\\]") & place


def is_secret_key(key: Column) -> Column:
    """Whether a YAML key names a secret."""
    low = F.lower(F.replace(key, F.lit("-"), F.lit("_")))
    # Parts of key names.
    words = F.array(*[F.lit(w) for w in ("api", "auth", "credential", "credentials", "encryption", "pass", "passwd", "password", "private", "secret", "token")])
    parts = F.split(low, "_")
    return F.arrays_overlap(parts, words) | (F.element_at(parts, -1) == "key") | low.rlike(r"^(api|access|private|secret|encryption).*key\z")


def html_escape(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"), ("=", "&#61;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def markdown_escape(x: Column) -> Column:
    for a, b in (("\\", "\\\\"), ("|", "\\|"), ("`", "\\`"), ("[", "\\["), ("]", "\\]"), ("\n", " "), ("\r", " ")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def csv_cell(x: Column) -> Column:
    """A quoted cell; one that a spreadsheet would read as a formula gets an apostrophe."""
    cut = trim(x)
    safe = F.when(cut.rlike(r"^[=+@-]"), F.concat(F.lit("'"), cut)).otherwise(cut)
    return F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))


def sarif_level(severity: Column) -> Column:
    return F.when(severity.isin("CRITICAL", "HIGH"), "error").when(severity == "MEDIUM", "warning").otherwise("note")


def size_text(size: Column, digits: tuple[int, int, int] = (1, 1, 2)) -> Column:
    """Bytes in a unit of 1024 powers with so many digits for KB, MB and GB; (2, 2, 2) is the cache's form."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for power, (unit, n) in enumerate(zip(("KB", "MB", "GB"), digits), 1):
        out = F.when(size >= 1024**power, F.concat(_fixed(size / 1024**power, n), F.lit(f" {unit}"))).otherwise(out)
    return out


def _fixed(x: Column, digits: int) -> Column:
    return F.round(x, digits).cast(f"decimal(20,{digits})").cast("string")


def git_sha1(kind: Column, content: Column) -> Column:
    """SHA-1 of an object: its kind, length and content."""
    head = F.encode(F.concat(kind, F.lit(" "), F.octet_length(content).cast("string")), "UTF-8")
    return F.sha1(F.concat(head, F.lit(bytearray(b"\x00")), content))


def error_metadata(message: Column) -> Column:
    """struct<code, stage, http_status, retryable> of an error message.

    The status is the first whole number after a word "http"; capability and authentication words
    outrank it.
    """
    low = F.lower(message)
    named = F.regexp_extract(low, r"(?<!\S)http\s+\+?0*([0-9]{1,5})(?!\S)", 1)
    status = F.when((named != "") & (named.cast("int") <= 65535), named.cast("int"))
    capability = contains_any(low, ("unsupported capability", "not available for this provider"))
    identity = contains_any(low, ("authentication", "invalid or expired", "access denied")) | F.coalesce(status.isin(401, 403), F.lit(False))
    code = F.when(capability, "unsupported_capability").when(identity, "authentication_failed").otherwise("scan_failed")
    stage = F.when(capability, "capability").when(identity, "authentication").when(status.isNotNull(), "transport").otherwise("scan")
    retry = F.coalesce(status.isin(408, 425, 429) | status.between(500, 599), F.lit(False))
    return F.struct(code.alias("code"), stage.alias("stage"), status.alias("http_status"), retry.alias("retryable"))
