"""Detectors over whole texts and over neighbouring lines: keys, JSON, YAML, heredocs, framework settings, URLs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsieve.functions import text as X
from quillsieve.operators.hits import around, findings, hit, prepared
from quillsieve.policy import ScanPolicy


@dataclass(frozen=True)
class Block:
    """A whole-text detector; ``value`` is the group reported, ``description`` and ``context`` may name groups as {1}."""

    pattern_id: str
    severity: str
    regex: str
    value: int
    description: str
    context: str
    least_entropy: float = 0.0
    adjust: bool = True
    drop_placeholders: bool = True
    config_gate: bool = False
    match: str = ""


# Regexes, severities and wordings of the whole-text detectors, in the order of their findings.
BLOCKS = (
    Block("pem_key_multiline", "CRITICAL", r"(?s)-----BEGIN (RSA |EC |DSA |OPENSSH |)?PRIVATE KEY-----[a-zA-Z0-9+/=\n]+-----END (RSA |EC |DSA |OPENSSH |)?PRIVATE KEY-----", 0, "PEM Private Key ({1})", "multi-line PEM block ({lines} lines)", adjust=False),
    Block("json_nested_secret", "HIGH", r'(?si)"([a-z_]+)":\s*\{[^}]*"(password|passwd|secret|api_key|access_token|private_key|client_secret)"\s*:\s*"([^"]{8,})"[^}]*\}', 3, "JSON nested secret: {1}.{2}", "nested JSON (parent: {1})"),
    Block("yaml_block_scalar_secret", "HIGH", r"(?i)([a-z_][a-z0-9_]*)\s*:\s*\|[\n\r]+([^\n\r]*?(?:akia|aws_|secret|password|token|key|credential)[^\n\r]*)", 2, "YAML block scalar: {1}", "YAML block scalar (|) {1}", least_entropy=2.5),
    Block("python_multiline_secret", "HIGH", r"""(?im)^[A-Z_]*(?:PASSWORD|SECRET|KEY|TOKEN)[A-Z_]*\s*=\s*['"]{3}[^'"\n]{8,}['"]{3}""", 0, "Python multi-line config secret", "Python triple-quoted multi-line value"),
    Block("ruby_heredoc_secret", "HIGH", r"""(?im)^([A-Z_]*(?:PASSWORD|SECRET|KEY|TOKEN)[A-Z_]*)\s*=\s*<<(?:[-~])['"]?([A-Z]+)['"]?\n\s+([^\n]{8,})""", 3, "Ruby heredoc: {1}", "Ruby heredoc multi-line ({1})"),
    Block("php_multiline_secret", "HIGH", r"""(?im)['"]([A-Z_]*_(?:PASSWORD|SECRET|KEY|TOKEN)(?:_[A-Z_]+)?)['"]\s*=>\s*['"]([^'\n]{8,})['"]""", 2, "PHP config: {1}", "PHP array config ({1})"),
    Block("django_db_password", "HIGH", r"(?si)'PASSWORD'\s*:\s*'([^']{6,})'", 1, "Django/Python database password", "DB config block", config_gate=True),
    Block("django_secret_key", "CRITICAL", r"""(?i)SECRET_KEY\s*=\s*['"]([^'"]{20,})['"]""", 1, "Django/Flask SECRET_KEY detected", "Django settings", least_entropy=2.5, config_gate=True),
    Block("django_env_secret_key", "HIGH", r"""(?i)SECRET_KEY\s*=\s*os\.environ(?:\.get)?\s*\(\s*['"]([^'"\s]+)['"]\s*\)""", 1, "Django SECRET_KEY from environment variable: {1}", "os.environ reference", adjust=False, drop_placeholders=False, config_gate=True, match="{1}"),
    Block("ruby_database_url", "HIGH", r"""(?i)DATABASE_URL\s*[=:]\s*['"]?([a-z]+://[^'"\s]{10,})['"]?""", 1, "Ruby/Rails DATABASE_URL connection string", "Ruby database config", config_gate=True),
    Block("ruby_config_password", "HIGH", r"""(?i)[a-z_]+\s*:\s*\{[^}]*password:\s*['"]([^'"\s]{4,})['"]""", 1, "Ruby config hash password field", "Ruby hash config", config_gate=True),
    Block("php_laravel_app_key", "CRITICAL", r"(?i)APP_KEY\s*=\s*base64:\s*([A-Za-z0-9+/=]{32,})", 1, "PHP Laravel APP_KEY", "Laravel .env/config", least_entropy=2.5, config_gate=True),
    Block("php_db_config", "HIGH", r"""(?i)DB_[A-Z_]+\s*=\s*['"]([^'"\s]{6,})['"]""", 1, "PHP DB_* configuration value", "PHP database config", least_entropy=2.0, config_gate=True),
    Block("go_config_password_struct", "MEDIUM", r"(?s)type\s+([A-Z]\w+)\s+struct\s*\{[^}]*Password\s+string[^}]*\}", 1, "Go config struct '{1}' with Password field", "Go struct definition", adjust=False, drop_placeholders=False, config_gate=True, match="{1} struct contains Password field"),
    Block("db_url_password", "HIGH", r"(?i)(postgres|mysql|mongodb|redis|amqp)://[^:]+:([^@]+)@", 2, "Database connection string with password", "DB connection URL", config_gate=True),
)
# A text holds one of these if a settings detector can match, and words that a YAML block must hold.
CONFIG_MARKS = ("PASSWORD", "SECRET_KEY", "DATABASE_URL", "password", "APP_KEY", "DB_", "Password", "://")
YAML_WORDS = ("akia", "aws_", "secret", "password", "token", "credential", "access_key", "api_key")
#: What a match of each detector must hold, in lower case; tried before its regex.
MARKS = {
    "pem_key_multiline": ("private key-----",),
    "json_nested_secret": ('":',),
    "yaml_block_scalar_secret": ("|",),
    "python_multiline_secret": ("'''", '"""', "''\"", "'\"'", "\"''", "'\"\"", "\"'\"", "\"\"'"),
    "ruby_heredoc_secret": ("<<-", "<<~"),
    "php_multiline_secret": ("=>",),
    "django_db_password": ("'password'",),
    "django_secret_key": ("ecret_",),
    "django_env_secret_key": (".environ",),
    "ruby_database_url": ("database_url",),
    "ruby_config_password": ("word:",),
    "php_laravel_app_key": ("base64:",),
    "php_db_config": ("db_",),
    "go_config_password_struct": ("password",),
    "db_url_password": ("://",),
}


def _java(pattern: str) -> tuple[str, str]:
    """Inline flags and body for Java, the anchors ^ of multi-line patterns kept."""
    flags = ""
    if pattern.startswith("(?"):
        flags, pattern = pattern[2 : pattern.index(")")], pattern[pattern.index(")") + 1 :]
    return flags.replace("i", "iu") + "Ud", pattern


def spans_of(text: Column, pattern: str, groups: int) -> Column:
    """array<struct<gap, g0, g1, ...>>: each match with the text since the one before."""
    flags, body = _java(pattern)
    whole = F.lit(rf"(?{flags})\G((?s:.*?))({body})")
    names = ["gap"] + [f"g{i}" for i in range(groups + 1)]
    return F.arrays_zip(*[F.regexp_extract_all(text, whole, F.lit(i + 1)).alias(n) for i, n in enumerate(names)])


def _worded(template: str, m: Column) -> Column:
    parts, rest = [], template
    while "{" in rest:
        before, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        parts += [F.lit(before)] if before else []
        parts.append(F.size(X.lines_of(m["g0"])).cast("string") if name == "lines" else m[f"g{name}"])
    return F.concat(*parts, F.lit(rest)) if parts else F.lit(rest)


def with_block_hits(rows: DataFrame, policy: ScanPolicy, blocks: tuple[Block, ...] = BLOCKS) -> DataFrame:
    """Adds the array ``block_hits`` of the whole-text detectors to prepared texts."""
    marked = rows.withColumn("config", F.col("text").rlike(X.any_of(CONFIG_MARKS)))
    arrays = []
    for rank, block in enumerate(blocks):
        gate = F.col("low").rlike(X.any_of(MARKS[block.pattern_id]))
        if block.config_gate:
            gate = F.col("config") & gate
        if block.pattern_id == "php_multiline_secret":
            path = F.lower("filename")
            gate = gate & ~path.rlike(r"/data/.*paginators-1\.json\.php\z|descriptor_config\.php")
        arrays.append(F.when(gate, _block_hits(rank, block, policy)))
    return marked.withColumn("block_hits", F.flatten(F.array_compact(F.array(*arrays)))).drop("config")


def _block_hits(rank: int, block: Block, policy: ScanPolicy) -> Column:
    groups = max(block.value, 1 if "{1}" in block.description + block.context + block.match else 0, 2 if "{2}" in block.description else 0)
    value = lambda m: m[f"g{block.value}"]

    def wanted(m):
        ok = F.lit(True)
        if block.drop_placeholders and not policy.exhaustive:
            ok = ~X.is_placeholder(value(m))
        measured = value(m)
        if block.pattern_id == "yaml_block_scalar_secret":
            measured = X.trim(F.regexp_replace(measured, r"(?s)\A[^:]*:", ""))
            ok = ok & F.lower(value(m)).rlike(X.any_of(YAML_WORDS))
        return ok & (X.entropy(measured) >= block.least_entropy) if block.least_entropy else ok

    def made(m):
        return hit(
            detector=F.lit("block"), rank=F.lit(rank), line=m["line"], pattern_id=F.lit(block.pattern_id), description=_worded(block.description, m), severity=F.lit(block.severity),
            match=_worded(block.match, m) if block.match else F.left(value(m), F.lit(100)), context=_worded(block.context, m), around=around(F.col("lines"), m["line"] - 1) if block.adjust else F.lit(None),
        )

    return F.transform(F.filter(_placed(spans_of(F.col("text"), block.regex, groups), groups), wanted), made)


def _placed(spans: Column, groups: int) -> Column:
    """The matches with the ``line`` that each is reported at: one more than the lines before its first character.

    What stands before a match is summed up over the matches before it, not read again.
    """
    names = [f"g{i}" for i in range(groups + 1)]
    breaks = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    ends = lambda x: F.endswith(x, F.lit("\n"))

    def put(all_, before):
        def place(m, i):
            last = F.get(all_, i - 1)["g0"]
            # the character before the match is the gap's last one, or without a gap the last match's
            open_ = F.when(m["gap"] != "", ~ends(m["gap"])).otherwise(F.coalesce(~ends(last), F.lit(False)))
            line = F.get(before, i) + breaks(m["gap"]) + F.when(open_, 1).otherwise(0) + 1
            return F.struct(line.cast("int").alias("line"), *[m[n].alias(n) for n in names])

        return F.transform(all_, place)

    count = lambda all_: X.running(F.transform(all_, lambda m: breaks(m["gap"]) + breaks(m["g0"])), lambda a, x: a + x, F.lit(0))
    return X.let(spans, lambda all_: X.let(count(all_), lambda before: put(all_, before)))


def detect_blocks(df: DataFrame, policy: ScanPolicy = ScanPolicy(), blocks: tuple[Block, ...] = BLOCKS) -> DataFrame:
    """Findings of the whole-text detectors in a table (filename, text, is_deleted, commit_sha1), in one scan of it."""
    return findings(with_block_hits(prepared(df), policy, blocks), [F.col("block_hits")], policy)


# Line shapes of YAML keys.
YAML_SCALAR = r"^\s*([a-z][a-z0-9_]{2,})\s*:\s*(\||>)\s*\z"
YAML_INLINE = r"^\s*([a-z][a-z0-9_]{2,})\s*:\s*[|>]?\s*([A-Za-z0-9+/=]{20,})\s*(?:#.*)?\z"
YAML_ANCHOR = r"^\s*([a-z][a-z0-9_]{2,})\s*:\s*&\s*([a-z_]+)\s*\z"
YAML_KEY = r"^\s*([a-z][a-z0-9_]{2,})\s*:\s*(?:\||>|\s*)?\z"


#: Code points of a block scalar that are kept; so many lines hold them all, as each has one and a space.
SCALAR = 120


def with_yaml_hits(rows: DataFrame, policy: ScanPolicy) -> DataFrame:
    """Adds the array ``yaml_hits``: at YAML keys block scalars, inline values, anchors and values on the next line, the first that fits."""
    one = lambda line, regex, g: F.regexp_extract(line, "(?Ud)" + regex, g)
    shapes = (("scalar", YAML_SCALAR), ("inline", YAML_INLINE), ("anchor", YAML_ANCHOR), ("next", YAML_KEY))

    def shape(line):
        kind = F.lit(None).cast("string")
        for name, regex in reversed(shapes):
            kind = F.when(line.rlike("(?Ud)" + regex), name).otherwise(kind)
        return kind

    numbered = F.transform("lines", lambda line, at: F.struct(line.alias("line"), at.alias("at")))
    keyed = F.filter(F.transform(F.filter(numbered, lambda x: F.contains(x["line"], F.lit(":"))), lambda x: F.struct(x["line"].alias("line"), x["at"].alias("at"), shape(x["line"]).alias("kind"))), lambda x: x["kind"].isNotNull())
    shaped = rows.withColumn("keys", F.when(F.contains("text", F.lit(":")), keyed))
    # Lines that are neither blank nor comments, and how many of them stand before each line: a scalar's lines are a slice of them.
    trimmed = F.transform("lines", X.trim)
    is_solid = lambda x: (x != "") & ~F.startswith(x, F.lit("#"))
    some = F.exists(F.coalesce("keys", F.array().cast("array<struct<line:string,at:int,kind:string>>")), lambda x: x["kind"] == "scalar")
    shaped = shaped.withColumn("solid", F.when(some, F.filter(trimmed, is_solid))).withColumn("before", F.when(some, X.running(F.transform(trimmed, lambda x: F.when(is_solid(x), 1).otherwise(0)), lambda a, x: a + x, F.lit(0))))

    def scalar(x, mark):
        # the scalar's own key line ends with a mark, so it is solid itself
        rest = F.slice("solid", F.get("before", x["at"]) + 2, F.lit(SCALAR // 2 + 1))
        ends = F.filter(F.transform(rest, lambda y, i: F.when(F.endswith(y, F.lit(":")) & ~F.startswith(y, F.lit("-")), i)), lambda i: i.isNotNull())
        body = F.slice(rest, F.lit(1), F.coalesce(F.get(ends, F.lit(0)), F.size(rest)))
        return F.left(F.array_join(F.when(mark == "|", F.slice(body, 1, 1)).otherwise(body), " "), F.lit(SCALAR))

    def read(x):
        line, kind = x["line"], x["kind"]
        key = F.when(kind == "scalar", one(line, YAML_SCALAR, 1)).when(kind == "inline", one(line, YAML_INLINE, 1)).when(kind == "anchor", one(line, YAML_ANCHOR, 1)).otherwise(one(line, YAML_KEY, 1))
        mark = one(line, YAML_SCALAR, 2)
        after = X.trim(F.get("lines", x["at"] + 1))
        value = F.when(kind == "scalar", scalar(x, mark)).when(kind == "inline", one(line, YAML_INLINE, 2)).when(~F.startswith(after, F.lit("#")), after)
        return F.struct(x["at"].alias("at"), kind.alias("kind"), key.alias("key"), mark.alias("mark"), one(line, YAML_ANCHOR, 2).alias("anchor"), value.alias("value"))

    def wanted(x):
        ok = (F.octet_length(x["value"]) >= 8) & (X.entropy(x["value"]) >= 2.5)
        return ok if policy.exhaustive else ok & X.is_secret_key(x["key"]) & ~X.is_placeholder(x["value"])

    def made(x):
        k, key, value, anchor = x["kind"], x["key"], x["value"], x["anchor"]
        short = F.left(value, F.lit(80))
        pick = lambda a, b, c, d: F.when(k == "scalar", a).when(k == "inline", b).when(k == "anchor", c).otherwise(d)
        return hit(
            detector=F.lit("yaml"), rank=F.lit(0), line=x["at"] + 1, severity=F.lit("HIGH"), match=value, around=around(F.col("lines"), x["at"]),
            pattern_id=pick(F.lit("yaml_block_scalar_secret"), F.lit("yaml_inline_secret"), F.lit("yaml_anchor_secret"), F.lit("yaml_nextline_secret")),
            description=pick(F.format_string("YAML block scalar secret (key: %s)", key), F.format_string("YAML inline secret (key: %s)", key), F.format_string("YAML anchor secret (key: %s, anchor: &%s)", key, anchor), F.format_string("YAML next-line secret (key: %s)", key)),
            context=pick(F.concat(key, F.lit(": "), x["mark"], F.lit(" | "), value), F.concat(key, F.lit(": "), short), F.concat(key, F.lit(": &"), anchor, F.lit(" -> "), value), F.concat(key, F.lit(": | "), short)),
        )

    return shaped.withColumn("yaml_hits", F.transform(F.filter(F.transform("keys", read), wanted), made)).drop("keys", "solid", "before")


def detect_yaml(df: DataFrame, policy: ScanPolicy = ScanPolicy()) -> DataFrame:
    """Findings at YAML keys; see ``with_yaml_hits``."""
    return findings(with_yaml_hits(prepared(df), policy), [F.col("yaml_hits")], policy)
