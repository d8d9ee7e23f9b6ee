"""The queries of the driver's contract over its tables, and DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsieve.functions import paths as P
from quillsieve.functions import text as X
from quillsieve.operators import lines as L
from quillsieve.operators import outcomes as O
from quillsieve.operators import repository as R
from quillsieve.operators import rollup as U
from quillsieve.operators.blocks import detect_blocks, detect_yaml
from quillsieve.patterns import CONTEXT_KEYWORDS, ENTROPY_WORD, LINE_PATTERNS, PLACEHOLDERS, SENSITIVE_NAME, TECH_NAMES
from quillsieve.plans.scan import as_files, detect_ai_paths
from quillsieve.policy import ScanPolicy

#: The documents' quoted tokens have 3.5 to 3.9 bits a byte.
POLICY = ScanPolicy(entropy_threshold=3.5)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def sql_list(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


# Texts that look like settings, made of hashes of order keys: (Spark expression, the same in DuckDB) by key modulo their number.
CONFIG = (
    "concat('aws = AKIA', upper(substr(md5(k), 1, 16)), ' end')",
    "concat('login', chr(10), 'gh', 'p_', md5(k), substr(md5(k), 1, 4))",
    "concat('password = \"', substr(md5(k), 1, 12), '\"', chr(10), 'ok')",
    "concat('sk_', 'live_', md5(k))",
    "concat('url: postgres://user:', substr(md5(k), 1, 10), '@db/x')",
    "concat('api_key: example_', md5(k))",
    "concat('# remark', chr(10), 'SECRET_KEY = \"', md5(k), '\"')",
    "concat('AIza', md5(k), 'abc')",
    "concat('key-', md5(k), ' and key-', md5(concat(k, 'b')))",
    "concat('a', chr(10), 'b', chr(10), 'xoxb-1234567890-1234567890-', substr(md5(k), 1, 24), chr(10), 'c', chr(10), 'd')",
    "concat('token = \"', upper(substr(md5(k), 1, 8)), md5(concat(k, 'c')), 'xyzQW+/\"')",
    "concat('plain words of ', substr(md5(k), 1, 6), chr(13), chr(10))",
)


def config_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One settings-like text for each order."""
    keyed = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("k"))
    kinds = " ".join(f"WHEN {i} THEN {e.replace('chr(', 'char(')}" for i, e in enumerate(CONFIG))
    return as_files(keyed.withColumn("text", F.expr(f"CASE o_orderkey % {len(CONFIG)} {kinds} END")), F.concat(F.lit("etc/"), "k", F.lit(".conf")))


CONFIG_SQL = f"""files AS (SELECT 'etc/' || k || '.conf' AS filename, CASE o_orderkey % {len(CONFIG)} {" ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(CONFIG))} END AS text
  FROM (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS k FROM orders))"""
DOCUMENTS_SQL = "files AS (SELECT CAST(doc_id AS VARCHAR) AS filename, text FROM documents)"
LINES_SQL = """cut AS (SELECT filename, CASE WHEN ls[len(ls)] = '' THEN ls[1:len(ls)-1] ELSE ls END AS raw FROM (SELECT filename, string_split(text, chr(10)) AS ls FROM files WHERE text IS NOT NULL)),
ln AS (SELECT filename, list_transform(raw, lambda x: CASE WHEN ends_with(x, chr(13)) THEN x[1:-2] ELSE x END) AS lns FROM cut),
line AS (SELECT filename, lns, unnest(range(0, len(lns))) AS pos, unnest(lns) AS line FROM ln)"""


def entropy_sql(value: str) -> str:
    h = f"regexp_extract_all(hex(encode({value})), '..')"
    return f"(CASE WHEN strlen({value}) < 4 THEN 0.0 ELSE list_sum(list_transform(list_distinct({h}), lambda c: -(len(list_filter({h}, lambda y: y = c)) / strlen({value})) * log2(len(list_filter({h}, lambda y: y = c)) / strlen({value})))) END)"


def placeholder_sql(value: str) -> str:
    return f"(len(list_filter({sql_list(PLACEHOLDERS)}, lambda w: contains({value}, w))) > 0)"


def findings_sql(files: str, patterns, threshold: float) -> str:
    """Findings of the line detectors: pattern hits, entropy where a line has none, context and confidence."""
    none = "SELECT filename, lns, pos, line, '' AS pattern_id, '' AS description, '' AS severity, '' AS match FROM short WHERE false"
    hits = "\nUNION ALL\n".join(f"SELECT filename, lns, pos, line, {q(i)} AS pattern_id, {q(d)} AS description, {q(s)} AS severity, unnest(regexp_extract_all(line, {q(r)})) AS match FROM short" for i, s, d, r in patterns) or none
    marks = " OR ".join(f"contains(win, {q(m)})" for m in X.COMMENT_MARKS)
    word = q(ENTROPY_WORD)
    return f"""{files}, {LINES_SQL},
short AS (SELECT * FROM line WHERE strlen(line) <= 2000),
hit AS (SELECT * FROM ({hits}) WHERE NOT {placeholder_sql("match")}),
val AS (SELECT filename, lns, pos, line, unnest(regexp_extract_all(line, '[''"]([A-Za-z0-9+/=_\\-\\.!@#$%^&*]{{20,}})[''"]', 1)) AS match FROM short s
  WHERE regexp_matches(line, {word}) AND NOT EXISTS (SELECT 1 FROM hit h WHERE h.filename = s.filename AND h.pos = s.pos)),
ent AS (SELECT *, {entropy_sql("match")} AS bits FROM val WHERE NOT {placeholder_sql("match")}),
allf AS (SELECT filename, lns, pos, pattern_id, description, severity, match FROM hit
  UNION ALL SELECT filename, lns, pos, 'high_entropy_secret', format('High-entropy secret ({{:.2f}} bits/char)', bits), 'HIGH', match FROM ent WHERE bits >= {threshold}),
win AS (SELECT *, array_to_string(lns[greatest(pos - 2, 1):pos + 4], ' ') AS win FROM allf),
fnd AS (SELECT *, list_filter({sql_list(CONTEXT_KEYWORDS)}, lambda w: contains(lower(win), lower(w))) AS kw, ({marks}) AS note FROM win),
fin AS (SELECT filename, CAST(pos + 1 AS INTEGER) AS line, pattern_id, description, match,
  CASE WHEN len(kw) >= 2 AND note THEN 'likely placeholder: 2+ keywords + comment' WHEN len(kw) >= 2 THEN 'likely placeholder: 2+ keywords found'
    WHEN len(kw) = 1 AND note THEN 'possible placeholder: ''' || kw[1] || ''' + comment' WHEN len(kw) = 1 THEN 'possible placeholder: ''' || kw[1] || ''' found nearby'
    WHEN note THEN 'context: comment only (reduced confidence)' END AS confidence_adjustment, severity AS s0,
  array_to_string(list_transform(lns[greatest(pos - 1, 1):pos + 3], lambda x: trim(x)), ' | ') AS context FROM fnd),
findings AS (SELECT *, CASE WHEN confidence_adjustment IS NULL THEN s0 WHEN s0 = 'CRITICAL' THEN 'HIGH' WHEN s0 = 'HIGH' THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM fin)"""


DOC_FINDINGS = findings_sql(DOCUMENTS_SQL, (), 3.5)
CONFIG_FINDINGS = findings_sql(CONFIG_SQL, LINE_PATTERNS, 3.5)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def named(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return named


def documents(spark, d) -> DataFrame:
    return as_files(table(spark, d, "documents"), F.col("doc_id").cast("string"))


def document_findings(spark, d) -> DataFrame:
    return L.detect_lines(documents(spark, d), POLICY)


def config_findings(spark, d) -> DataFrame:
    return L.detect_lines(config_files(spark, d), POLICY)


SEVERITY_ROWS = "(VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW')) v(severity)"


@query(f"WITH {DOC_FINDINGS} SELECT v.severity, CAST(count(f.match) AS BIGINT) AS n FROM {SEVERITY_ROWS} LEFT JOIN findings f ON f.severity = v.severity GROUP BY v.severity")
def severity_rollup(spark, d):
    return U.severity_counts(document_findings(spark, d))


FINDING_OUT = "filename, line, pattern_id, description, severity, match, context, confidence_adjustment"


@query(f"WITH {DOC_FINDINGS} SELECT {FINDING_OUT} FROM findings")
def entropy_findings(spark, d):
    return document_findings(spark, d).select(*FINDING_OUT.split(", "))


@query(f"WITH {CONFIG_FINDINGS} SELECT {FINDING_OUT} FROM findings")
def pattern_findings(spark, d):
    return config_findings(spark, d).select(*FINDING_OUT.split(", "))


@query(f"WITH {CONFIG_FINDINGS} SELECT v.severity, CAST(count(f.match) AS BIGINT) AS n FROM {SEVERITY_ROWS} LEFT JOIN findings f ON f.severity = v.severity GROUP BY v.severity")
def config_severities(spark, d):
    return U.severity_counts(config_findings(spark, d))


RISK_SQL = """SELECT CAST(least(100, least(60, 20 * count(*) FILTER (severity = 'CRITICAL')) + least(30, 10 * count(*) FILTER (severity = 'HIGH')) + least(15, 5 * count(*) FILTER (severity = 'MEDIUM'))) AS INTEGER) AS risk_score FROM findings"""


@query(f"WITH {DOC_FINDINGS} SELECT risk_score, CASE WHEN risk_score >= 70 THEN 'CRITICAL' WHEN risk_score >= 40 THEN 'HIGH' WHEN risk_score >= 15 THEN 'MEDIUM' ELSE 'CLEAR' END AS risk_label FROM ({RISK_SQL})")
def risk_rollup(spark, d):
    return U.risk(document_findings(spark, d))


@query(f"WITH {CONFIG_FINDINGS} SELECT filename, line, pattern_id, match FROM (SELECT *, row_number() OVER (PARTITION BY pattern_id, match ORDER BY filename, line) AS n FROM findings) WHERE n = 1")
def unique_findings(spark, d):
    return U.unique_findings(config_findings(spark, d)).select("filename", "line", "pattern_id", "match")


SEVERITY_ORDER = "CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 99 END"


@query(f"WITH {CONFIG_FINDINGS} SELECT filename, line, pattern_id, severity, match FROM (SELECT *, row_number() OVER (PARTITION BY pattern_id, left(match, 40) ORDER BY {SEVERITY_ORDER}, filename, line, match) AS n FROM findings) WHERE n = 1")
def shown_findings(spark, d):
    return U.shown_findings(config_findings(spark, d)).select("filename", "line", "pattern_id", "severity", "match")


@query(f"WITH {CONFIG_FINDINGS} SELECT count(*) AS unique_secrets FROM (SELECT DISTINCT pattern_id, match FROM findings)")
def unique_secrets(spark, d):
    return U.unique_secrets(config_findings(spark, d))


@query(f"""WITH {CONFIG_FINDINGS} SELECT pattern_id, CASE max(CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 3 WHEN severity = 'MEDIUM' THEN 2 ELSE 1 END) WHEN 3 THEN 'error' WHEN 2 THEN 'warning' ELSE 'note' END AS level,
arg_min(description, (filename, line, match)) AS description FROM findings GROUP BY pattern_id""")
def sarif_rules(spark, d):
    return U.sarif_rules(config_findings(spark, d))


@query(f"WITH {CONFIG_FINDINGS} SELECT filename, line, pattern_id, match, bool_or(severity = 'CRITICAL') OVER (PARTITION BY filename ORDER BY line, pattern_id, match ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS recent_critical FROM findings")
def recent_critical(spark, d):
    return U.recent_critical(config_findings(spark, d)).select("filename", "line", "pattern_id", "match", "recent_critical")


@query(f"WITH {DOCUMENTS_SQL}, {LINES_SQL} SELECT filename, CAST(pos AS INTEGER) AS pos, line FROM line")
def document_lines(spark, d):
    return L.numbered_lines(documents(spark, d)).select("filename", F.col("at").alias("pos"), "line")


@query(f"WITH {DOCUMENTS_SQL}, {LINES_SQL} SELECT strlen(line) <= 2000 AS scanned, count(*) AS n, CAST(sum(strlen(line)) AS BIGINT) AS bytes FROM line GROUP BY 1")
def line_limits(spark, d):
    rows = L.numbered_lines(documents(spark, d)).select(F.octet_length("line").alias("b"))
    return rows.groupBy((F.col("b") <= 2000).alias("scanned")).agg(F.count("*").alias("n"), F.sum("b").alias("bytes"))


@query(f"SELECT c_custkey, round({entropy_sql('c_name')}, 6) AS name_entropy, round({entropy_sql('md5(c_name)')}, 6) AS hash_entropy FROM customer")
def entropies(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.round(X.entropy(F.col("c_name")), 6).alias("name_entropy"), F.round(X.entropy(F.md5("c_name")), 6).alias("hash_entropy"))


@query(f"SELECT p_partkey, {placeholder_sql('p_name')} AS placeholder FROM part")
def placeholders(spark, d):
    return table(spark, d, "part").select("p_partkey", X.is_placeholder(F.col("p_name")).alias("placeholder"))


# Paths made of part keys, by key modulo their number.
PATHS = ("src/main.rs", ".claude/settings.json", "home/.cursor/chat/history.db", "web/.env", "app/.aider.cache", "deploy/values.yaml", "x/.continue/auth.json", "docker-compose.yml", "lib/module.ts", ".github/prompts/a.md", "keys/id_rsa", "pkg/package.json", "Gemfile", "a/b/../c.tf")
PATH_SPARK = f"concat('d', p_partkey % 7, '/', element_at(array({', '.join(q(p) for p in PATHS)}), cast(p_partkey % {len(PATHS)} as int) + 1))"
PATH_SQL = f"'d' || (p_partkey % 7) || '/' || ({sql_list(PATHS)})[CAST(p_partkey % {len(PATHS)} AS INTEGER) + 1]"


def part_paths(spark, d) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.expr(PATH_SPARK).alias("path"))


AI_SQL = f"CASE WHEN regexp_matches(lower(path), {q(P.AI_SCOPE)}) THEN CASE " + " ".join(f"WHEN regexp_matches(lower(path), {q(r)}) THEN {q(n)}" for n, r, _, _ in P.AI_KINDS[:-1]) + " ELSE 'config' END END"


@query(f"SELECT p_partkey, path, {AI_SQL} AS kind, regexp_matches(path, {q(SENSITIVE_NAME)}) OR ({AI_SQL}) IS NOT NULL AS sensitive FROM (SELECT p_partkey, {PATH_SQL} AS path FROM part)")
def path_kinds(spark, d):
    return part_paths(spark, d).select("p_partkey", "path", P.ai_kind(F.col("path")).alias("kind"), P.is_sensitive(F.col("path")).alias("sensitive"))


@query(f"SELECT path AS filename, 'ai_path_' || kind AS pattern_id, CASE kind WHEN 'credential' THEN 'HIGH' WHEN 'state' THEN 'LOW' ELSE 'MEDIUM' END AS severity, 'ai_path_category=' || kind || '_path' AS context FROM (SELECT path, {AI_SQL} AS kind FROM (SELECT {PATH_SQL} AS path FROM part)) WHERE kind IS NOT NULL")
def ai_path_findings(spark, d):
    files = as_files(part_paths(spark, d).withColumn("text", F.lit("")), F.col("path"))
    return detect_ai_paths(files).select("filename", "pattern_id", "severity", "context")


@query(f"SELECT tech, count(*) AS n FROM (SELECT unnest(list_filter([{', '.join(f'CASE WHEN regexp_matches(path, {q(r)}) THEN {q(n)} END' for n, r in TECH_NAMES)}], lambda x: x IS NOT NULL)) AS tech FROM (SELECT {PATH_SQL} AS path FROM part)) GROUP BY tech")
def technologies(spark, d):
    return part_paths(spark, d).select(F.explode(P.tech_of_name(F.col("path"))).alias("tech")).groupBy("tech").agg(F.count("*").alias("n"))


@query("""SELECT CAST(coalesce(i.k, g.k) AS VARCHAR) AS sha1, coalesce(i.path, g.path) AS path
FROM (SELECT l_partkey AS k, arg_max('i/' || l_orderkey, l_orderkey * 10 + l_linenumber) AS path FROM lineitem GROUP BY 1) i FULL JOIN (SELECT o_custkey AS k, arg_min('g/' || o_orderkey, o_orderkey) AS path FROM orders GROUP BY 1) g ON i.k = g.k""")
def object_paths(spark, d):
    return R.object_paths(_index(spark, d), _graph(spark, d))


def _index(spark, d) -> DataFrame:
    """lineitem as an index: a part is an object, an order's line one of its paths."""
    return table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("sha1"), F.concat(F.lit("i/"), "l_orderkey").alias("path"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))


def _graph(spark, d) -> DataFrame:
    """orders as a graph: a customer is an object, an order one of its paths."""
    return table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("sha1"), F.concat(F.lit("g/"), "o_orderkey").alias("path"), F.col("o_orderkey").alias("seq"))


def _objects(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("sha1"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS sha1, CASE WHEN o_orderkey IN (SELECT l_partkey FROM lineitem) THEN 0 WHEN o_orderkey IN (SELECT o_custkey FROM orders) THEN 1 ELSE 2 END AS origin FROM orders")
def verification_candidates(spark, d):
    return R.candidates(_objects(spark, d), _index(spark, d), _graph(spark, d))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS sha1 FROM orders WHERE o_orderstatus <> 'F'")
def resume_pending(spark, d):
    done = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("sha1"))
    return R.pending(_objects(spark, d), done)


@query("SELECT CAST(o.o_orderkey AS VARCHAR) AS sha1, coalesce(g.path, '[blob:' || left(CAST(o.o_orderkey AS VARCHAR), 8) || ']') AS path, g.path IS NULL AS is_deleted FROM orders o LEFT JOIN (SELECT o_custkey, arg_min('g/' || o_orderkey, o_orderkey) AS path FROM orders GROUP BY 1) g ON o.o_orderkey = g.o_custkey")
def named_objects(spark, d):
    graph = _graph(spark, d).groupBy("sha1").agg(F.min_by("path", "seq").alias("path"))
    return R.mark_deleted(R.named_objects(_objects(spark, d), graph), graph)


@query("SELECT author_email, arg_min(author, seq) AS author FROM (SELECT role AS author_email, left(text, 12) || conv_id AS author, conv_id * 1000 + turn AS seq FROM conversations) GROUP BY author_email")
def first_contributors(spark, d):
    rows = table(spark, d, "conversations").select(F.col("role").alias("author_email"), F.concat(F.left("text", F.lit(12)), F.col("conv_id")).alias("author"), F.expr("conv_id * 1000 + turn").alias("seq"))
    return U.contributors(rows)


PROBES = (("HEAD", 40), ("config", 30), ("packed-refs", 15), ("index", 20), ("logs/HEAD", 10), ("COMMIT_EDITMSG", 5), ("objects/info/packs", 10))
PROBE_SQL = f"""p AS (SELECT user_id AS url, CAST(event_id % 3 AS VARCHAR) AS git_path, ({sql_list([n for n, _ in PROBES])})[CAST(event_id % 7 AS INTEGER) + 1] AS probe, ([{", ".join(str(w) for _, w in PROBES)}])[CAST(event_id % 7 AS INTEGER) + 1] AS weight,
  value > 20 AS valid, CASE WHEN value > 20 THEN 200 WHEN value > 10 THEN 403 ELSE 404 END AS status FROM events),
s AS (SELECT url, git_path, coalesce(sum(weight) FILTER (valid), 0) AS points, coalesce(bool_or(probe = 'HEAD' AND status = 403), false) AS refused, coalesce(bool_or(probe = 'HEAD' AND NOT valid), false) AS failed FROM p GROUP BY ALL),
c AS (SELECT url, git_path, CAST(CASE WHEN refused THEN 25 ELSE least(floor(points * 100 / 130), 100) END AS INTEGER) AS confidence, refused FROM s WHERE refused OR NOT failed),
scored AS (SELECT url, git_path, confidence, CASE WHEN refused THEN 'PROTECTED' WHEN confidence >= 90 THEN 'CONFIRMED' WHEN confidence >= 70 THEN 'HIGH' WHEN confidence >= 45 THEN 'MEDIUM' WHEN confidence >= 20 THEN 'LOW' ELSE 'NONE' END AS label FROM c)"""


def _probes(spark, d) -> DataFrame:
    names = F.array(*[F.lit(n) for n, _ in PROBES])
    weights = F.array(*[F.lit(w) for _, w in PROBES])
    at = (F.col("event_id") % 7).cast("int")
    return table(spark, d, "events").select(F.col("user_id").alias("url"), (F.col("event_id") % 3).cast("string").alias("git_path"), F.get(names, at).alias("probe"), F.get(weights, at).alias("weight"), (F.col("value") > 20).alias("valid"), F.when(F.col("value") > 20, 200).when(F.col("value") > 10, 403).otherwise(404).alias("status"))


@query(f"WITH {PROBE_SQL} SELECT * FROM scored")
def probe_scores(spark, d):
    return R.score_probes(_probes(spark, d))


@query(f"WITH {PROBE_SQL} SELECT url, git_path, confidence, label FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY confidence DESC, git_path) AS n FROM scored WHERE confidence >= 20) WHERE n = 1")
def best_probes(spark, d):
    return R.best_probe(R.score_probes(_probes(spark, d)))


HISTORY_SQL = """h AS (SELECT l_suppkey AS repo, CAST(l_orderkey AS VARCHAR) AS commit_sha, 'f' || (l_partkey % 50) AS path, CASE WHEN l_returnflag = 'R' THEN 'removed' ELSE 'modified' END AS status,
  CASE WHEN l_linestatus = 'O' THEN CAST(l_partkey % 90 AS VARCHAR) END AS blob_sha, l_orderkey * 10 + l_linenumber AS seq FROM lineitem),
u AS (SELECT *, path || ':' || coalesce(blob_sha, commit_sha) AS view_key FROM h WHERE NOT (status = 'removed' AND blob_sha IS NULL)),
v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, view_key ORDER BY seq) AS n FROM u) WHERE n = 1)"""


def _history(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("repo"), F.col("l_orderkey").cast("string").alias("commit_sha"), F.concat(F.lit("f"), F.col("l_partkey") % 50).alias("path"), F.when(F.col("l_returnflag") == "R", "removed").otherwise("modified").alias("status"),
        F.when(F.col("l_linestatus") == "O", (F.col("l_partkey") % 90).cast("string")).alias("blob_sha"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )


@query(f"WITH {HISTORY_SQL} SELECT repo, commit_sha, path, view_key FROM v")
def history_views(spark, d):
    return R.history_views(_history(spark, d)).select("repo", "commit_sha", "path", "view_key")


@query(f"WITH {HISTORY_SQL} SELECT a.repo, a.commits, a.considered, coalesce(b.scanned, 0) AS scanned, a.usable - coalesce(b.scanned, 0) AS deduplicated, a.deleted FROM (SELECT repo, count(DISTINCT commit_sha) AS commits, count(*) AS considered, count(*) FILTER (status = 'removed') AS deleted, count(*) FILTER (NOT (status = 'removed' AND blob_sha IS NULL)) AS usable FROM h GROUP BY repo) a LEFT JOIN (SELECT repo, count(*) AS scanned FROM v GROUP BY repo) b USING (repo)")
def history_coverage(spark, d):
    return R.history_coverage(_history(spark, d))


@query("""WITH RECURSIVE e AS (SELECT o_orderkey AS c, unnest([o_orderkey // 2, o_orderkey - 7]) AS p FROM orders), w AS (SELECT max(o_orderkey) AS c, 0 AS depth FROM orders UNION SELECT e.p, w.depth + 1 FROM w JOIN e ON e.c = w.c WHERE w.depth < 6 AND e.p IN (SELECT o_orderkey FROM orders))
SELECT CAST(c AS VARCHAR) AS sha1, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY c ORDER BY depth, sha1 LIMIT 12""")
def commit_walk(spark, d):
    orders = table(spark, d, "orders")
    commits = orders.select(F.col("o_orderkey").cast("string").alias("sha1"), F.expr("array(cast(o_orderkey div 2 as string), cast(o_orderkey - 7 as string))").alias("parents"))
    heads = orders.agg(F.max("o_orderkey").cast("string").alias("sha1"))
    return R.commit_walk(commits, heads, 12)


@query("SELECT s_name AS full_name FROM supplier WHERE lower(s_name) = 'supplier#000000003' OR regexp_matches(s_name, '(?i)^supplier#.*7$') OR regexp_matches(s_name, '(?i)^s.pplier#0000000.1$')")
def selected_repositories(spark, d):
    selectors = spark.createDataFrame([("supplier#000000003",), ("SUPPLIER#*7",), ("s?pplier#0000000?1",)], "selector string")
    return R.select_repositories(table(spark, d, "supplier").select(F.col("s_name").alias("full_name")), selectors)


MESSAGES = ("HTTP 401 from host", "request failed: http 503", "unsupported capability: history", "http abc", "timeout", "Access denied by policy", "got http 429 twice", "http 70000")
MESSAGE_SQL = f"({sql_list(MESSAGES)})[CAST(o_orderkey % {len(MESSAGES)} AS INTEGER) + 1]"


@query(f"""SELECT code, stage, http_status, retryable, count(*) AS n FROM (SELECT CASE WHEN cap THEN 'unsupported_capability' WHEN auth THEN 'authentication_failed' ELSE 'scan_failed' END AS code,
CASE WHEN cap THEN 'capability' WHEN auth THEN 'authentication' WHEN http_status IS NOT NULL THEN 'transport' ELSE 'scan' END AS stage, http_status, coalesce(http_status IN (408, 425, 429) OR http_status BETWEEN 500 AND 599, false) AS retryable
FROM (SELECT *, contains(m, 'unsupported capability') AS cap, contains(m, 'access denied') OR coalesce(http_status IN (401, 403), false) AS auth FROM
(SELECT m, CASE WHEN TRY_CAST(nullif(regexp_extract(m, 'http ([0-9]+)', 1), '') AS INTEGER) <= 65535 THEN TRY_CAST(regexp_extract(m, 'http ([0-9]+)', 1) AS INTEGER) END AS http_status FROM (SELECT lower({MESSAGE_SQL}) AS m FROM orders)))) GROUP BY ALL""")
def error_classes(spark, d):
    messages = F.array(*[F.lit(m) for m in MESSAGES])
    rows = table(spark, d, "orders").select(X.error_metadata(F.get(messages, (F.col("o_orderkey") % len(MESSAGES)).cast("int"))).alias("e"))
    return rows.groupBy("e.code", "e.stage", "e.http_status", "e.retryable").agg(F.count("*").alias("n"))


RAW_SPARK = "concat(array('=', ' +', 'a|b', '<b>', 'x', '[l](u)', '`c`', '\"q\"')[cast(o_orderkey % 8 as int)], o_orderpriority, '&', '\\'', '\\n')"
RAW_SQL = "(['=', ' +', 'a|b', '<b>', 'x', '[l](u)', '`c`', '\"q\"'])[CAST(o_orderkey % 8 AS INTEGER) + 1] || o_orderpriority || '&' || '''' || chr(10)"


@query(f"""SELECT o_orderkey, replace(replace(replace(replace(replace(replace(raw, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;'), '=', '&#61;') AS html,
replace(replace(replace(replace(replace(replace(raw, '\\', '\\\\'), '|', '\\|'), '`', '\\`'), '[', '\\['), ']', '\\]'), chr(10), ' ') AS markdown,
'"' || replace(CASE WHEN regexp_matches(cut, '^[=+@-]') THEN '''' || cut ELSE cut END, '"', '""') || '"' AS csv FROM (SELECT *, trim(raw, ' ' || chr(10)) AS cut FROM (SELECT o_orderkey, {RAW_SQL} AS raw FROM orders))""")
def escapes(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.expr(RAW_SPARK).alias("raw"))
    return rows.select("o_orderkey", X.html_escape(F.col("raw")).alias("html"), X.markdown_escape(F.col("raw")).alias("markdown"), X.csv_cell(F.col("raw")).alias("csv"))


CACHE_SQL = "c AS (SELECT CAST(o_orderkey AS VARCHAR) AS sha1, CAST(o_totalprice AS BIGINT) AS size, o_orderkey // 3 AS created_at FROM orders)"


def _cache(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("sha1"), F.round("o_totalprice").cast("long").alias("size"), F.expr("o_orderkey div 3").alias("created_at"))


@query(f"WITH {CACHE_SQL.replace('CAST(o_totalprice AS BIGINT)', 'CAST(round(o_totalprice) AS BIGINT)')} SELECT sha1, size, created_at FROM (SELECT *, sum(size) OVER (ORDER BY created_at DESC, sha1 DESC ROWS UNBOUNDED PRECEDING) AS newer FROM c) WHERE newer <= 90000000")
def cache_eviction(spark, d):
    return R.evict(_cache(spark, d), 100_000_000, 0, 0)


@query(f"WITH {CACHE_SQL.replace('CAST(o_totalprice AS BIGINT)', 'CAST(round(o_totalprice) AS BIGINT)')} SELECT count(*) AS entries, CAST(sum(size) AS BIGINT) AS bytes, count(*) FILTER (created_at <= 300) AS expired FROM c")
def cache_statistics(spark, d):
    return R.cache_stats(_cache(spark, d), 1000, 700)


# YAML-like texts of customers, by key modulo their number.
YAML = (
    "concat('db_password: |', chr(10), '  # note', chr(10), '  ', md5(c_name))",
    "concat('api_token: ', md5(c_name), ' # set')",
    "concat('auth_key: &base', chr(10), '  ', md5(c_name))",
    "concat('private_key:', chr(10), '  v', md5(c_name))",
    "concat('comment: ', md5(c_name))",
    "concat('secret: >', chr(10), 'a', md5(c_name), chr(10), 'b', chr(10), 'next:')",
)


@query(f"""WITH y AS (SELECT CAST(c_custkey AS VARCHAR) AS filename, md5(c_name) AS m, c_custkey % 6 AS k FROM customer)
SELECT filename, 1 AS line, (['yaml_block_scalar_secret', 'yaml_inline_secret', 'yaml_anchor_secret', 'yaml_nextline_secret', '', 'yaml_block_scalar_secret'])[k + 1] AS pattern_id,
CASE k WHEN 3 THEN 'v' || m WHEN 5 THEN 'a' || m || ' b' ELSE m END AS match, CASE WHEN k IN (0, 1) THEN 'MEDIUM' ELSE 'HIGH' END AS severity FROM y WHERE k <> 4 AND NOT {placeholder_sql("m")} AND NOT contains(m, '00000000')""")
def yaml_findings(spark, d):
    kinds = " ".join(f"WHEN {i} THEN {e.replace('chr(', 'char(')}" for i, e in enumerate(YAML))
    rows = table(spark, d, "customer").withColumn("text", F.expr(f"CASE c_custkey % {len(YAML)} {kinds} END"))
    return detect_yaml(as_files(rows, F.col("c_custkey").cast("string"))).select("filename", "line", "pattern_id", "match", "severity")


BLOCK_TEXTS = (
    "concat('x = 1', chr(10), 'SECRET_KEY = \"', md5(c_name), '\"')",
    "concat('DB_', 'PASSWORD=\"', substr(md5(c_name), 1, 14), '\"')",
    "concat('redis://u:', substr(md5(c_name), 1, 9), '@h')",
    "concat('\"svc\": {', chr(10), ' \"api_key\": \"', md5(c_name), '\"}')",
    "concat('nothing ', md5(c_name))",
)


@query("""WITH y AS (SELECT CAST(c_custkey AS VARCHAR) AS filename, md5(c_name) AS m, c_custkey % 5 AS k FROM customer)
SELECT filename, CASE k WHEN 0 THEN 2 ELSE 1 END AS line, (['django_secret_key', 'php_db_config', 'db_url_password', 'json_nested_secret'])[k + 1] AS pattern_id,
CASE k WHEN 1 THEN substr(m, 1, 14) WHEN 2 THEN substr(m, 1, 9) ELSE m END AS match, CASE k WHEN 0 THEN 'CRITICAL' ELSE 'HIGH' END AS severity FROM y WHERE k <> 4""")
def block_findings(spark, d):
    kinds = " ".join(f"WHEN {i} THEN {e.replace('chr(', 'char(')}" for i, e in enumerate(BLOCK_TEXTS))
    rows = table(spark, d, "customer").withColumn("text", F.expr(f"CASE c_custkey % {len(BLOCK_TEXTS)} {kinds} END"))
    return detect_blocks(as_files(rows, F.col("c_custkey").cast("string"))).select("filename", "line", "pattern_id", "match", "severity")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS sha1 FROM orders UNION SELECT CAST(c_custkey AS VARCHAR) FROM customer UNION SELECT CAST(l_partkey AS VARCHAR) FROM lineitem")
def all_objects(spark, d):
    ids = lambda name, key: table(spark, d, name).select(F.col(key).cast("string").alias("sha1"))
    return O.object_ids(ids("orders", "o_orderkey"), ids("customer", "c_custkey"), ids("lineitem", "l_partkey"))


@query("SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS sha1 FROM lineitem WHERE l_orderkey NOT IN (SELECT c_custkey FROM customer)")
def commit_candidates(spark, d):
    ids = lambda name, key: table(spark, d, name).select(F.col(key).cast("string").alias("sha1"))
    return O.without(ids("lineitem", "l_orderkey"), ids("customer", "c_custkey"))
