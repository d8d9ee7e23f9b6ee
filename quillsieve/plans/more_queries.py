"""Further queries of the driver's contract: repository work lists, telemetry, reports, binaries, whole-text detectors, with their SQL."""

from __future__ import annotations

import io
import zipfile
import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from quillsieve.functions import paths as P
from quillsieve.functions import text as X
from quillsieve.functions import urls as N
from quillsieve.operators import binary as B
from quillsieve.operators import lines as L
from quillsieve.operators import outcomes as O
from quillsieve.operators import repository as R
from quillsieve.operators import rollup as U
from quillsieve.operators.blocks import BLOCKS, detect_blocks
from quillsieve.patterns import CONTEXT_KEYWORDS, SENSITIVE_NAME, TECH_CONTENT
from quillsieve.plans.queries import AI_SQL, CONFIG_FINDINGS, PATH_SQL, POLICY, PROBE_SQL, _probes, as_files, config_findings, entropy_sql, findings_sql, part_paths, placeholder_sql, q, query, sql_list, table
from quillsieve.sources import git as G
from quillsieve.sources import metadata as M
from quillsieve.sources import provider as V
from quillsieve.sources import reports as K

# ---- work lists and object sets


def _ids(spark, d, name, key, alias="sha1"):
    return table(spark, d, name).select(F.col(key).cast("string").alias(alias))


@query(f"""WITH b AS (SELECT CAST(p_partkey AS VARCHAR) AS sha1, {PATH_SQL} AS path, p_size < 25 AS now FROM part),
c AS (SELECT CAST(o_orderkey AS VARCHAR) AS sha1 FROM orders),
u AS (SELECT sha1, 0 AS origin FROM b UNION ALL SELECT sha1, 1 AS origin FROM c WHERE sha1 NOT IN (SELECT sha1 FROM b)),
r AS (SELECT u.sha1, u.origin, b.path, NOT coalesce(b.now, false) AS is_deleted, coalesce(regexp_matches(b.path, {q(SENSITIVE_NAME)}) OR ({AI_SQL}) IS NOT NULL, false) AS special FROM u LEFT JOIN b USING (sha1))
SELECT sha1, origin, path, is_deleted, CASE WHEN origin = 1 THEN 4 WHEN is_deleted AND special THEN 0 WHEN is_deleted THEN 1 WHEN special THEN 2 ELSE 3 END AS priority FROM r""")
def work_list(spark, d):
    parts = part_paths(spark, d).select(F.col("p_partkey").cast("string").alias("sha1"), "path")
    current = table(spark, d, "part").filter("p_size < 25").select(F.col("p_partkey").cast("string").alias("sha1"))
    return O.work_list(parts, _ids(spark, d, "orders", "o_orderkey"), parts, current)


@query("SELECT CAST(o_orderkey AS VARCHAR) AS sha1, array_agg(path ORDER BY origin, seq, path) AS paths FROM (SELECT o_orderkey, path, min(origin) AS origin, arg_min(seq, (origin, seq)) AS seq FROM (SELECT l_orderkey AS o_orderkey, 'i/' || l_partkey AS path, 0 AS origin, l_linenumber AS seq FROM lineitem UNION ALL SELECT o_orderkey, 'g/' || o_custkey, 1, 0 FROM orders) GROUP BY o_orderkey, path) GROUP BY 1")
def all_paths(spark, d):
    index = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("sha1"), F.concat(F.lit("i/"), "l_partkey").alias("path"), F.col("l_linenumber").alias("seq"))
    graph = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("sha1"), F.concat(F.lit("g/"), "o_custkey").alias("path"), F.lit(0).alias("seq"))
    return R.all_paths(index, graph)


@query("""WITH c AS (SELECT CAST(o_orderkey AS VARCHAR) AS sha1, o_custkey, o_totalprice, o_orderstatus FROM orders)
SELECT c.sha1, CASE WHEN o_orderstatus = 'F' THEN 'p' || sha1 WHEN o_custkey % 2 = 0 AND o_totalprice > 50000 THEN 'c' || sha1 WHEN o_custkey % 3 = 0 THEN 'l' || sha1 END AS content,
CASE WHEN o_orderstatus = 'F' THEN 'pack' WHEN o_custkey % 2 = 0 AND o_totalprice > 50000 THEN 'cache' WHEN o_custkey % 3 = 0 THEN 'loose' END AS source FROM c""")
def acquired(spark, d):
    o = table(spark, d, "orders").withColumn("sha1", F.col("o_orderkey").cast("string"))
    of = lambda cond, mark: o.filter(cond).withColumn("content", F.concat(F.lit(mark), "sha1"))
    return R.acquire(o, of("o_orderstatus = 'F'", "p"), of("o_custkey % 2 = 0", "c"), of("o_custkey % 3 = 0", "l"), F.col("o_totalprice") > 50000)


@query("""WITH RECURSIVE t AS (SELECT o_orderkey AS k, o_orderkey // 2 AS target, CASE WHEN o_orderkey % 4 IN (0, 1) THEN 'tag' ELSE 'commit' END AS kind FROM orders),
w AS (SELECT k, target, kind, 0 AS hop FROM t UNION ALL SELECT w.k, t.target, t.kind, hop + 1 FROM w JOIN t ON w.target = t.k WHERE w.kind = 'tag' AND hop < 8)
SELECT CAST(k AS VARCHAR) AS sha1, CAST(arg_max(target, hop) AS VARCHAR) AS target, arg_max(kind, hop) AS target_type FROM w GROUP BY k""")
def tag_targets(spark, d):
    kind = F.when((F.col("o_orderkey") % 4).isin(0, 1), "tag").otherwise("commit")
    return R.tag_targets(table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("sha1"), F.expr("cast(o_orderkey div 2 as string)").alias("target"), kind.alias("target_type")))


@query("SELECT CAST(coalesce(sum(p_size), 0) AS BIGINT) AS estimated_bytes FROM part")
def estimated_size(spark, d):
    return R.estimated_size(table(spark, d, "part").select(F.col("p_size").alias("file_size")), 10)


@query("""WITH c AS (SELECT s_suppkey, row_number() OVER (ORDER BY origin, sha1) - 1 AS place, sha1, count(*) OVER () AS total FROM (SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) AS sha1, s_nationkey % 3 AS origin FROM supplier)),
p AS (SELECT sha1, s_suppkey FROM c WHERE place IN (SELECT least(k * CASE WHEN least(total, 10) > 1 THEN total // least(total, 10) ELSE 1 END, total - 1) FROM range(10) AS r(k) WHERE k < least(total, 10)))
SELECT count(*) FILTER (s_suppkey % 2 = 0) >= greatest(ceil(count(*) * 0.3), 1) AS objects_accessible FROM p""")
def accessible_objects(spark, d):
    candidates = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("sha1"), (F.col("s_nationkey") % 3).alias("origin"))
    probes = O.probe_sample(candidates).withColumn("ok", F.col("sha1").cast("int") % 2 == 0)
    return O.accessible(probes, strict=True)


@query(f"SELECT path, length, CASE WHEN ({AI_SQL}) IS NOT NULL THEN 0 ELSE 1 END AS \"order\" FROM (SELECT {PATH_SQL} AS path, p_size * 100 AS length FROM part) WHERE length <= 3000 AND lower(regexp_extract(path, '[^.]*$', 0)) NOT IN {tuple(P.BINARY_EXTENSIONS)}")
def scan_candidates(spark, d):
    files = part_paths(spark, d).join(table(spark, d, "part").select("p_partkey", (F.col("p_size") * 100).alias("length")), "p_partkey")
    return O.scan_candidates(files.select("path", "length"), 3000, False, P.is_binary_name(F.col("path")))


def _local_tech_sql(exact: bool) -> str:
    tests = []
    for name, parts, endings in P.LOCAL_TECH:
        tests.append(f"CASE WHEN {' OR '.join([f'contains(path, {q(x)})' for x in parts] + [f'ends_with(path, {q(x)})' if exact else f'contains(path, {q(x)})' for x in endings])} THEN {q(name)} END")
    return f"list_filter([{', '.join(tests)}], lambda x: x IS NOT NULL)"


@query(f"SELECT p_partkey, {_local_tech_sql(False)} AS local, {_local_tech_sql(True)} AS exact FROM (SELECT p_partkey, {PATH_SQL} || CASE WHEN p_partkey % 3 = 0 THEN '.php.go~' ELSE '' END AS path FROM part)")
def path_technologies(spark, d):
    rows = part_paths(spark, d).withColumn("path", F.concat("path", F.when(F.col("p_partkey") % 3 == 0, ".php.go~").otherwise("")))
    return rows.select("p_partkey", P.tech_of_path(F.col("path")).alias("local"), P.tech_of_path(F.col("path"), exact=True).alias("exact"))


SNIPPETS = ("from flask import x", "import fastapi", "nothing here", "new PrismaClient()", "@NgModule({})", "use Illuminate\\Support", "require 'rails'", "t.procedure.query", "Celery('x')")


@query(f"SELECT p_partkey, list_filter([{', '.join(f'CASE WHEN regexp_matches(text, {q(r)}) THEN {q(n)} END' for n, r in TECH_CONTENT)}], lambda x: x IS NOT NULL) AS tech FROM (SELECT p_partkey, p_name || chr(10) || ({sql_list(SNIPPETS)})[CAST(p_partkey % {len(SNIPPETS)} AS INTEGER) + 1] AS text FROM part)")
def content_technologies(spark, d):
    snippet = F.get(F.array(*[F.lit(s) for s in SNIPPETS]), (F.col("p_partkey") % len(SNIPPETS)).cast("int"))
    return table(spark, d, "part").select("p_partkey", P.tech_of_content(F.concat("p_name", F.lit("\n"), snippet)).alias("tech"))


@query(f"SELECT list_sort(list_distinct(flatten(list({_local_tech_sql(False)})))) AS tech_stack FROM (SELECT {PATH_SQL} AS path FROM part)")
def tech_stack(spark, d):
    return U.tech_stack(part_paths(spark, d).select(P.tech_of_path(F.col("path")).alias("tech")))


# ---- paths, URLs and hashes

ODD_PATHS = ("a/b.txt", "../up", "/abs/x", "a//b", "./c/./d", "x\\y\\..\\z", "", ".", "ok/file")
ODD_SQL = f"({sql_list(ODD_PATHS)})[CAST(o_orderkey % {len(ODD_PATHS)} AS INTEGER) + 1]"


@query(f"""SELECT o_orderkey, CASE WHEN len(parts) > 0 THEN array_to_string(parts, '/') END AS safe, CASE WHEN path <> '' AND len(list_filter(string_split(path, '/'), lambda x: x IN ('', '.', '..'))) = 0 THEN path END AS strict,
regexp_full_match(sha, '[0-9a-fA-F]{{40}}') AS valid FROM (SELECT o_orderkey, path, list_filter(string_split(replace(path, '\\', '/'), '/'), lambda x: x NOT IN ('', '.', '..')) AS parts, sha FROM (SELECT o_orderkey, {ODD_SQL} AS path, left(md5(CAST(o_orderkey AS VARCHAR)) || 'ABCDEF0123', CAST(39 + o_orderkey % 3 AS INTEGER)) AS sha FROM orders))""")
def path_safety(spark, d):
    path = F.get(F.array(*[F.lit(p) for p in ODD_PATHS]), (F.col("o_orderkey") % len(ODD_PATHS)).cast("int"))
    sha = F.left(F.concat(F.md5(F.col("o_orderkey").cast("string").cast("binary")), F.lit("ABCDEF0123")), (F.col("o_orderkey") % 3 + 39).cast("int"))
    rows = table(spark, d, "orders").select("o_orderkey", path.alias("path"), sha.alias("sha"))
    return rows.select("o_orderkey", P.safe_path(F.col("path")).alias("safe"), P.strict_path(F.col("path")).alias("strict"), P.is_valid_sha(F.col("sha")).alias("valid"))


@query("SELECT doc_id, sha1('blob ' || strlen(text) || chr(0) || text) AS sha1 FROM documents WHERE text IS NOT NULL")
def object_hashes(spark, d):
    rows = table(spark, d, "documents").filter("text IS NOT NULL")
    return rows.select("doc_id", X.git_sha1(F.lit("blob"), F.encode("text", "UTF-8")).alias("sha1"))


@query("""SELECT o_orderkey, CASE WHEN s >= 1073741824 THEN printf('%.2f GB', round(s / 1073741824.0, 2)) WHEN s >= 1048576 THEN printf('%.1f MB', round(s / 1048576.0, 1)) WHEN s >= 1024 THEN printf('%.1f KB', round(s / 1024.0, 1)) ELSE s || ' B' END AS size
FROM (SELECT o_orderkey, o_orderkey * o_orderkey * (o_custkey % 7) AS s FROM orders)""")
def size_texts(spark, d):
    return table(spark, d, "orders").select("o_orderkey", X.size_text(F.expr("o_orderkey * o_orderkey * (o_custkey % 7)")).alias("size"))


HOSTS = ("example.org", "10.0.0.7", "172.31.9.9", "172.32.0.1", "localhost", "[::1]", "192.168.1.1:8080", "100.64.0.1", "8.8.8.8", "169.254.169.254", "[fe80::1]", "[2001:db8::1]", "[::ffff:127.0.0.1]", "127.0.0.256", "224.0.0.1")
URL_SHAPES = ("concat('https://', h, '/p/', c)", "concat(h, '/p?private_token=', c, '&page=2')", "concat('javascript:alert(', c, ')')", "concat('http://user:pw@', h, '/x?code=1&q=', c, '#top')", "concat('  https://', h, '/ ')", "concat('ftp://', h, '/a')", "concat('https://', h, '?flag&API_KEY=', c)")
INTERNAL_SQL = " OR ".join(f"(a = {a} AND b BETWEEN {low} AND {high})" for a, low, high in N.INTERNAL)
URL_SQL = f"(SELECT c_custkey, CASE c_custkey % {len(URL_SHAPES)} {' '.join(f'WHEN {i} THEN {e}' for i, e in enumerate(URL_SHAPES))} END AS url FROM (SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS c, ({sql_list(HOSTS)})[CAST(c_custkey % {len(HOSTS)} AS INTEGER) + 1] AS h FROM customer))"


def _urls(spark, d):
    host = F.get(F.array(*[F.lit(h) for h in HOSTS]), (F.col("c_custkey") % len(HOSTS)).cast("int"))
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("c"), host.alias("h"))
    kinds = " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(URL_SHAPES))
    return rows.select("c_custkey", F.expr(f"CASE c_custkey % {len(URL_SHAPES)} {kinds} END").alias("url"))


@query(f"""WITH u AS (SELECT c_custkey, url, trim(url) AS cut FROM {URL_SQL}), w AS (SELECT *, CASE WHEN regexp_matches(cut, '^https?://') THEN cut ELSE 'https://' || cut END AS whole FROM u)
SELECT c_custkey, url, CASE WHEN NOT regexp_matches(lower(cut), '^(javascript|data|vbscript):') AND regexp_matches(whole, '^https?://([^/?#@]*@)?(\\[[0-9A-Fa-f:.]+\\]|[^/?#:@\\s\\[\\]]+)(:[0-9]{{0,5}})?([/?#].*)?$') THEN rtrim(whole, '/') END AS normal FROM w""")
def valid_urls(spark, d):
    return _urls(spark, d).select("c_custkey", "url", N.valid_url(F.col("url")).alias("normal"))


@query(f"""WITH u AS (SELECT c_custkey, url, regexp_replace(url, '^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#@]*@', '\\1') AS bare FROM {URL_SQL}),
p AS (SELECT c_custkey, url, string_split(bare, '?')[1] AS head, list_filter(string_split(regexp_extract(bare, '\\?([^#]*)', 1), '&'), lambda x: x <> '') AS pairs, contains(bare, '?') AS asked, regexp_extract(bare, '(#.*)$', 1) AS mark FROM u)
SELECT c_custkey, CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/]') THEN head || CASE WHEN asked THEN '?' || array_to_string(list_transform(pairs, lambda x: CASE WHEN regexp_matches(lower(string_split(x, '=')[1]), 'token|secret|key|password|auth') OR lower(string_split(x, '=')[1]) = 'code' THEN string_split(x, '=')[1] || '=%5BREDACTED%5D' WHEN NOT contains(x, '=') THEN x || '=' ELSE x END), '&') ELSE '' END || CASE WHEN asked THEN mark ELSE '' END
  ELSE string_split(url, '?')[1] END AS redacted FROM p""")
def redacted_urls(spark, d):
    return _urls(spark, d).select("c_custkey", N.redacted_url(F.col("url")).alias("redacted"))


@query(f"""WITH h AS (SELECT c_custkey, lower(trim(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?(\\[[^\\]]*\\]|[^/?#:]*)', 2), '[]')) AS host FROM {URL_SQL}),
o AS (SELECT c_custkey, host, CASE WHEN regexp_matches(host, '^::ffff:[0-9.]+$') THEN host[8:] ELSE host END AS four FROM h),
i AS (SELECT *, try_cast(string_split(four, '.')[1] AS INTEGER) AS a, try_cast(string_split(four, '.')[2] AS INTEGER) AS b, regexp_full_match(four, '([0-9]{{1,3}}[.]){{3}}[0-9]{{1,3}}') AND list_max(list_transform(string_split(four, '.'), lambda x: try_cast(x AS INTEGER))) <= 255 AS v4 FROM o)
SELECT c_custkey, host, coalesce(host IN {N.LOCAL_NAMES}, false) OR host IN ('::1', '::') OR regexp_matches(host, '^(fe[89ab]|f[cd]|ff)[0-9a-f]*:') OR coalesce(v4 AND (four IN ('0.0.0.0', '255.255.255.255') OR a BETWEEN 224 AND 239 OR {INTERNAL_SQL}), false) AS internal FROM i""")
def internal_hosts(spark, d):
    rows = _urls(spark, d).select("c_custkey", N.host_of(F.col("url")).alias("host"))
    return rows.select("c_custkey", "host", N.is_internal_host(F.col("host")).alias("internal"))


@query(f"""SELECT c_custkey, left(trim(regexp_replace(regexp_replace(regexp_replace(url, '^(https://)+', ''), '^(http://)+', ''), '[^\\p{{L}}\\p{{N}}.-]', '_', 'g'), '_'), 200) AS name, array_to_string(list_transform(string_split(url, '/'), lambda x: url_encode(x)), '/') AS encoded,
'objects/' || left(md5(url), 2) || '/' || md5(url)[3:] AS place, replace(c_name, '#', '_') AS workspace FROM {URL_SQL} JOIN customer USING (c_custkey)""")
def target_names(spark, d):
    rows = _urls(spark, d).join(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey")
    url = F.col("url")
    return rows.select("c_custkey", N.target_name(url).alias("name"), N.encoded_path(url).alias("encoded"), N.object_path(F.md5(url.cast("binary"))).alias("place"), N.workspace_name(F.replace("c_name", F.lit("#"), F.lit("/"))).alias("workspace"))


# ---- outcomes and telemetry

OUTCOME_SQL = "CASE WHEN o_orderstatus = 'F' THEN 'scanned' WHEN o_orderstatus = 'O' THEN 'skipped' ELSE 'failed' END"
REASON_SQL = "CASE WHEN o_orderstatus = 'O' THEN CASE WHEN o_custkey % 2 = 0 THEN 'resource_budget' ELSE 'oversized' END END"


def _outcomes(spark, d):
    tech = F.when(F.col("o_custkey") % 5 == 0, F.array(F.lit("Go"), F.lit("Rust"))).otherwise(F.array(F.concat(F.lit("T"), (F.col("o_custkey") % 3).cast("string"))))
    return table(spark, d, "orders").select(F.expr(OUTCOME_SQL).alias("outcome"), F.expr(REASON_SQL).alias("reason"), F.round("o_totalprice").cast("long").alias("bytes"), tech.alias("tech"))


@query(f"SELECT count(*) FILTER (o = 'scanned') AS scanned, CAST(coalesce(sum(b) FILTER (o = 'scanned'), 0) AS BIGINT) AS bytes, count(*) FILTER (o = 'skipped' AND coalesce(r, '') <> 'resource_budget') AS skipped_total, count(*) FILTER (o = 'failed') AS failed_total FROM (SELECT {OUTCOME_SQL} AS o, {REASON_SQL} AS r, CAST(round(o_totalprice) AS BIGINT) AS b FROM orders)")
def scan_totals(spark, d):
    return U.scan_totals(_outcomes(spark, d))


@query(f"""SELECT count(*) FILTER (o = 'scanned') AS blobs_scanned, count(*) FILTER (o = 'failed') AS blobs_failed, count(*) FILTER (o = 'skipped') AS blobs_skipped, CAST(sum(b) FILTER (o = 'scanned') AS BIGINT) AS bytes_scanned,
list_sort(list_distinct(flatten(list(t) FILTER (o = 'scanned')))) AS tech_stack FROM (SELECT {OUTCOME_SQL} AS o, CAST(round(o_totalprice) AS BIGINT) AS b, CASE WHEN o_custkey % 5 = 0 THEN ['Go', 'Rust'] ELSE ['T' || (o_custkey % 3)] END AS t FROM orders)""")
def scan_accumulated(spark, d):
    return O.accumulated(_outcomes(spark, d))


@query(f"SELECT unnest(list_sort(list(reason || '=' || n))) AS entry FROM (SELECT {REASON_SQL} AS reason, count(*) AS n FROM orders GROUP BY 1) WHERE reason IS NOT NULL")
def skip_tallies(spark, d):
    return U.tallies(_outcomes(spark, d), "reason").select(F.explode(F.transform(F.map_entries("tallies"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))).alias("entry"))


@query("SELECT l_suppkey, CAST(sum(l_linenumber) AS BIGINT) AS granted, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS wait_ms, CAST(max(l_partkey) AS BIGINT) AS peak_active FROM lineitem GROUP BY 1")
def fanout_telemetry(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", F.col("l_linenumber").alias("granted"), F.col("l_quantity").cast("long").alias("wait_ms"), F.col("l_partkey").alias("peak_active"))
    return O.merged(rows, ("granted", "wait_ms"), ("peak_active",), ("l_suppkey",))


@query("SELECT l_returnflag, name, CAST(sum(n) AS BIGINT) AS n FROM (SELECT l_returnflag, 'depth' AS name, l_linenumber AS n FROM lineitem UNION ALL SELECT l_returnflag, l_linestatus, 1 FROM lineitem) GROUP BY ALL")
def archive_telemetry(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", F.create_map(F.lit("depth"), "l_linenumber", "l_linestatus", F.lit(1)).alias("issues"))
    return O.merged_counts(rows, "issues", ("l_returnflag",))


REQUESTS = "(SELECT user_id AS request, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS attempt, CASE WHEN event_type = 'click' THEN 200 WHEN value > 30 THEN 503 WHEN value > 20 THEN 429 WHEN value > 10 THEN 404 END AS status FROM events)"


@query(f"""WITH r AS {REQUESTS}, l AS (SELECT request, arg_max(coalesce(status, -1), attempt) AS status FROM r GROUP BY request)
SELECT count(*) AS attempts, count(*) FILTER (attempt > 0) AS retries, (SELECT count(*) FROM l WHERE status BETWEEN 200 AND 399) AS succeeded, (SELECT count(*) FROM l WHERE status NOT BETWEEN 200 AND 399) AS failed, count(*) FILTER (status IS NULL) AS network_errors,
(SELECT array_to_string(list_sort(list(s || '=' || n)), ',') FROM (SELECT status AS s, count(*) AS n FROM r WHERE status IN (403, 404, 429, 500, 502, 503, 504) GROUP BY 1)) AS status_counts FROM r""")
def retry_metrics(spark, d):
    from pyspark.sql import Window as W

    e = table(spark, d, "events")
    status = F.when(F.col("event_type") == "click", 200).when(F.col("value") > 30, 503).when(F.col("value") > 20, 429).when(F.col("value") > 10, 404)
    rows = e.select(F.col("user_id").alias("request"), (F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1).cast("long").alias("attempt"), F.coalesce(status, F.lit(None).cast("int")).alias("status"))
    out = O.retry_metrics(rows)
    return out.withColumn("status_counts", F.array_join(F.transform(F.map_entries("status_counts"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ","))


@query("""SELECT o_orderkey, coalesce(s = 429 OR s BETWEEN 500 AND 599, false) AS standard, coalesce(s = 429, false) AS conservative, CAST(least(500 * pow(2, least(a, 30)), 30000) AS BIGINT) AS wait
FROM (SELECT o_orderkey, ([200, 404, 403, 429, 500, 502, 599, 418])[CAST(o_orderkey % 8 AS INTEGER) + 1] AS s, o_custkey % 12 AS a FROM orders)""")
def retry_classes(spark, d):
    status = F.get(F.array(*[F.lit(s) for s in (200, 404, 403, 429, 500, 502, 599, 418)]), (F.col("o_orderkey") % 8).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", O.should_retry(status).alias("standard"), O.should_retry(status, "conservative").alias("conservative"), O.longest_wait(F.col("o_custkey") % 12).alias("wait"))


@query("""WITH RECURSIVE p AS (SELECT w, count(*) AS n, count(*) FILTER (value <= 10) AS e, row_number() OVER (ORDER BY w) AS k FROM (SELECT event_id // 500 AS w, value FROM events) GROUP BY w),
r AS (SELECT w, k, n AS requests, e AS errors FROM p WHERE k = 1 UNION ALL SELECT p.w, p.k, p.n + CAST(floor(r.requests * 0.2) AS BIGINT), p.e + CAST(floor(r.errors * 0.2) AS BIGINT) FROM r JOIN p ON p.k = r.k + 1)
SELECT w AS "window", CAST(requests AS BIGINT) AS requests, CAST(errors AS BIGINT) AS errors FROM r""")
def decayed_errors(spark, d):
    rows = table(spark, d, "events").select(F.expr("event_id div 500").alias("window"), (F.col("value") > 10).alias("ok"))
    return O.decayed_errors(rows)


@query(f"WITH {PROBE_SQL} SELECT url, git_path, confidence, label FROM scored WHERE confidence >= 45")
def confident_probes(spark, d):
    return R.confident(R.score_probes(_probes(spark, d)))


# ---- ends, roll-ups and reports


@query(f"WITH {CONFIG_FINDINGS}, o AS (SELECT *, row_number() OVER (ORDER BY filename, line, pattern_id, match) AS n FROM findings) SELECT filename, line, pattern_id, severity FROM o WHERE n <= (SELECT min(n) FROM o WHERE severity = 'CRITICAL') AND n <= 40")
def until_critical(spark, d):
    return O.until(config_findings(spark, d), 40, True, ("filename", "line", "pattern_id", "match")).select("filename", "line", "pattern_id", "severity")


@query(f"WITH {CONFIG_FINDINGS} SELECT o_orderkey AS seq, filename AS target, n FROM (SELECT filename, count(*) AS n FROM findings GROUP BY 1) JOIN (SELECT o_orderkey, 'etc/' || o_orderkey || '.conf' AS filename FROM orders) USING (filename)")
def results_in_order(spark, d):
    targets = table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("etc/"), F.col("o_orderkey").cast("string"), F.lit(".conf")).alias("target"))
    results = config_findings(spark, d).groupBy(F.col("filename").alias("target")).agg(F.count("*").alias("n"))
    return O.in_input_order(results, targets).select("seq", "target", "n")


AI_IDS = ("openai_key", "anthropic_key", "ai_path_config", "aws_key_id", "huggingface_token", "ai_provider_env_key", "groq_key", "cohere_key")
AI_CASE = "CASE WHEN p = 'ai_provider_env_key' OR starts_with(p, 'openai') OR starts_with(p, 'anthropic') OR starts_with(p, 'huggingface') OR starts_with(p, 'cohere') OR starts_with(p, 'openrouter') OR starts_with(p, 'groq') THEN 'provider_key' WHEN starts_with(p, 'ai_path_') THEN p[9:] END"
AI_ROWS = f"(SELECT p_partkey, ({sql_list(AI_IDS)})[CAST(p_partkey % {len(AI_IDS)} AS INTEGER) + 1] AS p, (['CRITICAL', 'HIGH', 'MEDIUM', 'LOW'])[CAST(p_size % 4 AS INTEGER) + 1] AS s FROM part)"


def _ai_findings(spark, d):
    at = lambda values, k: F.get(F.array(*[F.lit(v) for v in values]), k.cast("int"))
    return table(spark, d, "part").select(
        F.concat(F.lit("src/"), "p_partkey").alias("filename"), F.lit(1).alias("line"), at(AI_IDS, F.col("p_partkey") % len(AI_IDS)).alias("pattern_id"), F.lit("d").alias("description"),
        at(("CRITICAL", "HIGH", "MEDIUM", "LOW"), F.col("p_size") % 4).alias("severity"), F.col("p_name").alias("match"), F.lit("c").alias("context"), F.lit(False).alias("is_deleted"), F.lit(None).cast("string").alias("commit_sha1"), F.lit(None).cast("string").alias("confidence_adjustment"),
    )


@query(f"SELECT ai_category, count(*) AS n FROM (SELECT {AI_CASE} AS ai_category FROM {AI_ROWS}) WHERE ai_category IS NOT NULL GROUP BY 1")
def ai_summary(spark, d):
    return U.ai_summary(_ai_findings(spark, d))


@query(f"""WITH r AS (SELECT s, {AI_CASE} AS ai FROM {AI_ROWS}), t AS (SELECT CAST(least(100, least(60, 20 * count(*) FILTER (s = 'CRITICAL')) + least(30, 10 * count(*) FILTER (s = 'HIGH')) + least(15, 5 * count(*) FILTER (s = 'MEDIUM'))) AS INTEGER) AS risk_score, count(*) AS secrets_total, count(ai) AS ai_findings_total,
count(*) FILTER (s = 'CRITICAL') AS critical, count(*) FILTER (s = 'HIGH') AS high, count(*) FILTER (s = 'MEDIUM') AS medium, count(*) FILTER (s = 'LOW') AS low FROM r)
SELECT risk_score, CASE WHEN risk_score >= 70 THEN 'CRITICAL' WHEN risk_score >= 40 THEN 'HIGH' WHEN risk_score >= 15 THEN 'MEDIUM' ELSE 'CLEAR' END AS risk_label, secrets_total, ai_findings_total, critical, high, medium, low,
(SELECT array_to_string(list_sort(list(ai || '=' || n)), ',') FROM (SELECT ai, count(*) AS n FROM r WHERE ai IS NOT NULL GROUP BY 1)) AS ai_counts FROM t""")
def report_summary(spark, d):
    r = K.result_summary(_ai_findings(spark, d))
    return r.select("risk_score", "risk_label", "secrets_total", "ai_findings_total", *[F.col(f"severity_counts.{s}").alias(s.lower()) for s in X.SEVERITIES], F.array_join(F.transform(F.map_entries("ai_category_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("ai_counts"))


def _html_sql(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"), ("=", "&#61;")):
        x = f"replace({x}, {q(a)}, {q(b)})"
    return x


def _markdown_sql(x: str) -> str:
    for a, b in (("\\", "\\\\"), ("|", "\\|"), ("`", "\\`"), ("[", "\\["), ("]", "\\]")):
        x = f"replace({x}, {q(a)}, {q(b)})"
    return f"replace(replace({x}, chr(10), ' '), chr(13), ' ')"


def _csv_sql(x: str) -> str:
    cut = f"trim({x}, ' ' || chr(9) || chr(10) || chr(13))"
    return f"""'"' || replace(CASE WHEN regexp_matches({cut}, '^[=+@-]') THEN '''' || {cut} ELSE {cut} END, '"', '""') || '"'"""


def _case(table_, other: str) -> str:
    return "CASE severity " + " ".join(f"WHEN {q(n)} THEN {q(v)}" for n, v in table_) + f" ELSE {q(other)} END"


@query(f"""WITH {CONFIG_FINDINGS} SELECT concat_ws(',', {_csv_sql('filename')}, CAST(line AS VARCHAR), {_csv_sql('severity')}, {_csv_sql('pattern_id')}, {_csv_sql('description')}, {_csv_sql('match')}, 'false', 'false', '""', '""') AS value FROM findings""")
def csv_report(spark, d):
    return K.csv_lines(config_findings(spark, d))


@query(f"""WITH {CONFIG_FINDINGS} SELECT '| ' || concat_ws(' | ', {_case(K.MARKS, "x")} || ' ' || severity, {_markdown_sql('pattern_id')}, {_markdown_sql('filename')}, CAST(line AS VARCHAR), chr(8212), '`' || {_markdown_sql('left(match, 60)')} || '`') || ' |' AS value FROM findings""")
def markdown_report(spark, d):
    return K.markdown_lines(config_findings(spark, d))


@query(f"""WITH {CONFIG_FINDINGS} SELECT '<tr><td style=''color:' || {_case(K.COLOURS, "#888888")} || '''>' || severity || '</td><td>' || concat_ws('</td><td>', {_html_sql('pattern_id')}, {_html_sql('filename')}, CAST(line AS VARCHAR), 'no') || '</td><td><code>' || {_html_sql('left(match, 80)')} || '</code></td></tr>' AS value FROM findings""")
def html_report(spark, d):
    return K.html_lines(config_findings(spark, d))


@query(f"""WITH {CONFIG_FINDINGS} SELECT json_extract_string(j, '$.ruleId') AS rule, json_extract_string(j, '$.level') AS level, json_extract_string(j, '$.locations[0].physicalLocation.artifactLocation.uri') AS uri, CAST(json_extract(j, '$.locations[0].physicalLocation.region.startLine') AS INTEGER) AS line, json_extract_string(j, '$.message.text') AS message
FROM (SELECT json_object('ruleId', pattern_id, 'level', CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 'error' WHEN severity = 'MEDIUM' THEN 'warning' ELSE 'note' END, 'message', json_object('text', description), 'locations', [json_object('physicalLocation', json_object('artifactLocation', json_object('uri', filename), 'region', json_object('startLine', line)))]) AS j FROM findings)""")
def sarif_report(spark, d):
    j = K.sarif_results(config_findings(spark, d))
    get = lambda path: F.get_json_object("value", path)
    return j.select(get("$.ruleId").alias("rule"), get("$.level").alias("level"), get("$.locations[0].physicalLocation.artifactLocation.uri").alias("uri"), get("$.locations[0].physicalLocation.region.startLine").cast("int").alias("line"), get("$.message.text").alias("message"))


@query(f"WITH {CONFIG_FINDINGS} SELECT filename AS file, line, pattern_id AS type, severity, left(match, 120) AS match, left(context, 200) AS context, confidence_adjustment AS why FROM findings")
def ndjson_report(spark, d):
    rows = K.ndjson_lines(config_findings(spark, d)).select(F.from_json("value", "file string, line int, type string, severity string, match string, context string, confidence_adjustment string").alias("j"))
    return rows.select("j.file", "j.line", "j.type", "j.severity", "j.match", "j.context", F.col("j.confidence_adjustment").alias("why"))


@query("SELECT s_suppkey AS seq, s_name AS target, CASE WHEN s_suppkey % 3 = 0 THEN 'failed' ELSE 'completed' END AS status, s_nationkey AS findings_count, CASE WHEN s_suppkey % 3 = 0 THEN 'scan_failed' END AS error_code FROM supplier")
def aggregate_report(spark, d):
    bad = F.col("s_suppkey") % 3 == 0
    outcomes = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("seq"), F.col("s_name").alias("target"), F.lit("URL").alias("target_type"), F.when(bad, "failed").otherwise("completed").alias("status"), F.lit(None).cast("string").alias("report_path"), F.col("s_nationkey").alias("findings_count"), F.lit(0).alias("risk_score"),
        F.when(bad, "scan_failed").alias("error_code"), F.lit(None).cast("string").alias("error"),
    )
    return K.aggregate_lines(outcomes).select("seq", F.from_json("value", "target string, status string, findings_count int, error_code string").alias("j")).select("seq", "j.*")


@query("""WITH s AS (SELECT s_suppkey AS k, md5(CAST(s_suppkey AS VARCHAR)) AS sha1, list_filter(['dir/' || s_name, CASE WHEN s_suppkey % 2 = 0 THEN '../up' ELSE 'b/' || s_suppkey END, CASE WHEN s_suppkey % 5 = 0 THEN '/abs' ELSE 'c/' || s_suppkey END], lambda x: s_suppkey % 7 <> 0 AND NOT starts_with(x, '/') AND NOT starts_with(x, '..')) AS ok FROM supplier),
a AS (SELECT sha1, CASE WHEN len(ok) > 0 THEN ok ELSE ['_unreferenced/' || left(sha1, 2) || '/' || sha1[3:]] END AS ok FROM s)
SELECT sha1, ok[i] AS path, CASE WHEN i > 1 THEN ok[1] END AS link_of FROM (SELECT sha1, ok, unnest(range(1, len(ok) + 1)) AS i FROM a)""")
def saved_paths(spark, d):
    s = table(spark, d, "supplier").withColumn("sha1", F.md5(F.col("s_suppkey").cast("string").cast("binary")))
    k = F.col("s_suppkey")
    paths = F.array(F.concat(F.lit("dir/"), "s_name"), F.when(k % 2 == 0, "../up").otherwise(F.concat(F.lit("b/"), k.cast("string"))), F.when(k % 5 == 0, "/abs").otherwise(F.concat(F.lit("c/"), k.cast("string"))))
    return K.saved_paths(s, s.filter(k % 7 != 0).select("sha1", paths.alias("paths")))


@query("SELECT sha1, max(n) AS n, max(created_at) AS created_at FROM (SELECT CAST(o_orderkey AS VARCHAR) AS sha1, 4 AS n, o_orderkey // 3 AS created_at FROM orders WHERE o_orderkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT CAST(c_custkey AS VARCHAR), strlen(c_name), 9000 FROM customer) WHERE created_at > 9000 - 8000 GROUP BY sha1")
def cache_put(spark, d):
    old = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("sha1"), F.encode(F.lit("old!"), "UTF-8").alias("content"), F.lit(4).cast("long").alias("size"), F.expr("o_orderkey div 3").alias("created_at"), F.lit("").alias("source_url"))
    new = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("sha1"), F.encode("c_name", "UTF-8").alias("content"))
    return R.cleanup(R.put(old, new, 9000), 9000, 8000).select("sha1", F.octet_length("content").alias("n"), "created_at")


# ---- repositories' files


@query(f"SELECT seq, path FROM (SELECT unnest(range({len(M.META_FILES)})) AS seq, unnest({sql_list(M.META_FILES)}) AS path) WHERE starts_with(path, 'refs/')")
def metadata_files(spark, d):
    return M.metadata_table(spark).filter(F.startswith("path", F.lit("refs/"))).select(F.col("seq").cast("long").alias("seq"), "path")


REFS_SQL = "SELECT CAST(c_nationkey AS VARCHAR) AS path, string_agg(md5(c_name) || chr(9) || CASE WHEN c_custkey % 3 = 0 THEN 'refs/tags/v' ELSE 'refs/heads/b' END || c_custkey || CASE WHEN c_custkey % 4 = 0 THEN chr(13) ELSE '' END, chr(10) ORDER BY c_custkey) AS text FROM customer GROUP BY 1"


def _info_refs(spark, d):
    c = table(spark, d, "customer")
    line = F.concat(F.md5(F.col("c_name").cast("binary")), F.lit("\t"), F.when(F.col("c_custkey") % 3 == 0, "refs/tags/v").otherwise("refs/heads/b"), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 4 == 0, "\r").otherwise(""))
    rows = c.groupBy(F.col("c_nationkey").cast("string").alias("path")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("l")))).alias("ls"))
    return rows.select("path", F.array_join(F.transform("ls", lambda x: x["l"]), "\n").alias("text"))


@query("SELECT CAST(c_nationkey AS VARCHAR) AS path, 'b' || c_custkey AS branch FROM customer WHERE c_custkey % 3 <> 0")
def listed_branches(spark, d):
    return M.branches(M.info_refs(_info_refs(spark, d)))


@query("SELECT c_nationkey, list(md5(c_name) || '00000000' ORDER BY c_custkey) AS packs FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1")
def listed_packs(spark, d):
    line = F.concat(F.when(F.col("c_custkey") % 2 == 0, "P pack-").otherwise("X pack-"), F.md5(F.col("c_name").cast("binary")), F.lit("00000000.pack"))
    rows = table(spark, d, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("l")))).alias("ls"))
    return rows.select("c_nationkey", M.pack_names(F.array_join(F.transform("ls", lambda x: x["l"]), "\n")).alias("packs")).filter(F.size("packs") > 0)


@query("SELECT CAST(s_nationkey AS VARCHAR) AS path, 'https://h/' || (s_suppkey % 4) AS url, min('submodule.m' || s_suppkey) AS section FROM supplier WHERE s_suppkey % 5 <> 0 GROUP BY 1, 2")
def submodule_urls(spark, d):
    part = F.concat(F.when(F.col("s_suppkey") % 5 == 0, '[remote "r').otherwise('[submodule "m'), F.col("s_suppkey").cast("string"), F.lit('"]\n\tpath = x\n\turl = https://h/'), (F.col("s_suppkey") % 4).cast("string"))
    rows = table(spark, d, "supplier").groupBy(F.col("s_nationkey").cast("string").alias("path")).agg(F.array_join(F.collect_list(part), "\n").alias("text"))
    return M.submodules(G.ini_entries(rows)).select("path", "url", "section")


@query("SELECT sha1('blob ' || strlen(c_name) || chr(0) || c_name) AS sha1, 'blob' AS kind, c_name AS data, CAST(c_custkey % 10 = 0 AS BOOLEAN) AS broken FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT NULL, NULL, NULL, true FROM customer WHERE c_custkey % 10 = 0")
def loose_objects(spark, d):
    """Each customer's name as a loose object, every tenth cut short."""

    def squeeze(batches):
        for batch in batches:
            out = []
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                packed = zlib.compress(bytes(raw))
                out.append(packed[: len(packed) // 2] if key % 10 == 0 else packed)
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(out, pa.binary())], names=["path", "content"])

    head = F.encode(F.concat(F.lit("blob "), F.octet_length("c_name").cast("string")), "UTF-8")
    sha = X.git_sha1(F.lit("blob"), F.encode("c_name", "UTF-8"))
    rows = table(spark, d, "customer").select("c_custkey", F.concat(head, F.lit(bytearray(b"\0")), F.encode("c_name", "UTF-8")).alias("raw"), F.concat(F.lit("objects/"), F.left(sha, F.lit(2)), F.lit("/"), F.substring(sha, 3, 38)).alias("path"))
    read = G.read_loose(rows.mapInArrow(squeeze, "path string, content binary"))
    return read.select("sha1", "kind", F.col("data").cast("string").alias("data"), F.col("error").isNotNull().alias("broken"))


@query("""SELECT sha1('tree' || o_orderkey) AS sha1, md5(CAST(o_orderkey AS VARCHAR)) || '00000000' AS tree, CASE WHEN o_orderkey % 3 = 0 THEN [md5('p' || o_orderkey) || '00000000'] ELSE CAST([] AS VARCHAR[]) END AS parents, 'A B' || o_custkey AS author, 'u' || o_custkey || '@h.org' AS author_email, CAST(o_orderkey AS BIGINT) AS author_ts, 'message ' || o_orderpriority || chr(10) || chr(10) || 'more' AS message FROM orders""")
def parsed_commits(spark, d):
    o = table(spark, d, "orders")
    text = F.concat(
        F.lit("tree "), F.md5(F.col("o_orderkey").cast("string").cast("binary")), F.lit("00000000\n"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("parent "), F.md5(F.concat(F.lit("p"), "o_orderkey").cast("binary")), F.lit("00000000\n"))).otherwise(""),
        F.lit("author A B"), F.col("o_custkey").cast("string"), F.lit(" <u"), F.col("o_custkey").cast("string"), F.lit("@h.org> "), F.col("o_orderkey").cast("string"), F.lit(" +0100\ncommitter X <x@y> 1 +0000\n\nmessage "), "o_orderpriority", F.lit("\n\nmore\n"),
    )
    objects = o.select(F.sha1(F.concat(F.lit("tree"), "o_orderkey").cast("binary")).alias("sha1"), F.encode(text, "UTF-8").alias("data"))
    return G.commits(objects)


@query("SELECT CAST(c_nationkey AS VARCHAR) AS tree, CASE WHEN c_custkey % 4 = 0 THEN '40000' ELSE '100644' END AS mode, 'n' || c_custkey AS name, md5(c_name) || '00000000' AS sha1 FROM customer")
def tree_entries(spark, d):
    entry = F.concat(F.encode(F.concat(F.when(F.col("c_custkey") % 4 == 0, "40000").otherwise("100644"), F.lit(" n"), F.col("c_custkey").cast("string")), "UTF-8"), F.lit(bytearray(b"\0")), F.unhex(F.concat(F.md5(F.col("c_name").cast("binary")), F.lit("00000000"))))
    trees = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("string").alias("sha1")).agg(F.unhex(F.array_join(F.transform(F.collect_list(entry), F.hex), "")).alias("data"))
    return G.read_trees(trees).select("tree", "mode", "name", "sha1")


@query("""SELECT CAST(o.o_orderkey AS VARCHAR) AS commit, 0 AS depth, 'd' || (l_partkey % 9) || '/f' || l_linenumber AS path, l.l_orderkey || '.' || l.l_linenumber AS sha1 FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey""")
def commit_files(spark, d):
    """Every order as a head commit whose tree has a directory for each of its lines."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    key = F.col("l_orderkey").cast("string")
    commits = o.select(F.col("o_orderkey").cast("string").alias("sha1"), F.concat(F.lit("t"), "o_orderkey").alias("tree"), F.array().cast("array<string>").alias("parents"))
    folder = F.concat(F.lit("t"), key, F.lit("/"), (F.col("l_partkey") % 9).cast("string"))
    top = li.select(F.concat(F.lit("t"), key).alias("tree"), F.lit("40000").alias("mode"), F.concat(F.lit("d"), (F.col("l_partkey") % 9).cast("string")).alias("name"), folder.alias("sha1")).distinct()
    inner = li.select(folder.alias("tree"), F.lit("100644").alias("mode"), F.concat(F.lit("f"), "l_linenumber").alias("name"), F.concat(key, F.lit("."), F.col("l_linenumber").cast("string")).alias("sha1"))
    return R.commit_files(commits, top.union(inner), commits).select("commit", "depth", "path", "sha1")


MESSAGES_SQL = "files AS (SELECT '[commit:' || left(md5(CAST(conv_id * 1000 + turn AS VARCHAR)), 8) || ':message]' AS filename, text || chr(10) || 'token = \"' || md5(text) || '\"' AS text FROM conversations WHERE text <> '')"


@query(f"WITH {findings_sql(MESSAGES_SQL, (), 3.5)} SELECT filename, line, pattern_id, severity, match FROM findings")
def commit_message_findings(spark, d):
    rows = table(spark, d, "conversations").select(F.md5(F.expr("cast(conv_id * 1000 + turn as string)").cast("binary")).alias("sha1"), F.when(F.col("text") != "", F.concat("text", F.lit('\ntoken = "'), F.md5(F.col("text").cast("binary")), F.lit('"'))).alias("message"))
    return L.detect_lines(R.commit_messages(rows), POLICY).select("filename", "line", "pattern_id", "severity", "match")


# ---- exported provider pages


@query("SELECT 'g' || s_nationkey || '/' || s_name AS full_name, 'g' || s_nationkey AS owner, s_name AS name, s_suppkey % 2 = 0 AS private, CASE WHEN s_suppkey % 3 = 0 THEN 'main' ELSE 'dev' END AS default_branch, 'https://h/' || s_suppkey AS clone_url FROM supplier")
def gitlab_repositories(spark, d):
    s = table(spark, d, "supplier")
    one = F.struct(F.concat(F.lit("g"), "s_nationkey", F.lit("/"), "s_name").alias("path_with_namespace"), F.when(F.col("s_suppkey") % 2 == 0, "internal").otherwise("public").alias("visibility"), F.when(F.col("s_suppkey") % 3 != 0, "dev").alias("default_branch"), F.concat(F.lit("https://h/"), "s_suppkey").alias("http_url_to_repo"))
    pages = s.groupBy((F.col("s_suppkey") % 10).cast("int").alias("page")).agg(F.to_json(F.collect_list(one)).alias("body"))
    return V.provider_repositories(pages.union(pages.withColumn("page", F.col("page") + 100)), "gitlab")


@query("SELECT 'w/' || s_name AS full_name, CASE WHEN s_suppkey % 2 = 0 THEN 'me' ELSE 'w' END AS owner, s_name AS name, s_suppkey % 3 = 0 AS private, 'b' || s_nationkey AS default_branch, 'https://h/' || s_suppkey AS clone_url FROM supplier")
def bitbucket_repositories(spark, d):
    link = lambda name, url: F.struct(url.alias("href"), F.lit(name).alias("name"))
    k = F.col("s_suppkey")
    one = F.struct(F.concat(F.lit("w/"), "s_name").alias("full_name"), F.col("s_name").alias("slug"), F.when(k % 2 == 0, F.struct(F.lit("me").alias("username"))).alias("owner"), (k % 3 == 0).alias("is_private"), F.struct(F.concat(F.lit("b"), "s_nationkey").alias("name")).alias("mainbranch"), F.struct(F.array(link("ssh", F.lit("git@h")), link("https", F.concat(F.lit("https://h/"), k.cast("string")))).alias("clone")).alias("links"))
    pages = table(spark, d, "supplier").groupBy((k % 4).cast("int").alias("page")).agg(F.to_json(F.struct(F.collect_list(one).alias("values"), F.lit("").alias("next"))).alias("body"))
    return V.provider_repositories(pages, "bitbucket")


@query("SELECT 'id' || s_suppkey AS full_name, 'proj' || (s_nationkey % 3) AS owner, s_name AS name, s_suppkey % 3 <> 1 AS private, 'main' AS default_branch, CASE WHEN s_suppkey % 2 = 0 THEN 'r' ELSE 'w' END || s_suppkey AS clone_url FROM supplier")
def azure_repositories(spark, d):
    k = F.col("s_suppkey")
    one = F.struct(F.concat(F.lit("id"), k.cast("string")).alias("id"), F.col("s_name").alias("name"), F.when(k % 3 != 0, F.struct(F.when(k % 3 == 1, "public").otherwise("organization").alias("visibility"))).alias("project"), F.when(k % 2 == 0, F.concat(F.lit("r"), k.cast("string"))).alias("remoteUrl"), F.concat(F.lit("w"), k.cast("string")).alias("webUrl"))
    pages = table(spark, d, "supplier").groupBy((F.col("s_nationkey") % 3).cast("int").alias("page")).agg(F.to_json(F.struct(F.collect_list(one).alias("value"))).alias("body"))
    return V.provider_repositories(pages.withColumn("project", F.concat(F.lit("proj"), "page")), "azure")


@query("SELECT CAST(l_orderkey AS VARCHAR) AS commit_sha, CASE WHEN l_returnflag = 'R' THEN 'o' ELSE 'n' END || l_partkey AS path, CASE l_returnflag WHEN 'R' THEN 'removed' WHEN 'A' THEN 'renamed' ELSE CASE WHEN l_linestatus = 'O' THEN 'added' ELSE 'modified' END END AS status, CASE WHEN l_returnflag = 'A' THEN 'o' || l_partkey END AS previous_path FROM lineitem")
def gitlab_changes(spark, d):
    flag = F.col("l_returnflag")
    one = F.struct(F.concat(F.lit("o"), "l_partkey").alias("old_path"), F.concat(F.lit("n"), "l_partkey").alias("new_path"), (flag == "R").alias("deleted_file"), (flag == "A").alias("renamed_file"), (F.col("l_linestatus") == "O").alias("new_file"))
    return V.change_pages(table(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("commit_sha")).agg(F.to_json(F.collect_list(one)).alias("body")))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 3 WHEN c_custkey % 3 = 0 THEN 7 END AS next, CASE WHEN c_custkey % 4 <> 0 THEN 'https://h?p=' || c_custkey END AS url FROM customer")
def next_pages(spark, d):
    k = F.col("c_custkey")
    header = F.when(k % 5 == 0, " 3 ").when(k % 7 == 0, "1").otherwise("")
    link = F.when(k % 3 == 0, '<https://h/p?per=2&page=7>; rel="next"').otherwise('<https://h/p?page=9>; rel="prev"')
    body = F.to_json(F.struct(F.when(k % 4 != 0, F.concat(F.lit("https://h?p="), k.cast("string"))).otherwise("").alias("next")))
    return table(spark, d, "customer").select("c_custkey", V.next_page(header, link, F.lit(2)).alias("next"), V.next_url(body).alias("url"))


# ---- binaries

KEYS_SQL = "'AKIA' || upper(substr(md5(c_name), 1, 16))"
KIND_SQL = "(['zip', 'elf', 'gzip', 'binary'])[CAST(c_custkey % 4 AS INTEGER) + 1]"
ID_SQL = "(['aws_key_id', 'own', 'unheard_of'])[CAST(c_custkey % 3 AS INTEGER) + 1]"
BINARY_CONTEXTS = ("Binary: lib.so", "Binary: test/example.bin", "ZIP: sample.zip", "Binary: my-demo", "Binary: plain")
BINARY_SQL = f"""(SELECT c_custkey, 'f' || c_custkey AS filename, {KIND_SQL} AS kind, {ID_SQL} AS pattern_id, CASE WHEN c_custkey % 11 = 0 THEN 'example_key' ELSE {KEYS_SQL} END AS match, ({sql_list(BINARY_CONTEXTS)})[CAST(c_custkey % {len(BINARY_CONTEXTS)} AS INTEGER) + 1] AS context FROM customer)"""


@query(f"""WITH b AS (SELECT *, list_filter({sql_list(CONTEXT_KEYWORDS)}, lambda w: contains(lower(context), lower(w))) AS kw FROM {BINARY_SQL} WHERE NOT {placeholder_sql('match')}),
r AS (SELECT *, CASE WHEN kind IN ('zip', 'elf') OR len(kw) = 0 THEN NULL WHEN len(kw) = 1 THEN 'possible placeholder: ''' || kw[1] || ''' in binary string' ELSE 'likely placeholder: 2+ keywords in binary string' END AS why,
 CASE pattern_id WHEN 'aws_key_id' THEN 'CRITICAL' WHEN 'own' THEN 'MEDIUM' ELSE 'HIGH' END AS s FROM b)
SELECT filename, pattern_id, CASE pattern_id WHEN 'aws_key_id' THEN 'AWS Access Key ID' WHEN 'own' THEN 'Own words' ELSE CASE kind WHEN 'zip' THEN 'ZIP Secret' WHEN 'elf' THEN 'ELF Secret' WHEN 'gzip' THEN 'GZIP Secret' ELSE 'Binary Secret' END END AS description,
CASE WHEN why IS NULL THEN s WHEN s = 'CRITICAL' THEN 'HIGH' WHEN s = 'HIGH' THEN 'MEDIUM' ELSE 'LOW' END AS severity, match, why AS confidence_adjustment FROM r""")
def repository_binary_findings(spark, d):
    k = F.col("c_custkey")
    at = lambda values: F.get(F.array(*[F.lit(v) for v in values]), (k % len(values)).cast("int"))
    key = F.concat(F.lit("AKIA"), F.upper(F.substring(F.md5(F.col("c_name").cast("binary")), 1, 16)))
    rows = table(spark, d, "customer").select(F.concat(F.lit("f"), k.cast("string")).alias("filename"), at(("zip", "elf", "gzip", "binary")).alias("kind"), at(("aws_key_id", "own", "unheard_of")).alias("pattern_id"), F.when(k % 11 == 0, "example_key").otherwise(key).alias("match"), at(BINARY_CONTEXTS).alias("context"))
    scanned = rows.select("filename", F.array(F.struct("pattern_id", "match", "context")).alias("findings"))
    objects = rows.select("filename", F.lit("s").alias("sha1"), F.lit(False).alias("is_deleted"), "kind")
    found = B.repository_findings(scanned, objects, custom=(("own", "MEDIUM", "Own words", "x"),))
    return found.select("filename", "pattern_id", "description", "severity", "match", "confidence_adjustment")


@query(f"SELECT 'a' || c_custkey || '.zip' AS filename, 'aws_key_id' AS pattern_id, {KEYS_SQL} AS match FROM customer WHERE c_custkey % 3 <> 0 AND regexp_matches({KEYS_SQL}, '^AKIA[A-Z0-9]{{16}}$')")
def archive_findings(spark, d):
    """Each customer's key in an entry of an archive; every third archive is damaged."""

    def packed(batches):
        for batch in batches:
            out = []
            for key, name in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("in.txt", f"key {name} end")
                    z.writestr("../up.txt", f"key {name} end")
                out.append(buffer.getvalue()[:20] if key % 3 == 0 else buffer.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.binary())], names=["filename", "content"])

    key = F.concat(F.lit("AKIA"), F.upper(F.substring(F.md5(F.col("c_name").cast("binary")), 1, 16)))
    files = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("a"), F.col("c_custkey").cast("string"), F.lit(".zip")).alias("filename"), key.alias("key")).mapInArrow(packed, "filename string, content binary")
    return B.binary_findings(B.scan_binaries(files)).select("filename", "pattern_id", "match")


@query("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'sqlite' WHEN 1 THEN 'zip' WHEN 2 THEN 'gzip' WHEN 3 THEN 'text' ELSE 'binary' END AS kind, CASE c_custkey % 5 WHEN 0 THEN 'magic' WHEN 1 THEN 'extension' WHEN 2 THEN 'magic' ELSE 'content' END AS confidence FROM customer")
def binary_kinds(spark, d):
    k = F.col("c_custkey")
    heads = F.array(F.lit(bytearray(b"SQLite format 3\0")), F.lit(bytearray(b"??")), F.lit(bytearray(b"\x1f\x8b")), F.lit(bytearray(b"a" + b"\0" * 10)), F.lit(bytearray(b"a" + b"\0" * 11)))
    rows = table(spark, d, "customer").select("c_custkey", F.concat(F.get(heads, (k % 5).cast("int")), F.encode("c_name", "UTF-8")).alias("content"), F.concat(F.lit("f."), F.when(k % 5 == 1, "JAR").otherwise("txt")).alias("path"))
    return rows.select("c_custkey", B.content_kind(F.col("content"), F.col("path")).alias("k")).select("c_custkey", "k.*")


# ---- whole-text detectors: the SQL runs the same regexes over the same texts

# A § stands for a single quote, which the two dialects escape differently.
BLOCK_TEXTS = (
    "concat('x', chr(10), '-----BEGIN RSA PRIVATE ', 'KEY-----', chr(10), m, chr(10), '-----END RSA PRIVATE ', 'KEY-----')",
    "concat('{\"db\": {\"a\": 1, \"pass', 'word\": \"', substr(m, 1, 12), '\"}}', chr(10), '# remark')",
    "concat('conf: |', chr(10), 'my_token: ', m, chr(10), 'x')",
    "concat(chr(10), 'API_TOKEN = §§§', substr(m, 1, 20), '§§§', chr(10), '// test')",
    "concat('a', chr(10), 'DB_PASSWORD = <<~EOS', chr(10), '  ', substr(m, 1, 20), chr(10), 'EOS')",
    "concat('return [', chr(10), '§AUTH_KEY§ => §', substr(m, 1, 20), '§,', chr(10), '§APP_SECRET§ => §example', substr(m, 1, 5), '§]')",
    "concat('D = {', chr(10), '§PASSWORD§: §', substr(m, 1, 10), '§}')",
    "concat('SECRET_KEY = \"', m, '\"', chr(10), 'more')",
    "concat('import os', chr(10), 'SECRET_KEY = os.environ.get(§N', substr(m, 1, 4), '§)')",
    "concat('# sample', chr(10), 'DATABASE_URL=mysql://u:', substr(m, 1, 8), '@h/d')",
    "concat('db: { password: §', substr(m, 1, 8), '§ }')",
    "concat('APP_KEY=base64:', m, '====')",
    "concat('DB_', 'HOST=\"', substr(m, 1, 9), '\"', chr(10), chr(10), 'DB_', 'PASSWORD = §', substr(m, 1, 14), '§')",
    "concat('package x', chr(10), 'type Conf', upper(substr(m, 1, 2)), ' struct {', chr(10), ' Password string', chr(10), '}')",
    "concat('u: postgres://a:', substr(m, 1, 9), '@h', chr(10), 'v: redis://b:', substr(m, 3, 9), '@h/1')",
    "concat('plain ', m)",
)


def _block_sql() -> str:
    kinds = " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(BLOCK_TEXTS)).replace("§", "''")
    parts = []
    for rank, b in enumerate(BLOCKS):
        groups = max(b.value, 1 if "{1}" in b.description + b.context + b.match else 0, 2 if "{2}" in b.description else 0)
        found = ", ".join(f"regexp_extract_all(text, {q(b.regex)}, {g}) AS g{g}" for g in range(groups + 1))
        picked = ", ".join(f"g{g}[i] AS v{g}" for g in range(groups + 1))

        def worded(x: str) -> str:
            out = "''"
            rest = x
            while "{" in rest:
                before, rest = rest.split("{", 1)
                name, rest = rest.split("}", 1)
                out += f" || {q(before)} || " + ("CAST(len(string_split(v0, chr(10))) AS VARCHAR)" if name == "lines" else f"v{name}")
            return f"{out} || {q(rest)}"

        value = f"v{b.value}"
        tests = []
        if b.drop_placeholders:
            tests.append(f"NOT {placeholder_sql(value)}")
        measured = f"trim(regexp_replace({value}, '(?s)^[^:]*:', ''))" if b.pattern_id == "yaml_block_scalar_secret" else value
        if b.pattern_id == "yaml_block_scalar_secret":
            tests.append(f"regexp_matches(lower({value}), 'akia|aws_|secret|password|token|credential|access_key|api_key')")
        if b.least_entropy:
            tests.append(f"{entropy_sql(measured)} >= {b.least_entropy}")
        # a scan of the whole text, so positions come from the pieces between the matches
        config = "regexp_matches(text, 'PASSWORD|SECRET_KEY|DATABASE_URL|password|APP_KEY|DB_|Password|://')" if b.config_gate else "true"
        parts.append(f"""SELECT filename, text, {rank} AS rank, {q(b.pattern_id)} AS pattern_id, {q(b.severity)} AS s0, {str(b.adjust).lower()} AS adjust, {worded(b.description)} AS description, {worded(b.match) if b.match else f'left({value}, 100)'} AS match, {worded(b.context)} AS context,
 array_to_string(list_transform(range(1, CAST(i AS BIGINT) + 1), lambda j: gaps[j] || CASE WHEN j < i THEN g0[j] ELSE '' END), '') AS pre FROM (SELECT filename, text, gaps, g0, i, {picked} FROM (SELECT *, unnest(range(1, len(g0) + 1)) AS i FROM (SELECT filename, text, string_split_regex(text, {q(b.regex)}) AS gaps, {found} FROM y WHERE {config})))
 {'WHERE ' + ' AND '.join(tests) if tests else ''}""")
    marks = " OR ".join(f"contains(win, {q(m)})" for m in X.COMMENT_MARKS)
    return f"""WITH y AS (SELECT CAST(c_custkey AS VARCHAR) AS filename, CASE c_custkey % {len(BLOCK_TEXTS)} {kinds} END AS text FROM (SELECT c_custkey, md5(c_name) AS m FROM customer)),
f AS ({' UNION ALL '.join(parts)}),
l AS (SELECT *, len(pre) - len(replace(pre, chr(10), '')) + CASE WHEN pre <> '' AND NOT ends_with(pre, chr(10)) THEN 1 ELSE 0 END + 1 AS line, string_split(text, chr(10)) AS ls FROM f),
w AS (SELECT *, array_to_string(ls[greatest(line - 3, 1):line + 3], ' ') AS win FROM l),
k AS (SELECT *, list_filter({sql_list(CONTEXT_KEYWORDS)}, lambda x: contains(lower(win), lower(x))) AS kw, ({marks}) AS note FROM w),
r AS (SELECT *, CASE WHEN NOT adjust THEN NULL WHEN len(kw) >= 2 AND note THEN 'likely placeholder: 2+ keywords + comment' WHEN len(kw) >= 2 THEN 'likely placeholder: 2+ keywords found'
 WHEN len(kw) = 1 AND note THEN 'possible placeholder: ''' || kw[1] || ''' + comment' WHEN len(kw) = 1 THEN 'possible placeholder: ''' || kw[1] || ''' found nearby' WHEN note THEN 'context: comment only (reduced confidence)' END AS why FROM k)
SELECT filename, CAST(line AS INTEGER) AS line, pattern_id, description, CASE WHEN why IS NULL THEN s0 WHEN s0 = 'CRITICAL' THEN 'HIGH' WHEN s0 = 'HIGH' THEN 'MEDIUM' ELSE 'LOW' END AS severity, match, context, why AS confidence_adjustment FROM r"""


@query(_block_sql())
def every_block_finding(spark, d):
    kinds = " ".join(f"WHEN {i} THEN {e.replace('chr(', 'char(')}" for i, e in enumerate(BLOCK_TEXTS)).replace("§", "\\'")
    rows = table(spark, d, "customer").withColumn("m", F.md5(F.col("c_name").cast("binary"))).withColumn("text", F.expr(f"CASE c_custkey % {len(BLOCK_TEXTS)} {kinds} END"))
    found = detect_blocks(as_files(rows, F.col("c_custkey").cast("string")))
    return found.select("filename", "line", "pattern_id", "description", "severity", "match", "context", "confidence_adjustment")
