import hashlib

import pytest
from pyspark.sql import functions as F

from quillsieve.functions import text as X
from quillsieve.functions.gates import required
from quillsieve.patterns import LINE_PATTERNS
from quillsieve.plans.queries import ORACLES, QUERIES
from quillsieve.plans.scan import scan_text
from quillsieve.policy import ScanPolicy
from quillsieve.schemas import FILES
from quillsieve.streaming.scan import fingerprint, start_scan

H = hashlib.sha256(b"seed").hexdigest()


def files(spark, rows):
    return spark.createDataFrame([(n, t, False, None) for n, t in rows], FILES)


def positive(items, out=""):
    """A text that a parsed regex matches: literals, first branches, least repeats."""
    from re import _constants as c

    for op, arg in items:
        if op is c.LITERAL:
            out += chr(arg)
        elif op is c.NOT_LITERAL:
            out += "a"
        elif op is c.ANY:
            out += "x"
        elif op is c.IN:
            kinds = [x for x in arg if x[0] is not c.NEGATE]
            if arg[0][0] is c.NEGATE:
                out += next(ch for ch in "aZ0_" if not any(x == (c.LITERAL, ord(ch)) for x in kinds))
            elif kinds[0][0] is c.RANGE:
                out += chr(kinds[0][1][0] + len(out) % 6 if kinds[0][1][1] - kinds[0][1][0] > 6 else kinds[0][1][0])
            elif kinds[0][0] is c.CATEGORY:
                out += " " if "SPACE" in str(kinds[0][1]) else "3"
            else:
                out += chr(kinds[0][1])
        elif op is c.SUBPATTERN:
            out = positive(arg[3], out)
        elif op is c.BRANCH:
            out = positive(arg[1][0], out)
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT):
            for _ in range(arg[0]):
                out = positive(arg[2], out)
    return out


def test_each_line_pattern_finds_a_generated_positive(spark):
    from re import _parser as parser

    rows = [(pid, positive(parser.parse(regex.removeprefix("(?i)")))) for pid, _, _, regex in LINE_PATTERNS]
    got = scan_text(files(spark, rows), ScanPolicy(exhaustive=True)).select("filename", "pattern_id").distinct().collect()
    found = {r["filename"] for r in got if r["filename"] == r["pattern_id"]}
    assert {pid for pid, _ in rows} - found == set()


def test_gates_are_part_of_every_match():
    from re import _parser as parser

    for _, _, _, regex in LINE_PATTERNS:
        words, exact = required(regex)
        line = positive(parser.parse(regex.removeprefix("(?i)")))
        assert not words or any(w in (line if exact else line.lower()) for w in words)


CASES = [
    ("pem_key_multiline", "x\n-----BEGIN RSA PRIVATE " + "KEY-----\nabc\n-----END RSA PRIVATE " + "KEY-----", "CRITICAL", 2),
    ("json_nested_secret", '{"db": {"a": 1, "pass' + f'word": "{H[:12]}"}}}}', "HIGH", 2),
    ("python_multiline_secret", f"\nAPI_TOKEN = '''{H[:20]}'''", "HIGH", 2),
    ("ruby_heredoc_secret", f"DB_PASSWORD = <<~EOS\n  {H[:20]}\nEOS", "MEDIUM", 1),
    ("php_multiline_secret", f"'AUTH_KEY' => '{H[:20]}'", "HIGH", 1),
    ("django_db_password", f"'PASSWORD': '{H[:10]}'", "HIGH", 1),
    ("django_env_secret_key", "SECRET_KEY = os.environ.get('NAME')", "HIGH", 1),
    ("ruby_database_url", f"DATABASE_URL=mysql://u:{H[:8]}@h/d", "HIGH", 1),
    ("ruby_config_password", f"db: {{ password: '{H[:8]}' }}", "HIGH", 2),
    ("php_laravel_app_key", f"APP_KEY=base64:{H[:40]}", "CRITICAL", 1),
    ("go_config_password_struct", "type Conf struct {\n Password string\n}", "MEDIUM", 1),
    ("yaml_inline_secret", f"api_token: {H[:24]}", "HIGH", 1),
    ("yaml_anchor_secret", f"auth_key: &base\n  {H[:20]}", "HIGH", 1),
]


@pytest.fixture(scope="module")
def scanned(spark):
    rows = scan_text(files(spark, [(f"{i}.txt", t) for i, (_, t, _, _) in enumerate(CASES)])).collect()
    return {(r["filename"], r["pattern_id"]): r for r in rows}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_block_detectors(scanned, i):
    pid, _, severity, line = CASES[i]
    row = scanned.get((f"{i}.txt", pid))
    assert row and row["severity"] == severity and row["line"] in (line, 1)


def test_minified_lines_and_limits(spark):
    key = "AKIA" + H[:16].upper()
    long_ = "a" * 1500 + ";" + "b" * 800 + f';k="{key}";' + "c=2;" * 250 + f'late="{key[::-1]}";' 
    got = scan_text(files(spark, [("a.js", long_), ("a.txt", long_), ("b.js", "x" * 60_000), ("c", None), ("d", "")])).collect()
    assert [(r["filename"], r["match"], r["context"][:10]) for r in got if r["pattern_id"] == "aws_key_id"] == [("a.js", key, "[minified]")]


def test_exhaustive_holds_all_that_normal_finds(spark):
    rows = [("a", f'token = "example_{H[:20]}"\nsecret = "{H}"\nkey: "static/x.js"'), ("b.yml", f"revalidate: {H[:30]}\npassword:\n  {H[:12]}")]
    find = lambda p: {(r["filename"], r["pattern_id"], r["match"]) for r in scan_text(files(spark, rows), p).collect()}
    normal, wide = find(ScanPolicy(entropy_threshold=3.0)), find(ScanPolicy(entropy_threshold=3.0, exhaustive=True))
    assert normal < wide


def test_custom_patterns(spark):
    got = scan_text(files(spark, [("a", "id CUST-0042 and CUST-0043")]), custom=(("own", "LOW", "Own", r"CUST-\d{4}"),)).collect()
    assert [r["match"] for r in got if r["pattern_id"] == "own"] == ["CUST-0042", "CUST-0043"]


def test_line_rules(spark):
    df = spark.createDataFrame([("a\r\nb\n",), ("a\n\nb",), ("",), ("\n",)], "t string")
    assert [r[0] for r in df.select(X.lines_of(F.col("t"))).collect()] == [["a", "b"], ["a", "", "b"], [], [""]]
    e = spark.createDataFrame([("aaaa",), ("abc",), ("abcd",)], "t string").select(X.entropy(F.col("t"))).collect()
    assert [r[0] for r in e] == [0.0, 0.0, 2.0]
    n = spark.createDataFrame([("ab\ncd", 0), ("ab\ncd", 1), ("ab\ncd", 3), ("ab\ncd", 4)], "t string, o int").select(X.line_number(F.col("t"), F.col("o"))).collect()
    assert [r[0] for r in n] == [1, 2, 2, 3]


def test_stream_resumes_and_equals_batch(spark, tmp_path):
    source, target, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    key = "AKIA" + H[:16].upper()
    one = files(spark, [("a", f"k {key}"), ("b", None)])
    one.write.parquet(source)
    start_scan(spark, source, target, marks).awaitTermination()
    start_scan(spark, source, target, marks).awaitTermination()
    two = files(spark, [("c", f"j {key}")])
    two.write.mode("append").parquet(source)
    start_scan(spark, source, target, marks).awaitTermination()
    done = spark.read.parquet(f"{target}/findings")
    want = scan_text(one.union(two))
    columns = want.columns
    assert sorted(map(str, done.select(columns).collect())) == sorted(map(str, want.collect())) and done.count() == 2
    assert {(r["filename"], r["outcome"]) for r in spark.read.parquet(f"{target}/outcomes").collect()} == {("a", "scanned"), ("b", "failed"), ("c", "scanned")}
    assert fingerprint(ScanPolicy()) != fingerprint(ScanPolicy(exhaustive=True))


def test_every_query_has_its_sql():
    assert set(ORACLES) == set(QUERIES)
