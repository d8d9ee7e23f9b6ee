"""Prefix folds, cuts, gates and detectors on long texts."""

import hashlib
import itertools
import re
import time

from pyspark.sql import functions as F

from quillsieve.functions import text as X
from quillsieve.functions.gates import may_match, pattern_table, required
from quillsieve.patterns import LINE_PATTERNS
from quillsieve.plans.scan import scan_text
from quillsieve.schemas import FILES

H = hashlib.sha256(b"seed").hexdigest()


def files(spark, rows):
    return spark.createDataFrame([(n, t, False, None) for n, t in rows], FILES)


def test_prefix_folds(spark):
    rows = [list(range(n)) for n in (0, 1, 2, 31, 32, 33, 64, 1000, 1025)] + [None]
    df = spark.createDataFrame([(r,) for r in rows], "v array<long>")
    zero = F.lit(0).cast("long")
    got = df.select(X.running(F.col("v"), lambda a, x: a + x, zero).alias("s"), X.running(F.col("v"), F.greatest, F.lit(-1).cast("long")).alias("m")).collect()
    for v, r in zip(rows, got):
        if v is not None:
            assert r["s"] == [0, *itertools.accumulate(v)][: len(v)] and r["m"] == [max(v[:i], default=-1) for i in range(len(v))]


def test_cuts_by_code_points(spark):
    text = "".join(chr(0x1F600 + k % 50) if k % 7 == 0 else chr(97 + k % 26) for k in range(10_000))
    spots = [(0, 0), (0, 5), (4090, 4100), (4096, 4096), (4096, 8192), (0, 10_000), (9_999, 10_000), (10_000, 10_000)]
    df = spark.createDataFrame([(text, a, b) for a, b in spots], "t string, a long, b long")
    assert [r[0] for r in df.select(X.cut_out(X.pieces_of(F.col("t")), F.col("a"), F.col("b"))).collect()] == [text[a:b] for a, b in spots]


def test_gates_read_regexes():
    assert required(r"(?:sk|pk)_(live|test)_[0-9]{3}") == (("pk_live_", "pk_test_", "sk_live_", "sk_test_"), True)
    assert required(r"(?i)Db[_\-]?(pass(word)?|pwd)\s*=") == (("pass", "pwd"), False)
    assert required(r"[0-9]{4}") == ((), True) and required(r"a(?=b)c") == ((), True) and required(r"x{2,3}|(y") == ((), True)
    assert required(r"(?P<k>abc)+d*") == (("abc",), True) and required(r"https?://h")[0] == ("http://h", "https://h")
    for _, _, _, regex in LINE_PATTERNS:
        assert required(regex)[0], regex


def test_gates_fold_case_as_the_regex_does(spark):
    table = pattern_table([("p", "LOW", "d", r"(?i)secret=\d+")], X.java_regex)
    from quillsieve.functions.gates import lowered

    df = spark.createDataFrame([("SECRET=1",), ("ſecret=1",), ("secre=1",), (None,)], "t string")
    assert [r[0] for r in df.select(F.exists(table, lambda p: may_match(p, F.col("t"), lowered(F.col("t"))))).collect()] == [True, True, False, None]


def test_negatives_of_the_line_patterns(spark):
    """A generated match without its last character, inside a word, or of one character less than wanted is none."""
    from test_detectors import positive

    from re import _parser as parser

    rows = []
    for pid, _, _, regex in LINE_PATTERNS:
        made = positive(parser.parse(regex.removeprefix("(?i)")))
        for n, bad in enumerate((made[:-1], f"x{made}x" if regex.startswith(r"\b") and regex.endswith(r"\b") else "", made[1:])):
            if bad and not re.search(regex, bad):
                rows.append((f"{pid}#{n}", bad))
    got = {(r["filename"].split("#")[0], r["pattern_id"]) for r in scan_text(files(spark, rows)).collect()}
    assert len(rows) > 200 and not {(p, q) for p, q in got if p == q}


def test_many_matches_take_nearly_linear_time(spark):
    took = []
    for n in (2000, 8000):
        urls = "\n".join(f"u: postgres://a{k}:{H[k % 40 : k % 40 + 9]}@h" for k in range(n))
        yaml = "\n".join(f"secret_key: >\n  {H[k % 30 : k % 30 + 20]}" for k in range(n))
        began = time.time()
        found = scan_text(files(spark, [("a.txt", urls), ("b.yml", yaml)])).groupBy("pattern_id").count().collect()
        took.append(time.time() - began)
        counts = {r["pattern_id"]: r["count"] for r in found}
        assert counts["db_url_password"] == n and counts["yaml_block_scalar_secret"] >= n
    assert took[1] < 8 * took[0] + 4


def test_scans_read_their_input_once(spark, tmp_path):
    files(spark, [("a", "x")]).write.parquet(str(tmp_path / "in"))
    plan = scan_text(spark.read.parquet(str(tmp_path / "in")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Generate") == 1 and "BatchEvalPython" not in plan
