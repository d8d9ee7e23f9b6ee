import base64
import json

from pyspark.sql import functions as F

from quillsieve.sources import provider


def test_headers_and_urls(spark):
    df = spark.createDataFrame([("https://API.github.com/x", '<https://h/p?page=3>; rel="next", <https://h/p?page=9>; rel="last"'), ("https://git.visualstudio.com", '<https://h>; rel="prev"'), ("ssh://other", None)], "url string, link string")
    got = df.select(provider.provider_of(F.col("url")).alias("p"), provider.next_link(F.col("link")).alias("n")).collect()
    assert [r["p"]["name"] if r["p"] else None for r in got] == ["GitHub", "Azure DevOps", None]
    assert [r["n"] for r in got] == ["https://h/p?page=3", None, None]
    forms = ["120", " 7 ", "Wed, 21 Oct 2015 07:28:00 GMT", "Wednesday, 21-Oct-15 07:28:00 GMT", "Wed Oct 21 07:28:00 2015", "soon", "Wed, 21 Oct 2009 07:28:00 GMT"]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(forms)], "i int, h string").withColumn("now", F.lit("2015-10-21 07:27:00").cast("timestamp"))
    assert [r[0] for r in df.orderBy("i").select(provider.retry_after(F.col("h"), F.col("now"))).collect()] == [120, 7, 60, 60, 60, None, 0]


def test_pages(spark):
    one = [{"full_name": "a/b", "name": "b", "owner": {"login": "a"}, "private": True, "default_branch": "dev", "clone_url": "u"}, {"name": "none"}]
    two = [{"full_name": "a/b", "name": "late"}, {"full_name": "c/d"}]
    pages = spark.createDataFrame([(1, json.dumps(one)), (2, json.dumps(two)), (3, "broken")], "page int, body string")
    got = {r["full_name"]: r for r in provider.repositories(pages).collect()}
    assert got.keys() == {"a/b", "c/d"} and got["a/b"]["name"] == "b" and got["c/d"]["default_branch"] == "main"
    tree = {"sha": "t", "truncated": True, "tree": [{"path": "p", "mode": "100644", "type": "blob", "sha": "s", "size": 3}, {"path": "", "sha": "x"}]}
    rows = provider.tree_pages(spark.createDataFrame([(json.dumps(tree),)], "body string")).collect()
    assert [(r["tree"], r["truncated"], r["path"], r["size"]) for r in rows] == [("t", True, "p", 3)]
    commit = {"sha": "c", "files": [{"filename": "f", "status": "renamed", "sha": "b", "previous_filename": "g"}, {"filename": "h", "status": "odd"}]}
    rows = provider.history_pages(spark.createDataFrame([(json.dumps(commit),)], "body string")).collect()
    assert [(r["path"], r["status"], r["previous_path"]) for r in rows] == [("f", "renamed", "g"), ("h", "unknown", None)]
    text = base64.encodebytes(b"x" * 100).decode()
    df = spark.createDataFrame([(text,), ("??",), (None,)], "c string")
    assert [bytes(r[0]) if r[0] is not None else None for r in df.select(provider.content_of(F.col("c"))).collect()] == [b"x" * 100, None, None]
