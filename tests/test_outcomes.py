"""Work lists, telemetry, URLs and metadata files on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from quillsieve.functions import urls
from quillsieve.operators import binary, outcomes, repository
from quillsieve.sources import connector, metadata, provider


def test_urls(spark):
    rows = [("Example.org/a/", "https://Example.org/a"), ("  http://h:8080  ", "http://h:8080"), ("javascript:alert(1)", None), ("", None), ("ftp://x/y", "https://ftp://x/y"), ("https://", None), ("h" * 2049, None)]
    got = spark.createDataFrame([(u,) for u, _ in rows], "u string").select(urls.valid_url(F.col("u"))).collect()
    assert [r[0] for (u, _), r in zip(rows, got) if not u.startswith("ftp")] == [w for u, w in rows if not u.startswith("ftp")]
    hosts = {"127.0.0.1": True, "172.16.0.1": True, "172.32.0.1": False, "192.168.3.4": True, "100.100.1.1": True, "198.19.0.1": True, "8.8.8.8": False, "::1": True, "fe80::1": True, "fd00::2": True, "2001:db8::1": False, "::ffff:10.0.0.1": True, "::ffff:8.8.8.8": False, "localhost": True, "a.localhost": False, "300.1.1.1": False, "239.1.1.1": True}
    got = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", urls.is_internal_host(F.col("h")).alias("i")).collect()
    assert {r["h"]: r["i"] for r in got} == hosts
    red = spark.createDataFrame([("https://u:p@h/a?private_token=x&page=2#f",), ("nothing?token=1",), ("https://h/a",)], "u string").select(urls.redacted_url(F.col("u"))).collect()
    assert [r[0] for r in red] == ["https://h/a?private_token=%5BREDACTED%5D&page=2#f", "nothing", "https://h/a"]
    names = spark.createDataFrame([("https://h.org/a b/ü", "/data/repo name/", "ab12")], "u string, p string, s string").select(urls.target_name(F.col("u")), urls.directory_name(F.col("p")), urls.object_path(F.col("s")), urls.encoded_path(F.lit("a b/c~*ü"))).first()
    assert tuple(names) == ("h.org_a_b_ü", "repo_name", "objects/ab/12", "a%20b/c~%2A%C3%BC")


def test_workers_follow_the_errors():
    state = {"workers": 40, "initial": 40, "requests": 100, "errors": 20, "last_decrease": -50}
    less = outcomes.adjust_workers(state, 10)
    assert (less["workers"], less["requests"], less["errors"], less["last_decrease"]) == (20, 20, 4, 10)
    assert outcomes.adjust_workers({**less, "requests": 100, "errors": 20}, 30)["workers"] == 20
    assert outcomes.adjust_workers({**less, "requests": 100, "errors": 0}, 100)["workers"] == 24
    assert outcomes.adjust_workers({**less, "requests": 0}, 100)["workers"] == 20


def test_probes_and_access(spark):
    some = spark.createDataFrame([(f"{k:040d}", 0) for k in range(37)], "sha1 string, origin int")
    picked = sorted(r["place"] for r in outcomes.probe_sample(some).collect())
    assert picked == [3 * k for k in range(10)]
    assert outcomes.probe_sample(some.limit(0)).count() == 0
    probes = spark.createDataFrame([(k < 2,) for k in range(10)], "ok boolean")
    assert outcomes.accessible(probes).first()[0] and not outcomes.accessible(probes, strict=True).first()[0]
    assert not outcomes.accessible(probes.limit(0)).first()[0] and outcomes.accessible(probes.limit(0), packs_read=True).first()[0]


def test_early_end(spark):
    rows = [(k, 1, "p", f"m{k}", "CRITICAL" if k in (4, 7) else "LOW") for k in range(10)]
    df = spark.createDataFrame(rows, "seq int, line int, pattern_id string, match string, severity string")
    assert sorted(r["seq"] for r in outcomes.until(df, stop_on_critical=True).collect()) == [0, 1, 2, 3, 4]
    assert [r["seq"] for r in outcomes.until(df, most=3).collect()] == [0, 1, 2]
    assert outcomes.until(df.filter("severity = 'LOW'"), stop_on_critical=True).count() == 8


def test_deep_trees_are_an_error(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", "/tmp/quillsieve-test"))
    entries = spark.createDataFrame([(f"t{k}", "40000", "d", f"t{k + 1}") for k in range(5)] + [("t5", "100644", "f", "b")], "tree string, mode string, name string, sha1 string")
    roots = spark.createDataFrame([("t0",)], "sha1 string")
    assert [r["path"] for r in repository.expand_trees(roots, entries).collect()] == ["d/d/d/d/d/f"]
    with pytest.raises(RuntimeError, match="deeper"):
        repository.expand_trees(roots, entries, depth=3)


def test_metadata_of_a_directory(spark, tmp_path):
    (tmp_path / "refs" / "heads").mkdir(parents=True)
    (tmp_path / "info").mkdir()
    a, b = "a" * 40, "b" * 40
    (tmp_path / "HEAD").write_text("ref: refs/heads/main\n")
    (tmp_path / "refs" / "heads" / "main").write_text(a + "\n")
    (tmp_path / "info" / "refs").write_text(f"{b}\trefs/heads/dev\n{a}\trefs/tags/v1\n")
    (tmp_path / "config").write_text('[branch "fix"]\n\tremote = origin\n')
    (tmp_path / "other").write_text("c" * 40)
    files = metadata.read_metadata(spark, str(tmp_path)).select("path", F.col("content").cast("string").alias("text"))
    assert {r["path"] for r in files.collect()} == {"HEAD", "refs/heads/main", "info/refs", "config"}
    assert [r["branch"] for r in metadata.all_branches(files).collect()] == ["dev", "fix", "main"]
    assert {r["sha1"] for r in metadata.listed_hashes(files).collect()} == {a, b}
    assert len(metadata.META_FILES) == len(set(metadata.META_FILES)) == 57


def test_truncated_trees_are_expanded_once(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", "/tmp/quillsieve-test"))
    seed = spark.createDataFrame([("a", "tree", "t1", None), ("x.txt", "blob", "b0", 3), ("z", "tree", "t1", None)], "path string, kind string, sha1 string, size long")
    pages = spark.createDataFrame([("t1", "in", "tree", "t2", None), ("t1", "f", "blob", "b1", 1), ("t2", "g", "blob", "b2", 1), ("t2", "up", "tree", "t1", None)], "tree string, path string, kind string, sha1 string, size long")
    assert sorted(r["path"] for r in provider.expand_truncated(seed, pages).collect()) == ["a", "a/f", "a/in", "a/in/g", "a/in/up", "x.txt", "z"]


def test_connectors(spark, tmp_path):
    (tmp_path / "page-2.json").write_text(json.dumps([{"path_with_namespace": "g/s/n", "visibility": "private"}]))
    (tmp_path / "page-1.json").write_text(json.dumps([{"path_with_namespace": "g/s/n", "visibility": "public"}, {"path_with_namespace": "lone"}]))
    gitlab = connector.connector("gitlab")
    assert [(r["full_name"], r["owner"], r["private"]) for r in gitlab.repositories(connector.read_pages(spark, str(tmp_path))).collect()] == [("g/s/n", "g/s", False)]
    tree = spark.createDataFrame([(json.dumps([{"name": "f", "type": "blob", "id": "s"}, {"name": "x"}]), "dir")], "body string, base string")
    assert [tuple(r) for r in gitlab.trees(tree).collect()] == [("dir/f", "blob", "s", None)]
    azure = spark.createDataFrame([(json.dumps({"value": [{"path": "/d", "isFolder": True, "objectId": "1"}, {"path": "/f", "objectId": "2", "gitObjectType": "blob"}, {"path": "/g"}]}),)], "body string")
    assert [(r["path"], r["kind"]) for r in connector.connector("azure").trees(azure).collect()] == [("/d", "tree"), ("/f", "blob")]
    bitbucket = spark.createDataFrame([(json.dumps({"values": [{"path": "p", "type": "commit_directory"}, {"path": "q", "type": "commit_file", "commit": {"hash": "h"}, "size": 4}]}),)], "body string")
    assert [tuple(r) for r in connector.connector("bitbucket").trees(bitbucket).collect()] == [("p", "tree", "", None), ("q", "blob", "h", 4)]
    with pytest.raises(ValueError):
        connector.connector("nowhere")


def test_entropy_of_regions():
    assert binary.high_entropy_region(bytes(range(256)) * 16) and not binary.high_entropy_region(b"a" * 5000) and not binary.high_entropy_region(bytes(range(15)))


def test_oversized_binaries_are_counted(spark):
    rows = binary.scan_binaries(spark.createDataFrame([("a", bytearray(b"\0" * 200))], "filename string, content binary"), limit=100).collect()
    assert rows[0]["issues"] == {"scan_size": 1} and rows[0]["findings"] == []
