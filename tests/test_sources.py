import gzip
import hashlib
import io
import json
import os
import stat
import struct
import zipfile
import zlib

import pytest

from quillsieve.operators import binary, repository
from quillsieve.sources import files, git, reports


def loose(kind: str, body: bytes):
    data = f"{kind} {len(body)}\0".encode() + body
    return hashlib.sha1(data).hexdigest(), zlib.compress(data)


def entry(mode, name, sha):
    return f"{mode} {name}".encode() + b"\0" + bytes.fromhex(sha)


def test_loose_trees_and_commits(spark):
    blob, raw = loose("blob", b"hello")
    sub, sub_raw = loose("tree", entry("100644", "a.txt", blob))
    root, root_raw = loose("tree", entry("40000", "dir", sub) + entry("100755", "b.sh", blob) + entry("160000", "mod", "1" * 40))
    one, one_raw = loose("commit", f"tree {root}\nauthor A B <a@b.c> 1700000000 +0000\ncommitter x <y> 1 +0000\n\n first\nline \n".encode())
    two, two_raw = loose("commit", f"tree {root}\nparent {one}\nauthor C <c@d.e> 1700000001 +0000\n\nsecond".encode())
    rows = [(f"/r/.git/objects/{s[:2]}/{s[2:]}", bytearray(r)) for s, r in ((blob, raw), (sub, sub_raw), (root, root_raw), (one, one_raw), (two, two_raw))]
    rows += [("/r/.git/objects/ab/" + "0" * 38, bytearray(raw)), ("/r/.git/objects/cd/" + "0" * 38, bytearray(b"junk")), ("/r/.git/HEAD", bytearray(b"x"))]
    objects = git.read_loose(spark.createDataFrame(rows, "path string, content binary"))
    got = {r["sha1"]: r for r in objects.collect()}
    assert len(got) == 6 and got[blob]["data"] == b"hello" and got[None]["error"]
    commits = git.commits(objects.filter("kind = 'commit'"))
    by = {r["sha1"]: r for r in commits.collect()}
    assert (by[one]["author"], by[one]["author_email"], by[one]["author_ts"], by[one]["message"], by[one]["parents"]) == ("A B", "a@b.c", 1700000000, "first\nline", [])
    assert by[two]["parents"] == [one] and by[two]["tree"] == root
    spark.sparkContext.setCheckpointDir(os.path.join("/tmp", "quillsieve-test-checkpoints"))
    walk = {r["sha1"]: r["depth"] for r in repository.commit_walk(commits, spark.createDataFrame([(two,)], "sha1 string"), 0).collect()}
    assert walk == {two: 0, one: 1}
    entries = git.read_trees(objects.filter("kind = 'tree'"))
    paths = {r["path"]: r["sha1"] for r in repository.expand_trees(spark.createDataFrame([(root,)], "sha1 string"), entries).collect()}
    assert paths == {"dir/a.txt": blob, "b.sh": blob}


def pack_of(objects):
    out, places = b"PACK" + struct.pack(">II", 2, len(objects)), []
    for kind, head, body in objects:
        places.append(len(out))
        size = len(body)
        first, size = kind << 4 | size & 15, size >> 4
        while size:
            out += bytes([first | 128])
            first, size = size & 127, size >> 7
        out += bytes([first]) + head(places) + zlib.compress(body)
    return out, places


def index_of(rows):
    rows = sorted(rows)
    return b"\xfftOc" + struct.pack(">I", 2) + b"\0" * 1020 + struct.pack(">I", len(rows)) + b"".join(bytes.fromhex(s) for s, _ in rows) + b"\0" * 4 * len(rows) + b"".join(struct.pack(">I", o) for _, o in rows)


def test_packs_with_deltas(spark):
    base, want = b"hello world, this is a base", b"hello world, NEW"
    delta = bytes([len(base), len(want), 0x91, 0, 13, 3]) + b"NEW"
    pack, places = pack_of([(3, lambda p: b"", base), (6, lambda p: bytes([p[1] - p[0]]), delta), (7, lambda p: bytes.fromhex(loose("blob", base)[0]), delta[:-1] + b"X")])
    shas = [loose("blob", b)[0] for b in (base, want, want[:-1] + b"X")]
    idx = index_of(list(zip(shas, places)))
    df = spark.createDataFrame([("p", bytearray(pack), bytearray(idx)), ("bad", bytearray(b"x"), bytearray(idx)), ("none", None, None)], "path string, content binary, idx binary")
    rows = git.read_packs(df).collect()
    assert {r["sha1"]: r["data"] for r in rows if r["path"] == "p"} == dict(zip(shas, (base, want, want[:-1] + b"X")))
    assert all(r["error"] for r in rows if r["path"] != "p") and len(rows) == 5
    with pytest.raises(git.Malformed):
        git.apply_delta(b"short", delta)
    assert git.pack_index(idx) == sorted(zip(shas, places))


def test_index_versions():
    def one(name, extra=b""):
        return b"\0" * 24 + struct.pack(">I", 0o100644) + b"\0" * 8 + struct.pack(">I", 7) + bytes.fromhex("ab" * 20) + struct.pack(">H", len(name)) + extra

    def padded(name):
        raw = one(name) + name
        return raw + b"\0" * (8 - len(raw) % 8)

    two = b"DIRC" + struct.pack(">II", 2, 3) + padded(b"a/b") + padded(b"longer/name") + padded(b"../x")
    assert [(p, m, s) for _, p, m, s in git.index_entries(two)] == [("a/b", 0o100644, 7), ("longer/name", 0o100644, 7), ("", 0o100644, 7)]
    four = b"DIRC" + struct.pack(">II", 4, 2) + one(b"dir/a") + b"\0dir/a\0" + one(b"dir/b") + b"\x01b\0"
    assert [p for _, p, _, _ in git.index_entries(four)] == ["dir/a", "dir/b"]
    with pytest.raises(git.Malformed):
        git.index_entries(b"DIRC" + struct.pack(">II", 1, 0))


def test_text_files_of_repositories(spark):
    a, b = "a" * 40, "b" * 40
    refs = spark.createDataFrame([("p", f"# pack-refs\n{a} refs/tags/v1\n^{b}\n{b} refs/heads/x\n")], "path string, text string")
    assert [tuple(r)[1:] for r in git.packed_refs(refs).orderBy("ref_name").collect()] == [(b, "refs/heads/x", None), (a, "refs/tags/v1", b)]
    ini = spark.createDataFrame([("c", '[core]\n\tbare = false\n; note\n[remote "origin"]\n url = https://h/x=y\n')], "path string, text string")
    entries = git.ini_entries(ini)
    assert {(r["section"], r["key"], r["value"]) for r in entries.collect()} == {("core", "bare", "false"), ("remote.origin", "url", "https://h/x=y")}
    assert [tuple(r) for r in git.remotes(entries).collect()] == [("c", "origin", "https://h/x=y")]
    heads = spark.createDataFrame([("ref: refs/heads/main\n",), (a,), ("?",)], "t string")
    assert [r[0]["kind"] for r in heads.select(git.head_kind(heads["t"])).collect()] == ["ref", "detached", "unknown"]
    assert [r[0] for r in git.hashes_in(spark.createDataFrame([(f"{a} x {a} {'0' * 40}",)], "text string")).collect()] == [a]


def test_binaries(spark):
    key = "AKIA" + hashlib.md5(b"k").hexdigest()[:16].upper()
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("in.txt", f"key {key} end")
        z.writestr("../up.txt", "x")
        z.writestr("n.gz", gzip.compress(f"xx {key}".encode()))
    rows = [("a.zip", bytearray(buf.getvalue())), ("b.bin", bytearray(b"\0\1" + f"zz {key} ".encode() + b"\0custom_77\0")), ("c.tar", bytearray(b"abc")), ("d.gz", bytearray(b"\x1f\x8bjunk")), ("e", None)]
    custom = (("own", "LOW", "Own words", r"custom_\d+"),)
    scanned = binary.scan_binaries(spark.createDataFrame(rows, "filename string, content binary"), custom)
    got = {r["filename"]: r for r in scanned.collect()}
    assert [f["match"] for f in got["a.zip"]["findings"]] == [key, key] and got["a.zip"]["issues"] == {"traversal": 1}
    assert [(f["pattern_id"], f["match"]) for f in got["b.bin"]["findings"]] == [("aws_key_id", key), ("own", "custom_77")]
    assert got["c.tar"]["issues"] == {"unsupported_format": 1} and got["d.gz"]["issues"] == {"malformed": 1} and got["e"]["findings"] == []
    named = {r["pattern_id"]: (r["severity"], r["description"]) for r in binary.binary_findings(scanned, custom).collect()}
    assert named["own"] == ("LOW", "Own words") and named["aws_key_id"][0] == "HIGH"
    kinds = spark.createDataFrame([("x.db", bytearray(b"SQLite format 3\0")), ("y.jar", bytearray(b"?")), ("z", bytearray(b"a" + b"\0" * 10)), ("w", bytearray(b"a" + b"\0" * 11))], "p string, c binary")
    assert [r[0]["kind"] for r in kinds.select(binary.content_kind(kinds["c"], kinds["p"])).collect()] == ["sqlite", "zip", "text", "binary"]


def test_directory_targets_and_patterns(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.txt").write_bytes(b"ok \xff end")
    (tmp_path / "big").write_bytes(b"x" * 100)
    found = files.as_text(files.read_directory(spark, str(tmp_path), 50), str(tmp_path)).collect()
    assert [(r["filename"], r["text"]) for r in found] == [("sub/a.txt", "ok � end")]
    lines = spark.createDataFrame([("# no",), ("",), ("https://h/x",), (json.dumps({"dir": "/d"}),), (json.dumps({"token": "t", "repos": ["a", "b"], "selectors": ["b", "c"]}),)], "value string")
    assert [(r["kind"], r["url"], r["selectors"]) for r in files.read_targets(lines).collect()] == [("url", "https://h/x", []), ("dir", None, []), ("token", None, ["a", "b", "c"])]
    good = {"id": "x", "severity": "LOW", "description": "d", "regex": "a+"}
    assert files.check_patterns([good]) == (("x", "LOW", "d", "a+"),)
    for bad in ({"severity": "ODD"}, {"regex": "(a+)+"}, {"regex": "x" * 1001}, {"id": ""}):
        with pytest.raises(ValueError):
            files.check_patterns([{**good, **bad}])


def test_reports(spark, tmp_path):
    rows = [("f<1>.txt", 3, "openai_key", "d", "LOW", "=1|x", "c", False, None, None), ("g", 1, "p", 'say "hi"', "CRITICAL", "m", "c", True, "s", "r"), ("h", 2, "p", "later", "MEDIUM", "m2", "c", False, None, None)]
    from quillsieve.schemas import FINDING

    df = spark.createDataFrame(rows, FINDING)
    for kind in ("ndjson", "csv", "markdown", "html", "json", "sarif"):
        path = tmp_path / kind
        reports.write_report(df, str(path), kind)
        assert stat.S_IMODE(path.stat().st_mode) == 0o600
    lines = (tmp_path / "ndjson").read_text().splitlines()
    assert json.loads(lines[0])["_quillsieve"]["telemetry"]["findings_total"] == 3 and len(lines) == 4
    first = json.loads(lines[1])
    assert first["severity"] == "CRITICAL" and first["deleted"] is True
    whole = json.loads((tmp_path / "json").read_text())
    assert whole["result"]["findings"][2]["ai_category"] == "provider_key" and whole["result"]["severity_counts"] == {"CRITICAL": 1, "HIGH": 0, "MEDIUM": 1, "LOW": 1}
    sarif = json.loads((tmp_path / "sarif").read_text())["runs"][0]
    assert [r["id"] for r in sarif["tool"]["driver"]["rules"]] == ["openai_key", "p"] and len(sarif["results"]) == 3
    assert "'=1|x" in (tmp_path / "csv").read_text() and "\\|" in (tmp_path / "markdown").read_text() and "f&lt;1&gt;.txt" in (tmp_path / "html").read_text()
    assert (tmp_path / "csv").read_text().splitlines()[0].startswith("file,line,severity") and json.loads((tmp_path / "csv.meta.json").read_text())["_quillsieve"]["telemetry"]["schema_version"] == 1
    total = reports.result_summary(df).first()
    assert total["severity_counts"]["HIGH"] == 0 and total["risk_score"] == 25 and total["risk_label"] == "MEDIUM" and total["ai_category_counts"] == {"provider_key": 1}
    assert reports.terminal_lines(df)[-1] == "Risk 25/100 MEDIUM" and len(reports.terminal_lines(df.limit(0))) == 6


def test_envelopes(spark, tmp_path):
    from quillsieve.schemas import FINDING

    df = spark.createDataFrame([("f", 3, "p", "d", "LOW", "m", "c", False, None, None)], FINDING)
    scan = {"blobs_scanned": 7, "elapsed_s": 1.2345, "contributors": [(f"n{k}", f"e{k}") for k in range(60)]}
    url = reports.exposure_envelope(df, "https://h", "now", {"git_url": "https://h/.git", "confidence": 90, "label": "HIGH"}, {"total_sha1s": 4}, scan)
    assert url["detection"]["git_path"] == ".git" and url["map"]["total_sha1s"] == 4 and len(url["result"]["contributors"]) == 50 and url["result"]["elapsed_s"] == 1.23
    reports.write_report(df, str(tmp_path / "r"), "json", "https://h", url)
    assert json.loads((tmp_path / "r").read_text())["result"]["findings"][0]["match"] == "m"
    token = reports.token_envelope(df, "me", 3, "now", "GitHub", ["a/*"], scan)
    assert (token["mode"], token["scope"], "contributors" in token["result"]) == ("token", {"selectors": ["a/*"]}, False)
    part = reports.partial_report("https://h", "now", {"label": "CONFIRMED", "confidence": 95}, {"blob_sha1s": 2, "branches": ["main"]})
    assert part["detection"]["label"] == "PARTIAL" and part["detection"]["original_label"] == "CONFIRMED" and part["result"]["findings"] == []
    outcomes = spark.createDataFrame([(2, "b", "DIR", "failed", None, 0, 0, "scan_failed", "x"), (1, "a", "URL", "completed", "p", 3, 40, None, None)], "seq int, target string, target_type string, status string, report_path string, findings_count int, risk_score int, error_code string, error string")
    reports.write_aggregate(outcomes, str(tmp_path / "all"), 3, "now", {"peak_active": 2})
    got = json.loads((tmp_path / "all").read_text())
    assert [r["target"] for r in got["results"]] == ["a", "b"] and got["scanned_targets"] == 2 and got["target_fanout"] == {"peak_active": 2} and got["results"][0]["error"] is None
    assert stat.S_IMODE((tmp_path / "all").stat().st_mode) == 0o600


def test_saved_sources(spark, tmp_path):
    a, b = "a" * 40, "b" * 40
    objects = spark.createDataFrame([(a, bytearray(b"one")), (b, bytearray(b"two"))], "sha1 string, content binary")
    paths = spark.createDataFrame([(a, ["../up", "x/y.txt", "z.txt"]), (b, ["/abs"])], "sha1 string, paths array<string>")
    places = reports.saved_paths(objects, paths)
    assert {(r["path"], r["link_of"]) for r in places.collect()} == {("x/y.txt", None), ("z.txt", "x/y.txt"), (f"_unreferenced/bb/{'b' * 38}", None)}
    assert reports.save_sources(objects, places, str(tmp_path)) == (3, 0)
    assert (tmp_path / "z.txt").read_bytes() == b"one" and (tmp_path / "_unreferenced" / "bb" / ("b" * 38)).read_bytes() == b"two"
