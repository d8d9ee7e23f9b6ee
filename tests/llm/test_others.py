import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from quillsieve.llm import itq_dedup, language_bayes, license_tfidf, quality_cnn, rendezvous, secret_automaton, suffix_decontam

PATTERNS = {
    "assign": re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile("AKIA([A-Z0-9]+)"),
    "hex": re.compile("([0-9a-f]+)"),
}


def plain_secrets(text):
    out = []
    for k, (kind, least) in enumerate((("assign", 6), ("access", 16), ("hex", 24))):
        out += [(m.start(), k, kind, m.end()) for m in PATTERNS[kind].finditer(text or "") if len(m[1]) >= least]
    return [(k, s, e) for s, _, k, e in sorted(out)]


def test_secrets_equal_plain_regexes(spark):
    random.seed(2)
    parts = ["token", "Secret", "api_key", "=", ":", " ", '"', "'", "abc", "abcdef12", "AKIA", "ABCD1234ABCD1234", "deadbeef", "\n", ",", "é", "日", "_", "-", "."]
    texts = ["".join(random.choice(parts) for _ in range(random.randrange(0, 40))) for _ in range(2000)]
    texts += [None, "", "a" * 100_000, "token=" * 3000, "token" + " " * 5000 + "=abcdefg"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS spans")
    base = {r.name for r in secret_automaton.BASE_RULES}
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] in base] for r in secret_automaton.find_secrets(df).collect()}
    assert all(got[i] == plain_secrets(t) for i, t in enumerate(texts))
    clean = spark.createDataFrame([(1, "my token=abcdef123 ok"), (2, "fine"), (3, None)], "doc_id int, text string")
    assert [r["text"] for r in secret_automaton.redact(clean).orderBy("doc_id").collect()] == ["my [secret] ok", "fine", None]
    assert secret_automaton.find_secrets(df.limit(0)).count() == 0


def test_added_rules_find_their_tokens():
    scanner = secret_automaton.compiled(secret_automaton.RULES)
    digest = hashlib.sha256(b"x").hexdigest()
    texts = [f"x ghp_{digest[:36]} y", f"xoxb-{digest[:12]}", f"sk_live_{digest[:20]}", "-----BEGIN RSA PRIVATE KEY-----", "plain words only"]
    raw = [t.encode() for t in texts]
    found = scanner.scan(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    names = [{secret_automaton.RULES[k].name for _, k, _ in row} for row in found]
    assert "forge_token" in names[0] and "chat_token" in names[1] and "live_key" in names[2] and "private_key" in names[3] and not names[4]


def test_secret_scans_take_linear_time_and_keep_repeated_rows(spark):
    texts = ["eyJ" * 350_000 + " token=abcdefgh", "ab" * 500_000, "token=" * 170_000, "eyJa." * 200_000, "token" + " " * 1_000_000 + "=abcdefg", "-----BEGIN " * 90_000]
    scanner = secret_automaton.compiled(secret_automaton.RULES)
    for text in texts:
        raw = text.encode()
        began = time.time()
        found = scanner.scan(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
        assert time.time() - began < 4
        base = [(secret_automaton.RULES[k].name, s, e) for s, k, e in found if k < 3]
        assert base == plain_secrets(text)
    df = spark.createDataFrame([(1, "token=abcdef1", None)] * 3 + [(None, "token=abcdef1", "x")], "doc_id long, text string, kind string")
    assert [[tuple(s) for s in r["spans"]] for r in secret_automaton.find_secrets(df).collect()] == [[("assign", 0, 13)]] * 4


def test_added_secret_rules_equal_plain_regexes():
    random.seed(5)
    plain = [
        (r"-----BEGIN (?:(?:RSA|EC|DSA|OPENSSH|ENCRYPTED) )?PRIVATE KEY----(-+)", 1), (r"gh[pousr]_([A-Za-z0-9]+)", 36), (r"xox[abeprs]-([A-Za-z0-9-]+)", 10),
        (r"[rs]k_live_([A-Za-z0-9]+)", 16), (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.([A-Za-z0-9_-]+)", 10),
    ]
    parts = ["-----BEGIN ", "RSA ", "PRIVATE KEY-----", "-", "ghp_", "gho_", "A1b2" * 9, "xoxb-", "12ab", "sk_live_", "eyJ", "eyJab", ".", " ", "\n", "é", "x" * 16]
    texts = ["".join(random.choice(parts) for _ in range(random.randrange(0, 30))) for _ in range(3000)]
    raw = [t.encode() for t in texts]
    found = secret_automaton.compiled(secret_automaton.RULES).scan(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    for text, got in zip(texts, found):
        want = [(m.start(), 3 + k, m.end()) for k, (rx, least) in enumerate(plain) for m in re.finditer(rx, text) if len(m[1]) >= least]
        assert [x for x in got if x[1] > 2] == sorted(want), text


def plain_contamination(documents, benchmark):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows, whole = {}, []
    for item, text in benchmark:
        w = split(text)
        n = min(10, len(w))
        whole.append((w, n))
        for p in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[p : p + n]), set()).add(str(item))
    out = []
    for _, text in documents:
        w, hit, items = split(text), set(), set()
        for n in {len(k) for k in windows}:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in windows:
                    hit |= set(range(p, p + n))
                    items |= windows[tuple(w[p : p + n])]
        out.append((len(w), len(hit), sorted(items)))
    return out


def plain_longest(documents, benchmark):
    """(words, first word) of the longest common run with an item that holds a window of it."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    items = [(w, min(10, len(w))) for w in (split(t) for _, t in benchmark) if w]
    out = []
    for _, text in documents:
        w, best = split(text), (0, 1)
        for item, n in items:
            for q in range(len(item) - n + 1):
                for p in range(len(w) - n + 1):
                    k = 0
                    while p + k < len(w) and q + k < len(item) and w[p + k] == item[q + k]:
                        k += 1
                    if k >= n and (k, -p) > best:
                        best = (k, -p)
        out.append((best[0], -best[1] if best[0] else -1))
    return out


def test_contamination_equals_brute_force_in_one_and_many_blocks(spark, monkeypatch):
    random.seed(6)
    vocabulary = ["a", "B", "cé", "d1", "e", "f", "ぎ"]
    make = lambda n: " ".join(random.choice(vocabulary) for _ in range(n))
    benchmark = [(i, make(random.randrange(1, 16))) for i in range(12)] + [(50, None), (51, ""), (52, "!!"), (3, "x y"), (60, "x y"), (70, make(40)), (None, "zz yy")]
    documents = [(i, make(random.randrange(0, 60)) + random.choice(["", " " + benchmark[i % 12][1].upper() + ". "]) + make(5)) for i in range(80)]
    documents += [(i, make(4) + " " + " ".join(benchmark[17][1].split()[i - 80 : i - 55])) for i in range(80, 90)]
    documents += [(900, None), (901, ""), (902, "x-Y"), (904, "zz yy"), (900, "x y"), (900, "x y")]
    long = [(903, "x y " * 4000)]
    want = [(*a, *b) for a, b in zip(plain_contamination(documents, benchmark), plain_longest(documents, benchmark))] + [(*plain_contamination(long, benchmark)[0], 2, 0)]
    want = [(a, b, [x for x in c if x != "None"], d, e) for a, b, c, d, e in want]
    df = spark.createDataFrame([(k, i, t, 3) for k, (i, t) in enumerate(documents + long)], "k long, doc_id long, text string, n_words int")
    b = spark.createDataFrame(benchmark, "item_id long, text string")
    for size, held, many in ((1 << 20, 8, 128), (64, 1, 128), (64, 8, 2)):
        monkeypatch.setattr(suffix_decontam, "HELD", held)
        monkeypatch.setattr(suffix_decontam, "BLOCKS", many)
        found = suffix_decontam.find_contamination(df, b, keep=["k"], benchmark_bytes=size)
        assert many == 2 or found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
        got = found.orderBy("k").collect()
        assert [(r["n_words"], r["n_hit"], r["items"], r["longest"], r["longest_at"]) for r in got] == want
    clean = suffix_decontam.decontaminate(df, b)
    assert clean.columns == df.columns and clean.count() == sum(w[1] == 0 for w in want)
    assert suffix_decontam.find_contamination(df, b.limit(0)).filter("n_hit > 0").count() == 0
    assert suffix_decontam.find_contamination(df.limit(0), b).count() == 0


def test_longest_match_and_its_place():
    test = suffix_decontam.TestSuffixes([(1, "one two three four five six")], 3)
    text = b"zero two three four five one two three x"
    shard = suffix_decontam.Shard(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    hit, items, longest, place = shard.hits(test)
    assert (shard.n_words[0], hit.sum(), items[0], longest[0], place[0]) == (9, 7, {0}, 4, 1)


def test_words_of_equal_hashes_are_told_apart_by_their_bytes():
    test = suffix_decontam.TestSuffixes([(1, "one two three")], 3)
    test.spelled[1:] = [w + b"x" if w == b"two" else w for w in test.spelled[1:]]
    text = b"zero one two three"
    hit, items, longest, _ = suffix_decontam.Shard(np.frombuffer(text, np.uint8), np.array([0, len(text)])).hits(test)
    assert not hit.any() and items == [set()] and longest[0] == 0


def test_many_distinct_words_in_one_block_take_wider_numbers():
    test = suffix_decontam.TestSuffixes([(1, "alpha beta gamma delta epsilon")], 4)
    wide = suffix_decontam.TestSuffixes([(1, "alpha beta gamma delta epsilon")], 4)
    wide.side, wide.bits, wide.anchor = 2, 31, 2
    wide.anchors = np.unique(suffix_decontam.pack(wide.words, wide.at, 2, 31))
    text = b"beta gamma delta epsilon alpha beta gamma delta x beta gamma"
    shard = suffix_decontam.Shard(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert [x.tolist() if hasattr(x, "tolist") else x for x in shard.hits(test)] == [x.tolist() if hasattr(x, "tolist") else x for x in shard.hits(wide)]


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(30):
        v = rng.normal(size=16)
        rows += [(v, i % 3), (v, i % 3), (v + 0.02 * rng.normal(size=16), i % 3), (v + 0.06 * rng.normal(size=16), i % 3), (v * 3, i % 3), (v, (i + 1) % 3)]
    rows += [(rng.normal(size=4), 1), (np.zeros(16), 1), (np.full(16, np.nan), 1)]
    data = [(i, [float(np.float32(x)) for x in v], int(l)) for i, (v, l) in enumerate(rows)]
    n = len(data)
    data += [(n, None, 1), (n + 1, [], 1), (n + 2, [None] * 16, 1), (n + 3, data[0][1], None), (None, data[0][1], 0)]
    df = spark.createDataFrame([(*r, "c") for r in data], "vec_id long, embedding array<float>, label int, n_links string")
    for layout in (None, (4, 4)):
        got = {r["vec_id"]: r for r in itq_dedup.near_vectors(df, layout=layout).collect()}
        links = {}
        for a, va, la in data:
            for b, vb, lb in data:
                if a is not b and (a, la) != (b, lb) or a is None != b is None:
                    if la is None or la != lb or not va or not vb or len(va) != len(vb) or None in va + vb:
                        continue
                    x, y = np.array(va), np.array(vb)
                    if a != b and np.isfinite(x).all() and np.isfinite(y).all() and x.any() and y.any() and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                        links.setdefault(a, set()).add(b)
        found = sum(r["n_links"] for k, r in got.items() if k is not None)
        true = sum(len(x) for k, x in links.items() if k is not None)
        assert found == true and all(got[k]["n_links"] == len(links.get(k, ())) for k in got if k is not None)
        for k, r in got.items():
            if k is not None and k >= n - 2:
                assert (r["n_links"], r["component_id"], r["kept"]) == (0, k, True)
    assert itq_dedup.near_vectors(df.limit(0)).count() == 0


def test_language_on_held_out_rows(spark):
    random.seed(1)
    syllables = {"en": ["the", "ing", "and", "tion"], "de": ["der", "ung", "sch", "ein"], "fr": ["les", "eau", "ique", "est"]}
    rows = [(i, " ".join("".join(random.choice(s) for _ in range(2)) for _ in range(30)), lang) for i in range(240) for lang, s in [random.choice(list(syllables.items()))]]
    rows += [(900, None, "en"), (901, "123 !?", "de"), (902, "", None), (903, "l'été", None), (None, "der die das", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' AS lang_pred", "1 AS score")
    model = language_bayes.fit(df.filter(~language_bayes.held_out()))
    got = {r["doc_id"]: r for r in language_bayes.identify(df, model).collect()}
    held = [r for r in rows if r[0] is not None and r[0] < 900 and zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in held) >= 0.97 * len(held)
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and got[903]["lang_pred"] in syllables
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = language_bayes.fit(df.limit(0))
    assert {r["lang_pred"] for r in language_bayes.identify(df, none).collect()} == {"und"}


def test_quality_on_held_out_rows(spark):
    random.seed(9)
    good = lambda: " ".join(random.choice(["calm", "river", "stone", "light"]) for _ in range(random.randrange(5, 120)))
    bad = lambda: " | ".join(random.choice(["calm", "river", "stone", "light"]) for _ in range(random.randrange(5, 120)))
    rows = [(i, good() if i % 3 else bad()) for i in range(300)] + [(1000, None), (1001, ""), (1002, "x" * 200_000), (None, "calm")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS score")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] + [(1, None), (None, 1), (2, 2)], "doc_id long, quality int")
    net = quality_cnn.train(df, labels)
    got = {r["doc_id"]: r["score"] for r in quality_cnn.score_quality(df, net).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((got[i] >= 0.7) == (i % 3 > 0) for i in held) >= 0.97 * len(held)
    assert got[1000] == got[1001] and all(0 <= s <= 1 for s in got.values())
    flat = quality_cnn.train(df, labels.limit(0))
    assert {round(r["score"], 6) for r in quality_cnn.score_quality(df, flat).collect()} == {0.5}


def test_chunks_cover_the_whole_text():
    net = quality_cnn.Network(np.zeros((5, 256, 16), np.float32), np.zeros(16, np.float32), np.zeros(32), 0.0)
    net.embed[:, ord("#")] = 1.0
    net.out[16:] = 1.0
    for size in (1, 5, 255, 256, 257, 1000, 70_000):
        for at in {0, size // 2, size - 1}:
            text = bytearray(b"a" * size)
            text[at] = ord("#")
            assert net.score(np.frombuffer(bytes(text), np.uint8), np.array([0, size]))[0] > 0.999


def test_shards(spark):
    rows = [(i, "t" * (i % 5)) for i in range(3000)] + [(None, None), (None, None), (7, "dup"), (7, "dup")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS shard", "0 AS slot")
    got = rendezvous.shard_documents(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert r["grown_shard"] in (r["shard"], 24) and r["size"] == len((dict(rows).get(r["doc_id"]) or "") if r["doc_id"] != 7 else "x" * (r["size"] - 8)) + 8
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and len(by) == 24
    moved = sum(r["grown_shard"] == 24 for r in got) / len(got)
    assert 0.02 < moved < 0.07
    heavy = rendezvous.shard_documents(df, weights=[1.0, 3.0, 0.0]).groupBy("shard").count().collect()
    share = {r["shard"]: r["count"] / len(rows) for r in heavy}
    assert 2 not in share and 0.7 < share[1] < 0.8
    assert rendezvous.shard_documents(df.limit(0)).count() == 0


def test_slots_of_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(rendezvous, "ROWS_PER_BUCKET", 50)
    df = spark.range(2000).selectExpr("IF(id % 3 = 0, 1, id) AS doc_id", "'t' AS text")
    got = rendezvous.shard_documents(df, 3).collect()
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_licences_equal_brute_force(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."),
        (2, "a/b/x.py", "code\ncode"),
        (3, "a/b/y.py", "# Licensed under the Apache License, Version 2.0.\ncode"),
        (4, "c/z.py", "none"),
        (5, "a/b/c/LICENSE.txt", "This work is licensed under the GNU General Public License, version 3.\nmore"),
        (6, "a/b/c/d/e.py", None),
        (7, None, "Licensed under CC BY-NC 4.0."),
        (8, "top.py", ""),
        (8, "top.py", ""),
        (9, "a/b/licensed.py", "a license of unrelated words that no template knows, by far not"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string").selectExpr("*", "1 AS license", "2 AS row")
    got = {r["doc_id"]: (r["license"], r["origin"], r["license_dir"]) for r in license_tfidf.scan_licenses(df).collect()}
    assert got == {
        1: ("MIT", "notice", None),
        2: ("MIT", "inherited", "a"),
        3: ("Apache-2.0", "notice", None),
        4: (None, "none", None),
        5: ("GPL-3.0", "notice", None),
        6: ("GPL-3.0", "inherited", "a/b/c"),
        7: ("CC-BY-NC-4.0", "notice", None),
        8: (None, "none", None),
        9: ("MIT", "inherited", "a"),
    }
    assert license_tfidf.scan_licenses(df).count() == len(rows) and license_tfidf.scan_licenses(df.limit(0)).count() == 0


def test_cosines_equal_brute_force(spark):
    import math
    from collections import Counter

    texts = ["Released under the MIT License.", "some license words", "Licensed under the Apache License, Version 2.0. extra extra", "copyright"]
    counts = [3, 1, 2, 5]
    df = spark.createDataFrame([(str(i), t, n) for i, (t, n) in enumerate(zip(texts, counts))], "key string, notice string, n long")
    got = {r["key"]: (r["license"], r["cosine"]) for r in license_tfidf.score_notices(df).collect()}
    word = re.compile(license_tfidf.WORD)
    tf = lambda t: Counter(word.findall(t.lower()))
    total, df_ = sum(counts) + len(license_tfidf.TEMPLATES), Counter()
    for t, n in zip(texts, counts):
        df_.update({w: n for w in tf(t)})
    for _, t in license_tfidf.TEMPLATES:
        df_.update(set(tf(t)))
    weight = lambda t: {w: c * (math.log((total + 1) / (df_[w] + 1)) + 1) for w, c in tf(t).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    for i, t in enumerate(texts):
        v = weight(t)
        best = min((-round(sum(v.get(w, 0) * x for w, x in u.items()) / (norm(v) * norm(u)), 9), name) for name, u in ((n, weight(s)) for n, s in license_tfidf.TEMPLATES))
        if best[0] == 0:
            assert str(i) not in got
        else:
            assert got[str(i)][0] == best[1] and got[str(i)][1] == pytest.approx(-best[0], abs=1e-8)


def plain_grams(text):
    """Buckets of a text's lower-cased 1- to 3-grams, one by one in whole numbers of 64 bits."""
    points = [int(language_bayes.FOLD[ord(c)]) if ord(c) < len(language_bayes.FOLD) else ord(c) for c in text]
    mix, word, out = int(language_bayes.MIX), (1 << 64) - 1, []
    for n in (1, 2, 3):
        for i in range(len(points) - n + 1):
            h = 0
            for k in range(n):
                h = (h + points[i + k] + k + 1) * mix & word
                h ^= h >> 31
            out.append(h >> (64 - language_bayes.BITS))
    return out


def test_language_scores_equal_a_plain_version(spark):
    import math
    from collections import Counter

    random.seed(3)
    syllables = {"en": ["the", "ing", "and", "tion"], "de": ["der", "ung", "sch", "über"], "ja": ["日本", "こと", "です", "ます"]}
    rows = [(i, " ".join(random.choice(s) for _ in range(random.randrange(1, 12))), lang) for i in range(60) for lang, s in [random.choice(list(syllables.items()))]]
    rows += [(100, "12 34", "en"), (101, None, "de"), (102, "ÜBER Der", None), (103, "", "en"), (104, rows[0][1], rows[0][2]), (105, "x" * 300_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_bayes.identify(df, language_bayes.fit(df)).collect()}
    counts, texts = {}, Counter()
    letter = lambda t: any(c.isalpha() for c in t or "")
    for _, text, lang in rows:
        if text is not None and lang is not None:
            counts.setdefault(lang, Counter())
            texts[lang] += 0
            if letter(text):
                texts[lang] += 1
                counts[lang].update(plain_grams(text))
    total = {lang: sum(c.values()) for lang, c in counts.items()}
    for i, text, _ in rows:
        if not letter(text):
            assert got[i] == ("und", 0.0)
            continue
        score = {}
        for lang, c in counts.items():
            score[lang] = math.log((texts[lang] + 1) / (sum(texts.values()) + len(texts))) + sum(n * math.log((c[b] + 0.5) / (total[lang] + 0.5 * language_bayes.BUCKETS)) for b, n in Counter(plain_grams(text)).items())
        best = min(score, key=lambda x: (-score[x], x))
        assert got[i][0] == best and got[i][1] == pytest.approx(1 / sum(math.exp(x - score[best]) for x in score.values()), rel=1e-6)


def test_quality_scores_equal_a_plain_forward_pass():
    rng = np.random.default_rng(5)
    net = quality_cnn.Network(rng.normal(0, 0.3, (quality_cnn.WIDTH, 256, quality_cnn.FILTERS)).astype(np.float32), rng.normal(0, 0.3, quality_cnn.FILTERS).astype(np.float32), rng.normal(0, 0.3, 2 * quality_cnn.FILTERS), 0.1)
    texts = [b"", b"a", bytes(rng.integers(0, 256, 63).astype(np.uint8)), bytes(rng.integers(0, 256, 64).astype(np.uint8)), b"word " * 100, bytes(rng.integers(97, 123, 3000).astype(np.uint8)), b"a"]
    got = net.score(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    w, cell = quality_cnn.WIDTH, quality_cnn.CELL
    for text, score in zip(texts, got):
        cells = -(-(len(text) + w - 1) // cell)
        padded = b"\0" * (w - 1) + text + b"\0" * (cells * cell - len(text))
        response = np.array([sum(net.embed[k][padded[i + k]].astype(np.float64) for k in range(w)) for i in range(cells * cell)])
        top = response.reshape(cells, cell, -1).max(1)
        chunks, at = [], 0
        while True:
            chunks.append(np.maximum(top[at : at + quality_cnn.CHUNK_CELLS].max(0) + net.bias, 0))
            if at + quality_cnn.CHUNK_CELLS >= cells:
                break
            at += quality_cnn.HOP_CELLS
        features = np.concatenate([np.mean(chunks, 0), np.max(chunks, 0)])
        assert score == pytest.approx(1 / (1 + np.exp(-(features @ net.out + net.base))), abs=1e-5)


def test_training_rows_stay_within_their_bytes(spark):
    rows = [(i, "x" * (1000 + i)) for i in range(200)] + [(5, "x" * 1005), (300, None), (None, "y"), (301, "z" * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(301, 1), (3, None), (7, 5)], "doc_id long, quality int")
    got = quality_cnn.training_rows(df, labels, rows=150, size=50_000, longest=4000)
    assert 40 < len(got) and sum(len(t) for t, _ in got) <= 50_000 and all(len(t) <= 4000 for t, _ in got)
    assert got == quality_cnn.training_rows(df.repartition(3), labels, rows=150, size=50_000, longest=4000)
    assert quality_cnn.training_rows(df.limit(0), labels) == [] and quality_cnn.training_rows(df, labels.limit(0)) == []
    net = quality_cnn.train(df, labels.limit(0))
    scored = quality_cnn.score_quality(df, net)
    assert scored.count() == len(rows) and scored.select("score").distinct().count() == 1 and quality_cnn.score_quality(df.limit(0), net).count() == 0


def test_slots_of_many_repeated_rows(spark):
    df = spark.createDataFrame([(i % 3, "t") for i in range(600)] + [(None, None)] * 5, "doc_id long, text string")
    import quillsieve.llm.rendezvous as rv

    dealt = rv.slots(df.withColumn("shard", (rv.F.coalesce("doc_id", rv.F.lit(1)) % 2).cast("int")), "shard", [rv.F.col("doc_id")], per_bucket=40)
    by = {}
    for r in dealt.collect():
        by.setdefault(r["shard"], []).append(r["slot"])
    assert sum(map(len, by.values())) == 605 and all(sorted(s) == list(range(len(s))) for s in by.values())
