import random

import numpy as np
import xxhash

from quillsieve.llm import simhash_golay as sg
from quillsieve.llm.components import connected_components


def plain_print(text):
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    if not shingles:
        return 0
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(values):
    """Least index reachable over links of 3 bits or fewer, by brute force."""
    label = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for i in range(len(values)):
            for j in range(len(values)):
                if bin(values[i] ^ values[j]).count("1") <= 3 and label[j] > label[i]:
                    label[j], changed = label[i], True
    return label


def test_every_word_is_within_three_bits_of_one_codeword():
    code = sg.Golay()
    x = np.arange(0, 1 << 23, 97).astype(np.int32)
    weight = np.bitwise_count(code.error[code.syndrome(x)])
    assert weight.max() == 3
    y = x ^ code.error[code.syndrome(x)]
    assert (code.syndrome(y) == 0).all()


def test_links_of_planted_fingerprints(spark, monkeypatch):
    random.seed(4)
    values = [0]
    for _ in range(40):
        v = random.getrandbits(64)
        values.append(v)
        for d in (1, 2, 3, 4, 5):
            values.append(v ^ sum(1 << b for b in random.sample(range(64), d)))
    for tile in (1024, 2):
        monkeypatch.setattr(sg, "TILE", tile)
        df = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in set(values)], "simhash long")
        from quillsieve.llm.components import connected_components

        found = {r["node"]: r["component"] for r in connected_components(sg.link_forest(sg.golay_keys(df))).collect()}
        signed = [int(np.uint64(v).view(np.int64)) for v in values]
        label = components(values)
        groups = {}
        for v, c in zip(signed, label):
            groups.setdefault(c, set()).add(v)
        for members in groups.values():
            assert len({found.get(v, v) for v in members}) == 1
        assert len({found.get(v, v) for v in signed}) == len(groups)


def test_documents_equal_brute_force(spark):
    random.seed(5)
    words = ["alpha", "Beta", "γάμμα", "delta", "x", "É", " ", " "]
    texts = [" ".join(random.choice(words) for _ in range(random.randrange(0, 40))) for _ in range(60)]
    texts += [None, "", "  \n\t", "One two", "one  TWO", texts[3], texts[3], "word " * 30000]
    rows = [(i * 7 % 997, t, 1, "y") for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in sg.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string, simhash int, component_id string")).collect()}
    values = [plain_print(t) for _, t, _, _ in rows]
    label = components(values)
    for (i, _, _, _), v, c in zip(rows, values, label):
        assert int(np.int64(got[i]["simhash"]).view(np.uint64)) == v
        assert got[i]["component_id"] == min(r[0] for r, x in zip(rows, label) if x == c)


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (None, "zz yy xx ww"), (6, None), (7, "")], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in sg.simhash_groups(df).collect())
    assert got == [(-1, -1), (-1, 5), (5, 5), (5, 5), (6, 6), (7, 6)]
    assert sorted((r["doc_id"] or -1) for r in sg.drop_near_duplicates(df).collect()) == [-1, 5, 6]
    assert sg.simhash_groups(df.limit(0)).count() == 0


def test_components_with_hubs_equal_brute_force(spark, monkeypatch):
    from quillsieve.llm import components as parts

    random.seed(8)
    edges = [(0, k) for k in range(1, 60)] + [(100 + k, 100 + random.randrange(0, 40)) for k in range(40)] + [(59, 300), (300, 301), (5, 5), (None, 3)]
    label = {x: x for e in edges for x in e if x is not None and e[0] != e[1] and None not in e}
    while (now := {**label, **{x: min(label[a], label[b]) for a, b in edges if a is not None and a != b for x in (a, b) if min(label[a], label[b]) < label[x]}}) != label:
        label = now
    df = spark.createDataFrame(edges, "u long, v long")
    for split, small in ((1 << 20, 0), (1, 0), (1, 1 << 14)):
        monkeypatch.setattr(parts, "SMALL", small)
        monkeypatch.setattr(parts, "SPLIT", split)
        monkeypatch.setattr(parts, "HUB", 7)
        assert {r["node"]: r["component"] for r in parts.connected_components(df).collect()} == label
