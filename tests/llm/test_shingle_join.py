import random

import pytest

import corpus_pipeline
from quillsieve.llm import shingle_join


def plain_sets(texts):
    out = []
    for t in texts:
        w = (t or "").lower().split()
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def plain_groups(sets):
    """Least index reachable over pairs of similarity 0.8 or more, of all pairs."""
    label = list(range(len(sets)))
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a == b or 5 * len(a & b) >= 4 * len(a | b)]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            least = min(label[i], label[j])
            if label[i] != least or label[j] != least:
                label[i] = label[j] = least
                changed = True
    return label


def changed_copies(count):
    random.seed(11)
    vocabulary = [f"w{k}" for k in range(3000)]
    texts = []
    for _ in range(count):
        base = [random.choice(vocabulary) for _ in range(random.randrange(3, 300))]
        texts.append(" ".join(base))
        for share in (0.005, 0.01, 0.02, 0.03, 0.05):
            texts.append(" ".join(random.choice(vocabulary) if random.random() < share else w for w in base))
        cut = max(1, len(base) // random.randrange(4, 12))
        texts.append(" ".join(base[:-cut]))
    return texts


@pytest.mark.parametrize("tile, pairs", [(1024, 1 << 15), (2, 1)])
def test_near_copies_equal_brute_force(spark, monkeypatch, tile, pairs):
    monkeypatch.setattr(shingle_join, "TILE", tile)
    monkeypatch.setattr(shingle_join, "PAIRS", pairs)
    texts = changed_copies(25) + [None, "", " \n", "one two", "One  TWO", "one two three"]
    label = plain_groups(plain_sets(texts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect())
    assert got == sorted(set(label)) and len(got) < len(texts) - 60


def test_one_row_of_each_group_stays_with_null_and_repeated_ids(spark):
    long = [f"a{k}" for k in range(60)]
    near = [*long[:-1], "other"]
    rows = [(None, "p q r s t u"), (None, "p q r s t u"), (5, "x y z"), (5, "x y z"), (4, " ".join(long)), (5, " ".join(near)), (None, " ".join(long)), (None, "x Y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["text"]) for r in corpus_pipeline.near_duplicates(spark, df, "").collect())
    assert got == [(-1, "p q r s t u"), (4, " ".join(long)), (5, "x y z")]
    assert corpus_pipeline.near_duplicates(spark, df.limit(0), "").count() == 0


def test_sketches_never_rule_out_more_than_differs():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(2)
    for n in (5, 90, 300, 700, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for share in (0.0, 0.1, 0.5, 1.0):
            new = rng.integers(0, 1 << 63, max(1, int(1.2 * n * share))).astype(np.uint64)
            b = np.unique(np.concatenate([a[: int(n * (1 - share))], new]))
            marks = shingle_join.Sketches(pa.array([shingle_join.parity(a), shingle_join.parity(b)], pa.binary()))
            differ = len(np.setxor1d(a, b))
            got = int(marks.apart(np.array([0]), np.array([1]))[0])
            assert got <= differ and got == int(marks.apart(np.array([1]), np.array([0]))[0])
            if n <= 300 and share == 1.0:
                assert got > (n + len(b)) / 9
