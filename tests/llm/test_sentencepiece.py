import itertools
import math
from collections import Counter

import numpy as np
import pytest

from quillsieve.llm import sentencepiece_topk as sp

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def small():
    texts = ["<unk>", *[f"<0x{b:02X}>" for b in range(256)], "▁", "a", "b", "ab", "▁a", "▁ab", "ba", "aba", "▁▁"]
    logp = np.array([-math.inf] * 257 + [-2.0, -1.5, -1.7, -1.2, -1.9, -2.2, -2.5, -2.0, -3.0])
    return sp.Pieces(texts, logp, np.arange(1, 257, dtype=np.int32))


def encode(pieces, texts, k, seeds=None):
    raw = [t.encode() for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    seeds = np.arange(len(texts), dtype=np.uint64) if seeds is None else seeds
    return sp.sample_block(pieces, np.frombuffer(b"".join(raw), np.uint8), bounds, seeds, k)


def segmentations(pieces, text):
    """All (ids, log-probability) by brute force, normalised."""
    number = {t: i for i, t in enumerate(pieces.texts) if pieces.logp[i] > -math.inf}

    def rest(s):
        if not s:
            yield (), 0.0
        for n in range(1, len(s) + 1):
            i = number.get(s[:n])
            if i is not None:
                for tail, lp in rest(s[n:]):
                    yield (i, *tail), lp + pieces.logp[i]

    found = list(rest("▁" + text.replace(" ", "▁")))
    total = math.log(sum(math.exp(lp) for _, lp in found))
    return {ids: lp - total for ids, lp in found}


def test_pairs_follow_sampling_without_replacement():
    pieces, text, n = small(), "aba ab", 60000
    want = segmentations(pieces, text)
    got = encode(pieces, [text] * n, 2)
    ids = [tuple(tuple(np.frombuffer(x[0], "<u2").tolist()) for x in row) for row in got]
    assert all(a != b for a, b in ids)
    first, pairs = Counter(a for a, _ in ids), Counter(ids)
    for a, lp in want.items():
        p = math.exp(lp)
        assert abs(first[a] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4
        for b, lq in want.items():
            if a != b:
                q = p * math.exp(lq) / (1 - p)
                assert abs(pairs[a, b] / n - q) < 5 * math.sqrt(q / n) + 1e-4


def test_inclusion_scores_estimate_sums_without_bias():
    pieces, text, n = small(), "abab", 40000
    want = segmentations(pieces, text)
    got = encode(pieces, [text] * n, 3)
    # Horvitz-Thompson: sum of p / inclusion over the samples has expectation 1
    each = [sum(math.exp(lp - li) for _, _, lp, _, li in row) for row in got]
    assert abs(np.mean(each) - 1) < 0.02
    for row in got[:200]:
        assert [x[3] for x in row] == sorted((x[3] for x in row), reverse=True)
        for packed, count, lp, _, _ in row:
            key = tuple(np.frombuffer(packed, "<u2").tolist())
            assert len(key) == count and abs(want[key] - lp) < 1e-9


def test_all_segmentations_come_out_when_k_is_large():
    pieces = small()
    for text in ("", "a", "ab", "aba", "b a", "a  b"):
        want = segmentations(pieces, text) if text else {}
        row = encode(pieces, [text], 60)[0]
        assert len({x[0] for x in row}) == len(row) == len(want)
        assert all(x[4] == 0.0 for x in row)


def test_round_trip_with_model():
    pieces = sp.load_pieces(MODEL)
    texts = ["Hello  world", "", " x", "日本語 naïve 🙂\n\ttab", "é" * 3000, "a" * 3000, "\x00\x01", "w " * 2000, "٣ ೫ 𝒳"]
    got = encode(pieces, texts, 3)
    for t, row in zip(texts, got):
        assert len(row) == len({x[0] for x in row}) and (row or not t)
        for x in row:
            assert sp.decode_ids(pieces, x[0]) == t


def test_rows_do_not_depend_on_their_block():
    pieces = sp.load_pieces(MODEL)
    texts = ["the cat sat on the mat", "another text entirely", "x"]
    seeds = np.array([5, 6, 7], np.uint64)
    together = encode(pieces, texts, 2, seeds)
    for i, t in enumerate(texts):
        alone = encode(pieces, [t], 2, seeds[i : i + 1])[0]
        for a, b in itertools.zip_longest(alone, together[i]):
            assert a[0] == b[0] and a[1] == b[1] and a[2:4] == pytest.approx(b[2:4], abs=1e-9)


def test_dataframe_edges(spark):
    pieces = small()
    df = spark.createDataFrame([(1, "ab", 5), (1, "ab", 5), (None, "aba", 1), (2, None, 2), (3, "", 3)], "doc_id long, text string, samples int")
    got = sp.sample_encodings(df, pieces, 2).collect()
    assert len(got) == 5 and got[0] == got[1]
    by = {r["doc_id"]: r["samples"] for r in got}
    assert by[2] == [] and by[3] == [] and len(by[None]) == 2
    assert sp.sample_encodings(df.limit(0), pieces).count() == 0
    packed = spark.createDataFrame([(1, bytearray(by[1][0]["ids"])), (2, None), (3, bytearray())], "id int, ids binary")
    assert [r["text"] for r in sp.decode(packed, pieces).orderBy("id").collect()] == ["ab", None, ""]


def test_samples_decode_to_their_texts(spark):
    from quillsieve.llm.queries import PIECE_MODEL

    pieces = sp.load_pieces(PIECE_MODEL)
    texts = ["hello world", "", None, "  two  blanks ", "日本語 😀 x", "a\u2581b", "x" * 5000, "\n\ttabs", "hello world"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sp.sample_encodings(df, pieces, k=3, decodes="same").collect()
    assert len(rows) == len(texts) and all(r["same"] for r in rows)
    packed = [s["ids"] for r in rows for s in r["samples"] or []]
    assert [x.decode() for x in sp.decode_all(pieces, packed)] == [sp.decode_ids(pieces, x) for x in packed]
    assert sp.decode_all(pieces, []) == [] and sp.decode_all(pieces, [b"", packed[0], b""])[0] == b""
