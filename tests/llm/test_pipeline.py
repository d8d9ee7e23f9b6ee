"""The pipeline's stages, each held against brute force on its own input."""

import pytest
from test_others import plain_contamination
from test_pii import plain as plain_pii
from test_shingle_join import plain_groups, plain_sets

import corpus_pipeline
from quillsieve.llm import sentencepiece_topk
from quillsieve.llm.common import materialize
from quillsieve.llm.queries import PIECE_MODEL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(materialize(stage(spark, docs[-1], SF), name.replace(" ", "-")))
    return docs


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near duplicates", "decontamination", "personal data", "encoding"]
    assert all(d.columns == stages[0].columns for d in stages[1:-1])


def test_quality_keeps_clean_documents(spark, stages):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in stages[1].select("doc_id").collect()}
    good, bad = [i for i, q in labels.items() if q == 1], [i for i, q in labels.items() if q == 0]
    assert sum(i in kept for i in good) >= 0.95 * len(good) and sum(i in kept for i in bad) <= 0.3 * len(bad)


def test_one_document_of_each_group_stays(stages):
    rows = sorted((r["doc_id"], r["text"]) for r in stages[1].select("doc_id", "text").collect())
    # of all pairs of texts, by the Jaccard similarity of their five-word shingles
    label = plain_groups(plain_sets([t for _, t in rows]))
    want = {min(rows[i][0] for i in range(len(rows)) if label[i] == c) for c in set(label)}
    assert sorted(r["doc_id"] for r in stages[2].select("doc_id").collect()) == sorted(want)


def test_benchmark_passages_go(spark, stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[2].select("doc_id", "text").collect()]
    benchmark = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {i for (i, _), (_, hit, _) in zip(rows, plain_contamination(rows, benchmark)) if hit == 0}
    assert {r["doc_id"] for r in stages[3].select("doc_id").collect()} == want


def test_personal_data_goes_and_clean_text_stays(stages):
    before = {r["doc_id"]: r["text"] for r in stages[3].collect()}
    after = {r["doc_id"]: r for r in stages[4].collect()}
    assert before.keys() == after.keys()
    for i, text in before.items():
        spans = plain_pii(text)
        now = after[i]["text"]
        assert all(text[s:e] not in now for k, s, e in spans if k in ("email", "card", "phone"))
        assert now.count("[email]") >= sum(k == "email" for k, _, _ in spans) and after[i]["n_chars"] == len(now)
        assert spans or "[" in now or now == text


def test_ids_decode_to_the_texts(stages):
    pieces = sentencepiece_topk.load_pieces(PIECE_MODEL)
    texts = {r["doc_id"]: r["text"] for r in stages[4].collect()}
    rows = stages[5].collect()
    assert {(r["doc_id"], r["sample"]) for r in rows} == {(i, s) for i in texts for s in (0, 1)}
    assert all(sentencepiece_topk.decode_ids(pieces, r["ids"]) == texts[r["doc_id"]] for r in rows)
    assert len({(r["doc_id"], bytes(r["ids"])) for r in rows}) == len(rows)


def test_stages_take_odd_rows(spark):
    """Nulls in every column, empty and repeated rows, clashing column names and empty tables, stage by stage."""
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, None, None, "s", None), (3, "x " * 20_000, "en", None, 5), (3, "x " * 20_000, "en", None, 5), (None, "a b c d e f", None, None, 3)], whole.schema)
    docs = odd.union(whole.limit(20)).selectExpr("*", "7 AS __key", "8 AS spans", "9 AS n_words", "'s' AS samples")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        kept = out.count()
        assert 0 < kept <= docs.count() and stage(spark, docs.limit(0), SF).count() == 0, name
    groups = corpus_pipeline.near_duplicates(spark, odd, SF).collect()
    assert sorted((r["doc_id"] or -1, (r["text"] or "")[:3]) for r in groups) == [(-1, "a b"), (1, ""), (3, "x x")]
    packed = corpus_pipeline.encoding(spark, docs, SF)
    assert packed.filter("sample IS NULL").count() == 4 and corpus_pipeline.encoding(spark, docs.limit(0), SF).count() == 0
