import pytest

from attestry.llm import op3_toxicity as op3
from attestry.llm import op6_simhash as op6
from attestry.llm import op8_decontamination as op8
from attestry.llm import op9_sentencepiece as op9
from attestry.llm import op10_pii as op10

cp = pytest.importorskip("corpus_pipeline")


def test_stages_follow_each_other(spark, sf_dir):
    """run() against its stages taken apart: each decision recomputed from the operator's own answers."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    scores = op3.score(docs, op3.train(op3.labelled_rows(docs, labels)))
    stays = {r["doc_id"] for r in scores.where("score < 0.7").collect()}
    docs = docs.where(docs["doc_id"].isin(*stays))
    stays = {r["component_id"] for r in op6.grouped(docs, words=5, radius=op6.WIDE_RADIUS, similarity=0.8).collect()}
    docs = docs.where(docs["doc_id"].isin(*stays))
    stays = {r["doc_id"] for r in op8.judged(op8.matched(docs, bench)).where("NOT contaminated").collect()}
    docs = op10.sanitised(docs.where(docs["doc_id"].isin(*stays)))
    pieces = op9.encoder_of(op9.model_file()).pieces
    want = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = cp.run(spark, sf_dir).collect()
    assert {r["doc_id"]: pieces.decode(r["ids"]) for r in got} == want and len(got) == len(want) > 0
    assert all(r["round_trip"] and r["n_ids"] == len(r["ids"]) for r in got)


def test_stages_keep_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(50)
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
    assert 4 <= len(cp.STAGES) <= 5
