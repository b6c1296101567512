"""The pipeline's stages against the operators' own rules."""

import corpus_pipeline
from helixlake.llm import registry
from helixlake.llm.common import table, written

SF = "/root/testdata/sf0.001"


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "decontamination", "mixing", "token_ids"]
    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in registry.QUERIES if q.startswith("op")} and "pipeline" in registry.QUERIES


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    before = {r.doc_id for r in docs.select("doc_id").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = written(stage(spark, docs, SF))
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert set(ids) <= before
        if k < 4:
            assert docs.columns == columns
        if name == "ngram_join":
            assert len(ids) == len(set(ids))
        before = set(ids)
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and len(ids) > 100
