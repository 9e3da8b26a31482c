import corpus_pipeline
from revlens.llm import ngram_join
from tests.llm.test_native import check_mix
from tests.llm.test_tokens import digests


def test_stages_in_order_against_brute_force(spark, sf, edge_docs, no_docs):
    """Each stage judged on its own input."""
    from tokenizers import Tokenizer

    from revlens.llm.queries import WORD_BPE
    from tests.llm.test_ngram_join import brute

    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "language_id", "ngram_jaccard_join", "mixing", "bpe"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    clean = stages["toxicity"](spark, docs, sf)
    left = {r["doc_id"] for r in clean.collect()}
    gone = [labels[i] for i in labels if i not in left]
    assert clean.columns == docs.columns and gone and sum(gone) >= 0.8 * len(gone)
    known = stages["language_id"](spark, docs, sf)
    assert known.columns == docs.columns and known.count() >= docs.count() - 2
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    single = stages["ngram_jaccard_join"](spark, docs, sf)
    assert {r["doc_id"] for r in single.collect()} == {c for _, c in brute(rows).values()}
    mixed = stages["mixing"](spark, docs, sf)
    assert mixed.columns == docs.columns
    copies = {}
    for r in mixed.collect():
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    from revlens.llm import mixing
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect() if r["copies"]}
    assert copies == want
    check_mix([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()], mixing.mix(docs).collect(), 150)
    library = Tokenizer.from_file(WORD_BPE)
    text = dict(rows)
    for r in stages["bpe"](spark, docs, sf).collect():
        assert tuple(r)[1:] == digests(library, text[r["doc_id"]])


def test_run_composes_the_stages(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert 0 < out.count() < 2 * 200


def test_stages_on_edges(spark, sf, edge_docs, no_docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, sf).count() == 0
        stage(spark, edge_docs, sf).collect()


def test_nothing_else_imports_the_subpackage():
    from pathlib import Path

    root = Path(ngram_join.__file__).resolve().parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "revlens.llm" not in path.read_text()
