import random

import pytest

import corpus_pipeline
from tracklake.llm import bit_planes, fingerprints, language_id, merkle, ngram_join, packing, pii, prefix_trie, quality, sentencepiece_codec, sharding, suffix_dedup, token_counts

from .fixtures import documents, texts, words


def test_stages_take_effect_and_keep_columns(spark, tmp_path):
    rng = random.Random(4)
    passage = " ".join(words(rng, 60, 4000))
    extra = [" ".join(words(rng, 40)) + " " + passage + f" mail a{i}@x.example.com " + " ".join(words(rng, 30)) for i in range(4)]
    docs = documents(spark, texts(5) + extra).dropDuplicates(["doc_id"])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "suffix-array dedup", "PII surrogates", "packing"]
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, after = now, stage(spark, now, str(tmp_path))
        if i < 4:
            assert after.schema.simpleString() == now.schema.simpleString()
            after.write.parquet(str(tmp_path / f"stage{i}"))
            now = spark.read.parquet(str(tmp_path / f"stage{i}"))
        if i == 0:
            assert quality.quality(now).filter("not kept").count() == 0
        if i == 1:
            assert ngram_join.near_duplicates(now).filter("component_id <> doc_id").count() == 0
        if i == 2:  # what was repeated is gone; cutting may bring new bytes together, so a second turn may find more
            given = {r.doc_id: r.n_removed for r in suffix_dedup.repeated_bytes(before, suffix_dedup.PASSAGE, suffix_dedup.PASSAGE).collect()}
            sizes = {r.doc_id: len(r.text.encode()) for r in before.collect()}
            kept = {r.doc_id: len(r.text.encode()) for r in now.collect()}
            assert any(given.values()) and all(0 <= sizes[d] - given[d] - kept[d] < 4 * (given[d] > 0) + 4 for d in sizes)
        if i == 3:  # the entities' count stays, and no key of before is left
            from tests.llm import plain_pii

            keys = lambda rows: [k for r in rows.collect() for _, _, m, kind in plain_pii.find(r.text) for k in plain_pii.keys(m, kind)]
            assert not {k for k in keys(before) if k[0] in ("email", "phone", "card")} & set(keys(now))
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.agg({"length": "sum"}).collect() == after.agg({"length": "sum"}).collect()
    assert {r.doc_id for r in whole.select("doc_id").distinct().collect()} == {r.doc_id for r in now.select("doc_id").distinct().collect()}


MODULES = [ngram_join, quality, packing, token_counts, fingerprints, sentencepiece_codec, suffix_dedup, language_id, sharding, pii, bit_planes, prefix_trie, merkle, corpus_pipeline]


@pytest.mark.parametrize("module", MODULES, ids=lambda m: m.__name__.rpartition(".")[2])
def test_docstrings_state_edge_cases(module):
    text = " ".join(module.__doc__.lower().split())
    for word in ("null", "empty", "long", "equal", "extra columns", "repeated rows", "empty table"):
        assert word in text, word
