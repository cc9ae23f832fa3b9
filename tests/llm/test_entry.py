"""The registered queries on the smallest table, and the pipeline's stages on what they read."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from veloframe.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
CONTRACT = {
    "op1_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op2_pii": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint",
                "base_sha256": "string", "spans": "string"},
    "op4_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint",
                  "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op5_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint",
                    "sequence_id": "bigint", "offset": "bigint"},
    "op7_langid": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op8_ann": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op11_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op12_spelling": {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"},
    "op13_merkle": {"doc_id": "bigint", "leaf": "string", "subroot": "string", "root": "string", "proof_sha256": "string",
                    "folded_root": "string", "verified": "boolean"},
    "op10_html": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    got = entry.queries()[name](spark, DATA)
    types = dict(got.dtypes)
    assert CONTRACT.get(name, {}).items() <= types.items()
    n = got.count()
    if name not in ("op5_packing", "op8_ann", "op12_spelling"):
        assert n == spark.read.parquet(f"{DATA}/{'pages' if name == 'op10_html' else 'documents'}.parquet").count()
    assert n > 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.saved(stage(spark, docs, DATA), f"test-{name}")
        assert out.columns == columns and dict(out.dtypes) == dict(docs.dtypes)
        before = {r.doc_id: r.text for r in docs.collect()}
        after = {r.doc_id: r.text for r in out.collect()}
        assert out.count() == len(after) and 0 < len(after) <= len(before)
        assert all(after[i] == before[i] for i in after) or name == "lines"
        docs = out
    packed = corpus_pipeline.saved(corpus_pipeline.packing(spark, docs, DATA), "test-packing")
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.collect()}
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, packed.select(*keys).collect())) == sorted(map(tuple, corpus_pipeline.run(spark, DATA).select(*keys).collect()))


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_rows(spark, k):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "some words in a row", "en", "s", 19), (3, "a\n" * 50, "xx", None, 100),
            (4, "word " * 3000, "en", "s", 15_000), (4, "word " * 3000, "en", "s", 15_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    name, stage = corpus_pipeline.STAGES[k]
    stage(spark, docs, DATA).collect()
    assert stage(spark, docs.limit(0), DATA).count() == 0
