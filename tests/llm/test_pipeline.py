"""Each pipeline stage beside plain Python on its own input."""

import re

import corpus_pipeline
from evigraph.llm import language, pii
from test_jaccard import plain
from test_native import plain_contamination
from test_tokens import check_packing


def test_stages_on_their_own_inputs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    junk = spark.createDataFrame([(10**6, "12 34 !!", "en", "s", 8), (10**6 + 1, None, "en", "s", 0), (10**6 + 2, "日本語の文", None, "s", 5)], docs.schema)
    docs = docs.unionByName(junk)
    columns = docs.columns
    filters = language.fit(docs)
    want = {r.doc_id for r in docs.collect() if filters.decide(r.text)[0] != "und" and filters.decide(r.text)[1] >= 0.3}
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language identification"](spark, docs, sf_dir)
    rows = kept.collect()
    assert kept.columns == columns and {r.doc_id for r in rows} == want and len(want) == docs.count() - 3

    kept = spark.createDataFrame(rows, docs.schema)
    want = {d for d, _, c in plain([(r.doc_id, r.text) for r in rows]) if d == c}
    kept = stages["n-gram Jaccard join"](spark, kept, sf_dir)
    rows = kept.collect()
    assert kept.columns == columns and sorted(r.doc_id for r in rows) == sorted(want)

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = {d for d, *_, bad in plain_contamination([(r.doc_id, r.text) for r in rows], items) if not bad}
    kept = stages["benchmark decontamination"](spark, spark.createDataFrame(rows, docs.schema), sf_dir)
    rows = kept.collect()
    assert kept.columns == columns and sorted(r.doc_id for r in rows) == sorted(want)

    clean = stages["personal data"](spark, spark.createDataFrame(rows, docs.schema), sf_dir)
    after = {r.doc_id: r for r in clean.collect()}
    assert clean.columns == columns and set(after) == want
    for r in rows:
        assert not pii.base_spans(after[r.doc_id].text) and after[r.doc_id].n_chars == len(after[r.doc_id].text)
        if not re.search("[0-9@]", r.text):
            assert after[r.doc_id] == r
    packed = stages["best-fit packing"](spark, clean, sf_dir).collect()
    count, total = check_packing(packed, 2048)
    assert {r.doc_id for r in packed} == want and count <= 1.02 * -(-total // 2048) + 1


def test_run_is_the_stages_in_order(spark, sf_dir):
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language identification", "n-gram Jaccard join", "benchmark decontamination", "personal data", "best-fit packing"]
    packed = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(packed.columns) and packed.count() > 0
