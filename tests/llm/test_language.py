"""Language filters: held-out accuracy, counts beside sets, odd rows."""

import zlib

import numpy as np

from evigraph.llm import language
from evigraph.llm.queries import QUERIES


def test_held_out_accuracy(spark, sf_dir):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = QUERIES["op2_language_filters"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.9
    assert all(0 <= r.score <= 1 for r in got)


def brute(train, text, min_rate=0.002, min_share=0.2):
    """Plain sets instead of filters."""
    by = {}
    for lang, body in train:
        if len(g := language.grams(body)):
            by.setdefault(lang, []).append(set(g.tolist()))
    rate = {k: {} for k in by}
    for k, sets in by.items():
        for s in sets:
            for g in s:
                rate[k][g] = rate[k].get(g, 0) + 1 / len(sets)
    mine = language.grams(text).tolist()
    share = {k: sum(rate[k].get(g, 0) >= max(min_rate, 1e-12) and rate[k][g] >= min_share * max(r.get(g, 0) for r in rate.values()) - 1e-12 for g in mine) for k in by}
    best = min(share, key=lambda k: (-share[k], k))
    return best, share[best] / len(mine)


def test_filters_follow_the_sets(spark, sf_dir):
    data = [(r.lang, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(90).collect()]
    filters = language.fit(spark.createDataFrame(data, "lang string, text string").repartition(4))
    for _, text in data[::6]:
        lang, share = brute(data, text)
        assert filters.decide(text)[0] == lang and abs(filters.decide(text)[1] - share) < 0.03


def test_odd_rows(spark):
    train = spark.createDataFrame([("aa", "foo bar foo", "x"), ("bb", "Ünä öl", "x"), (None, "foo", "x"), ("aa", None, "x"), ("cc", "12", "x")], "lang string, text string, gram string")
    filters = language.fit(train)
    assert filters.names == ("aa", "bb")
    docs = spark.createDataFrame([(1, "FOO!"), (1, "FOO!"), (2, None), (3, ""), (4, "12 !"), (5, "日本"), (None, "öl"), (6, "foo bar " * 30000)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.lang_pred, round(r.score, 2)) for r in language.predict(docs, filters).collect())
    assert got == [(0, "bb", 1.0), (1, "aa", 1.0), (1, "aa", 1.0), (2, "und", 0.0), (3, "und", 0.0), (4, "und", 0.0), (5, filters.fallback, 0.0), (6, "aa", 1.0)]
    empty = language.fit(train.limit(0))
    assert {r.lang_pred for r in language.predict(docs, empty).collect()} == {"und"}
    extra = docs.selectExpr("text", "doc_id", "1 as score", "'z' as lang_pred")
    kept = language.keep_identified(extra, filters)
    assert kept.columns == extra.columns and kept.count() == 4
