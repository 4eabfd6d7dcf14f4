"""The near-duplicate join beside all pairs in plain Python."""

import random

import duckdb
import numpy as np
import pytest

from evigraph.llm import jaccard
from evigraph.llm.queries import ORACLES, QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs):
    sets = []
    for doc_id, text in docs:
        w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if x]
        sets.append((doc_id, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for k in range(len(sets)):
        groups.setdefault(find(k), []).append(sets[k][0])
    small = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return [(sets[k][0], len(sets[k][1]), small[find(k)]) for k in range(len(sets))]


def near_copies(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5)))
    docs, passage = [], " ".join(word() for _ in range(40))
    for _ in range(6):  # groups whose members drift apart: chains and fringes
        base = [word() for _ in range(rng.choice([8, 30, 80, 200]))]
        for k in range(rng.choice([2, 5, 30])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 28))):
                copy[rng.randrange(len(copy))] = word()
            docs.append(" ".join(copy))
            if k % 3 == 0:
                base = copy
    docs += [passage + " " + " ".join(word() for _ in range(rng.choice([3, 12, 60]))) for _ in range(40)]
    docs += ["a b c", "A  b\tC", "a b c d", "a b c d e", "", "  ", docs[3], docs[3].upper()]
    rng.shuffle(docs)
    return [(k * 3 % 1000, t) for k, t in enumerate(docs)] + [(5000, None), (5001, "x y " * 30_000), (5001, "x y " * 30_000), (None, docs[2])]


@pytest.mark.parametrize("seed, block, hot", [(1, 512, 64), (2, 4, 3)])
def test_components_beside_all_pairs(spark, monkeypatch, seed, block, hot):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "HOT_SETS", hot)
    docs = near_copies(seed)
    frame = spark.createDataFrame([(*d, "x", b"1") for d in docs], "doc_id long, text string, node string, bits binary").repartition(5)
    got = [tuple(r) for r in jaccard.near_duplicates(frame).collect()]
    assert sorted(got, key=str) == sorted(plain(docs), key=str)
    kept = jaccard.one_of_each(frame)
    assert kept.columns == frame.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _, c in plain(docs) if d == c)


def test_empty_table(spark):
    assert jaccard.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_hashes_follow_words():
    text = "One two  three four five\nSIX é seven " * 3
    a, b = jaccard.word_hashes(text), jaccard.word_hashes(text.lower().replace("  ", "\t"))
    assert a.tolist() == b.tolist() and len(a) == 24
    assert len(set(jaccard.word_hashes("ab ba abc cab bca a b c aa bb").tolist())) == 10
    long = "w " * 700_000 + "x" * 2_000_000 + " end"
    h = jaccard.word_hashes(long)
    assert len(h) == 700_002 and len(set(h.tolist())) == 3
    assert len(jaccard.shingles("a b c d e f")) == 2 and len(jaccard.shingles("a b c")) == 1 and len(jaccard.shingles(" \n")) == 0


def test_bitmaps_bound_from_above():
    rng = np.random.default_rng(3)
    for _ in range(200):
        common = rng.integers(0, 1 << 63, rng.integers(1, 200), dtype=np.uint64)
        a = np.unique(np.concatenate([common, rng.integers(0, 1 << 63, rng.integers(0, 60), dtype=np.uint64)]))
        b = np.unique(np.concatenate([common, rng.integers(0, 1 << 63, rng.integers(0, 60), dtype=np.uint64)]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert jaccard._upper(np.frombuffer(jaccard.bitmap(a), np.uint64), np.frombuffer(jaccard.bitmap(b), np.uint64), len(a), len(b)) >= true - 1e-12


def test_join_sql(spark, sf_dir):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = db.sql(ORACLES["op1_jaccard_join"])
    got = QUERIES["op1_jaccard_join"](spark, sf_dir)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())
