"""Decontamination and syncmers beside plain Python, and the plans' freedom from Python workers."""

import hashlib
import random
import re

import duckdb
import xxhash

from evigraph.llm import decontam, syncmers
from evigraph.llm.queries import ORACLES, QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_contamination(docs, items, size=10):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
    wins = {}
    for item_id, text in items:
        w = split(text)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            wins.setdefault(tuple(w[k : k + size]), set()).add(item_id)
    out = []
    for doc_id, text in docs:
        w, hit, seen = split(text), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit.update(range(k, k + n))
                    seen |= wins[tuple(w[k : k + n])]
        ids = sorted(str(x) for x in seen if x is not None)
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


def case():
    rng = random.Random(7)
    text = lambda n: " ".join(rng.choice("ab cd ef gh É ij9 K".split()) for _ in range(n))
    items = [(k, text(rng.choice([0, 1, 2, 3, 9, 10, 11, 14]))) for k in range(4, 30)] + [(1, None), (None, "zz yy"), (2, "Zz, YY"), (3, "zz yy")]
    docs = [(k, text(rng.randint(0, 40))) for k in range(40)] + [(40, None), (41, ""), (None, "é zz-yy!"), (43, "zz yy " * 20_000), (44, text(30) + (items[20][1] or ""))]
    return docs, items


def test_contamination_beside_plain_python(spark):
    docs, items = case()
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs + docs[:3]], "doc_id long, text string, words string, start int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    key = lambda x: str(x)
    for limit in (1000, 3):
        found = decontam.contamination(frame, bench, broadcast_windows=limit)
        got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.contaminated) for r in found.collect()]
        assert sorted(got, key=key) == sorted(plain_contamination(docs, items), key=key)
    kept = decontam.without_contaminated(frame, bench)
    assert kept.columns == frame.columns
    bad = {d for d, *_, c in plain_contamination(docs, items) if c}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d[0]) for d in docs + docs[:3] if d[0] not in bad)
    assert decontam.contamination(frame.limit(0), bench).collect() == []
    assert decontam.contamination(frame, bench.limit(0)).where("contaminated").count() == 0


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chain(values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest((v % (1 << 64)).to_bytes(8, "little"), seed)
    return signed(seed)


def plain_anchors(text):
    w = re.findall("[^\x20\x09-\x0d]+", text)
    if len(w) * 32 < len(text):
        w = list(text)
    h = [signed(xxhash.xxh64_intdigest(x.encode(), 42)) for x in w]
    if not h:
        return []
    if len(h) < 5:
        return [(chain(h), 0)]
    first = {}
    for i in range(len(h) - 4):
        if min(h[i], h[i + 4]) <= min(h[i + 1 : i + 4]):
            first.setdefault(chain(h[i : i + 5]), i)
    return sorted(first.items())[:64]


def plain_likeness(a, b):
    union = sorted({x for x, _ in a} | {x for x, _ in b})[:64]
    if not union:
        return 1.0
    other = dict(b)
    shifts = sorted(other[x] - p for x, p in a if x <= union[-1] and x in other)
    j = sum(abs(s - shifts[len(shifts) // 2]) <= 32 for s in shifts) / len(union)
    return 2 * j / (1 + j)


def check_fingerprints(docs, got):
    docs = sorted(((d, t or "") for d, t in docs), key=lambda x: (x[0] is not None, x[0] or 0, x[1]), reverse=True)
    want = {}
    for k, (doc_id, text) in enumerate(docs):
        follow = docs[(k + 1) % len(docs)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + follow[:cut]
        a, b, c = plain_anchors(text), plain_anchors(edited), plain_anchors(follow)
        say = lambda x: ",".join(f"{h % (1 << 64):x}:{p}" for h, p in x)
        row = (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), say(a), say(b), round(plain_likeness(a, b), 9), round(plain_likeness(a, c), 9))
        want.setdefault(doc_id, []).append(row)
    mine = {}
    for r in got:
        row = (r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9))
        mine.setdefault(r.doc_id, []).append(row)
    assert {k: sorted(v) for k, v in mine.items()} == {k: sorted(v) for k, v in want.items()}


def test_fingerprints_of_odd_rows(spark):
    words = " ".join(f"w{k}" for k in range(300))
    docs = [
        (7, words), (5, words), (3, "One two  three four\tfive six\nseven"), (3, "twin"), (3, "twin"), (-2, "é" * 700), (11, ""), (12, None), (13, "a b"),
        (None, "no id at all, but text"), (20, "l o n g " * 9000), (21, "日本語🎉 " * 50), (22, "x " + words), (99, words + " end"),
    ]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, ghost int, next_text string").repartition(4)
    check_fingerprints(docs, syncmers.edited_fingerprints(frame).collect())
    check_fingerprints(docs[:1], syncmers.edited_fingerprints(frame.where("doc_id = 7")).collect())
    assert syncmers.edited_fingerprints(frame.limit(0)).collect() == []
    near = {r.doc_id: r for r in syncmers.edited_fingerprints(frame.where("doc_id in (5, 7, 99)")).collect()}
    assert near[7].near_next == 1.0 and near[99].near_next > 0.9 and near[7].fingerprint == near[5].fingerprint


def test_fingerprints_of_the_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = QUERIES["op7_closed_syncmers"](spark, sf_dir).collect()
    check_fingerprints(docs, got)
    whole = [r for r in got if r.n_chars > 300]
    assert sum(r.near_edited > 0.4 for r in whole) > 0.95 * len(whole)


def test_decontamination_sql(spark, sf_dir):
    db = duckdb.connect()
    for table in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    want = db.sql(ORACLES["op4_decontamination"])
    got = QUERIES["op4_decontamination"](spark, sf_dir)
    assert got.columns == want.columns
    rows = want.fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(rows) and any(r[-1] for r in rows) and not all(r[-1] for r in rows)


def test_no_python_in_native_plans(spark, sf_dir):
    for name in ("op4_decontamination", "op7_closed_syncmers"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)
