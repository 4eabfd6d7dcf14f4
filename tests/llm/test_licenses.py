"""License scans beside all windows of all texts, bands that keep their promise, odd rows, no Python in the plan."""

import math
import random
import re

from evigraph.llm import licenses
from evigraph.llm.queries import QUERIES

DOCS = "source string, doc_id long, text string, template_id string, w int"


def words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]


def shingles(all_words, k):
    return {" ".join(all_words[i : i + k]) for i in range(len(all_words) - k + 1)}


def plain(docs, templates, share=0.75):
    """(doc_id, template_id) -> (containment, first word, windows) over every window."""
    out = {}
    for doc_id, text in docs:
        mine = words(text)
        for name, template in templates:
            t = words(template)
            if not t or name is None:
                continue
            k, need = min(5, len(t)), shingles(t, min(5, len(t)))
            for start in range(0, max(len(mine), 1), len(t)):
                both = len(need & shingles(mine[start : start + 2 * len(t)], k))
                if both >= math.ceil(share * len(need) - 1e-9):
                    best, first, n = out.get((doc_id, name), (0, start, 0))
                    out[doc_id, name] = (max(best, both / len(need)), first, n + 1)
    return out


def found(frame):
    return {(r.doc_id, r.template_id): (r.containment, r.word, r.windows) for r in frame.collect()}


def test_query_beside_all_windows(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = plain(docs, licenses.LICENSES)
    by_doc = {}
    for doc_id, name in want:
        by_doc.setdefault(doc_id, []).append(name)
    got = QUERIES["op3_license_scans"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in docs)
    for r in got:
        names = sorted(by_doc.get(r.doc_id, []))
        assert (r.n_licenses, r.licenses) == (len(names), ",".join(names))
        assert r.containment == max((want[r.doc_id, n][0] for n in names), default=0.0)
    assert sum(r.n_licenses for r in got) >= 3


def test_cut_and_changed_notices(spark):
    rng = random.Random(6)
    filler = [f"w{k}" for k in range(300)]
    docs = []
    for k in range(240):
        _, text = rng.choice(licenses.LICENSES)
        body = words(text)
        for _ in range(rng.randrange(4)):
            body[rng.randrange(len(body))] = rng.choice(["x", "the"])
        body = body[rng.randrange(3) :] if rng.random() < 0.4 else body
        before, after = rng.choices(filler, k=rng.randrange(200)), rng.choices(filler, k=rng.randrange(80))
        docs.append((k, " ".join([*before, *body, *after])))
    frame = spark.createDataFrame([("s", i, t, "x", 1) for i, t in docs], DOCS).repartition(4)
    want = plain(docs, licenses.LICENSES)
    got = found(licenses.scan(frame, licenses.license_templates(spark)))
    assert set(got) <= set(want) and len(set(want) - set(got)) <= 1 and len(want) > 80
    assert all(got[k][0] == want[k][0] for k in got)
    assert found(licenses.scan(frame, licenses.license_templates(spark), broadcast_bands=0)) == got


def test_bands_follow_from_the_probability(spark):
    bands = {}
    for r in licenses.template_bands(licenses.license_templates(spark)).collect():
        bands.setdefault(r.template_id, []).append(r)
    for name, rows in bands.items():
        n, size, needed, length = rows[0].n, len(rows[0].shingles), rows[0].needed, rows[0].length
        least = needed / (2 * n - length + 1 + size - needed)
        assert 1 - (1 - least) ** len(rows) >= 0.9999 > 1 - (1 - least) ** (len(rows) - 1), name
        assert all(r.shingle in r.shingles for r in rows)


def test_odd_rows(spark):
    templates = spark.createDataFrame([("a", "one two"), ("b", None), (None, "three four"), ("c", " . "), ("d", "alpha beta gamma delta epsilon zeta eta"), ("a", "one two")], "template_id string, text string")
    long = "filler " * 60_000 + "One, two! " + "filler " * 60_000
    data = [(1, "ONE two"), (1, "ONE two"), (1, "else"), (2, None), (3, ""), (4, "one"), (None, "say one two"), (5, long), (6, "alpha beta gamma delta epsilon zeta eta " * 3)]
    frame = spark.createDataFrame([("s", i, t, "x", 1) for i, t in data], DOCS).repartition(3)
    got = sorted(((r.doc_id or 0, r.n_licenses, r.licenses, r.containment) for r in licenses.license_digest(frame, templates).collect()))
    assert got == sorted([(1, 1, "a", 1.0), (1, 1, "a", 1.0), (1, 0, "", 0.0), (2, 0, "", 0.0), (3, 0, "", 0.0), (4, 0, "", 0.0), (0, 1, "a", 1.0), (5, 1, "a", 1.0), (6, 1, "d", 1.0)])
    assert licenses.license_digest(frame.limit(0), templates).collect() == []
    assert {r.n_licenses for r in licenses.license_digest(frame, templates.limit(0)).collect()} == {0}


def test_no_python_in_the_plan(spark, sf_dir):
    plan = QUERIES["op3_license_scans"](spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
