"""Personal data and secrets: base spans beside the plain patterns, models, odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest

from evigraph.llm import pii, secrets
from evigraph.llm.queries import QUERIES

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def plain_pii(text):
    out = []
    for kind in pii.KINDS:
        for m in re.finditer(PLAIN[kind], text):
            d = "".join(re.findall("[0-9]", m[0]))
            odd, even = d[-1::-2], d[-2::-2]
            luhn = (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0
            ok = {
                "email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0,
                "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15,
            }[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


def plain_secrets(text):
    out = [("assign", *m.span()) for m in re.finditer(ASSIGN, text, re.ASCII) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda x: (x[1], secrets.KINDS.index(x[0])))


def noise(rng, parts, n=12):
    return "".join(rng.choice(parts) for _ in range(rng.randint(1, n)))


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(5)
    parts = ["@", ".", "a", "b-c", "1", "25", "255", "256", " ", "-", "+", "(", ")", "4539", "5787 6362", "4111 1111 1111 1111", "x@y.zz", "10.0.0.1", "+1 (017) 555-7713", "ö", "\n", "@@", "00", "%"]
    for _ in range(6000):
        text = noise(rng, parts)
        assert pii.base_spans(text) == plain_pii(text), text
    parts = ["password", "Passwd", "secret", "TOKEN", "api_key", "APIkey", "=", ":", " ", '"', "'", "abc", "deadbeef", "0" * 23, "f", "AKIA", "ABCDEFGH12345678", "x", "/+_.", "\n", "İ", "ſ", "ABCD", "K"]
    for _ in range(6000):
        text = noise(rng, parts, 9)
        assert secrets.base_spans(text) == plain_secrets(text), text


def test_base_spans_stay_linear():
    for text in ["1" * 400_000, "a" * 300_000 + "@", "a@" * 100_000, "+" + "1 " * 200_000, "1." * 200_000, "f" * 23 + " "]:
        pii.base_spans(text)
        secrets.base_spans(text)


def beside_plain(spark, sf_dir, name, plain, kinds, order):
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = QUERIES[name](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(text)
    for r in got:
        want = plain(text[r.doc_id])
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in kinds] == [sum(w[0] == k for w in want) for k in kinds]
        every = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in r.spans.split(",") if x)]
        assert set(want) <= set(every) and every == sorted(every, key=order)
    return text, got


def test_personal_data_of_the_table(spark, sf_dir):
    text, got = beside_plain(spark, sf_dir, "op8_personal_data", plain_pii, pii.KINDS, lambda x: (pii.KINDS.index(x[0]), x[1]))
    clean = [r for r in got if not re.search("[0-9@]", text[r.doc_id])]
    assert clean and all(r.spans == "" for r in clean)


def test_secrets_of_the_table(spark, sf_dir):
    text, got = beside_plain(spark, sf_dir, "op10_secret_spans", plain_secrets, secrets.KINDS[:3], lambda x: (x[1], secrets.KINDS.index(x[0])))
    clean = [r for r in got if not re.search("[0-9]", text[r.doc_id])]
    assert clean and all("tagged" not in r.spans for r in clean)


def test_trees_select_look_alikes(spark):
    rng = random.Random(3)
    docs = []
    for k in range(600):
        phone = f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
        docs.append((k, f"please call phone {phone} today" if k % 2 else f"item {rng.randint(1, 99)}.{rng.randint(1, 999)}.{rng.randint(256, 999)} of {rng.randint(100, 999)} 77 8{k}"))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    selector = pii.fit(frame)
    base, added = selector.spans("please call phone (321) 555-0187 today")
    assert base == [] and added == [("phone", 18, 32)]
    assert selector.spans("item 12.13.270 of 100 77 81") == ([], [])
    odd = spark.createDataFrame([(1, None, "k"), (1, "", "k"), (None, "a@b.cc", "k"), (2, "a@b.cc " * 30_000, "k"), (3, "x", None)], "doc_id long, text string, spans string")
    found = {(r.doc_id, r.n_email) for r in pii.find(odd, selector).collect()}
    assert found == {(1, 0), (None, 1), (2, 30_000), (3, 0)}
    clean = pii.redact(odd, selector)
    assert clean.columns == odd.columns
    assert [r.text for r in clean.where("doc_id is null").collect()] == ["<EMAIL>"]
    assert pii.find(odd.limit(0), pii.fit(odd.limit(0))).collect() == []


def test_copies_fill_no_sample(spark):
    rng = random.Random(6)
    sizes = (1, 10, 100)
    ips = [f"server {a}.{b}.{c}.{d} is up" for a in sizes for b in sizes for c in sizes for d in sizes]
    phones = [(3000 + k, f"{'so ' * rng.randint(0, 3)}call phone ({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)} today") for k in range(200)]
    others = [(4000 + k, f"item {rng.randint(1, 99)}.{rng.randint(1, 999)}.{rng.randint(256, 999)} of {rng.randint(100, 999)} 77 8{k}") for k in range(200)]
    for n in (1, 200):  # 200: the copies are many times the sample
        frame = spark.createDataFrame([(k, text) for k, text in enumerate(ips * n)] + phones + others, "doc_id long, text string")
        chosen = pii.sampled(pii.distinct_candidates(frame), 400).to_pylist()
        assert len({(tuple(r["x"]), r["label"]) for r in chosen}) == len(chosen) <= 400
        assert {(r["kind"], r["label"]) for r in chosen} >= {(1, 1.0), (3, 0.0), (3, 1.0)}
        assert max(r["n"] for r in chosen if r["kind"] == 1 and r["label"]) >= n
        sides = {}
        for r in chosen:
            sides.setdefault(tuple(r["x"]), set()).add(r["held"])
        assert all(len(s) == 1 for s in sides.values())
        text = "please call phone (321) 555-0187 today"
        assert pii.fit(frame, sample=400).spans(text) == ([], [("phone", 18, 32)])


def test_trees_and_thresholds_come_from_all_candidates(spark, monkeypatch):
    rng = np.random.default_rng(11)
    table = []
    for k in range(9000):
        x = [0.0, 0.0, 0.0, 1.0, *rng.integers(0, 40, pii.FEATURES - 5).astype(float).tolist(), float(k)]
        table.append((3, x, float(x[4] >= 20 and rng.random() < min(1.0, 0.90 + x[4] / 400)), 1 + int(k % 5)))
    frame = spark.createDataFrame(table, "kind int, x array<double>, label double, n long").repartition(5)
    monkeypatch.setattr(pii, "distinct_candidates", lambda *_: frame)
    monkeypatch.setattr(pii, "sampled", lambda *_: pytest.fail("a sample was taken"))
    selector = pii.fit(spark.createDataFrame([], "doc_id long, text string"), precision=0.95)
    rows = pii._sided(frame).where("held").collect()
    p, n, y = selector.score(np.array([r.x for r in rows])), np.array([r.n for r in rows]), np.array([r.label for r in rows])
    good = [t for t in pii.LEVELS if (over := p >= t).any() and n[over].sum() >= 50 and (n * y)[over].sum() >= 0.95 * n[over].sum()]
    over = lambda t: p >= t
    assert good and (over(selector.thresholds[3]) == over(good[0])).all()


def test_field_prefers_what_it_saw(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    key = lambda: "".join(rng.choice("0123456789abcdefGHIJKL") for _ in range(24))
    docs = [(k, f"{word(4)} {word(6)} " + (f'secret = "{key()}"' if k % 2 else f"order {rng.randint(1000000, 9999999)} {word(3)}") + f" {word(5)}") for k in range(400)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    field = secrets.fit(frame)
    text = 'abc defa secret -> "9a8b7c6d5e4f3G2H1I0JKLab" efg'
    added = field.added(text, secrets.base_spans(text))
    assert [text[s:e] for _, s, e in added] == ["9a8b7c6d5e4f3G2H1I0JKLab"]
    assert field.added("abc order 1234567 efg", []) == []
    odd = spark.createDataFrame([(1, None, "k"), (1, "", "k"), (None, "token=abcdef1", "k"), (2, "token=abcdef1 " * 20_000, "k")], "doc_id long, text string, spans string")
    assert {(r.doc_id, r.n_assign) for r in secrets.find(odd, field).collect()} == {(1, 0), (None, 1), (2, 20_000)}
    assert secrets.find(odd.limit(0), secrets.fit(odd.limit(0))).collect() == []


def test_field_reads_every_token(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    key = lambda: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") for _ in range(24))
    docs = [(k, f"{word(4)} {word(6)} " + (f'secret = "{key()}"' if k % 2 else f'{word(6)} = "{word(5)}"') + f" {word(5)}") for k in range(400)]
    copies = [(1000 + k, docs[1][1]) for k in range(3000)]
    frame = spark.createDataFrame(docs + copies, "doc_id long, text string")
    chosen = secrets.sampled(frame, 200)
    assert len({(x.tobytes(), y.tobytes()) for x, y, _ in chosen}) == len(chosen) <= 200
    assert sum(bool(y.any()) for _, y, _ in chosen) > 50 and max(n for *_, n in secrets.sampled(frame)) > 3000
    field = secrets.fit(frame)
    lone = 'abc defa hiding = "QmFzZVNlYXJldEtleQabcDEF" efg'  # neither a digit nor a name
    assert [lone[s:e] for _, s, e in field.added(lone, [])] == ["QmFzZVNlYXJldEtleQabcDEF"]
    for n in (254, 255, 8190, 8191):  # also across the edges of blocks
        long = "abc " * n + lone
        assert [long[s:e] for _, s, e in field.added(long, [])] == ["QmFzZVNlYXJldEtleQabcDEF"]


def test_scores_by_class_are_the_sums_of_all_features(monkeypatch):
    rng, words = np.random.default_rng(3), random.Random(3)
    field = secrets.Field(rng.normal(0, 1, (secrets.BUCKETS, 3)), rng.normal(0, 1, (3, 3)))
    parts = ["password", "tokenapi_key", "deadbeef", "DEADBEEF12", "AKIA" + "Q" * 16, "İ", "²", "日", "=", "a1b2", "x" * 70, "0" * 64 + "g", "Zz.", "/a+b=", "secretpasswd"]
    plain, described = secrets.Coder(), []
    monkeypatch.setattr(secrets, "describe", lambda token, old=secrets.describe: described.append(token) or old(token))
    for turn in range(60):
        text = " ".join(words.choice(parts) + "".join(words.choice("abcDEF019_+.") for _ in range(words.randint(0, 20))) for _ in range(words.randint(1, 400)))
        tokens, marks = secrets.TOKEN.findall(text), secrets.file_marks(text)
        if turn in (30, 45):
            field.coder.clear()
        want = np.concatenate([field.emit[x].sum(axis=1) for x in plain.blocks(tokens, marks)])
        assert np.allclose(field.scores(tokens, marks), want, atol=1e-9, rtol=0)
    for token in {t for t in plain.known if t.isascii() and len(t) <= 64}:
        assert plain.classes[secrets.describe(token)] == plain.known[token]
    described.clear()
    secrets.Coder().ids(["".join(words.sample("bcdefghijklmnopq", 9)) for _ in range(200)])
    assert len(described) <= 2  # words that look alike are described once


def test_skipped_tokens_are_outside_in_every_best_path():
    rng = np.random.default_rng(9)
    for k in range(600):
        move = rng.normal(0, 2, (3, 3))
        move[0, 2] = -1e4
        field, score = secrets.Field(np.zeros((1, 3)), move), rng.normal(0, 3, (rng.integers(1, 40), 3)) + [k % 7, 0, 0]
        assert field.path(score).tolist() == field.viterbi(score, True, True)


def test_gradient_fits_a_small_chain():
    x = np.array([[1], [2], [3], [4]])
    field = secrets.train([(x, np.array([0, 1, 2, 0]))] * 4, epochs=60)
    assert field.tags(x).tolist() == [0, 1, 2, 0]
