"""Operators against brute force on small fixtures, invariance and idempotence."""

import itertools
import math
import random
import re
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from evigraph import vocab
from evigraph.operators import assemble, diffs, evidence, facts, geography, graph, learning, neighborhood, prefix, resolve, spatial, titles, trials, validate
from evigraph.session import lookup, shared_folder
from evigraph.streaming.leases import work_folder

SRC = "array<struct<label:string,url:string,provider:string>>"
EDGE = f"id string, source string, target string, type string, label string, strength double, context array<string>, year int, sources {SRC}"
NODE = f"id string, label string, node_type string, zone string, starter boolean, era_start int, x double, y double, roles array<string>, aliases array<string>, metadata array<string>, summary string, sources {SRC}"


def edge(ident, source, target, label="plays with", context=(), url=None, strength=0.5, kind="member_of"):
    return (ident, source, target, kind, label, strength, list(context), None, [("s", url, None)] if url else [])


def node(ident, kind="band", zone="z", label=None, starter=False, year=None, x=0.0, y=0.0):
    return (ident, label or ident, kind, zone, starter, year, x, y, [kind], [], [], "", [])


def test_evidence_tiers(spark):
    rows = [
        edge("a", "1", "2", "Wikipedia link signal", url="https://x"), edge("b", "1", "2", context=["wikipedia category: rock"], url="https://x"),
        edge("c", "1", "2", url="https://x"), edge("d", "1", "2", url=" "), edge("e", "1", "2"),
    ]
    got = {r.id: r.tier for r in evidence.with_tier(spark.createDataFrame(rows, EDGE)).collect()}
    assert got == {"a": "research_lead", "b": "research_lead", "c": "source_linked", "d": "curated_unsourced", "e": "curated_unsourced"}


def test_degrees_ignore_leads_and_dangling_ends(spark):
    nodes = spark.createDataFrame([node("a"), node("b"), node("c")], NODE)
    rows = [edge("1", "a", "b"), edge("2", "a", "gone"), edge("3", "b", "c", "wikipedia category signal"), edge("4", "b", "a", strength=None)]
    got = {r.id: (r.degree, r.weighted_degree) for r in graph.degrees(spark.createDataFrame(rows, EDGE), nodes).collect()}
    assert got == {"a": (2, 1.0), "b": (2, 1.0), "c": (0, 0.0)}


def test_lookup_of_a_hot_key(spark):
    facts = spark.createDataFrame([("hub", i) for i in range(200)] + [("x", 1), ("none", 2)], "k string, v int")
    dim = spark.createDataFrame([("hub", "a"), ("x", "b"), ("y", "c")], "name string, w string")
    assert lookup(facts, dim, "k", "name").count() == 201
    assert lookup(facts, dim, "k", "name", "left").where("w is null").count() == 1
    with pytest.raises(ValueError):
        lookup(facts, dim, "k", "name", "full")


def test_shared_folder_follows_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark) == named and work_folder(spark, "x").startswith(f"{named}/x-")
    bare = SimpleNamespace(conf=SimpleNamespace(get=lambda key, *default: {"spark.sql.warehouse.dir": "s3://w"}.get(key, *default)))
    assert shared_folder(bare) == "s3://w/_checkpoints"


def test_ties_of_repeated_ids_are_total(spark):
    nodes = spark.createDataFrame([node("a"), node("b")], NODE)
    twins = [edge("e", "a", "b", strength=0.9), edge("e", "a", "b", strength=0.2)]
    for rows in (twins, twins[::-1]):
        kept = assemble.assemble_edges([spark.createDataFrame(rows, EDGE)], nodes).collect()
        assert [r.strength for r in kept] == [0.2]
    old = spark.createDataFrame([("a", 1)], "id string, v int")
    new = spark.createDataFrame([("a", 2), ("a", 3)], "id string, v int")
    assert [tuple(r) for r in diffs.upsert(old, new, ["id"], [F.desc("v")]).collect()] == [("a", 3)]


def test_positions_and_sums_match_a_plain_sort(spark):
    rnd = random.Random(3)
    rows = [(("hot" if i % 3 else "cold"), rnd.randint(0, 5), f"n{i:05d}", rnd.randint(1, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, k int, id string, w int")
    got = prefix.prefix_sums(df, [("k", False), ("id", True)], {"pos": F.lit(1).cast("bigint"), "run": F.col("w").cast("bigint")}, ["g"])
    want = {}
    for g, part in itertools.groupby(sorted(rows, key=lambda r: (r[0], -r[1], r[2])), key=lambda r: r[0]):
        total = 0
        for i, row in enumerate(part, 1):
            total += row[3]
            want[row[2]] = (i, total)
    assert {r.id: (r.pos, r.run) for r in got.collect()} == want


def test_floor_quantiles(spark):
    rows = [("a", v) for v in (5, 1, 4, 4)] + [("b", 9)]
    df = spark.createDataFrame(rows, "g string, v int")
    assert {r.g: r.m for r in prefix.floor_quantile(df, ["g"], "v", None, "m").collect()} == {"a": 4, "b": 9}
    assert {r.g: r.m for r in prefix.floor_quantile(df, ["g"], "v", 0.25, "m").collect()} == {"a": 1, "b": 9}


def test_floor_quantiles_of_many_values_in_one_group(spark):
    """One group with 20,000 distinct values: exact, and every window is bounded to a slice or to its totals."""
    rnd = random.Random(11)
    values = [rnd.random() for _ in range(20_000)] + [0.5] * 5000
    df = spark.createDataFrame([("hot", v) for v in values] + [(None, 1.5), ("x", None)], "g string, v double").repartition(6)
    got = prefix.floor_quantiles(df, ["g"], "v", {"median": None, "low": 0.1, "least": 0.0, "most": 1.0})
    rows = {r.g: r for r in got.collect()}
    ordered = sorted(values)
    n = len(ordered)
    assert rows["hot"][1:] == (ordered[n // 2], ordered[int((n - 1) * 0.1)], ordered[0], ordered[-1])
    assert rows[None][1:] == (1.5,) * 4 and "x" not in rows
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    running = [line for line in plan.splitlines() if "Window [sum(_n" in line]
    assert running and all("_row" in line for line in running)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small slices would be put together again
    try:
        slices = prefix._in_order(df.where("g = 'hot'").groupBy("g", "v").count(), [("v", True)], ["g"]).groupBy("_slice").count().collect()
        assert len(slices) > 4 and max(r["count"] for r in slices) < 8000
        assert {r.g: r.median for r in prefix.floor_quantiles(df, ["g"], "v", {"median": None}).collect()}["hot"] == ordered[n // 2]
        numbered = prefix.positions(df.where("g = 'hot'").distinct(), [("v", True)], "p", ["g"]).collect()
        assert [r.p for r in sorted(numbered, key=lambda r: r.v)] == list(range(1, 20_002))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_positions_keep_null_groups_and_equal_orders(spark):
    df = spark.createDataFrame([(None, 2), (None, None), ("a", 1), ("a", 3), ("a", 2)], "g string, v int")
    got = prefix.positions(df, [("v", True)], "p", ["g"]).collect()
    assert sorted((r.g or "", r.p, r.v or 0) for r in got) == [("", 1, 0), ("", 2, 2), ("a", 1, 1), ("a", 2, 2), ("a", 3, 3)]
    before = prefix.with_previous(df, ["g"], [("v", True)], [F.col("v")], "was").collect()
    assert sorted((r.g or "", r.v or 0, r.was and (r.was.v or 0)) for r in before if r.was) == [("", 2, 0), ("a", 2, 1), ("a", 3, 2)]


def test_cap_counts_repeated_ids(spark):
    facts = spark.createDataFrame([("e", "a"), ("e", "a"), ("e", "a"), ("e", "b"), ("f", "c"), (None, "z"), (None, "z"), (None, "z")], "entity_id string, id string")
    assert sorted((r.key, r.detail) for r in validate.over_cap(facts, 2).collect()) == [("a", "e"), ("b", "e")]


def test_labels_sort_by_locale(spark):
    labels = ["Zebra", "apple", "Ärger", "arger", "ea", "Éa", "b", "B", "éb", "_x", "10", "Ea"]
    nodes = spark.createDataFrame([(f"n{k:02d}", label, False, "band") for k, label in enumerate(labels)], "id string, label string, starter boolean, node_type string")
    page = [r.label for r in neighborhood.map_page(nodes, "artists", 20).collect()]
    assert page == ["_x", "10", "apple", "arger", "Ärger", "b", "B", "ea", "Ea", "Éa", "éb", "Zebra"]
    zoned = nodes.selectExpr("id", "label", "'z' as zone", "'band' as node_type", "cast(null as int) as era_start")
    base = {r.position: labels[int(r.id[1:])] for r in graph.stable_positions(zoned, ["band"]).collect()}
    assert [base[k] for k in sorted(base)] == ["_x", "10", "apple", "Ärger", "arger", "b", "B", "ea", "Éa", "Ea", "éb", "Zebra"]


def test_grid_pairs_equal_all_pairs(spark):
    rnd = random.Random(5)
    rows = [node(f"n{i:03d}", rnd.choice(["band", "genre", "artist"]), rnd.choice("xy"), "L" * rnd.randint(1, 40), x=rnd.uniform(-900, 900), y=rnd.uniform(-400, 400)) for i in range(300)]
    rows += [node(f"s{i}", x=1.0, y=1.0) for i in range(12)]
    df = spark.createDataFrame(rows, NODE)
    radius = {"genre": 104, "band": 82, "artist": 68}
    near, boxes = set(), set()
    for a, b in itertools.combinations(sorted(rows), 2):
        gap = ((a[6] - b[6]) ** 2 + (a[7] - b[7]) ** 2) ** 0.5
        if gap < (radius[a[2]] + radius[b[2]]) * (0.72 if a[3] == b[3] else 0.5):
            near.add((a[0], b[0]))
        wa, wb = (min(540, max(120, 32 + 16 * len(v[1]))) for v in (a, b))
        if abs(a[6] - b[6]) < (wa + wb) / 2 and abs(a[7] - b[7]) < 88:
            boxes.add((a[0], b[0]))
    assert {(r.a, r.b) for r in spatial.proximity_pairs(df).collect()} == near
    assert {(r.a, r.b) for r in spatial.label_overlaps(df).collect()} == boxes


def test_similar_pairs_equal_all_pairs(spark):
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(30)]
    rows = [(rnd.choice("ab"), " ".join(rnd.sample(words, rnd.randint(2, 12)))) for _ in range(120)]
    rows += [(g, t + " extra") for g, t in rows[:40]] + rows[:30]
    left, right = rows[::2], rows[1::2]

    def sets(part):
        return {(g, tuple(sorted(set(re.findall("[a-z0-9]+", t))))) for g, t in part}

    want = {
        (a, b) for ga, a in sets(left) for gb, b in sets(right)
        if ga == gb and len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.64
    }
    schema = "g string, text string"
    got = facts.similar_pairs(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["g"])
    assert {(tuple(r.left_set), tuple(r.right_set)) for r in got.collect()} == want


def test_fact_leads_follow_the_rules(spark):
    band = (
        "The band recorded its debut in a basement with borrowed gear over winter. "
        "Their first album was recorded in a garage near the harbour town. "
        "Harbour took their name from a lighthouse that stood near the rehearsal room. "
        "Somebody else recorded a session in a garage down the road that year."
    )
    person = "Stone was born as a child and named after a saint by his parents. Stone lost a finger while working and damaged his hand badly."
    rows = [("b", "Harbour", "band", band), ("p", "Adam Stone", "artist", person)]
    found = facts.candidate_leads(spark.createDataFrame(rows, "entity_id string, label string, node_type string, extract string"))
    got = {(r.entity_id, r.category, r.order): r.score for r in found.collect()}
    assert got == {("b", "recording-story", 0): 5, ("b", "name-origin", 2): 8, ("p", "playing-technique", 1): 6} or got == {
        ("b", "name-origin", 2): 8, ("p", "playing-technique", 1): 6, ("b", "recording-story", 0): 5,
    }


def test_bias_and_used_categories_change_scores(spark):
    rows = [("b", "Harbour", "band", "Harbour took their name from a lighthouse near town.")]
    df = spark.createDataFrame(rows, "entity_id string, label string, node_type string, extract string")
    bias = spark.createDataFrame([("name-origin", 2)], "category string, bias int")
    used = spark.createDataFrame([("b", "name-origin")], "entity_id string, category string")
    assert [r.score for r in facts.candidate_leads(df, bias).collect()] == [9]
    assert [r.score for r in facts.candidate_leads(df, bias, used).collect()] == [7]


def test_fingerprint_ignores_order_and_sees_changes(spark):
    rows = [node(f"n{i}", x=float(i)) for i in range(20)]
    edges = spark.createDataFrame([edge("1", "n1", "n2"), edge("2", "n3", "n4")], EDGE)
    first = diffs.graph_fingerprint(spark.createDataFrame(rows, NODE), edges, "artists").first()[0]
    again = diffs.graph_fingerprint(spark.createDataFrame(rows[::-1], NODE).repartition(5), edges, "artists").first()[0]
    moved = diffs.graph_fingerprint(spark.createDataFrame([node("n0", x=0.5)] + rows[1:], NODE), edges, "artists").first()[0]
    assert first == again != moved


def test_append_and_upsert_are_idempotent(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    patch = spark.createDataFrame([("b", 9), ("c", 3), ("c", 4)], "id string, v int")
    once = diffs.append_missing(old, patch, ["id"], [F.asc("v")])
    twice = diffs.append_missing(once, patch, ["id"], [F.asc("v")])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [("a", 1), ("b", 2), ("c", 3)]
    new = spark.createDataFrame([("b", 9)], "id string, v int")
    assert sorted(map(tuple, diffs.upsert(diffs.upsert(old, new, ["id"], [F.desc("v")]), new, ["id"], [F.desc("v")]).collect())) == [("a", 1), ("b", 9)]


def test_guarded_append_is_all_or_nothing(spark):
    live = spark.createDataFrame([("a", "Alpha"), ("b", "Beta")], "id string, label string")
    rows = spark.createDataFrame([("c", "Gamma"), ("d", "ALPHA")], "id string, label string")
    states = diffs.missing_or_conflict(rows, live, "id", "label")
    assert {r.id: r.state for r in states.collect()} == {"c": "missing", "d": "conflict"}
    assert diffs.guarded_append(live, rows, states, "id").count() == 2
    assert diffs.guarded_append(live, rows, states.where("id = 'c'"), "id").count() == 3


def test_batch_gate_rejects_bad_batches(spark):
    schema = "id string, type string, tier string"
    before = spark.createDataFrame([("1", "member_of", "source_linked")], schema)
    ledger = spark.createDataFrame([("2",)], "edge_id string")
    good = before.union(spark.createDataFrame([("2", "member_of", "source_linked")], schema))
    bad = spark.createDataFrame([("1", "plays", "source_linked"), ("3", "member_of", "research_lead")], schema)
    assert diffs.batch_gate(before, good, ledger).count() == 0
    assert {r.rule for r in diffs.batch_gate(before, bad, ledger).collect()} == {"existing_changed", "unreviewed_addition"}
    assert {r.rule for r in diffs.batch_gate(before, before, ledger).collect()} == {"addition_count"}


def test_graph_gate_passes_a_reviewed_batch(spark):
    ident = "0123456789abcdef0123456789abcdef0123"
    source = [("MB", f"https://musicbrainz.org/artist/{ident}", "musicbrainz")]
    kinds = "sources array<struct<label:string,url:string,provider:string>>"
    node_kind = f"id string, node_type string, x double, y double, {kinds}"
    edge_kind = f"id string, type string, source string, target string, {kinds}"
    old = [("a", "artist", 0.0, 0.0, [])]
    band = (f"mb-band-{ident}", "band", 1.0, 2.0, source)
    link = ("e", "member_of", "a", band[0], source)
    nodes = lambda rows: spark.createDataFrame(rows, node_kind)
    edges = lambda rows: spark.createDataFrame(rows, edge_kind)
    ledger = spark.createDataFrame([("typed_connection", "e")], "kind string, edge_id string")
    after = (nodes([*old, band]), edges([link]))
    moved = (nodes([(*band[:2], 9.0, 9.0, source)]), edges([link]))
    assert diffs.graph_gate((nodes(old), edges([])), after, after, moved, ledger).collect() == []
    weak = (nodes([*old, band]), edges([(*link[:4], [])]))
    rules = {(r.rule, r.key) for r in diffs.graph_gate((nodes(old), edges([])), weak, after, moved, ledger).collect()}
    assert rules == {("new_edge", "e"), ("published_edge", "e")}
    none = spark.createDataFrame([], ledger.schema)
    assert {r.rule for r in diffs.graph_gate((nodes(old), edges([])), after, after, moved, none).collect()} == {"new_node"}
    twice = (nodes([("a", "artist", 5.0, 0.0, []), band, band]), edges([link]))
    assert {r.rule for r in diffs.graph_gate((nodes(old), edges([])), twice, twice, moved, ledger).collect()} == {"duplicate_node", "existing_node"}


def test_co_occurrence_makes_each_pair_once(spark):
    rows = [("r", m) for m in ("c", "a", "b", "a")] + [("s", "a"), ("s", "b")]
    got = assemble.co_occurrence(spark.createDataFrame(rows, "release_id string, member string"))
    assert sorted((r.release_id, r.source, r.target) for r in got.collect()) == [("r", "a", "b"), ("r", "a", "c"), ("r", "b", "c"), ("s", "a", "b")]


def test_reach_is_breadth_first(spark):
    rows = [edge(str(i), a, b) for i, (a, b) in enumerate([("a", "b"), ("c", "b"), ("c", "d"), ("e", "f")])]
    got = neighborhood.reach(spark.createDataFrame(rows, EDGE), spark.createDataFrame([("a",)], "id string"), 3)
    assert {r.id: r.level for r in got.collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_ambiguous_claims_are_refused(spark):
    from evigraph.schemas import CLAIM

    def claim(entity, prop, sid, rank="normal", item=None, lat=None, lon=None, globe=geography.EARTH):
        return (entity, prop, sid, rank, "value", item, None, None, lat, lon, globe, [])

    rows = [
        claim("Q1", "P19", "1", item="Q5"), claim("Q1", "P19", "2", item="Q6"),
        claim("Q2", "P19", "3", item="Q5"), claim("Q2", "P19", "4", "preferred", "Q6"), claim("Q3", "P19", "5", "deprecated", "Q5"),
        claim("Q5", "P625", "6", lat=1.0, lon=1.0), claim("Q5", "P625", "7", lat=1.02, lon=1.0),
        claim("Q6", "P625", "8", lat=1.0, lon=1.0), claim("Q6", "P625", "9", lat=1.005, lon=1.0), claim("Q6", "P625", "a", lat=50.0, lon=1.0, globe="moon"),
    ]
    df = spark.createDataFrame(rows, CLAIM)
    assert {r.entity_id: r.item for r in geography.single_items(df.where("property = 'P19'")).collect()} == {"Q2": "Q6"}
    assert {(r.entity_id, r.lat) for r in geography.points(df).collect()} == {("Q6", 1.0)}


def test_one_vote_per_seed_and_unseen_seeds_in_holdout(spark):
    rows = [(f"i{i}", f"s{i % 9}", i % 2 == 0, 1.0 if i % 3 else 0.2, "k", "", i) for i in range(90)]
    df = spark.createDataFrame(rows, "id string, seed_key string, positive boolean, weight double, kind string, zone string, reviewed_at int")
    votes = learning.usable(df.withColumn("skip", F.lit(None).cast("string"))).groupBy("seed_key").agg(F.sum("learning_weight").alias("v"))
    assert all(abs(r.v - 1) < 1e-9 for r in votes.collect())
    sides = learning.split_holdout(df).groupBy("seed_key").agg(F.collect_set("side").alias("s")).collect()
    held = {r.seed_key for r in sides if r.s == ["holdout"]}
    assert all(len(r.s) == 1 for r in sides) and len(held) == 4 and held == {"s8", "s7", "s6", "s5"}
    few = learning.split_holdout(df.limit(10)).select("side").distinct().collect()
    assert [r.side for r in few] == ["train"]


def test_zone_scores_words_and_phrases(spark):
    texts = spark.createDataFrame([(1, "hard rock and rocks", "x"), (2, "hard edge", "")], "id int, text string, zone string")
    terms = spark.createDataFrame([("x", "hard rock", None), ("y", "rock", None), ("y", "edge", 100.0), ("y", "ock", None)], "zone string, term string, weight double")
    got = {(r.id, r.zone): r.score for r in trials.zone_scores(texts, terms).collect()}
    assert got == {(1, "x"): 4.0, (1, "y"): 2.0, (2, "y"): 6.0}
    plan = trials.zone_scores(texts, terms)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan
    inner = spark.createDataFrame([("x", "ard roc", None)], "zone string, term string, weight double")
    assert [(r.id, r.score) for r in trials.zone_scores(texts, inner).where("zone = 'x' and score > 1").collect()] == [(1, 4.0)]


def test_phrases_equal_a_plain_substring_search(spark):
    rng = random.Random(4)
    letters = ["a", "b", "ab", "ba", "aab", "bbaa", "cab", "of"]
    texts = [(i, " ".join(rng.choice(letters) for _ in range(rng.randrange(0, 12)))) for i in range(150)] + [(999, None), (998, "a  b")]
    phrases = sorted({" ".join(rng.choice(letters) for _ in range(rng.randrange(2, 5))) for _ in range(250)}) + ["b a ", " ab a", "a  b", "zzz of a", "x y"]
    got = trials.phrase_hits(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(p,) for p in phrases] * 2, "term string"))
    want = sorted((i, p) for i, t in texts for p in phrases if t is not None and p in t)
    assert sorted((r.id, r.term) for r in got.collect()) == want and len(want) > 300
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "collect_list" not in plan


def test_a_frequent_word_gives_no_candidates(spark):
    """A phrase is looked up by its rarest word only: `the` in every text brings nothing to be checked."""
    texts = spark.createDataFrame([(i, f"in the night {'w%d' % i} of the moon") for i in range(400)] + [(1000, "over the pale moon again")], "id int, text string")
    phrases = spark.createDataFrame([("over the pale moon",), ("in the dusk of",), ("the night",)], "term string")
    got = trials.phrase_hits(texts, phrases)
    assert sorted(r.id for r in got.where("term <> 'the night'").collect()) == [1000]
    assert got.where("term = 'the night'").count() == 400


def place(k, lat, lon, name="Springfield", country="US"):
    return (f"p{k:05d}", name, country, float(lat), float(lon))


PLACE = "place_id string, name string, country string, lat double, lon double"


def plain_same(rows):
    out = set()
    for a, b in itertools.combinations(sorted(rows), 2):
        apart = abs(a[4] - b[4])
        near = min(apart, abs(360 - apart)) < 0.15 or (abs(a[3]) > 89.85 and abs(b[3]) > 89.85)
        if a[1].strip().lower() == b[1].strip().lower() and a[2].strip().lower() == b[2].strip().lower() and abs(a[3] - b[3]) < 0.15 and near:
            out.add((a[0], b[0]))
    return out


def test_same_places_around_the_date_line_and_the_poles(spark):
    rng = random.Random(8)
    rows = [place(k, rng.uniform(-1, 1), (179.5 + rng.random() + 180) % 360 - 180, rng.choice(["Springfield", " springfield "])) for k in range(300)]
    rows += [place(400 + k, rng.choice([-1, 1]) * rng.uniform(89.6, 90), rng.uniform(-180, 180)) for k in range(120)]
    rows += [place(600, 0, 180), place(601, 0, -180), place(602, 0.1, 179.9), place(603, 90, 0), place(604, 90, 180), ("p00605", "Springfield", "US", None, 1.0), ("p00606", None, "US", 0.0, 180.0)]
    known = [r for r in rows if r[1] is not None and r[3] is not None]
    got = [tuple(r) for r in spatial.same_place_pairs(spark.createDataFrame(rows, PLACE)).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_same(known) and ("p00600", "p00601") in set(got)


def test_ten_thousand_places_of_one_name_meet_only_where_they_are_near(spark):
    rng = random.Random(9)
    rows = [place(k, rng.uniform(-80, 80), rng.uniform(-180, 180)) for k in range(10_000)]
    frame = spark.createDataFrame(rows, PLACE)
    got = {tuple(r) for r in spatial.same_place_pairs(frame).collect()}
    cells = {}
    for r in rows:
        cells.setdefault((math.floor(r[3] / 0.2), math.floor(r[4] / 0.2)), []).append(r)
    want = set()
    for (y, x), own in cells.items():
        near = [r for dy in (-1, 0, 1) for dx in (-1, 0, 1) for r in cells.get((y + dy, x + dx), [])]
        want |= {(a[0], b[0]) for a in own for b in near if a[0] < b[0] and abs(a[3] - b[3]) < 0.15 and abs(a[4] - b[4]) < 0.15}
    assert got == want and 20 < len(got) < 2000


def test_a_huge_release_is_many_tiles(spark):
    rows = [("hot", f"m{k:04d}") for k in range(1500)] + [("small", "a"), ("small", "b"), ("one", "a")]
    frame = spark.createDataFrame(rows * 2, "release_id string, member string")
    got = assemble.co_occurrence(frame, block=100)
    assert got.count() == 1500 * 1499 // 2 + 1 and got.select("release_id", "source", "target").distinct().count() == got.count()
    assert got.where("source >= target").count() == 0
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan


def test_scope_order(spark):
    rows = [("Category:Rock albums", "genre", "category"), ("Deep Purple", "band", "link"), ("1999 tour", "band", "link"), ("Rock duos", "genre", "link"), ("Solar", "band", "template"), ("Solar", "band", "")]
    df = spark.createDataFrame(rows, "t string, k string, s string")
    got = [r[0] for r in df.select(titles.scope_reason(F.col("t"), F.col("k"), F.col("s"))).collect()]
    assert got == [
        "category, list, history or geography page", "release page, not a map entity", "year/date page", "category-style grouping, not a concrete music genre",
        "weak category/template signal for non-genre candidate", None,
    ]


def test_missing_columns_are_found_before_a_write(spark):
    from pyspark.sql.types import IntegerType, StructField, StructType

    expected = StructType([StructField("id", IntegerType()), StructField("era_start", IntegerType())])
    assert validate.missing_columns(spark.range(1), expected) == ["era_start"]


def test_vocabularies_are_distinct():
    for name in ("OUT_OF_SCOPE_TERMS", "RELEASE_TERMS", "MUSIC_TERMS", "NODE_KINDS", "RELATION_TYPES"):
        values = getattr(vocab, name)
        assert len(values) == len(set(values))


def test_earliest_era_bound_is_the_callers(spark):
    df = spark.createDataFrame([("model 2028",), ("model 2026 and 2029",)], "t string")
    none = F.lit(None).cast("int")
    capped, whole = (evidence.infer_era(none, none, none, none, F.col("t"), earliest=True, **more) for more in ({}, {"last_year": None}))
    assert [tuple(r) for r in df.select(capped, whole).collect()] == [(vocab.EARLIEST_YEAR_DEFAULT, 2028), (2026, 2026)]


def test_similar_pairs_keep_groups_apart_that_read_alike(spark, monkeypatch):
    rows = spark.createDataFrame([("a", "b c"), ("a b", "c"), (None, "b c")], "g string, text string")
    for slots in (facts.WORD_SLOTS, 1):  # with one slot every word ranks alike
        monkeypatch.setattr(facts, "WORD_SLOTS", slots)
        got = sorted((r.g, tuple(r.left_set), tuple(r.right_set)) for r in facts.similar_pairs(rows, rows, ["g"]).collect())
        assert got == [("a", ("b", "c"), ("b", "c")), ("a b", ("c",), ("c",))]


def test_similar_pairs_shuffle_no_words_one_by_one(spark):
    rows = spark.createDataFrame([("a", "b c"), ("a", "b c d")], "g string, text string")
    plan = facts.similar_pairs(rows, rows, ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_key" in plan and "hashpartitioning(_token" not in plan and "Window" not in plan
    assert "bit_count" in plan


def test_catalogue_is_cut_to_one_entry_a_name_before_seeds_meet_it(spark):
    seeds = spark.createDataFrame(
        [(1, "The_Act", "band", None), (2, "the act ", "band", None), (3, "the act", "artist", "i9"), (4, "the act", "genre", None), (5, "x", None, "i4"), (6, "y", "band", "none"), (7, "The Act", "artist", None)],
        "p long, seed string, kind string, linked_id string",
    )
    entries = [("i1", "The Act", "Group", None, 2), ("i2", "the_act", "Group", "", 1), ("i3", "The Act", "Other", "a singer", 3), ("i4", "The Act", None, "", 0), ("i9", "z", "Person", "", 5), ("i9", "z", "Person", "", 4)]
    catalogue = spark.createDataFrame(entries, "item_id string, name string, type string, description string, rank int")
    got = resolve.catalogue_match(seeds, catalogue, ["p"])
    assert sorted((r.p, r.item_id, r.matched_by) for r in got.collect()) == [(1, "i2", "name"), (2, "i2", "name"), (3, "i9", "linked"), (5, "i4", "linked"), (7, "i3", "name")]
    by_name = resolve.catalogue_match(seeds, catalogue)
    assert {(r.seed, r.kind, r.item_id, r.matched_by) for r in by_name.collect()} >= {("the act", "artist", "i9", "linked"), ("The_Act", "band", "i2", "name")}


def test_batch_gate_takes_rows_that_are_repeated_on_both_sides(spark):
    schema = "id string, type string, tier string"
    twice = spark.createDataFrame([("1", "plays", "a"), ("1", "member_of", "a"), ("2", None, "a")], schema)
    more = twice.union(spark.createDataFrame([("3", "plays", "source_linked"), ("4", "member_of", "source_linked")], schema))
    ledger = spark.createDataFrame([("3",), ("4",)], "edge_id string")
    rules = lambda old, new: sorted((r.rule, r.key, r.detail) for r in diffs.batch_gate(old, new, ledger).collect())
    assert rules(twice, more) == [("unreviewed_addition", "3", "plays")]
    swapped = more.withColumn("type", F.expr("case when id = '1' then 'plays' else type end"))
    assert rules(twice, swapped) == [("existing_changed", "1", ""), ("unreviewed_addition", "3", "plays")]
    nulls = more.withColumn("tier", F.when(F.col("id") == "2", F.lit(None)).otherwise(F.col("tier"))).withColumn("type", F.when(F.col("id") == "2", "a").otherwise(F.col("type")))
    assert rules(twice, nulls)[0] == ("existing_changed", "2", "")


def test_gates_shuffle_each_side_once(spark):
    schema = "id string, type string, tier string"
    rows = spark.createDataFrame([("1", "plays", "a")], schema)
    ledger = rows.selectExpr("id as edge_id")
    plan = diffs.batch_gate(rows, rows, ledger).select("rule", "key")._jdf.queryExecution().executedPlan().toString()
    assert "FullOuter" not in plan and "sha2" not in plan and "SortAggregate" not in plan
