"""Plans whose cost must grow no faster than the input."""

import random
import unicodedata
from types import SimpleNamespace

from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from evigraph.functions import text
from evigraph.operators import assemble, diffs, evidence, facts, geography, graph, prefix, promotion, validate
from evigraph.plans import graph_queries, promotion_queries, views
from evigraph.sources import readers
from evigraph.streaming import review_log


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_conditions_on_notes_do_not_parse_them_again(spark):
    notes = spark.createDataFrame([("a", "---\nid: x\nid: y\ntype: band\n---"), ("b", "---\ntype: band\n---"), ("c", "no head")], "path string, value string")
    found, warnings = readers.parse_notes(notes)
    assert [r.id for r in found.collect()] == ["y"]
    assert sorted(r.key for r in warnings.collect()) == ["b", "c"]
    for rows in (found, warnings):
        assert optimized(rows).count("regexp_extract(value") == 1


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_relations_meet_their_nodes_without_a_sort_or_a_broadcast(spark, sf_dir):
    """A broadcast that ends at some size makes the shuffled bytes jump, a sort of the relations spills beyond it."""
    edges, nodes = views.relations(spark, sf_dir).select("id", "source", "target", "strength", "label", "context", "sources"), views.entities(spark, sf_dir).select("id", "label", "node_type", "zone")
    for rows, joins in ((graph.end_kinds(edges, nodes), 2), (evidence.induced_edges(edges, nodes), 2), (graph.degrees(edges, nodes), 3)):
        assert physical(rows).count("ShuffledHashJoin") >= joins  # Spark may push them below a union
    assert physical(validate.audit_edges(edges.withColumn("type", F.lit("plays")), nodes)).count("ShuffledHashJoin") >= 2


def test_packages_are_grouped_before_their_candidates_are_made(spark, sf_dir):
    plan = optimized(views.packages(spark, sf_dir).select(F.explode("payload.music_candidates")))
    grouped = plan[plan.index("Aggregate [l_orderkey"):]
    assert "documented_relation" not in grouped and "Player" not in grouped
    assert plan.count("Join ") == 1


def test_folding_stays_in_arrow(spark):
    words = ["Ärger", "ascii only", "ﬁn Å ё", None, "한국 ½"]
    strip = lambda v: "".join(c for c in unicodedata.normalize("NFKD", v) if not 0x300 <= ord(c) <= 0x36F)
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").select("i", text._strip_marks("w").alias("t"))
    assert {r.i: r.t for r in rows.collect()} == {i: None if w is None else strip(w) for i, w in enumerate(words)}
    assert text._strip_marks.evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF


def test_zones_of_neighbours_lose_repeats_before_they_travel(spark):
    nodes = spark.createDataFrame([(i, i, "band", z) for i, z in (("a", "x"), ("b", "y"), ("c", "y"))], "id string, label string, node_type string, zone string")
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "b"), ("a", "gone")], "source string, target string")
    zones = graph.zones_of_neighbours(graph.end_kinds(edges, nodes))
    assert sorted(map(tuple, zones.collect())) == [("a", "y"), ("b", "x"), ("b", "y"), ("c", "x"), ("c", "y")]
    plan = physical(zones)
    assert plan.count("HashAggregate") - plan.count("ObjectHashAggregate") >= 2


def test_profiles_read_the_relations_once(spark, sf_dir):
    """Sums and policies of a node come from the same links; a second join of the relations doubled what was shuffled."""
    plan = optimized(graph_queries.profiles(spark, sf_dir))
    assert plan.count("inline(array(named_struct(id, concat(m-") == 1 and "Expand" not in plan
    slim = optimized(graph_queries.profiles(spark, sf_dir).drop("weighted_degree"))
    assert "round((l_discount" in plan and "round((l_discount" not in slim


def test_sums_of_nodes(spark):
    nodes = spark.createDataFrame(
        [("a", "A", "band", "x"), ("b", "B", "band", "y"), ("c", "C", "artist", "y"), ("g", "G", "genre", "z"), ("n", "N", "band", None), ("e", "E", "band", ""), ("o", "O", "band", "x")],
        "id string, label string, node_type string, zone string",
    )
    edges = spark.createDataFrame(
        [("a", "b", 1.0), ("a", "c", None), ("a", "g", 0.25), ("n", "a", 2.0), ("e", "b", 1.0), ("a", "a", 1.0), ("a", "gone", 9.0), ("b", "g", 1.0)], "source string, target string, strength double"
    )
    policies = spark.createDataFrame(
        [("p", ["x", "Y"], ["O"], False), ("q", ["x", "y"], ["a"], True), ("r", ["y", "z"], [], False)], "policy string, zones array<string>, anchors array<string>, anchors_only boolean"
    )
    sums = graph.node_sums(nodes, graph.node_links(graph.end_kinds(edges, nodes), nodes), policies)
    names = ["id", "degree", "weighted_degree", "zone_links", "genre_links", "policies", "anchored"]
    assert sorted(map(tuple, sums.select(names).collect())) == [
        ("a", 6, 5.75, 2, 1, 3, 1), ("b", 3, 3.0, 2, 1, 2, 0), ("c", 1, 0.5, 1, 0, 1, 0), ("e", 1, 1.0, 1, 0, 0, 0), ("g", 2, 1.25, 2, 0, 2, 0), ("n", 1, 2.0, 1, 0, 0, 0), ("o", 0, 0.0, 0, 0, 1, 1),
    ]


def test_placements_are_sorted_once(spark):
    """Rows that pack well end up in few tasks, and each further sort holds them again."""
    rows = spark.createDataFrame([("a", "r", "q"), ("a", "r", "p"), ("a", "s", "z"), ("gone", "r", "p")], "node_id string, role string, place_id string")
    inferred = rows.union(spark.createDataFrame([("b", "r", "y")], rows.schema))
    found = geography.precedence(rows.where("role = 'r'"), rows.limit(0), inferred, spark.createDataFrame([("a",), ("b",)], "id string"))
    assert sorted(map(tuple, found.collect())) == [("a", "r", "p"), ("a", "s", "z"), ("b", "r", "y")]
    plan = physical(found)
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_graph_gate_compares_by_numbers(spark):
    """Joins of digests sorted every copy of the nodes several times in one task."""
    nodes = spark.createDataFrame([("a", "artist", 0.0, 0.0, []), ("b", "band", 1.0, 1.0, [])], "id string, node_type string, x double, y double, sources array<struct<label:string,url:string,provider:string>>")
    edges = spark.createDataFrame([], "id string, type string, source string, target string, sources array<struct<label:string,url:string,provider:string>>")
    ledger = spark.createDataFrame([], "kind string, edge_id string")
    moved = nodes.withColumn("x", F.col("x") + 1)
    found = diffs.graph_gate((nodes.where("id = 'a'"), edges), (moved, edges), (nodes, edges), (nodes, edges), ledger)
    assert sorted(map(tuple, found.collect())) == [("existing_node", "a"), ("new_node", "b"), ("published_node", "a"), ("published_node", "b")]
    allowed = spark.createDataFrame([("a", True), ("b", False)], "id string, allowed boolean")
    found = diffs.graph_gate((nodes, edges), (moved, edges), (moved, edges), (moved, edges), ledger, allowed)
    assert sorted(map(tuple, found.collect())) == [("existing_node", "b")]
    assert "sha2" not in optimized(found) and "FullOuter" not in optimized(found)


def test_a_candidate_costs_few_calls_to_the_state():
    """Each call is a message between Python and the executor; a call or two for each row doubled the run."""
    calls = []

    class State:
        value, rows = None, ()

        def __getattribute__(self, name):
            if name in ("get", "update", "clear", "appendList"):
                calls.append(name)
            return object.__getattribute__(self, name)

        def update(self, value):
            self.value = value

        def appendList(self, rows):
            self.rows = (*self.rows, *rows)

        def clear(self):
            self.value, self.rows = None, ()

    seen, waiting = State(), State()
    seen.get, waiting.get = lambda: seen.value, lambda: iter(waiting.rows)
    handle = SimpleNamespace(getValueState=lambda *a: seen, getListState=lambda *a: waiting, registerTimer=lambda ms: calls.append(ms), deleteTimer=lambda ms: calls.append(ms))
    log = review_log.ReviewLog(1000)
    log.init(handle)
    calls.clear()
    row = lambda at, status: SimpleNamespace(happened_at_us=at * 1000, version=str(at), status=status, reason_code=None, note=None)
    rows = [row(at, "approved" if at % 2 else "review") for at in range(500, 0, -1)] + [row(7, "rejected"), row(900, "approved")]
    assert list(log.handleInputRows(("c",), iter(rows), None)) == []
    out = list(log.handleExpiredTimer(("c",), SimpleNamespace(getCurrentWatermarkInMs=lambda: 600), None))
    assert [e.version for e in out] == [str(at) for at in range(1, 501)] and out[6].status == "rejected"
    assert len(waiting.rows) == 1 and seen.value[-1] == 901 and len(calls) <= 10
    out = list(log.handleExpiredTimer(("c",), SimpleNamespace(getCurrentWatermarkInMs=lambda: 5000), None))
    assert [(e.version, e.previous_status) for e in out] == [("900", "review")] and seen.value is None and waiting.rows == ()


def test_assembled_edges_carry_a_number_for_the_row(spark):
    """A digest as text, made after the joins, took every column through them and was half of the largest shuffle."""
    kind = "id string, source string, target string, type string, label string, strength double, context array<string>, year int, sources array<string>"
    rows = [("i", "a", "b", "t", "l", None, [str(k)], 1, []) for k in range(6)] + [("j", "a", "b", "t", "l", 0.7, ["x"], 2, []), ("k", "a", "gone", "t", "l", 0.7, ["x"], 2, [])]
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    found = {str(assemble.assemble_edges([spark.createDataFrame(some, kind).repartition(n)], nodes).collect()) for n, some in ((1, rows), (3, rows[::-1]))}
    assert len(found) == 1 and "id='i'" in found.pop()
    slim = optimized(assemble.assemble_edges([spark.createDataFrame(rows, kind)], nodes).select("id", "strength"))
    assert "sha2" not in slim and "context" not in slim[: slim.index("xxhash64")]


def test_candidate_pairs_share_more_than_a_word(spark, monkeypatch):
    """Each shared prefix word made a pair, so large texts of one vocabulary met nearly all others, and both whole sets travelled for each pair."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(600)]
    rows = [(k, " ".join(rng.sample(words, rng.randint(150, 260)))) for k in range(60)]
    rows += [(100 + k, " ".join(text.split()[rng.randint(0, 12):])) for k, text in rows[:6]]
    docs = spark.createDataFrame([(k, "en" if k % 7 else "de", text) for k, text in rows], "id int, lang string, text string")
    left, right = docs.where("id % 2 = 0"), docs.where("id % 2 = 1 or id > 99")
    sets = lambda df: {(r.lang, frozenset(r.text.split())) for r in df.collect()}
    near = {(g, a, b) for g, a in sets(left) for h, b in sets(right) if g == h and len(a & b) / len(a | b) >= 0.64}
    assert len(facts.similar_pairs(left, right, ["lang"]).collect()) == len(near)
    monkeypatch.setattr(facts, "MANY_SETS", 10)
    pairs = facts.similar_pairs(left, right, ["lang"])
    assert physical(pairs).count("LeftSemi, BuildRight") == 2  # sets that are in no pair stay where they are
    found = pairs.collect()
    assert {(r.lang, frozenset(r.left_set), frozenset(r.right_set)) for r in found} == near and len(found) == len(near) > 2
    on = docs.select("lang", F.array_sort(facts.tokens("text")).alias("words"), F.expr("id % 2 = 0").alias("_l"), F.expr("id % 2 = 1 or id > 99").alias("_r"))
    stored = on.select("*", F.monotonically_increasing_id().alias("_set"), *facts._marks()).localCheckpoint()
    short = docs.select(F.slice(facts.tokens("text"), 1, facts.SMALL).alias("words")).select(*facts._marks()).distinct()
    assert [tuple(r) for r in short.collect()] == [(None,) * facts.MARKS]
    assert len(near) <= facts.candidate_pairs(stored, ["lang"]).count() < len(near) + 20


def test_update_states_travel_as_hashes(spark):
    """Keys, contexts and sources of both sides were shuffled as texts."""
    link = lambda *urls: [("l", url, "other") for url in urls]
    schema = "id string, source string, target string, context array<string>, sources array<struct<label:string,url:string,provider:string>>"
    live = [("1", "a", "b", ["x"], link("u")), ("2", "a", "c", [], []), ("3", "a", "d", ["x"], link("u")), ("4", "a", "d", ["x"], link("u")), ("5", "a", None, ["x"], []), ("6", "e", "f", None, None), ("7", "g", "h", ["x", "y"], [])]
    edges = [("a1", "a", "b", ["x"], link("u")), ("a2", "a", "b", ["x"], link("v")), ("a3", "a", "c", ["x"], []), ("a4", "a", "d", ["x"], link("u")), ("a5", "a", None, ["x"], []),
             ("a6", "e", "f", None, None), ("a7", "e", "f", [], None), ("a8", "g", "h", ["x"], []), ("a9", "no", "no", [], []), ("a9", "a", "c", [], [])]
    states = diffs.update_states(spark.createDataFrame(edges, schema), spark.createDataFrame(live, schema), ["source", "target"])
    want = {"a1": "current", "a2": "conflict", "a3": "update", "a4": "conflict", "a5": "conflict", "a6": "current", "a7": "update", "a8": "conflict"}
    assert sorted(map(tuple, states.collect())) == sorted([*want.items(), ("a9", "conflict"), ("a9", "current")])
    deals = [line for line in physical(states).splitlines() if "hashpartitioning" in line]
    assert deals and not any(f"{name}#" in line for line in deals for name in ("source", "target", "context", "sources"))


def test_numbered_rows_do_not_travel_again(spark):
    """Rows that lay in order were shuffled a second time to meet the totals of the slices before."""
    names = ["hot"] * 3000 + [None] * 40 + ["", "a", "a", "z"]
    rows = spark.createDataFrame([(g, (k * 7919) % 5003, k) for k, g in enumerate(names)], "g string, v int, id int").repartition(5)
    numbered = prefix.positions(rows, [("v", True), ("id", True)], "p", ["g"], ["g", "id"])
    assert numbered.columns == ["g", "id", "p"] and "SortMergeJoin" not in physical(numbered)
    want = {(g, i): p for g in set(names) for p, (_, i) in enumerate(sorted(((k * 7919) % 5003, k) for k, n in enumerate(names) if n == g), 1)}
    got = numbered.collect()
    assert len(got) == len(names) and {(r.g, r.id): r.p for r in got} == want
    two = prefix.positions(rows.withColumn("h", F.expr("if(id % 2 = 0, g, null)")), [("id", True)], "p", ["g", "h"]).where("p = 1").count()
    assert two == 7 and prefix.positions(rows.limit(0), [("v", True)], "p", ["g"]).collect() == []


def test_constraints_do_not_travel_to_their_nodes(spark):
    """Whole constraints were dealt by source, by target and by evidence; those without evidence all met in one task."""
    long = "close because they played together"
    rows = [
        ("n1", "near", "a", "b", 300.0, None, False, "e1", long), ("n2", "near", "a", "b", 5.0, None, False, "e1", long), ("n3", "near", "a", "c", 300.0, None, False, "e2", long),
        ("n4", "near", "a", "gone", 300.0, None, False, "e3", long), ("n5", "near", "a", "a", 300.0, None, False, None, "short"), ("n6", "near", None, "b", 300.0, None, False, "no", None),
        ("p1", "apart", "b", "c", None, 200.0, True, None, long), ("p2", "apart", "a", "c", None, 400.0, True, None, long), ("p3", "apart", "a", "c", None, 600.0, None, "e1", long),
        ("k1", None, "a", "b", 300.0, None, False, "e1", long), ("k1", "far", "b", "c", 300.0, None, False, "twice", long), ("t1", "near", "c", "d", 300.0, None, False, "twice", long),
    ]
    constraints = spark.createDataFrame(rows, "id string, kind string, source string, target string, max_distance double, min_distance double, display_only boolean, evidence_edge_id string, reason string")
    nodes = spark.createDataFrame([(n,) for n in ("a", "b", "c", "d", "d", None)], "id string")
    link = [("l", "https://x.example.org/", "other")]
    edges = [("e1", "b", "a", link), ("e2", "a", "d", link), ("e3", "a", "gone", []), ("twice", "c", "d", link), ("twice", "d", "b", link), (None, "a", "b", link)]
    frame = spark.createDataFrame([(i, s, t, "member of", [], x) for i, s, t, x in edges], "id string, source string, target string, label string, context array<string>, sources array<struct<label:string,url:string,provider:string>>")
    found = validate.constraint_rules(constraints, nodes, frame)
    got = sorted((r.rule, r.key, r.detail) for r in found.collect())
    assert got == sorted([
        ("near_evidence", "n2", ""), ("near_evidence", "n3", ""), ("ends", "n4", ""), ("near_evidence", "n4", ""), ("ends", "n5", ""), ("reason", "n5", ""), ("near_evidence", "n5", ""),
        ("ends", "n6", ""), ("reason", "n6", ""), ("near_evidence", "n6", ""), ("apart_bounds", "p3", ""), ("apart_bounds", "k1", ""), ("kind", "k1", ""), ("kind", "k1", "far"), ("kind", "k1", "far"),
        ("near_evidence", "t1", ""), ("duplicate_id", "k1", "2"), ("pair_repeated", "a|b", ""), ("pair_repeated", "a|c", ""), ("pair_repeated", "c|d", ""), ("pair_conflict", "a|c", ""),
    ])
    deals = [line for line in physical(found).splitlines() if "hashpartitioning" in line]
    assert not any(f"hashpartitioning({name}#" in line for line in deals for name in ("source", "target", "evidence_edge_id"))


def _aggregates(plan):
    return plan.count("Aggregate [")


def test_gates_compare_once(spark):
    """Each rule of a batch made a comparison of its own, and new rows of a ledger were looked for twice."""
    schema = "id string, type string, tier string, provider string"
    rows = lambda *ids: spark.createDataFrame([(i, "member_of" if i and i > "c" else "plays", "source_linked", "p") for i in ids], schema)
    before, after = rows("a", "b", "b", "c"), rows("a", "b", "c", "c", "d", "e", "e", None, "a0")
    changed = after.withColumn("provider", F.expr("if(id = 'a', 'q', provider)"))
    ledger = spark.createDataFrame([("d",), ("d",), ("a0",), ("z",)], "edge_id string")
    gate = diffs.batch_gate(before, changed, ledger, 2)
    got = sorted(((r.rule, r.key, r.detail) for r in gate.collect()), key=str)
    assert got == sorted([
        ("existing_changed", "a", ""), ("existing_changed", "b", ""), ("existing_changed", "c", ""), ("unreviewed_addition", "e", "member_of"), ("unreviewed_addition", None, None),
        ("unreviewed_addition", "a0", "plays"), ("addition_count", "batch", "5"),
    ], key=str)
    assert _aggregates(optimized(gate.select("rule", "key"))) == 1  # the count of what is stored

    part = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    lines = lambda *all_: spark.createDataFrame(list(all_), "id string, edge_id string, kind string")
    old = {"nodes": part("n"), "edges": part("e"), "rows": lines(("r", "e", "typed_connection"))}
    new = {"nodes": part("n", "m"), "edges": part("e", "f"), "rows": lines(("r", "e", "typed_connection"), ("s", "f", "typed_connection"), ("t", "g", "typed_connection"), ("t", "f", None), ("u", None, "typed_connection"))}
    found = diffs.ledger_gate(old, new, (part("m"), part("f", "f")))
    assert sorted((r.rule, r.key) for r in found.collect()) == sorted([
        ("promotion_rows_repeated", "t"), ("promotion_rows_delta", "t"), ("promotion_rows_delta", "t"), ("promotion_rows_delta", "u"), ("promotion_count", "4 rows, 2 edges"),
    ])
    assert optimized(found).count("Join LeftAnti") == 0  # stored beforehand


def test_assembled_relations_are_not_dealt_by_their_ends(spark):
    rows = [("1", "a", "b"), ("2", "a", "gone"), ("3", "gone", "b"), ("4", None, "b"), ("5", "b", None), ("6", "b", "a"), ("6", "b", "a"), (None, "a", "a")]
    edges = spark.createDataFrame([(i, s, t, "t", f"l{k}", 0.5, 1) for k, (i, s, t) in enumerate(rows)], "id string, source string, target string, type string, label string, strength double, year int")
    nodes = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "id string")
    kept = evidence.induced_edges(edges, nodes, mostly_known=True)
    assert sorted(map(str, kept.collect())) == sorted(map(str, evidence.induced_edges(edges, nodes).collect())) and kept.count() == 4
    assert evidence.induced_edges(edges, nodes.limit(0), mostly_known=True).collect() == []
    found = assemble.assemble_edges([edges], nodes)
    assert sorted((r.id or "", r.source, r.target) for r in found.collect()) == [("", "a", "a"), ("1", "a", "b"), ("6", "b", "a")]
    assert not any(f"hashpartitioning({end}#" in physical(found) for end in ("source", "target"))


def test_candidates_are_judged_once(spark, sf_dir):
    """The titles of the candidates and the candidates themselves were made from the packages twice, and so were the seeds."""
    made, _ = promotion.promoted_nodes(promotion_queries._packages(spark, sf_dir), views.entities(spark, sf_dir), ("blocked act",), max_new=900, per_seed=1)
    assert "music_candidates" not in optimized(made) and made.count() > 0
