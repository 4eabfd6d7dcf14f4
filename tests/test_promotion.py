"""Staged connections, whole promotion rows and the ledger gate on small cases."""

import pytest
from pyspark.sql import functions as F

from evigraph import schemas, vocab
from evigraph.operators import diffs, promotion, resolve

PERSON, BAND, NEW = (f"{k}0000000-0000-4000-8000-000000000000" for k in "123")
PAGE = "https://musicbrainz.org/artist/"
NODE = f"id string, label string, aliases array<string>, node_type string, x double, y double, zone string, sources {schemas.SOURCES}"
EDGE = f"id string, source string, target string, type string, label string, sources {schemas.SOURCES}"
CONNECTION = (
    "struct<id:string,source:string,target:string,type:string,relation_type_id:string,artist_ids:array<string>,source_name:string,"
    f"periods:array<struct<begin:string,end:string>>,sources:{schemas.SOURCES},discovery:struct<name:string,mbid:string,type:string>>"
)
ROW = f"id string, pos int, status string, payload_kind string, connection {CONNECTION}"


def artist(mbid, path=""):
    return [("m", f"{PAGE}{mbid}{path}", "musicbrainz")]


def member(**changes):
    base = {
        "id": "mb-member-p-b", "source": "p", "target": "b", "type": "member_of", "relation_type_id": vocab.MEMBERSHIP_TYPE_ID, "artist_ids": [PERSON, BAND], "source_name": "Pat",
        "periods": [("1985", None)], "sources": artist(PERSON, "/relationships"), "discovery": None,
    }
    return tuple({**base, **changes}.values())


def discovered(name="Newcomers", **changes):
    target = f"mb-band-{NEW}"
    return member(**{"id": f"mb-member-p-{target}", "target": target, "artist_ids": [PERSON, NEW], "discovery": (name, NEW, "band"), **changes})


def staged(spark, connections, edges=(), nodes=(), promoted=((), ()), recorded=(), limit=12):
    graph = [("p", "Pat", [], "artist", 10.0, 20.0, "jazz", artist(PERSON)), ("b", "The Band", [], "band", 0.0, 0.0, "jazz", artist(BAND)), *nodes]
    rows = [(f"r{k}", k, *(c if len(c) == 3 else ("approved", "typed_connection", c))) for k, c in enumerate(connections)]
    frame = lambda data, schema: spark.createDataFrame(list(data), schema)
    out = promotion.stage_connections(
        frame(rows, ROW), frame(graph, NODE), frame(edges, EDGE), (frame(promoted[0], NODE), frame(promoted[1], EDGE)), frame([(i,) for i in recorded], "id string"), limit,
    )
    return {name: [tuple(r) for r in df.collect()] for name, df in out.items()}


def test_only_approved_typed_rows_are_staged_once(spark):
    got = staged(spark, [("review", "typed_connection", member()), ("approved", "wikipedia_link", member()), member(), member(), member()], recorded=["r4"])
    (edge,) = got["edges"]
    assert edge[:6] == ("mb-member-p-b", "p", "b", "member_of", "Member of", 0.9)
    assert edge[6] == ["MusicBrainz records Pat as a member of The Band.", "Documented period: 1985 onward (end not recorded)."]
    assert [tuple(s) for s in edge[7]] == [("MusicBrainz: member of band relationship", f"{PAGE}{PERSON}/relationships", "musicbrainz")]
    assert got["candidate_rows"] == [("r2", "typed_connection", "mb-member-p-b", "p", "b"), ("r3", "typed_connection", "mb-member-p-b", "p", "b")]
    assert got["already_present"] == [("r3", "mb-member-p-b")] and got["violations"] == [] and got["nodes"] == [] and got["deferred"] == [(0,)]
    two = staged(spark, [member(periods=[("1985", "1990"), (None, "2001"), (None, None)])])["edges"][0][6][1]
    assert two == "Documented periods: 1985 to 1990; start not recorded to 2001; dates not specified."


def test_the_limit_defers_and_is_checked(spark):
    assert staged(spark, [member()] * 5, limit=2)["deferred"] == [(3,)]
    for limit in (0, 26):
        with pytest.raises(ValueError, match="connection batch"):
            staged(spark, [member()], limit=limit)


FORBIDDEN = [
    (member(target="p"), "member_nodes"), (member(source="b"), "member_nodes"), (member(target="gone"), "member_nodes"), (member(artist_ids=[BAND, PERSON]), "membership_identity"),
    (member(relation_type_id="other"), "membership_identity"), (member(id="x"), "membership_identity"), (member(type="plays"), "membership_identity"), (member(artist_ids=None), "membership_identity"),
    (member(sources=[("w", "https://en.wikipedia.org/wiki/Pat", "wikipedia")]), "membership_source"), (member(sources=artist(PERSON)), "membership_source"), (member(sources=None), "membership_source"),
    (member(periods=[("unknown", None)]), "membership_dates"), (member(periods=[]), "membership_dates"), (member(periods=None), "membership_dates"), (member(periods=[None]), "membership_dates"),
    (discovered(source_name="Other"), "discovery_identity"), (discovered(artist_ids=[PERSON, BAND]), "discovery_identity"), (discovered(discovery=("N", NEW, "artist")), "discovery_identity"),
    (discovered(discovery=(" ", NEW, "band")), "discovery_identity"), (discovered("the BAND "), "discovery_label"), (discovered(target="b"), "discovery_identity"),
]


def test_what_forbids_a_row(spark):
    got = staged(spark, [c for c, _ in FORBIDDEN], limit=25)
    assert sorted(got["violations"]) == sorted((f"r{k}", rule) for k, (_, rule) in enumerate(FORBIDDEN))
    assert got["edges"] == got["nodes"] == got["candidate_rows"] == []


def test_a_present_membership_needs_its_evidence(spark):
    good = ("e", "p", "b", "member_of", "Member of", artist(PERSON))
    assert staged(spark, [member()], edges=[good])["already_present"] == [("r0", "mb-member-p-b")]
    assert staged(spark, [member()], promoted=((), [good]))["edges"] == []
    for bad in ((*good[:4], "plays in", good[5]), (*good[:5], []), (*good[:5], None)):
        assert staged(spark, [member()], edges=[bad])["violations"] == [("r0", "manual_review")]
    assert len(staged(spark, [member()], edges=[(*good[:3], "plays", "x", [])])["edges"]) == 1


def test_a_band_is_discovered_once(spark):
    other = ("q", "Quin", [], "guitarist", 1.0, 2.0, "punk-alt", [])
    mine = "40000000-0000-4000-8000-000000000000"
    second = discovered(id=f"mb-member-q-mb-band-{NEW}", source="q", source_name="Quin", artist_ids=[mine, NEW], sources=artist(NEW, "/relationships"))
    got = staged(spark, [discovered(), second], nodes=[other])
    (node,) = got["nodes"]
    assert node[:10] == (f"mb-band-{NEW}", "Newcomers", "band", ["band"], "Band with a documented membership connection to Pat.", ["Band"], 150.0, 100.0, "jazz", False)
    assert tuple(node[10]) == ("jazz", "p") and got["violations"] == [] and len(got["edges"]) == 2
    assert {e[7][0]["url"] for e in got["edges"]} == {f"{PAGE}{PERSON}/relationships", f"{PAGE}{mine}/relationships"}
    renamed = staged(spark, [discovered(), (*second[:9], ("Other", NEW, "band"))], nodes=[other])
    assert renamed["violations"] == [("r1", "discovery_conflict")]
    third = "50000000-0000-4000-8000-000000000000"
    same_name = discovered("newcomers", id=f"mb-member-p-mb-band-{third}", target=f"mb-band-{third}", artist_ids=[PERSON, third], discovery=("newcomers", third, "band"))
    assert staged(spark, [discovered(), same_name])["violations"] == [("r1", "discovery_label")]
    live = (f"mb-band-{NEW}", "Newcomers", [], "band", 0.0, 0.0, "jazz", artist(NEW))
    assert staged(spark, [discovered()], nodes=[live])["nodes"] == [] and len(staged(spark, [discovered()], promoted=([live], ()))["edges"]) == 1
    assert staged(spark, [discovered()], nodes=[(live[0], "Else", *live[2:])])["violations"] == [("r0", "discovery_conflict")]


def test_group_start(spark):
    bands = spark.createDataFrame([("a", "A", artist(NEW)), ("b", "B", artist(BAND)), ("c", "C", [])], f"id string, label string, sources {schemas.SOURCES}")
    entries = spark.createDataFrame([(NEW.upper(), " A ", "Group", "1988-05"), (BAND, "B", "Person", "1990")], "id string, name string, type string, begin string")
    dated, missing = promotion.with_group_start(bands, entries, 2024)
    (row,) = dated.collect()
    assert (row.id, row.era_start, row.era_start_evidence.basis, [s.label for s in row.sources]) == ("a", 1988, "group_formation", ["m", "MusicBrainz: group begin"])
    assert sorted(r.id for r in missing.collect()) == ["b", "c"]


def test_discovered_band_readback(spark):
    candidates = spark.createDataFrame(
        [(f"r{k}", "approved", "e", "p", f"mb-band-{m}", (n, m)) for k, (n, m) in enumerate([("N", NEW), ("X", NEW), ("N", BAND)])] + [("r9", "approved", "e", "p", "b", None)],
        "id string, status string, edge_id string, source string, target string, discovery struct<name:string,mbid:string>")
    live = spark.createDataFrame([(f"mb-band-{NEW}", "N", "band", artist(NEW)), (f"mb-band-{BAND}", "N", "band", artist(NEW))], f"id string, label string, node_type string, sources {schemas.SOURCES}")
    edges = spark.createDataFrame([], EDGE)
    got = resolve.readback(candidates.select("id", "edge_id", "source", "target"), candidates, edges, live)
    assert sorted((r.id, r.band_live) for r in got.collect()) == [("r0", True), ("r1", False), ("r2", False), ("r9", True)]


def test_article_addresses(spark):
    got = spark.createDataFrame([("AC/DC",), ("Blue Öyster Cult",), ("a+b ~*x",)], "t string").select(promotion.article_url(F.col("t"))).collect()
    assert [r[0].rsplit("/wiki/", 1)[1] for r in got] == ["AC/DC", "Blue_%C3%96yster_Cult", "a%2Bb_~%2Ax"]


def test_ledger_gate(spark):
    thing = lambda *ids: spark.createDataFrame([(i, "v") for i in ids], "id string, v string")
    rows = lambda *data: spark.createDataFrame(list(data), "id string, edge_id string, kind string")
    old = {"nodes": thing("n1"), "edges": thing("e1"), "rows": rows(("1", "e1", "typed_connection"))}
    new = {"nodes": thing("n1", "n2"), "edges": thing("e1", "e2"), "rows": rows(("1", "e1", "typed_connection"), ("2", "e2", "typed_connection"))}
    rules = lambda now, added=(thing("n2"), thing("e2")), **more: sorted(r.rule for r in diffs.ledger_gate(old, now, added, **more).collect())
    assert rules(new) == []
    assert rules({**new, "nodes": thing("n2")}) == ["promotion_nodes_changed"]
    assert rules({**new, "nodes": thing("n1")}) == ["promotion_nodes_delta"]
    assert rules({**new, "edges": thing("e1", "e2", "e3")}) == ["promotion_edges_delta"]
    assert rules({**new, "rows": rows(("1", "e1", "typed_connection"), ("2", "e2", "generic"))}) == ["promotion_rows_delta"]
    assert rules({**new, "rows": rows(("2", "e2", "typed_connection"))}) == ["promotion_rows_changed"]
    assert rules(new, (thing("n2"), thing("e2", "e9"))) == ["promotion_count", "promotion_edges_delta"]
    assert rules(new, max_new=0) == ["promotion_count"]


def test_ledger_gate_reads_each_part_once_for_its_rules(spark):
    thing = spark.createDataFrame([("a", "v")], "id string, v string")
    rows = spark.createDataFrame([("1", "a", "typed_connection")], "id string, edge_id string, kind string")
    parts = {"nodes": thing, "edges": thing, "rows": rows}
    plan = diffs.ledger_gate(parts, parts, (thing, thing))._jdf.queryExecution().executedPlan().toString()
    assert "sha2" not in plan and plan.count("_changed") == plan.count("_repeated")
