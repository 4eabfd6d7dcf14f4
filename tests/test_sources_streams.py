"""Readers, writers and streams on files."""

import datetime
import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from evigraph.sources import readers, sinks
from evigraph.streaming import leases, review_log


def test_graph_document(spark, tmp_path):
    graph = {"version": 1, "nodes": [{"id": "a", "label": "A", "type": "band", "x": 1, "sources": [{"label": "s", "url": "https://x"}], "odd": 1}, {"id": "b", "type": "genre", "eraStart": 1200}],
             "edges": [{"id": "e", "source": "a", "target": "b", "type": "associated_genre", "label": "in"}]}
    (tmp_path / "graph.json").write_text(json.dumps(graph, indent=1))
    documents = readers.read_graph(spark, str(tmp_path / "graph.json"))
    nodes = readers.entity_rows(readers.graph_nodes(documents)).orderBy("id").collect()
    assert [(n.id, n.zone, n.era_start) for n in nodes] == [("a", "unplaced", None), ("b", "unplaced", 1200)]
    assert readers.relation_rows(readers.graph_edges(documents)).first().strength == 0.5
    assert [r.rule for r in readers.year_evidence_violations(readers.graph_nodes(documents)).collect()] == ["year_range"]


@pytest.mark.parametrize("wrap", [True, False])
def test_inbox_shapes(spark, tmp_path, wrap):
    requests = [{"id": "r1", "seeds": [{"name": "A", "kind": "band"}]}, {"id": "r2", "priority": 7}]
    (tmp_path / "inbox.json").write_text(json.dumps({"version": 1, "requests": requests} if wrap else requests))
    rows = readers.request_rows(readers.read_inbox(spark, str(tmp_path / "inbox.json"))).orderBy("id").collect()
    assert [(r.id, r.priority, r.status, r.title) for r in rows] == [("r1", 50, "queued", "r1"), ("r2", 7, "queued", "r2")]


def test_runs_newest_first(spark, tmp_path):
    for day in (1, 2):
        body = {"runId": f"run{day}", "candidates": [{"name": f"A{day}"}, {"name": f"B{day}", "status": "approved"}]}
        (tmp_path / f"2024-0{day}.json").write_text(json.dumps(body))
    rows = readers.read_runs(spark, str(tmp_path)).collect()
    assert [(r.id, r.run_id) for r in rows] == [("2024-02:A2", "run2"), ("2024-01:A1", "run1")]


def test_notes_round(spark, tmp_path):
    folder = tmp_path / "band"
    folder.mkdir()
    (folder / "a.md").write_text("---\nid: a\nlabel: \"The A\"\ntype: band\naliases: [\"x, y\", 'it''s', z]\neraStart: 1970\nzone:\nstarter: true\n---\n# body\n")
    (folder / "b.md").write_text("no front matter")
    (folder / "c.md").write_text("---\nid: c\ntype: album\n---\n")
    notes, warnings = readers.parse_notes(readers.read_notes(spark, str(tmp_path)))
    row = notes.collect()
    assert [(r.id, r.label, r.aliases, r.era_start, r.zone, r.starter) for r in row] == [("a", "The A", ["x, y", "it's", "z"], 1970, None, True)]
    assert sorted(r.rule for r in warnings.collect()) == ["note_kind", "note_without_id"]


def test_fact_batch_lookup(spark):
    rows = [("b", "2024", {"k": ["L", "https://x"]}, [["e", "t", "c", "k", "p"], ["e", "t", "c", "none", "p"]])]
    df = spark.createDataFrame(rows, "batchId string, verifiedAt string, sources map<string,array<string>>, facts array<array<string>>")
    assert [(r["index"], r.source_url) for r in readers.fact_batch_rows(df).collect()] == [(1, "https://x"), (2, None)]


def test_snapshot_fails_on_a_bad_row(spark):
    schema = "id string, entity_id string, text string, tags array<string>, sources array<struct<label:string,url:string>>, source_fingerprint string, status string, verified_at date"
    good = ("f", "e", "t", [], [("l", "https://x")], "p", "approved", None)
    assert sinks.approved_snapshot(spark.createDataFrame([good], schema)).count() == 1
    bad = spark.createDataFrame([good, (*good[:6], "review", None)], schema)
    with pytest.raises(Exception, match="invalid approved fact"):
        sinks.approved_snapshot(bad).collect()


CHANGE = "candidate_id string, version string, status string, reason_code string, note string, happened_at timestamp"


def change(candidate, version, status, day, reason=None):
    return (candidate, version, status, reason, None, datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day))


def deliver(spark, folder, schema, batches):
    """One file for each batch, in order of their names and times."""
    for k, rows in enumerate(batches):
        target = folder / f"{k:03d}.parquet"
        pd = spark.createDataFrame(rows, schema).coalesce(1)
        pd.write.parquet(str(folder / f"tmp{k}"))
        part = next((folder / f"tmp{k}").glob("part-*.parquet"))
        part.rename(target)
        os.utime(target, (1_700_000_000 + 100 * k,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "0*.parquet").parquet(str(folder))


def batch_rows(spark, rows):
    frame = spark.createDataFrame(rows, CHANGE).where("candidate_id is not null").dropDuplicates(["candidate_id", "version"])
    out = review_log.batch_events(frame.withColumnRenamed("reason_code", "review_reason_code"), "candidate_id", ["happened_at", "version"])
    return sorted((r.candidate_id, r.version, r.previous_status, r.status) for r in out.collect())


def test_review_stream_equals_batch_whatever_the_batches(spark, tmp_path):
    rows = [change("a", "1", "review", 0), change("a", "2", "approved", 1), change("a", "3", "approved", 2, "x"), change("a", "4", "approved", 3, "x"),
            change("b", "5", "rejected", 1.5), change("b", "6", "review", 2.5), change("c", "7", "review", 0.5), change("c", "8", "review", 2.7)]
    mark = (None, None, None, None, None, datetime.datetime(2024, 3, 1))
    late_and_split = [[rows[1], rows[4]], [rows[0], rows[6]], [rows[3], rows[1], rows[5]], [rows[2], rows[7], rows[5]], [mark]]
    stream = deliver(spark, tmp_path, CHANGE, late_and_split)
    out = leases.run_available(review_log.stream_events(stream, delay="3 days"), "split").collect()
    got = sorted((r.candidate_id, r.version, r.previous_status, r.status) for r in out)
    assert got == batch_rows(spark, rows) and len(got) == 4
    assert all(r.origin == "review_change" for r in out)


def test_review_state_ends_and_rows_beyond_the_delay_are_dropped(spark, tmp_path):
    first, again = change("a", "1", "approved", 0), change("a", "3", "rejected", 40)
    batches = [[first], [change("z", "9", "review", 20)], [change("z", "8", "review", 20.5)], [change("a", "2", "rejected", 1)], [again], [(None, None, None, None, None, datetime.datetime(2024, 4, 1))]]
    stream = deliver(spark, tmp_path, CHANGE, batches)
    out = leases.run_available(review_log.stream_events(stream, keep_days=10), "ends").collect()
    assert sorted((r.version, r.previous_status, r.status) for r in out) == [("1", None, "approved"), ("3", None, "rejected")]


def test_many_rows_of_one_candidate_in_random_batches(spark, tmp_path):
    rng = random.Random(2)
    rows = [change(rng.choice("aaaab"), f"{k:04d}", rng.choice(["review", "approved", "rejected"]), rng.randrange(50) / 10) for k in range(300)]
    mixed = rng.sample(rows, len(rows))
    batches = [mixed[k::6] + rng.sample(rows, 5) for k in range(6)] + [[(None, None, None, None, None, datetime.datetime(2024, 3, 1))]]
    out = leases.run_available(review_log.stream_events(deliver(spark, tmp_path, CHANGE, batches), delay="10 days"), "random").collect()
    assert sorted((r.candidate_id, r.version, r.previous_status, r.status) for r in out) == batch_rows(spark, rows)


REQUEST = "id string, started_at timestamp"
RUN = "request_id string, run_id string, outcome string, candidates_written boolean, error string, finished_at timestamp"


def test_request_stream_late_never_twice(spark, tmp_path):
    at = lambda hour: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=hour)
    (tmp_path / "q").mkdir()
    (tmp_path / "r").mkdir()
    asked = [[("ok", at(0)), ("never", at(0)), ("twice", at(0))], [("late", at(1)), ("failed", at(1)), ("wrote", at(1))], [("later", at(2))], [(None, at(100))], [(None, at(101))], [(None, at(102))]]
    run = lambda i, outcome, hour, wrote=False, error=None: (i, f"run-{i}", outcome, wrote, error, at(hour))
    ended = [[run("ok", "completed", 3), run("twice", "completed", 4)], [run("twice", "completed", 4), run("failed", "failed", 5, error="boom")],
             [run("late", "completed", 20), run("wrote", "failed", 6, True, "half")], [(None, None, None, None, None, at(100))], [(None, None, None, None, None, at(101))],
             [run("later", "completed", 3), (None, None, None, None, None, at(102))]]
    requests, runs = deliver(spark, tmp_path / "q", REQUEST, asked), deliver(spark, tmp_path / "r", RUN, ended)
    got = leases.run_available(leases.close_request_stream(requests, runs), "requests").collect()
    again = leases.RECOVERED
    assert sorted((r.id, r.status, r.error) for r in got) == [
        ("failed", "queued", "boom"), ("late", "queued", again), ("later", "queued", again), ("never", "queued", again), ("ok", "processed", None),
        ("twice", "processed", None), ("wrote", "processed", "half"),
    ]


def test_lease_timers(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    schema = "id string, status string, updated_at timestamp"
    batches = [[("stale", "processing", at), ("done", "processing", at), ("busy", "processing", at)], [("done", "processed", at + datetime.timedelta(hours=1))]]
    stream = deliver(spark, tmp_path, schema, batches)
    folder = leases.work_folder(spark, "lease")
    running = leases.start(leases.lease_stream(stream, seconds=4), folder, processingTime="1 second")
    deadline, found = time.time() + 90, []
    while time.time() < deadline and len(found) < 2:
        running.awaitTermination(2)
        if running.exception():
            raise running.exception()
        try:
            found = spark.read.schema("id string, status string, error string").parquet(f"{folder}/out").collect()
        except Exception:  # noqa: BLE001  (nothing is written yet)
            continue
    running.stop()
    assert sorted((r.id, r.status, r.error) for r in found) == [("busy", "queued", leases.RECOVERED), ("stale", "queued", leases.RECOVERED)]


def test_stale_requests_return_to_the_queue(spark):
    rows = [("old", "processing", "2024-01-01 00:00:00"), ("new", "processing", "2024-01-02 00:00:00"), ("done", "processed", "2020-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "id string, status string, t string").select("id", "status", F.col("t").cast("timestamp").alias("updated_at"), F.lit(None).cast("string").alias("error"))
    got = leases.recover_stale(df, F.lit("2024-01-02 06:00:00").cast("timestamp")).collect()
    assert {r.id: r.status for r in got} == {"old": "queued", "new": "processing", "done": "processed"}


def test_nested_front_matter(spark):
    note = '---\nid: a\nspan: {"from": 1970, "to": null, "names": ["x", {"y": [1, 2]}]}\nroles: [lead, \'bass\']\nempty:\nplain: some: text\nnumber: 12\n---\nbody'
    rows = readers.note_values(spark.createDataFrame([(note,), ("no front matter",)], "value string"))
    at = lambda name, path, kind="string": F.try_variant_get(F.col("values")[name], path, kind)
    got = rows.select(
        at("id", "$"), at("span", "$.from", "int"), at("span", "$.names[1].y[1]", "int"), at("span", "$.nothing"), at("roles", "$[1]"), F.is_variant_null(F.col("values")["empty"]),
        at("plain", "$"), at("number", "$", "int"), at("missing", "$"),
    ).collect()
    assert tuple(got[0]) == ("a", 1970, 2, None, "bass", True, "some: text", 12, None) and all(v in (None, False) for v in got[1])


def test_payload_elements_of_odd_payloads(spark):
    rows = spark.createDataFrame([(1, '{"a": [{"n": "x"}, {"m": 1}, 5]}'), (2, "{"), (3, None), (4, '{"a": {"n": 1}}'), (5, '{"a": []}')], "id int, payload string")
    got = readers.payload_rows(rows, "id", "payload", "$.a", "struct<n:string>").collect()
    assert sorted((r.id, r.position, r.item and r.item.n) for r in got) == [(1, 0, "x"), (1, 1, None), (1, 2, None)]
