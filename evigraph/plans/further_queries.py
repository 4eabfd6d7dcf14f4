"""Queries on run files, table constraints, term rules, notes on facts and stable orders."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evigraph import vocab
from evigraph.functions import text
from evigraph.operators import diffs, graph, learning, validate
from evigraph.plans import views
from evigraph.plans.registry import query
from evigraph.sources import readers
from evigraph.streaming.leases import work_folder


@query(
    "src05_run_files",
    """SELECT 'run-' || lpad(CAST(o_custkey % 20 AS VARCHAR), 2, '0') || ':act ' || o_orderkey AS id, 'R' || (o_custkey % 20) AS run_id, 'act ' || o_orderkey AS seed_name,
       CASE WHEN o_orderkey % 2 = 0 THEN 'band' ELSE 'artist' END AS requested_kind FROM orders WHERE o_orderstatus <> 'F'""",
)
def run_files(spark, d):
    """Orders written as run files, one per run, and read back by status."""
    orders = views.table(spark, d, "orders").selectExpr(
        "lpad(cast(o_custkey % 20 as string), 2, '0') as run", "concat('act ', o_orderkey) as name", "case when o_orderkey % 2 = 0 then 'band' else 'artist' end as requested_kind",
        "case when o_orderstatus = 'F' then 'rejected' when o_orderstatus = 'O' then 'review' end as status",
    )
    folder = work_folder(spark, "runs")
    documents = orders.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("name", "requested_kind", "status"))).alias("candidates"))
    documents = documents.withColumn("runId", F.concat(F.lit("R"), F.col("run").cast("int")))
    documents.select("run", "runId", "candidates").repartition("run").write.partitionBy("run").json(folder)
    rows = readers.read_runs(spark, f"{folder}/*/*.json")
    run = F.lpad(F.regexp_extract("run_id", r"([0-9]+)", 1), 2, "0")
    return rows.select(F.concat(F.lit("run-"), run, F.lit(":"), F.col("seed_name")).alias("id"), "run_id", "seed_name", "requested_kind")


@query(
    "val16_schema_preflight",
    """SELECT name, n FROM (SELECT unnest(['evidence', 'layout_hints']) AS name), (SELECT count(*) AS n FROM entities)""",
    ("entities",),
)
def schema_preflight(spark, d):
    """What entities lack of the node schema and two planned columns, beside the rows that would be written."""
    nodes = views.entities(spark, d).drop("evidence")
    wanted = StructType.fromDDL("id string, label string, zone string, evidence string, layout_hints string")
    lacking = validate.missing_columns(nodes, wanted)
    return nodes.agg(F.count(F.lit(1)).alias("n")).select(F.explode(F.array(*[F.lit(name) for name in lacking])).alias("name"), "n")


@query(
    "snk01_relation_rows",
    "SELECT id, coalesce(strength, 0.5) AS strength, len(context) AS contexts, year, len(sources) AS sources FROM relations",
    ("relations",),
)
def relation_rows(spark, d):
    edges = views.relations(spark, d)
    rows = readers.relation_rows(edges.withColumn("label", F.concat_ws("\t", "id", "label")))
    return rows.select(
        F.substring_index("label", "\t", 1).alias("id"), "strength", F.size("context").cast("bigint").alias("contexts"), "year", F.size("sources").cast("bigint").alias("sources")
    )


@query(
    "snk01_year_violations",
    "SELECT CASE WHEN id LIKE '%3' THEN 'year_range' ELSE 'evidence_without_year' END AS rule, id AS key FROM entities WHERE id LIKE '%3' OR (era_start IS NULL AND NOT id LIKE '%3')",
    ("entities",),
)
def year_violations(spark, d):
    nodes = views.entities(spark, d).selectExpr("id", "case when id like '%3' then 1200 else era_start end as era_start", "'source' as evidence")
    return readers.year_evidence_violations(nodes)


@query(
    "flt24_public_tags",
    """SELECT doc_id, array_to_string(list_filter(list_filter([trim(source), CASE WHEN trim(source) <> lang THEN lang END, CASE WHEN lang <> 'hidden' THEN 'open' END, 'last one'],
       lambda v: v IS NOT NULL), lambda v: v NOT IN ('src1', 'src2') AND v <> 'de'), '|') AS tags FROM documents""",
)
def public_tags(spark, d):
    tags = F.array(F.concat(F.lit(" "), F.col("source"), F.lit(" ")), F.col("lang"), F.col("source"), F.lit(""), F.lit("open"), F.lit("last one"))
    return views.table(spark, d, "documents").select("doc_id", F.array_join(text.public_tags(tags, ["src1", "src2"], ["DE"]), "|").alias("tags"))


@query(
    "fn18_term_match",
    """SELECT doc_id, list_contains(string_split(t, ' '), 'the') AS word, list_contains(string_split(t, ' '), 'er') AS rare, contains(t, 'on the') AS phrase, contains(t, 'de la') AS other
       FROM (SELECT doc_id, replace(lower(text), chr(10), ' ') AS t FROM documents)""",
)
def term_match(spark, d):
    rows = views.table(spark, d, "documents").select("doc_id", F.replace(F.lower("text"), F.lit("\n"), F.lit(" ")).alias("t"))
    terms = {"word": "the", "rare": "er", "phrase": "on the", "other": "de la"}
    return rows.select("doc_id", *[text.matches_term(F.col("t"), term).alias(name) for name, term in terms.items()])


@query(
    "fn19_public_summary",
    """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN CASE WHEN lang IN ('en', 'es') THEN 'An ' ELSE 'A ' END || lang || ' act connected to documented Wikipedia signals around ' || source || '. More.'
       WHEN 1 THEN 'A ' || source || ' added from approved research.' ELSE regexp_extract(text, '^[^.]*', 0) END AS summary
       FROM (SELECT doc_id, lang, regexp_replace(source, '[0-9]', 'x', 'g') AS source, text FROM documents)""",
)
def public_summary(spark, d):
    rows = views.table(spark, d, "documents").withColumn("source", F.regexp_replace("source", "[0-9]", "x"))
    raw = F.expr("""case doc_id % 3 when 0 then concat('A ', lang, ' act surfaced by the project research brain from Wikipedia signals around ', source, '. More.')
        when 1 then concat('A ', source, ' added from approved project research.') else regexp_extract(text, '^[^.]*', 0) end""")
    return rows.select("doc_id", text.public_summary(raw).alias("summary"))


@query(
    "fn28_public_report",
    """SELECT requested_kind AS "group", count(*) AS n, count(*) FILTER (status = 'approved') AS approved, 'n,approved' AS fields FROM review_rows GROUP BY 1""",
    ("review_rows",),
)
def public_report(spark, d):
    rows = views.review_rows(spark, d)
    stats = rows.groupBy(F.col("requested_kind").alias("group")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "approved").alias("approved"), F.array(F.min("id"), F.max("id")).alias("examples")
    )
    model = stats.select(F.lit("kind").alias("dimension"), "group", F.struct("n", "approved", "examples").alias("stats"))
    report = learning.public_report(model)
    fields = ",".join(report.schema["stats"].dataType.names)
    return report.select("group", "stats.n", "stats.approved", F.lit(fields).alias("fields"))


_NOTE_SQL = """, f AS (SELECT doc_id, 'batch-' || doc_id AS batch, 'artist-' || doc_id AS entity, CASE WHEN doc_id % 3 <> 0 THEN 'https://' || source || '.example.org' END AS url,
     sha256('batch-' || doc_id || chr(10) || 'artist-' || doc_id || chr(10) || text) AS fp FROM documents),
   n AS (SELECT doc_id, CASE WHEN doc_id % 10 = 9 THEN 'Bad Batch' ELSE 'batch-' || doc_id END AS batch, CASE WHEN doc_id % 11 = 0 THEN 2 ELSE 1 END AS i,
     CASE WHEN doc_id % 7 = 0 THEN ['artist-1'] ELSE ['artist-' || doc_id, 'artist-' || (doc_id + CASE WHEN doc_id % 17 = 0 THEN 100000000 ELSE 1 END)] END AS related,
     CASE WHEN doc_id % 13 = 0 THEN ' ' ELSE 'note ' || doc_id END AS txt FROM documents),
   j AS (SELECT n.*, f.entity, f.url, f.fp, n.batch || '#' || i AS ref FROM n LEFT JOIN f ON f.batch = n.batch AND i = 1),
   k AS (SELECT *, CASE WHEN batch = 'Bad Batch' THEN 'note_reference' WHEN entity IS NULL OR url IS NULL OR trim(txt) = '' OR NOT list_contains(related, entity)
     OR len(list_filter(related, lambda r: NOT EXISTS (SELECT 1 FROM entities e WHERE e.id = r))) > 0 OR entity NOT IN (SELECT id FROM entities) THEN 'note_incomplete' END AS rule FROM j)"""


@query(
    "join29_interpretation_notes",
    _NOTE_SQL.replace("len(list_filter(related, lambda r: NOT EXISTS (SELECT 1 FROM entities e WHERE e.id = r))) > 0", "len(list_intersect(related, (SELECT list(id) FROM entities))) < len(related)")
    + """ SELECT coalesce(rule, 'note') AS part, ref, CASE WHEN rule IS NULL THEN txt END AS interpretation, CASE WHEN rule IS NULL THEN doc_id % 2 = 0 END AS approved FROM k""",
    ("entities",),
)
def interpretation_notes(spark, d):
    docs = views.table(spark, d, "documents")
    batches = docs.selectExpr(
        "concat('batch-', doc_id) as batchId", "'2024-01-01' as verifiedAt", "map('s', array(source, concat('https://', source, '.example.org'))) as sources",
        "array(array(concat('artist-', doc_id), text, 'history', case when doc_id % 3 = 0 then 'missing' else 's' end, 'page 1')) as facts",
    )
    batch = readers.fact_batch_rows(batches)
    notes = docs.selectExpr(
        "case when doc_id % 10 = 9 then 'Bad Batch' else concat('batch-', doc_id) end as batch_id", "case when doc_id % 11 = 0 then 2 else 1 end as fact_index",
        "case when doc_id % 7 = 0 then array('artist-1') else array(concat('artist-', doc_id), concat('artist-', doc_id + case when doc_id % 17 = 0 then 100000000 else 1 end)) end as related_nodes",
        "case when doc_id % 13 = 0 then ' ' else concat('note ', doc_id) end as interpretation",
    )
    approved = batch.where("cast(substr(batch_id, 7) as bigint) % 2 = 0").select("entity_id", F.col("fingerprint").alias("source_fingerprint"))
    rows, warnings = learning.interpretation_notes(notes, batch, views.entities(spark, d), approved)
    kept = rows.select(F.lit("note").alias("part"), "ref", "interpretation", "approved")
    none = warnings.select(F.col("rule").alias("part"), F.col("key").alias("ref"), F.lit(None).cast("string").alias("interpretation"), F.lit(None).cast("boolean").alias("approved"))
    return kept.unionByName(none)


@query(
    "top14_stable_positions",
    """SELECT id, zone, row_number() OVER (PARTITION BY zone ORDER BY CASE node_type """
    + " ".join(f"WHEN '{kind}' THEN {k}" for k, kind in enumerate(vocab.NODE_KINDS))
    + """ END, era_start NULLS LAST, icu_sort_key(lower(strip_accents(label)), 'en'), id) AS position FROM entities""",
    ("entities",),
)
def stable_positions(spark, d):
    return graph.stable_positions(views.entities(spark, d), vocab.NODE_KINDS)


@query(
    "val10_batch_edges",
    """, r AS (SELECT * FROM relations WHERE starts_with(id, 'p-1')), k AS (SELECT id FROM entities WHERE id NOT LIKE '%7')
    SELECT 'no_context' AS rule, id AS key FROM r WHERE len(context) = 0 UNION ALL SELECT 'no_sources', id FROM r WHERE len(sources) = 0
    UNION ALL SELECT 'duplicate_id', id FROM r GROUP BY id HAVING count(*) > 1
    UNION ALL SELECT 'unknown_end', id FROM (SELECT id, unnest([source, target]) AS e FROM r) WHERE e NOT IN (SELECT id FROM k) UNION ALL SELECT 'edge_count', 'p-1'""",
    ("entities", "relations"),
)
def batch_edges(spark, d):
    nodes = views.entities(spark, d).where("id not like '%7'")
    return validate.batch_edges(views.relations(spark, d), nodes, "p-1", 5).select("rule", "key")


@query(
    "val08_graph_gate",
    """, n AS (SELECT * FROM entities), e AS (SELECT DISTINCT source AS id FROM relations WHERE type = 'made_by')
    SELECT 'existing_node' AS rule, id AS key FROM n WHERE id LIKE '%3' AND id NOT LIKE '%9' AND id NOT LIKE '%13' UNION ALL SELECT 'new_node', id FROM n WHERE id LIKE '%9'
    UNION ALL SELECT 'new_edge', 'm-' || id FROM e WHERE id LIKE '%9' UNION ALL SELECT 'published_node', id FROM n WHERE id LIKE '%5'""",
    ("entities", "relations"),
)
def graph_gate(spark, d):
    """Entities on 9 are new but no catalogue bands, those on 3 changed (on 13 as permitted), those on 5 differ where published."""
    names = ["id", "label", "node_type", "zone", "x", "y", "sources"]
    nodes = views.entities(spark, d).select(*names)
    after = nodes.withColumn("label", F.expr("case when id like '%3' then concat(label, ' x') else label end"))
    edges = views.relations(spark, d).where("type = 'made_by'").selectExpr("concat('m-', source) as id", "type", "source", "target", f"{views.NO_SOURCES} as sources").distinct()
    old = (nodes.where("id not like '%9'"), edges.where("source not like '%9'"))
    published = after.withColumn("zone", F.expr("case when id like '%5' then 'elsewhere' else zone end"))
    ledger = edges.selectExpr("'typed_connection' as kind", "id as edge_id")
    permitted = nodes.selectExpr("id", "id like '%13' as allowed")
    return diffs.graph_gate(old, (after, edges), (published, edges), (after, edges), ledger, permitted).select("rule", "key")
