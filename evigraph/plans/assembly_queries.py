"""Queries on assembly, validation, diffs, guarded updates, neighbourhoods and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigraph.functions import hashing, text
from evigraph.operators import assemble, diffs, evidence, graph, neighborhood, validate
from evigraph.plans import views
from evigraph.plans.registry import query


def _nodes(spark, d):
    return views.entities(spark, d)


def _edges(spark, d):
    return views.relations(spark, d)


@query(
    "set01_assemble_nodes",
    """, base AS (SELECT * FROM entities WHERE node_type <> 'band'), promoted AS (SELECT * REPLACE (label || ' promoted' AS label) FROM entities WHERE node_type IN ('band', 'genre')),
    ok AS (SELECT * FROM promoted WHERE NOT (replace(replace(lower(id), '-', ' '), '_', ' ') IN ('band 3', 'genre 4')))
    SELECT id, label FROM base UNION ALL SELECT id, label FROM ok WHERE id NOT IN (SELECT id FROM base)
    UNION ALL SELECT id || '-new', label FROM entities WHERE node_type = 'guitar_brand'""",
    ("entities",),
)
def assemble_nodes(spark, d):
    nodes = _nodes(spark, d)
    promoted = nodes.where("node_type in ('band', 'genre')").withColumn("label", F.expr("concat(label, ' promoted')"))
    curated = nodes.where("node_type = 'guitar_brand'").withColumn("id", F.expr("concat(id, '-new')"))
    merged, _ = assemble.assemble_nodes(nodes.where("node_type <> 'band'"), promoted, curated, ["band-3", "Genre_4"])
    return merged.select("id", "label")


@query(
    "set01_curated_clashes",
    "SELECT 'curated_exists' AS rule, id AS key, label AS detail FROM entities WHERE node_type = 'band' AND starter",
    ("entities",),
)
def curated_clashes(spark, d):
    nodes = _nodes(spark, d)
    _, clashes = assemble.assemble_nodes(nodes, nodes.where("node_type = 'genre'"), nodes.where("node_type = 'band' and starter"))
    return clashes


@query(
    "set01_assemble_edges",
    """, known AS (SELECT id FROM entities WHERE NOT starter), u AS (
      SELECT 0 AS p, * FROM relations WHERE type <> 'plays' UNION ALL SELECT 1, * FROM relations WHERE type IN ('plays', 'made_by')),
    k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p, source || '|' || target || '|' || type || '|' || label, strength NULLS FIRST) AS a FROM u
          WHERE source IN (SELECT id FROM known) AND target IN (SELECT id FROM known))
    SELECT id, coalesce(strength, 0.5) AS strength FROM (SELECT *, row_number() OVER (PARTITION BY source, target, type, label ORDER BY p, id) AS b FROM k WHERE a = 1) WHERE b = 1""",
    ("entities", "relations"),
)
def assemble_edges(spark, d):
    edges, nodes = _edges(spark, d), _nodes(spark, d).where("not starter")
    parts = [edges.where("type <> 'plays'"), edges.where("type in ('plays', 'made_by')")]
    return assemble.assemble_edges(parts, nodes).select("id", "strength")


OVERRIDE_SQL = """, o AS (SELECT id, CASE WHEN length(label) % 2 = 0 THEN '' ELSE label || '!' END AS label, CASE WHEN starter THEN 'band' ELSE 'unknown' END AS node_type,
   CASE WHEN starter THEN 'zone-x' ELSE '' END AS zone, ['Performer 1', ' extra '] AS aliases, starter AS flip FROM entities WHERE node_type = 'artist')"""


@query(
    "set02_overrides",
    OVERRIDE_SQL + """ SELECT e.id, coalesce(nullif(o.label, ''), e.label) AS label, CASE WHEN o.node_type = 'band' THEN 'band' ELSE e.node_type END AS node_type,
      coalesce(nullif(o.zone, ''), e.zone) AS zone, CASE WHEN o.id IS NULL THEN array_to_string(e.aliases, '|')
        ELSE array_to_string(list_filter(['Performer ' || substr(e.id, 8), CASE WHEN e.id = 'artist-1' THEN '' ELSE 'Performer 1' END, 'extra'], lambda v: v <> ''), '|') END AS aliases,
      coalesce(NOT o.flip, e.starter) AS starter FROM entities e LEFT JOIN o ON o.id = e.id""",
    ("entities",),
)
def overrides(spark, d):
    nodes = _nodes(spark, d)
    other = nodes.where("node_type = 'artist'").selectExpr(
        "id", "case when length(label) % 2 = 0 then '' else concat(label, '!') end as label",
        "case when starter then 'band' else 'unknown' end as node_type", "case when starter then 'zone-x' else '' end as zone",
        f"{views.NO_STRINGS} as roles", "array('Performer 1', ' extra ') as aliases", "not starter as starter",
        "cast(null as int) as era_start",
    )
    merged = assemble.apply_overrides(nodes, other)
    return merged.select("id", "label", "node_type", "zone", F.array_join("aliases", "|").alias("aliases"), "starter")


def _corrections(spark, d):
    origin = views.source_struct("Review", "concat('https://review.example.org/', id)", "other")
    return _nodes(spark, d).where("node_type = 'artist'").selectExpr(
        "case when id like '%7' then concat(id, '-lost') else id end as id",
        "case when id like '%5' then 'band' else 'artist' end as node_type", "1997 as era_start", f"array({origin}) as sources",
    )


CORRECTION_SQL = """, c AS (SELECT CASE WHEN id LIKE '%7' THEN id || '-lost' ELSE id END AS id, CASE WHEN id LIKE '%5' THEN 'band' ELSE 'artist' END AS node_type, 1997 AS era_start
   FROM entities WHERE node_type = 'artist')
, j AS (SELECT c.id, c.node_type AS want, e.id AS hit, e.node_type, e.era_start FROM c LEFT JOIN entities e ON e.id = c.id)"""


@query(
    "set03_corrections",
    CORRECTION_SQL + """ SELECT e.id, CASE WHEN j.id IS NOT NULL AND j.want = e.node_type AND coalesce(e.era_start, 1997) = 1997 THEN 1997 ELSE e.era_start END AS era_start,
      len(e.sources) + CASE WHEN j.id IS NOT NULL AND j.want = e.node_type AND coalesce(e.era_start, 1997) = 1997 THEN 1 ELSE 0 END AS sources
      FROM entities e LEFT JOIN j ON j.id = e.id""",
    ("entities",),
)
def corrections(spark, d):
    fixed, _ = assemble.apply_corrections(_nodes(spark, d), _corrections(spark, d))
    return fixed.select("id", "era_start", F.size("sources").cast("bigint").alias("sources"))


@query(
    "set03_correction_issues",
    CORRECTION_SQL + """ SELECT CASE WHEN hit IS NULL THEN 'missing_target' WHEN want <> node_type THEN 'wrong_kind' ELSE 'conflicting_year' END AS rule, id AS key
      FROM j WHERE hit IS NULL OR want <> node_type OR era_start <> 1997""",
    ("entities",),
)
def correction_issues(spark, d):
    _, issues = assemble.apply_corrections(_nodes(spark, d), _corrections(spark, d))
    return issues.select("rule", "key")


def _after(nodes):
    return nodes.where("id not like '%9'").withColumn("zone", F.expr("case when id like '%4' then 'moved' else zone end")).union(
        nodes.where("node_type = 'guitar_brand'").withColumn("id", F.expr("concat(id, '-b')"))
    )


@query(
    "set04_snapshot_diff",
    """SELECT id, CASE WHEN id LIKE '%9' THEN 'removed' WHEN id LIKE '%4' THEN 'changed' ELSE 'same' END AS state FROM entities
       UNION ALL SELECT id || '-b', 'added' FROM entities WHERE node_type = 'guitar_brand'""",
    ("entities",),
)
def snapshot_diff(spark, d):
    nodes = _nodes(spark, d).select("id", "label", "node_type", "zone", "starter", "era_start", "roles", "sources")
    return diffs.snapshot_diff(nodes, _after(nodes))


@query(
    "set05_baseline_containment",
    """SELECT 'missing' AS rule, id AS key FROM entities WHERE id LIKE '%9' UNION ALL SELECT 'differs', id FROM entities WHERE id LIKE '%4'""",
    ("entities",),
)
def baseline_containment(spark, d):
    nodes = _nodes(spark, d)
    return diffs.baseline_violations(nodes, _after(nodes), ["id"], ["node_type", "zone", "starter"])


@query(
    "set06_position_overlay",
    """SELECT id, CASE WHEN id LIKE '%4' THEN x ELSE x + 1 END AS x, CASE WHEN id LIKE '%4' THEN y ELSE y + 1 END AS y, zone FROM entities""",
    ("entities",),
)
def position_overlay(spark, d):
    nodes = _nodes(spark, d).select("id", "x", "y", "zone")
    live = nodes.where("id not like '%4'").selectExpr("id", "x + 1 as x", "y + 1 as y", "zone")
    return assemble.overlay_positions(nodes.where("id not like '%8'"), live)


@query(
    "set07_08_merge_unique",
    """SELECT id, array_to_string(list_filter([label, 'Ensemble 1', CASE WHEN lower(label) = 'ensemble 1' THEN '' ELSE 'x y' END], lambda v: v <> ''), '|') AS merged,
       array_to_string(CASE WHEN len(sources) = 0 THEN ['http://a'] ELSE list_append(list_transform(sources, lambda s: s.url), 'http://a') END, '|') AS urls FROM entities""",
    ("entities",),
)
def merge_unique(spark, d):
    nodes = _nodes(spark, d)
    values = F.array(F.lit("Ensemble 1"), F.lit(" x y"), F.lit("X_Y"), F.lit(""))
    merged = text.merge_unique_normalized(F.array("label"), values)
    from evigraph.functions import refs

    extra = F.expr(f"array({views.source_struct('A', repr('http://a'), 'other')})")
    sources = refs.merge_sources(refs.merge_sources(F.col("sources"), F.col("sources")), extra)
    return nodes.select("id", F.array_join(merged, "|").alias("merged"), F.array_join(refs.urls(sources), "|").alias("urls"))


@query(
    "set09_edge_keys",
    "SELECT id, source || '|' || target || '|' || type || '|' || label AS directed, least(source, target) || '|' || greatest(source, target) AS unordered FROM relations",
    ("relations",),
)
def edge_keys(spark, d):
    return assemble.edge_keys(_edges(spark, d))


@query(
    "join08_live_over_baseline",
    """SELECT id, CASE WHEN id LIKE '%2' THEN 1990 ELSE coalesce(era_start, 1990) END AS era_start,
       CASE WHEN id LIKE '%2' OR era_start IS NULL OR era_start = 1990 THEN 'baseline' END AS evidence FROM entities""",
    ("entities",),
)
def live_over_baseline(spark, d):
    nodes = _nodes(spark, d)
    baseline = nodes.selectExpr("id", "1990 as era_start", "'baseline' as evidence")
    live = nodes.selectExpr("id", "case when id not like '%2' then era_start end as era_start", "cast(null as string) as evidence")
    return assemble.overlay_live(baseline, live)


@query(
    "join09_co_occurrence",
    """, m AS (SELECT DISTINCT l_orderkey AS r, 'band-' || l_suppkey AS s FROM lineitem)
    SELECT 'release-' || a.r || '-' || a.s || '-' || b.s AS id, a.s AS source, b.s AS target FROM m a JOIN m b ON a.r = b.r AND a.s < b.s""",
    ("blocked",),
)
def co_occurrence(spark, d):
    lines = views.table(spark, d, "lineitem")
    members = lines.selectExpr("cast(l_orderkey as string) as release_id", "concat('band-', l_suppkey) as member")
    return assemble.co_occurrence(members).select("id", "source", "target")


@query(
    "val01_audit_nodes",
    """SELECT 'no_sources' AS rule, id AS key FROM entities WHERE len(sources) = 0 UNION ALL SELECT 'unsupported_kind', id FROM entities WHERE node_type = 'guitar_brand'
       UNION ALL SELECT 'blocked_entity', id FROM entities WHERE id = 'band-5' OR label = 'Customer#000000012'""",
    ("entities",),
)
def audit_nodes(spark, d):
    kinds = ("band", "guitarist", "artist", "guitar", "genre")
    return validate.audit_nodes(_nodes(spark, d), ["Band_5", "customer#000000012"], kinds).select("rule", "key")


@query(
    "val02_audit_edges",
    """, k AS (SELECT id FROM entities WHERE NOT starter)
    SELECT 'missing_source' AS rule, id AS key FROM relations WHERE source NOT IN (SELECT id FROM k) UNION ALL SELECT 'missing_target', id FROM relations WHERE target NOT IN (SELECT id FROM k)
    UNION ALL SELECT 'unsupported_type', id FROM relations WHERE type = 'plays' UNION ALL SELECT 'blocked_edge', id FROM relations WHERE target = 'band-5' OR source = 'band-5'
    UNION ALL SELECT 'blocked_context', id FROM relations WHERE list_contains(context, 'Order 77')""",
    ("entities", "relations"),
)
def audit_edges(spark, d):
    kinds = ("member_of", "associated_genre", "made_by")
    nodes = _nodes(spark, d).where("not starter")
    return validate.audit_edges(_edges(spark, d), nodes, ["band-5", "order 77"], kinds).select("rule", "key")


@query(
    "val03_table_constraints",
    """SELECT 'strength_range' AS rule, id AS key FROM relations WHERE strength IS NULL UNION ALL SELECT 'year_range', id FROM entities WHERE era_start + 100 > 2100
       UNION ALL SELECT 'relation_key', source || '|' || target || '|' || type || '|' || label FROM relations GROUP BY 2 HAVING count(*) > 1""",
    ("entities", "relations"),
)
def table_constraints(spark, d):
    nodes = _nodes(spark, d).withColumn("era_start", F.expr("era_start + 100"))
    return validate.table_constraints(nodes, _edges(spark, d)).select("rule", "key")


@query(
    "val04_request_rules",
    """, r AS (SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'Bad Id ' || o_orderkey ELSE 'request-' || o_orderkey END AS id, o_orderkey AS k FROM orders)
    SELECT 'request_id' AS rule, id AS key FROM r WHERE k % 10 = 0 UNION ALL SELECT 'no_seeds', id FROM r WHERE k % 7 = 0
    UNION ALL SELECT 'seed_name', id || '#2' FROM r WHERE k % 7 <> 0 AND k % 3 = 0 UNION ALL SELECT 'seed_kind', id || '#1' FROM r WHERE k % 7 <> 0 AND k % 5 = 0""",
    ("blocked",),
)
def request_rules(spark, d):
    requests = views.table(spark, d, "orders").selectExpr(
        "case when o_orderkey % 10 = 0 then concat('Bad Id ', o_orderkey) else concat('request-', o_orderkey) end as id",
        "case when o_orderkey % 7 = 0 then cast(array() as array<struct<name:string,kind:string>>) else array("
        "named_struct('name', 'A', 'kind', case when o_orderkey % 5 = 0 then 'album' else 'band' end), "
        "named_struct('name', case when o_orderkey % 3 = 0 then '' else 'B' end, 'kind', 'genre')) end as seeds",
    )
    return validate.request_rules(requests).select("rule", "key")


FACT_RULE_SQL = r""", f AS (SELECT *, regexp_matches(lower(text), '\b(first|only|largest|most|oldest|youngest)\b') AS sup,
      CASE WHEN pos % 9 = 0 THEN '2024-13-01' ELSE '2024-01-01' END AS verified_at FROM facts), known AS (SELECT id FROM entities WHERE node_type <> 'genre' AND NOT starter)"""


@query(
    "val05_curated_fact_rules",
    FACT_RULE_SQL + """ SELECT 'unknown_entity' AS rule, id AS key FROM f WHERE entity_id NOT IN (SELECT id FROM known) UNION ALL SELECT 'text_length', id FROM f WHERE length(text) NOT BETWEEN 35 AND 200
      UNION ALL SELECT 'year_range', id FROM f WHERE year NOT BETWEEN 1800 AND 2100 UNION ALL SELECT 'verified_at', id FROM f WHERE pos % 9 = 0
      UNION ALL SELECT 'superlative', id FROM f WHERE sup AND len(sources) < 2
      UNION ALL SELECT 'entity_cap', id FROM (SELECT id, row_number() OVER (PARTITION BY entity_id ORDER BY id) AS n FROM f) WHERE n > 2""",
    ("entities", "facts"),
)
def curated_fact_rules(spark, d):
    facts = views.facts(spark, d).withColumn("verified_at", F.expr("case when pos % 9 = 0 then '2024-13-01' else '2024-01-01' end"))
    nodes = _nodes(spark, d).where("node_type <> 'genre' and not starter")
    return validate.curated_fact_rules(facts, nodes).select("rule", "key")


@query(
    "val06_fact_rules",
    FACT_RULE_SQL + """ SELECT 'unknown_entity' AS rule, id AS key FROM f WHERE entity_id NOT IN (SELECT id FROM known)
      UNION ALL SELECT 'superlative', id FROM f WHERE sup AND len(sources) < 2
      UNION ALL SELECT 'not_independent', id FROM f WHERE status = 'approved' AND doc_id % 7 = 0""",
    ("entities", "facts"),
)
def fact_rules(spark, d):
    nodes = _nodes(spark, d).where("node_type <> 'genre' and not starter")
    return validate.fact_rules(views.facts(spark, d), nodes).select("rule", "key")


@query(
    "val08_batch_gate",
    """, b AS (SELECT * FROM tiered WHERE type <> 'made_by'), a AS (SELECT * FROM tiered WHERE type <> 'made_by' AND id NOT LIKE 'bg-1%' UNION ALL SELECT * FROM tiered WHERE type = 'made_by')
    SELECT 'existing_removed' AS rule, id AS key FROM tiered WHERE id LIKE 'bg-1%' UNION ALL SELECT 'unreviewed_addition', id FROM tiered WHERE type = 'made_by'
    UNION ALL SELECT 'addition_count', 'batch'""",
    ("relations", "tiered"),
)
def batch_gate(spark, d):
    edges = evidence.with_tier(_edges(spark, d))
    before = edges.where("type <> 'made_by'").drop("tier")
    after = edges.where("id not like 'bg-1%'")
    ledger = edges.where("type = 'made_by' and tier = 'source_linked'").select(F.col("id").alias("edge_id"))
    return diffs.batch_gate(before, after, ledger).select("rule", "key")


@query(
    "val09_documented_backfill",
    """SELECT id, id NOT LIKE '%3' AND era_start IS NOT NULL AND len(sources) > 0 AS allowed FROM entities""",
    ("entities",),
)
def documented_backfill(spark, d):
    nodes = _nodes(spark, d).withColumn("urls", F.expr("transform(sources, s -> s.url)"))
    before = nodes.selectExpr("id", "label", "cast(null as int) as era_start", f"{views.NO_STRINGS} as evidence_urls", "urls as source_urls")
    after = nodes.selectExpr(
        "id", "case when id like '%3' then concat(label, ' x') else label end as label", "era_start",
        "slice(urls, 1, 1) as evidence_urls", "array_append(urls, 'https://more.example.org') as source_urls",
    )
    return diffs.documented_backfill(before, after)


@query(
    "val10_batch_completeness",
    """SELECT 'absent' AS rule, id || '-x' AS key FROM entities WHERE starter
       UNION ALL SELECT 'zone', id FROM entities WHERE zone NOT IN ('nation-1', 'nation-2', 'nation-3')
       UNION ALL SELECT 'no_sources', id FROM entities WHERE len(sources) = 0""",
    ("entities",),
)
def batch_completeness(spark, d):
    bands = _nodes(spark, d)
    ids = bands.select("id").union(bands.where("starter").selectExpr("concat(id, '-x')"))
    return validate.batch_completeness(ids, bands, ["nation-1", "nation-2", "nation-3"]).select("rule", "key")


@query(
    "val11_ledger_delta",
    """SELECT 'ledger_row_changed' AS rule, id AS key FROM review_rows WHERE status = 'review' AND id LIKE '%3'
       UNION ALL SELECT 'ledger_addition_count', 'ledger'""",
    ("review_rows",),
)
def ledger_delta(spark, d):
    rows = views.review_rows(spark, d).select("id", "status", "seed_name")
    previous = rows.where("status = 'review'")
    current = rows.withColumn("seed_name", F.expr("case when id like '%3' then '' else seed_name end"))
    return diffs.ledger_delta(previous, current).select("rule", "key")


CONSTRAINT_SQL = """, pairs AS (SELECT l_orderkey AS o, 'artist-' || o_custkey AS a, 'band-' || l_suppkey AS b, 'm-' || concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS eid,
     l_returnflag AS flag, l_linestatus = 'O' AND l_linenumber = 7 AS hinted, row_number() OVER (PARTITION BY o_custkey, l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS n
     FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""


def _constraints(spark, d):
    """A near constraint per first line of a customer and supplier, an apart constraint for some."""
    from pyspark.sql import Window

    orders = views.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    lines = views.table(spark, d, "lineitem").join(orders, F.expr("l_orderkey = o_orderkey"))
    window = Window.partitionBy("o_custkey", "l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")
    first = lines.withColumn("n", F.row_number().over(window)).where("n = 1")
    base = first.selectExpr(
        "concat('artist-', o_custkey) as source", "concat('band-', l_suppkey) as target",
        "concat('m-', concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)) as edge", "l_orderkey",
    )
    reason = "'close because they played together' as reason"
    near = base.selectExpr(
        "concat('near-', edge) as id", "'near' as kind", "source", "target", "cast(300 + l_orderkey % 2000 as double) as max_distance",
        "cast(null as double) as min_distance", "false as display_only", "edge as evidence_edge_id", reason,
    )
    apart = base.where("l_orderkey % 3 = 0").selectExpr(
        "concat('apart-', edge) as id", "'apart' as kind", "source", "target", "cast(null as double) as max_distance",
        "cast(100 + l_orderkey % 500 as double) as min_distance", "true as display_only", "cast(null as string) as evidence_edge_id", reason,
    )
    return near.union(apart)


@query(
    "val12_constraint_rules",
    CONSTRAINT_SQL + """, f AS (SELECT *, 300 + o % 2000 AS mx, 100 + o % 500 AS mn FROM pairs WHERE n = 1)
    SELECT 'near_evidence' AS rule, 'near-' || eid AS key FROM f WHERE mx > 1800 OR flag <> 'A' OR hinted
    UNION ALL SELECT 'apart_bounds', 'apart-' || eid FROM f WHERE o % 3 = 0 AND mn NOT BETWEEN 120 AND 500
    UNION ALL SELECT 'pair_conflict', a || '|' || b FROM f WHERE o % 3 = 0 AND mn >= mx""",
    ("blocked",),
)
def constraint_rules(spark, d):
    nodes = _nodes(spark, d).select("id")
    return validate.constraint_rules(_constraints(spark, d), nodes, _edges(spark, d)).select("rule", "key")


@query(
    "agg17_constraint_details",
    CONSTRAINT_SQL + """, f AS (SELECT p.*, CAST(round(sqrt((e.x - g.x) ** 2 + (e.y - g.y) ** 2)) AS BIGINT) AS dist FROM pairs p JOIN entities e ON e.id = p.a JOIN entities g ON g.id = p.b WHERE n = 1)
    , x AS (SELECT greatest(0.0, dist - (300 + o % 2000)) AS excess FROM f UNION ALL SELECT greatest(0.0, 100 + o % 500 - dist) FROM f WHERE o % 3 = 0)
    SELECT count(*) AS constraints, count(*) FILTER (excess > 0) AS violations, CAST(sum(excess) AS DOUBLE) AS total_excess FROM x""",
    ("entities",),
)
def constraint_totals(spark, d):
    from evigraph.operators import spatial

    return spatial.constraint_totals(spatial.constraint_details(_constraints(spark, d), _nodes(spark, d).select("id", "x", "y")))


@query(
    "val13_set_equality",
    """SELECT 'first' AS side, seed_name FROM (SELECT seed_name, count(*) AS n FROM review_rows WHERE status IN ('approved', 'imported') GROUP BY 1), range(1000) r(i) WHERE false
       UNION ALL (SELECT 'first', seed_name FROM (SELECT DISTINCT seed_name FROM review_rows) EXCEPT SELECT 'first', label FROM entities WHERE starter)
       UNION ALL (SELECT 'second', label FROM entities WHERE starter AND node_type = 'artist' EXCEPT SELECT 'second', seed_name FROM review_rows)""",
    ("entities", "review_rows"),
)
def set_equality(spark, d):
    names = views.review_rows(spark, d).select("seed_name").distinct()
    labels = _nodes(spark, d).where("starter and node_type = 'artist'").select(F.col("label").alias("seed_name"))
    return diffs.set_difference(names, labels)


@query(
    "val14_early_pool_issues",
    """SELECT id, CAST(len(issues) AS BIGINT) AS n, array_to_string(issues, ';') AS issues FROM (SELECT 'p-' || o_custkey || '-' || o_orderkey AS id, list_filter([
         CASE WHEN o_orderpriority = '5-LOW' THEN 'music identity not clear in description' END,
         CASE WHEN y < b + 8 THEN 'work start predates plausible career age' END, CASE WHEN y > b + 85 THEN 'work start implausibly late' END,
         CASE WHEN y > b + 20 + o_custkey % 80 THEN 'work start follows death' END, CASE WHEN o_custkey % 2 = 0 AND o_orderkey % 20 < 8 THEN 'limited independent identity signals' END],
         lambda v: v IS NOT NULL) AS issues FROM (SELECT *, year(o_orderdate) - 100 AS y, 1800 + o_orderkey % 120 AS b FROM orders))""",
)
def early_pool_issues(spark, d):
    pool = views.table(spark, d, "orders").selectExpr(
        "concat('p-', o_custkey, '-', o_orderkey) as id", "year(o_orderdate) - 100 as start_year", "1800 + o_orderkey % 120 as birth_year",
        "1820 + o_orderkey % 120 + o_custkey % 80 as death_year", "case when o_custkey % 2 = 1 then 'x' end as catalogue_id",
        "o_orderkey % 20 as sitelinks", "case when o_orderpriority = '5-LOW' then 'French painter' else 'French organist' end as description",
    )
    checked = validate.early_pool_issues(pool)
    return checked.select("id", F.size("issues").cast("bigint").alias("n"), F.array_join("issues", ";").alias("issues"))


@query(
    "agg19_graph_fingerprint",
    """, k AS (SELECT * FROM entities WHERE node_type IN ('guitar', 'guitar_brand', 'genre')),
    h AS (SELECT 'nodes' AS part, sha256('["' || concat_ws('","', id, node_type, CAST(x AS VARCHAR), CAST(y AS VARCHAR), zone, CAST(starter AS VARCHAR), coalesce(CAST(era_start AS VARCHAR), 'null')) || '"]') AS h FROM k
      UNION ALL SELECT 'edges', sha256('["' || concat_ws('","', source, target, type, label, coalesce(CAST(strength AS VARCHAR), 'null')) || '"]') FROM relations
        WHERE source IN (SELECT id FROM k) AND target IN (SELECT id FROM k)),
    pt AS (SELECT part, sha256(concat_ws(':', CAST(count(*) AS VARCHAR), CAST(sum(CAST('0x' || substr(h, 1, 8) AS BIGINT)) AS VARCHAR), CAST(sum(CAST('0x' || substr(h, 9, 8) AS BIGINT)) AS VARCHAR), CAST(sum(CAST('0x' || substr(h, 17, 8) AS BIGINT)) AS VARCHAR), CAST(sum(CAST('0x' || substr(h, 25, 8) AS BIGINT)) AS VARCHAR), CAST(sum(CAST('0x' || substr(h, 33, 8) AS BIGINT)) AS VARCHAR), CAST(sum(CAST('0x' || substr(h, 41, 8) AS BIGINT)) AS VARCHAR), CAST(sum(CAST('0x' || substr(h, 49, 8) AS BIGINT)) AS VARCHAR), CAST(sum(CAST('0x' || substr(h, 57, 8) AS BIGINT)) AS VARCHAR))) AS fp FROM h GROUP BY part)
    SELECT sha256(array_to_string(list_sort(list(part || ':' || fp)), '|')) AS fingerprint FROM pt""",
    ("entities", "relations"),
)
def graph_fingerprint(spark, d):
    return diffs.graph_fingerprint(_nodes(spark, d), _edges(spark, d), "guitars")


@query(
    "snk02_10_upsert",
    """SELECT id, CASE WHEN id LIKE '%3' THEN 'renewed' WHEN id LIKE '%4' THEN 'new' ELSE status END AS status FROM review_rows
    WHERE status <> 'review' OR id LIKE '%3' OR id LIKE '%4'""",
    ("review_rows",),
)
def upsert(spark, d):
    rows = views.review_rows(spark, d).select("id", "status")
    new = rows.where("id like '%3' or id like '%4'").withColumn("status", F.lit("new"))
    again = rows.where("id like '%3'").withColumn("status", F.lit("renewed"))
    return diffs.upsert(rows.where("status <> 'review'"), new.unionByName(again), ["id"], [F.desc("status")])


@query(
    "snk03_missing_or_conflict",
    """, live AS (SELECT CASE WHEN id LIKE '%3' THEN id || '-other' ELSE id END AS id, CASE WHEN id LIKE '%3' THEN upper(label) ELSE label END AS label,
       CASE WHEN id LIKE '%2' THEN 'elsewhere' ELSE zone END AS zone FROM entities WHERE id NOT LIKE '%1'),
    o AS (SELECT lower(label) AS l, min(id) AS lo, max(id) AS hi FROM live GROUP BY 1)
    SELECT e.id, CASE WHEN o.lo <> e.id OR o.hi <> e.id THEN 'conflict' WHEN v.id IS NULL THEN 'missing'
      WHEN v.label = e.label AND v.zone IS NOT DISTINCT FROM e.zone THEN 'current' ELSE 'conflict' END AS state
    FROM entities e LEFT JOIN live v ON v.id = e.id LEFT JOIN o ON o.l = lower(e.label)""",
    ("entities",),
)
def missing_or_conflict(spark, d):
    nodes = _nodes(spark, d).select("id", "label", "zone")
    live = nodes.where("id not like '%1'").selectExpr(
        "case when id like '%3' then concat(id, '-other') else id end as id", "case when id like '%3' then upper(label) else label end as label",
        "case when id like '%2' then 'elsewhere' else zone end as zone",
    )
    return diffs.missing_or_conflict(nodes, live, "id", "label")


@query(
    "snk03_guarded_append",
    "SELECT id, label || ' ' || id AS label FROM entities",
    ("entities",),
)
def guarded_append(spark, d):
    rows = _nodes(spark, d).selectExpr("id", "concat(label, ' ', id) as label")
    live = rows.where("id not like 'genre-%'")
    states = diffs.missing_or_conflict(rows, live, "id", "label")
    return diffs.guarded_append(live, rows, states, "id")


@query(
    "snk04_update_states",
    """, live AS (SELECT source, target, type, label, context, CASE WHEN id LIKE '%2' THEN [] WHEN id LIKE '%3' THEN
         [{'label': 'Catalogue', 'url': 'https://catalogue.example.org/e/' || source, 'provider': 'other'}] ELSE sources END AS sources FROM tiered WHERE id NOT LIKE '%1'),
    c AS (SELECT source, target, type, label, count(*) AS n, any_value(context) AS context, any_value(sources) AS sources FROM live GROUP BY ALL)
    SELECT t.id, CASE WHEN coalesce(n, 0) <> 1 THEN 'conflict' WHEN t.context = c.context AND t.sources = c.sources THEN 'current'
         WHEN len(c.context) > 0 OR len(c.sources) > 0 THEN 'conflict' ELSE 'update' END AS state
    FROM tiered t LEFT JOIN c ON c.source = t.source AND c.target = t.target AND c.type = t.type AND c.label = t.label""",
    ("relations", "tiered"),
)
def update_states(spark, d):
    edges = _edges(spark, d)
    origin = views.source_struct("Catalogue", "concat('https://catalogue.example.org/e/', source)", "other")
    live = edges.where("id not like '%1'").withColumn(
        "sources", F.expr(f"case when id like '%2' then {views.NO_SOURCES} when id like '%3' then array({origin}) else sources end")
    )
    return diffs.update_states(edges, live, ["source", "target", "type", "label"])


@query(
    "snk05_append_missing",
    "SELECT id, label FROM entities",
    ("entities",),
)
def append_missing(spark, d):
    nodes = _nodes(spark, d).select("id", "label")
    existing = nodes.where("id like '%1'")
    patch = nodes.union(nodes.selectExpr("id", "concat(label, ' later')"))
    return diffs.append_missing(existing, patch, ["id"], [F.asc("label")])


@query(
    "snk06_fact_snapshot",
    "SELECT entity_id, text, array_to_string(tags, ',') AS tags, source_fingerprint FROM facts WHERE status = 'approved'",
    ("facts",),
)
def fact_snapshot(spark, d):
    from evigraph.sources.sinks import approved_snapshot

    rows = approved_snapshot(views.facts(spark, d).where("status = 'approved'").withColumn("verified_at", F.lit(None).cast("date")))
    return rows.select("entity_id", "text", F.array_join("tags", ",").alias("tags"), "source_fingerprint")


@query(
    "snk12_append_trials",
    """SELECT batch_no, count(*) AS trials FROM (SELECT event_id // 40 AS batch_no FROM events WHERE event_id < 20 * (SELECT count(*) FROM events)
         UNION ALL SELECT (SELECT max(event_id // 40) FROM events) + 1 FROM events) WHERE batch_no > (SELECT max(event_id // 40) FROM events) + 1 - 100 GROUP BY batch_no""",
)
def append_trials(spark, d):
    events = views.table(spark, d, "events")
    history = events.selectExpr("concat('b', event_id div 40) as batch", "event_id div 40 as batch_no", "event_type as mode")
    batch = events.selectExpr("event_type as mode")
    fresh = views.table(spark, d, "supplier").selectExpr("concat('band-', s_suppkey) as id")
    return diffs.append_trials(history, batch, fresh, keep=100).groupBy("batch_no").agg(F.count(F.lit(1)).alias("trials"))


@query(
    "snk13_set_status",
    "SELECT id, CASE WHEN value > 90 THEN 'imported' ELSE status END AS status, CASE WHEN value > 90 THEN 'published' ELSE reason END AS reason FROM review_rows",
    ("review_rows",),
)
def set_status(spark, d):
    rows = views.review_rows(spark, d)
    return diffs.set_status(rows, rows.where("value > 90").select("id"), "imported", "published").select("id", "status", "reason")


@query(
    "snk08_note_export",
    """, adj AS (SELECT source AS id, target AS o, label, context FROM relations UNION ALL SELECT target, source, label, context FROM relations),
    lines AS (SELECT a.id, e.label AS ol, '- [[' || a.o || '|' || e.label || ']] - ' || a.label || CASE WHEN len(a.context) > 0 THEN ' (' || array_to_string(a.context, '; ') || ')' ELSE '' END AS line FROM adj a JOIN entities e ON e.id = a.o)
    SELECT id, 2 AS section, row_number() OVER (PARTITION BY id ORDER BY ol COLLATE en, line) AS line_no, line FROM lines
    UNION ALL SELECT id, 0, unnest(range(1, 13)), unnest(['---', 'id: ' || id, 'label: "' || label || '"', 'type: ' || node_type, 'zone: ' || zone,
      'roles: [' || array_to_string(list_transform(roles, lambda v: '"' || v || '"'), ', ') || ']', 'aliases: [' || array_to_string(list_transform(aliases, lambda v: '"' || v || '"'), ', ') || ']',
      'eraStart: ' || coalesce(CAST(era_start AS VARCHAR), ''), 'layoutX: ' || CAST(x AS DECIMAL(18, 3)), 'layoutY: ' || CAST(y AS DECIMAL(18, 3)), 'starter: ' || starter, '---']) FROM entities
    UNION ALL SELECT id, 1, 1, '# ' || label FROM entities UNION ALL SELECT id, 1, 2, '## Summary' FROM entities UNION ALL SELECT id, 1, 3, CASE WHEN summary = '' THEN 'No summary yet.' ELSE summary END FROM entities
    UNION ALL SELECT id, 3, i, CASE WHEN len(sources) = 0 THEN 'No sources yet.' ELSE '- [' || sources[i].label || '](' || sources[i].url || ')' END FROM entities, range(1, 3) r(i) WHERE i <= greatest(1, len(sources))""",
    ("entities", "relations"),
)
def note_export(spark, d):
    from evigraph.sources.sinks import note_lines

    return note_lines(_nodes(spark, d), _edges(spark, d)).select("id", "section", "line_no", "line")


@query(
    "snk08_src07_round_trip",
    "SELECT id, label, node_type, zone, array_to_string(roles, '|') AS roles, array_to_string(aliases, '|') AS aliases, era_start, starter FROM entities",
    ("entities",),
)
def note_round_trip(spark, d):
    """Front matter written for every entity and read back; a note's head has twelve lines."""
    from evigraph.sources.readers import parse_notes
    from evigraph.sources.sinks import front_matter_lines

    heads = front_matter_lines(_nodes(spark, d)).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("lines"))
    notes = heads.select(F.col("id").alias("path"), F.array_join(F.transform("lines", lambda v: v["line"]), "\n").alias("value"))
    rows, _ = parse_notes(notes)
    return rows.select("id", "label", "node_type", "zone", F.array_join("roles", "|").alias("roles"), F.array_join("aliases", "|").alias("aliases"), "era_start", "starter")


@query(
    "snk08_src07_nested",
    """SELECT id, era_start AS since, aliases[1] AS first_alias, CAST(len(aliases) AS INTEGER) AS n_aliases, zone AS deep, starter FROM entities""",
    ("entities",),
)
def nested_round_trip(spark, d):
    """Nested front matter of every entity written, read back as variants and reached by path."""
    from evigraph.sources.readers import note_values
    from evigraph.sources.sinks import front_matter_lines

    span = F.parse_json(F.to_json(F.struct(F.col("era_start").alias("since"), F.col("aliases").alias("names"), F.struct(F.struct("zone").alias("inner")).alias("outer"))))
    nodes = _nodes(spark, d).withColumn("extra", F.create_map(F.lit("span"), span, F.lit("begins"), F.to_variant_object(F.array("starter"))))
    heads = front_matter_lines(nodes, "extra").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("lines"))
    notes = heads.select(F.array_join(F.transform("lines", lambda v: v["line"]), "\n").alias("value"))
    values = note_values(notes)
    at = lambda name, path, kind: F.try_variant_get(F.col("values")[name], path, kind)
    return values.select(
        at("id", "$", "string").alias("id"), at("span", "$.since", "int").alias("since"), at("span", "$.names[0]", "string").alias("first_alias"),
        F.size(at("span", "$.names", "array<string>")).alias("n_aliases"), at("span", "$.outer.inner.zone", "string").alias("deep"), at("begins", "$[0]", "boolean").alias("starter"),
    )


@query(
    "fn24_payload_elements",
    """SELECT o_orderkey AS id, CAST(i AS INTEGER) AS position, 'n' || (o_orderkey + i) AS name, CAST(o_orderkey % 9 + i AS BIGINT) AS rank
       FROM orders, range(4) r(i) WHERE i < o_orderkey % 4 AND o_orderkey % 11 <> 0""",
)
def payload_elements(spark, d):
    """Seeds inside the free payload of each request; every eleventh payload is broken."""
    from evigraph.sources.readers import payload_rows

    seeds = "transform(filter(sequence(0, 3), i -> i < o_orderkey % 4), i -> named_struct('name', concat('n', o_orderkey + i), 'rank', o_orderkey % 9 + i))"
    rows = views.table(spark, d, "orders").selectExpr(
        "o_orderkey as id", f"if(o_orderkey % 11 = 0, '{{broken', to_json(named_struct('title', o_orderstatus, 'deep', named_struct('seeds', {seeds})))) as payload"
    )
    return payload_rows(rows, "id", "payload", "$.deep.seeds", "struct<name:string,rank:bigint>").select("id", "position", "item.name", "item.rank")


@query(
    "snk03_guarded_publish",
    "SELECT id, label || ' ' || id AS label, CASE WHEN starts_with(id, 'genre-') THEN 2 ELSE 1 END AS written FROM entities",
    ("entities",),
)
def guarded_publish(spark, d):
    """A table in two guarded versions: first without genres, then with the missing ones inserted; the newest is read back."""
    from evigraph.sources import guarded
    from evigraph.streaming.leases import work_folder

    schema, path = "id string, label string, written int", work_folder(spark, "guarded")
    rows = _nodes(spark, d).selectExpr("id", "concat(label, ' ', id) as label")
    nothing = F.lit(None).cast("string")
    base = guarded.publish(rows.where("id not like 'genre-%'").withColumn("written", F.lit(1)), path, nothing)
    live = guarded.current(spark, path, schema)
    states = diffs.missing_or_conflict(rows, live.drop("written"), "id", "label").withColumnRenamed("id", "_id")
    new = rows.join(states, F.col("id") == F.col("_id")).where("state <> 'current'").select("id", "label", F.lit(2).alias("written"), "state")
    both = live.withColumn("state", F.lit("current")).unionByName(new)
    guarded.publish(both, path, F.when(F.col("state") == "conflict", F.col("id")), base)
    return guarded.current(spark, path, schema)


@query(
    "snk09_type_index",
    "SELECT node_type, row_number() OVER (PARTITION BY node_type ORDER BY label COLLATE en, id) AS line_no, '- [[' || id || '|' || label || ']]' AS line FROM entities",
    ("entities",),
)
def type_index(spark, d):
    from evigraph.sources.sinks import index_lines

    return index_lines(_nodes(spark, d))


@query(
    "top01_map_page",
    "SELECT id, starter, label FROM entities WHERE node_type IN ('band', 'guitarist', 'artist', 'genre') ORDER BY starter DESC, label COLLATE en, id LIMIT 800",
    ("entities",),
)
def map_page(spark, d):
    return neighborhood.map_page(_nodes(spark, d), "artists").select("id", "starter", "label")


@query(
    "top01_map_edges",
    """, p AS (SELECT id FROM entities WHERE node_type IN ('band', 'guitarist', 'artist', 'genre') ORDER BY starter DESC, label COLLATE en, id LIMIT 800)
    SELECT id FROM relations WHERE source IN (SELECT id FROM p) AND target IN (SELECT id FROM p) ORDER BY id LIMIT 5000""",
    ("entities", "relations"),
)
def map_edges(spark, d):
    return neighborhood.map_edges(_edges(spark, d), neighborhood.map_page(_nodes(spark, d), "artists")).select("id")


@query(
    "join03_neighborhood",
    """, n AS (SELECT target AS id FROM relations WHERE source = 'band-7' UNION SELECT source FROM relations WHERE target = 'band-7' UNION SELECT 'band-7')
    SELECT 'with_center' AS variant, id FROM (SELECT id FROM n ORDER BY id <> 'band-7', id LIMIT 80) UNION ALL SELECT 'plain', id FROM (SELECT id FROM n ORDER BY id LIMIT 80)""",
    ("relations",),
)
def one_hop(spark, d):
    edges = _edges(spark, d)
    kept = neighborhood.neighborhood(edges, "band-7").select(F.lit("with_center").alias("variant"), "id")
    return kept.unionByName(neighborhood.neighborhood(edges, "band-7", keep_center=False).select(F.lit("plain").alias("variant"), "id"))


@query(
    "join04_reach",
    """, b AS (SELECT source AS f, target AS t FROM relations UNION SELECT target, source FROM relations),
    l0 AS (SELECT 'brand-3' AS id UNION SELECT 'artist-3'), l1 AS (SELECT DISTINCT t AS id FROM b WHERE f IN (SELECT id FROM l0) AND t NOT IN (SELECT id FROM l0)),
    l2 AS (SELECT DISTINCT t AS id FROM b WHERE f IN (SELECT id FROM l1) AND t NOT IN (SELECT id FROM l0) AND t NOT IN (SELECT id FROM l1))
    SELECT id, 0 AS level FROM l0 UNION ALL SELECT id, 1 FROM l1 UNION ALL SELECT id, 2 FROM l2""",
    ("relations",),
)
def reach(spark, d):
    edges = _edges(spark, d)
    start = _nodes(spark, d).where("id in ('brand-3', 'artist-3')").select("id")
    return neighborhood.reach(edges, start, 2)


@query(
    "join05_adjacency",
    "SELECT id, other, other_label, strength FROM (SELECT source AS id, target AS other, target_label AS other_label, strength FROM ends UNION ALL SELECT target, source, source_label, strength FROM ends)",
    ("entities", "relations", "tiered", "ends"),
)
def adjacency(spark, d):
    return graph.adjacency(_edges(spark, d).select("source", "target", "strength"), _nodes(spark, d)).select("id", "other", "other_label", "strength")


@query(
    "top02_search",
    """SELECT 'all' AS variant, id FROM (SELECT id FROM entities WHERE contains(lower(concat_ws(' ', label, node_type, array_to_string(roles, ' '), array_to_string(metadata, ' '), array_to_string(aliases, ' '))), 'small')
         ORDER BY starts_with(lower(label), 'small') DESC, label COLLATE en, id LIMIT 12)
       UNION ALL SELECT 'labels', id FROM (SELECT id FROM entities WHERE contains(lower(concat_ws(' ', label, array_to_string(aliases, ' '))), 'ensemble 1') ORDER BY label COLLATE en, id LIMIT 12)""",
    ("entities",),
)
def search(spark, d):
    nodes = _nodes(spark, d)
    every = neighborhood.search(nodes, " Small ").select(F.lit("all").alias("variant"), "id")
    return every.unionByName(neighborhood.search_labels(nodes, "ensemble 1").select(F.lit("labels").alias("variant"), "id"))


@query(
    "src12_recordings_to_graph",
    """, c AS (SELECT 'group-' || l_orderkey AS g, 'nation-' || (l_orderkey % 25) AS z, 'S' || l_suppkey AS m FROM lineitem)
    SELECT 'node' AS part, g AS id FROM (SELECT DISTINCT g FROM c) UNION ALL SELECT 'node', 'member-' || m FROM (SELECT DISTINCT m FROM c)
    UNION ALL SELECT 'edge', 'member-' || m || '-' || g FROM (SELECT DISTINCT m, g FROM c)""",
    ("blocked",),
)
def recordings_to_graph(spark, d):
    lines = views.table(spark, d, "lineitem")
    catalogue = lines.groupBy("l_orderkey").agg(F.expr("collect_list(concat('S', l_suppkey)) as members")).selectExpr(
        "concat('group-', l_orderkey) as group_id", "concat('Group ', l_orderkey) as group_label",
        "concat('nation-', l_orderkey % 25) as zone", "members",
    )
    nodes, edges = assemble.recordings_to_graph(catalogue)
    return nodes.select(F.lit("node").alias("part"), "id").unionByName(edges.select(F.lit("edge").alias("part"), "id"))


@query(
    "win12_change_events",
    """, w AS (SELECT *, lag(status) OVER p AS ps, lag(coalesce(review_reason_code, '')) OVER p AS pr, lag(id) OVER p AS pid FROM review_rows WINDOW p AS (PARTITION BY user_id ORDER BY updated_at, id))
    SELECT id, ps AS previous_status, status FROM w WHERE CASE WHEN pid IS NULL THEN status IN ('approved', 'imported', 'rejected') ELSE ps <> status OR pr <> coalesce(review_reason_code, '') END""",
    ("review_rows",),
)
def change_events(spark, d):
    from evigraph.streaming.review_log import batch_events

    rows = views.review_rows(spark, d).withColumn("version", F.col("id")).withColumn("note", F.lit(None).cast("string"))
    events = batch_events(rows.withColumn("candidate_id", F.col("user_id")), "candidate_id", ["updated_at", "id"])
    return events.select("id", "previous_status", "status")


@query(
    "win13_latest_per_key",
    "SELECT user_id, id, status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, id DESC) AS n FROM review_rows) WHERE n = 1",
    ("review_rows",),
)
def latest_per_key(spark, d):
    return diffs.latest_per_key(views.review_rows(spark, d), ["user_id"], "updated_at", "id").select("user_id", "id", "status")


@query(
    "win01_03_first_and_capped",
    """SELECT 'first' AS variant, id FROM (SELECT id, row_number() OVER (PARTITION BY seed_name, requested_kind ORDER BY value DESC, id) AS n FROM review_rows) WHERE n = 1
       UNION ALL SELECT 'capped', id FROM (SELECT id, row_number() OVER (PARTITION BY seed_name ORDER BY value DESC, id) AS n FROM review_rows) WHERE n <= 6""",
    ("review_rows",),
)
def first_and_capped(spark, d):
    rows = views.review_rows(spark, d)
    order = [F.desc("value"), F.asc("id")]
    first = validate.first_wins(rows, ["seed_name", "requested_kind"], order).select(F.lit("first").alias("variant"), "id")
    return first.unionByName(diffs.capped_per_key(rows, ["seed_name"], order, 6).select(F.lit("capped").alias("variant"), "id"))


@query(
    "fn_hashes",
    """SELECT id, list_reduce(list_concat([2166136261::BIGINT], list_transform(string_split(id, ''), lambda c: ord(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS fnv,
       list_sum(list_transform(range(1, length(id) + 1), lambda i: (i + 16) * ord(substr(id, i, 1))))::BIGINT AS number, sha256('u' || chr(10) || lower(label)) AS print FROM entities""",
    ("entities",),
)
def hashes(spark, d):
    return _nodes(spark, d).select(
        "id", hashing.fnv1a(F.col("id")).alias("fnv"), hashing.stable_number(F.col("id")).alias("number"),
        hashing.fingerprint(F.lit("u"), F.lower("label")).alias("print"),
    )
