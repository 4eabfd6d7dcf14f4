"""Queries on resolution, catalogues, claims, places, layouts, trials, notes, pages and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigraph import vocab
from evigraph.functions import refs
from evigraph.operators import geography, graph, resolve, spatial, titles, trials
from evigraph.plans import views
from evigraph.plans.registry import ORACLES, query
from evigraph.session import attach_row, cut_lineage
from evigraph.sources import readers, sinks
from evigraph.streaming import leases, review_log

UID = vocab.MEMBERSHIP_TYPE_ID


def _nodes(spark, d):
    return views.entities(spark, d)


def _edges(spark, d):
    return views.relations(spark, d)


@query(
    "join06_resolve_titles",
    """, k AS (SELECT key, min(id) AS id FROM (SELECT lower(label) AS key, id FROM entities UNION ALL SELECT lower(unnest(aliases)), id FROM entities) WHERE key <> '' GROUP BY key)
    SELECT p_partkey AS p, coalesce(k.id, trim(regexp_replace(lower(t.name), '[^a-z0-9]+', '-', 'g'), '-')) AS node_id, k.id IS NOT NULL AS known
    FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'Ensemble ' || p_partkey WHEN p_partkey % 3 = 1 THEN 'performer ' || p_partkey ELSE p_name || ' x' END AS name FROM part) t LEFT JOIN k ON k.key = lower(t.name)""",
    ("entities",),
)
def resolve_titles(spark, d):
    wanted = views.table(spark, d, "part").selectExpr(
        "p_partkey as p", "case when p_partkey % 3 = 0 then concat('Ensemble ', p_partkey, ' (band)') when p_partkey % 3 = 1 then concat('performer ', p_partkey) "
        "else concat(p_name, ' x') end as title",
    )
    return resolve.resolve_titles(wanted, resolve.title_index(_nodes(spark, d))).select("p", "node_id", "known")


@query(
    "join07_unique_index",
    "SELECT lower(label) AS key, min(id) AS id FROM (SELECT * FROM entities UNION ALL SELECT * REPLACE (id || '-b' AS id) FROM entities WHERE id LIKE '%3') GROUP BY 1 HAVING count(*) = 1",
    ("entities",),
)
def unique_index(spark, d):
    nodes = _nodes(spark, d).select("id", "label")
    twice = nodes.union(nodes.where("id like '%3'").selectExpr("concat(id, '-b')", "label"))
    return resolve.unique_index(twice, F.lower("label"))


@query(
    "join15_feedback_seeds",
    """, u AS (SELECT lower(label) AS k, min(id) AS id, count(*) AS n FROM entities WHERE node_type IN ('artist', 'band') GROUP BY 1 HAVING count(*) = 1),
    h AS (SELECT u.id, r.requested_kind, r.updated_at AS o FROM review_rows r JOIN u ON u.k = lower(r.seed_name) WHERE r.status = 'rejected' AND r.review_reason_code = 'weak_connection' AND payload_kind <> 'typed_connection'),
    g AS (SELECT h.*, list_filter(list_transform(e.sources, lambda s: regexp_extract(s.url, 'musicbrainz.org/artist/(.*)$', 1)), lambda v: v <> '')[1] AS own FROM h JOIN entities e ON e.id = h.id
      WHERE h.requested_kind = CASE WHEN list_contains(e.roles, 'guitarist') THEN 'guitarist' ELSE e.node_type END AND h.id NOT LIKE '%7')
    SELECT id AS node_id, own AS catalogue_id FROM (SELECT id, own, min(o) AS o FROM g GROUP BY 1, 2) ORDER BY o, id LIMIT 20""",
    ("entities", "review_rows"),
)
def feedback_seeds(spark, d):
    nodes = _nodes(spark, d)
    reviews = views.review_rows(spark, d).withColumn("catalogue_id", F.lit(None).cast("string")).withColumn("order", F.col("updated_at"))
    return resolve.feedback_seeds(nodes, reviews, nodes.where("id like '%7'").select("id"), 20)


@query(
    "join16_reconcile",
    """SELECT id AS node_id, CASE WHEN id LIKE '%7' AND id NOT LIKE '%1%' THEN NULL WHEN id LIKE '%9' THEN 'Q' || length(id) ELSE 'Q' || length(id) END AS item,
       CASE WHEN id LIKE '%7' AND id NOT LIKE '%1%' THEN 'identity_conflict' ELSE 'resolved' END AS state FROM entities""",
    ("entities",),
)
def reconcile(spark, d):
    nodes = _nodes(spark, d)
    direct = nodes.where("id not like '%9'").selectExpr("id as node_id", "concat('Q', length(id)) as item")
    page = nodes.where("id not like '%1%' or id like '%9'").selectExpr(
        "id as node_id", "case when id like '%7' then 'Q0' else concat('Q', length(id)) end as item"
    )
    return resolve.reconcile(direct, page)


def _catalogue_relations(spark, d):
    """Order lines as catalogue relations of the customer, some of the wrong kind."""
    orders = views.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = views.table(spark, d, "lineitem").join(orders, F.expr("l_orderkey = o_orderkey"))
    return lines.selectExpr(
        "concat('a0000000-0000-4000-8000-', lpad(cast(o_custkey as string), 12, '0')) as seed_mbid", "'Person' as seed_type",
        f"case when l_returnflag = 'R' then 'other' else '{UID}' end as type_id",
        "upper(concat('b0000000-0000-4000-8000-', lpad(cast(l_suppkey * 3 as string), 12, '0'))) as other_id",
        "concat('Group ', l_suppkey * 3) as other_name", "case when l_linestatus = 'O' then 'Group' else 'Person' end as other_type",
        "cast(year(l_shipdate) as string) as begin", "case when l_linenumber = 1 then '' else '2005' end as end",
        "concat('artist-', o_custkey) as person",
    )


_REL_SQL = """, rel AS (SELECT o_custkey AS c, l_suppkey * 3 AS s, CAST(year(l_shipdate) AS VARCHAR) AS b, CASE WHEN l_linenumber = 1 THEN NULL ELSE '2005' END AS e
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag <> 'R' AND l_linestatus = 'O')"""


@query(
    "join13_membership_proposals",
    _REL_SQL + """, p AS (SELECT DISTINCT 'artist-' || c AS source, 'band-' || s AS target, b, e FROM rel WHERE c % 5 IN (3, 4) AND s % 5 IN (3, 4) AND s < (SELECT count(*) FROM supplier)
       AND c < (SELECT count(*) FROM customer)),
    x AS (SELECT DISTINCT source, target FROM tiered WHERE type = 'member_of' AND tier <> 'research_lead')
    SELECT 'mb-member-' || source || '-' || target AS id, count(*) AS periods FROM p WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.source = p.source AND x.target = p.target) GROUP BY 1""",
    ("relations", "tiered"),
)
def membership_proposals(spark, d):
    found = resolve.membership_proposals(_nodes(spark, d), _catalogue_relations(spark, d), _edges(spark, d))
    return found.select("id", F.size("periods").cast("bigint").alias("periods"))


@query(
    "join14_membership_discoveries",
    _REL_SQL + """, known AS (SELECT s_suppkey AS s FROM supplier WHERE s_suppkey % 5 IN (3, 4)), g AS (SELECT c, s, count(*) AS n FROM rel WHERE c % 5 IN (3, 4) AND s NOT IN (SELECT s FROM known) GROUP BY 1, 2)
    SELECT 'artist-' || c AS seed, 'mb-band-b0000000-0000-4000-8000-' || lpad(CAST(s AS VARCHAR), 12, '0') AS target, 'Group ' || s AS name, n AS relations
    FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY 'Group ' || s, lpad(CAST(s AS VARCHAR), 12, '0')) AS r FROM g) WHERE r <= 3""",
    ("blocked",),
)
def membership_discoveries(spark, d):
    return resolve.membership_discoveries(_nodes(spark, d), _catalogue_relations(spark, d))


@query(
    "flt30_membership_candidates",
    """, r AS (SELECT s_suppkey, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 60 AS o, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS pos
       FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
    f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey, o ORDER BY pos) AS n FROM r WHERE l_partkey % 7 <> 0 AND o % 9 <> 0) WHERE n = 1)
    SELECT 'Act ' || s_suppkey AS seed, 'Person ' || o AS title, rank FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY pos) AS rank FROM f) WHERE rank <= 12""",
    ("blocked",),
)
def membership_candidates(spark, d):
    from pyspark.sql import Window

    seeds = views.table(spark, d, "supplier").selectExpr("concat('Act ', s_suppkey) as seed", "'band' as kind", "cast(s_suppkey as string) as seed_mbid")
    window = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")
    lines = views.table(spark, d, "lineitem").withColumn("pos", F.row_number().over(window)).selectExpr(
        "cast(l_suppkey as string) as seed_mbid", "'member of band' as type", "case when l_partkey % 7 = 0 then 'forward' else 'backward' end as direction",
        "concat('id-', l_partkey % 60) as other_id", "case when l_partkey % 60 % 9 = 0 then 'Rolling Stone' else concat('Person ', l_partkey % 60) end as other_name",
        "'Person' as other_type", "'' as begin", "'' as end", "pos",
    )
    return resolve.membership_candidates(seeds, lines).select("seed", "title", "rank")


@query(
    "flt29_promoted_edges",
    """SELECT 'brain-' || s || '-' || t || '-' || ty AS id, s AS source, t AS target, CASE WHEN ty = 'member_of' AND l_linenumber % 2 = 0 THEN 'Member' ELSE replace(ty, '_', ' ') END AS label, CASE WHEN l_quantity > 25 THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END AS strength
       FROM (SELECT *, CASE WHEN ty = 'member_of' AND l_suppkey % 2 = 0 THEN 'band-' || l_suppkey ELSE 'artist-' || l_partkey END AS s, CASE WHEN ty = 'member_of' AND l_suppkey % 2 = 0 THEN 'artist-' || l_partkey ELSE 'band-' || l_suppkey END AS t FROM (
         SELECT *, CASE l_returnflag WHEN 'A' THEN 'member_of' WHEN 'N' THEN 'influenced_by' ELSE 'fan_of' END AS ty FROM lineitem)) WHERE ty <> 'fan_of' AND l_linenumber <> 3""",
)
def promoted_edges(spark, d):
    kind = "case l_returnflag when 'A' then 'member_of' when 'N' then 'influenced_by' else 'fan_of' end"
    rows = views.table(spark, d, "lineitem").selectExpr(
        "concat('artist-', l_partkey) as seed_id", "concat('band-', l_suppkey) as target_id",
        f"named_struct('type', {kind}, 'label', case when {kind} = 'member_of' and l_linenumber % 2 = 0 then 'Member' else '' end, 'context', 'c', "
        "'source_url', case when l_linenumber = 3 then 'ftp://x' else 'https://x.example.org' end, 'seed_mb_id', '', 'seed_is_band', l_suppkey % 2 = 0, "
        "'strength', case when l_quantity > 25 then 0.8D end) as relation",
    )
    return resolve.promoted_edges(rows).select("id", "source", "target", "label", "strength")


_PATCH_SQL = """, c AS (SELECT l_orderkey AS ro, l_linenumber * 1000000 + l_partkey AS pos, 'artist-' || o_custkey AS seed, 'Find ' || (l_partkey % 400) AS title, l_returnflag <> 'R' AS zoned FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY ro, pos) AS n FROM c WHERE zoned) WHERE n = 1),
    g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY ro, pos) AS m FROM f) WHERE m <= 6), made AS (SELECT * FROM g ORDER BY ro, pos LIMIT 50)"""


@query("join30_flt34_promotion_nodes", _PATCH_SQL + " SELECT lower(replace(title, ' ', '-')) AS id, title AS label FROM made", ("blocked",))
def promotion_nodes(spark, d):
    made, _ = _patch(spark, d)
    return made.select("id", "label")


@query(
    "join30_promotion_edges",
    _PATCH_SQL + """ SELECT DISTINCT seed AS source, lower(replace(title, ' ', '-')) AS target FROM c WHERE title IN (SELECT title FROM made)""",
    ("blocked",),
)
def promotion_edges(spark, d):
    _, edges = _patch(spark, d)
    return edges.select("source", "target")


def _patch(spark, d):
    orders = views.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    rows = views.table(spark, d, "lineitem").join(orders, F.expr("l_orderkey = o_orderkey")).selectExpr(
        "l_orderkey as row_order", "l_linenumber * 1000000 + l_partkey as pos", "concat('artist-', o_custkey) as seed_id",
        "concat('Find ', l_partkey % 400) as title", "'artist' as kind", "case when l_returnflag <> 'R' then 'jazz' end as zone",
        "named_struct('type', 'related', 'label', '', 'context', 'c', 'source_url', 'https://x.example.org', 'seed_mb_id', '', 'seed_is_band', false, 'strength', 0.5D) as relation",
    )
    return resolve.promotion_patch(rows, _nodes(spark, d), _edges(spark, d), 50, 6)


def _proposals(spark, d):
    origin = views.source_struct("Catalogue", "concat('https://musicbrainz.org/artist/', user_id)", "musicbrainz")
    return views.review_rows(spark, d).selectExpr(
        "id", "concat('artist-', user_id) as source", "concat('band-', user_id % 40) as target", "status", f"array({origin}) as sources",
        "array(named_struct('begin', '1999', 'end', case when value > 50 then '2001' end)) as periods", "value",
    )


def _memberships(spark, d):
    """Live memberships: one per user, sourced for even users."""
    good = views.source_struct("Catalogue", "concat('https://musicbrainz.org/artist/', user_id)", "musicbrainz")
    users = views.review_rows(spark, d).select("user_id").distinct()
    return users.selectExpr(
        "concat('e-', user_id) as id", "concat('artist-', user_id) as source", "concat('band-', user_id % 40) as target", "'member_of' as type", "'Member of' as label",
        f"case when user_id % 2 = 0 then array({good}) else {views.NO_SOURCES} end as sources", "user_id",
    ).where("user_id % 3 <> 0")


@query(
    "join32_stage_memberships",
    """, o AS (SELECT *, row_number() OVER (ORDER BY id) AS p FROM review_rows WHERE status = 'approved' AND value <= 90)
    SELECT id, CASE WHEN p > 500 THEN 'deferred' WHEN user_id % 3 = 0 THEN 'stage' WHEN user_id % 2 = 0 THEN 'already_present' ELSE 'needs_review' END AS state FROM o""",
    ("review_rows",),
)
def stage_memberships(spark, d):
    proposals = _proposals(spark, d)
    return resolve.stage_memberships(proposals, _memberships(spark, d), proposals.where("value > 90").select("id"), 500)


@query(
    "join27_readback",
    "SELECT id, status IN ('approved', 'imported') AND user_id % 7 <> 0 AS approved, user_id % 3 <> 0 AND user_id % 2 = 0 AS published FROM review_rows",
    ("review_rows",),
)
def readback(spark, d):
    rows = _proposals(spark, d).withColumn("edge_id", F.concat(F.lit("x-"), "id"))
    candidates = rows.withColumn("edge_id", F.expr("case when cast(substr(source, 8) as bigint) % 7 = 0 then 'other' else edge_id end"))
    return resolve.readback(rows.select("id", "edge_id", "source", "target"), candidates, _memberships(spark, d))


@query(
    "join28_publishable",
    "SELECT id, 'e-' || user_id AS edge_id FROM review_rows WHERE status = 'approved' AND user_id % 3 <> 0 AND user_id % 2 = 0",
    ("review_rows",),
)
def publishable(spark, d):
    rows = _proposals(spark, d)
    ledger = rows.selectExpr("id", "concat('e-', substr(source, 8)) as edge_id")
    return resolve.publishable(ledger, rows, _memberships(spark, d))


@query(
    "fn15_join33_periods",
    "SELECT id, true AS valid, CASE WHEN value > 50 THEN '1999 to 2001' ELSE '1999 onward (end not recorded)' END AS text, value > 50 AS complete FROM review_rows",
    ("review_rows",),
)
def periods(spark, d):
    rows = _proposals(spark, d)
    expected = F.expr("array(named_struct('begin', '1999', 'end', '2001'))")
    complete = rows.select(F.col("id").alias("_id"), resolve.has_expected_periods(expected, F.col("periods")).alias("complete"))
    return resolve.period_lines(rows).join(complete, F.col("id") == F.col("_id")).drop("_id")


@query(
    "fn16_group_start",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND year(o_orderdate) <= 1999 THEN CAST(year(o_orderdate) AS INTEGER) END AS year FROM orders",
)
def group_start(spark, d):
    begin = F.expr("case when o_orderkey % 3 = 0 then date_format(o_orderdate, 'yyyy-MM') when o_orderkey % 3 = 1 then 'about 1990' end")
    return views.table(spark, d, "orders").select("o_orderkey", resolve.group_start(begin, 1999).alias("year"))


@query(
    "join26_request_of_seed",
    """, r AS (SELECT lower('Act ' || (l_partkey % 300)) AS n, l_orderkey, row_number() OVER (PARTITION BY l_partkey % 300 ORDER BY l_orderkey) AS k FROM lineitem)
    SELECT p_partkey AS p, 'req-' || r.l_orderkey AS request_id FROM part LEFT JOIN r ON r.n = 'act ' || p_partkey AND r.k = 1""",
    ("blocked",),
)
def request_of_seed(spark, d):
    requests = views.table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.expr("collect_list(named_struct('name', concat('Act ', l_partkey % 300), 'kind', 'band')) as seeds")
    ).selectExpr("concat('req-', l_orderkey) as request_id", "l_orderkey as position", "seeds")
    seeds = views.table(spark, d, "part").selectExpr("p_partkey as p", "concat('ACT ', p_partkey) as name", "'band' as kind")
    return resolve.request_of_seed(seeds, requests).select("p", "request_id")


@query(
    "join36_catalogue_match",
    """, c AS (SELECT s_suppkey, 'i-' || s_suppkey AS item, lower('Ensemble ' || (s_suppkey % 40)) AS n FROM supplier),
    b AS (SELECT n, min(s_suppkey) AS k FROM c WHERE s_suppkey % 3 <> 0 GROUP BY n)
    SELECT p_partkey AS p, CASE WHEN p_partkey % 4 = 0 AND p_partkey < (SELECT count(*) FROM supplier) THEN 'i-' || p_partkey ELSE 'i-' || b.k END AS item_id, CASE WHEN p_partkey % 4 = 0 AND p_partkey < (SELECT count(*) FROM supplier) THEN 'linked' ELSE 'name' END AS matched_by
    FROM part LEFT JOIN b ON b.n = 'ensemble ' || (p_partkey % 50) WHERE (p_partkey % 4 = 0 AND p_partkey < (SELECT count(*) FROM supplier)) OR b.k IS NOT NULL""",
    ("blocked",),
)
def catalogue_match(spark, d):
    seeds = views.table(spark, d, "part").selectExpr(
        "p_partkey as p", "concat('Ensemble_', p_partkey % 50, repeat(' ', cast(p_partkey % 3 as int))) as seed", "'band' as kind", "case when p_partkey % 4 = 0 then concat('i-', p_partkey) end as linked_id"
    )
    catalogue = views.table(spark, d, "supplier").selectExpr(
        "concat('i-', s_suppkey) as item_id", "concat('Ensemble ', s_suppkey % 40) as name", "case when s_suppkey % 3 = 0 then 'Person' else 'Group' end as type",
        "'a village' as description", "s_suppkey as rank",
    )
    return resolve.catalogue_match(seeds, catalogue, ["p"]).select("p", "item_id", "matched_by")


@query(
    "join37_page_for_seed",
    """SELECT 'Act ' || s_suppkey AS seed, CASE WHEN s_suppkey % 3 = 0 THEN 'Act ' || s_suppkey ELSE 'Act ' || s_suppkey || ' (band)' END AS title FROM supplier WHERE s_suppkey % 3 = 0 OR s_suppkey % 2 = 0""",
)
def page_for_seed(spark, d):
    rows = views.table(spark, d, "supplier")
    seeds = rows.selectExpr("concat('Act ', s_suppkey) as seed", "'band' as kind", "cast(null as string) as preferred")
    plain = rows.selectExpr("concat('Act ', s_suppkey) as title", "case when s_suppkey % 3 = 0 then 'A rock band.' else 'A village.' end as extract", f"{views.NO_STRINGS} as categories")
    suffixed = rows.where("s_suppkey % 2 = 0").selectExpr("concat('Act ', s_suppkey, ' (band)') as title", "'A rock band.' as extract", f"{views.NO_STRINGS} as categories")
    return resolve.page_for_seed(seeds, plain.union(suffixed)).select("seed", "title")


@query(
    "src09_resolve_redirects",
    """SELECT p_partkey AS p, 'Page ' || CASE WHEN p_partkey % 10 < 7 THEN p_partkey + least(3, 7 - p_partkey % 10) ELSE p_partkey END AS resolved FROM part""",
)
def resolve_redirects(spark, d):
    rows = views.table(spark, d, "part")
    wanted = rows.selectExpr("p_partkey as p", "concat('Page_', p_partkey) as title").selectExpr("p", "replace(title, '_', ' ') as title")
    redirects = rows.where("p_partkey % 10 < 7").selectExpr("concat('page ', p_partkey) as from_title", "concat('Page ', p_partkey + 1) as to_title")
    return resolve.resolve_redirects(wanted, redirects).select("p", "resolved")


@query(
    "flt36_archive_leads",
    """SELECT seed, identifier FROM (SELECT 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS seed, 'item-' || o_orderkey AS identifier, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n
       FROM orders WHERE o_orderkey % 5 <> 0) WHERE n <= 2""",
)
def archive_leads(spark, d):
    seeds = views.table(spark, d, "customer").selectExpr("upper(c_name) as seed", "c_name").selectExpr("c_name as seed")
    items = views.table(spark, d, "orders").selectExpr(
        "case when o_orderkey % 5 = 0 then concat('bad item ', o_orderkey) else concat('item-', o_orderkey) end as identifier", "'t' as title", "o_orderkey as rank",
        "array('x', concat('CUSTOMER ', lpad(cast(o_custkey as string), 9, '0'))) as creators",
    )
    return resolve.archive_leads(seeds, items)


@query(
    "join38_assemble_packages",
    """SELECT 'Act ' || s_suppkey AS seed, CASE WHEN s_suppkey % 2 = 0 THEN 'Page ' || s_suppkey END AS page, CASE WHEN s_suppkey % 3 = 0 THEN 'Q' || s_suppkey END AS item, 'mb-' || s_suppkey AS mbid,
       coalesce((SELECT string_agg(DISTINCT 'a-' || (p_partkey % 3), ',' ORDER BY 'a-' || (p_partkey % 3)) FROM part WHERE p_partkey % 40 = s_suppkey), '') AS leads FROM supplier""",
)
def assemble_packages(spark, d):
    rows = views.table(spark, d, "supplier")
    seeds = rows.selectExpr("concat('Act ', s_suppkey) as seed")
    pages = rows.where("s_suppkey % 2 = 0").selectExpr("concat('Act ', s_suppkey) as seed", "concat('Page ', s_suppkey) as page")
    items = rows.where("s_suppkey % 3 = 0").selectExpr("concat('Act ', s_suppkey) as seed", "concat('Q', s_suppkey) as item")
    catalogue = rows.selectExpr("concat('Act ', s_suppkey) as seed", "concat('mb-', s_suppkey) as mbid")
    leads = views.table(spark, d, "part").selectExpr("concat('Act ', p_partkey % 40) as seed", "concat('a-', p_partkey % 3) as identifier")
    packed = resolve.assemble_packages(seeds, pages, items, catalogue, leads)
    return packed.select("seed", "page", "item", "mbid", F.array_join("archive_leads", ",").alias("leads"))


# --- claims and places ----------------------------------------------------------------------------------------


def _claims(spark, d):
    """Claims of customers (birth place), suppliers (formation place), parts as places and their countries."""
    customer, supplier, part = (views.table(spark, d, n) for n in ("customer", "supplier", "part"))
    none = views.NO_STRINGS

    def rows(df, entity, prop, item, rank, lat="cast(null as double)", lon="cast(null as double)", globe="cast(null as string)", tail="'s'"):
        return df.selectExpr(
            f"concat('Q', {entity}) as entity_id", f"'{prop}' as property", f"concat({tail}, {entity}) as statement_id", f"{rank} as rank", "'value' as snaktype",
            f"{item} as value_id", "cast(null as string) as value_time", "cast(null as string) as value_text", f"{lat} as lat", f"{lon} as lon", f"{globe} as globe", f"{none} as reference_urls",
        )

    born = rows(customer, "c_custkey * 10 + 1", "P19", "concat('Q', (c_custkey % 50) * 10 + 3)", "case when c_custkey % 9 = 0 then 'deprecated' else 'normal' end")
    second = rows(customer.where("c_custkey % 4 = 0"), "c_custkey * 10 + 1", "P19", "'Q13'", "case when c_custkey % 8 = 0 then 'preferred' else 'normal' end", tail="'t'")
    formed = rows(supplier, "s_suppkey * 10 + 2", "P740", "concat('Q', (s_suppkey % 50) * 10 + 3)", "'normal'")
    point = rows(part, "p_partkey * 10 + 3", "P625", "cast(null as string)", "'normal'", "p_partkey * 1D", "p_partkey * 2D",
                 f"case when p_partkey % 11 = 0 then 'moon' else '{geography.EARTH}' end")
    drift = rows(part.where("p_partkey % 7 = 0"), "p_partkey * 10 + 3", "P625", "cast(null as string)", "'normal'", "p_partkey * 1D + 0.02D", "p_partkey * 2D", f"'{geography.EARTH}'", tail="'t'")
    country = rows(part, "p_partkey * 10 + 3", "P17", "concat('Q', (p_partkey % 5) * 10 + 4)", "'normal'")
    return born.union(second).union(formed).union(point).union(drift).union(country)


def _identities(spark, d):
    customer, supplier = views.table(spark, d, "customer"), views.table(spark, d, "supplier")
    people = customer.selectExpr("concat('artist-', c_custkey) as node_id", "'artist' as node_type", "concat('Q', c_custkey * 10 + 1) as item")
    return people.union(supplier.selectExpr("concat('band-', s_suppkey)", "'band'", "concat('Q', s_suppkey * 10 + 2)"))


def _labels(spark, d):
    part, region = views.table(spark, d, "part"), views.table(spark, d, "region")
    places = part.selectExpr("concat('Q', p_partkey * 10 + 3) as entity_id", "case when p_partkey % 2 = 0 then concat('City ', p_partkey) else '' end as en", "concat('Ciudad ', p_partkey) as mul")
    return places.union(region.selectExpr("concat('Q', r_regionkey * 10 + 4)", "r_name", "r_name"))


_PLACE_SQL = """, loc AS (SELECT 'artist-' || c AS node_id, 'birthplace' AS role, pl FROM (SELECT c_custkey AS c, CASE
      WHEN c_custkey % 8 = 0 THEN 1 WHEN c_custkey % 4 = 0 THEN CASE WHEN c_custkey % 9 = 0 OR c_custkey % 50 = 1 THEN 1 END WHEN c_custkey % 9 <> 0 THEN c_custkey % 50 END AS pl FROM customer) WHERE pl IS NOT NULL
    UNION ALL SELECT 'band-' || s_suppkey, 'musical_base', s_suppkey % 50 FROM supplier)
  , placed AS (SELECT node_id, role, 'wikidata:Q' || (pl * 10 + 3) AS place_id, CASE WHEN pl % 2 = 0 THEN 'City ' || pl ELSE 'Ciudad ' || pl END AS name, r_name AS country, pl + CASE WHEN pl % 77 = 0 THEN 0.02::DOUBLE ELSE 0.0::DOUBLE END AS lat, pl * 2.0::DOUBLE AS lon
      FROM loc JOIN region ON r_regionkey = pl % 5 WHERE ((pl % 7 <> 0 AND pl % 11 <> 0) OR pl % 77 = 0) AND pl * 2 <= 180 AND pl <= 90)"""


@query("join35_location_claims", _PLACE_SQL + " SELECT node_id, role, 'Q' || (pl * 10 + 3) AS place_item FROM loc", ("blocked",))
def location_claims(spark, d):
    return geography.location_claims(_identities(spark, d), _claims(spark, d)).select("node_id", "role", "place_item")


@query("join17_placements", _PLACE_SQL + " SELECT node_id, role, place_id, name, country, lat, lon FROM placed", ("blocked",))
def placements(spark, d):
    claims = cut_lineage(_claims(spark, d))
    return geography.placements_from_claims(geography.location_claims(_identities(spark, d), claims), claims, _labels(spark, d))


@query(
    "snk11_geography_outputs",
    _PLACE_SQL + """, t AS (SELECT 'artist-' || c_custkey AS id FROM customer UNION ALL SELECT 'band-' || s_suppkey FROM supplier)
    SELECT count(*) AS graph_targets, count(*) FILTER (id NOT LIKE '%5' AND id NOT LIKE '%6') AS identified, count(*) FILTER (id LIKE '%5') AS identity_conflicts, (SELECT count(*) FROM loc) AS claims,
      (SELECT count(*) FROM placed) AS placed, (SELECT count(*) FROM placed WHERE node_id LIKE 'band-%') AS bands_placed, (SELECT count(*) FROM placed WHERE role = 'birthplace') AS people_with_birthplace,
      count(*) FILTER (id NOT IN (SELECT node_id FROM placed)) AS unplaced, (SELECT count(*) FROM placed) AS written FROM t""",
    ("blocked",),
)
def geography_outputs(spark, d):
    """A whole run written to the shared folder, and its summary row read back with the number of placements written."""
    claims = cut_lineage(_claims(spark, d))
    identities, nodes = _identities(spark, d), _nodes(spark, d)
    located = geography.location_claims(identities, claims)
    placed = geography.placements_from_claims(located, claims, _labels(spark, d))
    states = identities.selectExpr("node_id", "case when node_id like '%5' then 'identity_conflict' when node_id like '%6' then 'identity_unresolved' else 'resolved' end as state")
    targets = identities.select(F.col("node_id").alias("id"))
    missing = geography.unresolved(targets, states, located, placed)
    bridges = geography.cross_place_relations(_edges(spark, d), placed)
    summary = geography.geography_summary(targets, states, located, placed, nodes, bridges, missing)
    folder = leases.work_folder(spark, "geography")
    sinks.write_geography(folder, summary, placed, located.where("node_id like '%7'"), missing)
    written = spark.read.parquet(f"{folder}/placements").agg(F.count(F.lit(1)).alias("written"))
    return attach_row(spark.read.parquet(f"{folder}/summary").drop("cross_place_relations"), written)


@query(
    "agg27_unresolved",
    _PLACE_SQL + """ SELECT reason, count(*) AS n FROM (SELECT CASE WHEN id LIKE '%5' THEN 'identity_conflict' WHEN id LIKE '%6' THEN 'identity_unresolved' WHEN l.node_id IS NULL THEN 'location_claim_missing' ELSE 'place_or_coordinates_missing' END AS reason
      FROM (SELECT 'artist-' || c_custkey AS id FROM customer UNION ALL SELECT 'band-' || s_suppkey FROM supplier) t LEFT JOIN loc l ON l.node_id = t.id WHERE t.id NOT IN (SELECT node_id FROM placed)) GROUP BY reason""",
    ("blocked",),
)
def unresolved(spark, d):
    claims = cut_lineage(_claims(spark, d))
    identities = _identities(spark, d)
    located = geography.location_claims(identities, claims)
    placed = geography.placements_from_claims(located, claims, _labels(spark, d))
    states = identities.selectExpr("node_id", "case when node_id like '%5' then 'identity_conflict' when node_id like '%6' then 'identity_unresolved' else 'resolved' end as state")
    rows = geography.unresolved(identities.select(F.col("node_id").alias("id")), states, located, placed)
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "join19_placement_precedence",
    """, u AS (SELECT *, 0 AS p FROM placements WHERE node_id LIKE '%1' UNION ALL SELECT * REPLACE ('backed' AS place_id), 1 FROM placements WHERE node_id NOT LIKE '%2' UNION ALL SELECT * REPLACE ('inferred' AS place_id), 2 FROM placements)
    SELECT node_id, role, place_id FROM (SELECT *, row_number() OVER (PARTITION BY node_id, role ORDER BY p, place_id) AS n FROM u WHERE node_id IN (SELECT id FROM entities WHERE NOT starter)) WHERE n = 1""",
    ("entities", "placements"),
)
def placement_precedence(spark, d):
    rows = views.placements(spark, d)
    backed = rows.where("node_id not like '%2'").withColumn("place_id", F.lit("backed"))
    inferred = rows.withColumn("place_id", F.lit("inferred"))
    known = _nodes(spark, d).where("not starter")
    return geography.precedence(rows.where("node_id like '%1'"), backed, inferred, known).select("node_id", "role", "place_id")


@query(
    "flt27_inferred_places",
    "SELECT id AS node_id, 'p-' || regexp_extract(zone, '([0-9]+)$', 1) AS place_id FROM entities WHERE node_type = 'band' AND len(sources) > 0",
    ("entities",),
)
def inferred_places(spark, d):
    aliases = views.table(spark, d, "nation").selectExpr("concat('p-', n_nationkey) as place_id", "n_name as alias")
    return geography.inferred_places(_nodes(spark, d), aliases)


@query(
    "join21_cross_place_relations",
    """SELECT t.id, a.place_id AS source_place, b.place_id AS target_place, a.role AS source_role, b.role AS target_role FROM tiered t JOIN placements a ON a.node_id = t.source JOIN placements b ON b.node_id = t.target
       WHERE tier = 'source_linked' AND a.place_id <> b.place_id""",
    ("entities", "relations", "tiered", "placements"),
)
def cross_place_relations(spark, d):
    return geography.cross_place_relations(_edges(spark, d), views.placements(spark, d)).drop("type")


@query(
    "join22_same_place",
    """, p AS (SELECT DISTINCT place_id, name, country, lat, lon FROM placements) SELECT a.place_id AS first, b.place_id AS second FROM p a JOIN p b ON a.place_id < b.place_id AND lower(trim(a.name)) = lower(trim(b.name)) AND lower(trim(a.country)) = lower(trim(b.country))
       AND abs(a.lat - b.lat) < 0.15
       AND (least(abs(a.lon - b.lon), abs(360 - abs(a.lon - b.lon))) < 0.15 OR (abs(a.lat) > 89.85 AND abs(b.lat) > 89.85))""",
    ("entities", "placements"),
)
def same_place(spark, d):
    return spatial.same_place_pairs(views.placements(spark, d))


@query(
    "join20_extend_atlas",
    """, en AS (SELECT *, CASE WHEN s_suppkey % 10 = 1 THEN 'Unknown ' || s_suppkey ELSE s_name END AS nm, 'b0000000-0000-4000-8000-' || lpad(CAST(CASE WHEN s_suppkey % 10 = 3 THEN s_suppkey + 500000 ELSE s_suppkey END AS VARCHAR), 12, '0') AS mb FROM supplier),
    m AS (SELECT *, CASE WHEN s_suppkey % 10 = 3 OR (s_suppkey % 10 = 1) THEN 'atlas:' || mb ELSE 'band-' || s_suppkey END AS node FROM en)
    SELECT 'node' AS part, node AS id FROM m WHERE node LIKE 'atlas:%' UNION ALL SELECT 'placement', node FROM m WHERE node NOT LIKE 'band-%2'""",
    ("entities",),
)
def extend_atlas(spark, d):
    entries = views.table(spark, d, "supplier").selectExpr(
        "cast(s_suppkey as string) as entry_id", "case when s_suppkey % 10 = 1 then concat('Unknown ', s_suppkey) else s_name end as label",
        "concat('b0000000-0000-4000-8000-', lpad(cast(case when s_suppkey % 10 = 3 then s_suppkey + 500000 else s_suppkey end as string), 12, '0')) as mbid",
        "'City' as city", "'Country' as country", "1D as lat", "2D as lon", "1990 as year",
    )
    placed = views.placements(spark, d).where("node_id like 'band-%2'")
    nodes, added = geography.extend_atlas(_nodes(spark, d), placed, entries)
    return nodes.select(F.lit("node").alias("part"), "id").unionByName(added.select(F.lit("placement").alias("part"), F.col("node_id").alias("id")))


@query(
    "join34_label_identities",
    """SELECT 'band-' || s_suppkey AS id, 'Q' || s_suppkey AS item FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey % 5 <> 0""",
)
def label_identities(spark, d):
    rows = views.table(spark, d, "supplier")
    unmatched = rows.selectExpr("concat('band-', s_suppkey) as id", "s_name as label", "'band' as node_type", "1 as name_count")
    pages = rows.selectExpr("s_name as title", "concat('Q', s_suppkey) as item", "upper(s_name) as item_label")
    classes = rows.selectExpr("concat('Q', s_suppkey) as item", "'P31' as class_relation", "case when s_suppkey % 3 = 0 then 'rock Band' else 'village' end as class_label")
    located = rows.where("s_suppkey % 5 <> 0").selectExpr("concat('Q', s_suppkey) as item")
    return geography.label_identities(unmatched, pages, classes, located)


@query(
    "join18_agreed_years",
    """SELECT 'year' AS part, 'artist-' || c AS id, CASE WHEN c % 10 = 0 THEN 1900 ELSE y END AS year FROM (SELECT o_custkey AS c, CAST(min(year(o_orderdate)) AS INTEGER) AS y FROM orders GROUP BY 1) WHERE (c % 3 <> 0 AND c % 4 <> 0) OR c % 10 = 0
       UNION ALL SELECT 'conflict', 'artist-' || o_custkey, NULL FROM orders WHERE o_custkey % 10 = 0 AND o_custkey % 3 <> 0 AND o_custkey % 4 <> 0 GROUP BY o_custkey""",
)
def agreed_years(spark, d):
    base = views.table(spark, d, "orders").groupBy("o_custkey").agg(F.expr("cast(min(year(o_orderdate)) as int) as year"))
    first = base.selectExpr("concat('artist-', o_custkey) as id", "1 as claims", "'candidate' as status", "year")
    second = base.selectExpr("concat('artist-', o_custkey) as id", "case when o_custkey % 4 = 0 then 'Person' else 'Group' end as type", "year + case when o_custkey % 3 = 0 then 1 else 0 end as year")
    manual = base.where("o_custkey % 10 = 0").selectExpr("concat('artist-', o_custkey) as id", "1900 as year")
    years, conflicts = geography.agreed_years(first, second, manual)
    return years.select(F.lit("year").alias("part"), "id", "year").unionByName(conflicts.select(F.lit("conflict").alias("part"), F.col("key").alias("id"), F.lit(None).cast("int").alias("year")))


def _dated_claims(spark, d):
    return views.table(spark, d, "orders").selectExpr(
        "concat('Q', o_custkey) as entity_id", "'P571' as property", "concat('s-', o_orderkey) as statement_id", "case when o_orderkey % 5 = 0 then 'deprecated' else 'normal' end as rank",
        "'value' as snaktype", "cast(null as string) as value_id", "case when o_orderkey % 7 = 0 then 'unknown' else concat('+', year(o_orderdate) - o_orderkey % 700, '-00-00T00:00:00Z') end as value_time",
        "array('https://a.example.org/x', 'https://www.wikidata.org/y', 'https://en.wikipedia.org/z', concat('https://b.example.org/', o_orderkey), 'https://c.example.org/q') as reference_urls",
    )


@query(
    "src10_11_statement_years",
    """SELECT 's-' || o_orderkey AS statement_id, CAST(year(o_orderdate) - o_orderkey % 700 AS INTEGER) AS year, 5 AS "references", 'https://a.example.org/x,https://b.example.org/' || o_orderkey AS external FROM orders
       WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND year(o_orderdate) - o_orderkey % 700 BETWEEN 1400 AND 2026""",
)
def statement_years(spark, d):
    years = geography.statement_years(_dated_claims(spark, d))
    return years.select("statement_id", "year", "references", F.array_join("external", ",").alias("external"))


@query(
    "agg27_year_status",
    """, y AS (SELECT o_custkey AS c, count(DISTINCT year(o_orderdate) - o_orderkey % 700) AS n FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND year(o_orderdate) - o_orderkey % 700 BETWEEN 1400 AND 2026 GROUP BY 1)
    SELECT status, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 6 = 0 THEN 'not-found' WHEN coalesce(n, 0) = 0 THEN 'no-claim' WHEN n > 1 THEN 'conflicting-years' ELSE 'candidate' END AS status FROM customer LEFT JOIN y ON c = c_custkey) GROUP BY status""",
    ("blocked",),
)
def year_status(spark, d):
    customer = views.table(spark, d, "customer")
    nodes = customer.selectExpr("concat('artist-', c_custkey) as id", "'artist' as node_type")
    found = customer.where("c_custkey % 6 <> 0").selectExpr("concat('artist-', c_custkey) as node_id", "concat('Q', c_custkey) as item")
    years = geography.statement_years(_dated_claims(spark, d))
    return geography.year_status(nodes, found, years).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "flt26_claim_leads",
    """SELECT 'band-' || s_suppkey AS entity_id, 'name-origin' AS category, 'The name ' || s_name || ' was taken from Old Part ' || (s_suppkey % 100) || '.' AS text FROM supplier WHERE s_suppkey % 2 = 0
       UNION ALL SELECT 'artist-' || c_custkey, 'birth-name', c_name || ' was born under the name ' || CASE WHEN c_custkey % 3 = 1 THEN 'Someone Else' END || '.' FROM customer WHERE c_custkey % 3 = 1""",
)
def claim_leads(spark, d):
    supplier, customer, part = (views.table(spark, d, n) for n in ("supplier", "customer", "part"))
    entities = supplier.selectExpr("concat('band-', s_suppkey) as entity_id", "concat('S', s_suppkey) as item", "s_name as label", "'band' as node_type").union(
        customer.selectExpr("concat('artist-', c_custkey)", "concat('C', c_custkey)", "c_name", "'artist'")
    )
    none = views.NO_STRINGS
    claims = supplier.where("s_suppkey % 2 = 0").selectExpr(
        "concat('S', s_suppkey) as entity_id", "'P138' as property", "concat('x', s_suppkey) as statement_id", "concat('P', s_suppkey % 100) as value_id", "cast(null as string) as value_text", f"{none} as reference_urls"
    ).union(customer.where("c_custkey % 3 < 2").selectExpr(
        "concat('C', c_custkey)", "'P1477'", "concat('y', c_custkey)", "cast(null as string)", "case when c_custkey % 3 = 1 then 'Someone Else' else concat('Dr ', upper(c_name)) end", none
    ))
    labels = part.selectExpr("concat('P', p_partkey) as entity_id", "concat('Old Part ', p_partkey) as en")
    return geography.claim_leads(entities, claims, labels).select("entity_id", "category", "text")


@query(
    "agg28_first_releases",
    """, r AS (SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders WHERE o_orderpriority <> '5-LOW' AND o_orderkey % 11 <> 0)
    SELECT 'artist-' || o_custkey AS person, count(*) AS releases, min(d || '|rel-' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0')) AS first FROM r GROUP BY o_custkey""",
    ("blocked",),
)
def first_releases(spark, d):
    releases = views.table(spark, d, "orders").selectExpr(
        "concat('artist-', o_custkey) as person", "concat('rel-', lpad(cast(o_orderkey as string), 9, '0')) as release_id", "'t' as title",
        "case when o_orderkey % 11 = 0 then '' else date_format(o_orderdate, 'yyyy-MM-dd') end as date",
        f"case when o_orderpriority = '5-LOW' then array('Live') else {views.NO_STRINGS} end as secondary_types",
    )
    return geography.first_releases(releases).select("person", "releases", F.concat_ws("|", "date", "release_id").alias("first"))


@query(
    "agg29_half_century_pool",
    """, p AS (SELECT 'per-' || o_orderkey AS person_id, 'Customer#' || lpad(CAST(o_orderkey % 4000 AS VARCHAR), 9, '0') AS name, 1600 + o_orderkey % 400 AS y, o_custkey AS links FROM orders),
    b AS (SELECT *, least(y, 1949) // 50 * 50 AS bin FROM p WHERE y BETWEEN 1600 AND 1950)
    SELECT bin, person_id, name FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY links DESC, person_id) AS n FROM b) WHERE n <= 70 AND lower(name) NOT IN (SELECT lower(c_name) FROM customer)""",
    ("blocked",),
)
def half_century_pool(spark, d):
    people = views.table(spark, d, "orders").selectExpr(
        "concat('per-', o_orderkey) as person_id", "concat('Customer#', lpad(cast(o_orderkey % 4000 as string), 9, '0')) as name", "1600 + o_orderkey % 400 as start_year", "o_custkey as sitelinks"
    )
    known = views.table(spark, d, "customer").selectExpr("c_name as label")
    return geography.half_century_pool(people, known)


@query(
    "flt35_genre_edges",
    """, g AS (SELECT DISTINCT o_custkey AS c, o_orderkey % 12 AS k FROM orders),
    z AS (SELECT c, min(k) AS k FROM g GROUP BY c) SELECT 'node' AS part, 'artist-' || c_custkey AS id, CASE WHEN k IS NULL THEN 'classical-history' WHEN k < 3 THEN 'jazz' ELSE 'pop-soul-disco' END AS zone FROM customer LEFT JOIN z ON c = c_custkey WHERE c_custkey IN (SELECT o_custkey FROM orders)
    UNION ALL SELECT 'edge', 'early-artist-' || c || '-genre-' || k, 'artist-' || c FROM g""",
    ("blocked",),
)
def genre_edges(spark, d):
    artists = views.table(spark, d, "orders").groupBy("o_custkey").agg(F.expr("collect_set(concat('G', o_orderkey % 12)) as genre_ids")).selectExpr(
        "concat('artist-', o_custkey) as id", "genre_ids", "size(genre_ids) as references"
    )
    genres = views.table(spark, d, "nation").selectExpr(
        "concat('G', n_nationkey) as genre_id", "concat('genre-', n_nationkey) as node_id", "n_name as label", "case when n_nationkey < 3 then 'jazz' else 'pop-soul-disco' end as zone", "n_nationkey as precedence"
    )
    placed, edges = geography.genre_edges(artists, genres)
    return placed.select(F.lit("node").alias("part"), "id", "zone").unionByName(edges.select(F.lit("edge").alias("part"), F.col("edge_id").alias("id"), F.col("source").alias("zone")))


# --- layouts --------------------------------------------------------------------------------------------------

_BOX_SQL = """, lay AS (SELECT p.mode, p.id, p.x, p.y, e.zone, e.node_type, least(greatest(length(e.label) * 16 + 32, 120), 540) AS w FROM positions p JOIN entities e ON e.id = p.id),
  ov AS (SELECT a.mode, a.id AS a, b.id AS b, a.zone AS az, b.zone AS bz, least(a.x + a.w / 2.0, b.x + b.w / 2.0) - greatest(a.x - a.w / 2.0, b.x - b.w / 2.0) AS ox, 88 - abs(a.y - b.y) AS oy
    FROM lay a JOIN lay b ON a.mode = b.mode AND a.id < b.id AND abs(a.y - b.y) < 88 AND abs(a.x - b.x) < 540 WHERE least(a.x + a.w / 2.0, b.x + b.w / 2.0) > greatest(a.x - a.w / 2.0, b.x - b.w / 2.0))"""
_LEN_SQL = """, len AS (SELECT t.id, t.source, t.target, a.mode, a.zone AS sz, b.zone AS tz, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS l FROM tiered t JOIN lay a ON a.id = t.source JOIN lay b ON b.id = t.target AND b.mode = a.mode WHERE t.tier <> 'research_lead')"""
_LAYOUT_VIEWS = ("entities", "relations", "tiered", "positions")


def _layout(spark, d, mode):
    nodes = _nodes(spark, d).select("id", "label", "node_type", "zone")
    at = views.positions(spark, d).where(F.col("mode") == mode).select(F.col("id").alias("_id"), "x", "y")
    return nodes.join(at, F.col("id") == F.col("_id")).drop("_id")


@query("join12_label_overlaps", _BOX_SQL + " SELECT a, b, ox AS over_x, oy AS over_y, ox > 28 AND oy > 16 AS severe FROM ov WHERE mode = 'before'", ("entities", "positions"))
def label_overlaps(spark, d):
    return spatial.label_overlaps(_layout(spark, d, "before")).select("a", "b", "over_x", "over_y", "severe")


@query(
    "join12_reference_window",
    _BOX_SQL + """ SELECT count(*) AS pairs FROM ov JOIN lay p ON p.id = a AND p.mode = ov.mode JOIN lay q ON q.id = b AND q.mode = ov.mode WHERE ov.mode = 'before' AND abs(floor(p.x / 240) - floor(q.x / 240)) <= 2 AND abs(floor(p.y / 240) - floor(q.y / 240)) <= 1""",
    ("entities", "positions"),
)
def reference_window(spark, d):
    return spatial.label_overlaps(_layout(spark, d, "before"), reference_window=True).agg(F.count(F.lit(1)).alias("pairs"))


@query(
    "join10_proximity_pairs",
    """, r AS (SELECT id, x, y, zone, CASE node_type WHEN 'genre' THEN 104 WHEN 'artist' THEN 68 ELSE 82 END AS r FROM entities),
    p AS (SELECT a.id AS a, b.id AS b, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d, (a.r + b.r) * CASE WHEN a.zone = b.zone THEN 0.72::DOUBLE ELSE 0.5::DOUBLE END AS t FROM r a JOIN r b ON a.id < b.id AND abs(a.x - b.x) <= 150 AND abs(a.y - b.y) <= 150)
    SELECT a, b, CAST(round(d) AS BIGINT) AS distance, round((t - d) / t, 3) AS severity FROM p WHERE d < t""",
    ("entities",),
)
def proximity_pairs(spark, d):
    return spatial.proximity_pairs(_nodes(spark, d)).select("a", "b", "distance", "severity")


def _metric_sql(mode: str, zone: str | None) -> str:
    both = "" if zone is None else f" AND (az = '{zone}' OR bz = '{zone}')"
    ends = "" if zone is None else f" AND (sz = '{zone}' OR tz = '{zone}')"
    own = "" if zone is None else f" AND c.zone = '{zone}'"
    return f"""SELECT '{mode}' AS mode, nodes, edges, "overlaps", severe, CAST(round(me) AS BIGINT) AS mean_edge, long_edges, CAST(round(md) AS BIGINT) AS mean_drift,
      round("overlaps" * 8 + severe * 14 + me * greatest(1.0::DOUBLE, edges / greatest(1, nodes)) * 0.025::DOUBLE + long_edges * 2 + md * 0.035::DOUBLE, 1) AS score FROM
      (SELECT count(*) AS "overlaps", count(*) FILTER (ox > 28 AND oy > 16) AS severe FROM ov WHERE mode = '{mode}'{both}),
      (SELECT count(*) AS edges, coalesce(avg(l), 0) AS me, count(*) FILTER (l > 1800) AS long_edges FROM len WHERE mode = '{mode}'{ends}),
      (SELECT count(*) AS nodes, avg(sqrt((c.x - o.x) ** 2 + (c.y - o.y) ** 2)) AS md FROM lay c JOIN lay o ON o.id = c.id AND o.mode = 'before' WHERE c.mode = '{mode}'{own})"""


def _metrics(spark, d, mode, scope=None):
    before = _layout(spark, d, "before")
    layout = before if mode == "before" else _layout(spark, d, mode)
    return spatial.layout_metrics(layout, _edges(spark, d), before, scope).withColumn("mode", F.lit(mode))


@query("agg14_layout_metrics", _BOX_SQL + _LEN_SQL + " " + _metric_sql("after", None), _LAYOUT_VIEWS)
def layout_metrics(spark, d):
    return _metrics(spark, d, "after")


@query("agg14_zone_metrics", _BOX_SQL + _LEN_SQL + " " + _metric_sql("after", "nation-3"), _LAYOUT_VIEWS)
def zone_metrics(spark, d):
    return _metrics(spark, d, "after", "nation-3")


@query(
    "agg18_outcome",
    _BOX_SQL + _LEN_SQL + f""", mb AS ({_metric_sql('before', 'nation-3')}), ma AS ({_metric_sql('after', 'nation-3')})
    SELECT CASE WHEN ma.severe > mb.severe OR ma."overlaps" > mb."overlaps" OR ma.mean_edge > greatest(mb.mean_edge * 1.15, mb.mean_edge + 100) THEN 'regression' WHEN ma.score < mb.score - 0.1 THEN 'improved' ELSE 'unchanged' END AS outcome FROM ma, mb""",
    _LAYOUT_VIEWS,
)
def outcome(spark, d):
    from evigraph.session import attach_row

    before = _metrics(spark, d, "before", "nation-3").select(F.struct("*").alias("before"))
    after = _metrics(spark, d, "after", "nation-3").select(F.struct("*").alias("after"))
    return attach_row(before, after).select(spatial.outcome().alias("outcome"))


@query(
    "agg15_focused_legibility",
    _BOX_SQL + """, f AS (SELECT id FROM entities WHERE starter), e AS (SELECT a || '|' || b AS p, ox > 28 AND oy > 16 AS s, unnest([a, b]) AS id FROM ov WHERE mode = 'before')
    SELECT count(DISTINCT p) AS overlap_pairs, count(DISTINCT id) AS overlapping_nodes, count(DISTINCT id) FILTER (s) AS severely_overlapping_nodes FROM e WHERE id IN (SELECT id FROM f)""",
    ("entities", "positions"),
)
def focused_legibility(spark, d):
    return spatial.focused_legibility(_layout(spark, d, "before"), _nodes(spark, d).where("starter"))


@query(
    "agg16_focused_connections",
    _BOX_SQL + _LEN_SQL + """, f AS (SELECT id FROM entities WHERE starter), h AS (SELECT * FROM len WHERE mode = 'before' AND (source IN (SELECT id FROM f) OR target IN (SELECT id FROM f)))
    SELECT count(*) AS edges, CAST(round(avg(l)) AS BIGINT) AS mean, CAST(round(coalesce(max(l) FILTER (sz = tz), 0)) AS BIGINT) AS longest_same_zone, CAST(round(coalesce(max(l) FILTER (sz <> tz), 0)) AS BIGINT) AS longest_cross_zone FROM h""",
    _LAYOUT_VIEWS,
)
def focused_connections(spark, d):
    return spatial.focused_connections(_edges(spark, d), _layout(spark, d, "before"), _nodes(spark, d).where("starter"))


@query(
    "val15_metric_mismatches",
    _BOX_SQL + _LEN_SQL + f""", m AS ({_metric_sql('after', 'nation-3')}) SELECT 'metric_differs' AS rule, 'overlaps' AS key, CAST("overlaps" AS VARCHAR) AS detail FROM m""",
    _LAYOUT_VIEWS,
)
def metric_mismatches(spark, d):
    from evigraph.operators.validate import metric_mismatches as check

    row = _metrics(spark, d, "after", "nation-3")
    long = cut_lineage(row.select(F.expr("stack(3, 'overlaps', overlaps, 'severe', severe, 'edges', edges) as (metric, value)")))
    claimed = long.withColumn("value", F.expr("case when metric = 'overlaps' then value + 1 else value end"))
    return check(claimed, long)


@query(
    "win14_growth_hints",
    """, fr AS (SELECT id FROM entities WHERE id LIKE '%7'), u AS (SELECT id, source, target, coalesce(strength, 0) AS s FROM tiered WHERE type = 'member_of' AND tier = 'source_linked'),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY s DESC, id) AS n FROM u) WHERE n = 1),
    c AS (SELECT id, list_filter([source, target], lambda v: v LIKE '%7') AS ends, row_number() OVER (ORDER BY s DESC, id) AS n FROM b WHERE source IN (SELECT id FROM fr) OR target IN (SELECT id FROM fr)),
    g AS (SELECT list_reduce(list({'id': id, 'ends': ends, 'used': CAST([] AS VARCHAR[]), 'taken': CAST([] AS VARCHAR[])} ORDER BY n),
      lambda a, x: CASE WHEN len(list_filter(x.ends, lambda v: len(list_filter(a.used, lambda w: w = v)) >= 2)) = 0
        THEN {'id': '', 'ends': x.ends, 'used': list_concat(a.used, x.ends), 'taken': list_append(a.taken, x.id)} ELSE a END,
      {'id': '', 'ends': CAST([] AS VARCHAR[]), 'used': CAST([] AS VARCHAR[]), 'taken': CAST([] AS VARCHAR[])}).taken AS taken FROM c)
    SELECT 'growth-' || unnest(taken) AS id FROM g""",
    ("entities", "relations", "tiered"),
)
def growth_hints(spark, d):
    nodes = _nodes(spark, d)
    return spatial.growth_hints(_edges(spark, d), nodes, nodes.where("id like '%7'")).select("id")


@query(
    "win08_undated_slots",
    """SELECT id, 100.0 + ((n - 1) % 7 + 0.5) * 50.0 AS x, 200.0 + ((n - 1) // 7) * 126.0 AS y FROM (SELECT id, row_number() OVER (ORDER BY zone, icu_sort_key(lower(strip_accents(label)), 'en'), id) AS n FROM entities WHERE era_start IS NULL)""",
    ("entities",),
)
def undated_slots(spark, d):
    nodes = cut_lineage(_nodes(spark, d).where("era_start is null").select("id", "zone", "label"))
    return spatial.undated_slots(nodes, 100.0, 200.0, 7, 50.0, 126.0).select("id", "x", "y")


@query(
    "win08_alphabetic_grid",
    """SELECT id, round(-2260 + ((n - 1) % 16) * (6560 / 15.0::DOUBLE), 4) AS x, CAST(-1220 + ((n - 1) // 16) * 112 + ord(lower(label)) % 7 * 4 AS DOUBLE) AS y FROM (SELECT id, label, row_number() OVER (ORDER BY icu_sort_key(lower(strip_accents(label)), 'en'), id) AS n FROM entities)""",
    ("entities",),
)
def alphabetic_grid(spark, d):
    return spatial.alphabetic_grid(_nodes(spark, d).select("id", "label")).select("id", F.round("x", 4).alias("x"), "y")


@query(
    "win09_timeline_x",
    """, s AS (SELECT id, era_start - CAST(length(label) AS INTEGER) * 10 AS y FROM entities WHERE era_start IS NOT NULL), m AS (SELECT CAST(d AS BIGINT) AS d, CASE WHEN d < 1900 THEN 140 WHEN d < 1920 THEN 260 WHEN d < 1950 THEN 500 ELSE 640 END AS w FROM range(1600, 2031, 10) t(d)),
    p AS (SELECT d, w, -4800 + coalesce(sum(w) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x FROM m)
    SELECT id, y AS start_year, d AS decade, CAST(x + greatest(18.0::DOUBLE, (y - d) * w / 10.0) AS DOUBLE) AS x FROM s JOIN p ON d = y // 10 * 10""",
    ("entities",),
)
def timeline_x(spark, d):
    nodes = _nodes(spark, d).selectExpr("id", "era_start - length(label) * 10 as start_year")
    return spatial.timeline_x(nodes)


def _trials(spark, d):
    return views.table(spark, d, "events").selectExpr(
        "event_id", "case when user_id % 2 = 0 then 'organized' else 'timeline' end as mode", "concat('nation-', user_id % 5) as zone", "concat('p', event_id % 4) as parameters",
        "case when event_type in ('view', 'click', 'purchase', 'signup') then 'safe' else event_type end as reason", "cast(event_id % 3 as int) as hint_count",
        "event_id div 8 as sample", "cast(value as int) as severe", "case when event_type = 'purchase' then 'win' when event_type = 'signup' and value > 97 and event_id % 4 = 1 then 'regression' else 'none' end as outcome",
    )


@query(
    "agg20_trial_history",
    """SELECT CASE WHEN user_id % 2 = 0 THEN 'organized' ELSE 'timeline' END AS mode, 'nation-' || (user_id % 5) AS zone, 'p' || (event_id % 4) AS parameters, event_id % 3 > 0 AS hinted, count(*) AS samples, count(*) FILTER (event_type <> 'error') AS safe,
       round((count(*) FILTER (event_type <> 'error') + 1) / (count(*) + 2), 6) AS rate FROM events GROUP BY 1, 2, 3, 4""",
)
def trial_history(spark, d):
    return trials.trial_history(_trials(spark, d)).withColumn("rate", F.round("rate", 6))


@query(
    "agg33_choose_parameters",
    """, t AS (SELECT event_id // 8 AS sample, CASE WHEN user_id % 2 = 0 THEN 'organized' ELSE 'timeline' END AS mode, 'nation-' || (user_id % 5) AS zone, 'p' || (event_id % 4) AS parameters, event_type <> 'error' AS ok, CAST(trunc(value) AS INTEGER) AS severe,
        CASE WHEN event_type = 'purchase' THEN 'win' WHEN event_type = 'signup' AND value > 97 AND event_id % 4 = 1 THEN 'regression' ELSE 'none' END AS outcome FROM events),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample, mode, zone, parameters ORDER BY ok DESC, severe, outcome) AS n FROM t) WHERE n = 1),
    c AS (SELECT mode, zone, parameters, count(*) FILTER (ok) AS safe, count(*) FILTER (ok AND outcome = 'win') AS wins, count(*) FILTER (ok AND outcome = 'regression') AS reg FROM b GROUP BY 1, 2, 3)
    SELECT mode, zone, parameters, safe, wins FROM (SELECT *, row_number() OVER (PARTITION BY mode, zone ORDER BY wins DESC, safe DESC, parameters) AS n FROM c WHERE safe >= 3 AND wins >= 2 AND reg <= 0) WHERE n = 1""",
    ("blocked",),
)
def choose_parameters(spark, d):
    rows = _trials(spark, d)
    samples = rows.select("zone").distinct().withColumn("samples", F.lit(4))
    return trials.choose_parameters(rows, samples)


@query(
    "agg32_comparison_summary",
    """SELECT 'quantity' AS metric, sum(l_quantity) AS before, sum(l_linenumber * 10.0::DOUBLE) AS after, count(*) FILTER (l_linenumber * 10 < l_quantity) AS improved, count(*) FILTER (l_linenumber * 10 > l_quantity) AS regressed FROM lineitem
       UNION ALL SELECT 'part', CAST(sum(l_partkey) AS DOUBLE), CAST(sum(l_suppkey) AS DOUBLE), count(*) FILTER (l_suppkey < l_partkey), count(*) FILTER (l_suppkey > l_partkey) FROM lineitem""",
)
def comparison_summary(spark, d):
    rows = views.table(spark, d, "lineitem").selectExpr(
        "l_quantity as before_quantity", "l_linenumber * 10D as after_quantity", "cast(l_partkey as double) as before_part", "cast(l_suppkey as double) as after_part"
    )
    return trials.comparison_summary(rows, ["quantity", "part"])


@query(
    "win06_practice_split",
    """, so AS (SELECT source, target FROM tiered WHERE tier = 'source_linked' AND source IN (SELECT id FROM entities) AND target IN (SELECT id FROM entities)), u AS (SELECT id, zone FROM entities WHERE id IN (SELECT source FROM so UNION ALL SELECT target FROM so)),
    z AS (SELECT zone FROM u GROUP BY zone HAVING count(*) >= 8 ORDER BY count(*) DESC, zone LIMIT 12)
    SELECT id, zone, CASE WHEN n <= 4 THEN 'train' WHEN n <= 6 THEN 'validation' ELSE 'test' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY sha256('layout-practice-v1:' || id), id) AS n FROM u WHERE zone IN (SELECT zone FROM z)) WHERE n <= 8""",
    ("entities", "relations", "tiered"),
)
def practice_split(spark, d):
    return trials.practice_split(_nodes(spark, d), _edges(spark, d))


@query(
    "win06_hash_positions",
    "SELECT id, zone, row_number() OVER (PARTITION BY zone ORDER BY sha256('layout-practice-v1:' || id), id) AS position FROM entities",
    ("entities",),
)
def hash_positions(spark, d):
    return trials.split_all(_nodes(spark, d))


_TERMS = (("rock-circuit", "by the"), ("rock-circuit", "of"), ("jazz", "the"), ("jazz", "de la"), ("folk-country-vise", "und"), ("folk-country-vise", "with by and"), ("punk-alt", "que"))


def _zone_terms(spark, d):
    """Fixed terms, and a learned word or phrase of each nation's zone that texts hold, some with weights past either clamp."""
    fixed = " union all ".join(f"select '{z}' as zone, '{t}' as term, cast(null as double) as weight" for z, t in _TERMS)
    learned = views.table(spark, d, "nation").selectExpr("concat('nation-', n_nationkey) as zone", "element_at(array('the', 'on the', 'und', 'er und', 'de la'), n_nationkey % 5 + 1) as term", "cast(n_nationkey as double) as weight")
    return spark.sql(fixed).union(learned)


_ZS_SQL = r""", tx AS (SELECT doc_id AS id, trim(regexp_replace(strip_accents(lower(text)), '[^\p{L}\p{N}]+', ' ', 'g')) AS t, CASE WHEN doc_id % 2 = 0 THEN 'jazz' ELSE '' END AS zone FROM documents),
  tm AS (SELECT * FROM (VALUES """ + ", ".join(f"('{z}', '{t}')" for z, t in _TERMS) + r""") v(zone, term)),
  sc AS (SELECT id, zone, sum(s) AS score FROM (SELECT tx.id, tm.zone, greatest(2, len(string_split(term, ' ')) + 1) AS s FROM tx JOIN tm ON CASE WHEN contains(term, ' ') THEN contains(t, term) ELSE contains(' ' || t || ' ', ' ' || term || ' ') END
    UNION ALL SELECT tx.id, 'nation-' || n_nationkey, least(6.0, greatest(0.5, n_nationkey * 0.35)) FROM tx JOIN (SELECT n_nationkey, ['the', 'on the', 'und', 'er und', 'de la'][n_nationkey % 5 + 1] AS term FROM nation)
      ON CASE WHEN contains(term, ' ') THEN contains(t, term) ELSE contains(' ' || t || ' ', ' ' || term || ' ') END
    UNION ALL SELECT id, zone, 1 FROM tx WHERE zone <> '') GROUP BY id, zone)"""


def _zone_scores(spark, d):
    from evigraph.functions.text import fold_text

    texts = views.table(spark, d, "documents").select(F.col("doc_id").alias("id"), fold_text("text").alias("text"), F.expr("case when doc_id % 2 = 0 then 'jazz' else '' end as zone"))
    return trials.zone_scores(texts, _zone_terms(spark, d))


@query("join25_zone_scores", _ZS_SQL + " SELECT id, zone, CAST(score AS DOUBLE) AS score FROM sc", ("blocked",))
def zone_scores(spark, d):
    return _zone_scores(spark, d)


@query(
    "join25_best_zones",
    _ZS_SQL + """, rk AS (SELECT * FROM (VALUES ('rock-circuit', 0), ('punk-alt', 1), ('jazz', 2), ('folk-country-vise', 3)) v(zone, r)),
    b AS (SELECT * FROM (SELECT sc.*, row_number() OVER (PARTITION BY id ORDER BY score DESC, r) AS n FROM sc JOIN rk ON rk.zone = sc.zone) WHERE n = 1),
    f AS (SELECT doc_id AS id, CASE WHEN doc_id % 13 = 0 THEN 'guitar-workshop' WHEN doc_id % 17 = 0 THEN 'jazz' WHEN doc_id % 23 = 0 THEN 'punk-alt' END AS fixed FROM documents)
    SELECT f.id, coalesce(fixed, b.zone, 'rock-circuit') AS zone, CASE WHEN fixed IS NULL THEN CAST(score AS DOUBLE) END AS score FROM f LEFT JOIN b ON b.id = f.id""",
    ("blocked",),
)
def best_zones(spark, d):
    ranks = spark.sql("select * from values ('rock-circuit', 0), ('punk-alt', 1), ('jazz', 2), ('folk-country-vise', 3) as v(zone, zone_rank)")
    nodes = views.table(spark, d, "documents").selectExpr(
        "doc_id as id", "case when doc_id % 13 = 0 then 'guitar' else 'artist' end as node_type",
        "case when doc_id % 17 = 0 then 'jazz' when doc_id % 19 = 0 then 'nowhere' end as preferred_zone", "case when doc_id % 23 = 0 then 'punk-alt' end as learned_zone",
    )
    return trials.best_zones(nodes, _zone_scores(spark, d), ranks)


@query(
    "top11_top_tags",
    """, s AS (SELECT 'artist-' || o_custkey AS id, 'tag-' || (l_partkey % 30) AS tag, count(*) AS score FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2),
    f AS (SELECT 'artist-' || c_custkey AS id, 'nation-' || ((c_custkey + i) % 3) AS tag, i AS rank FROM customer, range(3) t(i)), u AS (SELECT id, tag, 0 AS p, score, 0 AS r FROM s UNION ALL SELECT id, tag, 1, 0, rank FROM f)
    SELECT id, tag, rank FROM (SELECT id, tag, row_number() OVER (PARTITION BY id ORDER BY p, score DESC, r, tag) AS rank FROM u) WHERE rank <= 3""",
    ("blocked",),
)
def top_tags(spark, d):
    orders = views.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    scores = views.table(spark, d, "lineitem").join(orders, F.expr("l_orderkey = o_orderkey")).selectExpr(
        "concat('artist-', o_custkey) as id", "concat('tag-', l_partkey % 30) as tag", "1D as score"
    )
    fallback = views.table(spark, d, "customer").selectExpr("c_custkey", "explode(sequence(0, 2)) as rank").selectExpr(
        "concat('artist-', c_custkey) as id", "concat('nation-', (c_custkey + rank) % 3) as tag", "rank"
    )
    return trials.top_tags(scores, fallback).select("id", "tag", F.col("rank").cast("bigint").alias("rank"))


@query(
    "agg21_zone_term_weights",
    """, v AS (SELECT id, zone, trim(regexp_replace(lower(unnest(list_concat([id, label, node_type], roles, metadata, aliases))), '[^a-z0-9]+', ' ', 'g')) AS t FROM entities),
    w AS (SELECT DISTINCT id, zone, t AS term FROM v WHERE t <> '' UNION SELECT id, zone, unnest(string_split(t, ' ')) FROM v WHERE t <> ''),
    k AS (SELECT w.* FROM w WHERE EXISTS (SELECT 1 FROM v WHERE v.id = w.id AND v.t = w.term) OR length(term) > 2),
    stop AS (SELECT unnest([""" + ", ".join(f"'{w}'" for w in trials.STOP_WORDS) + """]) AS s),
    g AS (SELECT zone, term, CAST(sum(wt) AS DOUBLE) AS weight FROM (SELECT zone, term, 1.0 AS wt FROM k UNION ALL SELECT 'nation-' || n_nationkey, lower(n_name), 8.0 FROM nation) WHERE term <> '' AND term NOT IN (SELECT s FROM stop) GROUP BY 1, 2)
    SELECT zone, term, weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY weight DESC, term) AS rank FROM g) WHERE rank <= 80""",
    ("entities",),
)
def zone_term_weights(spark, d):
    extra = views.table(spark, d, "nation").selectExpr("concat('nation-', n_nationkey) as zone", "lower(n_name) as term", "8D as weight")
    weights = trials.zone_term_weights(trials.term_seeds(_nodes(spark, d)), extra, 80)
    return weights.select("zone", "term", "weight", F.col("rank").cast("bigint").alias("rank"))


@query(
    "agg22_learned_nodes",
    """SELECT id, CASE WHEN id LIKE '%1' THEN 'feedback' WHEN id LIKE '%2' THEN 'note' ELSE zone END AS zone, round(least(1.0, length(label) % 5 * 0.22 + length(id) % 3 * 0.08 + CASE WHEN starter THEN 0.1 ELSE 0 END)::DOUBLE, 3) AS bridge_score,
       round(least(1.0::DOUBLE, length(label) / 12), 3) AS hub_score, CAST(list_min(ys) AS INTEGER) AS era_start, CAST(list_sort(ys)[len(ys) // 2 + 1] AS INTEGER) AS era_peak
       FROM (SELECT *, list_filter([era_start, CASE WHEN length(id) % 2 = 0 THEN 1980 END, CASE WHEN length(id) % 3 = 0 THEN 1960 END], lambda v: v IS NOT NULL) AS ys FROM entities)""",
    ("entities",),
)
def learned_nodes(spark, d):
    profile = _nodes(spark, d).selectExpr(
        "id", "zone as graph_zone", "case when id like '%2' then 'note' end as note_zone", "case when id like '%1' then 'feedback' else '' end as feedback_zone",
        "length(label) % 5 as zones", "length(id) % 3 as genres", "length(label) as degree", "case when starter then 0.1D else 0D end as bridge_boost", "0D as hub_boost",
        "array_compact(array(era_start, case when length(id) % 2 = 0 then 1980 end, case when length(id) % 3 = 0 then 1960 end)) as years",
    )
    return trials.learned_nodes(profile)


_LEARNED_SQL = """, l AS (SELECT *, CASE WHEN id LIKE '%1' THEN 'moved-zone' ELSE zone END AS primary_zone, CASE WHEN id LIKE '%2' THEN ['Blues Rock', 'the'] ELSE [] END AS genres,
      CASE WHEN id LIKE '%3' THEN ['Garage', 'garage!'] ELSE [] END AS tags, CASE WHEN id LIKE '%4' THEN 'Hot Act' END AS feedback FROM entities),
    fold AS (SELECT id, primary_zone, zone, genres, trim(regexp_replace(lower(unnest(list_concat([id, label, node_type], roles, metadata, aliases, genres, tags))), '[^a-z0-9]+', ' ', 'g')) AS t FROM l),
    stop AS (SELECT unnest([""" + ", ".join(f"'{w}'" for w in trials.STOP_WORDS) + """]) AS s),
    seeds AS (SELECT DISTINCT id, primary_zone, zone, genres, t FROM fold WHERE t <> ''
      UNION SELECT id, primary_zone, zone, genres, w FROM (SELECT *, unnest(string_split(t, ' ')) AS w FROM fold) WHERE length(w) > 2 AND w NOT IN (SELECT s FROM stop)),
    parts AS (SELECT primary_zone AS zone, t AS term, CASE WHEN primary_zone <> zone THEN 3 ELSE 1 END + CASE WHEN len(genres) > 0 THEN 1 ELSE 0 END AS weight FROM seeds
      UNION ALL SELECT primary_zone, unnest(list_concat(genres, tags, CASE WHEN feedback IS NULL THEN [] ELSE [feedback] END)), 4 FROM l
      UNION ALL SELECT 'nation-' || n_nationkey, n_name, 8 FROM nation UNION ALL SELECT 'nation-' || n_nationkey, 'nation-' || ((n_nationkey + 1) % 25), 3 FROM nation
      UNION ALL SELECT 'nation-' || n_nationkey, 'see ' || n_name, 3 FROM nation
      UNION ALL SELECT 'nation-' || a.n_nationkey, 'nation-' || b.n_nationkey, 4 FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey
      UNION ALL SELECT 'nation-' || n_nationkey, unnest(['artist-' || n_regionkey, 'band-' || n_regionkey]), 6 FROM nation
      UNION ALL SELECT 'nation-' || n_nationkey, 'cat ' || n_regionkey, 3 FROM nation UNION ALL SELECT 'nation-' || n_nationkey, 'policy ' || n_regionkey, 3 FROM nation),
    g AS (SELECT zone, term, CAST(sum(weight) AS DOUBLE) AS weight FROM (SELECT zone, trim(regexp_replace(lower(term), '[^a-z0-9]+', ' ', 'g')) AS term, weight FROM parts) WHERE term <> '' AND term NOT IN (SELECT s FROM stop) GROUP BY ALL)
    SELECT zone, term, weight, row_number() OVER (PARTITION BY zone ORDER BY weight DESC, term COLLATE en) AS rank FROM g"""


@query("agg21_learned_terms", _LEARNED_SQL, ("entities",))
def learned_terms(spark, d):
    """Every term of every zone: nodes by their learned zone, tags and genres, curators' words on zones, and bridge policies."""
    nodes = _nodes(spark, d)
    learned = nodes.selectExpr(
        "id", "if(id like '%1', 'moved-zone', zone) as zone", f"if(id like '%2', array('Blues Rock', 'the'), {views.NO_STRINGS}) as primary_genres",
        f"if(id like '%3', array('Garage', 'garage!'), {views.NO_STRINGS}) as curator_tags", "if(id like '%4', 'Hot Act', null) as feedback",
    )
    nation = views.table(spark, d, "nation")
    feedback = nation.selectExpr("concat('nation-', n_nationkey) as zone", "array(n_name) as terms", "array(concat('nation-', (n_nationkey + 1) % 25)) as bridge_to_zones", "concat('see ', n_name) as feedback")
    policies = nation.groupBy("n_regionkey").agg(F.collect_list(F.concat(F.lit("nation-"), "n_nationkey")).alias("zones")).selectExpr(
        "zones", "array(concat('artist-', n_regionkey), concat('band-', n_regionkey)) as anchor_nodes", "array(concat('cat ', n_regionkey)) as categories", "concat('policy ', n_regionkey) as feedback",
    )
    return trials.learned_terms(nodes, learned, feedback, policies)


@query(
    "agg22_secondary_zones",
    """, z AS (SELECT id, list_distinct(list(o ORDER BY o)) AS linked FROM (
      SELECT r.source AS id, e.zone AS o FROM relations r JOIN entities e ON e.id = r.target UNION SELECT r.target, e.zone FROM relations r JOIN entities e ON e.id = r.source) GROUP BY 1),
    p AS (SELECT e.id, CASE WHEN e.id LIKE '%1' THEN 'feedback' ELSE e.zone END AS zone, length(e.id) % 3 AS genres, era_start,
      list_concat(CASE WHEN e.id LIKE '%5' THEN ['extra', e.zone] ELSE [] END, CASE WHEN e.id LIKE '%3' THEN ['noted', ''] ELSE [] END, list_sort(coalesce(linked, []))) AS raw, len(CASE WHEN e.id LIKE '%5' THEN ['extra', e.zone] ELSE [] END) + len(CASE WHEN e.id LIKE '%3' THEN [1, 2] ELSE [] END) AS own
      FROM entities e LEFT JOIN z ON z.id = e.id),
    s AS (SELECT id, zone, genres, era_start, list_filter(raw, lambda v, i: v <> '' AND list_position(raw, v) = i AND (i <= own OR v <> zone)) AS secondary FROM p)
    SELECT id, zone, array_to_string(secondary, '|') AS secondary_zones, round(least(1.0, len(secondary) * 0.22 + genres * 0.08)::DOUBLE, 3) AS bridge_score,
      CAST(CASE WHEN id LIKE '%7' THEN 1955 ELSE era_start END AS INTEGER) AS era_start FROM s""",
    ("entities", "relations"),
)
def secondary_zones(spark, d):
    """Secondary zones from feedback, notes and linked nodes, the bridge score they give, and a start year that feedback states."""
    nodes = _nodes(spark, d)
    ends = graph.zones_of_neighbours(graph.end_kinds(_edges(spark, d).select("source", "target"), nodes)).groupBy("id").agg(F.array_sort(F.collect_set("zone")).alias("linked_zones"))
    profile = nodes.join(ends.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left").selectExpr(
        "id", "zone as graph_zone", "cast(null as string) as note_zone", "if(id like '%1', 'feedback', '') as feedback_zone", "length(id) % 3 as genres", "0 as degree", "0D as bridge_boost", "0D as hub_boost",
        "array_compact(array(era_start)) as years", "if(id like '%7', 1955, null) as known_start", "cast(null as int) as known_peak",
        f"if(id like '%5', array('extra', zone), {views.NO_STRINGS}) as feedback_zones", f"if(id like '%3', array('noted', ''), {views.NO_STRINGS}) as note_zones", "linked_zones",
    )
    rows = trials.learned_nodes(profile)
    return rows.select("id", "zone", F.array_join("secondary_zones", "|").alias("secondary_zones"), "bridge_score", "era_start")


@query(
    "agg36_model_samples",
    """SELECT 'nodes' AS counter, count(*) AS n FROM entities UNION ALL SELECT 'dated', count(era_start) FROM entities UNION ALL SELECT 'edges', count(*) FROM relations UNION ALL SELECT 'map_connections', count(*) FROM tiered WHERE tier <> 'research_lead'
       UNION ALL SELECT 'notes', count(*) FROM entities WHERE node_type = 'band' UNION ALL SELECT 'notes_with_era', count(era_start) FROM entities WHERE node_type = 'band'""",
    ("entities", "relations", "tiered"),
)
def model_samples(spark, d):
    nodes = _nodes(spark, d)
    return trials.model_samples(nodes, _edges(spark, d), nodes.where("node_type = 'band'"))


# --- sources --------------------------------------------------------------------------------------------------


@query(
    "src01_snk01_graph_documents",
    "SELECT id, label, node_type, zone, era_start, CAST(len(sources) AS BIGINT) AS sources, CAST(len(roles) AS BIGINT) AS roles FROM entities",
    ("entities",),
)
def graph_documents(spark, d):
    """Each node as a one-node JSON document, read back with the fixed schema."""
    from evigraph import schemas

    node = F.expr(
        "named_struct('id', id, 'label', label, 'type', node_type, 'roles', roles, 'summary', summary, 'metadata', metadata, 'aliases', aliases, 'x', x, 'y', y, 'zone', zone, "
        "'starter', starter, 'eraStart', era_start, 'sources', sources, 'extra', 'kept out')"
    )
    text = _nodes(spark, d).select(F.to_json(F.struct(F.lit(1).alias("version"), F.array(node).alias("nodes"))).alias("value"))
    documents = text.select(F.from_json("value", schemas.GRAPH).alias("g")).select("g.*")
    rows = readers.entity_rows(readers.graph_nodes(documents))
    return rows.select("id", "label", "node_type", "zone", "era_start", F.size("sources").cast("bigint").alias("sources"), F.size("roles").cast("bigint").alias("roles"))


@query("src02_projected_read", "SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag IN ('A', 'N')")
def projected_read(spark, d):
    return views.table(spark, d, "lineitem").where(F.col("l_returnflag").isin("A", "N")).select("l_orderkey", "l_suppkey")


@query("src03_repeated_keys", "SELECT CAST(l_orderkey AS VARCHAR) AS key, CAST(count(*) AS VARCHAR) AS detail FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def repeated_keys(spark, d):
    return readers.repeated_keys(views.table(spark, d, "lineitem"), "l_orderkey").select("key", "detail")


@query(
    "src03_paged_read",
    "SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS total FROM orders WHERE o_orderkey > 700 AND o_orderstatus <> 'P'",
)
def paged_read(spark, d):
    """The orders as a folder of pages in key order, read by key; the key's filter skips pages, the other one stays with Spark."""
    from evigraph.sources import paged

    folder = leases.work_folder(spark, "pages")
    rows = views.table(spark, d, "orders").selectExpr("o_orderkey as id", "o_orderstatus as status", "o_totalprice as total")
    rows.repartitionByRange("id").sortWithinPartitions("id").write.option("maxRecordsPerFile", 50_000).parquet(folder)
    return paged.read_pages(spark, folder, rows.schema).where("id > 700 and status <> 'P'")


@query(
    "src04_fn26_inbox",
    """SELECT 'req-' || o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'req-' || o_orderkey ELSE 'T' END AS title, CASE WHEN o_orderkey % 3 = 0 THEN 50 ELSE CAST(o_orderkey % 100 AS INTEGER) END AS priority, 'queued' AS status FROM orders""",
)
def inbox(spark, d):
    """Each order as an inbox file, half of them lists and half objects."""
    one = "named_struct('id', concat('req-', o_orderkey), 'title', case when o_orderkey % 4 <> 0 then 'T' end, 'priority', case when o_orderkey % 3 <> 0 then o_orderkey % 100 end)"
    text = views.table(spark, d, "orders").selectExpr(
        f"case when o_orderkey % 2 = 0 then to_json(array({one})) else to_json(named_struct('version', 1, 'requests', array({one}))) end as value"
    )
    return readers.request_rows(readers.inbox_requests(text, "value")).select("id", "title", "priority", "status")


@query(
    "src06_fact_batches",
    """SELECT 'batch-' || doc_id AS batch_id, 'artist-' || doc_id AS entity_id, CASE WHEN doc_id % 3 <> 0 THEN 'https://' || source || '.example.org' END AS source_url, sha256('batch-' || doc_id || chr(10) || 'artist-' || doc_id || chr(10) || text) AS fingerprint FROM documents""",
)
def fact_batches(spark, d):
    batches = views.table(spark, d, "documents").selectExpr(
        "concat('batch-', doc_id) as batchId", "'2024-01-01' as verifiedAt", "map('s', array(source, concat('https://', source, '.example.org'))) as sources",
        "array(array(concat('artist-', doc_id), text, 'history', case when doc_id % 3 = 0 then 'missing' else 's' end, 'page 1')) as facts",
    )
    return readers.fact_batch_rows(batches).select("batch_id", "entity_id", "source_url", "fingerprint")


@query(
    "src07_notes",
    """SELECT id, label, node_type, era_start, array_to_string(list_concat(['x, y'], aliases), '|') AS aliases, starter FROM entities WHERE id NOT LIKE '%9' AND node_type <> 'genre'
       UNION ALL SELECT 'warning', CASE WHEN id LIKE '%9' THEN 'note_without_id' ELSE 'note_kind' END, id, NULL, NULL, NULL FROM entities WHERE id LIKE '%9' OR node_type = 'genre'""",
    ("entities",),
)
def notes(spark, d):
    """Notes written from the entities and parsed again."""
    value = F.expr(
        "concat('---\\n', case when id like '%9' then '' else concat('id: ', id, '\\n') end, 'label: old\\nlabel: \"', label, '\"\\ntype: ', case when node_type = 'genre' then 'album' else node_type end, "
        "'\\n# comment\\nzone:\\neraStart: ', coalesce(cast(era_start as string), ''), '\\naliases: [\"x, y\"', case when size(aliases) > 0 then concat(', ', aliases[0]) else '' end, "
        "']\\nstarter: ', starter, '\\n---\\n# Body: text')"
    )
    found, warnings = readers.parse_notes(_nodes(spark, d).select(F.col("id").alias("path"), value.alias("value")))
    rows = found.select("id", "label", "node_type", "era_start", F.array_join("aliases", "|").alias("aliases"), "starter")
    return rows.unionByName(warnings.select(
        F.lit("warning").alias("id"), F.col("rule").alias("label"), F.col("key").alias("node_type"), F.lit(None).cast("int").alias("era_start"),
        F.lit(None).cast("string").alias("aliases"), F.lit(None).cast("boolean").alias("starter"),
    ))


@query(
    "src08_page_corpus",
    """SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, CAST(len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS BIGINT) AS links, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host
       FROM pages WHERE trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) <> ''""",
)
def page_corpus(spark, d):
    return readers.page_corpus(views.table(spark, d, "pages")).select("page_id", "title", F.size("links").cast("bigint").alias("links"), "host")


@query(
    "top12_page_candidates",
    f"""SELECT page_id, title, rank FROM (SELECT page_id, title, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rank FROM (SELECT page_id, title, pos, row_number() OVER (PARTITION BY page_id, lower(title) ORDER BY pos) AS n FROM (
         SELECT page_id, pos, trim(replace(replace(link, '/', 'rock '), 'th', 'folk ')) AS title FROM (SELECT page_id, unnest(l) AS link, unnest(range(len(l))) AS pos FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages
           WHERE trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) <> ''))) WHERE NOT ({' OR '.join(f"contains(lower(title), '{t}')" for t in vocab.MAINTENANCE_TERMS + vocab.PAGE_RELEASE_TERMS + tuple(x for x in vocab.OUT_OF_SCOPE_TERMS if x != 'research brain'))})) WHERE n = 1) WHERE rank <= 20""",
)
def page_candidates(spark, d):
    links = readers.page_links(views.table(spark, d, "pages")).withColumn("link", F.expr("replace(replace(link, '/', 'rock '), 'th', 'folk ')"))
    return titles.page_candidates(links, "page_id", "link").select("page_id", "title", "rank")


@query(
    "src10_claims_json",
    """SELECT 'Q' || s_suppkey AS entity_id, p AS property, 'st-' || s_suppkey || '-' || p AS statement_id, CASE WHEN p = 'P17' THEN 'Q5' END AS value_id, CASE WHEN p = 'P571' THEN '+1990-01-01T00:00:00Z' END AS value_time, 'normal' AS rank FROM supplier, (VALUES ('P17'), ('P571')) v(p)""",
)
def claims_json(spark, d):
    statement = "array(named_struct('id', concat('st-', s_suppkey, '-{p}'), 'mainsnak', named_struct('snaktype', 'value', 'datavalue', named_struct('value', named_struct({v})))))"
    text = views.table(spark, d, "supplier").selectExpr(
        "concat('Q', s_suppkey) as entity_id",
        "to_json(named_struct('P17', " + statement.format(p="P17", v="'id', 'Q5'") + ", 'P571', " + statement.format(p="P571", v="'time', '+1990-01-01T00:00:00Z'") + ")) as claims",
    )
    return readers.claims_from_json(text).select("entity_id", "property", "statement_id", "value_id", "value_time", "rank")


@query(
    "src13_live_nodes",
    "SELECT id, label FROM entities UNION ALL SELECT 'candidate:' || id, seed_name FROM review_rows WHERE status IN ('review', 'approved')",
    ("entities", "review_rows"),
)
def live_nodes(spark, d):
    nodes = _nodes(spark, d)
    return readers.live_nodes(nodes, nodes.where("node_type = 'band'"), views.review_rows(spark, d)).select("id", "label")


@query(
    "flt32_identity_matches",
    "SELECT id, len(list_filter(sources, lambda s: s.label = 'Wikipedia')) > 0 AND id NOT LIKE '%1' AS same FROM entities WHERE len(sources) > 0",
    ("entities",),
)
def identity_matches(spark, d):
    nodes = _nodes(spark, d).where("size(sources) > 0")
    title = refs.article_title(F.col("sources"), "en")
    other = F.expr("case when id like '%1' then 'Elsewhere' else upper(regexp_extract(sources[0].url, '/wiki/(.*)$', 1)) end")
    other = F.when(other.rlike("^Q[0-9]"), F.upper(F.replace(title, F.lit(" "), F.lit("_")))).otherwise(other)
    return nodes.select("id", resolve.sitelink_matches(F.col("sources"), other).alias("same"))


@query(
    "flt33_route_leads",
    """, l AS (SELECT id, entity_id, text, source_fingerprint AS fp, doc_id % 4 > 0 AS ref, pos FROM facts WHERE pos % 2 = 1), ex AS (SELECT * FROM facts WHERE pos % 2 = 0),
    k AS (SELECT l.id, EXISTS (SELECT 1 FROM ex WHERE ex.entity_id = l.entity_id AND ex.source_fingerprint = l.fp) OR EXISTS (SELECT 1 FROM ex WHERE ex.entity_id = l.entity_id AND ex.status IN ('review', 'approved') AND
       len(list_distinct(regexp_extract_all(lower(l.text), '[a-z0-9]+'))) > 0 AND len(list_intersect(list_distinct(regexp_extract_all(lower(l.text), '[a-z0-9]+')), list_distinct(regexp_extract_all(lower(ex.text), '[a-z0-9]+'))))::DOUBLE /
       greatest(1, len(list_distinct(list_concat(regexp_extract_all(lower(l.text), '[a-z0-9]+'), regexp_extract_all(lower(ex.text), '[a-z0-9]+'))))) >= 0.64) AS dropped, ref, pos FROM l),
    c AS (SELECT id FROM k WHERE NOT dropped AND ref ORDER BY pos DESC, id LIMIT 100)
    SELECT id, CASE WHEN dropped THEN 'drop' WHEN NOT ref THEN 'research_lead' WHEN id IN (SELECT id FROM c) THEN 'proposal' ELSE 'deferred' END AS route FROM k""",
    ("facts",),
)
def route_leads(spark, d):
    from evigraph.operators.facts import route_leads as route

    rows = views.facts(spark, d)
    leads = rows.where("pos % 2 = 1").selectExpr(
        "id", "entity_id", "text", "source_fingerprint as fingerprint", f"case when doc_id % 4 > 0 then array('https://r.example.org') else {views.NO_STRINGS} end as references", "pos as score"
    )
    return route(leads, rows.where("pos % 2 = 0"), 100).select("id", "route")


@query(
    "top03_flt28_queue",
    """SELECT 'table' AS variant, id FROM (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' ORDER BY CAST(substr(o_orderpriority, 1, 1) AS INTEGER) DESC, o_orderdate, o_orderkey LIMIT 100)
       UNION ALL SELECT 'files', id FROM (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' ORDER BY CAST(substr(o_orderpriority, 1, 1) AS INTEGER) DESC, o_orderdate DESC, o_orderkey DESC LIMIT 100)""",
)
def queue(spark, d):
    rows = views.table(spark, d, "orders").selectExpr(
        "o_orderkey as id", "case when o_orderstatus = 'O' then 'queued' else 'processed' end as status", "cast(substr(o_orderpriority, 1, 1) as int) as priority", "o_orderdate as created_at"
    )
    return readers.queue(rows, limit=100).select(F.lit("table").alias("variant"), "id").unionByName(
        readers.queue_of_files(rows, 100).select(F.lit("files").alias("variant"), "id")
    )


@query(
    "top07_best_request",
    """, s AS (SELECT o_orderkey AS r, o_custkey % 7 AS k FROM orders WHERE o_orderkey % 3 <> 0), o AS (SELECT r, 50 + r % 40 + CASE k WHEN 0 THEN 1.5 WHEN 1 THEN -2.25 ELSE 0 END AS score FROM s)
    SELECT 'req-' || r AS id, round(CAST(score AS DOUBLE), 4) AS score FROM o ORDER BY score DESC, r LIMIT 1""",
    ("blocked",),
)
def best_request(spark, d):
    from evigraph.operators.learning import best_request as best

    orders = views.table(spark, d, "orders")
    requests = orders.selectExpr("concat('req-', o_orderkey) as id", "50 + o_orderkey % 40 as priority", "o_orderkey as position")
    seeds = orders.selectExpr("concat('req-', o_orderkey) as request_id", "concat('act ', o_orderkey) as name", "concat('k', o_custkey % 7) as kind", "'' as zone")
    deltas = spark.sql("select * from values ('kind', 'k0', 1.5D), ('kind', 'k1', -2.25D) as v(dimension, value, delta)")
    seen = orders.where("o_orderkey % 3 = 0").selectExpr("concat('req-', o_orderkey) as id")
    used = seeds.where("false").select("name", "kind")
    return best(requests, seeds, seen, used, deltas)


# --- streams --------------------------------------------------------------------------------------------------


@query(
    "str01_review_stream",
    """, w AS (SELECT *, lag(status) OVER p AS ps, lag(coalesce(review_reason_code, '')) OVER p AS pr, lag(id) OVER p AS pid FROM review_rows WINDOW p AS (PARTITION BY user_id ORDER BY updated_at, id))
    SELECT CAST(user_id AS VARCHAR) AS candidate_id, id AS version, ps AS previous_status, status FROM w WHERE CASE WHEN pid IS NULL THEN status <> 'review' ELSE ps <> status OR pr <> coalesce(review_reason_code, '') END""",
    ("review_rows",),
)
def review_stream(spark, d):
    """The change stream of the events table through the stateful operator."""
    events = spark.readStream.schema(views.TABLES["events"]).option("pathGlobFilter", "events.parquet").parquet(d)
    rows = views.review_rows_of(events)
    changes = rows.selectExpr(
        "cast(user_id as string) as candidate_id", "id as version", "status", "review_reason_code as reason_code", "cast(null as string) as note",
        "cast(updated_at as timestamp) as happened_at",
    )
    end = views.table(spark, d, "events").agg(F.max("ts").cast("timestamp").alias("ts")).first().ts
    changes = changes.unionByName(leases.clock_mark(changes, "happened_at", F.lit(end) + F.expr("interval 2 days")))
    out = leases.run_available(review_log.stream_events(changes), "review-events")
    return out.select("candidate_id", "version", "previous_status", "status")


@query(
    "str01_backfill",
    "SELECT id AS candidate_id, status FROM review_rows WHERE status <> 'review' AND value <= 50",
    ("review_rows",),
)
def backfill(spark, d):
    rows = views.review_rows(spark, d)
    events = rows.where("value > 50").select(F.col("id").alias("candidate_id"))
    return review_log.backfill_events(rows, events).select("candidate_id", "status")


@query(
    "str02_recover_stale",
    """SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1999-12-31 12:00:00' THEN 'queued' WHEN o_orderstatus = 'P' THEN 'processing' WHEN o_orderstatus = 'O' THEN 'queued' ELSE 'processed' END AS status,
       CASE WHEN o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1999-12-31 12:00:00' THEN 'Recovered after an interrupted run.' END AS error FROM orders""",
)
def recover_stale(spark, d):
    rows = _request_states(spark, d)
    return leases.recover_stale(rows, F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")).select("id", "status", "error")


def _request_states(spark, d):
    return views.table(spark, d, "orders").selectExpr(
        "o_orderkey as id", "case o_orderstatus when 'P' then 'processing' when 'O' then 'queued' else 'processed' end as status", "o_orderdate as updated_at", "cast(null as string) as error"
    )


@query(
    "str05_close_requests",
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN CASE o_orderstatus WHEN 'P' THEN 'processing' WHEN 'O' THEN 'queued' ELSE 'processed' END WHEN o_orderkey % 5 < 3 OR o_orderkey % 2 = 0 THEN 'processed' ELSE 'queued' END AS status,
       CASE WHEN o_orderkey % 5 >= 3 THEN 'boom' END AS error FROM orders""",
)
def close_requests(spark, d):
    rows = _request_states(spark, d)
    runs = rows.where("id % 5 <> 0").selectExpr(
        "id as request_id", "case when id % 5 < 3 then 'completed' else 'failed' end as outcome", "id % 2 = 0 as candidates_written", "case when id % 5 >= 3 then 'boom' end as error"
    )
    return leases.close_requests(rows, runs).select("id", "status", "error")


@query(
    "str05_request_stream",
    """SELECT o_orderkey AS id, CASE WHEN run AND (o_orderkey % 3 < 2 OR o_orderkey % 2 = 0) THEN 'processed' ELSE 'queued' END AS status,
       CASE WHEN NOT run THEN 'Recovered after an interrupted run.' WHEN o_orderkey % 3 = 2 THEN 'boom' END AS error
       FROM (SELECT *, o_orderkey % 5 <> 0 AND o_orderkey % 30 <= 12 AS run FROM orders) ORDER BY id""",
)
def request_stream(spark, d):
    """Requests and their runs as two streams: a run ends up to 29 hours after the request, some never, some are delivered twice."""
    orders = spark.readStream.schema(views.TABLES["orders"]).option("pathGlobFilter", "orders.parquet").parquet(d)
    requests = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("started_at"))
    runs = orders.where("o_orderkey % 5 <> 0").select(
        F.col("o_orderkey").alias("request_id"), F.concat(F.lit("run-"), "o_orderkey").alias("run_id"), F.expr("case when o_orderkey % 3 = 2 then 'failed' else 'completed' end as outcome"),
        F.expr("o_orderkey % 2 = 0 as candidates_written"), F.expr("case when o_orderkey % 3 = 2 then 'boom' end as error"),
        (F.col("o_orderdate").cast("timestamp") + F.expr("make_dt_interval(0, o_orderkey % 30)")).alias("finished_at"), F.expr("explode(sequence(0, if(o_orderkey % 7 = 0, 1, 0)))"),
    ).drop("col")
    end = views.table(spark, d, "orders").agg(F.max("o_orderdate").cast("timestamp").alias("t")).first().t
    mark = F.lit(end) + F.expr("interval 9 days")
    requests = requests.unionByName(leases.clock_mark(requests, "started_at", mark))
    runs = runs.unionByName(leases.clock_mark(runs, "finished_at", mark))
    return leases.run_available(leases.close_request_stream(requests, runs), "requests").select("id", "status", "error")


@query(
    "str03_recently_checked",
    "SELECT DISTINCT entity_id AS id FROM attempts WHERE attempted_at > TIMESTAMP '2024-01-16 00:00:00' - INTERVAL 14 DAY",
    ("attempts",),
)
def recently_checked(spark, d):
    return leases.recently_checked(views.attempts(spark, d), F.lit("2024-01-16 00:00:00").cast("timestamp_ntz"))


@query(
    "str06_review_counts",
    "SELECT strftime(time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d') AS week, event_type AS status, count(*) AS decisions FROM events GROUP BY 1, 2",
)
def review_counts(spark, d):
    rows = views.table(spark, d, "events").selectExpr("cast(ts as timestamp) as happened_at", "event_type as status")
    return review_log.review_counts(rows).select(F.date_format("week", "yyyy-MM-dd").alias("week"), "status", "decisions")
