"""Queries on titles, package review, facts and learning."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigraph import vocab
from evigraph.functions import refs, text
from evigraph.functions.numeric import half_even
from evigraph.operators import evidence, facts, graph, learning, titles
from evigraph.plans import views
from evigraph.plans.registry import query
from evigraph.session import cut_lineage


def _any(column: str, terms) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(column, t.replace("'", "''")) for t in terms) + ")"


def _in(column: str, terms) -> str:
    return f"{column} IN (" + ", ".join("'" + t.replace("'", "''") + "'" for t in terms) + ")"


def _scope_sql(name: str, raw: str, kind: str, source: str, promotion: bool) -> str:
    release = vocab.RELEASE_TERMS + vocab.MAINTENANCE_TERMS if promotion else vocab.RELEASE_TERMS
    text_ = "release, maintenance or generic encyclopedia topic" if promotion else "release page, not a map entity"
    starts = " OR ".join(f"starts_with({raw}, '{p}')" for p in vocab.GENERIC_PREFIXES)
    return f"""CASE WHEN {name} = '' THEN 'empty title' WHEN {starts} THEN 'category, list, history or geography page'
      WHEN {_in(name, vocab.OUT_OF_SCOPE_EXACT)} THEN 'out-of-scope reference/platform topic' WHEN {_any(name, vocab.OUT_OF_SCOPE_TERMS)} THEN 'out-of-scope platform/media/list/reference topic'
      WHEN starts_with({name}, 'list of ') THEN 'list page' WHEN regexp_matches({name}, '^[0-9]{{4}}') THEN 'year/date page' WHEN {_any(name, release)} THEN '{text_}'
      WHEN {_in(name, vocab.GENERIC_TOPICS)} OR ends_with({name}, ' genres') THEN 'generic topic, not a concrete map entity'
      WHEN {kind} = 'genre' AND {_any(name, vocab.GROUPING_GENRE_TERMS)} THEN 'category-style grouping, not a concrete music genre'
      WHEN {_in(source, vocab.WEAK_SOURCES)} AND {kind} <> 'genre' THEN 'weak category/template signal for non-genre candidate'
      WHEN {source} = 'category' AND {_any(name, vocab.COLLECTION_TERMS)} THEN 'category collection page'
      WHEN {source} = 'category' AND {_any(name, (' by ', ' from '))} THEN 'category grouping page' END"""


TITLE_SQL = """, n AS (SELECT *, trim(replace(lower(title), '_', ' ')) AS raw, trim(lower(replace(title, 'Category:', ''))) AS plain,
   trim(regexp_replace(lower(title), '\\s*\\((band|singer)\\)\\s*$', '')) AS canon FROM titles)"""


@query(
    "flt07_scope_reason",
    TITLE_SQL + f""" SELECT id, {_scope_sql('plain', 'raw', 'kind', 'source', False)} AS review, {_scope_sql('canon', 'raw', 'kind', 'source', True)} AS promotion FROM n""",
    ("titles",),
)
def scope_reason(spark, d):
    title, kind, source = F.col("title"), F.col("kind"), F.col("source")
    return views.titles(spark, d).select(
        "id", titles.scope_reason(title, kind, source).alias("review"),
        titles.scope_reason(title, kind, source, promotion=True).alias("promotion"),
    )


@query(
    "flt10_actionable_seeds",
    f"""SELECT id, t <> '' AND t NOT IN ('bandcamp', 'bandcamp daily') AND (kind <> 'genre' OR NOT (starts_with(t, 'history of ') OR {_any('t', vocab.SEED_GROUPING_TERMS)})) AS actionable
        FROM (SELECT id, kind, trim(lower(title)) AS t FROM titles)""",
    ("titles",),
)
def actionable_seeds(spark, d):
    return views.titles(spark, d).select("id", evidence.is_actionable_seed(F.col("title"), F.col("kind")).alias("actionable"))


_CLASS_SQL = """CASE WHEN contains(t, 'guitarist') THEN 'guitarist' WHEN contains(t, 'band') OR contains(t, 'music group') THEN 'band' WHEN contains(t, 'genre') OR contains(t, 'rock music') THEN 'genre'
   WHEN contains(t, 'guitar manufacturer') OR contains(t, 'guitar brands') THEN 'guitar_brand' WHEN contains(t, 'guitar') THEN 'guitar' WHEN contains(t, 'musician') OR contains(t, 'songwriter') THEN 'artist' ELSE 'unknown' END"""


@query(
    "flt16_17_title_candidates",
    f"""SELECT id, kind, round(least(1.0, CASE WHEN source = 'category' THEN 0.56 ELSE 0.42 END + CASE WHEN kind <> 'unknown' THEN 0.22 ELSE 0 END + CASE WHEN contains(t, 'guitar') THEN 0.18 ELSE 0 END
          + CASE WHEN contains(t, 'guitarist') THEN 0.12 ELSE 0 END + CASE WHEN contains(t, 'band') THEN 0.1 ELSE 0 END + CASE WHEN contains(t, 'genre') THEN 0.08 ELSE 0 END
          + CASE WHEN contains(t, 'rock') OR contains(t, 'blues') THEN 0.06 ELSE 0 END), 3)::DOUBLE AS score,
         c <> '' AND NOT ({_any('c', vocab.MAINTENANCE_TERMS + vocab.PAGE_RELEASE_TERMS)} OR contains(c, 'cold bolt') OR {_in('c', [t for t in vocab.OUT_OF_SCOPE_EXACT if t != 'brain'])}
           OR {_any('c', [t for t in vocab.OUT_OF_SCOPE_TERMS if t != 'research brain'])} OR starts_with(c, 'list of ') OR regexp_matches(c, '^[0-9]{{4}}')) AND {_any('c', vocab.MUSIC_TERMS)} AS admitted
        FROM (SELECT id, source, t, trim(replace(t, 'category:', '')) AS c, {_CLASS_SQL} AS kind FROM (SELECT id, source, trim(lower(title)) AS t FROM titles))""",
    ("titles",),
)
def title_candidates(spark, d):
    title = F.col("title")
    kind = titles.classify_title(title)
    return views.titles(spark, d).select(
        "id", kind.alias("kind"), F.round(titles.title_score(title, F.col("source"), kind), 3).alias("score"),
        titles.is_admissible(title, ["Cold_bolt"]).alias("admitted"),
    )


@query(
    "top12_best_titles",
    f""", s AS (SELECT key % 50 AS g, title, trim(lower(title)) AS t, CASE WHEN contains(lower(title), 'rock') THEN 2.0 ELSE 1.0 END + CASE WHEN contains(lower(title), 'band') THEN 0.5 ELSE 0 END AS score FROM titles),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g, t ORDER BY score DESC, title) AS n FROM s) WHERE n = 1)
    SELECT g, title, rank FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, title) AS rank FROM b) WHERE rank <= 12""",
    ("titles",),
)
def best_titles(spark, d):
    rows = views.titles(spark, d).selectExpr(
        "key % 50 as g", "title",
        "case when contains(lower(title), 'rock') then 2.0D else 1.0D end + case when contains(lower(title), 'band') then 0.5D else 0D end as score",
    )
    return titles.best_titles(rows, "g").select("g", "title", F.col("rank").cast("bigint").alias("rank"))


_REVIEW_SQL = f""", c AS (SELECT l_orderkey, turn, CASE turn WHEN 0 THEN 'act ' || o_custkey WHEN 1 THEN 'ensemble ' || l_suppkey WHEN 2 THEN 'some album' WHEN 3 THEN 'player ' || l_partkey WHEN 4 THEN 'blocked act two' ELSE '' END AS t,
     turn IN (1, 3) AND l_returnflag <> 'R' AS verified, CASE turn WHEN 1 THEN 'band' WHEN 3 THEN 'artist' WHEN 4 THEN 'venue' ELSE 'genre' END AS kind FROM lines6),
  j AS (SELECT *, NOT verified OR {_scope_sql('t', 't', 'kind', "''", False)} IS NOT NULL AS rejected FROM c),
  cs AS (SELECT l_orderkey, count(*) AS total, count(*) FILTER (rejected) AS rejected FROM j GROUP BY l_orderkey),
  p AS (SELECT o_orderkey AS k, o_custkey AS u, CASE WHEN o_orderkey % 13 = 0 THEN '' WHEN o_orderkey % 11 = 0 THEN 'list of things' WHEN o_orderkey % 17 = 0 THEN 'blocked act' ELSE 'act ' || o_custkey END AS name,
     (['band', 'artist', 'guitarist', 'genre', 'album'])[o_orderkey % 5 + 1] AS kind, coalesce(total, 0) AS total, coalesce(rejected, 0) AS rejected FROM orders LEFT JOIN cs ON l_orderkey = o_orderkey),
  f AS (SELECT *, (name = '')::INT + (name = 'blocked act')::INT + (kind = 'album')::INT + (kind <> 'album' AND name = 'list of things')::INT
      + (k % 24 = 0)::INT + (k % 4 <> 0 AND k % 5 < 3 AND k % 3 <> 0)::INT
      + (k % 4 <> 0 AND k % 5 < 3 AND k % 6 <> 0 AND k % 19 = 0)::INT + (k % 4 <> 0 AND k % 8 <> 0 AND k % 23 = 0)::INT AS rejects,
      (k % 4 = 0)::INT + (k % 9 = 0)::INT + (total = 0)::INT + (total > 0 AND total = rejected)::INT + (total > rejected AND rejected > total - rejected AND rejected >= 5)::INT AS warnings FROM p)"""


@query(
    "agg26_package_review",
    _REVIEW_SQL + """ SELECT 'pkg-' || k AS id, CASE WHEN rejects > 0 THEN 'reject' WHEN warnings > 0 OR greatest(0, 100 - rejects * 35 - warnings * 12 - rejected * 2) < 85 THEN 'warning' ELSE 'ok' END AS level,
      CAST(greatest(0, 100 - rejects * 35 - warnings * 12 - rejected * 2) AS BIGINT) AS score, total, rejected, CAST(rejects + warnings AS BIGINT) AS flags FROM f""",
    ("lines6",),
)
def package_review(spark, d):
    reviewed = titles.review_packages(views.packages(spark, d), ["Blocked act"])
    return reviewed.select(
        "id", "level", F.col("score").cast("bigint").alias("score"), F.col("total").cast("bigint").alias("total"),
        F.col("rejected").cast("bigint").alias("rejected"), F.size("flags").cast("bigint").alias("flags"),
    )


@query(
    "fn25_27_rejected_preview",
    """, r AS (SELECT 'pkg-' || l_orderkey AS id, turn, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos,
        CASE turn WHEN 0 THEN 'Act ' || o_custkey WHEN 1 THEN 'Ensemble ' || l_suppkey WHEN 2 THEN 'Some album' WHEN 3 THEN 'Player ' || l_partkey WHEN 4 THEN 'Blocked act two' ELSE '' END AS title
        FROM lines6 WHERE turn NOT IN (1, 3) OR l_returnflag = 'R')
    SELECT id, pos, title, CASE turn WHEN 5 THEN 'Candidate has no title.' WHEN 4 THEN 'Unsupported kind: venue.' WHEN 2 THEN 'release page, not a map entity' ELSE 'Research lead, not a verified entity.' END AS reason,
      CASE turn WHEN 4 THEN 'bad_node_type,blocked_entity' WHEN 2 THEN 'release_as_context_only' ELSE 'candidate_ok' END AS categories FROM r WHERE pos < 8""",
    ("lines6",),
)
def rejected_preview(spark, d):
    return titles.preview_rejections(views.packages(spark, d), ["Blocked act"])


@query(
    "flt09_11_rejection_reason",
    f""", c AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, turn, CASE turn WHEN 0 THEN 'act ' || o_custkey WHEN 1 THEN 'ensemble ' || l_suppkey WHEN 2 THEN 'some album' WHEN 3 THEN 'player ' || l_partkey WHEN 4 THEN 'blocked act two' ELSE '' END AS t,
       turn IN (1, 3) AND l_returnflag <> 'R' AS verified FROM lines6)
    SELECT t, coalesce(CASE WHEN turn IN (4, 5) THEN 'blocked, empty or unsupported kind' END, {_scope_sql('t', 't', "'band'", "'musicbrainz relation'", True)}, CASE WHEN NOT verified THEN 'unverified candidate identity' END) AS reason,
      count(*) AS n FROM c GROUP BY 1, 2""",
    ("lines6",),
)
def rejection_reason(spark, d):
    rows = views.packages(spark, d).select(F.explode("payload.music_candidates").alias("c"))
    reasoned = rows.select(F.lower("c.title").alias("t"), titles.rejection_reason(F.col("c"), ["blocked act"]).alias("reason"))
    return reasoned.groupBy("t", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "agg13_snk07_run_metrics",
    """, c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)
    SELECT 'run-' || (o_orderkey // 100) AS run_id, count(*) AS candidates, CAST(sum(CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS link_leads, CAST(sum(n) AS BIGINT) AS related, CAST(sum(n) AS BIGINT) AS documented,
      CAST(sum(CASE WHEN o_orderkey % 9 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS source_errors FROM orders LEFT JOIN c ON l_orderkey = o_orderkey GROUP BY 1""",
)
def run_metrics(spark, d):
    from evigraph.sources.sinks import run_rows

    return run_rows(views.packages(spark, d).select("run_id", "payload.*"))


@query(
    "flt08_page_matches_kind",
    f"""SELECT doc_id, NOT contains(t, 'may refer to') AND {_any('t', [x.replace('duo', 'duo') for x in vocab.PAGE_KIND_TERMS['band']])} AS band,
         NOT contains(t, 'may refer to') AND {_any('t', vocab.PAGE_KIND_TERMS['artist'])} AS artist FROM (SELECT doc_id, substr(replace(replace(lower(text), 'the ', 'band '), 'ing', 'singer'), 1) AS t FROM documents)""",
)
def page_matches(spark, d):
    extract = F.replace(F.replace(F.lower("text"), F.lit("the "), F.lit("band ")), F.lit("ing"), F.lit("singer"))
    none = F.array().cast("array<string>")
    return views.table(spark, d, "documents").select(
        "doc_id", titles.page_matches_kind(extract, none, F.lit("band")).alias("band"),
        titles.page_matches_kind(extract, none, F.lit("artist")).alias("artist"),
    )


def _near_new(spark, d):
    return views.table(spark, d, "documents").select("doc_id", "lang", "text")


@query(
    "join11_near_duplicates",
    """, w AS (SELECT doc_id, lang, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS s FROM documents), a AS (SELECT DISTINCT lang, s FROM w WHERE doc_id % 2 = 0 AND len(s) > 0),
    b AS (SELECT DISTINCT lang, s FROM w WHERE doc_id % 2 = 1 AND len(s) > 0),
    hit AS (SELECT DISTINCT a.lang, a.s FROM a JOIN b ON a.lang = b.lang AND len(b.s) BETWEEN len(a.s) * 0.64 - 1 AND len(a.s) / 0.64 + 1
      WHERE len(list_intersect(a.s, b.s))::DOUBLE / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) >= 0.64)
    SELECT doc_id FROM w JOIN hit ON hit.lang = w.lang AND hit.s = w.s WHERE doc_id % 2 = 0""",
    ("blocked",),
)
def near_duplicates(spark, d):
    """Documents of one half that nearly repeat a document of the other half in the same language."""
    docs = _near_new(spark, d)
    return facts.near_duplicates(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), ["lang"]).select("doc_id")


@query(
    "agg11_feedback_bias",
    """SELECT category, CAST(round_even((2.0 * a - n) * 2 / n, 0) AS BIGINT) AS bias FROM (SELECT substr(tag, 7) AS category, count(*) FILTER (status = 'approved') AS a, count(*) AS n
       FROM (SELECT status, unnest(tags) AS tag FROM facts WHERE status IN ('approved', 'rejected')) WHERE tag LIKE 'scout-%' GROUP BY 1) WHERE n >= 3""",
    ("facts",),
)
def feedback_bias(spark, d):
    return facts.feedback_bias(views.facts(spark, d))


# Curated facts: the second sentence of every fifth document. An entity's facts count where its first sentence is active.
_CURATED = "pos = 1 and doc_id % 5 = 0"
_OCC_SQL = f""", cur AS (SELECT * FROM facts WHERE {_CURATED}), occ AS (SELECT entity_id, count(*) AS occupied FROM (
   SELECT entity_id FROM facts WHERE status IN ('review', 'approved') UNION ALL SELECT entity_id FROM cur) GROUP BY entity_id)"""


def _curated(spark, d):
    return views.facts(spark, d).where(_CURATED)


def _blocked_ids(spark, d):
    return views.blocked(spark, d).select(F.lower("id").alias("id"))


def _eligible(spark, d):
    now = F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")
    return facts.eligible_entities(
        views.entities(spark, d), views.facts(spark, d), views.attempts(spark, d), now, _blocked_ids(spark, d), curated=_curated(spark, d)
    )


_ELIGIBLE_SQL = _OCC_SQL + """, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY attempted_at DESC, outcome DESC) AS n FROM attempts) WHERE n = 1)
  , el AS (SELECT e.id, e.zone, e.starter, coalesce(o.occupied, 0) AS occupied FROM entities e LEFT JOIN occ o ON o.entity_id = e.id LEFT JOIN last l ON l.entity_id = e.id
     WHERE e.node_type IN ('artist', 'band') AND len(list_filter(e.sources, lambda s: starts_with(s.url, 'https://en.wikipedia.org/wiki/'))) > 0 AND coalesce(o.occupied, 0) < 2
       AND e.id NOT IN (SELECT lower(id) FROM blocked)
       AND (l.entity_id IS NULL OR l.attempted_at + CASE WHEN l.outcome = 'source_error' THEN INTERVAL 1 DAY ELSE INTERVAL 30 DAY END <= TIMESTAMP '2024-03-01 00:00:00'))
  , zr AS (SELECT e.zone, CAST(coalesce(sum(o.occupied), 0) AS DOUBLE) / count(*) AS ratio FROM entities e LEFT JOIN occ o ON o.entity_id = e.id GROUP BY e.zone)"""


@query(
    "flt31_str03_eligible_entities",
    _ELIGIBLE_SQL + " SELECT id, occupied FROM el",
    ("entities", "facts", "attempts", "blocked"),
)
def eligible_entities(spark, d):
    return _eligible(spark, d).select("id", "occupied")


@query(
    "win04_round_robin",
    _ELIGIBLE_SQL + """, q AS (SELECT el.id, el.zone, row_number() OVER (PARTITION BY el.zone ORDER BY occupied, starter DESC, id) AS round, ratio FROM el JOIN zr ON zr.zone = el.zone)
    SELECT id, zone, round, round(ratio, 6) AS ratio, row_number() OVER (ORDER BY round, ratio, zone) AS position FROM q""",
    ("entities", "facts", "attempts", "blocked"),
)
def round_robin(spark, d):
    eligible = cut_lineage(_eligible(spark, d).select("id", "zone", "starter", "occupied"))
    ratios = facts.zone_fact_ratio(views.entities(spark, d), views.facts(spark, d), _curated(spark, d))
    return facts.round_robin(eligible, ratios).select("id", "zone", "round", F.round("ratio", 6).alias("ratio"), "position")


_COVERED_SQL = f""", cov AS (SELECT DISTINCT entity_id FROM facts WHERE status = 'approved' OR {_CURATED}),
   m AS (SELECT e.*, c.entity_id IS NOT NULL AS has FROM entities e LEFT JOIN cov c ON c.entity_id = e.id WHERE e.id NOT IN (SELECT lower(id) FROM blocked))"""
_PROVIDER_SQL = """list_distinct(list_filter(list_transform(sources, lambda s: CASE WHEN s.provider <> 'other' THEN s.provider END), lambda p: p IS NOT NULL))"""


@query(
    "agg10_fact_coverage",
    _COVERED_SQL + f""" SELECT g AS "group", k AS key, count(*) AS total, CAST(sum(has::INT) AS BIGINT) AS covered FROM (SELECT 'kind' AS g, node_type AS k, has FROM m UNION ALL SELECT 'zone', zone, has FROM m
      UNION ALL SELECT 'source', unnest({_PROVIDER_SQL}), has FROM m) GROUP BY g, k""",
    ("entities", "facts", "blocked"),
)
def fact_coverage(spark, d):
    return facts.coverage(views.entities(spark, d), views.facts(spark, d), _curated(spark, d), _blocked_ids(spark, d))


@query(
    "agg10_coverage_gaps",
    _COVERED_SQL + """, z AS (SELECT zone, avg(has::INT) AS r FROM m GROUP BY zone) SELECT m.id, m.zone, m.node_type, m.label FROM m JOIN z ON z.zone = m.zone WHERE NOT has ORDER BY r, m.zone, node_type, lower(label), id LIMIT 30""",
    ("entities", "facts", "blocked"),
)
def coverage_gaps(spark, d):
    return facts.coverage_gaps(views.entities(spark, d), views.facts(spark, d), 30, _curated(spark, d), _blocked_ids(spark, d))


# A batch of every third document's sentences beside the facts of the others; some rows break a rule of their own.
_BATCH_SQL = f""", b AS (SELECT CASE WHEN doc_id % 31 = 0 THEN 'Batch_A' ELSE 'batch-a' END AS batch_id, doc_id * 100000 + pos AS index,
   CASE WHEN doc_id % 4 = 1 THEN 'artist-' || (doc_id % 50) ELSE entity_id END AS entity_id, text || '.' AS text, CASE WHEN pos % 11 = 0 THEN 'Bad One' ELSE 'history' END AS category,
   CASE WHEN pos % 7 = 0 THEN NULL ELSE 'Site' END AS source_label, CASE WHEN pos % 7 = 0 THEN NULL WHEN pos % 5 = 0 THEN 'https://en.wikipedia.org/wiki/X' ELSE 'https://site.example.org/' || doc_id END AS source_url,
   CASE WHEN pos % 13 = 0 THEN '  ' ELSE 'page 1' END AS evidence, CASE WHEN pos % 3 = 0 THEN source_fingerprint ELSE 'new-' || id END AS fingerprint,
   list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS w FROM facts WHERE doc_id % 3 = 0),
   old AS (SELECT entity_id, status, source_fingerprint, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS w FROM facts WHERE doc_id % 3 > 0 OR pos % 6 = 0),
   cur AS (SELECT entity_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS w FROM facts WHERE {_CURATED}),
   r AS (SELECT b.*, e.node_type, source_label IS NOT NULL AS sourced FROM b LEFT JOIN entities e ON e.id = b.entity_id),
   o AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY batch_id, index) AS n FROM r WHERE sourced AND fingerprint NOT IN (SELECT source_fingerprint FROM old)),
   act AS (SELECT entity_id, count(*) AS k FROM (SELECT entity_id FROM old WHERE status IN ('review', 'approved') UNION ALL SELECT entity_id FROM cur) GROUP BY 1),
   prior AS (SELECT entity_id, w, 0 AS n FROM old WHERE status IN ('review', 'approved') UNION ALL SELECT entity_id, w, 0 FROM cur UNION ALL SELECT entity_id, w, n FROM o)
"""


@query(
    "val07_batch_preflight",
    _BATCH_SQL + """ SELECT 'batch_slug' AS rule, batch_id, index FROM r WHERE batch_id = 'Batch_A' UNION ALL SELECT 'unknown_entity', batch_id, index FROM r WHERE node_type IS NULL
   UNION ALL SELECT 'text_form', batch_id, index FROM r WHERE length(text) NOT BETWEEN 35 AND 200 UNION ALL SELECT 'category_slug', batch_id, index FROM r WHERE category = 'Bad One'
   UNION ALL SELECT 'missing_source', batch_id, index FROM r WHERE NOT sourced UNION ALL SELECT 'indirect_source', batch_id, index FROM r WHERE sourced AND contains(source_url, 'wikipedia')
   UNION ALL SELECT 'superlative', batch_id, index FROM r WHERE sourced AND regexp_matches(lower(text), '\\b(first|only|largest|most|oldest|youngest)\\b')
   UNION ALL SELECT 'missing_evidence', batch_id, index FROM r WHERE sourced AND trim(evidence) = ''
   UNION ALL SELECT 'entity_full', batch_id, index FROM o LEFT JOIN act USING (entity_id) WHERE coalesce(k, 0) + n > 2
   UNION ALL SELECT DISTINCT 'near_duplicate', o.batch_id, o.index FROM o JOIN prior p ON p.entity_id = o.entity_id AND p.n < o.n AND len(o.w) > 0 AND len(p.w) > 0
     AND len(list_intersect(o.w, p.w))::DOUBLE / (len(o.w) + len(p.w) - len(list_intersect(o.w, p.w))) >= 0.64""",
    ("entities", "facts"),
)
def batch_preflight(spark, d):
    every = views.facts(spark, d)
    batch = every.where("doc_id % 3 = 0").selectExpr(
        "case when doc_id % 31 = 0 then 'Batch_A' else 'batch-a' end as batch_id", "doc_id * 100000 + pos as index",
        "case when doc_id % 4 = 1 then concat('artist-', doc_id % 50) else entity_id end as entity_id", "concat(text, '.') as text",
        "case when pos % 11 = 0 then 'Bad One' else 'history' end as category", "case when pos % 7 = 0 then null else 'Site' end as source_label",
        "case when pos % 7 = 0 then null when pos % 5 = 0 then 'https://en.wikipedia.org/wiki/X' else concat('https://site.example.org/', doc_id) end as source_url",
        "case when pos % 13 = 0 then '  ' else 'page 1' end as evidence", "case when pos % 3 = 0 then source_fingerprint else concat('new-', id) end as fingerprint",
    )
    return facts.preflight(batch, views.entities(spark, d), _curated(spark, d), every.where("doc_id % 3 > 0 or pos % 6 = 0"))


@query(
    "agg35_evidence_counts",
    """, u AS (SELECT entity_id, 'curated:' || id AS fp FROM facts WHERE pos % 5 = 0 UNION ALL SELECT entity_id, source_fingerprint FROM facts WHERE status = 'approved'),
    g AS (SELECT entity_id, fp, count(*) AS n FROM u GROUP BY 1, 2), k AS (SELECT id FROM entities WHERE NOT starter)
    SELECT 'facts' AS part, entity_id AS key, count(*) AS n FROM g WHERE entity_id IN (SELECT id FROM k) GROUP BY 2 UNION ALL SELECT 'unknown_entity', entity_id, CAST(sum(n) AS BIGINT) FROM g WHERE entity_id NOT IN (SELECT id FROM k) GROUP BY 2
    UNION ALL SELECT 'repeated_fingerprint', entity_id, CAST(sum(n - 1) AS BIGINT) FROM g WHERE n > 1 AND entity_id IN (SELECT id FROM k) GROUP BY 2""",
    ("entities", "facts"),
)
def evidence_counts(spark, d):
    rows = views.facts(spark, d)
    counts, warnings = facts.evidence_counts(rows.where("pos % 5 = 0"), rows.where("status = 'approved'"), views.entities(spark, d).where("not starter"))
    return counts.select(F.lit("facts").alias("part"), F.col("entity_id").alias("key"), F.col("facts").alias("n")).unionByName(
        warnings.select(F.col("rule").alias("part"), "key", "n")
    )


@query(
    "top13_shown_facts",
    """, u AS (SELECT entity_id, id, text, 0 AS p, NULL::TIMESTAMP AS t FROM facts WHERE pos % 4 = 3 UNION ALL SELECT entity_id, id, text, 1, TIMESTAMP '2024-01-01' + to_days(CAST(pos AS INTEGER)) FROM facts WHERE status = 'approved'),
    f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, text ORDER BY p, t DESC NULLS LAST, id) AS n FROM u) WHERE n = 1)
    SELECT entity_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY p, t DESC NULLS LAST, id) AS rank FROM f) WHERE rank <= 2""",
    ("facts",),
)
def shown_facts(spark, d):
    rows = views.facts(spark, d).withColumn("reviewed_at", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(pos as int))"))
    shown = facts.shown_facts(rows.where("pos % 4 = 3"), rows.where("status = 'approved'"))
    return shown.select("entity_id", "id", F.col("rank").cast("bigint").alias("rank"))


@query(
    "str04_fact_states",
    """SELECT id, text, CASE WHEN status = 'approved' AND pos % 4 = 0 THEN 'review' WHEN pos % 3 = 0 THEN 'approved' ELSE status END AS status,
       CASE WHEN CASE WHEN status = 'approved' AND pos % 4 = 0 THEN 'review' WHEN pos % 3 = 0 THEN 'approved' ELSE status END = 'approved'
         THEN CASE WHEN status = 'approved' THEN DATE '2024-01-05' ELSE DATE '2024-06-01' END END AS verified_at
       FROM (SELECT id, CASE WHEN pos % 4 = 0 THEN text || ' edited' ELSE text END AS text, status, pos FROM facts)""",
    ("facts",),
)
def fact_states(spark, d):
    old = views.facts(spark, d).withColumn("verified_at", F.expr("case when status = 'approved' then date'2024-01-05' end"))
    new = old.withColumn("text", F.expr("case when pos % 4 = 0 then concat(text, ' edited') else text end")).withColumn(
        "status", F.expr("case when pos % 3 = 0 then 'approved' else status end")
    ).withColumn("verified_at", F.lit(None).cast("date"))
    return facts.next_state(old, new, F.lit("2024-06-01 00:00:00").cast("timestamp"))


@query("flt25_candidate_leads")
def candidate_leads(spark, d):
    """Lead sentences of every document, whose words are mapped so that the rules have something to find."""
    words = {"The ": "The band was recorded in a garage ", "ing": " built a guitar", "Of ": "Member took their name from "}
    extract = F.col("text")
    for plain, term in words.items():
        extract = F.replace(extract, F.lit(plain), F.lit(term))
    docs = views.table(spark, d, "documents").select(
        F.concat(F.lit("artist-"), "doc_id").alias("entity_id"), F.lit("Member").alias("label"), F.lit("band").alias("node_type"), extract.alias("extract")
    )
    return facts.candidate_leads(docs, facts.feedback_bias(views.facts(spark, d)))


# --- learning -------------------------------------------------------------------------------------------------

_DECISION_SQL = """, z AS (SELECT name, kind, zone FROM (SELECT *, row_number() OVER (PARTITION BY name, kind ORDER BY id DESC) AS n FROM (
    SELECT id, zone, CASE WHEN list_contains(roles, 'guitarist') AND node_type = 'artist' THEN 'guitarist' ELSE node_type END AS kind, lower(unnest(list_concat([label], aliases))) AS name FROM entities)) WHERE n = 1)
, d AS (SELECT r.id, r.status, requested_kind AS kind, lower(seed_name) AS name, requested_kind || ':' || lower(seed_name) AS seed_key, status IN ('approved', 'imported') AS positive, updated_at AS reviewed_at,
    coalesce(review_reason_code, 'unspecified') AS reason_code, CASE WHEN status <> 'rejected' OR review_reason_code IS NOT NULL THEN 1.0 ELSE 0.2 END AS weight,
    CASE WHEN status = 'review' THEN 'not_a_decision' WHEN payload_kind = 'typed_connection' THEN 'connection_review' WHEN status <> 'rejected' AND identity_conflict THEN 'source_identity_conflict'
      WHEN status = 'rejected' AND (review_reason_code IN ('duplicate', 'wrong_entity', 'weak_source', 'weak_connection', 'incorrect_fact') OR reason = 'Existing node') THEN 'rejection_not_about_frontier' END AS skip FROM review_rows r)
, dz AS (SELECT d.*, coalesce(z.zone, '') AS zone FROM d LEFT JOIN z ON z.name = d.name AND z.kind = d.kind)
, u AS (SELECT *, CAST(weight / sum(weight) OVER (PARTITION BY seed_key) AS DOUBLE) AS lw FROM dz WHERE skip IS NULL)
"""
_DECISION_VIEWS = ("entities", "review_rows")


def _decisions(spark, d):
    return learning.prepare_decisions(views.review_rows(spark, d), learning.seed_zones(views.entities(spark, d)))


@query("agg37_skip_counts", _DECISION_SQL + "SELECT skip, count(*) AS n FROM dz WHERE skip IS NOT NULL GROUP BY skip", _DECISION_VIEWS)
def skip_counts(spark, d):
    return learning.skip_counts(_decisions(spark, d))


@query("join31_win02_decisions", _DECISION_SQL + "SELECT id, seed_key, zone, positive, round(lw, 8) AS learning_weight FROM u", _DECISION_VIEWS)
def decisions(spark, d):
    return learning.usable(_decisions(spark, d)).select("id", "seed_key", "zone", "positive", F.round("learning_weight", 8).alias("learning_weight"))


_COUNT_SQL = _DECISION_SQL + """, gc AS (SELECT dimension, value, count(*) FILTER (positive) AS approved, count(*) FILTER (NOT positive) AS rejected,
   round(coalesce(sum(lw) FILTER (positive), 0), 3) AS pw, round(coalesce(sum(lw) FILTER (NOT positive), 0), 3) AS nw FROM (
     SELECT 'overall' AS dimension, '' AS value, positive, lw FROM u UNION ALL SELECT 'kind', kind, positive, lw FROM u UNION ALL SELECT 'zone', zone, positive, lw FROM u WHERE zone <> '') GROUP BY 1, 2)
, adj AS (SELECT dimension, value, CASE WHEN pw + nw < 4 THEN 0.0 ELSE least(4.0, greatest(-4.0, ((pw + 2) / (pw + nw + 4) - (SELECT (pw + 2) / (pw + nw + 4) FROM gc WHERE dimension = 'overall')) * 16 * (pw + nw) / (pw + nw + 8))) END AS delta
   FROM gc WHERE dimension <> 'overall')
"""


@query("agg12_group_counts", _COUNT_SQL + "SELECT dimension, value, approved, rejected, pw AS positive_weight, nw AS negative_weight FROM gc", _DECISION_VIEWS)
def group_counts(spark, d):
    return learning.group_counts(learning.usable(_decisions(spark, d)))


@query(
    "agg12_group_examples",
    _DECISION_SQL + """SELECT dimension, value, rank, id FROM (SELECT *, row_number() OVER (PARTITION BY dimension, value ORDER BY reviewed_at DESC, id DESC) AS rank FROM (
      SELECT 'kind' AS dimension, kind AS value, id, reviewed_at FROM u UNION ALL SELECT 'zone', zone, id, reviewed_at FROM u WHERE zone <> '')) WHERE rank <= 4""",
    _DECISION_VIEWS,
)
def group_examples(spark, d):
    rows = learning.group_examples(learning.usable(_decisions(spark, d)))
    return rows.select("dimension", "value", F.col("rank").cast("bigint").alias("rank"), "id")


@query("agg23_adjustments", _COUNT_SQL + "SELECT dimension, value, round(delta, 4) AS delta FROM adj", _DECISION_VIEWS)
def adjustments(spark, d):
    counts = learning.group_counts(learning.usable(_decisions(spark, d)))
    return learning.adjustments(counts).select("dimension", "value", F.round("delta", 4).alias("delta"))


_SPLIT_SQL = """, sd AS (SELECT seed_key, count(*) AS n, max(reviewed_at) AS last FROM u GROUP BY seed_key)
, rk AS (SELECT *, coalesce(sum(n) OVER w, 0) AS before, row_number() OVER (ORDER BY last DESC, seed_key DESC) - 1 AS taken, sum(n) OVER () AS total, count(*) OVER () AS seeds
   FROM sd WINDOW w AS (ORDER BY last DESC, seed_key DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
, sides AS (SELECT seed_key, CASE WHEN total >= 20 AND seeds >= 2 AND taken < seeds - 1 AND (before < greatest(4, round_even(total * 0.2, 0)) OR taken < 4) THEN 'holdout' ELSE 'train' END AS side FROM rk)
"""


@query("win05_split_holdout", _DECISION_SQL + _SPLIT_SQL + "SELECT side, count(*) AS n, count(DISTINCT u.seed_key) AS seeds FROM u JOIN sides ON sides.seed_key = u.seed_key GROUP BY side", _DECISION_VIEWS)
def split_holdout(spark, d):
    split = learning.split_holdout(cut_lineage(learning.usable(_decisions(spark, d))))
    return split.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("seed_key").alias("seeds"))


@query(
    "agg24_brier",
    _DECISION_SQL + _SPLIT_SQL + """, su AS (SELECT u.*, side FROM u JOIN sides ON sides.seed_key = u.seed_key)
    , gc AS (SELECT dimension, value, round(coalesce(sum(lw) FILTER (positive), 0), 3) AS pw, round(coalesce(sum(lw) FILTER (NOT positive), 0), 3) AS nw FROM (
        SELECT 'overall' AS dimension, '' AS value, positive, lw FROM su WHERE side = 'train' UNION ALL SELECT 'kind', kind, positive, lw FROM su WHERE side = 'train' UNION ALL SELECT 'zone', zone, positive, lw FROM su WHERE side = 'train' AND zone <> '') GROUP BY 1, 2)
    , base AS (SELECT (pw + 2) / (pw + nw + 4) AS b FROM gc WHERE dimension = 'overall')
    , adj AS (SELECT dimension, value, CASE WHEN pw + nw < 4 THEN 0.0 ELSE least(4.0, greatest(-4.0, ((pw + 2) / (pw + nw + 4) - b) * 16 * (pw + nw) / (pw + nw + 8))) END AS delta FROM gc, base WHERE dimension <> 'overall')
    , h AS (SELECT s.*, b, least(0.95, greatest(0.05, b + round(least(6.0, greatest(-6.0, coalesce(k.delta, 0) + coalesce(zz.delta, 0))), 2) / 16)) AS p FROM su s CROSS JOIN base
        LEFT JOIN adj k ON k.dimension = 'kind' AND k.value = s.kind LEFT JOIN adj zz ON zz.dimension = 'zone' AND zz.value = s.zone WHERE side = 'holdout')
    SELECT count(*) AS holdout, count(*) FILTER (positive) AS holdout_approved, count(*) FILTER (NOT positive) AS holdout_rejected, round(sum(lw * (b - positive::INT) ** 2) / sum(lw), 4) AS baseline_brier,
      round(sum(lw * (p - positive::INT) ** 2) / sum(lw), 4) AS learned_brier FROM h""",
    _DECISION_VIEWS,
)
def brier(spark, d):
    split = cut_lineage(learning.split_holdout(cut_lineage(learning.usable(_decisions(spark, d)))))
    return learning.evaluate(split.where("side = 'train'"), split.where("side = 'holdout'"))


@query(
    "agg25_31_eligibility",
    _DECISION_SQL + _SPLIT_SQL + """SELECT count(*) FILTER (side = 'train') AS train, count(DISTINCT u.seed_key) FILTER (side = 'train') AS train_seeds, count(DISTINCT u.seed_key) FILTER (side = 'holdout') AS holdout_seeds,
      count(*) FILTER (NOT positive AND reason_code <> 'unspecified') AS clear_rejections, count(DISTINCT u.seed_key) FILTER (NOT positive AND reason_code <> 'unspecified') AS rejection_seeds,
      count(*) FILTER (side = 'train') >= 40 AS enough_training FROM u JOIN sides ON sides.seed_key = u.seed_key""",
    _DECISION_VIEWS,
)
def eligibility(spark, d):
    split = cut_lineage(learning.split_holdout(cut_lineage(learning.usable(_decisions(spark, d)))))
    return learning.eligibility(split).select("train", "train_seeds", "holdout_seeds", "clear_rejections", "rejection_seeds", "enough_training")


@query("agg25_rejection_reasons", "SELECT coalesce(review_reason_code, 'unspecified') AS reason_code, count(*) AS n FROM review_rows WHERE status = 'rejected' GROUP BY 1", ("review_rows",))
def rejection_reasons(spark, d):
    return learning.rejection_reasons(views.review_rows(spark, d))


_FRONTIER_SQL = """, dg AS (SELECT id, count(*) AS n FROM (SELECT source AS id FROM tiered WHERE tier <> 'research_lead' UNION ALL SELECT target FROM tiered WHERE tier <> 'research_lead') GROUP BY id),
  sc AS (SELECT e.id, label, zone, coalesce(dg.n, 0) AS degree, CASE WHEN list_contains(roles, 'guitarist') THEN 'guitarist' ELSE node_type END AS kind, starter,
     CASE WHEN list_contains(roles, 'guitarist') THEN 10 WHEN node_type = 'artist' THEN 9 WHEN node_type = 'band' THEN 8 WHEN node_type = 'genre' THEN 7 WHEN node_type = 'guitar' THEN 6 ELSE 5 END + greatest(0, 6 - least(coalesce(dg.n, 0), 6)) * 5
     + CASE WHEN starter THEN 5 ELSE 0 END + CASE WHEN len(list_filter(sources, lambda s: s.provider IN ('wikipedia', 'wikidata'))) > 0 THEN 4 ELSE 0 END + CASE WHEN summary = '' THEN 2 ELSE 0 END AS score
     FROM entities e LEFT JOIN dg ON dg.id = e.id), ok AS (SELECT * FROM sc WHERE degree <= 5 OR starter)"""


def _frontier_rows(spark, d):
    nodes = views.entities(spark, d)
    found = graph.end_degrees(views.relations(spark, d))
    joined = nodes.join(found, "id", "left").fillna({"degree": 0})
    kind = evidence.derived_kind(F.col("node_type"), F.col("roles"), F.col("metadata"))
    scored = joined.withColumn("kind", kind)
    score = learning.frontier_score(F.col("kind"), F.col("degree"), F.col("starter"), refs.has_wiki_source(F.col("sources")), F.col("summary"), F.lit(0))
    return scored.withColumn("score", score).where("degree <= 5 or starter")


@query("top04_frontier_score", _FRONTIER_SQL + " SELECT id, CAST(score AS BIGINT) AS score FROM ok", ("entities", "relations", "tiered"))
def frontier_score(spark, d):
    return _frontier_rows(spark, d).select("id", F.col("score").cast("bigint").alias("score"))


@query(
    "top05_frontier",
    _FRONTIER_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY score DESC, degree, label, id) AS rz, row_number() OVER (PARTITION BY zone, kind ORDER BY score DESC, degree, label, id) AS rk, count(*) OVER (PARTITION BY zone) AS size FROM ok),
    zs AS (SELECT zone, sum(score) FILTER (rz <= 6) AS s, max(size) AS size, least(6, count(*) FILTER (rk <= 2)) AS b FROM r GROUP BY zone), best AS (SELECT zone FROM zs ORDER BY b >= 3 DESC, s DESC, size DESC, zone LIMIT 1)
    SELECT zone, id, rank FROM (SELECT zone, id, row_number() OVER (ORDER BY score DESC, degree, label, id) AS rank FROM r WHERE rk <= 2 AND zone IN (SELECT zone FROM best)) WHERE rank <= 6""",
    ("entities", "relations", "tiered"),
)
def frontier(spark, d):
    chosen = learning.frontier(cut_lineage(_frontier_rows(spark, d).select("id", "label", "kind", "zone", "degree", "score")), 6)
    return chosen.select("zone", "id", F.col("rank").cast("bigint").alias("rank"))


# --- text functions -------------------------------------------------------------------------------------------


@query(
    "fn_text_normal_forms",
    """SELECT doc_id, sha256(trim(replace(lower(text), '_', ' '))) AS plain, sha256(trim(replace(replace(lower(text), '_', ' '), '-', ' '))) AS key_form,
       sha256(trim(regexp_replace(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+', ' ', 'g'))) AS folded FROM documents""",
)
def normal_forms(spark, d):
    return views.table(spark, d, "documents").select(
        "doc_id", F.sha2(text.normalize_text("text"), 256).alias("plain"), F.sha2(text.normalize_key("text"), 256).alias("key_form"),
        F.sha2(text.fold_text("text"), 256).alias("folded"),
    )


@query(
    "fn_titles_and_slugs",
    """SELECT id, trim(regexp_replace(title, '\\s*\\((band|singer)\\)\\s*$', '')) AS canonical, regexp_replace(trim(regexp_replace(lower(title), '\\s*\\(band\\)\\s*$', '')), '^(the|a|an)\\s+', '') AS loose,
       trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') AS slug, CASE WHEN regexp_matches(title, '^[aeiouAEIOU]') THEN 'An' ELSE 'A' END AS article FROM titles""",
    ("titles",),
)
def titles_and_slugs(spark, d):
    return views.titles(spark, d).select(
        "id", text.canonical_title("title").alias("canonical"), text.loose_title_key("title").alias("loose"),
        text.slugify("title").alias("slug"), text.article_for("title").alias("article"),
    )


@query(
    "fn_summary_years_search",
    r"""SELECT id, array_to_string(regexp_extract_all(summary, '\b(19[2-9]\d|20[0-2]\d)\b', 1), ',') AS years, CASE WHEN regexp_matches(summary, '\b(1[6-9]\d{2}|20[0-2]\d)\b') THEN CAST(regexp_extract(summary, '\b(1[6-9]\d{2}|20[0-2]\d)\b', 1) AS INTEGER) END AS first_year,
       lower(concat_ws(' ', label, array_to_string(aliases, ' '), array_to_string(roles, ' '))) AS search,
       CASE WHEN era_start IS NULL AND x > 50000 THEN 'dates not specified' WHEN era_start IS NULL THEN 'start not recorded to 2001' WHEN x > 50000 THEN era_start || ' onward (end not recorded)' ELSE era_start || ' to 2001' END AS period,
       CASE WHEN summary = '' THEN 'none' ELSE summary END AS compact FROM entities""",
    ("entities",),
)
def summary_years_search(spark, d):
    end = F.expr("case when x <= 50000 then '2001' end")
    return views.entities(spark, d).select(
        "id", F.array_join(text.years_in_text("summary"), ",").alias("years"), text.first_year_in_text("summary").alias("first_year"),
        text.search_text("label", "aliases", "roles").alias("search"), text.period_text(F.col("era_start").cast("string"), end).alias("period"),
        text.compact_summary("summary", "none").alias("compact"),
    )


@query(
    "fn_source_ids",
    """SELECT id, CASE WHEN len(sources) > 0 AND sources[1].label IN ('Wikipedia', 'Wikidata') THEN replace(regexp_extract(list_filter(sources, lambda s: s.label = 'Wikipedia')[1].url, '/wiki/(.*)$', 1), '_', ' ') END AS article,
       list_filter(list_transform(sources, lambda s: regexp_extract(s.url, 'wikidata.org/wiki/(Q[0-9]+)', 1)), lambda v: v <> '')[1] AS item,
       list_filter(list_transform(sources, lambda s: regexp_extract(s.url, 'musicbrainz.org/artist/(.*)$', 1)), lambda v: v <> '')[1] AS artist,
       array_to_string(list_transform(sources, lambda s: s.provider), ',') AS providers FROM entities""",
    ("entities",),
)
def source_ids(spark, d):
    sources = F.col("sources")
    bare = F.transform(sources, lambda s: F.struct(s["label"].alias("label"), s["url"].alias("url"), F.lit(None).cast("string").alias("provider")))
    return views.entities(spark, d).select(
        "id", refs.article_title(sources).alias("article"), refs.catalogue_item_id(sources).alias("item"), refs.artist_catalogue_id(sources).alias("artist"),
        F.array_join(F.transform(bare, refs.source_provider), ",").alias("providers"),
    )


@query(
    "fn_numbers",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, least(greatest(l_quantity, 10.0), 40.0) AS clamped, round(l_extendedprice / 7, 2) AS half_up, round(sqrt(l_quantity ** 2 + l_linenumber ** 2), 6) AS hyp FROM lineitem""",
)
def numbers(spark, d):
    from evigraph.functions.numeric import clamp, half_up

    return views.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", clamp(F.col("l_quantity"), 10.0, 40.0).alias("clamped"),
        half_up(F.col("l_extendedprice") / 7, 2).alias("half_up"), half_up(F.hypot("l_quantity", "l_linenumber"), 6).alias("hyp"),
    )


@query(
    "fn23_layout_priority",
    "SELECT e.id, round(least(1.0, CASE WHEN node_type = 'genre' THEN 1.0 WHEN starter THEN 0.92 ELSE 0.42 END + least(0.45, g.degree * 0.045))::DOUBLE, 3) AS priority FROM entities e JOIN degree g ON g.id = e.id",
    ("entities", "relations", "tiered", "ends", "degree"),
)
def layout_priority(spark, d):
    from evigraph.functions.numeric import layout_priority as priority

    found = graph.degrees(views.relations(spark, d), views.entities(spark, d))
    return found.select("id", priority(F.col("node_type"), F.col("starter"), F.col("degree")).alias("priority"))


@query(
    "fn17_authority_names",
    """SELECT s_suppkey, true AS swapped, s_suppkey % 2 = 0 AS plain FROM supplier""",
)
def authority_names(spark, d):
    rows = views.table(spark, d, "supplier")
    name = F.concat(F.lit("Given "), F.col("s_suppkey"), F.lit(" Family"))
    swapped = F.concat(F.lit("FAMILY, given "), F.col("s_suppkey"))
    other = F.when(F.col("s_suppkey") % 2 == 0, name).otherwise("Someone Else")
    return rows.select("s_suppkey", text.authority_name_matches(swapped, name).alias("swapped"), text.authority_name_matches(other, name).alias("plain"))


@query(
    "fn29_scope_of_kinds",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 3 THEN 'guitar_history' WHEN o_orderkey % 5 = 2 THEN 'genre_cluster' ELSE 'artist_network' END AS scope,
       'frontier-' || isoyear(o_orderdate) || '-w' || lpad(CAST(week(o_orderdate) AS VARCHAR), 2, '0') AS request FROM orders""",
)
def scope_of_kinds(spark, d):
    kinds = F.expr(
        "case o_orderkey % 5 when 3 then array('genre', 'guitar') when 2 then array('genre', 'genre') when 1 then array('genre', 'band') else array('artist') end"
    )
    request = learning.request_id_of_scope(F.lit("frontier"), F.col("o_orderdate"))
    return views.table(spark, d, "orders").select("o_orderkey", learning.scope_of_kinds(kinds).alias("scope"), request.alias("request"))


@query(
    "fn20_half_even",
    "SELECT o_orderkey, round_even(o_orderkey / 2.0, 0) AS even FROM orders",
)
def half_even_numbers(spark, d):
    return views.table(spark, d, "orders").select("o_orderkey", half_even(F.col("o_orderkey") / 2).alias("even"))
