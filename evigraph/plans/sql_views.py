"""The same views as plain SQL for an independent engine."""

_SRC = "STRUCT(label VARCHAR, url VARCHAR, provider VARCHAR)[]"


def _sources(key: str, prefix: str) -> str:
    marker = "a" if prefix == "Performer" else "b"
    article = f"{{'label': 'Wikipedia', 'url': 'https://en.wikipedia.org/wiki/{prefix}_' || {key}, 'provider': 'wikipedia'}}"
    item = f"{{'label': 'Wikidata', 'url': 'https://www.wikidata.org/wiki/Q' || {key}, 'provider': 'wikidata'}}"
    artist = (
        f"{{'label': 'MusicBrainz', 'url': 'https://musicbrainz.org/artist/{marker}0000000-0000-4000-8000-' || "
        f"lpad(CAST({key} AS VARCHAR), 12, '0'), 'provider': 'musicbrainz'}}"
    )
    site = f"{{'label': 'Site', 'url': 'http://site.example.org/' || {key}, 'provider': 'other'}}"
    return (
        f"CASE {key} % 5 WHEN 1 THEN [{article}] WHEN 2 THEN [{item}, {article}] WHEN 3 THEN [{article}, {artist}] "
        f"WHEN 4 THEN [{artist}, {site}] ELSE CAST([] AS {_SRC}) END"
    )


def _xy(key: str, band: int) -> str:
    return (
        f"CAST(({key} * 137) % 997 * 110 + {band} * 200000 AS DOUBLE) AS x, "
        f"CAST({key} // 997 * 90 + ({key} * 61) % 89 AS DOUBLE) AS y"
    )


_EMPTY = "CAST([] AS VARCHAR[])"
_BRAND = "CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS BIGINT)"
_LINE_CONTEXT = "CASE WHEN l_linestatus = 'O' AND l_linenumber = 7 THEN ['Wikipedia category: sets'] ELSE ['Order ' || l_orderkey] END"
_LINE_SOURCES = (
    "CASE WHEN l_returnflag = 'A' THEN [{'label': 'Catalogue', 'url': 'https://catalogue.example.org/r/' || l_orderkey, "
    f"'provider': 'other'}}] ELSE CAST([] AS {_SRC}) END"
)


def _linked(test: str, source: str) -> str:
    return (
        f"CASE WHEN {test} THEN [{{'label': 'Catalogue', 'url': 'https://catalogue.example.org/e/' || {source}, "
        f"'provider': 'other'}}] ELSE CAST([] AS {_SRC}) END"
    )


SQL_VIEWS: dict[str, str] = {
    "entities": f"""
SELECT 'artist-' || c_custkey AS id, c_name AS label, 'artist' AS node_type, 'nation-' || c_nationkey AS zone,
       c_acctbal >= 9000 AS starter, CAST(fy AS INTEGER) AS era_start, {_xy('c_custkey', 0)},
       CASE WHEN c_mktsegment = 'MACHINERY' THEN ['guitarist', 'artist'] ELSE ['artist'] END AS roles,
       ['Performer ' || c_custkey] AS aliases, [c_mktsegment] AS metadata,
       CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'Performer from NATION_' || c_nationkey || '.' END AS summary,
       {_sources('c_custkey', 'Performer')} AS sources
FROM customer LEFT JOIN (SELECT o_custkey, min(year(o_orderdate)) AS fy FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey
UNION ALL
SELECT 'band-' || s_suppkey, s_name, 'band', 'nation-' || s_nationkey, s_acctbal >= 9000,
       CASE WHEN s_suppkey % 3 <> 0 THEN CAST(1950 + s_suppkey % 60 AS INTEGER) END, {_xy('s_suppkey', 1)},
       ['band'], ['Ensemble ' || s_suppkey], ['Band'],
       'Band formed in NATION_' || s_nationkey || ' during ' || (1950 + s_suppkey % 60) || '.',
       {_sources('s_suppkey', 'Ensemble')}
FROM supplier
UNION ALL
SELECT 'guitar-' || p_partkey, p_name || ' ' || p_partkey, 'guitar', 'guitar-workshop', false, NULL,
       {_xy('p_partkey', 2)}, ['guitar'], {_EMPTY}, [p_type], p_name || ' model.', CAST([] AS {_SRC})
FROM part
UNION ALL
SELECT 'brand-' || b, p_brand, 'guitar_brand', 'guitar-workshop', b % 5 = 0, CAST(1900 + b AS INTEGER),
       {_xy('b', 3)}, ['guitar_brand'], {_EMPTY}, ['Guitar brand'], '', CAST([] AS {_SRC})
FROM (SELECT DISTINCT p_brand, {_BRAND} AS b FROM part)
UNION ALL
SELECT 'genre-' || k, n_name, 'genre', 'nation-' || k, k % 5 = 0, NULL,
       {_xy('k', 4)}, ['genre'], {_EMPTY}, ['Genre'], '', CAST([] AS {_SRC})
FROM (SELECT CAST(n_nationkey AS BIGINT) AS k, n_name FROM nation)
""",
    "relations": f"""
SELECT 'm-' || concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, 'artist-' || o_custkey AS source,
       'band-' || l_suppkey AS target, 'member_of' AS type,
       CASE WHEN l_returnflag = 'R' THEN 'Wikipedia link signal' ELSE 'member of' END AS label,
       CASE WHEN l_tax < 0.08 THEN round(l_discount * 10, 1) END AS strength,
       {_LINE_CONTEXT} AS context, CAST(year(l_shipdate) AS INTEGER) AS year, {_LINE_SOURCES} AS sources
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
UNION ALL
SELECT 'p-' || concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey), 'artist-' || o_custkey,
       'guitar-' || l_partkey, 'plays',
       CASE WHEN l_returnflag = 'R' THEN 'Wikipedia category signal' ELSE 'plays' END,
       CASE WHEN l_tax < 0.08 THEN round(l_discount * 10, 1) END,
       {_LINE_CONTEXT}, CAST(year(l_shipdate) AS INTEGER), {_LINE_SOURCES}
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
UNION ALL
SELECT 'b-' || p_partkey, 'guitar-' || p_partkey, 'brand-' || regexp_extract(p_brand, '([0-9]+)$', 1), 'made_by', 'made by', 0.8,
       {_EMPTY}, NULL, {_linked('p_size % 2 = 0', "'guitar-' || p_partkey")}
FROM part
UNION ALL
SELECT 'ag-' || c_custkey, 'artist-' || c_custkey, 'genre-' || c_nationkey, 'associated_genre', 'associated with', 0.6,
       {_EMPTY}, NULL, {_linked('c_custkey % 3 = 0', "'artist-' || c_custkey")}
FROM customer
UNION ALL
SELECT 'bg-' || s_suppkey, 'band-' || s_suppkey, 'genre-' || s_nationkey, 'associated_genre', 'associated with', 0.6,
       {_EMPTY}, NULL, {_linked('s_suppkey % 3 = 0', "'band-' || s_suppkey")}
FROM supplier
""",
    "tiered": """
SELECT *, CASE WHEN regexp_matches(lower(trim(label)), '^wikipedia (link|category) signal$')
                 OR len(list_filter(context, lambda c: regexp_matches(lower(trim(c)), '^wikipedia (link|category):'))) > 0
               THEN 'research_lead'
               WHEN len(list_filter(sources, lambda s: trim(coalesce(s.url, '')) <> '')) > 0 THEN 'source_linked'
               ELSE 'curated_unsourced' END AS tier
FROM relations
""",
    "ends": """
SELECT t.*, a.label AS source_label, a.node_type AS source_type, a.zone AS source_zone,
       b.label AS target_label, b.node_type AS target_type, b.zone AS target_zone
FROM tiered t JOIN entities a ON a.id = t.source JOIN entities b ON b.id = t.target
""",
    "degree": """
SELECT e.id, coalesce(d.degree, 0) AS degree, coalesce(d.weighted, 0.0) AS weighted_degree
FROM entities e LEFT JOIN (
  SELECT id, count(*) AS degree, sum(strength) AS weighted FROM (
    SELECT source AS id, coalesce(strength, 0.5) AS strength FROM ends WHERE tier <> 'research_lead'
    UNION ALL SELECT target, coalesce(strength, 0.5) FROM ends WHERE tier <> 'research_lead') GROUP BY id) d ON d.id = e.id
""",
    "zone_boxes": """
SELECT 'nation-' || n_nationkey AS zone, CAST(n_nationkey * 4000 AS DOUBLE) AS x, 0.0::DOUBLE AS y,
       CAST(30000 + n_nationkey * 500 AS DOUBLE) AS width, CAST(60 + n_nationkey * 40 AS DOUBLE) AS height FROM nation
UNION ALL SELECT 'guitar-workshop', 400000.0, 0.0, 250000.0, 200.0
""",
    "policies": """
SELECT 'region-' || n_regionkey AS policy, list_sort(list('nation-' || n_nationkey)) AS zones,
       ['genre-' || min(n_nationkey)] AS anchors, n_regionkey = 4 AS anchors_only FROM nation GROUP BY n_regionkey
""",
    "blocked": """
SELECT CASE WHEN s_suppkey % 7 = 0 THEN 'Band-' || s_suppkey ELSE 'none-' || s_suppkey END AS id,
       CASE WHEN s_suppkey % 11 = 0 THEN [s_name] ELSE CAST([] AS VARCHAR[]) END AS labels
FROM supplier WHERE s_suppkey % 7 = 0 OR s_suppkey % 11 = 0
""",
    "review_rows": """
SELECT 'cand-' || event_id AS id, 'run-' || (event_id // 50) AS run_id,
       'Customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS seed_name,
       CASE WHEN k % 2 = 0 THEN 'guitarist' ELSE 'artist' END AS requested_kind, status,
       CASE WHEN status = 'rejected' THEN CASE k % 7 WHEN 0 THEN 'duplicate' WHEN 1 THEN 'wrong_entity'
            WHEN 2 THEN 'not_relevant' WHEN 3 THEN 'out_of_scope' WHEN 4 THEN 'weak_connection' END END AS review_reason_code,
       CASE WHEN k % 13 = 0 THEN 'Existing node' ELSE '' END AS reason, ts AS updated_at, value > 80 AS identity_conflict,
       CASE WHEN k % 17 = 0 THEN 'typed_connection' ELSE 'package' END AS payload_kind, value, user_id
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
        CASE event_type WHEN 'purchase' THEN 'approved' WHEN 'signup' THEN 'imported' WHEN 'view' THEN 'review'
             ELSE 'rejected' END AS status FROM events)
""",
    "facts": f"""
SELECT 'fact-' || doc_id || '-' || pos AS id, 'artist-' || doc_id AS entity_id, sentence AS text,
       CASE WHEN pos % 4 = 0 THEN CAST(1750 + pos % 400 AS INTEGER) END AS year,
       ['music-history', 'scout-' || CASE pos % 3 WHEN 0 THEN 'name-origin' WHEN 1 THEN 'recording-story' ELSE 'cover-story' END] AS tags,
       CASE WHEN doc_id % 7 = 0 THEN [{{'label': 'Wikipedia', 'url': 'https://en.wikipedia.org/wiki/Doc_' || doc_id, 'provider': 'wikipedia'}}]
            WHEN doc_id % 2 = 0 THEN [{{'label': 'Site', 'url': 'https://' || source || '.example.org/d/' || doc_id, 'provider': 'other'}},
                 {{'label': 'Wikipedia', 'url': 'https://en.wikipedia.org/wiki/Doc_' || doc_id, 'provider': 'wikipedia'}}]
            ELSE [{{'label': 'Site', 'url': 'https://' || source || '.example.org/d/' || doc_id, 'provider': 'other'}}] END AS sources,
       CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'approved' ELSE 'review' END AS status,
       sha256('https://' || source || '.example.org/d/' || doc_id || chr(10) || lower(sentence)) AS source_fingerprint,
       doc_id, pos
FROM (SELECT doc_id, source, quality, toxic, unnest(parts) AS sentence, unnest(range(len(parts))) AS pos
      FROM (SELECT d.doc_id, d.source, l.quality, l.toxic, string_split_regex(d.text, '[.!?]\\s+') AS parts
            FROM documents d LEFT JOIN labels l USING (doc_id)))
""",
    "positions": """
SELECT 'before' AS mode, id, x, y FROM entities
UNION ALL SELECT 'after', id, x + s, y + s % 37 FROM (
  SELECT id, x, y, length(label) * 7 + CASE WHEN zone IN ('nation-3', 'nation-7') THEN 55 ELSE 0 END AS s FROM entities)
""",
    "placements": """
SELECT id AS node_id, CASE WHEN node_type = 'band' THEN 'musical_base' ELSE 'birthplace' END AS role,
       'place-' || n || '-' || (k % 4) AS place_id, 'City ' || n AS name, 'Country ' || (n % 5) AS country,
       (n * 7) % 120 - 60 + (k % 4) * 0.1::DOUBLE AS lat, (n * 13) % 340 - 170 + (k % 4) * 0.1::DOUBLE AS lon
FROM (SELECT id, node_type, CAST(regexp_extract(id, '([0-9]+)$', 1) AS BIGINT) AS k,
             CAST(regexp_extract(zone, '([0-9]+)$', 1) AS BIGINT) AS n FROM entities WHERE node_type IN ('artist', 'band'))
""",
}


def _pick(words, key: str) -> str:
    listed = ", ".join(f"'{word}'" for word in words)
    return f"([{listed}])[{key} % {len(words)} + 1]"


_PREFIXES = (
    "", "List of ", "Category:", "History of ", "1999 ", "The ", "Deep ", "Billboard ", "Rolling ", "Music of ", "rock ",
    "electric ",
)
_SUFFIXES = (
    "", " (band)", " album", " genres", " musicians", " by era", " media", " pages", " guitarist", " rock music", " singer",
    " guitar",
)
SQL_VIEWS["titles"] = f"""
SELECT 't-' || p_partkey AS id, {_pick(_PREFIXES, 'p_partkey')} || p_name || {_pick(_SUFFIXES, '(p_partkey // 12)')} AS title,
       {_pick(('genre', 'band', 'artist', 'guitarist', 'guitar', 'guitar_brand'), '(p_partkey // 5)')} AS kind,
       {_pick(('link', 'category', 'template', ''), '(p_partkey // 7)')} AS source, p_partkey AS key FROM part
"""
SQL_VIEWS["attempts"] = """
SELECT 'artist-' || user_id AS entity_id, ts AS attempted_at, CASE WHEN event_type = 'error' THEN 'source_error' ELSE 'no_match' END AS outcome FROM events
"""
SQL_VIEWS["lines6"] = """
SELECT l.*, o_custkey, l_linenumber % 6 AS turn FROM lineitem l JOIN orders ON o_orderkey = l_orderkey
"""
