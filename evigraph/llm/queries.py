"""The registered queries of the operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evigraph.llm import centroids, conversations, decontam, jaccard, language, licenses, packing, pages, pii, quality, secrets, syncmers, token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _query(name: str, sql: str | None = None):
    def register(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT c.a, c.b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL) c
  JOIN n p ON p.doc_id = c.a JOIN n q ON q.doc_id = c.b WHERE 100 * c.both >= 75 * (p.n + q.n - c.both)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
smallest AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM smallest LEFT JOIN n USING (doc_id)
"""


@_query("op1_jaccard_join", OP1_SQL)
def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_documents(spark, sf_dir))


@_query("op2_language_filters")
def op2_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.held_out_predictions(_documents(spark, sf_dir))


def _op3_sql() -> str:
    """Exact containment of each template in every window of twice its words."""
    values = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in licenses.LICENSES)
    split = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""
    return f"""
WITH t AS (SELECT template_id, {split} AS w FROM (VALUES {values}) v(template_id, text)),
ts AS (SELECT DISTINCT template_id, len(w) AS n, array_to_string(w[i:i + 4], ' ') AS shingle FROM t, unnest(range(1, len(w) - 3)) u(i)),
tn AS (SELECT template_id, n, count(*) AS every FROM ts GROUP BY ALL),
d AS (SELECT row_number() OVER () AS row, doc_id, {split} AS w FROM documents),
ds AS (SELECT row, i - 1 AS place, array_to_string(w[i:i + 4], ' ') AS shingle FROM d, unnest(range(1, len(w) - 3)) u(i)),
hit AS (SELECT row, template_id, n, place, shingle FROM ds JOIN ts USING (shingle)),
win AS (SELECT row, template_id, n, shingle, unnest(range(greatest(0, CAST(ceil((place + 5 - 2 * n) / n) AS BIGINT)), place // n + 1)) AS win FROM hit),
held AS (SELECT row, template_id, n, win, count(DISTINCT shingle) AS shared FROM win GROUP BY ALL),
best AS (SELECT row, template_id, max(shared / every) AS containment FROM held JOIN tn USING (template_id, n) WHERE shared >= ceil(0.75 * every - 1e-9) GROUP BY ALL),
listed AS (SELECT row, count(*) AS n_licenses, string_agg(template_id, ',' ORDER BY template_id) AS licenses, max(containment) AS containment FROM best GROUP BY row)
SELECT doc_id, coalesce(n_licenses, 0) AS n_licenses, coalesce(licenses, '') AS licenses, coalesce(containment, 0.0::DOUBLE) AS containment FROM d LEFT JOIN listed USING (row)
"""


@_query("op3_license_scans", _op3_sql())
def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digest(_documents(spark, sf_dir), licenses.license_templates(spark))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS win, len(w[i:i + 9]) AS n
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens)),
hit AS (SELECT DISTINCT doc_id, s, n, win FROM dw SEMI JOIN bw USING (win)),
pos AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit)),
words_hit AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit JOIN bw USING (win)) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words_hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@_query("op4_decontamination", OP4_SQL)
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination_digest(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_query("op5_quality")
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_query("op7_closed_syncmers")
def op7_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edited_fingerprints(_documents(spark, sf_dir))


@_query("op6_token_files")
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digest(_documents(spark, sf_dir))


@_query("op9_best_fit_packing")
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir))


@_query("op8_personal_data")
def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_documents(spark, sf_dir))


@_query("op10_secret_spans")
def op10_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(_documents(spark, sf_dir))


def _op11_sql(k: int = 8, rounds: int = 10) -> str:
    """The rounds written out, each as one table of assignments and one of centroids."""
    nearest = """
a{r} AS MATERIALIZED (
  SELECT row, vec_id, arg_min(c, (d, c)) AS c, min(d) AS d
  FROM (SELECT v.row, v.vec_id, c.c, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN c{r} c USING (pos) GROUP BY ALL) GROUP BY row, vec_id)"""
    update = """
c{n} AS MATERIALIZED (
  SELECT c.c, c.pos, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, c.x) AS x
  FROM c{r} c LEFT JOIN (SELECT a.c, v.pos, sum(v.x) AS s, count(*) AS n FROM v JOIN a{r} a USING (row) GROUP BY ALL) m USING (c, pos))"""
    steps = [nearest.format(r=r) + "," + update.format(r=r, n=r + 1) for r in range(rounds)] + [nearest.format(r=rounds)]
    return f"""
WITH e AS (
  SELECT row_number() OVER () AS row, vec_id, embedding FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
v AS MATERIALIZED (
  SELECT row, vec_id, pos, CAST(floor(CAST(embedding[pos] AS DOUBLE) * 1024) AS HUGEINT) AS x
  FROM (SELECT row, vec_id, embedding, unnest(range(1, 65)) AS pos FROM e)),
s AS (SELECT row, row_number() OVER (ORDER BY sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), ''))) - 1 AS c FROM e QUALIFY c < {k}),
c0 AS MATERIALIZED (SELECT c, pos, x FROM v JOIN s USING (row)),{",".join(steps)}
SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance,
  CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
  sha256(t.text) AS centroid_sha256, count(*) OVER (PARTITION BY a.c) AS n_cluster
FROM a{rounds} a JOIN (SELECT c, string_agg(CAST(x AS VARCHAR), ',' ORDER BY pos) AS text FROM c{rounds} GROUP BY c) t USING (c)
"""


@_query("op11_centroid_clusters", _op11_sql())
def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


# Forwards over whole edit scripts instead of backwards over costs: w0 to w3 are the cheapest (cost, audit, lines) for each state of the grammar.
OP12_SQL = r"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_transform(range(1, length(key) + 1), lambda i: CAST(ascii(key[i]) AS BIGINT)), lambda acc, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7],
      lambda x, n: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(acc, b)), 4294967295), 4294967295) % 20 AS case_no
  FROM (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations)),
d AS (
  SELECT conv_id, turn, CASE WHEN case_no = 4 THEN 'user' ELSE role END AS role,
    CASE case_no WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN case_no = 3 THEN 2 ELSE 1 END))
  FROM k WHERE case_no <> 0),
o AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n, left(role, 1) AS r, lag(left(role, 1)) OVER w AS before,
    right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS tail
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text))),
f AS (
  SELECT *, CASE WHEN tail = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN tail NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM o),
steps AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, n, {'c': CAST(0 AS BIGINT), 'a': '', 't': ''} AS w0, {'c': CAST(1000000000000 AS BIGINT), 'a': '', 't': ''} AS w1,
    {'c': CAST(1000000000000 AS BIGINT), 'a': '', 't': ''} AS w2, {'c': CAST(1000000000000 AS BIGINT), 'a': '', 't': ''} AS w3
  FROM f WHERE i = 1
  UNION ALL
  SELECT conv_id, i, n, {'c': w0.c + 2, 'a': w0.a || 'D', 't': w0.t},
    list_min([{'c': w1.c + 2, 'a': w1.a || 'D', 't': w1.t},
      {'c': w0.c + dear + if(r = 's', late, 1000000000000), 'a': w0.a || 'K', 't': w0.t || line}]),
    list_min([{'c': u.c + 2, 'a': u.a || 'D', 't': u.t},
      {'c': w0.c + dear + if(r = 'u', late, 1000000000000), 'a': w0.a || 'K', 't': w0.t || line}, {'c': w0.c + 1 + dear + late, 'a': w0.a || 'R', 't': w0.t || asked},
      {'c': w1.c + dear + if(r = 'u', late, 1000000000000), 'a': w1.a || 'K', 't': w1.t || line}, {'c': w1.c + 1 + dear + late, 'a': w1.a || 'R', 't': w1.t || asked},
      {'c': a.c + dear + if(r = 'u', late, 1000000000000), 'a': a.a || 'K', 't': a.t || line}, {'c': a.c + 1 + dear + late, 'a': a.a || 'R', 't': a.t || asked}]),
    list_min([{'c': a.c + 2, 'a': a.a || 'D', 't': a.t},
      {'c': u.c + dear + if(r = 'a', late, 1000000000000), 'a': u.a || 'K', 't': u.t || line}, {'c': u.c + 1 + dear + late, 'a': u.a || 'R', 't': u.t || said}])
  FROM (
    SELECT *, list_min([w3, {'c': u.c + 5, 'a': u.a || 'I', 't': u.t || chr(10) || 'assistant:'}]) AS a
    FROM (
      SELECT s.conv_id, f.i, s.n, w0, w1, w3, f.r, if(f.fault IN ('blank', 'duplicate'), 1000000000000, 0) AS dear, if(f.fault = 'truncated', 5, 0) AS late,
        chr(10) || f.role || ':' || f.text AS line, chr(10) || 'user:' || f.text AS asked, chr(10) || 'assistant:' || f.text AS said,
        list_min([w2, {'c': w0.c + 5, 'a': w0.a || 'I', 't': w0.t || chr(10) || 'user:'}, {'c': w1.c + 5, 'a': w1.a || 'I', 't': w1.t || chr(10) || 'user:'},
          {'c': w3.c + 5, 'a': w3.a || 'I', 't': w3.t || chr(10) || 'user:'}]) AS u
      FROM steps s JOIN f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i + 1))),
ends AS (
  SELECT conv_id, list_min([w0, w3, {'c': w2.c + 5, 'a': w2.a || 'I', 't': w2.t || chr(10) || 'assistant:'},
    {'c': w0.c + 10, 'a': w0.a || 'II', 't': w0.t || chr(10) || 'user:' || chr(10) || 'assistant:'}, {'c': w1.c + 10, 'a': w1.a || 'II', 't': w1.t || chr(10) || 'user:' || chr(10) || 'assistant:'}]) AS e
  FROM steps WHERE i = n),
m AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || r NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n_rows
  FROM f GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(e.c, 0) AS cost, coalesce(e.a, '') AS audit, sha256(coalesce(substr(e.t, 2), '')) AS repaired_sha256, coalesce(n_rows, 0) AS n_rows
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN m ON m.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM c.conv_id
"""


@_query("op12_conversation_repair", OP12_SQL)
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.damage_and_repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@_query("op13_main_text")
def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
