"""Gates. Each returns violations as (rule, key, detail)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evigraph import vocab
from evigraph.functions.hashing import pair_key
from evigraph.functions.refs import has_url
from evigraph.functions.text import has_superlative, normalize_key
from evigraph.operators.evidence import map_connections
from evigraph.operators.graph import first_per_key, top_per_group
from evigraph.session import listed


def _rule(rule: str, condition: Column, detail: Column | str = "") -> Column:
    text = F.lit(detail) if isinstance(detail, str) else detail.cast("string")
    hit = F.struct(F.lit(rule).alias("rule"), F.coalesce(text, F.lit("")).alias("detail"))
    return F.when(F.coalesce(condition, F.lit(True)), hit)


def violations(rows: DataFrame, key: Column, rules: Sequence[Column]) -> DataFrame:
    """Every broken rule of every row in one pass; an unknown condition counts as broken."""
    exploded = rows.select(key.alias("key"), F.explode(F.array_compact(F.array(*rules))).alias("_hit"))
    return exploded.select("_hit.rule", "key", "_hit.detail")


def duplicates(rows: DataFrame, key: Column, rule: str) -> DataFrame:
    counted = rows.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return counted.select(F.lit(rule).alias("rule"), "key", F.col("_n").cast("string").alias("detail"))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _blocked(column: str, terms: Sequence[str]) -> Column:
    normalized = [term.lower().replace("_", " ").replace("-", " ").strip() for term in terms]
    return normalize_key(column).isin(*normalized) if normalized else F.lit(False)


def audit_nodes(nodes: DataFrame, blocked_terms: Sequence[str] = (), kinds: Sequence[str] = vocab.NODE_KINDS) -> DataFrame:
    found = violations(nodes, F.coalesce("id", F.lit("")), [
        _rule("missing_id", F.coalesce("id", F.lit("")) == "", F.col("label")),
        _rule("unsupported_kind", ~F.col("node_type").isin(*kinds), F.col("node_type")),
        _rule("blocked_entity", _blocked("id", blocked_terms) | _blocked("label", blocked_terms), F.col("label")),
        _rule("no_sources", F.coalesce(F.size("sources"), F.lit(0)) <= 0),
    ])
    return found.unionByName(duplicates(nodes, F.col("id"), "duplicate_id"))


def audit_edges(edges: DataFrame, nodes: DataFrame, blocked_terms: Sequence[str] = (),
                kinds: Sequence[str] = vocab.RELATION_TYPES) -> DataFrame:
    ids = nodes.select(F.col("id").alias("_id")).distinct().hint("shuffle_hash")

    def dangling(end: str) -> DataFrame:
        lost = edges.join(ids, F.col(end) == F.col("_id"), "left_anti")
        return lost.select(F.lit(f"missing_{end}").alias("rule"), F.col("id").alias("key"), F.col(end).alias("detail"))

    terms = [term.lower().replace("_", " ").replace("-", " ").strip() for term in blocked_terms]
    context = F.exists("context", lambda c: normalize_key(c).isin(*terms)) if terms else F.lit(False)
    ends = _blocked("source", blocked_terms) | _blocked("target", blocked_terms) | _blocked("label", blocked_terms)
    found = violations(edges, F.col("id"), [
        _rule("unsupported_type", ~F.col("type").isin(*kinds), F.col("type")),
        _rule("blocked_edge", ends),
        _rule("blocked_context", F.coalesce(context, F.lit(False))),
    ])
    return union_all([dangling("source"), dangling("target"), found])


def table_constraints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Slugs, kinds, ranges, self relations and the four-column key of relations."""
    node_rules = violations(nodes, F.col("id"), [
        _rule("id_not_slug", ~F.col("id").rlike(vocab.SLUG)),
        _rule("kind_unknown", ~F.col("node_type").isin(*vocab.NODE_KINDS), F.col("node_type")),
        _rule("year_range", F.col("era_start").isNotNull() & ~F.col("era_start").between(1400, 2100), F.col("era_start")),
    ])
    edge_rules = violations(edges, F.col("id"), [
        _rule("strength_range", F.col("strength").isNull() | ~F.col("strength").between(0, 1), F.col("strength")),
        _rule("self_relation", F.col("source") == F.col("target"), F.col("source")),
    ])
    key = F.concat_ws("|", "source", "target", "type", "label")
    return union_all([node_rules, edge_rules, duplicates(edges, key, "relation_key")])


def request_rules(requests: DataFrame) -> DataFrame:
    """Request ids, and names and kinds of their seeds."""
    head = violations(requests, F.coalesce("id", F.lit("")), [
        _rule("request_id", ~F.coalesce("id", F.lit("")).rlike(vocab.SLUG)),
        _rule("no_seeds", F.coalesce(F.size("seeds"), F.lit(0)) <= 0),
    ])
    seeds = requests.select("id", F.posexplode("seeds").alias("pos", "seed"))
    body = violations(seeds, F.concat_ws("#", "id", F.col("pos") + 1), [
        _rule("seed_name", F.coalesce("seed.name", F.lit("")) == ""),
        _rule("seed_kind", ~F.coalesce("seed.kind", F.lit("")).isin(*vocab.NODE_KINDS), F.col("seed.kind")),
    ])
    return head.unionByName(body)


def _https(s: Column) -> Column:
    return F.coalesce(s["url"], F.lit("")).rlike(r"^https://[^\s/]+")


def curated_fact_rules(facts: DataFrame, nodes: DataFrame, per_entity: int = 2) -> DataFrame:
    """Rules of hand-written facts: known entity, length, year, tags, date and direct sources."""
    ids = nodes.where(F.col("node_type").isin(*vocab.NODE_KINDS)).select(F.col("id").alias("_node")).distinct()
    joined = facts.join(ids, F.col("entity_id") == F.col("_node"), "left")
    urls = F.transform("sources", lambda s: s["url"])
    tags_ok = F.size("tags").between(1, 5) & F.forall("tags", lambda t: t.rlike(vocab.SLUG))
    date_ok = F.col("verified_at").rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date("verified_at").isNotNull()
    found = violations(joined, F.col("id"), [
        _rule("id_not_slug", ~F.col("id").rlike(vocab.SLUG)),
        _rule("unknown_entity", F.col("_node").isNull(), F.col("entity_id")),
        _rule("text_length", ~F.length("text").between(35, 200), F.length("text")),
        _rule("year_range", F.col("year").isNotNull() & ~F.col("year").between(1800, 2100), F.col("year")),
        _rule("tags", ~tags_ok),
        _rule("verified_at", ~date_ok, F.col("verified_at")),
        _rule("no_source", F.coalesce(F.size("sources"), F.lit(0)) <= 0),
        _rule("source_label", F.exists("sources", lambda s: F.trim(F.coalesce(s["label"], F.lit(""))) == "")),
        _rule("source_url", F.exists("sources", lambda s: ~_https(s))),
        _rule("source_repeated", F.size(F.array_distinct(urls)) < F.size(urls)),
        _rule("superlative", has_superlative("text") & (F.size("sources") < 2)),
    ])
    return union_all([found, duplicates(facts, F.col("id"), "duplicate_id"), over_cap(facts, per_entity)])


def over_cap(facts: DataFrame, cap: int) -> DataFrame:
    """Facts beyond the cap of their entity, counted in order of id: all but the top `cap`, which are found per task first."""
    rows = facts.where(F.col("entity_id").isNotNull()).groupBy("entity_id", "id").agg(F.count(F.lit(1)).alias("_n"))
    first = top_per_group(rows, ["entity_id"], [F.asc("id")], cap)  # at most `cap` rows of an entity from here
    before = Window.partitionBy("entity_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    room = F.greatest(F.lit(0), F.least(F.col("_n"), F.lit(cap) - F.coalesce(F.sum("_n").over(before), F.lit(0))))
    within = first.select(F.col("entity_id").alias("_e"), F.col("id").alias("_i"), room.alias("_room"))
    counted = rows.join(within, (F.col("entity_id") == F.col("_e")) & F.col("id").eqNullSafe(F.col("_i")), "left")
    extra = counted.withColumn("_extra", F.col("_n") - F.coalesce("_room", F.lit(0))).where(F.col("_extra") > 0)
    return extra.select(
        F.lit("entity_cap").alias("rule"), F.col("id").alias("key"), F.col("entity_id").alias("detail"), F.explode(F.sequence(F.lit(1), "_extra")).alias("_")
    ).drop("_")


def fact_rules(facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Row gate of stored facts: kind, tag count, sources, superlatives, and an independent source on approval."""
    ids = nodes.where(F.col("node_type").isin(*vocab.NODE_KINDS)).select(F.col("id").alias("_node")).distinct()
    joined = facts.join(ids, F.col("entity_id") == F.col("_node"), "left")
    independent = F.exists("sources", lambda s: ~s["url"].rlike(r"(?i)^https://([a-z0-9-]+\.)*wikipedia\.org/"))
    bad = F.exists(
        "sources", lambda s: (F.trim(F.coalesce(s["label"], F.lit(""))) == "") | ~F.coalesce(s["url"], F.lit("")).rlike(r"^https://[^ ]+$")
    )
    return violations(joined, F.col("id"), [
        _rule("unknown_entity", F.col("_node").isNull(), F.col("entity_id")),
        _rule("tag_count", ~F.size("tags").between(1, 5), F.size("tags")),
        _rule("source", bad),
        _rule("superlative", has_superlative("text") & (F.size("sources") < 2)),
        _rule("not_independent", (F.col("status") == "approved") & ~independent),
    ])


def constraint_rules(constraints: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Near pairs need a sourced connection between the same nodes, apart pairs are bounded; no contradictions.

    Constraints travel to their evidence, as hashes and the rules that they break by themselves, and not to their nodes: what is looked up are the ends
    that no node has. A constraint whose evidence is there several times counts as often.
    """
    def name(column: str) -> list[Column]:
        return [F.xxhash64(column), F.when(F.col(column).isNotNull(), F.hash(column))]  # null meets nothing

    ends = constraints.select(F.explode(F.array("source", "target")).alias("_end")).where(F.col("_end").isNotNull()).distinct()
    lost = listed(ends.join(nodes.select(F.col("id").alias("_id")).distinct(), F.col("_end") == F.col("_id"), "left_anti"))
    connections = map_connections(edges).where(has_url(F.col("sources")) & F.col("id").isNotNull())
    sourced = connections.select(*[part.alias(f"_e{k}") for k, part in enumerate(name("id"))], F.xxhash64(pair_key(F.col("source"), F.col("target"))).alias("_edge_pair"))
    several = listed(sourced.groupBy("_e0", "_e1").agg(F.count(F.lit(1)).alias("_times")).where("_times > 1"))

    marked = constraints.withColumn("pair", pair_key(F.col("source"), F.col("target")))
    near, apart = F.col("kind") == "near", F.col("kind") == "apart"
    apart_bad = (
        ~F.coalesce(F.col("display_only"), F.lit(False)) | ~F.coalesce(F.col("min_distance").between(120, 500), F.lit(False))
        | F.col("evidence_edge_id").isNotNull()
    )
    for end in ("source", "target"):
        marked = marked.join(lost.withColumnRenamed("_end", f"_no_{end}"), F.col(end) == F.col(f"_no_{end}"), "left")
    known = F.col("_no_source").isNull() & F.col("_no_target").isNull() & (F.col("source") != F.col("target"))
    own = [
        _rule("ends", ~known),
        _rule("kind", ~(near | apart), F.col("kind")),
        _rule("reason", F.length(F.trim(F.coalesce("reason", F.lit("")))) < 20),
        _rule("apart_bounds", apart & apart_bad),
    ]
    evidence = name("evidence_edge_id")
    key = [F.xxhash64(F.coalesce("evidence_edge_id", "id")), evidence[1]]  # rows without evidence are dealt by their own ids
    slim = marked.select(
        "id", *[part.alias(f"_e{k}") for k, part in enumerate(key)], F.xxhash64("pair").alias("_pair"), near.alias("_near"),
        F.coalesce(F.col("max_distance").between(180, 1800), F.lit(False)).alias("_within"), F.array_compact(F.array(*own)).alias("_own"),
    )
    joined = slim.join(sourced, ["_e0", "_e1"], "left")
    near_bad = ~F.col("_within") | ~F.coalesce(F.col("_edge_pair") == F.col("_pair"), F.lit(False))
    hits = F.concat("_own", F.array_compact(F.array(_rule("near_evidence", F.col("_near") & near_bad))))
    found = joined.select(F.col("id").alias("key"), F.explode(hits).alias("_hit")).select("_hit.rule", "key", "_hit.detail")

    counted = constraints.select("*", pair_key(F.col("source"), F.col("target")).alias("pair"), *[part.alias(f"_e{k}") for k, part in enumerate(evidence)])
    times = F.coalesce("_times", F.lit(1))
    pairs = counted.join(several, ["_e0", "_e1"], "left").groupBy("pair").agg(
        F.sum(F.when(near, times).otherwise(0)).alias("_near"), F.sum(F.when(apart, times).otherwise(0)).alias("_apart"),
        F.min(F.when(near, F.col("max_distance"))).alias("_max"), F.max(F.when(apart, F.col("min_distance"))).alias("_min"),
    )
    clash = violations(pairs, F.col("pair"), [
        _rule("pair_repeated", (F.col("_near") > 1) | (F.col("_apart") > 1)),
        _rule("pair_conflict", F.coalesce(F.col("_min") >= F.col("_max"), F.lit(False))),
    ])
    return union_all([found, duplicates(constraints, F.col("id"), "duplicate_id"), clash])


def batch_completeness(reviewed_ids: DataFrame, rows: DataFrame, zones: Sequence[str]) -> DataFrame:
    """A reviewed batch: ids unique and present, allowed zone, at least one source."""
    found = rows.select(F.col("id").alias("_id"), "zone", "sources")
    joined = reviewed_ids.join(found, F.col("id") == F.col("_id"), "left")
    present = F.col("_id").isNotNull()
    rules = violations(joined, F.col("id"), [
        _rule("absent", ~present),
        _rule("zone", present & ~F.coalesce("zone", F.lit("")).isin(*zones), F.col("zone")),
        _rule("no_sources", present & (F.coalesce(F.size("sources"), F.lit(0)) <= 0)),
    ])
    return rules.unionByName(duplicates(reviewed_ids, F.col("id"), "duplicate_id"))


def batch_edges(edges: DataFrame, nodes: DataFrame, prefix: str, expected: int) -> DataFrame:
    """The edges of a reviewed batch: as many as expected, ids unique, both ends known, context and sources given."""
    rows = edges.where(F.startswith("id", F.lit(prefix)))
    ids = nodes.select(F.col("id").alias("_node")).distinct()
    ends = rows.select("id", F.explode(F.array("source", "target")).alias("_end"))
    lost = ends.join(ids, F.col("_end") == F.col("_node"), "left_anti").select(F.lit("unknown_end").alias("rule"), F.col("id").alias("key"), F.col("_end").alias("detail"))
    rules = violations(rows, F.col("id"), [
        _rule("no_context", F.coalesce(F.size("context"), F.lit(0)) <= 0),
        _rule("no_sources", F.coalesce(F.size("sources"), F.lit(0)) <= 0),
    ])
    count = rows.agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") != expected)
    count = count.select(F.lit("edge_count").alias("rule"), F.lit(prefix).alias("key"), F.col("_n").cast("string").alias("detail"))
    return rules.unionByName(duplicates(rows, F.col("id"), "duplicate_id")).unionByName(lost).unionByName(count)


def early_pool_issues(pool: DataFrame) -> DataFrame:
    """Plausibility issues of early performers: role, ages and identity signals."""
    issue = lambda condition, text: F.when(F.coalesce(condition, F.lit(False)), F.lit(text))
    start, birth, death = F.col("start_year"), F.col("birth_year"), F.col("death_year")
    issues = F.array_compact(F.array(
        issue(~F.coalesce("description", F.lit("")).rlike(vocab.EARLY_ROLE), "music identity not clear in description"),
        issue(start < birth + 8, "work start predates plausible career age"),
        issue(start > birth + 85, "work start implausibly late"),
        issue(start > death, "work start follows death"),
        issue(F.col("catalogue_id").isNull() & (F.col("sitelinks") < 8), "limited independent identity signals"),
    ))
    return pool.withColumn("issues", issues)


def metric_mismatches(claimed: DataFrame, measured: DataFrame) -> DataFrame:
    """Metrics of an uploaded report that differ from the ones measured again; both are (metric, value)."""
    joined = claimed.join(measured.withColumnRenamed("value", "_measured"), "metric", "left")
    differs = F.col("_measured").isNull() | (F.col("value") != F.col("_measured"))
    return joined.where(differs).select(
        F.lit("metric_differs").alias("rule"), F.col("metric").alias("key"), F.col("_measured").cast("string").alias("detail")
    )


def missing_columns(df: DataFrame, expected: StructType) -> list[str]:
    """Names the frame lacks; checked before any write, without running a job."""
    present = set(df.columns)
    return [field.name for field in expected.fields if field.name not in present]


def first_wins(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return first_per_key(rows, key, order)

