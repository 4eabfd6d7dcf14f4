"""Building one graph from several sources: union, de-duplication, overrides, corrections and derived relations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph import vocab
from evigraph.functions import refs
from evigraph.functions.hashing import edge_key, pair_key, row_hash
from evigraph.functions.text import merge_unique, normalize_key
from evigraph.operators.evidence import induced_edges
from evigraph.operators.graph import first_per_key
from evigraph.session import lookup


def _tie(df: DataFrame) -> Column:
    """Ends an order: rows that are equal in all that is compared before differ in no column, or by digest."""
    return row_hash(*[F.col(name) for name in sorted(df.columns)])


def _ranked_union(parts: Sequence[tuple[int, DataFrame]]) -> DataFrame:
    frames = [df.withColumn("_priority", F.lit(priority)) for priority, df in parts]
    union = frames[0]
    for frame in frames[1:]:
        union = union.unionByName(frame, allowMissingColumns=True)
    return union


def assemble_nodes(
    base: DataFrame, promoted: DataFrame, curated: DataFrame, blocked_terms: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Nodes of all sources, first source wins, and the curated rows that clash with an existing id.

    Base and promoted rows need a known kind; promoted rows must also be free of blocked ids and labels.
    """
    terms = [term.lower().replace("_", " ").replace("-", " ").strip() for term in blocked_terms]
    known = F.col("node_type").isin(*vocab.NODE_KINDS)
    free = ~(normalize_key("id").isin(*terms) | normalize_key("label").isin(*terms)) if terms else F.lit(True)
    parts = [(0, base.where(known)), (1, promoted.where(known & free & (F.col("id") != ""))), (2, curated)]
    union = _ranked_union(parts)
    nodes = first_per_key(union, ["id"], [F.asc("_priority"), F.asc("label"), _tie(union)]).drop("_priority")
    earlier = parts[0][1].select("id").union(parts[1][1].select("id"))
    clashes = curated.join(earlier.select(F.col("id").alias("_id")).distinct(), F.col("id") == F.col("_id"), "left_semi")
    return nodes, clashes.select(F.lit("curated_exists").alias("rule"), F.col("id").alias("key"), F.col("label").alias("detail"))


def assemble_edges(parts: Sequence[DataFrame], nodes: DataFrame, blocked_terms: Sequence[str] = ()) -> DataFrame:
    """Relations of all sources between known nodes; the first per id and per (source, target, type, label) stays.

    Of rows with one id the order is: source of the rows, key, strength, year (each ascending, missing first), hash of the row (64 bits).
    """
    terms = [term.lower().replace("_", " ").replace("-", " ").strip() for term in blocked_terms]
    union = _ranked_union(list(enumerate(parts)))
    if terms:
        hit = F.exists("context", lambda c: normalize_key(c).isin(*terms))
        for name in ("id", "source", "target", "label"):
            hit = hit | normalize_key(name).isin(*terms)
        union = union.where(~F.coalesce(hit, F.lit(False)))
    # A number stands for the whole row in the order from the start, so that columns no one reads do not travel.
    text = F.to_json(F.struct(*sorted(union.columns)), {"ignoreNullFields": "false"})
    keyed = induced_edges(union.withColumn("_tie", F.xxhash64(text)), nodes, mostly_known=True).withColumn(
        "_key", edge_key(F.col("source"), F.col("target"), F.col("type"), F.col("label"))
    )
    order = [F.asc("_priority"), F.asc("_key"), F.asc("strength"), F.asc("year"), F.asc("_tie")]
    by_id = first_per_key(keyed, ["id"], order)
    by_key = first_per_key(by_id, ["_key"], [F.asc("_priority"), F.asc("id")])
    return by_key.withColumn("strength", F.coalesce("strength", F.lit(0.5))).drop("_priority", "_key", "_tie")


def apply_overrides(nodes: DataFrame, overrides: DataFrame) -> DataFrame:
    """Non-empty override fields replace, role lists replace, alias lists merge without repeats."""
    other = overrides.select([F.col(name).alias(f"_o_{name}") for name in overrides.columns])
    joined = nodes.join(other, F.col("id") == F.col("_o_id"), "left")
    allowed = F.col("_o_node_type").isin(*vocab.NODE_KINDS)
    roles = F.when(F.size("_o_roles") > 0, F.col("_o_roles")).otherwise(F.col("roles"))
    aliases = F.when(F.size("_o_aliases") > 0, merge_unique(F.col("aliases"), F.col("_o_aliases"))).otherwise(F.col("aliases"))
    return (
        joined.withColumn("label", F.coalesce(F.nullif(F.col("_o_label"), F.lit("")), "label"))
        .withColumn("node_type", F.when(allowed, F.col("_o_node_type")).otherwise(F.col("node_type")))
        .withColumn("zone", F.coalesce(F.nullif(F.col("_o_zone"), F.lit("")), "zone"))
        .withColumn("roles", roles)
        .withColumn("aliases", aliases)
        .withColumn("starter", F.coalesce("_o_starter", "starter"))
        .withColumn("era_start", F.coalesce("_o_era_start", "era_start"))
        .select(nodes.columns)
    )


def apply_corrections(nodes: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Start years with their sources, and a violation for each missing target, wrong kind or conflicting year."""
    other = corrections.select([F.col(name).alias(f"_c_{name}") for name in corrections.columns])
    joined = nodes.join(other, F.col("id") == F.col("_c_id"), "left")
    conflict = (F.col("node_type") != F.col("_c_node_type")) | (
        F.col("era_start").isNotNull() & (F.col("era_start") != F.col("_c_era_start"))
    )
    good = F.col("_c_id").isNotNull() & ~F.coalesce(conflict, F.lit(False))
    sources = F.when(good, refs.merge_sources(F.col("sources"), F.col("_c_sources"))).otherwise(F.col("sources"))
    fixed = joined.withColumn("sources", sources).withColumn(
        "era_start", F.when(good, F.col("_c_era_start")).otherwise(F.col("era_start"))
    ).select(nodes.columns)
    target = nodes.select(F.col("id").alias("_id"), F.col("node_type").alias("_type"), F.col("era_start").alias("_year"))
    checked = corrections.join(target, F.col("id") == F.col("_id"), "left")
    rule = (
        F.when(F.col("_id").isNull(), "missing_target")
        .when(F.col("_type") != F.col("node_type"), "wrong_kind")
        .when(F.col("_year").isNotNull() & (F.col("_year") != F.col("era_start")), "conflicting_year")
    )
    issues = checked.select(rule.alias("rule"), F.col("id").alias("key"), F.col("era_start").cast("string").alias("detail"))
    return fixed, issues.where(F.col("rule").isNotNull())


def co_occurrence(members: DataFrame, block: int = 256) -> DataFrame:
    """Collaborations between every two members of one release: release_id, member -> one row per pair and release.

    The pairs themselves are the result. The members of a release are dealt into blocks of about `block`, as many as its measured
    size asks for, and a tile of two blocks makes its pairs: a small release is one tile and no member is copied, a huge one
    is many tiles of `block` squared pairs.
    """
    distinct = members.select("release_id", "member").distinct()
    sizes = distinct.groupBy("release_id").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).alias("_blocks"))
    dealt = lookup(distinct, sizes.withColumnRenamed("release_id", "_release"), "release_id", "_release").drop("_release")
    dealt = dealt.withColumn("_block", F.pmod(F.xxhash64("member"), F.col("_blocks")))
    left = dealt.select("release_id", F.col("member").alias("_one"), F.col("_block").alias("_i"), F.explode(F.sequence("_block", F.col("_blocks") - 1)).alias("_j"))
    right = dealt.select("release_id", F.col("member").alias("_two"), F.explode(F.sequence(F.lit(0).cast("bigint"), "_block")).alias("_i"), F.col("_block").alias("_j"))
    pairs = left.join(right, ["release_id", "_i", "_j"]).where(F.when(F.col("_i") == F.col("_j"), F.col("_one") < F.col("_two")).otherwise(F.lit(True)))
    pairs = pairs.withColumn("source", F.least("_one", "_two")).withColumn("target", F.greatest("_one", "_two"))
    return pairs.select(
        F.concat_ws("-", F.lit("release"), "release_id", "source", "target").alias("id"), "source", "target",
        F.lit("collaboration").alias("type"), F.lit("recorded together").alias("label"), F.lit(0.72).alias("strength"),
        "release_id",
    )


def overlay_live(baseline: DataFrame, live: DataFrame) -> DataFrame:
    """Live rows over a baseline: missing years fall back, evidence only when the year does not disagree."""
    old = baseline.select(
        F.col("id").alias("_b"), F.col("era_start").alias("_b_year"), F.col("evidence").alias("_b_evidence")
    )
    joined = live.join(old, F.col("id") == F.col("_b"), "left")
    inherit = F.col("era_start").isNull() | (F.col("era_start") == F.col("_b_year"))
    evidence = F.coalesce("evidence", F.when(inherit, F.col("_b_evidence")))
    return (
        joined.withColumn("evidence", evidence).withColumn("era_start", F.coalesce("era_start", "_b_year")).select(live.columns)
    )


def overlay_positions(saved: DataFrame, live: DataFrame) -> DataFrame:
    """Live x, y and zone over a saved layout; new nodes are added."""
    fresh = live.select(F.col("id").alias("_id"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("zone").alias("_zone"))
    return saved.join(fresh, F.col("id") == F.col("_id"), "full").select(
        F.coalesce("id", "_id").alias("id"), F.coalesce("_x", "x").alias("x"), F.coalesce("_y", "y").alias("y"),
        F.coalesce("_zone", "zone").alias("zone"),
    )


def edge_keys(edges: DataFrame) -> DataFrame:
    """Directed and unordered keys of relations."""
    return edges.select(
        "id", edge_key(F.col("source"), F.col("target"), F.col("type"), F.col("label")).alias("directed"),
        pair_key(F.col("source"), F.col("target")).alias("unordered"),
    )


def recordings_to_graph(catalogue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Catalogue tuples (group_id, group_label, zone, members) to member nodes and `member_of` relations."""
    exploded = catalogue.select("group_id", "group_label", "zone", F.explode("members").alias("member"))
    groups = catalogue.select(
        F.col("group_id").alias("id"), F.col("group_label").alias("label"), F.lit("band").alias("node_type"), "zone"
    )
    people = exploded.groupBy("member").agg(F.min("zone").alias("zone")).select(
        F.concat(F.lit("member-"), "member").alias("id"), F.col("member").alias("label"),
        F.lit("artist").alias("node_type"), "zone",
    )
    source = F.concat(F.lit("member-"), "member")
    edges = exploded.select(
        F.concat_ws("-", F.lit("member"), "member", "group_id").alias("id"), source.alias("source"),
        F.col("group_id").alias("target"), F.lit("member_of").alias("type"), F.lit("Member of").alias("label"),
    ).distinct()
    return groups.unionByName(people), edges
