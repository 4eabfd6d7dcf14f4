"""Evidence tiers of relations, blocklists, kinds and simple visibility filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph import vocab
from evigraph.functions import refs, text
from evigraph.session import listed


def evidence_tier(label: Column, context: Column, sources: Column) -> Column:
    """research_lead for machine signals, source_linked with any address, else curated_unsourced."""
    signal = F.trim(F.coalesce(label, F.lit(""))).rlike(vocab.SIGNAL_LABEL)
    hinted = F.coalesce(F.exists(context, lambda item: F.trim(item).rlike(vocab.SIGNAL_CONTEXT)), F.lit(False))
    return (
        F.when(signal | hinted, F.lit("research_lead"))
        .when(refs.has_url(sources), F.lit("source_linked"))
        .otherwise(F.lit("curated_unsourced"))
    )


def with_tier(edges: DataFrame) -> DataFrame:
    return edges.withColumn("tier", evidence_tier(F.col("label"), F.col("context"), F.col("sources")))


def map_connections(edges: DataFrame) -> DataFrame:
    """Relations that count as connections: everything but research leads."""
    return edges.where(evidence_tier(F.col("label"), F.col("context"), F.col("sources")) != "research_lead")


def tier_counts(edges: DataFrame) -> DataFrame:
    return with_tier(edges).groupBy("tier").agg(F.count(F.lit(1)).alias("relations"))


def count_by(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    """Row counts per key with missing keys under `unknown`."""
    return df.groupBy(F.coalesce(F.col(key), F.lit("unknown")).alias(key)).agg(F.count(F.lit(1)).alias(name))


def of_mode(nodes: DataFrame, mode: str) -> DataFrame:
    return nodes.where(F.col("node_type").isin(*vocab.MODE_KINDS[mode]))


def induced_edges(edges: DataFrame, nodes: DataFrame, mostly_known: bool = False) -> DataFrame:
    """Relations with both ends in the node set; tasks hash their share of the ids, the relations are not sorted.

    Where relations are wide and most ends are nodes (`mostly_known`), the ends that are none are listed first, and the relations are not dealt by their ends.
    """
    if mostly_known:
        ends = edges.select(F.explode(F.array("source", "target")).alias("_end")).where(F.col("_end").isNotNull()).distinct()
        lost = listed(ends.join(nodes.select(F.col("id").alias("_known")), F.col("_end") == F.col("_known"), "left_anti"))
        whole = edges.where(F.col("source").isNotNull() & F.col("target").isNotNull())
        return whole.join(lost, F.col("source") == F.col("_end"), "left_anti").join(lost, F.col("target") == F.col("_end"), "left_anti")
    ids = nodes.select(F.col("id").alias("_known")).hint("shuffle_hash")
    first = edges.join(ids, F.col("source") == F.col("_known"), "left_semi")
    return first.join(ids, F.col("target") == F.col("_known"), "left_semi")


def drop_blocked_ids(nodes: DataFrame, blocked: DataFrame) -> DataFrame:
    """Rows whose lower-case id is not on the blocklist (column `id`)."""
    keys = blocked.select(F.lower("id").alias("_blocked")).distinct()
    return nodes.join(keys, F.lower(F.col("id")) == F.col("_blocked"), "left_anti")


def drop_blocked_edges(edges: DataFrame, blocked: DataFrame) -> DataFrame:
    keys = blocked.select(F.lower("id").alias("_blocked")).distinct()
    first = edges.join(keys, F.lower(F.col("source")) == F.col("_blocked"), "left_anti")
    return first.join(keys, F.lower(F.col("target")) == F.col("_blocked"), "left_anti")


def drop_blocked_labels(nodes: DataFrame, blocked: DataFrame) -> DataFrame:
    """Neither the id nor the exact lower-case label is blocked; `blocked` has id and labels."""
    names = blocked.select(F.explode("labels").alias("_blocked")).select(F.lower("_blocked").alias("_blocked")).distinct()
    return drop_blocked_ids(nodes, blocked).join(names, F.lower(F.col("label")) == F.col("_blocked"), "left_anti")


def has_blocked_term(value: Column, terms: Sequence[str], whole_words: bool = False) -> Column:
    """Substring match on normalised text; short terms also hit inside words unless `whole_words`."""
    normalized = [term.lower().replace("_", " ").strip() for term in terms]
    return text.contains_any(text.normalize_text(value), normalized, whole_words)


def node_has_blocked_term(terms: Sequence[str], whole_words: bool = False) -> Column:
    """Any text field of a node row carries a blocked term."""
    def in_array(name: str) -> Column:
        hit = F.exists(F.col(name), lambda v: has_blocked_term(v, terms, whole_words))
        return F.coalesce(hit, F.lit(False))

    fields = [has_blocked_term(F.col(name), terms, whole_words) for name in ("id", "label", "summary")]
    arrays = [in_array(name) for name in ("aliases", "metadata", "roles")]
    condition = fields[0]
    for item in fields[1:] + arrays:
        condition = condition | item
    return condition


def derived_kind(node_type: Column, roles: Column, metadata: Column) -> Column:
    """An artist whose roles or metadata say guitarist is a guitarist."""
    values = F.transform(F.concat(roles, metadata), lambda v: text.normalize_words(v))
    guitarist = F.coalesce(F.array_contains(values, "guitarist"), F.lit(False))
    return F.when((node_type == "artist") & guitarist, F.lit("guitarist")).otherwise(node_type)


def is_actionable_seed(label: Column, kind: Column) -> Column:
    name = text.normalize_text(label)
    genre_ok = ~F.startswith(name, F.lit("history of ")) & ~text.contains_any(name, vocab.SEED_GROUPING_TERMS)
    return (name != "") & ~name.isin(*vocab.BLOCKED_SEED_LABELS) & ((kind != "genre") | genre_ok)


def visible_in_timeline(era_start: Column, year: int, hide_unknown: bool = True) -> Column:
    unknown = F.lit(not hide_unknown)
    return F.when(era_start.isNull(), unknown).otherwise(era_start <= year)


def relation_type(label: Column, source_type: Column, target_type: Column) -> Column:
    """Type from the label words, then from the kinds of the ends; order matters."""
    name = F.lower(label)

    def says(*terms: str) -> Column:
        return text.contains_any(name, terms)

    def either(kind: str) -> Column:
        return F.coalesce(source_type == kind, F.lit(False)) | F.coalesce(target_type == kind, F.lit(False))

    return (
        F.when(says("member", "frontman", "guitarist"), "member_of")
        .when(says("influence", "draws from", "roots source"), "influenced_by")
        .when(either("genre"), "associated_genre")
        .when(either("guitar_brand"), "made_by")
        .when(either("guitar") & says("signature", "iconic"), "signature_instrument")
        .when(either("guitar"), "plays")
        .when(says("collab", "shared", "link"), "collaboration")
        .otherwise("related")
    )


def relation_type_of_kinds(source_type: Column, target_type: Column) -> Column:
    def either(kind: str) -> Column:
        return F.coalesce(source_type == kind, F.lit(False)) | F.coalesce(target_type == kind, F.lit(False))

    maker = F.coalesce(source_type == "guitar_brand", F.lit(False)) | F.coalesce(target_type == "guitar", F.lit(False))
    return (
        F.when(either("genre"), "associated_genre")
        .when(either("guitar_brand") & maker, "made_by")
        .when(either("guitar_brand"), "related")
        .when(either("guitar"), "plays")
        .otherwise("related")
    )


def zone_of_point(x: Column, y: Column, node_type: Column) -> Column:
    return (
        F.when(node_type.isin("guitar", "guitar_brand"), "guitar-workshop")
        .when((y > 400) & (x < 500), "folk-country-vise")
        .when((x > 250) & (y > -500), "hard-rock-metal")
        .when(y < -350, "psychedelia-prog")
        .when(x < -650, "roots-blues")
        .otherwise("rock-circuit")
    )


def zone_of_title(title: Column, kind: Column, seed_zone: Column) -> Column:
    """Zone by keyword precedence, then the seed's zone, else null."""
    name = text.normalize_text(title)
    metal_prog = text.contains_any(name, vocab.PROG_TERMS)
    zone = (
        F.when(kind.isin("guitar", "guitar_brand"), "guitar-workshop")
        .when(name.isin(*vocab.JAZZ_TITLES), "jazz")
        .when(name.isin(*vocab.COUNTRY_TITLES), "country-roots")
        .when(text.contains_any(name, vocab.PUNK_ALT_TERMS), "punk-alt")
        .when(metal_prog & ~F.contains(name, F.lit("metal")), "psychedelia-prog")
        .when(metal_prog | text.contains_any(name, vocab.HARD_ROCK_METAL_TERMS), "hard-rock-metal")
    )
    for target, terms in vocab.ZONE_TAIL_TERMS:
        zone = zone.when(text.contains_any(name, terms), target)
    return zone.otherwise(F.nullif(seed_zone, F.lit("")))


def valid_start_year(value: Column) -> Column:
    return F.when(value.between(1400, 2100), value)


def first_active_year(own: Column, learned: Column) -> Column:
    return F.coalesce(valid_start_year(own), valid_start_year(learned))


def infer_era(
    own_start: Column, learned_start: Column, own_peak: Column, learned_peak: Column, folded: Column,
    earliest: bool = False, last_year: int | None = 2026,
) -> Column:
    """Known years first, then years in the text, then a hint, then a default.

    `earliest` takes the smallest year of the text, up to `last_year` (None: all that the pattern names), and its own
    hint list; otherwise the first year counts.
    """
    if earliest:
        found = F.array_min(text.years_in_text(folded, vocab.ANY_YEAR, 1600, 9999 if last_year is None else last_year))
        hints, default = vocab.EARLIEST_YEAR_HINTS, vocab.EARLIEST_YEAR_DEFAULT
    else:
        found = text.first_year_in_text(folded)
        hints, default = vocab.ERA_HINTS, vocab.ERA_DEFAULT
    hinted = F.when(F.lit(False), F.lit(0))
    for pattern, year in hints:
        hinted = hinted.when(folded.rlike(pattern), F.lit(year))
    return F.coalesce(own_start, learned_start, own_peak, learned_peak, found, hinted.otherwise(F.lit(default)))
