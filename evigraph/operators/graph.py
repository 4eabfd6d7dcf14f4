"""Degrees, zone profiles, bridges, hubs and ranked work lists over nodes and relations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph import vocab
from evigraph.functions import numeric, refs, text
from evigraph.operators.evidence import induced_edges, is_actionable_seed, map_connections, with_tier
from evigraph.operators.prefix import floor_quantile, positions
from evigraph.session import lookup


def end_kinds(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relations with label, kind and zone of both ends; relations with a missing end are dropped.

    Tasks hash their share of the nodes, so the many relations are neither sorted nor spilled.
    """
    def side(prefix: str) -> DataFrame:
        return nodes.select(
            F.col("id").alias(f"_{prefix}_id"),
            F.col("label").alias(f"{prefix}_label"),
            F.col("node_type").alias(f"{prefix}_type"),
            F.col("zone").alias(f"{prefix}_zone"),
        ).hint("shuffle_hash")

    first = lookup(edges, side("source"), "source", "_source_id")
    return lookup(first, side("target"), "target", "_target_id").drop("_source_id", "_target_id")


def endpoints(edges: DataFrame) -> DataFrame:
    """One row per end of a relation."""
    ends = F.array(
        F.struct(F.col("source").alias("id"), F.col("target").alias("other")),
        F.struct(F.col("target").alias("id"), F.col("source").alias("other")),
    )
    return edges.withColumn("_end", F.explode(ends)).select("*", "_end.id", "_end.other").drop("_end")


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Degree and weighted degree over map connections between known nodes; unconnected nodes count 0.

    Partial sums run before the shuffle, so a hub costs one row per map task.
    """
    known = induced_edges(map_connections(edges), nodes)
    sums = (
        endpoints(known.select("source", "target", "strength"))
        .groupBy("id")
        .agg(
            F.count(F.lit(1)).alias("degree"),
            F.sum(F.coalesce("strength", F.lit(0.5))).alias("weighted_degree"),
        )
    )
    return nodes.join(sums.hint("shuffle_hash"), "id", "left").fillna({"degree": 0, "weighted_degree": 0.0})


def end_degrees(edges: DataFrame) -> DataFrame:
    """Degree of every end that occurs, whether or not its node is known."""
    ends = endpoints(map_connections(edges).select("source", "target"))
    return ends.where(F.col("id") != "").groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def adjacency(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each node's relations in both directions with the label of the other end."""
    other = nodes.select(F.col("id").alias("_other_id"), F.col("label").alias("other_label"))
    return lookup(endpoints(edges), other, "other", "_other_id").drop("_other_id")


def connected_zones(ends: DataFrame) -> DataFrame:
    """Strength from each node to each other zone; input is `end_kinds` of map connections."""
    def direction(near: str, far: str) -> DataFrame:
        return ends.select(
            F.col(near).alias("id"), F.col(f"{near}_zone").alias("zone"), F.col(f"{far}_zone").alias("other_zone"),
            F.coalesce("strength", F.lit(0.5)).alias("strength"),
        )

    both = direction("source", "target").unionByName(direction("target", "source"))
    crossing = both.where((F.col("zone") != "") & (F.col("other_zone") != "") & (F.col("zone") != F.col("other_zone")))
    return crossing.groupBy("id", "other_zone").agg(F.sum("strength").alias("strength"))


def zones_of_neighbours(ends: DataFrame) -> DataFrame:
    """Distinct zones at the other ends of each node's relations (id, zone); input is `end_kinds`.

    Repeats go in each task, before rows travel.
    """
    both = F.array(*[F.struct(F.col(a).alias("id"), F.col(f"{b}_zone").alias("zone")) for a, b in (("source", "target"), ("target", "source"))])
    return ends.select(F.inline(both)).distinct()


def linked_genres(ends: DataFrame) -> DataFrame:
    """Distinct genres a node is connected to."""
    def direction(near: str, far: str) -> DataFrame:
        hit = ends.where((F.col(f"{far}_type") == "genre") & (F.col(f"{near}_type") != "genre"))
        return hit.select(F.col(near).alias("id"), F.col(far).alias("genre_id"))

    return direction("source", "target").unionByName(direction("target", "source")).distinct()


def edges_by_zone(ends: DataFrame) -> DataFrame:
    """Relation counts inside a zone or from one zone to another."""
    return ends.groupBy("source_zone", "target_zone").agg(F.count(F.lit(1)).alias("relations"))


def zone_crossings(ends: DataFrame) -> DataFrame:
    """Internal and crossing relations per zone."""
    pairs = edges_by_zone(ends)
    inside = F.col("source_zone") == F.col("target_zone")
    touched = F.when(inside, F.array("source_zone")).otherwise(F.array("source_zone", "target_zone"))
    return (
        pairs.withColumn("zone", F.explode(touched))
        .groupBy("zone")
        .agg(
            F.sum(F.when(inside, F.col("relations")).otherwise(0)).alias("internal"),
            F.sum(F.when(inside, 0).otherwise(F.col("relations"))).alias("crossing"),
        )
    )


def overflow_distance(nodes: DataFrame, zones: DataFrame) -> DataFrame:
    """Distance of a node from the rectangle of its zone; `zones` has zone, x, y, width, height."""
    box = zones.select(
        F.col("zone").alias("_zone"), F.col("x").alias("_x"), F.col("y").alias("_y"),
        (F.col("x") + F.col("width")).alias("_right"), (F.col("y") + F.col("height")).alias("_bottom"),
    )
    joined = lookup(nodes, box, "zone", "_zone", "left")
    zero = F.lit(0.0)
    dx = F.greatest(F.col("_x") - F.col("x"), F.col("x") - F.col("_right"), zero)
    dy = F.greatest(F.col("_y") - F.col("y"), F.col("y") - F.col("_bottom"), zero)
    distance = F.when(F.col("_zone").isNull(), zero).otherwise(numeric.half_up(F.hypot(dx, dy)))
    return joined.withColumn("overflow", distance.cast("bigint")).drop("_zone", "_x", "_y", "_right", "_bottom")


def _policy_anchors(nodes: DataFrame, policies: DataFrame) -> DataFrame:
    """Distinct (id, policy) of nodes whose id or label is an anchor of the policy; policies are rules, few enough for every task."""
    anchors = policies.select("policy", F.explode("anchors").alias("_anchor"))
    anchors = anchors.select("policy", text.normalize_key("_anchor").alias("_anchor")).distinct()
    keys = nodes.select("id", F.explode(F.array_distinct(F.array(text.normalize_key("id"), text.normalize_key("label")))).alias("_key"))
    return keys.join(F.broadcast(anchors), F.col("_key") == F.col("_anchor")).select("id", "policy").distinct()


def _policy_zones(policies: DataFrame) -> DataFrame:
    """Distinct (policy, zone) of policies that take nodes by zones, too."""
    return policies.where(~F.col("anchors_only")).select("policy", F.explode("zones").alias("_wanted")).distinct()


def bridge_policy_matches(nodes: DataFrame, node_zones: DataFrame, policies: DataFrame) -> DataFrame:
    """Policies a node satisfies through an anchor or through two of their zones.

    `node_zones` (id, zone) holds a node's own and connected zones; `policies` has policy, zones, anchors,
    anchors_only. Both conditions are equi-joins on exploded keys.
    """
    by_zone = (
        node_zones.distinct()
        .join(F.broadcast(_policy_zones(policies)), text.normalize_key("zone") == text.normalize_key("_wanted"))
        .groupBy("id", "policy")
        .agg(F.count(F.lit(1)).alias("_hits"))
        .where(F.col("_hits") >= 2)
        .select("id", "policy")
    )
    marked = _policy_anchors(nodes, policies).withColumn("anchor", F.lit(1)).unionByName(by_zone.withColumn("anchor", F.lit(0)))
    return marked.groupBy("id", "policy").agg((F.max("anchor") == 1).alias("anchor"))


def node_links(ends: DataFrame, nodes: DataFrame) -> DataFrame:
    """What each node touches: a row for its own zone (`own` 1), for each zone and, for non-genres, for each genre at the other end.

    (id, other_zone, genre_id, links, strength, own); genre rows have no zone and count no links. One pass over the relations
    with partial sums, in which a hub shrinks to its distinct zones and genres. Input is `end_kinds` of map connections.
    """
    none, nothing = F.lit(None).cast("string"), F.lit(0).cast("bigint")

    def rows(near: str, far: str) -> list[Column]:
        genre = (F.col(f"{far}_type") == "genre") & (F.col(f"{near}_type") != "genre")
        reached = F.struct(F.col(near).alias("id"), none.alias("other_zone"), F.col(far).alias("genre_id"), nothing.alias("links"))
        linked = F.struct(F.col(near).alias("id"), F.col(f"{far}_zone").alias("other_zone"), none.alias("genre_id"), F.lit(1).cast("bigint").alias("links"))
        return [linked, F.when(genre, reached)]

    each = F.array_compact(F.array(*rows("source", "target"), *rows("target", "source")))
    both = ends.select(F.inline(each), F.coalesce("strength", F.lit(0.5)).alias("strength"), F.lit(0).alias("own"))  # a strength that no one reads does not travel
    own = nodes.select("id", F.col("zone").alias("other_zone"), none.alias("genre_id"), nothing.alias("links"), F.lit(0.0).alias("strength"), F.lit(1).alias("own"))
    return both.unionByName(own).groupBy("id", "other_zone", "genre_id").agg(
        F.sum("links").alias("links"), F.sum(F.when(F.col("links") > 0, F.col("strength"))).alias("strength"), F.max("own").alias("own")
    )


def node_sums(nodes: DataFrame, links: DataFrame, policies: DataFrame | None = None) -> DataFrame:
    """degree, weighted_degree, zone_links, genre_links, policies and anchored of every node, in one pass over `node_links`.

    The links travel once by id. Zones and genres are counted as rows, since they are distinct already, and the zones of
    policies (as in `bridge_policy_matches`) are counted beside them, so that relations are not joined a second time for them.
    """
    none = F.lit(None).cast("string")
    rows = links.withColumn("_genre", F.col("genre_id").isNotNull()).withColumn("_anchor", none).drop("genre_id")
    if policies is not None:
        anchored = _policy_anchors(nodes, policies).withColumnRenamed("policy", "_anchor")
        rows = rows.unionByName(anchored.withColumn("own", F.lit(0)).withColumn("_genre", F.lit(False)), allowMissingColumns=True)
    rows = rows.repartition("id")
    is_zone = ~F.col("_genre") & F.col("_anchor").isNull()
    wanting = F.array().cast("array<string>")
    if policies is not None:
        wanted = _policy_zones(policies).groupBy(text.normalize_key("_wanted").alias("_wanted")).agg(F.collect_list("policy").alias("_policies"))
        rows = rows.join(F.broadcast(wanted), is_zone & (text.normalize_key("other_zone") == F.col("_wanted")), "left")
        wanting = F.coalesce("_policies", wanting)
    zero = F.lit(0)
    crossing = F.coalesce((F.col("other_zone") != "") & (F.col("own") == 0) & is_zone, F.lit(False)).cast("int")

    def part(policy: Column, *values: Column) -> Column:
        return F.struct(policy.alias("policy"), *[v.alias(n) for v, n in zip(values, ("links", "zones", "genres", "hits", "anchor"), strict=True)])

    first = part(
        F.col("_anchor"), F.coalesce("links", zero.cast("bigint")), crossing, F.col("_genre").cast("int"), zero,
        F.col("_anchor").isNotNull().cast("int"),
    )
    hits = F.transform(wanting, lambda p: part(p, zero.cast("bigint"), zero, zero, F.lit(1), zero))
    parts = rows.select("id", F.coalesce("strength", F.lit(0.0)).alias("strength"), F.inline(F.concat(F.array(first), hits)))
    totals = [F.sum(name).alias(name) for name in ("links", "zones", "genres", "hits")]
    by_policy = parts.groupBy("id", "policy").agg(*totals, F.sum(F.when(F.col("hits") == 0, F.col("strength"))).alias("strength"), F.max("anchor").alias("anchor"))
    return by_policy.groupBy("id").agg(
        F.sum("links").alias("degree"), F.sum("strength").alias("weighted_degree"), F.sum("zones").alias("zone_links"), F.sum("genres").alias("genre_links"),
        F.count_if(F.col("policy").isNotNull() & ((F.col("hits") >= 2) | (F.col("anchor") == 1))).alias("policies"), F.max("anchor").alias("anchored"),
    )


def node_profiles(nodes: DataFrame, sums: DataFrame, overlap_counts: DataFrame, learned: DataFrame | None = None) -> DataFrame:
    """Bridge and hub scores, importance and recommended actions of every node.

    `sums` comes from `node_sums`; `overlap_counts` has id, overlap_count; `learned` may add bridge_score,
    hub_score and fact_count per id. Nodes need an `overflow` column.
    """
    profile = nodes.join(sums, "id", "left").fillna({"degree": 0, "weighted_degree": 0.0})
    profile = profile.withColumn("zone_links", F.when(F.col("zone").isNotNull(), F.col("zone_links")))  # without a zone nothing crosses
    profile = profile.join(overlap_counts, "id", "left")
    if learned is not None:
        renamed = learned.select(
            "id", F.col("bridge_score").alias("_bridge"), F.col("hub_score").alias("_hub"), "fact_count"
        )
        profile = profile.join(renamed, "id", "left")
    else:
        profile = (
            profile.withColumn("_bridge", F.lit(0.0)).withColumn("_hub", F.lit(0.0)).withColumn("fact_count", F.lit(0))
        )
    profile = profile.fillna(
        {"zone_links": 0, "genre_links": 0, "overlap_count": 0, "policies": 0, "anchored": 0, "_bridge": 0.0,
         "_hub": 0.0, "fact_count": 0}
    )
    bridge = F.least(
        F.lit(1.0),
        F.col("_bridge") + F.col("zone_links") * 0.1 + F.least(F.lit(0.35), F.col("genre_links") * 0.05)
        + F.col("policies") * 0.12 + F.col("anchored") * 0.16,
    )
    hub = F.least(F.lit(1.0), F.col("_hub") + F.least(F.lit(0.45), F.col("degree") / 24))
    profile = (
        profile.withColumn("bridge_raw", bridge)
        .withColumn("hub_raw", hub)
        .withColumn("quality_raw", refs.source_quality(F.col("sources")))
        .drop("_bridge", "_hub")
    )
    important = F.col("starter") | (F.col("node_type") == "genre") | (F.col("hub_raw") >= 0.45) | (
        F.col("bridge_raw") >= 0.35
    )
    profile = profile.withColumn("important", F.coalesce(important, F.lit(False)))

    def action(condition: Column, name: str) -> Column:
        return F.when(condition, F.lit(name))

    actions = F.array_compact(F.array(
        action(F.col("degree") == 0, "research-first-connections"),
        action(F.col("important") & (F.col("degree") <= 2), "expand-important-node"),
        action(F.col("zone_links") > 0, "preserve-cross-zone-bridge"),
        action(F.col("policies") > 0, "train-bridge-policy"),
        action(F.col("overlap_count") >= 3, "spread-local-neighborhood"),
        action(F.col("overflow") > 0, "review-zone-bleed"),
        action(F.col("quality_raw") < 0.45, "improve-source-quality"),
        action(F.col("important") & (F.col("fact_count") == 0), "source-history-fact"),
    ))
    return (
        profile.withColumn("actions", actions)
        .withColumn("bridge_score", numeric.half_up(F.col("bridge_raw"), 3))
        .withColumn("hub_score", numeric.half_up(F.col("hub_raw"), 3))
        .withColumn("source_quality", numeric.half_up(F.col("quality_raw"), 3))
    )


def zone_profiles(profiles: DataFrame, transition_needs: DataFrame | None = None, list_cap: int | None = None) -> DataFrame:
    """Counts, averages and the needs-attention score of each zone; with `list_cap` list sizes count at most that each."""
    def listed(condition: Column) -> Column:
        return F.count_if(condition) if list_cap is None else F.least(F.lit(list_cap), F.count_if(condition))

    zones = profiles.groupBy("zone").agg(
        F.count(F.lit(1)).alias("nodes"),
        numeric.half_up(F.avg("degree"), 2).alias("average_degree"),
        numeric.half_up(F.avg("source_quality"), 3).alias("average_quality"),
        numeric.half_up(F.avg((F.col("fact_count") > 0).cast("int")), 3).alias("fact_coverage"),
        F.sum("overlap_count").alias("overlap_risk"),
        listed(F.col("degree") == 0).alias("isolated"),
        listed(F.col("important") & (F.col("degree") <= 2)).alias("under_connected"),
        listed((F.col("bridge_raw") >= 0.34) | (F.col("zone_links") >= 2)).alias("bridges"),
        listed((F.col("hub_raw") >= 0.34) | F.col("starter") | (F.col("node_type") == "genre")).alias("hubs"),
        listed(F.col("overflow") > 0).alias("overflowing"),
    )
    zones = zones.join(floor_quantile(profiles, ["zone"], "degree", 0.25, "degree_p25"), "zone", "left")
    zones = zones.join(floor_quantile(profiles, ["zone"], "era_start", None, "era_median"), "zone", "left")
    if transition_needs is None:
        zones = zones.withColumn("needs", F.lit(0))
    else:
        zones = zones.join(transition_needs.select("zone", "needs"), "zone", "left").fillna({"needs": 0})
    score = (
        F.col("isolated") * 2.2 + F.col("under_connected") * 2.8 + F.col("bridges") * 0.8
        + F.least(F.lit(30.0), F.col("overlap_risk") * 0.38)
        + F.greatest(F.lit(0.0), 0.68 - F.col("average_quality")) * 18
        + F.greatest(F.lit(0.0), 2.4 - F.col("average_degree")) * 5
    )
    needs = numeric.half_up(numeric.half_up(score, 2) + F.col("needs") * 3.5, 2)
    return zones.withColumn("needs_attention", needs)


def layout_pressure(zones: DataFrame, boxes: DataFrame, readability_rule: bool = False) -> DataFrame:
    """Density, pressure and spacing guidance of each zone that has a rectangle."""
    joined = zones.join(boxes.select("zone", "width", "height"), "zone")
    density = F.col("nodes") / F.greatest(F.lit(1.0), F.col("width") * F.col("height") / 100000)
    per_node = F.col("overlap_risk") / F.greatest(F.lit(1), F.col("nodes"))
    bridge_ratio = F.col("bridges") / F.greatest(F.lit(1), F.col("nodes"))
    pressure = numeric.clamp(
        density * 0.09 + per_node * 0.16 + F.greatest(F.lit(0.0), 2.2 - F.col("average_degree")) * 0.08
        + F.col("under_connected") * 0.015, 0.0, 1.0,
    )
    p = F.col("_pressure")
    spacing = p * 0.42 + (1.08 if readability_rule else 1.0)
    return (
        joined.withColumn("_pressure", pressure)
        .withColumn("_ratio", bridge_ratio)
        .select(
            "zone",
            numeric.half_up(p, 3).alias("pressure"),
            numeric.half_up(density, 3).alias("density"),
            numeric.half_up(per_node, 3).alias("overlap_per_node"),
            numeric.half_up(F.col("_ratio"), 3).alias("bridge_ratio"),
            numeric.half_up(spacing, 3).alias("spacing"),
            numeric.half_up(numeric.clamp(F.col("width") * (0.08 + p * 0.22), 120.0, 760.0)).cast("bigint").alias("expand_x"),
            numeric.half_up(numeric.clamp(F.col("height") * (0.08 + p * 0.2), 100.0, 620.0)).cast("bigint").alias("expand_y"),
            numeric.half_up(numeric.clamp(160 + F.col("_ratio") * 860 + p * 180, 160.0, 760.0)).cast("bigint").alias("bridge_bleed"),
            F.when(p > 0.66, "expand-and-relax").when(F.col("_ratio") > 0.2, "soft-overlap-bridges")
            .otherwise("preserve-loose-cluster").alias("strategy"),
        )
    )


def top_per_group(df: DataFrame, group: list[str], order: list[Column], limit: int, rank: str = "rank") -> DataFrame:
    """First `limit` rows of each group; Spark keeps only `limit` rows per group and task before the shuffle."""
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= limit)


def first_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return top_per_group(df, key, order, 1, "_rank").drop("_rank")


def zone_top_lists(profiles: DataFrame, limit: int = 20) -> DataFrame:
    """Top rows of each zone for the isolated, under-connected, bridge, hub and overflow lists, in long form."""
    both = F.col("hub_score") + F.col("bridge_score")
    zero = F.lit(0.0)
    entries = F.array(
        F.when(F.col("degree") == 0, F.struct(F.lit("isolated").alias("list"), zero.alias("score"))),
        F.when(F.col("important") & (F.col("degree") <= 2), F.struct(F.lit("under_connected").alias("list"), both.alias("score"))),
        F.when((F.col("bridge_raw") >= 0.34) | (F.col("zone_links") >= 2), F.struct(F.lit("bridge").alias("list"), F.col("bridge_score").alias("score"))),
        F.when((F.col("hub_raw") >= 0.34) | F.col("starter") | (F.col("node_type") == "genre"), F.struct(F.lit("hub").alias("list"), F.col("hub_score").alias("score"))),
        F.when(F.col("overflow") > 0, F.struct(F.lit("overflow").alias("list"), F.col("overflow").cast("double").alias("score"))),
    )
    listed = profiles.withColumn("_entry", F.explode(F.array_compact(entries))).select(
        "zone", "id", "label", "_entry.list", "_entry.score"
    )
    return top_per_group(listed, ["zone", "list"], [F.desc("score"), F.asc("label"), F.asc("id")], limit)


def seed_score() -> Column:
    """Research value of a node profile."""
    priority = F.coalesce(
        F.element_at(F.create_map(*[F.lit(p) for kv in vocab.SEED_PRIORITY.items() for p in kv]), F.col("node_type")),
        F.lit(1),
    )
    return (
        priority * 5
        + F.when(F.array_contains("actions", "expand-important-node"), 22).otherwise(0)
        + F.when(F.array_contains("actions", "research-first-connections"), 16).otherwise(0)
        + F.col("bridge_score") * 14 + F.col("hub_score") * 12
        + F.greatest(F.lit(0), 3 - F.col("degree")) * 5
        + F.when(F.col("source_quality") < 0.45, 5).otherwise(0)
    )


def recommended_requests(profiles: DataFrame, zones: DataFrame, zone_limit: int = 5, seed_limit: int = 8) -> DataFrame:
    """Seeds for the neediest zones, taken from their work lists and ranked by research value."""
    neediest = zones.orderBy(F.desc("needs_attention"), F.asc("zone")).limit(zone_limit)
    neediest = neediest.select("zone", "needs_attention")
    scored = profiles.withColumn("seed_score", numeric.half_up(seed_score(), 3))
    listed = zone_top_lists(scored).where(F.col("list") != "overflow").select("zone", "id").distinct()
    seeds = scored.join(listed, ["zone", "id"]).where(is_actionable_seed(F.col("label"), F.col("node_type")))
    seeds = seeds.join(F.broadcast(neediest), "zone")
    ranked = top_per_group(seeds, ["zone"], [F.desc("seed_score"), F.asc("label"), F.asc("id")], seed_limit)
    priority = numeric.clamp(numeric.half_up(F.col("needs_attention") + 52), 50.0, 90.0).cast("bigint")
    return ranked.select(
        "zone", F.col("rank").cast("bigint").alias("rank"), "id", "label", F.col("node_type").alias("kind"),
        "seed_score", priority.alias("priority"),
    )


def priority_review(edges: DataFrame, nodes: DataFrame, unsourced: int = 12, leads: int = 8) -> DataFrame:
    """Cross-zone relations between non-instruments that still lack a source, most useful first."""
    ends = end_kinds(with_tier(edges), nodes)
    instrument = F.col("source_type").isin("guitar", "guitar_brand") | F.col("target_type").isin("guitar", "guitar_brand")
    crossing = (F.col("source_zone") != "") & (F.col("target_zone") != "") & (F.col("source_zone") != F.col("target_zone"))
    open_ends = ends.where(crossing & ~instrument & (F.col("tier") != "source_linked"))
    genre = ((F.col("source_type") == "genre") | (F.col("target_type") == "genre")).cast("int")
    ranked = top_per_group(
        open_ends.withColumn("_genre", genre), ["tier"],
        [F.desc("_genre"), F.desc(F.coalesce("strength", F.lit(0.0))), F.asc("id")], max(unsourced, leads),
    )
    limit = F.when(F.col("tier") == "research_lead", leads).otherwise(unsourced)
    return ranked.where(F.col("rank") <= limit).drop("_genre")


def isolated_catalogued(nodes: DataFrame, edges: DataFrame, limit: int = 12) -> DataFrame:
    """Unconnected music entities with exactly one catalogue id, starters and persons first."""
    touched = end_degrees(edges).select("id")
    eligible = (
        nodes.where(F.col("node_type").isin(*vocab.MUSIC_ENTITY_KINDS))
        .withColumn("catalogue_id", refs.artist_catalogue_id(F.col("sources")))
        .where(F.col("catalogue_id").isNotNull())
        .join(touched, "id", "left_anti")
    )
    return eligible.orderBy(
        F.desc("starter"), F.asc((F.col("node_type") == "band").cast("int")), F.asc("label"), F.asc("id")
    ).limit(limit)


def work_lists(profiles: DataFrame, limit: int = 80) -> DataFrame:
    """Overall isolated and under-connected nodes by combined score."""
    both = numeric.half_up(F.col("hub_score") + F.col("bridge_score"), 3)
    entries = F.array_compact(F.array(
        F.when(F.col("degree") == 0, F.lit("isolated")),
        F.when(F.array_contains("actions", "expand-important-node"), F.lit("under_connected")),
    ))
    rows = profiles.select("id", "label", F.explode(entries).alias("list"), both.alias("score"))
    return top_per_group(rows, ["list"], [F.desc("score"), F.asc("id")], limit)


def stable_positions(nodes: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Position of each node in its zone: by rank of its kind in `kinds`, start year (missing last), label by its base letters, id."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("node_type")), F.lit(0))
    ordered = nodes.select(
        "id", "zone", F.when(rank == 0, len(kinds) + 1).otherwise(rank).cast("int").alias("_rank"),
        F.coalesce("era_start", F.lit(9999)).alias("_era"), text.base_order("label").alias("_label"),
    )
    return positions(ordered, [("_rank", True), ("_era", True), ("_label", True), ("id", True)], "position", ["zone"]).select("id", "zone", "position")
