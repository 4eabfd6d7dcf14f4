"""Pair joins on positions, layout measurements, pair constraints and slot layouts.

Pairs are found through grid cells: every point sits in one cell, one side is also sent to the neighbouring cells,
and an exact predicate decides. A cell that holds many points is split by salt, so no task meets a whole hot cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions import numeric
from evigraph.functions.hashing import pair_key
from evigraph.functions.text import base_order
from evigraph.operators.evidence import map_connections
from evigraph.operators.prefix import positions as row_positions
from evigraph.session import cut_lineage, attach_row, lookup


def _cells(points: DataFrame, width: float, height: float) -> DataFrame:
    return points.withColumn("_cx", F.floor(F.col("x") / width)).withColumn("_cy", F.floor(F.col("y") / height))


def grid_pairs(points: DataFrame, width: float, height: float, keep: list[str]) -> DataFrame:
    """Candidate pairs no further apart than one cell in each direction, each pair once with first.id < second.id.

    A point meets its own cell and four of its neighbours, which finds each pair once; AQE splits crowded cells.
    """
    names = ["id", "x", "y", *keep]
    base = _cells(points.select(*names), width, height)
    half = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((0, 0), (1, -1), (1, 0), (1, 1), (0, 1))])
    left = base.withColumn("_shift", F.explode(half)).select(
        *[F.col(name).alias(f"_l_{name}") for name in names], (F.col("_cx") + F.col("_shift.dx")).alias("_cx"), (F.col("_cy") + F.col("_shift.dy")).alias("_cy"),
        ((F.col("_shift.dx") == 0) & (F.col("_shift.dy") == 0)).alias("_own"),
    )
    right = base.select(*[F.col(name).alias(f"_r_{name}") for name in names], "_cx", "_cy")
    pairs = left.join(right, ["_cx", "_cy"]).where(F.when(F.col("_own"), F.col("_l_id") < F.col("_r_id")).otherwise(F.col("_l_id") != F.col("_r_id")))
    first = F.col("_l_id") < F.col("_r_id")
    return pairs.select(
        *[F.when(first, F.col(f"_l_{name}")).otherwise(F.col(f"_r_{name}")).alias(f"a_{name}") for name in names],
        *[F.when(first, F.col(f"_r_{name}")).otherwise(F.col(f"_l_{name}")).alias(f"b_{name}") for name in names],
    )


def grid_pairs_of(points: DataFrame, chosen: DataFrame, width: float, height: float, keep: list[str]) -> DataFrame:
    """As `grid_pairs`, but only pairs with an end among the ids of `chosen`: those alone are sent to their nine cells, and a cell without them makes no pair."""
    names = ["id", "x", "y", *keep]
    ids = chosen.select(F.col("id").alias("_chosen")).distinct()
    base = _cells(points.select(*names), width, height).join(ids, F.col("id") == F.col("_chosen"), "left")
    around = F.array(*[F.struct((F.col("_cx") + dx).alias("_cx"), (F.col("_cy") + dy).alias("_cy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    left = base.where("_chosen is not null").select(*[F.col(name).alias(f"_l_{name}") for name in names], F.explode(around).alias("_cell")).select("*", "_cell.*").drop("_cell")
    right = base.select(*[F.col(name).alias(f"_r_{name}") for name in names], "_cx", "_cy", F.col("_chosen").isNotNull().alias("_both"))
    pairs = left.join(right, ["_cx", "_cy"]).where(F.when(F.col("_both"), F.col("_l_id") < F.col("_r_id")).otherwise(F.col("_l_id") != F.col("_r_id")))
    first = F.col("_l_id") < F.col("_r_id")
    return pairs.select(
        *[F.when(first, F.col(f"_l_{name}")).otherwise(F.col(f"_r_{name}")).alias(f"a_{name}") for name in names],
        *[F.when(first, F.col(f"_r_{name}")).otherwise(F.col(f"_l_{name}")).alias(f"b_{name}") for name in names],
    )


def proximity_pairs(nodes: DataFrame) -> DataFrame:
    """Nodes closer than their radii allow: 0.72 of the sum in one zone, half of it across zones."""
    reach = 0.72 * 2 * 104
    points = nodes.withColumn("radius", numeric.node_radius(F.col("node_type")))
    pairs = grid_pairs(points, reach, reach, ["radius", "zone", "label"])
    same = F.col("a_zone") == F.col("b_zone")
    gap = F.hypot(F.col("b_x") - F.col("a_x"), F.col("b_y") - F.col("a_y"))
    limit = (F.col("a_radius") + F.col("b_radius")) * F.when(same, 0.72).otherwise(0.5)
    close = pairs.withColumn("_gap", gap).withColumn("_limit", limit).where(F.col("_gap") < F.col("_limit"))
    return close.select(
        F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.col("a_label"), F.col("b_label"),
        F.when(same, F.col("a_zone")).otherwise("cross-zone").alias("zone"),
        numeric.half_up(F.col("_gap")).cast("bigint").alias("distance"),
        numeric.half_up((F.col("_limit") - F.col("_gap")) / F.col("_limit"), 3).alias("severity"),
    )


def overlap_counts(pairs: DataFrame) -> DataFrame:
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("overlap_count"))


def top_overlap_risks(pairs: DataFrame, limit: int = 80) -> DataFrame:
    ordered = pairs.orderBy(F.desc("severity"), "a_label", "a", "b").limit(limit)
    return ordered.select("a", "b", "zone", "distance", "severity")


def label_overlaps(nodes: DataFrame, reference_window: bool = False, focus: DataFrame | None = None) -> DataFrame:
    """Pairs of overlapping label boxes with the overlap in both directions and whether it is severe; with `focus`, those that touch one of its ids.

    Cells are as wide as the widest label can be, so no pair is missed. `reference_window` keeps only pairs whose
    240-unit cells are at most two columns and one row apart, which drops some pairs of very wide labels.
    """
    points = nodes.withColumn("width", numeric.label_width(F.col("label")))
    grid = (540.0, 88.0, ["width", "zone"])
    pairs = grid_pairs(points, *grid) if focus is None else grid_pairs_of(points, focus, *grid)
    over_x = F.least(F.col("a_x") + F.col("a_width") / 2, F.col("b_x") + F.col("b_width") / 2) - F.greatest(
        F.col("a_x") - F.col("a_width") / 2, F.col("b_x") - F.col("b_width") / 2
    )
    over_y = F.lit(88.0) - F.abs(F.col("a_y") - F.col("b_y"))
    hit = pairs.withColumn("over_x", over_x).withColumn("over_y", over_y).where((over_x > 0) & (over_y > 0))
    if reference_window:
        columns = F.abs(F.floor(F.col("a_x") / 240) - F.floor(F.col("b_x") / 240))
        rows = F.abs(F.floor(F.col("a_y") / 240) - F.floor(F.col("b_y") / 240))
        hit = hit.where((columns <= 2) & (rows <= 1))
    severe = (F.col("over_x") > 28) & (F.col("over_y") > 16)
    return hit.select(
        F.col("a_id").alias("a"), F.col("b_id").alias("b"), "a_zone", "b_zone", "over_x", "over_y", severe.alias("severe")
    )


def edge_lengths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Length of every map connection whose ends are placed."""
    def side(prefix: str) -> DataFrame:
        return nodes.select(
            F.col("id").alias(f"_{prefix}"), F.col("x").alias(f"_{prefix}_x"), F.col("y").alias(f"_{prefix}_y"),
            F.col("zone").alias(f"{prefix}_zone"),
        )

    kept = map_connections(edges).select("id", "source", "target")
    joined = lookup(lookup(kept, side("source"), "source", "_source"), side("target"), "target", "_target")
    length = numeric.distance(F.col("_source_x"), F.col("_source_y"), F.col("_target_x"), F.col("_target_y"))
    return joined.select("id", "source", "target", "source_zone", "target_zone", length.alias("length"))


def layout_metrics(nodes: DataFrame, edges: DataFrame, baseline: DataFrame, scope: str | None = None) -> DataFrame:
    """One row: overlaps, edge lengths, drift and score of a layout, optionally for what touches one zone."""
    def touching(df: DataFrame, first: str, second: str) -> DataFrame:
        return df if scope is None else df.where((F.col(first) == scope) | (F.col(second) == scope))

    labels = touching(label_overlaps(nodes), "a_zone", "b_zone").agg(
        F.count(F.lit(1)).alias("overlaps"), F.count_if("severe").alias("severe")
    )
    lengths = touching(edge_lengths(edges, nodes), "source_zone", "target_zone").agg(
        F.count(F.lit(1)).alias("edges"), F.avg("length").alias("_mean_edge"),
        F.count_if(F.col("length") > 1800).alias("long_edges"),
    )
    old = baseline.select(F.col("id").alias("_old"), F.col("x").alias("_old_x"), F.col("y").alias("_old_y"))
    placed = nodes if scope is None else nodes.where(F.col("zone") == scope)
    drift = placed.join(old, F.col("id") == F.col("_old")).agg(
        F.count(F.lit(1)).alias("nodes"),
        F.avg(numeric.distance(F.col("x"), F.col("y"), F.col("_old_x"), F.col("_old_y"))).alias("_mean_drift"),
    )
    row = attach_row(attach_row(labels, lengths), drift).fillna({"_mean_edge": 0.0, "_mean_drift": 0.0})
    density = F.greatest(F.lit(1.0), F.col("edges") / F.greatest(F.lit(1), F.col("nodes")))
    score = (
        F.col("overlaps") * 8 + F.col("severe") * 14 + F.col("_mean_edge") * density * 0.025
        + F.col("long_edges") * 2 + F.col("_mean_drift") * 0.035
    )
    return row.select(
        "nodes", "edges", "overlaps", "severe", numeric.half_up(F.col("_mean_edge")).cast("bigint").alias("mean_edge"),
        "long_edges", numeric.half_up(F.col("_mean_drift")).cast("bigint").alias("mean_drift"),
        numeric.half_up(score, 1).alias("score"),
    )


def outcome(before: str = "before", after: str = "after") -> Column:
    """Regression, improvement or neither, from two structs of layout metrics."""
    b, a = F.col(before), F.col(after)
    worse = (a["severe"] > b["severe"]) | (a["overlaps"] > b["overlaps"]) | (
        a["mean_edge"] > F.greatest(b["mean_edge"] * 1.15, b["mean_edge"] + 100)
    )
    return F.when(worse, "regression").when(a["score"] < b["score"] - 0.1, "improved").otherwise("unchanged")


def focused_legibility(nodes: DataFrame, focus: DataFrame) -> DataFrame:
    """Overlaps that touch the focus nodes: pairs, and distinct focus nodes overlapping or severely overlapping."""
    ids = focus.select(F.col("id").alias("_focus")).distinct()
    pairs = label_overlaps(nodes, focus=ids.withColumnRenamed("_focus", "id")).select("a", "b", "severe", pair_key(F.col("a"), F.col("b")).alias("pair"))
    ends = pairs.select("pair", "severe", F.explode(F.array("a", "b")).alias("id"))
    hit = ends.join(ids, F.col("id") == F.col("_focus"))
    return hit.agg(
        F.count_distinct("pair").alias("overlap_pairs"),
        F.count_distinct("id").alias("overlapping_nodes"),
        F.count_distinct(F.when(F.col("severe"), F.col("id"))).alias("severely_overlapping_nodes"),
    )


def focused_connections(edges: DataFrame, nodes: DataFrame, focus: DataFrame) -> DataFrame:
    """Mean and longest connections that touch the focus nodes."""
    ids = focus.select(F.col("id").alias("_focus")).distinct()
    lengths = edge_lengths(edges, nodes)
    ends = lengths.select("id", F.explode(F.array_distinct(F.array("source", "target"))).alias("_end"))
    touched = ends.join(ids, F.col("_end") == F.col("_focus"), "left_semi").select(F.col("id").alias("_edge")).distinct()
    hit = lengths.join(touched, F.col("id") == F.col("_edge"), "left_semi")
    same = F.col("source_zone") == F.col("target_zone")

    def longest(condition: Column) -> Column:
        return numeric.half_up(F.coalesce(F.max(F.when(condition, F.col("length"))), F.lit(0.0))).cast("bigint")

    return hit.agg(
        F.count(F.lit(1)).alias("edges"),
        numeric.half_up(F.coalesce(F.avg("length"), F.lit(0.0))).cast("bigint").alias("mean"),
        longest(same).alias("longest_same_zone"), longest(~same).alias("longest_cross_zone"),
    )


def constraint_details(constraints: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distance and excess of each near/apart pair; pairs with an unplaced end have no distance."""
    def side(prefix: str) -> DataFrame:
        return nodes.select(F.col("id").alias(f"_{prefix}"), F.col("x").alias(f"_{prefix}_x"), F.col("y").alias(f"_{prefix}_y"))

    joined = lookup(constraints, side("source"), "source", "_source", "left")
    joined = lookup(joined, side("target"), "target", "_target", "left")
    gap = numeric.distance(F.col("_source_x"), F.col("_source_y"), F.col("_target_x"), F.col("_target_y"))
    measured = joined.withColumn("distance", numeric.half_up(gap).cast("bigint"))
    near, apart = F.col("distance") - F.col("max_distance"), F.col("min_distance") - F.col("distance")
    excess = F.greatest(F.lit(0.0), F.when(F.col("kind") == "near", near).otherwise(apart))
    return measured.select("id", "kind", "distance", F.when(F.col("distance").isNotNull(), excess).alias("excess"))


def constraint_totals(details: DataFrame) -> DataFrame:
    return details.agg(
        F.count(F.lit(1)).alias("constraints"), F.count_if(F.col("excess") > 0).alias("violations"),
        F.coalesce(F.sum("excess"), F.lit(0.0)).alias("total_excess"),
    )


def growth_hints(edges: DataFrame, nodes: DataFrame, fresh: DataFrame, per_node: int = 2) -> DataFrame:
    """Near-constraints for new nodes from their strongest sourced relations, at most `per_node` per new node.

    Relations are taken by strength, then id, each if its new ends still have a free place. In sets: an open relation
    that ranks within the free places of all its new ends is taken whatever happens to the others, and those with
    a full end go; this is repeated until none is open. The strongest open relation always counts, so each round ends some.
    """
    from evigraph.functions.refs import has_url
    from evigraph.operators.graph import first_per_key, top_per_group

    ids = fresh.select(F.col("id").alias("_fresh")).distinct()
    zones = nodes.select(F.col("id").alias("_zid"), F.col("zone").alias("_zone"))
    usable = map_connections(edges.where(F.col("type").isin("member_of", "collaboration"))).where(has_url(F.col("sources")))
    usable = usable.select("id", "source", "target", "type", F.coalesce("strength", F.lit(0.0)).alias("strength"))
    usable = usable.withColumn("pair", pair_key(F.col("source"), F.col("target")))
    best = first_per_key(usable, ["pair"], [F.desc("strength"), F.asc("id")])
    placed = lookup(best, zones, "source", "_zid").withColumnRenamed("_zone", "source_zone").drop("_zid")
    placed = cut_lineage(lookup(placed, zones, "target", "_zid").withColumnRenamed("_zone", "target_zone").drop("_zid"))

    ends = placed.select("id", "strength", F.explode(F.array_distinct(F.array("source", "target"))).alias("end"))
    open_ends = cut_lineage(ends.join(ids, F.col("end") == F.col("_fresh")).select("id", "strength", "end"))
    taken: list[DataFrame] = []
    used = open_ends.select("end").limit(0).withColumn("used", F.lit(0).cast("long"))
    while not open_ends.isEmpty():
        count = open_ends.groupBy("id").agg(F.count(F.lit(1)).alias("_ends"))
        places = open_ends.join(used, "end", "left").withColumn("free", per_node - F.coalesce("used", F.lit(0)))
        ranked = top_per_group(places, ["end"], [F.desc("strength"), F.asc("id")], per_node)
        good = ranked.where("rank <= free").groupBy("id").agg(F.count(F.lit(1)).alias("_good"))
        chosen = cut_lineage(count.join(good, "id").where(F.col("_ends") == F.col("_good")).select("id"))
        taken.append(chosen)
        now = open_ends.join(chosen, "id", "left_semi").groupBy("end").agg(F.count(F.lit(1)).alias("used"))
        used = cut_lineage(used.unionByName(now).groupBy("end").agg(F.sum("used").alias("used")))
        full = used.where(F.col("used") >= per_node).select("end")
        lost = open_ends.join(full, "end", "left_semi").select("id").union(chosen).distinct()
        open_ends = cut_lineage(open_ends.join(lost, "id", "left_anti").select("id", "strength", "end"))
    picked = placed.select("id").limit(0)
    for part in taken:
        picked = picked.union(part)
    reach = F.when(F.col("source_zone") == F.col("target_zone"), 700).otherwise(1200)
    return placed.join(picked, "id").select(
        F.concat(F.lit("growth-"), "id").alias("id"), F.lit("near").alias("kind"), "source", "target",
        reach.cast("double").alias("max_distance"), F.col("id").alias("evidence_edge_id"),
    )


def undated_slots(nodes: DataFrame, left: float, top: float, columns: int, column_gap: float, row_gap: float) -> DataFrame:
    """Row-by-row slots for nodes without a year, in order of zone, label by its base letters, and id."""
    keyed = nodes.withColumn("_key", base_order("label"))
    ordered = row_positions(keyed, [("zone", True), ("_key", True), ("id", True)], "_pos")
    index = F.col("_pos") - 1
    return ordered.select(
        "id", "zone", (F.lit(left) + (index % columns + 0.5) * column_gap).alias("x"),
        (F.lit(top) + F.floor(index / columns) * row_gap).alias("y"),
    )


def alphabetic_grid(nodes: DataFrame, columns: int = 16) -> DataFrame:
    """A to Z grid, by the base letters of labels, with a small offset by first letter."""
    from evigraph.functions.text import fold_text

    low, high, gap, start = -2260, 4300, 112, -1220
    keyed = nodes.withColumn("_key", base_order("label"))
    ordered = row_positions(keyed, [("_key", True), ("id", True)], "_pos")
    index = F.col("_pos") - 1
    letter = F.pmod(F.ascii(fold_text("label")), F.lit(7))
    return ordered.select(
        "id", (F.lit(low) + (index % columns) * ((high - low) / (columns - 1))).alias("x"),
        (F.lit(start) + F.floor(index / columns) * gap + letter * 4).cast("double").alias("y"),
    )


def decade_markers(nodes: DataFrame, start_x: int = -4800, first: int = 1600, last: int = 2030) -> DataFrame:
    """Start and width of each decade on a time axis that covers the default span and every known year."""
    from pyspark.sql import Window

    decade = F.floor(F.col("start_year") / 10) * 10
    span = nodes.agg(
        F.least(F.lit(first), F.coalesce(F.min(decade), F.lit(first))).alias("lo"),
        F.greatest(F.lit(last), F.coalesce(F.max(decade), F.lit(last))).alias("hi"),
    )
    decades = span.select(F.explode(F.sequence("lo", "hi", F.lit(10).cast("bigint"))).alias("decade"))
    sized = decades.withColumn("width", numeric.decade_width(F.col("decade")))
    # At most seventy-odd decades exist between the years 1400 and 2100.
    before = Window.orderBy("decade").rowsBetween(Window.unboundedPreceding, -1)
    return sized.withColumn("x", F.lit(start_x) + F.coalesce(F.sum("width").over(before), F.lit(0)))


def timeline_x(nodes: DataFrame, start_x: int = -4800) -> DataFrame:
    """Horizontal place of each dated node on the time axis."""
    dated = nodes.where(F.col("start_year").isNotNull()).withColumn("_decade", F.floor(F.col("start_year") / 10) * 10)
    markers = decade_markers(nodes, start_x).select(
        F.col("decade").alias("_marker"), F.col("width").alias("_width"), F.col("x").alias("_x")
    )
    joined = dated.join(F.broadcast(markers), F.col("_decade") == F.col("_marker"))
    offset = F.greatest(F.lit(18.0), (F.col("start_year") - F.col("_decade")) * F.col("_width") / 10)
    return joined.select("id", "start_year", F.col("_decade").alias("decade"), (F.col("_x") + offset).alias("x"))


NEAR = 0.15  # degrees
COLUMNS = 2399  # of a little more than 0.15 degrees, all around
POLAR = 90 - NEAR


def _text(name: str) -> Column:
    return F.lower(F.trim(F.col(name)))


def same_place(a: str, b: str) -> Column:
    """Equal name and country and both coordinates within 0.15 degrees, for aliased frames.

    Longitudes are compared around the circle, so 179.95 and -179.95 are near; at a pole, where all of them meet, latitude alone decides.
    """
    apart = F.abs(F.col(f"{a}.lon") - F.col(f"{b}.lon"))
    apart = F.least(apart, F.abs(F.lit(360.0) - apart))
    pole = (F.abs(F.col(f"{a}.lat")) > POLAR) & (F.abs(F.col(f"{b}.lat")) > POLAR)
    return (
        (_text(f"{a}.name") == _text(f"{b}.name")) & (_text(f"{a}.country") == _text(f"{b}.country"))
        & (F.abs(F.col(f"{a}.lat") - F.col(f"{b}.lat")) < NEAR) & ((apart < NEAR) | pole)
    )


def same_place_pairs(places: DataFrame) -> DataFrame:
    """Distinct place ids that describe one place; input is reduced to distinct places before the join.

    Places meet in cells a little wider than the tolerance, by name and country: each in its own cell and half of the neighbours, columns
    closed to a ring at 180 degrees, and those at a pole in one cell more. So places of a usual name meet only where they are near.
    """
    distinct = places.select("place_id", "name", "country", "lat", "lon").dropDuplicates(["place_id"])
    width = 360.0 / COLUMNS
    column = F.pmod(F.floor((F.col("lon") + 180) / width), F.lit(COLUMNS))
    keyed = distinct.withColumns({"_name": _text("name"), "_country": _text("country"), "_cx": column, "_cy": F.floor(F.col("lat") / width), "_pole": F.abs("lat") > POLAR})
    cap = F.struct(F.lit(-1).cast("bigint").alias("x"), F.signum("lat").cast("bigint").alias("y"))
    cell = F.struct(F.col("_cx").alias("x"), F.col("_cy").alias("y"))
    around = F.array(*[
        F.struct(F.pmod(F.col("_cx") + dx, F.lit(COLUMNS)).alias("x"), (F.col("_cy") + dy).alias("y")) for dx, dy in ((0, 0), (1, -1), (1, 0), (1, 1), (0, 1))
    ])

    def side(cells: Column, name: str) -> DataFrame:
        with_cap = F.when(F.col("_pole"), F.concat(cells, F.array(cap))).otherwise(cells)
        return keyed.select("place_id", "name", "country", "lat", "lon", "_name", "_country", F.explode(with_cap).alias("_cell")).alias(name)

    met = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("_name", "_country", "_cell")]
    pairs = side(around, "a").join(side(F.array(cell), "b"), met[0] & met[1] & met[2] & (F.col("a.place_id") != F.col("b.place_id"))).where(same_place("a", "b"))
    ids = F.array_sort(F.array(F.col("a.place_id"), F.col("b.place_id")))
    return pairs.select(ids[0].alias("first"), ids[1].alias("second")).distinct()
