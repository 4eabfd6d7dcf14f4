"""Claims, places and placements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph import vocab
from evigraph.functions.refs import external_references, urls
from evigraph.functions.text import normalize_text
from evigraph.operators.evidence import map_connections
from evigraph.operators.graph import first_per_key
from evigraph.session import attach_row, lookup

EARTH = "http://www.wikidata.org/entity/Q2"


def active_claims(claims: DataFrame) -> DataFrame:
    """Valued statements that count: the preferred ones of a property if there are any, else all but deprecated."""
    valued = claims.where((F.col("rank") != "deprecated") & (F.col("snaktype") == "value"))
    best = valued.groupBy("entity_id", "property").agg(F.max((F.col("rank") == "preferred").cast("int")).alias("_preferred"))
    joined = valued.join(best, ["entity_id", "property"])
    return joined.where((F.col("_preferred") == 0) | (F.col("rank") == "preferred")).drop("_preferred")


def single_items(claims: DataFrame) -> DataFrame:
    """Item of each (entity, property) whose active statements name exactly one."""
    items = active_claims(claims).where(F.col("value_id").rlike(r"^Q\d+$"))
    grouped = items.groupBy("entity_id", "property").agg(F.min("value_id").alias("item"), F.max("value_id").alias("_high"))
    return grouped.where(F.col("item") == F.col("_high")).drop("_high")


def points(claims: DataFrame) -> DataFrame:
    """Coordinates of entities whose active points agree within 0.01 degrees."""
    earth = claims.where((F.col("property") == "P625") & (F.col("globe") == EARTH))
    valid = active_claims(earth).where((F.abs("lat") <= 90) & (F.abs("lon") <= 180))
    first = F.min_by(F.struct("lat", "lon"), F.col("statement_id"))
    grouped = valid.groupBy("entity_id").agg(
        first.alias("_p"), F.min("lat").alias("_a"), F.max("lat").alias("_b"), F.min("lon").alias("_c"), F.max("lon").alias("_d")
    )
    near = (
        (F.col("_b") - F.col("_p.lat") <= 0.01) & (F.col("_p.lat") - F.col("_a") <= 0.01)
        & (F.col("_d") - F.col("_p.lon") <= 0.01) & (F.col("_p.lon") - F.col("_c") <= 0.01)
    )
    return grouped.where(near).select("entity_id", "_p.lat", "_p.lon")


def location_claims(identities: DataFrame, claims: DataFrame, begin_areas: DataFrame | None = None) -> DataFrame:
    """Place of each node: its own location claim, else the begin area of its catalogue entry.

    Identities are (node_id, node_type, item); begin areas are (node_id, place_item).
    """
    items = single_items(claims.where(F.col("property").isin("P740", "P19")))
    wanted = F.when(F.col("node_type") == "band", "P740").when(F.col("node_type").isin(*vocab.PERSON_KINDS), "P19")
    keyed = identities.withColumn("_property", wanted)
    found = items.select(F.col("entity_id").alias("_e"), F.col("property").alias("_p"), F.col("item").alias("_place"))
    joined = keyed.join(found, (F.col("item") == F.col("_e")) & (F.col("_property") == F.col("_p")), "left")
    place, origin = F.col("_place"), F.col("_property")
    if begin_areas is not None:
        areas = begin_areas.select(F.col("node_id").alias("_n"), F.col("place_item").alias("_area"))
        joined = joined.join(areas, F.col("node_id") == F.col("_n"), "left")
        origin = F.when(place.isNotNull(), origin).otherwise("MB_BEGIN_AREA")
        place = F.coalesce(place, "_area")
    role = F.when(F.col("node_type") == "band", "musical_base").otherwise("birthplace")
    return joined.select("node_id", role.alias("role"), place.alias("place_item"), origin.alias("property")).where(F.col("place_item").isNotNull())


def placements_from_claims(located: DataFrame, claims: DataFrame, labels: DataFrame) -> DataFrame:
    """Placements with point, place name and country; anything unknown drops the row. Labels are (entity_id, en, mul)."""
    named = labels.select(F.col("entity_id").alias("_l"), F.coalesce(F.nullif("en", F.lit("")), "mul").alias("_name")).where("_name is not null")
    country = single_items(claims.where(F.col("property") == "P17")).select(F.col("entity_id").alias("_c"), F.col("item").alias("_country"))
    at = points(claims).withColumnRenamed("entity_id", "_at")
    joined = lookup(located, at, "place_item", "_at")
    joined = lookup(joined, named, "place_item", "_l").withColumnRenamed("_name", "name").drop("_l")
    joined = lookup(joined, country, "place_item", "_c")
    joined = lookup(joined, named, "_country", "_l").withColumnRenamed("_name", "country")
    return joined.select("node_id", "role", F.concat(F.lit("wikidata:"), "place_item").alias("place_id"), "name", "country", "lat", "lon")


def precedence(explicit: DataFrame, backed: DataFrame, inferred: DataFrame, nodes: DataFrame) -> DataFrame:
    """One placement per (node, role): explicit before source-backed before inferred, known nodes only.

    Known nodes are hashed, so the rows, which pack so well that a task holds many times its packed size, are sorted once and not three times.
    """
    parts = [df.withColumn("_p", F.lit(i)) for i, df in enumerate((explicit, backed, inferred))]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2])
    ids = nodes.select(F.col("id").alias("_id")).hint("shuffle_hash")
    known = union.join(ids, F.col("node_id") == F.col("_id"), "left_semi")
    return first_per_key(known, ["node_id", "role"], [F.asc("_p"), F.asc("place_id")]).drop("_p")


def inferred_places(nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """Place a band's summary says it was formed in, by longest alias.

    Aliases are (place_id, alias). Summary words are cut into phrases of the alias lengths and matched by equality,
    so the aliases may be many; the text before the match must anchor it.
    """
    bands = nodes.where((F.col("node_type") == "band") & (F.coalesce("summary", F.lit("")) != "") & (F.size("sources") > 0)).select("id", "summary")
    table = aliases.select("place_id", F.lower("alias").alias("_alias"), F.size(F.split("alias", " ")).alias("_words")).distinct()
    longest = table.agg(F.max("_words").alias("_longest"))
    parts = F.split(F.lower("summary"), r"[^\p{L}\p{N}_]+")
    words = attach_row(bands.withColumn("_parts", parts), longest)
    lengths = words.select("id", "summary", "_parts", F.explode(F.sequence(F.lit(1), F.least("_longest", F.size("_parts")))).alias("_words"))
    spans = lengths.select("id", "summary", F.explode(
        F.transform(F.sequence(F.lit(1), F.size("_parts") - F.col("_words") + 1), lambda i: F.array_join(F.slice("_parts", i, F.col("_words")), " "))
    ).alias("_span")).distinct()
    hits = spans.join(table.select("place_id", "_alias"), F.col("_span") == F.col("_alias")).select("id", "summary", "place_id", "_alias")
    at = F.regexp_instr("summary", F.concat(F.lit(r"(?i)\b\Q"), "_alias", F.lit(r"\E\b")))
    start = F.greatest(F.lit(1), at - 80)
    before = F.substr(F.col("summary"), start, at - start)
    anchored = before.rlike(r"(?i)\b(?:formed|founded|created|established)\b[^.!?]{0,48}\b(?:in|at)\s*$") | before.rlike(r"(?i)\b(?:band|group|collective)\s+from\s*$")
    good = hits.where((at > 0) & anchored)
    return first_per_key(good, ["id"], [F.desc(F.length("_alias")), F.asc("place_id")]).select(F.col("id").alias("node_id"), "place_id")


def cross_place_relations(edges: DataFrame, placements: DataFrame) -> DataFrame:
    """Sourced relations whose ends lie in different places; a base counts before a birthplace."""
    base = (F.col("role") != "musical_base").cast("int")
    at = first_per_key(placements.withColumn("_base", base), ["node_id"], [F.asc("_base"), F.asc("place_id")])
    kept = map_connections(edges).where(F.size("sources") > 0).select("id", "source", "target", "type")

    def side(prefix: str) -> DataFrame:
        return at.select(F.col("node_id").alias(f"_{prefix}"), F.col("place_id").alias(f"{prefix}_place"), F.col("role").alias(f"{prefix}_role"))

    joined = lookup(lookup(kept, side("source"), "source", "_source"), side("target"), "target", "_target")
    return joined.where(F.col("source_place") != F.col("target_place")).select("id", "source_place", "target_place", "source_role", "target_role", "type")


def extend_atlas(nodes: DataFrame, placements: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Match atlas entries to nodes by catalogue address, else by band name without contradiction, else add a node.

    Entries are (entry_id, label, mbid, city, country, lat, lon, year). Returns new nodes and new placements.
    """
    address = F.concat(F.lit("https://musicbrainz.org/artist/"), "mbid")
    keyed = entries.withColumn("_url", address).withColumn("_name", F.lower("label"))
    by_url = nodes.select("id", F.explode(urls(F.col("sources"))).alias("_url")).groupBy("_url").agg(F.max("id").alias("_by_url"))
    contradicting = F.filter(urls(F.col("sources")), lambda u: F.startswith(u, F.lit("https://musicbrainz.org/artist/")))
    bands = nodes.where(F.col("node_type") == "band").select(F.lower("label").alias("_name"), "id", contradicting.alias("_urls"))
    by_name = first_per_key(bands, ["_name"], [F.desc("id")]).select("_name", F.col("id").alias("_by_name"), "_urls")
    joined = keyed.join(by_url, "_url", "left").join(by_name, "_name", "left")
    conflict = F.coalesce(F.exists("_urls", lambda u: u != F.col("_url")), F.lit(False))
    node = F.coalesce("_by_url", F.when(~conflict, F.col("_by_name")))
    matched = joined.withColumn("node_id", F.coalesce(node, F.concat(F.lit("atlas:"), "mbid"))).withColumn("_new", node.isNull())
    fresh = first_per_key(matched.where("_new"), ["node_id"], [F.asc("entry_id")]).select(F.col("node_id").alias("id"), "label", F.col("year").alias("era_start"))
    placed = placements.where(F.col("role") == "musical_base").select(F.col("node_id").alias("_placed")).distinct()
    open_rows = matched.join(placed, F.col("node_id") == F.col("_placed"), "left_anti")
    added = first_per_key(open_rows, ["node_id"], [F.asc("entry_id")]).select(
        "node_id", F.lit("musical_base").alias("role"), F.concat(F.lit("atlas:"), "entry_id").alias("place_id"), F.col("city").alias("name"), "country", "lat", "lon"
    )
    return fresh, added


def unresolved(targets: DataFrame, states: DataFrame, located: DataFrame, placements: DataFrame) -> DataFrame:
    """Why each target has no placement."""
    placed = placements.select(F.col("node_id").alias("_p")).distinct()
    claimed = located.select(F.col("node_id").alias("_c")).distinct()
    missing = targets.select("id").join(placed, F.col("id") == F.col("_p"), "left_anti")
    joined = missing.join(states.select(F.col("node_id").alias("_n"), "state"), F.col("id") == F.col("_n"), "left").join(claimed, F.col("id") == F.col("_c"), "left")
    reason = (
        F.when(F.col("state") == "identity_conflict", "identity_conflict")
        .when(F.col("state").isNull() | (F.col("state") == "identity_unresolved"), "identity_unresolved")
        .when(F.col("_c").isNull(), "location_claim_missing").otherwise("place_or_coordinates_missing")
    )
    return joined.select("id", reason.alias("reason"))


def label_identities(unmatched: DataFrame, pages: DataFrame, classes: DataFrame, located: DataFrame) -> DataFrame:
    """Nodes whose exact label names a page of the right class, once among all nodes, with a location claim.

    Unmatched are (id, label, node_type, name_count); pages (title, item, item_label); classes (item, relation, label).
    """
    joined = unmatched.join(pages, F.col("label") == F.col("title")).where(normalize_text("item_label") == normalize_text("label"))
    kinds = classes.groupBy(F.col("item").alias("_item")).agg(
        F.max((F.col("class_relation") == "P31") & F.col("class_label").rlike(vocab.BAND_CLASS)).alias("_band"),
        F.max((F.col("class_relation") == "P31") & (F.col("class_label") == "human")).alias("_human"),
        F.max((F.col("class_relation") == "P106") & F.col("class_label").rlike(vocab.PERSON_OCCUPATION)).alias("_music"),
    )
    typed = joined.join(kinds, F.col("item") == F.col("_item"))
    right = F.when(F.col("node_type") == "band", F.col("_band")).otherwise(F.col("_human") & F.col("_music"))
    placed = located.select(F.col("item").alias("_located")).distinct()
    return typed.where(right & (F.col("name_count") == 1)).join(placed, F.col("item") == F.col("_located"), "left_semi").select("id", "item")


def agreed_years(first: DataFrame, second: DataFrame, manual: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Start years two catalogues agree on, completed by manual rows, and conflicts between the two sets.

    First is (id, claims, status, year), second (id, type, year), manual (id, year).
    """
    single = first.where((F.col("status") == "candidate") & (F.col("claims") == 1)).select("id", "year")
    groups = second.where(F.col("type") == "Group").select(F.col("id").alias("_id"), F.col("year").alias("_year"))
    agreed = single.join(groups, (F.col("id") == F.col("_id")) & (F.col("year") == F.col("_year"))).select("id", "year")
    hand = manual.select(F.col("id").alias("_id"), F.col("year").alias("_year"))
    both = agreed.join(hand, F.col("id") == F.col("_id"), "full")
    conflicts = both.where((F.col("id").isNotNull()) & (F.col("_year") != F.col("year"))).select(F.lit("conflicting_year").alias("rule"), F.col("id").alias("key"))
    return both.select(F.coalesce("id", "_id").alias("id"), F.coalesce("_year", "year").alias("year")), conflicts


def statement_years(claims: DataFrame, low: int = 1400, high: int = 2026) -> DataFrame:
    """Years of dated statements that are not deprecated, with their reference count and first outside references."""
    year = F.try_to_number(F.substring("value_time", 2, 4), F.lit("9999")).cast("int")
    rows = claims.where(F.col("rank") != "deprecated").withColumn("year", year)
    return rows.where(F.col("year").between(low, high)).select(
        "entity_id", "property", "statement_id", "year", F.size("reference_urls").cast("bigint").alias("references"),
        external_references(F.col("reference_urls")).alias("external"),
    )


def year_status(nodes: DataFrame, found: DataFrame, years: DataFrame) -> DataFrame:
    """Audit status of nodes without a year: not-found, no-claim, conflicting-years or candidate."""
    counted = years.groupBy(F.col("entity_id").alias("_e")).agg(F.count_distinct("year").alias("_n"))
    joined = nodes.join(found.select(F.col("node_id").alias("_node"), "item"), F.col("id") == F.col("_node"), "left").join(counted, F.col("item") == F.col("_e"), "left")
    status = (
        F.when(F.col("item").isNull(), "not-found").when(F.col("node_type") == "genre", "genre-needs-context")
        .when(F.coalesce("_n", F.lit(0)) == 0, "no-claim").when(F.col("_n") > 1, "conflicting-years").otherwise("candidate")
    )
    return joined.select("id", status.alias("status"))


def claim_leads(entities: DataFrame, claims: DataFrame, labels: DataFrame) -> DataFrame:
    """Fact texts from name-origin and birth-name statements. Entities are (entity_id, item, label, node_type)."""
    label = F.col("label")
    named = claims.where(F.col("property") == "P138").join(
        labels.select(F.col("entity_id").alias("_t"), F.col("en").alias("_target")), F.col("value_id") == F.col("_t")
    ).select(F.col("entity_id").alias("_item"), "statement_id", "reference_urls", "_target")
    origin = entities.join(named, F.col("item") == F.col("_item")).where(F.lower("_target") != F.lower(label)).select(
        "entity_id", "statement_id", F.lit("name-origin").alias("category"),
        F.concat(F.lit("The name "), label, F.lit(" was taken from "), "_target", F.lit(".")).alias("text"), "reference_urls",
    )
    births = claims.where(F.col("property") == "P1477").select(F.col("entity_id").alias("_item"), "statement_id", "reference_urls", F.col("value_text").alias("_name"))
    subset = F.size(F.array_except(F.split(F.lower(label), r"\s+"), F.split(F.lower("_name"), r"\s+"))) == 0
    birth = entities.where(F.col("node_type").isin(*vocab.PERSON_KINDS)).join(births, F.col("item") == F.col("_item")).where((F.col("_name") != "") & ~subset).select(
        "entity_id", "statement_id", F.lit("birth-name").alias("category"),
        F.concat(label, F.lit(" was born under the name "), "_name", F.lit(".")).alias("text"), "reference_urls",
    )
    union = origin.unionByName(birth).where(F.length("text").between(35, 200) & F.col("statement_id").isNotNull())
    return union.select("entity_id", "statement_id", "category", "text", external_references(F.col("reference_urls")).alias("references"))


def first_releases(releases: DataFrame) -> DataFrame:
    """Earliest dated primary release of each person and how many releases count.

    Releases are (person, release_id, title, date, secondary_types).
    """
    skipped = F.arrays_overlap("secondary_types", F.array(*[F.lit(t) for t in vocab.SECONDARY_RELEASES]))
    usable = releases.where(F.col("date").rlike(r"^\d{4}(?:$|-)") & ~F.coalesce(skipped, F.lit(False)))
    order = F.struct("date", "release_id")
    return usable.groupBy("person").agg(
        F.count(F.lit(1)).alias("releases"), F.min_by(F.struct("release_id", "title", "date"), order).alias("_f")
    ).select("person", "releases", "_f.release_id", "_f.title", "_f.date", F.substring("_f.date", 1, 4).cast("int").alias("year"))


def half_century_pool(people: DataFrame, known: DataFrame, limit: int = 70) -> DataFrame:
    """Best linked people of each half century who are not known by name."""
    from evigraph.operators.graph import top_per_group

    binned = people.where(F.col("start_year").between(1600, 1950)).withColumn("bin", (F.floor(F.least(F.col("start_year"), F.lit(1949)) / 50) * 50).cast("bigint"))
    ranked = top_per_group(binned, ["bin"], [F.desc("sitelinks"), F.asc("person_id")], limit)
    names = known.select(F.lower("label").alias("_known")).distinct()
    fresh = ranked.join(names, F.lower("name") == F.col("_known"), "left_anti").where(~F.col("name").rlike(r"^Q\d+$"))
    return fresh.select("bin", "person_id", "name")


def genre_edges(artists: DataFrame, genres: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Zone of each artist by its genres and one relation per known genre.

    Artists are (id, genre_ids, references); genres (genre_id, node_id, label, zone, precedence). The zone of the genre
    with the lowest precedence wins, `classical-history` when no genre is known.
    """
    exploded = artists.select("id", F.explode(F.array_distinct("genre_ids")).alias("genre_id"))
    joined = exploded.join(genres, "genre_id")
    best = first_per_key(joined, ["id"], [F.asc("precedence"), F.asc("genre_id")]).select(F.col("id").alias("_a"), F.col("zone").alias("_zone"))
    note = F.when(F.col("references") > 0, "reference attached").otherwise("no reference attached")
    placed = artists.join(best, F.col("id") == F.col("_a"), "left").select(
        "id", F.coalesce("_zone", F.lit("classical-history")).alias("zone"), note.alias("note")
    )
    edges = joined.select(
        F.concat_ws("-", F.lit("early"), "id", "node_id").alias("edge_id"), F.col("id").alias("source"), F.col("node_id").alias("target"),
        F.concat(F.lit("Associated with "), "label").alias("label"),
    )
    return placed, edges


def geography_summary(
    targets: DataFrame, states: DataFrame, located: DataFrame, placements: DataFrame, nodes: DataFrame, bridges: DataFrame, missing: DataFrame
) -> DataFrame:
    """One row of counts on a geography run; `missing` are the rows of `unresolved`."""
    kinds = nodes.select(F.col("id").alias("_id"), "node_type")
    placed = placements.join(kinds, F.col("node_id") == F.col("_id"), "left")
    counts = [
        targets.agg(F.count(F.lit(1)).alias("graph_targets")),
        states.agg(F.count_if(F.col("state") == "resolved").alias("identified"), F.count_if(F.col("state") == "identity_conflict").alias("identity_conflicts")),
        located.agg(F.count(F.lit(1)).alias("claims")),
        placed.agg(
            F.count(F.lit(1)).alias("placed"), F.count_if(F.col("node_type") == "band").alias("bands_placed"),
            F.count_if(F.col("role") == "birthplace").alias("people_with_birthplace"),
        ),
        missing.agg(F.count(F.lit(1)).alias("unplaced")),
        bridges.agg(F.count(F.lit(1)).alias("cross_place_relations")),
    ]
    row = counts[0]
    for part in counts[1:]:
        row = attach_row(row, part)
    return row
