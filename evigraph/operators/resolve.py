"""Entity resolution: label indexes, identity reconciliation, catalogue memberships, seeds and promotion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph import vocab
from evigraph.functions import refs
from evigraph.functions.hashing import edge_key
from evigraph.functions.text import (
    canonical_title, contains_any, normalize_text, period_text, slugify, title_keys,
)
from evigraph.operators.evidence import map_connections
from evigraph.operators.graph import first_per_key, top_per_group
from evigraph.operators.titles import page_matches_kind, scope_reason


def title_index(nodes: DataFrame, order: str = "id") -> DataFrame:
    """key -> node id over labels and aliases with and without disambiguation; the first node in order wins."""
    names = F.explode(F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>"))))
    rows = nodes.select("id", F.col(order).alias("_order"), names.alias("_name")).where(F.col("_name") != "")
    keys = rows.select("id", "_order", F.explode(title_keys("_name")).alias("key"))
    return first_per_key(keys, ["key"], [F.asc("_order"), F.asc("id")]).select("key", "id")


def resolve_titles(titles: DataFrame, index: DataFrame, title: str = "title") -> DataFrame:
    """Node id of each title through its full, then its canonical key; a slug when neither is known."""
    wanted = titles.select(F.col(title).alias("_title")).distinct()
    keys = wanted.select("_title", F.posexplode(title_keys("_title")).alias("_pos", "_key"))
    hits = keys.join(index.select(F.col("key").alias("_key"), F.col("id").alias("_hit")), "_key")
    best = first_per_key(hits, ["_title"], [F.asc("_pos")]).select("_title", "_hit")
    joined = titles.join(best, F.col(title) == F.col("_title"), "left")
    return joined.withColumn("node_id", F.coalesce("_hit", slugify(canonical_title(title)))).withColumn(
        "known", F.col("_hit").isNotNull()
    ).drop("_title", "_hit")


def unique_index(rows: DataFrame, key: Column, value: str = "id") -> DataFrame:
    """key -> value where exactly one row has the key; contested keys are left out."""
    counted = rows.select(key.alias("key"), F.col(value).alias("_value")).where(F.col("key").isNotNull() & (F.col("key") != ""))
    grouped = counted.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.min("_value").alias(value))
    return grouped.where("_n = 1").drop("_n")


def feedback_seeds(nodes: DataFrame, reviews: DataFrame, recently_checked: DataFrame, limit: int) -> DataFrame:
    """Nodes behind weak-connection rejections: unique label, agreeing kind and identity, not checked lately.

    Reviews have seed_name, requested_kind, status, review_reason_code, payload_kind, catalogue_id and order.
    """
    people = nodes.where(F.col("node_type").isin(*vocab.MUSIC_ENTITY_KINDS))
    index = unique_index(people, F.lower(F.trim("label")))
    own = people.select(
        F.col("id").alias("_id"), refs.artist_catalogue_id(F.col("sources")).alias("_own"),
        F.when(F.col("node_type") == "band", "band").when(
            (F.col("node_type") == "guitarist") | F.array_contains("roles", "guitarist"), "guitarist"
        ).otherwise("artist").alias("_kind"),
    )
    weak = reviews.where((F.col("status") == "rejected") & (F.col("review_reason_code") == "weak_connection") & (F.col("payload_kind") != "typed_connection"))
    hits = weak.select("seed_name", "requested_kind", "catalogue_id", "order").join(
        index.withColumnRenamed("id", "node_id"), F.lower(F.trim("seed_name")) == F.col("key")
    )
    reviewed = F.when(F.col("catalogue_id").rlike(vocab.UUID), F.lower("catalogue_id"))
    joined = hits.join(own, F.col("node_id") == F.col("_id")).where(F.col("requested_kind") == F.col("_kind"))
    agreeing = joined.withColumn("_reviewed", reviewed).where(
        F.col("_reviewed").isNull() | F.col("_own").isNull() | (F.col("_reviewed") == F.col("_own"))
    )
    fresh = agreeing.join(recently_checked.select(F.col("id").alias("_seen")).distinct(), F.col("node_id") == F.col("_seen"), "left_anti")
    first = first_per_key(fresh, ["node_id"], [F.asc("order")])
    return first.orderBy("order", "node_id").limit(limit).select("node_id", F.coalesce("_own", "_reviewed").alias("catalogue_id"))


def reconcile(direct: DataFrame, by_page: DataFrame) -> DataFrame:
    """One identity per node from two sources; disagreement is a conflict. Inputs are (node_id, item)."""
    a = direct.select("node_id", F.col("item").alias("_direct"))
    b = by_page.select("node_id", F.col("item").alias("_page"))
    joined = a.join(b, "node_id", "full")
    conflict = F.coalesce(F.col("_direct") != F.col("_page"), F.lit(False))
    return joined.select(
        "node_id", F.when(~conflict, F.coalesce("_direct", "_page")).alias("item"),
        F.when(conflict, "identity_conflict").when(F.coalesce("_direct", "_page").isNull(), "identity_unresolved").otherwise("resolved").alias("state"),
    )


def _catalogued(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("node_type").isin(*vocab.MUSIC_ENTITY_KINDS)).select(
        "id", "label", "node_type", refs.artist_catalogue_id(F.col("sources")).alias("mbid")
    )


def membership_proposals(nodes: DataFrame, relations: DataFrame, edges: DataFrame) -> DataFrame:
    """Proposed memberships between catalogued nodes, with their distinct periods.

    Relations are (seed_mbid, seed_type, type_id, other_id, other_type, begin, end).
    """
    known = _catalogued(nodes)
    index = unique_index(known, F.col("mbid"))
    seeds = index.join(known.drop("mbid"), "id").select(
        F.col("key").alias("_seed_mbid"), F.col("id").alias("_seed"), F.col("node_type").alias("_seed_kind")
    )
    others = index.join(known.drop("mbid"), "id").select(
        F.col("key").alias("_other_mbid"), F.col("id").alias("_other"), F.col("node_type").alias("_other_kind")
    )
    band_seed = F.col("_seed_kind") == "band"
    joined = relations.where(F.col("type_id") == vocab.MEMBERSHIP_TYPE_ID).join(seeds, F.col("seed_mbid") == F.col("_seed_mbid"))
    joined = joined.join(others, F.lower("other_id") == F.col("_other_mbid")).where(F.col("_seed") != F.col("_other"))
    fits = (
        (F.col("seed_type") == F.when(band_seed, "Group").otherwise("Person"))
        & (F.col("other_type") == F.when(band_seed, "Person").otherwise("Group"))
        & F.when(band_seed, F.col("_other_kind").isin(*vocab.PERSON_KINDS)).otherwise(F.col("_other_kind") == "band")
    )
    person, band = F.when(band_seed, F.col("_other")).otherwise(F.col("_seed")), F.when(band_seed, F.col("_seed")).otherwise(F.col("_other"))
    pairs = joined.where(fits).select(
        person.alias("source"), band.alias("target"),
        F.nullif("begin", F.lit("")).alias("begin"), F.nullif("end", F.lit("")).alias("end"),
    )
    grouped = pairs.groupBy("source", "target").agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("periods"))
    existing = map_connections(edges.where(F.col("type") == "member_of")).select(F.col("source").alias("_s"), F.col("target").alias("_t")).distinct()
    fresh = grouped.join(existing, (F.col("source") == F.col("_s")) & (F.col("target") == F.col("_t")), "left_anti")
    return fresh.select(F.concat_ws("-", F.lit("mb-member"), "source", "target").alias("id"), "source", "target", "periods")


def membership_discoveries(nodes: DataFrame, relations: DataFrame, limit: int = 3) -> DataFrame:
    """Bands of catalogued persons that are unknown by id and by name, the first `limit` by name per person."""
    known = _catalogued(nodes)
    seeds = known.where(F.col("node_type") != "band").where("mbid is not null").select(F.col("mbid").alias("_mbid"), F.col("id").alias("seed"))
    ids = known.select(F.col("mbid").alias("_known")).where("_known is not null").distinct()
    labels = nodes.select(F.lower(F.trim("label")).alias("_label")).distinct()
    found = relations.where(
        (F.col("type_id") == vocab.MEMBERSHIP_TYPE_ID) & (F.col("other_type") == "Group") & (F.col("seed_type") == "Person")
        & F.col("other_id").rlike(vocab.UUID) & (F.trim("other_name") != "")
    ).join(seeds, F.col("seed_mbid") == F.col("_mbid"))
    unknown = found.join(ids, F.lower("other_id") == F.col("_known"), "left_anti").join(
        labels, F.lower(F.trim("other_name")) == F.col("_label"), "left_anti"
    )
    grouped = unknown.groupBy("seed", F.lower("other_id").alias("mbid")).agg(F.min(F.trim("other_name")).alias("name"), F.count(F.lit(1)).alias("relations"))
    ranked = top_per_group(grouped, ["seed"], [F.asc("name"), F.asc("mbid")], limit)
    return ranked.select("seed", F.concat(F.lit("mb-band-"), "mbid").alias("target"), "name", "relations")


def membership_candidates(seeds: DataFrame, relations: DataFrame, limit: int = 12) -> DataFrame:
    """Documented memberships of seeds: direction and type follow the kind of the seed, one row per other artist.

    Seeds are (seed, kind, seed_mbid); relations (seed_mbid, type, direction, other_id, other_name, other_type,
    begin, end, pos).
    """
    joined = seeds.join(relations, "seed_mbid")
    band = F.col("kind") == "band"
    other_kind = F.when(band, "artist").otherwise("band")
    ok = (
        (F.col("type") == "member of band") & (F.col("direction") == F.when(band, "backward").otherwise("forward"))
        & (F.col("other_type") == F.when(band, "Person").otherwise("Group")) & (F.coalesce("other_id", F.lit("")) != "")
        & (normalize_text("other_name") != normalize_text("seed")) & scope_reason(F.col("other_name"), other_kind, F.lit("")).isNull()
    )
    first = first_per_key(joined.where(ok), ["seed", "other_id"], [F.asc("pos")])
    kept = top_per_group(first, ["seed"], [F.asc("pos"), F.asc("other_id")], limit)
    return kept.select("seed", F.col("other_name").alias("title"), other_kind.alias("kind"), "begin", "end", F.col("rank").cast("bigint").alias("rank"))


def promoted_edges(candidates: DataFrame) -> DataFrame:
    """Relations from candidates with evidence; the direction of a membership follows the band.

    Candidates are (seed_id, target_id, relation) with relation as in the package schema.
    """
    r = F.col("relation")
    usable = (
        r["type"].isin(*vocab.RELATION_TYPES) & r["source_url"].rlike("^https?://") & (F.coalesce(r["context"], F.lit("")) != "")
        & (F.col("seed_id") != F.col("target_id"))
    )
    flip = (r["type"] == "member_of") & F.coalesce(r["seed_is_band"], F.lit(False))
    source, target = F.when(flip, F.col("target_id")).otherwise(F.col("seed_id")), F.when(flip, F.col("seed_id")).otherwise(F.col("target_id"))
    kept = candidates.where(usable).select(source.alias("source"), target.alias("target"), "relation")
    return kept.select(
        F.concat_ws("-", F.lit("brain"), "source", "target", r["type"]).alias("id"), "source", "target", r["type"].alias("type"),
        F.coalesce(F.nullif(r["label"], F.lit("")), F.translate(r["type"], "_", " ")).alias("label"),
        F.coalesce(F.when(r["strength"] != 0, r["strength"]), F.lit(0.6)).alias("strength"), F.array(r["context"]).alias("context"),
    )


def promotion_patch(candidates: DataFrame, nodes: DataFrame, edges: DataFrame, max_new: int, per_seed: int) -> tuple[DataFrame, DataFrame]:
    """New nodes and relations of accepted candidates in set form.

    Candidates are (row_order, pos, seed_id, title, kind, zone, relation). A node several rows would make is made
    once, by the first; the caps count nodes after this, so a cap never hides a repeat. Relations need both ends.
    """
    resolved = resolve_titles(candidates, title_index(nodes))
    fresh = first_per_key(resolved.where(~F.col("known") & (F.coalesce("zone", F.lit("")) != "")), ["node_id"], [F.asc("row_order"), F.asc("pos")])
    capped = top_per_group(fresh, ["seed_id"], [F.asc("row_order"), F.asc("pos")], per_seed).drop("rank")
    ordered = capped.orderBy("row_order", "pos").limit(max_new)
    made = ordered.select(F.col("node_id").alias("id"), canonical_title("title").alias("label"), F.col("kind").alias("node_type"), "zone")
    ids = nodes.select("id").union(made.select("id")).withColumnRenamed("id", "_id").distinct()
    ends = resolved.select("seed_id", F.col("node_id").alias("target_id"), "relation", "row_order", "pos").join(ids, F.col("target_id") == F.col("_id"), "left_semi")
    linked = promoted_edges(ends)
    key = edge_key(F.col("source"), F.col("target"), F.col("type"), F.col("label"))
    known = edges.select(key.alias("_known")).distinct()
    new = first_per_key(linked.withColumn("_key", key), ["_key"], [F.asc("id")]).join(known, F.col("_key") == F.col("_known"), "left_anti").drop("_key")
    return made, new


def stage_memberships(proposals: DataFrame, edges: DataFrame, recorded: DataFrame, limit: int) -> DataFrame:
    """stage, already_present, needs_review or deferred for approved proposals; the first `limit` ids are not deferred."""
    open_rows = proposals.where(F.col("status") == "approved").join(recorded.select(F.col("id").alias("_r")).distinct(), F.col("id") == F.col("_r"), "left_anti")
    chosen = open_rows.select("id").orderBy("id").limit(limit).select(F.col("id").alias("_chosen"))
    ranked = open_rows.join(chosen, F.col("id") == F.col("_chosen"), "left")
    sourced = F.exists("sources", lambda s: s["provider"] == "musicbrainz")
    present = edges.where(F.col("type") == "member_of").groupBy(F.col("source").alias("_s"), F.col("target").alias("_t")).agg(
        F.max((sourced & (F.col("label") == "Member of")).cast("int")).alias("_good")
    )
    joined = ranked.join(present, (F.col("source") == F.col("_s")) & (F.col("target") == F.col("_t")), "left")
    state = (
        F.when(F.col("_chosen").isNull(), "deferred").when(F.col("_s").isNull(), "stage").when(F.col("_good") == 1, "already_present").otherwise("needs_review")
    )
    return joined.select("id", state.alias("state"))


def period_lines(proposals: DataFrame) -> DataFrame:
    """Readable periods of each proposal; a malformed date makes the row invalid."""
    date_ok = lambda v: v.isNull() | v.rlike(vocab.PARTIAL_DATE)
    valid = (F.size("periods") > 0) & F.forall("periods", lambda p: date_ok(p["begin"]) & date_ok(p["end"]))
    text = F.array_join(F.transform("periods", lambda p: period_text(p["begin"], p["end"])), "; ")
    return proposals.select("id", F.coalesce(valid, F.lit(False)).alias("valid"), text.alias("text"))


def has_expected_periods(expected: Column, actual: Column) -> Column:
    """Some actual period exists and every expected one is among them, nulls compared as values."""
    return (F.size(actual) > 0) & F.forall(
        expected, lambda p: F.exists(actual, lambda a: a["begin"].eqNullSafe(p["begin"]) & a["end"].eqNullSafe(p["end"]))
    )


def group_start(begin: Column, current_year: int) -> Column:
    """Year of a partial date when it lies between 1600 and the current year."""
    year = F.when(begin.rlike(vocab.PARTIAL_DATE), F.substring(begin, 1, 4).cast("int"))
    return F.when(year.between(1600, current_year), year)


def readback(ledger: DataFrame, candidates: DataFrame, live: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """Whether each ledger row agrees with its candidate and with the live relation.

    With `entities` (id, label, node_type, sources), and a `discovery` (name, mbid) on the candidates, also whether the band that a candidate discovered
    is live as it was proposed: under its own id, as a band of that name with its catalogue page; true where nothing was discovered.
    """
    c = candidates.select(
        F.col("id").alias("_c"), F.col("status").alias("_status"), F.col("edge_id").alias("_edge"), F.col("source").alias("_cs"), F.col("target").alias("_ct")
    )
    sourced = F.exists("sources", lambda s: s["provider"] == "musicbrainz")
    r = live.where((F.col("type") == "member_of") & (F.col("label") == "Member of") & sourced).select(
        F.col("source").alias("_rs"), F.col("target").alias("_rt")
    ).distinct()
    joined = ledger.join(c, F.col("id") == F.col("_c"), "left").join(r, (F.col("source") == F.col("_rs")) & (F.col("target") == F.col("_rt")), "left")
    approved = F.coalesce(
        F.col("_status").isin("approved", "imported") & (F.col("_edge") == F.col("edge_id")) & (F.col("_cs") == F.col("source")) & (F.col("_ct") == F.col("target")),
        F.lit(False),
    )
    result = [approved.alias("approved"), F.col("_rs").isNotNull().alias("published")]
    if entities is None:
        return joined.select("id", *result)
    found = candidates.select(F.col("id").alias("_d"), F.col("discovery.name").alias("_name"), F.col("discovery.mbid").alias("_mbid"), F.col("discovery").isNotNull().alias("_found"))
    bands = entities.where(F.col("node_type") == "band").select(F.col("id").alias("_band"), F.col("label").alias("_label"), F.col("sources").alias("_sources"))
    joined = joined.join(found, F.col("id") == F.col("_d"), "left").join(bands, F.col("target") == F.col("_band"), "left")
    page = F.concat(F.lit("https://musicbrainz.org/artist/"), "_mbid")
    listed = F.exists("_sources", lambda s: (s["provider"] == "musicbrainz") & (s["url"] == page))
    matches = (F.col("target") == F.concat(F.lit("mb-band-"), "_mbid")) & (F.col("_label") == F.col("_name")) & listed
    return joined.select("id", *result, (~F.coalesce("_found", F.lit(False)) | F.coalesce(matches, F.lit(False))).alias("band_live"))


def publishable(ledger: DataFrame, candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of approved, not yet imported candidates whose proposal and edge name the same addresses."""
    c = candidates.where(F.col("status") == "approved").select(F.col("id").alias("_c"), F.array_sort(F.array_distinct(refs.urls(F.col("sources")))).alias("_proposal"))
    e = edges.select(F.col("id").alias("_e"), F.array_sort(F.array_distinct(refs.urls(F.col("sources")))).alias("_edge"))
    joined = ledger.join(c, F.col("id") == F.col("_c")).join(e, F.col("edge_id") == F.col("_e"))
    return joined.where((F.size("_proposal") > 0) & F.col("_proposal").eqNullSafe(F.col("_edge"))).select("id", "edge_id")


def request_of_seed(seeds: DataFrame, requests: DataFrame) -> DataFrame:
    """Request a seed came from: first exact (name, kind), else the only request, else null."""
    listed = requests.select("request_id", "position", F.explode("seeds").alias("s"))
    keyed = listed.select("request_id", "position", F.lower("s.name").alias("_name"), F.col("s.kind").alias("_kind"))
    first = first_per_key(keyed, ["_name", "_kind"], [F.asc("position")]).select("_name", "_kind", F.col("request_id").alias("_hit"))
    only = requests.agg(F.when(F.count(F.lit(1)) == 1, F.min("request_id")).alias("_only"))
    joined = seeds.join(first, (F.lower("name") == F.col("_name")) & (F.col("kind") == F.col("_kind")), "left")
    from evigraph.session import attach_row

    return attach_row(joined, only).withColumn("request_id", F.coalesce("_hit", "_only")).drop("_name", "_kind", "_hit", "_only")


def catalogue_match(seeds: DataFrame, catalogue: DataFrame, key: Sequence[str] = ("seed", "kind")) -> DataFrame:
    """Best catalogue entry per seed: a linked id beats a name, then the catalogue's own rank.

    Seeds are (seed, kind, linked_id) and may have further columns; one row is returned for each `key`. The catalogue is (item_id, name, type,
    description, rank). It is cut to its best entry for each id, and for each name and kind, before a seed meets it, so seeds of one name are never
    joined with all entries of that name.
    """
    by_id = catalogue.groupBy(F.col("item_id").alias("_id")).agg(F.min(F.struct("rank")).alias("_id_best"))

    def fits(kind: str) -> Column:
        expected = F.lit("Group") if kind == "band" else F.lit("Person") if kind in vocab.PERSON_KINDS else F.lit(None)
        described = contains_any(F.lower("description"), vocab.DESCRIPTORS[kind]) if kind in vocab.DESCRIPTORS else F.lit(False)
        return F.coalesce((F.col("type") == expected) | described, F.lit(False))

    kinds = dict.fromkeys(("band", *vocab.PERSON_KINDS, *vocab.DESCRIPTORS))
    listed = F.explode(F.array_compact(F.array(*[F.when(fits(kind), F.lit(kind)) for kind in kinds])))
    named = catalogue.select(normalize_text("name").alias("_name"), F.struct("rank", "item_id").alias("_entry"), listed.alias("_kind"))
    named = named.groupBy("_name", "_kind").agg(F.min("_entry").alias("_named"))
    met = seeds.withColumn("_key", normalize_text("seed")).join(by_id, F.col("linked_id") == F.col("_id"), "left")
    met = met.join(named, (F.col("_key") == F.col("_name")) & (F.col("kind") == F.col("_kind")), "left")
    linked = F.col("_id").isNotNull()
    met = met.where(linked | F.col("_name").isNotNull()).select(
        *dict.fromkeys((*key, "seed", "kind")), F.when(linked, F.col("_id")).otherwise(F.col("_named.item_id")).alias("item_id"),
        F.when(linked, F.col("_id_best.rank")).otherwise(F.col("_named.rank")).alias("_rank_of"), F.when(linked, "linked").otherwise("name").alias("matched_by"),
    )
    best = first_per_key(met, list(key), [F.asc("matched_by"), F.asc("_rank_of"), F.asc("item_id")])
    return best.drop("_rank_of")


def page_for_seed(seeds: DataFrame, pages: DataFrame) -> DataFrame:
    """First page among preferred title, name and `name (suffix)` that fits the kind; seeds are (seed, kind, preferred)."""
    suffixes = F.create_map(*[p for kind, words in vocab.TITLE_SUFFIXES.items() for p in (F.lit(kind), F.array(*[F.lit(w) for w in words]))])
    none = F.array().cast("array<string>")
    names = F.concat(
        F.array("preferred", "seed"),
        F.transform(F.coalesce(F.element_at(suffixes, F.col("kind")), none), lambda s: F.concat("seed", F.lit(" ("), s, F.lit(")"))),
    )
    tried = seeds.select("seed", "kind", F.posexplode(names).alias("_pos", "_title")).where(F.col("_title").isNotNull())
    joined = tried.join(pages, normalize_text("_title") == normalize_text("title"))
    fits = ~F.col("kind").isin(*vocab.MUSIC_ENTITY_KINDS) | page_matches_kind(F.col("extract"), F.col("categories"), F.col("kind"))
    return first_per_key(joined.where(fits), ["seed", "kind"], [F.asc("_pos"), F.asc("title")]).select("seed", "kind", "title")


def resolve_redirects(titles: DataFrame, redirects: DataFrame, title: str = "title", hops: int = 3) -> DataFrame:
    """Follow redirects a bounded number of times."""
    table = redirects.select(normalize_text("from_title").alias("_from"), F.col("to_title").alias("_to"))
    table = first_per_key(table, ["_from"], [F.asc("_to")])
    out = titles.withColumn("resolved", F.col(title))
    for _ in range(hops):
        out = out.join(table, normalize_text("resolved") == F.col("_from"), "left").withColumn("resolved", F.coalesce("_to", "resolved")).drop("_from", "_to")
    return out


def archive_leads(seeds: DataFrame, items: DataFrame, limit: int = 2) -> DataFrame:
    """Archive items with the seed among their creators word for word, at most `limit` per seed."""
    def words(value: Column) -> Column:
        return F.array_join(F.regexp_extract_all(F.lower(value), F.lit(r"([\p{L}\p{N}_]+)"), 1), " ")

    keyed = items.where(F.col("identifier").rlike(r"^[A-Za-z0-9._-]+$")).select("identifier", "title", "rank", F.explode("creators").alias("_creator"))
    joined = seeds.select("seed", words(F.col("seed")).alias("_key")).join(keyed.withColumn("_key", words(F.col("_creator"))), "_key")
    distinct = first_per_key(joined, ["seed", "identifier"], [F.asc("rank")])
    return top_per_group(distinct, ["seed"], [F.asc("rank"), F.asc("identifier")], limit).select("seed", "identifier")


def assemble_packages(seeds: DataFrame, pages: DataFrame, items: DataFrame, catalogue: DataFrame, leads: DataFrame) -> DataFrame:
    """Candidate package of each seed from its page, entity, catalogue entry and archive leads, each unique per seed."""
    listed = leads.groupBy("seed").agg(F.array_sort(F.collect_set("identifier")).alias("archive_leads"))
    out = seeds.join(pages, "seed", "left").join(items, "seed", "left").join(catalogue, "seed", "left").join(listed, "seed", "left")
    return out.withColumn("archive_leads", F.coalesce("archive_leads", F.array().cast("array<string>")))


def sitelink_matches(sources: Column, sitelink: Column) -> Column:
    """Whether the article among the sources is the catalogue's; case and underscores don't count."""
    title = refs.article_title(sources, "en")
    return F.coalesce(F.lower(title) == F.translate(F.lower(sitelink), "_", " "), F.lit(False))
