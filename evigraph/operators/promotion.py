"""Whole rows of reviewed promotions: nodes of approved packages, and staged memberships with the bands they discover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph import vocab
from evigraph.functions import refs
from evigraph.functions.text import article_for, canonical_title, compact_summary, period_text, same_loose_title
from evigraph.operators.evidence import has_blocked_term, zone_of_title
from evigraph.operators.graph import first_per_key, top_per_group
from evigraph.operators.resolve import group_start, resolve_titles, title_index
from evigraph.operators.titles import rejection_reason, scope_reason
from evigraph.schemas import SOURCES
from evigraph.session import cut_lineage, lookup

ARTIST_PAGE = "https://musicbrainz.org/artist/"
MAX_BATCH = 25


def _source(label: str, url: Column, provider: str) -> Column:
    return F.struct(F.lit(label).alias("label"), url.alias("url"), F.lit(provider).alias("provider"))


def _filled(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) != ""


def article_url(title: Column, language: str = "en") -> Column:
    """Address of an encyclopedia article: blanks as underscores, other characters escaped, `/` and `~` kept."""
    encoded = F.url_encode(F.replace(title, F.lit(" "), F.lit("_")))
    for escape, plain in (("%2F", "/"), ("%7E", "~"), ("*", "%2A"), ("+", "%20")):
        encoded = F.replace(encoded, F.lit(escape), F.lit(plain))
    return F.concat(F.lit(f"https://{language}.wikipedia.org/wiki/"), encoded)


def package_sources(payload: Column) -> Column:
    """Article, catalogue item and artist page of a package, those that it names, one per address."""
    page, item, artist = payload["wikipedia"], payload["wikidata"], payload["musicbrainz"]
    title = F.coalesce(F.nullif(page["title"], F.lit("")), payload["name"], F.lit(""))
    url = F.coalesce(F.nullif(page["url"], F.lit("")), article_url(title))
    listed = F.array_compact(F.array(
        F.when(_filled(page["title"]) | _filled(page["url"]), _source("Wikipedia", url, "wikipedia")),
        F.when(_filled(item["id"]), _source("Wikidata", F.concat(F.lit("https://www.wikidata.org/wiki/"), item["id"]), "wikidata")),
        F.when(_filled(artist["id"]), _source("MusicBrainz", F.concat(F.lit(ARTIST_PAGE), artist["id"]), "musicbrainz")),
    ))
    return refs.normalize_sources(listed)


def _kind_label(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in vocab.KIND_LABELS.items() for x in pair])[kind]


def _roles(kind: Column) -> Column:
    return F.when(kind == "guitarist", F.array(F.lit("guitarist"), F.lit("artist"))).otherwise(F.array(kind))


def _finished(rows: DataFrame) -> DataFrame:
    return rows.select(
        "row_order", "pos", "node_id", canonical_title("title").alias("label"), F.col("kind").alias("node_type"), _roles(F.col("kind")).alias("roles"), "summary",
        F.array(_kind_label(F.col("kind"))).alias("metadata"), "zone", F.lit(False).alias("starter"), F.col("sources").cast(SOURCES).alias("sources"),
    )


def seed_nodes(packages: DataFrame, nodes: DataFrame, blocked_terms: tuple[str, ...] = ()) -> DataFrame:
    """New nodes for the seeds of approved packages (row_order, seed_name, payload), one per node id, the first package's.

    A seed needs a name, a known kind, a source, and a zone: the suggested one if the layout or any node has it, else one told by its title. Blocked and
    out-of-scope names and names that a node already answers to are passed over.
    """
    p = F.col("payload")
    name = F.coalesce(F.nullif(p["name"], F.lit("")), F.nullif("seed_name", F.lit("")))
    rows = packages.select(
        "row_order", F.lit(-1).cast("bigint").alias("pos"), name.alias("title"), p["requested_kind"].alias("kind"), F.coalesce(p["suggested_zone"], F.lit("")).alias("_wish"),
        package_sources(p).alias("sources"), p["wikipedia"]["extract"].alias("_extract"),
    )
    title, kind = F.col("title"), F.col("kind")
    fits = _filled(title) & kind.isin(*vocab.NODE_KINDS) & ~has_blocked_term(title, blocked_terms) & scope_reason(title, kind, F.lit(""), promotion=True).isNull()
    rows = cut_lineage(rows.where(F.coalesce(fits, F.lit(False)) & (F.size("sources") > 0)))  # judged once; read for its titles and for itself
    rows = resolve_titles(rows, title_index(nodes)).where(~F.col("known"))
    used = nodes.where(_filled(F.col("zone"))).select(F.col("zone").alias("_used")).distinct()
    rows = lookup(rows, used, "_wish", "_used", "left")
    wished = F.when(F.col("_wish").isin(*vocab.LAYOUT_ZONES) | F.col("_used").isNotNull(), F.col("_wish"))
    rows = rows.withColumn("zone", F.coalesce(wished, zone_of_title(title, kind, F.lit("")))).where(F.col("zone").isNotNull())
    fallback = F.concat(F.lit("A "), F.lower(_kind_label(kind)), F.lit(" added from approved MHM research."))
    rows = rows.withColumn("summary", compact_summary(F.col("_extract"), fallback))
    return _finished(first_per_key(rows, ["node_id"], [F.asc("row_order"), F.asc("pos")]))


def promoted_nodes(
    packages: DataFrame, nodes: DataFrame, blocked_terms: tuple[str, ...] = (), max_new: int = 50, per_seed: int = 6,
) -> tuple[DataFrame, DataFrame]:
    """All new nodes of approved packages, seeds and their candidates, and the candidates that are refused (row_order, title, reason).

    A candidate needs a seed that is or becomes a node, an admissible title of another name, and a zone told by its title or its seed. A node that several rows
    would make is made once, by the first. Candidates stop at `per_seed` for each package and once `max_new` nodes, seeds included, stand before them.
    """
    seeds = cut_lineage(seed_nodes(packages, nodes, blocked_terms))  # read five times below, and so is the index
    columns = ["id", "label", "aliases", "zone"]
    known = nodes.select(*columns).unionByName(seeds.select(F.col("node_id").alias("id"), "label", F.array().cast("array<string>").alias("aliases"), "zone"))
    index = cut_lineage(title_index(known))
    p = F.col("payload")
    named = packages.withColumn("_seed", F.trim(F.coalesce(F.nullif(p["name"], F.lit("")), "seed_name", F.lit(""))))
    seeded = resolve_titles(named, index, "_seed").where("known").withColumnRenamed("node_id", "seed_id").drop("known")
    zones = known.select(F.col("id").alias("_zid"), F.col("zone").alias("_seed_zone"))
    seeded = lookup(seeded, zones, "seed_id", "_zid").drop("_zid")
    spread = seeded.select("row_order", "_seed", "_seed_zone", "seed_id", F.posexplode(p["music_candidates"]).alias("_pos", "_c")).withColumn("pos", F.col("_pos").cast("bigint"))
    judged = spread.withColumn("title", F.trim(F.coalesce(F.col("_c.title"), F.lit("")))).withColumn("_why", rejection_reason(F.col("_c"), blocked_terms))
    refused = judged.where("_why is not null").select("row_order", "title", F.col("_why").alias("reason"))
    good = judged.where("_why is null").where(~same_loose_title("_seed", "title")).select(
        "row_order", "pos", "title", "_seed", "_seed_zone", F.trim(F.col("_c.kind")).alias("kind"), F.col("_c.source").alias("_source"), F.col("_c.musicbrainz.id").alias("_artist")
    )
    good = cut_lineage(good)  # candidates are judged once; read for their titles and for themselves
    fresh = resolve_titles(good, index).where(~F.col("known"))
    fresh = fresh.withColumn("zone", zone_of_title(F.col("title"), F.col("kind"), F.col("_seed_zone"))).where(F.col("zone").isNotNull())
    artist = F.col("_artist")
    related = (F.col("_source") == "musicbrainz_relation") & _filled(artist)
    noun = F.lower(_kind_label(F.col("kind")))
    tail = F.when(related, " with a documented MusicBrainz band-membership connection to ").otherwise(" found while researching Wikipedia signals around ")
    seed = F.coalesce(F.nullif("_seed", F.lit("")), F.lit("an approved seed"))
    fresh = fresh.withColumn("summary", F.concat(article_for(noun), F.lit(" "), noun, tail, seed, F.lit(".")))
    own = F.when(related, _source("MusicBrainz", F.concat(F.lit(ARTIST_PAGE), artist), "musicbrainz")).otherwise(_source("Wikipedia", article_url(F.col("title")), "wikipedia"))
    first = first_per_key(fresh.withColumn("sources", F.array(own)), ["node_id"], [F.asc("row_order"), F.asc("pos")])
    capped = _finished(top_per_group(first, ["row_order"], [F.asc("pos")], per_seed))
    within = seeds.unionByName(capped).orderBy("row_order", "pos").limit(max_new).where(F.col("pos") >= 0)
    made = seeds.unionByName(within).withColumnRenamed("node_id", "id")
    return made, refused


def _chosen(rows: DataFrame, recorded: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """The first `limit` approved connection rows that are not recorded yet, and how many are left."""
    open_rows = rows.where((F.col("status") == "approved") & (F.col("payload_kind") == "typed_connection"))
    open_rows = open_rows.join(recorded.select(F.col("id").alias("_r")).distinct(), F.col("id") == F.col("_r"), "left_anti")
    left = open_rows.agg(F.greatest(F.lit(0).cast("bigint"), F.count(F.lit(1)) - limit).alias("deferred"))
    return open_rows.orderBy("pos", "id").limit(limit), left


def stage_connections(
    rows: DataFrame, nodes: DataFrame, edges: DataFrame, promoted: tuple[DataFrame, DataFrame], recorded: DataFrame, limit: int = 12,
) -> dict[str, DataFrame]:
    """A batch of approved memberships as it would be written, and what forbids it.

    Rows are (id, pos, status, payload_kind, connection) with a connection of (id, source, target, type, relation_type_id, artist_ids, source_name, periods,
    sources, discovery); `promoted` is the earlier ledger's (nodes, edges), `recorded` its candidate rows. The result has the new `nodes` and `edges`, the
    `candidate_rows` to record, the edges `already_present`, the number `deferred`, and `violations` (id, rule): unless that is empty nothing may be written.
    Of two rows for one membership the first stages it and the second finds it present; of two rows that discover one band the first makes the node.

    A batch holds 25 rows at most, so the graph is only asked for their ends and names.
    """
    if not 1 <= limit <= MAX_BATCH:
        raise ValueError(f"a connection batch holds 1 to {MAX_BATCH} rows, not {limit}")
    chosen, left = _chosen(rows, recorded, limit)
    c = F.col("connection")
    batch = chosen.select("id", "pos", c.alias("c"), c["discovery"].alias("d"), F.lower(F.trim(c["discovery"]["name"])).alias("_name"))
    asked = F.broadcast(batch.select(F.explode(F.array("c.source", "c.target")).alias("_asked")).distinct())
    fields = ["id", "label", "node_type", "x", "y", "zone", "sources"]
    every = nodes.select(*fields, F.lit(0).alias("_from")).unionByName(promoted[0].select(*fields, F.lit(1).alias("_from")))
    ends = first_per_key(every.join(asked, F.col("id") == F.col("_asked"), "left_semi"), ["id"], [F.asc("_from"), F.asc("label")])
    ends = ends.withColumn("mbid", refs.artist_catalogue_id(F.col("sources"))).drop("sources", "_from")
    names = F.broadcast(batch.where("_name is not null").select(F.col("_name").alias("_n")).distinct())
    taken = every.select(F.lower(F.trim("label")).alias("_label")).join(names, F.col("_label") == F.col("_n"), "left_semi").distinct()
    person = ends.select([F.col(n).alias(f"p_{n}") for n in ends.columns])
    band = ends.select([F.col(n).alias(f"b_{n}") for n in ends.columns])
    joined = batch.join(F.broadcast(person), F.col("c.source") == F.col("p_id"), "left").join(F.broadcast(band), F.col("c.target") == F.col("b_id"), "left")
    joined = joined.join(F.broadcast(taken), F.col("_name") == F.col("_label"), "left")

    ids, d = F.col("c.artist_ids"), F.col("d")
    is_person = F.coalesce(F.col("p_node_type").isin(*vocab.PERSON_KINDS), F.lit(False))
    found = d.isNotNull()
    identity = (
        is_person & (d["type"] == "band") & (F.trim(d["name"]) != "") & d["mbid"].rlike(vocab.UUID) & F.get(ids, F.lit(0)).rlike(vocab.UUID)
        & (F.col("c.source_name") == F.col("p_label")) & (F.get(ids, F.lit(1)) == d["mbid"]) & (F.col("c.target") == F.concat(F.lit("mb-band-"), d["mbid"]))
        & (F.col("p_mbid").isNull() | (F.col("p_mbid") == F.get(ids, F.lit(0))))
    )
    agrees = (F.col("b_node_type") == "band") & (F.col("b_label") == d["name"]) & (F.col("b_mbid") == d["mbid"])
    makes = found & F.col("b_id").isNull()
    person_mbid = F.coalesce("p_mbid", F.when(found, F.get(ids, F.lit(0))))
    band_mbid = F.when(makes, F.lower(d["mbid"])).otherwise(F.col("b_mbid"))
    band_id = F.when(makes, F.col("c.target")).otherwise(F.col("b_id"))
    matched = (
        person_mbid.isNotNull() & band_mbid.isNotNull() & (F.col("c.id") == F.concat(F.lit("mb-member-"), F.col("p_id"), F.lit("-"), band_id)) & (F.col("c.type") == "member_of")
        & (F.col("c.relation_type_id") == vocab.MEMBERSHIP_TYPE_ID) & ids.eqNullSafe(F.array(person_mbid, band_mbid))
    )
    pages = [F.concat(F.lit(ARTIST_PAGE), who, F.lit("/relationships")) for who in (person_mbid, band_mbid)]
    sourced = F.exists("c.sources", lambda s: (s["provider"] == "musicbrainz") & ((s["url"] == pages[0]) | (s["url"] == pages[1])))
    date_ok = lambda v: v.isNull() | v.rlike(vocab.PARTIAL_DATE)
    periods = F.col("c.periods")
    dated = (F.size(periods) > 0) & F.forall(periods, lambda t: F.coalesce(t.isNotNull() & date_ok(t["begin"]) & date_ok(t["end"]), F.lit(False)))
    no = lambda good: ~F.coalesce(good, F.lit(False))
    rule = (
        F.when(found & no(identity), "discovery_identity").when(found & F.col("b_id").isNotNull() & no(agrees), "discovery_conflict")
        .when(makes & F.col("_label").isNotNull(), "discovery_label").when(no(is_person & (makes | (F.col("b_node_type") == "band"))), "member_nodes")
        .when(no(matched), "membership_identity").when(no(sourced), "membership_source").when(no(dated), "membership_dates")
    )
    same = [F.col(f"e.{a}") == F.col(f"k.{b}") for a, b in (("source", "_s"), ("target", "_t"))]
    keys = F.broadcast(batch.select(F.col("c.source").alias("_s"), F.col("c.target").alias("_t")).distinct().alias("k"))
    listed = edges.select("source", "target", "type", "label", "sources").unionByName(promoted[1].select("source", "target", "type", "label", "sources"))
    present = listed.where("type = 'member_of'").alias("e").join(keys, same[0] & same[1], "left_semi")
    good = (F.col("label") == "Member of") & F.coalesce(F.exists("sources", lambda s: s["provider"] == "musicbrainz"), F.lit(False))
    present = present.groupBy(F.col("source").alias("_ps"), F.col("target").alias("_pt")).agg(F.min(good.cast("int")).alias("_good"))
    told = joined.withColumn("rule", rule).withColumns({"_makes": makes, "_band": band_id, "_pmbid": person_mbid})
    told = told.join(F.broadcast(present), (F.col("c.source") == F.col("_ps")) & (F.col("c.target") == F.col("_pt")), "left")
    told = told.withColumn("rule", F.coalesce("rule", F.when(F.col("_good") == 0, "manual_review")))

    # Within the batch: the first row makes a band or a membership; a second band of the same name is as wrong as one on the map.
    order = [F.asc("pos"), F.asc("id")]
    fine = F.col("rule").isNull()
    told = told.withColumns({
        "_first_of_band": F.row_number().over(Window.partitionBy("_band", fine).orderBy(*order)),
        "_first_of_edge": F.row_number().over(Window.partitionBy("c.source", "c.target", fine).orderBy(*order)),
        "_name_of_band": F.first("d.name").over(Window.partitionBy("_band", fine & F.col("_makes")).orderBy(*order)),
        "_band_of_name": F.first("_band").over(Window.partitionBy("_name", fine & F.col("_makes")).orderBy(*order)),
    })
    clash = F.when(F.col("_makes") & (F.col("_name_of_band") != F.col("d.name")), "discovery_conflict").when(F.col("_makes") & (F.col("_band_of_name") != F.col("_band")), "discovery_label")
    told = cut_lineage(told.withColumn("rule", F.coalesce("rule", clash)))  # a batch; the graph is read for it once, not for each part
    valid = told.where(F.col("rule").isNull())

    near = F.struct(F.col("p_zone").alias("preferred_zone"), F.col("p_id").alias("near_node"))
    new_nodes = valid.where(F.col("_makes") & (F.col("_first_of_band") == 1)).select(
        F.col("c.target").alias("id"), F.trim("d.name").alias("label"), F.lit("band").alias("node_type"), F.array(F.lit("band")).alias("roles"),
        F.concat(F.lit("Band with a documented membership connection to "), "p_label", F.lit(".")).alias("summary"), F.array(F.lit("Band")).alias("metadata"),
        (F.col("p_x") + 140).alias("x"), (F.col("p_y") + 80).alias("y"), F.col("p_zone").alias("zone"), F.lit(False).alias("starter"), near.alias("layout_hints"),
        F.array(_source("MusicBrainz: artist identity", F.concat(F.lit(ARTIST_PAGE), "d.mbid"), "musicbrainz")).alias("sources"),
    )
    band_label = F.when(F.col("_makes"), F.trim("d.name")).otherwise(F.col("b_label"))
    dates = F.array_join(F.transform("c.periods", lambda t: period_text(t["begin"], t["end"])), "; ")
    plural = F.when(F.size("c.periods") == 1, "Documented period: ").otherwise("Documented periods: ")
    fresh = F.col("_good").isNull() & (F.col("_first_of_edge") == 1)
    new_edges = valid.where(fresh).select(
        F.col("c.id").alias("id"), F.col("c.source").alias("source"), F.col("c.target").alias("target"), F.lit("member_of").alias("type"), F.lit("Member of").alias("label"),
        F.lit(0.9).alias("strength"),
        F.array(F.concat(F.lit("MusicBrainz records "), "p_label", F.lit(" as a member of "), band_label, F.lit(".")), F.concat(plural, dates, F.lit("."))).alias("context"),
        F.array(_source("MusicBrainz: member of band relationship", F.concat(F.lit(ARTIST_PAGE), "_pmbid", F.lit("/relationships")), "musicbrainz")).alias("sources"),
    )
    return {
        "nodes": new_nodes, "edges": new_edges,
        "candidate_rows": valid.select("id", F.lit("typed_connection").alias("kind"), F.col("c.id").alias("edge_id"), F.col("c.source").alias("source"), F.col("c.target").alias("target")),
        "already_present": valid.where(~fresh).select("id", F.col("c.id").alias("edge_id")), "deferred": left,
        "violations": told.where(F.col("rule").isNotNull()).select("id", "rule"),
    }


def with_group_start(bands: DataFrame, artists: DataFrame, current_year: int) -> tuple[DataFrame, DataFrame]:
    """Discovered bands with the year their catalogue entry begins, and the bands that have no matching entry (id, rule).

    Artists are (id, name, type, begin). The entry must have the band's catalogue id, be a group and bear its name; only a year from 1600 to now counts,
    with its evidence, and the evidence's source joins the others.
    """
    entry = artists.select(F.lower("id").alias("_a"), F.trim("name").alias("_name"), F.col("type").alias("_type"), "begin")
    joined = bands.withColumn("_mbid", refs.artist_catalogue_id(F.col("sources"))).join(entry, F.col("_mbid") == F.col("_a"), "left")
    ok = F.coalesce((F.col("_type") == "Group") & (F.col("_name") == F.col("label")), F.lit(False))
    year = group_start(F.col("begin"), current_year)
    origin = F.array(_source("MusicBrainz: group begin", F.concat(F.lit(ARTIST_PAGE), "_mbid"), "musicbrainz"))
    listed = F.exists("sources", lambda s: (s["url"] == origin[0]["url"]) & (s["label"] == origin[0]["label"]))
    evidence = F.struct(F.lit("group_formation").alias("basis"), F.lit("MusicBrainz group begin date.").alias("note"), origin.alias("sources"))
    dated = joined.where(ok).withColumns({
        "era_start": year, "era_start_evidence": F.when(year.isNotNull(), evidence), "sources": F.when(year.isNotNull() & ~listed, F.concat("sources", origin)).otherwise(F.col("sources")),
    })
    missing = joined.where(~ok).select("id", F.lit("unverified_band").alias("rule"))
    return dated.drop("_mbid", "_a", "_name", "_type", "begin"), missing

