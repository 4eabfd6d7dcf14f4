"""Graph views over the star-schema tables: entities, relations, reviews, facts and positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph import schemas

# Known table schemas spare every scan a file inspection; tables not listed are read with their own schema.
TABLES = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
        "o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "benchmark": "item_id long, text string",
    "pages": "page_id long, url string, html string",
    "conversations": "conv_id long, turn long, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the star schema; how files are split is the session's business."""
    reader = spark.read.schema(TABLES[name]) if name in TABLES else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


NO_STRINGS = "cast(array() as array<string>)"
NO_SOURCES = f"cast(array() as {schemas.SOURCES})"


def source_struct(label: str, url: str, provider: str) -> str:
    return f"named_struct('label', '{label}', 'url', {url}, 'provider', '{provider}')"


def _entity_sources(key: str, prefix: str) -> str:
    article = source_struct("Wikipedia", f"concat('https://en.wikipedia.org/wiki/{prefix}_', {key})", "wikipedia")
    item = source_struct("Wikidata", f"concat('https://www.wikidata.org/wiki/Q', {key})", "wikidata")
    marker = "a" if prefix == "Performer" else "b"
    artist = source_struct(
        "MusicBrainz",
        f"concat('https://musicbrainz.org/artist/{marker}0000000-0000-4000-8000-', lpad(cast({key} as string), 12, '0'))",
        "musicbrainz",
    )
    site = source_struct("Site", f"concat('http://site.example.org/', {key})", "other")
    return (
        f"case {key} % 5 when 1 then array({article}) when 2 then array({item}, {article}) "
        f"when 3 then array({article}, {artist}) when 4 then array({artist}, {site}) else {NO_SOURCES} end"
    )


def _point(key: str, band: int) -> list[str]:
    return [
        f"cast(({key} * 137) % 997 * 110 + {band} * 200000 as double) as x",
        f"cast(floor({key} / 997) * 90 + ({key} * 61) % 89 as double) as y",
    ]


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as artists, suppliers as bands, parts as guitars, brands as makers, nations as genres.

    The first order year of a customer is a left join on unique keys, which Catalyst drops when no one reads it.
    """
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    part, nation = table(spark, sf_dir, "part"), table(spark, sf_dir, "nation")
    orders = table(spark, sf_dir, "orders")
    years = orders.selectExpr("o_custkey as first_cust", "year(o_orderdate) as order_year")
    years = years.groupBy("first_cust").agg(F.min("order_year").alias("first_year"))
    artists = customer.join(years, F.expr("c_custkey = first_cust"), "left").selectExpr(
        "concat('artist-', c_custkey) as id",
        "c_name as label",
        "'artist' as node_type",
        "concat('nation-', c_nationkey) as zone",
        "c_acctbal >= 9000 as starter",
        "first_year as era_start",
        *_point("c_custkey", 0),
        "case when c_mktsegment = 'MACHINERY' then array('guitarist', 'artist') else array('artist') end as roles",
        "array(concat('Performer ', c_custkey)) as aliases",
        "array(c_mktsegment) as metadata",
        "case when c_custkey % 4 = 0 then '' else concat('Performer from NATION_', c_nationkey, '.') end as summary",
        f"{_entity_sources('c_custkey', 'Performer')} as sources",
    )
    bands = supplier.selectExpr(
        "concat('band-', s_suppkey) as id", "s_name as label", "'band' as node_type",
        "concat('nation-', s_nationkey) as zone", "s_acctbal >= 9000 as starter",
        "case when s_suppkey % 3 <> 0 then cast(1950 + s_suppkey % 60 as int) end as era_start",
        *_point("s_suppkey", 1),
        "array('band') as roles", "array(concat('Ensemble ', s_suppkey)) as aliases", "array('Band') as metadata",
        "concat('Band formed in NATION_', s_nationkey, ' during ', 1950 + s_suppkey % 60, '.') as summary",
        f"{_entity_sources('s_suppkey', 'Ensemble')} as sources",
    )
    guitars = part.selectExpr(
        "concat('guitar-', p_partkey) as id", "concat(p_name, ' ', p_partkey) as label", "'guitar' as node_type",
        "'guitar-workshop' as zone", "false as starter", "cast(null as int) as era_start",
        *_point("p_partkey", 2),
        "array('guitar') as roles", f"{NO_STRINGS} as aliases", "array(p_type) as metadata",
        "concat(p_name, ' model.') as summary", f"{NO_SOURCES} as sources",
    )
    brands = part.select("p_brand").distinct()
    makers = brands.selectExpr("p_brand", r"cast(regexp_extract(p_brand, '([0-9]+)$', 1) as bigint) as brand").selectExpr(
        "concat('brand-', brand) as id", "p_brand as label", "'guitar_brand' as node_type",
        "'guitar-workshop' as zone", "brand % 5 = 0 as starter", "cast(1900 + brand as int) as era_start",
        *_point("brand", 3),
        "array('guitar_brand') as roles", f"{NO_STRINGS} as aliases", "array('Guitar brand') as metadata",
        "'' as summary", f"{NO_SOURCES} as sources",
    )
    genres = nation.selectExpr("cast(n_nationkey as bigint) as nation", "n_name").selectExpr(
        "concat('genre-', nation) as id", "n_name as label", "'genre' as node_type",
        "concat('nation-', nation) as zone", "nation % 5 = 0 as starter", "cast(null as int) as era_start",
        *_point("nation", 4),
        "array('genre') as roles", f"{NO_STRINGS} as aliases", "array('Genre') as metadata",
        "'' as summary", f"{NO_SOURCES} as sources",
    )
    return artists.union(bands).union(guitars).union(makers).union(genres)


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as memberships and instruments, parts as makers, home nations as genres."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").join(orders, F.expr("l_orderkey = o_orderkey"))
    origin = source_struct("Catalogue", "concat('https://catalogue.example.org/r/', l_orderkey)", "other")
    tail = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"
    shared = [
        "case when l_tax < 0.08 then round(l_discount * 10, 1) end as strength",
        "case when l_linestatus = 'O' and l_linenumber = 7 then array('Wikipedia category: sets') "
        "else array(concat('Order ', l_orderkey)) end as context",
        "year(l_shipdate) as year",
        f"case when l_returnflag = 'A' then array({origin}) else {NO_SOURCES} end as sources",
    ]
    # Each line gives a membership and an instrument; one pass over the lines makes both.
    member = (
        f"named_struct('id', concat('m-', {tail}), 'target', concat('band-', l_suppkey), 'type', 'member_of', 'label', "
        "case when l_returnflag = 'R' then 'Wikipedia link signal' else 'member of' end)"
    )
    instrument = (
        f"named_struct('id', concat('p-', {tail}), 'target', concat('guitar-', l_partkey), 'type', 'plays', 'label', "
        "case when l_returnflag = 'R' then 'Wikipedia category signal' else 'plays' end)"
    )
    from_lines = lines.selectExpr(
        f"inline(array({member}, {instrument}))", "concat('artist-', o_custkey) as source", *shared
    ).select("id", "source", "target", "type", "label", "strength", "context", "year", "sources")

    def fixed(name: str, ident: str, source: str, target: str, kind: str, label: str, strength: str, linked: str) -> DataFrame:
        origin = source_struct("Catalogue", f"concat('https://catalogue.example.org/e/', {source})", "other")
        return table(spark, sf_dir, name).selectExpr(
            f"{ident} as id", f"{source} as source", f"{target} as target", f"'{kind}' as type", f"'{label}' as label",
            f"cast({strength} as double) as strength", f"{NO_STRINGS} as context", "cast(null as int) as year",
            f"case when {linked} then array({origin}) else {NO_SOURCES} end as sources",
        )

    made = fixed(
        "part", "concat('b-', p_partkey)", "concat('guitar-', p_partkey)",
        "concat('brand-', regexp_extract(p_brand, '([0-9]+)$', 1))", "made_by", "made by", "0.8", "p_size % 2 = 0",
    )
    artist_genre = fixed(
        "customer", "concat('ag-', c_custkey)", "concat('artist-', c_custkey)", "concat('genre-', c_nationkey)",
        "associated_genre", "associated with", "0.6", "c_custkey % 3 = 0",
    )
    band_genre = fixed(
        "supplier", "concat('bg-', s_suppkey)", "concat('band-', s_suppkey)", "concat('genre-', s_nationkey)",
        "associated_genre", "associated with", "0.6", "s_suppkey % 3 = 0",
    )
    return from_lines.union(made).union(artist_genre).union(band_genre)


def zone_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rectangle per zone, the workshop included."""
    nation = table(spark, sf_dir, "nation")
    boxes = nation.selectExpr(
        "concat('nation-', n_nationkey) as zone", "cast(n_nationkey * 4000 as double) as x", "cast(0 as double) as y",
        "cast(30000 + n_nationkey * 500 as double) as width", "cast(60 + n_nationkey * 40 as double) as height",
    )
    workshop = nation.where("n_nationkey = 0").selectExpr(
        "'guitar-workshop' as zone", "400000D as x", "0D as y", "250000D as width", "200D as height"
    )
    return boxes.union(workshop)


def bridge_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One policy per region: its nations as zones, one genre as anchor."""
    nation = table(spark, sf_dir, "nation")
    return nation.groupBy("n_regionkey").agg(
        F.expr("array_sort(collect_list(concat('nation-', n_nationkey))) as zones"),
        F.expr("array(concat('genre-', min(n_nationkey))) as anchors"),
    ).selectExpr("concat('region-', n_regionkey) as policy", "zones", "anchors", "n_regionkey = 4 as anchors_only")


def blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocklist: every seventh supplier by id, every eleventh by label."""
    supplier = table(spark, sf_dir, "supplier")
    return supplier.where("s_suppkey % 7 = 0 or s_suppkey % 11 = 0").selectExpr(
        "case when s_suppkey % 7 = 0 then concat('Band-', s_suppkey) else concat('none-', s_suppkey) end as id",
        f"case when s_suppkey % 11 = 0 then array(s_name) else {NO_STRINGS} end as labels",
    )


def review_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a reviewed candidate about the customer with the event's user number."""
    return review_rows_of(table(spark, sf_dir, "events"))


def review_rows_of(events: DataFrame) -> DataFrame:
    """The same mapping for any frame with the columns of the events table, streams included."""
    events = events.selectExpr(
        "*", "cast(get_json_object(props, '$.k') as bigint) as k",
        "case event_type when 'purchase' then 'approved' when 'signup' then 'imported' when 'view' then 'review' "
        "else 'rejected' end as status",
    )
    return events.selectExpr(
        "concat('cand-', event_id) as id",
        "concat('run-', event_id div 50) as run_id",
        "concat('Customer#', lpad(cast(user_id as string), 9, '0')) as seed_name",
        "case when k % 2 = 0 then 'guitarist' else 'artist' end as requested_kind",
        "status",
        "case when status = 'rejected' then case k % 7 when 0 then 'duplicate' when 1 then 'wrong_entity' "
        "when 2 then 'not_relevant' when 3 then 'out_of_scope' when 4 then 'weak_connection' end end as review_reason_code",
        "case when k % 13 = 0 then 'Existing node' else '' end as reason",
        "ts as updated_at",
        "value > 80 as identity_conflict",
        "case when k % 17 = 0 then 'typed_connection' else 'package' end as payload_kind",
        "value",
        "user_id",
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sentence of a document as a fact about the artist with the document's number."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    sentences = documents.join(labels, "doc_id", "left").selectExpr(
        "doc_id", "source", "quality", "toxic", r"posexplode(split(text, '[.!?]\\s+')) as (pos, sentence)"
    )
    site = source_struct("Site", "concat('https://', source, '.example.org/d/', doc_id)", "other")
    article = source_struct("Wikipedia", "concat('https://en.wikipedia.org/wiki/Doc_', doc_id)", "wikipedia")
    return sentences.selectExpr(
        "concat('fact-', doc_id, '-', pos) as id",
        "concat('artist-', doc_id) as entity_id",
        "sentence as text",
        "case when pos % 4 = 0 then cast(1750 + pos % 400 as int) end as year",
        "array('music-history', concat('scout-', case pos % 3 when 0 then 'name-origin' when 1 then 'recording-story' "
        "else 'cover-story' end)) as tags",
        f"case when doc_id % 7 = 0 then array({article}) when doc_id % 2 = 0 then array({site}, {article}) "
        f"else array({site}) end as sources",
        "case when toxic = 1 then 'rejected' when quality = 1 then 'approved' else 'review' end as status",
        r"sha2(concat('https://', source, '.example.org/d/', doc_id, '\n', lower(sentence)), 256) as source_fingerprint",
        "doc_id",
        "cast(pos as bigint) as pos",
    )


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two layouts of the same nodes: as stored, and shifted by an amount that depends on the node."""
    nodes = entities(spark, sf_dir)
    shifted = nodes.selectExpr(
        "id", "x", "y", "length(label) * 7 + case when zone in ('nation-3', 'nation-7') then 55 else 0 end as s"
    )
    before = nodes.selectExpr("'before' as mode", "id", "x", "y")
    return before.union(shifted.selectExpr("'after' as mode", "id", "x + s as x", "y + s % 37 as y"))


def placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bases of bands and birthplaces of artists at points derived from their nation."""
    nodes = entities(spark, sf_dir).where("node_type in ('artist', 'band')")
    keyed = nodes.selectExpr(
        "id", "node_type", "try_cast(regexp_extract(id, '([0-9]+)$', 1) as bigint) as k",
        "try_cast(regexp_extract(zone, '([0-9]+)$', 1) as bigint) as n",
    )
    return keyed.selectExpr(
        "id as node_id", "case when node_type = 'band' then 'musical_base' else 'birthplace' end as role",
        "concat('place-', n, '-', k % 4) as place_id", "concat('City ', n) as name",
        "concat('Country ', n % 5) as country", "(n * 7) % 120 - 60 + (k % 4) * 0.1D as lat",
        "(n * 13) % 340 - 170 + (k % 4) * 0.1D as lon",
    )


PREFIXES = (
    "", "List of ", "Category:", "History of ", "1999 ", "The ", "Deep ", "Billboard ", "Rolling ", "Music of ", "rock ",
    "electric ",
)
SUFFIXES = (
    "", " (band)", " album", " genres", " musicians", " by era", " media", " pages", " guitarist", " rock music", " singer",
    " guitar",
)


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A made title per part with a kind and a source, covering the scope rules."""
    def pick(words: tuple[str, ...], key: str) -> str:
        listed = ", ".join(f"'{word}'" for word in words)
        return f"element_at(array({listed}), cast({key} % {len(words)} as int) + 1)"

    return table(spark, sf_dir, "part").selectExpr(
        "concat('t-', p_partkey) as id", f"concat({pick(PREFIXES, 'p_partkey')}, p_name, {pick(SUFFIXES, 'p_partkey div 12')}) as title",
        f"{pick(('genre', 'band', 'artist', 'guitarist', 'guitar', 'guitar_brand'), 'p_partkey div 5')} as kind",
        f"{pick(('link', 'category', 'template', ''), 'p_partkey div 7')} as source", "p_partkey as key",
    )


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a research package about its customer with its lines as related candidates."""
    title = (
        "case v.n % 6 when 0 then concat('Act ', o_custkey) when 1 then concat('Ensemble ', v.s) when 2 then 'Some album' "
        "when 3 then concat('Player ', v.p) when 4 then 'Blocked act two' else '' end"
    )
    kind = "case v.n % 6 when 1 then 'band' when 3 then 'artist' when 4 then 'venue' else 'genre' end"
    candidate = (
        f"named_struct('title', {title}, 'kind', {kind}, 'source', 'musicbrainz_relation', 'reason', '', "
        f"'musicbrainz', named_struct('id', 'x', 'name', {title}, 'type', case when v.f = 'R' then 'Other' when v.n % 6 = 1 then 'Group' else 'Person' end), "
        f"'wikipedia', cast(null as {schemas.PAGE}), 'documented_relation', named_struct('type', 'member_of', 'label', 'member of', "
        "'context', 'c', 'source_url', 'https://musicbrainz.org/artist/mb', 'seed_mb_id', 'mb', 'seed_is_band', false, 'strength', cast(null as double)))"
    )
    # The lines travel as four short fields; the nested candidates are made from them once a package is together.
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.expr("array_sort(collect_list(named_struct('n', l_linenumber, 'p', l_partkey, 's', l_suppkey, 'f', l_returnflag))) as lines")
    )
    joined = table(spark, sf_dir, "orders").join(lines, F.expr("o_orderkey = l_orderkey"), "left")
    orders = joined.withColumn("candidates", F.expr(f"transform(lines, v -> {candidate})"))
    name = (
        "case when o_orderkey % 13 = 0 then '' when o_orderkey % 11 = 0 then 'List of things' when o_orderkey % 17 = 0 then 'Blocked act' "
        "else concat('Act ', o_custkey) end"
    )
    text = "case when o_orderkey % 3 = 0 then 'English rock band and singer.' else 'A village.' end"
    none = NO_STRINGS
    return orders.selectExpr(
        "concat('pkg-', o_orderkey) as id", "concat('run-', o_orderkey div 100) as run_id", "o_orderkey",
        f"named_struct('name', {name}, 'kind', 'package', 'requested_kind', element_at(array('band', 'artist', 'guitarist', 'genre', 'album'), cast(o_orderkey % 5 as int) + 1), "
        f"'suggested_zone', '', 'wikipedia', case when o_orderkey % 4 <> 0 then named_struct('title', {name}, 'url', '', 'extract', {text}, 'wikidata_id', concat('Q', o_orderkey), "
        f"'categories', {none}, 'links', {none}, 'musicbrainz_artist_ids', array(concat('mb', o_custkey))) end, "
        "'wikidata', case when o_orderkey % 6 <> 0 then named_struct('id', concat('Q', o_orderkey + case when o_orderkey % 19 = 0 then 1 else 0 end), "
        f"'musicbrainz_artist_ids', {none}) end, "
        "'musicbrainz', case when o_orderkey % 8 <> 0 then named_struct('id', concat('MB', o_custkey + case when o_orderkey % 23 = 0 then 1 else 0 end), 'name', '', 'type', 'Person') end, "
        "'music_candidates', candidates, 'link_leads', case when o_orderkey % 2 = 0 then array('a', 'b') else array('a') end, "
        "'source_errors', case when o_orderkey % 9 = 0 then array(named_struct('source', 's', 'message', 'm')) else cast(array() as array<struct<source:string,message:string>>) end) as payload",
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup attempts about the customer of each event."""
    return table(spark, sf_dir, "events").selectExpr(
        "concat('artist-', user_id) as entity_id", "ts as attempted_at",
        "case when event_type = 'error' then 'source_error' else 'no_match' end as outcome",
    )
