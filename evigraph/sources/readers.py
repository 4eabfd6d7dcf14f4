"""Readers of graph documents, request inboxes, run files, fact batches, notes, pages, claims and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph import schemas, vocab


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """Graph documents; one file is one document."""
    return spark.read.schema(schemas.GRAPH).json(path, multiLine=True)


def graph_nodes(documents: DataFrame) -> DataFrame:
    rows = documents.select(F.explode("nodes").alias("n")).select("n.*")
    return rows.withColumnRenamed("type", "node_type").withColumnRenamed("eraStart", "era_start").withColumnRenamed("eraStartEvidence", "evidence")


def graph_edges(documents: DataFrame) -> DataFrame:
    return documents.select(F.explode("edges").alias("e")).select("e.*")


def entity_rows(nodes: DataFrame) -> DataFrame:
    """Table form of nodes with the defaults of missing fields."""
    strings = F.array().cast("array<string>")
    return nodes.select(
        "id", "label", "node_type", F.coalesce("roles", strings).alias("roles"), F.coalesce("summary", F.lit("")).alias("summary"),
        F.coalesce("metadata", strings).alias("metadata"), F.coalesce("aliases", strings).alias("aliases"),
        F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"),
        F.coalesce("zone", F.lit("unplaced")).alias("zone"), F.coalesce("starter", F.lit(False)).alias("starter"),
        "era_start", "evidence", F.coalesce("sources", F.array().cast(schemas.SOURCES)).alias("sources"),
    )


def relation_rows(edges: DataFrame) -> DataFrame:
    return edges.select(
        "source", "target", "type", "label", F.coalesce("strength", F.lit(0.5)).alias("strength"),
        F.coalesce("context", F.array().cast("array<string>")).alias("context"), "year",
        F.coalesce("sources", F.array().cast(schemas.SOURCES)).alias("sources"),
    )


def year_evidence_violations(nodes: DataFrame) -> DataFrame:
    """Years out of range and evidence without a year."""
    rule = (
        F.when(F.col("era_start").isNotNull() & ~F.col("era_start").between(1400, 2100), "year_range")
        .when(F.col("era_start").isNull() & F.col("evidence").isNotNull(), "evidence_without_year")
    )
    return nodes.select(rule.alias("rule"), F.col("id").alias("key")).where(F.col("rule").isNotNull())


def read_table(spark: SparkSession, path: str, columns: list[str], kinds: list[str] | None = None) -> DataFrame:
    """Columns of a Parquet table, filtered by kind; both reach the scan."""
    df = spark.read.parquet(path).select(*columns)
    return df.where(F.col("node_type").isin(*kinds)) if kinds else df


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, partitions: int, **options: str) -> DataFrame:
    """A complete partitioned read of a database table by ranges of its numeric key."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    bounds = {"partitionColumn": key, "lowerBound": low, "upperBound": high, "numPartitions": partitions}
    return reader.options(**bounds).load()


def repeated_keys(rows: DataFrame, key: str) -> DataFrame:
    """Keys a complete read returned more than once."""
    counted = rows.groupBy(F.col(key).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return counted.select(F.lit("repeated_key").alias("rule"), "key", F.col("_n").cast("string").alias("detail"))


def read_inbox(spark: SparkSession, path: str) -> DataFrame:
    """Requests of an inbox file that is either a list or an object with a list."""
    text = spark.read.text(path, wholetext=True)
    return inbox_requests(text, "value")


def inbox_requests(documents: DataFrame, column: str) -> DataFrame:
    value = F.col(column)
    listed = F.from_json(value, schemas.REQUEST_LIST)
    wrapped = F.from_json(value, schemas.INBOX)["requests"]
    requests = F.when(F.ltrim(value).startswith("["), listed).otherwise(wrapped)
    return documents.select(F.explode(requests).alias("r")).select("r.*")


def request_rows(requests: DataFrame, source: str = "local-inbox") -> DataFrame:
    """Queue rows with defaults."""
    return requests.select(
        "id", F.coalesce(F.nullif("title", F.lit("")), "id").alias("title"), F.coalesce("status", F.lit("queued")).alias("status"),
        F.coalesce("priority", F.lit(50)).alias("priority"), F.coalesce("scope", F.lit("open_research")).alias("scope"),
        F.coalesce("instructions", F.lit("")).alias("instructions"), "seeds", "limits", "notes",
        F.coalesce("source", F.lit(source)).alias("source"), F.col("createdAt").alias("created_at"),
    )


def read_runs(spark: SparkSession, path: str, status: str = "review", limit: int | None = None) -> DataFrame:
    """Candidates of run files with a status, newest file first."""
    files = spark.read.schema(schemas.RUN_FILE).json(path, multiLine=True).withColumn("file", F.col("_metadata.file_name"))
    rows = files.select("file", "runId", F.posexplode("candidates").alias("pos", "c"))
    kept = rows.where(F.coalesce("c.status", F.lit("review")) == status)
    stem = F.regexp_replace("file", r"\.json$", "")
    out = kept.select(
        F.concat_ws(":", stem, "c.name").alias("id"), F.coalesce("runId", stem).alias("run_id"), F.col("c.name").alias("seed_name"),
        F.col("c.requested_kind").alias("requested_kind"), "file", "pos",
    )
    ordered = out.orderBy(F.desc("file"), F.asc("pos"))
    return ordered.limit(limit) if limit else ordered


def fact_batch_rows(batches: DataFrame) -> DataFrame:
    """Facts of compact batches with their source looked up by key."""
    rows = batches.select("batchId", "verifiedAt", "sources", F.posexplode("facts").alias("pos", "f"))
    entry = rows.select(
        F.col("batchId").alias("batch_id"), (F.col("pos") + 1).alias("index"), F.get("f", F.lit(0)).alias("entity_id"), F.get("f", F.lit(1)).alias("text"),
        F.get("f", F.lit(2)).alias("category"), F.get("f", F.lit(3)).alias("source_key"), F.get("f", F.lit(4)).alias("evidence"),
        F.try_element_at("sources", F.get("f", F.lit(3))).alias("_source"), F.size("f").alias("width"),
    )
    return entry.select(
        "batch_id", "index", "entity_id", "text", "category", "source_key", "evidence", "width",
        F.get("_source", F.lit(0)).alias("source_label"), F.get("_source", F.lit(1)).alias("source_url"),
        F.sha2(F.concat_ws("\n", "batch_id", "entity_id", "text"), 256).alias("fingerprint"),
    )


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """Whole notes with their file name; sub-folders included."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), "value")


def _unquote(value: Column) -> Column:
    inner = F.substr(value, F.lit(2), F.length(value) - 2)
    quoted = value.rlike(r'^".*"$|^\'.*\'$') & (F.length(value) >= 2)
    return F.when(quoted, F.replace(F.replace(inner, F.lit('\\"'), F.lit('"')), F.lit("''"), F.lit("'"))).otherwise(value)


def front_matter(notes: DataFrame) -> DataFrame:
    """Front matter of each note as a map of raw values; the last line of a key counts."""
    block = F.regexp_extract("value", r"^---\r?\n([\s\S]*?)\r?\n---", 1)
    lines = F.transform(F.split(block, r"\r?\n"), lambda v: F.trim(v))
    kept = F.filter(lines, lambda v: (v != "") & ~F.startswith(v, F.lit("#")) & F.contains(v, F.lit(":")))
    pairs = F.transform(kept, lambda v: F.struct(F.trim(F.substring_index(v, ":", 1)).alias("k"), F.trim(F.substr(v, F.instr(v, ":") + 1)).alias("v")))
    named = notes.withColumn("_pairs", pairs).withColumn("_keys", F.reverse(F.transform("_pairs", lambda p: p["k"])))
    last = F.filter("_pairs", lambda p, i: F.array_position("_keys", p["k"]) == F.size("_keys") - i)
    # A generator, because conditions on the fields would otherwise be pushed below it and parse the note once for each mention.
    return named.withColumn("fields", F.explode(F.array(F.map_from_entries(last)))).drop("_pairs", "_keys")


def _text(fields: Column, key: str) -> Column:
    raw = F.try_element_at(fields, F.lit(key))
    return F.when(~raw.isin("", "null", "~"), _unquote(raw))


def _list(fields: Column, key: str | Column) -> Column:
    raw = F.try_element_at(fields, F.lit(key))
    inner = F.regexp_replace(raw, r"^\[\s*|\s*\]$", "")
    items = F.regexp_extract_all(inner, F.lit(r"""\s*("(?:\\.|[^"\\])*"|'(?:''|[^'])*'|[^,]*)\s*(?:,|$)"""), 1)
    values = F.filter(F.transform(items, lambda v: _unquote(F.trim(v))), lambda v: v != "")
    single = F.when(~raw.isin("", "null", "~"), F.array(_unquote(raw)))
    return F.coalesce(F.when(raw.rlike(r"^\[.*\]$"), values), single, F.array().cast("array<string>"))


def note_values(notes: DataFrame) -> DataFrame:
    """Front matter of each note with `values`, map<string, variant>: JSON as it is, nested or not, lists of bare words, and all else as text.

    Paths reach into it: `F.try_variant_get(F.col("values")["span"], "$.from", "int")`. A field without a value is a variant null.
    """
    rows = front_matter(notes)
    bare = lambda k, v: F.to_variant_object(_list(F.create_map(k, v), k))
    value = lambda k, v: F.coalesce(
        F.try_parse_json(F.when(v.isin("", "~"), "null").otherwise(v)), F.when(v.rlike(r"^\[.*\]$"), bare(k, v)), v.cast("variant"),
    )
    return rows.withColumn("values", F.transform_values("fields", value))


def payload_rows(rows: DataFrame, key: str, payload: str, path: str, kind: str) -> DataFrame:
    """Elements of a list inside free JSON payloads: key, position and the element as `kind`; payloads that are no JSON, or hold no list there, give no row."""
    items = F.try_variant_get(F.try_parse_json(payload), path, "array<variant>")
    found = rows.select(F.col(key), F.posexplode(items).alias("position", "_item"))
    return found.select(key, "position", F.try_variant_get("_item", "$", kind).alias("item"))


def parse_notes(notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed note rows, and warnings for notes without id or with an unsupported kind."""
    rows = front_matter(notes)
    f = F.col("fields")

    def number(key: str) -> Column:
        value = _text(f, key)
        return F.when(value.rlike(r"^-?\d+(\.\d+)?$"), value.cast("double"))

    typed = rows.select(
        "path", _text(f, "id").alias("id"), _text(f, "label").alias("label"), _text(f, "type").alias("node_type"), _text(f, "zone").alias("zone"),
        _list(f, "roles").alias("roles"), _list(f, "aliases").alias("aliases"), number("eraStart").cast("int").alias("era_start"),
        number("eraPeak").cast("int").alias("era_peak"), _list(f, "primaryGenres").alias("primary_genres"), _list(f, "curatorTags").alias("curator_tags"),
        _list(f, "secondaryZones").alias("secondary_zones"), (_text(f, "layoutPinned") == "true").alias("pinned"),
        number("layoutX").alias("x"), number("layoutY").alias("y"), (_text(f, "starter") == "true").alias("starter"),
    )
    bad_kind = F.col("node_type").isNotNull() & ~F.col("node_type").isin(*vocab.NODE_KINDS)
    rule = F.when(F.col("id").isNull(), "note_without_id").when(bad_kind, "note_kind")
    warnings = typed.select(rule.alias("rule"), F.col("path").alias("key"), F.col("node_type").alias("detail")).where(F.col("rule").isNotNull())
    return typed.where(F.col("id").isNotNull() & ~F.coalesce(bad_kind, F.lit(False))), warnings


def page_corpus(pages: DataFrame) -> DataFrame:
    """Title, links and host of raw pages; pages without a title are dropped."""
    title = F.trim(F.regexp_extract("html", r"<title>([^<]*)</title>", 1))
    links = F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), 1)
    host = F.lower(F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1))
    return pages.select("page_id", "url", title.alias("title"), links.alias("links"), host.alias("host")).where(F.col("title") != "")


def page_links(pages: DataFrame) -> DataFrame:
    return page_corpus(pages).select("page_id", F.posexplode("links").alias("pos", "link"))


CLAIM_VALUE = (
    "struct<snaktype:string,datavalue:struct<value:struct<id:string,time:string,text:string,latitude:double,longitude:double,globe:string>>>"
)
CLAIM_JSON = f"map<string,array<struct<id:string,rank:string,mainsnak:{CLAIM_VALUE},references:array<struct<urls:array<string>>>>>>"


def claims_from_json(entities: DataFrame, column: str = "claims") -> DataFrame:
    """Long claim rows of entities whose statements are a JSON map by property."""
    parsed = entities.select("entity_id", F.explode(F.from_json(column, CLAIM_JSON)).alias("property", "statements"))
    rows = parsed.select("entity_id", "property", F.explode("statements").alias("s"))
    v = F.col("s.mainsnak.datavalue.value")
    return rows.select(
        "entity_id", "property", F.col("s.id").alias("statement_id"), F.coalesce("s.rank", F.lit("normal")).alias("rank"),
        F.col("s.mainsnak.snaktype").alias("snaktype"), v["id"].alias("value_id"), v["time"].alias("value_time"), v["text"].alias("value_text"),
        v["latitude"].alias("lat"), v["longitude"].alias("lon"), v["globe"].alias("globe"),
        F.flatten(F.coalesce(F.transform("s.references", lambda r: r["urls"]), F.array().cast("array<array<string>>"))).alias("reference_urls"),
    )


def pseudo_nodes(reviews: DataFrame) -> DataFrame:
    """Open and approved candidates as nodes with `candidate:` ids."""
    return reviews.where(F.col("status").isin("review", "approved")).select(
        F.concat(F.lit("candidate:"), "id").alias("id"), F.col("seed_name").alias("label"), F.col("requested_kind").alias("node_type"), "status"
    )


def live_nodes(published: DataFrame, live: DataFrame, candidates: DataFrame) -> DataFrame:
    """Published nodes overlaid by live ones, and candidates as pseudo-nodes."""
    kept = published.select("id", "label", "node_type").join(live.select(F.col("id").alias("_live")), F.col("id") == F.col("_live"), "left_anti")
    return kept.unionByName(live.select("id", "label", "node_type")).unionByName(pseudo_nodes(candidates).drop("status"))


def queue(requests: DataFrame, status: str = "queued", limit: int | None = None) -> DataFrame:
    """Queued requests: highest priority, then oldest, then id."""
    ordered = requests.where(F.col("status") == status).orderBy(F.desc("priority"), F.asc("created_at"), F.asc("id"))
    return ordered.limit(limit) if limit else ordered


def queue_of_files(requests: DataFrame, limit: int | None = None) -> DataFrame:
    """The file variant: everything descending."""
    ordered = requests.where(F.col("status") == "queued").orderBy(F.desc("priority"), F.desc("created_at"), F.desc("id"))
    return ordered.limit(limit) if limit else ordered
