"""Writers: checked snapshots, notes, indexes, run ledgers and geography outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions.text import label_order
from evigraph.operators.graph import end_kinds
from evigraph.operators.prefix import positions


def approved_snapshot(facts: DataFrame) -> DataFrame:
    """Public fields of approved facts, sorted; a bad or repeated row fails the job that writes it."""
    ok = (
        (F.col("status") == "approved") & (F.trim("entity_id") != "") & (F.trim("source_fingerprint") != "") & (F.size("sources") > 0)
        & F.forall("sources", lambda s: (F.trim(s["label"]) != "") & s["url"].rlike(r"^https://[^/\s]+"))
    )
    checked = facts.withColumn("_ok", F.assert_true(F.coalesce(ok, F.lit(False)), F.concat(F.lit("invalid approved fact "), "id")))
    kept = checked.where(F.col("_ok").isNull()).select("entity_id", "text", "tags", "sources", "source_fingerprint", "verified_at")
    return kept.orderBy("entity_id", "source_fingerprint")


def repeated_fingerprints(facts: DataFrame) -> DataFrame:
    counted = facts.groupBy("entity_id", "source_fingerprint").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return counted.select(
        F.lit("fingerprint_repeated").alias("rule"), F.concat_ws(":", "entity_id", "source_fingerprint").alias("key"),
        F.col("_n").cast("string").alias("detail"),
    )


def write_single_json(df: DataFrame, path: str) -> None:
    """One ordered JSON file for a bounded snapshot; use partitioned Parquet for anything larger."""
    df.coalesce(1).write.mode("overwrite").json(path)


def front_matter_lines(nodes: DataFrame, extra: str | None = None) -> DataFrame:
    """The head of each note that `readers.parse_notes` reads back (id, node_type, section 0, line_no, line).

    `extra` names a column map<string, variant> of further fields, nested ones too: a line each, in order of their names, with the value as JSON,
    which `readers.note_values` reads back.
    """
    def quoted(value: Column) -> Column:
        return F.concat(F.lit('"'), F.replace(F.coalesce(value, F.lit("")), F.lit('"'), F.lit('\\"')), F.lit('"'))

    def listed(name: str) -> Column:
        return F.concat(F.lit("["), F.array_join(F.transform(name, quoted), ", "), F.lit("]"))

    def plain(name: str, kind: str = "string") -> Column:
        return F.coalesce(F.col(name).cast(kind).cast("string"), F.lit(""))

    fields = [
        ("id", plain("id")), ("label", quoted(F.col("label"))), ("type", plain("node_type")), ("zone", plain("zone")), ("roles", listed("roles")),
        ("aliases", listed("aliases")), ("eraStart", plain("era_start")), ("layoutX", plain("x", "decimal(18,3)")), ("layoutY", plain("y", "decimal(18,3)")),
        ("starter", plain("starter")),
    ]
    lines = F.array(F.lit("---"), *[F.concat(F.lit(f"{name}: "), value) for name, value in fields])
    if extra:
        named = F.array_sort(F.map_keys(extra))
        more = F.transform(named, lambda k: F.concat(k, F.lit(": "), F.coalesce(F.to_json(F.try_element_at(F.col(extra), k)), F.lit("null"))))
        lines = F.concat(lines, F.coalesce(more, F.array().cast("array<string>")))
    lines = F.concat(lines, F.array(F.lit("---")))
    numbered = nodes.select("id", "node_type", F.lit(0).alias("section"), F.posexplode(lines).alias("_n", "line"))
    return numbered.withColumn("line_no", (F.col("_n") + 1).cast("bigint")).drop("_n")


def note_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of one markdown note per node: front matter, head, sorted relations, sources (id, node_type, section, line_no, line).

    The relations of a node are numbered by slices, so a node with a third of all relations is not one task.
    """
    context = F.when(F.size("context") > 0, F.concat(F.lit(" ("), F.array_join("context", "; "), F.lit(")"))).otherwise("")
    ends = end_kinds(edges.select("source", "target", F.concat(F.lit("]] - "), "label", context).alias("_tail")), nodes)

    def seen(near: str, far: str) -> Column:
        return F.struct(F.col(near).alias("id"), F.col(f"{near}_type").alias("node_type"), F.col(far).alias("other"), F.col(f"{far}_label").alias("other_label"))

    both = ends.select("_tail", F.explode(F.array(seen("source", "target"), seen("target", "source"))).alias("_end")).select("_tail", "_end.*")
    related = both.select("id", "node_type", label_order("other_label").alias("_order"), F.concat(F.lit("- [["), "other", F.lit("|"), "other_label", "_tail").alias("line"))
    numbered = positions(related, [("_order", True), ("line", True)], "line_no", ["id"], ["id", "node_type", "line"])
    body = numbered.select("id", "node_type", F.lit(2).alias("section"), "line_no", "line")
    summary = F.when(F.coalesce("summary", F.lit("")) == "", "No summary yet.").otherwise(F.col("summary"))
    head = nodes.select("id", "node_type", F.lit(1).alias("section"), F.posexplode(F.array(F.concat(F.lit("# "), "label"), F.lit("## Summary"), summary)).alias("_n", "line"))
    sources = F.transform("sources", lambda s: F.concat(F.lit("- ["), F.coalesce(s["label"], s["provider"], F.lit("Source")), F.lit("]("), s["url"], F.lit(")")))
    listed = F.when(F.size("sources") > 0, sources).otherwise(F.array(F.lit("No sources yet.")))
    tail = nodes.select("id", "node_type", F.lit(3).alias("section"), F.posexplode(listed).alias("_n", "line"))
    ends = head.unionByName(tail).withColumn("line_no", (F.col("_n") + 1).cast("bigint")).drop("_n")
    return front_matter_lines(nodes).unionByName(body).unionByName(ends)


def write_notes(lines: DataFrame, path: str) -> None:
    """Text files by kind; the lines of a note follow each other in order."""
    ordered = lines.repartitionByRange("node_type", "id", "section", "line_no").sortWithinPartitions("node_type", "id", "section", "line_no")
    ordered.select("node_type", F.col("line").alias("value")).write.mode("overwrite").partitionBy("node_type").text(path)


def index_lines(nodes: DataFrame) -> DataFrame:
    """Numbered index lines per kind in locale order of label; the order of a kind is built without one task per kind."""
    ranked = positions(nodes.select("node_type", "label", "id", label_order("label").alias("_order")), [("_order", True), ("id", True)], "line_no", ["node_type"])
    return ranked.select("node_type", "line_no", F.concat(F.lit("- [["), "id", F.lit("|"), "label", F.lit("]]")).alias("line"))


def run_rows(packages: DataFrame) -> DataFrame:
    """Ledger row per run: sizes of the nested parts and the number of documented relations."""
    return packages.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("candidates"),
        F.sum(F.size("link_leads")).alias("link_leads"),
        F.sum(F.size("music_candidates")).alias("related"),
        F.sum(F.size(F.filter("music_candidates", lambda c: c["documented_relation"].isNotNull()))).alias("documented"),
        F.sum(F.size("source_errors")).alias("source_errors"),
    )


def write_geography(folder: str, summary: DataFrame, placements: DataFrame, pending: DataFrame, missing: DataFrame) -> None:
    """The outputs of a geography run: the dataset, the candidates with a location, what has no place, and the counts."""
    for name, rows in (("placements", placements), ("pending", pending), ("unresolved", missing), ("summary", summary)):
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")
