"""Interactive reads: map page, neighbourhoods and search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph import vocab
from evigraph.functions.text import label_order
from evigraph.operators.evidence import induced_edges
from evigraph.operators.graph import endpoints
from evigraph.session import cut_lineage


def _positive(limit: int) -> None:
    if limit < 1:
        raise ValueError(f"a page needs a limit of 1 or more, not {limit}")


def map_page(nodes: DataFrame, mode: str, limit: int = 800) -> DataFrame:
    """The first `limit` nodes, starters first, then by label in locale order."""
    _positive(limit)
    kept = nodes.where(F.col("node_type").isin(*vocab.MODE_KINDS[mode]))
    return kept.orderBy(F.desc("starter"), F.asc(label_order("label")), F.asc("id")).limit(limit)


def map_edges(edges: DataFrame, page: DataFrame, limit: int = 5000) -> DataFrame:
    """The first `limit` relations between the nodes of a page, in order of id."""
    _positive(limit)
    return induced_edges(edges, page).orderBy("id").limit(limit)


def neighborhood(edges: DataFrame, center: str, limit: int = 80, keep_center: bool = True) -> DataFrame:
    """Ids one hop from the centre in order of id, cut at `limit`.

    With `keep_center` the centre always counts among them; without it the plain cut may drop it.
    """
    _positive(limit)
    near = endpoints(edges.where((F.col("source") == center) | (F.col("target") == center)).select("source", "target"))
    ids = near.where(F.col("id") == center).select(F.col("other").alias("id"))
    own = edges.sparkSession.range(1).select(F.lit(center).alias("id"))
    union = ids.union(own).distinct()
    order = [F.asc("id")]
    if keep_center:
        order.insert(0, F.asc(F.when(F.col("id") == center, 0).otherwise(1)))
    return union.orderBy(*order).limit(limit)


def reach(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """Ids within `depth` hops of the start ids, with their level; breadth first.

    Every level is one join; lineage is cut at each level so that a deep search does not grow its plan.
    """
    both = endpoints(edges.select("source", "target")).select(F.col("id").alias("_from"), F.col("other").alias("_to")).distinct()
    seen = start.select("id").distinct().withColumn("level", F.lit(0))
    frontier = seen.select("id")
    for level in range(1, depth + 1):
        found = both.join(frontier, F.col("_from") == F.col("id"), "left_semi").select(F.col("_to").alias("id")).distinct()
        fresh = found.join(seen.select("id"), "id", "left_anti")
        if level < depth:
            fresh = cut_lineage(fresh)
        frontier = fresh
        seen = seen.unionByName(fresh.withColumn("level", F.lit(level)))
    return seen


def search(nodes: DataFrame, query: str, limit: int = 12) -> DataFrame:
    """Substring of label, kind, roles, metadata or aliases; labels that start with the query come first."""
    wanted = query.strip().lower()
    if not wanted:
        return nodes.limit(0)
    text = F.lower(F.concat_ws(" ", "label", "node_type", F.array_join("roles", " "), F.array_join("metadata", " "), F.array_join("aliases", " ")))
    hits = nodes.where(F.contains(text, F.lit(wanted)))
    return hits.orderBy(F.desc(F.startswith(F.lower("label"), F.lit(wanted))), F.asc(label_order("label")), F.asc("id")).limit(limit)


def search_labels(nodes: DataFrame, query: str, limit: int = 12) -> DataFrame:
    """As `search` over labels and aliases only, from two characters on."""
    wanted = query.strip().lower()
    if len(wanted) < 2:
        return nodes.limit(0)
    text = F.lower(F.concat_ws(" ", "label", F.array_join("aliases", " ")))
    hits = nodes.where(F.contains(text, F.lit(wanted)))
    return hits.orderBy(F.desc(F.startswith(F.lower("label"), F.lit(wanted))), F.asc(label_order("label")), F.asc("id")).limit(limit)
