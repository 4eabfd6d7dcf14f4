"""Document fingerprints of closed syncmers: word windows whose smallest word hash lies at an edge.

DataFrame operations only. Whether a window is chosen depends on the window alone, so the same passage gives the same
anchors in any text. A fingerprint keeps the ANCHORS smallest anchors of the whole text with their word positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.llm.shared import texts

WINDOW, ANCHORS, SHIFT = 5, 64, 32
#: Texts with fewer words than one in so many characters are cut into characters instead.
LONG_WORD = 32


def _let(value: Column, body) -> Column:
    """Bind a value once for an expression that uses it often."""
    return F.transform(F.array(value), body)[0]


def tokens(text: Column) -> Column:
    by_space = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    return _let(by_space, lambda w: F.when(F.size(w) * LONG_WORD >= F.length(text), w).otherwise(F.array_remove(F.split(text, ""), "")))


def anchors(text: Column) -> Column:
    """The ANCHORS smallest (hash, pos) of a text, one for each hash, at its first position; none without words.

    A window is an anchor if neither inner word hash is below both of its ends. Texts of fewer than WINDOW words have one
    anchor, the whole text.
    """
    hashes = F.transform(tokens(text), lambda w: F.xxhash64(w))

    def chosen(h: Column) -> Column:
        def closed(i: Column) -> Column:
            inner = F.least(*[F.get(h, i + k) for k in range(1, WINDOW - 1)])
            return F.least(F.get(h, i), F.get(h, i + WINDOW - 1)) <= inner

        starts = F.filter(F.sequence(F.lit(0), F.size(h) - WINDOW), closed)
        anchor = lambda i: F.struct(F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]).alias("hash"), i.alias("pos"))
        whole = F.array(F.struct(F.xxhash64(h).alias("hash"), F.lit(0).alias("pos")))
        none = F.slice(whole, 1, 0)
        return F.when(F.size(h) >= WINDOW, F.transform(starts, anchor)).when(F.size(h) > 0, whole).otherwise(none)

    first_of_hash = lambda a: F.filter(a, lambda x, i: (i == 0) | (F.get(a, i - 1)["hash"] != x["hash"]))
    return F.slice(_let(F.sort_array(_let(hashes, chosen)), first_of_hash), 1, ANCHORS)


def fingerprint(found: Column) -> Column:
    """hash:position of each anchor, by hash."""
    return F.array_join(F.transform(found, lambda x: F.concat(F.lower(F.hex(x["hash"])), F.lit(":"), x["pos"].cast("string"))), ",")


def likeness(a: Column, b: Column) -> Column:
    """How much of two texts agrees, 0 to 1: the share of anchors that both have at positions which agree.

    Of the ANCHORS smallest hashes of both together, those in both count if their shift is within SHIFT words of the
    median shift; the share j of them gives 2j / (1 + j). Two texts without words are alike, one of them is not.
    """
    hashes = lambda x: F.transform(x, lambda y: y["hash"])
    together = F.slice(F.sort_array(F.array_union(hashes(a), hashes(b))), 1, ANCHORS)
    places = F.map_from_arrays(hashes(b), F.transform(b, lambda y: y["pos"]))

    def share(bound: Column) -> Column:
        top, size = F.element_at(bound["union"], -1), F.size(bound["union"])
        common = F.filter(a, lambda x: (x["hash"] <= top) & F.array_contains(bound["other"], x["hash"]))
        shifts = F.sort_array(F.transform(common, lambda x: bound["places"][x["hash"]] - x["pos"]))
        agree = _let(shifts, lambda s: F.size(F.filter(s, lambda d: F.abs(d - F.get(s, F.floor(F.size(s) / 2).cast("int"))) <= SHIFT)))
        return F.when(size == 0, F.lit(1.0)).otherwise(_let(agree / size, lambda j: 2 * j / (1 + j)))

    return _let(F.struct(together.alias("union"), places.alias("places"), hashes(b).alias("other")), share)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and the row's place in an order: bucket (ranges of ids) and ghost.

    Ranges come from approximate quantiles, which only balance the work. The first row of each range is also a ghost at
    the end of the range before it in descending order (that of the last range: the first), so every row finds its
    successor inside its own range. Null ids come last; equal ids are ordered by text, descending.
    """
    rows = texts(docs, id_col, text_col)
    parts = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = rows.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 100 * parts).alias("cuts")).first().cuts or []
    bounds = F.array(*[F.lit(x).cast("long") for x in sorted(set(cuts))]) if cuts else F.array().cast("array<bigint>")
    bucket = F.size(F.filter(bounds, lambda x: x < F.col("doc_id")))
    placed = rows.withColumn("bucket", bucket)
    tops = placed.groupBy("bucket").agg(F.max("doc_id").alias("top"))  # a row for each range
    order = Window.orderBy(F.col("bucket").desc())
    everywhere = Window.partitionBy()
    tops = tops.select(F.coalesce(F.lag("bucket").over(order), F.min("bucket").over(everywhere)).alias("ghost_in"), F.col("bucket").alias("of"), "top")
    tops = F.broadcast(tops)
    joined = placed.join(tops, (placed["bucket"] == tops["of"]) & placed["doc_id"].eqNullSafe(tops["top"]), "left")
    own = F.struct(F.col("bucket").alias("range"), F.lit(False).alias("ghost"))
    ghost = F.struct(F.col("ghost_in").alias("range"), F.lit(True).alias("ghost"))
    copies = F.when(F.col("of").isNull(), F.array(own)).otherwise(F.array(own, ghost))
    return joined.select("doc_id", "text", F.explode(copies).alias("place")).select("doc_id", "text", "place.range", "place.ghost")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, fingerprint (of the whole text; null counts as empty). No shuffle."""
    return texts(docs, id_col, text_col).select("doc_id", fingerprint(anchors(F.col("text"))).alias("fingerprint"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text and their likeness, and the likeness to the next document.

    The next document follows in descending order of ids (the first follows the last; a single document follows itself).
    The edited text has the last third of the code points replaced by the first as many of the next text. Every row counts.
    """
    order = Window.partitionBy("range").orderBy("ghost", F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    n = F.length("text")
    edited = F.concat(F.expr("substring(text, 1, length(text) - int(floor(length(text) / 3)))"), F.expr("substring(next_text, 1, int(floor(length(text) / 3)))"))
    placed = with_next(docs, id_col, text_col).withColumn("next_text", F.coalesce(F.lead("text").over(order), F.lit("")))
    made = placed.select(
        "range", "ghost", "doc_id", "text", n.cast("long").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"),
        anchors(F.col("text")).alias("own"), anchors(edited).alias("changed"),
    )
    both = made.withColumn("next", F.lead("own").over(order)).where("not ghost")
    return both.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
