"""Benchmark decontamination: a prefix-filtered join of document shingles with item windows, then exact containment.

DataFrame operations only. A window occurs in a document only if its rarest shingle does, so one shingle of each window
is the whole prefix that containment needs: the join finds that shingle in the documents, the position says where the
window would have to start and end, and the words between are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.llm.shared import lower_ascii, texts, write_table

# Fixed value: what separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE = 3
#: Windows up to which they are broadcast: some hundred bytes each.
BROADCAST_WINDOWS = 100_000
END = -1  # the length that marks the row of a document itself
ROW = ["doc_id", "text_key"]


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(text), SEPARATORS), "")


def _shingle(all_words: Column, at: Column, length: int) -> Column:
    return F.xxhash64(*[F.get(all_words, at + k) for k in range(length)])


def _positions(docs: DataFrame, lengths: list[int], id_col: str, text_col: str) -> DataFrame:
    """A row for each word position and shingle length, and one with `at` = n_words that stands for the document."""
    split = texts(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("words"))
    at = F.explode(F.sequence(F.lit(0), F.size("words"))).alias("at")
    rows = split.select(*ROW, "words", at)
    if lengths == [SHINGLE]:
        return rows.withColumn("shingle", _shingle(F.col("words"), F.col("at"), SHINGLE))
    keys = F.array(*[_shingle(F.col("words"), F.col("at"), k) for k in lengths])
    return rows.withColumn("shingle", F.explode(F.array_distinct(keys)))


def windows(benchmark: DataFrame, size: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (item_id, window, n): `size` consecutive item words, or all words of a shorter item; none without words."""
    split = benchmark.select(F.col(id_col).cast("string").alias("item_id"), words(F.coalesce(F.col(text_col), F.lit(""))).alias("words")).where(F.size("words") > 0)
    first = F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1))))
    cut = split.withColumn("first", first).withColumn("window", F.slice("words", F.col("first"), size))
    return cut.select("item_id", F.array_join("window", " ").alias("window"), F.size("window").alias("n")).distinct()


def contamination(
    docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """Per document: doc_id, text_key, n_words, n_hit, n_items, items (ids as strings, sorted), contaminated.

    A document word inside any occurrence of a window is hit. Texts that are null or without words have no words and no
    hits; items without words have no window, and items without id hit words but are not counted. Rows that repeat an id
    with the same text are one row; the same id with another text is another row. An empty table of items hits nothing.
    """
    item_windows = write_table(windows(benchmark, size, item_col, item_text_col), "item-windows")
    distinct = item_windows.select("window", "n", F.split("window", " ").alias("item_words")).distinct()
    few = distinct.limit(broadcast_windows + 1).count() <= broadcast_windows
    lengths = sorted({min(r.n, SHINGLE) for r in distinct.select(F.least("n", F.lit(SHINGLE)).alias("n")).distinct().collect()}) or [SHINGLE]
    small = F.broadcast if few else (lambda df: df)

    # Every window's shingles, by place; the rarest in the documents is the prefix.
    place = F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - SHINGLE, F.lit(0)))).alias("place")
    each = distinct.select("window", "n", "item_words", place)
    hashed = F.lit(None).cast("long")
    for k in lengths:
        hashed = F.when(F.least("n", F.lit(SHINGLE)) == k, _shingle(F.col("item_words"), F.col("place"), k)).otherwise(hashed)
    each = each.select("window", "n", "place", hashed.alias("shingle"))
    rows = _positions(docs, lengths, id_col, text_col)
    counts = rows.select("shingle").join(small(each.select("shingle").distinct()), "shingle").groupBy("shingle").agg(F.count("*").alias("uses"))
    counts = write_table(counts, "shingle-counts")
    rare = F.min(F.struct(F.coalesce("uses", F.lit(0)).alias("uses"), "shingle", "place")).alias("rare")
    prefix = each.join(counts, "shingle", "left").groupBy("window", "n").agg(rare).select("window", "n", "rare.shingle", "rare.place")

    # The document itself joins as a row of length END, so one pass gives word counts and hits.
    own = docs.sparkSession.range(1).select(F.lit("").alias("window"), F.lit(END).alias("n"), F.lit(0).cast("long").alias("shingle"), F.lit(0).alias("place"))
    prefix = write_table(prefix.unionByName(own), "window-prefixes")
    start = F.col("at") - F.col("place")
    if few:
        last = F.col("at") == F.size("words")
        keyed = rows.withColumn("shingle", F.when(last, F.lit(0).cast("long")).otherwise(F.col("shingle")))
        found = keyed.join(F.broadcast(prefix), "shingle")
        inside = (start >= 0) & (start + F.col("n") <= F.size("words"))
        same = F.array_join(F.slice("words", F.greatest(start, F.lit(0)) + 1, F.greatest("n", F.lit(0))), " ") == F.col("window")
        found = found.where(F.when(F.col("n") == END, last).otherwise(~last & inside & same))
        found = found.select(*ROW, F.size("words").alias("n_words"), start.alias("start"), "n", "window")
    else:  # only ids and positions meet the windows; the words are looked up for what met
        narrow = rows.where(F.col("at") < F.size("words")).select(*ROW, "at", "shingle").join(prefix.where(f"n <> {END}"), "shingle")
        narrow = narrow.select(*ROW, start.alias("start"), "n", "window").where("start >= 0")
        split = texts(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("words"))
        met = split.alias("d").join(narrow.alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.text_key") == F.col("w.text_key")))
        same = F.array_join(F.slice("words", F.col("start") + 1, F.col("n")), " ") == F.col("window")
        met = met.where((F.col("start") + F.col("n") <= F.size("words")) & same)
        found = met.select("d.doc_id", "d.text_key", F.size("words").alias("n_words"), "start", "n", "window")
        found = found.unionByName(split.select(*ROW, F.size("words").alias("n_words"), F.lit(0).alias("start"), F.lit(END).alias("n"), F.lit("").alias("window")))
    found = write_table(found, "hits")

    documents = found.where(f"n = {END}").groupBy(*ROW).agg(F.max("n_words").alias("n_words"))
    hits = found.where(f"n <> {END}").select(*ROW, "start", "n", "window").distinct()
    before = Window.partitionBy(*ROW).orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("n")
    new = F.greatest(end - F.greatest("start", F.coalesce(F.max(end).over(before), F.lit(0))), F.lit(0))
    hit_words = hits.withColumn("new", new).groupBy(*ROW).agg(F.sum("new").alias("n_hit"))
    by_item = hits.select(*ROW, "window").distinct().join(item_windows.where("item_id is not null").select("window", "item_id"), "window")
    items = by_item.groupBy(*ROW).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    result = documents.alias("d")
    for k, part in enumerate((hit_words, items)):
        on = F.col("d.doc_id").eqNullSafe(F.col(f"p{k}.doc_id")) & (F.col("d.text_key") == F.col(f"p{k}.text_key"))
        result = result.join(part.alias(f"p{k}"), on, "left")
    n_hit = F.coalesce("p0.n_hit", F.lit(0)).cast("long")
    listed = F.coalesce("p1.items", F.array().cast("array<string>"))
    return result.select(
        "d.doc_id", "d.text_key", F.col("d.n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"), listed.alias("items"), (n_hit > 0).alias("contaminated"),
    )


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns: the item ids as a checksum."""
    found = contamination(docs, benchmark)
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns as they are, in which no window occurs."""
    bad = write_table(contamination(docs, benchmark, id_col=id_col, text_col=text_col).where("contaminated").select(*ROW), "contaminated")
    on = docs[id_col].cast("long").eqNullSafe(bad["doc_id"]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == bad["text_key"])
    return docs.join(bad, on, "left_anti")
