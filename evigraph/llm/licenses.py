"""License scans: MinHash bands over overlapping windows find templates, exact shingle containment decides.

DataFrame operations only. A template of n words is looked for in windows of 2n words that begin every n words, so any place of
it lies in one window. A window that holds `share` of a template's shingles has a Jaccard similarity J with it of which the least value
is known, and with one hash function a band it meets the template in some band with probability 1 - (1 - J)^bands; each template gets as
many bands as the wanted probability asks for. A band can only agree where the window holds the template's smallest shingle under that
function, so documents meet the bands by one join on shingles, and signatures are worked out for the windows around those places only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm.decontam import words
from evigraph.llm.shared import texts, write_table

SHINGLE, SHARE, PROBABILITY = 5, 0.75, 0.9999
#: Bands up to which they are broadcast: some hundred bytes each.
BROADCAST_BANDS = 100_000
KEY = ["doc_id", "text_key"]

# Notices of public licenses.
LICENSES = (
    ("apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("bsd-conditions", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-4.0-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("gpl-3.0-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("mit-notice", "Released under the MIT License."),
    ("mit-permission", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
)


def license_templates(spark: SparkSession, rows: Sequence[tuple[str, str]] = LICENSES) -> DataFrame:
    return spark.createDataFrame(list(rows), "template_id string, text string")


def _hash(all_words: Column, at: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(all_words, at + i) for i in range(k)])


def _shingles(all_words: Column, length: Column) -> Column:
    """Hashes of `length` consecutive words, one to five; an empty array if there are fewer words."""
    def each(k: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(all_words) - k), lambda i: _hash(all_words, i, k))

    found = F.array().cast("array<bigint>")
    for k in range(1, SHINGLE + 1):
        found = F.when((length == k) & (F.size(all_words) >= k), each(k)).otherwise(found)
    return found


def template_bands(templates: DataFrame, share: float = SHARE, probability: float = PROBABILITY, id_col: str = "template_id", text_col: str = "text") -> DataFrame:
    """A row for each template and band: template_id, n (words), length (of a shingle: five words, or all of a shorter template), needed (shingles that
    must be there), shingles (distinct), band, value (smallest hash) and shingle (where it is taken). Templates without id or words give none."""
    split = templates.select(F.col(id_col).cast("string").alias("template_id"), words(F.coalesce(F.col(text_col), F.lit(""))).alias("w"))
    split = split.where(F.col("template_id").isNotNull() & (F.size("w") > 0)).withColumn("n", F.size("w")).withColumn("length", F.least("n", F.lit(SHINGLE)))
    cut = split.withColumn("shingles", F.array_distinct(_shingles(F.col("w"), F.col("length")))).drop("w").distinct()
    needed = F.ceil(F.size("shingles") * F.lit(share) - F.lit(1e-9)).cast("int")
    least = F.col("needed") / (2 * F.col("n") - F.col("length") + 1 + F.size("shingles") - F.col("needed"))
    bands = F.when(least >= 1, 1).otherwise(F.ceil(F.log(F.lit(1 - probability)) / F.log(1 - least))).cast("int")
    sized = cut.withColumn("needed", needed).withColumn("bands", bands)
    each = sized.withColumn("band", F.explode(F.sequence(F.lit(1), "bands"))).drop("bands")
    smallest = F.array_min(F.transform("shingles", lambda s: F.struct(F.xxhash64(s, F.col("band")).alias("value"), s.alias("shingle"))))
    return each.withColumn("_least", smallest).select("template_id", "n", "length", "needed", "shingles", "band", "_least.value", "_least.shingle")


def scan(
    docs: DataFrame, templates: DataFrame, share: float = SHARE, probability: float = PROBABILITY, id_col: str = "doc_id", text_col: str = "text",
    broadcast_bands: int = BROADCAST_BANDS,
) -> DataFrame:
    """doc_id, text_key, template_id, containment, word (where the first window begins) and windows of every template found in a text.

    A template is found where a window of twice its words holds at least `share` of its distinct shingles; containment is the best
    window's share. Rows that repeat an id with the same text are one. Null and empty texts hold nothing. The whole text is read, whatever its length.
    """
    bands = write_table(template_bands(templates, share, probability), "template-bands")
    few = bands.limit(broadcast_bands + 1).count() <= broadcast_bands
    lengths = sorted(r.length for r in bands.select("length").distinct().collect()) or [SHINGLE]  # five values at most
    about = ["template_id", "n", "length"]
    meeting = bands.groupBy(*about, "shingle").agg(F.collect_list(F.struct("band", "value")).alias("bands"))
    split = texts(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("w"))
    start = F.col("at")
    first = F.greatest(F.lit(0), F.ceil((start + F.col("length") - 2 * F.col("n")) / F.col("n")).cast("int"))
    covering = F.sequence(first, F.floor(start / F.col("n")).cast("int"))  # two windows at most
    met = None
    for k in lengths:  # one pass for each length, so that no array of words goes into a row for each word
        rows = split.where(F.size("w") >= k).select(*KEY, "w", F.explode(F.sequence(F.lit(0), F.size("w") - k)).alias("at"))
        hashed, mine = _hash(F.col("w"), F.col("at"), k).alias("shingle"), meeting.where(F.col("length") == k)
        if few:  # the windows are cut where a band is met, in the task that holds the text
            part = rows.select(*KEY, "w", "at", hashed).join(F.broadcast(mine), "shingle")
            cut = F.transform(covering, lambda j: F.struct(j.alias("window"), F.slice("w", j * F.col("n") + 1, 2 * F.col("n")).alias("inside")))
        else:  # only ids and positions travel to the bands; the words are looked up for what met
            part = rows.select(*KEY, "at", hashed).join(mine, "shingle")
            cut = F.transform(covering, lambda j: F.struct(j.alias("window")))
        part = part.select(*KEY, *about, "bands", F.explode(cut).alias("_cut")).select(*KEY, *about, "bands", "_cut.*")
        met = part if met is None else met.unionByName(part)
    texts_of = [F.any_value("inside").alias("inside")] if few else []
    hit = met.groupBy(*KEY, *about, "window").agg(F.array_distinct(F.flatten(F.collect_list("bands"))).alias("bands"), *texts_of)
    if not few:
        hits = write_table(hit, "window-hits")
        both = split.alias("d").join(hits.alias("h"), F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.text_key") == F.col("h.text_key")))
        inside = F.slice("w", F.col("window") * F.col("n") + 1, 2 * F.col("n"))
        hit = both.select("d.doc_id", "d.text_key", *about, "window", "bands", inside.alias("inside"))
    wanted = bands.where("band = 1").select("template_id", "needed", "shingles")
    own = F.array_distinct(_shingles(F.col("inside"), F.col("length"))).alias("own")
    cut = hit.select(*KEY, "template_id", "n", "window", "bands", own).join(F.broadcast(wanted) if few else wanted, "template_id")
    agrees = F.exists("bands", lambda b: F.array_min(F.transform("own", lambda s: F.xxhash64(s, b["band"]))) == b["value"])
    shared = F.size(F.array_intersect("own", "shingles"))
    found = cut.where(agrees).select(*KEY, "template_id", (F.col("window") * F.col("n")).alias("word"), shared.alias("shared"), "needed", F.size("shingles").alias("all"))
    return found.where("shared >= needed").groupBy(*KEY, "template_id").agg(
        F.max(F.col("shared") / F.col("all")).alias("containment"), F.min("word").cast("long").alias("word"), F.count_distinct("word").alias("windows"),
    )


def license_digest(docs: DataFrame, templates: DataFrame, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of `docs`: doc_id, n_licenses, licenses (template ids, sorted, comma-joined) and containment (the best one, 0 without any)."""
    found = write_table(scan(docs, templates, share, id_col=id_col, text_col=text_col), "licenses")
    listed = found.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_licenses"), F.array_join(F.array_sort(F.collect_list("template_id")), ",").alias("licenses"), F.max("containment").alias("containment"),
    )
    rows = texts(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("text_key"))
    joined = rows.alias("d").join(listed.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.text_key") == F.col("f.text_key")), "left")
    return joined.select(
        "d.doc_id", F.coalesce("n_licenses", F.lit(0)).alias("n_licenses"), F.coalesce("licenses", F.lit("")).alias("licenses"), F.coalesce("containment", F.lit(0.0)).alias("containment"),
    )
