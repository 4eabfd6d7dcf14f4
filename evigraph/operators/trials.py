"""Trials of layout parameters, splits of practice nodes and zone terms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph import vocab
from evigraph.functions.numeric import laplace_rate
from evigraph.functions.refs import has_url
from evigraph.functions.text import fold_text, label_order
from evigraph.operators.evidence import induced_edges, map_connections
from evigraph.operators.graph import endpoints, first_per_key, top_per_group
from evigraph.operators.prefix import positions
from evigraph.session import attach_row, cut_lineage

BORDER = 3  # letters of a border word that a two-word phrase is filed under
# Words that say nothing about a zone.
STOP_WORDS = (
    "a", "an", "and", "as", "artist", "artists", "band", "bands", "by", "brain", "for", "from", "genre", "genres",
    "guitar", "guitars", "guitarist", "guitarists", "in", "into", "music", "musician", "musicians", "of", "on", "or",
    "research", "research brain", "rock", "singer", "songwriter", "the", "to", "with",
)


def trial_history(trials: DataFrame) -> DataFrame:
    """Samples, safe trials and the smoothed safe rate by mode, zone, parameters and hints."""
    grouped = trials.groupBy("mode", "zone", "parameters", (F.col("hint_count") > 0).alias("hinted")).agg(
        F.count(F.lit(1)).alias("samples"), F.count_if(F.col("reason") == "safe").alias("safe")
    )
    return grouped.withColumn("rate", laplace_rate(F.col("safe"), F.col("samples")))


def choose_parameters(trials: DataFrame, samples: DataFrame) -> DataFrame:
    """Best parameters per mode and zone: safe almost always, at least two wins, no regression.

    Trials are (sample, mode, zone, parameters, reason, severe, outcome); samples (zone, samples). Only the best
    trial of a sample and parameter set counts: a safe one, then the least severe.
    """
    safe = (F.col("reason") == "safe").cast("int")
    best = first_per_key(trials.withColumn("_safe", safe), ["sample", "mode", "zone", "parameters"], [F.desc("_safe"), F.asc("severe"), F.asc("outcome")])
    counted = best.groupBy("mode", "zone", "parameters").agg(
        F.sum("_safe").alias("safe"),
        F.count_if((F.col("_safe") == 1) & (F.col("outcome") == "win")).alias("wins"),
        F.count_if((F.col("_safe") == 1) & (F.col("outcome") == "regression")).alias("regressions"),
    )
    joined = counted.join(samples, "zone")
    good = joined.where((F.col("safe") >= F.greatest(F.lit(2), F.col("samples") - 1)) & (F.col("wins") >= 2) & (F.col("regressions") == 0))
    return first_per_key(good, ["mode", "zone"], [F.desc("wins"), F.desc("safe"), F.asc("parameters")]).select("mode", "zone", "parameters", "safe", "wins")


def comparison_summary(rows: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Per metric: sums before and after, improved and regressed views. Rows have before_<m> and after_<m>."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"before_{m}").alias("b"), F.col(f"after_{m}").alias("a")) for m in metrics])
    return rows.select(F.explode(pairs).alias("p")).groupBy("p.metric").agg(
        F.sum("p.b").alias("before"), F.sum("p.a").alias("after"),
        F.count_if(F.col("p.a") < F.col("p.b")).alias("improved"), F.count_if(F.col("p.a") > F.col("p.b")).alias("regressed"),
    )


def practice_split(nodes: DataFrame, edges: DataFrame, train: int = 4, validation: int = 2, test: int = 2, zones: int = 12) -> DataFrame:
    """Deterministic train, validation and test nodes of the largest zones, in order of a hash of the id."""
    size = train + validation + test
    sourced = induced_edges(map_connections(edges).where(has_url(F.col("sources"))), nodes).select("source", "target")
    touched = endpoints(sourced).select(F.col("id").alias("_id")).distinct()
    usable = nodes.join(touched, F.col("id") == F.col("_id"), "left_semi").select("id", "zone")
    sizes = usable.groupBy("zone").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= size)
    chosen = sizes.orderBy(F.desc("_n"), F.asc("zone")).limit(zones).select("zone")
    hashed = usable.join(F.broadcast(chosen), "zone").withColumn("_h", F.sha2(F.concat(F.lit("layout-practice-v1:"), "id"), 256))
    ranked = top_per_group(hashed, ["zone"], [F.asc("_h"), F.asc("id")], size)
    side = F.when(F.col("rank") <= train, "train").when(F.col("rank") <= train + validation, "validation").otherwise("test")
    return ranked.select("id", "zone", side.alias("split"))


def split_all(nodes: DataFrame) -> DataFrame:
    """Hash-ordered position of every node in its zone, for splits by share; zones are ranked by slices."""
    hashed = nodes.select("id", "zone", F.sha2(F.concat(F.lit("layout-practice-v1:"), "id"), 256).alias("_h"))
    return positions(hashed, [("_h", True), ("id", True)], "position", ["zone"]).select("id", "zone", "position")


def _gap(left: Column, right: Column, tail: Column, head: Column) -> Column:
    """The last `tail` letters of a word and the first `head` of the next; null if a word is shorter."""
    fits = (F.length(left) >= tail) & (F.length(right) >= head)
    return F.when(fits, F.concat(F.lit("g"), F.right(left, tail), F.lit(" "), F.left(right, head)))


def phrase_hits(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """Distinct (id, term) where the text holds the phrase as a substring; a phrase has two words or more.

    An inverted index of phrases. A phrase between two texts' words can begin and end inside a word, but its inner words are whole;
    so each phrase is filed under its rarest inner word, counted over the texts, or under the letters around its only gap if it has two
    words. Texts meet it by one join on those keys, and the border words are checked in the row of each candidate. Neither the
    vocabulary nor the texts are collected anywhere; the work follows the candidates.
    """
    own = phrases.where(F.contains("term", F.lit(" "))).select("term").distinct().withColumn("_words", F.split("term", " "))
    size, edge = F.size("_words"), F.lit(BORDER)
    first, last = F.element_at("_words", 1), F.element_at("_words", -1)
    tail, head = F.least(F.length(first), edge), F.least(F.length(last), edge)
    inner = F.transform(F.slice("_words", F.lit(2), F.greatest(size - 2, F.lit(0))), lambda w: F.concat(F.lit("w"), w))
    keys = F.when(size > 2, F.array_distinct(inner)).otherwise(F.array(_gap(first, last, tail, head)))
    filed = own.select("term", F.explode(keys).alias("_key"), F.when(size == 2, F.struct(tail.alias("tail"), head.alias("head"))).alias("_cut"))
    filed = cut_lineage(filed)
    cuts = filed.agg(F.collect_set("_cut").alias("_cuts"))  # at most (BORDER + 1)^2 pairs of lengths

    words = attach_row(texts.select("id", F.split("text", " ").alias("_words")), cuts)
    following = F.slice("_words", F.lit(1), F.greatest(F.size("_words") - 1, F.lit(0)))
    gaps = F.flatten(F.transform(following, lambda w, i: F.transform("_cuts", lambda c: _gap(w, F.get("_words", i + 1), c["tail"], c["head"]))))
    spelled = F.array_distinct(F.concat(F.transform("_words", lambda w: F.concat(F.lit("w"), w)), F.array_compact(gaps)))
    postings = words.select("id", F.explode(spelled).alias("_key"))
    postings = cut_lineage(postings.join(filed.select("_key").distinct(), "_key", "left_semi"))
    found = filed.join(postings.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")), "_key")
    whole = filed.groupBy("term").agg(F.count(F.lit(1)).alias("_all"))
    rarest = found.groupBy("term").agg(F.count(F.lit(1)).alias("_seen"), F.min(F.struct("_n", "_key")).alias("_best")).join(whole, "term")
    index = rarest.where(F.col("_seen") == F.col("_all")).select("term", F.col("_best._key").alias("_key"))
    candidates = postings.join(index, "_key").select(F.col("id").alias("_id"), "term").distinct()
    return texts.select("id", "text").join(candidates, F.col("id") == F.col("_id")).where(F.contains("text", F.col("term"))).select("id", "term").distinct()


def zone_scores(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """Score of each text in each zone: a matched term counts max(2, words + 1), the current zone one more.

    Texts are (id, text, zone) with folded text, one row an id; terms (zone, term, weight) with folded terms, weight null for fixed
    terms and clamp(0.35 w, 0.5, 6) for learned ones. A word matches as a whole word, by one join with the distinct words
    of the texts; a phrase matches as a substring, see `phrase_hits`.
    """
    parts = F.split("term", " ")
    value = F.when(F.col("weight").isNull(), F.greatest(F.lit(2), F.size(parts) + 1).cast("double")).otherwise(
        F.least(F.lit(6.0), F.greatest(F.lit(0.5), F.col("weight") * 0.35))
    )
    table = terms.where(F.col("term") != "").select("zone", "term", value.alias("score"))
    words = texts.select("id", F.explode(F.array_distinct(F.split("text", " "))).alias("term"))
    hits = words.where(~F.contains("term", F.lit(" "))).unionByName(phrase_hits(texts, terms))
    own = texts.where(F.col("zone") != "").select("id", "zone", F.lit(1.0).alias("score"))
    return hits.join(table, "term").select("id", "zone", "score").unionByName(own).groupBy("id", "zone").agg(F.sum("score").alias("score"))


def best_zones(nodes: DataFrame, scores: DataFrame, ranks: DataFrame, default: str = "rock-circuit") -> DataFrame:
    """Zone of each node (id, node_type, preferred_zone, learned_zone), and the score if that decided.

    Instruments belong to the workshop; then a preferred, then a learned zone counts if it is among `ranks` (zone,
    zone_rank); then the best positive score, ties by rank; nodes without any get the default zone.
    """
    joined = scores.where(F.col("score") > 0).join(ranks, "zone").where(F.col("zone") != vocab.WORKSHOP_ZONE)
    best = first_per_key(joined, ["id"], [F.desc("score"), F.asc("zone_rank")]).select("id", F.col("zone").alias("_best"), "score")
    known = ranks.agg(F.collect_set("zone").alias("_known"))  # the zones of the layout
    rows = attach_row(nodes.join(best, "id", "left"), known)
    fixed = F.coalesce(
        F.when(F.col("node_type").isin("guitar", "guitar_brand"), F.lit(vocab.WORKSHOP_ZONE)),
        F.when(F.array_contains("_known", F.col("preferred_zone")), F.col("preferred_zone")),
        F.when(F.array_contains("_known", F.col("learned_zone")), F.col("learned_zone")),
    )
    return rows.select("id", F.coalesce(fixed, "_best", F.lit(default)).alias("zone"), F.when(fixed.isNull(), F.col("score")).alias("score"))


def top_tags(scores: DataFrame, fallback: DataFrame, limit: int = 3) -> DataFrame:
    """Best tags of each node, completed from the tags of its zone. Scores (id, tag, score), fallback (id, tag, rank)."""
    own = scores.groupBy("id", "tag").agg(F.sum("score").alias("score")).withColumn("_p", F.lit(0)).withColumn("_r", F.lit(0))
    spare = fallback.select("id", "tag", F.lit(0.0).alias("score"), F.lit(1).alias("_p"), F.col("rank").alias("_r"))
    distinct = first_per_key(own.unionByName(spare), ["id", "tag"], [F.asc("_p"), F.desc("score"), F.asc("_r")])
    return top_per_group(distinct, ["id"], [F.asc("_p"), F.desc("score"), F.asc("_r"), F.asc("tag")], limit).select("id", "tag", "rank")


def term_seeds(nodes: DataFrame) -> DataFrame:
    """Distinct folded terms of each node: every value, and its words of more than two letters."""
    values = F.concat(F.array("id", "label", "node_type"), F.col("roles"), F.col("metadata"), F.col("aliases"))
    rows = nodes.select("id", "zone", F.explode(values).alias("_v")).withColumn("_t", fold_text("_v")).where(F.col("_t") != "")
    words = F.filter(F.split("_t", " "), lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS))
    return rows.select("id", "zone", F.explode(F.array_distinct(F.concat(F.array("_t"), words))).alias("term")).distinct()


def zone_term_weights(seeds: DataFrame, extra: DataFrame, limit: int | None = None) -> DataFrame:
    """Terms of each zone by falling weight, with `limit` only the first so many; seeds (zone, term) weigh one, `extra` (zone, term, weight) adds feedback."""
    union = seeds.select("zone", "term", F.lit(1.0).alias("weight")).unionByName(extra.select("zone", "term", "weight"))
    kept = union.where((F.col("term") != "") & ~F.col("term").isin(*STOP_WORDS))
    summed = kept.groupBy("zone", "term").agg(F.sum("weight").alias("weight"))
    if limit is None:
        return positions(summed, [("weight", False), ("term", True)], "rank", ["zone"])
    return top_per_group(summed, ["zone"], [F.desc("weight"), F.asc("term")], limit)


def _weighted(rows: DataFrame, zone: Column, values: Column, weight: float | Column) -> DataFrame:
    found = rows.select(zone.alias("zone"), F.explode(values).alias("_v"), (weight if isinstance(weight, Column) else F.lit(weight)).cast("double").alias("weight"))
    return found.select("zone", fold_text("_v").alias("term"), "weight")


def learned_terms(nodes: DataFrame, learned: DataFrame, zone_feedback: DataFrame, policies: DataFrame, limit: int | None = None) -> DataFrame:
    """zone, term, weight and rank: the terms a model learns for each zone, all or the first `limit`, equal weights in locale order.

    A node's terms weigh 1 in its learned zone (`learned`: id, zone, primary_genres, curator_tags, feedback), 2 more if it was moved there and 1 more if it has genres;
    its genres, tags and feedback weigh 4 more each. What curators say of a zone (zone, terms, bridge_to_zones, feedback) weighs 8, 3 and 3. A bridge policy (zones,
    anchor_nodes, categories, feedback) gives each of its zones the others by 4, its anchors by 6, its categories and its feedback by 3.
    """
    none = F.array().cast("array<string>")
    own = learned.select(F.col("id").alias("_id"), F.col("zone").alias("_zone"), "primary_genres", "curator_tags", "feedback")
    both = nodes.join(own, F.col("id") == F.col("_id"))
    genres, tags = F.coalesce("primary_genres", none), F.coalesce("curator_tags", none)
    seeds = term_seeds(both.withColumn("aliases", F.concat(F.coalesce("aliases", none), genres, tags)))
    amount = F.when(F.col("_zone") != F.col("zone"), 3).otherwise(1) + F.when(F.size(genres) > 0, 1).otherwise(0)
    amounts = both.select(F.col("id").alias("_node"), "_zone", amount.cast("double").alias("weight"))
    by_node = seeds.select("id", "term").join(amounts, F.col("id") == F.col("_node")).select(F.col("_zone").alias("zone"), "term", "weight")
    said = F.array_compact(F.array("feedback"))
    others = policies.withColumn("_one", F.explode("zones"))
    parts = [
        by_node, _weighted(both, F.col("_zone"), F.concat(genres, tags, said), 4),
        *[_weighted(zone_feedback, F.col("zone"), values, weight) for values, weight in ((F.col("terms"), 8), (F.col("bridge_to_zones"), 3), (said, 3))],
        *[
            _weighted(others, F.col("_one"), values, weight)
            for values, weight in ((F.filter("zones", lambda z: z != F.col("_one")), 4), (F.col("anchor_nodes"), 6), (F.col("categories"), 3), (said, 3))
        ],
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    kept = union.where((F.col("term") != "") & ~F.col("term").isin(*STOP_WORDS) & (F.coalesce("zone", F.lit("")) != ""))
    summed = kept.groupBy("zone", "term").agg(F.round(F.sum("weight"), 3).alias("weight")).withColumn("_order", label_order("term"))
    if limit is None:
        return positions(summed, [("weight", False), ("_order", True), ("term", True)], "rank", ["zone"]).drop("_order")
    ranked = top_per_group(summed, ["zone"], [F.desc("weight"), F.asc("_order"), F.asc("term")], limit)
    return ranked.select("zone", "term", "weight", F.col("rank").cast("bigint").alias("rank"))


def learned_nodes(profile: DataFrame) -> DataFrame:
    """Zone by precedence feedback, note, graph, and bridge and hub scores from link counts.

    Rows have id, graph_zone, note_zone, feedback_zone, zones, genres, degree, bridge_boost, hub_boost and years. Instead of the number `zones` they may have
    the arrays feedback_zones, note_zones and linked_zones, of which the distinct secondary_zones are made (a linked zone counts if it is not the node's
    own); known_start and known_peak, where feedback or a note states them, go before the years.
    """
    if "linked_zones" in profile.columns:
        none = F.array().cast("array<string>")
        own = F.coalesce(F.nullif("feedback_zone", F.lit("")), F.nullif("note_zone", F.lit("")), "graph_zone")
        linked = F.filter(F.coalesce("linked_zones", none), lambda z: z != own)
        every = F.array_distinct(F.concat(F.coalesce("feedback_zones", none), F.coalesce("note_zones", none), linked))
        profile = profile.withColumn("secondary_zones", F.filter(every, lambda z: F.coalesce(z, F.lit("")) != "")).withColumn("zones", F.size("secondary_zones"))
    more = ["secondary_zones"] if "secondary_zones" in profile.columns else []
    start, peak_known = (F.col(c) if c in profile.columns else F.lit(None).cast("int") for c in ("known_start", "known_peak"))
    zone = F.coalesce(F.nullif("feedback_zone", F.lit("")), F.nullif("note_zone", F.lit("")), "graph_zone")
    bridge = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("zones") * 0.22 + F.col("genres") * 0.08 + F.col("bridge_boost")))
    hub = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("degree") / 12 + F.col("hub_boost")))
    years = F.array_sort("years")
    peak = F.when(F.size("years") > 0, F.element_at(years, (F.floor(F.size("years") / 2) + 1).cast("int")))
    return profile.select(
        "id", zone.alias("zone"), F.round(bridge, 3).alias("bridge_score"), F.round(hub, 3).alias("hub_score"),
        F.coalesce(start, F.array_min("years")).alias("era_start"), F.coalesce(peak_known, peak).alias("era_peak"), *more,
    )


def model_samples(nodes: DataFrame, edges: DataFrame, notes: DataFrame) -> DataFrame:
    """Input counters of a model build in long form."""
    def one(df: DataFrame, *measures) -> DataFrame:
        row = df.agg(*[expr.alias(name) for name, expr in measures])
        names = [name for name, _ in measures]
        return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("counter"), F.col(n).alias("n")) for n in names])).alias("c")).select("c.*")

    total = F.count(F.lit(1))
    connections = one(map_connections(edges), ("map_connections", total))
    return one(nodes, ("nodes", total), ("dated", F.count_if(F.col("era_start").isNotNull()))).unionByName(
        one(edges, ("edges", total))
    ).unionByName(connections).unionByName(one(notes, ("notes", total), ("notes_with_era", F.count_if(F.col("era_start").isNotNull()))))

