"""Learning from review outcomes: decisions, group counts, posterior adjustments, seed holdout and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph import vocab
from evigraph.functions.numeric import clamp, group_adjustment, half_even, posterior
from evigraph.functions.text import normalize_words
from evigraph.operators.evidence import derived_kind
from evigraph.operators.graph import first_per_key, top_per_group
from evigraph.operators.prefix import prefix_sums
from evigraph.session import attach_row, cut_lineage


def seed_zones(nodes: DataFrame) -> DataFrame:
    """Zone by (name, kind) over labels and aliases; the last node in id order decides."""
    kind = derived_kind(F.col("node_type"), F.col("roles"), F.col("metadata"))
    names = F.explode(F.concat(F.array("label"), F.col("aliases")))
    rows = nodes.select("id", "zone", kind.alias("kind"), names.alias("_name")).where(F.col("_name") != "")
    keyed = rows.withColumn("name", normalize_words("_name"))
    return first_per_key(keyed, ["name", "kind"], [F.desc("id")]).select("name", "kind", "zone")


def prepare_decisions(rows: DataFrame, zones: DataFrame) -> DataFrame:
    """Every review row with a skip reason (null when usable), outcome, weight and zone.

    Rows have id, seed_name, requested_kind, status, review_reason_code, reason, payload_kind, identity_conflict
    and updated_at.
    """
    reason = F.trim(F.coalesce("review_reason_code", F.lit("")))
    legacy = normalize_words("reason")
    duplicate = (reason == "duplicate") | legacy.rlike("|".join(vocab.DUPLICATE_PHRASES))
    final = F.col("status").isin(*vocab.FINAL_STATUSES) & (F.coalesce("requested_kind", F.lit("")) != "") & (F.coalesce("seed_name", F.lit("")) != "")
    positive = F.col("status").isin(*vocab.POSITIVE_STATUSES)
    skip = (
        F.when(~F.coalesce(final, F.lit(False)), "not_a_decision")
        .when(F.col("payload_kind") == "typed_connection", "connection_review")
        .when(positive & F.col("identity_conflict"), "source_identity_conflict")
        .when((F.col("status") == "rejected") & (reason.isin(*vocab.SOURCE_REASONS) | duplicate), "rejection_not_about_frontier")
    )
    prepared = rows.select(
        "id", "status", F.col("requested_kind").alias("kind"), normalize_words("seed_name").alias("name"), skip.alias("skip"),
        positive.alias("positive"), F.when(positive | (reason != ""), 1.0).otherwise(0.2).alias("weight"),
        F.when(reason == "", "unspecified").otherwise(reason).alias("reason_code"), F.col("updated_at").alias("reviewed_at"),
    ).withColumn("seed_key", F.concat_ws(":", "kind", "name"))
    return prepared.join(zones, ["name", "kind"], "left").withColumn("zone", F.coalesce("zone", F.lit("")))


def usable(decisions: DataFrame) -> DataFrame:
    """Decisions without a skip reason, each with its share of its seed's single vote."""
    kept = decisions.where(F.col("skip").isNull())
    totals = kept.groupBy("seed_key").agg(F.sum("weight").alias("_total"))
    return kept.join(totals, "seed_key").withColumn("learning_weight", F.col("weight") / F.col("_total")).drop("_total")


def skip_counts(decisions: DataFrame) -> DataFrame:
    return decisions.where(F.col("skip").isNotNull()).groupBy("skip").agg(F.count(F.lit(1)).alias("n"))


def group_counts(decisions: DataFrame) -> DataFrame:
    """Weights and counts overall, by kind and by zone, in long form (dimension, value)."""
    rows = decisions.select(
        "positive", "learning_weight",
        F.explode(F.array_compact(F.array(
            F.struct(F.lit("overall").alias("dimension"), F.lit("").alias("value")),
            F.struct(F.lit("kind").alias("dimension"), F.col("kind").alias("value")),
            F.when(F.col("zone") != "", F.struct(F.lit("zone").alias("dimension"), F.col("zone").alias("value"))),
        ))).alias("g"),
    )
    positive = F.col("positive")
    return rows.groupBy("g.dimension", "g.value").agg(
        F.count_if(positive).alias("approved"), F.count_if(~positive).alias("rejected"),
        half_even(F.sum(F.when(positive, F.col("learning_weight")).otherwise(0.0)), 3).alias("positive_weight"),
        half_even(F.sum(F.when(positive, 0.0).otherwise(F.col("learning_weight"))), 3).alias("negative_weight"),
    )


def group_examples(decisions: DataFrame, last: int = 4) -> DataFrame:
    """Ids of the latest decisions of each kind and zone."""
    rows = decisions.select(
        "id", "reviewed_at",
        F.explode(F.array_compact(F.array(
            F.struct(F.lit("kind").alias("dimension"), F.col("kind").alias("value")),
            F.when(F.col("zone") != "", F.struct(F.lit("zone").alias("dimension"), F.col("zone").alias("value"))),
        ))).alias("g"),
    ).select("id", "reviewed_at", "g.dimension", "g.value")
    return top_per_group(rows, ["dimension", "value"], [F.desc("reviewed_at"), F.desc("id")], last)


def adjustments(counts: DataFrame) -> DataFrame:
    """Rounded push of each kind and zone away from the overall posterior."""
    overall = counts.where(F.col("dimension") == "overall").agg(
        posterior(F.coalesce(F.sum("positive_weight"), F.lit(0.0)), F.coalesce(F.sum("negative_weight"), F.lit(0.0))).alias("_baseline")
    )
    joined = attach_row(counts.where(F.col("dimension") != "overall"), overall)
    return joined.select("dimension", "value", group_adjustment(F.col("positive_weight"), F.col("negative_weight"), F.col("_baseline")).alias("delta"))


def priority_adjustment(rows: DataFrame, deltas: DataFrame) -> DataFrame:
    """Rows (kind, zone) with the clamped sum of their two pushes."""
    kinds = deltas.where(F.col("dimension") == "kind").select(F.col("value").alias("kind"), F.col("delta").alias("_k"))
    zones = deltas.where(F.col("dimension") == "zone").select(F.col("value").alias("zone"), F.col("delta").alias("_z"))
    joined = rows.join(kinds, "kind", "left").join(zones, "zone", "left")
    total = F.coalesce("_k", F.lit(0.0)) + F.coalesce("_z", F.lit(0.0))
    return joined.withColumn("adjustment", half_even(clamp(total, -6.0, 6.0), 2)).drop("_k", "_z")


def split_holdout(decisions: DataFrame) -> DataFrame:
    """train or holdout for each decision; all decisions of a seed fall on one side.

    Seeds are taken from the latest reviewed backwards until a fifth of the decisions and four seeds are held out;
    the oldest seed always trains. The running count over seeds is built by slices.
    """
    # Read several times below, and the slices need one stable version of it.
    seeds = cut_lineage(decisions.groupBy("seed_key").agg(F.count(F.lit(1)).alias("_rows"), F.max("reviewed_at").alias("_last")))
    order = [("_last", False), ("seed_key", False)]
    ranked = prefix_sums(seeds, order, {"_before": F.col("_rows"), "_taken": F.lit(1).cast("bigint")}, exclusive=True)
    totals = seeds.agg(F.sum("_rows").alias("_all"), F.count(F.lit(1)).alias("_seeds"))
    sized = attach_row(ranked, totals)
    target = F.greatest(F.lit(4), half_even(F.col("_all") * 0.2))
    enough = (F.col("_all") >= 20) & (F.col("_seeds") >= 2) & (F.col("_taken") < F.col("_seeds") - 1)
    held = enough & ((F.col("_before") < target) | (F.col("_taken") < 4))
    sides = sized.select("seed_key", F.when(held, "holdout").otherwise("train").alias("side"))
    return decisions.join(sides, "seed_key")


def evaluate(train: DataFrame, holdout: DataFrame) -> DataFrame:
    """One row: weighted Brier score of the baseline and of the adjusted predictions on the holdout."""
    counts = group_counts(train)
    base = counts.where(F.col("dimension") == "overall").agg(
        posterior(F.coalesce(F.sum("positive_weight"), F.lit(0.0)), F.coalesce(F.sum("negative_weight"), F.lit(0.0))).alias("_baseline")
    )
    scored = attach_row(priority_adjustment(holdout, adjustments(counts)), base)
    target = F.col("positive").cast("double")
    predicted = clamp(F.col("_baseline") + F.col("adjustment") / 16, 0.05, 0.95)
    weight = F.col("learning_weight")

    def brier(prediction: Column) -> Column:
        return half_even(F.sum(weight * (prediction - target) * (prediction - target)) / F.sum(weight), 4)

    return scored.agg(
        F.count(F.lit(1)).alias("holdout"), F.count_if("positive").alias("holdout_approved"),
        F.count_if(~F.col("positive")).alias("holdout_rejected"),
        brier(F.col("_baseline")).alias("baseline_brier"), brier(predicted).alias("learned_brier"),
    )


def eligibility(split: DataFrame) -> DataFrame:
    """One row of counts and checks that decide whether learned ranking may be used; input from `split_holdout`."""
    train, holdout = F.col("side") == "train", F.col("side") == "holdout"
    positive = F.col("positive")
    explicit = ~positive & (F.col("reason_code") != "unspecified")

    def seeds(condition: Column) -> Column:
        return F.count_distinct(F.when(condition, F.col("seed_key")))

    sums = split.agg(
        F.count_if(train).alias("train"), seeds(train).alias("train_seeds"), seeds(holdout).alias("holdout_seeds"),
        F.count_if(explicit).alias("clear_rejections"), seeds(explicit).alias("rejection_seeds"),
        F.count_if(holdout).alias("holdout_rows"), F.count_if(holdout & positive).alias("_ha"), F.count_if(holdout & ~positive).alias("_hr"),
        seeds(holdout & positive).alias("_has"), seeds(holdout & ~positive).alias("_hrs"),
    )
    score = evaluate(split.where(train), split.where(holdout)).select("baseline_brier", "learned_brier")
    row = attach_row(sums, score)
    checks = {
        "enough_training": F.col("train") >= 40,
        "enough_seeds": (F.col("train_seeds") >= 8) & (F.col("holdout_seeds") >= 4),
        "enough_rejections": F.col("clear_rejections") >= 10,
        "enough_rejection_seeds": F.col("rejection_seeds") >= 4,
        "enough_holdout": F.col("holdout_rows") >= 8,
        "both_outcomes": (F.col("_ha") >= 3) & (F.col("_hr") >= 3) & (F.col("_has") >= 2) & (F.col("_hrs") >= 2),
        "beats_baseline": F.coalesce(F.col("learned_brier") + 0.01 < F.col("baseline_brier"), F.lit(False)),
    }
    for name, check in checks.items():
        row = row.withColumn(name, check)
    every = F.lit(True)
    for name in checks:
        every = every & F.col(name)
    return row.withColumn("eligible", every).drop("_ha", "_hr", "_has", "_hrs")


def rejection_reasons(rows: DataFrame) -> DataFrame:
    code = F.coalesce(F.nullif(F.trim("review_reason_code"), F.lit("")), F.lit("unspecified"))
    return rows.where(F.col("status") == "rejected").groupBy(code.alias("reason_code")).agg(F.count(F.lit(1)).alias("n"))


def frontier_score(kind: Column, degree: Column, starter: Column, wiki: Column, summary: Column, adjustment: Column) -> Column:
    priority = F.coalesce(F.element_at(F.create_map(*[F.lit(p) for kv in vocab.FRONTIER_PRIORITY.items() for p in kv]), kind), F.lit(1))
    return (
        priority + F.greatest(F.lit(0), 6 - F.least(degree, F.lit(6))) * 5 + F.when(starter, 5).otherwise(0)
        + F.when(wiki, 4).otherwise(0) + F.when(F.coalesce(summary, F.lit("")) == "", 2).otherwise(0) + adjustment
    )


def frontier(scored: DataFrame, limit: int) -> DataFrame:
    """Seeds of the best zone: zones by the sum of their top scores, then size, then name.

    The first zone that yields min(3, limit) seeds with at most two per kind wins; otherwise the best zone gives its
    top seeds. Rows have id, label, kind, zone, degree and score.
    """
    order = [F.desc("score"), F.asc("degree"), F.asc("label"), F.asc("id")]
    top = top_per_group(scored, ["zone"], order, limit)
    balanced = top_per_group(scored, ["zone", "kind"], order, 2, "_kind_rank")
    balanced = top_per_group(balanced, ["zone"], order, limit)
    sizes = scored.groupBy("zone").agg(F.count(F.lit(1)).alias("_size"))
    sums = top.groupBy("zone").agg(F.sum("score").alias("_sum")).join(sizes, "zone")
    yields = balanced.groupBy("zone").agg(F.count(F.lit(1)).alias("_balanced"))
    ranked = sums.join(yields, "zone").withColumn("_ok", (F.col("_balanced") >= min(3, limit)).cast("int"))
    best = ranked.orderBy(F.desc("_ok"), F.desc("_sum"), F.desc("_size"), F.asc("zone")).limit(1).select("zone", "_ok")
    picked = balanced.select("zone", "id", "label", "kind", "score", "rank").withColumn("_mode", F.lit(1)).unionByName(
        top.select("zone", "id", "label", "kind", "score", "rank").withColumn("_mode", F.lit(0))
    )
    return picked.join(F.broadcast(best), "zone").where(F.col("_mode") == F.col("_ok")).drop("_mode", "_ok")


def scope_of_kinds(kinds: Column) -> Column:
    return (
        F.when(F.arrays_overlap(kinds, F.array(F.lit("guitar"), F.lit("guitar_brand"))), "guitar_history")
        .when(F.array_distinct(kinds) == F.array(F.lit("genre")), "genre_cluster").otherwise("artist_network")
    )


def best_request(requests: DataFrame, seeds: DataFrame, seen_ids: DataFrame, seen_seeds: DataFrame, deltas: DataFrame) -> DataFrame:
    """The unseen request with the best priority plus mean adjustment of its unseen seeds; the earliest wins a tie.

    Requests have id, priority, position; seeds have request_id, name, kind, zone.
    """
    fresh = requests.join(seen_ids.select(F.col("id").alias("_seen")).distinct(), F.col("id") == F.col("_seen"), "left_anti")
    names = seen_seeds.select("name", "kind").distinct()
    open_seeds = seeds.join(names, ["name", "kind"], "left_anti")
    mean = priority_adjustment(open_seeds, deltas).groupBy("request_id").agg(F.avg("adjustment").alias("_mean"))
    options = fresh.join(mean, F.col("id") == F.col("request_id"))
    scored = options.withColumn("score", F.round(F.col("priority") + F.col("_mean"), 4))
    return scored.orderBy(F.desc("score"), F.asc("position")).limit(1).select("id", "score")


def request_id_of_scope(name: Column, at: Column) -> Column:
    """name-year-week of a request, by ISO year and week."""
    week = F.lpad(F.extract(F.lit("WEEK"), at).cast("string"), 2, "0")
    return F.concat_ws("-", name, F.extract(F.lit("YEAROFWEEK"), at).cast("string"), F.concat(F.lit("w"), week))


def interpretation_notes(notes: DataFrame, batch: DataFrame, nodes: DataFrame, approved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Notes on facts joined to their batch row and, by entity and fingerprint, to the approved facts; and the warnings.

    Notes are (batch_id, fact_index, related_nodes, interpretation). A note counts if its batch is a slug, its fact and source
    exist, its text is not empty, and the fact's entity is among the related nodes, which must all be known.
    """
    ids = nodes.select(F.col("id").alias("_node")).distinct()
    numbered = notes.withColumn("ref", F.concat_ws("#", "batch_id", F.col("fact_index").cast("string")))
    facts = batch.select(F.col("batch_id").alias("_batch"), F.col("index").alias("_index"), "entity_id", "category", "source_url", "fingerprint")
    joined = numbered.join(facts, (F.col("batch_id") == F.col("_batch")) & (F.col("fact_index") == F.col("_index")), "left")
    related = joined.select("ref", F.explode(F.array_distinct("related_nodes")).alias("_related")).distinct()
    lost = related.join(ids, F.col("_related") == F.col("_node"), "left_anti").select(F.col("ref").alias("_lost")).distinct()
    marked = joined.join(lost, F.col("ref") == F.col("_lost"), "left").join(ids, F.col("entity_id") == F.col("_node"), "left")
    form = F.col("batch_id").rlike("^[a-z0-9-]+$") & (F.col("fact_index") >= 1)
    whole = (
        F.col("_node").isNotNull() & (F.coalesce("source_url", F.lit("")) != "") & (F.trim(F.coalesce("interpretation", F.lit(""))) != "")
        & F.col("_lost").isNull() & F.coalesce(F.array_contains("related_nodes", F.col("entity_id")), F.lit(False))
    )
    rule = F.when(~F.coalesce(form, F.lit(False)), "note_reference").when(~F.coalesce(whole, F.lit(False)), "note_incomplete")
    judged = marked.withColumn("rule", rule)
    known = approved.select(F.col("entity_id").alias("_e"), F.col("source_fingerprint").alias("_f"), F.lit(True).alias("approved")).distinct()
    kept = judged.where("rule is null").join(known, (F.col("entity_id") == F.col("_e")) & (F.col("fingerprint") == F.col("_f")), "left")
    rows = kept.select(
        "ref", "entity_id", "category", "related_nodes", F.trim("interpretation").alias("interpretation"), "source_url", "fingerprint",
        F.coalesce("approved", F.lit(False)).alias("approved"),
    )
    return rows, judged.where("rule is not null").select("rule", F.col("ref").alias("key"))


def public_report(model: DataFrame) -> DataFrame:
    """The model's groups (dimension, group, stats) without the examples inside `stats`, which name private candidates."""
    return model.withColumn("stats", F.col("stats").dropFields("examples"))
