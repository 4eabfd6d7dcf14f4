"""Snapshot comparison, fingerprints and guarded table updates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph import vocab
from evigraph.functions.hashing import row_hash
from evigraph.operators.evidence import induced_edges
from evigraph.operators.graph import first_per_key, top_per_group
from evigraph.session import attach_row, cut_lineage


def snapshot_diff(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """added, removed, changed or same for every key."""
    def hashed(df: DataFrame, name: str) -> DataFrame:
        columns = [F.col(c) for c in sorted(df.columns) if c != key]
        return df.select(F.col(key).alias(f"_{name}_key"), row_hash(*columns).alias(f"_{name}_hash"))

    joined = hashed(before, "old").join(hashed(after, "new"), F.col("_old_key") == F.col("_new_key"), "full")
    state = (
        F.when(F.col("_old_key").isNull(), "added").when(F.col("_new_key").isNull(), "removed")
        .when(F.col("_old_hash") != F.col("_new_hash"), "changed").otherwise("same")
    )
    return joined.select(F.coalesce("_old_key", "_new_key").alias(key), state.alias("state"))


def _compared(before: DataFrame, after: DataFrame, sums: dict[str, Column] | None = None, marked: DataFrame | None = None) -> DataFrame:
    """One row for each id of either frame: `_key`, `_old` and `_new` (its rows before and after), `_same`, `_mark` and `sums` over its rows after.

    Both frames travel once, as ids with a hash of 64 bits. An id is the same if its rows are, repeated ones included: halves of the hash are
    added for rows after and taken off for rows before. `marked` (id) sets `_mark`.
    """
    names, sums = sorted(before.columns), sums or {}
    nothing = F.lit(0).cast("bigint")

    def side(df: DataFrame, old: int, new: int, mark: int = 0) -> DataFrame:
        halves = [nothing] * 2
        if not mark:
            h = F.xxhash64(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}))
            halves = [(new - old) * half for half in (F.shiftright(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF)))]
        counts = [F.lit(n).cast("bigint").alias(name) for name, n in (("_old", old), ("_new", new), ("_mark", mark))]
        more = [(value.cast("bigint") if new else nothing).alias(name) for name, value in sums.items()]
        return df.select(F.col("id").alias("_key"), *counts, *[h.alias(f"_h{k}") for k, h in enumerate(halves)], *more)

    rows = side(before, 1, 0).unionByName(side(after, 0, 1))
    if marked is not None:
        rows = rows.unionByName(side(marked, 0, 0, 1))
    totals = ["_old", "_new", "_mark", "_h0", "_h1", *sums]
    grouped = rows.groupBy("_key").agg(*[F.sum(name).alias(name) for name in totals])
    same = (F.col("_old") == F.col("_new")) & (F.col("_h0") == 0) & (F.col("_h1") == 0)
    return grouped.select("_key", "_old", "_new", "_mark", same.alias("_same"), *sums)


def _beside(
    copy: DataFrame, own: DataFrame, sums: dict[str, Column] | None = None, marks: dict[str, DataFrame] | None = None, drop: tuple[str, ...] = (),
) -> DataFrame:
    """One row for each id: `_key`, `_copy` and `_own` (its rows on either side), `_same`, `sums` (conditions that hold, over its own rows) and `marks` (rows of frames with an id).

    `_same`: it is on both sides and all its rows are equal but for `drop`, by two hashes of 64 bits. Rows travel as numbers and are summed up
    by hash, so that no task sorts them or holds their digests as text.
    """
    names, sums, marks = [c for c in sorted(own.columns) if c not in drop], sums or {}, marks or {}
    counts = ["_copy", "_own", *marks]

    def side(df: DataFrame, count: str) -> DataFrame:
        text = F.to_json(F.struct(*names), {"ignoreNullFields": "false"}) if count in ("_copy", "_own") else None
        hashes = [F.lit(None).cast("bigint")] * 2 if text is None else [F.xxhash64(text), F.xxhash64(F.lit(1), text)]
        ones = [F.lit(int(name == count)).cast("bigint").alias(name) for name in counts]
        more = [(test.cast("bigint") if count == "_own" else F.lit(0).cast("bigint")).alias(name) for name, test in sums.items()]
        return df.select(F.col("id").alias("_key"), *ones, *more, *[h.alias(f"_h{k}") for k, h in enumerate(hashes)])

    rows = side(copy, "_copy").unionByName(side(own, "_own"))
    for name, frame in marks.items():
        rows = rows.unionByName(side(frame, name))
    ends = [bound(f"_h{k}").alias(f"_{bound.__name__}{k}") for k in range(2) for bound in (F.min, F.max)]
    grouped = rows.groupBy("_key").agg(*[F.sum(name).alias(name) for name in (*counts, *sums)], *ends)
    same = (F.col("_copy") > 0) & (F.col("_own") > 0) & (F.col("_min0") == F.col("_max0")) & (F.col("_min1") == F.col("_max1"))
    return grouped.select("_key", *counts, *sums, same.alias("_same"))


def batch_gate(
    before: DataFrame, after: DataFrame, ledger: DataFrame, max_new: int = 12
) -> DataFrame:
    """Violations of a reviewed relation batch: no old row changes, 1 to `max_new` additions, each in the ledger.

    `after` needs id, type, tier and provider columns beside the compared ones; `ledger` has edge_id. A key is named once for each rule.
    """
    unfit = (F.col("type") != "member_of") | (F.col("tier") != "source_linked")
    diff = _compared(before, after, {"_unfit": F.coalesce(unfit, F.lit(False)).cast("int")}, ledger.select(F.col("edge_id").alias("id")))
    # What differs is stored, so that the three rules below read one comparison and do not make one each.
    differs = ((F.col("_old") > 0) & ~F.col("_same")) | ((F.col("_old") == 0) & (F.col("_new") > 0))
    diff = cut_lineage(diff.where(differs).select("_key", "_old", "_new", "_mark", "_unfit"))
    broken = diff.where(F.col("_old") > 0).select(
        F.when(F.col("_new") > 0, "existing_changed").otherwise("existing_removed").alias("rule"), F.col("_key").alias("key"), F.lit("").alias("detail")
    )
    added = diff.where(F.col("_old") == 0)
    bad = added.where((F.col("_unfit") > 0) | (F.col("_mark") == 0) | F.col("_key").isNull())
    kinds = after.groupBy(F.col("id").alias("_id")).agg(F.max("type").alias("_type"))  # unread where no one asks for the detail
    unreviewed = bad.join(kinds, F.col("_key") == F.col("_id"), "left").select(
        F.lit("unreviewed_addition").alias("rule"), F.col("_key").alias("key"), F.col("_type").alias("detail")
    )
    count = added.agg(F.coalesce(F.sum("_new"), F.lit(0)).alias("_n")).where(~F.col("_n").between(1, max_new)).select(
        F.lit("addition_count").alias("rule"), F.lit("batch").alias("key"), F.col("_n").cast("string").alias("detail")
    )
    return broken.unionByName(unreviewed).unionByName(count)


def graph_gate(
    before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame], published: tuple[DataFrame, DataFrame],
    promoted: tuple[DataFrame, DataFrame], ledger: DataFrame, backfills: DataFrame | None = None,
) -> DataFrame:
    """Violations of a reviewed batch as a whole; each pair is (nodes, edges) with the same columns everywhere.

    Ids are unique, a key is named once for a rule and side; an old node stays as it is unless `backfills` (id, allowed) permits its change; a new node is a band
    with a catalogue id and source, is the target of a new reviewed membership and equals its promoted copy but for its
    place; a new edge equals its promoted copy and has a catalogue source; the published copy equals the new graph.
    """
    def sourced(pattern: Column) -> Column:
        return F.coalesce(F.exists("sources", lambda v: F.coalesce((v["provider"] == "musicbrainz") & F.regexp_like(v["url"], pattern), F.lit(False))), F.lit(False))

    def named(rows: DataFrame, **rules: Column) -> DataFrame:
        hits = F.array_compact(F.array(*[F.when(test, F.lit(rule.partition("__")[0])) for rule, test in rules.items()]))
        return rows.select(F.explode(hits).alias("rule"), F.col("_key").alias("key"))

    copied, there, differs, known = F.col("_copy") > 0, F.col("_own") > 0, ~F.col("_same"), F.col("_known") > 0
    permitted = {} if backfills is None else {"_permitted": backfills.where("allowed").select("id")}
    allowed = F.col("_permitted") > 0 if permitted else F.lit(False)
    kept = _beside(before[0], after[0], marks=permitted)
    found = [named(kept, duplicate_node=F.col("_copy") > 1, duplicate_node__after=F.col("_own") > 1, existing_node=copied & differs & ~allowed)]

    reviewed = ledger.where(F.col("kind") == "typed_connection").select(F.col("edge_id").alias("_edge")).distinct()
    links = after[1].where(F.col("type") == "member_of").join(reviewed, F.col("id") == F.col("_edge"), "left_semi")
    linked = links.join(before[1].select("id"), "id", "left_anti").select(F.col("target").alias("id"))
    address = F.concat(F.lit("^https://musicbrainz[.]org/artist/"), F.substring("id", 9, 36), F.lit("$"))
    band = (F.col("node_type") == "band") & F.col("id").rlike("^mb-band-[0-9a-f-]{36}$") & sourced(address)
    unfit = {"_unfit": ~F.coalesce(band, F.lit(False))}
    nodes = _beside(promoted[0], after[0], unfit, {"_known": before[0].select("id"), "_linked": linked}, ("x", "y"))
    found.append(named(nodes, new_node=there & ~known & (differs | (F.col("_unfit") > 0) | (F.col("_linked") == 0))))

    loose = {"_loose": ~sourced(F.lit("^https://musicbrainz[.]org/artist/"))}
    edges = _beside(promoted[1], after[1], loose, {"_known": before[1].select("id")})
    found.append(named(edges, duplicate_edge=F.col("_known") > 1, duplicate_edge__after=F.col("_own") > 1, new_edge=there & ~known & (differs | (F.col("_loose") > 0))))
    for name, own, copy in zip(("node", "edge"), after, published, strict=True):
        found.append(named(_beside(copy, own), **{f"published_{name}": differs & (there | copied)}))
    result = found[0]
    for part in found[1:]:
        result = result.unionByName(part)
    return result


def ledger_gate(previous: dict[str, DataFrame], current: dict[str, DataFrame], added: tuple[DataFrame, DataFrame], max_new: int = 12) -> DataFrame:
    """Violations (rule, key) of a promotion ledger against the one before: `nodes`, `edges` and `rows`, each with an id.

    What was recorded stays as it was; the new nodes and edges of the ledger are exactly those that the graph gained (`added`: ids of nodes, of edges), and each new row
    is a reviewed connection for one of them, as many rows as edges and `max_new` at most. Each part travels once for the rules of its ids.
    """
    def says(rows: DataFrame, rule: str) -> DataFrame:
        return rows.select(F.lit(rule).alias("rule"), F.col("id").cast("string").alias("key"))

    found = []
    fresh = (F.col("_old") == 0) & (F.col("_new") > 0)
    for part, gained in (("nodes", added[0]), ("edges", added[1]), ("rows", None)):
        diff = _compared(previous[part], current[part].select(previous[part].columns), marked=gained)
        tests = [((F.col("_old") > 0) & ~F.col("_same"), "changed"), (F.col("_new") > 1, "repeated")]
        if gained is not None:
            tests.append((fresh != (F.col("_mark") > 0), "delta"))
        rules = F.array_compact(F.array(*[F.when(test, F.lit(f"promotion_{part}_{name}")) for test, name in tests]))
        found.append(diff.select(F.explode(rules).alias("rule"), F.col("_key").cast("string").alias("key")))
    slim = current["rows"].select("id", "edge_id", F.coalesce(F.col("kind") == "typed_connection", F.lit(False)).alias("_typed"))
    new = cut_lineage(slim.join(previous["rows"].select("id"), "id", "left_anti"))  # read for the rules and for the count
    edges = added[1].select(F.col("id").alias("_edge")).distinct()
    typed = new.join(edges, F.col("edge_id") == F.col("_edge"), "left")
    found.append(says(typed.where(~F.col("_typed") | F.col("_edge").isNull()), "promotion_rows_delta"))
    counts = attach_row(new.agg(F.count(F.lit(1)).alias("_rows")), added[1].agg(F.count(F.lit(1)).alias("_edges")))
    wrong = counts.where((F.col("_rows") != F.col("_edges")) | (F.col("_rows") > max_new)).select(F.concat_ws(" rows, ", F.col("_rows").cast("string"), F.concat(F.col("_edges").cast("string"), F.lit(" edges"))).alias("id"))
    found.append(says(wrong, "promotion_count"))
    result = found[0]
    for part in found[1:]:
        result = result.unionByName(part)
    return result


def documented_backfill(before: DataFrame, after: DataFrame) -> DataFrame:
    """Whether each changed node only gained a valid year with evidence among its kept sources.

    Both frames have id, era_start, evidence_urls, source_urls and any other columns, which must not differ.
    """
    special = {"id", "era_start", "evidence_urls", "source_urls"}
    rest = [name for name in before.columns if name not in special]
    old = before.select([F.col(name).alias(f"_b_{name}") for name in before.columns])
    joined = after.join(old, F.col("id") == F.col("_b_id"))
    same = F.lit(True)
    for name in rest:
        same = same & F.col(name).eqNullSafe(F.col(f"_b_{name}"))
    ok = (
        same & F.coalesce(F.col("era_start").between(1400, 2100), F.lit(False)) & (F.size("evidence_urls") > 0)
        & (F.size(F.array_except("_b_source_urls", "source_urls")) == 0)
        & (F.size(F.array_except("evidence_urls", "source_urls")) == 0)
    )
    return joined.select("id", F.coalesce(ok, F.lit(False)).alias("allowed"))


def ledger_delta(previous: DataFrame, current: DataFrame, low: int = 1, high: int = 12) -> DataFrame:
    """Violations of an append-only ledger: changed rows, repeated ids, or an addition count out of range."""
    diff = snapshot_diff(previous, current)
    changed = diff.where(F.col("state").isin("changed", "removed")).select(
        F.lit("ledger_row_changed").alias("rule"), F.col("id").alias("key"), F.col("state").alias("detail")
    )
    repeated = current.groupBy("id").count().where("count > 1").select(
        F.lit("ledger_row_repeated").alias("rule"), F.col("id").alias("key"), F.col("count").cast("string").alias("detail")
    )
    size = diff.agg(F.count_if(F.col("state") == "added").alias("_n")).where(~F.col("_n").between(low, high)).select(
        F.lit("ledger_addition_count").alias("rule"), F.lit("ledger").alias("key"), F.col("_n").cast("string").alias("detail")
    )
    return changed.unionByName(repeated).unionByName(size)


def baseline_violations(baseline: DataFrame, live: DataFrame, key: list[str], compare: list[str]) -> DataFrame:
    """Baseline rows that are missing live or differ in a compared column."""
    other = live.select([F.col(name).alias(f"_l_{name}") for name in key + compare]).withColumn("_found", F.lit(True))
    condition = F.lit(True)
    for name in key:
        condition = condition & (F.col(name) == F.col(f"_l_{name}"))
    joined = baseline.join(other, condition, "left")
    differs = F.lit(False)
    for name in compare:
        differs = differs | ~F.col(name).eqNullSafe(F.col(f"_l_{name}"))
    rule = F.when(F.col("_found").isNull(), "missing").when(differs, "differs")
    return joined.select(rule.alias("rule"), F.concat_ws("|", *key).alias("key")).where(F.col("rule").isNotNull())


def set_difference(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of either frame the other lacks, with the side they are on; empty when the sets are equal."""
    left = first.exceptAll(second).withColumn("side", F.lit("first"))
    return left.unionByName(second.exceptAll(first).withColumn("side", F.lit("second")))


def table_fingerprint(rows: DataFrame, columns: Sequence[Column]) -> DataFrame:
    """Order-insensitive digest of a table: the row count and the sums of the eight words of the row digests.

    Sums are partial aggregates, so nothing but one row per task is shuffled however large or repetitive the table is.
    """
    hashed = rows.select(F.sha2(F.to_json(F.array(*columns)), 256).alias("h"))
    words = [F.sum(F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")) for i in range(8)]
    sums = hashed.agg(F.count(F.lit(1)).alias("n"), *[word.alias(f"w{i}") for i, word in enumerate(words)])
    parts = [F.coalesce(F.col(name).cast("string"), F.lit("0")) for name in ["n"] + [f"w{i}" for i in range(8)]]
    return sums.select(F.sha2(F.concat_ws(":", *parts), 256).alias("fingerprint"))


def graph_fingerprint(nodes: DataFrame, edges: DataFrame, mode: str) -> DataFrame:
    """Digest of ids, kinds, positions, zones, starters and years, and of relations between the mode's nodes."""
    kept = nodes.where(F.col("node_type").isin(*vocab.MODE_KINDS[mode]))
    inside = induced_edges(edges, kept)

    def text(names: list[str]) -> list[Column]:
        return [F.coalesce(F.col(name).cast("string"), F.lit("null")) for name in names]

    a = table_fingerprint(kept, text(["id", "node_type", "x", "y", "zone", "starter", "era_start"]))
    b = table_fingerprint(inside, text(["source", "target", "type", "label", "strength"]))
    both = a.withColumn("part", F.lit("nodes")).unionByName(b.withColumn("part", F.lit("edges")))
    return both.agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "part", "fingerprint"))), "|"), 256).alias("fingerprint")
    )


def upsert(existing: DataFrame, new: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Rows of `new` replace rows of `existing` with the same key; other rows stay.

    Of several new rows with one key the first in `order` counts; a digest of the row breaks remaining ties.
    """
    kept = existing.join(new.select(*key).distinct(), key, "left_anti")
    tie = row_hash(*[F.col(name) for name in sorted(new.columns)])
    return kept.select(existing.columns).unionByName(first_per_key(new, key, [*order, tie]).select(existing.columns))


def append_missing(existing: DataFrame, patch: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Existing rows and the first patch row of each key they lack."""
    missing = patch.join(existing.select(*key).distinct(), key, "left_anti")
    return existing.unionByName(first_per_key(missing, key, order).select(existing.columns))


def missing_or_conflict(rows: DataFrame, live: DataFrame, key: str, label: str) -> DataFrame:
    """missing, current or conflict for each row; a label owned by another id is a conflict too."""
    compared = [name for name in rows.columns if name != key]
    old = live.select(F.col(key).alias("_key"), row_hash(*[F.col(c) for c in compared]).alias("_hash"))
    owners = live.groupBy(F.lower(label).alias("_label")).agg(
        F.min(key).alias("_low"), F.max(key).alias("_high")
    )
    joined = rows.join(old, F.col(key) == F.col("_key"), "left").join(owners, F.lower(F.col(label)) == F.col("_label"), "left")
    foreign = (F.col("_low") != F.col(key)) | (F.col("_high") != F.col(key))
    state = (
        F.when(F.coalesce(foreign, F.lit(False)), "conflict").when(F.col("_key").isNull(), "missing")
        .when(F.col("_hash") == row_hash(*[F.col(c) for c in compared]), "current").otherwise("conflict")
    )
    return joined.select(key, state.alias("state"))


def guarded_append(live: DataFrame, rows: DataFrame, states: DataFrame, key: str) -> DataFrame:
    """Live rows plus the missing ones, or only the live rows when any state is a conflict."""
    conflicts = states.agg(F.count_if(F.col("state") == "conflict").alias("_conflicts"))
    wanted = rows.join(states.where(F.col("state") == "missing").select(key), key, "left_semi")
    open_gate = attach_row(wanted, conflicts.where("_conflicts = 0")).select(live.columns)
    return live.unionByName(open_gate)


def update_states(edges: DataFrame, live: DataFrame, key: list[str]) -> DataFrame:
    """current, update (nothing there yet) or conflict for the context and sources of each relation.

    Keys travel as 96 bits of hashes, contexts and sources as one hash of 64 bits; a key with a null meets nothing.
    """
    whole = reduce(lambda a, b: a & b, [F.col(name).isNotNull() for name in key], F.lit(True))
    digest = F.xxhash64(F.to_json(F.struct("context", "sources"), {"ignoreNullFields": "false"}))
    filled = (F.coalesce(F.size("context"), F.lit(0)) > 0) | (F.coalesce(F.size("sources"), F.lit(0)) > 0)
    text = F.to_json(F.array(*[F.col(name).cast("string") for name in key]))
    hashes = [F.when(whole, F.xxhash64(text)).alias("_k0"), F.hash(text).alias("_k1")]
    other = live.where(whole).select(*hashes, digest.alias("_digest"), filled.alias("_filled"))
    # Where the count is one, the least is the one.
    counted = other.groupBy("_k0", "_k1").agg(F.count(F.lit(1)).alias("_n"), F.min("_digest").alias("_there"), F.max("_filled").alias("_filled"))
    joined = edges.select("id", *hashes, digest.alias("_own")).join(counted, ["_k0", "_k1"], "left")
    state = (
        F.when(F.coalesce(F.col("_n"), F.lit(0)) != 1, "conflict").when(F.col("_own") == F.col("_there"), "current")
        .when(F.col("_filled"), "conflict").otherwise("update")
    )
    return joined.select("id", state.alias("state"))


def set_status(rows: DataFrame, ids: DataFrame, status: str, reason: str | None = None) -> DataFrame:
    """New status (and reason) for the rows whose id is listed."""
    marked = rows.join(ids.select(F.col("id").alias("_id")).distinct(), F.col("id") == F.col("_id"), "left")
    hit = F.col("_id").isNotNull()
    out = marked.withColumn("status", F.when(hit, F.lit(status)).otherwise(F.col("status")))
    if reason is not None:
        out = out.withColumn("reason", F.when(hit, F.lit(reason)).otherwise(F.col("reason")))
    return out.drop("_id")


def append_trials(history: DataFrame, batch: DataFrame, fresh_ids: DataFrame, keep: int | None = None) -> DataFrame:
    """Append a trial batch under a digest of its new ids, unless that batch is known; with `keep` only the newest so many stay.

    Ids that mark simulated nodes stop the append.
    """
    simulated = fresh_ids.agg(F.count_if(F.startswith("id", F.lit("__simulation_"))).alias("_simulated")).where("_simulated = 0")
    digest = attach_row(table_fingerprint(fresh_ids, [F.col("id")]), simulated).select(F.substring("fingerprint", 1, 20).alias("_batch"))
    last = history.agg(F.coalesce(F.max("batch_no"), F.lit(0)).alias("_last"))
    stamped = attach_row(attach_row(batch, digest), last)
    stamped = stamped.withColumn("batch", F.col("_batch")).withColumn("batch_no", F.col("_last") + 1)
    new = stamped.join(history.select(F.col("batch").alias("_known")).distinct(), F.col("batch") == F.col("_known"), "left_anti")
    union = history.unionByName(new.select(history.columns))
    if keep is None:
        return union
    newest = union.agg(F.max("batch_no").alias("_newest"))
    return attach_row(union, newest).where(F.col("batch_no") > F.col("_newest") - keep).drop("_newest")


def latest_per_key(rows: DataFrame, key: list[str], time: str, tie: str) -> DataFrame:
    return first_per_key(rows, key, [F.desc(time), F.desc(tie)])


def capped_per_key(rows: DataFrame, key: list[str], order: list[Column], cap: int) -> DataFrame:
    return top_per_group(rows, key, order, cap).drop("rank")
