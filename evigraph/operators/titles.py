"""Title scope, page classification, candidate identity and package review; all row-local expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph import vocab
from evigraph.functions.text import canonical_title, contains_any, normalize_text
from evigraph.operators.evidence import has_blocked_term
from evigraph.operators.graph import first_per_key, top_per_group


def scope_reason(
    title: Column, kind: Column, source: Column, promotion: bool = False, whole_words: bool = False
) -> Column:
    """Why a title is out of scope, or null; the first matching rule decides.

    Terms are substrings unless `whole_words`. `promotion` looks at the title without its disambiguation and also
    rejects maintenance terms; otherwise a category prefix is removed.
    """
    raw = normalize_text(title)
    name = normalize_text(canonical_title(title)) if promotion else normalize_text(F.replace(title, F.lit("Category:"), F.lit("")))
    origin = normalize_text(source)
    release = vocab.RELEASE_TERMS + vocab.MAINTENANCE_TERMS if promotion else vocab.RELEASE_TERMS
    release_text = (
        "release, maintenance or generic encyclopedia topic" if promotion else "release page, not a map entity"
    )
    prefixes = "^(?:" + "|".join(vocab.GENERIC_PREFIXES) + ")"

    def has(terms: Sequence[str]) -> Column:
        return contains_any(name, terms, whole_words)

    category = origin == "category"
    return (
        F.when(name == "", "empty title")
        .when(raw.rlike(prefixes), "category, list, history or geography page")
        .when(name.isin(*vocab.OUT_OF_SCOPE_EXACT), "out-of-scope reference/platform topic")
        .when(has(vocab.OUT_OF_SCOPE_TERMS), "out-of-scope platform/media/list/reference topic")
        .when(F.startswith(name, F.lit("list of ")), "list page")
        .when(name.rlike(r"^[0-9]{4}"), "year/date page")
        .when(has(release), release_text)
        .when(name.isin(*vocab.GENERIC_TOPICS) | F.endswith(name, F.lit(" genres")), "generic topic, not a concrete map entity")
        .when((kind == "genre") & has(vocab.GROUPING_GENRE_TERMS), "category-style grouping, not a concrete music genre")
        .when(origin.isin(*vocab.WEAK_SOURCES) & (kind != "genre"), "weak category/template signal for non-genre candidate")
        .when(category & (kind != "genre"), "category candidates may only become genre nodes")
        .when(category & has(vocab.COLLECTION_TERMS), "category collection page")
        .when(category & contains_any(name, (" by ", " from ")), "category grouping page")
    )


def is_out_of_scope(title: Column) -> Column:
    name = normalize_text(F.replace(title, F.lit("Category:"), F.lit("")))
    exact = tuple(term for term in vocab.OUT_OF_SCOPE_EXACT if term != "brain")
    terms = tuple(term for term in vocab.OUT_OF_SCOPE_TERMS if term != "research brain")
    return name.isin(*exact) | contains_any(name, terms)


def classify_title(title: Column) -> Column:
    name = normalize_text(title)

    def says(*terms: str) -> Column:
        return contains_any(name, terms)

    return (
        F.when(says("guitarist"), "guitarist").when(says("band", "music group"), "band")
        .when(says("genre", "rock music"), "genre").when(says("guitar manufacturer", "guitar brands"), "guitar_brand")
        .when(says("stratocaster", "telecaster", "les paul", "guitar"), "guitar")
        .when(says("musician", "songwriter"), "artist").otherwise("unknown")
    )


def title_score(title: Column, source: Column, kind: Column) -> Column:
    name = normalize_text(title)

    def bonus(amount: float, *terms: str) -> Column:
        return F.when(contains_any(name, terms), amount).otherwise(0.0)

    score = (
        F.when(source == "category", 0.56).otherwise(0.42) + F.when(kind != "unknown", 0.22).otherwise(0.0)
        + bonus(0.18, "guitar") + bonus(0.12, "guitarist") + bonus(0.1, "band") + bonus(0.08, "genre")
        + bonus(0.06, "rock", "blues")
    )
    return F.least(F.lit(1.0), F.round(score, 6))


def is_admissible(title: Column, blocked_terms: Sequence[str] = ()) -> Column:
    """A title worth collecting: has a music term and is no list, year, release, maintenance or blocked page."""
    clean = F.trim(F.replace(title, F.lit("Category:"), F.lit("")))
    name = normalize_text(clean)
    bad = (
        contains_any(name, vocab.MAINTENANCE_TERMS + vocab.PAGE_RELEASE_TERMS) | has_blocked_term(clean, blocked_terms)
        | is_out_of_scope(clean) | F.startswith(name, F.lit("list of ")) | name.rlike(r"^[0-9]{4}")
    )
    return (clean != "") & ~bad & contains_any(name, vocab.MUSIC_TERMS)


def page_candidates(pages: DataFrame, page_key: str, link: str, blocked_terms: Sequence[str] = (), limit: int = 20) -> DataFrame:
    """Admissible links of each page, one per lower-case title, the first `limit` in page order."""
    kept = pages.where(is_admissible(F.col(link), blocked_terms)).withColumn("title", F.trim(F.replace(F.col(link), F.lit("Category:"), F.lit(""))))
    first = first_per_key(kept.withColumn("_key", F.lower("title")), [page_key, "_key"], [F.asc("pos")])
    ranked = top_per_group(first, [page_key], [F.asc("pos")], limit)
    return ranked.select(page_key, "title", classify_title(F.col("title")).alias("kind"), F.col("rank").cast("bigint").alias("rank"))


def best_titles(candidates: DataFrame, key: str, limit: int = 12) -> DataFrame:
    """Best score per folded title and then the top titles of each key."""
    best = first_per_key(candidates.withColumn("_t", normalize_text("title")), [key, "_t"], [F.desc("score"), F.asc("title")])
    return top_per_group(best, [key], [F.desc("score"), F.asc("title")], limit).drop("_t")


def _opening(extract: Column, characters: int | None) -> Column:
    whole = F.lower(F.coalesce(extract, F.lit("")))
    return whole if characters is None else F.substring(whole, 1, characters)


def page_matches_kind(extract: Column, categories: Column, kind: Column, characters: int | None = None, first: int | None = None) -> Column:
    """Terms of the kind in the extract or the categories; disambiguation pages never match.

    `characters` and `first` limit the extract and the categories that count; by default all do.
    """
    text = _opening(extract, characters)
    listed = F.coalesce(categories, F.array().cast("array<string>"))
    joined = F.lower(F.array_join(listed if first is None else F.slice(listed, 1, first), " "))
    hit = F.lit(False)
    for name, terms in vocab.PAGE_KIND_TERMS.items():
        hit = hit | ((kind == name) & (contains_any(text, terms) | contains_any(joined, terms)))
    return hit & ~F.contains(text, F.lit("may refer to")) & ~F.contains(joined, F.lit("disambiguation"))


def has_verified_identity(candidate: Column, characters: int | None = None, first: int | None = None) -> Column:
    """Identity through a documented relation, through a linked page, or through the subject of the page."""
    kind, title = candidate["kind"], normalize_text(candidate["title"])
    page, catalogue, relation = candidate["wikipedia"], candidate["musicbrainz"], candidate["documented_relation"]

    def filled(value: Column) -> Column:
        return F.coalesce(value, F.lit("")) != ""

    expected = F.when(kind == "band", "Group").when(kind.isin(*vocab.PERSON_KINDS), "Person")
    typed = F.coalesce(catalogue["type"] == expected, F.lit(False))
    by_relation = (
        typed & filled(catalogue["id"]) & (normalize_text(catalogue["name"]) == title)
        & F.coalesce(relation["type"] == "member_of", F.lit(False)) & filled(relation["seed_mb_id"])
        & F.coalesce(relation["source_url"] == F.concat(F.lit("https://musicbrainz.org/artist/"), relation["seed_mb_id"]), F.lit(False))
        & filled(relation["context"])
    )
    linked = F.coalesce(F.array_contains(page["musicbrainz_artist_ids"], catalogue["id"]), F.lit(False))
    text = _opening(page["extract"], characters)
    subject = F.lit(False)
    for name, terms in vocab.SUBJECT_TERMS.items():
        subject = subject | ((kind == name) & contains_any(text, terms))
    by_page = filled(page["wikidata_id"]) & (normalize_text(page["title"]) == title) & F.when(
        kind.isin(*vocab.MUSIC_ENTITY_KINDS), typed & linked & page_matches_kind(page["extract"], page["categories"], kind, characters, first)
    ).otherwise(subject)
    return F.coalesce(F.when(candidate["source"] == "musicbrainz_relation", by_relation).otherwise(by_page), F.lit(False))


def rejection_reason(candidate: Column, blocked_terms: Sequence[str] = ()) -> Column:
    title = F.trim(F.coalesce(candidate["title"], F.lit("")))
    kind = F.trim(F.coalesce(candidate["kind"], F.lit("unknown")))
    bad = (title == "") | ~kind.isin(*vocab.NODE_KINDS) | has_blocked_term(title, blocked_terms)
    return F.coalesce(
        F.when(bad, F.lit("blocked, empty or unsupported kind")),
        scope_reason(title, kind, F.coalesce(candidate["source"], F.lit("")), promotion=True),
        F.when(~has_verified_identity(candidate), F.lit("unverified candidate identity")),
    )


def _flag(condition: Column, severity: str, code: str) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code")))


def judged(candidate: Column) -> Column:
    """Title, kind, scope reason and verified identity of a candidate, so that each is worked out once."""
    title, kind = F.trim(F.coalesce(candidate["title"], F.lit(""))), F.trim(F.coalesce(candidate["kind"], F.lit("unknown")))
    return F.struct(
        title.alias("title"), kind.alias("kind"), scope_reason(title, kind, F.coalesce(candidate["source"], F.lit(""))).alias("reason"),
        has_verified_identity(candidate).alias("verified"),
    )


def candidate_issues(candidate: Column, seed: Column, blocked_terms: Sequence[str] = ()) -> Column:
    """Issues of one `judged` candidate as (severity, code, message)."""
    title, kind, reason = candidate["title"], candidate["kind"], candidate["reason"]

    def issue(condition: Column, severity: str, code: str, message: Column) -> Column:
        value = F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), message.alias("message"))
        return F.when(F.coalesce(condition, F.lit(False)), value)

    listed = F.array_compact(F.array(
        issue(~kind.isin(*vocab.NODE_KINDS), "reject", "unsupported_candidate_kind", F.concat(F.lit("Unsupported kind: "), kind, F.lit("."))),
        issue(has_blocked_term(title, blocked_terms), "reject", "blocked_entity", F.lit("Candidate matches the blocklist.")),
        issue(reason.isNotNull(), "reject", "out_of_scope_candidate", reason),
        issue(reason.isNull() & ~candidate["verified"], "reject", "unverified_candidate_identity", F.lit("Research lead, not a verified entity.")),
        issue(normalize_text(title) == normalize_text(seed), "warning", "same_as_seed", F.lit("Candidate repeats the seed entity.")),
    ))
    empty = F.array(F.struct(F.lit("reject").alias("severity"), F.lit("empty_candidate_title").alias("code"), F.lit("Candidate has no title.").alias("message")))
    return F.when(title == "", empty).otherwise(listed)


def quality_categories(title: Column, kind: Column, issues: Column) -> Column:
    """Sorted quality categories of a candidate from its issues."""
    codes = F.transform(issues, lambda i: i["code"])
    messages = F.array_join(F.transform(issues, lambda i: i["message"]), " ")
    scope = (
        F.when(contains_any(messages, ("platform", "media", "reference")), "platform_or_reference")
        .when(contains_any(messages, ("release",)), "release_as_context_only")
        .when(contains_any(messages, ("category", "grouping")), "category_grouping").otherwise("out_of_scope")
    )
    found = F.array_compact(F.array(
        F.when(F.array_contains(codes, "unsupported_candidate_kind"), F.lit("bad_node_type")),
        F.when(F.array_contains(codes, "blocked_entity"), F.lit("blocked_entity")),
        F.when(F.array_contains(codes, "out_of_scope_candidate"), scope),
        F.when((kind == "genre") & contains_any(normalize_text(title), vocab.GROUPING_GENRE_TERMS), F.lit("category_grouping")),
    ))
    return F.when(F.size(found) == 0, F.array(F.lit("candidate_ok"))).otherwise(F.array_sort(F.array_distinct(found)))


def package_flags(p: Column, blocked_terms: Sequence[str] = ()) -> Column:
    """Flags about the seed and its sources."""
    name = F.trim(F.coalesce(F.nullif(p["name"], F.lit("")), F.lit("")))
    kind = F.coalesce(p["requested_kind"], F.lit(""))
    page, item, catalogue = p["wikipedia"], p["wikidata"], p["musicbrainz"]
    supported = kind.isin(*vocab.NODE_KINDS)
    music = kind.isin(*vocab.MUSIC_ENTITY_KINDS)
    none = F.array().cast("array<string>")
    page_ids, item_ids = F.coalesce(page["musicbrainz_artist_ids"], none), F.coalesce(item["musicbrainz_artist_ids"], none)
    linked = F.when(F.size(page_ids) > 0, page_ids).otherwise(item_ids)
    lowered = F.transform(linked, lambda v: F.lower(v))
    return F.array_compact(F.array(
        _flag(name == "", "reject", "missing_seed_name"),
        _flag((name != "") & has_blocked_term(name, blocked_terms), "reject", "blocked_seed"),
        _flag(~supported, "reject", "unsupported_seed_kind"),
        _flag(supported & (name != "") & scope_reason(name, kind, F.lit("")).isNotNull(), "reject", "out_of_scope_seed"),
        _flag(page.isNull() & item.isNull() & catalogue.isNull(), "reject", "missing_seed_evidence"),
        _flag(page.isNotNull() & music & ~page_matches_kind(page["extract"], page["categories"], kind), "reject", "wikipedia_subject_mismatch"),
        _flag(page.isNotNull() & music & (page["wikidata_id"] != item["id"]), "reject", "source_identity_conflict"),
        _flag((F.size(linked) > 0) & ~F.array_contains(lowered, F.lower(catalogue["id"])), "reject", "source_identity_conflict"),
        _flag(page.isNull(), "warning", "missing_wikipedia"),
        _flag(F.size(p["source_errors"]) > 0, "warning", "source_errors"),
    ))


def review_packages(rows: DataFrame, blocked_terms: Sequence[str] = (), payload: str = "payload") -> DataFrame:
    """Level, score, flags and candidate counts of each package; no shuffle, each row is judged on its own."""
    p = F.col(payload)
    rows = rows.withColumn("_judged", F.coalesce(F.transform(p["music_candidates"], judged), F.array()))
    issues = F.transform("_judged", lambda j: F.transform(candidate_issues(j, p["name"], blocked_terms), lambda i: i["severity"]))
    flagged = rows.withColumn("_flags", package_flags(p, blocked_terms)).withColumn("_issues", issues)
    rejected = F.size(F.filter("_issues", lambda s: F.array_contains(s, "reject")))
    warned = F.size(F.filter("_issues", lambda s: F.array_contains(s, "warning") & ~F.array_contains(s, "reject")))
    counted = flagged.withColumn("total", F.size("_issues")).withColumn("rejected", rejected).withColumn("warnings", warned)
    counted = counted.withColumn("publishable", F.col("total") - F.col("rejected"))
    extra = F.array_compact(F.array(
        _flag(F.col("total") == 0, "warning", "no_music_candidates"),
        _flag((F.col("total") > 0) & (F.col("publishable") == 0), "warning", "no_publishable_candidates"),
        _flag((F.col("publishable") > 0) & (F.col("rejected") > F.col("publishable")) & (F.col("rejected") >= 5), "warning", "noisy_candidate_set"),
    ))
    flagged = counted.withColumn("flags", F.concat("_flags", extra))

    def severity(name: str) -> Column:
        return F.size(F.filter("flags", lambda f: f["severity"] == name))

    score = F.greatest(F.lit(0), 100 - severity("reject") * 35 - severity("warning") * 12 - F.col("rejected") * 2 - F.col("warnings"))
    scored = flagged.withColumn("score", score)
    level = F.when(severity("reject") > 0, "reject").when((severity("warning") > 0) | (F.col("score") < 85), "warning").otherwise("ok")
    return scored.withColumn("level", level).drop("_flags", "_issues", "_judged")


def preview_rejections(rows: DataFrame, blocked_terms: Sequence[str] = (), limit: int = 8) -> DataFrame:
    """First rejected candidates of each package with the reason and quality categories."""
    p = F.col("payload")
    found = F.transform(
        F.transform(p["music_candidates"], judged),
        lambda j: F.struct(j["title"].alias("title"), j["kind"].alias("kind"), candidate_issues(j, p["name"], blocked_terms).alias("issues")),
    )
    rejected = F.filter(found, lambda j: F.exists(j["issues"], lambda i: i["severity"] == "reject"))
    exploded = rows.select("id", F.posexplode(F.slice(rejected, 1, limit)).alias("pos", "j"))
    return exploded.select(
        "id", F.col("pos").cast("bigint").alias("pos"), F.col("j.title").alias("title"), F.col("j.issues")[0]["message"].alias("reason"),
        F.array_join(quality_categories(F.col("j.title"), F.col("j.kind"), F.col("j.issues")), ",").alias("categories"),
    )

