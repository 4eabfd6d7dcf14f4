"""Text normalisation, term matching and templated text."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from evigraph import vocab


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def normalize_text(value: Column | str) -> Column:
    """Lower case, underscores to spaces, trimmed; null counts as empty."""
    return F.trim(F.translate(F.lower(F.coalesce(_c(value), F.lit(""))), "_", " "))


def normalize_words(value: Column | str) -> Column:
    """Lower case with every run of underscores and white space as one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_c(value), F.lit(""))), r"[_\s]+", " "))


def normalize_key(value: Column | str) -> Column:
    """Lower case, underscores and hyphens to spaces, trimmed: the form blocked terms are compared in."""
    return F.trim(F.translate(F.lower(F.coalesce(_c(value), F.lit(""))), "_-", "  "))


@F.arrow_udf(StringType())
def _strip_marks(values: pa.Array) -> pa.Array:
    # Spark has no NFKD built-in. The batch stays in Arrow buffers, without a Python string a row.
    return pc.replace_substring_regex(pc.utf8_normalize(values, form="NFKD"), "[\u0300-\u036f]+", "")


def fold_text(value: Column | str) -> Column:
    """Lower case without accents; anything but letters and digits becomes one space."""
    folded = _strip_marks(F.lower(F.coalesce(_c(value), F.lit(""))))
    return F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}]+", " "))


def label_order(value: Column | str) -> Column:
    """Sort key of a label in locale order: letters before case, accents and case as later levels (ICU root collation)."""
    return F.collate(_c(value), "UNICODE")


def base_order(value: Column | str) -> Column:
    """As `label_order`, where labels that differ in case and accents only are equal."""
    return F.collate(_c(value), "UNICODE_CI_AI")


def slugify(value: Column | str, default: str = "research-candidate") -> Column:
    """ASCII slug with Nordic letters spelled out, or `default` when nothing is left."""
    text = _c(value)
    for letter, spelled in vocab.TRANSLITERATION:
        text = F.replace(text, F.lit(letter), F.lit(spelled))
    ascii_only = F.regexp_replace(_strip_marks(text), r"[^\x00-\x7F]", "")
    slug = F.regexp_replace(F.regexp_replace(F.lower(ascii_only), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.when(slug == "", F.lit(default)).otherwise(slug)


def canonical_title(value: Column | str) -> Column:
    """Title without a trailing music disambiguation in parentheses; never empty unless the title is."""
    text = F.trim(_c(value))
    cut = F.trim(F.regexp_replace(text, vocab.DISAMBIGUATION, ""))
    return F.when(cut == "", text).otherwise(cut)


def title_keys(value: Column | str) -> Column:
    return F.array_distinct(F.array(normalize_text(value), normalize_text(canonical_title(value))))


def loose_title_key(value: Column | str) -> Column:
    return F.regexp_replace(normalize_text(canonical_title(value)), r"^(the|a|an)\s+", "")


def same_loose_title(first: Column | str, second: Column | str) -> Column:
    left, right = loose_title_key(first), loose_title_key(second)
    return (left != "") & (left == right)


def compact_summary(value: Column | str, fallback: Column | str, limit: int = 420) -> Column:
    """First two sentences, cut at a word and marked with dots when longer than `limit`."""
    text = F.trim(F.regexp_replace(F.coalesce(_c(value), F.lit("")), r"\s+", " "))
    two = F.trim(F.array_join(F.slice(F.split(text, r"(?<=[.!?])\s+"), 1, 2), " "))
    head = F.substring(two, 1, limit)
    cut = F.concat(F.trim(F.regexp_replace(head, r" [^ ]*$", "")), F.lit("..."))
    default = F.lit(fallback) if isinstance(fallback, str) else fallback
    return F.when(text == "", default).when(F.length(two) > limit, cut).otherwise(two)


def alternation(terms: Sequence[str], whole_words: bool = False) -> str:
    """One pattern for a bounded vocabulary, so a text is scanned once however many terms there are."""
    body = "|".join(re.escape(term) for term in terms)
    return rf"(?<![\p{{L}}\p{{N}}])(?:{body})(?![\p{{L}}\p{{N}}])" if whole_words else f"(?:{body})"


def contains_any(value: Column, terms: Sequence[str], whole_words: bool = False) -> Column:
    return value.rlike(alternation(terms, whole_words)) if terms else F.lit(False)


def is_one_of(value: Column, terms: Sequence[str]) -> Column:
    return value.isin(*terms)


def matches_term(text: Column, term: str) -> Column:
    """A phrase matches as a substring of folded text, a single word only as a whole token."""
    if " " in term:
        return F.contains(text, F.lit(term))
    return F.array_contains(F.split(text, " "), term)


def tokens(value: Column | str) -> Column:
    """Distinct lower-case ASCII word tokens."""
    return F.array_distinct(F.regexp_extract_all(F.lower(_c(value)), F.lit(r"([a-z0-9]+)"), 1))


def has_superlative(value: Column | str) -> Column:
    return F.coalesce(_c(value), F.lit("")).rlike(vocab.SUPERLATIVE)


def years_in_text(value: Column | str, pattern: str = vocab.RECENT_YEAR, low: int = 1920, high: int = 2026) -> Column:
    found = F.regexp_extract_all(F.coalesce(_c(value), F.lit("")), F.lit(pattern), 1)
    return F.filter(F.transform(found, lambda y: y.cast("int")), lambda y: (y >= low) & (y <= high))


def first_year_in_text(value: Column | str) -> Column:
    match = F.regexp_extract(F.coalesce(_c(value), F.lit("")), vocab.ANY_YEAR, 1)
    return F.when(match != "", match.cast("int"))


def period_text(begin: Column | str, end: Column | str) -> Column:
    b, e = F.nullif(_c(begin), F.lit("")), F.nullif(_c(end), F.lit(""))
    return (
        F.when(b.isNull() & e.isNull(), F.lit("dates not specified"))
        .when(b.isNull(), F.concat(F.lit("start not recorded to "), e))
        .when(e.isNull(), F.concat(b, F.lit(" onward (end not recorded)")))
        .otherwise(F.concat(b, F.lit(" to "), e))
    )


def article_for(label: Column | str) -> Column:
    return F.when(_c(label).rlike(r"(?i)^[aeiou]"), F.lit("An")).otherwise(F.lit("A"))


def public_summary(value: Column | str, project: str = "project") -> Column:
    """Rewrites the two internal phrases a summary may carry into reader-facing text."""
    text = F.coalesce(_c(value), F.lit(""))
    surfaced = (
        r"(?i)\bA ([a-z_ -]+?) surfaced by the " + project
        + r" research brain from Wikipedia signals around ([^.]+)\."
    )
    tail = "$1 connected to documented Wikipedia signals around $2."
    vowel = surfaced.replace("([a-z_ -]+?)", "([aeiou][a-z_ -]*?)")
    text = F.regexp_replace(text, vowel, "An " + tail)
    text = F.regexp_replace(text, surfaced, "A " + tail)
    added = r"(?i)\bA ([a-z_ -]+?) added from approved " + project + r" research\."
    return F.regexp_replace(text, added, "A $1 added from approved research.")


def search_text(label: Column | str, aliases: Column | str, roles: Column | str) -> Column:
    return F.lower(
        F.concat_ws(" ", _c(label), F.array_join(_c(aliases), " "), F.array_join(_c(roles), " "))
    )


def authority_name_matches(preferred: Column | str, expected: Column | str) -> Column:
    """Equal word sequences, or `Family, Given` equal to `Given Family`."""
    def words(value: Column) -> Column:
        return F.array_join(F.regexp_extract_all(F.lower(value), F.lit(r"([\p{L}\p{N}_]+)"), 1), " ")

    left, right = _c(preferred), words(_c(expected))
    comma = F.instr(left, ",")
    family = F.substring_index(left, ",", 1)
    given = F.substr(left, comma + F.lit(1))
    swapped = words(F.concat(given, F.lit(" "), family))
    return (words(left) == right) | ((comma > 0) & (swapped == right))


def merge_unique(*arrays: Column) -> Column:
    """Concatenation in order, trimmed, without empties or repeats."""
    merged = F.concat(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays])
    trimmed = F.transform(merged, lambda v: F.trim(v))
    return F.array_distinct(F.filter(trimmed, lambda v: v != ""))


def merge_unique_normalized(*arrays: Column) -> Column:
    """As `merge_unique`, but values that agree after `normalize_words` count as repeats; the first spelling stays."""
    merged = merge_unique(*arrays)
    keys = F.transform(merged, lambda v: normalize_words(v))
    return F.filter(merged, lambda v, i: F.array_position(keys, normalize_words(v)) == i + 1)


def public_tags(tags: Column, hidden: Sequence[str], blocked: Sequence[str] = ()) -> Column:
    cleaned = merge_unique(tags)
    kept = F.filter(cleaned, lambda t: ~F.lower(t).isin(*hidden)) if hidden else cleaned
    if not blocked:
        return kept
    terms = [term.lower().replace("_", " ").replace("-", " ").strip() for term in blocked]
    return F.filter(kept, lambda t: ~normalize_key(t).isin(*terms))
