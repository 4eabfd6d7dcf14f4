"""Text, hash, reference and number functions against plain Python."""

import hashlib
import unicodedata

from pyspark.sql import functions as F

from evigraph.functions import hashing, numeric, refs, text


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


def one(df, expr):
    return [row[0] for row in df.select(expr).collect()]


def fnv(value):
    h = 2166136261
    for ch in value:
        h = ((h ^ ord(ch)) * 16777619) % 2**32
    return h


def test_fold_matches_python(spark):
    words = ["Motörhead", "Sigur Rós — Ágætis", "AC/DC", "Ｆｕｌｌ ｗｉｄｔｈ", "", None, "ﬁne"]

    def fold(v):
        lowered = unicodedata.normalize("NFKD", (v or "").lower())
        kept = "".join(c for c in lowered if not 0x300 <= ord(c) <= 0x36F)
        return " ".join("".join(c if c.isalnum() else " " for c in kept).split())

    assert one(column(spark, words), text.fold_text("v")) == [fold(w) for w in words]


def test_slug_spells_nordic_letters(spark):
    words = ["Øyvind Ålesund", "Æther & Co.", "--", "Mötley Crüe"]
    assert one(column(spark, words), text.slugify("v")) == ["oyvind-alesund", "aether-co", "research-candidate", "motley-crue"]


def test_canonical_title_keeps_plain_parentheses(spark):
    words = ["Heart (band)", "Prince (American musician)", "1984 (novel)", "(band)"]
    assert one(column(spark, words), text.canonical_title("v")) == ["Heart", "Prince", "1984 (novel)", "(band)"]


def test_summary_takes_two_sentences_and_cuts_at_a_word(spark):
    long = "word " * 120
    got = one(column(spark, ["One. Two. Three.", "", long]), text.compact_summary("v", "none"))
    assert got[0] == "One. Two." and got[1] == "none"
    assert got[2] == long.strip()[:420].rsplit(" ", 1)[0].strip() + "..."


def test_public_summary_chooses_the_article(spark):
    value = "A artist surfaced by the project research brain from Wikipedia signals around Yes. A guitar added from approved project research."
    assert one(column(spark, [value]), text.public_summary("v")) == [
        "An artist connected to documented Wikipedia signals around Yes. A guitar added from approved research."
    ]


def test_hashes_match_python(spark):
    words = ["metallica", "a", "ozzy-osbourne", "blå"]
    assert one(column(spark, words), hashing.fnv1a(F.col("v"))) == [fnv(w) for w in words]
    assert one(column(spark, words), hashing.stable_number(F.col("v"))) == [
        sum((i + 17) * ord(c) for i, c in enumerate(w)) for w in words
    ]
    assert one(column(spark, words), hashing.fingerprint(F.lit("u"), F.col("v"))) == [
        hashlib.sha256(f"u\n{w}".encode()).hexdigest() for w in words
    ]


def test_blocked_terms_substring_and_whole_word(spark):
    from evigraph.operators.evidence import has_blocked_term

    df = column(spark, ["Deep Purple", "EP", "stEPs"])
    assert one(df, has_blocked_term(F.col("v"), ["ep"])) == [True, True, True]
    assert one(df, has_blocked_term(F.col("v"), ["ep"], whole_words=True)) == [False, True, False]


def test_identities_need_exactly_one_distinct_id(spark):
    mb = "https://musicbrainz.org/artist/"
    a, b = "0" * 8 + "-0000-4000-8000-" + "1" * 12, "0" * 8 + "-0000-4000-8000-" + "2" * 12
    rows = [([("x", mb + a, None), ("y", mb + a + "/relationships", None)],), ([("x", mb + a, None), ("y", mb + b, None)],), ([],)]
    df = spark.createDataFrame(rows, "s array<struct<label:string,url:string,provider:string>>")
    assert one(df, refs.artist_catalogue_id(F.col("s"))) == [a, None, None]


def test_malformed_article_addresses_are_skipped(spark):
    rows = [([("x", "https://en.wikipedia.org/wiki/%E0%A4%A", None), ("y", "https://no.wikipedia.org/wiki/A_ha", None)],)]
    df = spark.createDataFrame(rows, "s array<struct<label:string,url:string,provider:string>>")
    assert one(df, refs.article_title(F.col("s"))) == ["A ha"]


def test_source_quality(spark):
    rows = [([],), ([("w", "https://en.wikipedia.org/wiki/X", "wikipedia")],), ([("w", "https://a.org", "other")] * 9,)]
    df = spark.createDataFrame(rows, "s array<struct<label:string,url:string,provider:string>>")
    assert [round(v, 3) for v in one(df, refs.source_quality(F.col("s")))] == [0.0, 0.5, 0.45]


def test_posterior_and_adjustment(spark):
    df = spark.createDataFrame([(8.0, 0.0), (1.0, 1.0)], "p double, n double")
    got = one(df, numeric.group_adjustment(F.col("p"), F.col("n"), F.lit(0.5)))
    assert got[0] == min(4.0, (10 / 12 - 0.5) * 16 * 8 / 16) and got[1] == 0.0
