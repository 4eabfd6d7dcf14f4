"""Source references: arrays of struct(label, url, provider)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evigraph import vocab
from evigraph.functions.text import normalize_text


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:@]+)", 1))


def _path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)", 1)


def _https(url: Column) -> Column:
    return F.startswith(F.lower(url), F.lit("https://"))


def has_url(sources: Column) -> Column:
    return F.coalesce(F.exists(sources, lambda s: F.trim(F.coalesce(s["url"], F.lit(""))) != ""), F.lit(False))


def source_provider(source: Column) -> Column:
    """Stated provider, else by address, else `other`."""
    url = F.coalesce(source["url"], F.lit(""))
    return (
        F.when(F.coalesce(source["provider"], F.lit("")) != "", source["provider"])
        .when(F.contains(url, F.lit("wikipedia.org")), F.lit("wikipedia"))
        .when(F.contains(url, F.lit("wikidata.org")), F.lit("wikidata"))
        .when(F.contains(url, F.lit("musicbrainz.org")), F.lit("musicbrainz"))
        .otherwise(F.lit("other"))
    )


def first_per_url(sources: Column) -> Column:
    """Sources with an address, one per address, first wins."""
    kept = F.filter(sources, lambda s: F.trim(F.coalesce(s["url"], F.lit(""))) != "")
    urls = F.transform(kept, lambda s: F.trim(s["url"]))
    return F.filter(kept, lambda s, i: F.array_position(urls, F.trim(s["url"])) == i + 1)


def normalize_sources(sources: Column) -> Column:
    return F.transform(
        first_per_url(sources),
        lambda s: F.struct(
            F.coalesce(F.nullif(s["label"], F.lit("")), F.initcap(source_provider(s))).alias("label"),
            F.trim(s["url"]).alias("url"),
            source_provider(s).alias("provider"),
        ),
    )


def merge_sources(first: Column, second: Column) -> Column:
    return first_per_url(F.concat(first, second))


def urls(sources: Column) -> Column:
    return F.transform(sources, lambda s: s["url"])


def article_title(sources: Column, language: str | None = None) -> Column:
    """Title of the first encyclopedia article among the sources; malformed addresses are passed over."""
    host = rf"^{language}\.wikipedia\.org$" if language else r"^[a-z]{2,3}\.wikipedia\.org$"
    hits = F.filter(
        sources,
        lambda s: _https(s["url"]) & _host(s["url"]).rlike(host) & F.startswith(_path(s["url"]), F.lit("/wiki/")),
    )
    titles = F.transform(hits, lambda s: F.try_url_decode(F.replace(F.substring(_path(s["url"]), 7, 4096), F.lit("+"), F.lit("%2B"))))
    decoded = F.filter(titles, lambda t: t.isNotNull())
    return F.translate(F.try_element_at(decoded, F.lit(1)), "_", " ")


def article_language(url: Column) -> Column:
    return F.when(F.endswith(_host(url), F.lit(".wikipedia.org")), F.split(_host(url), r"\.")[0])


def _single(values: Column) -> Column:
    """The only distinct value, or null when there is none or more than one."""
    distinct = F.array_distinct(F.filter(values, lambda v: v != ""))
    return F.when(F.size(distinct) == 1, F.try_element_at(distinct, F.lit(1)))


def catalogue_item_id(sources: Column) -> Column:
    return _single(F.transform(sources, lambda s: F.regexp_extract(s["url"], vocab.ITEM_URL, 1)))


def first_catalogue_item_id(sources: Column) -> Column:
    found = F.filter(F.transform(sources, lambda s: F.regexp_extract(s["url"], vocab.ITEM_URL, 1)), lambda v: v != "")
    return F.try_element_at(found, F.lit(1))


def artist_catalogue_id(sources: Column) -> Column:
    return _single(F.transform(sources, lambda s: F.lower(F.regexp_extract(s["url"], vocab.ARTIST_URL, 1))))


def research_sources(sources: Column) -> Column:
    """Sorted distinct known providers reached over https."""
    hosts = F.create_map(*[F.lit(part) for pair in vocab.SOURCE_HOSTS.items() for part in pair])
    found = F.transform(
        F.filter(sources, lambda s: _https(s["url"])), lambda s: F.element_at(hosts, _host(s["url"]))
    )
    return F.array_sort(F.array_distinct(F.array_compact(found)))


def source_quality(sources: Column) -> Column:
    """0 to 1: a little for each source, more for known providers and hosts."""
    def bonus(s: Column) -> Column:
        # Providers and addresses are ASCII here, so folding needs no accent step.
        provider = F.trim(F.regexp_replace(F.lower(F.coalesce(s["provider"], F.lit(""))), r"[^\p{L}\p{N}]+", " "))
        url = F.lower(F.coalesce(s["url"], F.lit("")))
        known = F.when(provider.isin(*vocab.QUALITY_PROVIDERS), 0.22).otherwise(0.0)
        return known + F.when(url.rlike(vocab.QUALITY_HOSTS), 0.16).otherwise(0.0)

    count = F.coalesce(F.size(sources), F.lit(0))
    total = F.aggregate(sources, F.least(F.lit(0.45), count * 0.12), lambda acc, s: acc + bonus(s))
    return F.when(count <= 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), total))


def external_references(reference_urls: Column) -> Column:
    """First two distinct https addresses outside the catalogue and wiki hosts."""
    def external(url: Column) -> Column:
        host = _host(url)
        return (
            F.startswith(url, F.lit("https://")) & (host != "")
            & ~host.isin("wikidata.org", "www.wikidata.org")
            & ~F.endswith(host, F.lit(".wikipedia.org")) & ~F.endswith(host, F.lit(".wikimedia.org"))
        )

    return F.slice(F.array_distinct(F.filter(reference_urls, external)), 1, 2)


def has_wiki_source(sources: Column) -> Column:
    return F.coalesce(
        F.exists(
            sources,
            lambda s: normalize_text(s["provider"]).isin("wikipedia", "wikidata", "wikimedia")
            | F.contains(normalize_text(s["url"]), F.lit("wikipedia.org")),
        ),
        F.lit(False),
    )

