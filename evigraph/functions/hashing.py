"""Stable hashes and fingerprints built from expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the 32-bit FNV-1a hash.
FNV_OFFSET = 2166136261
FNV_PRIME = 16777619
UINT32 = 4294967296


def _codes(value: Column) -> Column:
    return F.transform(F.split(value, ""), lambda ch: F.ascii(ch).cast("bigint"))


def fnv1a(value: Column) -> Column:
    """FNV-1a over the characters of a text; products stay below 2^57."""
    return F.aggregate(
        _codes(value), F.lit(FNV_OFFSET).cast("bigint"),
        lambda h, code: F.pmod(h.bitwiseXOR(code) * FNV_PRIME, F.lit(UINT32)),
    )


def stable_fraction(value: Column) -> Column:
    return fnv1a(value) / F.lit(float(UINT32))


def seeded_unit(value: Column) -> Column:
    return F.pmod(fnv1a(value), F.lit(100000)) / F.lit(100000.0)


def stable_number(value: Column) -> Column:
    """Sum of character codes weighted by position + 17."""
    weighted = F.transform(F.split(value, ""), lambda ch, i: (i + 17) * F.ascii(ch).cast("bigint"))
    return F.aggregate(weighted, F.lit(0).cast("bigint"), lambda total, item: total + item)


def fingerprint(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\n", *parts), 256)


def row_hash(*columns: Column) -> Column:
    """Digest of a row, null-aware and independent of nothing but the values."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def edge_key(source: Column, target: Column, kind: Column, label: Column) -> Column:
    empty = F.lit("")
    return F.concat_ws("|", *[F.coalesce(part, empty) for part in (source, target, kind, label)])


def pair_key(first: Column, second: Column) -> Column:
    return F.concat_ws("|", F.least(first, second), F.greatest(first, second))
