"""Expressions on record ids: source proxies, pseudo-times and portable hashes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Ids per source bucket (2**20) and the multiplier of the time hash (modulo 2**32).
BUCKET_BITS = 20
TIME_MULTIPLIER = 2654435761
TIME_RANGE = 2**32


def source_bucket(offer_id: Column) -> Column:
    """Source proxy of a record: the bucket its id falls in, as ``src_<n>``."""
    return F.concat(F.lit("src_"), F.shiftright(offer_id, BUCKET_BITS).cast("string"))


def hash_time(offer_id: Column) -> Column:
    """Pseudo-time in [0, 1): multiplicative hash of the id.

    The low 32 bits are multiplied in 16-bit halves, so nothing overflows.
    """
    mask = TIME_RANGE - 1
    low = offer_id.bitwiseAND(F.lit(0xFFFF))
    high = F.shiftright(offer_id, 16).bitwiseAND(F.lit(0xFFFF))
    upper = F.shiftleft((high * TIME_MULTIPLIER).bitwiseAND(F.lit(0xFFFF)), 16)
    return (low * TIME_MULTIPLIER + upper).bitwiseAND(F.lit(mask)) / float(TIME_RANGE)


def portable_hash(*parts: Column | str | int) -> Column:
    """32-bit hash that other engines can compute too: head of the MD5 of the joined parts."""
    columns = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    text = F.concat_ws("|", *[c.cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def sampled(fraction: float, *parts: Column | str | int) -> Column:
    """Deterministic sampling condition: true for about ``fraction`` of the keys."""
    return portable_hash(*parts) < int(round(fraction * 2**32))
