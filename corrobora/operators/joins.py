"""Skew-safe equi-joins of a large table with a table that is unique on the key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from corrobora.session import pin

BROADCAST_BYTES = 32 << 20
HOT_SHARE = 1000
#: Salts of a hot key for each mean partition's worth of rows it holds.
SALTS_PER_PART = 4


def table_bytes(df: DataFrame) -> int:
    """Exact payload size of ``df`` in bytes (16 per cell plus string lengths)."""
    strings = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema if isinstance(f.dataType, T.StringType)]
    width = F.lit(16 * len(df.columns)).cast("long")
    for length in strings:
        width = width + length
    return df.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0]


def hot_keys(
    df: DataFrame, keys: Sequence[str], share: int = HOT_SHARE, counts: DataFrame | None = None
) -> DataFrame:
    """Keys that each hold more than 1/``share`` of the rows: fewer than ``share`` of them.

    ``counts`` (the keys and their rows ``_n``) spares a pass over ``df``.
    """
    counts = pin(df.groupBy(*keys).agg(F.count("*").alias("_n")) if counts is None else counts, "keycount")
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    return counts.filter(F.col("_n") * share > total).select(*keys)


def hot_salts(
    df: DataFrame, keys: Sequence[str], share: int = HOT_SHARE, counts: DataFrame | None = None
) -> DataFrame:
    """The hot keys with ``_salts``: as many as the key's share of the rows asks for, given the shuffle's partitions.

    Shares add up to one, so all keys together have at most :data:`SALTS_PER_PART` salts per partition, and one more each.
    """
    counts = pin(df.groupBy(*keys).agg(F.count("*").alias("_n")) if counts is None else counts, "keycount")
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = F.ceil(F.col("_n") * (SALTS_PER_PART * parts) / F.lit(max(total, 1))).cast("int")
    return counts.filter(F.col("_n") * share > total).select(*keys, salts.alias("_salts"))


def salted_join(
    big: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    counts: DataFrame | None = None,
) -> DataFrame:
    """Shuffle join in which only the hot keys of ``big`` are spread, each over salts in proportion to its share.

    The rows of ``lookup`` under a hot key are repeated once per salt. The salt
    hashes the row and the partition it comes from, so a task that is run again deals alike.
    """
    keys = list(keys)
    hot = F.broadcast(hot_salts(big, keys, counts=counts))
    spread = F.pmod(F.xxhash64(*big.columns, F.spark_partition_id()), F.col("_salts")).cast("int")
    left = (
        big.join(hot, keys, "left")
        .withColumn("_salt", F.when(F.col("_salts").isNotNull(), spread).otherwise(F.lit(0)))
        .drop("_salts")
    )
    every = F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)
    right = lookup.join(hot, keys, "left").withColumn("_salt", F.explode(every)).drop("_salts")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def lookup_join(
    big: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    max_bytes: int = BROADCAST_BYTES,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Join ``big`` with a lookup table that is usually, but not surely, small.

    The lookup is pinned and measured. Up to ``max_bytes`` it is broadcast and
    ``big`` is not shuffled; beyond that :func:`salted_join` takes over.
    """
    keys = list(keys)
    lookup = pin(lookup, "lookup")
    if table_bytes(lookup) <= max_bytes:
        return big.join(F.broadcast(lookup), keys, how)
    return salted_join(big, lookup, keys, how, counts=counts)
