"""Global positions without a single-task sort: row index, arrival time, equal windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from corrobora.session import pin


def with_row_index(df: DataFrame, order: Sequence[str | Column], name: str = "row_index") -> DataFrame:
    """Add the 0-based position in ``order`` and the row count as ``<name>_total``.

    The table is range-sorted and written once with (partition, offset) stamps.
    Only the row counts of the sort partitions are added up in one place.
    ``order`` should be total; equal rows get positions in no fixed order.
    """
    stamp = F.monotonically_increasing_id()
    sorted_rows = pin(df.orderBy(*order).withColumn("_stamp", stamp), "sorted")
    part = F.shiftright("_stamp", 33)
    sizes = sorted_rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = sizes.select(
        "_part",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"),
        F.sum("_size").over(everything).alias(f"{name}_total"),
    )
    offset = F.col("_stamp").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        sorted_rows.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + offset)
        .drop("_part", "_start", "_stamp")
    )


def arrival_time(claims: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Number the rows by arrival: ``offer_id`` = position, ``ts`` = position / row count."""
    numbered = with_row_index(claims.drop("offer_id", "ts"), order, "offer_id")
    return numbered.withColumn("ts", F.col("offer_id") / F.col("offer_id_total")).drop("offer_id_total")


def time_windows(
    claims: DataFrame,
    n: int,
    order: Sequence[str | Column] = ("ts", "offer_id", "cluster_id", "field", "source_id", "value"),
    name: str = "window",
) -> DataFrame:
    """Cut the ordered rows into ``n`` consecutive windows 1..n of (nearly) equal size."""
    indexed = with_row_index(claims, order, "_row")
    window = F.expr(f"cast((_row * {int(n)}) div _row_total + 1 as int)")
    return indexed.withColumn(name, window).drop("_row", "_row_total")
