"""Fusion operators: pick one value per group from conflicting claims.

Two families. *Rank* keeps the claim whose policy tuple is greatest, compared
column by column. *Vote* adds the weights per value and keeps the value with
the greatest (total, value). Both are associative, so Spark combines map-side
before each shuffle: a group that holds a third of all rows still sends only
one row (rank) or one row per distinct value (vote) per map task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from corrobora.schema import GROUP, POLICY

WEIGHT_BITS = 32  # fixed value: vote weights are summed in units of 2**-32


def top_row(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The greatest row of each group by ``order``, compared column by column.

    Planned as a group limit on both sides of the shuffle, so at most one row
    per group and map task is exchanged. The hash of the keys leads the sort:
    it decides nearly all comparisons on one long.
    """
    window = Window.partitionBy("_hash", *keys).orderBy(*[F.col(c).desc() for c in order])
    hashed = df.withColumn("_hash", F.xxhash64(*keys))
    return hashed.withColumn("_place", F.row_number().over(window)).filter("_place = 1").drop("_hash", "_place")


def usable_weight(column: str) -> Column:
    """The weight, or an error where it is null, NaN or negative: checked as the rows pass, without a pass of its own."""
    w = F.col(column)
    bad = w.isNull() | F.isnan(w.cast("double")) | (w < 0)
    return F.when(bad, F.raise_error(F.lit(f"null, NaN or negative {column}")).cast("double")).otherwise(w)


def usable_key(column: str) -> Column:
    """The key column, or an error where it is null."""
    k = F.col(column)
    return F.when(k.isNull(), F.raise_error(F.lit(f"null {column}"))).otherwise(k)


def refusing(keys: Sequence[str], column: Column) -> Column:
    """The column, or an error where one of the keys is null.

    A check in the key itself would make a new column of it, and rows that lie by
    the key would be dealt again.
    """
    for k in reversed(keys):
        column = F.when(F.col(k).isNull(), F.raise_error(F.lit(f"null {k}"))).otherwise(column)
    return column


def fixed_point(weight: Column, bits: int = WEIGHT_BITS) -> Column:
    """Weight as a whole number of ``2**-bits`` (half-even), exact to add in any order.

    Decimal, because the total of a very large group outgrows 64 bits.
    """
    return F.rint(weight * F.lit(float(2**bits))).cast("long").cast("decimal(20,0)")


# ------------------------------------------------------------------- rank
def rank_fuse(
    claims: DataFrame,
    policy: Sequence[str] = POLICY,
    group: Sequence[str] = GROUP,
    value: str = "value",
) -> DataFrame:
    """Value of the claim with the greatest policy tuple, per group."""
    needed = list(dict.fromkeys([*group, *policy, value]))
    columns = {c: usable_weight(c) if c == "trust" and c in policy else F.col(c) for c in needed}
    checked = next(c for c in (*policy, value) if c not in group)
    columns[checked] = refusing(group, columns[checked])
    rows = claims.select(*[column.alias(c) for c, column in columns.items()])
    best = top_row(rows, group, policy)
    return best.select(*group, F.col(value).alias("value"))


def rank_state(
    claims: DataFrame,
    policy: Sequence[str] = POLICY,
    group: Sequence[str] = GROUP,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Winning tuple per group (with ``carry`` columns): a state that can be merged later."""
    columns = list(dict.fromkeys([*group, *policy, *carry]))
    return top_row(claims.select(*columns), group, policy)


def rank_merge(
    *states: DataFrame,
    policy: Sequence[str] = POLICY,
    group: Sequence[str] = GROUP,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One state from several; the same as ranking all their claims at once."""
    return rank_state(reduce(DataFrame.unionByName, states), policy, group, carry)


# ------------------------------------------------------------------- vote
def vote_state(
    claims: DataFrame,
    weight: str = "trust",
    group: Sequence[str] = GROUP,
    value: str = "value",
) -> DataFrame:
    """Exact weight total ``votes`` (units of 2**-32) per group and value; mergeable."""
    rows = claims.select(*group, F.col(value).alias("value"), refusing(group, usable_weight(weight)).alias("_weight"))
    return rows.groupBy(*group, "value").agg(F.sum(fixed_point(F.col("_weight"))).alias("votes"))


def vote_merge(*states: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """Add up several vote states."""
    together = reduce(DataFrame.unionByName, states)
    return together.groupBy(*group, "value").agg(F.sum("votes").alias("votes"))


def vote_winner(state: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """Value with the greatest (total, value) per group of a vote state."""
    return top_row(state, group, ["votes", "value"]).select(*group, "value")


def vote_fuse(
    claims: DataFrame,
    weight: str = "trust",
    group: Sequence[str] = GROUP,
    value: str = "value",
) -> DataFrame:
    """Weighted vote with fixed-point totals: the same winner under any partitioning."""
    return vote_winner(vote_state(claims, weight, group, value), group)


def vote_fuse_float(
    claims: DataFrame,
    weight: str = "trust",
    group: Sequence[str] = GROUP,
    value: str = "value",
) -> DataFrame:
    """Weighted vote with double totals; near ties may depend on the order of addition."""
    checked = refusing(group, usable_weight(weight).cast("double"))
    rows = claims.select(*group, F.col(value).alias("value"), checked.alias("_weight"))
    return vote_winner(rows.groupBy(*group, "value").agg(F.sum("_weight").alias("votes")), group)


def vote_share(
    claims: DataFrame,
    weight: str = "trust",
    group: Sequence[str] = GROUP,
    value: str = "value",
) -> DataFrame:
    """Vote winner and its ``share`` of the group's total weight.

    The group total is aggregated next to the winner, not read from a window
    over the group, so no task ever holds a whole group.
    """
    state = vote_state(claims, weight, group, value)
    best = state.groupBy(*group).agg(
        F.max(F.struct("votes", "value")).alias("top"), F.sum("votes").alias("total")
    )
    floor = F.greatest(F.col("total").cast("double"), F.lit(1e-12 * 2**WEIGHT_BITS))
    return best.select(
        *group, F.col("top.value").alias("value"), (F.col("top.votes").cast("double") / floor).alias("share")
    )


def abstain(winners: DataFrame, tau: float) -> DataFrame:
    """Blank the winners whose share is below ``tau`` (a null value means no answer)."""
    return winners.withColumn("value", F.when(F.col("share") >= tau, F.col("value")))


# --------------------------------------------------------------- collapse
def source_state(claims: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """How often, and when last, each source states each value of a group: a state that can be merged later."""
    return claims.groupBy(*group, "source_id", "value").agg(
        F.count("*").alias("n"), F.max("ts").alias("ts"), F.max("offer_id").alias("offer_id")
    )


def merge_source_states(state: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """One state from a union of several; the same as counting all their claims at once."""
    return state.groupBy(*group, "source_id", "value").agg(
        F.sum("n").alias("n"), F.max("ts").alias("ts"), F.max("offer_id").alias("offer_id")
    )


def collapse_state(state: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """One claim per (group, source) of a merged state: its most frequent value."""
    best = top_row(state, [*group, "source_id"], ["n", "ts", "offer_id", "value"])
    return best.select(*group, "source_id", "value", "ts", "offer_id")


def collapse_per_source(claims: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """One claim per (group, source): its most frequent value.

    Ties go to the newest, then the greatest offer id, then the greatest value.
    """
    return collapse_state(source_state(claims, group), group)


# ------------------------------------------------------------- comparison
def fingerprint(df: DataFrame, columns: Sequence[str] = (*GROUP, "value")) -> DataFrame:
    """Order-free digest of a table: equal digests mean (practically) equal row multisets."""
    digest = F.xxhash64(*columns)
    return df.agg(
        F.count("*").alias("rows"),
        F.sum(digest.cast("decimal(20,0)")).cast("string").alias("digest_sum"),
        F.coalesce(F.bit_xor(digest), F.lit(0)).alias("digest_xor"),
    )
