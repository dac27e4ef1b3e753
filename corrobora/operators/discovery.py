"""Truth discovery: votes and source weights in turn, with rounds that only look at what moved."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from corrobora.operators.fuse import fixed_point, usable_key
from corrobora.operators.joins import lookup_join
from corrobora.schema import GROUP
from corrobora.session import bucketed, narrow, pin, release

#: Claims of moved sources, as a share of all, from which a round votes on everything again.
MOST = 0.5


def _weighted(claims: DataFrame, weights: DataFrame, source: Sequence[str], *columns: str) -> DataFrame:
    return lookup_join(claims, weights.select(*source, *columns), source, "inner")


def _votes(weighted: DataFrame, keys: Sequence[str], *columns: str) -> DataFrame:
    """The winning (votes, value) of each group by each weight column, as ``w_<column>``; nothing is shuffled on bucketed keys."""
    totals = weighted.groupBy(*keys, "value").agg(*[F.sum(fixed_point(F.col(c))).alias(c) for c in columns])
    return totals.groupBy(*keys).agg(*[F.max(F.struct(c, "value"))["value"].alias(f"w_{c}") for c in columns])


def _agrees(winner: str) -> Column:
    return F.coalesce((F.col("value") == F.col(winner)).cast("long"), F.lit(0))


def _hits(claims: DataFrame, weights: DataFrame, keys: Sequence[str], source: Sequence[str]) -> DataFrame:
    """Each source's claims that win the vote; a merge of two sides that lie by group, so neither is moved or broadcast."""
    winners = _votes(_weighted(claims, weights, source, "trust"), keys, "trust")
    return claims.join(winners.hint("merge"), list(keys)).groupBy(*source).agg(F.sum(_agrees("w_trust")).alias("hits"))


def _gained(claims: DataFrame, weights: DataFrame, keys: Sequence[str], source: Sequence[str]) -> DataFrame:
    """What the sources' hits gain by the weights that moved from ``before`` to ``trust``.

    Only groups with a moved source are voted on, by both weights at once, and
    only those whose winner changes are held against the claims.
    """
    moved = weights.filter("before <> trust").select(*source)
    touched = lookup_join(claims, moved, source, "left_semi").select(*keys).distinct()
    again = claims.join(touched.hint("merge"), list(keys), "left_semi")
    winners = _votes(_weighted(again, weights, source, "before", "trust"), keys, "before", "trust")
    changed = winners.filter(~F.col("w_before").eqNullSafe(F.col("w_trust")))
    gain = _agrees("w_trust") - _agrees("w_before")
    return claims.join(changed.hint("merge"), list(keys)).groupBy(*source).agg(F.sum(gain).alias("hits"))


def discover_truth(
    collapsed: DataFrame,
    rounds: int,
    init: float,
    by: Sequence[str] = (),
    bound: float = 0.0,
    most: float = MOST,
) -> tuple[DataFrame, DataFrame]:
    """The truth after ``rounds`` votes, and a report with a line per re-weighing.

    Sources start at weight ``init``. Each round votes, then weighs every source
    by its smoothed share of winning claims. The claims are written once,
    bucketed and sorted by group, so votes and agreement need no shuffle of claims.

    Rounds are semi-naive: only groups with a source whose weight moved by more
    than ``bound`` since it was last used are voted on again, and hits change
    only where a winner does; the other groups are frozen. Rounds end early when nothing moves.
    With ``bound`` 0 the result is that of all full rounds, since equal weights give equal votes.
    While the moved sources hold more than the share ``most`` of the claims a full vote
    is cheaper and gives the same.

    Report: ``round``, ``sources`` moved, their ``claims``, ``largest`` move, and whether the vote was ``full``.
    Null keys are refused; an empty table has no truth and an empty report.
    """
    keys, source = [*by, *GROUP], [*by, "source_id"]
    spark = collapsed.sparkSession
    checked = narrow(collapsed, *[usable_key(c).alias(c) for c in (*keys, "source_id")], "value")
    lines: list[tuple] = []
    with bucketed(checked, keys, ["value"]) as claims:
        start = F.lit(float(init))
        state = claims.groupBy(*source).agg(F.count("*").alias("n"))
        state = pin(state.select("*", F.lit(0).cast("long").alias("hits"), start.alias("before"), start.alias("trust")), "weights")
        for step in range(1, rounds):
            full = not lines or lines[-1][4]
            found = _hits(claims, state, keys, source) if full else _gained(claims, state, keys, source)
            known = F.lit(0).cast("long") if full else F.col("hits")
            total = known + F.coalesce("found", F.lit(0).cast("long"))
            found = found.withColumnRenamed("hits", "found")
            weighed = state.join(found, source, "left").select(*source, "n", total.alias("hits"), F.col("trust").alias("before"))
            proposed = (F.col("hits") + 1.0) / (F.col("n") + 2.0)
            far = F.abs(proposed - F.col("before")) > bound
            fresh = pin(weighed.withColumn("trust", F.when(far, proposed).otherwise(F.col("before"))), "weights")
            move = F.abs(F.col("trust") - F.col("before"))
            moved = fresh.agg(
                F.count_if(move > 0).alias("sources"),
                F.coalesce(F.sum(F.when(move > 0, F.col("n"))), F.lit(0)).alias("claims"),
                F.coalesce(F.max(move), F.lit(0.0)).alias("largest"),
                F.coalesce(F.sum("n"), F.lit(0)).alias("all"),
            ).first()
            release(state)
            state = fresh
            lines.append((step, moved["sources"], moved["claims"], moved["largest"], moved["claims"] > most * moved["all"]))
            if not moved["sources"]:
                break
        truth = pin(_votes(_weighted(claims, state, source, "trust"), keys, "trust").withColumnRenamed("w_trust", "value"), "truth")
        release(state)
    report = spark.createDataFrame(lines, "round int, sources long, claims long, largest double, full boolean")
    return truth, report
