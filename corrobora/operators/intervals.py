"""What changes from window to window, as intervals instead of a copy per window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from corrobora.schema import GROUP, SOURCE_FIELD


def claim_intervals(claims: DataFrame, n_windows: int) -> DataFrame:
    """Collapsed claims of every prefix of windows: (group, source, value, ts, offer_id, since, until).

    ``claims`` carry a ``window`` 1..``n_windows``; a row holds for the prefixes
    that end in windows ``since`` to ``until``. Within a source, what backs a
    value only grows, so the best claim of a prefix is the greatest state
    reached so far: running sums per value, then a running maximum per source.
    The rows are one per change, and no sort partition has more than ``n_windows`` of them.
    """
    source = [*GROUP, "source_id"]
    partial = claims.filter(F.col("window").between(1, n_windows)).groupBy(*source, "value", "window").agg(
        F.count("*").alias("_n"), F.max("ts").alias("ts"), F.max("offer_id").alias("offer_id")
    )
    so_far = Window.partitionBy(*source, "value").orderBy("window").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = F.struct(
        F.sum("_n").over(so_far).alias("n"), F.max("ts").over(so_far).alias("ts"),
        F.max("offer_id").over(so_far).alias("offer_id"), F.col("value"),
    )
    states = partial.select(*source, "window", state.alias("state"))
    best = states.groupBy(*source, "window").agg(F.max("state").alias("state"))
    ahead = Window.partitionBy(*source).orderBy("window")
    reached = best.withColumn("state", F.max("state").over(ahead.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    seen = F.struct("state.value", "state.ts", "state.offer_id")
    changed = reached.withColumn("_before", F.lag(seen).over(ahead)).filter(F.col("_before").isNull() | ~seen.eqNullSafe(F.col("_before")))
    until = F.coalesce(F.lead("window").over(ahead) - 1, F.lit(n_windows))
    return changed.select(*source, "state.value", "state.ts", "state.offer_id", F.col("window").alias("since"), until.alias("until"))


def at_windows(intervals: DataFrame) -> DataFrame:
    """The rows of every window an interval covers, tagged ``as_of``."""
    return intervals.withColumn("as_of", F.explode(F.sequence("since", "until"))).drop("since", "until")


def interval_labels(silver: DataFrame, intervals: DataFrame, n_windows: int) -> DataFrame:
    """(as_of, group, value): labels of the groups that a prefix speaks about, from a group's first window on."""
    first = intervals.groupBy(*GROUP).agg(F.min("since").alias("_since"))
    every = F.explode(F.sequence("_since", F.lit(n_windows))).alias("as_of")
    return silver.join(first, list(GROUP)).select(every, *GROUP, "value")


def interval_evidence(intervals: DataFrame, silver: DataFrame, n_windows: int) -> DataFrame:
    """Outcome counts that each window's adjudication reveals: (window, source, field, succ, fail).

    The same as adjudicating every prefix anew: an interval counts from ``since``
    on and no more after ``until``, and the changes are added up per source and field. What is
    joined and shuffled grows with the changes; only the counts have a row per window.
    """
    truth = silver.select(*GROUP, F.col("value").alias("_truth"))
    judged = intervals.join(truth, list(GROUP)).withColumn("x", (F.col("value") == F.col("_truth")).cast("long"))
    one, less = F.lit(1), F.lit(-1)
    steps = F.array(F.struct(F.col("since").alias("window"), one.alias("d")), F.struct((F.col("until") + 1).alias("window"), less.alias("d")))
    moves = judged.filter("x IS NOT NULL").select(*SOURCE_FIELD, "x", F.inline(steps)).filter(F.col("window") <= n_windows)
    change = moves.groupBy(*SOURCE_FIELD, "window").agg(
        F.sum(F.col("d") * F.col("x")).alias("succ"), F.sum(F.col("d") * (1 - F.col("x"))).alias("fail")
    )
    order = Window.partitionBy(*SOURCE_FIELD).orderBy("window")
    until = F.coalesce(F.lead("window").over(order) - 1, F.lit(n_windows))
    total = [F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("double").alias(c) for c in ("succ", "fail")]
    steady = change.select(*SOURCE_FIELD, "window", until.alias("until"), *total)
    return steady.select(F.explode(F.sequence("window", "until")).alias("window"), *SOURCE_FIELD, "succ", "fail")
