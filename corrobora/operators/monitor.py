"""Watching sources and quality over time: windowed backtests, trust trends, heatmaps."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from corrobora.operators.evaluate import micro_prf
from corrobora.operators.fuse import fixed_point, vote_fuse
from corrobora.operators.intervals import at_windows, claim_intervals, interval_evidence, interval_labels
from corrobora.operators.joins import lookup_join
from corrobora.operators.trust import DECAY_BITS, DELTA, PRIOR_A, PRIOR_B, trust_counts, trust_table
from corrobora.schema import GROUP, SOURCE_FIELD
from corrobora.session import pin

PRIOR_MEAN = PRIOR_A / (PRIOR_A + PRIOR_B)


@dataclass(frozen=True)
class TrustPolicy:
    """How a backtest turns past evidence into trust.

    ``lam`` fades evidence per window of age; ``per_source`` pools the fields;
    ``freeze_after`` ignores evidence of later windows; ``mode`` as in
    :func:`~corrobora.operators.trust.trust_table`.
    """

    name: str
    lam: float = 0.0
    per_source: bool = False
    freeze_after: int | None = None
    mode: str = "mean"


def top_sources(claims: DataFrame, n: int) -> DataFrame:
    """The ``n`` sources with most claims; ties go to the smaller source id."""
    counts = claims.groupBy("source_id").agg(F.count("*").alias("claims"))
    return counts.orderBy(F.desc("claims"), F.asc("source_id")).limit(n)


def trust_heatmap(trust: DataFrame, fields: Sequence[str], value: str = "trust", digits: int = 4) -> DataFrame:
    """Sources in rows, ``fields`` in columns; sources sorted by their trailing number."""
    cells = trust.groupBy("source_id").pivot("field", list(fields)).agg(F.round(F.first(value), digits))
    number = F.regexp_extract("source_id", r"([0-9]+)\s*$", 1).try_cast("long")
    return cells.orderBy(number, "source_id")


def heterogeneity(trust: DataFrame) -> DataFrame:
    """Per source: evidence, and variance (population) and range of trust over its fields."""
    return (
        trust.groupBy("source_id")
        .agg(
            F.sum("n_eff").alias("evidence"),
            F.var_pop("trust").alias("variance"),
            (F.max("trust") - F.min("trust")).alias("range"),
        )
        .orderBy(F.desc("variance"), "source_id")
    )


def mean_range(trust: DataFrame) -> DataFrame:
    """Average over sources of the range of trust across fields."""
    return heterogeneity(trust).agg(F.avg("range").alias("mean_range"))


# ---------------------------------------------------------------- backtest
def prefix_claims(claims: DataFrame, n_windows: int) -> DataFrame:
    """Collapsed claims of every prefix of windows, tagged ``as_of`` = last window seen.

    The states are found as intervals, one per change, and only repeated per window at the end.
    """
    return at_windows(claim_intervals(claims, n_windows))


def resolved_labels(silver: DataFrame, claims: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Labels of the groups that ``claims`` (per ``by``) speaks about."""
    present = claims.select(*by, *GROUP).distinct()
    return silver.join(present, list(GROUP)).select(*by, *GROUP, "value")


def windowed_evidence(prefixes: DataFrame, silver: DataFrame, dedup: bool = False) -> DataFrame:
    """Outcome counts that each window's adjudication reveals: (window, source, field, succ, fail).

    Every window adjudicates the whole prefix again, so a pair counts once per
    window it is visible in; ``dedup=True`` counts it in its first window only.
    """
    truth = silver.select(*GROUP, F.col("value").alias("_truth"))
    judged = prefixes.join(truth, list(GROUP)).withColumn(
        "x", (F.col("value") == F.col("_truth")).cast("byte")
    )
    if dedup:
        first = judged.groupBy(*GROUP, "source_id").agg(F.min(F.struct("as_of", "x")).alias("_first"))
        judged = first.select("source_id", "field", "_first.as_of", "_first.x")
    return trust_counts(judged.withColumnRenamed("as_of", "window"), by=["window", *SOURCE_FIELD])


def windowed_trust(
    evidence: DataFrame, policies: Sequence[TrustPolicy], n_windows: int, delta: float = DELTA
) -> DataFrame:
    """Trust at each window from earlier windows' evidence: (policy, window, source, field, trust).

    Evidence of window w serves windows w+1..n, faded by its age in windows.
    The tables here have a row per window, source and field, not per claim.
    """
    future = F.sequence(F.col("window") + 1, F.lit(n_windows))
    later = evidence.filter(F.col("window") < n_windows).withColumn("_at", F.explode(future))
    options = F.array(
        *[
            F.struct(
                F.lit(p.name).alias("policy"),
                F.lit(float(p.lam)).alias("lam"),
                F.lit(p.freeze_after or n_windows).alias("until"),
                F.lit(p.per_source).alias("pooled"),
                F.lit(p.mode).alias("mode"),
            )
            for p in policies
        ]
    )
    seen = later.withColumn("_p", F.explode(options)).filter("window <= _p.until")
    fade = F.exp(-F.col("_p.lam") * (F.col("_at") - F.col("window")))
    key = [F.col("_p.policy").alias("policy"), F.col("_p.mode").alias("mode"), F.col("_at").alias("window")]
    unit = F.lit(float(2**DECAY_BITS))
    exact = {c: fixed_point(fade, DECAY_BITS) * F.col(c).cast("decimal(15,0)") for c in ("succ", "fail")}
    sums = [(F.sum(total).cast("double") / unit).alias(c) for c, total in exact.items()]
    names = ["policy", "mode", "window"]
    fine = seen.filter("not _p.pooled").groupBy(*key, "source_id", "field").agg(*sums)
    pooled = seen.filter("_p.pooled").groupBy(*key, "source_id").agg(*sums)
    fields = evidence.select(*SOURCE_FIELD).distinct()
    counts = pin(fine.unionByName(pooled.join(fields, "source_id").select(*fine.columns)), "evidence")
    by = [*names, *SOURCE_FIELD]
    modes = sorted({p.mode for p in policies})
    tables = [
        trust_table(counts.filter(F.col("mode") == m), m, delta, by=by).drop("mode") for m in modes
    ]
    result = tables[0]
    for table in tables[1:]:
        result = result.unionByName(table)
    return result


def prequential_backtest(
    claims: DataFrame, silver: DataFrame, policies: Sequence[TrustPolicy], n_windows: int
) -> DataFrame:
    """F1 per policy and window: fuse the prefix with trust from earlier windows, then learn from it.

    ``claims`` carry a ``window`` 1..n. Labels do not depend on the fused
    values, so all windows and policies run as one job instead of a loop.
    """
    labelled = lookup_join(claims, pin(silver.select(*GROUP), "groups"), list(GROUP), "left_semi")
    intervals = pin(claim_intervals(labelled, n_windows), "intervals")
    evidence = pin(interval_evidence(intervals, silver, n_windows), "evidence")
    trust = windowed_trust(evidence, policies, n_windows).withColumnRenamed("window", "as_of")
    names = [p.name for p in policies]
    policy = F.explode(F.array(*[F.lit(n) for n in names]))
    labels = pin(interval_labels(silver, intervals, n_windows), "labels")
    weighted = lookup_join(
        at_windows(intervals).withColumn("policy", policy),
        trust.select("policy", "as_of", *SOURCE_FIELD, "trust"),
        ["policy", "as_of", *SOURCE_FIELD],
    ).fillna({"trust": PRIOR_MEAN})
    by = ["policy", "as_of"]
    pred = vote_fuse(weighted, group=[*by, *GROUP])
    scores = micro_prf(pred, labels.withColumn("policy", policy), by)
    return scores.select("policy", F.col("as_of").alias("window"), "F1", "n")


def trust_trend(trust: DataFrame, watched: Sequence[str], policies: Sequence[TrustPolicy] = ()) -> DataFrame:
    """Mean trust of the watched sources per policy and window.

    ``policies`` that pool the fields have no trust per field to follow and are left out.
    """
    pooled = [p.name for p in policies if p.per_source]
    chosen = trust.filter(F.col("source_id").isin(*watched) & ~F.col("policy").isin(*pooled))
    return chosen.groupBy("policy", "window").agg(F.avg("trust").alias("mean_trust"))


def recovery_summary(
    scores: DataFrame, by: Sequence[str] = ("policy",), clean: int = 3, last: int = 8, within: float = 0.95
) -> DataFrame:
    """F1 before and after window ``clean``, and how many windows until it is back within 95 %."""
    f1 = F.col("F1")
    before = scores.filter(F.col("window") == clean).select(*by, f1.alias("pre_F1"))
    after = scores.filter(F.col("window") > clean).join(before, list(by))
    return after.groupBy(*by).agg(
        F.max("pre_F1").alias("pre_F1"),
        F.avg("F1").alias("post_avg_F1"),
        F.max(F.when(F.col("window") == last, f1)).alias("final_F1"),
        F.min(F.when(f1 >= within * F.col("pre_F1"), F.col("window") - clean)).alias("recovery_windows"),
    )


def batch_summary(metrics: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean and 95th percentile of ``value`` per group; last, first-five and last-five mean F1.

    Batches are numbered 1..n; the percentile is exact and interpolated.
    """
    keys = list(by) or ["_all"]
    metrics = metrics if by else metrics.withColumn("_all", F.lit(0))
    ends = metrics.groupBy(*keys).agg(F.max("batch").alias("_last"))
    summary = metrics.join(ends, keys).groupBy(*keys).agg(
        F.avg(value).alias(f"mean_{value}"),
        F.percentile(value, F.lit(0.95)).alias(f"p95_{value}"),
        F.max_by("F1", "batch").alias("final_F1"),
        F.avg(F.when(F.col("batch") <= 5, F.col("F1"))).alias("first5_F1"),
        F.avg(F.when(F.col("batch") > F.col("_last") - 5, F.col("F1"))).alias("last5_F1"),
    )
    return summary if by else summary.drop("_all")


__all__ = [
    "TrustPolicy",
    "batch_summary",
    "heterogeneity",
    "mean_range",
    "prefix_claims",
    "prequential_backtest",
    "recovery_summary",
    "resolved_labels",
    "top_sources",
    "trust_heatmap",
    "trust_trend",
    "windowed_evidence",
    "windowed_trust",
]
