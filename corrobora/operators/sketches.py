"""Profiles of large relations from sketches that are kept per part and merged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

#: Registers of a distinct count, as a power of two: a standard error of 0.8 %.
LG_K = 14
STANDARD_ERROR = 1.04 / 2 ** (LG_K / 2)
#: Items a quantile sketch keeps per level: the rank of a quantile is off by about 0.7 % typically, 2 % at most.
KLL_K = 400

#: Sketch -> what it counts; pairs give the averages per cluster.
_DISTINCT = {
    "offers": ["offer_id"],
    "clusters": ["cluster_id"],
    "sources": ["source_id"],
    "cluster_sources": ["cluster_id", "source_id"],
    "cluster_offers": ["cluster_id", "offer_id"],
}


def profile_sketches(claims: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per part (day, file, source): its rows, distinct-count sketches, and a quantile sketch of ``ts``.

    A pass with map-side combining and no distinct sets; a sketch has 16 KB at most. A key with a
    null in it is not counted. Parts that are added later get rows of their own, and earlier rows stay.
    """
    counts = [
        F.hll_sketch_agg(F.when(_whole(columns), F.xxhash64(*columns)), LG_K).alias(name) for name, columns in _DISTINCT.items()
    ]
    times = F.kll_sketch_agg_double(F.col("ts").cast("double"), KLL_K).alias("times")
    return claims.groupBy(*by).agg(F.count("*").alias("rows"), *counts, times)


def _whole(columns: Sequence[str]):
    whole = F.col(columns[0]).isNotNull()
    for c in columns[1:]:
        whole = whole & F.col(c).isNotNull()
    return whole


def merge_profiles(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sketches of larger parts, or with no ``by`` of everything, from those of smaller ones.

    Distinct counts may move with the order of merging, within their error.
    """
    merged = [F.hll_union_agg(c).alias(c) for c in _DISTINCT]
    return parts.groupBy(*by).agg(F.sum("rows").alias("rows"), *merged, F.kll_merge_agg_double("times").alias("times"))


def profile_estimates(parts: DataFrame, by: Sequence[str] = (), quantiles: Sequence[float] = (0.5,)) -> DataFrame:
    """Estimated offers, clusters, sources, rows, sources and offers per cluster, and quantiles of ``ts``."""
    found = merge_profiles(parts, by)
    n = {c: F.hll_sketch_estimate(c).cast("double") for c in _DISTINCT}
    at = [F.kll_sketch_get_quantile_double("times", F.lit(float(q))).alias(f"ts_q{q:g}") for q in quantiles]
    return found.select(
        *by, "rows", *[n[c].alias(c) for c in ("offers", "clusters", "sources")],
        (n["cluster_sources"] / n["clusters"]).alias("avg_sources_per_cluster"),
        (n["cluster_offers"] / n["clusters"]).alias("avg_offers_per_cluster"), *at,
    )
