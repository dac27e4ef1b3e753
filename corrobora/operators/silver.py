"""Silver labels: canonical values that enough trusted-panel sources agree on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from corrobora.operators.fuse import top_row
from corrobora.operators.joins import lookup_join
from corrobora.schema import GROUP

# Panel size per field, agreeing sources needed, and their least share.
PANEL_SIZE = 5
MIN_AGREE = 2
MIN_RATIO = 1 / 3


def gold_panel(claims: DataFrame, k: int = PANEL_SIZE) -> DataFrame:
    """The ``k`` sources with most claims on each field; ties go to the smaller source id."""
    coverage = claims.groupBy("field", "source_id").agg(F.count("*").alias("_n"))
    window = Window.partitionBy("field").orderBy(F.desc("_n"), F.asc("source_id"))
    ranked = coverage.withColumn("_place", F.row_number().over(window))
    return ranked.filter(F.col("_place") <= k).select("field", "source_id")


def silver_labels(
    claims: DataFrame,
    panel: DataFrame | None = None,
    k: int = PANEL_SIZE,
    min_agree: int = MIN_AGREE,
    min_ratio: float = MIN_RATIO,
    one_claim_per_source: bool = False,
    group: Sequence[str] = GROUP,
) -> DataFrame:
    """Most supported value among panel sources per group, if the agreement suffices.

    Support counts distinct sources. A group whose best value has fewer than
    ``min_agree`` sources, or less than ``min_ratio`` of the panel sources that
    answered, gets no label. With ``one_claim_per_source`` (collapsed claims)
    the number of answering sources is the sum of the supports, which saves the
    distinct counts and a join.
    """
    panel = gold_panel(claims, k) if panel is None else panel
    heard = lookup_join(claims.select(*group, "source_id", "value"), panel, ["field", "source_id"], "left_semi")
    if one_claim_per_source:
        support = heard.groupBy(*group, "value").agg(F.count("*").alias("_sup"))
        best = support.groupBy(*group).agg(
            F.max(F.struct("_sup", "value")).alias("_top"), F.sum("_sup").alias("_heard")
        )
        best = best.select(*group, "_top.value", "_top._sup", "_heard")
    else:
        support = heard.groupBy(*group, "value").agg(F.count_distinct("source_id").alias("_sup"))
        answered = heard.groupBy(*group).agg(F.count_distinct("source_id").alias("_heard"))
        best = top_row(support, group, ["_sup", "value"]).join(answered, list(group))
    enough = (F.col("_sup") >= min_agree) & (F.col("_sup") / F.col("_heard") >= min_ratio)
    return best.filter(enough).select(*group, "value")
