"""Quality of fused values against labels.

Every measure takes ``by``: extra columns (method, seed, ...) that both the
predictions and the labels carry, so one job scores a whole grid.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from corrobora.schema import GROUP
from corrobora.session import pin


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))


def _ratio(top: str, bottom: str) -> Column:
    return F.col(top) / F.greatest(F.col(bottom), F.lit(1))


def judged(pred: DataFrame, silver: DataFrame, by: Sequence[str] = (), group: Sequence[str] = GROUP) -> DataFrame:
    """Every label with the prediction for its group (null if there is none)."""
    keys = [*by, *group]
    answers = pred.withColumnRenamed("value", "pred")
    return silver.select(*keys, F.col("value").alias("truth")).join(answers, keys, "left")


def _tally(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count("pred").alias("answered"),
        F.count_if(F.col("pred") == F.col("truth")).alias("correct"),
    )


def _with_prf(tally: DataFrame) -> DataFrame:
    scored = tally.withColumn("P", _ratio("correct", "answered")).withColumn("R", _ratio("correct", "n"))
    return scored.withColumn("F1", _f1(F.col("P"), F.col("R")))


def field_prf(pred: DataFrame, silver: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and F1 per field; no answer lowers recall, not precision."""
    scored = _with_prf(_tally(judged(pred, silver, by), [*by, "field"]))
    return scored.select(*by, "field", "P", "R", "F1", "n", "answered")


def macro_prf(pred: DataFrame, silver: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Unweighted mean of the per-field measures."""
    per_field = field_prf(pred, silver, by)
    return per_field.groupBy(*by).agg(*[F.avg(c).alias(c) for c in ("P", "R", "F1")])


def micro_prf(pred: DataFrame, silver: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and F1 over all labels together."""
    scored = _with_prf(_tally(judged(pred, silver, by), list(by)))
    return scored.select(*by, "P", "R", "F1", "n", "answered")


def entity_exact_match(pred: DataFrame, silver: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of clusters (``EM``) whose labelled fields are all answered correctly."""
    ok = F.coalesce(F.col("pred") == F.col("truth"), F.lit(False))
    clusters = judged(pred, silver, by).groupBy(*by, "cluster_id").agg(F.bool_and(ok).alias("_ok"))
    return clusters.groupBy(*by).agg(F.avg(F.col("_ok").cast("double")).alias("EM"))


def accuracy(pred: DataFrame, truth: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of labels that the prediction equals; a missing prediction is wrong."""
    ok = F.coalesce(F.col("pred") == F.col("truth"), F.lit(False)).cast("double")
    return judged(pred, truth, by).groupBy(*by).agg(F.avg(ok).alias("accuracy"))


def quality(pred: DataFrame, silver: DataFrame, by: Sequence[str]) -> DataFrame:
    """Macro P, R, F1 and exact match in one table; the join is done once and written."""
    rows = pin(judged(pred, silver, by), "judged")
    ok = F.coalesce(F.col("pred") == F.col("truth"), F.lit(False))
    macro = _with_prf(_tally(rows, [*by, "field"])).groupBy(*by).agg(
        *[F.avg(c).alias(c) for c in ("P", "R", "F1")]
    )
    exact = rows.groupBy(*by, "cluster_id").agg(F.bool_and(ok).alias("_ok"))
    exact = exact.groupBy(*by).agg(F.avg(F.col("_ok").cast("double")).alias("EM"))
    return macro.join(exact, list(by))


def metric_summary(metrics: DataFrame, by: Sequence[str], columns: Sequence[str], digits: int = 4) -> DataFrame:
    """Mean and sample standard deviation of each column per group, rounded."""
    measures = []
    for c in columns:
        measures.append(F.round(F.avg(c), digits).alias(f"{c}_mean"))
        measures.append(F.round(F.stddev_samp(c), digits).alias(f"{c}_std"))
    return metrics.groupBy(*by).agg(*measures)


def risk_coverage(winners: DataFrame, silver: DataFrame, taus: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Precision, coverage and risk of abstaining below each share threshold ``tau``.

    ``winners`` has ``value`` and ``share``; one pass serves all thresholds.
    """
    rows = judged(winners, silver, by).withColumn("tau", F.explode(F.array(*[F.lit(float(t)) for t in taus])))
    answered = F.col("pred").isNotNull() & (F.col("share") >= F.col("tau"))
    tally = rows.groupBy(*by, "tau").agg(
        F.count("*").alias("n"),
        F.count_if(answered).alias("answered"),
        F.count_if(answered & (F.col("pred") == F.col("truth"))).alias("correct"),
    )
    scored = _with_prf(tally)
    return scored.select(
        *by,
        "tau",
        F.col("P").alias("precision"),
        (F.col("answered") / F.col("n")).alias("coverage"),
        F.col("R").alias("recall"),
        "F1",
        (1 - F.col("P")).alias("selective_risk"),
    )


def source_agreement(collapsed: DataFrame, first: str, second: str) -> DataFrame:
    """How often two sources that both answer a group say the same.

    Conditional aggregation instead of a pivot over all sources: only the two
    sources' claims are read and shuffled.
    """
    pair = collapsed.filter(F.col("source_id").isin(first, second))
    said = pair.groupBy(*GROUP).agg(
        F.max(F.when(F.col("source_id") == first, F.col("value"))).alias("a"),
        F.max(F.when(F.col("source_id") == second, F.col("value"))).alias("b"),
    )
    both = said.filter("a is not null and b is not null")
    return both.agg(F.count("*").alias("n"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("agreement"))


def fusion_coverage(fused: DataFrame) -> DataFrame:
    """Fused rows as a share of all (cluster, field) combinations."""
    sizes = fused.agg(
        F.count("*").alias("rows"),
        F.count_distinct("cluster_id").alias("clusters"),
        F.count_distinct("field").alias("fields"),
    )
    cells = F.greatest(F.col("clusters") * F.col("fields"), F.lit(1))
    return sizes.withColumn("coverage", F.col("rows") / cells)
