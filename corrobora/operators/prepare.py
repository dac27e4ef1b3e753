"""From wide records to the claims relation, and small reshaping helpers."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from corrobora.functions.text import norm_text
from corrobora.operators.joins import HOT_SHARE, lookup_join
from corrobora.operators.order import with_row_index
from corrobora.session import spread

Normaliser = Callable[[Column], Column]


def unpivot_claims(
    records: DataFrame,
    ids: Sequence[str],
    fields: Sequence[str],
    normalise: Normaliser | Mapping[str, Normaliser] | None = norm_text,
) -> DataFrame:
    """One row per (record, field) with a usable value; field names are lower-cased.

    ``normalise`` is applied to every value, or per field if it is a mapping.
    Records outside any cluster (negative ``cluster_id``) are dropped. Claims lie where
    their records do, so records that :func:`deal_groups` dealt give claims dealt alike.
    """
    def clean(field: str) -> Column:
        rule = normalise.get(field) if isinstance(normalise, Mapping) else normalise
        return rule(F.col(field)) if rule else F.col(field).cast("string")

    inside = records.filter(F.col("cluster_id") >= 0) if "cluster_id" in ids else records
    wide = inside.select(*ids, *[clean(f).alias(f.lower()) for f in fields])
    pairs = [F.struct(F.lit(f.lower()).alias("field"), F.col(f.lower()).alias("value")) for f in fields]
    return wide.select(*ids, F.inline(F.array(*pairs))).filter("value is not null")


#: Records of one part, and of one group, that are few enough for a task whatever the table.
PART_RECORDS = 250_000
GROUP_RECORDS = 10_000


def deal_groups(records: DataFrame, group: Sequence[str] = ("cluster_id",), part: int = PART_RECORDS) -> DataFrame:
    """Records dealt by their group, about ``part`` to a task: collapsing, ranking and voting on them then move nothing.

    One exchange of records takes the place of several of their claims. A table in which a
    group holds more than 1/1000 of the records (and over :data:`GROUP_RECORDS`) is not dealt by it, as one task would get
    the whole group; what fuses its claims then reduces them before they move. Null groups do not count.
    """
    known = records.select(*group).dropna()
    most, total = known.groupBy(*group).agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
    if not total or most > max(total // HOT_SHARE, GROUP_RECORDS):
        return spread(records)
    cores = records.sparkSession.sparkContext.defaultParallelism
    return records.repartition(max(cores, -(-total // part)), *group)


def deal_parts(
    records: DataFrame, parts: int, mix: Column, group: Sequence[str] = ("cluster_id",), part: int = PART_RECORDS
) -> DataFrame:
    """Records of each group dealt over ``parts`` partitions by the long ``mix``, whatever the size of the table.

    Groups are cut into as many slices as keep a partition at about ``part`` records; each slice has
    ``parts`` partitions of its own, one slice in a small table. No group lies in more than ``parts`` of them.
    """
    slices = max(1, -(-records.count() // (parts * part)))
    place = F.pmod(F.xxhash64(*group), F.lit(slices)) * parts + F.pmod(mix, F.lit(parts))
    return records.repartitionById(slices * parts, place.cast("int"))


def multi_source(claims: DataFrame, least: int = 2) -> DataFrame:
    """Claims of the clusters that at least ``least`` distinct sources speak about."""
    sources = claims.groupBy("cluster_id").agg(F.count_distinct("source_id").alias("_sources"))
    kept = sources.filter(F.col("_sources") >= least).select("cluster_id")
    return lookup_join(claims, kept, ["cluster_id"], "left_semi")


def dict_encode(claims: DataFrame, column: str = "value", code: str | None = None) -> DataFrame:
    """Replace ``column`` by its 0-based position among the sorted distinct values; a null one by -1."""
    code = code or f"{column}_code"
    present = claims.select(column).filter(F.col(column).isNotNull()).distinct()
    values = with_row_index(present, [column], code).select(column, code)
    coded = lookup_join(claims, values, [column], "left").drop(column)
    return coded.withColumn(code, F.coalesce(code, F.lit(-1).cast("long")))


def replicate_claims(claims: DataFrame, n_rows: int, order: Sequence[str]) -> DataFrame:
    """Exactly ``n_rows`` rows: the claims tiled with shifted cluster and offer ids.

    Copies are made in place by a generator; the last, partial copy keeps the
    first rows in ``order``.
    """
    base = with_row_index(claims, order, "_row")
    total, span, offers = base.agg(
        F.count("*"), F.max("cluster_id") + 1, F.max("offer_id") + 1
    ).first()
    copies = -(-n_rows // total)
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long")))
    tiled = base.withColumn("_copy", copy).filter(F.col("_copy") * total + F.col("_row") < n_rows)
    return (
        tiled.withColumn("cluster_id", F.col("cluster_id") + F.col("_copy") * span)
        .withColumn("offer_id", F.col("offer_id") + F.col("_copy") * offers)
        .drop("_copy", "_row", "_row_total")
    )


def split_claims(claims: DataFrame, split: DataFrame, part: str) -> DataFrame:
    """Claims of the clusters that ``split`` assigns to ``part``."""
    chosen = split.filter(F.col("part") == part).select("cluster_id")
    return lookup_join(claims, chosen, ["cluster_id"], "left_semi")


def relation_profile(claims: DataFrame) -> DataFrame:
    """One row of sizes: offers, clusters, sources, rows and per-cluster averages.

    Distinct offers and sources are counted per cluster first, so the distinct
    sets are spread by cluster and value, never gathered.
    """
    per_cluster = claims.groupBy("cluster_id").agg(
        F.count_distinct("source_id").alias("_sources"), F.count_distinct("offer_id").alias("_offers")
    )
    shape = per_cluster.agg(
        F.count("*").alias("clusters"),
        F.avg("_sources").alias("avg_sources_per_cluster"),
        F.median("_offers").alias("median_offers_per_cluster"),
    )
    sizes = claims.agg(
        F.count_distinct("offer_id").alias("offers"),
        F.count_distinct("source_id").alias("sources"),
        F.count("*").alias("rows"),
    )
    facts = [
        part.unpivot([], [F.col(c).cast("double").alias(c) for c in part.columns], "measure", "amount")
        for part in (shape, sizes)
    ]
    per_field = claims.groupBy("field").agg(F.count("*").cast("double").alias("amount"))
    named = per_field.select(F.concat(F.lit("rows of "), "field").alias("measure"), "amount")
    result = facts[0].unionByName(facts[1]).unionByName(named)
    if "category" in claims.columns:
        by_category = claims.groupBy("category").agg(F.count_distinct("cluster_id").cast("double").alias("amount"))
        result = result.unionByName(
            by_category.select(F.concat(F.lit("clusters of "), "category").alias("measure"), "amount")
        )
    return result


__all__ = [
    "deal_groups",
    "deal_parts",
    "dict_encode",
    "multi_source",
    "relation_profile",
    "replicate_claims",
    "split_claims",
    "unpivot_claims",
]
