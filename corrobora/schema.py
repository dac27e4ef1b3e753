"""Column conventions of the claims relation and its checks.

A *claim* says: source ``source_id`` states ``value`` for ``field`` of entity
``cluster_id``, at time ``ts`` (larger is newer), in record ``offer_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

GROUP = ("cluster_id", "field")
POLICY = ("trust", "ts", "value", "offer_id")
SOURCE_FIELD = ("source_id", "field")

CLAIMS = T.StructType(
    [
        T.StructField("cluster_id", T.LongType()),
        T.StructField("field", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("ts", T.DoubleType()),
        T.StructField("offer_id", T.LongType()),
    ]
)


def validate_claims(claims: DataFrame) -> DataFrame:
    """Return ``claims`` if it can be fused, else raise ``ValueError``.

    Null keys or policy columns, NaN times and (where present) null or negative
    trust are refused, because ordering and joining on them is engine-specific.
    One aggregation job, whatever the number of checks.
    """
    missing = [f.name for f in CLAIMS if f.name not in claims.columns]
    if missing:
        raise ValueError(f"claims lack columns {missing}")
    bad = {f"null {c}": F.col(c).isNull() for c in CLAIMS.names}
    bad["NaN ts"] = F.isnan("ts")
    if "trust" in claims.columns:
        bad["null trust"] = F.col("trust").isNull()
        bad["bad trust"] = F.isnan("trust") | (F.col("trust") < 0)
    row = claims.agg(*[F.count_if(cond).alias(name) for name, cond in bad.items()]).first()
    found = {name: n for name, n in row.asDict().items() if n}
    if found:
        raise ValueError(f"claims cannot be fused: {found}")
    return claims
