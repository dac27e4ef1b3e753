import pytest
from pyspark.sql import functions as F

from corrobora.operators.sketches import STANDARD_ERROR, merge_profiles, profile_estimates, profile_sketches


def claims(spark, n=60_000):
    k = F.col("id")
    return spark.range(n).select(
        (k % 7001).alias("cluster_id"), (k % 31_013).alias("offer_id"), F.concat(F.lit("s"), (k * 17 % 53).cast("string")).alias("source_id"),
        (k % 1000).cast("double").alias("ts"), (k % 5).alias("day"),
    )


def test_estimates_within_their_error(spark):
    frame = claims(spark)
    got = profile_estimates(profile_sketches(frame, ["day"])).first()
    clusters = 7001
    pairs = {c: frame.select("cluster_id", c).distinct().count() for c in ("source_id", "offer_id")}
    bound = 4 * STANDARD_ERROR
    assert got.rows == 60_000 and got.sources == pytest.approx(53)
    assert got.offers == pytest.approx(31_013, rel=bound) and got.clusters == pytest.approx(clusters, rel=bound)
    assert got.avg_sources_per_cluster == pytest.approx(pairs["source_id"] / clusters, rel=2 * bound)
    assert got.avg_offers_per_cluster == pytest.approx(pairs["offer_id"] / clusters, rel=2 * bound)
    assert abs(got["ts_q0.5"] - 500) <= 20


def test_parts_added_later_merge_within_the_error(spark):
    frame = claims(spark, 3000)
    early, late = frame.filter("day < 3"), frame.filter("day >= 3")
    parts = profile_sketches(early, ["day"]).unionByName(profile_sketches(late, ["day"]))
    assert parts.count() == 5
    for sketches in (parts, profile_sketches(frame, ["day"])):
        got = profile_estimates(sketches).first()
        assert got.rows == 3000
        for c, n in (("offers", 3000), ("clusters", 3000), ("sources", 53)):
            assert got[c] == pytest.approx(n, rel=4 * STANDARD_ERROR)
    assert merge_profiles(parts, ["day"]).count() == 5


def test_nulls_and_an_empty_table(spark):
    schema = "cluster_id long, offer_id long, source_id string, ts double, day int"
    frame = spark.createDataFrame([(1, None, "a", None, 1), (None, 2, "a", 3.0, 1), (1, 2, None, 4.0, 2)], schema)
    got = profile_estimates(profile_sketches(frame, ["day"])).first()
    assert (got.rows, round(got.offers), round(got.clusters), round(got.sources)) == (3, 1, 1, 1)
    assert profile_sketches(frame.limit(0), ["day"]).count() == 0
