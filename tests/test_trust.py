"""Trust learning, its quantiles and the joins that spread it."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corrobora.functions.beta import beta_cdf, beta_ppf
from corrobora.operators import joins, trust as tr
from corrobora.operators.evaluate import entity_exact_match, field_prf, macro_prf, micro_prf


@pytest.mark.parametrize("prob", [0.01, 0.05, 0.1, 0.2])
def test_quantile_inverts_binomial_tail(prob):
    a = np.array([2, 2, 3, 12, 40, 100])
    b = np.array([2, 90, 7, 5, 40, 2])
    x = beta_ppf(prob, a, b)
    for xi, ai, bi in zip(x, a, b):
        n = ai + bi - 1
        tail = sum(math.comb(int(n), k) * xi**k * (1 - xi) ** (n - k) for k in range(int(ai), int(n) + 1))
        assert tail == pytest.approx(prob, abs=1e-10)


def test_quantile_of_fractional_and_large_counts():
    a = np.array([2.3, 1000.5, 5e5, 2.0, 1e6])
    b = np.array([4.7, 2.25, 1e5, 1000.0, 1e6])
    assert np.abs(beta_cdf(beta_ppf(0.05, a, b), a, b) - 0.05).max() < 1e-8


def outcomes(spark, rows):
    return spark.createDataFrame(rows, "source_id string, field string, x byte, ts double")


def test_decay_clamps_the_future_and_zero_rate_is_plain(spark, rows_of):
    adj = outcomes(spark, [("s", "f", 1, 5.0), ("s", "f", 0, 1.0), ("s", "f", 1, 99.0)])
    plain = tr.trust_counts(adj)
    assert rows_of(plain) == [("s", "f", 2.0, 1.0)]
    assert rows_of(tr.trust_counts(adj, tr.decay_weight(5.0, 0.0))) == rows_of(plain)
    faded = tr.trust_counts(adj, tr.decay_weight(5.0, 0.5)).first()
    assert faded["succ"] == 2.0
    assert faded["fail"] == pytest.approx(math.exp(-2.0), abs=1e-12)


def test_summaries(spark):
    counts = spark.createDataFrame([("s", "f", 6.0, 2.0), ("t", "f", 0.0, 0.0)], "source_id string, field string, succ double, fail double")

    def trust(mode, **prior):
        return {r["source_id"]: r["trust"] for r in tr.trust_table(counts, mode, **prior).collect()}

    assert trust("mean") == {"s": 8 / 12, "t": 0.5}
    assert trust("map") == {"s": 7 / 10, "t": 0.5}
    assert trust("map", prior_a=1.0, prior_b=1.0)["t"] == 0.5
    assert trust("lcb")["t"] == pytest.approx(0.13535, abs=1e-5)
    with pytest.raises(ValueError):
        tr.trust_table(counts, "median")


def test_cold_pairs_get_the_prior_or_are_dropped(make_claims, spark):
    claims = make_claims([(1, "f", "v", "known", 1.0, 1), (1, "f", "w", "cold", 1.0, 2)])
    trust = spark.createDataFrame([("known", "f", 0.9)], "source_id string, field string, trust double")
    got = {r["source_id"]: r["trust"] for r in tr.join_trust(claims, trust).collect()}
    assert got == {"known": 0.9, "cold": 0.5}
    assert tr.join_trust(claims, trust, default=0.1).filter("trust = 0.1").count() == 1
    assert tr.join_trust(claims, trust, how="inner").count() == 1


@pytest.fixture
def skewed(spark):
    """30,000 rows, a third of them on key 7; a lookup with a key nobody has and a key it lacks."""
    big = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 900).alias("k"), F.col("id").alias("row")
    )
    lookup = spark.range(10, 1000).union(spark.range(7, 8)).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    return big, lookup


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_salted_join_equals_broadcast_join(skewed, rows_of, how):
    big, lookup = skewed
    small = joins.lookup_join(big, lookup, ["k"], how)
    salted = joins.lookup_join(big, lookup, ["k"], how, max_bytes=0)
    assert rows_of(salted.select(small.columns).fillna(-1)) == rows_of(small.fillna(-1))


def test_hot_keys_are_found_and_spread(skewed, spark):
    big, lookup = skewed
    assert [r[0] for r in joins.hot_keys(big, ["k"], share=10).collect()] == [7]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = joins.salted_join(big, lookup, ["k"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "_salt" in plan and "Cartesian" not in plan


def test_size_check_counts_string_bytes(spark):
    df = spark.createDataFrame([("é",), (None,), ("abc",)], "s string")
    assert joins.table_bytes(df) == 3 * 16 + 2 + 3


def test_measures_treat_missing_answers_as_abstention(spark):
    silver = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "a", "z"), (3, "b", "q")], "cluster_id long, field string, value string")
    pred = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "a", "no"), (9, "a", "x")], "cluster_id long, field string, value string")
    field = {r["field"]: r for r in field_prf(pred, silver).collect()}
    assert (field["a"]["P"], field["a"]["R"], field["a"]["n"], field["a"]["answered"]) == (0.5, 0.5, 2, 2)
    assert (field["b"]["P"], field["b"]["R"], field["b"]["answered"]) == (1.0, 0.5, 1)
    assert macro_prf(pred, silver).first()["P"] == 0.75
    assert micro_prf(pred, silver).first()["R"] == 0.5
    assert entity_exact_match(pred, silver).first()["EM"] == pytest.approx(1 / 3)
    nobody = pred.filter("cluster_id = 9")
    assert micro_prf(nobody, silver).first()["F1"] == 0.0
