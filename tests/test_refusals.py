"""What must not pass in silence: bad weights, null keys, odd file names, null values, loops that run out."""

import numpy as np
import pytest

from corrobora.functions import beta
from corrobora.operators import fuse, trust as tr
from corrobora.operators.components import component_roots
from corrobora.operators.prepare import dict_encode
from corrobora.session import pin, release, scratch
from corrobora.sources import files

GOOD = (1, "f", "v", "s", 1.0, 10, 0.5)


@pytest.mark.parametrize("weight", [None, float("nan"), -0.5])
@pytest.mark.parametrize("operator", [fuse.vote_fuse, fuse.vote_fuse_float, fuse.vote_share, fuse.rank_fuse])
def test_bad_weights_are_refused(make_claims, operator, weight):
    claims = make_claims([GOOD, (1, "f", "w", "t", 1.0, 11, weight)])
    with pytest.raises(Exception, match="null, NaN or negative trust"):
        operator(claims).collect()


@pytest.mark.parametrize("operator", [fuse.vote_fuse, fuse.rank_fuse])
def test_null_keys_are_refused(make_claims, operator):
    with pytest.raises(Exception, match="null cluster_id"):
        operator(make_claims([GOOD, (None, "f", "w", "t", 1.0, 11, 0.5)])).collect()


def test_null_source_is_refused(spark, make_claims):
    trust = spark.createDataFrame([("s", "f", 0.7)], "source_id string, field string, trust double")
    claims = make_claims([GOOD[:6], (1, "f", "w", None, 1.0, 11)])
    with pytest.raises(Exception, match="null among"):
        tr.join_trust(claims, trust).collect()


def test_match_files_in_any_case(spark, tmp_path):
    (tmp_path / "train.csv").write_text("ltable_id,rtable_id,label\n1,2,1\n3,4,0\n")
    (tmp_path / "perfectMapping.csv").write_text("ltable_id,rtable_id,label\n5,6,True\n7,8,1\n")
    (tmp_path / "notes.csv").write_text("x\n1\n")
    assert [p.rsplit("/", 1)[1] for p in files.match_files(spark, f"file://{tmp_path}")] == ["perfectMapping.csv", "train.csv"]
    got = sorted(map(tuple, files.read_match_pairs(spark, f"file://{tmp_path}").collect()))
    assert got == [("1", "2"), ("5", "6"), ("7", "8")]
    with pytest.raises(ValueError):
        files.read_match_pairs(spark, f"file://{tmp_path}/none")


def test_null_values_keep_their_rows(spark):
    frame = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "b")], "id long, value string")
    assert sorted(map(tuple, dict_encode(frame).collect())) == [(1, 1), (2, -1), (3, 0), (4, 1)]


def test_loops_that_run_out_raise():
    with pytest.raises(ArithmeticError):
        beta.beta_cdf(np.array([0.5]), np.array([1e13]), np.array([1e13]))


def test_scopes_free_their_tables(spark):
    rows = spark.range(10).select("id")
    files_of = lambda path: spark._jvm.java.io.File(path.removeprefix("file:")).exists()
    with scratch():
        table = pin(rows)
        inner = pin(rows)
        assert files_of(table._pinned)
        release(inner)
        assert not files_of(inner._pinned)
    assert not files_of(table._pinned)


def test_components_write_four_tables_a_round(spark, monkeypatch):
    import corrobora.operators.components as components

    written = []
    original = components.pin
    monkeypatch.setattr(components, "pin", lambda df, name="pin": (None if getattr(df, "_pinned", None) else written.append(name)) or original(df, name))
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)], "left long, right long")
    roots = {r.node: r.root for r in component_roots(chain).collect()}
    assert roots == {k: 0 for k in range(1, 41)}
    rounds = written.count("least") // 2
    assert written.count("edges") == 1 + 2 * rounds and len(written) <= 1 + 4 * rounds


def test_a_hot_key_is_spread_in_proportion(spark):
    from collections import Counter

    from pyspark.sql import functions as F

    from corrobora.operators.joins import salted_join

    rows = spark.range(30_000).repartition(8).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), "id")
    lookup = rows.select("k").distinct().withColumn("v", F.col("k") * 2)
    before = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        for c, v in zip(before, ("false", "-1", "16")):
            spark.conf.set(c, v)
        joined = salted_join(rows, lookup, ["k"], "inner")
        placed = joined.select(F.spark_partition_id().alias("p"), "k", "id", "v").collect()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert len({r.id for r in placed}) == len(placed) == 30_000 and all(r.v == 2 * r.k for r in placed)
    sizes = Counter(r.p for r in placed)
    assert max(sizes.values()) <= 2 * 30_000 / 16
