"""Trust as keyed state of the engine, and labels joined to claims within an interval."""

import pytest
from pyspark.sql import functions as F

from corrobora.session import scratch_path
from corrobora.streaming.keyed import KeyedFusion, collapsed, late_outcomes
from corrobora.streaming.live import LiveFusion

SILVER = "cluster_id long, field string, value string"


def rows(i):
    """A batch in which one source holds a third of the claims, with repeats, ties and a null value."""
    out = [(c, "f", "vwx"[(c * s + i) % 3], f"s{s}", float(i + s % 2), 100 * i + 10 * c + s) for c in range(8) for s in range(4)]
    out += [(c, "f", "vw"[c % 2], "s0", float(i), 1000 + 100 * i + c) for c in range(8)] + [(3, "f", None, "s2", 9.0 + i, 5000 + i)]
    return out


def arrive(make_claims, folder, i):
    make_claims(rows(i)).withColumn("batch", F.lit(i)).coalesce(1).write.mode("append").parquet(folder)


def stream_of(spark, folder):
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.fixture
def silver(spark):
    return spark.createDataFrame([(c, "f", "v") for c in range(6)], SILVER)


def test_keyed_state_equals_written_state_over_a_restart(spark, make_claims, silver, rows_of):
    folder, root = scratch_path(spark, "in"), scratch_path(spark, "keyed")
    live = LiveFusion(spark, scratch_path(spark, "live"), silver, label_fraction=1.0)
    keyed = KeyedFusion(spark, root, silver, F.lit(True))
    for i in range(4):
        live.fuse_batch(make_claims(rows(i)), i)
    for stop in ((0, 1), (2, 3)):  # the query ends and is started again from its checkpoint
        for i in stop:
            arrive(make_claims, folder, i)
        keyed.start(stream_of(spark, folder)).awaitTermination()
    columns = ["batch_id", "cluster_id", "field", "value"]
    assert rows_of(keyed.fused.all().select(columns)) == rows_of(live.tables["fused"].all().select(columns))
    for b in (0, 3):
        assert rows_of(keyed.evidence(b)) == rows_of(live.tables["state"].get(b).select("source_id", "field", "succ", "fail"))
    assert rows_of(keyed.evidence()) == rows_of(keyed.evidence(3))
    names = ["batch_id", "batch_rows", "F1", "n_eval", "updates"]
    assert rows_of(keyed.metrics().select(names)) == rows_of(live.tables["metrics"].all().select(names))


def test_a_replayed_batch_counts_once(spark, make_claims, silver, rows_of):
    folder, root = scratch_path(spark, "in"), scratch_path(spark, "keyed")
    keyed = KeyedFusion(spark, root, silver, F.lit(True))
    fail = {1}

    def once(heard, batch_id):
        keyed.fuse_batch(heard, batch_id)
        if batch_id in fail:
            fail.discard(batch_id)
            raise RuntimeError("lost after writing")

    failing = KeyedFusion(spark, root, silver, F.lit(True))
    failing.fuse_batch = once
    for i in range(3):
        arrive(make_claims, folder, i)
    with pytest.raises(Exception, match="lost after writing"):
        failing.start(stream_of(spark, folder)).awaitTermination()
    keyed.start(stream_of(spark, folder)).awaitTermination()
    evidence = keyed.evidence().agg(F.sum(F.col("succ") + F.col("fail"))).first()[0]
    assert evidence == sum(r["updates"] for r in keyed.metrics().collect()) > 0
    assert [r["batch_rows"] for r in keyed.metrics().orderBy("batch_id").collect()] == [41, 41, 41]


def test_null_key_fails_the_query_and_hidden_labels_teach_nothing(spark, make_claims, silver):
    folder = scratch_path(spark, "in")
    arrive(make_claims, folder, 0)
    blind = KeyedFusion(spark, scratch_path(spark, "keyed"), silver, F.lit(False))
    blind.start(stream_of(spark, folder)).awaitTermination()
    assert blind.evidence().count() == 0 and blind.metrics().first()["updates"] == 0
    make_claims([(None, "f", "v", "s", 1.0, 1)]).withColumn("batch", F.lit(1)).write.mode("append").parquet(folder)
    with pytest.raises(Exception, match="null cluster_id"):
        blind.start(stream_of(spark, folder)).awaitTermination()


def test_collapse_within_a_key():
    claims = [(1, "a", 1.0, 1, "a", True), (1, "b", 2.0, 2, "a", True), (1, "b", 0.0, 3, "a", True), (2, "a", 1.0, 1, None, False), (2, "b", 1.0, 1, None, False), (3, None, 1.0, 1, None, False)]
    assert [*collapsed(claims)] == [(1, "b", "a", True, 3), (2, "b", None, False, 2), (3, None, None, False, 1)]


def test_late_labels_join_within_the_interval(spark, make_claims, rows_of):
    claims_in, labels_in, checkpoint = (scratch_path(spark, n) for n in ("claims", "labels", "checkpoint"))
    day = 86400.0

    def claim(*claims):
        timed = make_claims([(c, "f", v, s, t * day, 0) for c, v, s, t in claims]).withColumn("at", F.timestamp_seconds("ts"))
        timed.coalesce(1).write.mode("append").parquet(claims_in)

    def label(*labels):
        frame = spark.createDataFrame([(c, "f", v, t * day) for c, v, t in labels], SILVER + ", t double")
        frame.withColumn("told", F.timestamp_seconds("t")).coalesce(1).write.mode("append").parquet(labels_in)

    found = []

    def run():
        joined = late_outcomes(stream_of(spark, claims_in), stream_of(spark, labels_in), "at", "told", "5 DAYS", "2 DAYS")
        sink = joined.writeStream.foreachBatch(lambda df, _: found.extend(map(tuple, df.select("cluster_id", "source_id", "x").collect())))
        query = sink.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]][-1:]

    claim((1, "v", "a", 10), (1, "w", "b", 11), (2, "v", "a", 10))
    label((1, "v", 12), (3, "v", 12))
    run()
    assert sorted(found) == [(1, "a", 1), (1, "b", 0)]
    label((2, "w", 16))  # six days after the claim
    claim((4, "v", "a", 40))
    label((5, "v", 40))
    kept = run()
    assert sorted(found) == [(1, "a", 1), (1, "b", 0)]
    assert kept[0] <= 2  # what no label can meet any more is gone
    label((4, "v", 41))
    run()
    assert sorted(found) == [(1, "a", 1), (1, "b", 0), (4, "a", 1)]
