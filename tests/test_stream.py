"""Micro-batches: replay safety, order of learning, and equality with the batch operators."""

import pytest
from pyspark.sql import functions as F

from corrobora.operators import fuse
from corrobora.operators.monitor import TrustPolicy, recovery_summary, windowed_evidence, windowed_trust
from corrobora.session import scratch_path
from corrobora.streaming.live import LiveFusion, batch_latency, bounded_claims, stream_rank


@pytest.fixture
def batches(make_claims):
    def batch(i):
        rows = [(c, "f", "v" if (c + s + i) % 3 else "w", f"s{s}", float(i), 100 * i + 10 * c + s, 0.5) for c in range(6) for s in range(4)]
        return make_claims(rows)

    return [batch(i) for i in range(3)]


@pytest.fixture
def silver(spark):
    return spark.createDataFrame([(c, "f", "v") for c in range(6)], "cluster_id long, field string, value string")


def live(spark, silver, **options):
    return LiveFusion(spark, scratch_path(spark, "live"), silver, label_fraction=1.0, **options)


def test_replayed_batch_counts_once(spark, batches, silver, rows_of):
    once, twice = live(spark, silver), live(spark, silver)
    for i, b in enumerate(batches):
        once.fuse_batch(b, i)
        twice.fuse_batch(b, i)
        if i == 1:
            twice.fuse_batch(b, i)
    for table in ("fused", "state", "metrics"):
        assert rows_of(once.tables[table].all()) == rows_of(twice.tables[table].all())
    evidence = once.tables["state"].get(2).agg(F.sum(F.col("succ") + F.col("fail"))).first()[0]
    assert evidence == 3 * 24


def test_first_batch_is_fused_with_the_prior(spark, batches, silver, rows_of):
    running = live(spark, silver)
    running.fuse_batch(batches[0], 0)
    even = fuse.vote_fuse(fuse.collapse_per_source(batches[0]).withColumn("trust", F.lit(0.5)))
    assert rows_of(running.tables["fused"].get(0)) == rows_of(even)


def test_states_of_all_batches_fuse_like_one_table(spark, batches, silver, rows_of):
    running = live(spark, silver)
    for i, b in enumerate(batches):
        running.keep_states(b, i)
    running.keep_states(batches[1], 1)
    everything = batches[0].union(batches[1]).union(batches[2])
    assert rows_of(running.canonical_by_rank()) == rows_of(fuse.rank_fuse(everything))
    assert rows_of(running.canonical_by_vote()) == rows_of(fuse.vote_fuse(everything))


def test_faded_state_equals_recomputation(spark, batches, silver):
    running = live(spark, silver, lam=0.7, mode="mean")
    for i, b in enumerate(batches):
        running.fuse_batch(b, i)
    import math

    succ = {}
    for i, b in enumerate(batches):
        for r in fuse.collapse_per_source(b).collect():
            succ.setdefault(r["source_id"], 0.0)
            if r["value"] == "v":
                succ[r["source_id"]] += math.exp(-0.7 * (2 - i))
    got = {r["source_id"]: r["succ"] for r in running.tables["state"].get(2).collect()}
    assert got == pytest.approx(succ, abs=1e-12)


def test_streaming_rank_and_watermark(spark, batches, rows_of):
    folder = scratch_path(spark, "in")
    for b in batches:
        b.withColumn("at", F.timestamp_seconds(F.col("ts") + 1e6)).coalesce(1).write.mode("append").parquet(folder)
    schema = spark.read.parquet(folder).schema
    stream = spark.readStream.schema(schema).parquet(folder)
    out = stream_rank(stream).writeStream.format("memory").queryName("ranked").outputMode("complete")
    running = out.trigger(availableNow=True).start()
    running.awaitTermination()
    everything = batches[0].union(batches[1]).union(batches[2])
    assert rows_of(spark.table("ranked")) == rows_of(fuse.rank_fuse(everything))
    unique = bounded_claims(stream.unionByName(stream), "at", "1 hour")
    running = unique.writeStream.format("memory").queryName("uniq").trigger(availableNow=True).start()
    running.awaitTermination()
    assert spark.table("uniq").count() == everything.count()


def test_window_trust_uses_only_the_past(spark):
    evidence = spark.createDataFrame([(1, "s", "f", 4.0, 0.0), (2, "s", "f", 0.0, 4.0)], "window int, source_id string, field string, succ double, fail double")
    policies = [TrustPolicy("plain"), TrustPolicy("frozen", per_source=True, freeze_after=1)]
    got = {(r["policy"], r["window"]): r["trust"] for r in windowed_trust(evidence, policies, 3).collect()}
    assert got == {("plain", 2): 6 / 8, ("plain", 3): 6 / 12, ("frozen", 2): 6 / 8, ("frozen", 3): 6 / 8}


def test_evidence_can_count_each_pair_once(spark, silver):
    prefixes = spark.createDataFrame([(w, 1, "f", "s", "v") for w in (1, 2, 3)], "as_of int, cluster_id long, field string, source_id string, value string")
    assert windowed_evidence(prefixes, silver).agg(F.sum("succ")).first()[0] == 3.0
    assert windowed_evidence(prefixes, silver, dedup=True).agg(F.sum("succ")).first()[0] == 1.0


def test_recovery_counts_windows_until_back(spark):
    scores = [(w, "m", f) for w, f in zip(range(1, 9), (0.9, 0.9, 1.0, 0.5, 0.7, 0.96, 0.9, 0.99))] + [(w, "n", 1.0 if w <= 3 else 0.2) for w in range(1, 9)]
    df = spark.createDataFrame(scores, "window int, policy string, F1 double")
    got = {r["policy"]: r for r in recovery_summary(df).collect()}
    assert got["m"]["recovery_windows"] == 3 and got["m"]["final_F1"] == 0.99
    assert got["n"]["recovery_windows"] is None


def test_folded_states_equal_all_batches(spark, batches, silver, rows_of):
    running = live(spark, silver)
    for table in running.tables.values():
        table.fold_every = 2
    for i, b in enumerate(batches):
        running.fuse_batch(b, i)
        running.keep_states(b, i)
    everything = batches[0].union(batches[1]).union(batches[2])
    assert running.tables["claims"]._snapshots().last() == 1
    assert rows_of(running.canonical_by_rank()) == rows_of(fuse.rank_fuse(everything))
    assert rows_of(running.canonical_by_vote()) == rows_of(fuse.vote_fuse(everything))
    merged = running.tables["claims"].merged()
    assert rows_of(fuse.collapse_state(merged)) == rows_of(fuse.collapse_per_source(everything))


def test_late_labels_count_like_early_ones(spark, batches, silver, rows_of):
    early, late = live(spark, silver), live(spark, silver.limit(0))
    everything = batches[0].union(batches[1]).union(batches[2])
    early.fuse_batch(everything, 0)
    for i, b in enumerate(batches):
        late.fuse_batch(b, i)
    for i in (0, 1, 1):  # the second batch of labels arrives twice
        late.learn_labels(silver.filter(F.col("cluster_id") % 2 == i), i)
    known = early.tables["state"].get(0).select("source_id", "field", "succ", "fail")
    assert rows_of(late.evidence()) == rows_of(known)


def test_latency_of_batches(spark, silver, batches):
    folder = scratch_path(spark, "in")
    for b in batches:
        b.coalesce(1).write.mode("append").parquet(folder)
    running_live = live(spark, silver)
    stream = spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(folder)
    running = running_live.start(stream).trigger(availableNow=True).start()
    running.awaitTermination()
    rows = batch_latency(running, spark).orderBy("batch").collect()
    assert [r.batch for r in rows] == [1, 2, 3] and all(r.batch_rows == 24 and r.latency_s > 0 for r in rows)
