import random

from pyspark.sql import functions as F

from corrobora.operators.fuse import collapse_per_source
from corrobora.operators.intervals import at_windows, claim_intervals, interval_evidence, interval_labels
from corrobora.operators.monitor import prefix_claims, resolved_labels, windowed_evidence

N = 6
SCHEMA = "cluster_id long, field string, value string, source_id string, ts double, offer_id long, window int"
COLUMNS = ["cluster_id", "field", "source_id", "value", "ts", "offer_id"]


def claims(spark, seed=3, n=400):
    rng = random.Random(seed)
    rows = [
        (rng.randrange(12), rng.choice("fg"), rng.choice("abc"), f"s{rng.randrange(5)}", float(rng.randrange(9)), k, rng.randrange(1, N + 1))
        for k in range(n)
    ]
    return spark.createDataFrame(rows + rows[:20], SCHEMA)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_every_prefix_as_collapsed_by_itself(spark):
    frame = claims(spark).cache()
    got = at_windows(claim_intervals(frame, N)).cache()
    for w in range(1, N + 1):
        want = collapse_per_source(frame.filter(F.col("window") <= w))
        assert rows(got.filter(F.col("as_of") == w), *COLUMNS) == rows(want, *COLUMNS)
    assert rows(prefix_claims(frame, N), "as_of", *COLUMNS) == rows(got, "as_of", *COLUMNS)


def test_evidence_and_labels_as_from_copies(spark):
    frame = claims(spark, 4)
    silver = spark.createDataFrame([(c, f, "a") for c in range(0, 12, 2) for f in "fg"], "cluster_id long, field string, value string")
    intervals = claim_intervals(frame, N).cache()
    copies = at_windows(intervals)
    columns = ["window", "source_id", "field", "succ", "fail"]
    assert rows(interval_evidence(intervals, silver, N), *columns) == rows(windowed_evidence(copies, silver), *columns)
    labels = ["as_of", "cluster_id", "field", "value"]
    assert rows(interval_labels(silver, intervals, N), *labels) == rows(resolved_labels(silver, copies, ["as_of"]), *labels)


def test_rows_grow_with_changes_not_with_windows(spark):
    frame = claims(spark).withColumn("window", F.lit(1))
    pairs = frame.select("cluster_id", "field", "source_id").distinct().count()
    for n in (1, 5, 50):
        assert claim_intervals(frame, n).count() == pairs
    assert claim_intervals(frame.limit(0), N).count() == 0


def test_repeated_claims_of_one_value_are_one_interval_unless_newer(spark):
    rows_ = [(1, "f", "a", "s", 5.0, 9, w) for w in (1, 3, 4)] + [(1, "f", "b", "s", 5.0, 1, 2)] + [(1, "f", "a", "s", 6.0, 2, 6)]
    got = claim_intervals(spark.createDataFrame(rows_, SCHEMA), N)
    assert rows(got, "value", "ts", "offer_id", "since", "until") == [("a", 5.0, 9, 1, 5), ("a", 6.0, 9, 6, 6)]
