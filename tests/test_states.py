import random

import pytest
from pyspark.sql import functions as F

from corrobora.operators.fuse import rank_merge, rank_state, vote_merge, vote_state
from corrobora.operators.states import StateTable
from corrobora.session import scratch_path

SCHEMA = "cluster_id long, field string, value string, source_id string, ts double, offer_id long, trust double"
KEYS = ["cluster_id", "field"]


def claims(spark, seed, n, clusters):
    rng = random.Random(seed)
    return spark.createDataFrame(
        [(rng.choice(clusters), "f", rng.choice("abc"), "s", float(k), seed * 1000 + k, rng.random()) for k in range(n)], SCHEMA
    )


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_versions_equal_states_of_all_claims_so_far(spark):
    first, second = claims(spark, 1, 200, range(50)), claims(spark, 2, 60, range(40, 70))
    both = first.unionByName(second)
    ranks = StateTable.create(rank_state(first), scratch_path(spark, "ranks"), KEYS, 16)
    assert ranks.upsert(rank_state(second), rank_merge) == 2
    assert rows(ranks.read()) == rows(rank_state(both)) and rows(ranks.read(1)) == rows(rank_state(first))
    votes = StateTable.create(vote_state(first), scratch_path(spark, "votes"), [*KEYS, "value"], 16)
    votes.upsert(vote_state(second), vote_merge)
    assert rows(votes.read()) == rows(vote_state(both))
    assert votes.read().schema["votes"].dataType == votes.read(1).schema["votes"].dataType


def test_a_merge_reads_and_writes_its_own_buckets_only(spark):
    table = StateTable.create(rank_state(claims(spark, 1, 2000, range(800))), scratch_path(spark, "ranks"), KEYS, 200)
    before = table.holders()
    delta = rank_state(claims(spark, 2, 8, [5, 6]))
    touched = table.touched(delta)
    assert 1 <= len(touched) <= 2
    assert {f.split("_bucket=")[1].split("/")[0] for f in table._rows(touched).inputFiles()} == {str(b) for b in touched}
    table.upsert(delta, rank_merge)
    after = table.holders()
    assert {b for b in after if after[b] == 2} == set(touched)
    assert all(after[b] == before[b] for b in before if b not in touched)


def test_empty_states_and_an_unfinished_version(spark):
    some = rank_state(claims(spark, 1, 20, range(5)))
    table = StateTable.create(some.limit(0), scratch_path(spark, "ranks"), KEYS, 4)
    assert rows(table.read()) == [] and table.upsert(some.limit(0), rank_merge) == 2
    some.write.parquet(f"{table.path}/data/version=3/_bucket=0")  # rows without a list, as a lost driver leaves them
    assert rows(table.read()) == [] and table.upsert(some, rank_merge) == 3
    assert rows(table.read()) == rows(some)
    with pytest.raises(ValueError):
        StateTable.create(some, scratch_path(spark, "ranks"), KEYS, 0)
