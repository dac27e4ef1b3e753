"""Records dealt by group, claims that then stay where they are, bucket files read in their order."""

import datetime

import pytest
from pyspark.sql import functions as F

from corrobora.operators import discovery, fuse, prepare as pp
from corrobora.plans.catalog import QUERIES
from corrobora.session import bucketed, pin

IDS = ["cluster_id", "source_id", "ts", "offer_id"]


@pytest.fixture
def records(spark):
    rows = [(k % 40 if k % 50 else None, f"s{k * 7 % 11}", float(k % 13), k, "AB"[k % 2], None if k % 9 == 0 else str(k % 5)) for k in range(800)]
    return spark.createDataFrame(rows, "cluster_id long, source_id string, ts double, offer_id long, x string, y string")


def moves(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


def claims_of(records):
    return pp.unpivot_claims(records, IDS, ["x", "y"], None).withColumn("trust", F.col("offer_id") % 16 / 16.0)


@pytest.mark.parametrize("operator", [fuse.rank_fuse, fuse.vote_fuse, fuse.vote_share, fuse.vote_fuse_float, fuse.collapse_per_source])
def test_fusing_claims_of_dealt_records_is_one_exchange(records, rows_of, operator):
    dealt = operator(claims_of(pp.deal_groups(records)))
    assert len(moves(dealt)) == 1 and "REPARTITION" in moves(dealt)[0]
    assert rows_of(dealt) == rows_of(operator(claims_of(records)))


def test_collapse_and_rank_after_it_share_the_exchange(records):
    dealt = claims_of(pp.deal_groups(records))
    assert len(moves(fuse.rank_fuse(fuse.collapse_per_source(dealt), ["ts", "offer_id", "value"]))) == 1


def test_a_group_with_a_third_of_the_records_is_not_dealt_to_one_task(records, monkeypatch, rows_of):
    monkeypatch.setattr(pp, "GROUP_RECORDS", 30)
    hot = records.withColumn("cluster_id", F.when(F.col("offer_id") % 3 == 0, 7).otherwise(F.col("cluster_id")))
    dealt = pp.deal_groups(hot)
    assert moves(dealt) == []
    assert rows_of(fuse.vote_fuse(claims_of(dealt))) == rows_of(fuse.vote_fuse(claims_of(hot)))
    assert moves(pp.deal_groups(records)) != []


def test_parts_grow_with_the_table(records):
    cores = records.sparkSession.sparkContext.defaultParallelism
    assert pp.deal_groups(records).rdd.getNumPartitions() == cores
    assert pp.deal_groups(records, part=10).rdd.getNumPartitions() == 79  # 784 records with a group
    assert pp.deal_groups(records.limit(0)).count() == 0


def test_rounds_of_truth_discovery_neither_sort_nor_hash_claims(records):
    collapsed = fuse.collapse_per_source(claims_of(records))
    keys = ["cluster_id", "field"]
    with bucketed(collapsed, keys, ["value"]) as claims:
        weights = claims.select("source_id").distinct().withColumn("trust", F.lit(0.8))
        plan = discovery._hits(claims, weights, keys, ["source_id"])._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Sort [" not in plan
        assert all("value" not in line.split("functions")[0] for line in plan.splitlines() if " HashAggregate(keys=" in line)


@pytest.fixture
def line_folder(spark, tmp_path):
    day = datetime.datetime(2000, 1, 1)
    lines = [(k // 4, k % 30, k * 7 % 11, k % 4, 0.01 * (k % 5), 0.02, "AN"[k % 2], "FO"[k % 2], day) for k in range(400)]
    columns = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame(lines, columns).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def test_the_fingerprint_deals_records_not_claims(spark, line_folder):
    found = QUERIES["fingerprint"](spark, line_folder)
    dealt = [line for line in moves(found) if "REPARTITION_BY_NUM" in line and ", 13)" in line]
    assert dealt and all("_orderkey" in line or "offer_id" in line for line in dealt)
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    place = [next(i for i, line in enumerate(plan) if word in line) for word in ("Generate inline", "RepartitionByExpression [offer_id")]
    assert place[0] < place[1]
    same = dict.fromkeys(["rank_equal", "vote_equal", "methods_equal"], True)  # each part's lines agree here
    assert found.first().asDict() == {"rows": 120, "same_rows": 120} | same


def test_the_audit_of_plans_leaves_only_digests_to_read(spark, line_folder):
    audit = QUERIES["plan_invariance"](spark, line_folder)
    assert all("/digest-" in name for name in audit.inputFiles())
    assert sorted(map(tuple, audit.collect())) == sorted((m, p, True) for m in ("rank", "vote", "collapse") for p in (3, 16, 64))


def test_parts_of_a_group_do_not_grow_with_the_table(records):
    known = records.dropna(subset=["cluster_id"])
    for part, slices in ((1000, 1), (20, 14)):  # 784 records
        dealt = pp.deal_parts(known, 3, F.col("offer_id"), part=part)
        assert dealt.rdd.getNumPartitions() == 3 * slices
        placed = dealt.withColumn("place", F.spark_partition_id()).collect()
        places = {}
        for r in placed:
            places.setdefault(r.cluster_id, set()).add(r.place)
        assert all(len(p) == 3 and {x % 3 for x in p} == {0, 1, 2} for p in places.values())
        assert sorted(r.offer_id for r in placed) == sorted(r.offer_id for r in known.collect())
    assert pp.deal_parts(records, 3, F.col("offer_id")).count() == 800 and pp.deal_parts(records.limit(0), 3, F.col("offer_id")).count() == 0


def test_the_audit_of_plans_deals_records_over_more_tasks_in_larger_tables(spark, line_folder, monkeypatch):
    seen = []

    def noted(found):
        seen.append(found)
        return found

    from corrobora.plans import monitor_queries as mq

    monkeypatch.setattr(mq, "deal_parts", lambda *args: noted(pp.deal_parts(*args, part=10)), raising=False)
    assert all(r.same for r in QUERIES["plan_invariance"](spark, line_folder).collect())
    assert [d.rdd.getNumPartitions() for d in seen] == [3 * 14, 16 * 3, 64]  # 400 records
    assert all("field" not in d.columns for d in seen)


def test_the_fingerprint_of_a_large_table_is_taken_in_passes(spark, line_folder, monkeypatch):
    from corrobora.plans import fusion_queries as fq

    whole = QUERIES["fingerprint"](spark, line_folder).first()
    digests = {r.kind: (r.rows, r.digest_sum) for r in fq._prints(spark, line_folder).collect()}
    taken = []

    def noted(df, name):
        taken.append(pin(df, name))
        return taken[-1]

    monkeypatch.setattr(fq, "PASS_RECORDS", 150)  # of 400 records
    monkeypatch.setattr(fq, "pin", noted)
    found = QUERIES["fingerprint"](spark, line_folder)
    assert found.first() == whole
    assert len(taken) == 3 and all("/prints-" in name for name in found.inputFiles())
    passes = [{r.kind: (r.rows, r.digest_sum) for r in t.collect()} for t in taken]
    assert all(p["rank"][0] for p in passes)
    for kind, (rows, digest) in digests.items():
        assert rows == sum(p[kind][0] for p in passes) and int(digest) == sum(int(p[kind][1]) for p in passes)
