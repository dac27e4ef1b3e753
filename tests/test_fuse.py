"""Fusion operators against hand-made cases and brute force."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corrobora.operators import discovery, fuse, silver as sv
from corrobora.operators.discovery import discover_truth
from corrobora.plans import methods as me
from corrobora.schema import validate_claims
from corrobora.session import bucketed


def random_claims(seed, n=600, hot=0.33):
    """Claims of which a third sits in one group and many come from one source."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        cluster = 0 if rng.random() < hot else rng.randrange(1, 40)
        field = "a" if cluster == 0 else rng.choice("ab")
        source = "s0" if rng.random() < hot else f"s{rng.randrange(8)}"
        rows.append((cluster, field, rng.choice("uvwxyz"), source, float(rng.randrange(5)), rng.randrange(50), rng.randrange(17) / 16))
    return rows


def by_group(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[0], r[1]].append(r)
    return groups


@pytest.mark.parametrize("seed", range(3))
def test_rank_is_the_greatest_tuple(make_claims, rows_of, seed):
    rows = random_claims(seed)
    want = sorted((*g, max(rs, key=lambda r: (r[6], r[4], r[2], r[5]))[2]) for g, rs in by_group(rows).items())
    assert rows_of(fuse.rank_fuse(make_claims(rows))) == want


@pytest.mark.parametrize("seed", range(3))
def test_vote_sums_weights_and_breaks_ties_upwards(make_claims, rows_of, seed):
    rows = random_claims(seed)
    want = []
    for g, rs in by_group(rows).items():
        total = Counter()
        for r in rs:
            total[r[2]] += round(r[6] * 2**32)
        want.append((*g, max(total, key=lambda v: (total[v], v))))
    claims = make_claims(rows)
    assert rows_of(fuse.vote_fuse(claims)) == sorted(want)
    assert rows_of(fuse.vote_fuse_float(claims)) == sorted(want)


@pytest.mark.parametrize("seed", range(2))
def test_collapse_takes_the_modal_value(make_claims, rows_of, seed):
    rows = random_claims(seed)
    cells = defaultdict(lambda: defaultdict(list))
    for r in rows:
        cells[r[0], r[1], r[3]][r[2]].append(r)
    want = []
    for key, values in cells.items():
        score = {v: (len(rs), max(r[4] for r in rs), max(r[5] for r in rs), v) for v, rs in values.items()}
        best = max(score.values())
        want.append((*key, best[3], best[1], best[2]))
    assert rows_of(fuse.collapse_per_source(make_claims(rows))) == sorted(want)


def test_ties_go_to_the_greatest_value(make_claims, rows_of):
    claims = make_claims([(1, "f", v, s, 1.0, 1, 0.5) for v, s in (("a", "x"), ("c", "y"), ("b", "z"))])
    assert rows_of(fuse.vote_fuse(claims)) == [(1, "f", "c")]
    assert rows_of(fuse.rank_fuse(claims)) == [(1, "f", "c")]


def test_fixed_point_rounds_half_to_even_and_outgrows_64_bits(spark):
    unit = 2.0**-32
    df = spark.createDataFrame([(0.5 * unit,), (1.5 * unit,), (2.5 * unit,)], "w double")
    assert [int(r[0]) for r in df.select(fuse.fixed_point(F.col("w"))).collect()] == [0, 2, 2]
    big = spark.range(4).select(F.lit(1).alias("cluster_id"), F.lit("f").alias("field"), F.lit("v").alias("value"), F.lit(2.0**30).alias("trust"))
    assert fuse.vote_state(big).first()["votes"] == 4 * 2**62


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_states_merge_to_the_whole(make_claims, rows_of, parts):
    rows = random_claims(7)
    claims = make_claims(rows)
    rng = random.Random(parts)
    piles = [[] for _ in range(parts)]
    for r in rows:
        rng.choice(piles).append(r)
    pieces = [make_claims(p) for p in piles if p]
    merged = fuse.rank_merge(*[fuse.rank_state(p) for p in pieces])
    assert rows_of(merged) == rows_of(fuse.rank_state(claims))
    votes = fuse.vote_merge(*[fuse.vote_state(p) for p in pieces])
    assert rows_of(fuse.vote_winner(votes)) == rows_of(fuse.vote_fuse(claims))


def test_partitioning_does_not_change_the_print(make_claims):
    claims = make_claims(random_claims(5))
    for operator in (fuse.rank_fuse, fuse.vote_fuse):
        prints = {fuse.fingerprint(operator(claims.repartition(p))).first() for p in (1, 5, 32)}
        assert len(prints) == 1


def test_extra_constant_coordinates_change_nothing(make_claims, rows_of):
    claims = make_claims(random_claims(2)).withColumn("q", F.lit(0.0))
    wide = fuse.rank_fuse(claims, policy=["trust", "ts", "q", "value", "offer_id"])
    assert rows_of(wide) == rows_of(fuse.rank_fuse(claims))


def test_share_and_abstention(make_claims, rows_of):
    claims = make_claims([(1, "f", "a", "x", 1.0, 1, 0.75), (1, "f", "b", "y", 1.0, 2, 0.25), (2, "f", "a", "x", 1.0, 1, 0.0)])
    won = fuse.vote_share(claims)
    assert rows_of(won) == [(1, "f", "a", 0.75), (2, "f", "a", 0.0)]
    assert rows_of(fuse.abstain(won, 0.75).filter("value is null").drop("value")) == [(2, "f", 0.0)]


def test_recency_ignores_trust(make_claims, rows_of):
    claims = make_claims([(1, "f", "old", "x", 1.0, 9), (1, "f", "new", "y", 2.0, 1), (1, "f", "also", "z", 2.0, 2)])
    assert rows_of(me.recency_first(claims)) == [(1, "f", "also")]


@pytest.mark.parametrize("k,want", [(10, []), (3, [(1, "f", "v")])])
def test_silver_needs_count_and_share(make_claims, rows_of, k, want):
    """Two of seven panel sources agree: enough sources, but less than a third of them."""
    rows = [(1, "f", "v" if i < 2 else f"o{i}", f"s{i}", 1.0, i) for i in range(7)]
    claims = make_claims(rows)
    assert rows_of(sv.silver_labels(claims, k=k)) == want
    assert rows_of(sv.silver_labels(claims, k=k, one_claim_per_source=True)) == want


def test_silver_of_raw_claims_counts_sources_once(make_claims, rows_of):
    rows = [(1, "f", "v", "s1", 1.0, 1), (1, "f", "v", "s1", 1.0, 2), (1, "f", "w", "s2", 1.0, 3), (1, "f", "w", "s3", 1.0, 4)]
    assert rows_of(sv.silver_labels(make_claims(rows))) == [(1, "f", "w")]


def test_panel_ties_go_to_the_smaller_source(make_claims, rows_of):
    rows = [(c, "f", "v", s, 1.0, c) for s in ("b", "a", "c") for c in (1, 2)] + [(3, "f", "v", "c", 1.0, 3)]
    assert rows_of(sv.gold_panel(make_claims(rows), 2)) == [("f", "a"), ("f", "c")]


def test_validate_refuses_nulls_and_bad_trust(make_claims):
    good = make_claims([(1, "f", "v", "s", 1.0, 1, 0.5)])
    assert validate_claims(good) is good
    for bad in ((1, None, "v", "s", 1.0, 1, 0.5), (1, "f", "v", "s", float("nan"), 1, 0.5), (1, "f", "v", "s", 1.0, 1, -0.1)):
        with pytest.raises(ValueError):
            validate_claims(make_claims([bad]))
    with pytest.raises(ValueError):
        validate_claims(good.drop("ts"))


def test_truth_discovery_against_plain_rounds(make_claims, rows_of):
    rows = [r[:6] for r in random_claims(11)]
    collapsed = fuse.collapse_per_source(make_claims(rows))
    claims = [r.asDict() for r in collapsed.collect()]
    weight = {c["source_id"]: 0.8 for c in claims}
    for _ in range(10):
        total = defaultdict(Counter)
        for c in claims:
            total[c["cluster_id"], c["field"]][c["value"]] += round(weight[c["source_id"]] * 2**32)
        truth = {g: max(t, key=lambda v: (t[v], v)) for g, t in total.items()}
        hits = defaultdict(list)
        for c in claims:
            hits[c["source_id"]].append(truth[c["cluster_id"], c["field"]] == c["value"])
        weight = {s: (sum(h) + 1.0) / (len(h) + 2.0) for s, h in hits.items()}
    want = sorted((*g, v) for g, v in truth.items())
    assert rows_of(me.em_truth(collapsed)) == want
    for most in (0.0, 2.0):  # every round votes on everything, or on the touched groups only
        found, report = discover_truth(collapsed, 10, 0.8, most=most)
        assert rows_of(found) == want
        assert [r.full for r in report.collect()][:-1] == [most == 0.0] * (report.count() - 1)
    lines = report.collect()
    assert [r.round for r in lines] == [*range(1, len(lines) + 1)] and all(r.sources for r in lines[:-1])


def test_truth_discovery_takes_joined_and_empty_tables_and_freezes_small_moves(make_claims, rows_of, spark):
    rows = [r[:6] for r in random_claims(5)]
    collapsed = fuse.collapse_per_source(make_claims(rows))
    joined = collapsed.join(spark.range(3).withColumn("seed", F.col("id") + 0), F.lit(True)).drop("id")
    want = rows_of(me.em_truth(collapsed))
    assert rows_of(me.em_truth(joined, by=["seed"])) == sorted((s, *r) for r in want for s in range(3))
    truth, report = discover_truth(collapsed.limit(0), 10, 0.8)
    assert truth.collect() == [] and [r.sources for r in report.collect()] == [0]
    loose, report = discover_truth(collapsed, 10, 0.8, bound=1.0)
    assert report.count() == 1 and rows_of(loose) == rows_of(me.cluster_majority(collapsed))


def test_votes_of_truth_discovery_shuffle_no_claims(make_claims):
    collapsed = fuse.collapse_per_source(make_claims([r[:6] for r in random_claims(5)]))
    keys = ["cluster_id", "field"]
    with bucketed(collapsed, keys) as claims:
        weights = claims.select("source_id").distinct().withColumn("trust", F.lit(0.8)).withColumn("before", F.lit(0.7))
        for hits in (discovery._hits, discovery._gained):
            plan = hits(claims, weights, keys, ["source_id"])._jdf.queryExecution().executedPlan().toString()
            moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
            assert moved and all("source_id" in line for line in moved)
            assert "SortMergeJoin" in plan


def test_learned_trust_beats_majority_on_planted_truth(spark):
    """Two good sources against three that repeat one wrong value half of the time."""
    rng = random.Random(3)
    rows = []
    for c in range(400):
        for s in range(5):
            right = rng.random() < (0.95 if s < 2 else 0.45)
            rows.append((c, "f", "true" if right else "wrong", f"s{s}", 1.0, c * 5 + s))
    from corrobora.operators import trust as tr
    from corrobora.schema import CLAIMS

    claims = spark.createDataFrame(rows, CLAIMS)
    truth = claims.select("cluster_id", "field").distinct().withColumn("value", F.lit("true"))
    train, test = truth.filter("cluster_id < 150"), truth.filter("cluster_id >= 150")
    from corrobora.operators.evaluate import accuracy

    trust = tr.trust_table(tr.trust_counts(tr.adjudicate(claims, train)), "lcb")
    learned = accuracy(me.trust_vote(claims, trust), test).first()[0]
    majority = accuracy(me.cluster_majority(claims), test).first()[0]
    assert learned > majority + 0.05
