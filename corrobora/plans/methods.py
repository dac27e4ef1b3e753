"""Fusion methods, and jobs that learn and score many of them at once."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from corrobora.functions.ids import portable_hash
from corrobora.operators.discovery import discover_truth
from corrobora.operators.evaluate import quality
from corrobora.operators.fuse import collapse_per_source, fixed_point, rank_fuse, vote_fuse
from corrobora.operators.joins import lookup_join
from corrobora.operators.order import with_row_index
from corrobora.operators.silver import PANEL_SIZE, gold_panel, silver_labels
from corrobora.operators.trust import (
    DELTA,
    adjudicate,
    decay_weight,
    hit_rate,
    join_trust,
    trust_counts,
    trust_table,
)
from corrobora.schema import GROUP, SOURCE_FIELD
from corrobora.session import pin

# Decay rate per unit of ts, start weight and rounds of truth discovery,
# the weight of a source without evidence.
LAMBDA = 3.0
EM_INIT = 0.8
EM_ROUNDS = 10
COLD = 0.5
#: Cells of a grid that one aggregation takes.
CELLS = 32

RECENCY_POLICY = ("ts", "offer_id", "value")
RANK_METHODS = ("source_priority", "rank_mean", "rank_map", "rank_lcb")
VOTE_METHODS = (
    "cluster_majority",
    "weighted_vote_global",
    "weighted_vote_field",
    "vote_mean",
    "vote_lcb",
    "vote_decay",
    "vote_lcb_decay",
    "oracle_bound",
)
METHODS = ("recency_first", "em_truth", *RANK_METHODS, *VOTE_METHODS)


def prepare(claims: DataFrame, k: int = PANEL_SIZE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Collapsed claims, silver labels and gold panel, each written once for reuse."""
    collapsed = pin(collapse_per_source(claims), "collapsed")
    panel = pin(gold_panel(collapsed, k), "panel")
    silver = pin(silver_labels(collapsed, panel, one_claim_per_source=True), "silver")
    return collapsed, silver, panel


# --------------------------------------------------------- single methods
def recency_first(claims: DataFrame) -> DataFrame:
    """The newest claim wins; ties by offer id, then value."""
    return rank_fuse(claims, RECENCY_POLICY)


def cluster_majority(claims: DataFrame) -> DataFrame:
    """Unweighted vote."""
    return vote_fuse(claims.withColumn("trust", F.lit(1.0)))


def source_priority(claims: DataFrame, adjudications: DataFrame) -> DataFrame:
    """Rank by the source's smoothed hit rate over all fields."""
    return rank_fuse(join_trust(claims, hit_rate(adjudications), COLD, by=["source_id"]))


def weighted_vote_global(claims: DataFrame, adjudications: DataFrame) -> DataFrame:
    """Vote with one smoothed hit rate per source."""
    return vote_fuse(join_trust(claims, hit_rate(adjudications), COLD, by=["source_id"]))


def weighted_vote_field(claims: DataFrame, adjudications: DataFrame) -> DataFrame:
    """Vote with the plain hit rate of each (source, field)."""
    return vote_fuse(join_trust(claims, hit_rate(adjudications, SOURCE_FIELD, smooth=False), COLD))


def oracle_bound(claims: DataFrame, test_adjudications: DataFrame) -> DataFrame:
    """Vote with smoothed (source, field) rates learned on the test labels: an upper bound only."""
    return vote_fuse(join_trust(claims, hit_rate(test_adjudications, SOURCE_FIELD), COLD))


def trust_rank(claims: DataFrame, trust: DataFrame) -> DataFrame:
    """Rank by trust, then time, value and offer id."""
    return rank_fuse(join_trust(claims, trust))


def trust_vote(claims: DataFrame, trust: DataFrame) -> DataFrame:
    """Vote weighted by trust."""
    return vote_fuse(join_trust(claims, trust))


def em_truth(
    collapsed: DataFrame, n_iter: int = EM_ROUNDS, init: float = EM_INIT, by: Sequence[str] = ()
) -> DataFrame:
    """Iterative truth discovery: vote, re-weigh each source by its agreement, repeat; the last vote.

    See :func:`corrobora.operators.discovery.discover_truth`.
    """
    return discover_truth(collapsed, n_iter, init, by)[0]


# ------------------------------------------------------------ many methods
def cluster_split(silver: DataFrame, n_trust: int, seeds: Sequence[int] = (0,)) -> DataFrame:
    """(seed, cluster_id, part): per seed, the first ``n_trust`` clusters in hash order are ``train``, others ``test``."""
    clusters = silver.select("cluster_id").distinct()
    seeded = clusters.withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
    hashed = seeded.withColumn("_hash", portable_hash(F.col("seed"), F.col("cluster_id")))
    ordered = with_row_index(hashed, ["seed", "_hash", "cluster_id"], "_place")
    place = F.col("_place") % (F.col("_place_total") / len(seeds)).cast("long")
    part = F.when(place < n_trust, "train").otherwise("test")
    return ordered.select("seed", "cluster_id", part.alias("part"))


def method_weights(
    methods: Sequence[str],
    adjudications: DataFrame,
    pairs: DataFrame,
    by: Sequence[str],
    decay=None,
    delta: float = DELTA,
    test_adjudications: DataFrame | None = None,
) -> DataFrame:
    """Learned weights of the given methods: (by, method, source_id, field, trust).

    ``pairs`` lists the (source, field) combinations, over which weights per
    source are spread. ``decay`` is the weight column of the decayed counts.
    """
    fine = [*by, *SOURCE_FIELD]
    counts = pin(trust_counts(adjudications, by=fine), "counts")
    wanted = set(methods)

    def per_source():
        return hit_rate(adjudications, [*by, "source_id"]).join(pairs, "source_id")

    def faded():
        return trust_counts(adjudications, decay, by=fine)

    recipes = {
        "source_priority": per_source,
        "weighted_vote_global": per_source,
        "weighted_vote_field": lambda: hit_rate(adjudications, fine, smooth=False),
        "rank_mean": lambda: trust_table(counts, "mean", by=fine),
        "rank_map": lambda: trust_table(counts, "map", by=fine),
        "rank_lcb": lambda: trust_table(counts, "lcb", delta, by=fine),
        "vote_mean": lambda: trust_table(counts, "mean", by=fine),
        "vote_lcb": lambda: trust_table(counts, "lcb", delta, by=fine),
        "vote_decay": lambda: trust_table(faded(), "mean", by=fine),
        "vote_lcb_decay": lambda: trust_table(faded(), "lcb", delta, by=fine),
        "oracle_bound": lambda: hit_rate(test_adjudications, fine),
    }
    tables = [
        recipe().select(*by, F.lit(name).alias("method"), *SOURCE_FIELD, "trust")
        for name, recipe in recipes.items()
        if name in wanted
    ]
    return pin(reduce(DataFrame.unionByName, tables), "weights")


def grid_weights(weights: DataFrame, by: Sequence[str], cells: Sequence[tuple]) -> DataFrame:
    """One row per (source, field) with ``w``: an array of the weight in each cell of the grid.

    ``cells`` lists the values of ``by``. A cell without evidence has weight 0.5, or 1 for the majority vote.
    """
    place = spread_cells(weights.sparkSession, by, cells)
    known = weights.join(F.broadcast(place), list(by)).groupBy(*SOURCE_FIELD)
    found = known.agg(F.map_from_entries(F.collect_list(F.struct("_cell", "trust"))).alias("_known"))
    w = F.array(*[F.coalesce(F.try_element_at("_known", F.lit(i)), F.lit(cold)) for i, cold in enumerate(cold_weights(by, cells))])
    return found.select(*SOURCE_FIELD, w.alias("w"))


def cold_weights(by: Sequence[str], cells: Sequence[tuple]) -> list[float]:
    return [1.0 if "cluster_majority" in cell else COLD for cell in cells]


def spread_cells(spark, by: Sequence[str], cells: Sequence[tuple]) -> DataFrame:
    """(by, _cell): the grid as a table, for lookups by its values."""
    kinds = {"seed": "long", "budget": "long", "method": "string"}
    rows = [(*cell, i) for i, cell in enumerate(cells)]
    return spark.createDataFrame(rows, ", ".join(f"{c} {kinds[c]}" for c in by) + ", _cell int")


def grid_fuse(
    claims: DataFrame, weights: DataFrame | None, by: Sequence[str], cells: Sequence[tuple], rank: bool = False
) -> DataFrame:
    """The winner of every group in every cell of a grid of weights: (by, group, value).

    The grid is columns: a claim stays one row with one weight per cell, and each
    cell is one aggregate among many over the same shuffle. Cells are taken
    :data:`CELLS` at a time; only winners, one per group and cell, become rows.
    """
    cold = F.array(*[F.lit(w) for w in cold_weights(by, cells)])
    if weights is None:
        weighed = claims.withColumn("w", cold)
    else:
        weighed = lookup_join(claims, grid_weights(weights, by, cells), SOURCE_FIELD, "left").withColumn("w", F.coalesce("w", cold))
    if len(cells) > CELLS:
        weighed = pin(weighed, "weighed")
    out = []
    for start in range(0, len(cells), CELLS):
        part = list(enumerate(cells))[start : start + CELLS]
        if rank:
            best = weighed.groupBy(*GROUP).agg(*[
                F.max(F.struct(F.col("w")[i].alias("w"), "ts", "value", "offer_id")).alias(f"b{i}") for i, _ in part
            ])
        else:
            votes = weighed.groupBy(*GROUP, "value").agg(*[F.sum(fixed_point(F.col("w")[i])).alias(f"v{i}") for i, _ in part])
            best = votes.groupBy(*GROUP).agg(*[F.max(F.struct(f"v{i}", "value")).alias(f"b{i}") for i, _ in part])
        rows = [F.struct(*[F.lit(v).alias(c) for c, v in zip(by, cell)], F.col(f"b{i}.value").alias("value")) for i, cell in part]
        out.append(best.select(*GROUP, F.inline(F.array(*rows))).select(*by, *GROUP, "value"))
    return reduce(DataFrame.unionByName, out)


def _spread_labels(silver: DataFrame, methods: Sequence[str]) -> DataFrame:
    return silver.withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods])))


def compare_methods(
    collapsed: DataFrame,
    silver: DataFrame,
    n_trust: int,
    seeds: Sequence[int] = (0,),
    include: Sequence[str] = METHODS,
    delta: float = DELTA,
    lam: float = LAMBDA,
    em_iters: int = EM_ROUNDS,
) -> DataFrame:
    """Learn every method on the train clusters, fuse and score on the test clusters.

    Returns (seed, method, P, R, F1, EM). All vote methods of all seeds are columns of one
    aggregation over the claims of labelled groups, all rank methods of another.
    Only truth discovery learns from unlabelled test claims too, and
    takes them once per seed.
    """
    split = pin(cluster_split(silver, n_trust, seeds), "split")
    halves = {p: pin(split.filter(F.col("part") == p).select("seed", "cluster_id"), p) for p in ("train", "test")}
    judged = pin(adjudicate(collapsed, silver), "judged")
    train = pin(lookup_join(judged, halves["train"], ["cluster_id"], "inner"), "train")
    test = lookup_join(judged, halves["test"], ["cluster_id"], "inner")
    labels = pin(lookup_join(silver, halves["test"], ["cluster_id"], "inner"), "labels")

    t_now = collapsed.agg(F.max("ts")).first()[0]
    learned = [m for m in (*RANK_METHODS, *VOTE_METHODS) if m in include]
    weights = method_weights(
        learned,
        train,
        pin(collapsed.select(*SOURCE_FIELD).distinct(), "pairs"),
        ["seed"],
        decay_weight(t_now, lam),
        delta,
        test,
    ) if set(learned) - {"cluster_majority"} else None

    groups = pin(labels.select(*GROUP).distinct(), "groups")
    labelled = pin(lookup_join(collapsed, groups, list(GROUP), "left_semi"), "labelled")
    keys = ["seed", "method", *GROUP]
    fused = []
    for form, wanted in ((True, RANK_METHODS), (False, VOTE_METHODS)):
        cells = [(int(seed), m) for seed in seeds for m in wanted if m in include]
        if cells:
            fused.append(grid_fuse(labelled, weights, ["seed", "method"], cells, rank=form))
    if "recency_first" in include:
        newest = rank_fuse(labelled, RECENCY_POLICY)
        seed = F.explode(F.array(*[F.lit(int(s)).cast("long") for s in seeds]))
        fused.append(newest.withColumn("method", F.lit("recency_first")).withColumn("seed", seed).select(*keys, "value"))
    if "em_truth" in include:
        unseen = lookup_join(collapsed, halves["test"], ["cluster_id"], "inner")
        found = em_truth(unseen, em_iters, by=["seed"])
        fused.append(found.withColumn("method", F.lit("em_truth")).select(*keys, "value"))
    pred = reduce(DataFrame.unionByName, fused)
    used = [m for m in METHODS if m in include]
    return quality(pred, _spread_labels(labels, used), ["seed", "method"])


def budget_curve(
    collapsed: DataFrame,
    silver: DataFrame,
    budgets: Sequence[int],
    seeds: Sequence[int],
    methods: Sequence[str] = ("weighted_vote_global", "weighted_vote_field", "vote_mean", "vote_lcb", "vote_lcb_decay"),
    delta: float = DELTA,
    lam: float = LAMBDA,
    split_seed: int = 123,
) -> DataFrame:
    """Quality on fixed test clusters as the number of labelled clusters grows.

    A pool of ``max(budgets)`` clusters is set aside; each (budget, seed) learns
    from that many pool clusters. The whole grid is one learning job, one vote
    and one scoring job: weights are arrays over the grid, votes columns, and only labels and winners become rows.
    """
    split = pin(cluster_split(silver, max(budgets), [split_seed]), "split")
    pool = split.filter("part = 'train'").select("cluster_id")
    seeded = pool.withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
    order = Window.partitionBy("seed").orderBy(portable_hash(F.col("seed"), F.col("cluster_id")), "cluster_id")
    ranked = seeded.withColumn("_place", F.row_number().over(order))
    budget = F.explode(F.array(*[F.lit(int(b)) for b in budgets]))
    chosen = ranked.withColumn("budget", budget).filter("_place <= budget").drop("_place")

    by = ["budget", "seed"]
    judged = pin(lookup_join(adjudicate(collapsed, silver), pool, ["cluster_id"], "left_semi"), "judged")
    train = pin(lookup_join(judged, chosen, ["cluster_id"], "inner"), "train")
    t_now = collapsed.agg(F.max("ts")).first()[0]
    pairs = pin(collapsed.select(*SOURCE_FIELD).distinct(), "pairs")
    weights = method_weights(methods, train, pairs, by, decay_weight(t_now, lam), delta)

    test = split.filter("part = 'test'").select("cluster_id")
    labels = pin(lookup_join(silver, test, ["cluster_id"], "left_semi"), "labels")
    labelled = pin(lookup_join(collapsed, pin(labels.select(*GROUP), "groups"), list(GROUP), "left_semi"), "labelled")

    def grid(df: DataFrame) -> DataFrame:
        return df.withColumn("budget", budget).withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))

    cells = [(int(b), int(s), m) for b in budgets for s in seeds for m in methods]
    pred = grid_fuse(labelled, weights, [*by, "method"], cells)
    scores = quality(pred, _spread_labels(grid(labels), methods), [*by, "method"])
    evidence = trust_counts(train, by=[*by, *SOURCE_FIELD]).groupBy(*by).agg(
        F.avg(F.col("succ") + F.col("fail")).alias("mean_n_eff")
    )
    return scores.join(evidence, by).select(*by, "method", "F1", "EM", "mean_n_eff")
