"""Queries on method comparison, grids, heatmaps, drift monitoring and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corrobora.functions.ids import portable_hash
from corrobora.operators import evaluate as ev, fuse, monitor as mo, trust as tr
from corrobora.operators.intervals import claim_intervals, interval_evidence
from corrobora.operators.order import time_windows
from corrobora.operators.prepare import deal_parts
from corrobora.plans import methods as me, tables
from corrobora.plans.fusion_queries import SHARE, YEARLY
from corrobora.plans.prepare_queries import SPLIT
from corrobora.plans.registry import query
from corrobora.plans.sqlparts import (
    COUNTS,
    DECAYED,
    MEAN,
    assemble,
    collapse_sql,
    hash_sql,
    lcb_fraction_sql, lcb_sql,
    rank_sql,
    trust_join_sql,
    vote_sql,
    windows_part,
)
from corrobora.session import pin, release, scratch_path
from corrobora.streaming.keyed import KeyedFusion, late_outcomes
from corrobora.streaming.live import (
    BatchTable,
    LiveFusion,
    bounded_claims,
    label_sample,
    latest,
    stream_rank,
    stream_trust,
    upsert,
)

SEEDS = (0, 1, 2)
N_TRUST = 100


def _round(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(c, digits))
    return df


# -------------------------------------------------------------- comparison
KEYS = "seed, cluster_id, field"


def _seeded_weights(table: str, per_source: bool = False) -> str:
    on = "c.seed = t.seed AND c.source_id = t.source_id" + ("" if per_source else " AND c.field = t.field")
    return f"""SELECT c.seed, c.cluster_id, c.field, c.source_id, c.value, c.ts, c.offer_id, coalesce(t.trust, 0.5) AS trust
      FROM tested c LEFT JOIN {table} t ON {on}"""


def _comparison_parts() -> dict[str, str]:
    """SQL of every method on every split, one part each."""
    extra = {
        "split": SPLIT,
        "train": "SELECT p.seed, a.* FROM adj a JOIN split p USING (cluster_id) WHERE p.part = 'train'",
        "testadj": "SELECT p.seed, a.* FROM adj a JOIN split p USING (cluster_id) WHERE p.part = 'test'",
        "tested": "SELECT p.seed, c.* FROM collapsed c JOIN split p USING (cluster_id) WHERE p.part = 'test'",
        "goal": "SELECT p.seed, s.* FROM silver s JOIN split p USING (cluster_id) WHERE p.part = 'test'",
        "scounts": f"SELECT seed, source_id, field, {COUNTS} FROM train GROUP BY seed, source_id, field",
        "sfaded": f"""SELECT seed, source_id, field, {DECAYED} FROM (
          SELECT *, exp(-1e-8 * greatest((SELECT max(ts) FROM collapsed) - ts, 0.0)) AS w FROM train)
          GROUP BY seed, source_id, field""",
        "s_mean": f"SELECT seed, source_id, field, {MEAN} AS trust FROM scounts",
        "s_map": "SELECT seed, source_id, field, (1.0 + succ) / (2.0 + succ + fail) AS trust FROM scounts",
        "s_lcb": lcb_sql("scounts", "seed, source_id, field"),
        "s_fade": f"SELECT seed, source_id, field, {MEAN} AS trust FROM sfaded",
        "s_lcbfade": lcb_sql("sfaded", "seed, source_id, field"),
        "s_rate": "SELECT seed, source_id, (sum(x) + 1.0) / (count(*) + 2.0) AS trust FROM train GROUP BY ALL",
        "s_ratefield": "SELECT seed, source_id, field, CAST(sum(x) AS DOUBLE) / count(*) AS trust FROM train GROUP BY ALL",
        "s_oracle": "SELECT seed, source_id, field, (sum(x) + 1.0) / (count(*) + 2.0) AS trust FROM testadj GROUP BY ALL",
        "t_one": "SELECT *, 1.0 AS trust FROM tested",
    }
    weights = {
        "source_priority": ("s_rate", True, rank_sql),
        "rank_mean": ("s_mean", False, rank_sql),
        "rank_map": ("s_map", False, rank_sql),
        "rank_lcb": ("s_lcb", False, rank_sql),
        "weighted_vote_global": ("s_rate", True, vote_sql),
        "weighted_vote_field": ("s_ratefield", False, vote_sql),
        "vote_mean": ("s_mean", False, vote_sql),
        "vote_lcb": ("s_lcb", False, vote_sql),
        "vote_decay": ("s_fade", False, vote_sql),
        "vote_lcb_decay": ("s_lcbfade", False, vote_sql),
        "oracle_bound": ("s_oracle", False, vote_sql),
    }
    for name, (table, per_source, form) in weights.items():
        extra[f"t_{name}"] = _seeded_weights(table, per_source)
        extra[f"p_{name}"] = form(f"t_{name}", KEYS)
    extra["p_recency_first"] = rank_sql("tested", KEYS, "ts, offer_id, value")
    extra["p_cluster_majority"] = vote_sql("t_one", KEYS)
    extra["e0"] = "SELECT *, CAST(0.8 AS DOUBLE) AS trust FROM tested"
    extra["w0"] = vote_sql("e0", KEYS)
    for i in range(1, me.EM_ROUNDS):
        extra[f"g{i}"] = f"""SELECT c.seed, c.source_id, (sum(CAST(c.value = w.value AS BIGINT)) + 1.0) / (count(*) + 2.0) AS trust
          FROM tested c JOIN w{i - 1} w USING (seed, cluster_id, field) GROUP BY ALL"""
        extra[f"e{i}"] = _seeded_weights(f"g{i}", True)
        extra[f"w{i}"] = vote_sql(f"e{i}", KEYS)
    extra["p_em_truth"] = f"SELECT * FROM w{me.EM_ROUNDS - 1}"
    extra["guess"] = " UNION ALL ".join(f"SELECT '{m}' AS method, {KEYS}, value FROM p_{m}" for m in me.METHODS)
    extra["rows_"] = """SELECT g.method, s.seed, s.cluster_id, s.field, g.value = s.value AS ok
      FROM goal s JOIN guess g USING (seed, cluster_id, field)"""
    extra["score"] = """SELECT seed, method, avg(p) AS F1, EM FROM (
        SELECT seed, method, field, avg(CAST(ok AS DOUBLE)) AS p FROM rows_ GROUP BY ALL)
      JOIN (SELECT seed, method, avg(CAST(ok AS DOUBLE)) AS EM FROM (
        SELECT seed, method, cluster_id, bool_and(ok) AS ok FROM rows_ GROUP BY ALL) GROUP BY ALL) USING (seed, method)
      GROUP BY seed, method, EM"""
    return extra


def _compared(spark, sf) -> DataFrame:
    collapsed, silver, _ = me.prepare(tables.claims(spark, sf))
    return me.compare_methods(collapsed, silver, N_TRUST, SEEDS, lam=YEARLY)


# Every test group has collapsed claims, so each method answers it and P = R = F1.
@query(
    "compare_methods",
    assemble(
        "SELECT seed, method, round(F1, 6) AS P, round(F1, 6) AS R, round(F1, 6) AS F1, round(EM, 6) AS EM FROM score",
        **_comparison_parts(),
    ),
)
def _(spark, sf):
    return _round(_compared(spark, sf), "P", "R", "F1", "EM")


@query(
    "metric_summary",
    assemble(
        """SELECT method, round(avg(F1), 4) AS F1_mean, round(stddev_samp(F1), 4) AS F1_std,
        round(avg(EM), 4) AS EM_mean, round(stddev_samp(EM), 4) AS EM_std FROM score GROUP BY method""",
        **_comparison_parts(),
    ),
)
def _(spark, sf):
    return ev.metric_summary(_compared(spark, sf), ["method"], ["F1", "EM"])


TAUS = (0.0, 0.2, 0.3, 0.4, 0.6)
DELTAS = (0.2, 0.05)


def _risk_sql() -> str:
    extra = {}
    for i, delta in enumerate(DELTAS):
        extra[f"lcb_{i}"] = lcb_sql("counts", "source_id, field", delta)
        extra[f"weigh_{i}"] = trust_join_sql("collapsed", f"lcb_{i}")
        extra[f"win_{i}"] = SHARE.format(source=f"weigh_{i}")
    every = " UNION ALL ".join(
        f"""SELECT CAST({d} AS DOUBLE) AS delta, s.value AS truth, w.value AS pred, w.share FROM silver s
        JOIN win_{i} w USING (cluster_id, field)""" for i, d in enumerate(DELTAS)
    )
    return assemble(
        f"""SELECT delta, tau, round(p, 6) AS precision, round(answered / n, 6) AS coverage, round(r, 6) AS recall,
        round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS F1, round(1 - p, 6) AS selective_risk FROM (
          SELECT *, correct / greatest(answered, 1) AS p, correct / n AS r FROM (
            SELECT delta, tau, count(*) AS n, count(*) FILTER (share >= tau) AS answered,
              count(*) FILTER (share >= tau AND pred = truth) AS correct
            FROM answers, (SELECT CAST(unnest([{", ".join(map(str, TAUS))}]) AS DOUBLE) AS tau) GROUP BY delta, tau))""",
        answers=every,
        **extra,
    )


@query("risk_coverage", _risk_sql())
def _(spark, sf):
    collapsed, silver, _ = me.prepare(tables.claims(spark, sf))
    counts = pin(tr.trust_counts(tr.adjudicate(collapsed, silver)))
    labelled = collapsed.join(silver.select("cluster_id", "field"), ["cluster_id", "field"], "left_semi")
    delta = F.explode(F.array(*[F.lit(d) for d in DELTAS]))
    trust = None
    for d in DELTAS:
        one = tr.trust_table(counts, "lcb", d).withColumn("delta", F.lit(d))
        trust = one if trust is None else trust.unionByName(one)
    weighted = tr.join_trust(
        labelled.withColumn("delta", delta),
        trust.select("delta", "source_id", "field", "trust"),
        by=["delta", "source_id", "field"],
    )
    winners = fuse.vote_share(weighted, group=["delta", "cluster_id", "field"])
    grid = ev.risk_coverage(winners, silver.withColumn("delta", delta), TAUS, ["delta"])
    return _round(grid, "precision", "coverage", "recall", "F1", "selective_risk")


BUDGETS = (25, 50, 100, 200, 300)
BUDGET_SEEDS = tuple(range(10))
BUDGET_METHODS = ("weighted_vote_global", "weighted_vote_field", "vote_mean", "vote_lcb", "vote_lcb_decay")


def _budget_sql() -> str:
    """One pass over the test claims: a column of weights, and then of votes, for each method."""
    tables_of = {"weighted_vote_global": "b_rate", "weighted_vote_field": "b_ratefield", "vote_mean": "b_mean"}
    tables_of |= {"vote_lcb": "b_lcb", "vote_lcb_decay": "b_lcbfade"}
    ms = range(len(BUDGET_METHODS))
    joins = "".join(
        f" LEFT JOIN {tables_of[m]} t{i} ON g.budget = t{i}.budget AND g.seed = t{i}.seed AND p.source_id = t{i}.source_id"
        + ("" if m == "weighted_vote_global" else f" AND p.field = t{i}.field")
        for i, m in enumerate(BUDGET_METHODS)
    )
    weights = ", ".join(f"CAST(round_even(coalesce(t{i}.trust, 0.5) * 4294967296.0, 0) AS BIGINT) AS w{i}" for i in ms)
    extra = {
        "place": f"""SELECT cluster_id, row_number() OVER (ORDER BY {hash_sql('123', 'cluster_id')}, cluster_id) AS place
          FROM (SELECT DISTINCT cluster_id FROM silver)""",
        "chosen": f"""SELECT budget, seed, cluster_id FROM (
          SELECT seed, cluster_id, row_number() OVER (PARTITION BY seed ORDER BY {hash_sql('seed', 'cluster_id')}, cluster_id) AS rk
          FROM place, (SELECT unnest({list(BUDGET_SEEDS)}) AS seed) WHERE place <= {max(BUDGETS)}),
          (SELECT unnest({list(BUDGETS)}) AS budget) WHERE rk <= budget""",
        "btrain": "SELECT c.budget, c.seed, a.* FROM adj a JOIN chosen c USING (cluster_id)",
        "bcounts": f"SELECT budget, seed, source_id, field, {COUNTS} FROM btrain GROUP BY ALL",
        "b_mean": f"SELECT budget, seed, source_id, field, {MEAN} AS trust FROM bcounts",
        "b_lcb": lcb_fraction_sql("bcounts", "budget, seed, source_id, field"),
        "bfaded": f"""SELECT budget, seed, source_id, field, {DECAYED} FROM (
          SELECT *, exp(-1e-8 * greatest((SELECT max(ts) FROM collapsed) - ts, 0.0)) AS w FROM btrain) GROUP BY ALL""",
        "b_lcbfade": lcb_fraction_sql("bfaded", "budget, seed, source_id, field"),
        "b_rate": "SELECT budget, seed, source_id, (sum(x) + 1.0) / (count(*) + 2.0) AS trust FROM btrain GROUP BY ALL",
        "b_ratefield": "SELECT budget, seed, source_id, field, CAST(sum(x) AS DOUBLE) / count(*) AS trust FROM btrain GROUP BY ALL",
        "bgoal": f"SELECT s.* FROM silver s JOIN place p USING (cluster_id) WHERE p.place > {max(BUDGETS)}",
        "btest": "SELECT c.cluster_id, c.field, c.source_id, c.value FROM collapsed c JOIN bgoal s USING (cluster_id, field)",
        "bweights": f"""SELECT g.budget, g.seed, p.source_id, p.field, {weights}
          FROM (SELECT DISTINCT budget, seed FROM chosen) g CROSS JOIN (SELECT DISTINCT source_id, field FROM btest) p{joins}""",
        "bvotes": f"""SELECT budget, seed, cluster_id, field, value, {", ".join(f"sum(w{i}) AS w{i}" for i in ms)}
          FROM btest JOIN bweights USING (source_id, field) GROUP BY ALL""",
        "bwinners": f"""SELECT budget, seed, cluster_id, field,
          {", ".join(f"arg_max(value, struct_pack(w := w{i}, v := value)) AS v{i}" for i in ms)} FROM bvotes GROUP BY ALL""",
        "brows": f"""SELECT unnest({list(BUDGET_METHODS)}) AS method, budget, seed, cluster_id, field,
          unnest([{", ".join(f"v{i} = s.value" for i in ms)}]) AS ok FROM bwinners JOIN bgoal s USING (cluster_id, field)""",
    }
    return assemble(
        """SELECT budget, seed, method, round(F1, 6) AS F1, round(EM, 6) AS EM, round(n, 6) AS mean_n_eff FROM (
          SELECT budget, seed, method, avg(p) AS F1 FROM (
            SELECT budget, seed, method, field, avg(CAST(ok AS DOUBLE)) AS p FROM brows GROUP BY ALL) GROUP BY ALL)
        JOIN (SELECT budget, seed, method, avg(CAST(ok AS DOUBLE)) AS EM FROM (
            SELECT budget, seed, method, cluster_id, bool_and(ok) AS ok FROM brows GROUP BY ALL) GROUP BY ALL) USING (budget, seed, method)
        JOIN (SELECT budget, seed, avg(succ + fail) AS n FROM bcounts GROUP BY ALL) USING (budget, seed)""",
        **extra,
    )


@query("budget_curve", _budget_sql())
def _(spark, sf):
    collapsed, silver, _ = me.prepare(tables.claims(spark, sf))
    curve = me.budget_curve(collapsed, silver, BUDGETS, BUDGET_SEEDS, BUDGET_METHODS, lam=1e-8)
    return _round(curve, "F1", "EM", "mean_n_eff")


# ----------------------------------------------------------- heterogeneity
LANGS = ("de", "en", "es", "fr")


def _doc_trust(spark, sf) -> DataFrame:
    return tr.trust_table(tr.trust_counts(tables.document_adjudications(spark, sf)))


def _heat_sql(value: str) -> str:
    cells = ", ".join(f"max(CASE WHEN field = '{f}' THEN round({value}, 4) END) AS {f}" for f in LANGS)
    return assemble(f"SELECT source_id, {cells} FROM doctrust GROUP BY source_id")


@query("trust_heatmap", _heat_sql("trust"))
def _(spark, sf):
    return mo.trust_heatmap(_doc_trust(spark, sf), LANGS)


@query("evidence_heatmap", _heat_sql("n_eff"))
def _(spark, sf):
    return mo.trust_heatmap(_doc_trust(spark, sf), LANGS, "n_eff")


@query(
    "heterogeneity",
    assemble(
        """SELECT source_id, sum(n_eff) AS evidence, round(var_pop(trust), 6) AS variance,
        round(max(trust) - min(trust), 6) AS range FROM doctrust GROUP BY source_id"""
    ),
)
def _(spark, sf):
    return _round(mo.heterogeneity(_doc_trust(spark, sf)), "variance", "range")


@query(
    "mean_range",
    assemble(
        """SELECT round(avg(r), 6) AS mean_range FROM (
        SELECT max(trust) - min(trust) AS r FROM doctrust GROUP BY source_id)"""
    ),
)
def _(spark, sf):
    return _round(mo.mean_range(_doc_trust(spark, sf)), "mean_range")


# ------------------------------------------------------------------- drift
N_WINDOWS = 8
POLICIES = (
    mo.TrustPolicy("static", per_source=True, freeze_after=3),
    mo.TrustPolicy("no_decay"),
    mo.TrustPolicy("decay_0.3", lam=0.3),
    mo.TrustPolicy("decay_1", lam=1.0),
)


def _windowed(spark, sf):
    claims = tables.event_claims(spark, sf)
    _, silver, _ = me.prepare(claims)
    return time_windows(claims, N_WINDOWS), silver


def _drift_parts() -> dict[str, str]:
    extra = {
        "cut": windows_part("stream", N_WINDOWS, "w"),
        "prefix": f"SELECT n AS as_of, c.* FROM cut c, (SELECT unnest(range(1, {N_WINDOWS + 1})) AS n) WHERE c.w <= n",
        "seen": collapse_sql("prefix", "as_of, cluster_id, field"),
        "evidence": f"""SELECT as_of, source_id, field, {COUNTS} FROM (
          SELECT c.*, CAST(c.value = s.value AS BIGINT) AS x FROM seen c JOIN streamsilver s USING (cluster_id, field))
          GROUP BY ALL""",
    }
    tables_ = []
    for p in POLICIES:
        until = p.freeze_after or N_WINDOWS
        fade = f"exp(-{p.lam} * (n - as_of))"
        body = f"""sum(succ * {fade}) AS succ, sum(fail * {fade}) AS fail FROM evidence,
          (SELECT unnest(range(1, {N_WINDOWS + 1})) AS n) WHERE as_of < n AND as_of <= {until}"""
        if p.per_source:
            pooled = f"SELECT n, source_id, {body} GROUP BY n, source_id"
            tables_.append(
                f"""SELECT '{p.name}' AS policy, n AS as_of, source_id, field, {MEAN} AS trust
                FROM ({pooled}) JOIN (SELECT DISTINCT source_id, field FROM evidence) USING (source_id)"""
            )
        else:
            tables_.append(
                f"""SELECT '{p.name}' AS policy, n AS as_of, source_id, field, {MEAN} AS trust
                FROM (SELECT n, source_id, field, {body} GROUP BY n, source_id, field)"""
            )
    extra["drifttrust"] = " UNION ALL ".join(tables_)
    names = ", ".join(f"'{p.name}'" for p in POLICIES)
    extra["driftclaims"] = f"""SELECT q.policy, c.as_of, c.cluster_id, c.field, c.value, coalesce(t.trust, 0.5) AS trust
      FROM (SELECT unnest([{names}]) AS policy) q, (seen c SEMI JOIN streamsilver s USING (cluster_id, field))
      LEFT JOIN drifttrust t ON t.policy = q.policy AND t.as_of = c.as_of AND t.source_id = c.source_id AND t.field = c.field"""
    extra["driftpred"] = vote_sql("driftclaims", "policy, as_of, cluster_id, field")
    extra["backtest"] = """SELECT policy, as_of AS w, avg(CAST(p.value = s.value AS DOUBLE)) AS F1, count(*) AS n
      FROM driftpred p JOIN streamsilver s USING (cluster_id, field) GROUP BY policy, as_of"""
    return extra


def _trust_by_window(spark, sf) -> DataFrame:
    claims, silver = _windowed(spark, sf)
    evidence = pin(interval_evidence(claim_intervals(claims, N_WINDOWS), silver, N_WINDOWS))
    return mo.windowed_trust(evidence, POLICIES, N_WINDOWS)


@query(
    "windowed_trust",
    assemble(
        'SELECT policy, as_of AS "window", source_id, field, round(trust, 6) AS trust FROM drifttrust', **_drift_parts()
    ),
)
def _(spark, sf):
    trust = _trust_by_window(spark, sf)
    return _round(trust.select("policy", "window", "source_id", "field", "trust"), "trust")


POOLED = ", ".join(f"'{p.name}'" for p in POLICIES if p.per_source)


@query(
    "trust_trend",
    assemble(
        f"""SELECT policy, as_of AS "window", round(avg(trust), 6) AS mean_trust FROM drifttrust
        WHERE source_id IN ('0', '3', '16') AND policy NOT IN ({POOLED}) GROUP BY policy, as_of""",
        **_drift_parts(),
    ),
)
def _(spark, sf):
    return _round(mo.trust_trend(_trust_by_window(spark, sf), ["0", "3", "16"], POLICIES), "mean_trust")


def _backtested(spark, sf) -> DataFrame:
    claims, silver = _windowed(spark, sf)
    return mo.prequential_backtest(claims, silver, POLICIES, N_WINDOWS)


@query(
    "prequential_backtest",
    assemble('SELECT policy, w AS "window", round(F1, 6) AS F1, n FROM backtest', **_drift_parts()),
)
def _(spark, sf):
    return _round(_backtested(spark, sf), "F1")


@query(
    "recovery_summary",
    assemble(
        """SELECT policy, round(max(b.pre), 6) AS pre_F1, round(avg(F1), 6) AS post_avg_F1,
        round(max(CASE WHEN w = 8 THEN F1 END), 6) AS final_F1, min(CASE WHEN F1 >= 0.95 * b.pre THEN w - 3 END) AS recovery_windows
        FROM backtest JOIN (SELECT policy, F1 AS pre FROM backtest WHERE w = 3) b USING (policy) WHERE w > 3 GROUP BY policy""",
        **_drift_parts(),
    ),
)
def _(spark, sf):
    summary = mo.recovery_summary(_backtested(spark, sf))
    return _round(summary, "pre_F1", "post_avg_F1", "final_F1").withColumn(
        "recovery_windows", F.col("recovery_windows").cast("long")
    )


# -------------------------------------------------------- plan invariance
@query(
    "plan_invariance",
    assemble(
        """SELECT method, parts, true AS same FROM (SELECT unnest(['rank', 'vote', 'collapse']) AS method),
        (SELECT unnest([3, 16, 64]) AS parts)"""
    ),
)
def _(spark, sf):
    collapsed, silver, trust = tables.learned_trust(spark, sf)
    trust = pin(trust, "trust")
    release(collapsed, silver)
    # records are dealt, not their claims, which lie where their records do
    dealt, records = tables.line_records(spark, sf), tables.line_records(spark, sf, dealt=False)
    mixes = {parts: deal_parts(records, parts, portable_hash(F.col("offer_id"), F.lit(parts))) for parts in (3, 16, 64)}
    operators = {
        "rank": (fuse.rank_fuse, ["cluster_id", "field", "value"]),
        "vote": (fuse.vote_fuse, ["cluster_id", "field", "value"]),
        "collapse": (fuse.collapse_per_source, ["cluster_id", "field", "source_id", "value", "ts", "offer_id"]),
    }
    audit = None
    for name, (operator, columns) in operators.items():

        def digest(of: DataFrame) -> DataFrame:
            # each digest is written on its own, so that its shuffle files go before the next
            return pin(fuse.fingerprint(operator(tr.join_trust(tables.claims_of(of), trust)), columns), "digest")

        base = digest(dealt)
        for parts, mixed in mixes.items():
            both = base.unionByName(digest(mixed)).agg(F.count_distinct("rows", "digest_sum", "digest_xor").alias("n"))
            line = both.select(F.lit(name).alias("method"), F.lit(parts).alias("parts"), (F.col("n") == 1).alias("same"))
            audit = line if audit is None else audit.unionByName(line)
    release(trust)
    return audit


# ----------------------------------------------------------------- streams
N_BATCHES = 8
FILES = 4
FRACTION = 0.2


def _arrivals(spark, cut: DataFrame, copies: int = 1) -> DataFrame:
    """A stream of the batches of ``cut``: one job writes each as FILES files, so that as many tasks read it."""
    folder = scratch_path(spark, "arrivals")
    for b in range(1, N_BATCHES + 1):
        for _ in range(copies):
            cut.filter(F.col("batch") == b).repartition(FILES).write.mode("append").parquet(folder)
    return spark.readStream.schema(cut.schema).option("maxFilesPerTrigger", FILES * copies).parquet(folder)


def _batches(spark, sf):
    """Event claims cut into batches that arrive in order, and their labels."""
    claims = tables.event_claims(spark, sf)
    _, silver, _ = me.prepare(claims)
    cut = pin(time_windows(claims, N_BATCHES, name="batch"))
    return _arrivals(spark, cut), cut, silver


def _run(live: LiveFusion, stream: DataFrame, step=None) -> LiveFusion:
    running = live.start(stream, step).trigger(availableNow=True).start()
    running.awaitTermination()
    return live


def _live(spark, sf, **options) -> LiveFusion:
    stream, _, silver = _batches(spark, sf)
    live = LiveFusion(spark, scratch_path(spark, "live"), silver, label_fraction=FRACTION, **options)
    return _run(live, stream)


def _stream_parts() -> dict[str, str]:
    """The stream replayed in SQL; batch ids count from 0 as the engine's do."""
    reveal = hash_sql("c.cluster_id", "c.field", "c.b")
    return {
        "cutb": windows_part("stream", N_BATCHES, "batch"),
        "arrived": "SELECT *, CAST(batch - 1 AS BIGINT) AS b FROM cutb",
        "collb": collapse_sql("arrived", "b, cluster_id, field"),
        "judgedb": f"""SELECT c.b, c.source_id, c.field, c.ts, CAST(c.value = s.value AS BIGINT) AS x
          FROM collb c JOIN streamsilver s USING (cluster_id, field) WHERE {reveal} < {int(round(FRACTION * 2**32))}""",
        "countsb": f"SELECT b, source_id, field, {COUNTS} FROM judgedb GROUP BY ALL",
        "stateb": f"""SELECT n AS b, source_id, field, sum(succ) AS succ, sum(fail) AS fail FROM countsb,
          (SELECT CAST(unnest(range(0, {N_BATCHES})) AS BIGINT) AS n) WHERE b <= n GROUP BY n, source_id, field""",
        "trustb": lcb_sql("stateb", "b, source_id, field"),
        "weighb": """SELECT c.b, c.cluster_id, c.field, c.value, coalesce(t.trust, 0.5) AS trust FROM collb c
          LEFT JOIN trustb t ON t.b = c.b - 1 AND t.source_id = c.source_id AND t.field = c.field""",
        "fusedb": vote_sql("weighb", "b, cluster_id, field"),
        "clock": "SELECT b, max(ts) AS now FROM collb GROUP BY b",
    }


@query("stream_fuse", assemble("SELECT b AS batch_id, cluster_id, field, value FROM fusedb", **_stream_parts()))
def _(spark, sf):
    fused = _live(spark, sf).tables["fused"].all()
    return fused.withColumn("batch_id", F.col("batch_id").cast("long"))


@query(
    "stream_adjudicate",
    assemble("SELECT b AS batch_id, source_id, field, succ, fail FROM countsb", **_stream_parts()),
)
def _(spark, sf):
    state = _live(spark, sf).tables["state"].all().filter("new_succ + new_fail > 0")
    counts = [F.col("new_succ").alias("succ"), F.col("new_fail").alias("fail")]
    return state.select(F.col("batch_id").cast("long"), "source_id", "field", *counts)


@query(
    "stream_trust",
    assemble(f"SELECT source_id, field, succ, fail FROM stateb WHERE b = {N_BATCHES - 1}", **_stream_parts()),
)
def _(spark, sf):
    stream, cut, silver = _batches(spark, sf)
    collapsed = fuse.collapse_per_source(cut, ["batch", "cluster_id", "field"])
    revealed = collapsed.join(silver.withColumnRenamed("value", "label"), ["cluster_id", "field"]).filter(
        label_sample(FRACTION, F.col("batch") - 1)
    )
    judged = revealed.select("batch", "source_id", "field", (F.col("value") == F.col("label")).cast("byte").alias("x"))
    folder = scratch_path(spark, "judged")
    judged.write.parquet(folder)
    outcomes = spark.readStream.schema(judged.schema).option("maxFilesPerTrigger", FILES).parquet(folder)
    table = BatchTable(spark, scratch_path(spark, "trust"))
    _follow(spark, stream_trust(outcomes), "update", upsert(table))
    return latest(table, ["source_id", "field"])


def _follow(spark, changes: DataFrame, mode: str, sink) -> None:
    """Run a stream to the end of what has arrived."""
    writer = changes.writeStream.outputMode(mode).foreachBatch(sink)
    running = writer.option("checkpointLocation", scratch_path(spark, "checkpoint")).trigger(availableNow=True).start()
    running.awaitTermination()


STEADY = "SELECT *, (CAST(source_id AS BIGINT) + 1) / 32.0 AS trust FROM stream"


@query("stream_rank", assemble("SELECT cluster_id, field, value FROM ranked", steady=STEADY, ranked=rank_sql("steady")))
def _(spark, sf):
    stream, _, _ = _batches(spark, sf)
    table = BatchTable(spark, scratch_path(spark, "rank"))
    ranked = stream_rank(stream.withColumn("trust", (F.col("source_id").cast("long") + 1) / 32.0))
    _follow(spark, ranked, "update", upsert(table))
    return latest(table, ["cluster_id", "field"])


def _keyed(spark, sf) -> KeyedFusion:
    stream, _, silver = _batches(spark, sf)
    live = KeyedFusion(spark, scratch_path(spark, "keyed"), silver, label_sample(FRACTION, F.col("batch") - 1))
    live.start(stream).awaitTermination()
    return live


@query("stream_keyed_fuse", assemble("SELECT b AS batch_id, cluster_id, field, value FROM fusedb", **_stream_parts()))
def _(spark, sf):
    return _keyed(spark, sf).fused.all().select(F.col("batch_id").cast("long"), "cluster_id", "field", "value")


@query(
    "stream_keyed_evidence",
    assemble(
        f"""SELECT b AS batch_id, source_id, field, succ, fail FROM stateb WHERE b IN (2, {N_BATCHES - 1})""",
        **_stream_parts(),
    ),
)
def _(spark, sf):
    live = _keyed(spark, sf)
    versions = [live.evidence(b).select(F.lit(b).cast("long").alias("batch_id"), "*") for b in (2, N_BATCHES - 1)]
    return versions[0].unionByName(versions[1])


KEPT_DAYS = 30


@query(
    "stream_interval_labels",
    assemble(
        f"SELECT source_id, field, {COUNTS} FROM judgedl GROUP BY ALL",
        colla=collapse_sql("stream"),
        labelled="""SELECT cluster_id, field, any_value(s.value) AS value, max(c.ts) AS at
          FROM colla c JOIN streamsilver s USING (cluster_id, field) GROUP BY cluster_id, field""",
        judgedl=f"""SELECT c.source_id, c.field, CAST(c.value = l.value AS BIGINT) AS x
          FROM colla c JOIN labelled l USING (cluster_id, field) WHERE l.at - c.ts <= {KEPT_DAYS * 86400}""",
    ),
)
def _(spark, sf):
    claims = tables.event_claims(spark, sf)
    _, silver, _ = me.prepare(claims)
    at = F.timestamp_micros((F.col("ts") * 1000000).cast("long"))
    collapsed = pin(time_windows(fuse.collapse_per_source(claims), N_BATCHES, name="batch"))
    stream = _arrivals(spark, collapsed).withColumn("claimed", at)
    labels = silver.join(collapsed.groupBy("cluster_id", "field").agg(F.max("ts").alias("ts")), ["cluster_id", "field"])
    folder = scratch_path(spark, "labels")
    labels.select("cluster_id", "field", "value", at.alias("labelled")).repartition(FILES).write.parquet(folder)
    told = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    table = BatchTable(spark, scratch_path(spark, "outcomes"))
    _follow(spark, late_outcomes(stream, told, "claimed", "labelled", f"{KEPT_DAYS} DAYS", "3650 days"), "append", upsert(table))
    return tr.trust_counts(table.all())


@query("bounded_claims", assemble("SELECT cluster_id, field, value, source_id, ts, offer_id FROM stream"))
def _(spark, sf):
    cut = pin(time_windows(tables.event_claims(spark, sf), N_BATCHES, name="batch"))
    timed = _arrivals(spark, cut, copies=2).withColumn("at", F.timestamp_micros((F.col("ts") * 1000000).cast("long")))
    table = BatchTable(spark, scratch_path(spark, "unique"))
    _follow(spark, bounded_claims(timed, "at", "3650 days"), "append", upsert(table))
    return table.all().select("cluster_id", "field", "value", "source_id", "ts", "offer_id")


@query(
    "stream_prefix_fuse",
    assemble(
        "SELECT * FROM prefixwon",
        **_stream_parts(),
        colla=collapse_sql("stream"),
        weigha=f"""SELECT c.cluster_id, c.field, c.value, coalesce(t.trust, 0.5) AS trust FROM colla c
          LEFT JOIN trustb t ON t.b = {N_BATCHES - 1} AND t.source_id = c.source_id AND t.field = c.field""",
        prefixwon=vote_sql("weigha"),
    ),
)
def _(spark, sf):
    return _live(spark, sf).canonical()


@query(
    "stream_late_labels",
    assemble(
        f"SELECT source_id, field, {COUNTS} FROM judgeda GROUP BY ALL",
        colla=collapse_sql("stream"),
        judgeda="""SELECT c.source_id, c.field, CAST(c.value = s.value AS BIGINT) AS x
          FROM colla c JOIN streamsilver s USING (cluster_id, field)""",
    ),
)
def _(spark, sf):
    stream, cut, silver = _batches(spark, sf)
    live = _run(LiveFusion(spark, scratch_path(spark, "live"), silver.limit(0)), stream)
    folder = scratch_path(spark, "labels")
    silver.repartition(2 * FILES).write.parquet(folder)
    labels = spark.readStream.schema(silver.schema).option("maxFilesPerTrigger", FILES).parquet(folder)
    _follow(spark, labels, "append", live.learn_labels)
    return live.evidence()


@query(
    "stream_state_merge",
    assemble(
        """SELECT cluster_id, field, r.value AS by_rank, v.value AS by_vote FROM ranked r JOIN voted v USING (cluster_id, field)""",
        steady=STEADY,
        ranked=rank_sql("steady"),
        voted=vote_sql("steady"),
    ),
)
def _(spark, sf):
    stream, _, silver = _batches(spark, sf)
    live = LiveFusion(spark, scratch_path(spark, "live"), silver)
    _run(live, stream.withColumn("trust", (F.col("source_id").cast("long") + 1) / 32.0), live.keep_states)
    by_rank = live.canonical_by_rank().withColumnRenamed("value", "by_rank")
    return by_rank.join(live.canonical_by_vote().withColumnRenamed("value", "by_vote"), ["cluster_id", "field"])


@query(
    "stream_trust_decay",
    assemble(
        """SELECT n AS batch_id, source_id, field, round(sum(x * w), 6) AS succ, round(sum((1 - x) * w), 6) AS fail FROM (
        SELECT c.b AS n, j.*, exp(-1e-6 * greatest(c.now - j.ts, 0.0)) AS w FROM judgedb j JOIN clock c ON j.b <= c.b)
        GROUP BY ALL""",
        **_stream_parts(),
    ),
)
def _(spark, sf):
    state = _live(spark, sf, lam=1e-6).tables["state"].all()
    return _round(state.select(F.col("batch_id").cast("long"), "source_id", "field", "succ", "fail"), "succ", "fail")


METRICS_B = """SELECT b AS batch_id, batch_rows, round(coalesce(F1, 0.0), 6) AS F1, coalesce(n_eval, 0) AS n_eval,
  coalesce(updates, 0.0) AS updates, trust_pairs
  FROM (SELECT b, count(*) AS batch_rows FROM arrived GROUP BY b)
  LEFT JOIN (SELECT b, avg(CAST(f.value = s.value AS DOUBLE)) AS F1, count(*) AS n_eval
    FROM fusedb f JOIN streamsilver s USING (cluster_id, field) GROUP BY b) USING (b)
  LEFT JOIN (SELECT b, sum(succ + fail) AS updates FROM countsb GROUP BY b) USING (b)
  LEFT JOIN (SELECT b, count(*) AS trust_pairs FROM stateb GROUP BY b) USING (b)"""


@query(
    "stream_keyed_metrics",
    assemble("SELECT * EXCLUDE (trust_pairs) FROM metricsb", **_stream_parts(), metricsb=METRICS_B),
)
def _(spark, sf):
    metrics = _keyed(spark, sf).metrics()
    whole = [F.col(c).cast("long") for c in ("batch_id", "batch_rows", "n_eval")]
    return _round(metrics.select(*whole, "updates", "F1"), "F1")


@query("batch_metrics", assemble(METRICS_B, **_stream_parts()))
def _(spark, sf):
    metrics = _live(spark, sf).tables["metrics"].all()
    whole = [F.col(c).cast("long") for c in ("batch_id", "batch_rows", "n_eval", "trust_pairs")]
    return _round(metrics.select(*whole, "updates", "F1"), "F1")


@query(
    "batch_summary",
    assemble(
        """SELECT policy, round(avg(n), 6) AS mean_n, round(quantile_cont(CAST(n AS DOUBLE), 0.95), 6) AS p95_n,
        round(arg_max(F1, w), 6) AS final_F1, round(avg(F1) FILTER (w <= 5), 6) AS first5_F1,
        round(avg(F1) FILTER (w > 3), 6) AS last5_F1 FROM backtest GROUP BY policy""",
        **_drift_parts(),
    ),
)
def _(spark, sf):
    per_batch = _backtested(spark, sf).withColumnRenamed("window", "batch")
    return _round(
        mo.batch_summary(per_batch, "n", ["policy"]), "mean_n", "p95_n", "final_F1", "first5_F1", "last5_F1"
    )
