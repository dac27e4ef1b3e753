"""Queries on fusing, trust and the fusion methods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corrobora.operators import evaluate as ev, fuse, silver as sv, trust as tr
from corrobora.operators.discovery import discover_truth
from corrobora.operators.states import StateTable
from corrobora.plans import methods as me, tables
from corrobora.plans.registry import query
from corrobora.plans.sqlparts import (
    assemble,
    collapse_sql,
    rank_sql,
    source_join_sql,
    trust_join_sql,
    vote_sql,
)
from corrobora.session import pin, scratch_path

YEARLY = 1e-8  # decay per second: about a factor e in three years


def _judged(spark: SparkSession, sf: str):
    collapsed, silver, _ = me.prepare(tables.claims(spark, sf))
    return collapsed, silver, tr.adjudicate(collapsed, silver)


# ------------------------------------------------------------ rank and vote
@query("rank_fuse", assemble(rank_sql("trusted")))
def _(spark, sf) -> DataFrame:
    return fuse.rank_fuse(tables.trusted_claims(spark, sf))


WIDE = "trust, ts, q0, q1, value, offer_id"


@query(
    "rank_fuse_wide",
    assemble(rank_sql("wide", policy=WIDE), wide="SELECT *, offer_id % 7 AS q0, 0.0 AS q1 FROM trusted"),
)
def _(spark, sf):
    wide = tables.trusted_claims(spark, sf).withColumn("q0", F.col("offer_id") % 7).withColumn("q1", F.lit(0.0))
    return fuse.rank_fuse(wide, policy=[c.strip() for c in WIDE.split(",")])


RANK_STATE = """SELECT cluster_id, field, w.trust AS trust, w.ts AS ts, w.value AS value, w.offer_id AS offer_id FROM (
  SELECT cluster_id, field, max(struct_pack(trust := round(trust, 9), ts := ts, value := value, offer_id := offer_id)) AS w
  FROM trusted GROUP BY cluster_id, field)"""


def _rounded(claims: DataFrame) -> DataFrame:
    return claims.withColumn("trust", F.round("trust", 9))


@query("rank_state", assemble(RANK_STATE))
def _(spark, sf):
    return fuse.rank_state(_rounded(tables.trusted_claims(spark, sf)))


@query("rank_merge", assemble(RANK_STATE))
def _(spark, sf):
    claims = _rounded(tables.trusted_claims(spark, sf))
    states = [fuse.rank_state(claims.filter(F.col("field") == f)) for f in ("returnflag", "linestatus")]
    rest = claims.filter(~F.col("field").isin("returnflag", "linestatus"))
    old, new = rest.filter("ts < 1e9"), rest.filter("ts >= 1e9")
    return fuse.rank_merge(*states, fuse.rank_state(old), fuse.rank_state(new))


@query("rank_upsert", assemble(RANK_STATE))
def _(spark, sf):
    claims = _rounded(tables.trusted_claims(spark, sf))
    old, new = claims.filter("ts < 1e9"), claims.filter("ts >= 1e9")
    table = StateTable.create(fuse.rank_state(old), scratch_path(spark, "ranks"), ["cluster_id", "field"], 32)
    table.upsert(fuse.rank_state(new), fuse.rank_merge)
    return table.read()


@query("vote_fuse", assemble(vote_sql("trusted")))
def _(spark, sf):
    return fuse.vote_fuse(tables.trusted_claims(spark, sf))


@query(
    "vote_fuse_float",
    assemble(
        """SELECT cluster_id, field, arg_max(value, struct_pack(w := w, v := value)) AS value FROM (
        SELECT cluster_id, field, value, sum(CAST(offer_id % 16 + 1 AS DOUBLE) / 16) AS w FROM claims
        GROUP BY cluster_id, field, value) GROUP BY cluster_id, field"""
    ),
)
def _(spark, sf):
    claims = tables.claims(spark, sf).withColumn("trust", (F.col("offer_id") % 16 + 1) / 16.0)
    return fuse.vote_fuse_float(claims)


VOTE_STATE = """SELECT cluster_id, field, value, CAST(sum(CAST(round_even(trust * 4294967296.0, 0) AS BIGINT)) AS BIGINT) AS votes
  FROM trusted GROUP BY cluster_id, field, value"""


@query("vote_state", assemble(VOTE_STATE))
def _(spark, sf):
    state = fuse.vote_state(tables.trusted_claims(spark, sf))
    return state.withColumn("votes", F.col("votes").cast("long"))


@query("vote_upsert", assemble(VOTE_STATE))
def _(spark, sf):
    claims = tables.trusted_claims(spark, sf)
    old, new = claims.filter("ts < 1e9"), claims.filter("ts >= 1e9")
    table = StateTable.create(fuse.vote_state(old), scratch_path(spark, "votes"), ["cluster_id", "field", "value"], 32)
    table.upsert(fuse.vote_state(new), fuse.vote_merge)
    return table.read().withColumn("votes", F.col("votes").cast("long"))


@query("vote_merge", assemble(vote_sql("trusted")))
def _(spark, sf):
    claims = tables.trusted_claims(spark, sf)
    old, new = claims.filter("ts < 1e9"), claims.filter("ts >= 1e9")
    return fuse.vote_winner(fuse.vote_merge(fuse.vote_state(old), fuse.vote_state(new)))


@query("collapse_per_source", assemble("SELECT cluster_id, field, source_id, value, ts, offer_id FROM collapsed"))
def _(spark, sf):
    return fuse.collapse_per_source(tables.claims(spark, sf))


SHARE = """SELECT cluster_id, field, t.value AS value, CAST(t.w AS DOUBLE) / CAST(total AS DOUBLE) AS share FROM (
  SELECT cluster_id, field, max(struct_pack(w := w, value := value)) AS t, sum(w) AS total FROM (
    SELECT cluster_id, field, value, sum(CAST(round_even(trust * 4294967296.0, 0) AS BIGINT)) AS w
    FROM {source} GROUP BY cluster_id, field, value) GROUP BY cluster_id, field)"""


@query(
    "vote_share",
    assemble("SELECT cluster_id, field, value, round(share, 6) AS share FROM won", won=SHARE.format(source="weighted")),
)
def _(spark, sf):
    collapsed, _, trust = tables.learned_trust(spark, sf)
    return fuse.vote_share(tr.join_trust(collapsed, trust)).withColumn("share", F.round("share", 6))


@query(
    "abstain_gate",
    assemble(
        """SELECT cluster_id, field, CASE WHEN share >= 0.35 THEN value END AS value, round(share, 6) AS share FROM won""",
        won=SHARE.format(source="weighted"),
    ),
)
def _(spark, sf):
    collapsed, _, trust = tables.learned_trust(spark, sf)
    gated = fuse.abstain(fuse.vote_share(tr.join_trust(collapsed, trust)), 0.35)
    return gated.withColumn("share", F.round("share", 6))


#: Order lines that are fingerprinted at a time: about 5 GB of shuffle and spill files.
PASS_RECORDS = 20_000_000


def _prints(spark: SparkSession, sf: str, only: Column | None = None) -> DataFrame:
    """(kind, rows, digest_sum) of rank and vote on order lines, perhaps ``only`` some, dealt by part and dealt otherwise."""
    claims = tables.claims_of(tables.line_records(spark, sf, only=only)).withColumn("trust", F.lit(1.0))
    records = tables.line_records(spark, sf, dealt=False, only=only).repartition(13, "offer_id")  # claims lie where their records do
    shuffled = tables.claims_of(records).withColumn("trust", F.lit(1.0))
    kinds = {
        "rank": fuse.rank_fuse(claims),
        "rank2": fuse.rank_fuse(shuffled),
        "vote": fuse.vote_fuse(claims),
        "vote2": fuse.vote_fuse(shuffled),
    }
    found = [fuse.fingerprint(df).select(F.lit(name).alias("kind"), "rows", "digest_sum") for name, df in kinds.items()]
    return reduce(DataFrame.unionByName, found)


@query(
    "fingerprint",
    assemble(
        f"""SELECT rows, rows AS same_rows, true AS rank_equal, true AS vote_equal, false AS methods_equal
        FROM (SELECT count(*) AS rows FROM (SELECT DISTINCT cluster_id, field FROM claims))"""
    ),
)
def _(spark, sf):
    lines = tables.load(spark, sf, "lineitem").count()
    passes = -(-lines // PASS_RECORDS)
    if passes <= 1:
        prints = _prints(spark, sf)
    else:
        # no part lies in two passes, so their digests add up; the shuffle files of a pass go before the next
        slices = [F.pmod(F.xxhash64("l_partkey"), F.lit(passes)) == k for k in range(passes)]
        done = [pin(_prints(spark, sf, only), "prints") for only in slices]
        total = F.sum(F.col("digest_sum").cast("decimal(38,0)")).cast("string").alias("digest_sum")
        prints = reduce(DataFrame.unionByName, done).groupBy("kind").agg(F.sum("rows").alias("rows"), total)
    kinds = ["rank", "rank2", "vote", "vote2"]
    wide = prints.groupBy().pivot("kind", kinds).agg(F.first("rows").alias("n"), F.first("digest_sum").alias("d"))
    return wide.select(
        F.col("rank_n").alias("rows"),
        F.col("vote_n").alias("same_rows"),
        (F.col("rank_d") == F.col("rank2_d")).alias("rank_equal"),
        (F.col("vote_d") == F.col("vote2_d")).alias("vote_equal"),
        (F.col("rank_d") == F.col("vote_d")).alias("methods_equal"),
    )


# ------------------------------------------------------------------- trust
@query("gold_panel", assemble("SELECT field, source_id FROM panel"))
def _(spark, sf):
    return sv.gold_panel(fuse.collapse_per_source(tables.claims(spark, sf)))


@query("silver_labels", assemble("SELECT cluster_id, field, value FROM silver"))
def _(spark, sf):
    return sv.silver_labels(fuse.collapse_per_source(tables.claims(spark, sf)))


@query("adjudicate", assemble("SELECT cluster_id, field, source_id, x, ts FROM adj"))
def _(spark, sf):
    return _judged(spark, sf)[2].withColumn("x", F.col("x").cast("long"))


@query("trust_counts", assemble("SELECT source_id, field, succ, fail FROM counts"))
def _(spark, sf):
    return tr.trust_counts(_judged(spark, sf)[2])


@query(
    "trust_counts_decay",
    assemble("SELECT source_id, field, round(succ, 6) AS succ, round(fail, 6) AS fail FROM fadecounts"),
)
def _(spark, sf):
    counts = _faded(*_judged(spark, sf))
    return counts.select("source_id", "field", F.round("succ", 6).alias("succ"), F.round("fail", 6).alias("fail"))


def _faded(collapsed, silver, judged) -> DataFrame:
    t_now = collapsed.agg(F.max("ts")).first()[0]
    return tr.trust_counts(judged, tr.decay_weight(t_now, YEARLY))


def _register_trust(mode: str, part: str) -> None:
    @query(f"trust_{mode}", assemble(f"SELECT source_id, field, round(trust, 6) AS trust FROM {part}"))
    def _(spark, sf):
        trust = tr.trust_table(tr.trust_counts(_judged(spark, sf)[2]), mode)
        return trust.select("source_id", "field", F.round("trust", 6).alias("trust"))


for _mode, _part in (("mean", "trust"), ("map", "trustmap"), ("lcb", "trustlcb")):
    _register_trust(_mode, _part)


@query("hit_rate_source", assemble("SELECT source_id, round(trust, 6) AS trust FROM rate"))
def _(spark, sf):
    return tr.hit_rate(_judged(spark, sf)[2]).withColumn("trust", F.round("trust", 6))


@query("hit_rate_field", assemble("SELECT source_id, field, round(trust, 6) AS trust FROM ratefield"))
def _(spark, sf):
    rates = tr.hit_rate(_judged(spark, sf)[2], ["source_id", "field"], smooth=False)
    return rates.withColumn("trust", F.round("trust", 6))


@query(
    "join_trust",
    assemble(
        f"""SELECT cluster_id, field, source_id, value, ts, offer_id, round(trust, 6) AS trust FROM trusted"""
    ),
)
def _(spark, sf):
    return tables.trusted_claims(spark, sf).withColumn("trust", F.round("trust", 6))


STREAM_RELIABLE = f"""SELECT source_id, field, (2.0 + sum(x)) / (4.0 + count(*)) AS trust FROM (
  SELECT c.source_id, c.field, CAST(c.value = s.value AS BIGINT) AS x
  FROM streamcollapsed c JOIN streamsilver s USING (cluster_id, field)) GROUP BY source_id, field HAVING count(*) >= 20"""


@query(
    "join_trust_inner",
    assemble(
        """SELECT c.cluster_id, c.field, c.source_id, c.value, c.ts, c.offer_id, round(t.trust, 6) AS trust
        FROM stream c JOIN reliable t ON c.source_id = t.source_id AND c.field = t.field""",
        reliable=STREAM_RELIABLE,
    ),
)
def _(spark, sf):
    claims = tables.event_claims(spark, sf)
    collapsed, silver, _ = me.prepare(claims)
    trust = tr.trust_table(tr.trust_counts(tr.adjudicate(collapsed, silver)))
    joined = tr.join_trust(claims, trust.filter("n_eff >= 20"), how="inner")
    return joined.withColumn("trust", F.round("trust", 6))


# ----------------------------------------------------------------- methods
@query("recency_first", assemble(rank_sql("collapsed", policy="ts, offer_id, value")))
def _(spark, sf):
    return me.recency_first(fuse.collapse_per_source(tables.claims(spark, sf)))


@query("cluster_majority", assemble(vote_sql("one"), one="SELECT *, 1.0 AS trust FROM collapsed"))
def _(spark, sf):
    return me.cluster_majority(fuse.collapse_per_source(tables.claims(spark, sf)))


def _register_learned(name: str, fn, part_sql: str, fuse_sql) -> None:
    @query(name, assemble(fuse_sql("ready"), ready=part_sql))
    def _(spark, sf):
        collapsed, silver, judged = _judged(spark, sf)
        return fn(collapsed, silver, judged)


_register_learned(
    "source_priority", lambda c, s, j: me.source_priority(c, j), source_join_sql("collapsed", "rate"), rank_sql
)
_register_learned(
    "weighted_vote_global",
    lambda c, s, j: me.weighted_vote_global(c, j),
    source_join_sql("collapsed", "rate"),
    vote_sql,
)
_register_learned(
    "weighted_vote_field",
    lambda c, s, j: me.weighted_vote_field(c, j),
    trust_join_sql("collapsed", "ratefield"),
    vote_sql,
)
_register_learned(
    "oracle_bound", lambda c, s, j: me.oracle_bound(c, j), trust_join_sql("collapsed", "ratesmooth"), vote_sql
)
for _mode, _part in (("mean", "trust"), ("map", "trustmap"), ("lcb", "trustlcb")):
    _register_learned(
        f"rank_{_mode}",
        lambda c, s, j, m=_mode: me.trust_rank(c, tr.trust_table(tr.trust_counts(j), m)),
        trust_join_sql("collapsed", _part),
        rank_sql,
    )
for _mode, _part in (("mean", "trust"), ("lcb", "trustlcb")):
    _register_learned(
        f"vote_{_mode}",
        lambda c, s, j, m=_mode: me.trust_vote(c, tr.trust_table(tr.trust_counts(j), m)),
        trust_join_sql("collapsed", _part),
        vote_sql,
    )
for _name, _mode, _part in (("vote_decay", "mean", "trustfade"), ("vote_lcb_decay", "lcb", "trustlcbfade")):
    _register_learned(
        _name,
        lambda c, s, j, m=_mode: me.trust_vote(c, tr.trust_table(_faded(c, s, j), m)),
        trust_join_sql("collapsed", _part),
        vote_sql,
    )


def _em_parts(rounds: int) -> dict[str, str]:
    """The rounds of truth discovery, one after the other."""
    extra = {"em0": "SELECT *, CAST(0.8 AS DOUBLE) AS trust FROM collapsed", "win0": vote_sql("em0")}
    for i in range(1, rounds):
        extra[f"weight{i}"] = f"""SELECT source_id, (sum(CAST(c.value = w.value AS BIGINT)) + 1.0) / (count(*) + 2.0) AS trust
          FROM collapsed c JOIN win{i - 1} w USING (cluster_id, field) GROUP BY source_id"""
        extra[f"em{i}"] = source_join_sql("collapsed", f"weight{i}")
        extra[f"win{i}"] = vote_sql(f"em{i}")
    return extra


@query("em_truth", assemble(f"SELECT cluster_id, field, value FROM win{me.EM_ROUNDS - 1}", **_em_parts(me.EM_ROUNDS)))
def _(spark, sf):
    return me.em_truth(me.prepare(tables.claims(spark, sf))[0])


def _convergence_sql(rounds: int) -> str:
    """How far each re-weighing moved the sources, up to the first that moves none."""
    moves = []
    for i in range(1, rounds):
        before = f"SELECT source_id, trust AS b FROM weight{i - 1}" if i > 1 else f"SELECT DISTINCT source_id, {me.EM_INIT} AS b FROM collapsed"
        moves.append(
            f"""SELECT {i} AS round, count(*) FILTER (t.trust <> b) AS sources, coalesce(sum(n) FILTER (t.trust <> b), 0) AS claims,
            max(abs(t.trust - b)) AS largest FROM weight{i} t JOIN ({before}) USING (source_id)
            JOIN (SELECT source_id, count(*) AS n FROM collapsed GROUP BY source_id) USING (source_id)"""
        )
    final = f"""SELECT round, sources, CAST(claims AS BIGINT) AS claims, round(largest, 9) AS largest FROM moves
      WHERE round <= coalesce((SELECT min(round) FROM moves WHERE sources = 0), {rounds})"""
    return assemble(final, **_em_parts(rounds), moves=" UNION ALL ".join(moves))


@query("em_convergence", _convergence_sql(me.EM_ROUNDS))
def _(spark, sf):
    collapsed, _, _ = me.prepare(tables.claims(spark, sf))
    report = discover_truth(collapsed, me.EM_ROUNDS, me.EM_INIT)[1]
    return report.select("round", "sources", "claims", F.round("largest", 9).alias("largest"))


# -------------------------------------------------------------- evaluation
def _scored(spark, sf):
    collapsed, silver, trust = tables.learned_trust(spark, sf)
    return me.trust_vote(collapsed, trust), silver


FIELD_PRF = """SELECT field, correct / greatest(answered, 1) AS P, correct / greatest(n, 1) AS R, n, answered,
  CASE WHEN correct = 0 THEN 0.0 ELSE 2 * (correct / answered) * (correct / n) / (correct / answered + correct / n) END AS F1
  FROM (SELECT field, count(*) AS n, count(pred) AS answered,
          CAST(coalesce(sum(CAST(pred = truth AS BIGINT)), 0) AS BIGINT) AS correct FROM joined GROUP BY field)"""


@query(
    "field_prf",
    assemble(
        "SELECT field, round(P, 6) AS P, round(R, 6) AS R, round(F1, 6) AS F1, n, answered FROM scored", scored=FIELD_PRF
    ),
)
def _(spark, sf):
    return _round(ev.field_prf(*_scored(spark, sf)), "P", "R", "F1")


def _round(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(c, digits))
    return df


@query(
    "macro_prf",
    assemble("SELECT round(avg(P), 6) AS P, round(avg(R), 6) AS R, round(avg(F1), 6) AS F1 FROM scored", scored=FIELD_PRF),
)
def _(spark, sf):
    return _round(ev.macro_prf(*_scored(spark, sf)), "P", "R", "F1")


@query(
    "micro_prf",
    assemble(
        """SELECT round(P, 6) AS P, round(R, 6) AS R, round(2 * P * R / (P + R), 6) AS F1, n, answered FROM (
        SELECT count(*) AS n, count(pred) AS answered, sum(CAST(pred = truth AS BIGINT)) / count(pred) AS P,
          sum(CAST(pred = truth AS BIGINT)) / count(*) AS R FROM joined)"""
    ),
)
def _(spark, sf):
    return _round(ev.micro_prf(*_scored(spark, sf)), "P", "R", "F1")


@query(
    "entity_exact_match",
    assemble(
        """SELECT round(avg(CAST(ok AS DOUBLE)), 6) AS EM FROM (
        SELECT cluster_id, bool_and(coalesce(pred = truth, false)) AS ok FROM joined GROUP BY cluster_id)"""
    ),
)
def _(spark, sf):
    return _round(ev.entity_exact_match(*_scored(spark, sf)), "EM")


@query("accuracy", assemble("SELECT round(avg(CAST(coalesce(pred = truth, false) AS DOUBLE)), 6) AS accuracy FROM joined"))
def _(spark, sf):
    return _round(ev.accuracy(*_scored(spark, sf)), "accuracy")


@query(
    "majority_coincidence",
    assemble(
        """SELECT count(*) AS silver_pairs, count(DISTINCT s.cluster_id) AS silver_clusters,
        round(avg(CAST(coalesce(m.value = s.value, false) AS DOUBLE)), 6) AS coincidence
        FROM silver s LEFT JOIN majority m USING (cluster_id, field)""",
        one="SELECT *, 1.0 AS trust FROM collapsed",
        majority=vote_sql("one"),
    ),
)
def _(spark, sf):
    collapsed, silver, _ = me.prepare(tables.claims(spark, sf))
    rows = ev.judged(me.cluster_majority(collapsed), silver)
    same = F.coalesce(F.col("pred") == F.col("truth"), F.lit(False)).cast("double")
    return rows.agg(
        F.count("*").alias("silver_pairs"),
        F.count_distinct("cluster_id").alias("silver_clusters"),
        F.round(F.avg(same), 6).alias("coincidence"),
    )


@query(
    "source_agreement",
    assemble(
        """SELECT count(*) AS n, round(avg(CAST(a.value = b.value AS DOUBLE)), 6) AS agreement
        FROM said a JOIN said b USING (cluster_id, field) WHERE a.source_id = 'F' AND b.source_id = 'O'""",
        said="SELECT cluster_id, field, source_id, value FROM twocollapsed",
        twocollapsed=collapse_sql("twoclaims"),
    ),
)
def _(spark, sf):
    collapsed = fuse.collapse_per_source(tables.two_source_claims(spark, sf))
    return _round(ev.source_agreement(collapsed, "F", "O"), "agreement")


@query(
    "fusion_coverage",
    assemble(
        """SELECT rows, clusters, fields, round(rows / (clusters * fields), 6) AS coverage FROM (
        SELECT count(*) AS rows, count(DISTINCT cluster_id) AS clusters, count(DISTINCT field) AS fields FROM (
          SELECT DISTINCT cluster_id, field FROM offerclaims))"""
    ),
)
def _(spark, sf):
    from corrobora.operators.prepare import unpivot_claims

    offers = tables.part_offers(spark, sf)
    claims = unpivot_claims(offers, ["cluster_id", "offer_id", "source_id", "ts"], ["Name", "Type"], None)
    return _round(ev.fusion_coverage(me.cluster_majority(claims)), "coverage")
