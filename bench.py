"""Headline timings; prints one JSON line.

Inputs of an operator are prepared and written first; a timing is the operator
from the Parquet scan to the last row of its result, best of two runs after
one warm-up (results go to the no-op sink, so every output row is computed).
``vote_mean_end_to_end`` starts at the raw test tables.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from corrobora.operators import fuse, trust as tr
from corrobora.operators.monitor import batch_summary
from corrobora.operators.prepare import dict_encode, replicate_claims
from corrobora.plans import catalog, methods as me, monitor_queries as mq, tables
from corrobora.session import local_session, pin, scratch_path
from corrobora.streaming.keyed import KeyedFusion
from corrobora.streaming.live import LiveFusion, batch_latency, label_sample

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
BIG_ROWS = int(os.environ.get("BENCH_ROWS", "10000000"))
TUPLE = ("trust", "ts", "value_code", "offer_id")
CODED_GROUP = ("cluster_id", "field_code")


def seconds(build: Callable[[], DataFrame], runs: int = 2, warm: int = 1) -> float:
    best = float("inf")
    for i in range(warm + runs):
        start = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        if i >= warm:
            best = min(best, time.perf_counter() - start)
    return round(best, 3)


def stream_latency(spark) -> dict[str, float]:
    """Mean and 95th percentile of the engine's time per micro-batch of the event stream, and rows per batch."""
    stream, cut, silver = mq._batches(spark, SF_DIR)
    live = LiveFusion(spark, scratch_path(spark, "live"), silver, label_fraction=0.2)
    keyed = KeyedFusion(spark, scratch_path(spark, "keyed"), silver, label_sample(0.2, F.col("batch") - 1))
    found = {"rows": cut.count() // mq.N_BATCHES}
    for name, running in (("keyed", keyed.start(stream)), ("", live.start(stream).trigger(availableNow=True).start())):
        running.awaitTermination()
        scored = batch_latency(running, spark).withColumn("F1", F.lit(0.0))
        if name:  # once the engine is warm
            scored = scored.filter("batch > 1")
        line = batch_summary(scored, "latency_s").first()
        prefix = f"{name}_" if name else ""
        found |= {f"{prefix}mean_s": round(line["mean_latency_s"], 3), f"{prefix}p95_s": round(line["p95_latency_s"], 3)}
    return found


GRID = ("recency_first", *me.RANK_METHODS, *me.VOTE_METHODS)


def main() -> None:
    spark = local_session(CPUS, memory=os.environ.get("BENCH_MEMORY", "16g"), shuffle_partitions=int(CPUS))
    collapsed, silver, trust = tables.learned_trust(spark, SF_DIR)
    trust = pin(trust)
    raw = pin(tr.join_trust(tables.claims(spark, SF_DIR), trust).repartition(int(CPUS)))
    judged = pin(tr.adjudicate(collapsed, silver))
    coded = pin(dict_encode(dict_encode(raw, "field"), "value"))
    codes = [F.col("field_code").cast("byte").alias("field_code"), F.col("value_code").cast("int").alias("value_code")]
    small = coded.select("cluster_id", "trust", "ts", "offer_id", *codes)
    big = pin(replicate_claims(small, BIG_ROWS, ["offer_id", "field_code", "ts"]).repartition(2 * int(CPUS)))

    extras = [f"q{i}" for i in range(12)]
    # stored columns that no plan can fold away: few distinct values, so they are compared often
    stored = [(F.xxhash64("offer_id", F.lit(i)) % 4 / 4.0).alias(n) for i, n in enumerate(extras)]
    padded = pin(big.select("*", *stored))

    def wide(extra: int) -> DataFrame:
        names = extras[:extra]
        return fuse.rank_fuse(padded, ["trust", "ts", *names, "value_code", "offer_id"], CODED_GROUP, "value_code")

    def sized(rows: int) -> DataFrame:
        """The big table tiled or cut to ``rows``."""
        return pin(replicate_claims(small, rows, ["offer_id", "field_code", "ts"]).repartition(2 * int(CPUS)))

    million = sized(1_000_000)
    music = sized(842_985)
    # as many outcomes and sources as the published trust update
    outcomes = pin(
        spark.range(36_000).select(
            (F.col("id") * 7919 % 5000).cast("string").alias("source_id"),
            F.concat(F.lit("f"), (F.col("id") % 3).cast("string")).alias("field"),
            (F.xxhash64("id") % 3 != 0).cast("byte").alias("x"),
        )
    )

    counts = {
        "raw": raw.count(), "collapsed": collapsed.count(), "big": big.count(), "judged": judged.count(),
    }
    cases: dict[str, tuple[Callable[[], DataFrame], int]] = {
        "rank_big": (lambda: fuse.rank_fuse(big, TUPLE, CODED_GROUP, "value_code"), counts["big"]),
        "rank_big_width8": (lambda: wide(4), counts["big"]),
        "rank_big_width16": (lambda: wide(12), counts["big"]),
        "rank_1m": (lambda: fuse.rank_fuse(million, TUPLE, CODED_GROUP, "value_code"), 1_000_000),
        "vote_842985": (lambda: fuse.vote_fuse(music, group=CODED_GROUP, value="value_code"), 842_985),
        "trust_update_36000": (lambda: tr.trust_table(tr.trust_counts(outcomes)), 36_000),
        "vote_big": (lambda: fuse.vote_fuse(big, group=CODED_GROUP, value="value_code"), counts["big"]),
        "rank_raw": (lambda: fuse.rank_fuse(raw), counts["raw"]),
        "vote_raw": (lambda: fuse.vote_fuse(raw), counts["raw"]),
        "vote_collapsed": (lambda: fuse.vote_fuse(tr.join_trust(collapsed, trust)), counts["collapsed"]),
        "collapse_raw": (lambda: fuse.collapse_per_source(raw), counts["raw"]),
        "trust_update": (lambda: tr.trust_table(tr.trust_counts(judged)), counts["judged"]),
        "trust_lcb": (lambda: tr.trust_table(tr.trust_counts(judged), "lcb"), counts["judged"]),
        "vote_mean_end_to_end": (lambda: catalog.QUERIES["vote_mean"](spark, SF_DIR), counts["raw"]),
    }
    times = {name: seconds(build) for name, (build, _) in cases.items()}
    times["em_truth"] = seconds(lambda: me.em_truth(collapsed), runs=1, warm=1)
    times["compare_methods"] = seconds(lambda: me.compare_methods(collapsed, silver, 100, lam=1e-8, include=GRID), runs=1, warm=0)
    rows = {name: n for name, (_, n) in cases.items()} | {"em_truth": counts["collapsed"], "compare_methods": counts["collapsed"]}
    latency = stream_latency(spark)
    print(
        json.dumps(
            {
                "metric": "fusion_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "stream_batch": latency,
                "rows": rows,
                "mrows_per_s": {name: round(rows[name] / t / 1e6, 3) for name, t in times.items()},
                "sf": os.path.basename(SF_DIR.rstrip("/")),
                "cpus": int(CPUS),
            }
        )
    )


if __name__ == "__main__":
    main()
