"""Stream fusion with its trust kept as keyed state in the engine: one job per micro-batch.

Claims pass a stateful operator keyed by (source, field). It collapses each
source's claims, hands them on with the evidence known before the batch, and
adds the outcomes of the labels that the batch reveals. The vote follows in the
same job. State lives in the engine's RocksDB store under the query's
checkpoint, by batch, so a replayed batch starts from the version before it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corrobora.operators.evaluate import _f1
from corrobora.operators.fuse import fixed_point, usable_key
from corrobora.operators.trust import DELTA, PRIOR_A, PRIOR_B, trust_table
from corrobora.schema import GROUP, SOURCE_FIELD
from corrobora.streaming.live import BatchTable

# Ship the processor by value, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

EVIDENCE = "succ double, fail double"
HEARD = "cluster_id long, field string, value string, label string, n long, hit long, miss long, known boolean, succ double, fail double"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def collapsed(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(cluster_id, value, label, revealed, n) of one source and field: each cluster's most frequent value.

    Ties go to the newest, then the greatest offer id, then the greatest value; ``n`` counts the cluster's claims.
    """
    states: dict = {}
    for cluster, value, ts, offer, label, revealed in rows:
        seen = states.setdefault(cluster, (label, revealed, {}))[2]
        n, last, most = seen.get(value, (0, ts, offer))
        seen[value] = n + 1, max(last, ts), max(most, offer)
    for cluster, (label, revealed, seen) in states.items():
        best = max(seen, key=lambda v: (*seen[v], v is not None, v))
        yield cluster, best, label, revealed, sum(s[0] for s in seen.values())


class Evidence(StatefulProcessor):
    """One value state per (source, field): its successes and failures so far; a pair without outcomes has none."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.evidence = handle.getValueState("evidence", EVIDENCE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        field = key[1]
        before = self.evidence.get()
        columns = ("cluster_id", "value", "ts", "offer_id", "label", "revealed")
        claims = (row for frame in rows for row in zip(*[frame[c].tolist() for c in columns]))
        out, hits, misses = [], 0, 0
        for cluster, value, label, revealed, n in collapsed(claims):
            told = revealed and label is not None and value is not None
            hit, miss = int(told and value == label), int(told and value != label)
            hits, misses = hits + hit, misses + miss
            out.append((cluster, field, value, label, n, hit, miss, before is not None, *(before or (0.0, 0.0))))
        if hits or misses:
            succ, fail = before or (0.0, 0.0)
            self.evidence.update((succ + hits, fail + misses))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in HEARD.split(", ")])

    def close(self) -> None:
        pass


@dataclass
class KeyedFusion:
    """Fuse a stream of claims; its trust is keyed state of the engine.

    ``silver`` holds the labels and ``revealed`` says, by the columns of a claim, which labels
    are learned from with its batch; they count for later batches only. Pairs
    without evidence weigh the prior mean. A null key fails the query.
    """

    spark: SparkSession
    root: str
    silver: DataFrame
    revealed: Column
    delta: float = DELTA
    mode: str = "lcb"

    @property
    def fused(self) -> BatchTable:
        return BatchTable(self.spark, f"{self.root}/fused")

    def heard(self, claims: DataFrame) -> DataFrame:
        """The streamed claims, collapsed per batch, with the trust that earlier batches left."""
        keyed = claims.select(*[usable_key(c).alias(c) for c in (*GROUP, "source_id")], "value", "ts", "offer_id", self.revealed.alias("revealed"))
        labels = self.silver.select(*GROUP, F.col("value").alias("label"))
        rows = keyed.join(labels, list(GROUP), "left")
        out = rows.groupBy(*SOURCE_FIELD).transformWithStateInPandas(Evidence(), HEARD, "Append", "None")
        prior = F.lit(PRIOR_A / (PRIOR_A + PRIOR_B))
        trust = trust_table(out, self.mode, self.delta, by=out.columns)
        return trust.withColumn("trust", F.when(F.col("known"), F.col("trust")).otherwise(prior))

    def fuse_batch(self, heard: DataFrame, batch_id: int) -> None:
        """Vote on one batch and write it, with what :meth:`metrics` needs: one job."""
        counts = [F.sum(c).alias(c) for c in ("n", "hit", "miss")]
        votes = heard.groupBy(*GROUP, "value").agg(F.sum(fixed_point(F.col("trust"))).alias("votes"), F.max("label").alias("label"), *counts)
        best = votes.groupBy(*GROUP).agg(F.max(F.struct("votes", "value")).alias("top"), F.max("label").alias("label"), *counts)
        best.select(*GROUP, "top.value", "label", "n", "hit", "miss").write.mode("overwrite").parquet(self.fused.path(batch_id))

    def start(self, claims: DataFrame, **trigger) -> StreamingQuery:
        """Start the query; ``trigger`` as of the engine, everything that has arrived unless given."""
        provider = "spark.sql.streaming.stateStore.providerClass"
        before = self.spark.conf.get(provider, None)
        self.spark.conf.set(provider, ROCKSDB)
        try:
            writer = self.heard(claims).writeStream.outputMode("append").foreachBatch(self.fuse_batch)
            return writer.option("checkpointLocation", f"{self.root}/checkpoint").trigger(**trigger or {"availableNow": True}).start()
        finally:
            self.spark.conf.set(provider, before) if before is not None else self.spark.conf.unset(provider)

    def evidence(self, batch_id: int | None = None) -> DataFrame:
        """(source_id, field, succ, fail) as of a batch, the last unless given, read from the engine's state."""
        reader = self.spark.read.format("statestore").option("stateVarName", "evidence")
        reader = reader if batch_id is None else reader.option("batchId", batch_id)
        return reader.load(f"{self.root}/checkpoint").select("key.source_id", "key.field", "value.succ", "value.fail")

    def metrics(self) -> DataFrame:
        """Volume and quality of every batch: (batch_id, batch_rows, F1, n_eval, updates)."""
        right = F.count_if(F.col("value") == F.col("label"))
        answered = F.count_if(F.col("value").isNotNull() & F.col("label").isNotNull())
        tally = self.fused.all().groupBy("batch_id").agg(
            F.sum("n").alias("batch_rows"), right.alias("right"), F.count("label").alias("n_eval"), answered.alias("answered"),
            F.sum(F.col("hit") + F.col("miss")).cast("double").alias("updates"),
        )
        share = _f1(F.col("right") / F.greatest("answered", F.lit(1)), F.col("right") / F.greatest("n_eval", F.lit(1)))
        return tally.select("batch_id", "batch_rows", share.alias("F1"), "n_eval", "updates")


def late_outcomes(claims: DataFrame, labels: DataFrame, claimed_at: str, labelled_at: str, within: str, delay: str) -> DataFrame:
    """Outcomes ``x`` of streamed claims whose label streams in later, at most ``within`` after the claim.

    A watermarked interval join: the engine keeps a claim no longer than a label
    for it may still come, and either side no longer than ``delay`` behind its
    stream. ``claims`` should be one per (group, source); a label counts once for
    each of them, and not at all for a claim older than ``within``.
    """
    left = claims.withWatermark(claimed_at, delay).select(*GROUP, "source_id", "value", "ts", F.col(claimed_at).alias("_claimed"))
    right = labels.withWatermark(labelled_at, delay).select(*[F.col(c).alias(f"_{c}") for c in GROUP], F.col("value").alias("_truth"), F.col(labelled_at).alias("_labelled"))
    same = [F.col(c) == F.col(f"_{c}") for c in GROUP]
    timely = F.expr(f"_labelled >= _claimed AND _labelled <= _claimed + INTERVAL {within}")
    joined = left.join(right, reduce(and_, same) & timely)
    return joined.select(*GROUP, "source_id", (F.col("value") == F.col("_truth")).cast("byte").alias("x"), "ts", "_claimed")
