"""Micro-batch fusion on Structured Streaming.

Each micro-batch is fused with the trust learned from earlier batches; labels
that arrive with it only count for later ones. All state is written per batch
id under ``root`` and replaced as a whole when a batch is replayed, so a
restarted query neither loses nor double-counts anything.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from corrobora.functions.ids import sampled
from corrobora.operators.evaluate import micro_prf
from corrobora.operators.fuse import (
    collapse_state,
    merge_source_states,
    rank_merge,
    rank_state,
    source_state,
    top_row,
    vote_fuse,
    vote_merge,
    vote_state,
    vote_winner,
)
from corrobora.operators.joins import lookup_join
from corrobora.operators.trust import (
    DELTA,
    adjudicate,
    decay_weight,
    join_trust,
    trust_counts,
    trust_table,
)
from corrobora.schema import GROUP, POLICY, SOURCE_FIELD
from corrobora.session import pin, release


def written(df: DataFrame) -> DataFrame:
    """Mark a table read back from the shared folder, so that it is not pinned again."""
    df._pinned = True
    return df


class BatchTable:
    """A table written one micro-batch at a time: ``<root>/batch_id=<n>``.

    A table of states can be folded: every ``fold_every`` batches the merged state
    of all batches so far is written beside it, so that reading the whole
    costs one snapshot and at most ``fold_every`` batches.
    """

    def __init__(self, spark: SparkSession, root: str, merge: Callable[[DataFrame], DataFrame] | None = None, fold_every: int = 16):
        self.spark, self.root, self.merge, self.fold_every = spark, root, merge, fold_every

    def path(self, batch_id: int) -> str:
        return f"{self.root}/batch_id={batch_id}"

    def put(self, batch_id: int, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(batch_id))
        if self.merge and (batch_id + 1) % self.fold_every == 0:
            self._snapshots().put(batch_id, self.merge(self._upto(batch_id, batch_id - self.fold_every)))
        return self.get(batch_id, df.schema)

    def get(self, batch_id: int, schema=None) -> DataFrame:
        reader = self.spark.read.schema(schema) if schema is not None else self.spark.read
        return written(reader.parquet(self.path(batch_id)))

    def all(self) -> DataFrame:
        """Every batch, with its number as ``batch_id``."""
        return self.spark.read.option("basePath", self.root).parquet(self.root)

    def merged(self) -> DataFrame:
        """The state of all batches so far: the last snapshot and the batches after it."""
        last = self.last()
        return self.merge(self._upto(last, (last + 1) // self.fold_every * self.fold_every - 1))

    def last(self) -> int:
        """The number of the newest batch."""
        context = self.spark.sparkContext
        place = context._jvm.org.apache.hadoop.fs.Path(self.root)
        listed = place.getFileSystem(context._jsc.hadoopConfiguration()).listStatus(place)
        names = [e.getPath().getName() for e in listed]
        return max(int(n.partition("=")[2]) for n in names if n.startswith("batch_id="))

    def _snapshots(self) -> BatchTable:
        return BatchTable(self.spark, f"{self.root}_snapshot")

    def _upto(self, last: int, snapshot: int) -> DataFrame:
        parts = [self.get(b) for b in range(snapshot + 1, last + 1)]
        if snapshot >= 0:
            parts.append(self._snapshots().get(snapshot))
        return reduce(DataFrame.unionByName, parts)


def label_sample(fraction: float, batch: Column | int) -> Column:
    """Which labels are revealed with a batch: a fixed pseudo-random ``fraction`` of the groups."""
    return sampled(fraction, F.col("cluster_id"), F.col("field"), batch)


@dataclass
class LiveFusion:
    """Fuse a stream of claims with continuously learned trust.

    ``silver`` holds the labels; a ``label_fraction`` of those a batch touches is
    adjudicated after it. With ``lam`` the evidence fades with time; its state
    stays one row per source and field, since exponential fading lets old
    counts be rescaled to a new reference time.
    """

    spark: SparkSession
    root: str
    silver: DataFrame
    label_fraction: float = 1.0
    delta: float = DELTA
    lam: float | None = None
    mode: str = "lcb"
    tables: dict[str, BatchTable] = field(init=False)

    def __post_init__(self) -> None:
        merges = {
            "fused": None, "state": None, "metrics": None, "late": None,
            "rank_state": rank_merge, "vote_state": vote_merge, "claims": merge_source_states,
        }
        self.tables = {n: BatchTable(self.spark, f"{self.root}/{n}", merge) for n, merge in merges.items()}

    # ------------------------------------------------------------- batches
    def state_before(self, batch_id: int) -> DataFrame | None:
        """Evidence and trust that the previous batch left, or None at the start.

        The engine begins a batch only after the one before it is committed, so a
        missing state is an error and not a fresh start.
        """
        return self.tables["state"].get(batch_id - 1) if batch_id else None

    def fuse_batch(self, batch: DataFrame, batch_id: int) -> None:
        """Fuse one micro-batch, then learn from the labels it reveals.

        The labels of the batch's groups are fetched once, for learning and for scoring.
        """
        old = self.state_before(batch_id)
        seen = self.tables["claims"].put(batch_id, source_state(batch))
        collapsed = pin(collapse_state(seen), "collapsed")
        weighted = collapsed.withColumn("trust", F.lit(0.5)) if old is None else join_trust(collapsed, old)
        fused = self.tables["fused"].put(batch_id, vote_fuse(weighted))
        groups = pin(fused.select(*GROUP), "groups")
        labels = pin(lookup_join(self.silver, groups, list(GROUP), "left_semi"), "labels")
        revealed = labels.filter(label_sample(self.label_fraction, batch_id))
        state = self._learn(adjudicate(collapsed, revealed), collapsed, old, batch_id)
        self._measure(seen, fused, labels, state, batch_id)
        release(collapsed, groups, labels)

    def learn_labels(self, labels: DataFrame, batch_id: int) -> None:
        """Learn from a micro-batch of labels that come later than their claims.

        Each label is held against everything seen of its group so far. The
        outcomes are kept per batch of labels and added by :meth:`evidence`.
        """
        truth = pin(labels.select(*GROUP, "value").dropDuplicates(list(GROUP)), "late")
        groups = pin(truth.select(*GROUP), "groups")
        seen = lookup_join(self.tables["claims"].merged(), groups, list(GROUP), "left_semi")
        self.tables["late"].put(batch_id, trust_counts(adjudicate(collapse_state(seen), truth)))
        release(truth, groups)

    def evidence(self) -> DataFrame:
        """Success and failure counts per (source, field): the last state, and all late labels."""
        state = self.tables["state"]
        counts = state.get(state.last()).select(*SOURCE_FIELD, "succ", "fail")
        late = self.tables["late"].all().select(*SOURCE_FIELD, "succ", "fail")
        both = counts.unionByName(late).groupBy(*SOURCE_FIELD)
        return both.agg(F.sum("succ").alias("succ"), F.sum("fail").alias("fail"))

    def _learn(
        self, judged: DataFrame, collapsed: DataFrame, old: DataFrame | None, batch_id: int
    ) -> DataFrame:
        """Add the batch's outcomes to the state; ``new_succ`` and ``new_fail`` keep what it added."""
        if self.lam is None:
            now, fade = F.lit(0.0), F.lit(1.0)
            news = trust_counts(judged)
        else:
            latest = collapsed.agg(F.max("ts").alias("t"))
            if old is not None:
                latest = latest.unionByName(old.agg(F.max("t_ref").alias("t")))
            t_now = latest.agg(F.max("t")).first()[0]
            now = F.lit(t_now)
            fade = F.exp(-F.lit(float(self.lam)) * (now - F.col("t_ref")))
            news = trust_counts(judged, decay_weight(now, self.lam))
        counts = ["succ", "fail", "new_succ", "new_fail"]
        parts = news.select(*SOURCE_FIELD, "succ", "fail", F.col("succ").alias("new_succ"), F.col("fail").alias("new_fail"))
        if old is not None:
            nothing = F.lit(0.0)
            faded = old.select(
                *SOURCE_FIELD,
                (F.col("succ") * fade).alias("succ"),
                (F.col("fail") * fade).alias("fail"),
                nothing.alias("new_succ"),
                nothing.alias("new_fail"),
            )
            parts = faded.unionByName(parts)
        merged = parts.groupBy(*SOURCE_FIELD).agg(*[F.sum(c).alias(c) for c in counts])
        extras = [*SOURCE_FIELD, *counts]
        trust = trust_table(merged, self.mode, self.delta, by=extras)
        return self.tables["state"].put(batch_id, trust.select(*extras, "trust").withColumn("t_ref", now))

    def _measure(self, seen: DataFrame, fused: DataFrame, labels: DataFrame, state: DataFrame, batch_id: int) -> None:
        """One line of quality and volume per batch."""
        facts = [
            seen.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("batch_rows")),
            micro_prf(fused, labels).select("F1", F.col("n").alias("n_eval")),
            state.agg(
                F.coalesce(F.sum(F.col("new_succ") + F.col("new_fail")), F.lit(0.0)).alias("updates"),
                F.count("*").alias("trust_pairs"),
            ),
        ]
        long = [f.unpivot([], [F.col(c).cast("double").alias(c) for c in f.columns], "k", "v") for f in facts]
        names = ["batch_rows", "F1", "n_eval", "updates", "trust_pairs"]
        line = long[0].unionByName(long[1]).unionByName(long[2])
        self.tables["metrics"].put(batch_id, line.groupBy().pivot("k", names).agg(F.first("v")).fillna(0.0))

    def keep_states(self, batch: DataFrame, batch_id: int) -> None:
        """Write the batch's rank and vote states; merging all of them fuses everything seen so far."""
        self.tables["rank_state"].put(batch_id, rank_state(batch))
        self.tables["vote_state"].put(batch_id, vote_state(batch))

    # -------------------------------------------------------------- results
    def canonical_by_rank(self, policy=POLICY) -> DataFrame:
        """Rank winners over all batches so far."""
        return rank_merge(self.tables["rank_state"].merged(), policy=policy).select(*GROUP, "value")

    def canonical_by_vote(self) -> DataFrame:
        """Vote winners over all batches so far, each claim at the weight it arrived with."""
        return vote_winner(self.tables["vote_state"].merged())

    def canonical(self) -> DataFrame:
        """Everything seen so far, collapsed per source and voted on with the trust learned by now."""
        state = self.tables["state"]
        return vote_fuse(join_trust(collapse_state(self.tables["claims"].merged()), state.get(state.last())))

    def start(self, claims: DataFrame, step: Callable[[DataFrame, int], None] | None = None) -> DataStreamWriter:
        """Writer that applies ``step`` (default :meth:`fuse_batch`) to each micro-batch of ``claims``."""
        return (
            claims.writeStream.foreachBatch(step or self.fuse_batch)
            .option("checkpointLocation", f"{self.root}/checkpoint")
        )


def batch_latency(running: StreamingQuery, spark: SparkSession) -> DataFrame:
    """(batch, batch_rows, latency_s) of the query's latest batches, numbered 1..n, as the engine timed them."""
    timed = [p for p in running.recentProgress if p["numInputRows"]]
    rows = [(int(p["batchId"]) + 1, int(p["numInputRows"]), p["durationMs"]["triggerExecution"] / 1000.0) for p in timed]
    return spark.createDataFrame(rows, "batch long, batch_rows long, latency_s double")


def upsert(table: BatchTable) -> Callable[[DataFrame, int], None]:
    """A sink for update mode: each batch writes only the rows that changed."""
    return lambda changed, batch_id: table.put(batch_id, changed) and None


def latest(table: BatchTable, keys: Sequence[str]) -> DataFrame:
    """The newest row of each key in a table that :func:`upsert` wrote."""
    return top_row(table.all(), keys, ["batch_id"]).drop("batch_id")


def stream_trust(adjudications: DataFrame) -> DataFrame:
    """Streaming success and failure counts per (source, field): two long sums of state each."""
    hit = F.col("x").cast("long")
    return adjudications.groupBy(*SOURCE_FIELD).agg(
        F.sum(hit).cast("double").alias("succ"), F.sum(1 - hit).cast("double").alias("fail")
    )


def stream_rank(claims: DataFrame, policy=POLICY) -> DataFrame:
    """Streaming rank fuse: the state of a group is its one winning tuple."""
    best = F.max(F.struct(*policy)).alias("w")
    return claims.groupBy(*GROUP).agg(best).select(*GROUP, "w.value")


def bounded_claims(claims: DataFrame, event_time: str, delay: str) -> DataFrame:
    """Streamed claims, each (cluster, field, source, offer) once, dropped when later than ``delay``.

    The watermark also bounds the state that keeps the claims unique.
    """
    keys = [*GROUP, "source_id", "offer_id"]
    return claims.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)
