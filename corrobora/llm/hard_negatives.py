"""Hard negatives: exact inner-product search with length buckets and coordinate pruning."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from corrobora.llm.common import load, ship
from corrobora.session import pin

#: Every so manyth id is an anchor.
EVERY = 100
POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these percentages of its positive's.
LOW, HIGH = 30, 90
#: Anchors that are sent to all tasks at once: 4,096 of them, fewer if their vectors exceed so many bytes.
BLOCK, BLOCK_BYTES = 4096, 16 << 20
#: Rows that are indexed together, vectors of a length bucket at least, and the ratio of its longest to its shortest.
CHUNK, BUCKET, RATIO = 8192, 64, 1.2
#: Coordinates an anchor looks at: those in which it is largest.
FOCUS = 4
#: Anchors of one matrix product.
TILE = 256
#: A feasible range that leaves more than this share of a bucket is not worth intersecting: the bucket is verified whole.
WIDE = 0.3
SLACK = 1e-9
EXACT = float(1 << 53)
LONGEST = (1 << 63) - 1


def scaled(vectors: np.ndarray) -> np.ndarray:
    """floor(256 * x) of each component; Python integers where doubles could not hold the inner products."""
    if np.abs(vectors).max(initial=0.0) < EXACT / 256:
        return np.floor(256.0 * vectors)
    return np.frompyfunc(lambda x: math.floor(256 * Fraction(x)), 1, 1)(vectors)


def products(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact integer inner products, as doubles where these hold every sum and as Python integers, held within 64 bits, beyond."""
    if rows.dtype != object and anchors.dtype != object:
        bound = np.abs(rows).max(initial=0.0) * np.abs(anchors).max(initial=0.0) * rows.shape[1]
        if bound < EXACT:
            return rows @ anchors.T
    whole, held = np.frompyfunc(int, 1, 1), np.frompyfunc(lambda s: max(-LONGEST, min(LONGEST, s)), 1, 1)
    return held(whole(rows) @ whole(anchors).T)


def first(scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` highest scores, ties by smaller id."""
    if scores.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda k: (-scores[k], ids[k]))[:n], int)
    if len(scores) > 8 * n:  # ties with the n-th score stay in
        kept = np.flatnonzero(scores >= np.partition(scores, len(scores) - n)[len(scores) - n])
        return kept[np.lexsort((ids[kept], -scores[kept]))[:n]]
    return np.lexsort((ids, -scores))[:n]


def reach(score: float | int) -> float:
    """A double that is no higher than the score."""
    return float(score) if abs(score) < EXACT else float(score) - abs(float(score)) * SLACK


class Bucket:
    """Rows of similar length: their directions, and each coordinate's values in ascending order."""

    def __init__(self, rows: np.ndarray, directions: np.ndarray, lengths: np.ndarray):
        self.rows, self.directions = rows, directions
        self.longest, self.shortest = lengths.max(), lengths.min()
        self.order = np.argsort(directions, axis=0)
        self.values = np.take_along_axis(directions, self.order, axis=0)

    def candidates(self, directions: np.ndarray, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Yield (anchors, rows) that may reach the least cosine of each anchor; rows are numbers within the bucket.

        Where both directions make an angle with a coordinate axis, those angles
        differ by no more than the angle between the directions. So each focus
        coordinate has a feasible range, a slice of its sorted list; the slices are intersected.
        """
        n, everything = len(self.rows), np.arange(len(self.rows))
        alive = np.flatnonzero(least <= 1 + SLACK)
        if not len(alive):
            return
        focus = np.argsort(-np.abs(directions[alive]), axis=1)[:, :FOCUS]
        axis = np.arccos(np.clip(np.take_along_axis(directions[alive], focus, axis=1), -1, 1))
        apart = np.arccos(np.clip(least[alive] - SLACK, -1, 1))[:, None]
        low = np.cos(np.minimum(axis + apart, np.pi)) - SLACK
        high = np.cos(np.maximum(axis - apart, 0.0)) + SLACK
        begin, end = np.zeros(focus.shape, np.int64), np.zeros(focus.shape, np.int64)
        for f in np.unique(focus):
            at = np.nonzero(focus == f)
            begin[at] = np.searchsorted(self.values[:, f], low[at], "left")
            end[at] = np.searchsorted(self.values[:, f], high[at], "right")
        size = end - begin
        narrowest = size.argmin(axis=1)
        wide = size.min(axis=1) > WIDE * n
        if wide.any():
            yield alive[wide], everything
        for k in np.flatnonzero(~wide & (size.min(axis=1) > 0)):
            f = narrowest[k]
            rows = self.order[begin[k, f] : end[k, f], focus[k, f]]
            for g in range(focus.shape[1]):
                if g != f:
                    seen = self.directions[rows, focus[k, g]]
                    rows = rows[(seen >= low[k, g]) & (seen <= high[k, g])]
            if len(rows):
                yield alive[k : k + 1], rows


class Search:
    """The best rows of each anchor's windows of scores, over any number of chunks of rows."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, windows: list[list[tuple]], same: bool, keep: int):
        """``windows``: per anchor (key, least, most) score, None for no limit. ``same``: rows of the anchor's label, or of others."""
        self.ids, self.labels, self.windows, self.same, self.keep = ids, labels, windows, same, keep
        self.vectors = scaled(vectors)
        floats = self.vectors.astype(np.float64)
        self.lengths = np.sqrt(np.square(floats).sum(axis=1))
        self.directions = floats / np.where(self.lengths > 0, self.lengths, 1.0)[:, None]
        none = np.zeros(0, self.vectors.dtype), np.zeros(0, np.int64)
        self.best = [[none for _ in w] for w in windows]
        self.least = np.array([min((-math.inf if low is None else reach(low) for _, low, _ in w), default=math.inf) for w in windows])
        self.verified = 0

    def chunk(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        rows = scaled(vectors)
        floats = rows.astype(np.float64)
        lengths = np.sqrt(np.square(floats).sum(axis=1))
        by = np.argsort(-lengths, kind="stable")
        at = 0
        while at < len(by):
            end = max(at + BUCKET, int(np.searchsorted(-lengths[by], -lengths[by[at]] / RATIO, "right")))
            part = by[at:end]
            here = lengths[part]
            bucket = Bucket(rows[part], floats[part] / np.where(here > 0, here, 1.0)[:, None], here)
            self._bucket(bucket, ids[part], labels[part])
            at = end

    def _bucket(self, bucket: Bucket, ids: np.ndarray, labels: np.ndarray) -> None:
        with np.errstate(divide="ignore", invalid="ignore"):
            length = np.where(self.least > 0, bucket.longest, bucket.shortest)
            cosine = np.where(np.isneginf(self.least), -1.0, self.least / (self.lengths * length))
        # a zero vector's score is zero: it has no direction to prune by
        cosine = np.where(self.lengths * length > 0, cosine * (1 - np.sign(cosine) * SLACK), np.where(self.least <= 0, -1.0, 2.0))
        if bucket.rows.dtype == object or self.vectors.dtype == object:  # lengths may be beyond doubles, scores are held within 64 bits
            cosine = np.full(len(cosine), -1.0)
        for anchors, rows in bucket.candidates(self.directions, cosine):
            self.verified += len(anchors) * len(rows)
            for a in range(0, len(anchors), TILE):
                tile = anchors[a : a + TILE]
                scores = products(bucket.rows[rows], self.vectors[tile])
                for k, anchor in enumerate(tile):
                    self._offer(anchor, scores[:, k], ids[rows], labels[rows])

    def _offer(self, anchor: int, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        open_ = (labels == self.labels[anchor]) & (ids != self.ids[anchor]) if self.same else labels != self.labels[anchor]
        at = np.flatnonzero(open_ & (scores >= self.least[anchor]))
        if not len(at):
            return
        scores, ids, floor = scores[at], ids[at], math.inf
        for w, (_, low, high) in enumerate(self.windows[anchor]):
            inside = np.ones(len(scores), bool)
            if low is not None:
                inside &= (scores >= low).astype(bool)
            if high is not None:
                inside &= (scores <= high).astype(bool)
            had_scores, had_ids = self.best[anchor][w]
            mine, mine_ids = np.concatenate([had_scores, scores[inside]]), np.concatenate([had_ids, ids[inside]])
            top = first(mine, mine_ids, self.keep)
            self.best[anchor][w] = mine[top], mine_ids[top]
            floor = min(floor, reach(mine[top[-1]]) if len(top) == self.keep else -math.inf if low is None else reach(low))
        self.least[anchor] = floor

    def found(self) -> pd.DataFrame:
        out = [
            (self.ids[a], key, i, int(s))
            for a, windows in enumerate(self.windows)
            for (key, *_), best in zip(windows, self.best[a])
            for s, i in zip(*best)
        ]
        return pd.DataFrame(out, columns=["anchor_id", "key", "vec_id", "score"]).astype("int64")


FOUND = "anchor_id long, key long, vec_id long, score long"


def _search(items: DataFrame, anchors: dict, same: bool, keep: int) -> DataFrame:
    """Each task's best rows of the anchors' windows. ``anchors``: by dimensions (ids, labels, vectors, windows)."""
    sent = items.sparkSession.sparkContext.broadcast(anchors)

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        searches = {d: Search(*given, same, keep) for d, given in sent.value.items()}
        for frame in frames:
            for dims, rows in frame.groupby(frame["vec"].map(len)):
                if dims in searches:
                    for at in range(0, len(rows), CHUNK):
                        part = rows.iloc[at : at + CHUNK]
                        vectors = np.stack(part["vec"].to_numpy()).astype(np.float64)
                        searches[dims].chunk(part["vec_id"].to_numpy(), part["label"].to_numpy(), vectors)
        for s in searches.values():
            yield s.found()

    return items.mapInPandas(search, FOUND)


def _ranked(found: DataFrame, keep: int) -> DataFrame:
    best = Window.partitionBy("anchor_id", "key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= keep)


def _blocks(anchors: DataFrame, rows: int, max_bytes: int) -> Iterator[dict]:
    """The anchors in blocks of bounded size, by dimensions; one block at a time is here."""
    totals = anchors.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("vec")), F.lit(0)).alias("cells")).first()
    blocks = max(-(-totals["n"] // rows), -(-8 * totals["cells"] // max_bytes), 1 if totals["n"] else 0)
    for b in range(blocks):
        mine = anchors.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toPandas()
        yield {
            int(d): (f["vec_id"].to_numpy(), f["label"].to_numpy(), np.stack(f["vec"].to_numpy()).astype(np.float64))
            for d, f in mine.groupby(mine["vec"].map(len))
        }


def hard_negatives(
    vectors: DataFrame,
    every: int = EVERY,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    block: int = BLOCK,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of (vec_id, embedding, label).

    Scores are inner products of the components floor(256 * x). Anchors are the
    rows whose id ``every`` divides; their positives are the best other rows of
    the same label, and the negatives the best rows of other labels that score
    between 30 and 90 percent of the positive.

    Anchors go to the rows in blocks of bounded size; the rows stay where they
    are. A task sorts its rows into length buckets with sorted coordinate lists.
    The lowest score an anchor can still use, and the bucket's length, give its
    least cosine; that gives a feasible range in each focus coordinate, and
    the rows in all of these ranges are verified exactly. Tasks send on only the best.

    Rows without id or label, and vectors that are null, empty or hold null or
    non-finite components, take no part; unlike lengths are not compared. Zero
    vectors score 0. Rows that share an id count once, with the least (label,
    vector). Scores beyond 64 bits count as the nearest that they hold. An empty table gives none. Other columns are not read.
    """
    ship(vectors.sparkSession)
    vec = F.col("embedding")
    odd = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    usable = vectors.filter(F.col("vec_id").isNotNull() & label.isNotNull() & vec.isNotNull() & (F.size(vec) > 0) & ~odd)
    one = usable.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(F.struct(moved.alias("label"), vec.alias("vec"))).alias("row"))
    items = pin(one.select("vec_id", "row.label", "row.vec"), "items")
    anchors = pin(items.filter(F.col("vec_id") % every == 0), "anchors")
    out = None
    for given in _blocks(anchors, block, block_bytes):
        open_ = {d: (*g, [[(0, None, None)]] * len(g[0])) for d, g in given.items()}
        best = pin(_ranked(_search(items, open_, True, positives), positives), "positives")
        chosen: dict[int, list[tuple]] = {}
        for r in best.toLocalIterator():  # ``positives`` rows for each anchor of the block
            chosen.setdefault(r.anchor_id, []).append((r.vec_id, -(-LOW * r.score // 100), HIGH * r.score // 100))
        windows = {d: (*g, [[w for w in chosen.get(int(a), []) if w[1] <= w[2]] for a in g[0]]) for d, g in given.items()}
        found = _ranked(_search(items, windows, False, negatives), negatives)
        scores = best.select("anchor_id", F.col("vec_id").alias("key"), F.col("score").alias("positive_score"))
        rows = found.join(F.broadcast(scores), ["anchor_id", "key"]).select(
            "anchor_id", F.col("key").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        )
        rows = pin(rows, "negatives")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        names = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        return vectors.sparkSession.createDataFrame([], names)
    return out


def negatives_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(load(spark, sf_dir, "embeddings"))


NEGATIVES_SQL = f"""
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS MATERIALIZED (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id % {EVERY} = 0 AND len(a.e) = len(b.e) AND NOT (a.vec_id = b.vec_id)
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER best AS INTEGER) AS rank, s.vec_id AS negative_id,
       p.positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same
 AND {LOW} * p.positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.positive_score
WINDOW best AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER best <= {NEGATIVES}
"""
