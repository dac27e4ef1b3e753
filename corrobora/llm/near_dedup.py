"""SimHash near-duplicates: pigeonring candidates, Hamming check, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from corrobora.llm.common import load, ship
from corrobora.operators.components import component_roots
from corrobora.session import pin

SHINGLE = 3
SEED = 42
RADIUS = 2
#: First bit and width of each segment of the ring.
RING = ((0, 22), (22, 21), (43, 21))
#: Fingerprints with one chain key, beyond which they are linked by their neighbourhoods instead of in pairs.
CROWD = 64


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of each run of ``size`` words, repeats included; fewer words are one run, none have no hash."""
    words = (text or "").encode().lower().split()  # bytes know only A-Z as upper case, and the six ASCII blanks
    if not words:
        return np.zeros(0, np.uint64)
    runs = map(b" ".join, zip(*(words[k:] for k in range(size)))) if len(words) >= size else [b" ".join(words)]
    return np.fromiter((xxhash.xxh64_intdigest(r, SEED) for r in runs), np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """Each bit that is set in over half of the hashes, as a signed 64-bit integer; 0 for none."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(votes * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


@F.pandas_udf(T.LongType())
def fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([simhash(shingle_hashes(t)) for t in texts], dtype="int64")


def _segment(fp: Column, k: int) -> Column:
    first, width = RING[k % len(RING)]
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1))


def _ring_distance(a: Column, b: Column, k: int) -> Column:
    return F.bit_count(_segment(a, k).bitwiseXOR(_segment(b, k)))


def _chain_key(fp: Column, k: int) -> Column:
    """Segments ``k`` and ``k + 1`` of the ring side by side, and ``k``: 45 bits."""
    second = RING[(k + 1) % len(RING)][1]
    both = F.shiftleft(_segment(fp, k), second).bitwiseOR(_segment(fp, k + 1))
    return F.shiftleft(both, 2).bitwiseOR(F.lit(k))


def _probe_keys(fp: Column, k: int) -> list[Column]:
    """The chain key, and those in which one bit of segment ``k + 1`` differs."""
    flips = [1 << (j + 2) for j in range(RING[(k + 1) % len(RING)][1])]
    key = _chain_key(fp, k)
    return [key, *(key.bitwiseXOR(F.lit(f)) for f in flips)]


def near_pairs(classes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(left, right): links between distinct fingerprints ``fp`` that differ in at most two bits.

    On a ring of three segments, two such fingerprints have a start from which
    every chain stays in proportion to its length: no difference in one segment,
    at most one over two, two over three. Segment and neighbour are the join
    key, with one bit of the neighbour open; the whole ring is checked after it.
    Both sides are shuffled: an exploded side is as many times larger than the planner takes it for as it has keys a row,
    65 for the probes, and must not be broadcast.
    Links are complete up to reachability: a key that more than ``crowd``
    fingerprints share would make pairs in the square of its size, so there
    each fingerprint that meets it is linked through its neighbourhood: two
    differ in at most two bits exactly if one value is within one bit of both,
    and all around one value are linked to the least of them.
    """
    fp = F.col("fp")
    ks = range(len(RING))
    index = classes.select(fp.alias("left"), F.explode(F.array(*(_chain_key(fp, k) for k in ks))).alias("key"))
    probe = classes.select(fp.alias("right"), F.explode(F.array(*(c for k in ks for c in _probe_keys(fp, k)))).alias("key"))
    crowded = pin(index.groupBy("key").count().filter(F.col("count") > crowd).select("key"), "crowded")
    any_crowded = bool(crowded.take(1))
    near = F.bit_count(F.col("left").bitwiseXOR(F.col("right"))) <= RADIUS
    if any_crowded:
        met = probe.join(crowded, "key", "left_semi").select(F.col("right").alias("fp")).distinct()
        index = index.join(crowded, "key", "left_anti")
    pairs = index.join(probe.hint("merge"), "key").filter(F.col("left") < F.col("right"))
    k, left, right = F.col("key").bitwiseAND(F.lit(3)), F.col("left"), F.col("right")
    chain = F.lit(False)
    for s in ks:
        first = _ring_distance(left, right, s)
        second = first + _ring_distance(left, right, s + 1)
        chain = chain | ((k == s) & (first == 0) & (second <= 1) & (second + _ring_distance(left, right, s + 2) <= RADIUS))
    links = pairs.filter(chain & near).select("left", "right")
    if any_crowded:
        around = met.select("fp", F.explode(F.array(fp, *(fp.bitwiseXOR(F.lit(_bit(j))) for j in range(64)))).alias("point"))
        star = around.groupBy("point").agg(F.min("fp").alias("left"), F.count("*").alias("n")).filter("n > 1")
        links = links.unionByName(around.join(star.hint("merge"), "point").filter(F.col("left") < fp).select("left", fp.alias("right")))
    return links


def _bit(j: int) -> int:
    return (1 << j) if j < 63 else -(1 << 63)


def near_components(prints: DataFrame) -> DataFrame:
    """(fp, root, component_id) of each distinct fingerprint in (doc_id, fp): the least fingerprint and doc_id that links reach."""
    classes = pin(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = component_roots(near_pairs(classes))
    joined = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    joined = pin(joined, "joined")
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return joined.join(least, "root").select("fp", "root", "component_id")


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    Null and empty texts share fingerprint 0, which is linked like any other.
    The component is the smallest doc_id reachable; null ids are passed
    over, so it is null only where all ids are. Repeated rows come back
    repeatedly; an empty table gives none. Other columns are not read.
    """
    ship(docs.sparkSession)
    prints = pin(docs.select("doc_id", fingerprint("text").alias("fp")), "prints")
    found = prints.join(near_components(prints), "fp")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each group, with all its columns: the one with the smallest doc_id.

    A null id comes after all others. Of rows that share the smallest id one stays.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("tag"), fingerprint(docs["text"]).alias("fp"))
    rows = pin(rows, "rows")
    prints = rows.select(F.col("row.doc_id").alias("doc_id"), "fp", "tag")
    groups = prints.join(near_components(prints), "fp")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")
    first = groups.groupBy("root").agg(F.min(order).alias("first")).select(F.col("first.tag").alias("tag"))
    return rows.join(first, "tag", "left_semi").select("row.*")


def near_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(load(spark, sf_dir, "documents"))
