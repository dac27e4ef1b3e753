"""Embedding near-duplicates: subspace pigeonhole join of rotated unit vectors, exact cosine check, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from corrobora.llm.common import load, ship
from corrobora.operators.components import component_roots
from corrobora.operators.joins import lookup_join, salted_join
from corrobora.session import pin

#: Least cosine of a link.
COSINE = 0.93
#: Dimensions of a block.
BLOCK = 16
#: Vectors of a cell and block that stay at home in one task, and those that visit them there.
HOMES, VISITORS = 8192, 16384
#: Vectors of the matrix products within a task.
TILE = 1024
#: Room for rounding in squared distances of unit vectors: candidates within it are kept, and owners decided exactly.
SLACK = 1e-6


def usable(vec: Column) -> Column:
    """The vector is there, holds finite numbers only, and is not zero."""
    odd = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vec.isNotNull() & ~odd & F.exists(vec, lambda x: x != 0), F.lit(False))


def unit_vectors(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; each is scaled by a power of two first, so that no square over- or underflows."""
    scaled = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def rotate(units: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """The rows under a fixed rotation: three rounds of sign flips and Hadamard transforms, after filling up with zeros.

    Only element-wise sums, so a vector's image never depends on the rows beside it.
    """
    n, d = units.shape
    wide = max(block, 1 << (d - 1).bit_length())
    out = np.zeros((n, wide))
    out[:, :d] = units
    draw = np.random.RandomState(7)
    for _ in range(3):
        out *= draw.randint(0, 2, wide) * 2.0 - 1.0
        half = 1
        while half < wide:
            pairs = out.reshape(n, wide // (2 * half), 2, half)
            out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, wide)
            half *= 2
        out /= np.sqrt(wide)
    return out


def budgets(cosine: float, blocks: int) -> float:
    """Squared distance that a block may use: an equal share of the whole, as blocks are of equal width."""
    return (2.0 - 2.0 * cosine) / blocks


def touched(part: np.ndarray, bits: int, budget: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, own): the sign cells of the first ``bits`` coordinates within the budget of each row, its own among them."""
    row, left = np.arange(len(part)), np.full(len(part), budget + SLACK)
    cell, own = np.zeros(len(part), np.int64), np.ones(len(part), bool)
    for k in range(bits):
        x = part[row, k]
        home = (x >= 0).astype(np.int64) << k
        rest = left - x * x
        over = rest >= 0
        row, left = np.concatenate([row, row[over]]), np.concatenate([left, rest[over]])
        cell = np.concatenate([cell | home, cell[over] | (home[over] ^ (1 << k))])
        own = np.concatenate([own, np.zeros(over.sum(), bool)])
    return row, cell, own


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def joined(roots: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``roots`` after linking ``i`` with ``j``: each row's least row of its component so far."""
    while True:
        a, b = roots[i], roots[j]
        apart = a != b
        if not apart.any():
            return roots
        i, j = i[apart], j[apart]
        np.minimum.at(roots, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while not np.array_equal(higher := roots[roots], roots):
            roots = higher


def block_links(vectors: np.ndarray, home: np.ndarray, visitor: np.ndarray, order: np.ndarray, block: int, cosine: float, width: int = BLOCK):
    """Yield (i, j): rows of links that ``block`` owns, ``i`` at home and ``j`` a visitor of lower ``order``.

    Tile by tile: pairs within the block's budget are candidates. The first block
    whose budget holds a pair owns it, so each link is found once; cosines come from the original vectors.
    """
    units = unit_vectors(vectors)
    turned = rotate(units, width)
    blocks = turned.shape[1] // width
    budget = budgets(cosine, blocks)
    part = turned[:, block * width : (block + 1) * width]
    square = (part * part).sum(axis=1)
    h, v = np.flatnonzero(home), np.flatnonzero(visitor)
    for a in range(0, len(h), TILE):
        rows = h[a : a + TILE]
        for b in range(0, len(v), TILE):
            columns = v[b : b + TILE]
            near = square[rows, None] + square[None, columns] - 2 * (part[rows] @ part[columns].T)
            at = np.flatnonzero((near <= budget + SLACK) & (order[columns][None, :] < order[rows][:, None]))
            for c in range(0, len(at), 1 << 15):
                x, y = np.divmod(at[c : c + (1 << 15)], len(columns))
                i, j = rows[x], columns[y]
                apart = np.square(turned[i, : (block + 1) * width] - turned[j, : (block + 1) * width])
                within = apart.reshape(len(i), block + 1, width).sum(axis=2) <= budget + SLACK / 2
                keep = within[:, block] & ~within[:, :block].any(axis=1)
                i, j = i[keep], j[keep]
                keep = (units[i] * units[j]).sum(axis=1) >= cosine
                if keep.any():
                    yield i[keep], j[keep]


CELL = ["label", "dims", "block", "cell"]


def _placed(classes: DataFrame, cosine: float, width: int, homes: int) -> DataFrame:
    """The classes with ``places``: 4 x (block number, cell) of the cells that each may meet others in, + 1 at its own."""
    sizes = classes.groupBy("label", "dims").agg(F.count("*").alias("n"))
    bits = F.ceil(F.log2(F.greatest(F.col("n") / homes, F.lit(1.0)))).cast("int")
    sized = lookup_join(classes, sizes.select("label", "dims", F.least(bits, F.lit(width)).alias("bits")), ["label", "dims"], "inner")

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for (dims, bits), rows in frame.groupby(["dims", "bits"]):
                turned = rotate(unit_vectors(_matrix(rows["vec"])), width)
                blocks = turned.shape[1] // width
                found = [touched(turned[:, k * width : (k + 1) * width], int(bits), budgets(cosine, blocks)) for k in range(blocks)]
                row = np.concatenate([f[0] for f in found])
                code = np.concatenate([(((k << width) | f[1]) << 1) | f[2] for k, f in enumerate(found)])
                by = np.argsort(row, kind="stable")
                places = np.split(code[by], np.cumsum(np.bincount(row, minlength=len(rows)))[:-1])
                yield rows.assign(places=pd.Series(places, index=rows.index))[[*frame.columns.drop("bits"), "places"]]

    schema = T.StructType([*classes.schema.fields, T.StructField("places", T.ArrayType(T.LongType()))])
    return sized.select(*classes.columns, "bits").mapInPandas(place, schema)


def near_vectors(classes: DataFrame, cosine: float = COSINE, width: int = BLOCK, homes: int = HOMES, visitors: int = VISITORS) -> DataFrame:
    """(cid, links, root) partial sums over classes (cid, label, dims, vec, n): other vectors linked, and a lower or equal cid linked with.

    Rotated unit vectors are cut into blocks of ``width`` dimensions. Two with
    cosine ``cosine`` or more lie, in one block at least, within that block's
    share of their squared distance. Each block is a range join of its own: sign
    cells of as many leading coordinates as the label's size asks for, in which
    every vector visits the cells within its budget. Cells beyond ``homes`` or
    ``visitors`` are split, the homes of each part meeting each part of the
    visitors. Tasks sum links and join components where they find them: no pair leaves them.
    """
    placed = pin(_placed(classes, cosine, width, homes), "placed")
    code = F.col("code")
    block, cell = F.shiftright(code, width + 1).cast("int"), F.shiftright(code, 1).bitwiseAND(F.lit((1 << width) - 1)).cast("int")
    each = placed.withColumn("code", F.explode("places")).drop("places")
    each = each.withColumns({"block": block, "cell": cell, "own": code.bitwiseAND(F.lit(1)) == 1}).drop("code")
    counts = each.groupBy(*CELL).agg(F.sum(F.col("own").cast("long")).alias("at_home"), F.count("*").alias("all"))
    counts = counts.filter((F.col("at_home") > 0) & (F.col("all") > 1))
    splits = counts.select(*CELL, F.ceil(F.col("at_home") / homes).cast("int").alias("hs"), F.ceil(F.col("all") / visitors).cast("int").alias("vs"))
    each = lookup_join(each, splits, CELL, "inner")
    mine_h, mine_v = F.pmod(F.xxhash64("cid"), "hs").cast("int"), F.pmod(F.xxhash64("cid", F.lit(1)), "vs").cast("int")
    each = each.withColumns({"my_h": mine_h, "my_v": mine_v})
    stays = F.transform(
        F.sequence(F.lit(0), F.col("vs") - 1),
        lambda v: F.struct(F.col("my_h").alias("h"), v.alias("v"), F.lit(True).alias("home"), (v == F.col("my_v")).alias("visitor")),
    )
    visits = F.transform(
        F.sequence(F.lit(0), F.col("hs") - 1),
        lambda h: F.struct(h.alias("h"), F.col("my_v").alias("v"), F.lit(False).alias("home"), F.lit(True).alias("visitor")),
    )
    elsewhere = F.filter(visits, lambda s: ~(F.col("own") & (s["h"] == F.col("my_h"))))
    spots = F.when(F.col("own"), F.concat(stays, elsewhere)).otherwise(visits)
    dealt = each.select("cid", "n", "vec", *CELL, F.explode(spots).alias("spot")).select("*", "spot.*").drop("spot")

    def found(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        cid, n = frame["cid"].to_numpy(), frame["n"].to_numpy()
        by = np.argsort(cid)
        cid, n = cid[by], n[by]
        links, roots = np.zeros(len(cid), np.int64), np.arange(len(cid))
        home, visitor = frame["home"].to_numpy()[by], frame["visitor"].to_numpy()[by]
        for i, j in block_links(_matrix(frame["vec"])[by], home, visitor, cid, int(key[2]), cosine, width):
            np.add.at(links, i, n[j])
            np.add.at(links, j, n[i])
            roots = joined(roots, i, j)
        seen = links > 0
        return pd.DataFrame({"cid": cid[seen], "links": links[seen], "root": cid[roots[seen]]})

    return dealt.groupBy(*CELL, "h", "v").applyInPandas(found, "cid long, links long, root long")


def vector_links(vectors: DataFrame, cosine: float = COSINE, width: int = BLOCK, homes: int = HOMES, visitors: int = VISITORS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding, label).

    Links join different rows of equal label whose cosine is ``cosine`` or more.
    Rows without label, and vectors that are null, empty, zero or hold null or
    non-finite components, link with nothing; vectors of unlike lengths are not
    compared. Equal vectors of a label are one class: they link with each
    other and share all links, which are found once. Repeated rows come back
    repeatedly and count as links of each other. The component is the smallest
    vec_id reachable; null ids are passed over, so it is null only where all are.
    An empty table gives none. Other columns are not read.
    """
    ship(vectors.sparkSession)
    rows = vectors.select("vec_id", "label", F.col("embedding").alias("vec"))
    rows = rows.withColumn("ok", F.col("label").isNotNull() & usable(F.col("vec")))
    grouped = rows.filter("ok").groupBy("label", "vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    classes = pin(grouped.select("*", F.size("vec").alias("dims"), F.monotonically_increasing_id().alias("cid")), "vectors")
    found = pin(near_vectors(classes.select("cid", "label", "dims", "vec", "n"), cosine, width, homes, visitors), "links")
    sums = found.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = component_roots(found.filter("cid <> root"), "cid", "root").withColumnsRenamed({"node": "cid"})
    known = classes.join(sums, "cid", "left").join(roots, "cid", "left")
    known = pin(
        known.select("label", "vec", "least", "n", F.coalesce("root", "cid").alias("root"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")),
        "known",
    )
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = lookup_join(known, least, ["root"], "inner")
    hot = known.select("label", "vec", F.col("n").alias("_n"))
    answered = salted_join(rows.filter("ok"), known.select("label", "vec", "n_links", "component_id"), ["label", "vec"], "inner", counts=hot)
    alone = rows.filter(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = answered.select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def links_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links(load(spark, sf_dir, "embeddings"))


LINKS_SQL = f"""
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
    SELECT * FROM v
    WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
    SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}
), reach AS (
    SELECT vec_id AS a, vec_id AS b FROM v
    UNION
    SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), least AS (
    SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM least
"""
