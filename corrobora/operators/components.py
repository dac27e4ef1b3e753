"""Clusters from match pairs: connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corrobora.operators.joins import BROADCAST_BYTES, lookup_join
from corrobora.operators.order import with_row_index
from corrobora.session import pin


def _point_to_least(edges: DataFrame, everyone: bool, max_bytes: int) -> DataFrame:
    """Link neighbours of each node ``u`` to the least node around it; the new edges are written.

    ``everyone=True`` looks at all neighbours and relinks the greater ones;
    otherwise only smaller neighbours are looked at and ``u`` itself is linked.
    """
    seen = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if everyone else edges
    least = pin(seen.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"), F.count("*").alias("_n")), "least")
    around = lookup_join(seen, least, ["u"], "inner", max_bytes, least.select("u", "_n")).drop("_n")
    links = around.filter("v > u" if everyone else "v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not everyone:
        links = links.unionByName(least.select("u", F.col("m").alias("v")))
    return pin(links.filter("u <> v").distinct(), "edges")


def component_roots(
    pairs: DataFrame,
    left: str = "left",
    right: str = "right",
    max_rounds: int = 100,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """(node, root) of every node in ``pairs`` that is linked to a smaller one; ``root`` is the least of its component.

    Each round is a few joins and aggregations and halves the paths, so the
    number of rounds grows with the logarithm of the longest one. Four tables
    are written each round, so the lineage stays short. A hub's edges are salted.
    """
    edge = [F.greatest(left, right).alias("u"), F.least(left, right).alias("v")]
    edges = pin(pairs.select(*edge).filter("u <> v").distinct(), "edges")

    def digest(df: DataFrame):
        total = F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))
        return df.agg(F.count("*"), total).first()

    last = digest(edges)
    for _ in range(max_rounds if last[0] else 0):
        relinked = _point_to_least(edges, everyone=True, max_bytes=max_bytes)
        edges = _point_to_least(relinked, everyone=False, max_bytes=max_bytes)
        now = digest(edges)
        if now == last:
            break
        last = now
    else:
        if last[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def connected_components(
    pairs: DataFrame,
    left: str = "left",
    right: str = "right",
    max_rounds: int = 100,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """(node, cluster_id) of every node in ``pairs``; ids are dense, by least member."""
    nodes = pairs.select(F.col(left).alias("node")).unionByName(pairs.select(F.col(right).alias("node"))).distinct()
    member = nodes.join(component_roots(pairs, left, right, max_rounds, max_bytes), "node", "left")
    member = pin(member.select("node", F.coalesce("root", "node").alias("root")), "member")
    roots = with_row_index(member.select("root").distinct(), ["root"], "cluster_id").select("root", "cluster_id")
    return lookup_join(member, roots, ["root"], "inner", max_bytes).select("node", "cluster_id")
