"""Components that grow and shrink with their pairs, without a new run over all of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from corrobora.operators.components import component_roots
from corrobora.operators.joins import lookup_join
from corrobora.session import pin


def _known(pairs: DataFrame, left: str, right: str) -> DataFrame:
    ends = pairs.select(F.col(left).alias("left"), F.col(right).alias("right"))
    return ends.filter(F.col("left").isNotNull() & F.col("right").isNotNull()).distinct()


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("left").alias("node")).unionByName(pairs.select(F.col("right").alias("node"))).distinct()


def _contracted(pairs: DataFrame) -> DataFrame:
    """(node, handle) of every node in ``pairs``: the handle is the least node of its component."""
    roots = component_roots(pairs).withColumnRenamed("root", "handle")
    return _ends(pairs).join(roots, "node", "left").select("node", F.coalesce("handle", "node").alias("handle"))


@dataclass(frozen=True)
class Components:
    """Components as two stored tables.

    ``members`` (node, handle) has one row per node. ``forest`` (handle, root)
    has the handles that were merged into a smaller one since the last
    :meth:`compact`. A batch of pairs adds its new nodes to the first and its
    merges to the second, so what it writes grows with the batch and not with
    the components it touches, however large one of them is. Every handle and root is the
    least node of its component. Pairs with a null end link nothing; repeated
    pairs and pairs of a node with itself are fine, and the latter make a node known.
    """

    members: DataFrame
    forest: DataFrame

    @classmethod
    def of(cls, pairs: DataFrame, left: str = "left", right: str = "right") -> Components:
        """The components of a first batch of pairs, which may be empty."""
        members = pin(_contracted(pin(_known(pairs, left, right), "pairs")), "members")
        none = members.filter(F.lit(False)).select("handle", F.col("handle").alias("root"))
        return cls(members, none)

    def roots(self) -> DataFrame:
        """(node, root) of every node."""
        merged = lookup_join(self.members, self.forest, ["handle"], "left")
        return merged.select("node", F.coalesce("root", "handle").alias("root"))

    def _roots_of(self, nodes: DataFrame) -> DataFrame:
        """(node, root) of those ``nodes`` that are known; only their rows are looked at, as a node has one."""
        own = lookup_join(self.members, nodes, ["node"], "inner")
        return lookup_join(own, self.forest, ["handle"], "left").select("node", F.coalesce("root", "handle").alias("root"))

    def add(self, pairs: DataFrame, left: str = "left", right: str = "right") -> Components:
        """With more pairs: they are contracted over the roots of their ends."""
        pairs = pin(_known(pairs, left, right), "pairs")
        ends = pin(_ends(pairs), "ends")
        known = pin(self._roots_of(ends), "known")
        new = pin(ends.join(known, "node", "left_anti").select("node", F.col("node").alias("handle")), "new")
        root = known.unionByName(new.withColumnRenamed("handle", "root"))
        root = pin(root, "roots")
        first = lookup_join(pairs, root.withColumnsRenamed({"node": "left", "root": "a"}), ["left"], "inner")
        both = lookup_join(first, root.withColumnsRenamed({"node": "right", "root": "b"}), ["right"], "inner")
        moved = component_roots(both.select("a", "b"), "a", "b").select(F.col("node").alias("root"), F.col("root").alias("now"))
        moved = pin(moved, "moved")
        older = lookup_join(self.forest, moved, ["root"], "left").select("handle", F.coalesce("now", "root").alias("root"))
        forest = older.unionByName(moved.select(F.col("root").alias("handle"), F.col("now").alias("root")))
        return Components(self.members.unionByName(new), pin(forest, "forest"))

    def remove(self, gone: DataFrame, remaining: DataFrame, left: str = "left", right: str = "right") -> Components:
        """Without the pairs ``gone``; ``remaining`` are all the others, in either order of their ends.

        Only the components of the ends of ``gone`` are contracted again, from
        those of the remaining pairs that lie in them. A node left without a pair is not known any more.
        """
        touched = pin(self._roots_of(_ends(_known(gone, left, right))).select("root").distinct(), "touched")
        roots = self.roots()
        inside = pin(lookup_join(roots, touched, ["root"], "inner").select("node"), "inside")
        pairs = remaining.select(F.col(left).alias("left"), F.col(right).alias("right"))
        within = lookup_join(pairs, inside.withColumnRenamed("node", "left"), ["left"], "inner")
        again = _contracted(pin(_known(within, "left", "right"), "within"))
        kept = self.members.join(inside, "node", "left_anti")
        forest = self.forest.join(touched, "root", "left_anti").select("handle", "root")
        return Components(pin(kept.unionByName(again), "members"), pin(forest, "forest"))

    def compact(self) -> Components:
        """The same components with an empty forest; rewrites the members."""
        members = pin(self.roots().withColumnRenamed("root", "handle"), "members")
        return Components(members, self.forest.filter(F.lit(False)))
