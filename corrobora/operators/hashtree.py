"""A relation's hash tree: digests of groups, rolled up with a fixed fan-out, to find where two relations differ."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from corrobora.schema import GROUP

#: Leaves of a tree at most: a comparison lists the differing nodes of one level in the driver.
MOST_LEAVES = 1 << 16
_DIGESTS = ("rows", "total", "mix")


def _row_hashes(columns: Sequence[str]) -> tuple[Column, Column]:
    """Two 64-bit hashes of a row; which columns are null is hashed too, as the hash skips nulls."""
    missing = [F.isnull(c) for c in columns]
    return F.xxhash64(*columns, *missing), F.xxhash64(F.lit(1), *columns, *missing)


def _added_up() -> list[Column]:
    """Digests of several parts as one: counts and totals add, mixes cancel; no order plays a part."""
    return [
        F.sum("rows").alias("rows"),
        F.sum("total").cast("decimal(38,0)").alias("total"),
        F.bit_xor("mix").alias("mix"),
    ]


@dataclass(frozen=True)
class HashTree:
    """Digests under ``path``, in a folder that all executors share.

    A group's digest is its row count, the sum of one hash of its rows and
    the xor of another, so it says nothing about order or partitioning and digests of parts add up.
    Groups hang on leaves by a hash of their keys; a node's digest sums those
    of its ``fan`` children, down from one root over ``depth`` levels. Group digests lie in
    one folder per child of the root, sorted by leaf within files. Each table is written once and nothing holds a whole group.
    """

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    fan: int
    depth: int
    schema: StructType

    @classmethod
    def build(
        cls,
        relation: DataFrame,
        path: str,
        keys: Sequence[str] = GROUP,
        columns: Sequence[str] | None = None,
        fan: int = 16,
        depth: int = 2,
    ) -> HashTree:
        """The tree of a relation, which may be empty; ``columns`` (all but the keys) are what equal rows share.

        Null keys make a group of their own. Repeated rows count as often as they stand there.
        """
        if fan < 2 or depth < 1 or fan**depth > MOST_LEAVES:
            raise ValueError(f"a fan-out of 2 or more, and at most {MOST_LEAVES} leaves")
        first, second = _row_hashes(sorted(columns if columns is not None else set(relation.columns) - set(keys)) or list(keys))
        rows = relation.select(*keys, first.alias("_first"), second.alias("_second"))
        groups = rows.groupBy(*keys).agg(
            F.count("*").alias("rows"),
            F.sum(F.col("_first").cast("decimal(20,0)")).cast("decimal(38,0)").alias("total"),
            F.bit_xor("_second").alias("mix"),
        )
        tree = cls(relation.sparkSession, path.rstrip("/"), tuple(keys), fan, depth, groups.schema)
        tree._write(groups)
        return tree

    @classmethod
    def combine(cls, path: str, *trees: HashTree) -> HashTree:
        """The tree of the union of several relations, from their trees alone: days, files or shards are hashed once."""
        one = trees[0]
        if any((t.keys, t.fan, t.depth) != (one.keys, one.fan, one.depth) for t in trees):
            raise ValueError("trees of one shape are needed")
        tree = cls(one.spark, path.rstrip("/"), one.keys, one.fan, one.depth, one.schema)
        groups = one.groups()
        for other in trees[1:]:
            groups = groups.unionByName(other.groups())
        tree._write(groups.groupBy(*tree.keys).agg(*_added_up()))
        return tree

    def _leaf(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys, *[F.isnull(k) for k in self.keys]), F.lit(self.fan**self.depth)).cast("int")

    def _branch(self, leaf: str) -> Column:
        return F.expr(f"cast({leaf} div {self.fan ** (self.depth - 1)} as int)")

    def _stored(self) -> DataFrame:
        schema = StructType([*self.schema.fields]).add("leaf", "integer").add("branch", "integer")
        return self.spark.read.schema(schema).parquet(f"{self.path}/groups")

    def _write(self, groups: DataFrame) -> None:
        leaf = groups.withColumn("leaf", self._leaf()).repartition("leaf").sortWithinPartitions("leaf")
        leaf.withColumn("branch", self._branch("leaf")).write.mode("overwrite").partitionBy("branch").parquet(f"{self.path}/groups")
        stored = self._stored()
        digest = F.xxhash64(*self.keys, *[F.isnull(k) for k in self.keys], *_DIGESTS)
        nodes = stored.groupBy(F.col("leaf").alias("node")).agg(
            F.sum("rows").alias("rows"), F.sum(digest.cast("decimal(20,0)")).cast("decimal(38,0)").alias("total"), F.bit_xor(digest).alias("mix")
        )
        for level in range(self.depth, -1, -1):
            place = f"{self.path}/nodes/level={level}"
            nodes.coalesce(1).write.mode("overwrite").parquet(place)
            written = self.spark.read.schema(nodes.schema).parquet(place)
            nodes = written.groupBy(F.expr(f"cast(node div {self.fan} as int)").alias("node")).agg(*_added_up())

    def nodes(self, level: int) -> DataFrame:
        """(node, rows, total, mix) of one level; node n has the children n * fan to n * fan + fan - 1."""
        return self.spark.read.schema("node int, rows long, total decimal(38,0), mix long").parquet(f"{self.path}/nodes/level={level}")

    def groups(self, leaves: Sequence[int] | None = None) -> DataFrame:
        """(keys, rows, total, mix) of all groups, or of those on some leaves, read from their branches' folders only."""
        stored = self._stored()
        if leaves is not None:
            branches = sorted({n // self.fan ** (self.depth - 1) for n in leaves})
            stored = stored.filter(F.col("branch").isin(branches) & F.col("leaf").isin(list(leaves)))
        return stored.select(*self.keys, *_DIGESTS)

    def differing(self, other: HashTree) -> list[list[int]]:
        """Per level, from the root, the nodes whose digests differ; below an equal node nothing is read."""
        if (self.keys, self.fan, self.depth) != (other.keys, other.fan, other.depth):
            raise ValueError("trees of one shape are needed")
        found: list[list[int]] = []
        for level in range(self.depth + 1):
            a, b = self.nodes(level), other.nodes(level)
            if found:
                under = F.expr(f"cast(node div {self.fan} as int)").isin(found[-1])
                a, b = a.filter(under), b.filter(under)
            both = a.alias("a").join(b.alias("b"), "node", "full")
            found.append(sorted(r.node for r in both.filter(_unlike()).select("node").collect()))
            if not found[-1]:
                break
        return found

    def changes(self, other: HashTree) -> DataFrame:
        """(keys, change, old_rows, new_rows): the groups that are added, removed or changed from this relation to ``other``.

        Group digests are read from differing branches and leaves only, and neither relation is read or sorted.
        """
        leaves = self.differing(other)[-1]
        old, new = self.groups(leaves).alias("a"), other.groups(leaves).alias("b")
        same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in self.keys]
        on = same[0]
        for condition in same[1:]:
            on &= condition
        change = F.when(F.col("a.rows").isNull(), "added").when(F.col("b.rows").isNull(), "removed").otherwise("changed")
        return old.join(new, on, "full").filter(_unlike()).select(
            *[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in self.keys],
            change.alias("change"),
            F.coalesce("a.rows", F.lit(0)).alias("old_rows"),
            F.coalesce("b.rows", F.lit(0)).alias("new_rows"),
        )


def _unlike() -> Column:
    equal = F.lit(True)
    for c in _DIGESTS:
        equal &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return ~equal
