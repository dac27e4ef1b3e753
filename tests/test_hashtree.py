import random

import pytest
from pyspark.sql import functions as F

from corrobora.operators.hashtree import HashTree
from corrobora.session import scratch_path

SCHEMA = "cluster_id long, field string, value string, source_id string"


def relation(spark, n=3000, seed=1):
    rng = random.Random(seed)
    rows = [(rng.randrange(700), rng.choice("xy"), rng.choice("abc"), f"s{rng.randrange(9)}") for _ in range(n)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def tree(spark, df, **shape):
    return HashTree.build(df, scratch_path(spark, "tree"), **shape)


def plain(old, new):
    """Groups whose sorted rows differ."""

    def by_group(rows):
        groups = {}
        for c, f, *rest in rows:
            groups.setdefault((c, f), []).append(tuple(rest))
        return groups

    a, b = by_group(old), by_group(new)
    out = []
    for key in a.keys() | b.keys():
        x, y = a.get(key, []), b.get(key, [])
        if sorted(x, key=repr) != sorted(y, key=repr):
            out.append((*key, "added" if not x else "removed" if not y else "changed", len(x), len(y)))
    return sorted(out, key=repr)


def test_equal_relations_in_any_order_and_partitioning(spark):
    _, df = relation(spark)
    a, b = tree(spark, df), tree(spark, df.orderBy(F.rand(3)).repartition(7))
    assert a.differing(b) == [[]] and a.changes(b).count() == 0


@pytest.mark.parametrize("fan,depth", [(2, 1), (4, 3), (16, 2)])
def test_changes_are_those_of_a_plain_comparison(spark, fan, depth):
    rows, df = relation(spark)
    rng = random.Random(5)
    new = [r for r in rows if r[0] != 17] + [(9999, "x", None, "s1"), rows[0]]
    for _ in range(5):
        k = rng.randrange(len(new))
        new[k] = (*new[k][:2], "changed", new[k][3])
    a = tree(spark, df, fan=fan, depth=depth)
    b = tree(spark, spark.createDataFrame(new, SCHEMA), fan=fan, depth=depth)
    assert sorted(map(tuple, a.changes(b).collect()), key=repr) == plain(rows, new)
    assert b.changes(a).filter("change = 'added'").count() == a.changes(b).filter("change = 'removed'").count()


def test_only_differing_branches_are_read(spark):
    rows, df = relation(spark)
    other = spark.createDataFrame([*rows[1:], (*rows[0][:3], "elsewhere")], SCHEMA)
    a, b = tree(spark, df), tree(spark, other)
    assert [len(level) for level in a.differing(b)] == [1, 1, 1]
    leaf = a.differing(b)[-1]
    plan = a.groups(leaf)._jdf.queryExecution().executedPlan().toString()
    assert f"= {leaf[0] // 16})" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert f"EqualTo(leaf,{leaf[0]})" in plan.split("PushedFilters: [")[1]
    assert [tuple(r) for r in a.changes(b).collect()] == plain(rows, [*rows[1:], (*rows[0][:3], "elsewhere")])


def test_trees_of_parts_add_up(spark):
    _, df = relation(spark)
    parts = [tree(spark, df.filter(F.pmod(F.xxhash64("value", "source_id"), F.lit(3)) == k)) for k in range(3)]
    assert HashTree.combine(scratch_path(spark, "tree"), *parts).differing(tree(spark, df)) == [[]]


def test_nulls_repeats_and_empty_relations(spark):
    a_rows = [(1, None, None, "s"), (1, None, "s", None), (None, "x", "a", "s"), (None, "x", "a", "s")]
    b_rows = [(1, None, "s", None), (1, None, "s", None), (None, "x", "a", "s")]
    a, b = (tree(spark, spark.createDataFrame(r, SCHEMA)) for r in (a_rows, b_rows))
    assert sorted(map(tuple, a.changes(b).collect()), key=repr) == plain(a_rows, b_rows)
    empty = tree(spark, spark.createDataFrame([], SCHEMA))
    assert {r.change for r in empty.changes(a).collect()} == {"added"}
    assert empty.differing(tree(spark, spark.createDataFrame([], SCHEMA))) == [[]]
    with pytest.raises(ValueError):
        tree(spark, spark.createDataFrame([], SCHEMA), fan=2, depth=17)
    with pytest.raises(ValueError):
        a.differing(tree(spark, spark.createDataFrame([], SCHEMA), fan=4))
