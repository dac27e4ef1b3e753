import random

import pytest

from corrobora.operators.incremental import Components


def plain(pairs):
    """node -> least node it is linked to, over all pairs."""
    least = {n: n for p in pairs for n in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(least[a], least[b])
            if (least[a], least[b]) != (m, m):
                least[a] = least[b] = m
                changed = True
    return least


def frame(spark, pairs, kind="long"):
    return spark.createDataFrame(pairs, f"left {kind}, right {kind}")


def found(components):
    rows = components.roots().collect()
    got = {r.node: r.root for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_and_removals_against_one_run(spark, seed):
    """A hub, chains that later batches join, and removals that split them."""
    rng = random.Random(seed)
    pairs = [(0, k) for k in range(200, 230)] + [(k, k + 1) for k in range(100, 130)]
    pairs += [(rng.randrange(300), rng.randrange(300)) for _ in range(90)]
    rng.shuffle(pairs)
    cuts = [pairs[:40], pairs[40:90], pairs[90:]]
    state, seen = Components.of(frame(spark, cuts[0])), list(cuts[0])
    for cut in cuts[1:]:
        state = state.add(frame(spark, cut))
        seen += cut
        assert found(state) == plain(seen)
    distinct = sorted(set(seen))
    gone = set(rng.sample(distinct, 12))
    rest = [p for p in distinct if p not in gone and p[::-1] not in gone]
    state = state.remove(frame(spark, sorted(gone)), frame(spark, rest))
    assert found(state) == plain(rest)
    state = state.compact()
    assert found(state) == plain(rest) and state.forest.count() == 0
    more = [(5, 299), (400, 5)]
    assert found(state.add(frame(spark, more))) == plain(rest + more)


def test_a_batch_writes_no_more_than_its_own_rows(spark):
    """A smaller node joins a large component: one new member, one merge."""
    state = Components.of(frame(spark, [(10, k) for k in range(11, 500)]))
    later = state.add(frame(spark, [(3, 400)]))
    assert later.members.count() - state.members.count() == 1
    assert [tuple(r) for r in later.forest.collect()] == [(10, 3)]
    assert set(found(later).values()) == {3}


def test_strings_nulls_repeats_and_empty_batches(spark):
    none = frame(spark, [], "string")
    state = Components.of(none)
    assert found(state) == {}
    state = state.add(frame(spark, [("b", "c"), ("c", "b"), (None, "x"), ("d", "d"), ("b", "c")], "string")).add(none)
    assert found(state) == {"b": "b", "c": "b", "d": "d"}
    state = state.remove(none, frame(spark, [("b", "c"), ("d", "d")], "string"))
    assert found(state) == {"b": "b", "c": "b", "d": "d"}
    assert found(state.remove(frame(spark, [("c", "b")], "string"), frame(spark, [("d", "d")], "string"))) == {"d": "d"}
