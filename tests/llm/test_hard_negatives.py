"""Hard negatives against all products in Python integers."""

import math
from fractions import Fraction

import numpy as np
import pytest

from corrobora.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int"


def held(score):
    return max(1 - (1 << 63), min((1 << 63) - 1, score))


def plain(rows, every=4):
    items = {}
    for i, e, label in rows:
        if i is None or label is None or not e or any(x is None or not math.isfinite(x) for x in e):
            continue
        row = ((label + 1) % 10 if i % 7 == 0 else label, e)
        items[i] = min(items.get(i, row), row)
    whole = {i: [math.floor(256 * Fraction(x)) for x in e] for i, (_, e) in items.items()}
    out = []
    for a in items:
        if a % every:
            continue
        scores = sorted((-held(sum(x * y for x, y in zip(whole[a], whole[b]))), b) for b in items if b != a and len(whole[a]) == len(whole[b]))
        for minus, p in [s for s in scores if items[s[1]][0] == items[a][0]][:5]:
            fit = [(-s, n) for s, n in scores if items[n][0] != items[a][0] and 30 * -minus <= 100 * -s <= 90 * -minus]
            out += [(a, p, k + 1, n, -minus, s) for k, (s, n) in enumerate(fit[:10])]
    return sorted(out)


def vectors(seed, n, dims, labels=3, lengths=(1.0,), spread=0.6):
    draw = np.random.RandomState(seed)
    centres = draw.randn(8, dims)
    rows = []
    for k in range(n):
        e = centres[draw.randint(8)] + spread * draw.randn(dims)
        e *= lengths[draw.randint(len(lengths))] / np.linalg.norm(e)
        rows.append((k, e.astype("f4").astype(float).tolist(), int(draw.randint(labels))))
    return rows


@pytest.mark.parametrize("n, dims, lengths, block", [(400, 64, (1.0,), 4096), (500, 6, (0.1, 1.0, 5.0), 13), (300, 3, (1.0, 2.0), 50)])
def test_against_all_products(spark, n, dims, lengths, block):
    rows = vectors(dims, n, dims, lengths=lengths)
    got = hn.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(5), every=4, block=block)
    assert sorted(map(tuple, got.collect())) == plain(rows)


def test_ties_and_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(k, [float(k % 3), 1.0], k % 2) for k in range(60)]
    rows += [(60, [0.0, 0.0], 1), (61, [0.0, 0.0], 0), (62, None, 0), (64, [1.0, None], 1), (68, [nan, 1.0], 0), (72, [inf, 1.0], 0), (76, [1.0], 0),
             (77, [2.0], 1), (None, [1.0, 1.0], 0), (80, [1.0, 1.0], None), (84, [], 1), (88, [-1.0, -2.0], 1), (8, [2.0, 1.0], 0), (8, [2.0, 1.0], 0)]
    clash = SCHEMA + ", vec string, key string, score string, rank int, row int, n int"
    frame = spark.createDataFrame([(*r, "x", "y", "z", 1, 2, 3) for r in rows], clash)
    assert sorted(map(tuple, hn.hard_negatives(frame, every=4).collect())) == plain(rows)
    assert hn.hard_negatives(frame.limit(0)).collect() == []


def test_products_beyond_doubles(spark):
    rows = [(k, [x * 2.0**20 + k / 7 for x in e], label) for k, e, label in vectors(5, 80, 4)]
    got = sorted(map(tuple, hn.hard_negatives(spark.createDataFrame(rows, SCHEMA), every=4).collect()))
    assert got == plain(rows) and abs(got[0][4]) > 1 << 53
    rows = [(k, [x * 1e250 for x in e], label) for k, e, label in vectors(6, 40, 4)]
    got = sorted(map(tuple, hn.hard_negatives(spark.createDataFrame(rows, SCHEMA), every=4).collect()))
    assert got == plain(rows)


def test_coordinates_prune_where_vectors_are_concentrated():
    draw = np.random.RandomState(2)
    rows = np.eye(32)[draw.randint(32, size=4000)] * 3 + draw.randn(4000, 32) * 0.1
    labels, ids = draw.randint(2, size=4000), np.arange(4000)
    search = hn.Search(ids[:40], labels[:40], rows[:40], [[(0, None, None)]] * 40, True, 5)
    for at in range(0, 4000, 1000):
        search.chunk(ids[at : at + 1000], labels[at : at + 1000], rows[at : at + 1000])
    assert search.verified < 0.4 * 40 * 4000  # the first bucket is seen whole, the others hardly
    whole = np.floor(256 * rows)
    for a in range(40):
        scores = whole @ whole[a]
        open_ = [k for k in range(4000) if labels[k] == labels[a] and k != a]
        want = sorted(open_, key=lambda k: (-scores[k], k))[:5]
        assert search.best[a][0][1].tolist() == want
