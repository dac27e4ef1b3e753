"""Embedding links against all pairs."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from corrobora.llm import embedding_links as el

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, cosine=el.COSINE):
    ok = [k for k, (_, e, label) in enumerate(rows) if label is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    links = {k: set() for k in range(len(rows))}
    for i in ok:
        for j in ok:
            if i < j and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                x, y = np.array(rows[i][1], "f4").astype(float), np.array(rows[j][1], "f4").astype(float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                    links[i].add(j)
                    links[j].add(i)
    out = []
    for k, row in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for n in links[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        known = [rows[n][0] for n in seen if rows[n][0] is not None]
        least = min(known) if known else None
        out.append((row[0], len(links[k]), least, row[0] == least))
    return sorted(out, key=str)


def groups(seed, n, dims=64, labels=3, spread=(0.05, 0.2, 0.4)):
    """Vectors around few centres at several distances, so that many pairs lie about the threshold."""
    draw = np.random.RandomState(seed)
    centres = draw.randn(6, dims)
    rows = []
    for k in range(n):
        c = centres[draw.randint(6)] if draw.rand() < 0.8 else draw.randn(dims)
        e = c + draw.randn(dims) * spread[draw.randint(len(spread))]
        rows.append((k, [float(x) for x in e.astype("f4")], int(draw.randint(labels))))
    return rows


@pytest.mark.parametrize("dims, homes, visitors", [(64, 8192, 16384), (64, 7, 20), (10, 30, 25), (100, 3, 1000)])
def test_against_all_pairs(spark, dims, homes, visitors):
    rows = groups(dims, 300, dims)
    got = el.vector_links(spark.createDataFrame(rows, SCHEMA).repartition(5), homes=homes, visitors=visitors).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)
    assert sum(r.n_links for r in got) > 1000


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0), (2, v, 0), (2, v, 0), (None, v, 0), (5, v, None), (6, None, 0), (7, [], 0), (8, [0.0, 0.0, 0.0], 0), (9, [1.0, None, 3.0], 0),
            (10, [nan, 2.0, 3.0], 0), (11, [inf, 2.0, 3.0], 0), (12, [2.0, 4.0, 6.0], 0), (13, [1.0, 2.0], 0), (14, v, 1), (None, [5.0, -1.0, 0.0], 0),
            (15, [3e38, 3e38, 3e38], 2), (16, [1e-44, 1e-44, 1e-44], 2)]
    clash = "vec_id long, embedding array<float>, label int, vec string, cid long, n int, root long, dims int, block int, cell int, h int, links int"
    frame = spark.createDataFrame([(*r, "x", *[3] * 8) for r in rows], clash)
    assert sorted(map(tuple, el.vector_links(frame).collect()), key=str) == plain(rows)
    assert el.vector_links(frame.limit(0)).collect() == []


def test_large_group_of_near_copies_is_split(spark):
    draw = np.random.RandomState(1)
    centre = draw.randn(64)
    rows = [(k, [float(x) for x in (centre + draw.randn(64) * 0.1).astype("f4")], 0) for k in range(900)]
    rows += [(k, rows[0][1], 0) for k in range(900, 1300)]
    rows += [(k, [float(x) for x in draw.randn(64).astype("f4")], k % 3) for k in range(1300, 1500)]
    got = sorted(map(tuple, el.vector_links(spark.createDataFrame(rows, SCHEMA), homes=100, visitors=150).collect()))
    assert got[:1300] == [(k, 1299, 0, k == 0) for k in range(1300)]
    assert all(r[1] == 0 for r in got[1300:])


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.sampled_from([3, 16, 20, 64]))
def test_rotation_keeps_distances_and_ignores_neighbours(seed, dims):
    units = el.unit_vectors(np.random.RandomState(seed).randn(9, dims))
    turned = el.rotate(units)
    assert np.allclose(turned @ turned.T, units @ units.T, atol=1e-12)
    assert all((el.rotate(units[k : k + 1]) == turned[k]).all() for k in range(9))


def test_every_block_owner_finds_each_link_once():
    rows = groups(3, 400, labels=1)
    vectors = np.array([r[1] for r in rows])
    everyone, order = np.ones(len(rows), bool), np.arange(len(rows))
    pairs = [p for b in range(4) for i, j in el.block_links(vectors, everyone, everyone, order, b, 0.93) for p in zip(i.tolist(), j.tolist())]
    units = el.unit_vectors(vectors)
    want = np.argwhere(np.tril(units @ units.T >= 0.93, -1))
    assert len(pairs) == len({*pairs}) and sorted(pairs) == sorted(map(tuple, want.tolist()))
