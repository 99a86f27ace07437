"""Vector links against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from defectlake.llm import vector_links as V

SCHEMA = "vec_id bigint, embedding array<double>, key string, gid int"


def brute(rows, cosine=0.95):
    """(vec_id, n_links, component_id, kept) by comparing every pair."""
    usable = []
    for at, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            usable.append((at, V.units(np.array([v]))[0]))
    near = {at: [] for at in range(len(rows))}
    for i, x in usable:
        near[i] = [j for j, y in usable if i != j and len(x) == len(y) and x @ y >= cosine]
    found, seen = [None] * len(rows), set()
    for at in range(len(rows)):
        if at in seen:
            continue
        group, open_ = {at}, [at]
        while open_:
            fresh = set(near[open_.pop()]) - group
            group |= fresh
            open_ += fresh
        seen |= group
        ids = [rows[i][0] for i in group if rows[i][0] is not None]
        least = min(ids) if ids else None
        for i in group:
            found[i] = (rows[i][0], len(near[i]), least, rows[i][0] == least)
    return sorted(found, key=str)


def got(spark, rows, **more):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)
    return sorted((tuple(r) for r in V.vector_links(df, **more).collect()), key=str)


def _groups(seed, n_groups, size, dim, noise):
    rng = np.random.default_rng(seed)
    x = np.repeat(rng.normal(size=(n_groups, dim)), size, axis=0) + noise * rng.normal(size=(n_groups * size, dim))
    return x * rng.uniform(0.1, 10, (len(x), 1))


@pytest.mark.parametrize("noise", [0.01, 0.15, 0.25])
def test_equals_all_pairs(spark, noise):
    x = np.concatenate([_groups(1, 12, 20, 16, noise), np.random.default_rng(2).normal(size=(150, 16))])
    rows = [(int(i) * 3 + 1, v.tolist()) for i, v in enumerate(x)]
    want = brute(rows)
    assert sum(r[1] for r in want) > 0
    assert got(spark, rows, block=16, sample=40) == want


def test_chain_over_blocks(spark):
    # neighbours at 15 degrees are linked, others are not; one component of all
    turn = np.radians(15) * np.arange(20)
    rows = [(100 - i, [float(np.cos(t)), float(np.sin(t)), 0.0]) for i, t in enumerate(turn)]
    found = got(spark, rows, block=3, sample=4)
    assert found == brute(rows)
    assert {r[2] for r in found} == {81}


def test_odd_rows(spark):
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
        (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [1e300, 1e290]), (9, [5e-324, 0.0]), (None, [1.0, 0.1]), (None, [0.0, 1.0]),
        (None, None), (10, [1.0]), (11, [2.0]), (12, [-0.0, -1.0]), (13, [0.0, -2.0]), (14, [1.0, 0.0, 0.0]), (-5, [0.99, 0.01]),
    ]
    assert got(spark, rows) == brute(rows)
    assert got(spark, rows, block=2, sample=2) == brute(rows)


def test_copies_need_one_point(spark):
    rows = [(i, [0.3, 0.4, 0.5]) for i in range(500)] + [(1000 + i, [0.3, 0.4, 0.5 + i / 1000]) for i in range(1, 30)]
    found = got(spark, rows, block=8, sample=8)
    assert found == brute(rows)


def test_empty(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, None)]) == [(1, 0, 1, True)]


def test_cover_tree_invariants():
    x = V.units(_groups(3, 15, 20, 8, 0.2))
    order, nodes = V.cover_tree(x)
    x = x[order]
    assert sorted(order) == list(range(len(x)))
    true = V.radii(x, nodes)
    level, radius = [0], 2.0
    while level:
        below = []
        for node in level:
            begin, end, first, stop = nodes[node]
            assert abs(V.chord(x[begin:end] @ x[begin]).max() - true[node]) < 1e-7 and true[node] <= radius + 1e-9
            if first == stop:
                continue
            kids = nodes[first:stop]
            assert kids[0, 0] == begin and kids[-1, 1] == end and (kids[1:, 0] == kids[:-1, 1]).all()
            centres = x[kids[:, 0]]
            apart = V.chord(centres @ centres.T) + 4 * np.eye(len(centres))
            assert apart.min() > radius / 2
            below += range(first, stop)
        level, radius = below, radius / 2


@pytest.mark.parametrize("noise", [0.005, 0.1, 0.2])
def test_traversal_counts_without_listing(noise):
    x = V.units(_groups(4, 5, 60, 12, noise))
    order, nodes = V.cover_tree(x)
    x, weights = x[order], np.arange(1, len(x) + 1)
    tree = V.Tree(len(x), 12, x.tobytes(), weights.astype(np.int64).tobytes(), nodes.tobytes())
    half = V.Tree(len(x), 12, x.astype(np.float32).tobytes(), weights.astype(np.int64).tobytes(), nodes.tobytes())
    assert np.abs(tree.x - half.x).max() < 1e-6
    pair = V.Pair(tree, tree, 0.95)
    pair.run()
    gids, n, _ = pair.links(0, 0)
    assert gids.tolist() == list(range(len(x)))
    assert n.tolist() == ((x @ x.T >= 0.95) * weights).sum(axis=1).tolist()
