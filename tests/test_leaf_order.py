"""Linkage by definition, and leaf orders against all orders that the tree allows."""

import itertools

import numpy as np
import pytest

from marlspan.functions import kernels


def random_distances(rng, k, ties):
    d = rng.integers(1, 4, (k, k)).astype(float) if ties else rng.random((k, k))
    d = np.triu(d, 1)
    return d + d.T


def merged_groups(dist):
    """Average linkage by its definition: each time the two groups with the least mean distance."""
    groups, out = [frozenset([i]) for i in range(len(dist))], []
    while len(groups) > 1:
        a, b = min(itertools.combinations(groups, 2), key=lambda p: dist[np.ix_(sorted(p[0]), sorted(p[1]))].mean())
        out.append((a | b, dist[np.ix_(sorted(a), sorted(b))].mean()))
        groups = [g for g in groups if g not in (a, b)] + [a | b]
    return out


@pytest.mark.parametrize("seed", range(12))
def test_merges_follow_the_definition(seed):
    dist = random_distances(np.random.default_rng(seed), 3 + seed, False)
    held, got = {i: frozenset([i]) for i in range(len(dist))}, []
    for i, j, h in kernels.average_merges(dist):
        union = held[i] | held[j]
        got.append((union, h))
        for x in union:
            held[x] = union
    want = merged_groups(dist)
    assert [g for g, _ in got] == [g for g, _ in want] and np.allclose([h for _, h in got], [h for _, h in want])


def allowed(tree):
    if isinstance(tree, int):
        return [[tree]]
    return [x + y for a, b in (tree, tree[::-1]) for x in allowed(a) for y in allowed(b)]


@pytest.mark.parametrize("seed", range(16))
def test_order_is_the_best_that_the_tree_allows(seed):
    rng = np.random.default_rng(seed)
    dist = random_distances(rng, int(rng.integers(2, 9)), seed % 2)
    merges = kernels.average_merges(dist)
    tree = dict(enumerate(range(len(dist))))
    where = list(range(len(dist)))
    for i, j, _ in merges:
        a, b = where[i], where[j]
        tree[a] = (tree[a], tree[b])
        where = [a if w == b else w for w in where]
    cost = lambda o: sum(dist[x, y] for x, y in zip(o, o[1:]))
    orders = allowed(tree[where[0]])
    got = kernels.leaf_order(dist, merges)
    assert got in orders and np.isclose(cost(got), min(map(cost, orders)))


def test_small_and_many():
    assert kernels.average_linkage(np.zeros((1, 1)), 0.6) == ([0], [0])
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 3))
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    label, order = kernels.average_linkage(dist, 1.0)
    assert sorted(order) == list(range(120)) and all(label[i] <= i for i in range(120)) and len(set(label)) > 5
