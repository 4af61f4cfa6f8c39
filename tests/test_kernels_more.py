"""Trees, searches from both ends and one-label queues on networks with cycles, against enumeration."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from test_kernels import all_routes, dag, front

from wayfront.plans import kernels


def cyclic(n: int, seed: int):
    rng = random.Random(seed)
    return kernels.network((i, j, tuple(rng.randint(0, 6) for _ in range(4)) + (1,)) for i in range(1, n + 1) for j in range(1, n + 1) if i != j and rng.random() < 0.3)


@pytest.mark.parametrize("seed", range(12))
def test_trees_and_both_ways(seed):
    net = cyclic(8, seed)
    for source in range(1, 9):
        for k in (0, 2, 4):
            dist, before = kernels.tree(net, source, k)
            for target in range(1, 9):
                routes = all_routes(net, source, target)
                least = min((c[k] for c, _ in routes), default=None)
                assert dist.get(target) == least
                found = kernels.both_ways(net, source, target, k)
                assert (found[1] if found else None) == least
                if found:
                    path = found[0]
                    assert path[0] == source and path[-1] == target
                    assert sum(min(c[k] for o, c in net[a] if o == b) for a, b in zip(path, path[1:])) == least
                    assert kernels.walk(before, target)[::-1][0] == source
                    alone = kernels.tree(net, source, k, target)
                    assert alone[0][target] == least
                hops = kernels.hops_both_ways(net, source, target)
                assert (hops[1] if hops else None) == min((len(p) - 1 for _, p in routes), default=None)


@pytest.mark.parametrize("seed", range(10))
@pytest.mark.parametrize("m", [2, 3, 5])
def test_one_label_each(seed, m):
    for net, n in ((dag(11, seed), 11), (cyclic(8, seed), 8)):
        expected = front([c for c, _ in all_routes(net, 1, n)], m)
        found, stats = kernels.one_label_each(net, 1, n, m)
        assert found == expected and stats["open_peak"] <= n
        assert kernels.pareto(net, 1, n, m)[0] == expected


@pytest.mark.parametrize("seed", range(6))
def test_reverse_tree(seed):
    net = cyclic(8, seed)
    best, after = kernels.reverse_tree(net, 8, lambda c: 2 * c[0] + c[1])
    for node in range(1, 9):
        routes = [(2 * c[0] + c[1], *c[:3]) for c, _ in all_routes(net, node, 8)]
        assert best.get(node) == (min(routes) if routes else None)
        if node in after:
            assert after[node] in {o for o, _ in net[node]}


def test_budget_ends_a_search():
    net = dag(12, 3)
    found, stats = kernels.pareto(net, 1, 12, 3, max_expanded=3)
    assert stats["exact"] == 0 and stats["expanded"] == 3 and len(found) <= 3


def test_shortest_for_many_weights_at_once():
    """Networks with cycles, costs of zero and ties, against one search for each weight."""
    rng = random.Random(41)
    for _ in range(60):
        n, high = rng.randint(2, 9), rng.choice([1, 3, 40, 1 << 61])
        net = kernels.network((rng.randint(1, n), rng.randint(1, n), tuple(rng.randint(0, high) for _ in range(5))) for _ in range(rng.randint(1, 30)))
        weights = np.array([[rng.choice([0, 1, 2, 500_000]) for _ in range(5)] for _ in range(50)])
        expected = set()
        for w in weights.tolist():
            found = kernels.shortest(net, 1, lambda c, w=w: (sum(a * b for a, b in zip(w, c, strict=True)),), n).get(n)
            expected |= {found[1:]} if found else set()
        assert kernels.shortest_each(net, 1, n, weights) == expected


def test_many_weights_take_little_time():
    """4096 weights over a network of 25 nodes took some 600 ms by one search each."""
    rng = random.Random(42)
    net = kernels.network((a, b, tuple(rng.randint(1, 60) for _ in range(5))) for a in range(25) for b in (a + 1, a + 5) if b < 25 and (b == a + 5 or b % 5))
    weights = np.array([[rng.randint(0, 100_000) for _ in range(5)] for _ in range(4096)])
    began = time.process_time()
    found = kernels.shortest_each(net, 0, 24, weights)
    batch, began = time.process_time() - began, time.process_time()
    expected = {kernels.shortest(net, 0, lambda c, w=w: (sum(a * b for a, b in zip(w, c, strict=True)),), 24)[24][1:] for w in weights.tolist()}
    single = time.process_time() - began
    print("seconds at once, one by one", batch, single)
    assert found == expected and 5 * batch < single
