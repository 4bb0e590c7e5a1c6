"""Graphs thinned block by block have the components of the whole graph."""

import random

import pytest

from factloom.plans import graph


@pytest.mark.parametrize("seed", range(40))
def test_blocks_keep_the_components(seed):
    rnd = random.Random(seed)
    n, size = rnd.randrange(1, 25), rnd.randrange(1, 12)
    pairs = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(rnd.randrange(1, 50))]
    left = [e for i in range(0, len(pairs), size) for e in graph._thinned(pairs[i : i + size])]
    assert graph.tarjan(left) == graph.tarjan(pairs) == graph.tarjan(graph._thinned(left))


def test_a_dense_graph_is_left_with_one_ring():
    assert len(graph._thinned([(a, b) for a in range(50) for b in range(50)])) == 50
