"""Components by power iteration, the tree by rounds, and the order of leaves, against numpy and against search."""

from itertools import product

import numpy as np
import pytest

from tallyhelix.operators import cluster as cl


def members(tree, n):
    of = {i: frozenset([i]) for i in range(n)}
    for i, (a, b, _, size) in enumerate(tree):
        of[n + i] = of[a] | of[b]
        assert len(of[n + i]) == size and max(a, b) < n + i
    return {of[n + i]: tree[i][2] for i in range(len(tree))}


@pytest.mark.parametrize("few", [1, 7, 100])
def test_tree_by_rounds_is_the_tree_of_nearest_pairs(spark, few):
    rng = np.random.default_rng(4)
    pts = np.concatenate([rng.normal(0, 1, (9, 3)), rng.normal(7, 2, (8, 3)), rng.normal(-20, 5, (6, 3))])
    got, want = cl.tree_by_rounds(spark, pts, few), cl.linkage(pts)
    assert [t[:2] + t[3:] for t in got] == [t[:2] + t[3:] for t in want]
    assert [t[2] for t in got] == pytest.approx([t[2] for t in want])


def test_trees_of_few_and_of_equal_samples(spark):
    assert cl.tree_by_rounds(spark, np.zeros((0, 2)), 1) == [] and cl.tree_by_rounds(spark, np.zeros((1, 2)), 1) == []
    same = cl.tree_by_rounds(spark, np.zeros((6, 2)), 1)
    assert len(members(same, 6)) == 5 and {t[2] for t in same} == {0.0}
    line = np.array([[0.0], [1.0], [2.0], [3.0], [50.0]])  # equal distances along a line
    got = members(cl.tree_by_rounds(spark, line, 1), 5)
    assert got[frozenset(range(5))] == pytest.approx(48.5) and frozenset(range(4)) in got


def flips(tree, n):
    """Every order of the leaves that swapping children can give."""
    for turn in product((False, True), repeat=len(tree)):
        of = {i: [i] for i in range(n)}
        for i, (a, b, *_) in enumerate(tree):
            of[n + i] = of[b] + of[a] if turn[i] else of[a] + of[b]
        yield of[n + len(tree) - 1]


def length(order, pts):
    return sum(float(np.linalg.norm(pts[a] - pts[b])) for a, b in zip(order, order[1:]))


@pytest.mark.parametrize("seed", range(6))
def test_leaf_order_is_the_best_of_all_flips(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(2, 11))
    pts = np.round(rng.normal(0, 3, (n, 2)), seed % 3)
    tree = cl.linkage(pts)
    order = cl.leaf_order(tree, pts)
    assert order in list(flips(tree, n))
    assert length(order, pts) == pytest.approx(min(length(o, pts) for o in flips(tree, n)))
    # parts that are ordered on their own and then joined still are an order of the tree
    assert cl.leaf_order(tree, pts, most=3) in list(flips(tree, n))


def test_leaf_order_of_many_and_of_none():
    rng = np.random.default_rng(1)
    pts = rng.normal(0, 1, (120, 4))
    tree = cl.linkage(pts)
    order = cl.leaf_order(tree, pts)
    of = {i: [i] for i in range(120)}
    for i, (a, b, *_) in enumerate(tree):
        of[120 + i] = of[a] + of[b]
    assert sorted(order) == list(range(120)) and length(order, pts) < length(of[238], pts)
    assert cl.leaf_order([], np.zeros((0, 2))) == [] and cl.leaf_order([], np.zeros((1, 2))) == [0]


def cells_of(spark, x):
    return spark.createDataFrame([(s, w, float(x[s, w])) for s in range(x.shape[0]) for w in range(x.shape[1])], "s int, widx long, fpm double").repartition(5)


@pytest.mark.parametrize("block", [8, 64])
def test_components_equal_numpy_when_blocks_are_smaller_than_samples(spark, block):
    rng = np.random.default_rng(5)
    n, m = 40, 60
    x = rng.normal(100, 1, (n, m)) + 30 * rng.normal(size=(n, 1)) * rng.random(m) + 12 * rng.normal(size=(n, 1)) * rng.random(m) + 9 * rng.normal(size=(n, 1)) * rng.random(m)
    space = cl.principal(cells_of(spark, x), block=block)
    c = x - x.mean(0)
    u, sv, _ = np.linalg.svd(c, full_matrices=False)
    share = sv**2 / (sv**2).sum()
    keep = int(np.argmin(share > cl.MIN_SHARE))
    assert space.scores.shape == (n, keep) and 2 <= keep <= 8 and list(space.ids) == list(range(n))
    assert space.share[:keep] == pytest.approx(share[:keep], abs=1e-9)
    for j in range(keep):
        want = u[:, j] * sv[j]
        want *= np.sign(want[np.abs(want).argmax()])
        assert space.scores[:, j] == pytest.approx(want, abs=1e-6 * np.abs(want).max())


def test_no_samples_and_missing_values(spark):
    none = spark.createDataFrame([], "s int, widx long, fpm double")
    g = cl.grown(none)
    assert g.tree == [] and cl.tree_of(g).count() == 0 and cl.clusters(g, "A", 2).count() == 0
    with pytest.raises(Exception, match="lacks the value"):
        cl.principal(cells_of(spark, np.ones((3, 5))).where("not (s = 2 and widx = 3)"))


def test_tables_of_a_grown_tree(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(100, 1, (6, 30)), rng.normal(100, 1, (5, 30)) + 40 * rng.random(30)])
    g = cl.grown(cells_of(spark, x), few=1)
    t = {r.node: r for r in cl.tree_of(g).collect()}
    assert sorted(t[i].place for i in range(11)) == list(range(11)) and [t[i].s for i in range(11)] == list(range(11))
    for k in range(11, 21):
        assert t[k].place == min(t[t[k].c1].place, t[t[k].c2].place) and t[t[k].c1].place < t[t[k].c2].place
        assert t[k].size == t[t[k].c1].size + t[t[k].c2].size and t[k].dist >= max(t[t[k].c1].dist, t[t[k].c2].dist)
    of = {r.s: r.cluster_id for r in cl.clusters(g, "A", 4).collect()}
    assert len({of[s] for s in range(6)}) == len({of[s] for s in range(6, 11)}) == 1 and of[0] != of[10]
    # a node of the drawn tree has the cluster of its leaves, or a mark where they are of several
    d = {r.node: r.cluster_id for r in cl.dendrogram(g, "A", 4).collect()}
    leaves = {i: {of[i]} for i in range(11)}
    for k in range(11, 21):
        leaves[k] = leaves[t[k].c1] | leaves[t[k].c2]
        assert d[k] == (next(iter(leaves[k])) if len(leaves[k]) == 1 else "V")
