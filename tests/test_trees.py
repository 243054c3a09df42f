"""Trees that grow: small cases by hand, properties, and parts of a table against a loop."""

from __future__ import annotations

import numpy as np
import pytest

from lodestone.operators import trees

SF = "/root/testdata/sf0.001"


def points(*xy):
    return [np.array(p, dtype=float) for p in xy]


def unit_rows(n, seed, d=6):
    x = np.random.default_rng(seed).normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def shape(tree):
    return {name: (parent, own) for name, parent, _, own, _, _ in tree.rows()}


def test_layered_creates_and_merges():
    tree = trees.LayeredTree(5.0, layers=3)
    for i, x in enumerate(points((0, 0), (10, 0), (20, 0), (0.5, 0))):
        tree.add(i, x)
    assert [d[1] for d in tree.decisions] == ["create", "create", "create", "add"]
    assert shape(tree) == {"root": (None, 0), "leaf0": ("root", 2), "leaf1": ("root", 1), "leaf2": ("root", 1)}
    assert tree.root.center.tolist() == [7.625, 0]


def test_layered_splits_where_the_objective_falls():
    """A sample between two far groups lowers the objective of the level: its nearest leaf is split around it."""
    tree = trees.LayeredTree(8.0, decay=0.5, layers=4)
    for i, x in enumerate(points((0, 0), (0, 0.1), (20, 0), (20, 0.1), (5, 0))):
        tree.add(i, x)
    assert tree.decisions[-1] == (4, "split", "leaf0")
    inner = tree.root.children[0]
    assert [sorted(c.ids) for c in inner.children] == [[0, 1], [4]]
    assert (inner.reach, [c.reach for c in inner.children]) == (4.0, [4.0, 4.0])
    assert tree.virtual_merge(tree.root, tree.root.children[1], np.array([5.0, 0])) < trees.objective([c.array for c in tree.root.children])


def test_layered_never_grows_deeper_than_its_layers():
    for layers in (2, 3, 4, 5):
        tree = trees.LayeredTree(1.3, layers=layers)
        for i, x in enumerate(unit_rows(150, 5)):
            tree.add(i, x)
        assert sorted(i for n in tree.root.walk() for i in n.ids) == list(range(150))
        assert max(n.depth for n in tree.root.walk()) <= layers
        assert all(n.reach <= n.parent.reach and n in n.parent.children for n in tree.root.walk() if n.parent)
        assert len({d[0] for d in tree.decisions}) == 150
    assert max(n.depth for n in tree.root.walk()) >= 3


def test_a_new_branch_takes_what_is_nearer_to_it():
    tree = trees.LayeredTree(6.0, layers=2)
    for i, x in enumerate(points((0, 0), (0, 0), (5, 0), (7.7, 0))):
        tree.add(i, x)
    assert [sorted(c.ids) for c in tree.root.children] == [[0, 1], [2, 3]]


def test_two_groups():
    x = np.array([[0.0], [1], [9], [10]])
    assert trees.two_groups(x, np.array([0.0]), np.array([10.0])).tolist() == [0, 0, 1, 1]
    assert trees.two_groups(x, np.array([5.0]), np.array([5.0])).tolist().count(1) >= 1  # ties go to the first; neither side stays empty


def test_growing_tree_has_levels_and_splits_into_children():
    tree = trees.GrowingTree(0.8, size=8, scale=50.0, layers=4)
    for i, x in enumerate(unit_rows(200, 3)):
        tree.add(i, x)
    split = [d[2] for d in tree.decisions if d[1] == "split"]
    assert split
    nodes = {n.name: n for n in tree.root.walk()}
    assert all(len(nodes[name].children) >= 2 for name in split)
    assert 2 <= max(n.depth for n in nodes.values()) <= 4
    assert sorted(i for n in nodes.values() for i in n.ids) == list(range(200))


def test_router_replies():
    tree = trees.GrowingTree(10.0)
    x = unit_rows(6, 1)
    tree.add(0, x[0])
    tree.add(1, x[1], "new:root")
    tree.add(2, x[2], "leaf1")
    tree.add(3, x[3], "no such node")
    tree.add(4, x[4], "new:leaf1")
    assert [d[1:] for d in tree.decisions[:3]] == [("create", "leaf0"), ("create", "leaf1"), ("add", "leaf1")]
    assert tree.decisions[4] == (4, "create", "leaf2")
    assert tree.root.children[1].children[0].ids == [4]
    candidates = [n.name for _, n in tree.nearest(x[5], 5)]
    assert set(candidates) == {n.name for n in tree.leaves}
    assert tree.parent_options(["leaf2"])[0] == "root"
    assert set(tree.parent_options(["leaf2"])) == {"root", "leaf0", "leaf1", "leaf2"}
    assert tree.parent_options(["leaf2"], most=2) == ["root", "leaf1"]


def test_stale_leaves_join_their_parent_or_the_nearest():
    tree = trees.GrowingTree(10.0, patience=3, size=100)
    for i, x in enumerate(points((0, 0), (50, 0))):
        tree.add(i, x, "new:root")
    for i in range(2, 8):
        tree.add(i, np.array([0.1 * i, 0]))
    assert (4, "prune", "leaf1") in tree.decisions
    assert [n.name for n in tree.leaves] == ["leaf0"]
    below = trees.GrowingTree(10.0, patience=2, size=100)
    below.add(0, np.zeros(2))
    below.add(1, np.ones(2), "new:leaf0")
    for i in range(2, 6):
        below.add(i, np.zeros(2), "leaf0")
    assert [n.name for n in below.leaves] == ["leaf0"]
    assert sorted(below.leaves[0].ids) == list(range(6))


def test_warm_start_finds_groups_that_are_apart():
    x = np.concatenate([np.random.default_rng(i).normal(size=(8, 3)) * 0.1 + 10 * i for i in range(3)])
    tree = trees.GrowingTree(1.0)
    trees.warm_start(tree, list(range(24)), x, 6)
    assert sorted(sorted(n.ids) for n in tree.leaves) == [list(range(8)), list(range(8, 16)), list(range(16, 24))]
    same = trees.GrowingTree(1.0)
    trees.warm_start(same, [0, 1, 2], np.zeros((3, 2)), 6)
    assert [n.ids for n in same.leaves] == [[0, 1, 2]]
    assert trees.local_kmeans(np.zeros((5, 2)), 2) is None


def test_silhouette():
    x, labels = np.array([[0.0], [1], [10], [12]]), np.array([0, 0, 1, 1])
    a, b = [1, 1, 2, 2], [11, 10, 9.5, 11.5]
    assert trees.silhouette(x, labels) == pytest.approx(np.mean([(q - p) / max(p, q) for p, q in zip(a, b, strict=True)]))


@pytest.mark.parametrize("make", [lambda: trees.LayeredTree(1.0, layers=4), lambda: trees.GrowingTree(1.1, scale=5.0)])
def test_parts_cover_the_table_and_match_a_loop(spark, make):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").selectExpr("vec_id", "CAST(embedding AS ARRAY<DOUBLE>) AS v")
    tell = lambda tree: [(n, int(i), at) for n, at, i in tree.members()]
    found = trees.grow(rows, "vec_id", "v", make, tell, "node string, vec_id long, at int", size=120).collect()
    vectors = {r["vec_id"]: np.array(r["v"]) for r in rows.collect()}
    assert sorted(r["vec_id"] for r in found) == sorted(vectors)
    parts = {}
    for r in found:
        parts.setdefault(r["part"], []).append(r)
    assert len(parts) >= 4
    for own in parts.values():
        tree = make()
        for k in sorted(r["vec_id"] for r in own):
            tree.add(k, vectors[k])
        assert sorted(tell(tree)) == sorted((r["node"], r["vec_id"], r["at"]) for r in own)


def test_queries_are_not_empty(spark):
    from lodestone.plans import registry

    for name in ("c4_incremental", "c6_stale_leaves", "c8_objective_split", "c9_hierarchy", "c27_tree_state"):
        assert registry.queries()[name](spark, SF).count() > 0
    assert registry.queries()["c9_hierarchy"](spark, SF).where("depth >= 2").count() > 0
    n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    for name in ("c10_rebalance", "c11_two_means", "c15_stabilise", "c27_tree_state"):
        assert registry.queries()[name](spark, SF).select("vec_id").distinct().count() == n
