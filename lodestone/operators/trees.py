"""Trees of capabilities that grow by one sample at a time, and the measures that they grow by.

Inserting is sequential by nature. A table is therefore dealt into parts of bounded size, each of which grows a tree of
its own in one task: all rows take part, and no task holds more than its part.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a part.
PART = 250


def split_gate(parent: float, children: list[float], bases: int, dimension: float, scale: float) -> dict:
    """Whether a split pays: the largest child's risk density above the parent's stays below the gain in bias."""
    before = max(1, bases)
    after = max(before + len(children) - 1, before)
    power = -2.0 / max(dimension, 1e-12)
    gain = max(scale, 0.0) * (before**power - after**power)
    delta = max(children) - parent
    return {"risk_delta": delta, "bias_gain": gain, "accepted": delta < gain}


def risk_density(x: np.ndarray) -> float:
    return float(((x - x.mean(axis=0)) ** 2).sum() / len(x) / len(x)) if len(x) else 0.0


def objective(groups: list[np.ndarray]) -> float:
    """Sum over groups of density (n * (2 - mean distance), 2 for a single member) times mean distance to other centres."""
    some = [g for g in groups if len(g)]
    if len(some) < 2:
        return 0.0
    centers = np.array([g.mean(axis=0) for g in some])
    apart = np.sqrt(((centers[:, None] - centers[None]) ** 2).sum(axis=2)).sum(axis=1) / (len(some) - 1)
    dense = [2.0 if len(g) == 1 else len(g) * (2 - float(np.sqrt(((g - c) ** 2).sum(axis=1)).mean())) for g, c in zip(some, centers, strict=True)]
    return float(np.dot(dense, apart))


def two_means(x: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Labels 0 and 1 from the two farthest-apart starts (farthest from the mean, then from that); never an empty side."""
    first = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmax())
    second = int(((x - x[first]) ** 2).sum(axis=1).argmax())
    centers = x[[first, second]].copy()
    labels = np.zeros(len(x), dtype=np.int64)
    for _ in range(rounds):
        far = ((x[:, None] - centers[None]) ** 2).sum(axis=2)
        new = far.argmin(axis=1)
        for side in (0, 1):
            if not (new == side).any():
                new[int(far[:, side].argmin())] = side
        if (new == labels).all() and _:
            break
        labels = new
        centers = np.array([x[labels == side].mean(axis=0) for side in (0, 1)])
    return labels


def two_groups(x: np.ndarray, first: np.ndarray, second: np.ndarray, rounds: int = 10) -> np.ndarray:
    """Labels 0 and 1 by distance to two centres that follow their members; ties to the first, never an empty side."""
    labels = np.full(len(x), -1)
    for _ in range(rounds):
        far = np.stack([np.linalg.norm(x - c, axis=1) for c in (first, second)])
        new = (far[0] > far[1]).astype(np.int64)
        for side in (0, 1):
            if not (new == side).any():
                new[int(far[1 - side].argmax())] = side
        first, second = x[new == 0].mean(axis=0), x[new == 1].mean(axis=0)
        if (new == labels).all():
            break
        labels = new
    return labels


def local_kmeans(x: np.ndarray, k: int, rounds: int = 50) -> np.ndarray | None:
    """Labels of a bounded set from starts that are far apart; None if fewer than k groups come of it."""
    starts = [int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())]
    while len(starts) < k:
        starts.append(int(np.min([((x - x[i]) ** 2).sum(axis=1) for i in starts], axis=0).argmax()))
    centers, labels = x[starts], np.full(len(x), -1)
    for _ in range(rounds):
        new = ((x[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
        if (new == labels).all():
            break
        labels = new
        centers = np.array([x[labels == g].mean(axis=0) if (labels == g).any() else centers[g] for g in range(k)])
    return labels if len(np.unique(labels)) == k else None


def silhouette(x: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette by distance; 0 for a member that is alone."""
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    groups, out = np.unique(labels), []
    for i, own in enumerate(labels.tolist()):
        same = labels == own
        if same.sum() == 1:
            out.append(0.0)
            continue
        a = far[i][same].sum() / (same.sum() - 1)
        b = min(far[i][labels == g].mean() for g in groups if g != own)
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(out))


@dataclass(eq=False)
class Node:
    """A node with samples of its own, children, or both. Its centre is the mean of all samples below it."""

    name: str
    reach: float
    parent: Node | None = None
    ids: list = field(default_factory=list)
    rows: list[np.ndarray] = field(default_factory=list)
    children: list[Node] = field(default_factory=list)
    idle: int = 0

    def walk(self) -> Iterator[Node]:
        yield self
        for child in self.children:
            yield from child.walk()

    @property
    def array(self) -> np.ndarray:
        return np.array([x for n in self.walk() for x in n.rows])

    @property
    def center(self) -> np.ndarray:
        return self.array.mean(axis=0)

    @property
    def height(self) -> int:
        return 1 + max((c.height for c in self.children), default=-1)

    @property
    def depth(self) -> int:
        return 0 if self.parent is None else 1 + self.parent.depth

    def adopt(self, children: list[Node]) -> None:
        for child in children:
            child.parent = self
        self.children += children

    def cap(self, reach: float) -> None:
        """No reach below a node is greater than its own."""
        self.reach = min(self.reach, reach)
        for child in self.children:
            child.cap(self.reach)


class _Tree:
    """What both kinds of trees share: a root, names in order of making, and a decision for each sample."""

    def __init__(self, reach: float):
        self.root, self.made = Node("root", reach), 0
        self.decisions: list[tuple] = []

    def _node(self, ids: list, rows: list[np.ndarray], reach: float, kind: str = "leaf") -> Node:
        self.made += 1
        return Node(f"{kind}{self.made - 1}", reach, None, ids, rows)

    @property
    def leaves(self) -> list[Node]:
        """The nodes that hold samples of their own."""
        return [n for n in self.root.walk() if n.ids]

    def rows(self) -> list[tuple]:
        """(node, parent, depth, own samples, samples below, reach) of all nodes."""
        return [(n.name, n.parent.name if n.parent else None, n.depth, len(n.ids), sum(len(m.ids) for m in n.walk()), n.reach) for n in self.root.walk()]

    def members(self) -> list[tuple]:
        """(node, place, sample)."""
        return [(n.name, at, i) for n in self.root.walk() for at, i in enumerate(n.ids)]


class GrowingTree(_Tree):
    """A tree that assigns samples to nodes or founds new ones, as a router replies, and splits nodes that grow.

    A reply is the name of a node that holds samples, or `new:` and the name of the node to found one under. Without a
    valid reply a sample goes to the nearest such node (ties to the older one). Farther than `reach` from all, it founds
    a leaf beside that node, unless the objective is higher with it in the nearest. A leaf of `size` members or more is
    split in two children if the gate, or with gate=False a higher objective, allows, down to `layers` levels; the
    children's reach shrinks by `decay`. With patience, leaves of one sample that saw none for so many samples go: the
    sample joins the parent, or below the root the nearest other node.
    """

    def __init__(self, reach: float, decay: float = 0.9, size: int = 20, gate: bool = True, scale: float = 1.0, patience: int = 0, layers: int = 3):
        super().__init__(reach)
        self.decay, self.size, self.gate, self.scale, self.patience, self.layers = decay, size, gate, scale, patience, layers

    def seed(self, groups: list[tuple[list, list[np.ndarray]]]) -> None:
        """Leaves to begin with, each of ids and rows."""
        for ids, rows in groups:
            self.root.adopt([self._node(list(ids), list(rows), self.root.reach)])
            self.decisions += [(i, "warm", self.root.children[-1].name) for i in ids]

    @staticmethod
    def _own(node: Node) -> np.ndarray:
        return np.array(node.rows)

    def nearest(self, x: np.ndarray, k: int = 1) -> list[tuple[float, Node]]:
        """The k nearest nodes that hold samples, by distance to their samples' mean: the candidates of a router."""
        found = [(round(float(np.linalg.norm(self._own(n).mean(axis=0) - x)), 12), int(n.name[4:]), n) for n in self.leaves]
        return [(d, n) for d, _, n in sorted(found, key=lambda f: f[:2])[:k]]

    def parent_options(self, candidates: list[str], most: int = 12, hops: int = 4, top: int = 6) -> list[str]:
        """Where a new node may be founded: the root, the candidates with their ancestors a few hops up, and the first
        nodes below the root; by depth, then with most samples below first."""
        known, wanted = {n.name: n for n in self.root.walk()}, {"root"} | {c.name for c in self.root.children[:top]}
        for name in candidates:
            node = known.get(name)
            for _ in range(hops):
                if node is not None:
                    wanted.add(node.name)
                    node = node.parent
        order = sorted((known[n] for n in wanted), key=lambda n: (n.depth, -sum(len(m.ids) for m in n.walk()), n.name))
        return [n.name for n in order[:most]]

    def add(self, key, x: np.ndarray, reply: str | None = None) -> None:
        for leaf in self.leaves:
            leaf.idle += 1
        self._place(key, x, reply)
        if self.patience:
            self._prune(key)

    def _place(self, key, x: np.ndarray, reply: str | None) -> None:
        if not self.leaves:
            self._create(key, x, self.root)
            return
        known = {n.name: n for n in self.root.walk()}
        if reply and reply.startswith("new:") and reply[4:] in known:
            self._create(key, x, known[reply[4:]])
            return
        far, near = self.nearest(x)[0]
        if reply in known and known[reply].ids:
            near = known[reply]
        elif far >= near.reach:
            groups = [(n, self._own(n)) for n in self.leaves]
            apart = objective([g for _, g in groups] + [x[None]])
            merged = objective([np.vstack([g, x[None]]) if n is near else g for n, g in groups])
            if merged < apart:
                self._create(key, x, near.parent or self.root)
                return
        near.ids.append(key)
        near.rows.append(x)
        near.idle = 0
        self.decisions.append((key, "add", near.name))
        if len(near.ids) >= self.size and not near.children and near.depth < self.layers:
            self._split(key, near)

    def _create(self, key, x: np.ndarray, parent: Node) -> None:
        leaf = self._node([key], [x], parent.reach)
        parent.adopt([leaf])
        self.decisions.append((key, "create", leaf.name))

    def _split(self, key, leaf: Node) -> None:
        x = self._own(leaf)
        labels = two_means(x)
        sides = [np.flatnonzero(labels == s) for s in (0, 1)]
        if self.gate:
            fine = split_gate(risk_density(x), [risk_density(x[s]) for s in sides], len(self.leaves), x.shape[1], self.scale)["accepted"]
        else:
            others = [self._own(n) for n in self.leaves if n is not leaf]
            fine = objective(others + [x[s] for s in sides]) > objective([*others, x])
        if not fine:
            return
        leaf.adopt([self._node([leaf.ids[i] for i in s], [leaf.rows[i] for i in s], leaf.reach * self.decay) for s in sides])
        leaf.ids, leaf.rows = [], []
        self.decisions.append((key, "split", leaf.name))

    def _prune(self, key) -> None:
        for leaf in [n for n in self.leaves if len(n.ids) == 1 and not n.children and n.idle >= self.patience]:
            into = leaf.parent
            if into is self.root:
                others = [n for _, n in self.nearest(leaf.rows[0], 2) if n is not leaf]
                if not others:
                    continue
                into = others[0]
            into.ids += leaf.ids
            into.rows += leaf.rows
            leaf.parent.children.remove(leaf)
            self.decisions.append((key, "prune", leaf.name))

    def rebalance(self, rounds: int = 10) -> int:
        """Samples move to their nearest centre until none does; a node keeps its last one. The number of moves."""
        moves = 0
        for _ in range(rounds):
            leaves = self.leaves
            centers = np.array([self._own(n).mean(axis=0) for n in leaves])
            moved = 0
            for i, leaf in enumerate(leaves):
                for k in range(len(leaf.ids) - 1, -1, -1):
                    j = int(((centers - leaf.rows[k]) ** 2).sum(axis=1).argmin())
                    if j != i and len(leaf.ids) > 1:
                        leaves[j].ids.append(leaf.ids.pop(k))
                        leaves[j].rows.append(leaf.rows.pop(k))
                        moved += 1
            moves += moved
            if not moved:
                break
        return moves


class LayeredTree(_Tree):
    """A hierarchy of `layers` levels below the root in which a sample sinks from the root to the nearest child.

    At each level a sample as far as the node's reach from all children founds a leaf there, and the level is dealt anew.
    Else, if the children's objective would fall with the sample in the nearest child, and the depth allows, that child
    is split around the sample; its reach and those below shrink by `decay`. Else the sample goes on into that child. At
    the last level it joins the nearest leaf in any case.
    """

    def __init__(self, reach: float, decay: float = 0.8, layers: int = 3):
        super().__init__(reach)
        self.decay, self.layers = decay, layers

    def virtual_merge(self, node: Node, near: Node, x: np.ndarray) -> float:
        """The objective of a node's children, were the sample in one of them."""
        return objective([np.vstack([c.array, x[None]]) if c is near else c.array for c in node.children])

    def add(self, key, x: np.ndarray) -> None:
        node, layer = self.root, 1
        while node.children:
            far = [float(np.linalg.norm(c.center - x)) for c in node.children]
            near = node.children[int(np.argmin(far))]
            if layer < self.layers:
                if min(far) >= node.reach:
                    leaf = self._node([key], [x], node.reach)
                    node.adopt([leaf])
                    self.decisions.append((key, "create", leaf.name))
                    self._level(node)
                    return
                room = layer < self.layers - 1 and layer + 2 + near.height <= self.layers
                if room and self.virtual_merge(node, near, x) < objective([c.array for c in node.children]):
                    self._split(node, near, key, x)
                    return
            node, layer = near, layer + 1
        if node is self.root:
            node.adopt([self._node([key], [x], node.reach)])
            self.decisions.append((key, "create", node.children[-1].name))
        else:
            node.ids.append(key)
            node.rows.append(x)
            self.decisions.append((key, "add", node.name))

    def _level(self, node: Node, rounds: int = 10) -> None:
        """Samples and subtrees of a node's children move to the nearest child, by centres that stand still for a round."""
        for _ in range(rounds):
            children, moved = list(node.children), False
            if len(children) < 2:
                return
            centers = np.array([c.center for c in children])
            goes = lambda x, centers=centers: int(((centers - x) ** 2).sum(axis=1).argmin())
            samples = [(i, key, x) for i, c in enumerate(children) for key, x in zip(c.ids, c.rows, strict=True)]
            subtrees = [(i, s, s.center) for i, c in enumerate(children) for s in c.children]
            for i, key, x in samples:
                if (j := goes(x)) != i:
                    at = children[i].ids.index(key)
                    children[j].ids.append(children[i].ids.pop(at))
                    children[j].rows.append(children[i].rows.pop(at))
                    moved = True
            for i, subtree, center in subtrees:
                if (j := goes(center)) != i:
                    children[i].children.remove(subtree)
                    children[j].adopt([subtree])
                    moved = True
            node.children = [c for c in children if c.ids or c.children]
            if not moved:
                return

    def _split(self, node: Node, near: Node, key, x: np.ndarray) -> None:
        """An inner node takes the child's place; its two children hold what the child held, and the sample."""
        reach = node.reach * self.decay
        if near.children:
            items = [*near.children, self._node([key], [x], reach)]
            labels = two_groups(np.array([n.center for n in items]), near.center, x)
            sides = [[n for n, s in zip(items, labels.tolist(), strict=True) if s == side] for side in (0, 1)]
            halves = [own[0] if len(own) == 1 else self._inner(own, reach) for own in sides]
        else:
            ids, rows = [*near.ids, key], [*near.rows, x]
            labels = two_groups(np.array(rows), near.center, x)
            halves = [self._node([ids[i] for i in at], [rows[i] for i in at], reach) for at in (np.flatnonzero(labels == side) for side in (0, 1))]
        inner = self._inner(halves, reach)
        inner.ids, inner.rows = (near.ids, near.rows) if near.children else ([], [])
        inner.cap(reach)
        inner.parent = node
        node.children[node.children.index(near)] = inner
        self.decisions.append((key, "split", near.name))

    def _inner(self, children: list[Node], reach: float) -> Node:
        inner = self._node([], [], reach, "node")
        inner.adopt(children)
        return inner


def warm_start(tree: GrowingTree, ids: list, x: np.ndarray, most: int) -> None:
    """Leaves from the k-means of the first samples with the best silhouette, k from 2; ties to the lesser k. Labellings
    with fewer than k groups are passed over; where none is left all samples begin in one leaf."""
    found = [(-silhouette(x, labels), k, labels) for k in range(2, min(most, len(x) - 1) + 1) if (labels := local_kmeans(x, k)) is not None]
    labels = min(found, key=lambda f: f[:2])[2] if found else np.zeros(len(x), dtype=np.int64)
    tree.seed([([ids[i] for i in at], [x[i] for i in at]) for at in (np.flatnonzero(labels == g) for g in np.unique(labels))])


def in_parts(rows: DataFrame, key: str, columns: list[str], work: Callable[[pd.DataFrame], list[tuple]], schema: str, size: int = PART) -> DataFrame:
    """Deals rows into parts of about `size` by a hash of their key, and gives each part's rows by key to `work`."""
    parts = max(1, -(-rows.count() // size))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        part = int(frame["part"].iloc[0])
        found = work(frame.sort_values(key, kind="stable", ignore_index=True))
        return pd.DataFrame([(part, *r) for r in found], columns=["part", *names])

    dealt = rows.select(key, *columns, F.pmod(F.xxhash64(F.col(key)), F.lit(parts)).cast("int").alias("part"))
    return dealt.groupBy("part").applyInPandas(run, f"part int, {schema}")


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=np.float64)


def grow(rows: DataFrame, key: str, vector: str, make: Callable[[], GrowingTree | LayeredTree], tell: Callable, schema: str, size: int = PART, warm: int = 0, reply: str | None = None) -> DataFrame:
    """Grows a tree of each part, all rows by key, and returns what `tell` says of it, with the part's number.

    With `warm`, so many first samples are leaves by k-means. `reply` names the column of a router's replies.
    """

    def work(frame: pd.DataFrame) -> list[tuple]:
        tree, x = make(), matrix(frame[vector])
        keys = frame[key].tolist()
        if warm:
            warm_start(tree, keys[:warm], x[:warm], 6)
        for i in range(warm, len(keys)):
            tree.add(keys[i], x[i], frame[reply].iloc[i]) if reply else tree.add(keys[i], x[i])
        return tell(tree)

    return in_parts(rows, key, [vector, *([reply] if reply else [])], work, schema, size)
