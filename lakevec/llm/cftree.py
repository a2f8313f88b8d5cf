"""Trees of cluster features: mergeable summaries of vectors, and Ward's agglomeration of their leaves."""

from __future__ import annotations

import numpy as np

#: Entries of a node before it is split, and the factor by which a full tree's threshold grows.
BRANCHING, GROWTH = 32, 1.25


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T), 0)


class _Node:
    """Entries (number, linear sum, square sum) and, above the leaves, the node below each entry."""

    __slots__ = ("n", "ls", "ss", "below")

    def __init__(self, n: np.ndarray, ls: np.ndarray, ss: np.ndarray, below: list[_Node] | None = None):
        self.n, self.ls, self.ss, self.below = n, ls, ss, below

    def total(self) -> tuple[float, np.ndarray, float]:
        return self.n.sum(), self.ls.sum(axis=0), self.ss.sum()


class CFTree:
    """A height-balanced tree whose leaf entries have members within threshold of their centre when they come.

    Batches are routed together. When a tree gets more than max_leaves leaf entries, they are agglomerated to half as
    many and the threshold grows, so that the tree's size is bounded whatever comes, and also vectors that are all
    equally far from each other don't fall together into one entry. A tree absorbs the leaves of another by insert.
    """

    def __init__(self, dimension: int, threshold: float, max_leaves: int):
        self.dimension, self.threshold, self.max_leaves = dimension, max(threshold, 1e-6), max_leaves
        self._root = self._empty()
        self._leaves = 0

    def _empty(self) -> _Node:
        return _Node(np.zeros(0), np.zeros((0, self.dimension)), np.zeros(0))

    def insert(self, n: np.ndarray, ls: np.ndarray, ss: np.ndarray) -> None:
        """Adds entries; a vector x is the entry (1, x, x·x)."""
        for at in range(0, len(n), self.max_leaves):
            part = slice(at, at + self.max_leaves)
            self._root = self._grown(self._put(self._root, n[part], ls[part], ss[part]))
            if self._leaves > self.max_leaves:
                self._halve()

    def _halve(self) -> None:
        n, ls, ss = self.leaves()
        label = ward(n, ls / n[:, None], self.max_leaves // 2)
        k = label.max() + 1
        merged = _Node(np.zeros(k), np.zeros((k, self.dimension)), np.zeros(k))
        np.add.at(merged.n, label, n)
        np.add.at(merged.ls, label, ls)
        np.add.at(merged.ss, label, ss)
        self._leaves = k
        self._root = self._grown(self._split(merged))
        self.threshold *= GROWTH

    def add(self, vectors: np.ndarray) -> None:
        x = vectors.astype(np.float64)
        self.insert(np.ones(len(x)), x, (x * x).sum(axis=1))

    def leaves(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers, linear and square sums of all leaf entries."""
        out, todo = [], [self._root]
        while todo:
            node = todo.pop()
            if node.below is None:
                out.append((node.n, node.ls, node.ss))
            else:
                todo.extend(node.below)
        return tuple(np.concatenate(x) for x in zip(*out))  # type: ignore[return-value]

    def _grown(self, nodes: list[_Node]) -> _Node:
        while len(nodes) > 1:
            nodes = self._split(self._above(nodes))
        return nodes[0]

    def _above(self, nodes: list[_Node]) -> _Node:
        sums = [x.total() for x in nodes]
        return _Node(np.array([s[0] for s in sums]), np.array([s[1] for s in sums]), np.array([s[2] for s in sums]), nodes)

    def _put(self, node: _Node, n: np.ndarray, ls: np.ndarray, ss: np.ndarray) -> list[_Node]:
        centres = ls / n[:, None]
        if node.below is None:
            rest = np.arange(len(n))
            if len(node.n):
                d = _squares(centres, node.ls / node.n[:, None])
                near = d.argmin(axis=1)
                fits = d[rest, near] <= self.threshold**2
                np.add.at(node.n, near[fits], n[fits])
                np.add.at(node.ls, near[fits], ls[fits])
                np.add.at(node.ss, near[fits], ss[fits])
                rest = rest[~fits]
            if len(rest):
                label = self._leaders(centres[rest])
                k = label.max() + 1
                new = _Node(np.zeros(k), np.zeros((k, self.dimension)), np.zeros(k))
                np.add.at(new.n, label, n[rest])
                np.add.at(new.ls, label, ls[rest])
                np.add.at(new.ss, label, ss[rest])
                self._leaves += k
                node = _Node(np.concatenate([node.n, new.n]), np.concatenate([node.ls, new.ls]), np.concatenate([node.ss, new.ss]))
            return self._split(node)
        way = _squares(centres, node.ls / node.n[:, None]).argmin(axis=1)
        below: list[_Node] = []
        for i, child in enumerate(node.below):
            mine = way == i
            below.extend(self._put(child, n[mine], ls[mine], ss[mine]) if mine.any() else [child])
        return self._split(self._above(below))

    def _leaders(self, centres: np.ndarray) -> np.ndarray:
        """Labels of new entries: each takes the open ones within the threshold of it."""
        label = np.full(len(centres), -1)
        k, open_ = 0, np.arange(len(centres))
        while len(open_):
            head = open_[:128]
            near = _squares(centres[head], centres[open_]) <= self.threshold**2
            for i, at in enumerate(head):
                if label[at] < 0:
                    take = open_[near[i]]
                    take = take[label[take] < 0]
                    label[take] = k
                    label[at] = k
                    k += 1
            open_ = open_[label[open_] < 0]
        return label

    def _split(self, node: _Node) -> list[_Node]:
        """node, or parts of at most BRANCHING entries around the ends of its longest way."""
        done, todo = [], [node]
        while todo:
            x = todo.pop()
            if len(x.n) <= BRANCHING:
                done.append(x)
                continue
            c = x.ls / x.n[:, None]
            a = _squares(c[:1], c)[0].argmax()
            da = _squares(c[a : a + 1], c)[0]
            b = da.argmax()
            second = _squares(c[b : b + 1], c)[0] < da
            if not second.any() or second.all():
                second = np.arange(len(x.n)) % 2 == 0
            for side in (second, ~second):
                at = np.flatnonzero(side)
                todo.append(_Node(x.n[at], x.ls[at], x.ss[at], None if x.below is None else [x.below[i] for i in at]))
        return done


def ward(n: np.ndarray, centres: np.ndarray, groups: int) -> np.ndarray:
    """Labels of at most so many groups by Ward's agglomeration of weighted centres, by chains of nearest neighbours."""
    size = len(n)
    if size <= groups:
        return np.arange(size)
    weight = n.astype(np.float64).copy()
    d = np.empty((size, size), dtype=np.float32)
    for at in range(0, size, 256):
        part = slice(at, at + 256)
        d[part] = _squares(centres[part], centres) * (weight[part, None] * weight[None, :] / (weight[part, None] + weight[None, :]))
    np.fill_diagonal(d, np.inf)
    alive = np.ones(size, dtype=bool)
    merges: list[tuple[float, int, int]] = []
    chain: list[int] = []
    while len(merges) < size - 1:
        if not chain:
            chain.append(int(alive.argmax()))
        top = chain[-1]
        near = int(d[top].argmin())
        if len(chain) > 1 and d[top, chain[-2]] <= d[top, near]:
            near = chain[-2]
        if len(chain) < 2 or near != chain[-2]:
            chain.append(near)
            continue
        chain = chain[:-2]
        height = float(d[top, near])
        merges.append((height, top, near))
        # Lance and Williams: distances of the union, kept in the row of near
        both = weight[top] + weight[near]
        row = ((weight[top] + weight) * d[top] + (weight[near] + weight) * d[near] - weight * height) / (both + weight)
        alive[top] = False
        row[~alive] = np.inf
        row[near] = np.inf
        d[near], d[:, near] = row, row
        d[top], d[:, top] = np.inf, np.inf
        weight[near] = both
    parent = np.arange(size)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for _, a, b in sorted(merges)[: size - groups]:
        parent[root(a)] = root(b)
    return np.unique([root(i) for i in range(size)], return_inverse=True)[1]
