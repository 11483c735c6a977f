"""Guide trees, sequence weights and merge schedules of one family."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd

UPGMA, WPGMA = 0, 1


@dataclass
class Node:
    left: int = -1
    right: int = -1
    parent: int = -1
    dist: float = 0.0
    leaves: int = 1


def build_tree(d: np.ndarray, linkage: int = UPGMA) -> list[Node]:
    """Nodes 0 .. n - 1 are the leaves, the root is last. The first strictly nearest pair i > j merges.

    Both children of a merge get half its distance; the larger index is the left child and its
    place holds the merged cluster. Distances below zero count as zero.
    """
    n = len(d)
    nodes = [Node() for _ in range(n)]
    d = np.maximum(np.array(d, float), 0)
    np.fill_diagonal(d, np.inf)
    node_of = list(range(n))
    # of each row the nearest of the rows before it, the first of equally near ones
    of = np.zeros(n, int)
    near = np.full(n, np.inf)

    def look(row: int) -> None:
        of[row] = d[row, :row].argmin()
        near[row] = d[row, of[row]]

    for row in range(1, n):
        look(row)
    for _ in range(n - 1):
        i = int(near.argmin())  # the first row of those whose nearest is nearest
        j, least = int(of[i]), near[i]
        left, right = node_of[i], node_of[j]
        a, b = nodes[left].leaves, nodes[right].leaves
        nodes.append(Node(left, right, -1, 0.0, a + b))
        for child in (left, right):
            nodes[child].parent, nodes[child].dist = len(nodes) - 1, least / 2
        merged = (d[i] * a + d[j] * b) / (a + b) if linkage == UPGMA else (d[i] + d[j]) / 2
        d[i], d[:, i] = merged, merged
        d[i, i] = np.inf
        d[j], d[:, j], near[j] = np.inf, np.inf, np.inf
        node_of[i] = len(nodes) - 1
        # only rows that pointed at one of the two must be looked through; rows after i may now be nearest to it
        lost = np.flatnonzero((of == j) | (of == i))
        later = np.arange(i + 1, n)
        closer = later[(d[later, i] < near[later]) | ((d[later, i] == near[later]) & (i < of[later]) & np.isfinite(near[later]))]
        near[closer], of[closer] = d[closer, i], i
        for row in (i, *lost[np.isfinite(near[lost])].tolist()):
            look(row)
    return nodes


def weights(nodes: list[Node], n: int) -> list[int]:
    """Of each leaf: branch lengths up to the root, each shared by the leaves below; about 1000 in all, 1 at least."""
    raw = []
    for leaf in range(n):
        total, at = 0.0, leaf
        while nodes[at].parent >= 0:
            total += nodes[at].dist / nodes[at].leaves
            at = nodes[at].parent
        raw.append(int(100 * total))
    if not sum(raw):
        raw = [1] * n
    return [max(1, 1000 * w // sum(raw)) for w in raw]


def merge_order(nodes: list[Node]) -> list[dict]:
    """Merges in post-order from 1: depth, number of both children (0 for a leaf), leaves of both sides."""
    found: list[dict] = []
    number, leaves = {}, {}
    # children before parents; an explicit stack, for trees may be deep
    stack = [(len(nodes) - 1, 0, False)] if nodes else []
    while stack:
        at, depth, ready = stack.pop()
        node = nodes[at]
        if node.left < 0:
            leaves[at] = [at]
        elif not ready:
            stack += [(at, depth, True), (node.right, depth + 1, False), (node.left, depth + 1, False)]
        else:
            leaves[at] = leaves[node.left] + leaves[node.right]
            number[at] = len(number) + 1
            found.append({"ord": number[at], "depth": depth, "left_ord": number.get(node.left, 0), "right_ord": number.get(node.right, 0), "left_leaves": leaves[node.left], "right_leaves": leaves[node.right]})
    return found


def nodes_of(frame: pd.DataFrame) -> list[Node]:
    """The nodes of one tree from its rows."""
    frame = frame.sort_values("node")
    return [Node(int(r.left), int(r.right), int(r.parent), float(r.dist), int(r.n_leaves)) for r in frame.itertuples(index=False)]


def subtree_roots(nodes: list[Node], most: int) -> list[int]:
    """Of each node the root of its subtree of at most most leaves; nodes above such subtrees are their own."""
    roots = list(range(len(nodes)))
    for k in reversed(range(len(nodes))):
        parent = nodes[k].parent
        if parent >= 0 and nodes[parent].leaves <= most:
            roots[k] = roots[parent]
    return roots


def levels_above(nodes: list[Node], most: int) -> dict[int, int]:
    """Of each node with more than most leaves its level: one more than its children's highest, subtrees have 0."""
    found: dict[int, int] = {}
    for k, node in enumerate(nodes):  # children come before their parents
        if node.leaves > most:
            found[k] = 1 + max(found.get(node.left, 0), found.get(node.right, 0))
    return found
