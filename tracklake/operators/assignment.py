"""Optimal one-to-one assignment with numpy: shortest augmenting paths with potentials."""

from __future__ import annotations

import itertools
import math

import numpy as np

#: Ways to match a cluster up to which all are compared, for many clusters at once.
WAYS = 720


def minimum_assignment(cost: np.ndarray) -> np.ndarray:
    """Pairs (row, column) of least total cost, min(rows, columns) of them, in order of rows."""
    cost = np.asarray(cost, float)
    if cost.size == 0:
        return np.zeros((0, 2), int)
    if cost.shape[0] > cost.shape[1]:
        pairs = minimum_assignment(cost.T)[:, ::-1]
        return pairs[np.argsort(pairs[:, 0], kind="stable")]
    n, m = cost.shape
    row_price, col_price = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)  # the row of each column
    for row in range(n):
        reach, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        current, at, total = row, -1, 0.0
        while True:
            slack = total + cost[current] - row_price[current] - col_price
            better = ~done & (slack < reach)
            reach[better], via[better] = slack[better], at
            at = int(np.argmin(np.where(done, np.inf, reach)))
            total = reach[at]
            done[at] = True
            if owner[at] < 0:
                break
            current = int(owner[at])
        seen = np.flatnonzero(done)
        seen = seen[seen != at]
        row_price[row] += total
        row_price[owner[seen]] += total - reach[seen]
        col_price[seen] -= total - reach[seen]
        while at >= 0:  # shift owners along the path
            before = int(via[at])
            owner[at] = owner[before] if before >= 0 else row
            at = before
    cols = np.flatnonzero(owner >= 0)
    pairs = np.c_[owner[cols], cols]
    return pairs[np.argsort(pairs[:, 0], kind="stable")]


def maximum_assignment(gain: np.ndarray) -> np.ndarray:
    return minimum_assignment(-np.asarray(gain, float))


def clusters(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each link between a left and a right node (numbers from 0) the number of its connected component: least labels and jumps."""
    if not len(left):
        return np.zeros(0, int)
    n = int(left.max()) + 1
    a, b = left, right + n
    label = np.arange(n + int(right.max()) + 1)
    while True:
        least = label.copy()
        np.minimum.at(least, a, label[b])
        np.minimum.at(least, b, label[a])
        least = np.minimum(least, least[least])
        if (least == label).all():
            return label[a]
        label = least


def _within(node: np.ndarray, cluster: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each link's node as a number within its cluster, and the nodes of each of k clusters."""
    _, first, at = np.unique(node, return_index=True, return_inverse=True)
    of = cluster[first]
    order, sizes = np.argsort(of, kind="stable"), np.bincount(of, minlength=k)
    rank = np.empty(len(of), int)
    rank[order] = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return rank[at], sizes


def sides(left: np.ndarray, right: np.ndarray, cluster: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each link the left nodes, right nodes and links of its cluster."""
    _, c, links = np.unique(cluster, return_inverse=True, return_counts=True)
    n, m = (_within(node, c, len(links))[1] for node in (left, right))
    return n[c], m[c], links[c]


def chosen_links(left: np.ndarray, right: np.ndarray, gain: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    """Marks the links of each cluster's one-to-one assignment with the largest sum of gains, all above 0. A node is in one cluster."""
    keep = np.zeros(len(left), bool)
    if not len(left):
        return keep
    names, c = np.unique(cluster, return_inverse=True)
    (row, n), (col, m) = _within(left, c, len(names)), _within(right, c, len(names))
    order = np.lexsort((gain, c))  # of equal links the largest counts, as it comes last
    ends = np.cumsum(np.bincount(c, minlength=len(names)))
    starts = np.r_[0, ends[:-1]]
    star = (n == 1) | (m == 1)
    keep[order[ends[star] - 1]] = True
    shapes, which = np.unique(np.c_[n, m][~star], axis=0, return_inverse=True)
    rest = np.flatnonzero(~star)
    for i, (a, b) in enumerate(shapes.tolist()):
        few, many = min(a, b), max(a, b)
        here = rest[which.ravel() == i]
        ways = np.array(list(itertools.permutations(range(many), few))) if math.perm(many, few) <= WAYS else None
        step = max(1, (1 << 21) // len(ways)) if ways is not None else 1
        for some in (here[j : j + step] for j in range(0, len(here), step)):
            size = ends[some] - starts[some]
            nth = np.repeat(np.arange(len(some)), size)
            link = order[np.repeat(starts[some] - np.cumsum(size) + size, size) + np.arange(size.sum())]
            x, y = (row[link], col[link]) if a <= b else (col[link], row[link])
            gains, at = np.zeros((len(some), few, many)), np.full((len(some), few, many), -1)
            gains[nth, x, y], at[nth, x, y] = gain[link], link
            if ways is not None:
                total = sum(gains[:, r, ways[:, r]] for r in range(few))
                taken = at[np.arange(len(some))[:, None], np.arange(few), ways[total.argmax(axis=1)]]
            else:
                pairs = maximum_assignment(gains[0])
                taken = at[0, pairs[:, 0], pairs[:, 1]]
            keep[taken[taken >= 0]] = True
    return keep
