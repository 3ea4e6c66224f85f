"""Recursive graph bisection: an order of documents in which those that share terms stand together.

Documents and terms form a bipartite graph. A range of documents is halved; documents then change sides in pairs as
long as that lowers the estimated cost of the terms' gaps, d * log2(n / (d + 1)) for a term in d of a side's n documents,
and both halves are halved in turn, down to ranges of `leaf` documents. All ranges of a level are treated in one numpy pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Exchanges tried at each level.
ROUNDS = 5


def halves(documents: int, leaf: int) -> Iterator[list[tuple[int, int, int]]]:
    """Level by level, the ranges (from, middle, to) that are halved; all cuts are multiples of leaf."""
    ranges = [(0, documents)]
    while True:
        cut = [(a, a + leaf * (-(-(b - a) // leaf) + 1 >> 1), b) for a, b in ranges if b - a > leaf]
        if not cut:
            return
        yield cut
        ranges = [r for a, m, b in cut for r in ((a, m), (m, b))]


def order(owner: np.ndarray, term: np.ndarray, documents: int, leaf: int, rounds: int = ROUNDS) -> np.ndarray:
    """The documents in their new order, from the pairs (owner, term) of the documents' distinct terms."""
    now = np.arange(documents)
    if documents <= leaf or not len(owner):
        return now
    degree = np.bincount(term)
    use = degree[term] > 1  # a term of one document costs the same on either side
    owner, term = owner[use], term[use]
    terms = int(term.max(initial=-1)) + 1
    log = np.log2(np.arange(1, documents + 2, dtype=np.float64))  # log[d] of d + 1
    place, part, side = np.empty(documents, np.int64), np.empty(documents, np.int64), np.empty(documents, bool)
    for cut in halves(documents, leaf):
        part[:], side[:] = -1, False
        for k, (a, m, b) in enumerate(cut):
            part[a:b] = k
            side[m:b] = True
        size = np.log2(np.array([[m - a, b - m] for a, m, b in cut], np.float64))
        place[now] = np.arange(documents)
        inside = part[place[owner]]
        mine = np.flatnonzero(inside >= 0)
        mine_owner = owner[mine]
        keys, of = np.unique(inside[mine] * terms + term[mine], return_inverse=True)
        total, (left_log, right_log) = np.bincount(of, minlength=len(keys)), size[keys // terms].T
        for _ in range(rounds):
            place[now] = np.arange(documents)
            right = side[place[mine_owner]]
            dr = np.bincount(of, weights=right, minlength=len(keys)).astype(np.int64)
            dl = total - dr
            cost = dl * (left_log - log[dl]) + dr * (right_log - log[dr])
            l1, r1 = np.maximum(dl - 1, 0), np.maximum(dr - 1, 0)
            out = cost - l1 * (left_log - log[l1]) - (dr + 1) * (right_log - log[np.minimum(dr + 1, documents)])
            back = cost - (dl + 1) * (left_log - log[np.minimum(dl + 1, documents)]) - r1 * (right_log - log[r1])
            gain = np.bincount(mine_owner, weights=np.where(right, back[of], out[of]), minlength=documents)
            moved = 0
            for a, m, b in cut:
                x, y = a + np.argsort(-gain[now[a:m]], kind="stable"), m + np.argsort(-gain[now[m:b]], kind="stable")
                both = min(len(x), len(y))
                k = int((gain[now[x[:both]]] + gain[now[y[:both]]] > 1e-9).sum())
                now[x[:k]], now[y[:k]] = now[y[:k]], now[x[:k]]
                moved += k
            if not moved:
                break
    return now


def tree(owner: np.ndarray, term: np.ndarray, documents: int, depth: int, terms: int) -> np.ndarray:
    """Weights (2**depth - 1 nodes, terms) by which other documents find their range among a bisected sample's.

    A document goes left at a node where the sum of its terms' weights is positive; node k's halves are 2k + 1 and 2k + 2.
    """
    weights = np.zeros(((1 << depth) - 1, terms), np.float32)
    leaf = max(1, -(-documents >> depth))
    place = np.empty(documents, np.int64)
    place[order(owner, term, documents, leaf)] = np.arange(documents)
    at = place[owner]
    nodes = {(0, documents): 0}
    for level, cut in enumerate(halves(documents, leaf)):
        if level == depth:
            break
        for a, m, b in cut:
            node = nodes[a, b]
            nodes[a, m], nodes[m, b] = 2 * node + 1, 2 * node + 2
            left = np.bincount(term[(at >= a) & (at < m)], minlength=terms)
            right = np.bincount(term[(at >= m) & (at < b)], minlength=terms)
            weights[node] = np.log((left + 1) / (m - a + 2)) - np.log((right + 1) / (b - m + 2))
    return weights


def leaves(owner: np.ndarray, term: np.ndarray, documents: int, weights: np.ndarray) -> np.ndarray:
    """The range of each document, 0 to 2**depth - 1, by tree()'s weights."""
    node = np.zeros(documents, np.int64)
    for _ in range(len(weights).bit_length()):
        score = np.bincount(owner, weights=weights[node[owner], term], minlength=documents)
        node = 2 * node + np.where(score > 0, 1, 2)
    return node - len(weights)
