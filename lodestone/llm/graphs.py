"""A robust-pruned directed graph over vectors of length 1, and beam search in it, for many queries at a time.

Points enter in batches: a greedy search in the graph so far proposes each new point's neighbours, and
pruning keeps those that no kept, closer neighbour stands for (its distance to the candidate, times ``ALPHA``, being
no more than the point's own). Edges are then added backwards under the same pruning.
"""

from __future__ import annotations

import numpy as np

DEGREE = 32
BEAM = 24
ALPHA = 1.2
#: Points that searches may start from, starts of one search, and nodes that it expands at a time.
PIVOTS = 512
STARTS = 8
AT_ONCE = 4
#: Points that enter at a time, and candidates that each takes from among them.
_BLOCK = 1024
TOGETHER = 8


def beam_search(points: np.ndarray, graph: np.ndarray, queries: np.ndarray, beam: int = BEAM, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` best points found for each query, best first, and their cosines; -1 where there are fewer.

    ``own``: the node that a query is, if it is in the graph; the search then starts there as well.
    """
    ids, sims = np.empty((len(queries), beam), np.int64), np.empty((len(queries), beam), np.float32)
    for a in range(0, len(queries), _BLOCK):
        ids[a : a + _BLOCK], sims[a : a + _BLOCK] = _search(points, graph, queries[a : a + _BLOCK], beam, None if own is None else own[a : a + _BLOCK])
    return ids, sims


def _search(points: np.ndarray, graph: np.ndarray, queries: np.ndarray, beam: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    m, n = len(queries), len(graph)
    pivots = min(PIVOTS, n)
    near = queries @ points[:pivots].T
    k = min(STARTS, pivots)
    start = np.argpartition(-near, k - 1, axis=1)[:, :k]
    if own is not None:
        known = (start == own[:, None]).any(1)
        start[~known, 0] = own[~known]
        near = np.take_along_axis(near, np.minimum(start, pivots - 1), 1)
        near[~known, 0] = 1.0
    else:
        near = np.take_along_axis(near, start, 1)
    ids = np.full((m, beam), -1, np.int64)
    sims = np.full((m, beam), -np.inf, np.float32)
    done = np.ones((m, beam), bool)
    ids[:, :k], sims[:, :k], done[:, :k] = start, near, False
    seen = np.zeros((m, n + 1), bool)
    seen[np.arange(m)[:, None], start] = True
    seen[:, n] = True  # the place of missing edges
    live = np.arange(m)
    width = min(AT_ONCE, beam)
    while len(live):
        open_ = np.where(done[live], -np.inf, sims[live])
        pick = np.argpartition(-open_, width - 1, axis=1)[:, :width]
        real = np.take_along_axis(open_, pick, 1) > -np.inf
        some = real.any(1)
        live, pick, real = live[some], pick[some], real[some]
        if not len(live):
            break
        done[live[:, None], pick] = True
        nodes = np.where(real, ids[live[:, None], pick], -1)
        around = np.where(nodes[:, :, None] >= 0, graph[nodes], n).reshape(len(live), -1)
        around = np.where(around < 0, n, around)
        around.sort(axis=1)
        fresh = ~seen[live[:, None], around]
        fresh[:, 1:] &= around[:, 1:] != around[:, :-1]
        seen[live[:, None], around] = True
        most = int(fresh.sum(1).max(initial=0))
        if not most:
            continue
        order = np.argsort(~fresh, axis=1, kind="stable")[:, :most]
        around, fresh = np.take_along_axis(around, order, 1), np.take_along_axis(fresh, order, 1)
        found = np.matmul(points[np.where(fresh, around, 0)], queries[live][:, :, None])[:, :, 0]
        found = np.where(fresh, found, -np.inf)
        every = np.concatenate([sims[live], found], axis=1)
        best = np.argpartition(-every, beam - 1, axis=1)[:, :beam]
        sims[live] = np.take_along_axis(every, best, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(fresh, around, -1)], axis=1), best, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], ~fresh], axis=1), best, 1)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def prune(points: np.ndarray, candidates: np.ndarray, sims: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """Of each row of candidates (-1: none) at most ``degree`` that lie in different directions, closest first."""
    order = np.argsort(-sims, axis=1, kind="stable")
    candidates, sims = np.take_along_axis(candidates, order, 1), np.take_along_axis(sims, order, 1)
    alive = (candidates >= 0) & (sims > -np.inf)
    own = points[np.where(alive, candidates, 0)]
    between = np.matmul(own, own.transpose(0, 2, 1))
    out = np.full((len(candidates), degree), -1, np.int64)
    rows = np.arange(len(candidates))
    limit = 1 - (1 - sims) / ALPHA**2  # squared distances are 2 - 2 cos
    for r in range(degree):
        has = alive.any(1)
        if not has.any():
            break
        j = alive.argmax(1)
        out[has, r] = candidates[rows[has], j[has]]
        alive &= between[rows, j] < limit
        alive[rows, j] = False
    return out


def build(points: np.ndarray, degree: int = DEGREE, beam: int = BEAM) -> np.ndarray:
    """The out-neighbours of each point (-1: none). Points should come in random order."""
    n = len(points)
    graph = np.full((n, degree), -1, np.int64)
    first = min(n, degree + 1)
    for i in range(first):
        graph[i, : first - 1] = [j for j in range(first) if j != i]
    at = first
    while at < n:
        upto = min(n, at * 2, at + _BLOCK)
        ids, sims = _search(points, graph[:at], points[at:upto], beam)
        # points that enter together cannot find each other in the graph: the closest of them are candidates as well
        beside = points[at:upto] @ points[at:upto].T
        np.fill_diagonal(beside, -np.inf)
        k = min(TOGETHER, upto - at - 1)
        if k > 0:
            near = np.argpartition(-beside, k - 1, axis=1)[:, :k]
            ids = np.concatenate([ids, near + at], axis=1)
            sims = np.concatenate([sims, np.take_along_axis(beside, near, 1)], axis=1)
        graph[at:upto] = prune(points, ids, sims, degree)
        _backwards(points, graph, np.arange(at, upto), degree)
        at = upto
    return graph


def _backwards(points: np.ndarray, graph: np.ndarray, new: np.ndarray, degree: int) -> None:
    """Add for each edge of the new points its reverse."""
    source, target = np.repeat(new, degree), graph[new].reshape(-1)
    on = target >= 0
    source, target = source[on], target[on]
    sims = np.einsum("ij,ij->i", points[source], points[target])
    order = np.lexsort((-sims, target))
    source, target, sims = source[order], target[order], sims[order]
    begins = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
    rank = np.arange(len(target)) - np.repeat(begins, np.diff(np.append(begins, len(target))))
    keep = rank < 2 * degree  # of more the closest; pruning would hardly keep others
    source, target, sims, rank = source[keep], target[keep], sims[keep], rank[keep]
    nodes = np.unique(target)
    row = np.searchsorted(nodes, target)
    for a in range(0, len(nodes), _BLOCK):
        own = nodes[a : a + _BLOCK]
        mine = (row >= a) & (row < a + _BLOCK)
        added = np.full((len(own), 2 * degree), -1, np.int64)
        added_sims = np.full((len(own), 2 * degree), -np.inf, np.float32)
        added[row[mine] - a, rank[mine]], added_sims[row[mine] - a, rank[mine]] = source[mine], sims[mine]
        old = graph[own]
        old_sims = np.where(old >= 0, np.matmul(points[old], points[own][:, :, None])[:, :, 0], -np.inf)
        both, both_sims = np.concatenate([old, added], axis=1), np.concatenate([old_sims, added_sims], axis=1)
        width = int((both >= 0).sum(1).max())
        order = np.argsort(-both_sims, axis=1, kind="stable")[:, :width]
        both, both_sims = np.take_along_axis(both, order, 1), np.take_along_axis(both_sims, order, 1)
        full = (both >= 0).sum(1) > degree
        graph[own[~full]] = np.pad(both[~full], ((0, 0), (0, max(0, degree - width))), constant_values=-1)[:, :degree]
        if full.any():
            graph[own[full]] = prune(points, both[full], both_sims[full], degree)
