"""The best points of many queries among the cells that each of them asks for, by comparing all points of these cells.

All queries that ask for a cell are compared with it in one matrix product, so a cell is read once. What is no better than
the worst of a query's best so far is dropped by one comparison; the cell nearest to each query comes first, for that bound.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Queries and points that are compared at a time, and similarities to centroids that are held at a time.
ROWS, POINTS, ROUTED = 1024, 2048, 2_000_000


def nearest_cells(queries: np.ndarray, centroids: np.ndarray, asked: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, cell``: which cells each query asks for, in any order; the nearest cell of each is the third and not among them."""
    asked, step = min(asked, len(centroids)), max(16, ROUTED // len(centroids))
    small = np.uint16 if len(centroids) <= 1 << 16 else np.int32
    rows, cells, first = [np.zeros(0, np.int32)], [np.zeros(0, small)], [np.zeros(0, small)]
    for a in range(0, len(queries), step):
        near = queries[a : a + step] @ centroids.T
        best = near.argmax(1)
        # of equal centroids all are asked for
        least = np.partition(near, near.shape[1] - asked, axis=1)[:, near.shape[1] - asked]
        on = near >= least[:, None]
        on[np.arange(len(on)), best] = False
        row, cell = np.divmod(np.flatnonzero(on), on.shape[1])
        rows.append((row + a).astype(np.int32))
        cells.append(cell.astype(small))
        first.append(best.astype(small))
    return np.concatenate(rows), np.concatenate(cells), np.concatenate(first)


def _by_cell(rows: np.ndarray, cells: np.ndarray, count: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each cell with its rows, cells of many rows first."""
    order = np.argsort(cells, kind="stable")
    sizes = np.bincount(cells, minlength=count)
    ends = np.cumsum(sizes)
    for c in np.argsort(-sizes, kind="stable").tolist():
        if not sizes[c]:
            return
        yield c, rows[order[ends[c] - sizes[c] : ends[c]]]


class Best:
    """The ``keep`` best points of each query, kept by similarity and then key."""

    def __init__(self, queries: np.ndarray, keep: int) -> None:
        self.queries, self.keep = queries, keep
        self.sims = np.full((len(queries), keep), -np.inf, np.float32)
        self.keys = np.zeros((len(queries), keep), np.int64)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def offer(self, rows: np.ndarray, vectors: np.ndarray, keys: np.ndarray) -> None:
        for b in range(0, len(keys), POINTS):
            points, names = vectors[b : b + POINTS].T, keys[b : b + POINTS]
            for a in range(0, len(rows), ROWS):
                own = rows[a : a + ROWS]
                sims = self.queries[own] @ points
                least = self.sims[own, -1]
                if len(names) > self.keep and np.isneginf(least).any():  # no bound yet: one from this cell
                    least = np.maximum(least, np.partition(sims, len(names) - self.keep, axis=1)[:, len(names) - self.keep])
                hit = np.flatnonzero(sims >= least[:, None])
                if len(hit):
                    row, at = np.divmod(hit, len(names))
                    self.found.append((own[row], sims.reshape(-1)[hit], names[at]))
                    self.waiting += len(hit)
            if self.waiting > 4 * self.sims.size:
                self.settle()

    def settle(self) -> None:
        if not self.found:
            return
        held = np.flatnonzero(self.sims > -np.inf)
        rows = np.concatenate([held // self.keep, *(f[0] for f in self.found)])
        sims = np.concatenate([self.sims.reshape(-1)[held], *(f[1] for f in self.found)])
        keys = np.concatenate([self.keys.reshape(-1)[held], *(f[2] for f in self.found)])
        self.found, self.waiting = [], 0
        order = np.lexsort((keys, -sims, rows))
        rows, sims, keys = rows[order], sims[order], keys[order]
        begins = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        place = np.arange(len(rows)) - np.repeat(begins, np.diff(np.append(begins, len(rows))))
        on = place < self.keep
        self.sims[rows[on], place[on]], self.keys[rows[on], place[on]] = sims[on], keys[on]


def best_in_cells(queries: np.ndarray, centroids: np.ndarray, asked: int, read: Callable[[int], Iterator[tuple[np.ndarray, np.ndarray]]], keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Similarities and keys of the ``keep`` best points of each query in its ``asked`` nearest cells, best first; -inf where there are fewer.

    ``read`` gives the vectors and keys of a cell in pieces. No point may be in two of them.
    """
    best = Best(queries, keep)
    rows, cells, first = nearest_cells(queries, centroids, asked)
    for at, wanted in ((np.arange(len(queries), dtype=np.int32), first), (rows, cells)):
        for cell, own in _by_cell(at, wanted, len(centroids)):
            for vectors, keys in read(cell):
                best.offer(own, vectors, keys)
        best.settle()
    return best.sims, best.keys
