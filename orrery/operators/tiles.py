"""The nearest rows of many queries among the rows that a task reads, in tiles of bounded size.

A tile is a product of some queries with some rows. What a task holds is one Arrow batch, one tile, and the best of each
query of its block so far, so its memory does not depend on how many rows it reads. A product only narrows: the score of
what may be among the best is summed in the order of components, as the columns of functions/vectors do it, so equal
vectors tie wherever they stand, and ties go to the lower row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from orrery.functions import vectors as V

#: Scores held at once (4 MB in doubles), and pairs whose components are held at once.
TILE, PAIRS = 1 << 19, 1 << 13
#: Rows of a batch of answers.
ANSWERS = 1 << 16
NONE = np.iinfo(np.int64).max


def keys(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Of each query with each row, lower is nearer."""
    s = q @ x.T
    if V.higher_is_nearer(metric):
        return np.negative(s, out=s)
    s *= -2
    s += (q * q).sum(axis=1)[:, None]
    s += (x * x).sum(axis=1)[None, :]
    return s


def pair_keys(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Of each query with the row at its place, summed in the order of components."""
    p = q * x if V.higher_is_nearer(metric) else (q - x) ** 2
    s = np.cumsum(p, axis=1, out=p)[:, -1] if p.shape[1] else np.zeros(len(p))
    return -s if V.higher_is_nearer(metric) else s


def slack(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each query more than a product can differ from the sum in order."""
    far = lambda v: np.sqrt((v * v).sum(axis=1))
    return 1e-12 * (far(q) + far(x).max(initial=0.0)) ** 2


def plain(queries: int, rows: int) -> Iterator[tuple[np.ndarray, slice]]:
    """Tiles of all queries with all rows: places of queries, rows."""
    for left in range(0, rows, TILE):
        own = slice(left, min(rows, left + TILE))
        step = max(1, TILE // max(1, own.stop - own.start))
        for at in range(0, queries, step):
            yield np.arange(at, min(queries, at + step)), own


class Probed:
    """Tiles of the lists of a batch with the queries that probe them."""

    def __init__(self, near: np.ndarray):
        """near: lists of each query."""
        order = np.argsort(near, axis=None, kind="stable")
        self.lists, starts = np.unique(near.ravel()[order], return_index=True)
        self.queries = np.split(order // max(1, near.shape[1]), starts[1:]) if self.lists.size else []

    def tiles(self, lists: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        order = np.argsort(lists, kind="stable")
        found, starts = np.unique(lists[order], return_index=True)
        for c, rows in zip(found, np.split(order, starts[1:]), strict=True):
            at = int(np.searchsorted(self.lists, c))
            if at < self.lists.size and self.lists[at] == c:
                for places, own in plain(self.queries[at].size, rows.size):
                    yield self.queries[at][places], rows[own]


class Best:
    """The k nearest rows of each query so far."""

    def __init__(self, queries: int, k: int, metric: str, digits: int | None = None):
        self.metric, self.digits = metric, digits
        self.keys, self.rows = np.full((queries, k), np.inf), np.full((queries, k), NONE)

    def offer(self, at: np.ndarray, q: np.ndarray, rows: np.ndarray, x: np.ndarray, shown: np.ndarray | None = None) -> None:
        """at: places of the queries q; rows: numbers of the rows x; shown: which pairs count."""
        k = self.keys.shape[1]
        if not k or not rows.size:
            return
        tile, limit = keys(q, x, self.metric), self.keys[at, -1]
        if shown is not None:
            tile[~shown] = np.inf
        if rows.size > k and np.isinf(limit).any():
            limit = np.fmin(limit, np.partition(tile, k - 1, axis=1)[:, k - 1])
        limit = limit + slack(q, x) + (0 if self.digits is None else 10.0**-self.digits)
        i, j = np.nonzero((tile <= limit[:, None]) if shown is None else (tile <= limit[:, None]) & shown)
        for a in range(0, i.size, PAIRS):
            some, other = i[a : a + PAIRS], j[a : a + PAIRS]
            key = pair_keys(q[some], x[other], self.metric)
            self._add(at[some], key if self.digits is None else np.round(key, self.digits), rows[other])

    def _add(self, at: np.ndarray, key: np.ndarray, row: np.ndarray) -> None:
        last, last_row = self.keys[at, -1], self.rows[at, -1]
        better = np.flatnonzero((key < last) | ((key == last) & (row < last_row)))
        if not better.size:
            return
        k = self.keys.shape[1]
        of, place = np.unique(at[better], return_inverse=True)
        place = np.concatenate([np.repeat(np.arange(of.size), k), place])
        key, row = np.concatenate([self.keys[of].ravel(), key[better]]), np.concatenate([self.rows[of].ravel(), row[better]])
        order = np.lexsort((row, key, place))
        place = place[order]
        kept = order[np.arange(place.size) - np.searchsorted(place, place) < k]
        self.keys[of], self.rows[of] = key[kept].reshape(-1, k), row[kept].reshape(-1, k)

    def answers(self, ids: np.ndarray, tie: str, final=lambda s: s) -> Iterator[pa.RecordBatch]:
        """query_id, tie, score."""
        i, j = np.nonzero(self.rows != NONE)
        for a in range(0, i.size, ANSWERS):
            some, other = i[a : a + ANSWERS], j[a : a + ANSWERS]
            key = self.keys[some, other]
            score = final(-key if V.higher_is_nearer(self.metric) else key)
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(self.rows[some, other]), pa.array(score)], names=["query_id", tie, "score"])


#: Answers of queries held at once; what is beyond is given out after each batch.
MOST_HELD = 1 << 20


def search(batches, read, ids: np.ndarray, q: np.ndarray, k: int, metric: str, tie: str, near: np.ndarray | None = None, digits: int | None = None, final=lambda s: s) -> Iterator[pa.RecordBatch]:
    """query_id, tie, score: at least the k nearest of the rows that this task reads, for each query.

    read(batch): rows, their vectors, their lists (None without near). near: lists that each query probes.
    """
    if not ids.size or k <= 0:
        return
    probed = None if near is None else Probed(near)
    of = lambda n, lists: plain(ids.size, n) if probed is None else probed.tiles(lists)
    best = Best(ids.size, k, metric, digits) if ids.size * k <= MOST_HELD else None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows, x, lists = read(batch)
        if x.shape[1] != q.shape[1]:
            raise ValueError(f"rows have {x.shape[1]} dimensions, queries {q.shape[1]}")
        if best is not None:
            for at, own in of(rows.size, lists):
                best.offer(at, q[at], rows[own], x[own])
            continue
        most = min(k, rows.size)
        step = max(1, MOST_HELD // most)
        for a in range(0, ids.size, step):
            some = Best(min(step, ids.size - a), most, metric, digits)
            for at, own in of(rows.size, lists):
                at = at[(at >= a) & (at < a + step)]
                if at.size:
                    some.offer(at - a, q[at], rows[own], x[own])
            yield from some.answers(ids[a : a + step], tie, final)
    if best is not None:
        yield from best.answers(ids, tie, final)
