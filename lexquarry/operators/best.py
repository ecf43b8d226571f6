"""The k best of each query that a task keeps while it reads."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


class Best:
    """The k rows at the least distance from each query so far: distance and place, ties by place.

    An empty entry has no distance and the last place, so that one whose distance is NaN comes before it.
    """

    EMPTY = np.iinfo(np.int64).max

    def __init__(self, n: int, k: int):
        self.k = k
        self.distance, self.place = np.full((n, k), np.nan), np.full((n, k), self.EMPTY)

    def maybe(self, near: np.ndarray, of: np.ndarray, room: np.ndarray, among: np.ndarray) -> np.ndarray:
        """Which of these rows (a column each) may be among the k best of the queries of these numbers (a row each): not known to be
        farther than the k-th so far by `room`, nor than the k-th of these by `among`."""
        worst = self.distance[of, -1] + room
        maybe = ~(near > worst[:, None]) & ~(np.isnan(near) & np.isfinite(worst)[:, None])
        if near.shape[1] > self.k and maybe.sum() > 4 * self.k * len(of):
            kth = np.partition(np.where(np.isnan(near), np.inf, near), self.k - 1, axis=1)[:, self.k - 1] + among
            maybe &= ~(near > np.where(np.isfinite(kth), kth, np.inf)[:, None])
        return maybe

    def add(self, of: np.ndarray, row: np.ndarray, place: np.ndarray, distance: np.ndarray) -> None:
        """Rows of these places at these distances from the queries of[row]."""
        if not len(row):
            return
        touched, row = np.unique(row, return_inverse=True)
        at = of[touched]
        rows = np.concatenate([np.repeat(np.arange(len(at)), self.k), row])
        distance, place = np.concatenate([self.distance[at].ravel(), distance]), np.concatenate([self.place[at].ravel(), place])
        order = np.lexsort((place, distance, rows))
        n = np.bincount(rows, minlength=len(at))
        kept = order[(np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)) < self.k]
        self.distance[at], self.place[at] = distance[kept].reshape(-1, self.k), place[kept].reshape(-1, self.k)

    def batches(self, query_ids: pa.Array, ids: pa.Array, name: str = "distance", sign: int = 1, step: int = 50_000):
        """query_id, id, and the distance under a name, of all that is held."""
        query, column = np.nonzero(self.place < self.EMPTY)
        for at in range(0, len(query), step):
            q, c = query[at : at + step], column[at : at + step]
            distance = sign * self.distance[q, c] + 0.0  # no zero with a sign
            yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(q)), ids.take(pa.array(self.place[q, c])), pa.array(distance, pa.float64())], ["query_id", "id", name])
