"""The best rows of many queries, tile by tile: rough scores rule out, exact ones rank.

A tile's scores come as a 32-bit product. Only pairs whose rough score, less its rounding error, can reach the
k-th best score a query has so far are scored exactly and ranked; on most tiles these are next to none. The
result is that of exact scores alone.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa

DIGITS = 6
SLACK = 1e-6  # more than rounding to DIGITS moves a score


def margin_of(width: int) -> float:
    """More than a 32-bit product of two unit vectors can be off."""
    return 2 * (width + 8) * float(np.finfo("float32").eps)


def best_columns(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k best scores of each row, ties to the lowest id."""
    order = np.argsort(ids, kind="stable")
    scores, every = scores[:, order], np.arange(len(scores))
    rows, columns = [], []
    for _ in range(min(k, len(ids))):
        spot = scores.argmax(axis=1)  # the first maximum, hence the lowest id
        rows.append(every)
        columns.append(order[spot])
        scores[every, spot] = -np.inf
    return np.concatenate(rows), np.concatenate(columns)


class Best:
    """The k best rows of every query among those offered; ties go to the lowest id.

    ``least`` holds scores that are known to be reached by k rows, offered or not: what is below is left out.
    """

    def __init__(self, query_ids: np.ndarray, k: int, exclude_self: bool, least: np.ndarray | None = None):
        self.query_ids, self.k = query_ids, k
        self.index = pd.Index(query_ids) if exclude_self else None
        self.floor = np.full(len(query_ids), -np.inf) if least is None else least.astype("float64")
        self.scores = np.full((len(query_ids), k), -np.inf)
        self.ids: np.ndarray | None = None

    def offer(
        self,
        places: np.ndarray,
        ids: np.ndarray,
        rough: np.ndarray,
        margin: float,
        exact: Callable[[np.ndarray, np.ndarray], np.ndarray],
        whole: Callable[[], np.ndarray],
    ) -> None:
        """A tile: the queries at ``places`` by the rows ``ids``. ``rough`` is written to.

        ``exact`` scores some pairs of the tile, ``whole`` all of them.
        """
        if not rough.size:
            return
        own = self._own(places, ids)
        if own is not None:
            rough[own] = -np.inf
        wide = margin + SLACK
        floor = self.floor[places]
        near = rough >= (floor - wide).astype("float32")[:, None]
        many = np.flatnonzero(np.count_nonzero(near, axis=1) > 4 * self.k)
        if len(many):
            # the tile's own k-th score rules out more than those known so far
            some = rough[many]
            own_kth = some.max(axis=1) if self.k == 1 else np.partition(some, -self.k, axis=1)[:, -self.k]
            floor[many] = np.maximum(floor[many], own_kth.astype("float64") - wide)
            near[many] = some >= (floor[many] - wide).astype("float32")[:, None]
        if np.count_nonzero(near) > max(near.size // 8, 4 * self.k * len(places)):
            scores = np.round(whole(), DIGITS) + 0.0
            if own is not None:
                scores[own] = -np.inf
            rows, columns = best_columns(ids, scores.copy(), self.k)
            found = scores[rows, columns]
        else:
            rows, columns = np.divmod(np.flatnonzero(near), len(ids))
            if own is not None:
                others = ~np.isneginf(rough[rows, columns])
                rows, columns = rows[others], columns[others]
            found = np.round(exact(rows, columns), DIGITS) + 0.0
        self._merge(places[rows], found, ids[columns])

    def _own(self, places: np.ndarray, ids: np.ndarray):
        if self.index is None:
            return None
        at = self.index.get_indexer(ids)
        row = np.full(len(self.query_ids) + 1, -1)
        row[places] = np.arange(len(places))
        row = row[at]  # the last place, for ids that are no query, holds -1
        return row[row >= 0], np.flatnonzero(row >= 0)

    def _merge(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        kept = (scores >= self.floor[queries]) & (scores > -np.inf)
        if not kept.any():
            return
        queries, scores, ids = queries[kept], scores[kept], ids[kept]
        if self.ids is None:
            self.ids = np.empty(self.scores.shape, dtype=ids.dtype)
        touched, at = np.unique(queries, return_inverse=True)
        old, held = self.scores[touched], self.ids[touched]
        there = old > -np.inf
        at = np.concatenate((at, np.nonzero(there)[0]))
        scores, ids = np.concatenate((scores, old[there])), np.concatenate((ids, held[there]))
        order = np.argsort(ids, kind="stable")
        order = order[np.argsort(-scores[order], kind="stable")]
        order = order[np.argsort(at[order], kind="stable")]
        at = at[order]
        turn = np.arange(len(at)) - np.searchsorted(at, at)
        order, at, turn = order[turn < self.k], at[turn < self.k], turn[turn < self.k]
        self.scores[touched] = -np.inf
        self.scores[touched[at], turn] = scores[order]
        self.ids[touched[at], turn] = ids[order]
        self.floor[touched] = np.maximum(self.floor[touched], self.scores[touched, self.k - 1])

    def found(self) -> pd.DataFrame:
        """``query_id, id, similarity``, at most k rows for a query."""
        rows, columns = np.nonzero(self.scores > -np.inf)
        ids = np.array([], dtype="object") if self.ids is None else self.ids[rows, columns]
        return pd.DataFrame(
            {"query_id": self.query_ids[rows], "id": ids, "similarity": self.scores[rows, columns]}
        )

    def table(self, schema: pa.Schema) -> pa.Table:
        return pa.Table.from_pandas(self.found(), schema=schema, preserve_index=False)
