"""FM-index over the word ids of one shard: suffix order to a fixed depth, BWT, and interval extension on both sides.

Id 0 separates pieces; no pattern contains it. All intervals of one depth are kept as one number per suffix row (0: no pattern), so that
one array pass extends every pattern of a shard by one word.
"""

from __future__ import annotations

import numpy as np


class WordIndex:
    """``order[r]`` is the text place of row r, rows sorted by their first ``depth`` ids; ``bwt[r]`` is the id before it."""

    def __init__(self, ids: np.ndarray, depth: int) -> None:
        self.ids = np.concatenate([np.asarray(ids, np.int64), np.zeros(1, np.int64)])
        n = len(self.ids)
        rank, span, self.order = self.ids, 1, np.argsort(self.ids, kind="stable")
        while span < depth:  # doubling: rows sorted by 2 * span ids
            width = int(rank.max()) + 2
            key = rank * width
            key[: n - span] += rank[span:] + 1
            self.order = np.argsort(key, kind="stable")
            ranked = key[self.order]
            rank = np.empty(n, np.int64)
            rank[self.order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
            span *= 2
        self.depth = span
        self.row = np.empty(n, np.int64)
        self.row[self.order] = np.arange(n)
        self.first = self.ids[self.order]
        self.bwt = self.ids[self.order - 1]  # of the text's first place: the closing separator
        self._after = self.row[np.minimum(self.order + 1, n - 1)]  # row of the suffix one word on: inverse of the LF step

    def words(self) -> np.ndarray:
        """Intervals of the single words."""
        return self._number(self.first != 0, self.first)

    @staticmethod
    def _number(valid: np.ndarray, *keys: np.ndarray) -> np.ndarray:
        """Numbers from 1 for runs of valid rows with equal keys."""
        opens = valid.copy()
        same = valid[1:] & valid[:-1]
        for key in keys:
            same &= key[1:] == key[:-1]
        opens[1:] &= ~same
        return np.where(valid, np.cumsum(opens), 0)

    def extend_left(self, intervals: np.ndarray) -> np.ndarray:
        """Intervals of all patterns cP: row r starts with c, and the row one word on lies in the interval of P (the LF step of all of P's rows)."""
        inner = intervals[self._after]
        return self._number((self.first != 0) & (inner != 0), self.first, inner)

    def extend_right(self, intervals: np.ndarray, length: int) -> np.ndarray:
        """Intervals of all patterns Pc: each interval of patterns of ``length`` words parted by the word that follows."""
        after = self.order + length
        word = np.where(after < len(self.ids), self.ids[np.minimum(after, len(self.ids) - 1)], 0)
        return self._number((intervals != 0) & (word != 0), intervals, word)

    def patterns(self, intervals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text place, count) of every interval."""
        counts = np.bincount(intervals, minlength=1)[1:]
        opens = np.flatnonzero((intervals != 0) & np.concatenate([[True], intervals[1:] != intervals[:-1]]))
        return self.order[opens], counts
