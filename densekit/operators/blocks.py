"""Scoring blocks of queries against blocks of documents inside tasks (numpy on Arrow batches).

Only these small helpers see numpy; which rows meet in which task is decided by Spark.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from densekit.functions.vectors import SCORE_PLACES

TILE_CELLS = 8_000_000  # scores held at a time by one task
OUT_ROWS = 65_536  # rows per batch handed back to Spark
METRICS = ("ip", "l2")


def check_metric(metric: str) -> str:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}, expected one of {METRICS}")
    return metric


def matrix(column) -> np.ndarray:
    """An Arrow list column of equally long vectors as a float64 matrix.

    Vectors that are null, differ in length, or hold null or NaN raise: they have no place in an order.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError(f"vectors of {sizes[0]} and {sizes[sizes != sizes[0]][0]} elements in one table (-1: null)")
    if np.isnan(flat).any():
        raise ValueError("a vector holds NaN or null")
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def numbers(column) -> np.ndarray:
    return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)


def round_half_up(x: np.ndarray) -> np.ndarray:
    """Round half away from zero, as SQL does, and never to minus zero."""
    scale = 10.0**SCORE_PLACES
    return np.copysign(np.floor(np.abs(x) * scale + 0.5), x) / scale + 0.0


def raw_scores(q: np.ndarray, d: np.ndarray, metric: str) -> np.ndarray:
    """Score matrix, larger is better; for 'l2' minus the squared distance."""
    s = (2 * q if metric == "l2" else q) @ d.T
    if metric == "l2":
        s -= (q * q).sum(1)[:, None]
        s -= (d * d).sum(1)[None, :]
        np.minimum(s, 0, out=s)
    return s


def scores(q: np.ndarray, d: np.ndarray, metric: str) -> np.ndarray:
    return round_half_up(raw_scores(q, d, metric))


def _best_first(row: np.ndarray, score: np.ndarray, pid: np.ndarray) -> np.ndarray:
    """Order by row, then score descending, then pid.

    Row and score go into one integer where they fit, which sorts several times faster than three
    keys; only equal ones are then ordered by pid.
    """
    if not len(row):
        return np.empty(0, np.int64)
    units = np.rint(score * 10.0**SCORE_PLACES)
    span = units.max() - units.min() + 1
    if not (row.max() + 1) * span < 2.0**52:
        return np.lexsort((pid, -score, row))
    key = row * int(span) + (units.max() - units).astype(np.int64)
    order = np.argsort(key)
    equal = np.diff(key[order]) == 0
    tied = np.flatnonzero(np.append(equal, False) | np.insert(equal, 0, False))
    part = order[tied]
    order[tied] = part[np.lexsort((pid[part], key[part]))]
    return order


def _places(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of what is true, in any order; where little is, flat places are found many times faster than pairs of them."""
    if hit.flags.f_contiguous:
        j, i = np.divmod(np.flatnonzero(hit.T), max(1, hit.shape[0]))
    else:
        i, j = np.divmod(np.flatnonzero(hit), max(1, hit.shape[1]))
    return i, j


class Best:
    """The k best (score, pid) of each of n query rows seen so far: score descending, then lower pid.

    Scores are compared rounded, but only arrivals that may enter a list are rounded at all; the
    others are dropped at once. Arrivals wait until they are as many as the lists themselves and
    are then sorted in.
    """

    def __init__(self, n: int, k: int):
        self.k = k
        self.floor = np.full(n, -np.inf)  # score of the k-th entry, once there is one
        self.row, self.pid, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.waiting: list[tuple] = []
        self.n_waiting = 0

    def add(self, rows: np.ndarray, pids: np.ndarray, s: np.ndarray) -> None:
        """Take in unrounded scores: s[i, j] belongs to query row rows[i] and document pids[j]."""
        low = self.floor[rows]
        fresh = np.isneginf(low)
        if s.shape[1] > self.k and fresh.any():
            low = low.copy()
            low[fresh] = np.partition(s[fresh], s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k]
        # rounding moves a score by half a unit of the last place at most, so this keeps all ties
        low = low - 10.0**-SCORE_PLACES - 1e-15 * np.abs(np.where(np.isinf(low), 0, low))
        i, j = _places(s >= low[:, None])
        score = round_half_up(s[i, j])
        row = rows[i]
        keep = score >= self.floor[row]
        self.waiting.append((row[keep], pids[j[keep]], score[keep]))
        self.n_waiting += int(keep.sum())
        if self.n_waiting >= max(len(self.row), len(self.floor) * self.k // 2, 1000):
            self.settle()

    def settle(self) -> None:
        row, pid, score = (
            np.concatenate(parts) for parts in zip((self.row, self.pid, self.score), *self.waiting)
        )
        order = _best_first(row, score, pid)
        row, pid, score = row[order], pid[order], score[order]
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        place = np.arange(len(row)) - np.repeat(starts, np.diff(starts, append=len(row)))
        keep, last = place < self.k, place == self.k - 1
        self.floor[row[last]] = score[last]
        self.row, self.pid, self.score = row[keep], pid[keep], score[keep]
        self.waiting, self.n_waiting = [], 0

    def add_tiled(self, rows, q, pids, d, metric: str) -> None:
        step = max(1, TILE_CELLS // max(1, len(rows)))
        for at in range(0, len(pids), step):
            part = d[at : at + step]
            self.add(rows, pids[at : at + step], raw_scores(q, part, metric))

    def batches(self, qids: np.ndarray):
        """The lists as Arrow batches of OUT_ROWS rows at most."""
        self.settle()
        for at in range(0, len(self.row), OUT_ROWS):
            part = slice(at, at + OUT_ROWS)
            columns = {"qid": qids[self.row[part]], "pid": self.pid[part], "score": self.score[part]}
            yield pa.RecordBatch.from_pydict(columns, schema=ARROW_SCORED)


ARROW_SCORED = pa.schema([("qid", pa.int64()), ("pid", pa.int64()), ("score", pa.float64())])
