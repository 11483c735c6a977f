"""Best monotone paths through posterior matrices."""

from __future__ import annotations

import numpy as np

from kinfold.operators.hmm import NONE, _cells


def best_trace(p: np.ndarray) -> tuple[str, float]:
    """Edit path of largest summed posterior and that sum; ties prefer B, then Y, then X.

    A row of the sums is the running maximum of its candidates, so rows are whole-array steps. Two
    rows of sums and a byte per cell for the way back are all that is held.
    """
    m, n = p.shape
    came = np.zeros((m, n), np.int8)
    above, row = np.zeros(n + 1), np.zeros(n + 1)
    for i in range(m):
        straight = above[:-1] + p[i]
        np.maximum(straight, above[1:], out=row[1:])
        np.maximum.accumulate(row, out=row)
        came[i] = np.where(row[1:] == straight, 0, np.where(row[1:] == row[:-1], 2, 1))
        above, row = row, above
    i, j, path = m, n, []
    while i and j:
        step = came[i - 1, j - 1]
        path.append("BXY"[step])
        i, j = i - (step != 2), j - (step != 1)
    return "Y" * j + "X" * i + "".join(reversed(path)), float(above[n])


def best_trace_with_gaps(p: np.ndarray, opening: float, longer: float) -> tuple[str, float]:
    """The same with costs for opening and lengthening gaps (both at most 0)."""
    m, n = p.shape
    v, came = np.full((3, m + 1, n + 1), NONE), np.zeros((3, m + 1, n + 1), np.int8)
    v[0, 0, 0] = 0
    for i, j in _cells(m, n, 0):
        a, b = i[(i > 0) & (j > 0)], j[(i > 0) & (j > 0)]
        if len(a):
            options = v[:, a - 1, b - 1]
            came[0, a, b], v[0, a, b] = options.argmax(axis=0), p[a - 1, b - 1] + options.max(axis=0)
        for k, here, (di, dj) in ((1, i > 0, (1, 0)), (2, j > 0, (0, 1))):
            a, b = i[here], j[here]
            options = v[:, a - di, b - dj] + np.array([longer if s == k else opening for s in range(3)])[:, None]
            came[k, a, b], v[k, a, b] = options.argmax(axis=0), options.max(axis=0)
    state, i, j, path, score = int(v[:, m, n].argmax()), m, n, [], float(v[:, m, n].max())
    while i or j:
        path.append("BXY"[state])
        before = int(came[state, i, j])
        i, j, state = i - (state != 2), j - (state != 1), before
    return "".join(reversed(path)), score


def with_gaps(residues: str, path: str, own: str) -> str:
    letters = iter(residues)
    return "".join(next(letters) if step in ("B", own) else "-" for step in path)


def distance(score: float, m: int, n: int) -> float:
    """One less the share of the shorter sequence that the trace expects to be right."""
    return 1 - score / min(m, n) if min(m, n) else 1.0
