"""Partition-function posteriors: Boltzmann weights of scores, affine gaps, free terminal gaps.

All sums are kept in log space, so long and similar sequences do not overflow.
"""

from __future__ import annotations

import numpy as np

from kinfold.functions.model import TEMPERATURE, ScoreMatrix
from kinfold.operators.hmm import NONE, _cells, add, add_rows


def _pass(s: np.ndarray, opening: float, longer: float) -> np.ndarray:
    """z[k, i, j] of match, gap in a, gap in b over prefixes; a gap at either end of a sequence is free."""
    m, n = s.shape
    z = np.full((3, m + 1, n + 1), NONE)
    z[0, 0, 0], z[1, 0, 1:], z[2, 1:, 0] = 0, 0, 0
    for i, j in _cells(m, n, 1):
        z[0, i, j] = s[i - 1, j - 1] + add_rows(z[:, i - 1, j - 1])
        free = i == m
        z[1, i, j] = add(z[0, i, j - 1] + np.where(free, 0, opening), z[1, i, j - 1] + np.where(free, 0, longer))
        free = j == n
        z[2, i, j] = add(z[0, i - 1, j] + np.where(free, 0, opening), z[2, i - 1, j] + np.where(free, 0, longer))
    return z


def partition_posterior(a: str, b: str, matrix: ScoreMatrix, gap_open: float = -22.0, gap_extend: float = -1.0, temperature: float = TEMPERATURE) -> np.ndarray:
    """P(letter i of a is aligned with letter j of b), m by n."""
    if not a or not b:
        return np.zeros((len(a), len(b)))
    s = matrix.table(a, b) / temperature
    opening, longer = gap_open / temperature, gap_extend / temperature
    forward = _pass(s, opening, longer)
    reverse = _pass(s[::-1, ::-1], opening, longer)[:, ::-1, ::-1]
    whole = np.logaddexp.reduce(forward[:, -1, -1])
    return np.exp(np.minimum(0, forward[0, 1:, 1:] + reverse[0, :-1, :-1] - s - whole))


def partition_viterbi(a: str, b: str, matrix: ScoreMatrix, gap_open: float = -22.0, gap_extend: float = -1.0) -> tuple[str, float]:
    """The best single alignment under the same scores: edit path and score."""
    m, n = len(a), len(b)
    s = matrix.table(a, b)
    z, came = np.full((3, m + 1, n + 1), NONE), np.zeros((3, m + 1, n + 1), np.int8)
    z[0, 0, 0], z[1, 0, 1:], z[2, 1:, 0] = 0, 0, 0
    came[1, 0, 2:], came[2, 2:, 0] = 1, 2
    for i, j in _cells(m, n, 1):
        options = z[:, i - 1, j - 1]
        came[0, i, j], z[0, i, j] = options.argmax(axis=0), s[i - 1, j - 1] + options.max(axis=0)
        for k, (p, q), free in ((1, (i, j - 1), i == m), (2, (i - 1, j), j == n)):
            opened, longer = z[0, p, q] + np.where(free, 0, gap_open), z[k, p, q] + np.where(free, 0, gap_extend)
            came[k, i, j], z[k, i, j] = np.where(opened >= longer, 0, k), np.maximum(opened, longer)
    state, i, j, path = int(z[:, m, n].argmax()), m, n, []
    score = float(z[:, m, n].max())
    while i or j:
        path.append("BYX"[state])
        before = int(came[state, i, j])
        i, j, state = i - (state != 1), j - (state != 2), before
    return "".join(reversed(path)), score
