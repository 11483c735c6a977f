"""Progressive alignment and randomised refinement of one family, on sparse posteriors.

An alignment is a byte matrix with a row for each sequence. The stored cells of all pairs stand in
flat arrays, so the profile of two groups is one weighted count over them, whatever their sizes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from kinfold.operators.trace import best_trace

#: (a, b) with a < b -> places in a, places in b (both from 1), posteriors.
Posteriors = dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]
ROUNDS, FEW_ROUNDS, LARGE, MEDIUM = 100, 10, 150, 25


def glibc_rand() -> Iterator[int]:
    """The additive-feedback generator of the C library, at its default seed 1."""
    r = [1]
    for _ in range(30):
        r.append(16807 * r[-1] % 2147483647)
    r += r[:3]
    for i in range(34, 344):
        r.append((r[i - 3] + r[i - 31]) % 2**32)
    while True:
        r.append((r[-3] + r[-31]) % 2**32)
        yield r[-1] >> 1
        if len(r) > 4096:
            r = r[-40:]


GAP = ord("-")


@dataclass
class Rows:
    """Labels and their aligned letters, in the order of the matrix."""

    labels: list[int]
    letters: np.ndarray

    @classmethod
    def of(cls, rows: dict[int, str]) -> Rows:
        texts = list(rows.values())
        width = len(texts[0]) if texts else 0
        return cls(list(rows), np.frombuffer("".join(texts).encode("latin-1"), np.uint8).reshape(len(texts), width))

    def texts(self) -> dict[int, str]:
        return {s: row.tobytes().decode("latin-1") for s, row in zip(self.labels, self.letters, strict=True)}

    def part(self, chosen: np.ndarray) -> Rows:
        return Rows([s for s, c in zip(self.labels, chosen, strict=True) if c], self.letters[chosen])

    def projected(self) -> Rows:
        """Without the columns that are gaps in all rows."""
        return Rows(self.labels, self.letters[:, (self.letters != GAP).any(axis=0)])


class Cells:
    """Stored cells of all pairs of a family: flat arrays of both labels, both places (from 0) and the posterior."""

    def __init__(self, posteriors: Posteriors):
        keys = [k for k, v in posteriors.items() if len(v[2])]
        sizes = [len(posteriors[k][2]) for k in keys]
        self.a, self.b = (np.repeat([k[x] for k in keys], sizes).astype(np.int64) for x in (0, 1))
        self.i, self.j = (np.concatenate([np.asarray(posteriors[k][x]) for k in keys]).astype(np.int64) - 1 if keys else np.zeros(0, np.int64) for x in (0, 1))
        self.p = np.concatenate([np.asarray(posteriors[k][2], float) for k in keys]) if keys else np.zeros(0)

    def profile(self, one: Rows, two: Rows, weights: list[int] | None = None) -> np.ndarray:
        """Summed posteriors of the columns of two alignments; with weights a pair counts its product, of all such products."""
        top = max([*one.labels, *two.labels], default=-1) + 1
        side, begins = np.zeros(top, np.int8), np.zeros(top, np.int64)
        columns, size = [], 0
        for k, rows in ((1, one), (2, two)):
            counts = (rows.letters != GAP).sum(axis=1)
            side[rows.labels] = k
            begins[rows.labels] = size + np.cumsum(counts) - counts
            columns.append(np.nonzero(rows.letters != GAP)[1])
            size += int(counts.sum())
        column = np.concatenate(columns)
        known = (self.a < top) & (self.b < top)
        a, b, i, j, p = self.a[known], self.b[known], self.i[known], self.j[known], self.p[known]
        cross = side[a] * side[b] == 2
        a, b, i, j, p = a[cross], b[cross], i[cross], j[cross], p[cross]
        at_a, at_b = column[begins[a] + i], column[begins[b] + j]
        first = side[a] == 1
        if weights is not None:
            w = np.asarray(weights, float)
            p = p * (w[a] * w[b] / (w[one.labels].sum() * w[two.labels].sum()))
        width = two.letters.shape[1]
        place = np.where(first, at_a, at_b) * width + np.where(first, at_b, at_a)
        return np.bincount(place, weights=p, minlength=one.letters.shape[1] * width).reshape(-1, width)


def spread(rows: Rows, path: np.ndarray, own: int) -> np.ndarray:
    """The letters of rows along an edit path, with gaps where it spends letters of the other side alone."""
    found = np.full((len(rows.labels), len(path)), GAP, np.uint8)
    found[:, (path == ord("B")) | (path == own)] = rows.letters
    return found


def join(one: Rows, two: Rows, p: np.ndarray) -> tuple[Rows, float]:
    text, score = best_trace(p)
    path = np.frombuffer(text.encode(), np.uint8)
    return Rows(one.labels + two.labels, np.concatenate([spread(one, path, ord("X")), spread(two, path, ord("Y"))])), score


def progressive(residues: list[str], merges: list[dict], cells: Posteriors, weights: list[int]) -> dict[int, str]:
    """Label -> aligned residues, merged in the order of the guide tree."""
    known = Cells(cells)
    held = {(k,): Rows.of({k: r}) for k, r in enumerate(residues)}
    for m in merges:
        one, two = held.pop(tuple(m["left_leaves"])), held.pop(tuple(m["right_leaves"]))
        held[tuple(m["left_leaves"] + m["right_leaves"])], _ = join(one, two, known.profile(one, two, weights))
    return next((r.texts() for r in held.values()), {})


def project(rows: dict[int, str]) -> dict[int, str]:
    """Rows without the columns that are gaps in all of them."""
    return Rows.of(rows).projected().texts()


def old_score(one: np.ndarray, two: np.ndarray, p: np.ndarray) -> float:
    """Score of the alignment that two groups of its rows come from, with p over their own columns; summed from left to right."""
    has_a, has_b = (one != GAP).any(axis=0), (two != GAP).any(axis=0)
    both = has_a & has_b
    values = p[(np.cumsum(has_a) - 1)[both], (np.cumsum(has_b) - 1)[both]]
    return float(np.cumsum(values)[-1]) if len(values) else 0.0


def realign(rows: Rows, chosen: np.ndarray, cells: Cells) -> tuple[Rows, int]:
    """The chosen rows and the others aligned anew, and 1 if the score is what it was, 0 if not, 2 if one side is empty.

    The chosen rows come first.
    """
    if chosen.all() or not chosen.any():
        return rows, 2
    one, two = rows.part(chosen), rows.part(~chosen)
    a, b = one.projected(), two.projected()
    p = cells.profile(a, b)
    found, score = join(a, b, p)
    return found, int(old_score(one.letters, two.letters, p) == score)


def refine_by_tree(rows: dict[int, str], leaves: list[int], cells: Posteriors) -> tuple[dict[int, str], int]:
    """The leaves of a subtree realigned against all others."""
    given = Rows.of(rows)
    found, flag = realign(given, np.isin(given.labels, leaves), Cells(cells))
    return found.texts(), flag


def refine(rows: dict[int, str], cells: Posteriors, s1: int) -> dict[int, str]:
    """Rounds of random splits. Middle-sized families get one more round for each without effect, within bounds."""
    n, draw, known, now = len(rows), glibc_rand(), Cells(cells), Rows.of(rows)
    rounds = FEW_ROUNDS if s1 == 2 or n >= LARGE else ROUNDS
    grows, idle, k = MEDIUM < n < LARGE and s1 < 2, 0, 0
    while k < rounds:
        now, flag = realign(now, np.array([next(draw) % 2 == 1 for _ in range(n)]), known)
        if grows:
            if flag and rounds < 4 * n:
                rounds += 1
            idle += flag == 1
            if idle > 2 * n and k > 100:
                break
        k += 1
    return now.texts()
