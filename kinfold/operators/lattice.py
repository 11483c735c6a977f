"""Posteriors of many pairs at once, in bounded memory and without logarithms.

A batch of pairs is swept anti-diagonal by anti-diagonal. Each lane, a row of a pair's lattice, keeps
its values as numbers times a power of two that is set anew every few diagonals, so neither long nor
very similar sequences leave the range of a double, and a step is a handful of products over whole
slices. What ends in a cell comes from the same sweep over the reversed sequences with transposed
transitions. The forward sweep keeps checkpoints; the diagonals between two of them are swept again
when the reversed sweep meets them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from numpy.lib.stride_tricks import as_strided

from kinfold.functions.model import TEMPERATURE, UNKNOWN_PAIR, UNKNOWN_SINGLE, PairModel, ScoreMatrix

#: Diagonals between two settings of the lanes' powers of two.
RESCALE = 16
#: Cells of a batch, bounded by padding to its longest pair; a longer pair goes alone.
BATCH_CELLS = 1 << 20
#: Bytes of forward values between two checkpoints; a block has at least as many diagonals as there are checkpoints.
BLOCK_BYTES = 16 << 20
_FAR = 1000


@dataclass(frozen=True)
class Moves:
    """A pair model: state 0 spends a letter of both, then states that spend one of x and of y take turns.

    trans has probabilities, or weights, from row to column; both, ex and ey emissions by the codes of
    letters, the last of which pads and has none. start and end weigh the states at the corners. free:
    gaps before the first and after the last letter cost nothing. anywhere: a path may begin and end
    in any cell of state 0.
    """

    trans: np.ndarray
    both: np.ndarray
    ex: np.ndarray
    ey: np.ndarray
    start: np.ndarray
    end: np.ndarray
    free: bool = False
    anywhere: bool = False

    def back(self) -> Moves:
        """For reversed sequences. With free ends, gaps are paid where they begin, from either side."""
        return self if self.free else Moves(self.trans.T, self.both, self.ex, self.ey, self.end, self.start, self.free, self.anywhere)


def _codes(rows: list[np.ndarray], pad: int, front: bool) -> np.ndarray:
    """Codes of sequences of unequal length from index 1 on, padded to the longest; index 0 is a pad."""
    size = max(map(len, rows))
    found = np.full((len(rows), size + 1), pad, np.intp)
    for k, r in enumerate(rows):
        found[k, size - len(r) + 1 if front else 1 :][: len(r)] = r
    return found


class Sweep:
    """One direction. Arrays are [state, pair, lane]; lane i + 1 holds row i, lane 0 nothing."""

    def __init__(self, moves: Moves, x: np.ndarray, y: np.ndarray, sizes: np.ndarray, front: bool):
        self.moves, self.x, self.y = moves, x, y
        self.pairs, self.rows, self.columns = len(x), x.shape[1] - 1, y.shape[1] - 1
        # the corner where each pair begins, in the padded frame, and where it ends
        self.at = np.array([[self.rows, self.columns]]) - sizes if front else np.zeros_like(sizes)
        self.to = self.at + sizes
        self.base = x * moves.both.shape[1]
        self.both = moves.both.ravel()
        self.ey = moves.ey[y]
        self.own = np.zeros((self.pairs, self.rows + 2))
        self.own[:, 1:] = moves.ex[x]
        self.d = -1
        states = len(moves.trans)
        self.p1, self.p2, self.spare = (np.zeros((states, self.pairs, self.rows + 2)) for _ in range(3))
        self.power = np.zeros((self.pairs, self.rows + 2), np.int64)
        if moves.free:
            lanes = np.arange(-1, self.rows + 1)
            self.edge = (lanes == self.at[:, :1]) | (lanes == self.to[:, :1])
        self._scaled()

    def _scaled(self) -> None:
        shift = np.clip(self.power[:, :-1] - self.power[:, 1:], -_FAR, _FAR)
        self.ratio = np.ones(self.power.shape)
        self.ratio[:, 1:] = np.exp2(shift)
        self.ratio_own = self.ratio * self.own
        if self.moves.anywhere:
            self.fresh = np.exp2(np.clip(-self.power, -_FAR, _FAR))

    def rescale(self) -> None:
        most = np.maximum(self.p1.max(axis=0), self.p2.max(axis=0))
        shift = np.where(most > 0, np.frexp(most)[1], 0)
        scale = np.exp2(-shift)
        self.p1 *= scale
        self.p2 *= scale
        self.power = self.power + shift
        # a lane without values takes the power of the one before it, from which it will be entered
        lanes = np.maximum.accumulate(np.where(most > 0, np.arange(most.shape[1]), 0), axis=1)
        self.power = np.take_along_axis(self.power, lanes, axis=1)
        self._scaled()

    def state(self) -> tuple:
        return self.d, self.p1.copy(), self.p2.copy(), self.power

    def restore(self, state: tuple) -> None:
        self.d, p1, p2, self.power = state
        self.p1[:], self.p2[:], self.spare[:] = p1, p2, 0  # lanes not yet entered are empty
        self._scaled()

    def step(self) -> None:
        """The next diagonal, into p1."""
        if self.d % RESCALE == RESCALE - 1:
            self.rescale()
        self.d = d = self.d + 1
        m, t, p1, p2, new = self.moves, self.moves.trans, self.p1, self.p2, self.spare
        lo, hi = max(0, d - self.columns), min(self.rows, d)
        here, above = slice(lo + 1, hi + 2), slice(lo, hi + 1)
        y = slice(d - hi, d - lo + 1)
        both = self.both[self.base[:, lo : hi + 1] + self.y[:, y][:, ::-1]]
        ratio = self.ratio[:, here]
        first = p2[0, :, above] * t[0, 0]
        for s in range(1, len(t)):
            first += p2[s, :, above] * t[s, 0]
        first *= ratio
        if m.anywhere:
            first += self.fresh[:, here]
        new[0, :, here] = first * both
        ey, up = self.ey[:, y][:, ::-1], self.ratio_own[:, here]
        for s in range(1, len(t), 2):
            new[s, :, here] = (p1[0, :, above] * t[0, s] + p1[s, :, above] * t[s, s]) * up
            if m.free:
                edge = self.edge[:, here]
                new[s + 1, :, here] = p1[0, :, here] * np.where(edge, 1, t[0, s + 1]) + p1[s + 1, :, here] * np.where(edge, 1, t[s + 1, s + 1])
            else:
                new[s + 1, :, here] = (p1[0, :, here] * t[0, s + 1] + p1[s + 1, :, here] * t[s + 1, s + 1]) * ey
        self.p1, self.p2, self.spare = new, p1, p2
        self._corners(new, p1, both, lo, hi)

    def _corners(self, new: np.ndarray, before: np.ndarray, both: np.ndarray, lo: int, hi: int) -> None:
        m, d = self.moves, self.d
        if m.free:
            for edge in (self.at, self.to):  # gaps in y beside its first and its last column
                lane = d - edge[:, 1]
                k = np.flatnonzero((lane >= max(1, lo)) & (lane <= hi))
                i = lane[k] + 1
                new[1, k, i] = (before[0, k, i - 1] + before[1, k, i - 1]) * self.ratio[k, i]
            k = np.flatnonzero(self.at.sum(axis=1) == d)
            new[0, k, self.at[k, 0] + 1] = np.exp2(-self.power[k, self.at[k, 0] + 1])
            return
        if m.anywhere:
            return
        begun = d - self.at.sum(axis=1)
        for k in np.flatnonzero((begun == 1) | (begun == 2)).tolist():
            i, j = self.at[k].tolist()
            if begun[k] == 2:
                if i < self.rows and j < self.columns:
                    new[0, k, i + 2] += m.start[0] * m.both[self.x[k, i + 1], self.y[k, j + 1]] * np.exp2(-float(self.power[k, i + 2]))
                continue
            for s in range(1, len(m.trans), 2):
                if i < self.rows:
                    new[s, k, i + 2] += m.start[s] * m.ex[self.x[k, i + 1]] * np.exp2(-float(self.power[k, i + 2]))
                if j < self.columns:
                    new[s + 1, k, i + 1] += m.start[s + 1] * m.ey[self.y[k, j + 1]] * np.exp2(-float(self.power[k, i + 1]))


class Backwards:
    """The diagonals of a forward sweep from the last to the first, out of checkpoints."""

    def __init__(self, forward: Sweep, states: slice, watch: Callable[[int], None]):
        """states: what is held of a diagonal; watch is called for each diagonal of the first pass."""
        self.forward, self.states = forward, states
        self.last = forward.rows + forward.columns
        size = 8 * forward.pairs * (forward.rows + 2) * len(range(*states.indices(len(forward.moves.trans))))
        length = max(int(np.sqrt(self.last)) + 1, BLOCK_BYTES // size)
        self.length = -(-length // RESCALE) * RESCALE
        self.saved: list[tuple] = []
        for d in range(self.last + 1):
            if d % self.length == 0:
                self.saved.append(forward.state())
                self.marks: list[tuple] = []
            self._advance()
            watch(d)

    def _advance(self) -> None:
        self.forward.step()
        self.marks.append((self.forward.p1[self.states].copy(), self.forward.power))

    def __getitem__(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        """Values and powers of diagonal d; asked for in falling order, but for two that were had before."""
        at, p1, p2, power = self.saved[-1]
        if d > at:
            return self.marks[d - at - 1]
        if d >= at - 1:
            return (p1 if d == at else p2)[self.states], power
        self.saved.pop()
        self.forward.restore(self.saved[-1])
        self.marks = []
        for _ in range(self.length):
            self._advance()
        return self[d]


def _directions(pairs: list[tuple[np.ndarray, np.ndarray]], moves: Moves, pad: int) -> tuple[Sweep, Sweep, np.ndarray]:
    sizes = np.array([[len(x), len(y)] for x, y in pairs])
    forward = Sweep(moves, _codes([x for x, _ in pairs], pad, False), _codes([y for _, y in pairs], pad, False), sizes, False)
    reverse = Sweep(moves.back(), _codes([x[::-1] for x, _ in pairs], pad, True), _codes([y[::-1] for _, y in pairs], pad, True), sizes, True)
    return forward, reverse, sizes


def _totals(forward: Sweep, sizes: np.ndarray, totals: np.ndarray) -> Callable[[int], None]:
    """Fills totals, the logs to base 2 of the pairs' weights, while the forward sweep goes on."""
    ends, moves = sizes.sum(axis=1), forward.moves

    def watch(d: int) -> None:
        if moves.anywhere:
            lo, hi = max(1, d - forward.columns), min(forward.rows, d)
            if lo <= hi:
                with np.errstate(divide="ignore"):
                    logs = np.log2(forward.p1[0, :, lo + 1 : hi + 2]) + forward.power[:, lo + 1 : hi + 2]
                totals[:] = np.logaddexp2(totals, np.logaddexp2.reduce(logs, axis=1))
            return
        for k in np.flatnonzero(ends == d).tolist():
            lane = sizes[k, 0] + 1
            totals[k] = np.log2(forward.p1[:, k, lane] @ moves.end) + forward.power[k, lane]

    return watch


def posteriors(pairs: list[tuple[np.ndarray, np.ndarray]], moves: Moves, pad: int, add: Callable[[np.ndarray], np.ndarray], out: np.ndarray) -> None:
    """Add to out[pair, diagonal, row] what add makes of the probabilities that state 0 stands in a cell.

    pairs are codes of two sequences that aren't empty; pad is the code of nothing. Rows and diagonals
    count from 0 at the corner before the first letters.
    """
    forward, reverse, sizes = _directions(pairs, moves, pad)
    totals = np.full(len(pairs), -np.inf)
    held = Backwards(forward, slice(0, 1), _totals(forward, sizes, totals))
    rows, last = forward.rows, held.last
    inverse = np.where(moves.both > 0, 1 / np.where(moves.both > 0, moves.both, 1), 0).ravel()
    whole = np.floor(totals)
    part = np.exp2(totals - whole)[:, None]
    seen: tuple = (None, None)
    reverse.step()
    for d in range(last, 1, -1):
        while reverse.d < last + 2 - d:
            reverse.step()
        values, power = held[d]
        if (power is not seen[0]) or (reverse.power is not seen[1]):
            seen = power, reverse.power
            # lane i + 1 of one sweep is the same row as lane rows + 2 - i of the other
            scale = np.zeros(power.shape)
            scale[:, 2:] = np.exp2(np.clip(power[:, 2:] + reverse.power[:, :1:-1] - whole[:, None], -1070, _FAR)) / part
        lo, hi = max(1, d - forward.columns), min(rows, d - 1)
        if lo > hi:
            continue
        here, there = slice(lo + 1, hi + 2), slice(rows + 2 - hi, rows + 3 - lo)
        both = inverse[forward.base[:, lo : hi + 1] + forward.y[:, d - hi : d - lo + 1][:, ::-1]]
        p = values[0, :, here] * reverse.p1[0, :, there][:, ::-1] * both * scale[:, here]
        out[:, d, lo : hi + 1] += add(np.minimum(p, 1))


@dataclass
class Counts:
    """Expected uses of a pair model's parameters in some pairs, and the logs of their probabilities."""

    init: np.ndarray  # pair, state: beginnings and ends
    moves: np.ndarray  # pair, from, to
    match: np.ndarray  # pair, letter of x, letter of y
    single: np.ndarray  # pair, letter
    logs: np.ndarray  # pair

    def vectors(self) -> np.ndarray:
        """A row for each pair: all numbers but the logs, one after the other."""
        n = len(self.logs)
        return np.concatenate([x.reshape(n, -1) for x in (self.init, self.moves, self.match, self.single)], axis=1)

    @staticmethod
    def of_vector(vector: np.ndarray, states: int, letters: int) -> tuple[np.ndarray, ...]:
        """init, moves, match, single of a vector or a sum of some."""
        cuts = np.cumsum([states, states * states, letters * letters])
        a, b, c, d = np.split(vector, cuts)
        return a, b.reshape(states, states), c.reshape(letters, letters), d


def expected(pairs: list[tuple[np.ndarray, np.ndarray]], moves: Moves, pad: int) -> Counts:
    """Counts of pairs of codes that aren't empty. A move into a cell is what comes before it, times what begins with it."""
    forward, reverse, sizes = _directions(pairs, moves, pad)
    n, states, t = len(pairs), len(moves.trans), moves.trans
    totals = np.full(n, -np.inf)
    held = Backwards(forward, slice(0, states), _totals(forward, sizes, totals))
    rows, last, ends = forward.rows, held.last, sizes.sum(axis=1)
    whole = np.floor(totals)
    part = np.exp2(totals - whole)
    init, used = np.zeros((n, states)), np.zeros((n, states, states))
    match = np.zeros((n, last + 1, rows + 1))
    of_x, of_y = np.zeros((n, rows + 1)), np.zeros((n, forward.columns + 1))
    scale = lambda a, b: np.exp2(np.clip(a + b - whole[:, None], -1070, _FAR)) / part[:, None]
    reverse.step()
    for d in range(last, 0, -1):
        while reverse.d < min(last, last + 2 - d):
            reverse.step()
        into, beside = (reverse.p1, reverse.p2) if d > 1 else (None, reverse.p1)
        for k in np.flatnonzero(ends == d).tolist():
            values, power = held[d]
            lane = sizes[k, 0] + 1
            init[k] += values[:, k, lane] * moves.end * np.exp2(power[k, lane] - whole[k]) / part[k]
        before, power = held[d - 1]
        lo, hi = max(1, d - forward.columns), min(rows, d)
        if lo <= hi:  # a letter of x: from the lane before
            above, there = slice(lo, hi + 1), slice(rows + 2 - hi, rows + 3 - lo)
            s = scale(power[:, above], reverse.power[:, there][:, ::-1])
            for x in range(1, states, 2):
                to = beside[x, :, there][:, ::-1] * s
                if d == 1:
                    first = moves.start[x] * beside[x, :, rows + 1] * np.exp2(reverse.power[:, rows + 1] - whole) / part
                    init[:, x] += first
                    of_x[:, 1] += first
                for f in (0, x):
                    flow = before[f, :, above] * to * t[f, x]
                    used[:, f, x] += flow.sum(axis=1)
                    of_x[:, lo : hi + 1] += flow
        lo, hi = max(0, d - forward.columns), min(rows, d - 1)
        if lo <= hi:  # a letter of y: in the same lane
            here, there = slice(lo + 1, hi + 2), slice(rows + 1 - hi, rows + 2 - lo)
            s = scale(power[:, here], reverse.power[:, there][:, ::-1])
            for y in range(2, states, 2):
                to = beside[y, :, there][:, ::-1] * s
                if d == 1:
                    first = moves.start[y] * beside[y, :, rows + 1] * np.exp2(reverse.power[:, rows + 1] - whole) / part
                    init[:, y] += first
                    of_y[:, 1] += first
                for f in (0, y):
                    flow = before[f, :, here] * to * t[f, y]
                    used[:, f, y] += flow.sum(axis=1)
                    of_y[:, d - hi : d - lo + 1] += flow[:, ::-1]
        lo, hi = max(1, d - forward.columns), min(rows, d - 1)
        if d > 1 and lo <= hi:
            above, there = slice(lo, hi + 1), slice(rows + 2 - hi, rows + 3 - lo)
            if d == 2:
                first = moves.start[0] * into[0, :, rows + 1] * np.exp2(reverse.power[:, rows + 1] - whole) / part
                init[:, 0] += first
                match[:, 2, 1] += first
            before, power = held[d - 2]
            to = into[0, :, there][:, ::-1] * scale(power[:, above], reverse.power[:, there][:, ::-1])
            for f in range(states):
                flow = before[f, :, above] * to * t[f, 0]
                used[:, f, 0] += flow.sum(axis=1)
                match[:, d, lo : hi + 1] += flow
    letters = pad
    both, single = np.zeros((n, letters, letters)), np.zeros((n, letters))
    for k, (x, y) in enumerate(pairs):
        step = match.strides
        view = as_strided(match[k, 2:, 1:], (len(x), len(y)), (step[1] + step[2], step[1]))
        by_x, by_y = np.eye(letters)[x], np.eye(letters)[y]
        both[k] = by_x.T @ view @ by_y
        single[k] = by_x.T @ of_x[k, 1 : len(x) + 1] + by_y.T @ of_y[k, 1 : len(y) + 1]
    return Counts(init, used, both, single, totals * np.log(2))


def batches(sizes: list[tuple[int, int]], cells: int = BATCH_CELLS) -> Iterator[list[int]]:
    """Numbers of pairs of like sizes, in batches of about so many padded cells."""
    order = sorted(range(len(sizes)), key=lambda k: (max(sizes[k]), min(sizes[k])))
    held: list[int] = []
    rows = columns = 0
    for k in order:
        r, c = max(rows, min(sizes[k])), max(columns, max(sizes[k]))
        if held and (len(held) + 1) * (r + 1) * (r + c + 1) > cells:
            yield held
            held, r, c = [], min(sizes[k]), max(sizes[k])
        held.append(k)
        rows, columns = r, c
    if held:
        yield held


def match_probabilities(pairs: list[tuple[str, str]], models: list[Moves], code: Callable[[str], np.ndarray], pad: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of each pair, in an order of its own: its number and the m by n matrix of match probabilities.

    Of several models it is the root of the mean of their squares. The matrix is a view that holds
    only until the next one is asked for. The shorter sequence's letters are the lanes if the models
    treat both alike.
    """
    coded = [(code(a), code(b)) for a, b in pairs]
    even = all(np.array_equal(m.both, m.both.T) and np.array_equal(m.ex, m.ey) for m in models)
    some = [k for k, (x, y) in enumerate(coded) if len(x) and len(y)]
    for k, (x, y) in enumerate(coded):
        if not (len(x) and len(y)):
            yield k, np.zeros((len(x), len(y)))
    for lot in batches([(len(coded[k][0]), len(coded[k][1])) for k in some]):
        numbers = [some[k] for k in lot]
        turned = [even and len(coded[k][0]) > len(coded[k][1]) for k in numbers]
        given = [coded[k][::-1] if t else coded[k] for k, t in zip(numbers, turned, strict=True)]
        rows, columns = max(len(x) for x, _ in given), max(len(y) for _, y in given)
        out = np.zeros((len(given), rows + columns + 1, rows + 1))
        for m in models:
            posteriors(given, m, pad, (lambda p: p) if len(models) == 1 else np.square, out)
        if len(models) > 1:
            out /= len(models)
            np.sqrt(out, out=out)
        step = out.strides
        for k, t, (x, y), one in zip(numbers, turned, given, out, strict=True):
            view = as_strided(one[2:, 1:], (len(x), len(y)), (step[1] + step[2], step[1]))
            yield k, view.T if t else view


class Kernel:
    """The posteriors of a pair model and a scoring matrix, over one code of letters."""

    #: Models of each strategy: pair-HMM, partition function, local pair-HMM.
    KINDS = {0: "h", 1: "p", 2: "hp", 3: "hpl"}

    def __init__(self, model: PairModel, matrix: ScoreMatrix):
        self.letters = sorted({*model.single, *(x for xy in model.pair for x in xy), *matrix.letters})
        self.pad = len(self.letters) + 1
        self._codes = {x: k for k, x in enumerate(self.letters)} | {x.lower(): k for k, x in enumerate(self.letters)}
        eta = 1 - model.init[2]
        pair = self._both(lambda x, y: model.pair.get((x, y), UNKNOWN_PAIR))
        single = self._one(lambda x: model.single.get(x, UNKNOWN_SINGLE))
        odds = np.zeros_like(pair)
        odds[:-1, :-1] = pair[:-1, :-1] / np.multiply.outer(single[:-1], single[:-1]) / eta**2
        open_, longer = (float(np.exp(g / TEMPERATURE)) for g in matrix.gaps)
        init, ends, ones = np.array(model.init), np.ones(3), self._one(lambda x: 1.0)
        self.moves = {
            "h": Moves(np.exp(model.transitions()), pair, single, single, init, init),
            "l": Moves(np.exp(model.local_transitions()), odds, ones / eta, ones / eta, ends, ends, anywhere=True),
            "p": Moves(np.array([[1, open_, open_], [1, longer, 0], [1, 0, longer]]), self._both(lambda x, y: float(np.exp(matrix.scores.get((x, y), 0.0) / TEMPERATURE))), ones, ones, ends, ends, free=True),
        }

    def code(self, text: str) -> np.ndarray:
        unknown = self.pad - 1
        return np.fromiter((self._codes.get(x, unknown) for x in text), np.intp, len(text))

    def _one(self, value: Callable[[str], float]) -> np.ndarray:
        return np.array([*map(value, (*self.letters, "?")), 0.0])

    def _both(self, value: Callable[[str, str], float]) -> np.ndarray:
        found = np.zeros((self.pad + 1, self.pad + 1))
        for i, x in enumerate((*self.letters, "?")):
            for j, y in enumerate((*self.letters, "?")):
                found[i, j] = value(x, y)
        return found

    def counts(self, pairs: list[tuple[str, str]]) -> Iterator[tuple[list[int], Counts]]:
        """Expected counts of the pair-HMM, lot by lot: numbers of pairs and their counts; pairs with an empty sequence have none."""
        coded = {k: (self.code(a), self.code(b)) for k, (a, b) in enumerate(pairs) if a and b}
        some = list(coded)
        for lot in batches([(len(coded[k][0]), len(coded[k][1])) for k in some], BATCH_CELLS // 4):
            numbers = [some[k] for k in lot]
            yield numbers, expected([coded[k] for k in numbers], self.moves["h"], self.pad)

    def __call__(self, pairs: list[tuple[str, str]], s1: int) -> Iterator[tuple[int, np.ndarray]]:
        """See match_probabilities. Letters that the tables lack are alike; s1 above 3 counts as 3."""
        return match_probabilities(pairs, [self.moves[k] for k in self.KINDS.get(s1, "hpl")], self.code, self.pad)


def pair_posterior(a: str, b: str, s1: int, model: PairModel, matrix: ScoreMatrix) -> np.ndarray:
    """The posterior of one pair; see Kernel."""
    return next(Kernel(model, matrix)([(a, b)], s1))[1]
