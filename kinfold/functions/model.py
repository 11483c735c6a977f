"""Parameters of the pair models: transitions, emissions and scoring matrices.

Large tables of scores or pair emissions are parameters, read by kinfold.sources.parameters;
the defaults here follow from a few fixed values and a rule.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

# Fixed values.
ALPHABET = "ARNDCQEGHILKMFPSTWYV"
#: Initial state distribution of the double-affine model: match, two pairs of insert states.
INIT = (0.6814756989, 8.615339902e-5, 8.615339902e-5, 0.1591759622, 0.1591759622)
GAP_OPEN = (0.0119511066, 0.0119511066, 0.008008334786, 0.008008334786)
GAP_EXTEND = (0.3965826333, 0.3965826333, 0.8988758326, 0.8988758326)
#: Initial state distribution of the Viterbi model with one pair of insert states.
VITERBI_INIT = (0.6080327034, 0.1959836632, 0.1959836632)
EMIT_SINGLE = (
    0.07831005, 0.05246024, 0.04433257, 0.05130349, 0.02189704, 0.03585766, 0.05615771, 0.07783433, 0.02601093, 0.06511648,
    0.09716489, 0.05877077, 0.02438117, 0.04463228, 0.03940142, 0.05849916, 0.05115306, 0.01203523, 0.03124726, 0.07343426,
)
STRONG_GROUPS = ("STA", "NEQK", "NHQK", "NDEQ", "QHRK", "MILV", "MILF", "HY", "FYW")
WEAK_GROUPS = ("CSA", "ATV", "SAG", "STNK", "STPA", "SGND", "SNDEQK", "NDEQHK", "NEHQRK", "FVLIM", "HFY")
#: Gap open and extension that go with each matrix; a matrix of another name brings its own.
GAP_COSTS = {160: (-22.0, -1.0), 200: (-22.15, -1.5), 4: (-4.0, -0.25)}
MATRIX_CODES = {"gonnet_160": 160, "vtml_200": 200, "nuc_simple": 4}
CLASS_PRIORS = (0.22, 0.17, 0.21, 0.4)
#: Strategy (posterior model, tree linkage, consistency weighting) of each class; any other class uses the last.
STRATEGIES = {0: (0, 1, 1), 1: (1, 0, 1), 2: (2, 0, 0)}
OTHER_STRATEGY = (3, 0, 1)
TEMPERATURE = 5.0
CUTOFF = 0.01
#: Probabilities of letters outside the alphabet.
UNKNOWN_PAIR, UNKNOWN_SINGLE = 1e-10, 1e-5


def matrix_name(which: int | str) -> str:
    """The name of a matrix given by name or code; other codes are an error."""
    names = {code: name for name, code in MATRIX_CODES.items()}
    if isinstance(which, str):
        return which
    if which not in names:
        raise ValueError(f"no matrix has the code {which}")
    return names[which]


def gap_costs(which: int | str) -> tuple[float, float]:
    """Gap open and extension of a matrix given by name or code."""
    name = matrix_name(which)
    if name not in MATRIX_CODES:
        raise ValueError(f"the gap costs of {name} must be given")
    return GAP_COSTS[MATRIX_CODES[name]]


def strategy_of(cls: int) -> tuple[int, int, int]:
    return STRATEGIES.get(cls, OTHER_STRATEGY)


@dataclass(frozen=True)
class ScoreMatrix:
    """Symmetric scores of letter pairs, and gap costs; a pair with an unknown letter scores 0."""

    letters: str
    scores: dict[tuple[str, str], float] = field(hash=False)
    gaps: tuple[float, float] = GAP_COSTS[160]

    @classmethod
    def from_triangle(cls, letters: str, values: list[float], gaps: tuple[float, float] = GAP_COSTS[160]) -> ScoreMatrix:
        """values: the lower triangle with the diagonal, row by row."""
        if len(values) != len(letters) * (len(letters) + 1) // 2:
            raise ValueError("the triangle doesn't fit the letters")
        found, at = {}, iter(values)
        for i, x in enumerate(letters):
            for y in letters[: i + 1]:
                found[x, y] = found[y, x] = float(next(at))
        return cls(letters, found, gaps)

    @classmethod
    def by_groups(cls) -> ScoreMatrix:
        """The default: 6 for equal letters, 2 within a strong group, 0 within a weak one, else -2."""
        rank = lambda x, y: 6 if x == y else next((s for s, groups in ((2, STRONG_GROUPS), (0, WEAK_GROUPS)) if any(x in g and y in g for g in groups)), -2)
        return cls(ALPHABET, {(x, y): float(rank(x, y)) for x in ALPHABET for y in ALPHABET})

    @classmethod
    def nucleotides(cls) -> ScoreMatrix:
        """1 for equal A, C, G, T or U, else 0."""
        letters = "ABCDGHKMNRSTUVWXY"
        return cls(letters, {(x, y): float(x == y and x in "ACGTU") for x in letters for y in letters}, GAP_COSTS[4])

    def table(self, a: str, b: str) -> np.ndarray:
        get = self.scores.get
        return np.array([[get((x, y), 0.0) for y in b.upper()] for x in a.upper()], float).reshape(len(a), len(b))

    def rows(self) -> list[tuple[str, str, float]]:
        return [(x, y, s) for (x, y), s in sorted(self.scores.items())]


@dataclass(frozen=True)
class PairModel:
    """Probabilities of the double-affine pair model and of the models derived from it."""

    init: tuple[float, ...] = INIT
    gap_open: tuple[float, ...] = GAP_OPEN
    gap_extend: tuple[float, ...] = GAP_EXTEND
    single: dict[str, float] = field(default_factory=lambda: dict(zip(ALPHABET, EMIT_SINGLE, strict=True)), hash=False)
    pair: dict[tuple[str, str], float] = field(default_factory=dict, hash=False)

    def __post_init__(self):
        if not self.pair:
            object.__setattr__(self, "pair", default_pairs(self.single))

    def log_single(self, a: str) -> np.ndarray:
        return np.log([self.single.get(x, UNKNOWN_SINGLE) for x in a.upper()] or [1.0])[: len(a)]

    def log_pair(self, a: str, b: str) -> np.ndarray:
        get = self.pair.get
        return np.log(np.array([[get((x, y), UNKNOWN_PAIR) for y in b.upper()] for x in a.upper()], float).reshape(len(a), len(b)))

    def transitions(self) -> np.ndarray:
        """Logs, from row to column, of states match, X0, Y0, X1, Y1."""
        t = np.zeros((5, 5))
        for k in (0, 1):
            for state in (2 * k + 1, 2 * k + 2):
                t[0, state] = self.gap_open[2 * k]
                t[state, state] = self.gap_extend[2 * k]
                t[state, 0] = 1 - self.gap_extend[2 * k]
        t[0, 0] = 1 - 2 * (self.gap_open[0] + self.gap_open[2])
        with np.errstate(divide="ignore"):
            return np.log(t)

    def local_transitions(self) -> np.ndarray:
        """Logs, of states match, X, Y, with the gap parameters of index 1."""
        o, e = self.gap_open[1], self.gap_extend[1]
        with np.errstate(divide="ignore"):
            return np.log(np.array([[1 - 2 * o, o, o], [1 - e, e, 0], [1 - e, 0, e]]))


def default_pairs(single: dict[str, float]) -> dict[tuple[str, str], float]:
    """Pair emissions by a rule: odds grow with the group score, and all pairs together have probability one."""
    score = ScoreMatrix.by_groups().scores
    raw = {(x, y): single[x] * single[y] * float(np.exp(0.35 * score.get((x, y), 0.0))) for x in single for y in single}
    total = sum(raw.values())
    return {k: v / total for k, v in raw.items()}
