"""Kernels against sums over all paths, and their invariants."""

import itertools
import random

import numpy as np
import pytest

from kinfold.functions.model import ALPHABET, PairModel, ScoreMatrix, strategy_of
from kinfold.operators import boltzmann, hmm, lattice, progressive, trace, tree

MODEL, MATRIX = PairModel(), ScoreMatrix.by_groups()


def words(seed, n, k):
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABET, k=rng.randrange(1, k + 1))) for _ in range(n)]


def paths(m, n, states):
    """All state paths that spend m letters of a and n of b; states maps a name to the letters it spends."""
    if not m and not n:
        yield ()
    for s, (i, j) in states.items():
        if i <= m and j <= n:
            for rest in paths(m - i, n - j, states):
                yield (s, *rest)


DOUBLE = {0: (1, 1), 1: (1, 0), 2: (0, 1), 3: (1, 0), 4: (0, 1)}


def path_log(a, b, path):
    t, init, value, i, j = MODEL.transitions(), np.log(MODEL.init), 0.0, 0, 0
    e2, ea, eb = MODEL.log_pair(a, b), MODEL.log_single(a), MODEL.log_single(b)
    for k, s in enumerate(path):
        value += t[path[k - 1], s] if k else init[s]
        value += e2[i, j] if s == 0 else ea[i] if s % 2 else eb[j]
        i, j = i + DOUBLE[s][0], j + DOUBLE[s][1]
    return value + init[path[-1]]


@pytest.mark.parametrize("a,b", [("A", "A"), ("AC", "C"), ("ACD", "AD"), ("W", "ACX")])
def test_forward_backward_by_paths(a, b):
    every = [(p, path_log(a, b, p)) for p in paths(len(a), len(b), DOUBLE)]
    every = [(p, v) for p, v in every if v > -np.inf]
    whole = np.logaddexp.reduce([v for _, v in every])
    f, g = hmm.forward(a, b, MODEL), hmm.backward(a, b, MODEL)
    assert np.isclose(np.logaddexp.reduce(f[:, -1, -1] + g[:, -1, -1]), whole)
    assert np.isclose(hmm.total(a, b, MODEL, f, g), whole)
    want = np.zeros((len(a), len(b)))
    for p, v in every:
        i = j = 0
        for s in p:
            i, j = i + DOUBLE[s][0], j + DOUBLE[s][1]
            if s == 0:
                want[i - 1, j - 1] += np.exp(v - whole)
    assert np.allclose(hmm.posterior(a, b, MODEL), want)


@pytest.mark.parametrize("seed", range(4))
def test_posteriors_are_probabilities(seed):
    a, b = words(seed, 2, 40)
    for p in (hmm.posterior(a, b, MODEL), boltzmann.partition_posterior(a, b, MATRIX), hmm.local_posterior(a, b, MODEL)):
        assert p.shape == (len(a), len(b)) and (p >= 0).all()
        assert p.sum(axis=0).max() <= 1 + 1e-9 and p.sum(axis=1).max() <= 1 + 1e-9


def test_models_are_symmetric():
    a, b = words(11, 2, 30)
    for make in (lambda x, y: hmm.posterior(x, y, MODEL), lambda x, y: boltzmann.partition_posterior(x, y, MATRIX), lambda x, y: hmm.local_posterior(x, y, MODEL)):
        assert np.allclose(make(a, b), make(b, a).T)


GAPPED = {0: (1, 1), 1: (0, 1), 2: (1, 0)}


def gapped_weight(a, b, path):
    value, i, j = 0.0, 0, 0
    for k, s in enumerate(path):
        if s and k and path[k - 1] not in (0, s):
            return -np.inf  # a gap follows a match or itself
        free = s and ((i in (0, len(a)) if s == 1 else j in (0, len(b))))
        if s == 0:
            value += MATRIX.table(a[i], b[j])[0, 0] / 5
        elif not free:
            value += -22 / 5 if not k or path[k - 1] == 0 else -1 / 5
        i, j = i + GAPPED[s][0], j + GAPPED[s][1]
    return value


@pytest.mark.parametrize("a,b", [("A", "A"), ("ACD", "CD"), ("MILV", "MIV"), ("WA", "AWY")])
def test_partition_function_by_paths(a, b):
    every = [(p, gapped_weight(a, b, p)) for p in paths(len(a), len(b), GAPPED)]
    whole = np.logaddexp.reduce([v for _, v in every])
    want = np.zeros((len(a), len(b)))
    for p, v in every:
        i = j = 0
        for s in p:
            i, j = i + GAPPED[s][0], j + GAPPED[s][1]
            if s == 0:
                want[i - 1, j - 1] += np.exp(v - whole)
    assert np.allclose(boltzmann.partition_posterior(a, b, MATRIX), want)
    path, score = boltzmann.partition_viterbi(a, b, MATRIX)
    assert np.isclose(score / 5, max(v for _, v in every))
    assert path.count("B") + path.count("X") == len(a) and path.count("B") + path.count("Y") == len(b)


def test_partition_function_of_long_sequences():
    a = "".join(random.Random(1).choices(ALPHABET, k=1500))
    p = boltzmann.partition_posterior(a, a[:700] + a[720:], MATRIX)
    assert np.isfinite(p).all() and p.max() <= 1 and p[0, 0] > 0.9


@pytest.mark.parametrize("seed", range(6))
def test_traces(seed):
    rng = np.random.default_rng(seed)
    p = rng.random((4, 3)) * (rng.random((4, 3)) < 0.7)
    steps = {"B": (1, 1), "X": (1, 0), "Y": (0, 1)}

    def score(path, opening=0.0, longer=0.0):
        i = j = 0
        value = 0.0
        for k, s in enumerate(path):
            i, j = i + steps[s][0], j + steps[s][1]
            value += p[i - 1, j - 1] if s == "B" else longer if k and path[k - 1] == s else opening
        return value

    every = list(paths(4, 3, steps))
    path, best = trace.best_trace(p)
    assert np.isclose(best, max(map(score, every))) and np.isclose(score(path), best)
    path, best = trace.best_trace_with_gaps(p, -0.3, -0.1)
    assert np.isclose(best, max(score(q, -0.3, -0.1) for q in every)) and np.isclose(score(path, -0.3, -0.1), best)


def test_trace_ties_and_gaps():
    assert trace.best_trace(np.zeros((1, 1)))[0] == "B"
    path, _ = trace.best_trace(hmm.posterior("ACDEFG", "ACDFG", MODEL))
    assert trace.with_gaps("ACDFG", path, "Y") == "ACD-FG" and trace.with_gaps("ACDEFG", path, "X") == "ACDEFG"
    assert trace.distance(3.0, 4, 6) == 0.25


@pytest.mark.parametrize("a,b", [("A", "A"), ("ACD", "AD"), ("WY", "ACW")])
def test_viterbi_by_paths(a, b):
    t, init = MODEL.local_transitions(), np.log(hmm.VITERBI_INIT)
    e2, ea, eb = MODEL.log_pair(a, b), MODEL.log_single(a), MODEL.log_single(b)
    kinds = {0: (1, 1), 1: (1, 0), 2: (0, 1)}
    best = -np.inf
    for p in paths(len(a), len(b), kinds):
        for start in range(3):
            value, i, j, before = init[start], 0, 0, start
            for s in p:
                value += t[before, s] + (e2[i, j] if s == 0 else ea[i] if s == 1 else eb[j])
                i, j, before = i + kinds[s][0], j + kinds[s][1], s
            best = max(best, value + init[p[-1]])
    path, score = hmm.viterbi(a, b, MODEL)
    assert np.isclose(score, best) and path.count("B") + path.count("X") == len(a)


def test_expected_counts_add_up():
    a, b = "ACDAW", "ACAW"
    c = hmm.expected_counts(a, b, MODEL)
    matches = sum(v for k, v in c.items() if k.startswith("pair:"))
    singles = sum(v for k, v in c.items() if k.startswith("single:"))
    assert np.isclose(2 * matches + singles, len(a) + len(b))
    assert np.isclose(sum(v for k, v in c.items() if k.startswith("init:")), 2)
    moves = sum(v for k, v in c.items() if k.startswith("move:"))
    assert np.isclose(moves + 1, matches + singles)  # one letter column less than transitions


def test_trees_weights_and_schedules():
    d = np.array([[0, 2, 6, 6], [2, 0, 6, 6], [6, 6, 0, 4], [6, 6, 4, 0]]) / 10
    nodes = tree.build_tree(d)
    assert [(n.left, n.right) for n in nodes[4:]] == [(1, 0), (3, 2), (5, 4)]
    assert np.allclose([n.dist for n in nodes[:4]], [0.1, 0.1, 0.2, 0.2]) and np.isclose(nodes[4].dist, 0.3)
    w = tree.weights(nodes, 4)
    assert w[0] == w[1] and w[2] == w[3] and w[2] >= w[0]
    order = tree.merge_order(nodes)
    assert [m["ord"] for m in order] == [1, 2, 3] and sorted(order[-1]["left_leaves"] + order[-1]["right_leaves"]) == [0, 1, 2, 3]
    assert tree.weights(tree.build_tree(np.zeros((3, 3))), 3) == [333] * 3
    assert tree.merge_order(tree.build_tree(np.zeros((1, 1)))) == [] and tree.merge_order([]) == []
    uneven = np.array([[0, 1, 4], [1, 0, 8], [4, 8, 0]]) / 10
    for linkage, far in ((tree.UPGMA, 0.6), (tree.WPGMA, 0.6)):
        assert np.isclose(tree.build_tree(uneven, linkage)[2].dist, far / 2)


def test_generator_and_refinement():
    draw = progressive.glibc_rand()
    assert list(itertools.islice(draw, 5)) == [1804289383, 846930886, 1681692777, 1714636915, 1957747793]
    residues = ["ACDEFG", "ACDFG", "ACEFG", "WYACDEF"]
    cells = {}
    d = np.zeros((4, 4))
    for i, j in itertools.combinations(range(4), 2):
        p = hmm.posterior(residues[i], residues[j], MODEL)
        x, y = np.nonzero(p >= 0.01)
        cells[i, j] = x + 1, y + 1, p[x, y]
        d[i, j] = d[j, i] = trace.distance(trace.best_trace(p)[1], *p.shape)
    nodes = tree.build_tree(d)
    rows = progressive.progressive(residues, tree.merge_order(nodes), cells, tree.weights(nodes, 4))
    for found in (rows, progressive.refine(dict(sorted(rows.items())), cells, 0), progressive.refine_by_tree(rows, [0, 1], cells)[0]):
        assert {s: r.replace("-", "") for s, r in found.items()} == dict(enumerate(residues))
        assert len({len(r) for r in found.values()}) == 1
        assert all(any(x != "-" for x in c) for c in zip(*found.values(), strict=True))
    assert progressive.refine_by_tree(rows, [], cells)[1] == 2
    assert progressive.project({0: "A-C", 1: "--D"}) == {0: "AC", 1: "-D"}


def test_matrices_and_strategies():
    m = ScoreMatrix.from_triangle("AB", [1, 2, 3])
    assert m.table("AbZ", "BA").tolist() == [[2, 1], [3, 2], [0, 0]]
    with pytest.raises(ValueError):
        ScoreMatrix.from_triangle("AB", [1, 2])
    assert ScoreMatrix.nucleotides().scores["A", "A"] == 1 and ScoreMatrix.nucleotides().scores["A", "C"] == 0
    assert np.isclose(sum(MODEL.pair.values()), 1)
    assert [strategy_of(c) for c in range(5)] == [(0, 1, 1), (1, 0, 1), (2, 0, 0), (3, 0, 1), (3, 0, 1)]


def of_one(a, b, s1):
    """The posterior of a strategy by the kernels that hold every state of every cell."""
    kinds = {"h": lambda: hmm.posterior(a, b, MODEL), "p": lambda: boltzmann.partition_posterior(a, b, MATRIX, *MATRIX.gaps), "l": lambda: hmm.local_posterior(a, b, MODEL)}
    found = [kinds[k]() for k in lattice.Kernel.KINDS[s1]]
    return found[0] if len(found) == 1 else np.sqrt(sum(x * x for x in found) / len(found))


@pytest.mark.parametrize("s1", range(4))
def test_batches_equal_single_pairs(s1, monkeypatch):
    some = words(3, 30, 60)
    pairs = [*zip(some[::2], some[1::2], strict=True), ("", "A"), ("A", ""), ("A", "W"), ("XBZ", "acd"), ("A" * 40, "A")]
    for cells, block in ((1 << 20, 16 << 20), (4000, 1)):  # with and without checkpoints between
        monkeypatch.setattr(lattice, "BLOCK_BYTES", block)
        monkeypatch.setattr(lattice.batches, "__defaults__", (cells,))
        seen = set()
        for k, p in lattice.Kernel(MODEL, MATRIX)(pairs, s1):
            seen.add(k)
            assert p.shape == tuple(map(len, pairs[k])) and np.allclose(p, of_one(*pairs[k], s1), rtol=1e-9, atol=1e-12)
        assert seen == set(range(len(pairs)))


@pytest.mark.parametrize("s1", [0, 1, 3])
def test_long_repeats_stay_in_range(s1):
    """Two places of one domain, whose prefixes differ by more than a double's range, share the probability."""
    part = "".join(random.Random(2).choices(ALPHABET, k=700))
    p = lattice.pair_posterior(part, part + part, s1, MODEL, MATRIX)
    assert np.isfinite(p).all() and np.allclose(p, of_one(part, part + part, s1), rtol=1e-7, atol=1e-9)
    assert p.sum(axis=0).max() < 1 + 1e-6


def test_memory_of_a_long_pair():
    import tracemalloc

    rng = random.Random(3)
    a, b = ("".join(rng.choices(ALPHABET, k=n)) for n in (6000, 1000))
    tracemalloc.start()
    trace.best_trace(lattice.pair_posterior(a, b, 0, MODEL, MATRIX))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 14 * len(a) * len(b)


def scanned_tree(d, linkage):
    """The tree by a scan over all pairs for each merge."""
    d = np.maximum(np.array(d, float), 0)
    live, node_of, leaves, merges = list(range(len(d))), list(range(len(d))), [1] * len(d), []
    while len(live) > 1:
        near, i, j = min((d[i, j], i, j) for i in live for j in live if j < i)
        a, b = leaves[node_of[i]], leaves[node_of[j]]
        merges.append((node_of[i], node_of[j], near / 2))
        d[i] = d[:, i] = (d[i] * a + d[j] * b) / (a + b) if linkage == tree.UPGMA else (d[i] + d[j]) / 2
        leaves.append(a + b)
        node_of[i] = len(leaves) - 1
        live.remove(j)
    return merges


@pytest.mark.parametrize("linkage", [tree.UPGMA, tree.WPGMA])
def test_trees_equal_a_scan_with_ties(linkage):
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 5, 9, 20, 33):
        for levels in (1, 2, 3, 1000):
            d = rng.integers(-1, levels, (n, n)) / 7
            d = np.tril(d, -1) + np.tril(d, -1).T
            nodes = tree.build_tree(d, linkage)
            assert [(x.left, x.right, nodes[x.left].dist) for x in nodes[n:]] == scanned_tree(d, linkage)


def test_a_large_tree():
    import time

    rng = np.random.default_rng(1)
    points = rng.random((3000, 2))
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    began = time.perf_counter()
    nodes = tree.build_tree(d)
    assert len(nodes) == 5999 and nodes[-1].leaves == 3000 and time.perf_counter() - began < 30
