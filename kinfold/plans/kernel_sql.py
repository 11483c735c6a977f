"""SQL of the pair kernels, over whole sequences: recursive queries that go from one anti-diagonal to the next.

The values of an anti-diagonal d = i + j are lists over i from 0 to the length of a; {NONE} stands for
the log of nothing.
"""

from __future__ import annotations

from kinfold.functions.model import ALPHABET, GAP_COSTS, TEMPERATURE, VITERBI_INIT, PairModel, ScoreMatrix
from kinfold.plans.sequence_queries import _BENCH
from kinfold.sources.tables import FAMILY_SIZE

NONE = "-1e30::DOUBLE"
_NUMBERS = f"list_transform(string_split({{}}, ''), lambda x: instr('{ALPHABET}', x))"


def _sum(*terms: str) -> str:
    """The log of the sum of what the terms are logs of."""
    high = f"greatest({', '.join(terms)})"
    return f"({high} + ln({' + '.join(f'exp({t} - {high})' for t in terms)}))"


def _list(value: str) -> str:
    return f"list_transform(range(0, m + 1), lambda i: {value})"


def _table(get) -> str:
    """All ordered pairs of letters as one list."""
    return "[" + ", ".join(f"{get(x, y)!r}::DOUBLE" for x in ALPHABET for y in ALPHABET) + "]"


def _pairs(both_ways: bool) -> str:
    numbers = lambda r: _NUMBERS.format(r)
    back = f" UNION ALL SELECT x.family, x.label, y.label, 'r', list_reverse({numbers('x.residues')}), list_reverse({numbers('y.residues')}) FROM b x JOIN b y ON x.family = y.family AND x.label < y.label"
    return f"""{_BENCH},
    o AS (SELECT x.family AS family, x.label AS a, y.label AS b, 'f' AS way, {numbers("x.residues")} AS x, {numbers("y.residues")} AS y
          FROM b x JOIN b y ON x.family = y.family AND x.label < y.label{back if both_ways else ""}),
    l AS (SELECT *, len(x) AS m, len(y) AS n FROM o WHERE len(x) > 0 AND len(y) > 0)"""


def partition_posterior() -> str:
    """CTEs up to post (family, a, b, m, n, i, j, p): the posterior of the partition function, all cells."""
    scores = ScoreMatrix.by_groups().scores
    table = _table(lambda x, y: scores[x, y] / TEMPERATURE)
    opening, longer = (g / TEMPERATURE for g in GAP_COSTS[160])
    j = "(d + 1 - i)"
    inside = f"{j} >= 1 AND {j} <= n AND i >= 1"
    score = f"s[(x[i] - 1) * {len(ALPHABET)} + y[{j}]]"
    gap_a = _sum(f"(p0[i + 1] + CASE WHEN i = m THEN 0 ELSE {opening!r} END)", f"(p1[i + 1] + CASE WHEN i = m THEN 0 ELSE {longer!r} END)")
    gap_b = _sum(f"(p0[i] + CASE WHEN {j} = n THEN 0 ELSE {opening!r} END)", f"(p2[i] + CASE WHEN {j} = n THEN 0 ELSE {longer!r} END)")
    return f"""{_pairs(True)},
    z AS (
        SELECT family, a, b, way, x, y, m, n, {table} AS s, 1 AS d,
               {_list(NONE)} AS p0, {_list(f"CASE WHEN i = 0 THEN 0 ELSE {NONE} END")} AS p1, {_list(f"CASE WHEN i = 1 THEN 0 ELSE {NONE} END")} AS p2,
               {_list(f"CASE WHEN i = 0 THEN 0 ELSE {NONE} END")} AS q0, {_list(NONE)} AS q1, {_list(NONE)} AS q2
        FROM l
        UNION ALL
        SELECT family, a, b, way, x, y, m, n, s, d + 1,
               {_list(f"CASE WHEN {inside} THEN {score} + {_sum('q0[i]', 'q1[i]', 'q2[i]')} ELSE {NONE} END")},
               {_list(f"CASE WHEN {inside} THEN {gap_a} WHEN i = 0 AND {j} <= n THEN 0 ELSE {NONE} END")},
               {_list(f"CASE WHEN {inside} THEN {gap_b} WHEN {j} = 0 THEN 0 ELSE {NONE} END")},
               p0, p1, p2
        FROM z WHERE d < m + n),
    whole AS (SELECT family, a, b, {_sum("p0[m + 1]", "p1[m + 1]", "p2[m + 1]")} AS total FROM z WHERE way = 'f' AND d = m + n),
    v AS (SELECT family, a, b, way, m, n, i, d - i AS j, p0[i + 1] AS v, s[(x[i] - 1) * {len(ALPHABET)} + y[d - i]] AS s
          FROM (SELECT *, unnest(range(greatest(1, d - n), least(m, d - 1) + 1)) AS i FROM z WHERE d > 1)),
    post AS (SELECT f.family, f.a, f.b, f.m, f.n, f.i, f.j, exp(least(0, f.v + r.v - f.s - total)) AS p
             FROM v f JOIN v r ON r.way = 'r' AND f.family = r.family AND f.a = r.a AND f.b = r.b AND r.i = f.m - f.i + 1 AND r.j = f.n - f.j + 1
                  JOIN whole w ON f.family = w.family AND f.a = w.a AND f.b = w.b
             WHERE f.way = 'f')"""


def trace_distance(posterior: str) -> str:
    """CTEs up to dist (family, a, b, d): 1 less the best monotone sum of posterior's cells over the shorter length."""
    return f"""{posterior},
    diagonal AS MATERIALIZED (SELECT family, a, b, m, n, i + j AS d, min(i) AS low, list(p ORDER BY i) AS p FROM post GROUP BY ALL),
    h AS (
        SELECT family, a, b, m, n, 1 AS d, {_list("0::DOUBLE")} AS p, {_list("0::DOUBLE")} AS q FROM l WHERE way = 'f'
        UNION ALL
        SELECT h.family, h.a, h.b, h.m, h.n, h.d + 1,
               list_transform(range(0, h.m + 1), lambda i: CASE WHEN i = 0 THEN 0 WHEN i < g.low OR i >= g.low + len(g.p) THEN h.p[i]
                   ELSE greatest(h.q[i] + g.p[i - g.low + 1], h.p[i], h.p[i + 1]) END),
               h.p
        FROM h JOIN diagonal g ON h.family = g.family AND h.a = g.a AND h.b = g.b AND g.d = h.d + 1),
    dist AS (SELECT family, a, b, 1 - p[m + 1] / least(m, n) AS d FROM h WHERE d = m + n)"""


def hmm_posterior() -> str:
    """CTEs up to post: the posterior of the pair-HMM with two pairs of insert states, all cells."""
    import numpy as np

    model = PairModel()
    k, t, init = len(ALPHABET), model.transitions(), np.log(model.init)
    pairs, single = _table(lambda x, y: float(np.log(model.pair[x, y]))), "[" + ", ".join(f"{float(np.log(model.single[x]))!r}::DOUBLE" for x in ALPHABET) + "]"
    c = lambda v: f"({float(v)!r})"
    j = "(d + 1 - i)"
    match = f"CASE WHEN i < 1 OR {j} < 1 OR {j} > n THEN {NONE} WHEN i = 1 AND {j} = 1 THEN {c(init[0])} + e[(x[1] - 1) * {k} + y[1]] ELSE e[(x[i] - 1) * {k} + y[{j}]] + {_sum(*(f'(q{s}[i] + {c(t[s, 0])})' for s in range(5)))} END"

    def insert(s: int) -> str:
        if s % 2:
            step = _sum(f"(p0[i] + {c(t[0, s])})", f"(p{s}[i] + {c(t[s, s])})")
            return f"CASE WHEN i < 1 OR {j} < 0 OR {j} > n THEN {NONE} WHEN i = 1 AND {j} = 0 THEN {c(init[s])} + o[x[1]] ELSE o[x[i]] + {step} END"
        step = _sum(f"(p0[i + 1] + {c(t[0, s])})", f"(p{s}[i + 1] + {c(t[s, s])})")
        return f"CASE WHEN {j} < 1 OR {j} > n THEN {NONE} WHEN i = 0 AND {j} = 1 THEN {c(init[s])} + o[y[1]] ELSE o[y[{j}]] + {step} END"

    # backward: g of cell (i, j) from (i + 1, j + 1) on diagonal d + 2, (i + 1, j) and (i, j + 1) on d + 1; r and u are these diagonals
    jb = "(d - 1 - i)"
    ahead = f"(CASE WHEN i < m AND {jb} < n THEN e[(x[i + 1] - 1) * {k} + y[{jb} + 1]] + u0[i + 2] ELSE {NONE} END)"
    by_x = lambda s: f"(CASE WHEN i < m THEN o[x[i + 1]] + r{s}[i + 2] ELSE {NONE} END)"
    by_y = lambda s: f"(CASE WHEN {jb} < n THEN o[y[{jb} + 1]] + r{s}[i + 1] ELSE {NONE} END)"
    by = lambda s: by_x(s) if s % 2 else by_y(s)
    back = [_sum(f"({c(t[0, 0])} + {ahead})", *(f"({c(t[0, s])} + {by(s)})" for s in range(1, 5)))]
    back += [_sum(f"({c(t[s, 0])} + {ahead})", f"({c(t[s, s])} + {by(s)})") for s in range(1, 5)]
    held = lambda value: f"CASE WHEN {jb} < 0 OR {jb} > n THEN {NONE} ELSE {value} END"
    names = lambda x: ", ".join(f"{x}{s}" for s in range(5))
    end_f = _sum(*(f"(f.p{s}[f.m + 1] + {c(init[s])})" for s in range(5)))
    start_g = _sum(f"({c(init[0])} + e[(x[1] - 1) * {k} + y[1]] + g2.r0[2])", *(f"({c(init[s])} + o[x[1]] + g1.r{s}[2])" if s % 2 else f"({c(init[s])} + o[y[1]] + g1.r{s}[1])" for s in range(1, 5)))
    return f"""{_pairs(False)},
    f AS (
        SELECT family, a, b, x, y, m, n, {pairs} AS e, {single} AS o, 0 AS d, {", ".join(f"{_list(NONE)} AS p{s}" for s in range(5))}, {", ".join(f"{_list(NONE)} AS q{s}" for s in range(5))}
        FROM l
        UNION ALL
        SELECT family, a, b, x, y, m, n, e, o, d + 1, {_list(match)}, {", ".join(_list(insert(s)) for s in range(1, 5))}, {names("p")}
        FROM f WHERE d < m + n),
    g AS (
        SELECT family, a, b, x, y, m, n, {pairs} AS e, {single} AS o, m + n AS d, {", ".join(f"{_list(f'CASE WHEN i = m THEN {c(init[s])} ELSE {NONE} END')} AS r{s}" for s in range(5))}, {", ".join(f"{_list(NONE)} AS u{s}" for s in range(5))}
        FROM l
        UNION ALL
        SELECT family, a, b, x, y, m, n, e, o, d - 1, {", ".join(_list(held(value)) for value in back)}, {names("r")}
        FROM g WHERE d > 1),
    whole AS (SELECT f.family, f.a, f.b, ({end_f} + {start_g.replace("e[(", "f.e[(").replace("(x[", "(f.x[").replace("+ y[1]]", "+ f.y[1]]").replace("o[x[1]]", "f.o[f.x[1]]").replace("o[y[1]]", "f.o[f.y[1]]")}) / 2 AS total
              FROM f JOIN g g1 USING (family, a, b) JOIN g g2 USING (family, a, b) WHERE f.d = f.m + f.n AND g1.d = 1 AND g2.d = 2),
    fv AS (SELECT family, a, b, m, n, i, d - i AS j, p0[i + 1] AS v FROM (SELECT *, unnest(range(greatest(1, d - n), least(m, d - 1) + 1)) AS i FROM f WHERE d > 1)),
    gv AS (SELECT family, a, b, i, d - i AS j, r0[i + 1] AS v FROM (SELECT *, unnest(range(greatest(1, d - n), least(m, d - 1) + 1)) AS i FROM g WHERE d > 1)),
    post AS (SELECT family, a, b, fv.m, fv.n, i, j, exp(least(0, fv.v + gv.v - total)) AS p FROM fv JOIN gv USING (family, a, b, i, j) JOIN whole USING (family, a, b))"""


def cells_sql(posterior: str) -> str:
    return f"WITH RECURSIVE {posterior} SELECT family, a, b, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(p, 6) AS p FROM post WHERE p >= 0.01"


def distance_sql(posterior: str) -> str:
    return f"WITH RECURSIVE {trace_distance(posterior)} SELECT family, a, b, round(d, 6) AS d FROM dist"


def tree_sql(what: str, plain: bool = False) -> str:
    """Guide trees by the distances of the partition function: what is tree, weights or merges.

    The merges of a family are as many CTEs, one for each; families have FAMILY_SIZE sequences at most.
    A cluster is known by its place i and its node; the merged one takes the place of the larger i.
    """
    steps = FAMILY_SIZE - 1
    made = [f"""{trace_distance(partition_posterior())},
    sizes AS (SELECT family, count(*) AS n FROM b GROUP BY family),
    e0 AS MATERIALIZED (SELECT family, greatest(a, b) AS i, least(a, b) AS j, greatest(0, round(d, 6)) AS d FROM dist),
    c0 AS (SELECT family, label AS place, label AS node, 1 AS leaves FROM b)"""]
    for k in range(steps):
        mean = "(x.d + y.d) / 2" if plain else "(x.d * best.li + y.d * best.lj) / (best.li + best.lj)"
        made.append(f"""
    best{k} AS MATERIALIZED (
        SELECT family, i, j, d, u.node AS left_node, v.node AS right_node, u.leaves AS li, v.leaves AS lj, CAST(n + {k} AS INTEGER) AS node
        FROM (SELECT family, unnest(arg_min({{'i': i, 'j': j, 'd': d}}, {{'d': d, 'i': i, 'j': j}})) FROM e{k} GROUP BY family)
             JOIN c{k} u USING (family) JOIN c{k} v USING (family) JOIN sizes USING (family) WHERE u.place = i AND v.place = j),
    c{k + 1} AS MATERIALIZED (
        SELECT c.family, place, CASE WHEN place = i THEN best.node ELSE c.node END AS node, CASE WHEN place = i THEN li + lj ELSE leaves END AS leaves
        FROM c{k} c LEFT JOIN best{k} best USING (family) WHERE j IS NULL OR place <> j),
    s{k} AS (SELECT family, i, j, d FROM e{k} UNION ALL SELECT family, j, i, d FROM e{k}),
    e{k + 1} AS MATERIALIZED (
        SELECT e.family, e.i, e.j, e.d FROM e{k} e JOIN best{k} best USING (family) WHERE e.i NOT IN (best.i, best.j) AND e.j NOT IN (best.i, best.j)
        UNION ALL
        SELECT x.family, greatest(x.i, x.j), least(x.i, x.j), {mean}
        FROM s{k} x JOIN best{k} best ON x.family = best.family AND x.i = best.i AND x.j <> best.j JOIN s{k} y ON y.family = x.family AND y.i = best.j AND y.j = x.j)""")
    every = " UNION ALL ".join(f"SELECT family, node, left_node, right_node, d, li + lj AS leaves FROM best{k}" for k in range(steps))
    made.append(f"""
    merged AS MATERIALIZED ({every}),
    tree AS MATERIALIZED (
        SELECT t.family, CAST(t.node AS INTEGER) AS node, CAST(t.left_node AS INTEGER) AS "left", CAST(t.right_node AS INTEGER) AS "right",
               CAST(coalesce(m.node, -1) AS INTEGER) AS parent, coalesce(m.d / 2, 0) AS dist, t.left_node < 0 AS is_leaf, CAST(t.leaves AS INTEGER) AS n_leaves
        FROM (SELECT family, node, left_node, right_node, leaves FROM merged UNION ALL SELECT family, label, -1, -1, 1 FROM b) t
             LEFT JOIN merged m ON m.family = t.family AND t.node IN (m.left_node, m.right_node)),
    up AS (
        SELECT family, node AS label, parent, round(dist, 6) / n_leaves AS total FROM tree WHERE is_leaf
        UNION ALL
        SELECT up.family, up.label, t.parent, total + round(t.dist, 6) / t.n_leaves FROM up JOIN tree t ON t.family = up.family AND t.node = up.parent WHERE up.parent >= 0),
    raw AS (SELECT family, label, CAST(floor(100 * max(total)) AS BIGINT) AS w FROM up GROUP BY family, label),
    equal AS (SELECT family, label, CASE WHEN sum(w) OVER (PARTITION BY family) = 0 THEN 1 ELSE w END AS w FROM raw),
    under AS (
        SELECT family, node AS top, node, ['L'][1:0] AS path, 0 AS depth FROM tree WHERE parent < 0
        UNION ALL
        SELECT u.family, u.top, t.node, list_append(u.path, CASE WHEN t.node = p."left" THEN 'A' ELSE 'B' END), u.depth + 1
        FROM under u JOIN tree p ON p.family = u.family AND p.node = u.node JOIN tree t ON t.family = u.family AND t.parent = u.node),
    -- in post-order a node comes after all below it: paths in order with an end mark that is greater than A and B
    ranked AS (SELECT family, node, depth, CAST(row_number() OVER (PARTITION BY family ORDER BY array_to_string(path, '') || 'Z') AS INTEGER) AS ord
               FROM under JOIN tree t USING (family, node) WHERE NOT t.is_leaf),
    below AS (
        SELECT family, node AS top, node FROM tree UNION ALL
        SELECT x.family, x.top, t.node FROM below x JOIN tree t ON t.family = x.family AND t.parent = x.node),
    leaf_order AS (SELECT family, node, row_number() OVER (PARTITION BY family ORDER BY array_to_string(path, '') || 'Z') AS nth FROM under JOIN tree t USING (family, node) WHERE t.is_leaf),
    lists AS (SELECT x.family, x.top, string_agg(x.node::VARCHAR, ' ' ORDER BY nth) AS leaves FROM below x JOIN leaf_order o ON o.family = x.family AND o.node = x.node GROUP BY x.family, x.top)""")
    last = {
        "tree": 'SELECT family, node, "left", "right", parent, round(dist, 6) AS dist, is_leaf, n_leaves FROM tree',
        "weights": "SELECT family, label, CAST(greatest(1, 1000 * w // sum(w) OVER (PARTITION BY family)) AS INTEGER) AS w FROM equal",
        "merges": """SELECT r.family, r.ord, r.depth, coalesce(x.ord, 0) AS left_ord, coalesce(y.ord, 0) AS right_ord, u.leaves AS left_leaves, v.leaves AS right_leaves
            FROM ranked r JOIN tree t USING (family, node) LEFT JOIN ranked x ON x.family = r.family AND x.node = t."left" LEFT JOIN ranked y ON y.family = r.family AND y.node = t."right"
                 JOIN lists u ON u.family = r.family AND u.top = t."left" JOIN lists v ON v.family = r.family AND v.top = t."right" """,
    }
    return "WITH RECURSIVE " + ",".join(made) + " " + last[what]


def viterbi_sql(last: str) -> str:
    """The best edit paths of the three-state model and what is measured on them; last selects from measured.

    Each anti-diagonal keeps the state that each cell came from; the way back is a second recursion.
    """
    import numpy as np

    model, scores = PairModel(), ScoreMatrix.by_groups().scores
    k, t, init = len(ALPHABET), model.local_transitions(), np.log(VITERBI_INIT)
    c = lambda v: f"({float(v)!r})" if v > -1e30 else f"({NONE})"
    pairs, single = _table(lambda x, y: float(np.log(model.pair[x, y]))), "[" + ", ".join(f"{float(np.log(model.single[x]))!r}::DOUBLE" for x in ALPHABET) + "]"
    emission, score = _table(lambda x, y: model.pair[x, y]), _table(lambda x, y: scores[x, y])
    j = "(d + 1 - i)"
    options = [f"(q{s}[i] + {c(t[s, 0])})" for s in range(3)]
    best = f"greatest({', '.join(options)})"
    inside, own, other = f"i >= 1 AND {j} >= 1 AND {j} <= n", f"i >= 1 AND {j} >= 0 AND {j} <= n", f"{j} >= 1 AND {j} <= n"
    x_open, x_long = f"(p0[i] + {c(t[0, 1])})", f"(p1[i] + {c(t[1, 1])})"
    y_open, y_long = f"(p0[i + 1] + {c(t[0, 2])})", f"(p2[i + 1] + {c(t[2, 2])})"
    values = [
        f"CASE WHEN {inside} THEN e[(x[i] - 1) * {k} + y[{j}]] + {best} ELSE {NONE} END",
        f"CASE WHEN {own} THEN o[x[i]] + greatest({x_open}, {x_long}) ELSE {NONE} END",
        f"CASE WHEN {other} THEN o[y[{j}]] + greatest({y_open}, {y_long}) ELSE {NONE} END",
    ]
    # the first of equal states, which is the match state wherever it is among them
    came = [
        f"CASE WHEN NOT ({inside}) OR {options[0]} = {best} THEN 0 WHEN {options[1]} = {best} THEN 1 ELSE 2 END",
        f"CASE WHEN NOT ({own}) OR {x_open} >= {x_long} THEN 0 ELSE 1 END",
        f"CASE WHEN NOT ({other}) OR {y_open} >= {y_long} THEN 0 ELSE 2 END",
    ]
    names = lambda x: ", ".join(f"{x}{s}" for s in range(3))
    ends = [f"(p{s}[m + 1] + {c(init[s])})" for s in range(3)]
    most = f"greatest({', '.join(ends)})"
    return f"""WITH RECURSIVE {_pairs(False)},
    v AS MATERIALIZED (
        SELECT family, a, b, x, y, m, n, {pairs} AS e, {single} AS o, 0 AS d, {", ".join(f"{_list(f'CASE WHEN i = 0 THEN {c(init[s])} ELSE {NONE} END')} AS p{s}" for s in range(3))},
               {", ".join(f"{_list(NONE)} AS q{s}" for s in range(3))}, {", ".join(f"{_list('0::TINYINT')} AS w{s}" for s in range(3))}
        FROM l
        UNION ALL
        SELECT family, a, b, x, y, m, n, e, o, d + 1, {", ".join(_list(value) for value in values)}, {names("p")}, {", ".join(_list(f"CAST({w} AS TINYINT)") for w in came)}
        FROM v WHERE d < m + n),
    steps AS MATERIALIZED (SELECT family, a, b, d, w0, w1, w2 FROM v),
    back AS (
        SELECT family, a, b, m AS i, n AS j, CASE WHEN {ends[0]} = {most} THEN 0 WHEN {ends[1]} = {most} THEN 1 ELSE 2 END AS state, 0 AS nth
        FROM v WHERE d = m + n
        UNION ALL
        SELECT k.family, k.a, k.b, CASE WHEN state <> 2 THEN i - 1 ELSE i END, CASE WHEN state <> 1 THEN j - 1 ELSE j END,
               CASE state WHEN 0 THEN s.w0[i + 1] WHEN 1 THEN s.w1[i + 1] ELSE s.w2[i + 1] END, nth + 1
        FROM back k JOIN steps s ON s.family = k.family AND s.a = k.a AND s.b = k.b AND s.d = k.i + k.j
        WHERE i + j > 0),
    walk AS (
        SELECT family, a, b, nth, substring('BXY', state + 1, 1) AS step, CASE WHEN state = 0 THEN x[i] END AS p, CASE WHEN state = 0 THEN y[j] END AS q
        FROM back JOIN l USING (family, a, b) WHERE i + j > 0),
    measured AS (
        SELECT family, a, b, CAST(count(*) AS INTEGER) AS path_len, string_agg(step, '' ORDER BY nth DESC) AS path,
               count_if(p = q) / count(*) AS identity, coalesce(sum({emission}[(p - 1) * {k} + q]), 0) / count(*) AS emission,
               coalesce(sum({score}[(p - 1) * {k} + q]), 0) / count(*) AS score
        FROM walk GROUP BY family, a, b),
    named AS (SELECT measured.*, x.residues || '-' || y.residues AS pair FROM measured JOIN b x ON x.family = measured.family AND x.label = a JOIN b y ON y.family = measured.family AND y.label = measured.b)
    {last}"""


def expected_counts_sql() -> str:
    """Expected use of the pair-HMM's parameters in each pair: init:s, move:s:r, pair:xy, single:x."""
    import numpy as np

    model = PairModel()
    k, t, init = len(ALPHABET), model.transitions(), np.log(model.init)
    c = lambda v: f"({float(v)!r})"
    on = lambda x, y, d: f"{x}.family = {y}.family AND {x}.a = {y}.a AND {x}.b = {y}.b AND {y}.d = {x}.d + {d}"
    # f of a cell of diagonal f.d goes into g of the next one, or of the one after by a match
    into = [f"(CASE WHEN i < f.m AND f.d - i < f.n THEN f.e[(f.x[i + 1] - 1) * {k} + f.y[f.d - i + 1]] + g2.r0[i + 2] ELSE {NONE} END)"]
    for s in range(1, 5):
        into.append(f"(CASE WHEN i < f.m THEN f.o[f.x[i + 1]] + g1.r{s}[i + 2] ELSE {NONE} END)" if s % 2 else f"(CASE WHEN f.d - i < f.n THEN f.o[f.y[f.d - i + 1]] + g1.r{s}[i + 1] ELSE {NONE} END)")
    moves = [(s, r) for s in range(5) for r in range(5) if t[s, r] > -1e30]
    inside = "i BETWEEN f.d - f.n AND f.d"
    each = ", ".join(f"sum(list_sum(list_transform(range(0, f.m + 1), lambda i: CASE WHEN {inside} THEN exp(f.p{s}[i + 1] + {c(t[s, r])} + {into[r]} - total) ELSE 0 END))) AS v{s}{r}" for s, r in moves)
    starts = [f"exp({c(init[0])} + g1.e[(g1.x[1] - 1) * {k} + g1.y[1]] + g2.r0[2] - total)"]
    starts += [f"exp({c(init[s])} + g1.o[g1.x[1]] + g1.r{s}[2] - total)" if s % 2 else f"exp({c(init[s])} + g1.o[g1.y[1]] + g1.r{s}[1] - total)" for s in range(1, 5)]
    ends = [f"exp(f.p{s}[f.m + 1] + {c(init[s])} - total)" for s in range(5)]
    letter = f"substring('{ALPHABET}', {{}}::BIGINT, 1)"
    shares = ", ".join(f"exp(f.p{s}[i + 1] + g.r{s}[i + 1] - total) AS s{s}" for s in range(5))
    parts = [f"SELECT family, a, b, 'move:{s}:{r}' AS key, v{s}{r} AS value FROM moves" for s, r in moves]
    parts += [f"SELECT family, a, b, 'init:{s}' AS key, v{s} AS value FROM ends" for s in range(5)]
    parts.append("SELECT family, a, b, 'pair:' || least(p, q) || greatest(p, q) AS key, sum(s0) AS value FROM shares WHERE i > 0 AND j > 0 GROUP BY ALL")
    parts.append("SELECT family, a, b, 'single:' || x AS key, sum(v) AS value FROM (SELECT family, a, b, p AS x, s1 + s3 AS v FROM shares WHERE i > 0 UNION ALL SELECT family, a, b, q, s2 + s4 FROM shares WHERE j > 0) GROUP BY ALL")
    return f"""WITH RECURSIVE {hmm_posterior()},
    moves AS MATERIALIZED (
        SELECT f.family, f.a, f.b, {each}
        FROM f JOIN whole USING (family, a, b) JOIN g g1 ON {on("f", "g1", 1)} LEFT JOIN g g2 ON {on("f", "g2", 2)} GROUP BY f.family, f.a, f.b),
    ends AS MATERIALIZED (
        SELECT f.family, f.a, f.b, {", ".join(f"{x} + {y} AS v{s}" for s, (x, y) in enumerate(zip(starts, ends, strict=True)))}
        FROM f JOIN whole USING (family, a, b) JOIN g g1 USING (family, a, b) JOIN g g2 USING (family, a, b) WHERE f.d = f.m + f.n AND g1.d = 1 AND g2.d = 2),
    shares AS MATERIALIZED (
        SELECT f.family, f.a, f.b, i, f.d - i AS j, {letter.format("x[i]")} AS p, {letter.format("y[f.d - i]")} AS q, {shares}
        FROM (SELECT *, unnest(range(greatest(0, d - n), least(m, d) + 1)) AS i FROM f WHERE d > 0) f
             JOIN (SELECT family, a, b, d, r0, r1, r2, r3, r4 FROM g) g ON {on("f", "g", 0)} JOIN whole ON whole.family = f.family AND whole.a = f.a AND whole.b = f.b)
    SELECT family, a, b, key, round(value, 6) AS value FROM ({" UNION ALL ".join(parts)})"""
