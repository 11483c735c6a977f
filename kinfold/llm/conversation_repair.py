"""Conversation repair by a lazily determinised weighted automaton.

The cheapest ways to finish a conversation from each of four states (nothing yet, after the system
turn, after a user turn, after an assistant turn) form a vector of costs. Less its minimum, such a
vector is a state of a deterministic automaton that reads turns from the last to the first. Its
states and transitions are made when they are first met and are looked up from then on; the offsets
on the way add up to the cost. From the first turn on, arcs whose cost is tight lead back through
the scanned states and give the edits, the least in ASCII order where several are cheapest.

A conversation may hold a large part of all rows. Its turns are cut into units of bounded size. The
cost of a unit from each state to each is a matrix of 16 numbers; these are chained by conversation,
and so are the states that units are left in. Units themselves are scanned and traced side by side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import pieces, release, shuffle_partitions, stored

REROLE, DELETE, INSERT, LEFT_TRUNCATED = 1, 2, 5, 5
#: Turns, and bytes of their text, of a unit at most; a longer text goes alone.
UNIT_TURNS, UNIT_BYTES = 4096, 1 << 20

START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a user or assistant turn that is inserted or given its role.
GROWN = (USER, USER, ASSISTANT, USER)
#: State after a kept turn, by its role's initial.
KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
NAMES = {USER: "user", ASSISTANT: "assistant"}
_INITIALS = "sua-"
#: Symbols: two for each initial (whole, truncated), and turns that must go.
MUST_GO = 2 * len(_INITIALS)
_NEVER = 1 << 60
_WHITE_SPACE = " \t\n\x0b\x0c\r"

Vector = tuple[int, ...]


def _with_inserts(v: Vector) -> Vector:
    user, assistant = min(v[USER], INSERT + v[ASSISTANT]), min(v[ASSISTANT], INSERT + v[USER])
    return min(v[START], INSERT + user, _NEVER), min(v[SYSTEM], INSERT + user, _NEVER), min(user, _NEVER), min(assistant, _NEVER)


#: Costs at the end of a conversation.
END = _with_inserts((0, _NEVER, _NEVER, 0))
#: Costs where a unit may only be left in one state.
EXITS = tuple(_with_inserts(tuple(0 if q == k else _NEVER for q in range(4))) for k in range(4))


def _arcs(symbol: int, q: int) -> Iterator[tuple[str, int, int]]:
    """Letter, cost and next state of what can be done with a turn, in ASCII order of the letters."""
    yield "D", DELETE, q
    if symbol != MUST_GO:
        extra = LEFT_TRUNCATED if symbol & 1 else 0
        if (after := KEPT[q].get(_INITIALS[symbol >> 1])) is not None:
            yield "K", extra, after
        yield "R", extra + REROLE, GROWN[q]


def _before(v: Vector, symbol: int) -> Vector:
    return _with_inserts(tuple(min(cost + v[after] for _, cost, after in _arcs(symbol, q)) for q in range(4)))


class Automaton:
    """States are vectors less their minimum; the table is filled as it is used."""

    def __init__(self) -> None:
        self.vectors: list[Vector] = []
        self._ids: dict[Vector, int] = {}
        self._table: list[list[tuple[int, int] | None]] = []
        self._traced: dict[tuple[int, int, int], tuple[str, int]] = {}

    def state(self, v: Vector) -> tuple[int, int]:
        """Number of a vector's state, and the offset."""
        low = min(v)
        v = tuple(x - low if x < _NEVER else _NEVER for x in v)
        if (found := self._ids.get(v)) is None:
            found = self._ids[v] = len(self.vectors)
            self.vectors.append(v)
            self._table.append([None] * (MUST_GO + 1))
        return found, low

    def scan(self, symbols: bytes, end: Vector) -> tuple[list[int], int]:
        """States after each turn, from the one before the first turn on, and the sum of offsets at the first."""
        at, total = self.state(end)
        found = [at]
        table = self._table
        for symbol in reversed(symbols):
            if (arc := table[at][symbol]) is None:
                arc = table[at][symbol] = self.state(_before(self.vectors[at], symbol))
            at, offset = arc
            total += offset
            found.append(at)
        return found[::-1], total

    def costs(self, symbols: bytes, end: Vector) -> Vector:
        states, total = self.scan(symbols, end)
        return tuple(min(x + total, _NEVER) for x in self.vectors[states[0]])

    def step(self, after: int, symbol: int, q: int) -> tuple[str, int]:
        """Letters of the cheapest edits up to and with a turn, from q, and the state they lead to."""
        if (found := self._traced.get((after, symbol, q))) is None:
            v, letters, at = self.vectors[after], "", q
            w = _before(v, symbol)
            while True:
                tight = [(letter, to) for letter, cost, to in _arcs(symbol, at) if w[at] == cost + v[to]]
                if w[at] == INSERT + w[GROWN[at]]:
                    tight.append(("I", -1))
                letter, to = min(tight)
                letters += letter
                if letter != "I":
                    break
                at = GROWN[at]
            found = self._traced[after, symbol, q] = letters, to
        return found

    def trace(self, symbols: bytes, end: Vector, q: int) -> Iterator[str]:
        """The letters of each turn."""
        states, _ = self.scan(symbols, end)
        for k, symbol in enumerate(symbols):
            letters, q = self.step(states[k + 1], symbol, q)
            yield letters

    def exits(self, symbols: bytes, end: Vector) -> list[int]:
        """The state in which the trace from each state ends; -1 where none leads on."""
        states, _ = self.scan(symbols, end)
        found = []
        for q in range(4):
            if self.vectors[states[0]][q] >= _NEVER:
                found.append(-1)
                continue
            for k, symbol in enumerate(symbols):
                _, q = self.step(states[k + 1], symbol, q)
            found.append(q)
        return found


def closing(q: int) -> str:
    """Inserts at the end of a conversation."""
    return {SYSTEM: "II", USER: "I"}.get(q, "")


def edited(letters: str, q: int, role: str, text: str) -> tuple[list[str], int]:
    """Lines that a turn's letters make, and the state after them."""
    lines = []
    for letter in letters:
        if letter == "D":
            continue
        q = KEPT[q][role[:1]] if letter == "K" else GROWN[q]
        lines.append(f"{role}:{text}" if letter == "K" else f"{NAMES[q]}:{text if letter == 'R' else ''}")
    return lines, q


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: what a fixed rule of twenty makes of every row; null roles and texts become a blank.

    The rule is crc32 of "conv_id:turn", null as a blank, divided by 20: 0 drops the row, 1 empties
    the text, 2 removes . ! ? from it, 3 repeats the row, 4 makes the role user.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), shown("role").alias("role"), shown("text").alias("text"))
    rule = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    rows = rows.withColumn("rule", rule).filter("rule <> 0")
    text = F.when(F.col("rule") == 1, "").when(F.col("rule") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("rule") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("rule") == 3, 2).otherwise(1).alias("copies"))


def marked(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, digest, copies, blank, symbol of each different turn. Stored.

    rows: conv_id, turn, role, text, copies. Equal rows of one turn are one with their number of
    copies; of these the first has the symbol and the others must go.
    """
    each = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("digest", F.sha2("text", 256))
    place = F.struct(F.col("turn").isNotNull().alias("given"), "turn")
    keyed = each.select("*", F.struct("conv_id", "role", "digest").alias("content"), place.alias("place"))
    first = keyed.groupBy("content").agg(F.min("place").alias("first"))
    trimmed = F.rtrim("text", F.lit(_WHITE_SPACE))
    initial = F.coalesce(F.nullif(F.position(F.substring("role", 1, 1), F.lit(_INITIALS[:3])), F.lit(0)), F.lit(4)) - 1
    initial = F.when(F.col("role") == "", 3).otherwise(initial)
    truncated = (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).cast("int")
    found = keyed.join(first, "content").withColumn("blank", trimmed == "")
    symbol = F.when(F.col("blank") | (F.col("place") != F.col("first")), MUST_GO).otherwise(2 * initial + truncated)
    return stored(found.select("conv_id", "turn", "role", "text", "digest", "copies", "blank", symbol.cast("int").alias("symbol")))


_UNIT = (
    "conv_id long, part int, seq long, symbols binary, copies array<long>, roles array<string>, texts array<string>, costs array<long>, "
    "low long, high long, turns long, first_turn long, last_turn long, opens string, closes string, blank long, duplicate long, truncated long, illegal long"
)
_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}


def _records(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), _ARROW[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


_LEGAL = {"su", "ua", "au"}


def _unit(conv_id, part: int, seq: int, turns: list[tuple], automaton: Automaton) -> tuple:
    """turns: turn, role, text, copies, blank, symbol. What must go has no text any more."""
    at, roles, texts, copies, blanks, symbols = (list(x) for x in zip(*turns, strict=True))
    code = bytes(symbols)
    given = [t for t in at if t is not None]
    initials = [r[:1] for r in roles]
    illegal = sum(n - 1 for n in copies) + sum(x + y not in _LEGAL for x, y in zip(initials, initials[1:], strict=False))
    blank = sum(n for n, b in zip(copies, blanks, strict=True) if b)
    duplicate = sum(n - (s != MUST_GO) for n, b, s in zip(copies, blanks, symbols, strict=True) if not b)
    copied = DELETE * sum(n - 1 for n in copies)
    costs = [min(automaton.costs(code, e)[q] + copied, _NEVER) for q in range(4) for e in EXITS]
    gone = [s == MUST_GO for s in symbols]
    roles, texts = [None if g else r for g, r in zip(gone, roles, strict=True)], [None if g else t for g, t in zip(gone, texts, strict=True)]
    truncated = sum(s != MUST_GO and s & 1 for s in symbols)
    return (conv_id, part, seq, code, copies, roles, texts, costs, min(given, default=None), max(given, default=None), len(set(given)), at[0], at[-1], initials[0], initials[-1], blank, duplicate, truncated, illegal)


def units(turns: DataFrame, unit_turns: int = UNIT_TURNS) -> DataFrame:
    """The turns of marked in order, cut into units; a conversation's units follow each other by part and seq. Stored."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, automaton = TaskContext.get().partitionId(), 0, Automaton()
        held, size, current = [], 0, None
        for batch in pieces(batches):
            done = []
            for conv_id, *turn in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (conv_id != current or len(held) >= unit_turns or size >= UNIT_BYTES):
                    done.append(_unit(current, part, seq, held, automaton))
                    held, size, seq = [], 0, seq + 1
                current = conv_id
                held.append(tuple(turn))
                size += len(turn[2])
            if done:
                yield _records(done, _UNIT)
        if held:
            yield _records([_unit(current, part, seq, held, automaton)], _UNIT)
        release()

    order = ["conv_id", "turn", "role", "digest"]  # nulls first
    in_order = turns.repartitionByRange(shuffle_partitions(turns.sparkSession), *order).sortWithinPartitions(*order)
    return stored(in_order.select("conv_id", "turn", "role", "text", "copies", "blank", "symbol").mapInArrow(cut, _UNIT))


def _chained(df: DataFrame, back: bool, make: Callable, schema: str) -> DataFrame:
    """make(conversations) over each conversation's rows one after the other; rows are dicts in the order of units."""
    order = ["conv_id", *(F.col(c).desc() if back else F.col(c) for c in ("part", "seq"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = make()
        for batch in pieces(batches):
            found = [x for row in batch.to_pylist() for x in chain(row)]
            if found:
                yield _records(found, schema)
        if found := list(chain(None)):
            yield _records(found, schema)
        release()

    return df.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, schema)


def _costs_back() -> Callable:
    """part, seq, the costs after each unit, and the cost before it of a conversation that starts there; from the last unit to the first."""
    state: dict = {"of": (), "costs": END}

    def chain(row: dict | None) -> Iterator[tuple]:
        if row is None:
            return
        if state["of"] != (row["conv_id"],):
            state.update(of=(row["conv_id"],), costs=END)
        after, m = state["costs"], row["costs"]
        state["costs"] = _with_inserts(tuple(min(min(m[4 * q + k] + after[k] for k in range(4)), _NEVER) for q in range(4)))
        yield row["part"], row["seq"], list(after), state["costs"][START]

    return chain


def _states_on() -> Callable:
    """part, seq and the state before each unit, from the first unit to the last."""
    state: dict = {"of": (), "q": START}

    def chain(row: dict | None) -> Iterator[tuple]:
        if row is None:
            return
        if state["of"] != (row["conv_id"],):
            state.update(of=(row["conv_id"],), q=START)
        yield row["part"], row["seq"], state["q"]
        state["q"] = row["exits"][state["q"]]

    return chain


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = Automaton()
    for batch in pieces(batches):
        rows = [(r["conv_id"], r["part"], r["seq"], automaton.exits(r["symbols"], tuple(r["after"]))) for r in batch.to_pylist()]
        yield _records(rows, "conv_id long, part int, seq long, exits array<int>")


_SUMS = "low long, high long, turns long, first_turn long, last_turn long, opens string, closes string, blank long, duplicate long, truncated long, illegal long"
_DONE = f"conv_id long, part int, seq long, cost long, audit string, lines string, n_lines long, q int, {_SUMS}"


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = Automaton()
    sums = [c.split()[0] for c in _SUMS.split(", ")]
    for batch in pieces(batches):
        rows = []
        for r in batch.to_pylist():
            q, audit, lines = r["q"], [], []
            for letters, n, role, text in zip(automaton.trace(r["symbols"], tuple(r["after"]), q), r["copies"], r["roles"], r["texts"], strict=True):
                more, q = edited(letters, q, role or "", text or "")
                lines += more
                audit.append(letters + "D" * (n - 1))
            rows.append((r["conv_id"], r["part"], r["seq"], r["cost"], "".join(audit), "\n".join(lines), len(lines), q, *(r[c] for c in sums)))
        yield _records(rows, _DONE)
    release()


_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _joined() -> Callable:
    """One row of the result for each conversation; its lines pass by unit after unit and only their hash is held."""
    now: dict = {}

    def finished() -> Iterator[tuple]:
        if now:
            tail = closing(now["q"])
            lines, _ = edited(tail, now["q"], "", "")
            put(lines)
            gaps = now["high"] - now["low"] + 1 - now["turns"] if now["low"] is not None else 0
            yield now["conv_id"], gaps, *(now[c] for c in _COUNTS), now["cost"], "".join(now["audit"]) + tail, now["hash"].hexdigest()

    def put(lines: list[str]) -> None:
        for x in lines:
            now["hash"].update((("\n" if now["any"] else "") + x).encode())
            now["any"] = True

    def chain(row: dict | None) -> Iterator[tuple]:
        if row is None or not now or now["conv_id"] != row["conv_id"]:
            yield from finished()
            now.clear()
            if row is None:
                return
            now.update({c: row[c] for c in ("conv_id", "cost", "low", "high", "turns", *_COUNTS)}, hash=sha256(), any=False, audit=[])
        else:
            for c in _COUNTS:
                now[c] += row[c]
            now["turns"] += row["turns"] - (row["first_turn"] is not None and row["first_turn"] == now["last_turn"])
            now["illegal"] += now["closes"] + row["opens"] not in _LEGAL
            now["low"] = row["low"] if now["low"] is None else now["low"]
            now["high"] = now["high"] if row["high"] is None else row["high"]
        now.update(last_turn=row["last_turn"], closes=row["closes"], q=row["q"])
        now["audit"].append(row["audit"])
        put([row["lines"]] if row["n_lines"] else [])

    return chain


def repair_rows(rows: DataFrame, unit_turns: int = UNIT_TURNS) -> DataFrame:
    """The result, without conversations that have no rows, of rows (conv_id, turn, role, text, copies)."""
    cut = units(marked(rows), unit_turns)
    key = ["part", "seq"]
    after = stored(_chained(cut.select("conv_id", *key, "costs"), True, _costs_back, "part int, seq long, after array<long>, cost long"))
    left = cut.select("conv_id", *key, "symbols").join(after.select(*key, "after"), key).select("conv_id", *key, "symbols", "after").mapInArrow(_exits, "conv_id long, part int, seq long, exits array<int>")
    entered = _chained(left, False, _states_on, "part int, seq long, q int")
    known = cut.drop("costs").join(after, key).join(entered, key)
    return _chained(known.mapInArrow(_edited, _DONE), False, _joined, _RESULT)


def repair(conversations: DataFrame, unit_turns: int = UNIT_TURNS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    conversations (conv_id, turn, role, text, any others) are damaged first (see damage). A null
    conv_id is a conversation like any other; turns without a number come first; rows of one turn are
    ordered by role and by the digest of their text, and repeated rows stand side by side. A role that
    is empty, or begins with another letter than s, u and a, can't be kept. A conversation without
    rows has zeros, an empty audit and the hash of nothing; an empty table gives an empty result.
    The audit of a conversation is one value, as long as it has turns.
    """
    found = repair_rows(damage(conversations), unit_turns).withColumn("key", F.struct("conv_id")).drop("conv_id")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumn("key", F.struct("conv_id"))
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", *_COUNTS, "cost")]
    return every.join(found, "key", "left").select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
