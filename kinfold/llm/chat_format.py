"""Preference formatting of chosen and rejected conversations.

The turns on which both conversations of a pair agree from the start are the prompt and are
rendered once. What follows in each is its completion; both completions stand side by side,
turn by turn, each with its mask: only what the assistant says is trained on. All steps are joins
and aggregates over single turns, so a conversation of any length spreads over tasks; only
DataFrame functions are used. Marks of the template inside a text are escaped, so that a
rendered turn can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.common import hex_sha256

PROMPT, COMPLETION, CHOSEN, REJECTED = "prompt", "completion", "chosen", "rejected"
TRAINED_ROLE = "assistant"
HEADER, END = "<|%s|>\n", "<|end|>\n"


def _turns(conversations: DataFrame, side: str) -> DataFrame:
    return conversations.select(
        "pair_id",
        F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.lit(side).alias("side"),
    )


def first_difference(turns: DataFrame) -> DataFrame:
    """pair_id, first: the smallest turn on which the two sides differ; no row where they are the same.

    The rows of a turn are compared by digests of role and text, as often as each occurs.
    """
    digest = F.unhex(hex_sha256(F.concat_ws("\n", F.length("role").cast("string"), "role", "text")))
    light = turns.select("pair_id", "turn", "side", digest.alias("digest"))
    here = lambda side: F.when(F.col("side") == side, F.col("digest"))
    # a null stands for nothing here, so the sums of hashes are those of the side alone
    mark = lambda side: F.sum(F.when(F.col("side") == side, F.xxhash64("digest").cast("decimal(38,0)")))
    facts = [f for side in (CHOSEN, REJECTED) for f in (F.min(here(side)), F.max(here(side)), F.count(here(side)), mark(side))]
    of_turn = light.groupBy("pair_id", "turn").agg(*[x.alias(f"f{k}") for k, x in enumerate(facts)])
    same = F.lit(True)
    for k in range(4):
        same = same & F.col(f"f{k}").eqNullSafe(F.col(f"f{k + 4}"))
    return of_turn.filter(~same).groupBy("pair_id").agg(F.min("turn").alias("first"))


def escaped(text: Column) -> Column:
    """text with one more backslash inside each <| (or <\\|, ...), so that no mark of the template is left."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def _role(role: Column) -> Column:
    return F.regexp_replace(role, r"\|(\\*)>", r"|$1\\>")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.format_string(HEADER, _role(role)), escaped(text), F.lit(END))


def format_preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row for each turn of the prompt and of the completions of two tables (pair_id, turn, role, text, any others).

    pair_id, part (prompt or completion), turn, nth, prompt, chosen, rejected and, for each
    completion, masked and trained characters: of the rendered turn the first chosen_masked
    characters are no target, the chosen_trained that follow are. In order of turn and nth the
    rendered turns of a column make its text. A turn that one completion lacks is null there, with
    no characters. A null turn counts as -1, a null role or text as empty; rows that repeat a turn
    number are compared together, as often as each occurs, and numbered by nth in order of role
    and text. A pair of equal conversations has a prompt alone; one side missing leaves no prompt.
    Rows without a pair_id are one pair. Empty tables give an empty result.
    """
    turns = _turns(chosen, CHOSEN).unionByName(_turns(rejected, REJECTED))
    first = first_difference(turns).withColumnRenamed("pair_id", "of_pair")
    joined = turns.join(first, turns["pair_id"].eqNullSafe(first["of_pair"]), "left")
    shared = F.col("first").isNull() | (F.col("turn") < F.col("first"))
    rows = joined.filter(~shared | (F.col("side") == CHOSEN)).withColumn("part", F.when(shared, PROMPT).otherwise(COMPLETION))
    order = Window.partitionBy("pair_id", "turn", "side").orderBy("role", "text")
    rows = rows.select("pair_id", "part", "turn", "side", "role", F.row_number().over(order).alias("nth"), rendered(F.col("role"), F.col("text")).alias("rendered"))
    header = F.length(F.format_string(HEADER, _role(F.col("role"))))
    trained = F.when(F.col("role") == TRAINED_ROLE, F.length("rendered") - header).otherwise(0)
    rows = rows.withColumn("trained", trained.cast("long")).withColumn("masked", F.length("rendered") - F.col("trained"))
    # a turn of either side is one row, so the aggregates only put the two sides beside each other
    of = lambda side, value: F.when((F.col("part") == COMPLETION) & (F.col("side") == side), F.col(value))
    columns = [F.max(F.when(F.col("part") == PROMPT, F.col("rendered"))).alias(PROMPT), *[F.max(of(side, "rendered")).alias(side) for side in (CHOSEN, REJECTED)]]
    columns += [F.coalesce(F.max(of(side, value)), F.lit(0)).cast("long").alias(f"{side}_{value}") for side in (CHOSEN, REJECTED) for value in ("masked", "trained")]
    return rows.groupBy("pair_id", "part", "turn", "nth").agg(*columns)


def assemble(segments: DataFrame) -> DataFrame:
    """One row for each pair: the texts prompt, chosen, rejected and the masks of the completions.

    segments: rows of format_preferences. A mask is an array of struct(masked, trained), by turn. A
    pair becomes one value here, so this is for conversations that a trainer can hold;
    format_preferences has no such bound. Rows without a pair_id are one pair; a pair without
    completions has empty texts and masks; no rows give no pairs.
    """
    rows = segments.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("turn", "nth", PROMPT, CHOSEN, REJECTED, *[f"{s}_{v}" for s in (CHOSEN, REJECTED) for v in ("masked", "trained")]))).alias("turns"))
    text = lambda p: F.array_join(F.transform("turns", lambda t: F.coalesce(t[p], F.lit(""))), "").alias(p)
    mask = lambda p: F.transform(F.filter("turns", lambda t: t[p].isNotNull()), lambda t: F.struct(t[f"{p}_masked"].alias("masked"), t[f"{p}_trained"].alias("trained"))).alias(f"{p}_mask")
    return rows.select("pair_id", text(PROMPT), text(CHOSEN), text(REJECTED), mask(CHOSEN), mask(REJECTED))


def last_turn_pairs(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected turns from conversations (conv_id, turn, role, text) without preferences.

    Chosen is the conversation itself; rejected has its last turn's text replaced by the last
    text of conversation conv_id + 1, or lacks that turn if there is no such conversation. A null
    turn counts as -1; rows that share the last turn number all get the other text, the greatest of
    equals in text order counts as last; rows without a conv_id are one conversation without a
    next one; an empty table gives two empty ones.
    """
    turns = conversations.select(F.col("conv_id").cast("long").alias("pair_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), "role", "text")
    last = turns.groupBy("pair_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    other = last.select((F.col("pair_id") - 1).alias("pair_id"), F.col("last.text").alias("other_text"), F.lit(True).alias("has_other"))
    ends = last.select("pair_id", F.col("last.turn").alias("last_turn")).join(other, "pair_id", "left")
    joined = turns.alias("t").join(ends.alias("e"), F.col("t.pair_id").eqNullSafe(F.col("e.pair_id")), "left")
    ending = F.col("t.turn") == F.col("e.last_turn")
    rejected = joined.filter(~ending | F.coalesce("has_other", F.lit(False))).select("t.pair_id", "t.turn", "t.role", F.when(ending, F.col("other_text")).otherwise(F.col("t.text")).alias("text"))
    return turns, rejected
