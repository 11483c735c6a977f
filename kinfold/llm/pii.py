"""Personal data: fixed shapes as seeds, and contexts bootstrapped from them.

The seeds (e-mail and IP addresses, card and telephone numbers) are found by shape. The words around
an instance are its lexical patterns: the word before, the two words before, the words before
and after. Patterns and the instances that stand in them, seeds and identifier-like tokens, make a
graph, scored in rounds: a pattern by the share of all its occurrences in the texts that hold a
trusted instance, an instance by the patterns it stands in. A pattern takes part once enough
different instances in it are trusted; instances that become trusted in a round induce further
patterns in the next. What trusted patterns hold are identifiers, though of no known shape.
Only DataFrame functions are used; texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm import spans
from kinfold.llm.common import cut, hex_sha256, marked_by, scratch, stored

ROUNDS = 4
#: Score from which a pattern or an instance is trusted, and different trusted instances that a pattern must have.
CONFIDENCE = 0.5
LEAST_TRUSTED = 3
#: Characters of an identifier of no known shape, at least; it also has a digit.
LEAST_CHARS = 5
#: Kind of the spans that learned patterns find; it comes after the base kinds.
LEARNED = "learned"

#: Fixed shapes: a run of the leading class is tried at its first character only, and no match is taken apart again.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_IDENTIFIER = r"(?<![A-Za-z0-9._/#-])(?=[A-Za-z._/#-]*+[0-9])[A-Za-z0-9](?:[A-Za-z0-9._/#-]*[A-Za-z0-9])?"
#: Opening marks between a word and an identifier that count as blanks.
_MARKS = "\"'([< "
_BLANKS = "\t\n\x0b\x0c\r"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(digits)

    def add(total: Column, at: Column) -> Column:
        digit = F.substring(back, at, F.lit(1)).cast("int")
        double = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when(at % 2 == 0, double).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _card(match: Column, _: Column) -> Column:
    digits = F.translate(match, " -", "")
    return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)


def _phone(match: Column, _: Column) -> Column:
    return F.length(F.translate(match, "+ ().-", "")).between(9, 15)


_KEEP = {"ip": lambda match, _: F.regexp_like(match, F.lit(rf"^{_PART}(?:\.{_PART}){{3}}$")), "card": _card, "phone": _phone}


def _plain(text: Column) -> Column:
    """Lower-cased, each run of white space as one blank."""
    return F.regexp_replace(F.lower(F.translate(text, _BLANKS, " " * len(_BLANKS))), "  +", " ")


def _patterns(before: Column, after: Column) -> Column:
    """The lexical patterns of what stands between two texts: kind and words, joined by blanks."""
    # white space or an opening mark must part a word from the identifier
    left = F.when(F.regexp_like(before, F.lit(r"""[\s"'(\[<]$""")), F.rtrim(_plain(before), F.lit(_MARKS))).otherwise("")
    right = F.when(F.regexp_like(after, F.lit(r"^\s")), F.substring_index(F.ltrim(_plain(after)), " ", 1)).otherwise("")

    def made(words: Column) -> Column:
        last, two = F.substring_index(words["l"], " ", -1), F.trim(F.substring_index(words["l"], " ", -2))
        one = F.when(last != "", F.concat(F.lit("l "), last))
        pair = F.when(F.contains(two, F.lit(" ")), F.concat(F.lit("ll "), two))
        around = F.when((last != "") & (words["r"] != ""), F.concat_ws(" ", F.lit("lr"), last, words["r"]))
        return F.filter(F.array(one, pair, around), lambda x: x.isNotNull())

    return F.transform(F.array(F.struct(left.alias("l"), right.alias("r"))), made)[0]


def marks(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text, base spans and identifier-like tokens, with their patterns."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("body"))

    def of_kind(k: int, kind: str) -> Column:
        found = spans.find(F.col("body"), PATTERNS[kind], _KEEP.get(kind), context=True)
        return F.transform(found, lambda s: F.struct(F.lit(k).alias("order"), F.lit(kind).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), _patterns(s["before"], s["after"]).alias("patterns"), s["value"].alias("instance")))

    tokens = spans.find(F.col("body"), _IDENTIFIER, lambda match, _: F.length(match) >= LEAST_CHARS, context=True)
    tokens = F.transform(tokens, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), _patterns(s["before"], s["after"]).alias("patterns"), s["value"].alias("instance")))
    return rows.select("doc_id", F.unhex(hex_sha256("body")).alias("digest"), F.concat(*[of_kind(k, kind) for k, kind in enumerate(KINDS)]).alias("base"), tokens.alias("tokens"))


def pattern_graph(marked: DataFrame) -> DataFrame:
    """pattern, instance, n, seed: how often an instance stands in a pattern, and whether it is a seed.

    Patterns with fewer than LEAST_TRUSTED different instances can't be trusted and are left out.
    """
    of = lambda column, seed: marked.select(F.explode(column).alias("m")).select(F.explode("m.patterns").alias("pattern"), "m.instance", F.lit(seed).alias("seed"))
    both = of("base", 1).unionByName(of("tokens", 0))
    edges = both.groupBy("pattern", "instance").agg(F.sum("seed").alias("seeds"), F.count("*").alias("all"))
    # a seed that is also one token was counted as both
    edges = stored(edges.select("pattern", "instance", F.greatest("seeds", F.col("all") - F.col("seeds")).alias("n"), (F.col("seeds") > 0).alias("seed")))
    enough = edges.groupBy("pattern").agg(F.count("*").alias("k")).filter(F.col("k") >= LEAST_TRUSTED).select("pattern")
    return edges.join(enough, "pattern")


def pattern_counts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """pattern, total: how often the words of each pattern in wanted stand in the texts, whatever stands between.

    A bitmap of fixed size leaves out nearly all other words before anything is shuffled.
    """
    words = F.split(F.trim(_plain(F.coalesce(F.col("text").cast("string"), F.lit("")))), " ")

    def each(w: Column) -> Column:
        return F.transform(w, lambda x, k: F.struct(x.alias("x"), F.get(w, k + 1).alias("y"), F.get(w, k + 2).alias("z")))

    # a lambda variable holds the words, so that a text is split once
    every = docs.select(F.explode(F.transform(F.array(words), each)[0]).alias("at")).select("at.*").withColumn("mark", F.xxhash64("x"))
    firsts = wanted.select(F.xxhash64(F.split("pattern", " ")[1]).alias("mark"))
    near = marked_by(every, firsts).filter("there").drop("mark", "there")
    # a pattern over a word that isn't there is null
    made = F.array(F.concat(F.lit("l "), "x"), F.concat(F.lit("ll "), "x", F.lit(" "), "y"), F.concat(F.lit("lr "), "x", F.lit(" "), "z"))
    hit = near.select(F.explode(made).alias("pattern")).filter(F.col("pattern").isNotNull()).withColumn("mark", F.xxhash64("pattern"))
    hit = marked_by(hit, wanted.select(F.xxhash64("pattern").alias("mark"))).filter("there").select("pattern")
    return hit.groupBy("pattern").agg(F.count("*").alias("total")).join(wanted, "pattern", "left_semi")


def trusted(edges: DataFrame, docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """pattern, instance: the edges of which both ends are trusted after the given rounds."""
    base = edges.groupBy("pattern").agg(F.sum("n").alias("n"))
    totals = pattern_counts(docs, edges.select("pattern").distinct())
    base = base.join(totals, "pattern", "left").select("pattern", F.greatest(F.coalesce("total", "n"), F.col("n")).alias("total"))
    graph = cut(edges.join(base, "pattern"))
    now = graph.withColumn("trust", F.col("seed").cast("double"))
    for _ in range(rounds):
        patterns = now.groupBy("pattern").agg((F.sum(F.col("n") * F.col("trust")) / F.first("total")).alias("score"), F.count_if(F.col("trust") >= CONFIDENCE).alias("support"))
        patterns = patterns.select("pattern", F.when(F.col("support") >= LEAST_TRUSTED, F.col("score")).otherwise(0.0).alias("score"))
        # an instance is as good as the best pattern it stands in
        instances = graph.join(patterns, "pattern").groupBy("instance").agg(F.max("score").alias("belief"))
        now = graph.join(patterns, "pattern").join(instances, "instance").withColumn("trust", F.when(F.col("seed"), 1.0).otherwise(F.col("belief")))
        now = cut(now.select("pattern", "instance", "n", "seed", "total", "score", "trust"))
    return now.filter(F.col("score") >= CONFIDENCE).select("pattern", "instance")


def discovered(marked: DataFrame, edges: DataFrame) -> DataFrame:
    """digest, learned: of each text with any, the identifiers that trusted edges find."""
    tokens = marked.select("digest", F.explode("tokens").alias("t")).select("digest", "t.start", "t.stop", "t.instance", F.explode("t.patterns").alias("pattern"))
    hits = tokens.join(edges, ["pattern", "instance"], "left_semi").select("digest", "start", "stop").distinct()
    return hits.groupBy("digest").agg(F.collect_list(F.struct("start", "stop")).alias("learned"))  # within one text


def find_personal_data(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row for every row of docs (doc_id, text, any others).

    Returns doc_id, n_email, n_ip, n_card, n_phone, n_learned, n_spans, base_sha256, spans. A null text counts
    as empty. A learned span never overlaps with a base span. Null and repeated doc_ids are
    carried along; an empty table gives an empty result.
    """
    marked = stored(marks(docs))
    with scratch(docs.sparkSession):
        edges = trusted(stored(pattern_graph(marked)), docs, rounds)
        # written, so that the join has two plain exchanges, of which Spark splits that of a hot text
        found = stored(discovered(marked, edges), keep=True)
    rows = marked.select("doc_id", "digest", "base").join(found, "digest", "left")
    free = lambda s: ~F.exists("base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))
    learned = F.filter(F.coalesce("learned", F.array().cast("array<struct<start:int,stop:int>>")), free)
    rows = rows.withColumn("learned", learned)
    narrow = lambda array, order, kind: F.transform(array, lambda s: F.struct(order(s).alias("order"), s["start"].alias("start"), kind(s).alias("kind"), s["stop"].alias("stop")))
    base = narrow("base", lambda s: s["order"], lambda s: s["kind"])
    every = F.concat(base, narrow("learned", lambda _: F.lit(len(KINDS)), lambda _: F.lit(LEARNED)))
    counts = [F.size(F.filter("base", _is(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return rows.select(
        "doc_id",
        *counts,
        F.size("learned").cast("long").alias("n_learned"),
        (F.size("base") + F.size("learned")).cast("long").alias("n_spans"),
        hex_sha256(spans.joined(F.array_sort(base))).alias("base_sha256"),
        spans.joined(F.array_sort(every)).alias("spans"),
    )


def _is(kind: str):
    return lambda s: s["kind"] == kind
