"""Positions of regular-expression matches, by DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Matches whose positions are summed at once; longer lists are summed in two levels.
BLOCK = 256


def _ends(lengths: Column) -> Column:
    """The running sums of an array of lengths."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    within = lambda part, base: F.aggregate(part, F.struct(base.alias("at"), F.array().cast("array<int>").alias("ends")), lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["ends"], F.array(a["at"] + x)).alias("ends")))["ends"]
    parts = F.transform(F.sequence(F.lit(0), (F.size(lengths) - 1).cast("int"), F.lit(BLOCK)), lambda k: F.slice(lengths, k + 1, F.lit(BLOCK)))
    bases = F.concat(F.array(F.lit(0)), F.aggregate(parts, F.array().cast("array<int>"), lambda a, p: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + total(p)))))
    return F.flatten(F.zip_with(parts, F.slice(bases, F.lit(1), F.size(parts)), within))


def find(text: Column, pattern: str, keep: Callable[[Column, Column], Column] | None = None, group: int = 0, context: bool = False) -> Column:
    """array of struct(start, stop, value, before, after) of the leftmost non-overlapping matches of pattern.

    start and stop count code points; value is the match; before and after, only with context, are
    the text around it, up to the second match on that side and with both these matches. keep, given the
    match and its group, says which matches stay. The text must not be null; the pattern must not
    match the empty string.
    """
    # between and around n matches lie n + 1 pieces; lambda variables hold both, so that they are found once
    whole = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))
    at = lambda array, k: F.coalesce(F.get(array, k), F.lit(""))
    none = F.lit(None).cast("string")

    def with_stops(x: Column) -> Column:
        gaps = F.zip_with(F.slice(x["p"], F.lit(1), F.size(x["m"])), x["m"], lambda b, m: (F.length(b) + F.length(m)).cast("int"))
        return F.struct(x["m"].alias("m"), x["p"].alias("p"), _ends(gaps).alias("stops"))

    def all_spans(x: Column) -> Column:
        def span(match: Column, k: Column) -> Column:
            before = F.concat(at(x["m"], k - 2), at(x["p"], k - 1), at(x["m"], k - 1), at(x["p"], k)) if context else none
            after = F.concat(at(x["p"], k + 1), at(x["m"], k + 1), at(x["p"], k + 2), at(x["m"], k + 2)) if context else none
            stop = F.get(x["stops"], k)
            return F.struct((stop - F.length(match)).cast("int").alias("start"), stop.alias("stop"), match.alias("value"), before.alias("before"), after.alias("after"))

        return F.transform(x["m"], span)

    found = F.transform(F.transform(F.array(whole), with_stops), all_spans)[0]
    if group:
        groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        marked = F.filter(F.zip_with(found, groups, lambda x, g: F.struct(x.alias("x"), g.alias("g"))), lambda y: keep(y["x"]["value"], y["g"]))
        found = F.transform(marked, lambda y: y["x"])
    elif keep:
        found = F.filter(found, lambda x: keep(x["value"], x["value"]))
    empty = F.array().cast("array<struct<start:int,stop:int,value:string,before:string,after:string>>")
    # the second pass over the text is for texts with a match only
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(empty)


def joined(spans: Column) -> Column:
    """kind:start:stop of an array of struct(kind, start, stop), comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))))
