"""URL filtering by rules indexed under their rarest literal token.

Each rule is filed under that of its literal tokens which occurs in the fewest URLs of the
table. A URL's own tokens fetch the rules filed under them, and only those run their regular
expressions on it.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Indexes of at most so many tokens are a constant in the plan; larger ones are joined.
INLINE_TOKENS = 256
ALLOW, BLOCK = "allow", "block"
#: Between host and path, neither of which can hold it.
EDGE = "#"


@dataclass(frozen=True)
class HostRule:
    """Fits host and all its subdomains where the path starts with path; the longest such rule decides."""

    verdict: str
    host: str
    path: str

    @property
    def rule(self) -> str:
        return self.host + self.path

    @property
    def regex(self) -> str:
        return rf"^(?:[^{EDGE}]*\.)?{re.escape(self.host)}{EDGE}{re.escape(self.path)}"

    @property
    def literals(self) -> list[str]:
        """Runs of letters and digits that are whole tokens of every URL the rule fits."""
        whole = f".{self.host}{EDGE}{self.path}"
        return [m.group().lower() for m in re.finditer(r"[A-Za-z0-9]+", whole) if m.end() < len(whole)]


@dataclass(frozen=True)
class PatternRule:
    """Fits where pattern, in which * stands for anything, covers all of host + path; decides where no host rule fits."""

    verdict: str
    pattern: str

    @property
    def rule(self) -> str:
        return self.pattern

    @property
    def regex(self) -> str:
        return "^" + "[\\s\\S]*".join(re.escape(part).replace("/", f"{EDGE}?/") for part in self.pattern.split("*")) + "$"

    @property
    def literals(self) -> list[str]:
        at = [(m, self.pattern) for m in re.finditer(r"[A-Za-z0-9]+", self.pattern)]
        return [m.group().lower() for m, p in at if p[m.start() - 1 : m.start()] != "*" and p[m.end() : m.end() + 1] != "*"]


RULES = (
    HostRule(ALLOW, "org", "/"),
    HostRule(BLOCK, "example.org", "/es/"),
    HostRule(BLOCK, "example.org", "/en/1"),
    HostRule(ALLOW, "com", "/fr/"),
    HostRule(BLOCK, "com", "/de/"),
)
#: Where no rule fits: URLs of pages that are rarely prose.
PATTERNS = tuple(PatternRule(BLOCK, f"*/{word}/*") for word in ("casino", "phishing", "tracking", "adserver", "warez"))


def read_rules(table: DataFrame) -> tuple[tuple[HostRule, ...], tuple[PatternRule, ...]]:
    """Host rules and patterns of a table (kind, verdict, target, path); rows with another kind or a null target are left out.

    kind is host or pattern; target is the host, or the pattern with * for anything; a null path
    stands for all paths. Any file that Spark reads will do. Rules are a list that one regular
    expression each is made of, so they are bounded by what the driver holds.
    """
    rows = table.select("kind", F.lower("verdict").alias("verdict"), "target", F.coalesce("path", F.lit("")).alias("path"))
    rows = rows.filter(F.col("verdict").isin(ALLOW, BLOCK) & F.col("target").isNotNull()).distinct().collect()
    hosts = tuple(HostRule(r["verdict"], r["target"].lower(), r["path"]) for r in rows if r["kind"] == "host")
    return hosts, tuple(PatternRule(r["verdict"], r["target"]) for r in rows if r["kind"] == "pattern")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    found = F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(target: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(target), F.lit("[a-z0-9]+"), 0))


def index_rules(urls: DataFrame, rules) -> dict[str, list[dict]]:
    """token -> the rules filed under it. urls: a column target. Rules without a literal token go under ''.

    Counts cover all rows; what reaches the driver has one row for each token of the rules.
    """
    words = {w for r in rules for w in r.literals}
    counts = {}
    if words:
        of_rules = F.array(*map(F.lit, sorted(words)))
        seen = urls.select(F.explode(F.array_intersect(_tokens(F.col("target")), of_rules)).alias("token"))
        counts = {r["token"]: r["count"] for r in seen.groupBy("token").count().collect()}
    index: dict[str, list[dict]] = {}
    for r in rules:
        rarest = min(r.literals, key=lambda w: (counts.get(w, 0), w), default="")
        index.setdefault(rarest, []).append({"regex": r.regex, "rule": r.rule, "verdict": r.verdict, "decides": isinstance(r, HostRule), "length": len(r.rule)})
    return index


_ENTRY = "struct<regex:string,rule:string,verdict:string,decides:boolean,length:int>"


def _judged(fitting: Column, default: str) -> list[Column]:
    """rule and verdict from the array of fitting rules: the longest host rule, else the longest pattern."""
    best = lambda decides: F.array_max(F.transform(F.filter(fitting, lambda r: r["decides"] == decides), lambda r: F.struct(r["length"], r["rule"], r["verdict"])))
    by_rule, by_pattern = best(True), best(False)
    return [by_rule["rule"].alias("rule"), F.coalesce(by_rule["verdict"], by_pattern["verdict"], F.lit(default)).alias("verdict")]


def filter_urls(pages: DataFrame, rules=RULES, patterns=PATTERNS, default: str = ALLOW, inline_tokens: int = INLINE_TOKENS) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages (page_id, url, any others).

    A null url, or one without ://, has an empty host and path, which no host rule fits.
    Of fitting host rules the longest decides, of equally long ones the greater in text order;
    where none fits, rule is null and the longest fitting pattern gives the verdict, else default.
    Repeated and null page_ids are judged row by row; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = urls.withColumn("target", F.concat("host", F.lit(EDGE), "path"))
    index = index_rules(urls, [*rules, *patterns])
    if len(index) <= inline_tokens:
        found = F.array(F.lit(None).cast(_ENTRY))
        if index:
            held = F.from_json(F.lit(json.dumps(index)), f"map<string,array<{_ENTRY}>>")
            tokens = F.concat(F.array_intersect(_tokens(F.col("target")), F.array(*map(F.lit, sorted(index)))), F.array(F.lit("")))
            found = F.flatten(F.transform(tokens, lambda t: F.coalesce(held[t], F.array().cast(f"array<{_ENTRY}>"))))
        fitting = F.filter(found, lambda r: F.coalesce(F.regexp_like(F.col("target"), r["regex"]), F.lit(False)))
        return urls.withColumn("fitting", fitting).select("page_id", "host", "path", *_judged(F.col("fitting"), default))
    entries = spark.createDataFrame([(t, *(e[k] for k in ("regex", "rule", "verdict", "decides", "length"))) for t, es in index.items() for e in es], "token string, regex string, rule string, verdict string, decides boolean, length int")
    tokens = urls.select("target").distinct().select("target", F.explode(F.concat(_tokens(F.col("target")), F.array(F.lit("")))).alias("token"))
    hits = tokens.join(entries, "token").filter(F.regexp_like("target", F.col("regex")))
    fitting = hits.groupBy("target").agg(F.collect_list(F.struct("regex", "rule", "verdict", "decides", "length")).alias("fitting"))
    empty = F.array().cast(f"array<{_ENTRY}>")
    return urls.join(fitting, "target", "left").withColumn("fitting", F.coalesce("fitting", empty)).select("page_id", "host", "path", *_judged(F.col("fitting"), default))
