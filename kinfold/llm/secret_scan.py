"""Secret scanning over an incremental ledger of blobs.

Every version of every path is addressed by the SHA-256 of its content. The ledger tells of each
blob which rule versions have scanned it and what they found. A run scans only the pairs of blob
and rule version that the ledger lacks, each blob once however many paths hold it, appends them,
and joins the spans back to all paths. Only DataFrame functions are used.

A run that fails leaves the ledger without its rows or, at worst, with some of them; run again, it
scans what is still missing. Pairs that two runs added at the same time count once.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import spans
from kinfold.llm.common import hex_sha256, shared_dir, stored

#: A row for each blob and run that scanned it: the rule versions of that run and their spans.
LEDGER_SCHEMA = "blob_id binary, labels array<string>, spans array<struct<label:string,start:int,stop:int>>"
_SPANS = "array<struct<label:string,start:int,stop:int>>"


@dataclass(frozen=True)
class Rule:
    """Spans where pattern matches and the given group has at least least characters."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def label(self) -> str:
        return f"{self.kind}:{self.version}"

    def spans(self, text: Column) -> Column:
        found = spans.find(text, self.pattern, lambda _, part: F.length(part) >= self.least, self.group)
        return F.transform(found, lambda s: F.struct(F.lit(self.label).alias("label"), s["start"], s["stop"]))


#: The contract's kinds, in its order. A run of hexadecimal digits is tried at its first digit only.
BASE_RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 1, r"(?<![0-9a-f])[0-9a-f]{24,}+", 0, 24),
)
#: Further kinds of secret with a fixed shape.
MORE_RULES = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]*+(?:-----END [A-Z ]{0,40}PRIVATE KEY-----)?"),
    Rule("jwt", 1, r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    Rule("forge", 1, r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36,}+"),
)
RULES = BASE_RULES + MORE_RULES


def blobs(versions: DataFrame) -> DataFrame:
    """blob_id, content of each distinct content of versions; copies are merged before they are shuffled."""
    content = F.coalesce(F.col("content").cast("string"), F.lit(""))
    found = versions.select(F.unhex(hex_sha256(content)).alias("blob_id"), content.alias("content"))
    return found.groupBy("blob_id").agg(F.first("content").alias("content"))


def _labels(rules: tuple[Rule, ...]) -> Column:
    return F.array(*[F.lit(r.label) for r in rules]).cast("array<string>")


def unseen(found: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob_id, content, labels: the blobs of found that some rule version hasn't scanned, and which."""
    done = ledger.groupBy("blob_id").agg(F.flatten(F.collect_list("labels")).alias("done"))  # an entry for each rule version
    due = F.array_except(_labels(rules), F.coalesce("done", F.array().cast("array<string>")))
    return found.join(done, "blob_id", "left").select("blob_id", "content", due.alias("labels")).filter(F.size("labels") > 0)


def scan_blobs(due: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger's rows of unseen blobs: also of those in which nothing is found."""
    none = F.array().cast(_SPANS)
    each = [F.when(F.array_contains("labels", r.label), r.spans(F.col("content"))).otherwise(none) for r in rules]
    return due.select("blob_id", "labels", F.concat(none, *each).alias("spans"))


def findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob_id and the spans of the given rule versions, of every blob of the ledger."""
    every = F.array_distinct(F.flatten(F.collect_list("spans")))
    found = ledger.groupBy("blob_id").agg(every.alias("spans"))
    return found.select("blob_id", F.filter("spans", lambda s: F.array_contains(_labels(rules), s["label"])).alias("spans"))


def on_paths(versions: DataFrame, by_blob: DataFrame) -> DataFrame:
    """Every row of versions with blob_id and the other columns of by_blob, without its content."""
    content = F.coalesce(F.col("content").cast("string"), F.lit(""))
    paths = versions.withColumn("blob_id", F.unhex(hex_sha256(content)))
    return paths.drop("content", *[c for c in by_blob.columns if c != "blob_id"]).join(by_blob, "blob_id", "left")


def open_ledger(spark: SparkSession, path: str | None = None) -> str:
    """Start an empty ledger, in the shared folder if path isn't given; its path."""
    path = path or f"{shared_dir(spark)}/ledgers/{uuid.uuid4().hex}"
    columns = [c.split(" ", 1) for c in LEDGER_SCHEMA.split(", ")]
    spark.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in columns]).write.parquet(path)
    return path


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER_SCHEMA).parquet(path)


def update(versions: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger at ledger_path lacks of versions, append it, and return the ledger."""
    spark = versions.sparkSession
    due = unseen(blobs(versions), read_ledger(spark, ledger_path), rules)
    scan_blobs(due, rules).write.mode("append").parquet(ledger_path)
    return read_ledger(spark, ledger_path)


def scan(versions: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Bring the ledger up to date with versions (content, any others) and join its findings to them.

    A row for every row of versions: its columns but content, blob_id, and spans (array of
    struct(label, start, stop) by the rules given). A null content counts as empty; repeated rows
    are each returned; of an input with columns named blob_id or spans those are replaced; an
    empty table gives an empty result and adds nothing to the ledger.
    """
    # written, so that the join has two plain exchanges, of which Spark splits that of a hot blob
    return on_paths(versions, stored(findings(update(versions, ledger_path, rules), rules)))


def scan_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger_path: str | None = None) -> DataFrame:
    """Scan docs (doc_id, text, any others) through the ledger at ledger_path, or through a new one.

    One row for every row of docs: doc_id, n_<kind> of the base kinds, base_sha256, spans. A null
    text counts as empty. Null and repeated doc_ids are carried along; an empty table gives an
    empty result.
    """
    versions = docs.select("doc_id", F.col("text").alias("content"))
    ledger = update(versions, ledger_path or open_ledger(docs.sparkSession), rules)
    base = tuple(r for r in rules if r in BASE_RULES)

    def sorted_spans(of: tuple[Rule, ...]) -> Column:
        own = F.filter("spans", lambda s: F.array_contains(_labels(of), s["label"]))
        tagged = F.transform(own, lambda s: F.struct(s["start"].alias("start"), F.array_position(_labels(rules), s["label"]).alias("order"), F.substring_index(s["label"], ":", 1).alias("kind"), s["stop"].alias("stop")))
        return spans.joined(F.array_sort(tagged))

    digests = findings(ledger, rules).select(
        "blob_id",
        *[F.size(F.filter("spans", _labelled(r))).cast("long").alias(f"n_{r.kind}") for r in base],
        hex_sha256(sorted_spans(base)).alias("base_sha256"),
        sorted_spans(rules).alias("spans"),
    )
    return on_paths(versions, stored(digests)).drop("blob_id")


def _labelled(rule: Rule):
    return lambda s: s["label"] == rule.label
