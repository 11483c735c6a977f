"""Sequence files: FASTA, MSF and Clustal readers, writers, and a Python data source named fasta."""

from __future__ import annotations

import io
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from urllib.parse import quote, unquote

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from kinfold.functions.residues import clean, fasta_record, valid
from kinfold.sources.paths import listed, open_path

SCHEMA = "family string, label int, header string, residues string"


def _decoded(name: Column) -> Column:
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def family_of(name: Column) -> Column:
    """The family of a file's path, as Spark tells it: that of a folder family=..., else the file's name."""
    path = _decoded(name)
    folder = _decoded(F.regexp_extract(path, "/family=([^/]*)/[^/]*$", 1))
    return F.when(F.regexp_like(path, F.lit("/family=[^/]*/[^/]*$")), folder).otherwise(F.element_at(F.split(path, "/"), -1))


def _shown(files: DataFrame) -> DataFrame:
    return files.filter(~F.startswith("family", F.lit(".")))


def _files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """family, content of each file; Spark skips hidden files."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return _shown(files.select(family_of(F.input_file_name()).alias("family"), F.regexp_replace("value", "\r\n?", "\n").alias("content")))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """path, family, block, at, value: the parts of each file between line ends that a > follows.

    A file is split like any text, so many tasks read a large one. block is where the split begins
    and at grows within it; the first part of a file has its own > if there is one.
    """
    parts = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n>").text(path)
    where = F.input_file_name()
    parts = parts.select(where.alias("path"), family_of(where).alias("family"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    return _shown(parts)


def numbered(records: DataFrame, order: list[str]) -> DataFrame:
    """records with label, a number from 0 within each family in the order of path, block and order.

    Rows are numbered within their block, and blocks by the sums of those before, so no task sees a whole family.
    """
    places = ["family", "path", "block"]
    sizes = records.groupBy(*places).agg(F.count("*").alias("n"))
    before = Window.partitionBy("family").orderBy("path", "block").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select(*places, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    inside = records.withColumn("nth", F.row_number().over(Window.partitionBy(*places).orderBy(*order)))
    return inside.join(begins, places).withColumn("label", (F.col("begin") + F.col("nth") - 1).cast("int")).drop("begin", "nth")


def _fields(record: Column, strip_gaps: bool) -> list[Column]:
    """header, residues, valid of a record without its >."""
    header, body = F.trim(F.regexp_extract(record, r"^([^\n]*)", 1)), F.regexp_extract(record, r"^[^\n]*\n([\s\S]*)$", 1)
    return [header.alias("header"), clean(body, strip_gaps).alias("residues"), valid(clean(body, False)).alias("valid")]


def fasta_records(records: DataFrame, strip_gaps: bool = True) -> DataFrame:
    """family, label, header, residues, valid of the parts of read_records, of FASTA files. Empty records keep their place."""
    text = F.regexp_replace(F.regexp_replace("value", "\r\n?", "\n"), r"^\s*>", "")
    # of the first part only a record counts; its > was not taken away as a mark
    text = F.when(F.col("block") + F.col("first") > 0, F.regexp_replace("value", "\r\n?", "\n")).otherwise(text)
    pieces = records.select("path", "family", "block", "at", F.posexplode(F.split(text, r"\n[ \t]*>")).alias("nth_piece", "record"))
    found = numbered(pieces.filter(F.regexp_like("record", F.lit(r"\S"))), ["at", "nth_piece"])
    return found.select("family", "label", *_fields(F.col("record"), strip_gaps))


def parse_fasta(files: DataFrame, strip_gaps: bool = True) -> DataFrame:
    """family, label, header, residues, valid of files (family, content). Empty records keep their place."""
    parts = F.filter(F.split("content", r"(?m)^[ \t]*>"), lambda x: F.regexp_like(x, F.lit(r"\S")))
    first = F.when(F.regexp_like("content", F.lit(r"^\s*>")), parts).otherwise(F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1))))
    records = files.select("family", F.posexplode(first).alias("label", "record"))
    return records.select("family", "label", *_fields(F.col("record"), strip_gaps))


def parse_raw_fasta(files: DataFrame) -> DataFrame:
    """The lenient form: any line with > begins a record; letters and gaps stay as they are."""
    lines = files.select("family", F.posexplode(F.split("content", "\n")).alias("at", "line"))
    order = Window.partitionBy("family").orderBy("at")
    marked = lines.withColumn("label", F.sum(F.contains("line", F.lit(">")).cast("int")).over(order) - 1).filter("label >= 0")
    body = F.filter(F.array_sort(F.collect_list(F.struct("at", F.trim("line").alias("line"), F.contains("line", F.lit(">")).alias("head")))), lambda x: ~x["head"])
    return marked.groupBy("family", F.col("label").cast("int").alias("label")).agg(F.array_join(F.transform(body, lambda x: x["line"]), "").alias("residues"))


def parse_blocks(files: DataFrame, strip_gaps: bool = True) -> DataFrame:
    """MSF and Clustal: the chunks of each name, in order of lines.

    In MSF the blocks begin after a line // ; a line of Clustal marks, a header line and a count
    at the end of a line are no residues. Residues may have *.
    """
    content = F.regexp_replace("content", r"^[\s\S]*\n//[^\n]*\n", "")
    lines = files.select("family", F.posexplode(F.split(content, "\n")).alias("at", "line"))
    found = lines.filter(F.regexp_like("line", F.lit(r"^\S+\s+\S")) & ~F.regexp_like("line", F.lit(r"(?i)^(CLUSTAL|MSAPROBS|PileUp|!!|Name:)")))
    name = F.regexp_extract("line", r"^(\S+)", 1)
    chunk = F.regexp_replace(F.regexp_extract("line", r"^\S+\s+([A-Za-z.*~\s-]*)", 1), r"[\s]+", "")
    rows = found.select("family", "at", name.alias("header"), F.translate(chunk, "~", "-").alias("chunk"))
    each = rows.groupBy("family", "header").agg(F.min("at").alias("first"), F.array_sort(F.collect_list(F.struct("at", "chunk"))).alias("chunks"))
    residues = clean(F.array_join(F.transform("chunks", lambda c: c["chunk"]), ""), strip_gaps)
    label = (F.row_number().over(Window.partitionBy("family").orderBy("first")) - 1).alias("label")
    return each.select("family", label, "header", residues.alias("residues"), valid(residues, True).alias("valid"))


def read_families(spark: SparkSession, path: str, strip_gaps: bool = True) -> DataFrame:
    """Every file of path as a family: FASTA if its first non-blank line begins with >, else MSF or Clustal.

    Many tasks share a large FASTA file; files of the other kinds are read whole. Files in a folder
    family=... are one family, in the order of their names.
    """
    records = read_records(spark, path)
    first = records.filter("block = 0").groupBy("path").agg(F.min("at").alias("lead"), F.min_by("value", "at").alias("text"), F.count("*").alias("n"))
    # a file that begins with blank lines has a blank first part
    kinds = first.select("path", "lead", F.regexp_like("text", F.lit(r"^\s*>")).alias("marked"), (~F.regexp_like("text", F.lit(r"\S"))).alias("empty"))
    kinds = kinds.withColumn("is_fasta", F.col("marked") | F.col("empty"))
    fasta = records.join(kinds.filter("is_fasta"), "path").withColumn("first", (F.col("at") - F.col("lead")))
    found = fasta_records(fasta, strip_gaps)
    # Spark lists files on the driver too; only those of the other kinds are named here
    others = [r["path"] for r in kinds.filter("NOT is_fasta").select("path").collect()]
    return found.unionByName(parse_blocks(_files(spark, others), strip_gaps)) if others else found


def fasta_texts(rows: DataFrame, order: str = "label") -> DataFrame:
    """family, text: one FASTA text for each family (families are bounded by what one aligner task holds)."""
    record = F.struct(order, fasta_record(F.col("header"), F.col("residues")).alias("record"))
    return rows.groupBy("family").agg(F.array_join(F.transform(F.array_sort(F.collect_list(record)), lambda x: x["record"]), "").alias("text"))


def write_fasta(rows: DataFrame, path: str, order: str = "label") -> None:
    """A folder for each family below path, with one FASTA file."""
    write_texts(fasta_texts(rows, order), path)


def write_texts(texts: DataFrame, path: str) -> None:
    """A folder for each family of texts (family, text) below path, with one file."""
    texts.select(F.expr("rtrim('\n', text)").alias("value"), "family").write.mode("overwrite").partitionBy("family").text(path)


def wrapped(residues: str, width: int = 60) -> str:
    return "".join(residues[k : k + width] + "\n" for k in range(0, len(residues), width))


class FastaSource(DataSource):
    """format("fasta") with the path of a folder, to read, write and stream families (family, label, header, residues).

    Reading has one partition per file; read_families splits large files. Writing puts every family
    into a folder family=... with a file for each task that has rows of it, named by its first label.
    Rows keep their order, so a table is sorted by family and label within its partitions first.
    """

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], schema, overwrite)

    def streamReader(self, schema):
        return _StreamReader(self.options)


def _records_of(root: str, name: str, strip: bool) -> Iterator[tuple]:
    """The records of a file that was listed below root."""
    system, _ = open_path(root)
    folder = name.rsplit("/", 2)[-2:]
    family = unquote(folder[0][7:]) if folder[0].startswith("family=") else folder[-1]
    header, parts, label = None, [], 0
    with system.open_input_stream(name) as raw:
        for line in chain(io.TextIOWrapper(raw, encoding="utf-8"), [">"]):
            if line.lstrip().startswith(">"):
                if header is not None:
                    text = "".join("".join(parts).split()).replace(".", "-").upper()
                    yield family, label, header, text.replace("-", "") if strip else text
                    label += 1
                header, parts = line.lstrip()[1:].strip(), []
            elif header is not None:
                parts.append(line)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.strip = options["path"], str(options.get("stripgaps", "true")).lower() == "true"

    def partitions(self):
        return [InputPartition(x.path) for x in listed(self.path)] or [InputPartition("")]

    def read(self, partition):
        if partition.value:
            yield from _records_of(self.path, partition.value, self.strip)


class _StreamReader(DataSourceStreamReader):
    """Files in the order of when they were last changed; an offset is the last file that was taken.

    A file is taken once it has been there for SETTLE seconds, so that none comes before one that was taken.
    """

    SETTLE = 1.0

    def __init__(self, options):
        self.path, self.strip = options["path"], str(options.get("stripgaps", "true")).lower() == "true"
        self.last: dict | None = None

    def _files(self) -> list[tuple[int, str]]:
        return sorted((x.mtime_ns, x.path) for x in listed(self.path) if x.mtime_ns <= (time.time() - self.SETTLE) * 1e9)

    def initialOffset(self) -> dict:
        return {"changed": 0, "path": ""}

    def latestOffset(self) -> dict:
        files = self._files()
        found = {"changed": files[-1][0], "path": files[-1][1]} if files else self.last or self.initialOffset()
        self.last = max(found, self.last or self.initialOffset(), key=lambda x: (x["changed"], x["path"]))
        return self.last

    def partitions(self, start: dict, end: dict):
        low, high = (start["changed"], start["path"]), (end["changed"], end["path"])
        return [InputPartition(p) for t, p in self._files() if low < (t, p) <= high]

    def read(self, partition):
        yield from _records_of(self.path, partition.value, self.strip)

    def commit(self, end: dict) -> None:
        """Nothing is held."""


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    """Tasks write below a hidden folder; commit moves their files into place, abort deletes them."""

    def __init__(self, path: str, schema, overwrite: bool):
        missing = {"family", "label", "header", "residues"} - set(schema.fieldNames())
        if missing:
            raise ValueError(f"columns are missing: {', '.join(sorted(missing))}")
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, iterator):
        system, root = open_path(self.path)
        task, made, out = uuid.uuid4().hex, [], None
        try:
            for row in iterator:
                family, label = row["family"], row["label"]
                if not made or made[-1][0] != family:
                    if out:
                        out.close()
                    name = f"family={quote(family or '', safe='')}/part-{label or 0:010d}-{task}.fasta"
                    made.append((family, name))
                    hidden = f"{root}/.job-{self.job}/{task}/{name}"
                    system.create_dir(hidden.rsplit("/", 1)[0], recursive=True)
                    out = system.open_output_stream(hidden)
                out.write(f">{row['header'] or ''}\n{wrapped(row['residues'] or '')}".encode())
        finally:
            if out:
                out.close()
        return _Written([(f"{task}/{name}", name) for _, name in made])

    def commit(self, messages):
        system, root = open_path(self.path)
        system.create_dir(root, recursive=True)
        if self.overwrite:
            for x in system.get_file_info(fs.FileSelector(root)):
                if not x.base_name.startswith(f".job-{self.job}"):
                    (system.delete_dir if x.type == fs.FileType.Directory else system.delete_file)(x.path)
        for message in messages:
            for hidden, name in message.files if message else []:
                system.create_dir(f"{root}/{name}".rsplit("/", 1)[0], recursive=True)
                system.move(f"{root}/.job-{self.job}/{hidden}", f"{root}/{name}")
        self._forget(system, root)

    def abort(self, messages):
        self._forget(*open_path(self.path))

    def _forget(self, system: fs.FileSystem, root: str) -> None:
        if system.get_file_info(f"{root}/.job-{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/.job-{self.job}")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastaSource)
