"""What the operators of this package share: tables, the shared folder, text hashing."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.sources.shared import new_path, shared_dir

#: Deleted or split on wherever a contract speaks of white space: [\x20\x09-\x0D].
WHITE_SPACE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint; for small intermediate results of loops."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Paths of tables that the innermost scratch deletes.
_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that stored() writes meanwhile, but those to be kept, are deleted at the end."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in map(spark._jvm.org.apache.hadoop.fs.Path, _scratch.pop()):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession) -> str:
    """A path in the shared folder that the innermost scratch deletes."""
    _scratch[-1].append(path := new_path(spark))
    return path


def stored(df: DataFrame, keep: bool = False) -> DataFrame:
    """df written as Parquet to the shared folder and read back; for results used more than once.

    Outside of scratch, or with keep, the table stays; sources.shared.forget_tables deletes all of them.
    """
    path = new_path(df.sparkSession)
    if _scratch and not keep:
        _scratch[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hex_sha256(column) -> Column:
    return F.sha2(column, 256)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def packed(df: DataFrame, **more: Column) -> DataFrame:
    """row, the whole row of df as one struct, and the columns more; no name of df can clash with another."""
    return df.select(F.struct("*").alias("row"), *[c.alias(n) for n, c in more.items()])


def unpacked(df: DataFrame) -> DataFrame:
    """What packed was made of."""
    return df.select("row.*")


def restrict(rows: DataFrame, wanted: DataFrame, best: Column | None = None) -> DataFrame:
    """One row of rows (row, key, any others) for each key that is in wanted (key).

    Keys are structs, which equal others by their fields, null or not; join and choice share their
    partitioning, so rows are shuffled once. Of rows with one key that of the least best stays, a
    value that rows can be ordered by; without it any one.
    """
    found = rows.join(wanted.select("key").distinct(), "key", "left_semi")
    if best is None:
        return found.dropDuplicates(["key"])
    place = F.row_number().over(Window.partitionBy("key").orderBy(best))
    return found.withColumn("place", place).filter("place = 1").drop("place")


#: Bits of bitmaps that are broadcast; a fuller one only lets more through.
BITMAP_BITS = 1 << 24


def bitmap(places: DataFrame) -> DataFrame:
    """bucket, bits: the bitmap of the column at, of fixed size, in buckets."""
    return places.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))


def marked_by(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """rows and the column there: false only if their mark isn't in wanted. A bitmap of fixed size tells, without a shuffle.

    It is broadcast as BITMAP_BITS / 64 rows of 64 bits at most. The names _word, _bits and there are
    taken; rows of a caller's table are packed for that.
    """
    place = F.pmod("mark", F.lit(BITMAP_BITS))
    bit = F.pmod("mark", F.lit(64)).cast("int")
    words = wanted.select(F.shiftright(place, 6).alias("_word"), F.expr("shiftleft(1L, cast(pmod(mark, 64) AS int))").alias("bit"))
    words = words.groupBy("_word").agg(F.bit_or("bit").alias("_bits"))
    placed = rows.withColumn("_word", F.shiftright(place, 6))
    there = F.coalesce(F.getbit("_bits", bit) == 1, F.lit(False))
    return placed.join(F.broadcast(words), "_word", "left").select(*rows.columns, there.alias("there"))


#: Bytes of Arrow data that a Python worker turns into objects at once; a longer row goes alone.
PIECE_BYTES = 4 << 20


def release() -> None:
    """Hand memory that is no longer used back to the system; workers live on after a task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def _parts(data) -> Iterator:
    """A record batch or array in parts of about PIECE_BYTES, in order."""
    rows = len(data)
    parts = [(0, rows)] if rows else []
    while parts:
        at, to = parts.pop()
        part = data.slice(at, to - at)
        if to - at > 1 and part.nbytes > PIECE_BYTES:
            middle = (at + to) // 2
            parts += [(middle, to), (at, middle)]
        else:
            yield part


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about PIECE_BYTES, so that a worker's memory does not follow Spark's batches."""
    for batch in batches:
        yield from _parts(batch)
    release()


def slices(column: pa.Array) -> Iterator[pa.Array]:
    """The same for the column of an Arrow UDF."""
    yield from _parts(column)
    release()
