"""A stream of family files: each new file of a folder is aligned as it arrives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinfold.operators.align import align
from kinfold.sources.fasta import family_of, parse_fasta


def stream_families(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """family, content of the files of folder, as a stream."""
    files = spark.readStream.option("wholetext", True).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).format("text").load(folder)
    return files.select(family_of(F.input_file_name()).alias("family"), F.regexp_replace("value", "\r\n?", "\n").alias("content"))


def align_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, aligner: Callable[[DataFrame], DataFrame] = align, files_per_batch: int = 100, **trigger) -> StreamingQuery:
    """Align each batch of files and write it as Parquet below out; a batch that is run again replaces itself."""

    def batch(files: DataFrame, k: int) -> None:
        sequences = parse_fasta(files).filter(F.length("residues") > 0).persist()
        aligner(sequences).write.mode("overwrite").parquet(f"{out}/batch={k}")
        sequences.unpersist()

    return stream_families(spark, folder, files_per_batch).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
