"""python -m kinfold FOLDER -o OUT [-s1 0..3] [-s2 0|1] [-s3 0|1] [-a]: align the families of a folder.

-s1: pair-HMM, partition function, both, or both and the local model; -s2: linkage by size or plain;
-s3: consistency without or with weights. Other numbers count as 3, 0 and 0. -a keeps the order of
the tree. Instead of one strategy, -c CLASSIFIER (a folder of a saved network) picks each family's own.
-m MODEL takes the pair model of a file.

-G writes pair features instead of alignments. -T STEPS trains the pair model on the folder's families
and writes it to OUT, with the models of all steps beside it. -C CSV trains a network on pairs and
classes (columns Seqs, as A-B, and Class) and saves it to OUT. Paths are Spark's. The time of a run
is printed at its end.
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators import classify, network
from kinfold.operators.align import align, align_by_strategy, pair_features, train
from kinfold.operators.pairs import all_pairs
from kinfold.sources.fasta import read_families, write_fasta
from kinfold.sources.parameters import feature_text, read_model, read_training, write_model


def switch(text: str, choices: range, default: int) -> int:
    return int(text) if text.isdigit() and int(text) in choices else default


def options(args: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser("kinfold", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("folder", nargs="?")
    parser.add_argument("-o", "--outfile", required=True)
    parser.add_argument("-s1", "-step1", dest="s1", default=3, type=lambda x: switch(x, range(4), 3))
    parser.add_argument("-s2", "-step2", dest="s2", default=0, type=lambda x: switch(x, range(2), 0))
    parser.add_argument("-s3", "-step3", dest="s3", default=0, type=lambda x: switch(x, range(2), 0))
    parser.add_argument("-a", "--alignment-order", dest="tree_order", action="store_true")
    parser.add_argument("-c", "--classifier")
    parser.add_argument("-m", "--model")
    parser.add_argument("-G", "-get", dest="features", action="store_true")
    parser.add_argument("-T", "--train", type=int, metavar="STEPS")
    parser.add_argument("-C", "--train-classifier", metavar="CSV")
    parser.add_argument("--epochs", type=int, default=network.EPOCHS)
    found = parser.parse_args(args)
    if found.folder is None and found.train_classifier is None:
        parser.error("a folder of families is needed")
    return found


def run(spark: SparkSession, given: argparse.Namespace) -> float:
    """Do what the options say; the seconds it took."""
    began = time.perf_counter()
    if given.train_classifier:
        network.save(spark, network.train(read_training(spark, given.train_classifier), epochs=given.epochs), given.outfile)
        return time.perf_counter() - began
    sequences: DataFrame = read_families(spark, given.folder).drop("valid")
    model = read_model(spark, given.model) if given.model else None
    if given.train is not None:
        write_model(spark, train(sequences, model, given.train, folder=f"{given.outfile}-steps").model, given.outfile)
    elif given.features:
        feature_text(pair_features(all_pairs(sequences), model)).select(F.col("record").alias("value"), "family").write.mode("overwrite").partitionBy("family").text(given.outfile)
    elif given.classifier:
        chosen = classify.strategies(sequences, network.load(spark, given.classifier))
        write_fasta(align_by_strategy(sequences, with_default(sequences, chosen), model, keep_order=not given.tree_order), given.outfile, "row")
    else:
        write_fasta(align(sequences, (given.s1, given.s2, given.s3), model, keep_order=not given.tree_order), given.outfile, "row")
    return time.perf_counter() - began


def with_default(sequences: DataFrame, chosen: DataFrame) -> DataFrame:
    """family, s1, s2, s3 of every family; one without classifier pairs, for it has a single row, gets the default."""
    families = sequences.select("family").distinct()
    numbers = [F.coalesce(c, F.lit(x)).alias(c) for c, x in zip(("s1", "s2", "s3"), (3, 0, 0), strict=True)]
    return families.join(chosen, "family", "left").select("family", *numbers)


if __name__ == "__main__":
    given = options()
    seconds = run(SparkSession.builder.appName("kinfold").getOrCreate(), given)
    print(f"{given.folder or given.train_classifier}: {seconds:.3f} seconds")
