"""Model parameters, scoring matrices and result sheets as files."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions.model import GAP_COSTS, PairModel, ScoreMatrix, gap_costs, matrix_name
from kinfold.operators.evaluate import replace_last
from kinfold.sources import sheets


def _lines(spark: SparkSession, path: str) -> list[str]:
    """Lines of one small file, read by Spark, so any store will do; its size is that of an alphabet squared."""
    content = spark.read.text(path, wholetext=True).limit(1).collect()
    return [x for x in content[0][0].splitlines() if x.strip()] if content else []


def model_text(model: PairModel, letters: str | None = None) -> str:
    """Three lines of transitions, the letters, the lower triangle of pair emissions, single emissions."""
    letters = letters or "".join(model.single)
    number = lambda xs: " ".join(f"{x:.10f}" for x in xs)
    triangle = [number(model.pair.get((x, y), 0.0) for y in letters[: i + 1]) for i, x in enumerate(letters)]
    return "\n".join([number(model.init), number(model.gap_open), number(model.gap_extend), letters, *triangle, number(model.single.get(x, 0.0) for x in letters)]) + "\n"


def parse_model(lines: list[str]) -> PairModel:
    floats = lambda line: tuple(float(x) for x in line.split())
    letters = lines[3].strip()
    pair = {}
    for i, x in enumerate(letters):
        for y, v in zip(letters[: i + 1], floats(lines[4 + i]), strict=True):
            pair[x, y] = pair[y, x] = v
    single = dict(zip(letters, floats(lines[4 + len(letters)]), strict=True))
    return PairModel(floats(lines[0]), floats(lines[1]), floats(lines[2]), single, pair)


def read_model(spark: SparkSession, path: str) -> PairModel:
    return parse_model(_lines(spark, path))


def write_model(spark: SparkSession, model: PairModel, path: str) -> None:
    spark.createDataFrame([(model_text(model).rstrip("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_matrix(spark: SparkSession, path: str, gaps: tuple[float, float] = GAP_COSTS[160]) -> ScoreMatrix:
    """A line of letters, then the lower triangle in any number of lines."""
    lines = _lines(spark, path)
    return ScoreMatrix.from_triangle(lines[0].strip(), [float(x) for line in lines[1:] for x in line.replace(",", " ").split()], gaps)


def write_matrix(spark: SparkSession, matrix: ScoreMatrix, path: str) -> None:
    """The file that read_matrix reads."""
    get = matrix.scores.get
    lines = [matrix.letters, *[" ".join(f"{get((x, y), 0.0):g}" for y in matrix.letters[: i + 1]) for i, x in enumerate(matrix.letters)]]
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def matrix(spark: SparkSession, which: int | str, folder: str | None = None, gaps: tuple[float, float] | None = None) -> ScoreMatrix:
    """The matrix of a name or code (160, 200, 4), with its gap costs unless others are given.

    The nucleotide matrix is built in; the others are files of their name in folder.
    """
    name = matrix_name(which)
    gaps = gaps or gap_costs(name)
    if name == matrix_name(4):
        return replace(ScoreMatrix.nucleotides(), gaps=gaps)
    if folder is None:
        raise ValueError(f"the scores of {name} are a file: give its folder")
    return read_matrix(spark, f"{folder}/{name}", gaps)


def boltzmann_weights(matrix: DataFrame, temperature: float = 5.0) -> DataFrame:
    """matrix (x, y, s) with weight exp(s / temperature)."""
    return matrix.withColumn("weight", F.exp(F.col("s") / temperature))


def read_training(spark: SparkSession, path: str) -> DataFrame:
    """res_a, res_b, cls from a CSV with columns Seqs (A-B) and Class."""
    rows = spark.read.csv(path, header=True, schema="Seqs string, Class int")
    return rows.select(F.split("Seqs", "-")[0].alias("res_a"), F.split("Seqs", "-")[1].alias("res_b"), F.col("Class").alias("cls"))


def write_training(rows: DataFrame, path: str) -> None:
    rows.select(F.concat_ws("-", "res_a", "res_b").alias("Seqs"), F.col("cls").alias("Class")).write.mode("overwrite").csv(path, header=True)


def write_relabelled(rows: DataFrame, index: str, column: str, changes: DataFrame, path: str) -> None:
    """The training CSV of rows (res_a, res_b, index, column) with column replaced by that of changes (index, column)."""
    write_training(replace_last(rows, index, column, changes).withColumnRenamed(column, "cls"), path)


def read_pids(spark: SparkSession, path: str) -> DataFrame:
    """family, pid from lines 'family, pid'."""
    return spark.read.csv(path, schema="family string, pid double", ignoreLeadingWhiteSpace=True)


def read_sheet(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    """family, tc, sp, row from spreadsheets without a header; row is the order within the file. kind: xlsx or csv."""
    if kind == "csv":
        lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.rtrim("value"), "\n")).alias("row", "line")).filter("line <> ''")
        rows = lines.select("row", F.split("line", ",").alias("cells"))
    else:
        sheets.register(spark)
        rows = spark.read.format("xlsx").load(path)
    cell = lambda k: F.try_element_at("cells", F.lit(k))
    return rows.select(cell(1).alias("family"), cell(2).cast("double").alias("tc"), cell(3).cast("double").alias("sp"), "row")


def write_sheet(rows: DataFrame, path: str, kind: str = "csv") -> None:
    """family, tc, sp as one sheet without a header, in order of family; a sheet is a small file."""
    ready = rows.select("family", "tc", "sp").coalesce(1).sortWithinPartitions("family")
    if kind == "csv":
        ready.select(F.concat_ws(",", "family", F.col("tc").cast("string"), F.col("sp").cast("string")).alias("value")).write.mode("overwrite").text(path)
    else:
        sheets.register(rows.sparkSession)
        ready.write.format("xlsx").mode("overwrite").save(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="idx int, y_true int, y_pred int")


def write_predictions(rows: DataFrame, path: str) -> None:
    rows.select("idx", "y_true", "y_pred").write.mode("overwrite").csv(path, sep="\t")


def feature_text(features: DataFrame) -> DataFrame:
    """family, a, b, record: the pair features joined by ', ' and ended by ';'."""
    return features.select("family", "a", "b", F.format_string("%d, %s, %s, %.6f, %.6f, %.6f;", "path_len", "path", "pair", "identity", "emission", "score").alias("record"))
