"""Queries that write files to the shared folder and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold.functions.model import ALPHABET, PairModel
from kinfold.operators import alignment, estimate, pairs
from kinfold.plans.pair_queries import _MATRIX, _PAIRS
from kinfold.plans.registry import query
from kinfold.plans.sequence_queries import _BENCH, _CELLS
from kinfold.sources import fasta, parameters
from kinfold.sources import tables as T
from kinfold.sources.shared import new_path
from kinfold.streaming.families import align_stream

_ALIGNED = f"""{_CELLS},
    r AS (SELECT family, label, header, string_agg(residue, '' ORDER BY col) AS residues FROM c GROUP BY ALL)"""


@query("fasta_files", f"WITH {_BENCH} SELECT family, label, header, residues, true AS valid FROM b")
def fasta_files(spark, sf_dir):
    """One FASTA file for each family, read again."""
    fasta.write_fasta(T.benchmark_sequences(spark, sf_dir), path := new_path(spark))
    return fasta.read_families(spark, path)


@query("fasta_gapped_files", f"WITH {_ALIGNED} SELECT family, label, header, residues FROM r")
def fasta_gapped_files(spark, sf_dir):
    """Alignments as FASTA, read with their gaps."""
    fasta.write_fasta(T.derived_alignment(spark, sf_dir), path := new_path(spark))
    return fasta.read_families(spark, path, strip_gaps=False).drop("valid")


@query("fasta_raw_files", f"WITH {_ALIGNED} SELECT family, label, residues FROM r")
def fasta_raw_files(spark, sf_dir):
    """The same by the lenient reader."""
    fasta.write_fasta(T.derived_alignment(spark, sf_dir), path := new_path(spark))
    return fasta.parse_raw_fasta(fasta._files(spark, path))


@query("fasta_source", f"WITH {_BENCH} SELECT family, label, header, residues FROM b")
def fasta_source(spark, sf_dir):
    """The same files through the data source fasta of this library, a family at a time by its folder."""
    fasta.write_fasta(T.benchmark_sequences(spark, sf_dir), path := new_path(spark))
    fasta.register(spark)
    return spark.read.format("fasta").option("path", path).load()


@query("directory_scan", "SELECT CAST(item_id // 4 AS VARCHAR) AS family, 1::BIGINT AS files FROM benchmark GROUP BY ALL")
def directory_scan(spark, sf_dir):
    fasta.write_fasta(T.benchmark_sequences(spark, sf_dir), path := new_path(spark))
    return fasta._files(spark, path).groupBy("family").agg(F.count("*").alias("files"))


@query("clustal_files", f"WITH {_ALIGNED} SELECT family, label, regexp_extract(header, '^\\s*(\\S*)', 1) AS name, residues FROM r")
def clustal_files(spark, sf_dir):
    """Alignments as Clustal files, read with their gaps."""
    fasta.write_texts(alignment.clustal(T.derived_alignment(spark, sf_dir)), path := new_path(spark))
    return fasta.read_families(spark, path, strip_gaps=False).select("family", "label", F.col("header").alias("name"), "residues")


@query("msf_files", f"WITH {_ALIGNED} SELECT family, label, regexp_extract(header, '^\\s*(\\S*)', 1) AS name, replace(residues, '-', '') AS residues FROM r")
def msf_files(spark, sf_dir):
    """Alignments as MSF files of 50 columns a block, read without their gaps."""
    rows = T.derived_alignment(spark, sf_dir).select("family", "label", F.regexp_extract("header", r"^\s*(\S*)", 1).alias("name"), F.translate("residues", "-", ".").alias("residues"))
    blocks = rows.select("family", "label", "name", "residues", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("residues") - 1), F.lit(50))).alias("start"))
    line = F.concat(F.rpad("name", F.lit(20), " "), F.substring("residues", F.col("start") + 1, F.lit(50)))
    lines = blocks.groupBy("family").agg(F.array_sort(F.collect_list(F.struct("start", "label", line.alias("line")))).alias("lines"))
    body = F.array_join(F.transform("lines", lambda x: F.concat(F.when(x["label"] == 0, "\n").otherwise(""), x["line"])), "\n")
    fasta.write_texts(lines.select("family", F.concat(F.lit("PileUp\n\n   MSF: 1  Type: P  Check: 1 ..\n\n//\n"), body).alias("text")), path := new_path(spark))
    return fasta.read_families(spark, path).select("family", "label", F.col("header").alias("name"), "residues")


@query("feature_records", f"""WITH {_PAIRS} SELECT family, a, b, printf('%d, %s, %s, %.6f, %.6f, %.6f;', length(ra), repeat('B', length(ra)), ra || '-' || rb, length(rb) / 7.0, a / 3.0, b * 1.5) AS record FROM p""")
def feature_records(spark, sf_dir):
    """The record format of pair features, written as text and read again."""
    found = pairs.all_pairs(T.benchmark_sequences(spark, sf_dir))
    rows = found.select("family", "a", "b", F.col("len_a").alias("path_len"), F.expr("repeat('B', len_a)").alias("path"), F.concat_ws("-", "res_a", "res_b").alias("pair"), (F.col("len_b") / 7.0).alias("identity"), (F.col("a") / 3.0).alias("emission"), (F.col("b") * 1.5).alias("score"))
    lines = parameters.feature_text(rows).select(F.concat_ws("\t", "family", F.col("a").cast("string"), F.col("b").cast("string"), "record").alias("value"))
    lines.write.text(path := new_path(spark))
    part = F.split("value", "\t")
    return spark.read.text(path).select(part[0].alias("family"), part[1].cast("int").alias("a"), part[2].cast("int").alias("b"), part[3].alias("record"))


@query("training_csv", f"WITH {_PAIRS} SELECT ra AS res_a, rb AS res_b, CAST((a + b) % 4 AS INTEGER) AS cls FROM p")
def training_csv(spark, sf_dir):
    found = pairs.all_pairs(T.benchmark_sequences(spark, sf_dir))
    parameters.write_training(found.select("res_a", "res_b", ((F.col("a") + F.col("b")) % 4).alias("cls")), path := new_path(spark))
    return parameters.read_training(spark, path)


@query("relabelled_csv", f"WITH {_PAIRS} SELECT ra AS res_a, rb AS res_b, CAST(CASE WHEN (a + 2 * b) % 3 = 0 THEN 3 ELSE (a + b) % 4 END AS INTEGER) AS cls FROM p")
def relabelled_csv(spark, sf_dir):
    """Training pairs of which some get another class by their number."""
    number = F.concat_ws("/", "family", F.col("a").cast("string"), F.col("b").cast("string")).alias("idx")
    rows = pairs.all_pairs(T.benchmark_sequences(spark, sf_dir)).select(number, "a", "b", "res_a", "res_b", ((F.col("a") + F.col("b")) % 4).alias("Class"))
    changes = rows.filter((F.col("a") + 2 * F.col("b")) % 3 == 0).select("idx", F.lit(3).alias("Class"))
    parameters.write_relabelled(rows, "idx", "Class", changes, path := new_path(spark))
    return parameters.read_training(spark, path)


@query("prediction_tsv", "SELECT CAST(doc_id AS INTEGER) AS idx, CAST(quality AS INTEGER) AS y_true, CAST(toxic AS INTEGER) AS y_pred FROM labels")
def prediction_tsv(spark, sf_dir):
    rows = T.load(spark, sf_dir, "labels").select(F.col("doc_id").alias("idx"), F.col("quality").alias("y_true"), F.col("toxic").alias("y_pred"))
    parameters.write_predictions(rows, path := new_path(spark))
    return parameters.read_predictions(spark, path)


@query("pid_text", "SELECT 'doc' || doc_id AS family, n_chars / 64.0 AS pid FROM documents")
def pid_text(spark, sf_dir):
    rows = T.load(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("family"), (F.col("n_chars") / 64.0).alias("pid"))
    rows.select(F.concat_ws(", ", "family", F.col("pid").cast("string")).alias("value")).write.text(path := new_path(spark))
    return parameters.read_pids(spark, path)


@query("score_sheet", "SELECT n_name AS family, n_nationkey / 4.0 AS tc, n_regionkey / 8.0 AS sp, CAST(row_number() OVER (ORDER BY n_name) - 1 AS INTEGER) AS row FROM nation")
def score_sheet(spark, sf_dir):
    rows = T.load(spark, sf_dir, "nation").select(F.col("n_name").alias("family"), (F.col("n_nationkey") / 4.0).alias("tc"), (F.col("n_regionkey") / 8.0).alias("sp"))
    parameters.write_sheet(rows, path := new_path(spark), "xlsx")
    return parameters.read_sheet(spark, path, "xlsx")


_LETTERS = "a AS (SELECT unnest(string_split('" + ALPHABET + "', '')) AS x)"


@query(
    "matrix_file",
    f"""WITH {_PAIRS}, {_LETTERS},
    o AS (SELECT ra[k] AS x, rb[k] AS y FROM p, range(1, 100000) t(k) WHERE k <= least(length(ra), length(rb))),
    c AS (SELECT x, y, count(*) AS n FROM (SELECT x, y FROM o UNION ALL SELECT y, x FROM o) GROUP BY ALL),
    m AS (SELECT x, sum(n) AS n FROM c GROUP BY x),
    g AS (SELECT i.x AS x, j.x AS y, coalesce(c.n, 0) + 1 AS n, coalesce(mx.n, 0) + 1 AS nx, coalesce(my.n, 0) + 1 AS ny
          FROM a i CROSS JOIN a j LEFT JOIN c ON c.x = i.x AND c.y = j.x LEFT JOIN m mx ON mx.x = i.x LEFT JOIN m my ON my.x = j.x),
    s AS (SELECT x, y, round(2 * log2(n * (SELECT sum(n) FROM c)::DOUBLE / (nx * ny))) + 0.0 AS s FROM g)
    SELECT x, y, s, round(exp(s / 5), 9) AS weight FROM s""",
)
def matrix_file(spark, sf_dir):
    """Log-odds scores of the letters of the benchmark's pairs, written to a file of letters and a triangle, and read again."""
    found = estimate.matrix_of(pairs.all_pairs(T.benchmark_sequences(spark, sf_dir)))
    parameters.write_matrix(spark, found, path := new_path(spark))
    rows = parameters.boltzmann_weights(pairs.matrix_frame(spark, parameters.read_matrix(spark, path)))
    return rows.withColumn("weight", F.round("weight", 9))


def _parameters(model: PairModel) -> list[tuple[str, float]]:
    named = [(f"{name}:{k}", x) for name in ("init", "gap_open", "gap_extend") for k, x in enumerate(getattr(model, name))]
    return [(k, round(v, 10)) for k, v in [*named, *((f"single:{x}", v) for x, v in model.single.items()), *((f"pair:{x}{y}", v) for (x, y), v in model.pair.items())]]


_NAMED = ", ".join(f"('{k}', {v:.10f})" for k, v in _parameters(PairModel()) if k.split(":")[0] not in ("single", "pair"))


@query(
    "model_file",
    f"""WITH {_BENCH}, {_LETTERS},
    n AS (SELECT unnest(string_split(residues, '')) AS x FROM b),
    c AS (SELECT a.x, count(n.x) + 1 AS n FROM a LEFT JOIN n USING (x) GROUP BY a.x),
    s AS (SELECT x, n / sum(n) OVER () AS v FROM c),
    r AS (SELECT m.x, m.y, i.v * j.v * exp(0.35 * m.s) AS v FROM (VALUES {_MATRIX}) m(x, y, s) JOIN s i ON i.x = m.x JOIN s j ON j.x = m.y)
    SELECT key, CAST(value AS DOUBLE) AS value FROM (VALUES {_NAMED}) p(key, value)
    UNION ALL SELECT 'single:' || x, round(v, 10) FROM s UNION ALL SELECT 'pair:' || x || y, round(v / sum(v) OVER (), 10) FROM r""",
)
def model_file(spark, sf_dir):
    """A pair model with the letter shares of the benchmark, written to a file of three lines, letters and tables, and read again."""
    parameters.write_model(spark, estimate.model_of(T.benchmark_sequences(spark, sf_dir)), path := new_path(spark))
    return spark.createDataFrame(_parameters(parameters.read_model(spark, path)), "key string, value double")


@query(
    "stream_identity",
    f"""WITH {_PAIRS}
    SELECT family, a, b, round(len(list_filter(range(1, least(length(ra), length(rb)) + 1), lambda k: ra[k] = rb[k])) / least(length(ra), length(rb)), 9) AS identity FROM p""",
)
def stream_identity(spark, sf_dir):
    """Identities of the pairs of families that arrive as a stream of files, three a batch."""
    fasta.write_fasta(T.benchmark_sequences(spark, sf_dir), path := new_path(spark))
    measured = lambda rows: pairs.all_pairs(rows).select("family", "a", "b", F.round(pairs.positional_identity(F.col("res_a"), F.col("res_b")), 9).alias("identity"))
    align_stream(spark, path, out := new_path(spark), new_path(spark), measured, files_per_batch=3).awaitTermination()
    return spark.read.option("recursiveFileLookup", True).schema("family string, a int, b int, identity double").parquet(out)


@query("append_files", f"WITH {_BENCH} SELECT family, CAST(row_number() OVER (PARTITION BY family ORDER BY label % 2, label) - 1 AS INTEGER) AS label, residues FROM b")
def append_files(spark, sf_dir):
    """Two inputs of a family, one after the other."""
    rows = T.benchmark_sequences(spark, sf_dir)
    return alignment.append_files([rows.filter("label % 2 = 0"), rows.filter("label % 2 = 1")]).select("family", "label", "residues")
