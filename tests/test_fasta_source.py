"""FASTA files that many tasks share, and the data source as reader, writer and stream."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from kinfold.sources import fasta


def expected(path, strip=True):
    """family, label, header, residues by the plain rule: a line whose first letter is > begins a record."""
    rows = []
    for name in sorted(os.listdir(path)):
        records = []
        for line in (path / name).read_bytes().decode().replace("\r\n", "\n").replace("\r", "\n").split("\n"):
            if line.lstrip(" \t").startswith(">"):
                records.append([line.lstrip(" \t")[1:], ""])
            elif records:
                records[-1][1] += line
        full = [r for r in records if (r[0] + r[1]).strip()]
        rows += [(name, k, h.strip(), "".join(t.split()).replace(".", "-").upper().replace("-", "" if strip else "-")) for k, (h, t) in enumerate(full)]
    return sorted(rows)


@pytest.fixture
def folder(tmp_path):
    rng = random.Random(3)
    path = tmp_path / "in"
    path.mkdir()
    for f in range(4):
        text = "".join(f">s{k} of {f}{rng.choice(['', ' x>y'])}\n" + "\n".join("".join(rng.choices("ACDEac-.", k=rng.randrange(70))) for _ in range(rng.randrange(4))) + "\n" for k in range(rng.randrange(1, 60)))
        (path / f"f{f}").write_text(text)
    (path / "blank").write_text("\n\n  >a\nACD\n\n>b\n")
    (path / "returns").write_bytes(b">a\r\nAC\r\n  >b\r\nDE\r\n>c\r\n")
    (path / "old").write_bytes(b">a\rAC\r>b\rDE\r")
    (path / "marks").write_text(">>a\nAC\n> \nDE\n>\n\n>last")
    (path / "one").write_text(">only header")
    (path / "empty").write_text("")
    return path


@pytest.mark.parametrize("size", ["128m", "40", "7"])
def test_split_files_have_the_same_records(spark, folder, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = fasta.read_families(spark, str(folder))
        if size == "40":
            assert fasta.read_records(spark, str(folder)).rdd.getNumPartitions() > 50
        assert sorted(map(tuple, found.drop("valid").collect())) == expected(folder)
        gaps = fasta.read_families(spark, str(folder), strip_gaps=False)
        assert sorted(map(tuple, gaps.drop("valid").collect())) == expected(folder, False)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_other_kinds_beside_fasta(spark, folder):
    (folder / "aln").write_text("CLUSTAL W\n\nx  AC-D\ny  ACDD\n   ** *\n\nx  EF\ny  E-\n")
    found = {(r["family"], r["header"]): r["residues"] for r in fasta.read_families(spark, str(folder)).filter("family IN ('aln', 'one')").collect()}
    assert found == {("aln", "x"): "ACDEF", ("aln", "y"): "ACDDE", ("one", "only header"): ""}


def test_round_trip_of_the_source(spark, folder, tmp_path):
    fasta.register(spark)
    rows = spark.createDataFrame(expected(folder), fasta.SCHEMA).withColumn("family", F.concat("family", F.lit("/=% é")))
    ready = rows.repartition(3, "family").sortWithinPartitions("family", "label")
    out = str(tmp_path / "out")
    ready.write.format("fasta").mode("append").save(out)
    want = sorted(map(tuple, rows.collect()))
    for back in (spark.read.format("fasta").load(out), fasta.read_families(spark, out).drop("valid")):
        assert sorted(map(tuple, back.collect())) == want
    assert not [x for x in os.listdir(out) if x.startswith(".")]
    ready.filter("label = 0").write.format("fasta").mode("overwrite").save(out)
    assert sorted(map(tuple, spark.read.format("fasta").load(out).collect())) == [r for r in want if r[1] == 0]
    # a family in several tasks is read back in the order of its labels
    spread = rows.repartitionByRange(4, "label").sortWithinPartitions("family", "label")
    spread.write.format("fasta").mode("overwrite").save(out)
    assert sorted(map(tuple, fasta.read_families(spark, out).drop("valid").collect())) == want


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    fasta.register(spark)
    out = tmp_path / "out"
    bad = spark.range(8, numPartitions=4).select(F.lit("f").alias("family"), F.col("id").cast("int").alias("label"), F.lit("h").alias("header"), F.when(F.col("id") < 6, "ACD").otherwise(F.raise_error(F.lit("no"))).alias("residues"))
    with pytest.raises(Exception, match="no"):
        bad.write.format("fasta").mode("append").save(str(out))
    assert not list(out.rglob("*.fasta"))
    with pytest.raises(Exception, match="missing"):
        spark.range(1).write.format("fasta").mode("append").save(str(out))


def test_a_stream_goes_on_without_loss_or_repeats(spark, tmp_path):
    fasta.register(spark)
    source, out, state = (str(tmp_path / x) for x in ("source", "out", "state"))
    os.mkdir(source)

    def arrive(names):
        for n in names:
            with open(f"{source}/{n}", "w") as f:
                f.write(f">{n}\nACD\n>{n} again\nEF\n")
        time.sleep(1.2)

    def run():
        stream = spark.readStream.format("fasta").load(source).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        stream.awaitTermination(120)
        assert stream.exception() is None
        return sorted(r["header"] for r in spark.read.parquet(out).collect())

    arrive(["b", "c"])
    first = run()
    arrive(["a"])
    assert first == ["b", "b again", "c", "c again"] and run() == ["a", "a again", *first] == run()
