"""Functions of this library for SQL: register(spark) makes them known by name.

log_add(x, y) and pair_identity(a, b) are expressions of the JVM; mea_score(a, b, s1) and the table
function posterior_cells(a, b, s1) -> (i, j, p) run the pair kernels on Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kinfold.functions.model import CUTOFF, PairModel, ScoreMatrix

#: Names, parameters and results of the functions that are expressions.
EXPRESSIONS = {
    "log_add(x DOUBLE, y DOUBLE) RETURNS DOUBLE": "CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN greatest(x, y) + log1p(exp(-abs(x - y))) END",
    "pair_identity(a STRING, b STRING) RETURNS DOUBLE": """CASE WHEN length(a) > 0 AND length(b) > 0 THEN
        size(filter(sequence(1, least(length(a), length(b))), k -> substring(a, k, 1) = substring(b, k, 1))) / least(length(a), length(b)) END""",
}


def register(spark: SparkSession, model: PairModel | None = None, matrix: ScoreMatrix | None = None) -> None:
    """Register the functions with the given model and matrix, or the defaults. A null argument gives null, or no rows."""
    model, matrix = model or PairModel(), matrix or ScoreMatrix.by_groups()

    def mea_score(a: pa.Array, b: pa.Array, s1: pa.Array) -> pa.Array:
        from kinfold.operators.lattice import Kernel
        from kinfold.operators.trace import best_trace

        rows, kernel = list(zip(a.to_pylist(), b.to_pylist(), s1.to_pylist(), strict=True)), Kernel(model, matrix)
        found: list[float | None] = [None] * len(rows)
        for kind in {r[2] for r in rows if None not in r}:
            mine = [k for k, r in enumerate(rows) if None not in r and r[2] == kind]
            for at, p in kernel([rows[k][:2] for k in mine], kind):
                found[mine[at]] = best_trace(p)[1]
        return pa.array(found, pa.float64())

    class PosteriorCells:
        def __init__(self):
            from kinfold.operators.lattice import Kernel

            self.kernel = Kernel(model, matrix)

        def eval(self, a: str, b: str, s1: int):
            if a is None or b is None or s1 is None:
                return
            _, p = next(self.kernel([(a, b)], s1))
            for i, j in zip(*np.nonzero(p >= CUTOFF), strict=True):
                yield int(i) + 1, int(j) + 1, float(p[i, j])

    for signature, body in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    spark.udf.register("mea_score", F.arrow_udf(mea_score, "double"))
    spark.udtf.register("posterior_cells", F.udtf(PosteriorCells, returnType="i int, j int, p double"))
