"""All queries of the library outside the subpackage llm."""

from __future__ import annotations

from kinfold.plans import evaluation_queries, file_queries, kernel_queries, pair_queries, sequence_queries
from kinfold.plans.registry import ORACLES, QUERIES, Query

#: Importing these modules registers their queries.
MODULES = (sequence_queries, pair_queries, evaluation_queries, kernel_queries, file_queries)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
