"""The registered text queries: against their SQL where there is any."""

from __future__ import annotations

import pytest

from mercadia.llm.oracle import llm_oracle
from mercadia.llm.queries import llm_queries
from tests.conftest import SMALL
from tests.oracle_check import connect, differences, run_duckdb, run_spark

QUERIES, SQL = llm_queries(), llm_oracle()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    assert not differences(run_spark(QUERIES[name](spark, SMALL)), run_duckdb(connect(SMALL), SQL[name]))


OTHER_GRAIN = {"near_benchmark_passages", "op8_tiered_packing", "op11_embedding_whitening", "op13_vector_best_fit_packing", "pipeline"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - OTHER_GRAIN))
def test_a_row_for_each_document(spark, name):
    found = QUERIES[name](spark, SMALL)
    assert found.count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()
