"""Registered queries against their oracles at the smallest scale."""

import os

import pytest

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "site_stats", "type_breakdown", "list_transactions", "correlate", "asof_price", "mentions_company",
    "supersede_same_day", "reconcile_match", "extract_rows", "dedupe_filings", "stream_usage", "stream_incremental", "seek_transactions", "graph_walk",
]


def test_registry_is_complete():
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 140


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")
@pytest.mark.parametrize("key", SAMPLE)
def test_equals_oracle(spark, key):
    from catalog import ORACLES, QUERIES
    from catalog.verify import compare, connect

    status, note = compare(spark, connect(FOLDER), FOLDER, key, QUERIES[key], ORACLES[key])
    assert status == "ok", note
