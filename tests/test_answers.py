"""Queries against their DuckDB answers on the small tables.

PARTLOOM_ALL=1 compares every query; without it the quick ones and one whole run are compared.
"""

import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry

QUICK = [
    "feed_csv_scan", "feed_encoding_fallback", "feed_ingest", "master_dim_sync", "clean_placeholders", "uom_spacing",
    "decimal_to_fraction", "invoice_compress", "html_technical_text", "resolve_entity", "evidence_snippets", "key_match",
    "input_validation", "latency_stats", "telemetry_snapshot", "review_current", "rolling_failure_rate", "rate_window_wide",
    "progress_stream", "enrich", "slot_align", "golden_compare", "schema_row_summary", "compliance_scorecard",
    "file_fingerprint", "persist_related",
]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    return v.replace(tzinfo=None).isoformat() if hasattr(v, "isoformat") else v


def ordered(columns, rows):
    at = [columns.index(n) for n in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


@pytest.fixture(scope="module")
def sql(sf):
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def names():
    from oracle.answers import ANSWERS

    return sorted(ANSWERS) if os.environ.get("PARTLOOM_ALL") else QUICK


@pytest.mark.parametrize("name", names())
def test_query(spark, sf, sql, name):
    df = entry.queries()[name](spark, sf)
    cur = sql.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert ordered(df.columns, df.collect()) == ordered(columns, cur.fetchall())


def test_every_query_is_named_once():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    from partloom.queries import QUERIES

    assert set(QUERIES) <= set(entry.oracle_sql())
