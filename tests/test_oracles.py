"""Registered queries against their SQL at the smallest scale."""

import os

import pytest

from rosterkit.queries import registry

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()
CHECKED = [
    "match_key", "clean_name", "parse_date", "complete_name", "unique_names", "column_blocks", "detect_header",
    "infer_column_type", "extract_roster", "dedup_rows", "compile_parts", "report_summary", "stale_parts", "compile_diagnosis",
    "parted_output", "run_outcome", "validate_requests", "admit_runs", "alias_defaults", "alias_residual", "merge_aliases",
    "scan_quoted_text", "scan_odd_text", "file_log", "output_index", "shrunken_reports",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_its_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF_DIR)
    result = duck.execute(registry.oracle_sql()[name])
    columns = sorted(d[0] for d in result.description)
    assert sorted(df.columns) == columns
    names = [d[0] for d in result.description]
    expected = sorted(repr([dict(zip(names, row))[c] for c in columns]) for row in result.fetchall())
    assert sorted(repr([row[c] for c in columns]) for row in df.collect()) == expected


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
