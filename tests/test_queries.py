"""Registered queries against their checking SQL on the smallest data."""

import math
import os
import re

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as contract  # noqa: E402
from workbook.queries import registry  # noqa: E402
from workbook.views import TABLES  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test data not mounted")

# The composites take longer; the driver compares all of them.
LIGHT = ["scan_parquet", "latest_per_key", "jobs_latest", "class_size_per_row", "k_anonymity", "l_diversity",
         "vulnerable_clusters", "profile_columns", "profile_samples", "classify_columns", "duplicate_flags",
         "numeric_similarity", "date_similarity", "string_similarity", "linkage_matches", "linkage_text", "linkage_wide",
         "linkage_crowded", "linkage_dates_numbers", "profile_merged", "linkable_overlap",
         "mitigate_age_band", "mitigate_date_quarter", "mitigate_topn_other", "optimize_mitigations",
         "inject_quality_faults", "derive_auxiliary", "fix_case", "fix_date_format", "fix_impute_mode",
         "date_patterns", "quality_unit_ratio"]


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v)


def test_every_query_has_checking_sql_over_whole_tables():
    sql = contract.oracle_sql()
    assert set(registry()) <= set(sql) <= set(contract.queries())
    assert not any(re.search(r"USING SAMPLE|TABLESAMPLE", text) for text in sql.values())


@pytest.mark.parametrize("name", LIGHT)
def test_query_equals_sql(spark, database, name):
    df = contract.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    result = database.execute(contract.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted(tuple(plain(row[i]) for i in at) for row in result.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want


def test_entry_returns_one_risk_row(spark):
    assert contract.entry(spark).count() == 1
