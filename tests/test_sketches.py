"""Merged profile states against the state of the whole table, and the stated error bounds."""

import numpy as np
import pytest

from veilgauge.operators import sketches
from veilgauge.sources.catalog import Catalog


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(40_000).selectExpr(
        "id", "if(id % 11 = 0, null, concat('name', id % 9000)) AS name", "if(id % 5 = 0, double('nan'), sqrt(id * 1.0D)) AS size",
        "date_add(date'2020-01-01', int(id % 700)) AS day", "cast(null as string) AS nothing").repartition(5)


def figures(profile):
    return {r["column"]: r for r in sketches.estimates(profile).collect()}


def test_merged_states_equal_the_state_of_the_whole_table(table):
    parts = [sketches.column_sketches(table.where(f"id % 3 = {k}")) for k in range(3)]
    one, many = figures(sketches.column_sketches(table)), figures(sketches.merged(*parts))
    assert set(one) == set(many) == set(table.columns)
    for name in one:
        for field in ("ordinal", "row_count", "missing_count", "approx_distinct"):
            assert one[name][field] == many[name][field], (name, field)


def test_estimates_keep_the_stated_bounds(table):
    parts = [sketches.column_sketches(table.where(f"id % 2 = {k}")) for k in range(2)]
    got = figures(sketches.merged(*parts))
    for name, exact in (("id", 40_000), ("name", 9000), ("day", 700), ("size", 32_000), ("nothing", 0)):
        assert abs(got[name]["approx_distinct"] - exact) <= 4 * sketches.DISTINCT_ERROR * exact
    values = np.sort([r[0] for r in table.where("not isnan(size)").select("size").collect()])
    for share, found in zip((0.25, 0.5, 0.75), got["size"]["quantiles"]):
        assert abs(np.searchsorted(values, found) / len(values) - share) <= sketches.RANK_ERROR
    assert got["name"]["quantiles"] == [None] * 3 and got["size"]["missing_count"] == 8000


def test_empty_tables_merge(table):
    empty = sketches.column_sketches(table.limit(0))
    alone = figures(sketches.merged(empty, empty))
    assert alone["id"]["row_count"] == 0 and alone["size"]["quantiles"] == [None] * 3
    both, whole = figures(sketches.merged(empty, sketches.column_sketches(table))), figures(sketches.column_sketches(table))
    assert {n: r["approx_distinct"] for n, r in both.items()} == {n: r["approx_distinct"] for n, r in whole.items()}


def test_a_grown_version_reads_its_new_rows_only(spark, table, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "c"))
    first = catalog.save(table.where("id < 30000"), "t", profiled=True)
    second = catalog.grow(first, table.where("id >= 30000"))
    assert catalog.load(second).count() == 40_000 and catalog.lookup(second).first()["parent_id"] == first
    assert figures(catalog.profile(second))["name"] == figures(sketches.column_sketches(table))["name"]
    assert "_profile" not in str(catalog.load(second).inputFiles()) and catalog.load(first).count() == 30_000
    plain = catalog.save(table.limit(3), "u")
    with pytest.raises(KeyError):
        catalog.profile(plain)
