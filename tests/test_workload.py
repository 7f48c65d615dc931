"""Every registered query runs; those with SQL twins match them."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF
from tools.check_oracle import TABLES, rows

# One per area keeps the suite short; tools/check_oracle.py runs them all.
SAMPLE = (
    "f4_keyset_newest", "o2_page_newest", "o7_boundaries_newest", "j1_person_facet", "a3_people_counts", "w1_best_avatars",
    "m17_recompute_clusters", "x12_signed_links", "x13_verify_links", "d1_catalog_rules", "d7_upload_rules", "p7_pending_uploads",
)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, duck, name):
    frame = entry.queries()[name](spark, SF)
    got = rows([tuple(r) for r in frame.collect()], frame.columns)
    result = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(frame.columns)
    assert got == rows(result.fetchall(), names) and got


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_paging_plan_is_a_top_k_with_pushdown(spark, roles):
    from shoebox.operators import paging
    from shoebox.workload.roles import ALBUM

    plan = paging.page(paging.published_in_album(roles.pictures, ALBUM), "newest", 60)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "EqualTo(o_orderpriority" in plan
