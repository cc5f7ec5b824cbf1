"""Every query with SQL gives the same rows as DuckDB on the smallest tables; the others run."""

import pytest
from tests_support import rows

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
CORE = sorted(k for m in entry._modules() if ".llm" not in m.__name__ for k in m.QUERIES)
SLOW = {"walk_counts_r10", "draw_counts_r12_r14_r17_r18_r19", "quantile_counts_r5_r6", "residual_slices_a30", "residual_balance_r2_r3", "residual_rows_r3", "flags_r8", "coefficient_table_r9", "bands_k7", "headline_r7", "walk_forward_r10", "sign_trend_r11", "bootstrap_r12_r14_r17", "inference_r15_r16", "estimation_grid_r5_r6", "residuals_r3", "winsorized_r4_a29", "ols_r2", "setups_d9_d13", "p3_reasons"}


@pytest.mark.parametrize("name", [n for n in CORE if n not in SLOW])
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, DIR).toArrow()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got.num_columns > 0
        return
    want = duck.sql(sql).to_arrow_table()
    columns = sorted(want.column_names)
    assert sorted(got.column_names) == columns
    assert rows(got, columns) == rows(want, columns)


def test_entry_and_registry(spark):
    assert entry.entry(spark).columns == ["series", "date", "mom_12_1", "mom_pct"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(any(k.startswith(f"p{n}_") for k in entry.queries()) for n in range(1, 5))
