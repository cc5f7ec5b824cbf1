"""The registered queries of this subpackage."""

import pytest

import __spark_entry__ as entry
from tests_support import rows

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["p5_certified", "p5_load_ranges", "p6_round_trip"])
def test_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, DIR).toArrow(), duck.sql(entry.oracle_sql()[name]).to_arrow_table()
    assert rows(got, sorted(want.column_names)) == rows(want, sorted(want.column_names))


def test_round_trip(spark):
    out = entry.queries()["p6_round_trip"](spark, DIR)
    assert out.filter("not same").count() == 0 and out.count() == spark.read.parquet(f"{DIR}/documents.parquet").count()


def test_columns(spark):
    assert entry.queries()["p6_ids"](spark, DIR).dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    assert entry.queries()["p8_found"](spark, DIR).dtypes == [("doc_id", "bigint"), ("cell_no", "int"), ("lang", "string")]
