"""Queries on all series (feed, ticker), where one ticker is in several feeds."""

import datetime

import __spark_entry__ as entry

BARS = "bar_id bigint, feed string, ticker string, date date, open double, high double, low double, close double, volume bigint, loaded_at timestamp_ntz"


def test_every_feed_of_a_ticker_counts(spark, tmp_path):
    day, at = datetime.date(2020, 1, 1), datetime.datetime(2021, 1, 1)
    rows = [(10 * i + k, f"F{k}", "HOT", day + datetime.timedelta(i), 1.0, 2.0, 0.5, 1.5, 1 + k, at) for i in range(4) for k in range(3)]
    spark.createDataFrame(rows, BARS).write.parquet(str(tmp_path / "daily_bars.parquet"))
    spark.createDataFrame([("HOT",)], "ticker string").write.parquet(str(tmp_path / "m1_setups.parquet"))
    run = lambda name: {r[0]: r for r in entry.queries()[name](spark, str(tmp_path)).collect()}
    assert {k: r.volume for k, r in run("slice_aggregates_a20").items()} == {"F0/HOT": 4, "F1/HOT": 8, "F2/HOT": 12}
    assert {k: r.n for k, r in run("semi_join_j8").items()} == {"F0/HOT": 4, "F1/HOT": 4, "F2/HOT": 4}
    assert entry.queries()["funnel_a8"](spark, str(tmp_path)).first().all_rows == 12
