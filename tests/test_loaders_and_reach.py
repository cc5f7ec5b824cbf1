"""Spellings of bars, unreadable inputs, and patterns that look far back."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators.detect import PatternParams, evaluate
from tidewright.operators.series import SeriesParams, add_features
from tidewright.sources.bars import normalize_bars, read_splits

D = datetime.date


def test_short_spellings_side_by_side(spark):
    raw = spark.createDataFrame([("A", 1_577_836_800_000, 1.0, 2.0, 0.5, 1.5, 7)], "T string, t bigint, o double, h double, l double, c double, v bigint")
    assert [tuple(r) for r in normalize_bars(raw).collect()] == [("A", D(2020, 1, 1), 1.0, 2.0, 0.5, 1.5, 7)]
    upper = raw.toDF("SYMBOL", "Date", "Open", "HIGH", "Low", "Close", "Volume")
    assert normalize_bars(upper).first().ticker == "A"
    with pytest.raises(ValueError, match="bars lack volume"):
        normalize_bars(raw.drop("v"))


@pytest.mark.parametrize("unit", [1, 10**3, 10**6, 10**9])
def test_epochs_of_every_unit(spark, unit):
    seconds = 1_577_836_800 + 3600
    raw = spark.createDataFrame([("A", seconds * unit, 1.0, 1.0, 1.0, 1.0, 1)], "ticker string, t bigint, o double, h double, l double, c double, v bigint")
    assert normalize_bars(raw).first().date == D(2020, 1, 1)


def test_only_a_missing_split_file_is_none(spark, tmp_path):
    assert read_splits(spark, str(tmp_path / "none.parquet")) is None
    (tmp_path / "bad.parquet").write_bytes(b"this is no parquet file")
    with pytest.raises(Exception, match="bad.parquet"):
        read_splits(spark, str(tmp_path / "bad.parquet")).count()


@pytest.mark.parametrize("pivot_back, leg_most, anchor", [(90, 60, 60), (230, 120, 100), (300, 60, 200)])
def test_patterns_look_as_far_back_as_they_are_told(spark, pivot_back, leg_most, anchor):
    rng = np.random.default_rng(3)
    n = 700
    close = 50 * np.exp(np.cumsum(rng.normal(0, 0.03, n)))
    high = close * (1 + np.abs(rng.normal(0, 0.01, n)))
    rows = [("A", "A", D(2015, 1, 1) + datetime.timedelta(i), float(close[i]), None if i in (333, 350) else float(high[i]), float(close[i] * 0.98), float(close[i]), 1000 + i) for i in range(n)]
    bars = spark.createDataFrame(rows, "series string, ticker string, date date, open double, high double, low double, close double, volume bigint")
    f = add_features(bars, "series", SeriesParams(momentum_long=20, momentum_short=5, year=20))
    asked = [3, 16, 40, 229, 231, 300, 420, 512, 699]
    p = PatternParams(pivot_back=pivot_back, leg_most=leg_most, anchor=anchor)
    out = {(r.date - D(2015, 1, 1)).days: r for r in evaluate(f.filter(F.col("days_in_segment").isin([t + 1 for t in asked])), f, p).collect()}
    highs = np.array([np.nan if r[4] is None else r[4] for r in rows])
    ups = np.concatenate([[0], np.cumsum(close[1:] > close[:-1])])
    for t in asked:
        lo, hi = max(0, t - p.pivot_back), t - p.pivot_lag
        if hi < lo:
            assert out[t].cons_start_date is None
            continue
        pivot = lo + int(np.nanargmax(highs[lo : hi + 1]))
        assert (out[t].cons_start_date - D(2015, 1, 1)).days == pivot and out[t].cons_duration_days == t - pivot
        a, b = max(0, pivot - p.leg_most), pivot - p.leg_least
        good = [i for i in range(a, b + 1) if p.gain_least <= (highs[pivot] - close[i]) / close[i] <= p.gain_most and (ups[pivot] - ups[i]) / (pivot - i) >= p.up_share]
        if not good:
            assert out[t].legup_low_date is None
            continue
        leg = good[0] + int(np.argmin(close[good[0] : min(good[0] + p.snap, b) + 1]))
        assert (out[t].legup_low_date - D(2015, 1, 1)).days == leg
        if leg - p.anchor >= 0:
            assert out[t].pre_legup_return == pytest.approx(close[leg - 1] / close[leg - p.anchor] - 1)
        else:
            assert out[t].pre_legup_return is None
