"""Orphans, profiles, spikes and rolling totals on small cases."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.functions.text import canonical_ticker, instant
from tidewright.operators.orphans import Link, absent, absent_at, orphan_cascade
from tidewright.operators.profile import Rule, load_findings, profile
from tidewright.operators.quantiles import exact_quantiles
from tidewright.operators.spikes import SpikeParams, implausible
from tidewright.operators.tiles import bar_index, with_halo
from tidewright.operators.trailing import rolling_totals

D = datetime.date
T = datetime.datetime


# ---- orphans


def test_ticker_spellings(spark):
    names = ["brk.b", " BRK-B\t", "BRK/B ", "BRK B", " BRK . B", None, " \t", ""]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "t string").select(canonical_ticker(F.col("t"))).collect()]
    assert got == ["BRK.B"] * 5 + [None] * 3


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_instants_do_not_hang_on_the_session(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        texts = ["2016-05-12T14:37:55Z", "2023-02-24T23:39:45-05:00", "2022-08-20 03:37:19", "2016-02-17T00:25:12+0900", "2020-01-01", "x", None]
        got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(instant(F.col("t")).cast("string")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == ["2016-05-12 14:37:55", "2023-02-25 04:39:45", "2022-08-20 03:37:19", "2016-02-16 15:25:12", "2020-01-01 00:00:00", None, None]


def frames(spark, setups, types, bars):
    s = spark.createDataFrame(setups, "row_id bigint, key string, at timestamp_ntz").withColumns({"first": F.lit(1), "open": F.lit(2), "reason": F.lit("x")})
    t = spark.createDataFrame(types, "row_id bigint, key string, start timestamp_ntz, until timestamp_ntz").withColumn("at", F.lit(3))
    b = spark.createDataFrame(bars, "key string")
    return {"s": s, "t": t, "b": b}


LINKS = [Link("s", "t", absent_at), Link("t", "b", absent)]


def test_orphans_of_every_kind(spark):
    at = lambda y: T(y, 6, 1)
    setups = [(1, "A", at(2015)), (2, "A", at(2010)), (3, "A", at(2021)), (4, "B", at(2015)), (5, None, at(2015)), (6, "C", at(2015)), (6, "C", at(2015)), (7, "A", None), (8, "E", at(2013)), (9, "E", at(2016)), (10, "F", T(2020, 1, 1))]
    types = [(1, "A", T(2012, 1, 1), T(2020, 1, 1)), (2, "C", None, None), (3, "D", None, None), (4, "E", T(2012, 1, 1), T(2014, 1, 1)), (5, "E", T(2014, 1, 1), T(2015, 1, 1)), (6, "F", T(2020, 1, 1), T(2020, 1, 1)), (6, "F", T(2020, 1, 1), T(2020, 1, 1))]
    out = orphan_cascade(frames(spark, setups, types, [("A",), ("E",), ("F",), (None,)]), LINKS).collect()
    got = sorted((r.child_table, r.row_id, r.reason, r.inherited) for r in out)
    assert got == [
        ("s", 2, "later", False), ("s", 3, "removed", False), ("s", 4, "missing", False), ("s", 5, "missing", False), ("s", 6, "orphaned parent", True), ("s", 6, "orphaned parent", True),
        ("s", 7, "removed", False), ("s", 9, "removed", False), ("s", 10, "removed", False), ("t", 2, "missing", False), ("t", 3, "missing", False),
    ]


def test_orphans_of_empty_tables(spark):
    assert orphan_cascade(frames(spark, [], [], []), LINKS).count() == 0
    assert orphan_cascade(frames(spark, [(1, "A", T(2015, 1, 1))], [(1, "A", None, None)], []), LINKS).filter("not inherited").count() == 1


def test_cascade_follows_chains_cycles_and_self_references(spark):
    # a tree of rows that refer to their parent's id: 1 is its own parent, 4's is gone, 5 and 6 hang on 4, 7 and 8 refer to each other
    tree = [(1, 1), (2, 1), (3, 2), (4, 99), (5, 4), (6, 5), (7, 8), (8, 7), (9, None), (10, 9)]
    df = spark.createDataFrame(tree, "row_id bigint, up bigint").withColumns({"period": F.lit("2020-01"), "reason": F.lit("clash"), "round": F.lit("x")})
    out = orphan_cascade({"t": df}, [Link("t", "t", absent, child_key="up", parent_key="row_id")]).collect()
    assert sorted((r.row_id, r.reason, r.inherited, r.round) for r in out) == [
        (4, "missing", False, 0), (5, "orphaned parent", True, 1), (6, "orphaned parent", True, 2), (9, "missing", False, 0), (10, "orphaned parent", True, 1),
    ]
    assert {r.period for r in out} == {"2020-01"}
    # two tables in a circle, one of which also refers to a third
    a = spark.createDataFrame([(1, 10, "x"), (2, 20, "y")], "row_id bigint, b bigint, c string")
    b = spark.createDataFrame([(10, 1), (20, 2)], "row_id bigint, a bigint")
    c = spark.createDataFrame([("x",)], "key string")
    links = [Link("a", "b", absent, "b", "row_id"), Link("b", "a", absent, "a", "row_id"), Link("a", "c", absent, "c", "key")]
    got = sorted((r.child_table, r.row_id, r.parent_table, r.round) for r in orphan_cascade({"a": a, "b": b, "c": c}, links).collect())
    assert got == [("a", 2, "b", 2), ("a", 2, "c", 0), ("b", 20, "a", 1)]


def test_long_chains_reach_the_end(spark):
    df = spark.createDataFrame([(i, i - 1) for i in range(1, 13)], "row_id bigint, up bigint")
    out = orphan_cascade({"t": df}, [Link("t", "t", absent, "up", "row_id")]).collect()
    assert sorted((r.row_id, r.round) for r in out) == [(i, i - 1) for i in range(1, 13)]


# ---- quantiles and profiles


@pytest.mark.parametrize("kind", ["linear", "nearest"])
def test_exact_quantiles_match_numpy(spark, kind):
    rng = np.random.default_rng(3)
    data = {None: rng.normal(size=999), "one": [5.0], "two": [1.0, 2.0], "ties": np.round(rng.normal(size=5000), 1), "many": rng.normal(size=20000), "even": rng.normal(size=188)}
    rows = [(k, float(v)) for k, vs in data.items() for v in vs] + [("one", None), ("one", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").withColumns({"n": F.lit(1), "i": F.lit(2), "_g0": F.lit(1)})
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = exact_quantiles(df, ["g"], "v", probs, kind).collect()
    assert len(got) == len(data) * len(probs)
    for r in got:
        x = np.sort(data[r.g])
        want = np.quantile(x, r.prob) if kind == "linear" else x[int(np.floor((len(x) - 1) * r.prob + 0.5))]
        assert r.n == len(x) and r.quantile == pytest.approx(want, abs=1e-12)
    assert exact_quantiles(df.limit(0), ["g"], "v", probs, kind).count() == 0
    assert exact_quantiles(df.limit(0), [], "v", probs, kind).count() == 0
    every = np.sort(np.concatenate([np.asarray(v) for v in data.values()]))
    for r in exact_quantiles(df, [], "v", probs, kind).collect():
        want = np.quantile(every, r.prob) if kind == "linear" else every[int(np.floor((len(every) - 1) * r.prob + 0.5))]
        assert r.n == len(every) and r.quantile == pytest.approx(want, abs=1e-12)


def loads(spark, broken=None):
    rng = np.random.default_rng(0)
    rows = []
    for load in (1, 2, 3, 4, 5, None):
        for i in range(200):
            x, s, b = float(rng.normal(0, 0.01)), "AB"[i % 2], 10 + i % 5
            if load == 2 and broken == "missing":
                x, s = (None, " ") if i % 3 else (float("nan"), "Unknown")
            if load == 2 and broken == "invalid":
                x, s, b = 5.0, "a", b + 1
            if load == 2 and broken == "shifted":
                x, s, b = x + 0.2, "A", b + 30
            rows.append((load, x, s, b, 10 + i % 5 + (30 if broken == "shifted" and load == 2 else 0), "clash"))
    return spark.createDataFrame(rows, "load_id int, x double, s string, b bigint, c bigint, word string")


RULES = lambda: [Rule("x", (F.col("x") > -1) & (F.col("x") < 1), True), Rule("s", F.col("s").isin("A", "B"), False, "Unknown"), Rule("b", F.col("b") == F.col("c"), True)]


@pytest.mark.parametrize("broken, want", [(None, set()), ("missing", {("x", "missing"), ("s", "missing")}), ("invalid", {("x", "invalid"), ("s", "invalid"), ("b", "invalid")}), ("shifted", {("x", "shifted"), ("s", "shifted"), ("b", "shifted")})])
def test_load_findings(spark, broken, want):
    got = load_findings(loads(spark, broken), "load_id", RULES()).collect()
    assert {(r.column_name, r.finding) for r in got} == want and all(r.load_id == 2 for r in got) and len(got) == len(want)


def test_profile_of_odd_columns(spark):
    df = spark.createDataFrame([(1, 1.0, "a", D(2020, 1, 1)), (1, 3.0, "B", None), (1, float("inf"), None, None), (1, None, " ", None), (2, float("nan"), "x" * 200_000, D(2021, 1, 1)), (2, 2.0, "x" * 200_000, D(2021, 1, 1))], "load_id int, x double, t string, d date")
    out = {(r.load_id, r.column_name): r for r in profile(df, "load_id", {"t": "^[a-z]+$"}).collect()}
    assert len(out) == 6
    x = out[1, "x"]
    assert (x.n, x.n_missing, x.n_distinct, x.n_finite, x.mean, x.q50, x.least, x.most) == (4, 1, 3, 2, 2.0, 2.0, "1.0", "3.0")
    assert (out[1, "t"].n_missing, out[1, "t"].n_violations, out[2, "t"].n_distinct) == (2, 1, 1)
    assert profile(df.limit(0), "load_id").count() == 0
    assert load_findings(loads(spark).limit(0), "load_id", RULES()).count() == 0


# ---- tiles


def test_tiles_number_and_repeat_rows(spark):
    df = spark.createDataFrame([("a", D(2019, 12, 31) + datetime.timedelta(i // 2), i) for i in range(40)], "s string, d date, k int")
    idx = bar_index(df, ["s"], F.year("d"), ["d", "k"])
    assert sorted((r.k, r.idx) for r in idx.collect()) == [(i, i) for i in range(40)]
    one = bar_index(df, ["s"], F.year("d"), ["d", "k"], one_per="d")
    assert sorted((r.k, r.idx) for r in one.collect()) == [(2 * i + 1, i) for i in range(20)]
    halo = with_halo(idx, "idx", 16, 3, 2).collect()
    for tile in (0, 1, 2):
        lo, hi = max(0, tile * 16 - 3), min(40, tile * 16 + 18)
        assert sorted(r.idx for r in halo if r.tile == tile) == list(range(lo, hi))
    assert sum(r.core for r in halo) == 40


# ---- spikes


def series(n=120, feed="f", ticker="A", seed=0, start=D(2020, 1, 1)):
    rng = np.random.default_rng(seed)
    c = 50 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    return [[i, feed, ticker, start + datetime.timedelta(i), float(x), float(x * 1.01), float(x * 0.99), float(x), int(100_000 * np.exp(rng.normal(0, 0.3))) + i, T(2021, 1, 1)] for i, x in enumerate(c)]


BARS = "bar_id bigint, feed string, ticker string, date date, open double, high double, low double, close double, volume bigint, loaded_at timestamp_ntz"


def flagged(spark, rows, **k):
    df = spark.createDataFrame(rows, BARS).withColumns({"idx": F.lit("clash"), "tile": F.lit(0), "series": F.lit("x"), "core": F.lit(1)})
    return {r.bar_id: r for r in implausible(df, SpikeParams(**k)).collect()}


def test_spikes_stuck_values_and_bounds(spark):
    rows = series()
    assert flagged(spark, rows) == {}
    rows[20][7] *= 3  # outside low..high, and a spike
    rows[40][5] *= 2  # a high
    rows[60][8] *= 500
    rows[70][8] *= 4  # a busy day is none
    rows[50][8] = 0  # halted
    for i in range(80, 90):
        rows[i][7] = rows[79][7]
        rows[i][5], rows[i][6] = max(rows[i][5], rows[i][7]), min(rows[i][6], rows[i][7])
    for i in range(100, 108):
        rows[i][8] = rows[99][8]
    rows[110][6] = 0.0
    rows[112][8] = -5
    rows[113][4] = None
    got = flagged(spark, rows)
    assert set(got) == {20, 40, 60, *range(80, 90), *range(100, 108), 110, 112}
    assert got[20].out_of_bounds and got[20].is_spike and got[40].is_spike and not got[40].out_of_bounds
    assert got[85].is_stuck and got[60].is_spike and got[110].out_of_bounds


def test_level_changes_breaks_and_ends_are_no_cases(spark):
    rows = series()
    for r in rows[60:]:
        for j in range(4, 8):
            r[j] /= 4
    rows[0][3] = D(2019, 1, 1)
    assert flagged(spark, rows) == {}


def test_deliveries_are_judged_each(spark):
    rows = series()
    good = [*rows[30]]
    good[0], good[9] = 1000, T(2022, 1, 1)
    rows[30][7] *= 5
    assert set(flagged(spark, [*rows, good])) == {30}
    good[9] = T(2020, 1, 1)  # the bad one is loaded last
    assert set(flagged(spark, [*rows, good])) == {30}
    rows[30][0] = good[0] = 30
    assert set(flagged(spark, [*rows, rows[30]])) == {30}


def test_tiles_do_not_change_spikes(spark):
    rows = series(400)
    for i in (3, 31, 32, 33, 64, 100, 200, 255, 256, 300):
        rows[i][5] *= 3
    for i in range(120, 132):
        rows[i][8] = 77_777
    whole, tiled = flagged(spark, rows), flagged(spark, rows, tile=32, halo=32)
    assert set(whole) == set(tiled) and {3, 31, 255, 300, *range(121, 132)} <= set(whole)


def test_spikes_of_nulls_and_nothing(spark):
    rows = [[1, None, None, None, None, None, None, None, None, None], [2, None, "A", D(2020, 1, 1), -1.0, 1.0, 1.0, 1.0, 5, None], [3, "f", None, None, float("nan"), 2.0, 3.0, 2.5, None, None]]
    assert set(flagged(spark, rows)) == {2, 3}
    assert flagged(spark, []) == {}


# ---- rolling totals


def test_rolling_totals_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows, k = [], 0
    for feed, ticker in (("f", "A"), ("f", "B"), (None, "A"), ("g", None)):
        day = D(2020, 1, 1)
        for i in range(90):
            day += datetime.timedelta(int(rng.choice([1, 1, 1, 3, 40 if i % 30 == 7 else 1, 400 if i == 50 else 1])))
            close = None if rng.random() < 0.03 else float(np.round(rng.uniform(5, 50), 2))
            rows.append([k, feed, ticker, day, 1.0, 1.0, 1.0, close, None if rng.random() < 0.03 else int(rng.integers(0, 10**6)), T(2021, 1, 1)])
            k += 1
            if rng.random() < 0.1:
                rows.append([k, feed, ticker, day, 1.0, 1.0, 1.0, 7.5, 1234, T(2022, 1, 1)])
                k += 1
    rows.append([k, "f", "A", None, 1.0, 1.0, 1.0, 1.0, 9, None])
    df = spark.createDataFrame(rows, BARS).withColumns({"day": F.lit("clash"), "tile": F.lit(0)})
    got = {(r.feed, r.ticker, r.day): r for r in rolling_totals(df).collect()}
    n = 0
    for key in {(r[1], r[2]) for r in rows}:
        one = {}
        for r in sorted((r for r in rows if (r[1], r[2]) == key and r[3]), key=lambda r: (r[3], r[9], r[0])):
            one[r[3]] = (r[7], r[8])
        days = sorted(one)
        closes, volumes = [one[d][0] for d in days], [one[d][1] for d in days]
        day = days[0]
        while day <= days[-1]:
            r = got[(*key, day)]
            n += 1
            for w, total, mean in ((7, r.total_7d, r.avg_7d), (30, r.total_30d, r.avg_30d)):
                span = [day - datetime.timedelta(j) for j in range(w) if day - datetime.timedelta(j) >= days[0]]
                want = sum(one.get(x, (None, 0))[1] or 0 for x in span)
                assert total == want and mean == pytest.approx(want / len(span))
            assert r.is_bar == (day in one)
            if day in one:
                i = days.index(day)
                for size, lag, values, have in ((20, 0, closes, r.sma_20), (50, 0, closes, r.sma_50), (20, 1, volumes, r.vol_avg_20)):
                    part = values[i - size + 1 - lag : i + 1 - lag] if i - size + 1 - lag >= 0 else []
                    want = sum(part) / size if len(part) == size and None not in part else None
                    assert have == (pytest.approx(want) if want is not None else None)
            else:
                assert r.sma_20 is None and r.volume == 0
            day += datetime.timedelta(1)
    assert n == len(got)
    assert rolling_totals(df.limit(0)).count() == 0


def test_tiles_do_not_change_the_scale_of_a_series(spark):
    # volatility, and the share of held closes, change along the series
    rng = np.random.default_rng(9)
    n = 4200
    step = rng.normal(0, np.where(np.arange(n) < 2000, 0.002, 0.03), n)
    step[2500:][rng.random(n - 2500) < 0.3] = 0
    c = 50 * np.exp(np.cumsum(step - step.mean()))
    rows = [[i, "f", "A", D(2005, 1, 1) + datetime.timedelta(i), float(x), float(x * 1.01), float(x * 0.99), float(x), int(100_000 * np.exp(rng.normal(0, 0.3))) + i, T(2021, 1, 1)] for i, x in enumerate(c)]
    for i in range(30, n, 97):
        rows[i][5] *= float(np.exp(rng.uniform(0.02, 0.5)))
    for i in (511, 512, 1023, 1024, 2047, 2048, 4095, 4096):
        for j in range(i, i + 3):
            rows[j][7] = rows[i][7]
    got = {tile: {k: tuple(v) for k, v in flagged(spark, rows, tile=tile).items()} for tile in (128, 512, 1024, 2048, 8192)}
    assert len(got[8192]) > 10
    for tile in (512, 1024, 2048):
        assert got[tile] == got[8192], tile
    assert set(got[128]) == set(got[8192])
