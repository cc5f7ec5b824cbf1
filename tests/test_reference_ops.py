"""Sources, sinks, detection, spacing, events and estimation on small cases."""

import datetime
import json
import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewright.functions import windows as fw
from tidewright.operators import audit, detect, events, quantreg, stats
from tidewright.operators.series import BreakoutParams, SeriesParams, UniverseParams, add_features, add_segments, breakouts, universe
from tidewright.sources import bars as src
from tidewright.sources import sinks

D = datetime.date
BARS = "ticker string, date date, open double, high double, low double, close double, volume bigint"


def days(n, start=D(2020, 1, 1)):
    return [start + datetime.timedelta(i) for i in range(n)]


# ---- sources and sinks


def test_bars_in_any_spelling(spark):
    day = D(2020, 3, 4)
    ns = (day - D(1970, 1, 1)).days * 86_400_000_000_000 + 1
    made = [
        spark.createDataFrame([("A", ns, 1.0, 2.0, 0.5, 1.5, 10)], "symbol string, t bigint, o double, h double, l double, c double, v bigint"),
        spark.createDataFrame([("A", "2020-03-04", 1.0, 2.0, 0.5, 1.5, 10.0)], "ticker string, date string, open double, high double, low double, close double, volume double"),
        spark.createDataFrame([("A", datetime.datetime(2020, 3, 4, 5), 1.0, 2.0, 0.5, 1.5, 10)], "ticker string, window_start timestamp_ntz, open double, high double, low double, close double, v int"),
    ]
    for raw in made:
        assert src.normalize_bars(raw).collect() == [("A", day, 1.0, 2.0, 0.5, 1.5, 10)]
    with pytest.raises(ValueError, match="volume"):
        src.normalize_bars(made[0].drop("v"))
    assert src.normalize_splits(made[0].select("symbol")) is None and src.read_splits(spark, "/nowhere") is None
    assert src.normalize_splits(spark.createDataFrame([("A", day), ("A", day)], "symbol string, ex_date date")).collect() == [("A", day)]


def test_factor_files(spark, tmp_path):
    text = "Title é\nmore\n\n,Mkt,SMB\n20200101, 1.50, -99.99\n20200102 ,0.5,2\n\n20210101,9,9\n"
    path = str(tmp_path / "f.zip")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("readme.txt", "no")
        z.writestr("F.CSV", text.encode("latin-1"))
    lines = src.text_lines(spark, src.zip_member_text(path))
    out = src.parse_factors(lines, ["mkt", "smb"]).orderBy("date").collect()
    assert [tuple(r) for r in out] == [(D(2020, 1, 1), 0.015, pytest.approx(-0.9999)), (D(2020, 1, 2), 0.005, 0.02)]
    assert src.data_block(src.text_lines(spark, "a\nb\n")).count() == 0
    panel = src.factor_panel(src.parse_factors(lines, ["mkt"]), spark.createDataFrame([(D(2020, 1, 2), float("nan")), (D(2020, 1, 1), None)], "date date, umd double"))
    assert panel.count() == 1  # NaN stays, null goes


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i < 3 else float(i), 'say "hi", | \n') for i in range(50)], "k int, x double, t string")
    out = str(tmp_path / "o")
    assert sinks.gated_write(df, out, ["x"]) == {"x": 0.06} and not os.path.exists(out)
    assert sinks.gated_write(df, out, ["x"], 0.1) == {} and spark.read.parquet(out).count() == 50
    sinks.write_sample_csv(df, out + "s", 10, 1, "k")
    assert spark.read.csv(out + "s", header=True).count() == 10
    for _ in range(2):
        sinks.append_csv(df.select("k", F.lit('a,"b"').alias("t")).limit(4), out + "l")
    log = sinks.read_csv_log(spark, out + "l", "k int, t string")
    assert log.count() == 8 and {r.t for r in log.collect()} == {'a,"b"'}
    sinks.json_summary({"a": df.limit(2)}, out + "j")
    assert [r["k"] for r in json.load(open(out + "j"))["a"]] == [0, 1]
    text = sinks.markdown("T", {"one": df.limit(1)})
    assert text.startswith("# T\n\n## one\n\n| k | x | t |\n| --- | --- | --- |\n| 0 | – | say")


def test_caches_and_year_folders(spark, tmp_path):
    from tidewright.sources.tables import read_or_make, years_of

    made = []
    make = lambda: made.append(1) or spark.range(3).withColumn("year", F.lit(2020))
    path = str(tmp_path / "cache")
    assert [read_or_make(spark, path, make).count() for _ in range(2)] == [3, 3] and len(made) == 1
    for y in (2020, 2021):
        sinks.write_parquet(spark.range(y - 2018), str(tmp_path / "bars" / str(y)))
    assert years_of(spark, str(tmp_path / "bars")).count() == 5
    sinks.write_parquet(spark.range(4).withColumn("year", F.col("id") % 2), str(tmp_path / "parts"), ("year",))
    assert spark.read.parquet(str(tmp_path / "parts")).filter("year = 1").count() == 2


# ---- windows and audits


def test_rank_share_of_ties(spark):
    df = spark.createDataFrame([("d", v) for v in (1.0, 2.0, 2.0, 4.0)], "g string, v double")
    assert sorted(r[0] for r in df.select(fw.rank_share("v", ["g"])).collect()) == [0.25, 0.625, 0.625, 1.0]


def test_full_windows_and_first_extremes(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([5.0, 7.0, 7.0, None, 6.0])], "g string, i int, v double")
    over = W.partitionBy("g").orderBy("i")
    assert [r[0] for r in df.select(fw.rolling("v", over, 2)).collect()] == [None, 6.0, 7.0, None, None]
    assert df.groupBy("g").agg(fw.first_argmax("i", "v").alias("x"), fw.first_argmin("i", "v").alias("n")).first()[1:] == (1, 0)
    odd = spark.createDataFrame([(float("nan"), "  "), (None, None), (2.0, "x"), (-1.0, " x")], "v double, t string")
    assert [tuple(r) for r in odd.select(fw.clip01("v"), fw.missing("v"), fw.finite("v"), fw.text_or("t", "U")).collect()] == [(None, True, False, "U"), (None, True, False, "U"), (1.0, False, True, "x"), (0.0, False, True, " x")]
    assert odd.select(fw.ratio(F.lit(1.0), F.lit(0.0)), fw.log_ratio(F.lit(1.0), F.lit(0.0))).first()[:] == (None, None)


def test_segments_cut_at_the_gap(spark):
    dates = [D(2020, 1, 1), D(2020, 1, 2), D(2020, 3, 1), D(2020, 4, 30), D(2020, 5, 1)]
    df = spark.createDataFrame([("A", d) for d in dates], "ticker string, date date")
    assert [(r.gap_days, r.segment_id) for r in add_segments(df).orderBy("date").collect()] == [(0, 0), (1, 0), (59, 0), (60, 1), (1, 1)]


def test_audit_counts_rows_and_categories(spark):
    rows = [("A", D(2019, 12, 31), 1.0, 1.0, 1.0, 1.0, 1), ("A", D(2020, 1, 1), 9.0, 9.0, 9.0, 9.0, 5), ("A", D(2020, 1, 2), -1.0, 1.0, 2.0, -1.0, 5), ("A", D(2020, 1, 3), 5.0, 6.0, 4.0, None, 5), ("A", D(2020, 1, 4), 2.0, 3.0, 1.0, 2.0, 5), ("A", D(2020, 1, 5), 4.0, 5.0, 3.0, 4.0, 5)]
    flags = audit.bar_flags(spark.createDataFrame(rows, BARS), "2020-01-01", "2020-12-31")
    t = audit.audit_totals(flags).first()
    assert (t.n_bars, t.n_bad_order, t.n_has_null, t.n_not_positive, t.n_flat, t.n_jump, t.n_hard) == (5, 1, 1, 1, 1, 1, 4)
    assert audit.audit_years(flags).first()[1:3] == (5, 3)
    splits = spark.createDataFrame([("A", D(2020, 1, 5)), ("A", D(2020, 1, 5))], "ticker string, date date")
    assert audit.unexplained_moves(flags, splits).first()[:] == (1, 0) and audit.unexplained_moves(flags, None).first()[:] == (1, None)


# ---- detection


def brute(f, t, p):
    """The stages for the bar at position t of a list of feature rows of one segment."""
    lo, hi = max(0, t - p.pivot_back), t - p.pivot_lag
    if hi < lo:
        return None
    pivot = max(range(lo, hi + 1), key=lambda i: (f[i].high, -i))
    ph = f[pivot].high
    if sum(f[i].high >= ph * p.near_share for i in range(max(0, pivot - p.near), min(t - 1, pivot + p.near) + 1)) - 1 < p.near_least:
        return None
    if pivot > 0 and f[pivot].open / f[pivot - 1].close - 1 > p.gap_open:
        return None
    legs = [i for i in range(max(0, pivot - p.leg_most), pivot - p.leg_least + 1) if p.gain_least <= (ph - f[i].close) / f[i].close <= p.gain_most and sum(f[k].close > f[k - 1].close for k in range(i + 1, pivot + 1)) / (pivot - i) >= p.up_share]
    if not legs:
        return None
    leg = min(range(legs[0], min(legs[0] + p.snap, pivot - p.leg_least) + 1), key=lambda i: (f[i].close, i))
    base = f[pivot:t]
    drops = [(ph - x.low) / ph for x in base]
    if not p.base_least <= len(base) <= p.base_most or max(drops) < p.pullback:
        return None
    if max(drops) > p.drop_most and (sum(p.drop_most < d <= p.drop_exception for d in drops) > p.exceptions or max(drops) > p.drop_exception):
        return None
    for m in ("sma_10", "sma_20"):
        if f[pivot][m] and f[t - 1][m] and f[t - 1][m] < f[pivot][m] * p.rising:
            return None
    touch = sum(any(x[m] and x.low <= x[m] * p.touch_low and x.close >= x[m] * p.touch_close for m in ("sma_10", "sma_20", "sma_50")) for x in base)
    if touch / len(base) < p.touch_share:
        return None
    run = most = 0
    for k in range(t - 4, t):
        run = run + 1 if f[k].close > f[k].open and f[k].close > p.up_close * f[k - 1].close else 0
        most = max(most, run)
    if (f[t - 1].close - f[t - 5].open) / f[t - 5].open > p.extension or f[t - 1].close / f[t - 1].sma_10 - 1 > p.above_mean or most > p.up_run:
        return None
    return f[leg].date, f[pivot].date, len(base)


def test_detection_equals_a_loop(spark):
    rng = np.random.default_rng(11)
    rows = []
    for name in "ABCDEF":
        c = 20 * np.exp(np.cumsum(rng.normal(0.004, 0.02, 300)))
        o = c * np.exp(rng.normal(0, 0.004, 300))
        for i, d in enumerate(days(300)):
            rows.append((name, d, float(o[i]), float(max(o[i], c[i]) * 1.006), float(min(o[i], c[i]) * 0.994), float(c[i]), int(rng.integers(10**5, 10**6))))
    f = add_features(spark.createDataFrame(rows, BARS), "ticker", SeriesParams(momentum_long=30, momentum_short=5, year=60)).withColumn("series", F.col("ticker")).persist()
    p = detect.PatternParams(gain_least=0.1, drop_most=0.15, drop_exception=0.2, pullback=0.02, touch_share=0.2)
    u = universe(f, UniverseParams("2020-01-01", "2021-12-31", 1.0, 1.0, 30))
    got = detect.evaluate(breakouts(u, BreakoutParams(1.0, 0.0, 0.0)), f, p).collect()
    by = {n: sorted((r for r in f.collect() if r.ticker == n), key=lambda r: r.date) for n in "ABCDEF"}
    n = 0
    for r in got:
        want = brute(by[r.ticker], r.days_in_segment - 1, p)
        assert r.passed == (want is not None)
        if want:
            n += 1
            assert (r.legup_low_date, r.legup_high_date, r.cons_duration_days) == want
    assert n > 5 and len(got) > n + 50
    setups = detect.detect_setups(breakouts(u, BreakoutParams(1.0, 0.0, 0.0)), f, p, (detect.Variant("strict", 0.9, 0.15), detect.Variant("loose", 0.0)))
    assert setups.columns == ["series", *detect.OUTPUT] and setups.count() > 0
    out, relaxed = detect.detect_or_relax(breakouts(u), f, detect.PatternParams(), p, breakouts(u, BreakoutParams(1.0, 0.0, 0.0)), variants=(detect.Variant("loose", 0.0),))
    assert relaxed and out.count() > 0
    f.unpersist()


def test_spacing_equals_a_loop(spark):
    rng = np.random.default_rng(2)
    rows = [("A" if i % 2 else "B", D(2020, 1, 1) + datetime.timedelta(int(k)), int(k) // 200, int(k) % 200, float(rng.choice([0.2, 0.4, 0.6]))) for i, k in enumerate(sorted(rng.choice(900, 120, replace=False)))]
    df = spark.createDataFrame(rows, "ticker string, date date, segment_id bigint, days_in_segment bigint, score double").withColumn("more", F.col("score") * 2)
    got = sorted((r.ticker, r.date, r.score) for r in detect.space_out(df, "ticker", 30).collect())
    want = []
    for name in "AB":
        kept = []
        for r in sorted(r for r in rows if r[0] == name):
            far = lambda k: abs(r[3] - k[3]) if r[2] == k[2] else abs((r[1] - k[1]).days) / 1.4  # noqa: E731, B023
            hit = next((i for i, k in enumerate(kept) if far(k) < 30), None)
            if hit is None:
                kept.append(r)
            elif r[4] > kept[hit][4]:
                kept[hit] = r
        want += [(r[0], r[1], r[4]) for r in kept]
    assert got == sorted(want)
    assert detect.space_out(df.limit(0), "ticker").count() == 0


# ---- events


def test_forward_returns_and_reasons(spark):
    bars = spark.createDataFrame([("A", d, float(i + 1)) for i, d in enumerate(days(30))] + [("Z", d, 0.0) for d in days(30)], "ticker string, date date, close double")
    ev = spark.createDataFrame([(1, "A", D(2020, 1, 2)), (2, "A", D(2019, 1, 1)), (3, "A", D(2020, 1, 25)), (4, "Q", D(2020, 1, 2)), (5, "Z", D(2020, 1, 2)), (6, None, None)], "k int, ticker string, date date")
    got = {r.k: (r.fwd_ret, r.fwd_end_date, r.fwd_reason) for r in events.forward_returns(ev, bars, "ticker").collect()}
    assert got == {1: (10.0, D(2020, 1, 22), None), 2: (None, None, "date not found"), 3: (None, None, "too few bars after"), 4: (None, None, "no bars"), 5: (None, None, "bad close"), 6: (None, None, "no bars")}
    fac = spark.createDataFrame([(d, 0.01) for d in days(10)], "date date, m double")
    win = events.factor_windows(spark.createDataFrame([(D(2020, 1, 2), D(2020, 1, 5)), (D(2020, 1, 2), D(2021, 1, 1)), (D(2020, 1, 2), None)], "date date, fwd_end_date date"), fac, ["m"])
    assert sorted(r.m_window or 0 for r in win.collect()) == [0, 0, pytest.approx(0.03)]


def test_window_features(spark):
    bars = spark.createDataFrame([("A", d, 10.0, 11.0, 9.0, 10.0 * 1.01**i, 100 if i < 5 else 300) for i, d in enumerate(days(10))] + [("B", d, 1.0, 1.0, 1.0, 0.0, 1) for d in days(3)], BARS)
    spy = spark.createDataFrame([(d, 100.0) for i, d in enumerate(days(10)) if i not in (3, 4)], "date date, close double")
    ev = spark.createDataFrame([(1, "A", D(2020, 1, 1), D(2020, 1, 10)), (2, "A", D(2020, 2, 1), D(2020, 2, 5)), (3, "C", D(2020, 1, 1), D(2020, 1, 3)), (4, "B", D(2020, 1, 1), D(2020, 1, 3)), (5, "A", D(2020, 1, 1), D(2020, 1, 1))], "k int, ticker string, a date, b date")
    got = {r.k: r for r in events.window_features(ev, bars, spy, "ticker", "k", "a", "b").collect()}
    assert got[1].vol_contraction_ratio == 3.0 and got[1].rs_slope == pytest.approx(np.log(1.01)) and got[1].n_bars == 10
    assert got[2].drop_reason == "no bars in window" and got[3].drop_reason == "no bars"
    assert got[4].adr_pct is None and got[5].vol_contraction_ratio is None and got[5].rs_slope is None


# ---- estimation


def test_ols_equals_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3)) * [1, 1000, 0.001]
    x[:, 2] = x[:, 0] * 2 if False else x[:, 2]
    y = 1 + x @ [2, 0.003, 5] + rng.normal(size=400)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, y double")
    fit = stats.ols(df, ["a", "b", "c"], "y")
    z = np.column_stack([np.ones(400), x])
    b = np.linalg.lstsq(z, y, rcond=None)[0]
    r = y - z @ b
    se = np.sqrt(np.diag(np.linalg.inv(z.T @ z)) * (r @ r) / 396)
    assert np.allclose(fit.coef, b, rtol=1e-8) and np.allclose(fit.std_err, se, rtol=1e-6)
    assert fit.r2 == pytest.approx(1 - r @ r / ((y - y.mean()) ** 2).sum()) and fit.n == 400
    twin = stats.ols(df.withColumn("a2", F.col("a") * 3), ["a", "a2"], "y")  # collinear
    assert np.isfinite(twin.coef).all() and twin.r2 == pytest.approx(stats.ols(df, ["a"], "y").r2, rel=1e-6)
    assert stats.student_p(2.0, 10) == pytest.approx(0.07338803, abs=1e-7) and stats.student_p(0.0, 5) == 1.0 and stats.student_p(1.96, 1e6) == pytest.approx(0.05, abs=1e-4)


def test_residuals_are_orthogonal_and_capped(spark):
    rng = np.random.default_rng(1)
    rows = [(i, D(2014 + i % 5, 1 + i % 12, 1), "ST"[i % 2] if i % 7 else "U", float(rng.normal()), float(rng.normal()), float(rng.exponential())) for i in range(600)]
    rows += [(1000, D(2019, 1, 1), "new", 1.0, 1.0, 99.0), (1001, D(2015, 1, 1), "S", float("nan"), 1.0, 1.0), (1002, D(2015, 1, 1), "S", 1.0, None, 1.0)]
    df = spark.createDataFrame(rows, "k int, date date, sector string, y double, f double, v double")
    out, info = stats.residualize(df, "y", ["f"], "2014-01-01", "2017-12-31", cap="v")
    got = out.collect()
    assert len(got) == 601 and info["sector_ref"] in "ST" and info["year_ref"] == 2014
    train = [r for r in got if r.date.year <= 2017]
    assert abs(sum(r.y_resid for r in train)) < 1e-8 and abs(sum(r.y_resid * r.f for r in train)) < 1e-8
    assert all(abs(sum(r.y_resid for r in train if r.sector == s)) < 1e-8 for s in "STU")
    v = sorted(r.v for r in train)
    assert info["p99"] == v[int(np.floor((len(v) - 1) * 0.99 + 0.5))] and max(r.v_w for r in got) == info["p99"]
    assert stats.winsorize(spark.createDataFrame([(float("nan"),), (None,), (5.0,)], "v double"), "v", 1.0).filter("v_w = 1.0").count() == 1


def test_correlations_of_constant_columns(spark):
    df = spark.createDataFrame([(float(i), float(i * 2), 1.0, None if i == 0 else 1.0 * i) for i in range(9)], "a double, b double, k double, n double")
    got = {(r.a, r.b): r.corr for r in stats.correlations(df, ["a", "b", "k", "n"]).collect()}
    assert got["a", "b"] == pytest.approx(1) and got["a", "k"] is None and len(got) == 10
    assert {r.corr for r in stats.correlations(df.limit(0), ["a", "b"]).collect()} == {None}


def test_quantile_regression_is_optimal(spark):
    rng = np.random.default_rng(3)
    x = np.column_stack([np.ones(300), rng.normal(size=(300, 2))])
    y = x @ [1, 2, -1] + rng.standard_t(3, 300) * (1 + 0.5 * np.abs(x[:, 1]))
    for tau in (0.1, 0.5, 0.9):
        b, used = quantreg.solve(x, y, tau)
        assert used < 1000
        best = quantreg.check_loss(y - x @ b, tau)
        assert all(best <= quantreg.check_loss(y - x @ (b + rng.normal(0, s, 3)), tau) + 1e-4 for s in (0.001, 0.01, 0.1) for _ in range(30))
        assert abs(np.mean(y - x @ b < 0) - tau) < 0.02
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (_, a, b), c in zip(x, y)], "a double, b double, y double")
    far, used = quantreg.distributed_fit(df, ["a", "b"], "y", 0.9, max_iter=60)
    near, _ = quantreg.solve(x, y, 0.9)
    assert used <= 60 and np.allclose(far, near, atol=1e-6)  # two methods, one optimum


def test_grid_bootstrap_and_inference(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([("pq"[i % 2], float(rng.normal()), float(rng.normal()), float(rng.normal())) for i in range(200)] + [("p", None, 1.0, 1.0), ("p", float("nan"), 1.0, 1.0)], "panel string, a double, b double, y double")
    g = quantreg.estimation_grid(df, "panel", {"one": ["a"], "two": ["a", "b"]}, "y", [0.5, 0.9])
    rows = g.collect()
    assert len(rows) == 2 * 3 * (2 + 3) and all(r.n == 100 for r in rows) and all((r.tau is None) == (r.model == "ols") for r in rows)
    assert sorted(map(str, g.repartition(5).collect())) == sorted(map(str, rows))
    assert quantreg.headline(g, "a").count() == 4 and quantreg.coefficient_table(g, ["ols", "qr_0.5"]).count() == 10
    x, y = np.column_stack([np.ones(80), rng.normal(size=80)]), rng.normal(size=80)
    draws = quantreg.bootstrap(spark, x, y, {"real": 12, "placebo": 6}, "t", 5, 10)
    one, two = (sorted(map(str, d.collect())) for d in (draws, quantreg.bootstrap(spark, x, y, {"real": 12, "placebo": 6}, "t", 5, 10)))
    assert one == two and len(one) == 19
    long = quantreg.number_draws(draws)
    assert sorted((r.mode, r.draw_idx) for r in long.collect() if r.mode != "real") == [("placebo", i) for i in range(6)] + [("point", -1)]
    s = quantreg.inference(draws).first()
    assert s.n + s.n_placebo <= 18 and s.lo <= s.hi and 0 < s.p_one_sided <= 1 and s.basic_hi == pytest.approx(2 * s.theta - s.lo)
    at = quantreg.block_indices(500, 30, rng)
    assert len(at) == 500 and at.min() >= 0 and at.max() < 500 and np.mean(np.diff(at) % 500 == 1) > 0.9


# ---- streaming


def test_stream_of_bars(spark, tmp_path):
    from tidewright.streaming.bars import daily_counts, impossible_bars

    schema = "bar_id bigint, feed string, open double, high double, low double, close double, volume bigint, loaded_at timestamp_ntz"
    rows = [(i, "f", 1.0, 2.0 if i % 5 else -2.0, 0.5, 1.5, 10, datetime.datetime(2020, 1, 1 + i // 10, 3)) for i in range(40)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("bad", impossible_bars(stream()), "append"), ("daily", daily_counts(stream()), "complete")):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("bad").count() == 8
    assert sorted((r.n_bars, r.n_bad) for r in spark.table("daily").collect()) == [(10, 2)] * 4
