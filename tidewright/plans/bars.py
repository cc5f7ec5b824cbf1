"""Queries on bars: sources, audits, windows, universe and pattern detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewright.functions.windows import first_argmax, first_argmin
from tidewright.operators import audit
from tidewright.operators.detect import STAGES, PatternParams, Variant, detect_setups, evaluate
from tidewright.operators.spikes import physical_bounds
from tidewright.operators.series import add_segments, breakouts, universe
from tidewright.plans.common import BARS_SQL, BREAKOUT, FEATURES_SQL, SERIES, UNIVERSE, bars, by_series, features
from tidewright.sources.bars import normalize_bars, normalize_splits
from tidewright.sources.tables import table

START, END = "2014-01-01", "2024-12-31"
PATTERN = PatternParams(gain_least=0.05, base_most=60, drop_exception=0.5, drop_most=0.4, pullback=0.01, up_share=0.3, near_share=0.9, touch_share=0.3)


def scan_projection_s1_s5(spark: SparkSession, d: str) -> DataFrame:
    """Pruned columns and a pushed date range."""
    rows = table(spark, d, "daily_bars").select("feed", "date", "volume").filter(F.col("date").between(F.lit("2018-01-01").cast("date"), F.lit("2019-12-31").cast("date")))
    return rows.groupBy("feed").agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"))


def normalize_bars_s2(spark: SparkSession, d: str) -> DataFrame:
    """Bars spelled as symbol, t (epoch nanoseconds), o, h, l, c, v and put right again."""
    raw = bars(spark, d).select("feed", F.col("ticker").alias("symbol"), (F.unix_date("date").cast("bigint") * 86_400_000_000_000 + 3_600_000_000_000).alias("t"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.col("volume").alias("v"))
    return normalize_bars(raw.drop("feed"))


def splits_s3(spark: SparkSession, d: str) -> DataFrame:
    return normalize_splits(table(spark, d, "splits"))


def _flagged(spark: SparkSession, d: str) -> DataFrame:
    return audit.bar_flags(bars(spark, d), START, END, "series")


def bar_audit_d1(spark: SparkSession, d: str) -> DataFrame:
    return audit.audit_totals(_flagged(spark, d))


def bar_audit_years_a3(spark: SparkSession, d: str) -> DataFrame:
    return audit.audit_years(_flagged(spark, d)).withColumn("share", F.round("share", 9))


def unexplained_moves_j1(spark: SparkSession, d: str) -> DataFrame:
    return audit.unexplained_moves(_flagged(spark, d), normalize_splits(table(spark, d, "splits")))


def coverage_j12_a4(spark: SparkSession, d: str) -> DataFrame:
    return audit.coverage(bars(spark, d), 2010, 2025)


PROBES = ["QIDX", "RCMNQ", "NOSUCH", "WLGWG", "ZZZZZZ"]


def probes_d2_j11(spark: SparkSession, d: str) -> DataFrame:
    return audit.probes(bars(spark, d), PROBES)


def probe_verdict_a23(spark: SparkSession, d: str) -> DataFrame:
    return audit.probe_verdict(audit.probes(bars(spark, d), PROBES))


def segments_w2_w3(spark: SparkSession, d: str) -> DataFrame:
    return add_segments(bars(spark, d), "series", SERIES.gap_days).select("series", "date", "gap_days", "segment_id")


def recycled_share_a7(spark: SparkSession, d: str) -> DataFrame:
    """Share of series with more than one segment."""
    top = add_segments(bars(spark, d), "series", SERIES.gap_days).groupBy("series").agg(F.max("segment_id").alias("m"))
    return top.agg(F.count(F.lit(1)).alias("n_series"), F.count_if(F.col("m") > 0).alias("n_recycled"), F.max("m").alias("most_segments"))


FEATURE_ROUND = {"sma_10": 6, "sma_20": 6, "sma_50": 6, "vol_avg_20": 4, "adr_20": 8, "mom_12_1": 8, "high_252": 6, "daily_range_pct": 8, "dist_52w_high_pct": 8}


def rolling_features_w4_w12(spark: SparkSession, d: str) -> DataFrame:
    return features(spark, d).select("series", "date", "segment_id", "days_in_segment", "prev_high", "cum_up", (F.round(F.col("adv_20") / 1e6, 4)).alias("adv_20_m"), *[F.round(c, k).alias(c) for c, k in FEATURE_ROUND.items()])


def universe_d3_w13(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the universe with the average-rank percentile of momentum."""
    types = table(spark, d, "yfinance_types").filter(F.col("quote_type") != "EQUITY").select("ticker")
    return universe(features(spark, d), UNIVERSE, types).select("series", "date", F.round("mom_12_1", 8).alias("mom_12_1"), F.round("mom_pct", 9).alias("mom_pct"))


def breakout_mask_p19(spark: SparkSession, d: str) -> DataFrame:
    return breakouts(universe(features(spark, d), UNIVERSE), BREAKOUT).select("series", "date", "close", "volume", F.round("mom_pct", 9).alias("mom_pct"))


def funnel_a8(spark: SparkSession, d: str) -> DataFrame:
    """Rows that are left after each filter, in one pass."""
    f = features(spark, d)
    u = UNIVERSE
    steps = {
        "in_dates": F.col("date").between(F.lit(u.start).cast("date"), F.lit(u.end).cast("date")), "price": F.col("close") > u.min_close, "dollar_volume": F.col("adv_20") > u.min_adv_20,
        "history": F.col("days_in_segment") - 1 >= u.min_history, "momentum": F.col("mom_12_1").isNotNull(),
    }
    aggs, so_far = [F.count(F.lit(1)).alias("all_rows")], F.lit(True)
    for name, test in steps.items():
        so_far = so_far & test
        aggs.append(F.count_if(so_far).alias(name))
    return f.agg(*aggs)


def _candidates(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    f = features(spark, d)
    return breakouts(universe(f, UNIVERSE), BREAKOUT), f


MEASURES = {
    "legup_gain_pct": 7, "pre_legup_return": 7, "cons_max_drop_pct": 7, "cons_low_trend_slope": 8, "ma_touches_pct_in_cons": 7, "range_contraction_ratio": 7, "pct_closes_above_20ma_in_cons": 7, "breakout_volume_ratio": 7,
}


def pattern_stages_d4_d8(spark: SparkSession, d: str) -> DataFrame:
    """Every breakout with the outcome of each stage and its measures (also the diagnosis of chosen rows)."""
    c, f = _candidates(spark, d)
    e = evaluate(c, f, PATTERN)
    return e.select(
        "series", "date", *[F.coalesce(F.col(s), F.lit(False)).alias(s) for s in STAGES], "passed", "legup_low_date", "legup_high_date", "legup_duration_days", "cons_duration_days", "cons_exception_days", "higher_low_count",
        *[F.round(m, k).alias(m) for m, k in MEASURES.items()],
    )


def setups_d9_d13(spark: SparkSession, d: str) -> DataFrame:
    """Setups of both variants, scored and spaced."""
    c, f = _candidates(spark, d)
    return detect_setups(c, f, PATTERN, (Variant("strict", 0.60, 0.15), Variant("loose", 0.20)), 20)


def impossible_bars_p22(spark: SparkSession, d: str) -> DataFrame:
    """Delivered rows whose own values cannot be."""
    return table(spark, d, "daily_bars").filter(physical_bounds()).select("bar_id", "feed", "ticker", "date")


def first_extremes_a17(spark: SparkSession, d: str) -> DataFrame:
    """The first date of the highest high and of the lowest low of each series."""
    return bars(spark, d).groupBy("series").agg(first_argmax("date", "high").alias("first_high"), first_argmin("date", "low").alias("first_low"))


def longest_run_a21(spark: SparkSession, d: str) -> DataFrame:
    """The longest run of rising closes of each ticker: gaps and islands."""
    g = W.partitionBy("series").orderBy("date")
    rows = bars(spark, d).withColumn("up", F.col("close") > F.lag("close").over(g)).withColumn("up", F.coalesce("up", F.lit(False)))
    rows = rows.withColumn("island", F.sum((~F.col("up")).cast("long")).over(g))
    runs = rows.filter("up").groupBy("series", "island").agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy("series").agg(F.count(F.lit(1)).alias("n_bars")).join(runs.groupBy("series").agg(F.max("n").alias("n")), "series", "left").select("series", "n_bars", F.coalesce("n", F.lit(0)).alias("longest"))


def fractal_minima_w21(spark: SparkSession, d: str) -> DataFrame:
    """Five-point local minima of closes per ticker, and how many are higher than the one before."""
    g = W.partitionBy("series").orderBy("date")
    c = F.col("close")
    low = (c < F.lag(c, 1).over(g)) & (c < F.lag(c, 2).over(g)) & (c < F.lead(c, 1).over(g)) & (c < F.lead(c, 2).over(g))
    minima = bars(spark, d).withColumn("low", low).filter("low").withColumn("before", F.lag("close").over(g))
    return minima.groupBy("series").agg(F.count(F.lit(1)).alias("n_minima"), F.count_if(F.col("close") > F.col("before")).alias("n_higher"))


def up_counts_w17(spark: SparkSession, d: str) -> DataFrame:
    """Rising closes over the last 20 bars as a difference of running counts."""
    f = features(spark, d)
    g = W.partitionBy("series", "segment_id").orderBy("date")
    return f.select("series", "date", (F.col("cum_up") - F.lag("cum_up", 20).over(g)).alias("ups_20"))


def half_means_a18(spark: SparkSession, d: str) -> DataFrame:
    """Ratio of the later to the earlier half's mean volume of each ticker, and the slope of its closes on position."""
    of = W.partitionBy("series")
    rows = bars(spark, d).withColumns({"pos": F.row_number().over(of.orderBy("date")) - 1, "n": F.count(F.lit(1)).over(of)})
    early = F.col("pos") < F.floor(F.col("n") / 2)
    out = rows.groupBy("series").agg(F.avg(F.when(early, F.col("volume"))).alias("a"), F.avg(F.when(~early, F.col("volume"))).alias("b"), F.regr_slope("close", F.col("pos").cast("double")).alias("slope"))
    return out.select("series", F.round(F.try_divide("b", "a"), 8).alias("ratio"), F.round("slope", 8).alias("slope"))


def slice_aggregates_a20(spark: SparkSession, d: str) -> DataFrame:
    rows = bars(spark, d)
    return rows.groupBy("series").agg(F.min("low").alias("least"), F.max("high").alias("most"), F.bool_and(F.col("close") > 0).alias("all_positive"), F.bool_or(F.col("volume") == 0).alias("any_halt"), F.sum("volume").alias("volume"))


def semi_join_j8(spark: SparkSession, d: str) -> DataFrame:
    """Bars of tickers that have a setup."""
    asked = table(spark, d, "m1_setups").select("ticker").distinct()
    return bars(spark, d).join(asked, "ticker", "left_semi").groupBy("series").agg(F.count(F.lit(1)).alias("n"))


def anti_join_j9(spark: SparkSession, d: str) -> DataFrame:
    """Bars of tickers that are not funds."""
    funds = table(spark, d, "yfinance_types").filter(F.col("quote_type") == "ETF").select("ticker").distinct()
    return bars(spark, d).join(funds, "ticker", "left_anti").groupBy("series").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (
    universe_d3_w13, scan_projection_s1_s5, normalize_bars_s2, splits_s3, bar_audit_d1, bar_audit_years_a3, unexplained_moves_j1, coverage_j12_a4, probes_d2_j11, probe_verdict_a23, segments_w2_w3, recycled_share_a7,
    rolling_features_w4_w12, breakout_mask_p19, funnel_a8, pattern_stages_d4_d8, setups_d9_d13, impossible_bars_p22, first_extremes_a17, longest_run_a21, fractal_minima_w21, up_counts_w17, half_means_a18, slice_aggregates_a20,
    semi_join_j8, anti_join_j9,
)}

_FLAGS = BARS_SQL + f""", fl as (select *, lag(close) over (partition by series order by date) as pc from bars where date between date '{START}' and date '{END}'),
fg as (select *, year(date) as year, (high < low) or (low > least(open, close)) or (high < greatest(open, close)) as bad_order,
  open is null or high is null or low is null or close is null or volume is null as has_null, open <= 0 or high <= 0 or low <= 0 or close <= 0 as not_positive,
  open = high and high = low and low = close and volume > 0 as flat, pc > 0 and close > 0 and abs(close / nullif(pc, 0) - 1) > 0.5 as jump from fl)"""

_PROBE = BARS_SQL + ", ask as (select unnest(['QIDX', 'RCMNQ', 'NOSUCH', 'WLGWG', 'ZZZZZZ']) as ticker), pr as (select a.ticker, count(b.ticker) > 0 as present, count(b.ticker) as n_bars, min(date) as first_date, max(date) as last_date from ask a left join bars b using (ticker) group by 1)"

_P = PATTERN
_PATTERN_SQL = FEATURES_SQL + f""", fi as (select *, days_in_segment - 1 as idx from ft), ca as (select ticker, segment_id, date, idx as t, volume, vol_avg_20 from (select *, days_in_segment - 1 as idx from bo)),
jn as (select c.ticker, c.segment_id, c.t, c.date as cdate, b.* exclude (ticker, segment_id) from ca c join fi b on b.ticker = c.ticker and b.segment_id = c.segment_id and b.idx between c.t - 210 and c.t),
pv as (select ticker, segment_id, t, arg_max(idx, struct_pack(h := high, i := -idx)) as pvt from jn where high is not null and idx between greatest(0, t - {_P.pivot_back}) and t - {_P.pivot_lag} group by all),
p2 as (select ca.*, pv.pvt, f.high as ph, f.open as po, f.prev_close as ppc, f.cum_up as pcu from ca left join pv using (ticker, segment_id, t) left join fi f on f.ticker = ca.ticker and f.segment_id = ca.segment_id and f.idx = pv.pvt),
w as (select p.ticker, p.segment_id, p.t, p.pvt, p.ph, p.pcu, b.idx, b.date as bdate, b.open as o, b.high as h, b.low as l, b.close as c, b.sma_10, b.sma_20, b.sma_50, b.prev_close as bpc, b.cum_up as cu
  from p2 p join fi b on b.ticker = p.ticker and b.segment_id = p.segment_id and b.idx between p.t - 210 and p.t),
sp as (select ticker, segment_id, t, count(*) filter (idx between greatest(0, pvt - {_P.near}) and least(t - 1, pvt + {_P.near}) and h >= ph * {_P.near_share}) - 1 >= {_P.near_least} as no_spike from w group by all),
l0 as (select ticker, segment_id, t, pvt, ph, min(idx) filter (idx between greatest(0, pvt - {_P.leg_most}) and pvt - {_P.leg_least} and c > 0 and (ph - c) / nullif(c, 0) between {_P.gain_least} and {_P.gain_most} and (pcu - cu) / (pvt - idx) >= {_P.up_share}) as leg0 from w group by all),
l1 as (select w.ticker, w.segment_id, w.t, min(struct_pack(c := w.c, i := w.idx)).i as leg from w join l0 using (ticker, segment_id, t) where w.c is not null and w.idx between l0.leg0 and least(l0.leg0 + {_P.snap}, w.pvt - {_P.leg_least}) group by all),
b0 as (select *, idx - pvt as k, t - pvt as n, (ph - l) / ph as dr,
   coalesce(sma_10 > 0 and l <= sma_10 * {_P.touch_low} and c >= sma_10 * {_P.touch_close}, false) or coalesce(sma_20 > 0 and l <= sma_20 * {_P.touch_low} and c >= sma_20 * {_P.touch_close}, false) or coalesce(sma_50 > 0 and l <= sma_50 * {_P.touch_low} and c >= sma_50 * {_P.touch_close}, false) as touch,
   (h - l) / case when c > 0 then c else 1 end as rg, lag(c, 1) over x as c1, lag(c, 2) over x as c2, lead(c, 1) over x as d1, lead(c, 2) over x as d2 from w where idx between pvt and t - 1 window x as (partition by ticker, segment_id, t order by idx)),
mi as (select ticker, segment_id, t, c, lag(c) over (partition by ticker, segment_id, t order by idx) as b from b0 where c < c1 and c < c2 and c < d1 and c < d2),
hl as (select ticker, segment_id, t, count(*) filter (c > b) as higher_low_count from mi group by all),
b1 as (select ticker, segment_id, t, n, max(dr) as md, count(*) filter (dr > {_P.drop_most} and dr <= {_P.drop_exception}) as ex, count(*) filter (dr > {_P.drop_exception}) as sv,
   count(*) filter (touch) / count(*) as mt, case when bool_and(rg is not null) filter (k < n // 2) then avg(rg) filter (k < n // 2) end as ra, case when bool_and(rg is not null) filter (k >= n // 2) then avg(rg) filter (k >= n // 2) end as rb, count(*) filter (c > sma_20) / nullif(count(sma_20), 0) as pa,
   max(sma_10) filter (k = 0) as a10, max(sma_10) filter (k = n - 1) as z10, max(sma_20) filter (k = 0) as a20, max(sma_20) filter (k = n - 1) as z20,
   case when count(*) filter (k >= 1) >= 3 and bool_and(l is not null) filter (k >= 1) then regr_slope(l / ph, k) filter (k >= 1) end as sl from b0 group by all),
ex as (select ticker, segment_id, t, max(c) filter (idx = t - 1) as lc, max(o) filter (idx = t - 5) as oc, max(sma_10) filter (idx = t - 1) as m10,
   bool_and(coalesce(c > o and c > {_P.up_close} * bpc, false)) filter (idx between t - 4 and t - 2) as r1, bool_and(coalesce(c > o and c > {_P.up_close} * bpc, false)) filter (idx between t - 3 and t - 1) as r2 from w group by all),
an as (select l1.ticker, l1.segment_id, l1.t, l1.leg, f.close as lclose, f.date as ldate, f.prev_close as bclose, a.close as aclose from l1 join fi f on f.ticker = l1.ticker and f.segment_id = l1.segment_id and f.idx = l1.leg
   left join fi a on a.ticker = l1.ticker and a.segment_id = l1.segment_id and a.idx = l1.leg - {_P.anchor}),
al as (select p2.ticker, p2.date, coalesce(p2.ph > 0, false) as pivot_found, coalesce(sp.no_spike, false) as no_spike, not coalesce(p2.pvt > 0 and p2.ppc > 0 and p2.po / nullif(p2.ppc, 0) - 1 > {_P.gap_open}, false) as no_gap,
  coalesce(an.lclose > 0, false) as leg_found, coalesce(b1.n between {_P.base_least} and {_P.base_most} and b1.n <= {_P.base_cap}, false) as base_length,
  coalesce((b1.md <= {_P.drop_most} or (b1.ex <= {_P.exceptions} and b1.sv = 0)) and b1.md >= {_P.pullback}, false) as base_depth,
  not (coalesce(a10 > 0 and z10 < a10 * {_P.rising}, false) or coalesce(a20 > 0 and z20 < a20 * {_P.rising}, false)) as means_rise, coalesce(b1.mt >= {_P.touch_share}, false) as means_touched,
  p2.t >= 5 and not (coalesce(oc > 0 and (lc - oc) / nullif(oc, 0) > {_P.extension}, false) or coalesce(m10 > 0 and lc / nullif(m10, 0) - 1 > {_P.above_mean}, false) or coalesce(r1, false) or coalesce(r2, false)) as not_extended,
  an.ldate as legup_low_date, f.date as legup_high_date, (p2.pvt - an.leg)::bigint as legup_duration_days, b1.n::bigint as cons_duration_days, case when b1.md > {_P.drop_most} then b1.ex else 0 end as cons_exception_days,
  coalesce(hl.higher_low_count, 0) as higher_low_count, round((p2.ph - an.lclose) / nullif(an.lclose, 0), 7) as legup_gain_pct, round(case when an.aclose > 0 then (an.bclose - an.aclose) / an.aclose end, 7) as pre_legup_return, round(b1.md, 7) as cons_max_drop_pct,
  round(b1.sl, 8) as cons_low_trend_slope, round(b1.mt, 7) as ma_touches_pct_in_cons, round(case when ra > 0 then rb / ra end, 7) as range_contraction_ratio, round(pa, 7) as pct_closes_above_20ma_in_cons,
  round(p2.volume / case when p2.vol_avg_20 > 0 then p2.vol_avg_20 end, 7) as breakout_volume_ratio
  from p2 left join sp using (ticker, segment_id, t) left join an using (ticker, segment_id, t) left join b1 using (ticker, segment_id, t) left join hl using (ticker, segment_id, t) left join ex using (ticker, segment_id, t)
  left join fi f on f.ticker = p2.ticker and f.segment_id = p2.segment_id and f.idx = p2.pvt)
select *, pivot_found and no_spike and no_gap and leg_found and base_length and base_depth and means_rise and means_touched and not_extended as passed from al"""

SQL = {
    "universe_d3_w13": "with " + FEATURES_SQL.replace("and mom_12_1 is not null),", "and mom_12_1 is not null and symbol not in (select ticker from yfinance_types where quote_type <> 'EQUITY')),") + " select ticker, date, round(mom_12_1, 8) as mom_12_1, round(mom_pct, 9) as mom_pct from un",
    "scan_projection_s1_s5": "select feed, count(*) as n, sum(volume)::bigint as volume from daily_bars where date between date '2018-01-01' and date '2019-12-31' group by 1",
    "normalize_bars_s2": f"with {BARS_SQL} select ticker, date, open, high, low, close, volume from bars",
    "splits_s3": "select distinct ticker, execution_date as date from splits",
    "bar_audit_d1": f"""with {_FLAGS}, t as (select count(*) as n_bars, count(*) filter (bad_order) as n_bad_order, count(*) filter (has_null) as n_has_null, count(*) filter (not_positive) as n_not_positive,
        count(*) filter (flat) as n_flat, count(*) filter (jump) as n_jump from fg) select *, n_bad_order + n_has_null + n_not_positive + n_flat as n_hard from t""",
    "bar_audit_years_a3": f"""with {_FLAGS}, t as (select year, count(*) as n_bars, count(*) filter (coalesce(bad_order, false) or coalesce(has_null, false) or coalesce(not_positive, false) or coalesce(flat, false)) as n_hard from fg group by 1)
        select year, n_bars, n_hard, round(n_hard / n_bars, 9) as share, n_hard / n_bars > 0.001 as over_limit from t""",
    "unexplained_moves_j1": f"with {_FLAGS} select count(*) as n_moves, count(*) filter ((ticker, date) not in (select (ticker, execution_date) from splits)) as n_without_split from fg where jump",
    "coverage_j12_a4": f"with {BARS_SQL} select y as year, count(distinct date) as n_dates, count(distinct date) < 200 as low from range(2010, 2026) t(y) left join bars on year(date) = y group by 1",
    "probes_d2_j11": f"with {_PROBE} select * from pr",
    "probe_verdict_a23": f"with {_PROBE}, s as (select avg(present::int) as share from pr) select share, case when share >= 0.5 then 'proceed' when share < 0.2 then 'pivot' else 'caveat' end as verdict from s",
    "segments_w2_w3": f"with {BARS_SQL}, g as (select series, date, coalesce(date_diff('day', lag(date) over (partition by series order by date), date), 0) as gap_days from bars) select *, (sum((gap_days >= 30)::int) over (partition by series order by date))::bigint as segment_id from g",
    "recycled_share_a7": f"with {BARS_SQL}, g as (select series, date_diff('day', lag(date) over (partition by series order by date), date) >= 30 as cut from bars), m as (select series, count(*) filter (cut) as m from g group by 1) select count(*) as n_series, count(*) filter (m > 0) as n_recycled, max(m) as most_segments from m",
    "rolling_features_w4_w12": f"with {FEATURES_SQL} select ticker, date, segment_id, days_in_segment, prev_high, cum_up, round(adv_20 / 1e6, 4) as adv_20_m, " + ", ".join(f"round({c}, {k}) as {c}" for c, k in FEATURE_ROUND.items()) + " from ft",
    "breakout_mask_p19": f"with {FEATURES_SQL} select ticker, date, close, volume, round(mom_pct, 9) as mom_pct from bo",
    "funnel_a8": f"""with {FEATURES_SQL}, s as (select date between date '2014-06-01' and date '2024-12-31' as a, close > 2 as b, adv_20 > 500000 as c, days_in_segment - 1 >= 63 as d, mom_12_1 is not null as e from ft)
        select count(*) as all_rows, count(*) filter (a) as in_dates, count(*) filter (a and b) as price, count(*) filter (a and b and c) as dollar_volume, count(*) filter (a and b and c and d) as history, count(*) filter (a and b and c and d and e) as momentum from s""",
    "pattern_stages_d4_d8": "with " + _PATTERN_SQL,
    "impossible_bars_p22": "select bar_id, feed, ticker, date from daily_bars where open <= 0 or high <= 0 or low <= 0 or close <= 0 or volume < 0 or high < low or open > high or open < low or close > high or close < low",
    "first_extremes_a17": f"with {BARS_SQL}, m as (select series, max(high) as h, min(low) as l from bars group by 1) select m.series, min(date) filter (high = h) as first_high, min(date) filter (low = l) as first_low from m join bars using (series) group by 1",
    "longest_run_a21": f"""with {BARS_SQL}, u as (select ticker, date, coalesce(close > lag(close) over (partition by ticker order by date), false) as up from tb), i as (select *, sum((not up)::int) over (partition by ticker order by date) as k from u),
        r as (select ticker, k, count(*) filter (up) as n, count(*) as a from i group by all) select ticker, sum(a)::bigint as n_bars, max(n) as longest from r group by 1""",
    "fractal_minima_w21": f"""with {BARS_SQL}, x as (select *, lag(close, 1) over g as a, lag(close, 2) over g as b, lead(close, 1) over g as c, lead(close, 2) over g as d from tb window g as (partition by ticker order by date)),
        m as (select ticker, close, lag(close) over (partition by ticker order by date) as before from x where close < a and close < b and close < c and close < d) select ticker, count(*) as n_minima, count(*) filter (close > before) as n_higher from m group by 1""",
    "up_counts_w17": f"with {FEATURES_SQL} select ticker, date, case when days_in_segment > 20 then sum(coalesce(close > prev_close, false)::int) over (partition by ticker, segment_id order by date rows 19 preceding)::bigint end as ups_20 from ft",
    "half_means_a18": f"""with {BARS_SQL}, x as (select *, row_number() over (partition by ticker order by date) - 1 as pos, count(*) over (partition by ticker) as n from tb)
        select ticker, round(avg(volume) filter (pos >= n // 2) / nullif(avg(volume) filter (pos < n // 2), 0), 8) as ratio, case when count(close) > 1 then round(regr_slope(close, pos), 8) end as slope from x group by 1""",
    "slice_aggregates_a20": f"with {BARS_SQL} select ticker, min(low) as least, max(high) as most, bool_and(close > 0) as all_positive, bool_or(volume = 0) as any_halt, sum(volume)::bigint as volume from tb group by 1",
    "semi_join_j8": f"with {BARS_SQL} select ticker, count(*) as n from tb where symbol in (select ticker from m1_setups) group by 1",
    "anti_join_j9": f"with {BARS_SQL} select ticker, count(*) as n from tb where symbol not in (select ticker from yfinance_types where quote_type = 'ETF') group by 1",
}
_BY_SERIES = (
    "universe_d3_w13", "rolling_features_w4_w12", "breakout_mask_p19", "pattern_stages_d4_d8", "longest_run_a21", "fractal_minima_w21", "up_counts_w17", "half_means_a18", "slice_aggregates_a20", "semi_join_j8", "anti_join_j9",
)
SQL |= {k: by_series(SQL[k]) for k in _BY_SERIES}
