"""Queries p1 to p4 and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.text import canonical_ticker, instant
from tidewright.operators.orphans import Link, absent, absent_at, orphan_cascade
from tidewright.operators.profile import Rule, load_findings, profile
from tidewright.operators.spikes import BUCKETS, LEAST, LONGEST, SpikeParams, implausible
from tidewright.operators.trailing import rolling_totals
from tidewright.sources.tables import table


def _cascade(spark: SparkSession, d: str, features: bool = False) -> DataFrame:
    """Orphans of the setups and their types; with ``features`` also those of the setups' features, one link further down."""
    month = lambda c: F.date_format(c, "yyyy-MM").alias("period")
    setups = table(spark, d, "m1_setups").select(F.col("setup_id").alias("row_id"), canonical_ticker(F.col("ticker")).alias("key"), F.col("loaded_at").cast("timestamp_ntz").alias("at"), month(F.col("date")))
    fetched = instant(F.col("fetched_at"))
    types = table(spark, d, "yfinance_types").select(F.col("type_id").alias("row_id"), canonical_ticker(F.col("ticker")).alias("key"), fetched.alias("start"), instant(F.col("removed_at")).alias("until"), month(fetched))
    bars = table(spark, d, "daily_bars").select("ticker").distinct().select(canonical_ticker(F.col("ticker")).alias("key"))
    tables = {"m1_setups": setups, "yfinance_types": types, "daily_bars": bars}
    links = [Link("m1_setups", "yfinance_types", absent_at), Link("yfinance_types", "daily_bars", absent)]
    if features:
        tables["m2_setups_with_features"] = table(spark, d, "m2_setups_with_features").select(F.col("setup_id").alias("row_id"), F.col("setup_id").alias("key"), month(F.col("date")))
        links.append(Link("m2_setups_with_features", "m1_setups", absent, parent_key="row_id"))
    return orphan_cascade(tables, links)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The direct orphans of the whole cascade; p1_periods has the inherited ones too."""
    return _cascade(spark, d).filter(~F.col("inherited")).select("child_table", "row_id", "reason")


def p1_periods(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per referring table, month, reason and kind."""
    return _cascade(spark, d).groupBy("child_table", F.col("period").alias("month"), "reason", "inherited").agg(F.count(F.lit(1)).alias("n"))


def p1_inherited(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose every target is an orphan itself, with the round that found them; feature rows are two links away from the types."""
    return _cascade(spark, d, True).filter("inherited").select("child_table", "row_id", "parent_table", F.col("round").cast("bigint").alias("round"))


def _rules(spark: SparkSession, d: str) -> tuple[DataFrame, list[Rule]]:
    rows = table(spark, d, "m2_setups_with_features")
    sectors = table(spark, d, "sector_list").select(F.col("sector").alias("_listed")).distinct().withColumn("_known", F.lit(True))
    rows = rows.join(sectors, rows["sector"] == sectors["_listed"], "left")
    slope = F.col("rs_slope_vs_spy")
    return rows, [
        Rule("rs_slope_vs_spy", (slope > -1) & (slope < 1), True),
        Rule("sector", F.coalesce(F.col("_known"), F.lit(False)), False, "Unknown"),
        Rule("base_duration_days", F.col("base_duration_days") == F.col("cons_duration_days"), True),
    ]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    rows, rules = _rules(spark, d)
    return load_findings(rows, "load_id", rules).select("load_id", "column_name", "finding")


def _digits(c: str) -> Column:
    """Rounded to significant digits: quartiles, which are no sums, to twelve, others to seven."""
    return F.when(F.col(c).isNotNull(), F.format_string("%.11e" if c[0] == "q" else "%.6e", F.col(c)).cast("double")).alias(c)


PATTERNS = {"ticker": r"^[A-Z]{1,5}(\.[A-Z])?$", "universe_variant": "^(loose|strict)$"}
MEASURES = ["mean", "stddev", "q25", "q50", "q75", "d_mean", "d_share"]


def p2_profile(spark: SparkSession, d: str) -> DataFrame:
    """Every column per load; the three columns of p2_found by its rules."""
    rows, rules = _rules(spark, d)
    out = profile(rows, "load_id", PATTERNS, ("_listed", "_known"), rules)
    return out.select("load_id", "column_name", "n", "n_missing", "n_distinct", "n_finite", "n_violations", "share_missing", "share_invalid", "least_number", "most_number", "least_text", "most_text", *[_digits(c) for c in MEASURES])


def p2_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The findings with the standardised difference of the load's valid numbers from those of all others."""
    rows, rules = _rules(spark, d)
    return load_findings(rows, "load_id", rules).select("load_id", "column_name", "finding", _digits("d_mean"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return implausible(table(spark, d, "daily_bars")).select("bar_id")


def p3_reasons(spark: SparkSession, d: str) -> DataFrame:
    return implausible(table(spark, d, "daily_bars"))


def p4_rolling(spark: SparkSession, d: str) -> DataFrame:
    out = rolling_totals(table(spark, d, "daily_bars"))
    rounded = [F.round(c, 6).alias(c) for c in ("avg_7d", "avg_30d")] + [F.round(c, 6).alias(c) for c in ("sma_20", "sma_50", "vol_avg_20")]
    return out.select("feed", "ticker", "day", "is_bar", "volume", "total_7d", "total_30d", *rounded)


QUERIES = {"p1_found": p1_found, "p1_periods": p1_periods, "p1_inherited": p1_inherited, "p2_found": p2_found, "p2_profile": p2_profile, "p2_evidence": p2_evidence, "p3_found": p3_found, "p3_reasons": p3_reasons, "p4_rolling": p4_rolling}

_TICKER = r"nullif(regexp_replace(regexp_replace(upper(ticker), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '[\s\p{Z}]*[./-][\s\p{Z}]*|[\s\p{Z}]+', '.', 'g'), '')"
_INSTANT = r"case when {c} is null then null when regexp_matches({c}, '(Z|[+-]\d\d:\d\d)$') then cast({c} as timestamptz) at time zone 'UTC' else cast({c} as timestamp) end"

_ORPHANS = f"""
s as (select setup_id, date, loaded_at as t, {_TICKER} as k from m1_setups),
y as (select type_id, {_TICKER} as k, {_INSTANT.format(c="fetched_at")} as f, {_INSTANT.format(c="removed_at")} as r from yfinance_types),
b as (select distinct {_TICKER} as k from daily_bars),
sd as (select s.setup_id, s.date,
  case when not exists (select 1 from y where y.k = s.k) then 'missing'
       when exists (select 1 from y where y.k = s.k and (y.f is null or y.f <= s.t)) then 'removed' else 'later' end as reason
  from s where not exists (select 1 from y where y.k = s.k and (y.f is null or y.f <= s.t) and (y.r is null or s.t < y.r))),
yd as (select type_id, f from y where not exists (select 1 from b where b.k = y.k)),
si as (select s.setup_id, s.date from s where s.setup_id not in (select setup_id from sd) and not exists (
  select 1 from y where y.type_id not in (select type_id from yd) and y.k = s.k and (y.f is null or y.f <= s.t) and (y.r is null or s.t < y.r)))
"""

_S = SpikeParams()
_SERIES = "feed, ticker, m"
_SAME = "a.feed is not distinct from b.feed and a.ticker is not distinct from b.ticker and a.m = b.m"
_OWN = "open <= 0 or high <= 0 or low <= 0 or close <= 0 or volume < 0 or high < low or open > high or open < low or close > high or close < low"
_SPIKES = f"""
d as (select *, row_number() over (partition by feed, ticker, date order by loaded_at nulls first, bar_id) as k, row_number() over (partition by feed, ticker, date order by loaded_at desc nulls last, bar_id desc) as l from daily_bars where date is not null),
x as (select bar_id, feed, ticker, date, k, l, volume, m, case when isfinite(v) then v end as v from (select *, unnest(['high', 'low', 'close', 'volume']) as m, unnest([high, low, close, volume::double]) as v from d)),
r as (select {_SERIES}, date, ln(v) as y, median(ln(v)) over (w rows between {_S.half} preceding and {_S.half} following) as level, median(ln(v)) over (w rows between {_S.half} preceding and 1 preceding) as y0,
  median(ln(v)) over (w rows between 1 following and {_S.half} following) as y1 from x where l = 1 and v > 0 window w as (partition by {_SERIES} order by date)),
h as (select {_SERIES}, case when y = level then {LEAST} else greatest(floor({BUCKETS} * log2(abs(y - level))), {LEAST}) end as step, count(*) as n from r group by all),
c as (select *, sum(n) over (partition by {_SERIES} order by step) as upto, sum(n) over (partition by {_SERIES}) / 2 as half from h),
mad as (select {_SERIES}, min(case when step = {LEAST} then 0 else pow(2.0, (step + (half - upto + n) / n) / {BUCKETS}) end) as mad from c where upto >= half and upto - n < half group by all),
f as (select x.bar_id, x.feed, x.ticker, x.m, ln(x.v) - b.y0 as e0, ln(x.v) - b.y1 as e1 from (select *, v as w from x where v > 0) x join r b on x.feed is not distinct from b.feed and x.ticker is not distinct from b.ticker and x.m = b.m and x.date = b.date),
spike as (select distinct bar_id from f a join mad b on {_SAME} where sign(e0) = sign(e1) and least(abs(e0), abs(e1)) >
  case when a.m = 'volume' then greatest({_S.volume_z} * greatest(1.4826 * mad, {_S.volume_floor}), {_S.volume_least}) else {_S.price_z} * greatest(1.4826 * mad, {_S.price_floor}) end),
q as (select *, 'first' as e from x where k = 1 and m in ('close', 'volume') and v is not null and volume is distinct from 0 union all select *, 'last' from x where l = 1 and m in ('close', 'volume') and v is not null and volume is distinct from 0),
q1 as (select *, coalesce(v = lag(v) over (partition by {_SERIES}, e order by date), false) as again from q),
q2 as (select *, sum((not again)::int) over (partition by {_SERIES}, e order by date) as island from q1),
q3 as (select *, count(*) over (partition by {_SERIES}, e, island) as size, sum((not again)::int) over (partition by {_SERIES}, e) as n_runs, count(*) over (partition by {_SERIES}, e) as n from q2),
q4 as (select *, sum((not again and size > 1)::int) over (partition by {_SERIES}, e) as longer from q3),
q5 as (select * from q4 where again and size >= {_S.run_least} and n * pow((greatest(longer - 1, 0) + 0.5) / (n_runs + 1), least(size - 1, {LONGEST})) < {_S.run_chance}),
stuck as (select distinct a.bar_id from x a join q5 b on {_SAME} and a.date = b.date and a.v = b.v where a.volume > 0)"""

_FINDINGS = """
with v as (
  select load_id, 'rs_slope_vs_spy' as column_name, rs_slope_vs_spy is null or isnan(rs_slope_vs_spy) as miss, rs_slope_vs_spy > -1 and rs_slope_vs_spy < 1 as ok, rs_slope_vs_spy as x, null as w from m2_setups_with_features
  union all select load_id, 'sector', sector is null or not regexp_matches(sector, '[^\\s\\p{Z}]') or sector = 'Unknown', sector in (select sector from sector_list), null, sector from m2_setups_with_features
  union all select load_id, 'base_duration_days', base_duration_days is null, coalesce(base_duration_days = cons_duration_days, false), base_duration_days, null from m2_setups_with_features),
c as (select load_id, column_name, miss, not miss and not coalesce(ok, false) as bad, case when not miss and ok then x end as x, case when not miss and ok then w end as w from v),
sh as (select load_id, column_name, avg(miss::int) as m, avg(bad::int) as i from c group by all),
f1 as (select load_id, column_name, 'missing' as finding from sh qualify abs(m - quantile_cont(m, 0.5) over (partition by column_name)) > 0.2
  union all select load_id, column_name, 'invalid' from sh qualify abs(i - quantile_cont(i, 0.5) over (partition by column_name)) > 0.2),
q as (select load_id, column_name, quantile_cont(x, 0.25) as lo, quantile_cont(x, 0.75) as hi from c where x is not null group by all),
qm as (select column_name, quantile_cont(lo, 0.5) as mlo, quantile_cont(hi, 0.5) as mhi, quantile_cont(hi - lo, 0.5) as mw from q group by all),
f2 as (select load_id, column_name, 'shifted' as finding from q join qm using (column_name) where greatest(abs(lo - mlo), abs(hi - mhi)) > 1.2 * mw),
cn as (select load_id, w, count(*) as n from c where w is not null group by all),
tot as (select load_id, sum(n) as t from cn group by all),
g as (select tot.load_id, s.w, coalesce(cn.n, 0) / t as share from tot cross join (select distinct w from cn) s left join cn on cn.load_id = tot.load_id and cn.w = s.w),
gm as (select w, quantile_cont(share, 0.5) as m from g group by all),
f3 as (select distinct load_id, 'sector' as column_name, 'shifted' as finding from g join gm using (w) where abs(share - m) > 0.25)"""

_NUMBERS = [
    "setup_id", "mom_12_1", "mom_pct", "legup_duration_days", "legup_gain_pct", "pre_legup_return", "cons_duration_days", "cons_max_drop_pct", "cons_exception_days", "cons_low_trend_slope", "ma_touches_pct_in_cons", "breakout_volume_ratio",
    "breakout_range_pct", "higher_low_count", "range_contraction_ratio", "pct_closes_above_20ma_in_cons", "dist_52w_high_pct", "close", "adv_20", "vol_contraction_ratio", "adr_pct", "base_duration_days", "rs_slope_vs_spy",
]
_TEXTS = ["ticker", "date", "universe_variant", "legup_low_date", "legup_high_date", "cons_start_date", "cons_end_date", "sector", "loaded_at"]
_BAD = {"rs_slope_vs_spy": "not coalesce(rs_slope_vs_spy > -1 and rs_slope_vs_spy < 1, false)", "base_duration_days": "not coalesce(base_duration_days = cons_duration_days, false)", "sector": "sector not in (select sector from sector_list)"}
_BAD |= {c: f"not regexp_matches({c}, '{p}')" for c, p in PATTERNS.items()}
_GONE = {c: f"({c} is null or isnan({c}::double))" for c in _NUMBERS} | {c: f"({c} is null or not regexp_matches({c}::varchar, '[^\\s\\p{{Z}}]'))" for c in _TEXTS}
_GONE["sector"] = f"({_GONE['sector']} or sector = 'Unknown')"
_WHAT = {c: f"case when not isnan({c}::double) then {c}::double + 0.0 end as x, null::varchar as w" for c in _NUMBERS} | {c: f"null::double as x, case when not {_GONE[c]} then {c}::varchar end as w" for c in _TEXTS}
_CELLS = " union all ".join(f"select load_id, '{c}' as column_name, {_GONE[c]} as gone, {f'coalesce(not {_GONE[c]} and {_BAD[c]}, false)' if c in _BAD else 'false'} as bad, {what} from m2_setups_with_features" for c, what in _WHAT.items())
_DMEAN = """ps as (select load_id, column_name, count(x) as n, avg(x) as mean, var_pop(x) * count(x) as m2 from {cells} where x is not null and isfinite(x) group by all),
pa as (select *, sum(n) over c as total, sum(n * mean) over c / sum(n) over c as mid from ps window c as (partition by column_name)),
pb as (select *, n * (mean - mid) as s1, m2 + n * (mean - mid) * (mean - mid) as s2, total - n as rn from pa),
pc as (select *, sum(s1) over c - s1 as r1, sum(s2) over c - s2 as r2 from pb window c as (partition by column_name)),
pd as (select load_id, column_name, case when rn > 1 and n > 1 then (mean - mid - r1 / rn) / nullif(sqrt((m2 / (n - 1) + greatest(r2 - r1 * r1 / rn, 0) / (rn - 1)) / 2), 0) end as d_mean from pc)"""
_DIGITS = lambda c: f"case when {c} is not null then printf('{'%.11e' if c[0] == 'q' else '%.6e'}', {c})::double end as {c}"

SQL = {
    "p3_found": f"with {_SPIKES} select bar_id from daily_bars where {_OWN} union select bar_id from spike union select bar_id from stuck",
    "p3_reasons": f"""with {_SPIKES}, o as (select bar_id, true as o, false as s, false as k from daily_bars where {_OWN} union all select bar_id, false, true, false from spike union all select bar_id, false, false, true from stuck)
        select bar_id, bool_or(o) as out_of_bounds, bool_or(s) as is_spike, bool_or(k) as is_stuck from o group by 1""",
    "p1_found": f"with {_ORPHANS} select 'm1_setups' as child_table, setup_id as row_id, reason from sd union all select 'yfinance_types', type_id, 'missing' from yd",
    "p1_periods": f"""with {_ORPHANS}, o as (
        select 'm1_setups' as child_table, strftime(date, '%Y-%m') as month, reason, false as inherited from sd
        union all select 'yfinance_types', strftime(f, '%Y-%m'), 'missing', false from yd
        union all select 'm1_setups', strftime(date, '%Y-%m'), 'orphaned parent', true from si)
        select child_table, month, reason, inherited, count(*) as n from o group by all""",
    "p1_inherited": f"""with {_ORPHANS} select 'm1_setups' as child_table, setup_id as row_id, 'yfinance_types' as parent_table, 1::bigint as round from si
        union all select 'm2_setups_with_features', m.setup_id, 'm1_setups', case when o.direct then 1 else 2 end from m2_setups_with_features m join (select setup_id, true as direct from sd union all select setup_id, false from si) o using (setup_id)""",
    "p2_found": f"with {_FINDINGS.strip()[5:]} select * from f1 union all select * from f2 union all select * from f3",
    "p2_evidence": f"with {_FINDINGS.strip()[5:]}, {_DMEAN.format(cells='(select load_id, column_name, x from c)')}, o as (select * from f1 union all select * from f2 union all select * from f3) select load_id, column_name, finding, {_DIGITS('d_mean')} from o left join pd using (load_id, column_name)",
    "p2_profile": f"""with c as ({_CELLS}), {_DMEAN.format(cells="c")},
        a as (select load_id, column_name, count(*) as n, count(*) filter (gone) as n_missing, count(distinct coalesce(w, x::varchar)) filter (not gone) as n_distinct, count(*) filter (bad) as n_violations, min(w) as least_text, max(w) as most_text from c group by all),
        f as (select load_id, column_name, count(x) as n_finite, avg(x) as mean, stddev_samp(x) as stddev, min(x) as least_number, max(x) as most_number, quantile_cont(x, 0.25) as q25, quantile_cont(x, 0.5) as q50, quantile_cont(x, 0.75) as q75 from c where x is not null and isfinite(x) group by all),
        w as (select load_id, column_name, w, count(*) as k from c where w is not null and not gone group by all), t as (select load_id, column_name, sum(k) as wn from w group by all), wa as (select column_name, w, sum(k) as ka from w group by all), ta as (select column_name, sum(wn) as wall from t group by all),
        s as (select load_id, column_name, case when max(wall - wn) > 0 then 1 - sum(least(k / wn, (ka - k) / nullif(wall - wn, 0))) end as d_share from w join t using (load_id, column_name) join wa using (column_name, w) join ta using (column_name) group by all)
        select load_id, column_name, n, n_missing, n_distinct, coalesce(n_finite, 0) as n_finite, n_violations, n_missing / n as share_missing, n_violations / n as share_invalid, least_number, most_number, least_text, most_text, {', '.join(_DIGITS(c) for c in MEASURES)}
        from a left join f using (load_id, column_name) left join s using (load_id, column_name) left join pd using (load_id, column_name)""",
    "p4_rolling": """
with one as (select feed, ticker, date, close, volume from daily_bars where date is not null
  qualify row_number() over (partition by feed, ticker, date order by loaded_at desc nulls last, bar_id desc) = 1),
means as (select feed, ticker, date, volume,
  case when count(close) over w20 = 20 then round(avg(close) over w20, 6) end as sma_20,
  case when count(close) over w50 = 50 then round(avg(close) over w50, 6) end as sma_50,
  case when count(volume) over v20 = 20 then round(avg(volume) over v20, 6) end as vol_avg_20
  from one window w20 as (partition by feed, ticker order by date rows 19 preceding), w50 as (partition by feed, ticker order by date rows 49 preceding),
  v20 as (partition by feed, ticker order by date rows between 20 preceding and 1 preceding)),
spans as (select feed, ticker, min(date) as a, max(date) as b from one group by all),
days as (select feed, ticker, unnest(generate_series(a::timestamp, b::timestamp, interval 1 day))::date as day from spans)
select d.feed, d.ticker, d.day, m.date is not null as is_bar, coalesce(m.volume, 0)::bigint as volume,
  sum(coalesce(m.volume, 0)) over w7 ::bigint as total_7d, sum(coalesce(m.volume, 0)) over w30 ::bigint as total_30d,
  round(avg(coalesce(m.volume, 0)) over w7, 6) as avg_7d, round(avg(coalesce(m.volume, 0)) over w30, 6) as avg_30d, sma_20, sma_50, vol_avg_20
from days d left join means m on m.feed is not distinct from d.feed and m.ticker is not distinct from d.ticker and m.date = d.day
window w7 as (partition by d.feed, d.ticker order by d.day rows 6 preceding), w30 as (partition by d.feed, d.ticker order by d.day rows 29 preceding)""",
}
