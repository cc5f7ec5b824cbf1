"""Inputs that the named queries share, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewright.functions.text import canonical_ticker
from tidewright.operators.series import BreakoutParams, SeriesParams, UniverseParams, add_features
from tidewright.sources.bars import latest_bars
from tidewright.sources.tables import table

#: The defaults of the operators ask for a year of history and dollar volumes of large markets; most series of the test tables
#: have some hundred bars, so that the registered queries use these instead.
SERIES = SeriesParams(gap_days=30, momentum_long=63, momentum_short=5, year=63)
UNIVERSE = UniverseParams(start="2014-06-01", end="2024-12-31", min_close=2.0, min_adv_20=500_000.0, min_history=63)
BREAKOUT = BreakoutParams(volume_surge=1.1, min_range=0.005, min_adr=0.005)

FACTOR_NAMES = ["mkt_rf", "smb", "hml", "umd"]


def bars(spark: SparkSession, d: str) -> DataFrame:
    """The last delivery of each bar, by feed and ticker."""
    return latest_bars(table(spark, d, "daily_bars"))


def features(spark: SparkSession, d: str) -> DataFrame:
    """Features of every series (feed, ticker), on all its bars, those with nulls too."""
    return add_features(bars(spark, d), "series", SERIES)


def setups(spark: SparkSession, d: str) -> DataFrame:
    """The last load of each setup with its features; tickers in one spelling."""
    rows = table(spark, d, "m2_setups_with_features")
    keep = [c for c in rows.columns if c not in ("load_id", "loaded_at")]
    ties = [F.coalesce(F.col(c).cast("double"), F.lit(-1e9)).desc() for c in ("adr_pct", "vol_contraction_ratio", "rs_slope_vs_spy", "base_duration_days")]
    newest = W.partitionBy("setup_id").orderBy(F.desc("load_id"), F.desc("loaded_at"), *ties)
    last = rows.withColumn("_rn", F.row_number().over(newest)).filter("_rn = 1").select(*keep)
    return last.withColumn("ticker", canonical_ticker(F.col("ticker")))


def setups_by_feed(spark: SparkSession, d: str) -> DataFrame:
    """Each setup once per series of its ticker, with event (setup_id, series); once without a series if there is none."""
    out = setups(spark, d).join(bars(spark, d).select("ticker", "series").distinct(), "ticker", "left")
    return out.withColumn("event", F.struct("setup_id", "series"))


def factors(spark: SparkSession, d: str) -> DataFrame:
    """A deterministic daily factor table from the orders, moved into the years of the bars."""
    k = dict(zip(FACTOR_NAMES, (1, 3, 7, 11)))
    day = F.date_add(F.col("o_orderdate").cast("date"), 7000).alias("date")
    total = table(spark, d, "orders").groupBy(day).agg(F.sum(F.floor("o_totalprice")).alias("s"))
    return total.select("date", *[((F.pmod(F.col("s") * v, F.lit(201)) - 100) / 10000).alias(n) for n, v in k.items()])


BARS_SQL = """bars as (select feed || '/' || ticker as series, feed, ticker, date, open, high, low, close, volume from daily_bars where date is not null
  qualify row_number() over (partition by feed, ticker, date order by loaded_at desc nulls last, bar_id desc) = 1),
tb as (select series as ticker, ticker as symbol, date, open, high, low, close, volume from bars)"""

FEATURES_SQL = BARS_SQL + """,
g0 as (select *, coalesce(date_diff('day', lag(date) over (partition by ticker order by date), date), 0) as gap_days from tb),
g1 as (select *, (sum((gap_days >= 30)::int) over (partition by ticker order by date))::bigint as segment_id, (high - low) / nullif(open, 0) as daily_range_pct, close * volume as dv from g0),
g2 as (select *, row_number() over g as days_in_segment,
  case when count(close) over (g rows 9 preceding) = 10 then avg(close) over (g rows 9 preceding) end as sma_10,
  case when count(close) over (g rows 19 preceding) = 20 then avg(close) over (g rows 19 preceding) end as sma_20,
  case when count(close) over (g rows 49 preceding) = 50 then avg(close) over (g rows 49 preceding) end as sma_50,
  case when count(dv) over (g rows between 20 preceding and 1 preceding) = 20 then avg(dv) over (g rows between 20 preceding and 1 preceding) end as adv_20,
  case when count(volume) over (g rows between 20 preceding and 1 preceding) = 20 then avg(volume) over (g rows between 20 preceding and 1 preceding) end as vol_avg_20,
  case when count(daily_range_pct) over (g rows between 20 preceding and 1 preceding) = 20 then avg(daily_range_pct) over (g rows between 20 preceding and 1 preceding) end as adr_20,
  case when lag(close, 5) over g > 0 and lag(close, 63) over g > 0 then ln(lag(close, 5) over g / lag(close, 63) over g) end as mom_12_1,
  case when count(close) over (g rows 62 preceding) = 63 then max(close) over (g rows 62 preceding) end as high_252,
  lag(high) over g as prev_high, lag(close) over g as prev_close
  from g1 window g as (partition by ticker, segment_id order by date)),
ft as (select *, (high_252 - close) / nullif(high_252, 0) as dist_52w_high_pct, (sum(coalesce(close > prev_close, false)::int) over (partition by ticker, segment_id order by date))::bigint as cum_up from g2),
un as (select *, (rank() over (partition by date order by mom_12_1) + (count(*) over (partition by date, mom_12_1) - 1) / 2) / count(*) over (partition by date) as mom_pct
  from ft where date between date '2014-06-01' and date '2024-12-31' and close > 2 and adv_20 > 500000 and days_in_segment - 1 >= 63 and mom_12_1 is not null),
bo as (select * from un where close > prev_high and high > prev_high and volume > 1.1 * vol_avg_20 and daily_range_pct >= 0.005 and adr_20 >= 0.005 and close > sma_20 and close > sma_50)"""

_TICKER = r"nullif(regexp_replace(regexp_replace(upper(ticker), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '[\s\p{Z}]*[./-][\s\p{Z}]*|[\s\p{Z}]+', '.', 'g'), '')"
SETUPS_SQL = f"st as (select * replace ({_TICKER} as ticker) from m2_setups_with_features qualify row_number() over (partition by setup_id order by load_id desc, loaded_at desc, coalesce(adr_pct, -1e9) desc, coalesce(vol_contraction_ratio, -1e9) desc, coalesce(rs_slope_vs_spy, -1e9) desc, coalesce(base_duration_days, -1e9) desc) = 1)"
FACTORS_SQL = "fa as (select (o_orderdate::date + 7000)::date as date, " + ", ".join(f"(((sum(floor(o_totalprice))::bigint * {k}) % 201) - 100) / 10000 as {n}" for n, k in zip(FACTOR_NAMES, (1, 3, 7, 11))) + " from orders group by 1)"

_SETUPS_BY_FEED = "st as (select s0.* replace ({'s': s0.setup_id, 'f': b.series} as setup_id, b.series as ticker) from s0 left join (select distinct series, ticker from bars) b on b.ticker = s0.ticker)"


def by_series(sql: str, keys: tuple[str, ...] = ("ticker",)) -> str:
    """Names the keys of the SQL below, where a ticker is a series and a setup_id an event (setup_id, series); keys: those of them that it returns."""
    sql = sql.replace(f"{SETUPS_SQL}, {BARS_SQL}", f"{SETUPS_SQL.replace('st as', 's0 as', 1)}, {BARS_SQL}, {_SETUPS_BY_FEED}")
    names = {"ticker": "ticker as series", "setup_id": "setup_id.s as setup_id, setup_id.f as series"}
    return f"select {', '.join(names[k] for k in keys)}, * exclude ({', '.join(keys)}) from ({sql})" if keys else sql
