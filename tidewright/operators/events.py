"""Event windows, forward returns and factor windows of events (series key, date)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewright.functions.windows import log_ratio

BUCKET_DAYS = 32


def window_bars(events: DataFrame, bars: DataFrame, key: str, event_id: str, start: str, end: str) -> DataFrame:
    """Bars with start <= date <= end of each event: event_id, the bar's columns, pos (0-based) and n.

    A range join inside an equi-join: events are repeated for the buckets of days their window touches, so a key with many
    events and bars is cut along time and only neighbouring rows meet.
    """
    span = F.sequence(F.floor(F.unix_date(F.col(start)) / BUCKET_DAYS), F.floor(F.unix_date(F.col(end)) / BUCKET_DAYS))
    ask = events.filter(F.col(start) <= F.col(end)).select(event_id, key, F.col(start).alias("_from"), F.col(end).alias("_to"), F.explode(span).alias("_bucket"))
    have = bars.withColumn("_bucket", F.floor(F.unix_date("date") / BUCKET_DAYS))
    met = ask.join(have, [key, "_bucket"]).filter(F.col("date").between(F.col("_from"), F.col("_to")))
    of = W.partitionBy(event_id)
    return met.withColumns({"pos": F.row_number().over(of.orderBy("date")) - 1, "n": F.count(F.lit(1)).over(of)}).drop("_from", "_to", "_bucket")


def window_features(events: DataFrame, bars: DataFrame, index: DataFrame, key: str, event_id: str, start: str, end: str) -> DataFrame:
    """Per event: vol_contraction_ratio, adr_pct, rs_slope, n_bars and drop_reason (null if there were bars).

    vol_contraction_ratio: mean volume of the later half of the bars over that of the earlier; null under two bars or with a mean <= 0.
    adr_pct: mean (high - low) / close; null if a close is not above zero or missing.
    rs_slope: least-squares slope of ln(close / index close) on the bar's position; bars without an index close are left out but keep
    their position; null under three.  index: date, close, at most a row a day.
    """
    idx = index.select(F.col("date"), F.col("close").alias("_index")).filter(F.col("_index").isNotNull()).dropDuplicates(["date"])
    rows = window_bars(events, bars, key, event_id, start, end).join(idx, "date", "left")
    early = F.col("pos") < F.floor(F.col("n") / 2)
    rows = rows.withColumns({"_y": log_ratio("close", "_index"), "_range": F.try_divide(F.col("high") - F.col("low"), F.col("close"))})
    x = F.when(F.col("_y").isNotNull(), F.col("pos").cast("double"))
    out = rows.groupBy(event_id).agg(
        F.count(F.lit(1)).alias("n_bars"),
        F.avg(F.when(early, F.col("volume"))).alias("_a"), F.avg(F.when(~early, F.col("volume"))).alias("_b"),
        F.avg("_range").alias("_adr"), F.min(F.coalesce(F.col("close") > 0, F.lit(False))).alias("_good"),
        F.count("_y").alias("_k"), F.regr_slope("_y", x).alias("_slope"),
    )
    feats = out.select(
        event_id, "n_bars",
        F.when((F.col("n_bars") >= 2) & (F.col("_a") > 0), F.try_divide("_b", "_a")).alias("vol_contraction_ratio"),
        F.when(F.col("_good"), F.col("_adr")).alias("adr_pct"), F.when(F.col("_k") >= 3, F.col("_slope")).alias("rs_slope"),
    )
    known = bars.select(key).distinct().withColumn("_known", F.lit(True))
    all_events = events.select(event_id, key).join(known, key, "left")
    reason = F.when(F.col("_known").isNull(), "no bars").when(F.col("n_bars").isNull(), "no bars in window")
    return all_events.join(feats, event_id, "left").select(event_id, F.coalesce("n_bars", F.lit(0)).alias("n_bars"), "vol_contraction_ratio", "adr_pct", "rs_slope", reason.alias("drop_reason"))


def forward_returns(events: DataFrame, bars: DataFrame, key: str, horizon: int = 20) -> DataFrame:
    """events with fwd_ret, fwd_end_date and fwd_reason: the return from the close of the event's date to that ``horizon`` bars later.

    Reasons in order: no bars (of the key), date not found, too few bars after, bad close.  bars: one row per (key, date).
    """
    g = W.partitionBy(key).orderBy("date")
    ahead = bars.select(key, "date", F.col("close").alias("_c0"), F.lead("close", horizon).over(g).alias("_c1"), F.lead("date", horizon).over(g).alias("_d1"), F.lit(True).alias("_found"))
    known = bars.select(key).distinct().withColumn("_known", F.lit(True))
    out = events.join(known, key, "left").join(ahead, [key, "date"], "left")
    good = (F.col("_c0") > 0) & (F.col("_c1") > 0)
    reason = F.when(F.col("_known").isNull(), "no bars").when(F.col("_found").isNull(), "date not found").when(F.col("_d1").isNull(), "too few bars after").when(~F.coalesce(good, F.lit(False)), "bad close")
    out = out.withColumn("fwd_reason", reason)
    ok = F.col("fwd_reason").isNull()
    return out.withColumns({"fwd_ret": F.when(ok, F.col("_c1") / F.col("_c0") - 1), "fwd_end_date": F.when(ok, F.col("_d1"))}).drop("_c0", "_c1", "_d1", "_found", "_known")


def factor_windows(events: DataFrame, factors: DataFrame, names: list[str]) -> DataFrame:
    """events (date, fwd_end_date) with {name}_window: the sum of each factor over (date, fwd_end_date], null if a date is not in the calendar.

    Differences of running sums over the factor calendar, which has one row a day and is small whatever the events are.
    """
    order = W.partitionBy(F.lit(0)).orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    sums = factors.select("date", *[F.sum(n).over(order).alias(n) for n in names])
    at = sums.select("date", *[F.col(n).alias(f"_{n}_0") for n in names])
    to = sums.select(F.col("date").alias("fwd_end_date"), *[F.col(n).alias(f"_{n}_1") for n in names])
    out = events.join(at, "date", "left").join(to, "fwd_end_date", "left")
    return out.withColumns({f"{n}_window": F.col(f"_{n}_1") - F.col(f"_{n}_0") for n in names}).drop(*[f"_{n}_{k}" for n in names for k in (0, 1)])
