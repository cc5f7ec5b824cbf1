"""Audits of bars: bad readings, moves that no split explains, coverage by year, presence of known tickers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewright.functions.windows import ratio

FLAGS = ["bad_order", "has_null", "not_positive", "flat", "jump"]


def bar_flags(bars: DataFrame, start: str, end: str, series: str = "ticker", jump: float = 0.5) -> DataFrame:
    """Bars of the dates start..end (both included) with year and FLAGS; the bar before is looked for inside the dates.

    bad_order: high < low, low above or high below open or close; has_null: any value null; not_positive: a price <= 0;
    flat: open = high = low = close with volume; jump: close moved by more than ``jump`` from the bar before.
    Flags are null where their inputs are (three-valued logic).
    """
    rows = bars.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    prev = F.lag("close").over(W.partitionBy(series).orderBy("date"))
    o, h, lo, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    any_null: Column = F.lit(False)
    for x in (o, h, lo, c, v):
        any_null = any_null | x.isNull()
    return rows.withColumn("prev_close", prev).withColumns({
        "year": F.year("date").cast("bigint"),
        "bad_order": (h < lo) | (lo > F.least(o, c)) | (h < F.greatest(o, c)),
        "has_null": any_null,
        "not_positive": (o <= 0) | (h <= 0) | (lo <= 0) | (c <= 0),
        "flat": (o == h) & (h == lo) & (lo == c) & (v > 0),
        "jump": (F.col("prev_close") > 0) & (c > 0) & (F.abs(ratio(c, "prev_close") - 1) > jump),
    })


def audit_totals(flagged: DataFrame) -> DataFrame:
    """One row: bars, the number of each flag, and n_hard, the sum of the first four (a bar may count more than once)."""
    out = flagged.agg(F.count(F.lit(1)).alias("n_bars"), *[F.count_if(F.col(f)).alias(f"n_{f}") for f in FLAGS])
    return out.withColumn("n_hard", F.col("n_bad_order") + F.col("n_has_null") + F.col("n_not_positive") + F.col("n_flat"))


def audit_years(flagged: DataFrame, limit: float = 0.001) -> DataFrame:
    """Per year: bars, bars with any of the first four flags (each once), their share, and whether it is over the limit."""
    hard = F.lit(False)
    for f in FLAGS[:4]:
        hard = hard | F.coalesce(F.col(f), F.lit(False))
    out = flagged.groupBy("year").agg(F.count(F.lit(1)).alias("n_bars"), F.count_if(hard).alias("n_hard"))
    return out.withColumns({"share": F.col("n_hard") / F.col("n_bars"), "over_limit": F.col("n_hard") / F.col("n_bars") > limit})


def unexplained_moves(flagged: DataFrame, splits: DataFrame | None) -> DataFrame:
    """One row: n_moves, n_without_split.  Without a split table nothing can be explained."""
    moves = flagged.filter("jump").select("ticker", "date")
    if splits is None:
        return moves.agg(F.count(F.lit(1)).alias("n_moves"), F.lit(None).cast("bigint").alias("n_without_split"))
    known = splits.select("ticker", "date", F.lit(True).alias("_split")).distinct()
    return moves.join(known, ["ticker", "date"], "left").agg(F.count(F.lit(1)).alias("n_moves"), F.count_if(F.col("_split").isNull()).alias("n_without_split"))


def coverage(bars: DataFrame, first: int, last: int, least: int = 200) -> DataFrame:
    """Every year first..last: distinct dates (0 where there are none) and whether they are below ``least``."""
    spark = bars.sparkSession
    years = spark.range(first, last + 1).withColumnRenamed("id", "year")
    found = bars.groupBy(F.year("date").cast("bigint").alias("year")).agg(F.count_distinct("date").alias("n"))
    out = years.join(found, "year", "left").withColumn("n_dates", F.coalesce("n", F.lit(0)))
    return out.select("year", "n_dates", (F.col("n_dates") < least).alias("low"))


def probes(bars: DataFrame, tickers: list[str]) -> DataFrame:
    """One row per asked ticker: present, n_bars, first_date, last_date."""
    asked = bars.sparkSession.createDataFrame([(t,) for t in tickers], "ticker string")
    found = bars.filter(F.col("ticker").isin(tickers)).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    return asked.join(found, "ticker", "left").select("ticker", F.col("n").isNotNull().alias("present"), F.coalesce("n", F.lit(0)).alias("n_bars"), "first_date", "last_date")


def probe_verdict(found: DataFrame) -> DataFrame:
    """share of probes present and verdict: proceed from 0.5, pivot below 0.2, else caveat."""
    out = found.agg(F.avg(F.col("present").cast("double")).alias("share"))
    return out.withColumn("verdict", F.when(F.col("share") >= 0.5, "proceed").when(F.col("share") < 0.2, "pivot").otherwise("caveat"))
