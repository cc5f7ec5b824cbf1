"""Bars, splits and factor files: loaders that tolerate the spellings found in practice."""

from __future__ import annotations

import io
import zipfile

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

# Accepted column names, in order of preference.
BAR_NAMES = {
    "ticker": ["ticker", "symbol", "T"],
    "date": ["date", "window_start", "timestamp", "t"],
    "open": ["open", "o"],
    "high": ["high", "h"],
    "low": ["low", "l"],
    "close": ["close", "c"],
    "volume": ["volume", "v"],
}
SPLIT_DATES = ["execution_date", "ex_date", "date", "effective_date"]


def normalize_bars(raw: DataFrame) -> DataFrame:
    """ticker, date, open, high, low, close, volume from any accepted spelling.

    Dates may be dates, timestamps, text, or epoch numbers, whose unit (seconds, milli-, micro- or nanoseconds) is told by their size: the units lie
    a factor of a thousand apart, so that each is meant for the years 1973 to 5138 alone.  Names are matched exactly before they are matched
    without case, so that ``T`` (ticker) and ``t`` (time) may stand side by side.  Raises ValueError naming the columns that are missing.
    """
    at: dict[str, int] = {}
    for k, names in BAR_NAMES.items():
        same = [raw.columns.index(n) for n in names if n in raw.columns]
        alike = [i for n in names for i, c in enumerate(raw.columns) if c.lower() == n.lower() and c not in sum(BAR_NAMES.values(), [])]
        if same or alike:
            at[k] = (same + alike)[0]
    if lost := [k for k in BAR_NAMES if k not in at]:
        raise ValueError(f"bars lack {', '.join(lost)}; columns are {', '.join(raw.columns)}")
    kind = raw.schema.fields[at["date"]].dataType
    named = raw.toDF(*[f"_{i}" for i in range(len(raw.columns))])  # by position, as Spark takes T and t for one name
    col = lambda k: F.col(f"_{at[k]}")
    when = col("date")
    if isinstance(kind, T.IntegralType):
        size = F.abs(when.cast("bigint"))
        day = F.when(size >= 10**17, F.lit(86_400 * 10**9)).when(size >= 10**14, F.lit(86_400 * 10**6)).when(size >= 10**11, F.lit(86_400_000)).otherwise(F.lit(86_400))
        when = F.date_from_unix_date(F.floor(when / day).cast("int"))
    else:
        when = when.cast("date")
    prices = [col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")]
    return named.select(col("ticker").cast("string").alias("ticker"), when.alias("date"), *prices, col("volume").cast("bigint").alias("volume"))


def read_splits(spark: SparkSession, path: str) -> DataFrame | None:
    """Distinct (ticker, date) of split events; None if there is no such file or it lacks the columns.  A file that can't be read raises."""
    try:
        raw = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return normalize_splits(raw)


def normalize_splits(raw: DataFrame) -> DataFrame | None:
    """Distinct (ticker, date) of split events; None if the columns are not there."""
    ticker = next((c for c in ("ticker", "symbol") if c in raw.columns), None)
    date = next((c for c in SPLIT_DATES if c in raw.columns), None)
    if ticker is None or date is None:
        return None
    return raw.select(F.col(ticker).cast("string").alias("ticker"), F.col(date).cast("date").alias("date")).distinct()


def latest_bars(delivered: DataFrame) -> DataFrame:
    """series, feed, ticker, date, open, high, low, close, volume: of several deliveries of a bar the one loaded last.

    ``series`` is feed/ticker.  An aggregate, so that deliveries meet before the shuffle.
    """
    fields = ["open", "high", "low", "close", "volume"]
    last = F.max(F.struct("loaded_at", "bar_id", *fields)).alias("b")
    rows = delivered.filter(F.col("date").isNotNull()).groupBy("feed", "ticker", "date").agg(last)
    return rows.select(F.concat("feed", F.lit("/"), "ticker").alias("series"), "feed", "ticker", "date", *[F.col(f"b.{c}").alias(c) for c in fields])


def zip_member_text(path: str, encoding: str = "latin-1") -> str:
    """Text of the first .csv member of a zip file."""
    with zipfile.ZipFile(path) as z:
        name = next((n for n in z.namelist() if n.lower().endswith(".csv")), None)
        if name is None:
            raise ValueError(f"no csv in {path}")
        return z.read(name).decode(encoding)


def text_lines(spark: SparkSession, text: str) -> DataFrame:
    """line_no, line of one small text."""
    return spark.createDataFrame([(i, x.rstrip("\r\n")) for i, x in enumerate(io.StringIO(text))], "line_no bigint, line string")


def data_block(lines: DataFrame) -> DataFrame:
    """The first run of consecutive lines whose first comma-separated token is eight digits (line_no, line).

    One file's lines are one ordered group; files of this kind are small.
    """
    good = F.trim(F.split(F.coalesce("line", F.lit("")), ",")[0]).rlike(r"^\d{8}$")
    order = W.partitionBy(F.lit(0)).orderBy("line_no")
    marked = lines.withColumn("good", good)
    run = marked.withColumn("breaks", F.sum((~F.col("good")).cast("int")).over(order))
    first = F.min(F.when(F.col("good"), F.col("breaks"))).over(W.partitionBy(F.lit(0)))
    return run.withColumn("first", first).filter(F.col("good") & (F.col("breaks") == F.col("first"))).select("line_no", "line")


def parse_factors(lines: DataFrame, names: list[str]) -> DataFrame:
    """date and the named factors, percent turned into shares, from the data block of a factor file."""
    cells = F.split("line", ",")
    values = [(F.trim(cells[i + 1]).cast("double") / 100).alias(n) for i, n in enumerate(names)]
    return data_block(lines).select(F.to_date(F.trim(cells[0]), "yyyyMMdd").alias("date"), *values)


def factor_panel(market: DataFrame, momentum: DataFrame, start: str | None = None) -> DataFrame:
    """Inner join of two factor tables by date, rows with a null left out (NaN kept), from ``start`` on."""
    both = market.join(momentum, "date")
    for c in both.columns:
        both = both.filter(F.col(c).isNotNull())
    return both.filter(F.col("date") >= F.lit(start).cast("date")) if start else both
