"""Window expressions: full-window rolling statistics, average-rank percentiles, running counts, first-index extremes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rolling(value: Column | str, over: WindowSpec, n: int, lag: int = 0, kind: str = "avg") -> Column:
    """``kind`` (avg, max, min, sum) of the ``n`` rows that end ``lag`` rows back; null until all n are there and not null."""
    frame = over.rowsBetween(-(n - 1) - lag, -lag)
    v = _col(value)
    return F.when(F.count(v).over(frame) == n, getattr(F, kind)(v).over(frame))


def rank_share(value: Column | str, within: list[str]) -> Column:
    """Average rank of ``value`` in its group divided by the group's size; ties share their mean rank."""
    v = _col(value)
    over = Window.partitionBy(*within)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*within, v))
    return (F.rank().over(over.orderBy(v)) + (ties - 1) / 2) / F.count(F.lit(1)).over(over)


def running_count(flag: Column, over: WindowSpec) -> Column:
    """Number of rows up to and with the current one for which ``flag`` is true."""
    return F.sum(F.coalesce(flag, F.lit(False)).cast("long")).over(over.rowsBetween(Window.unboundedPreceding, 0))


def first_argmax(index: Column | str, value: Column | str) -> Column:
    """Aggregate: the smallest index among the rows with the largest value (nulls left out)."""
    i, v = _col(index), _col(value)
    return F.min(F.when(v.isNotNull(), F.struct((-v).alias("v"), i.alias("i")))).getField("i")


def first_argmin(index: Column | str, value: Column | str) -> Column:
    """Aggregate: the smallest index among the rows with the smallest value."""
    i, v = _col(index), _col(value)
    return F.min(F.when(v.isNotNull(), F.struct(v.alias("v"), i.alias("i")))).getField("i")


def finite(value: Column | str) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    v = _col(value).cast("double")
    return F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))


def missing(value: Column | str) -> Column:
    """True for null or NaN."""
    v = _col(value).cast("double")
    return v.isNull() | F.isnan(v)


def clip01(value: Column | str) -> Column:
    """The value limited to 0..1; null and NaN become null."""
    v = _col(value).cast("double")
    return F.when(~missing(v), F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))


def log_ratio(a: Column | str, b: Column | str) -> Column:
    """ln(a / b), null unless both are above zero."""
    x, y = _col(a), _col(b)
    return F.when((x > 0) & (y > 0), F.ln(x / y))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(_col(a).cast("double"), _col(b).cast("double"))


def text_or(value: Column | str, default: str) -> Column:
    """The value as it is, or ``default`` where it is null or blank."""
    v = _col(value)
    return F.when(F.trim(v) != "", v).otherwise(F.lit(default))
