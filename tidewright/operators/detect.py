"""Multi-stage pattern detection on bars: pivot, leg up, consolidation, extension before the breakout.

A candidate at position t of its segment needs the ``reach`` bars before it, as many as the parameters look back.  Candidates and bars meet in an
equi-join on (series, segment, bucket of positions), the band is cut by position, and the bars of a candidate become one sorted array of at
most reach + 1 structs; every rule is then an expression on slices of that array, inside the JVM.  One exchange of
the bars serves all stages.  Positions are 0-based within a segment.  Bars with nulls keep their position; a null is no extreme, fails a test,
and makes a mean or slope over it null.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.windows import clip01, finite

@dataclass(frozen=True)
class PatternParams:
    """Thresholds of the stages, the defaults fixed values; positions and durations are in bars."""

    pivot_back: int = 90
    pivot_lag: int = 15
    near: int = 5
    near_share: float = 0.95
    near_least: int = 2
    gap_open: float = 0.15
    leg_least: int = 15
    leg_most: int = 60
    gain_least: float = 0.35
    gain_most: float = 3.0
    up_share: float = 0.40
    snap: int = 20
    anchor: int = 60
    base_least: int = 10
    base_most: int = 42
    base_cap: int = 60
    drop_most: float = 0.30
    drop_exception: float = 0.35
    exceptions: int = 2
    pullback: float = 0.04
    rising: float = 0.98
    touch_share: float = 0.40
    touch_low: float = 1.02
    touch_close: float = 0.98
    extension: float = 0.08
    above_mean: float = 0.06
    up_close: float = 1.003
    up_run: int = 2

    @property
    def reach(self) -> int:
        """Bars before a candidate that any stage may look at: the pivot, the leg before it and the anchor before that."""
        return max(self.pivot_back, self.near, 5) + max(self.leg_most + self.anchor, self.near) + 1


FIELDS = ["idx", "date", "open", "high", "low", "close", "sma_10", "sma_20", "sma_50", "prev_close", "cum_up"]


def candidate_bars(candidates: DataFrame, features: DataFrame, reach: int) -> DataFrame:
    """candidates (series, segment_id, t, ...) with w: their bars t - reach .. t in order."""
    keys = ["series", "segment_id", "t"]
    bucket = 1 << reach.bit_length()  # so that two buckets hold the reach
    ask = candidates.select(*keys, F.explode(F.array_distinct(F.array(F.floor(F.col("t") / bucket), F.floor(F.greatest(F.col("t") - reach, F.lit(0)) / bucket)))).alias("bucket"))
    bars = features.withColumn("idx", F.col("days_in_segment") - 1).select("series", "segment_id", F.floor(F.col("idx") / bucket).alias("bucket"), F.struct(*FIELDS).alias("b"))
    band = ask.join(bars, ["series", "segment_id", "bucket"]).filter(F.col("b.idx").between(F.col("t") - reach, F.col("t")))
    arrays = band.groupBy(*keys).agg(F.array_sort(F.collect_list("b")).alias("w"))
    return candidates.join(arrays, keys)


def _part(lo: Column, hi: Column) -> Column:
    """Bars at positions lo..hi of a candidate, both included; positions before its first bar are not there."""
    first = F.col("w")[0]["idx"]
    start = F.when(lo < first, first).otherwise(lo)  # a null stays null
    return F.slice("w", (start - first + 1).cast("int"), F.greatest(hi - start + 1, F.lit(0)).cast("int"))


def _bar(i: Column, field: str) -> Column:
    return F.get("w", (i - F.col("w")[0]["idx"]).cast("int"))[field]


def _first(part: Column, key) -> Column:
    """Position of the first bar with the least key."""
    return F.array_min(F.transform(F.filter(part, lambda x: key(x).isNotNull()), lambda x: F.struct(key(x).alias("k"), x["idx"].alias("i"))))["i"]


def _count(part: Column, test) -> Column:
    return F.size(F.filter(part, test)).cast("bigint")


def _mean(part: Column, value) -> Column:
    total = F.aggregate(part, F.lit(0.0), lambda a, x: a + value(x))
    return F.try_divide(total, F.size(part))


def _slope(ys: Column) -> Column:
    """Least-squares slope of an array of numbers on 0, 1, 2, ...; null under two elements."""
    n = F.size(ys).cast("double")
    mid = (n - 1) / 2
    pairs = F.transform(ys, lambda y, i: F.struct(y.alias("y"), (i - mid).alias("x")))
    xy = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p["x"] * p["y"])
    return F.try_divide(xy, n * (n * n - 1) / 12)


def _settled(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """df with new columns, computed once: a one-element explode keeps the optimizer from copying them into every later use."""
    return df.withColumn("_s", F.explode(F.array(F.struct(*[c.alias(n) for n, c in new.items()])))).select("*", "_s.*").drop("_s")


STAGES = ["pivot_found", "no_spike", "no_gap", "leg_found", "base_length", "base_depth", "means_rise", "means_touched", "not_extended"]


def evaluate(candidates: DataFrame, features: DataFrame, p: PatternParams = PatternParams()) -> DataFrame:
    """Every candidate with the outcome of each stage (STAGES, null counts as failed), ``passed``, and the pattern's measures.

    candidates: rows of ``features`` (see series.add_features, with a column series).  Stages do not hide each other: each is
    judged where its inputs exist, so the same frame explains why a candidate failed.
    """
    c = candidate_bars(candidates.withColumn("t", F.col("days_in_segment") - 1), features, p.reach)
    t = F.col("t")
    lo, hi = F.greatest(F.lit(0), t - p.pivot_back), t - p.pivot_lag
    c = _settled(c, {"pivot": F.when(hi >= lo, _first(_part(lo, hi), lambda x: -x["high"]))})
    pivot = F.col("pivot")
    c = _settled(c, {"ph": _bar(pivot, "high")})
    ph = F.col("ph")
    around = _part(F.greatest(F.lit(0), pivot - p.near), F.least(t - 1, pivot + p.near))
    gap = F.try_divide(_bar(pivot, "open"), F.when(_bar(pivot, "prev_close") > 0, _bar(pivot, "prev_close"))) - 1
    leg_lo, leg_hi = F.greatest(F.lit(0), pivot - p.leg_most), pivot - p.leg_least
    ups = _bar(pivot, "cum_up")

    def starts(x: Column) -> Column:
        gain = (ph - x["close"]) / x["close"]
        return (x["close"] > 0) & (gain >= p.gain_least) & (gain <= p.gain_most) & ((ups - x["cum_up"]) / (pivot - x["idx"]) >= p.up_share)

    c = _settled(c, {
        "pivot_found": ph > 0,
        "no_spike": _count(around, lambda x: x["high"] >= ph * p.near_share) - 1 >= p.near_least,
        "no_gap": ~F.coalesce((pivot > 0) & (gap > p.gap_open), F.lit(False)),
        "leg0": F.when(leg_hi >= leg_lo, F.array_min(F.transform(F.filter(_part(leg_lo, leg_hi), starts), lambda x: x["idx"]))),
    })
    snapped = _first(_part(F.col("leg0"), F.least(F.col("leg0") + p.snap, leg_hi)), lambda x: x["close"])
    c = _settled(c, {"leg": snapped, "base": _part(pivot, t - 1)})
    leg, base = F.col("leg"), F.col("base")
    n = F.size(base)
    c = _settled(c, {"drops": F.transform(base, lambda x: (ph - x["low"]) / ph)})
    c = _settled(c, {"cons_max_drop_pct": F.array_max("drops")})
    deep = F.col("cons_max_drop_pct") > p.drop_most
    some = F.size(F.filter("drops", lambda d: (d > p.drop_most) & (d <= p.drop_exception)))
    severe = F.size(F.filter("drops", lambda d: d > p.drop_exception))

    def falls(mean: str) -> Column:
        a, b = _bar(pivot, mean), _bar(t - 1, mean)
        return F.coalesce((a > 0) & (b < a * p.rising), F.lit(False))

    def touched(x: Column) -> Column:
        out = F.lit(False)
        for m in ("sma_10", "sma_20", "sma_50"):
            out = out | F.coalesce((x[m] > 0) & (x["low"] <= x[m] * p.touch_low) & (x["close"] >= x[m] * p.touch_close), F.lit(False))
        return out

    anchor = leg - p.anchor
    lows = F.transform(_part(pivot + 1, t - 1), lambda x: x["low"] / ph)
    ranges = F.transform(base, lambda x: (x["high"] - x["low"]) / F.when(x["close"] > 0, x["close"]).otherwise(1.0))
    half = F.floor(n / 2).cast("int")
    early, late = _mean(F.slice(ranges, F.lit(1), half), lambda x: x), _mean(F.slice(ranges, half + 1, n - half), lambda x: x)
    with_mean = F.filter(base, lambda x: x["sma_20"].isNotNull())

    def below(j: Column) -> Column:
        here = F.get(base, j)["close"]
        return reduce(and_, [here < F.get(base, j + o)["close"] for o in (-2, -1, 1, 2)])

    minima = F.transform(
        F.filter(F.sequence(F.lit(2), F.greatest(n - 3, F.lit(2))), lambda j: (j <= n - 3) & F.coalesce(below(j), F.lit(False))),
        lambda j: F.get(base, j)["close"],
    )
    c = _settled(c, {"minima": minima})
    higher = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.size("minima") - 1, F.lit(1))), lambda j: (j < F.size("minima")) & (F.get("minima", j) > F.get("minima", j - 1))))
    tail = F.transform(_part(F.greatest(t - 4, F.lit(1)), t - 1), lambda x: (x["close"] > x["open"]) & (x["close"] > p.up_close * x["prev_close"]))
    run = F.aggregate(tail, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda a, u: F.struct(F.when(u, a["now"] + 1).otherwise(0).alias("now"), F.greatest(a["most"], F.when(u, a["now"] + 1).otherwise(0)).alias("most")))["most"]
    last, opened, mean10 = _bar(t - 1, "close"), _bar(t - 5, "open"), _bar(t - 1, "sma_10")
    stretched = F.coalesce((opened > 0) & ((last - opened) / opened > p.extension), F.lit(False)) | F.coalesce((mean10 > 0) & (last / mean10 - 1 > p.above_mean), F.lit(False)) | (run > p.up_run)
    c = _settled(c, {
        "leg_found": leg.isNotNull() & (_bar(leg, "close") > 0),
        "base_length": n.between(p.base_least, p.base_most) & (n <= p.base_cap),
        "base_depth": F.coalesce(~deep | ((some <= p.exceptions) & (severe == 0)), F.lit(False)) & (F.col("cons_max_drop_pct") >= p.pullback),
        "means_rise": ~(falls("sma_10") | falls("sma_20")),
        "ma_touches_pct_in_cons": F.try_divide(_count(base, touched), n),
        "legup_low_date": _bar(leg, "date"), "legup_high_date": _bar(pivot, "date"), "cons_start_date": _bar(pivot, "date"), "cons_end_date": _bar(t - 1, "date"),
        "legup_duration_days": (pivot - leg).cast("bigint"), "legup_gain_pct": F.try_divide(ph - _bar(leg, "close"), _bar(leg, "close")),
        "pre_legup_return": F.when((anchor >= 0) & (leg > 0), F.try_divide(_bar(leg - 1, "close") - _bar(anchor, "close"), F.when(_bar(anchor, "close") > 0, _bar(anchor, "close")))),
        "cons_duration_days": n.cast("bigint"), "cons_exception_days": F.when(deep, some).otherwise(0).cast("bigint"),
        "cons_low_trend_slope": F.when(F.size(lows) >= 3, _slope(lows)),
        "higher_low_count": higher.cast("bigint"), "range_contraction_ratio": F.when(early > 0, F.try_divide(late, early)),
        "pct_closes_above_20ma_in_cons": F.try_divide(_count(with_mean, lambda x: x["close"] > x["sma_20"]), F.size(with_mean)),
        "breakout_volume_ratio": F.try_divide(F.col("volume").cast("double"), F.when(F.col("vol_avg_20") > 0, F.col("vol_avg_20"))), "breakout_range_pct": F.col("daily_range_pct"),
        "not_extended": (t >= 5) & ~stretched,
    }).withColumn("means_touched", F.col("ma_touches_pct_in_cons") >= p.touch_share)
    passed = F.lit(True)
    for s in STAGES:
        passed = passed & F.coalesce(F.col(s), F.lit(False))
    return _settled(c, {"passed": passed}).drop("w", "base", "drops", "minima", "leg0", "ph", "pivot", "leg")


@dataclass(frozen=True)
class Variant:
    """A named choice among survivors."""

    name: str
    min_mom_pct: float
    max_high_distance: float | None = None


# The variants, and below them the columns of a setup.
VARIANTS = (Variant("strict", 0.90, 0.15), Variant("loose", 0.80))


def choose(survivors: DataFrame, variants: tuple[Variant, ...]) -> DataFrame:
    """The survivors of each variant (UNION ALL in one pass): universe_variant added, a row repeated for every variant it belongs to."""
    tests = []
    for v in variants:
        rule = F.col("mom_pct") >= v.min_mom_pct
        if v.max_high_distance is not None:
            rule = rule & (F.col("dist_52w_high_pct") <= v.max_high_distance)
        tests.append(F.when(rule, F.lit(v.name)))
    return survivors.withColumn("universe_variant", F.explode(F.array_compact(F.array(*tests))))


def quality_score(df: DataFrame, drop_most: float = 0.30) -> DataFrame:
    """Adds score, in 0..1: tightness, length, touches of means and volume surge, each clipped to 0..1."""
    parts = [(0.50, 1 - F.col("cons_max_drop_pct") / drop_most), (0.10, F.col("cons_duration_days") / 60), (0.20, F.col("ma_touches_pct_in_cons")), (0.20, F.col("breakout_volume_ratio") / 5)]
    total = F.lit(0.0)
    for weight, x in parts:
        total = total + weight * clip01(x)
    return df.withColumn("score", total)


def space_out(df: DataFrame, series: str, least: int = 30, by: tuple[str, ...] = ()) -> DataFrame:
    """Per series (and ``by``) a chronological choice of rows at least ``least`` bars apart.

    A row that collides with kept ones takes the place of the first of them if its score is strictly higher, else it is dropped;
    the other kept rows are not looked at again.  Distance is in bars within a segment, else calendar days / 1.4.
    The order matters, so this is a fold: per group an ordered array of small structs, folded inside the JVM.  Survivors are few per series.
    Columns: series, date, segment_id, days_in_segment, score.
    """
    keys = [*by, series]
    rest = [c for c in df.columns if c not in keys]
    item = F.struct("date", "segment_id", "days_in_segment", "score", F.struct(*rest).alias("row"))
    groups = df.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("rows"))

    def far(a: Column, b: Column) -> Column:
        bars = F.abs(a["days_in_segment"] - b["days_in_segment"]).cast("double")
        return F.when(a["segment_id"] == b["segment_id"], bars).otherwise(F.abs(F.datediff(a["date"], b["date"])) / 1.4)

    def step(kept: Column, r: Column) -> Column:
        hit = F.coalesce(F.array_min(F.transform(F.filter(F.transform(kept, lambda k, i: F.struct(i.alias("i"), k.alias("k"))), lambda x: far(r, x["k"]) < least), lambda x: x["i"])), F.lit(-1))
        swapped = F.transform(kept, lambda k, i: F.when((i == hit) & (r["score"] > k["score"]), r).otherwise(k))
        return F.when(hit < 0, F.concat(kept, F.array(r))).otherwise(swapped)

    nothing = F.slice("rows", 1, 0)
    return groups.select(*keys, F.explode(F.aggregate("rows", nothing, step)).alias("k")).select(*keys, "k.row.*").select(*df.columns)


OUTPUT = [
    "ticker", "date", "universe_variant", "mom_12_1", "mom_pct", "legup_low_date", "legup_high_date", "legup_duration_days", "legup_gain_pct", "pre_legup_return",
    "cons_start_date", "cons_end_date", "cons_duration_days", "cons_max_drop_pct", "cons_exception_days", "cons_low_trend_slope", "ma_touches_pct_in_cons",
    "breakout_volume_ratio", "breakout_range_pct", "higher_low_count", "range_contraction_ratio", "pct_closes_above_20ma_in_cons", "dist_52w_high_pct", "close", "adv_20",
]


def detect_setups(candidates: DataFrame, features: DataFrame, params: PatternParams = PatternParams(), variants: tuple[Variant, ...] = VARIANTS, spacing: int = 30) -> DataFrame:
    """Setups of all variants (UNION ALL), each variant spaced on its own.  OUTPUT columns and series."""
    survivors = quality_score(evaluate(candidates, features, params).filter("passed"), params.drop_most)
    return space_out(choose(survivors, variants), "series", spacing, ("universe_variant",)).select("series", *OUTPUT)


def detect_or_relax(candidates: DataFrame, features: DataFrame, params: PatternParams, relaxed: PatternParams, relaxed_candidates: DataFrame | None = None, variant: str = "loose", least: int = 200, **k) -> tuple[DataFrame, bool]:
    """Setups by ``params``, or by ``relaxed`` if those of one variant are fewer than ``least``; and whether they were relaxed.

    The choice hangs on a count, so this runs a job.
    """
    first = detect_setups(candidates, features, params, **k).persist()
    if first.filter(F.col("universe_variant") == variant).limit(least).count() >= least:
        return first, False
    first.unpersist()
    return detect_setups(relaxed_candidates if relaxed_candidates is not None else candidates, features, relaxed, **k), True
