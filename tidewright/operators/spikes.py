"""Implausible readings of measured series: physical bounds, Hampel spikes and stuck values.

Method: a rolling median over neighbouring bars gives the level of a series at each bar, the median
absolute deviation of the whole series from it gives the scale (a Hampel filter, on logarithms), run lengths give stuck
values, and the bounds are plain comparisons.

A first pass over tiles finds departures and runs, which hang on neighbouring bars alone, and counts what describes a
series: a histogram of the deviations (BUCKETS steps an octave) and the numbers of readings, runs and longer runs.  The counts of
the tiles of a series add up, so the scale does not hang on tiles; the median is interpolated inside its step.
A second pass holds the few candidates against the scale and the runs of their series.

Defined results
* Null, NaN or infinite readings are never flagged by themselves and are skipped in levels and runs.
* Volume 0 (a halted day) is neither a reading of the volume series nor part of a run.
* Two deliveries of one bar are judged each by its own values; levels are medians of other bars, taken
  over the delivery loaded last, so neither delivery can hide the other.  Runs are followed both
  through the first and through the last deliveries, and
  hold for every delivery of a bar with the same reading.
* A row without feed or ticker belongs to the series of that null; a row without a date is in no
  series and is judged by the bounds alone.
* A spike must leave the medians of the bars before and of those after it, to the same side.  A lasting change of level
  agrees with one of the two, and is not flagged.  The first and last bar of a series have no such pair and are not flagged.
* Neighbours and runs are looked for among the ``halo`` rows on either side of a tile; a longer stretch without any reading parts a series.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewright.operators.settle import settle
from tidewright.operators.tiles import bar_index, map_tiles, numbers, with_halo

PRICES = ("open", "high", "low", "close")
METRICS = ("high", "low", "close", "volume")
SEQUENCES = (("close", "first"), ("close", "last"), ("volume", "first"), ("volume", "last"))
BUCKETS = 16  #: steps of the histogram of deviations per octave
LEAST = -640  #: the step of deviations of 2**-40 or less, which count as 0
LONGEST = 60  #: repeats of a run beyond these count no more


@dataclass(frozen=True)
class SpikeParams:
    """Parameters of :func:`implausible`."""

    half: int = 5  #: bars on either side that give the level
    price_z: float = 12.5  #: scales that a price must leave its level by
    volume_z: float = 6.0  #: the same for the logarithm of volume
    price_floor: float = 0.004  #: least scale of a log price
    volume_floor: float = 0.20  #: least scale of a log volume
    volume_least: float = 3.5  #: least departure of a log volume (busy days of a few times the usual are normal)
    run_chance: float = 1e-3  #: expected number of runs as long as this in the series, below which a run is stuck
    run_least: int = 4  #: shortest run that can be stuck
    tile: int = 2048  #: bars of a tile
    halo: int = 256  #: rows repeated beyond a tile's ends; more than LONGEST


def physical_bounds() -> Column:
    """True where a bar's own values cannot be: price <= 0, volume < 0, high < low, open or close outside low..high."""
    o, h, lo, c, v = (F.nanvl(F.col(x).cast("double"), F.lit(None).cast("double")) for x in (*PRICES, "volume"))
    tests = [o <= 0, h <= 0, lo <= 0, c <= 0, v < 0, h < lo, o > h, o < lo, c > h, c < lo]
    out = F.lit(False)
    for t in tests:
        out = out | F.coalesce(t, F.lit(False))
    return out


def _median_of(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row medians of a matrix with NaN for missing, and the number of values."""
    rows = np.sort(rows, axis=1)
    n = np.count_nonzero(~np.isnan(rows), axis=1)
    at = np.arange(len(rows))
    return (rows[at, np.maximum((n - 1) // 2, 0)] + rows[at, np.minimum(n // 2, rows.shape[1] - 1)]) / 2, n


def _neighbours(v: np.ndarray, g: np.ndarray, offsets: range) -> np.ndarray:
    """Values at the given distances inside the same group, NaN where there is none."""
    n = len(v)
    out = np.full((n, len(offsets)), np.nan)
    for j, o in enumerate(offsets):
        a, b = max(0, -o), n - max(0, o)
        if a < b:
            out[a:b, j] = np.where(g[a:b] == g[a + o : b + o], v[a + o : b + o], np.nan)
    return out


def departures(values: np.ndarray, group: np.ndarray, bar: np.ndarray, last: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How far readings leave their surroundings: rows that stand for their bar, their deviations from the level, and the departure of every row.

    values: logarithms, NaN where there is no reading; group: the tile, bar: number of the bar within the call (equal for
    deliveries of one bar), both not decreasing; last: true for the delivery that stands for its bar.  The departure is the smaller of
    the distances from the medians before and after the bar, 0 unless both are there and lie on the same side.
    """
    out = np.zeros(len(values))
    ref = np.flatnonzero(last & ~np.isnan(values))
    if not len(ref):
        return ref, np.zeros(0), out
    v, g = values[ref], group[ref]
    both = _neighbours(v, g, range(-half, half + 1))
    level, _ = _median_of(both)
    before, n_before = _median_of(both[:, :half])
    after, n_after = _median_of(both[:, half + 1 :])
    # each delivery is held against the neighbours of its bar
    slot = np.full(int(bar[-1]) + 1, -1)
    slot[bar[ref]] = np.arange(len(ref))
    at = slot[bar]
    can = (at >= 0) & ~np.isnan(values)
    at, x = at[can], values[can]
    d_before, d_after = x - before[at], x - after[at]
    same = (n_before[at] > 0) & (n_after[at] > 0) & (np.sign(d_before) == np.sign(d_after))
    out[can] = np.where(same, np.minimum(np.abs(d_before), np.abs(d_after)), 0.0)
    return ref, np.abs(v - level), out


def runs(values: np.ndarray, group: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of equal readings along ``rows``: the rows with a reading, whether each repeats the one before, and the length of its run."""
    rows = rows[~np.isnan(values[rows])]
    if not len(rows):
        return rows, np.zeros(0, bool), np.zeros(0, np.int64)
    v, g = values[rows], group[rows]
    repeat = np.r_[False, (v[1:] == v[:-1]) & (g[1:] == g[:-1])]
    start = np.flatnonzero(~repeat)
    length = np.diff(np.r_[start, len(v)])
    return rows, repeat, np.repeat(length, length)


SCHEMA = "series string, kind int, bar_id bigint, amount double, steps array<int>, counts array<bigint>"


def spike_kernel(params: SpikeParams):
    """The first pass for :func:`map_tiles`: SCHEMA with, for metric m and sequence s, kinds m (histogram of deviations), 4 + m (a departure
    beyond the least scale), 8 + s (readings, runs, runs of more than one) and 12 + s (a repeat in a run of run_least or more)."""

    def kernel(t: pa.Table, group: np.ndarray) -> pa.Table:
        idx = t.column("bar").to_numpy()
        bar = np.cumsum(np.r_[False, (idx[1:] != idx[:-1]) | (group[1:] != group[:-1])])
        n_bars, n_groups = int(bar[-1]) + 1, int(group[-1]) + 1
        ends = {"first": np.r_[True, bar[1:] != bar[:-1]], "last": np.r_[bar[1:] != bar[:-1], True]}
        core = t.column("core").to_numpy(zero_copy_only=False)
        x = {c: numbers(t.column(c)) for c in METRICS}
        x = {c: np.where(np.isfinite(v), v, np.nan) for c, v in x.items()}
        head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        series, ids = t.column("series"), t.column("bar_id")
        out = []

        def add(kind: int, names: pa.ChunkedArray, bar_id: pa.ChunkedArray | None, amount: np.ndarray | None, steps: pa.Array | None, counts: pa.Array | None) -> None:
            n = len(names)
            none = lambda kind: pa.nulls(n, kind)
            out.append(pa.table({
                "series": names, "kind": pa.array(np.full(n, kind, np.int32)), "bar_id": bar_id if bar_id is not None else none(pa.int64()), "amount": pa.array(amount) if amount is not None else none(pa.float64()),
                "steps": steps if steps is not None else none(pa.list_(pa.int32())), "counts": counts if counts is not None else none(pa.list_(pa.int64())),
            }))

        for m, c in enumerate(METRICS):
            with np.errstate(divide="ignore", invalid="ignore"):
                logs = np.where(x[c] > 0, np.log(x[c]), np.nan)
            ref, dev, far = departures(logs, group, bar, ends["last"], params.half)
            own = core[ref]
            with np.errstate(divide="ignore"):
                step = np.maximum(np.floor(BUCKETS * np.log2(dev[own])), LEAST).astype(np.int64)
            code, n = np.unique(group[ref[own]] * 4096 + step - LEAST, return_counts=True)
            of = code // 4096
            at = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
            cuts = pa.array(np.r_[at, len(of)], pa.int32())
            add(m, series.take(pa.array(head[of[at]])), None, None, pa.ListArray.from_arrays(cuts, pa.array((code % 4096 + LEAST).astype(np.int32))), pa.ListArray.from_arrays(cuts, pa.array(n.astype(np.int64))))
            least = params.volume_z * params.volume_floor if c == "volume" else params.price_z * params.price_floor
            keep = np.flatnonzero(core & (far > (max(least, params.volume_least) if c == "volume" else least)))
            add(4 + m, series.take(pa.array(keep)), ids.take(pa.array(keep)), far[keep], None, None)
        active = ~(x["volume"] == 0)
        for s, (c, end) in enumerate(SEQUENCES):
            rows, repeat, length = runs(x[c], group, np.flatnonzero(ends[end] & active))
            own = core[rows]
            tally = [np.bincount(group[rows[pick]], minlength=n_groups) for pick in (own, own & ~repeat, own & ~repeat & (length > 1))]
            live = np.flatnonzero(tally[0])
            flat = np.stack([k[live] for k in tally], axis=1).astype(np.int64).ravel()
            add(8 + s, series.take(pa.array(head[live])), None, None, None, pa.ListArray.from_arrays(pa.array(np.arange(len(live) + 1) * 3, pa.int32()), pa.array(flat)))
            held = repeat & (length >= params.run_least)
            # another delivery of the bar with the same reading is as stuck
            reading, size = np.full(n_bars, np.nan), np.zeros(n_bars)
            reading[bar[rows[held]]], size[bar[rows[held]]] = x[c][rows[held]], np.minimum(length[held] - 1, LONGEST)
            keep = np.flatnonzero(core & (x["volume"] > 0) & (x[c] == reading[bar]))
            add(12 + s, series.take(pa.array(keep)), ids.take(pa.array(keep)), size[bar[keep]], None, None)
        return pa.concat_tables(out)

    return kernel


def scales(counts: DataFrame) -> DataFrame:
    """series, kind, mad: the median of the deviations, from summed histograms.  A series has at most some hundred steps, whatever its length."""
    pairs = F.explode(F.arrays_zip("steps", "counts")).alias("p")
    steps = counts.select("series", "kind", pairs).groupBy("series", "kind", F.col("p.steps").alias("step")).agg(F.sum("p.counts").alias("n"))
    of = W.partitionBy("series", "kind")
    upto = steps.withColumns({"upto": F.sum("n").over(of.orderBy("step")), "half": F.sum("n").over(of) / 2})
    inside = (F.col("step") + (F.col("half") - F.col("upto") + F.col("n")) / F.col("n")) / BUCKETS
    value = F.when(F.col("step") == LEAST, 0.0).otherwise(F.pow(F.lit(2.0), inside))
    at = upto.filter((F.col("upto") >= F.col("half")) & (F.col("upto") - F.col("n") < F.col("half")))
    return at.groupBy("series", "kind").agg(F.min(value).alias("mad"))


def implausible(bars: DataFrame, params: SpikeParams = SpikeParams()) -> DataFrame:
    """Rows of ``bars`` with a bad reading: bar_id, out_of_bounds, is_spike, is_stuck (one row per bar_id).

    Two exchanges of the rows: one to number the bars of a series by year, one to lay out tiles.  The first pass runs as a job and leaves its counts and
    candidates in the shared folder; candidates meet the few numbers of their series in a join on series, which adaptive
    execution splits where one series has most of them.  Extra columns are ignored.  An empty input gives an empty result.
    """
    rows = bars.select("bar_id", "feed", "ticker", "date", *[F.col(c).cast("double").alias(c) for c in (*PRICES, "volume")], "loaded_at")
    bounds = rows.filter(physical_bounds()).select("bar_id", F.lit(True).alias("out_of_bounds"), F.lit(False).alias("is_spike"), F.lit(False).alias("is_stuck"))
    named = rows.filter(F.col("date").isNotNull()).select(
        "bar_id", F.struct("feed", "ticker").alias("series"), "date", "high", "low", "close", "volume", "loaded_at"
    ).withColumn("series", F.to_json("series"))  # null names become a name of their own
    indexed = bar_index(named, ["series"], F.year("date"), ["date", "loaded_at", "bar_id"])
    tiles = with_halo(indexed, "idx", params.tile, min(params.halo, params.tile), min(params.halo, params.tile)).withColumn("bar", F.unix_date("date"))
    passed = map_tiles(tiles.select("bar_id", "series", "tile", "idx", "bar", "core", "high", "low", "close", "volume"), ["series", "tile"], ["series", "tile", "idx"], spike_kernel(params), SCHEMA)
    found = settle(passed, "spikes")
    kind = F.col("kind")
    mads = scales(found.filter(kind < 4))
    far = found.filter(kind.between(4, 7)).select("series", (kind - 4).alias("kind"), "bar_id", "amount").join(mads, ["series", "kind"])
    price = kind < METRICS.index("volume")
    scale = F.greatest(1.4826 * F.col("mad"), F.when(price, params.price_floor).otherwise(params.volume_floor))
    limit = F.greatest(F.when(price, params.price_z).otherwise(params.volume_z) * scale, F.when(price, 0.0).otherwise(params.volume_least))
    spikes = far.filter(F.col("amount") > limit).select("bar_id", F.lit(False).alias("out_of_bounds"), F.lit(True).alias("is_spike"), F.lit(False).alias("is_stuck"))
    tally = found.filter(kind.between(8, 11)).groupBy("series", (kind - 8).alias("kind")).agg(*[F.sum(F.col("counts")[i]).alias(c) for i, c in enumerate(("n", "runs", "longer"))])
    # with p the share of the series' other runs that are longer than one reading, a run of n + 1 readings is expected length * p**n times
    p = (F.greatest(F.col("longer") - 1, F.lit(0)) + 0.5) / (F.col("runs") + 1)
    held = found.filter(kind >= 12).select("series", (kind - 12).alias("kind"), "bar_id", "amount").join(tally, ["series", "kind"])
    stuck = held.filter(F.col("n") * F.pow(p, F.col("amount")) < params.run_chance).select("bar_id", F.lit(False).alias("out_of_bounds"), F.lit(False).alias("is_spike"), F.lit(True).alias("is_stuck"))
    return bounds.unionByName(spikes).unionByName(stuck).groupBy("bar_id").agg(*[F.max(c).alias(c) for c in ("out_of_bounds", "is_spike", "is_stuck")])
