"""Rolling totals over trailing periods, by banded window operators on dense blocks.

Entities by days are packed into dense numpy blocks, one row per (series, time tile), which are multiplied
by banded 0/1 matrices: column t of the band for a period of w days holds ones in the rows t-w+1..t.  A tile
carries the days before it as a halo, so tiles are independent and a long series is never one task.

Defined results
* Of several deliveries of a bar the one loaded last counts, the larger bar_id at equal times.
* A day without a bar, or with a null volume, has volume 0.  Every day from a series' first to its last
  date has a row.
* Trailing totals and averages at the start of a series cover the days that there are; an average is the
  total divided by the number of days covered.
* Bar averages are null until the window is full and where a reading in it is null; NaN readings count as null.
* Rows without a date are in no series and left out; a null feed or ticker is a name of its own.
* An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators.tiles import bar_index, map_tiles, numbers, with_halo


def band(halo: int, length: int, window: int, lag: int = 0) -> np.ndarray:
    """The (halo + length, length) operator that sums ``window`` positions up to ``lag`` before each position of a tile."""
    t = np.arange(length)[None, :] + halo - lag
    j = np.arange(halo + length)[:, None]
    return ((j <= t) & (j > t - window)).astype(np.float64)


def bar_averages(bars: DataFrame, means: dict[str, tuple[str, int, int]], tile: int = 512) -> DataFrame:
    """``bars`` (series, idx, columns of ``means``) with window means over bars added.

    means: new column -> (value column, window, lag).  One block per tile: (tiles x positions) @ band.
    """
    halo = max(w + lag for _, w, lag in means.values())
    values = sorted({c for c, _, _ in means.values()})
    bands = {name: band(halo, tile, w, lag) for name, (_, w, lag) in means.items()}
    base = [f for f in bars.schema.fields]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in base] + [f"`{n}` double" for n in means])
    tiles = with_halo(bars, "idx", tile, halo, 0)
    # a row is also the halo of the next tile; a tile made of halo alone yields nothing

    def kernel(t: pa.Table, group: np.ndarray) -> pa.Table:
        core = t.column("core").to_numpy(zero_copy_only=False)
        n = int(group[-1]) + 1
        pos = t.column("idx").to_numpy() - t.column("tile").to_numpy() * tile + halo
        shape = (n, halo + tile)
        blocks = {}
        for c in values:
            x = numbers(t.column(c))
            there = np.isfinite(x)
            v, k = np.zeros(shape), np.zeros(shape)
            v[group[there], pos[there]] = x[there]
            k[group[there], pos[there]] = 1.0
            blocks[c] = (v, k)
        own, at = group[core], pos[core] - halo
        out = t.select([f.name for f in base]).filter(core)
        for name, (c, w, _) in means.items():
            v, k = blocks[c]
            total, count = (v @ bands[name])[own, at], (k @ bands[name])[own, at]
            out = out.append_column(name, pa.array(total / w, mask=count < w - 0.5))
        return out

    return map_tiles(tiles, ["series", "tile"], ["series", "tile", "idx"], kernel, schema, min_rows=65536)


def trailing_days(bars: DataFrame, value: str, windows: tuple[int, ...], keep: dict[str, str], tile: int = 128) -> DataFrame:
    """Dense days per series with totals and averages of ``value``: series, day, is_bar, value, total_{w}d, avg_{w}d, kept columns.

    bars: one row per (series, day as days since 1970) with ``value`` and the double columns of ``keep`` (column -> output name).
    """
    halo = max(windows) - 1
    spans = bars.groupBy("series").agg(F.min("day").alias("first"), F.max("day").alias("last"))
    low, high = F.floor(F.col("first") / tile), F.floor(F.col("last") / tile)
    frames = spans.select("series", "first", "last", F.explode(F.sequence(low, high)).alias("tile"))
    cols = [value, *keep]
    frame_rows = frames.select("series", "tile", F.lit(None).cast("int").alias("day"), F.lit(True).alias("core"), "first", "last", *[F.lit(None).cast("double").alias(c) for c in cols])
    rows = bars.select("series", "day", *[F.col(c).cast("double").alias(c) for c in cols])
    bar_rows = with_halo(rows, "day", tile, halo, 0).select("series", "tile", "day", "core", F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"), *cols)
    bands = {w: band(halo, tile, w) for w in windows}
    schema = ", ".join(["series string", "day int", "is_bar boolean", f"{value} bigint"] + [f"total_{w}d bigint, avg_{w}d double" for w in windows] + [f"{n} double" for n in keep.values()])

    def kernel(t: pa.Table, group: np.ndarray) -> pa.Table:
        n = int(group[-1]) + 1
        # rows of a tile come with the frame row first, as a null day sorts first
        start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        first, last = numbers(t.column("first"))[start], numbers(t.column("last"))[start]
        tile_no = t.column("tile").to_numpy()[start]
        framed = ~np.isnan(first)  # a halo may reach a tile beyond the last day
        day = numbers(t.column("day"))
        bar = ~np.isnan(day)
        g = group[bar]
        pos = day[bar].astype(np.int64) - tile_no[g] * tile + halo
        x = numbers(t.column(value))[bar]
        block = np.zeros((n, halo + tile))
        block[g, pos] = np.nan_to_num(x)
        days = tile_no[:, None] * tile + np.arange(tile)[None, :]
        live = framed[:, None] & (days >= np.nan_to_num(first)[:, None]) & (days <= np.nan_to_num(last)[:, None])
        gi, ti = np.nonzero(live)
        series = t.column("series").take(pa.array(start[gi]))
        there = np.zeros((n, tile), dtype=bool)
        mine = pos >= halo
        there[g[mine], pos[mine] - halo] = True
        out = {"series": series, "day": pa.array(days[gi, ti].astype(np.int32)), "is_bar": pa.array(there[gi, ti]), value: pa.array(block[:, halo:][gi, ti].astype(np.int64))}
        age = days[gi, ti] - first[gi] + 1
        for w in windows:
            total = (block @ bands[w])[gi, ti]
            out[f"total_{w}d"] = pa.array(np.rint(total).astype(np.int64))
            out[f"avg_{w}d"] = pa.array(total / np.minimum(age, w))
        for c, name in keep.items():
            dense = np.full((n, tile), np.nan)
            dense[g[mine], pos[mine] - halo] = numbers(t.column(c))[bar][mine]
            got = dense[gi, ti]
            out[name] = pa.array(got, mask=np.isnan(got))
        return pa.table(out)

    return map_tiles(frame_rows.unionByName(bar_rows), ["series", "tile"], ["series", "tile", "day"], kernel, schema, min_rows=65536)


def rolling_totals(bars: DataFrame, windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Per series and calendar day: feed, ticker, day, is_bar, volume, totals and averages of volume over the trailing
    ``windows``, and on days with a bar sma_20 and sma_50 of close (last 20 and 50 bars) and vol_avg_20 (the 20 bars before).
    """
    rows = bars.filter(F.col("date").isNotNull()).select(
        F.to_json(F.struct("feed", "ticker")).alias("series"), "date", "loaded_at", "bar_id", F.col("close").cast("double").alias("close"), F.col("volume").cast("double").alias("volume")
    )
    single = bar_index(rows, ["series"], F.year("date"), ["date", "loaded_at", "bar_id"], one_per="date")
    indexed = single.select("series", F.unix_date("date").alias("day"), "idx", "close", "volume")
    with_means = bar_averages(indexed, {"sma_20": ("close", 20, 0), "sma_50": ("close", 50, 0), "vol_avg_20": ("volume", 20, 1)})
    dense = trailing_days(with_means, "volume", windows, {c: c for c in ("sma_20", "sma_50", "vol_avg_20")})
    name = F.from_json("series", "feed string, ticker string")
    cols = [c for c in dense.columns if c not in ("series", "day")]
    return dense.withColumn("s", name).select("s.feed", "s.ticker", F.date_from_unix_date("day").alias("day"), *cols)
