"""Bounded tiles of long ordered series, and a streaming runner of numpy kernels over them.

A series is never collected as a whole.  ``bar_index`` numbers its rows without a window over the
whole series: rows are counted per (series, period), the counts are summed over the few periods of a
series, and row numbers are only taken inside one period.  ``with_halo`` then cuts the numbered series
into tiles of equal length and repeats the rows next to a border in the neighbouring tile, so that a
kernel with a bounded reach can work on each tile alone.  ``map_tiles`` streams sorted tiles through a
kernel with bounded memory, many tiles at once, so that one numpy call serves thousands of short series.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def bar_index(df: DataFrame, series: list[str], period: Column, order: list[str], out: str = "idx", one_per: str | None = None) -> DataFrame:
    """Adds ``out``: the 0-based position of each row in its series by (period, *order).

    With ``one_per`` (the first order column) only the last row of each of its values is kept.

    ``period`` must be a non-null bucket that does not decrease with the order columns (a year of a
    date); it bounds the rows that one window task sorts.  Series columns must not be null.  The counts
    and the row numbers share one exchange on (series, period).
    """
    keyed = df.withColumn("_period", period).repartition(*series, "_period")
    keys = [*series, "_period"]
    counts = keyed.groupBy(*keys).agg((F.count_distinct(one_per) if one_per else F.count(F.lit(1))).alias("_n"))
    before = W.partitionBy(*series).orderBy("_period").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = W.partitionBy(*keys).orderBy(*order)
    if one_per:
        last = keyed.withColumn("_next", F.lead(one_per).over(inside)).filter(~F.col("_next").eqNullSafe(F.col(one_per)))
        numbered = last.withColumn("_rn", F.row_number().over(inside) - 1).drop("_next")
    else:
        numbered = keyed.withColumn("_rn", F.row_number().over(inside) - 1)
    return numbered.join(offsets, keys).withColumn(out, F.col("_base") + F.col("_rn")).drop("_period", "_rn", "_base")


def with_halo(df: DataFrame, idx: str, length: int, before: int, after: int) -> DataFrame:
    """Repeats rows into every tile that needs them: adds ``tile`` and ``core`` (true in the row's own tile).

    A tile holds ``length`` positions; a row at distance ``before`` or less ahead of the next tile's first
    position is repeated there, and likewise ``after`` behind a tile's last position.
    """
    if max(before, after) > length:
        raise ValueError("a halo may not be longer than a tile")
    at = F.floor(F.col(idx) / length)
    off = F.col(idx) - at * length
    own = F.struct(at.alias("tile"), F.lit(True).alias("core"))
    up = F.when(off >= length - before, F.struct((at + 1).alias("tile"), F.lit(False).alias("core")))
    down = F.when((off < after) & (at > 0), F.struct((at - 1).alias("tile"), F.lit(False).alias("core")))
    copies = F.array_compact(F.array(own, up, down))
    return df.withColumn("_t", F.explode(copies)).withColumns({"tile": F.col("_t.tile"), "core": F.col("_t.core")}).drop("_t")


def map_tiles(df: DataFrame, keys: list[str], order: list[str], kernel: Callable[[pa.Table, np.ndarray], pa.Table], schema: str, min_rows: int = 131072) -> DataFrame:
    """Runs ``kernel(rows, group)`` over whole tiles, many at a time.

    Rows are hashed by ``keys`` and sorted by keys and order within each partition.  Batches are
    gathered until ``min_rows`` rows are there and cut at the last key border, so that memory is
    bounded by ``min_rows`` and the largest tile.  ``group`` numbers the tiles of a call from 0; it
    does not decrease.  The kernel must use every tile on its own.
    """
    hashed = df.withColumns({"_k1": F.xxhash64(*keys), "_k2": F.hash(*keys)})
    laid = hashed.repartition("_k1", "_k2").sortWithinPartitions("_k1", "_k2", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows
            whole = pa.Table.from_batches(held).combine_chunks()
            k1, k2 = (whole.column(c).to_numpy() for c in ("_k1", "_k2"))
            border = np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1
            end = whole.num_rows if last else (int(border[-1]) if len(border) else 0)
            held, rows = ([] if end == whole.num_rows else whole.slice(end).to_batches()), whole.num_rows - end
            if end:
                group = np.zeros(end, dtype=np.int64)
                group[border[border < end]] = 1
                yield from kernel(whole.slice(0, end).drop_columns(["_k1", "_k2"]), np.cumsum(group)).to_batches()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
                if rows >= min_rows:
                    yield from cut(False)
        if held:
            yield from cut(True)

    return laid.mapInArrow(run, schema)


def numbers(column: pa.ChunkedArray) -> np.ndarray:
    """A numeric column as float64 with NaN for nulls."""
    return column.cast(pa.float64()).combine_chunks().to_numpy(zero_copy_only=False)
