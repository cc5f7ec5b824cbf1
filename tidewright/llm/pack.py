"""Filling fixed-capacity containers with documents of varying length.

Method: Karmarkar-Karp multiway differencing.  Every item starts as a partial partition of its own; the two partial
partitions with the largest imbalance are merged so that the fullest windows of one meet the emptiest of the other,
until one partition into k near-equal windows is left.  k starts at the least number of windows that could hold the items.
Windows that end within the tolerance below the capacity are final; the items of the others, over the capacity or
too empty, are differenced again among themselves, and the tolerance rises as rounds go by.  What a round leaves is placed by best fit, which opens
windows where the capacity would be exceeded.  Of all rounds, and of best fit without any, the one with the fewest windows wins, of equals the
latest, so that differencing never costs a window.  ``raised`` is differencing alone: k rises until no window is over the capacity (see the README
for what it costs).

Documents are packed in buckets of about ``bucket_docs`` by hash, so that no task sees the whole corpus; a bucket ends with
at most one poorly filled window per capacity.  Equal rows are counted first and go in chunks of ``copies``, which are hashed each.

Defined results
* Size 0 or null is left out.  A document larger than the capacity is cut at multiples of the capacity; its full pieces have a
  container each and its rest is packed like an item.  No other document is cut.
* Within a container pieces are in order of doc_id and position.  Repeated rows are items each.
* Ties are broken by position in (doc_id, size) order, so the result depends on the rows alone.
* An empty table or no specs gives no rows.
"""

from __future__ import annotations

import bisect
import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_SPECS = 1000
MOST_TASKS = 50_000


@dataclass(frozen=True)
class PackParams:
    bucket_docs: int = 1024  #: documents packed together
    tolerance: float = 0.02  #: share of the capacity that a final window may lack
    widen: float = 1.2  #: growth of the tolerance after a round that settles under a tenth of the windows
    rounds: int = 6  #: of differencing
    copies: int = 256  #: equal rows that stay together


def difference(sizes: np.ndarray, k: int) -> tuple[np.ndarray, list[list[int]]]:
    """k-way differencing: window totals (descending) and the positions of their items; empty windows are left out."""
    heap: list = [(-int(sizes[i]), n, np.array([sizes[i]]), [(int(i),)]) for n, i in enumerate(np.argsort(-sizes, kind="stable"))]
    heapq.heapify(heap)
    serial = len(heap)
    while len(heap) > 1:
        _, _, a, in_a = heapq.heappop(heap)
        _, _, b, in_b = heapq.heappop(heap)
        if len(a) < len(b):
            a, b, in_a, in_b = b, a, in_b, in_a
        both = max(0, len(a) + len(b) - k)  # so many windows get something from either side, largest to smallest
        ka, kb = len(a) - both, len(b) - both
        met = a[ka:] + b[kb:][::-1]
        total = np.concatenate([a[:ka], b[:kb], met])
        members = in_a[:ka] + in_b[:kb] + [(x, y) for x, y in zip(in_a[ka:], in_b[kb:][::-1])]
        order = np.argsort(-total, kind="stable")
        total, members = total[order], [members[j] for j in order]
        spread = int(total[0]) - (int(total[-1]) if len(total) == k else 0)
        heapq.heappush(heap, (-spread, serial, total, members))
        serial += 1
    _, _, total, members = heap[0]

    def leaves(node: tuple) -> list[int]:
        out, stack = [], [node]
        while stack:
            for x in stack.pop():
                stack.append(x) if isinstance(x, tuple) else out.append(x)
        return out

    return total, [leaves(m) for m in members]


def _best_fit(windows: list[list[int]], free: list[int], items: list[int], sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Items, largest first, each into the window with the least sufficient room, else into a new one."""
    order = sorted(range(len(windows)), key=lambda j: free[j])
    room, slots = [free[j] for j in order], [list(windows[j]) for j in order]
    for i in sorted(items, key=lambda i: (-sizes[i], i)):
        need = int(sizes[i])
        j = bisect.bisect_left(room, need)
        left, window = (room.pop(j) - need, slots.pop(j)) if j < len(room) else (capacity - need, [])
        window.append(i)
        j = bisect.bisect_left(room, left)
        room.insert(j, left)
        slots.insert(j, window)
    return slots


def fill(sizes: np.ndarray, capacity: int, params: PackParams = PackParams()) -> list[list[int]]:
    """Windows as lists of item positions; every size must be between 1 and the capacity."""
    rest = list(range(len(sizes)))
    done: list[list[int]] = []
    best = _best_fit([], [], rest, sizes, capacity)
    tolerance = params.tolerance
    for _ in range(params.rounds):
        if not rest:
            break
        part = sizes[rest]
        total, windows = difference(part, max(1, -(-int(part.sum()) // capacity)))
        good = np.flatnonzero((total <= capacity) & (total >= capacity * (1 - tolerance)))
        if len(good) < 0.1 * len(total):
            tolerance *= params.widen
        done += [[rest[q] for q in windows[j]] for j in good]
        settled = {q for j in good for q in windows[j]}
        rest = [x for q, x in enumerate(rest) if q not in settled]
        now = _best_fit(done, [capacity - int(sizes[w].sum()) for w in done], rest, sizes, capacity)
        if len(now) <= len(best):
            best = now
    return best


def raised(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Windows by differencing alone: the number of windows rises until none is over the capacity."""
    if not len(sizes):
        return []
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        total, windows = difference(sizes, k)
        if total[0] <= capacity:
            return windows
        k += 1


def pack(items: DataFrame, specs: DataFrame, n_items: int, params: PackParams = PackParams()) -> DataFrame:
    """One row per container: spec_name, capacity_tokens, container_id, docs, n_docs, used_tokens, fill.

    items: doc_id, size; specs: spec_name, capacity_tokens (a small table, at most MOST_SPECS rows, those without a positive
    capacity are left out); n_items: about how many items there are, which sets the number of buckets.
    docs: array of (doc_id, from_token, n_tokens) in order.
    """
    rows = specs.select("spec_name", "capacity_tokens").limit(MOST_SPECS + 1).collect()
    if len(rows) > MOST_SPECS:
        raise ValueError(f"more than {MOST_SPECS} container specs")
    wanted = [(r[0], int(r[1])) for r in rows if r[1] and r[1] > 0]
    buckets = max(1, -(-n_items // params.bucket_docs))
    part = pa.struct([("doc_id", pa.int64()), ("from_token", pa.int64()), ("n_tokens", pa.int64())])

    def run(t: pa.Table) -> pa.Table:
        bucket = t.column("bucket")[0].as_py() if t.num_rows else 0
        t = t.sort_by([("doc_id", "ascending"), ("size", "ascending")])
        t = t.take(pa.array(np.repeat(np.arange(t.num_rows), t.column("n").to_numpy())))
        doc, size = t.column("doc_id").combine_chunks(), t.column("size").to_numpy()
        out = []
        for name, cap in wanted:
            over = np.where(size > cap, size // cap, 0)
            left = np.where(size > cap, size % cap, size)
            item = np.flatnonzero(left > 0)
            windows = [sorted(w) for w in fill(left[item], cap, params)]
            # full pieces of cut documents come first, then the windows
            whole = np.repeat(np.arange(len(size)), over)
            turn = np.arange(len(whole)) - np.repeat(np.cumsum(over) - over, over)
            flat = item[np.array([i for w in windows for i in w], dtype=np.int64)] if windows else np.zeros(0, np.int64)
            row = np.concatenate([whole, flat])
            start = np.concatenate([turn * cap, over[flat] * cap])
            n = np.concatenate([np.full(len(whole), cap), left[flat]]).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(np.concatenate([np.ones(len(whole), np.int64), np.array([len(w) for w in windows], np.int64)]))])
            if len(ends) == 1:
                continue
            total = np.concatenate([[0], np.cumsum(n)])
            used = total[ends[1:]] - total[ends[:-1]]
            docs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([doc.take(pa.array(row)), pa.array(start), pa.array(n)], fields=list(part)))
            many = len(ends) - 1
            out.append(pa.table({
                "spec_name": pa.array([name] * many, pa.string()), "capacity_tokens": pa.array(np.full(many, cap, np.int32)),
                "container_id": pa.array(np.int64(bucket) * (1 << 32) + np.arange(many)), "docs": docs, "n_docs": pa.array(np.diff(ends).astype(np.int32)),
                "used_tokens": pa.array(used), "fill": pa.array(used / cap),
            }))
        return pa.concat_tables(out) if out else empty

    schema = "spec_name string, capacity_tokens int, container_id bigint, docs array<struct<doc_id:bigint,from_token:bigint,n_tokens:bigint>>, n_docs int, used_tokens bigint, fill double"
    empty = pa.table({
        "spec_name": pa.array([], pa.string()), "capacity_tokens": pa.array([], pa.int32()), "container_id": pa.array([], pa.int64()), "docs": pa.array([], pa.list_(part)),
        "n_docs": pa.array([], pa.int32()), "used_tokens": pa.array([], pa.int64()), "fill": pa.array([], pa.float64()),
    })
    sized = items.filter(F.col("size") > 0).select("doc_id", F.col("size").cast("bigint").alias("size"))
    counted = sized.groupBy("doc_id", "size").agg(F.count(F.lit(1)).alias("c"))
    chunks = counted.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("c") - 1) / params.copies).cast("int"))))
    n = F.least(F.col("c") - F.col("chunk") * params.copies, F.lit(params.copies)).cast("int")
    bucket = F.pmod(F.xxhash64("doc_id", "size", "chunk"), F.lit(buckets))
    # rows are small and work per row is large: the number of tasks follows the buckets, and adaptive execution doesn't join them
    tasks = min(buckets, max(4 * int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(buckets // 16, MOST_TASKS)))
    return chunks.select("doc_id", "size", n.alias("n"), bucket.alias("bucket")).repartition(tasks, "bucket").groupBy("bucket").applyInArrow(run, schema)
