"""Percentiles of very large numeric columns by merging centroid digests, with certified rank errors.

Method: values of a partition are sorted and clustered so that a cluster spans at most one unit of the size function
k(q) = delta / (2 pi) * asin(2 q - 1), which keeps clusters small at both ends; digests merge by clustering their centroids again.
A second pass counts the rows below and up to each estimate, which gives its exact rank error.

A digest holds at most about delta / 2 + 3 centroids, whatever it stands for, so that summaries of partitions, days or loads
can be kept and combined in any order.

Defined results
* Null, NaN and infinite values are left out; a group without finite values gives no row.
* Groups may be null.  Repeated rows count each.  Equal values are one tie: an estimate inside a tie has no rank error if the wanted rank is in it.
* An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators.settle import settle

DELTA = 400  #: centroids grow with it; rank errors fall with it
RANK_BOUND = 0.005  #: largest certified rank error, as a share of the rows
FAN = 256  #: shares of a group's digests that are merged before the last step


def cluster(means: np.ndarray, weights: np.ndarray, delta: int = DELTA) -> tuple[np.ndarray, np.ndarray]:
    """Centroids (means, weights) of weighted values, in ascending order."""
    order = np.argsort(means, kind="stable")
    m, w = means[order], weights[order]
    upto = np.cumsum(w)
    q = np.clip((upto - w / 2) / upto[-1], 0, 1)
    k = np.floor(delta / (2 * np.pi) * np.arcsin(2 * q - 1)).astype(np.int64)
    start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    total = np.add.reduceat(w, start)
    # means are taken about the first value of a cluster, so that equal values keep their exact value
    base = m[start]
    shift = np.add.reduceat(w * (m - np.repeat(base, np.diff(np.r_[start, len(m)]))), start)
    return base + shift / total, total


def quantile(means: np.ndarray, weights: np.ndarray, least: float, most: float, q: float) -> float:
    """The value at rank q * n, linear between the middles of neighbouring centroids and the extremes."""
    upto = np.cumsum(weights)
    n = upto[-1]
    at = q * n
    middle = np.r_[0.0, upto - weights / 2, n]
    value = np.r_[least, means, most]
    return float(np.interp(at, middle, value))


SCHEMA = "{groups}, n bigint, least double, most double, means array<double>, weights array<double>"


def digests(df: DataFrame, groups: list[str], value: str, delta: int = DELTA) -> DataFrame:
    """One digest per group: groups..., n, least, most, means, weights.

    Partial digests are made where the rows are, without a shuffle; only they are sent.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    names = ", ".join(f"`{g}` {kinds[g]}" for g in groups)
    schema = SCHEMA.format(groups=names)
    rows = df.select(*groups, F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}  # key -> [raw arrays, raw count, means, weights, n, least, most]
        types = None

        def settle(x: list) -> None:
            raw = np.concatenate(x[0]) if x[0] else np.zeros(0)
            x[2], x[3] = cluster(np.r_[x[2], raw], np.r_[x[3], np.ones(len(raw))], delta)
            x[0], x[1] = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            for x in held.values():
                if x[1]:
                    settle(x)
            keys = list(held)
            cols = {g: pa.array([k[i] for k in keys], types[i]) for i, g in enumerate(groups)}
            cols |= {"n": pa.array([held[k][4] for k in keys], pa.int64()), "least": pa.array([held[k][5] for k in keys], pa.float64()), "most": pa.array([held[k][6] for k in keys], pa.float64())}
            cols |= {"means": pa.array([held[k][2] for k in keys], pa.list_(pa.float64())), "weights": pa.array([held[k][3] for k in keys], pa.list_(pa.float64()))}
            yield pa.RecordBatch.from_pydict(cols)

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            types = [t.schema.field(g).type for g in groups]
            # number the groups of the batch
            code = np.zeros(t.num_rows, dtype=np.int64)
            dicts = []
            for g in groups:
                d = t.column(g).combine_chunks().dictionary_encode(null_encoding="encode")
                dicts.append(d.dictionary.to_pylist())
                code = code * len(dicts[-1]) + d.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            code, v = code[order], t.column("v").to_numpy()[order]
            start = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            for a, b in zip(start, np.r_[start[1:], len(code)]):
                c, key = int(code[a]), []
                for d in reversed(dicts):
                    c, i = divmod(c, len(d))
                    key.append(d[i])
                x = held.setdefault(tuple(reversed(key)), [[], 0, np.zeros(0), np.zeros(0), 0, np.inf, -np.inf])
                part = v[a:b]
                x[0].append(part)
                x[1] += len(part)
                x[4] += len(part)
                x[5], x[6] = min(x[5], float(part.min())), max(x[6], float(part.max()))
                if x[1] > 20 * delta:
                    settle(x)
            if len(held) > 20_000:  # many groups: hand over what there is
                yield from out()
                held.clear()
        if held:
            yield from out()

    return merge(rows.mapInArrow(partial, schema), groups, delta)


def merge(parts: DataFrame, groups: list[str], delta: int = DELTA) -> DataFrame:
    """Digests with equal groups combined; columns as of :func:`digests`.

    In two steps, so that no task meets all digests of a hot group: first those of a share of 1 / FAN, by a hash of the digest itself.
    """
    kinds = {f.name: f.dataType.simpleString() for f in parts.schema.fields}
    schema = SCHEMA.format(groups=", ".join(f"`{g}` {kinds[g]}" for g in groups))

    def run(t: pa.Table) -> pa.Table:
        means, weights = (t.column(c).combine_chunks().flatten().to_numpy() for c in ("means", "weights"))
        m, w = cluster(means, weights, delta)
        out = {g: t.column(g).slice(0, 1).combine_chunks() for g in groups}
        out |= {"n": pa.array([int(np.sum(t.column("n").to_numpy()))], pa.int64()), "least": pa.array([float(np.min(t.column("least").to_numpy()))]), "most": pa.array([float(np.max(t.column("most").to_numpy()))])}
        out |= {"means": pa.array([m], pa.list_(pa.float64())), "weights": pa.array([w], pa.list_(pa.float64()))}
        return pa.table(out)

    own = [*groups, "n", "least", "most", "means", "weights"]
    shares = parts.select(*own, F.pmod(F.xxhash64("n", "least", "most", F.hash("means")), F.lit(FAN)).alias("_share"))
    return shares.groupBy(*groups, "_share").applyInArrow(run, schema).groupBy(*groups).applyInArrow(run, schema)


def percentiles(summaries: DataFrame, groups: list[str], probs: list[float]) -> DataFrame:
    """groups..., n, estimates (array in the order of ``probs``) from digests."""
    kinds = {f.name: f.dataType.simpleString() for f in summaries.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(b.column("means").to_pylist(), b.column("weights").to_pylist(), b.column("least").to_pylist(), b.column("most").to_pylist())
            got = [[quantile(np.array(m), np.array(w), lo, hi, p) for p in probs] for m, w, lo, hi in rows]
            yield pa.RecordBatch.from_pydict({g: b.column(g) for g in groups} | {"n": b.column("n"), "estimates": pa.array(got, pa.list_(pa.float64()))})

    return summaries.select(*groups, "n", "least", "most", "means", "weights").mapInArrow(run, ", ".join(f"`{g}` {kinds[g]}" for g in groups) + ", n bigint, estimates array<double>")


def certify(df: DataFrame, groups: list[str], value: str, estimates: DataFrame, probs: list[float]) -> DataFrame:
    """groups..., p, n, estimate, below, upto, rank_error: the second pass, which counts the rows below and up to each estimate.

    The wanted rank is p * n; rank_error is its distance from the interval below..upto (a tie counts whole), as a share of n.
    Counts are taken by map-side aggregation; the estimates are one row per group.
    """
    key = F.struct(*groups)
    rows = df.select(key.alias("k"), F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))
    est = estimates.select(key.alias("k"), "n", "estimates")
    counts = [F.struct(F.count_if(F.col("v") < F.col("estimates")[i]).alias("below"), F.count_if(F.col("v") <= F.col("estimates")[i]).alias("upto")) for i in range(len(probs))]
    got = rows.join(est, "k").groupBy("k", "n", "estimates").agg(F.array(*counts).alias("c"))
    one = got.select("k", "n", F.posexplode("c").alias("i", "c"), "estimates")
    p = F.element_at(F.array(*[F.lit(float(x)) for x in probs]), F.col("i") + 1)
    out = one.select(*[F.col("k")[g].alias(g) for g in groups], p.alias("p"), "n", F.col("estimates")[F.col("i")].alias("estimate"), "c.below", "c.upto")
    want = F.col("p") * F.col("n")
    off = F.greatest(F.col("below") - want, want - F.col("upto"), F.lit(0.0))
    return out.withColumn("rank_error", off / F.col("n"))


def certified(df: DataFrame, groups: list[str], value: str, summaries: DataFrame, probs: list[float], bound: float = RANK_BOUND, tries: int = 3) -> DataFrame:
    """As :func:`certify` of the percentiles of ``summaries`` (digests per group).  Groups with an error over ``bound`` (and over one row) are summarised
    again from their values with four times as many centroids, up to ``tries`` times.  Runs a job for each try."""
    over = F.col("rank_error") * F.col("n") > F.greatest(bound * F.col("n"), F.lit(1.0))
    key = F.struct(*groups)
    values, delta, parts = df, DELTA, []
    for left in range(tries, -1, -1):
        got = settle(certify(values, groups, value, percentiles(summaries, groups, probs), probs), "percentiles")
        bad = got.filter(over).select(key.alias("_k")).distinct()
        if not left or bad.isEmpty():
            parts.append(got)
            break
        parts.append(got.withColumn("_k", key).join(bad, "_k", "left_anti").drop("_k"))
        delta *= 4
        values = values.withColumn("_k", key).join(bad, "_k", "left_semi").drop("_k")
        summaries = digests(values, groups, value, delta)
    return reduce(DataFrame.unionByName, parts)
