"""Exact quantiles of groups of any size.

``F.percentile`` keeps every distinct value of a group in one task.  Here a bounded, mergeable sketch
brackets each wanted rank first; a second pass counts what lies below the bracket and keeps only the
values inside it, from which the exact order statistics are read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def exact_quantiles(df: DataFrame, groups: list[str], value: str, probs: list[float], kind: str = "linear", accuracy: int = 2000) -> DataFrame:
    """groups..., prob, quantile, n for each group with a value; nulls and NaN are left out.

    kind: ``linear`` interpolates between the neighbours of rank (n - 1) * p, ``nearest`` takes the value at
    floor((n - 1) * p + 0.5).  Infinite values take part in the order.  Groups may be null.
    A task holds at most about 4 / accuracy of a group's distinct values.
    """
    if kind not in ("linear", "nearest"):
        raise ValueError(kind)
    if not groups:  # one group: its bounds are one row, which the driver turns into literals
        return _whole(df, value, probs, kind, accuracy)
    keys = [f"_g{i}" for i in range(len(groups))]
    base = df.select(*[F.struct(F.col(g)).alias(k) for g, k in zip(groups, keys)], F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    eps = 2.0 / accuracy
    wanted = sorted({min(1.0, max(0.0, q)) for p in probs for q in (p - eps, p + eps)} | {0.0, 1.0})
    sketch = base.groupBy(*keys).agg(F.count("v").alias("n"), F.percentile_approx("v", wanted, accuracy).alias("s"), F.min("v").alias("least"), F.max("v").alias("most"))
    brackets = []
    for p in probs:
        lo = F.col("least") if p - eps <= 0 else F.col("s")[wanted.index(p - eps)]
        hi = F.col("most") if p + eps >= 1 else F.col("s")[wanted.index(p + eps)]
        brackets += [lo, hi]
    bounds = sketch.select(*keys, *[b.alias(f"b{i}") for i, b in enumerate(brackets)])
    marks = []
    for i in range(len(probs)):
        lo, hi = F.col(f"b{2 * i}"), F.col(f"b{2 * i + 1}")
        side = F.when(F.col("v") < lo, 0).when(F.col("v") <= hi, 1).otherwise(2)
        marks.append(F.struct(F.lit(i).alias("i"), side.alias("side"), F.when(side == 1, F.col("v")).alias("x")))
    marked = base.join(bounds, keys).select(*keys, "v", F.explode(F.array(*marks)).alias("m"))
    kept = marked.groupBy(*keys, F.col("m.i").alias("i"), F.col("m.side").alias("side"), F.col("m.x").alias("x")).agg(F.count(F.lit(1)).alias("c"), F.max("v").alias("top"), F.min("v").alias("low"))
    # of the values below a bracket the largest may be wanted, of those above the smallest: ranks are rounded by the sketch
    kept = kept.withColumn("x", F.when(F.col("side") == 0, F.col("top")).otherwise(F.col("low")))
    upto = F.sum("c").over(W.partitionBy(*keys, "i").orderBy("side", "x"))
    rank = kept.withColumn("upto", upto)
    sizes = sketch.select(*keys, "n")
    rank = rank.join(sizes, keys)
    prob = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("i") + 1)
    rank = rank.withColumns({"prob": prob, "pos": (F.col("n") - 1) * prob})
    at = (lambda k: F.min(F.when(F.col("upto") > k, F.col("x"))))
    if kind == "nearest":
        out = rank.groupBy(*keys, "prob", "n").agg(at(F.floor(F.col("pos") + 0.5)).alias("quantile"))
    else:
        out = rank.groupBy(*keys, "prob", "n", "pos").agg(at(F.floor("pos")).alias("a"), at(F.least(F.floor("pos") + 1, F.col("n") - 1)).alias("b"))
        w = F.col("pos") - F.floor("pos")
        out = out.withColumn("quantile", F.when((w == 0) | (F.col("a") == F.col("b")), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * w))
    return out.select(*[F.col(k).getField(g).alias(g) for g, k in zip(groups, keys)], "prob", "quantile", "n")


def _whole(df: DataFrame, value: str, probs: list[float], kind: str, accuracy: int) -> DataFrame:
    """exact_quantiles of all rows: prob, quantile, n; runs one small job for the bounds."""
    base = df.select(F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    eps = 2.0 / accuracy
    wanted = sorted({min(1.0, max(0.0, q)) for p in probs for q in (p - eps, p + eps)} | {0.0, 1.0})
    row = base.agg(F.count("v").alias("n"), F.percentile_approx("v", wanted, accuracy).alias("s"), F.min("v").alias("least"), F.max("v").alias("most")).first()
    n, out = row["n"], []
    if not n:
        return df.sparkSession.createDataFrame([], "prob double, quantile double, n bigint")
    marks = []
    for i, p in enumerate(probs):
        lo = row["least"] if p - eps <= 0 else row["s"][wanted.index(p - eps)]
        hi = row["most"] if p + eps >= 1 else row["s"][wanted.index(p + eps)]
        side = F.when(F.col("v") < lo, 0).when(F.col("v") <= hi, 1).otherwise(2)
        marks.append(F.struct(F.lit(i).alias("i"), side.alias("side"), F.when(side == 1, F.col("v")).alias("x")))
    kept = base.select("v", F.explode(F.array(*marks)).alias("m")).groupBy("m.i", "m.side", "m.x").agg(F.count(F.lit(1)).alias("c"), F.max("v").alias("top"), F.min("v").alias("low"))
    kept = kept.withColumn("x", F.when(F.col("side") == 0, F.col("top")).otherwise(F.col("low")))
    rank = kept.withColumn("upto", F.sum("c").over(W.partitionBy("i").orderBy("side", "x")))
    for i, p in enumerate(probs):
        pos = (n - 1) * float(p)
        low = math.floor(pos + 0.5) if kind == "nearest" else math.floor(pos)
        out.append((i, float(p), low, low if kind == "nearest" else min(low + 1, n - 1), 0.0 if kind == "nearest" else pos - math.floor(pos)))
    at = lambda j: F.element_at(F.array(*[F.lit(o[j]) for o in out]), F.col("i") + 1)
    first = lambda j: F.min(F.when(F.col("upto") > at(j), F.col("x")))
    got = rank.groupBy("i").agg(first(2).alias("a"), first(3).alias("b"))
    a, b, w = F.col("a"), F.col("b"), at(4)
    return got.select(at(1).alias("prob"), F.when((w == 0) | (a == b), a).otherwise(a + (b - a) * w).alias("quantile"), F.lit(n).cast("bigint").alias("n"))
