"""Column-level data quality profiles per load, and loads that went wrong.

Numbers are described by power sums in centred form (n, mean, m2: the sum of squared differences from the mean), which merge across
partitions and loads without cancellation (``merged_moments``); shifts between loads by standardised differences of means and by quartiles; all
columns by shares of missing and invalid values, grouped distinct counts, ranges and pattern violations.

Defined results
* Missing: null, NaN, blank text, or a column's own missing word.  Invalid: not missing and against the rule.
* A load without valid values has null statistics, and no ``shifted`` finding.
* Shares are of all delivered rows of a load, repeated rows included.  A null load is a load.
* An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from pyspark.sql.window import WindowSpec

from tidewright.operators.quantiles import exact_quantiles


@dataclass(frozen=True)
class Rule:
    """How one column is judged: ``valid`` holds for good values (null counts as bad); numeric columns get quartiles."""

    column: str
    valid: Column
    numeric: bool
    missing_word: str | None = None

    def missing(self) -> Column:
        c = F.col(self.column)
        if self.numeric:
            return c.isNull() | F.isnan(c.cast("double"))
        out = c.isNull() | ~c.rlike(r"[^\p{IsWhite_Space}]")
        return out | (c == self.missing_word) if self.missing_word is not None else out


@dataclass(frozen=True)
class Limits:
    """Departures that make a finding."""

    share: float = 0.2  #: of a missing or invalid share from its median over the loads
    quartile: float = 1.2  #: of a quartile from its median, in medians of the quartile distance
    category: float = 0.25  #: of a category's share of the valid values from its median


def classify(df: DataFrame, load: str, rules: list[Rule]) -> DataFrame:
    """Long form, one row per row and rule: load (a struct, so that a null load joins), column_name, is_missing, is_invalid, number, word (valid values only)."""
    parts = []
    for r in rules:
        gone = F.coalesce(r.missing(), F.lit(True))
        bad = ~gone & ~F.coalesce(r.valid, F.lit(False))
        c, ok = F.col(r.column), ~gone & ~bad
        number = F.when(ok, c.cast("double")) if r.numeric else F.lit(None).cast("double")
        word = F.lit(None).cast("string") if r.numeric else F.when(ok, c.cast("string"))
        parts.append(F.struct(F.lit(r.column).alias("column_name"), gone.alias("is_missing"), bad.alias("is_invalid"), number.alias("number"), word.alias("word")))
    return df.select(F.struct(F.col(load).alias("id")).alias("load"), F.explode(F.array(*parts)).alias("r")).select("load", "r.*")


def _median_over(groups: list[str], value: str) -> Column:
    """Median of one value per load over the loads; loads are few beside rows."""
    return F.median(value).over(W.partitionBy(*groups))


def power_sums(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys..., n_finite, mean, m2, least_number, most_number of the finite values; merged map-side, one row per group."""
    x = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), F.col(value))
    out = df.groupBy(*keys).agg(F.count(x).alias("n_finite"), F.avg(x).alias("mean"), F.var_pop(x).alias("_v"), F.min(x).alias("least_number"), F.max(x).alias("most_number"))
    return out.withColumn("m2", F.col("_v") * F.col("n_finite")).drop("_v")


def merged_moments(n: Column, mean: Column, m2: Column, over: WindowSpec) -> tuple[Column, Column, Column]:
    """n, mean and m2 of all *other* rows of a window of power sums: the sums are moved to the window's mean first, so that nothing cancels."""
    total = F.sum(n).over(over)
    centre = F.try_divide(F.sum(F.coalesce(n * mean, F.lit(0.0))).over(over), total)
    s1 = F.coalesce(n * (mean - centre), F.lit(0.0))
    s2 = F.coalesce(m2 + n * (mean - centre) * (mean - centre), F.lit(0.0))
    rest_n, rest_1, rest_2 = total - n, F.sum(s1).over(over) - s1, F.sum(s2).over(over) - s2
    return rest_n, centre + F.try_divide(rest_1, rest_n), F.greatest(rest_2 - rest_1 * F.try_divide(rest_1, rest_n), F.lit(0.0))


def standardised_difference(of: list[str]) -> Column:
    """The mean's difference from that of the other rows of ``of``, in pooled standard deviations; columns n_finite, mean, m2."""
    n, mean, m2 = F.col("n_finite"), F.col("mean"), F.col("m2")
    rest_n, rest_mean, rest_m2 = merged_moments(n, mean, m2, W.partitionBy(*of))
    var = lambda k, m: F.when(k > 1, m / (k - 1))
    return F.try_divide(mean - rest_mean, F.sqrt((var(n, m2) + var(rest_n, rest_m2)) / 2))


def load_findings(df: DataFrame, load: str, rules: list[Rule], limits: Limits = Limits()) -> DataFrame:
    """Loads that differ from the others: load, column_name, finding (``missing``, ``invalid`` or ``shifted``), d_mean.

    d_mean: the standardised difference of the valid numbers of the load from those of all others.
    """
    long = classify(df, load, rules)
    shares = long.groupBy("load", "column_name").agg(F.avg(F.col("is_missing").cast("double")).alias("missing"), F.avg(F.col("is_invalid").cast("double")).alias("invalid"))
    by_share = shares.select("load", "column_name", F.explode(F.array(*[F.struct(F.lit(k).alias("finding"), F.col(k).alias("share")) for k in ("missing", "invalid")])).alias("s")).select("load", "column_name", "s.*")
    odd_share = by_share.withColumn("m", _median_over(["column_name", "finding"], "share")).filter(F.abs(F.col("share") - F.col("m")) > limits.share).select("load", "column_name", "finding")

    quartiles = exact_quantiles(long.filter(F.col("number").isNotNull()), ["load", "column_name"], "number", [0.25, 0.75])
    q = quartiles.groupBy("load", "column_name").agg(F.max(F.when(F.col("prob") == 0.25, F.col("quantile"))).alias("lo"), F.max(F.when(F.col("prob") == 0.75, F.col("quantile"))).alias("hi"))
    q = q.withColumn("width", F.col("hi") - F.col("lo"))
    q = q.withColumns({f"m_{c}": _median_over(["column_name"], c) for c in ("lo", "hi", "width")})
    moved = F.greatest(F.abs(F.col("lo") - F.col("m_lo")), F.abs(F.col("hi") - F.col("m_hi"))) > limits.quartile * F.col("m_width")
    odd_number = q.filter(moved).select("load", "column_name", F.lit("shifted").alias("finding"))

    counts = long.filter(F.col("word").isNotNull()).groupBy("load", "column_name", "word").agg(F.count(F.lit(1)).alias("c"))
    totals = counts.groupBy("load", "column_name").agg(F.sum("c").alias("n"))
    # every word of a column against every load that has valid values, a missing pair being a share of 0
    words = counts.select("column_name", "word").distinct()
    grid = totals.join(words, "column_name")
    filled = grid.join(counts, ["load", "column_name", "word"], "left").withColumn("share", F.coalesce(F.col("c"), F.lit(0)) / F.col("n"))
    odd_word = filled.withColumn("m", _median_over(["column_name", "word"], "share")).filter(F.abs(F.col("share") - F.col("m")) > limits.category).select("load", "column_name", F.lit("shifted").alias("finding")).distinct()
    every = odd_share.unionByName(odd_number).unionByName(odd_word)
    sums = power_sums(long.filter(F.col("number").isNotNull()), ["load", "column_name"], "number").select("load", "column_name", standardised_difference(["column_name"]).alias("d_mean"))
    return every.join(sums, ["load", "column_name"], "left").select(F.col("load.id").alias(load), "column_name", "finding", "d_mean")


def profile(df: DataFrame, load: str, patterns: dict[str, str] | None = None, skip: tuple[str, ...] = (), rules: list[Rule] | None = None) -> DataFrame:
    """One row per load and column, for every column but ``load`` and ``skip``.

    n, n_missing, n_distinct, least and most as text (numeric order for finite numbers, which are least_number and most_number too), n_finite, mean, m2,
    stddev, n_violations (text against a pattern that must match somewhere), quartiles q25, q50, q75 of finite numbers, and d_mean: the difference of the
    mean from that of all other loads together in pooled standard deviations.  Dates, times and booleans count as text.
    share_missing and share_invalid are shares of the load's rows.  A column with a rule is missing and invalid by it (n_violations),
    not by a pattern.  d_share, of text: half the sum of the absolute differences between the shares of the values in the load and in all
    other loads together (0: the same shares, 1: no value in common), null where either side has no value.

    Counts, ranges and power sums are one aggregate that leaves a task as one row per load and column.  Only distinct counts send values: numbers as
    eight bytes, texts as they are, equal ones of a task once.
    """
    patterns, by_rule = patterns or {}, {r.column: r for r in rules or []}
    numeric = ("bigint", "int", "smallint", "tinyint", "double", "float")
    parts, names = [], []
    for c, kind in df.dtypes:
        if c == load or c in skip:
            continue
        text, is_number = F.col(c).cast("string"), kind in numeric or kind.startswith("decimal")
        if is_number:
            x = F.col(c).cast("double")
            gone = x.isNull() | F.isnan(x)
        else:
            x, gone = F.lit(None).cast("double"), text.isNull() | ~text.rlike(r"[^\p{IsWhite_Space}]")
        bad = F.coalesce(~text.rlike(patterns[c]) & ~gone, F.lit(False)) if c in patterns else F.lit(False)
        if r := by_rule.get(c):
            gone = F.coalesce(r.missing(), F.lit(True))
            bad = ~gone & ~F.coalesce(r.valid, F.lit(False))
        # 0.0 is added so that -0.0 and 0.0 are one value
        parts.append(F.struct(F.lit(len(names)).alias("i"), gone.alias("gone"), bad.alias("bad"), F.when(~F.isnan(x), x + 0.0).alias("x"), F.when(~gone, text).alias("text") if not is_number else F.lit(None).cast("string").alias("text")))
        names.append(c)
    long = df.select(F.struct(F.col(load).alias("id")).alias("k"), F.explode(F.array(*parts)).alias("r")).select("k", "r.*")
    x = F.when(F.abs("x") < float("inf"), F.col("x"))
    stats = long.groupBy("k", "i").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("gone").alias("n_missing"), F.count_if("bad").alias("n_violations"),
        F.count(x).alias("n_finite"), F.avg(x).alias("mean"), F.var_pop(x).alias("_v"), F.min(x).alias("least_number"), F.max(x).alias("most_number"),
    )
    stats = stats.withColumn("m2", F.col("_v") * F.col("n_finite")).withColumn("d_mean", standardised_difference(["i"]))
    values = long.filter(~F.col("gone")).groupBy("k", "i", "x", "text").agg(F.count(F.lit(1)).alias("c"))
    distinct = values.groupBy("k", "i").agg(F.count(F.lit(1)).alias("n_distinct"), F.min("text").alias("least_text"), F.max("text").alias("most_text"))
    # shares of words: 1 - the sum of the smaller share of each word, so that words of one side only need no row of the other
    words = values.filter(F.col("text").isNotNull()).withColumn("all_c", F.sum("c").over(W.partitionBy("i", "text")))
    totals = words.groupBy("k", "i").agg(F.sum("c").alias("w_n")).withColumn("w_all", F.sum("w_n").over(W.partitionBy("i")))
    common = F.sum(F.least(F.col("c") / F.col("w_n"), F.try_divide(F.col("all_c") - F.col("c"), F.col("w_all") - F.col("w_n"))))
    moved = words.join(totals, ["k", "i"]).groupBy("k", "i").agg(F.when(F.max(F.col("w_all") - F.col("w_n")) > 0, 1 - common).alias("d_share"))
    q = exact_quantiles(long.withColumn("x", x).filter(F.col("x").isNotNull()), ["k", "i"], "x", [0.25, 0.5, 0.75])
    q = q.groupBy("k", "i").agg(*[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(a) for p, a in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))])
    out = stats.join(distinct, ["k", "i"], "left").join(moved, ["k", "i"], "left").join(q, ["k", "i"], "left")
    return out.select(
        F.col("k.id").alias(load), F.element_at(F.array(*[F.lit(c) for c in names]), F.col("i") + 1).alias("column_name"), "n", "n_missing", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"), "n_finite", "n_violations",
        (F.col("n_missing") / F.col("n")).alias("share_missing"), (F.col("n_violations") / F.col("n")).alias("share_invalid"),
        F.coalesce(F.col("least_number").cast("string"), "least_text").alias("least"), F.coalesce(F.col("most_number").cast("string"), "most_text").alias("most"), "least_number", "most_number", "least_text", "most_text",
        "mean", "m2", F.when(F.col("n_finite") > 1, F.sqrt(F.col("m2") / (F.col("n_finite") - 1))).alias("stddev"), "q25", "q50", "q75", "d_mean", "d_share",
    )
