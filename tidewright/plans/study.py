"""Queries on setups: joins, aggregates, event features, returns and estimation."""

from __future__ import annotations

import datetime
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewright.functions.text import canonical_ticker
from tidewright.functions.windows import finite, missing, text_or
from tidewright.operators import quantreg, stats
from tidewright.operators.detect import quality_score, space_out
from tidewright.operators.events import factor_windows, forward_returns, window_features
from tidewright.operators.quantiles import exact_quantiles
from tidewright.operators.upsert import missing_keys, needs_refresh, upsert
from tidewright.plans.common import BARS_SQL, FACTOR_NAMES, FACTORS_SQL, SETUPS_SQL, bars, by_series, factors, setups, setups_by_feed
from tidewright.sources.bars import data_block, factor_panel, parse_factors
from tidewright.sources.tables import table

FEATURES = ["vol_contraction_ratio", "adr_pct", "base_duration_days", "rs_slope_vs_spy"]
TRAIN = ("2014-01-01", "2018-12-31")
WINDOWS = [f"{n}_window" for n in FACTOR_NAMES]


# ---- aggregates and tables on the setups


def counts_a5(spark: SparkSession, d: str) -> DataFrame:
    return setups(spark, d).groupBy("universe_variant", text_or("sector", "Unknown").alias("sector")).agg(F.count(F.lit(1)).alias("n"))


def pivot_a6_o6(spark: SparkSession, d: str) -> DataFrame:
    """Counts by sector and variant, absent ones 0, with a row total."""
    s = setups(spark, d).withColumn("sector", text_or("sector", "Unknown"))
    return s.groupBy("sector").pivot("universe_variant", ["loose", "strict"]).agg(F.count(F.lit(1))).na.fill(0).withColumn("total", F.col("loose") + F.col("strict"))


NEAREST = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


def _long(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    each = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*keys, F.explode(each).alias("c")).select(*keys, "c.*").filter(finite("value"))


def quantiles_nearest_a9(spark: SparkSession, d: str) -> DataFrame:
    """Seven nearest-rank quantiles of each feature and variant."""
    q = exact_quantiles(_long(setups(spark, d), FEATURES, ["universe_variant"]), ["universe_variant", "column_name"], "value", NEAREST, "nearest")
    return q.withColumnRenamed("prob", "p")


def quantiles_linear_a10(spark: SparkSession, d: str) -> DataFrame:
    q = exact_quantiles(_long(setups(spark, d), FEATURES, ["universe_variant"]), ["universe_variant", "column_name"], "value", [0.025, 0.1, 0.5, 0.9, 0.975])
    return q.withColumnRenamed("prob", "p").withColumn("quantile", F.round("quantile", 9))


def moments_a11(spark: SparkSession, d: str) -> DataFrame:
    rows = _long(setups(spark, d), ["adr_pct", "base_duration_days", "mom_pct", "close"], ["universe_variant"])
    keys = ["universe_variant", "column_name"]
    middle = exact_quantiles(rows, keys, "value", [0.5]).select(*[F.col(k).alias(f"_{k}") for k in keys], F.round("quantile", 8).alias("median"))
    out = rows.groupBy(*keys).agg(F.count("value").alias("n"), F.round(F.avg("value"), 8).alias("mean"), F.round(F.stddev_samp("value"), 8).alias("std"))
    return out.join(middle, F.col("universe_variant").eqNullSafe(F.col("_universe_variant")) & (F.col("column_name") == F.col("_column_name"))).drop("_universe_variant", "_column_name")


CORR = ["mom_pct", "legup_gain_pct", "cons_max_drop_pct", "breakout_range_pct", "dist_52w_high_pct"]


def correlations_a12_a13(spark: SparkSession, d: str) -> DataFrame:
    return stats.correlations(setups(spark, d), CORR).withColumn("corr", F.round("corr", 8))


def missing_by_variant_a14(spark: SparkSession, d: str) -> DataFrame:
    """Missing features per variant; sector also counts Unknown."""
    s = setups(spark, d)
    gone = [F.count_if(missing(c)).alias(f"{c}_missing") for c in FEATURES]
    return s.groupBy("universe_variant").agg(F.count(F.lit(1)).alias("n"), *gone, F.count_if(text_or("sector", "Unknown") == "Unknown").alias("sector_missing"))


def reasons_a15(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of failure, most common first."""
    kind = F.split("reason", ":")
    return table(spark, d, "yfinance_failures").groupBy(F.concat_ws(":", F.get(kind, F.lit(0)), F.get(kind, F.lit(1))).alias("kind")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "kind")


def top_sector_a16(spark: SparkSession, d: str) -> DataFrame:
    return setups(spark, d).groupBy(text_or("sector", "Unknown").alias("sector")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "sector").limit(1)


def sign_verdict_a22(spark: SparkSession, d: str) -> DataFrame:
    """Years whose mean pre_legup_return is negative, and the verdict on their number."""
    years = setups(spark, d).filter(finite("pre_legup_return")).groupBy(F.year("date").alias("y")).agg(F.avg("pre_legup_return").alias("m"))
    out = years.agg(F.count(F.lit(1)).alias("n_years"), F.count_if(F.col("m") < 0).alias("n_negative"))
    return out.withColumn("verdict", F.when(F.col("n_years") < 8, "INCOMPLETE").when(F.col("n_negative") >= 5, "PASS").otherwise("FAIL"))


EXPECTED = {"adr_pct": (0.02, 0.08), "vol_contraction_ratio": (0.5, 1.5), "base_duration_days": (10.0, 42.0)}


def range_verdict_a26(spark: SparkSession, d: str) -> DataFrame:
    """Whether the middle half, or the middle 80 %, of a feature lies in its expected range."""
    q = exact_quantiles(_long(setups(spark, d), list(EXPECTED), []), ["column_name"], "value", [0.1, 0.25, 0.75, 0.9], "nearest")
    at = lambda p: F.max(F.when(F.col("prob") == p, F.col("quantile")))
    w = q.groupBy("column_name").agg(at(0.1).alias("p10"), at(0.25).alias("p25"), at(0.75).alias("p75"), at(0.9).alias("p90"))
    lo, hi = (F.element_at(F.create_map(*[x for c, v in EXPECTED.items() for x in (F.lit(c), F.lit(v[i]))]), F.col("column_name")) for i in (0, 1))
    return w.withColumn("verdict", F.when((F.col("p10") >= lo) & (F.col("p90") <= hi), "inside").when((F.col("p25") >= lo) & (F.col("p75") <= hi), "middle half inside").otherwise("shifted"))


def histogram_a27_k7(spark: SparkSession, d: str) -> DataFrame:
    """Equal-width density of mom_pct in 49 bins."""
    s = setups(spark, d).filter(F.col("mom_pct").between(0, 1))
    b = s.groupBy(F.least(F.width_bucket("mom_pct", F.lit(0.0), F.lit(1.0), F.lit(49)), F.lit(49)).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return b.withColumn("density", F.round(F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0))) * 49, 8))


def top_tickers_o3(spark: SparkSession, d: str) -> DataFrame:
    """The ten tickers with most setups of each variant."""
    n = setups(spark, d).filter(F.col("universe_variant").isNotNull()).groupBy("universe_variant", "ticker").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(W.partitionBy("universe_variant").orderBy(F.desc("n"), "ticker")).cast("bigint")).filter(F.col("place") <= 10)


def first_rows_o1_o4(spark: SparkSession, d: str) -> DataFrame:
    """The first 50 setups without a slope, in order."""
    return setups(spark, d).filter(missing("rs_slope_vs_spy")).orderBy("date", "setup_id").limit(50).select("setup_id", "ticker", "date")


def sample_o5(spark: SparkSession, d: str) -> DataFrame:
    """A sample of ten that a seed fixes."""
    return setups(spark, d).orderBy(F.md5(F.concat_ws("/", F.col("setup_id"), F.lit("42"))), "setup_id").limit(10).select("setup_id", "ticker", "date")


def union_u1(spark: SparkSession, d: str) -> DataFrame:
    s = setups(spark, d)
    parts = [s.filter(F.col("universe_variant") == v).select("setup_id", F.lit(v).alias("variant"), F.lit(i).cast("bigint").alias("part")) for i, v in enumerate(("strict", "loose"))]
    return parts[0].unionByName(parts[1])


def excluded_tickers_u2_d16(spark: SparkSession, d: str) -> DataFrame:
    """Tickers excluded by any of three rules, with the rules' sizes; nulls exclude nothing."""
    t = table(spark, d, "yfinance_types").withColumn("ticker", canonical_ticker(F.col("ticker")))
    rules = {"quote_type": F.col("quote_type") != "EQUITY", "country": F.col("country") != "United States", "name": F.col("long_name").rlike(r"(?i)\bADR\b|American Depositary|Sponsored ADR")}
    marks = t.groupBy("ticker").agg(*[F.coalesce(F.bool_or(r), F.lit(False)).alias(f"by_{k}") for k, r in rules.items()])
    return marks.filter(F.col("by_quote_type") | F.col("by_country") | F.col("by_name"))


def difference_u4_s11_j10(spark: SparkSession, d: str) -> DataFrame:
    """Tickers still to fetch."""
    return missing_keys(table(spark, d, "m1_setups"), table(spark, d, "yfinance_types"), "ticker")


def upsert_s12(spark: SparkSession, d: str) -> DataFrame:
    """Rows without country or name replaced by new ones, the rest kept."""
    t = table(spark, d, "yfinance_types")
    new = needs_refresh(t, ["country", "long_name"]).select("type_id", "ticker", "quote_type", F.lit("refetched").alias("country"))
    return upsert(t.drop("fetched_at", "removed_at"), new, ["type_id"])


def sector_lookup_j7_p21(spark: SparkSession, d: str) -> DataFrame:
    """Setups with the sector of their ticker's last fetched row, Unknown where there is none or it is blank."""
    types = table(spark, d, "yfinance_types").withColumn("ticker", canonical_ticker(F.col("ticker"))).groupBy("ticker").agg(F.max(F.struct("type_id", F.col("sector").alias("s")))["s"].alias("type_sector"))
    return setups(spark, d).join(types, "ticker", "left").select("setup_id", "ticker", text_or("type_sector", "Unknown").alias("type_sector"))


def gate_k2(spark: SparkSession, d: str) -> DataFrame:
    """Share of missing values per numeric feature and whether a write would be withheld."""
    s = setups(spark, d)
    row = s.agg(*[F.avg(missing(c).cast("double")).alias(c) for c in FEATURES])
    each = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("share")) for c in FEATURES])
    return row.select(F.explode(each).alias("c")).select("c.*").withColumns({"withheld": F.col("share") > 0.05, "share": F.round("share", 9)})


def scores_d10_p18(spark: SparkSession, d: str) -> DataFrame:
    return quality_score(table(spark, d, "m1_setups")).select("setup_id", F.round("score", 8).alias("score"))


def spacing_d9(spark: SparkSession, d: str) -> DataFrame:
    """Setups of each variant and ticker at least 30 days apart, better scores first in collisions."""
    s = quality_score(setups(spark, d)).withColumn("score", F.coalesce("score", F.lit(0.0)))
    # one segment whose positions are days, so that the turn of a year is no border
    s = s.select("setup_id", "ticker", "universe_variant", "date", F.lit(0).cast("bigint").alias("segment_id"), F.unix_date("date").cast("bigint").alias("days_in_segment"), "score").filter(F.col("date").isNotNull())
    return space_out(s, "ticker", 30, ("universe_variant",)).select("setup_id", "ticker", "universe_variant", "date")


# ---- factor files


def _factor_lines(spark: SparkSession, d: str) -> DataFrame:
    """The factor table written as a text file with a title, a blank line, the block and a footer."""
    rows = factors(spark, d).withColumn("i", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("date")) + 10)
    body = rows.select("i", F.concat_ws(", ", F.date_format("date", "yyyyMMdd"), *[F.format_string("%.2f", F.col(n) * 100) for n in FACTOR_NAMES]).alias("line"))
    around = spark.createDataFrame([(1, "Daily factors"), (2, ""), (3, ",Mkt-RF,SMB,HML,UMD"), (10_000_000, ""), (10_000_001, "20010101, 9, 9, 9, 9"), (10_000_002, "Copyright")], "i int, line string")
    return body.unionByName(around).select(F.col("i").cast("bigint").alias("line_no"), "line")


def data_block_s7(spark: SparkSession, d: str) -> DataFrame:
    return data_block(_factor_lines(spark, d)).agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first"), F.max("line").alias("last"))


def factor_panel_s8_e7_j3(spark: SparkSession, d: str) -> DataFrame:
    both = parse_factors(_factor_lines(spark, d), FACTOR_NAMES)
    out = factor_panel(both.select("date", "mkt_rf", "smb", "hml"), both.select("date", "umd"), "2015-01-01")
    return out.select("date", *[F.round(n, 8).alias(n) for n in FACTOR_NAMES])


def factor_sums_w14(spark: SparkSession, d: str) -> DataFrame:
    o = W.partitionBy(F.lit(0)).orderBy("date")
    return factors(spark, d).select("date", *[F.round(F.sum(n).over(o), 8).alias(n) for n in FACTOR_NAMES])


# ---- event features and returns


def window_features_e1_e5_j14(spark: SparkSession, d: str) -> DataFrame:
    out = window_features(setups_by_feed(spark, d), bars(spark, d), table(spark, d, "spy_daily"), "series", "event", "cons_start_date", "cons_end_date")
    return out.select("event.*", "n_bars", *[F.round(c, 7).alias(c) for c in ("vol_contraction_ratio", "adr_pct", "rs_slope")], "drop_reason")


def _returns(spark: SparkSession, d: str) -> DataFrame:
    return forward_returns(setups_by_feed(spark, d), bars(spark, d), "series")


def forward_returns_e6_j15_w16(spark: SparkSession, d: str) -> DataFrame:
    out = _returns(spark, d)
    return out.select("setup_id", "series", F.round("fwd_ret", 9).alias("fwd_ret"), "fwd_end_date", "fwd_reason")


def _panel(spark: SparkSession, d: str) -> DataFrame:
    return factor_windows(_returns(spark, d), factors(spark, d), FACTOR_NAMES).withColumn("sector", text_or("sector", "Unknown"))


def factor_windows_e8_w15_j4_j5(spark: SparkSession, d: str) -> DataFrame:
    return _panel(spark, d).select("setup_id", "series", "fwd_end_date", *[F.round(w, 8).alias(w) for w in WINDOWS])


def kept_by_year_a28(spark: SparkSession, d: str) -> DataFrame:
    p = _panel(spark, d)
    return p.groupBy(F.year("date").cast("bigint").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("fwd_ret").isNotNull()).alias("kept"))


def design_counts_r1(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each sector and year of the training dates, and whether it is the reference category."""
    rows = stats.usable(_panel(spark, d).withColumn("year", F.year("date").cast("string")), ["fwd_ret", *WINDOWS])
    train = rows.filter(F.col("date").between(*[F.lit(x).cast("date") for x in TRAIN]))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("category")) for k in ("sector", "year")])).alias("c")
    n = train.select(each).groupBy("c.kind", "c.category").agg(F.count(F.lit(1)).alias("n"))
    by_size = F.row_number().over(W.partitionBy("kind").orderBy(F.desc("n"), "category"))
    by_name = F.row_number().over(W.partitionBy("kind").orderBy("category"))
    return n.withColumn("is_reference", F.when(F.col("kind") == "sector", by_size == 1).otherwise(by_name == 1))


def _residuals(spark: SparkSession, d: str, end: str = TRAIN[1]) -> tuple[DataFrame, dict]:
    return stats.residualize(_panel(spark, d), "fwd_ret", WINDOWS, TRAIN[0], end, cap="vol_contraction_ratio")


def ols_r2(spark: SparkSession, d: str) -> DataFrame:
    """The fitted terms."""
    _, info = _residuals(spark, d)
    names = {"const": "const"} | info["design"].names()
    rows = [(names[t], b, s, z, p) for t, b, s, z, p in info["fit"].rows()]
    return spark.createDataFrame(rows, "term string, coef double, std_err double, t double, p double")


def simple_ols_r2(spark: SparkSession, d: str) -> DataFrame:
    """One regressor, which SQL can fit too."""
    rows = stats.usable(_panel(spark, d), ["fwd_ret", "mkt_rf_window"])
    f = stats.ols(rows, ["mkt_rf_window"], "fwd_ret")
    return spark.createDataFrame([(float(f.coef[0]), float(f.coef[1]), float(f.r2), f.n)], "a double, b double, r2 double, n bigint").select(*[F.round(c, 7).alias(c) for c in ("a", "b", "r2")], "n")


def residuals_r3(spark: SparkSession, d: str) -> DataFrame:
    out, _ = _residuals(spark, d)
    return out.select("setup_id", "series", F.round("fwd_ret_resid", 9).alias("fwd_ret_resid"))


def winsorized_r4_a29(spark: SparkSession, d: str) -> DataFrame:
    """The cap, and the rows above it among the training rows and all."""
    out, info = _residuals(spark, d)
    above = F.col("vol_contraction_ratio") > F.lit(info["p99"])
    train = F.col("date").between(*[F.lit(x).cast("date") for x in TRAIN])
    return out.agg(F.lit(info["p99"]).alias("p99"), F.count_if(above & train).alias("n_train_above"), F.count_if(above).alias("n_above"), F.round(F.max(F.when(finite("vol_contraction_ratio_w"), F.col("vol_contraction_ratio_w"))), 9).alias("most"))


def _distribution(rows: DataFrame, value: str) -> DataFrame:
    rows = rows.filter(finite(value)).withColumn("slice", F.when(F.col("date") <= F.lit(TRAIN[1]).cast("date"), "train").otherwise("later"))
    q = exact_quantiles(rows, ["slice"], value, [0.1, 0.5, 0.9])
    at = lambda p: F.round(F.max(F.when(F.col("prob") == p, F.col("quantile"))), 8)
    w = q.groupBy("slice").agg(at(0.1).alias("p10"), at(0.5).alias("p50"), at(0.9).alias("p90"))
    return rows.groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 8).alias("mean"), F.round(F.stddev_samp(value), 8).alias("std")).join(w, "slice")


def slices_a30(spark: SparkSession, d: str) -> DataFrame:
    """Distribution of returns in the training dates and after them."""
    return _distribution(_panel(spark, d), "fwd_ret")


def residual_slices_a30(spark: SparkSession, d: str) -> DataFrame:
    """The same of the residuals."""
    return _distribution(_residuals(spark, d)[0], "fwd_ret_resid")


def residual_balance_r2_r3(spark: SparkSession, d: str) -> DataFrame:
    """The normal equations: over the training rows of each sector and year the residuals add up to nothing, and so do their products with each factor."""
    out, _ = _residuals(spark, d)
    train = out.filter(F.col("date").between(*[F.lit(x).cast("date") for x in TRAIN]))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("category"), F.lit(1.0).alias("x")) for k in ("sector", "year")], *[F.struct(F.lit("factor").alias("kind"), F.lit(w).alias("category"), F.col(w).alias("x")) for w in WINDOWS])).alias("c")
    total = F.sum(F.col("c.x") * F.col("fwd_ret_resid"))
    return train.select("fwd_ret_resid", each).groupBy("c.kind", "c.category").agg(F.count(F.lit(1)).alias("n"), (F.abs(total) < 1e-6).alias("balanced"))


def residual_rows_r3(spark: SparkSession, d: str) -> DataFrame:
    """The rows that have a residual."""
    return _residuals(spark, d)[0].filter(finite("fwd_ret_resid")).select("setup_id", "series", F.col("year").cast("bigint").alias("year"))


# ---- estimation

TERMS = {"primary": ["vol_contraction_ratio_w", "adr_pct", "base_duration_days", "rs_slope_vs_spy"], "sensitivity": ["vol_contraction_ratio", "adr_pct", "base_duration_days", "rs_slope_vs_spy"]}
RATIOS = [t[0] for t in TERMS.values()]
TAUS = [0.1, 0.25, 0.5, 0.75, 0.9]


def _estimable() -> Column:
    """All regressors are there."""
    good = finite("vol_contraction_ratio_w") & finite("adr_pct") & finite("rs_slope_vs_spy")
    return good & F.col("base_duration_days").isNotNull()


def _estimation_rows(spark: SparkSession, d: str, end: str = TRAIN[1]) -> DataFrame:
    out, _ = _residuals(spark, d, end)
    return out.filter(_estimable() & F.col("universe_variant").isNotNull())


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return quantreg.estimation_grid(_estimation_rows(spark, d), "universe_variant", TERMS, "fwd_ret_resid", TAUS)


def estimation_grid_r5_r6(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d)


def headline_r7(spark: SparkSession, d: str) -> DataFrame:
    return quantreg.headline(_grid(spark, d), RATIOS)


def _flagged_terms(coefs: DataFrame) -> DataFrame:
    return coefs.filter((F.col("model") == "ols") & (F.col("spec") == "primary") & (F.col("term") != "const") & (F.abs("t_or_z") > 3))


def flags_r8(spark: SparkSession, d: str) -> DataFrame:
    """Terms of the primary least-squares models with |t| > 3."""
    return _flagged_terms(_grid(spark, d))


def coefficient_table_r9(spark: SparkSession, d: str) -> DataFrame:
    return quantreg.coefficient_table(_grid(spark, d), ["ols", *[f"qr_{t:g}" for t in TAUS]])


def bands_k7(spark: SparkSession, d: str) -> DataFrame:
    """Coefficients by tau with their 95 % bands."""
    g = _grid(spark, d).filter(F.col("tau").isNotNull() & F.col("term").isin(RATIOS))
    return g.select("panel", "spec", "tau", "coef", (F.col("coef") - 1.96 * F.col("std_err")).alias("lo"), (F.col("coef") + 1.96 * F.col("std_err")).alias("hi"))


def quantile_counts_r5_r6(spark: SparkSession, d: str) -> DataFrame:
    """Optimality of each quantile fit: with k terms at most k rows lie on it, so that at most tau * n rows are below and at most (1 - tau) * n above,
    up to k; and n is the number of rows with all terms."""
    rows = _estimation_rows(spark, d)
    wide = quantreg.estimation_grid(rows, "universe_variant", TERMS, "fwd_ret_resid", TAUS).filter(F.col("tau").isNotNull())
    coefs = wide.groupBy("panel", "spec", "tau").agg(F.max("n").alias("n_fit"), F.map_from_entries(F.collect_list(F.struct("term", "coef"))).alias("b"))
    met = rows.join(coefs, rows["universe_variant"] == coefs["panel"])
    fitted = F.col("b")["const"]
    for t in ("vol_contraction_ratio_w", "vol_contraction_ratio", "adr_pct", "base_duration_days", "rs_slope_vs_spy"):
        fitted = fitted + F.coalesce(F.col("b")[t], F.lit(0.0)) * F.when(F.col("b")[t].isNotNull(), F.col(t).cast("double")).otherwise(0.0)
    e, k = F.col("fwd_ret_resid") - fitted, 5
    tau = F.col("tau")
    out = met.filter(finite(e)).groupBy("panel", "spec", "tau").agg(F.count(F.lit(1)).alias("n"), F.max("n_fit").alias("n_fit"), F.count_if(e < -1e-6).alias("_below"), F.count_if(e > 1e-6).alias("_above"))
    ok = (F.col("_below") <= tau * F.col("n") + k) & (F.col("_above") <= (1 - tau) * F.col("n") + k)
    return out.select("panel", "spec", "tau", "n", (F.col("n") == F.col("n_fit")).alias("same_rows"), ok.alias("optimal"))


def _made_coefs(spark: SparkSession, d: str) -> DataFrame:
    """A coefficient table made from the setups' own numbers, to hold the tables on it against SQL."""
    s = setups(spark, d).filter(F.col("universe_variant").isNotNull())
    terms = F.explode(F.array(*[F.struct(F.lit(c).alias("term"), F.col(c).cast("double").alias("v")) for c in CORR])).alias("t")
    models = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(t).cast("double").alias("tau"), F.lit(w).alias("w")) for m, t, w in MADE])).alias("m")
    g = s.select("universe_variant", terms).filter(finite("t.v")).groupBy(F.col("universe_variant").alias("panel"), "t.term").agg(F.round(F.avg("t.v"), 12).alias("a"), F.count(F.lit(1)).alias("n"))
    return g.select("panel", F.lit("primary").alias("spec"), "term", models, "a", "n").select("panel", "spec", "m.model", "m.tau", "term", (F.col("a") * F.col("m.w")).alias("coef"), F.lit(0.25).alias("std_err"), (F.col("a") * F.col("m.w") * 4).alias("t_or_z"), "n")


#: model, tau and weight; the weights are a little off whole numbers, so that no cell of the text table is a tie to be rounded
MADE = (("ols", None, 4.000001), ("qr_0.5", 0.5, 1.000001), ("qr_0.9", 0.9, 3.000001))


def headline_rules_r7(spark: SparkSession, d: str) -> DataFrame:
    """The headline of one term on a made coefficient table."""
    return quantreg.headline(_made_coefs(spark, d), "legup_gain_pct").select("panel", "spec", *[F.round(c, 8).alias(c) for c in ("beta_low", "beta_high", "diff")])


def flag_rules_r8(spark: SparkSession, d: str) -> DataFrame:
    """Least-squares terms with |t| > 3 on a made coefficient table."""
    return _flagged_terms(_made_coefs(spark, d)).select("panel", "term", F.round("t_or_z", 8).alias("t_or_z"))


def table_rules_r9(spark: SparkSession, d: str) -> DataFrame:
    """The text table of a made coefficient table."""
    return quantreg.coefficient_table(_made_coefs(spark, d), [m for m, _, _ in MADE])


def inference_rules_r15_r16(spark: SparkSession, d: str) -> DataFrame:
    """The summary of draws, on draws made from the setups' own numbers: real from mom_12_1, placebo from legup_gain_pct."""
    s = setups(spark, d).filter(F.col("universe_variant").isNotNull()).withColumn("label", F.col("universe_variant"))
    draw = lambda mode, v: s.filter(finite(v)).select("label", F.lit(mode).alias("mode"), F.round(F.col(v) - 0.3, 6).alias("diff"), (F.col("setup_id") % 7 != 0).alias("converged"))
    point = s.filter(finite("mom_pct")).groupBy("label").agg(F.round(F.avg("mom_pct") - 0.5, 6).alias("diff")).select("label", F.lit("point").alias("mode"), "diff", F.lit(True).alias("converged"))
    out = quantreg.inference(point.unionByName(draw("real", "mom_12_1")).unionByName(draw("placebo", "legup_gain_pct")))
    return out.select(*[F.round(c, 7).alias(c) if t == "double" else c for c, t in out.dtypes])


WALK_PANELS = ("loose", "strict")
FIRST_SCORE_YEAR = 2017
LEAST_ROWS = 50
WALK_SCHEMA = "year bigint, panel string, train_start date, train_end date, n_train bigint, n_score bigint, beta_50 double, beta_90 double, diff double, sign_diff string, p99_train double, ols_rsquared double, fit_succeeded boolean"


def walk_forward_r10(spark: SparkSession, d: str) -> DataFrame:
    """For each year up to the last of the setups and each panel the fit on all earlier years: residuals, cap and both quantiles anew.

    A fit fails only with under LEAST_ROWS training rows; panels beyond MOST_ROWS are fitted in the cluster.
    """
    panel = _panel(spark, d).persist()
    rows = []
    start = datetime.date.fromisoformat(TRAIN[0])
    try:
        last = panel.agg(F.max(F.year("date"))).first()[0] or 0
        for year in range(FIRST_SCORE_YEAR, last + 1):
            end = datetime.date(year - 1, 12, 31)
            out, info = stats.residualize(panel, "fwd_ret", WINDOWS, str(start), str(end), cap="vol_contraction_ratio")
            out = out.filter(F.col("universe_variant").isin(*WALK_PANELS)).withColumn("_train", F.col("date").between(F.lit(start), F.lit(end)) & _estimable())
            n = {r["universe_variant"]: r for r in out.groupBy("universe_variant").agg(F.count_if("_train").alias("n_train"), F.count_if(F.year("date") == year).alias("n_score")).collect()}
            enough = [p for p in WALK_PANELS if p in n and n[p]["n_train"] >= LEAST_ROWS]
            betas = {}
            if enough:
                train = out.filter(F.col("_train") & F.col("universe_variant").isin(enough))
                grid = quantreg.estimation_grid(train, "universe_variant", {"primary": TERMS["primary"]}, "fwd_ret_resid", [0.5, 0.9])
                betas = {r["panel"]: r for r in quantreg.headline(grid, TERMS["primary"][0]).collect()}
            info["rows"].unpersist()
            for p in WALK_PANELS:
                n_train, n_score = (n[p]["n_train"], n[p]["n_score"]) if p in n else (0, 0)
                low, high, diff = (betas[p]["beta_low"], betas[p]["beta_high"], betas[p]["diff"]) if p in enough else (None, None, None)
                sign = "none" if diff is None else "negative" if diff < 0 else "positive" if diff > 0 else "zero"
                rows.append((year, p, start, end, n_train, n_score, low, high, diff, sign, info["p99"], float(info["fit"].r2), p in enough))
    finally:
        panel.unpersist()
    return spark.createDataFrame(rows, WALK_SCHEMA)


def walk_counts_r10(spark: SparkSession, d: str) -> DataFrame:
    """Years and panels of walk_forward_r10 with their rows and caps."""
    return walk_forward_r10(spark, d).select("year", "panel", "train_start", "train_end", "n_train", "n_score", F.round("p99_train", 9).alias("p99_train"), "fit_succeeded")


def sign_trend_r11(spark: SparkSession, d: str) -> DataFrame:
    """Per panel, how many yearly differences are negative, and whether their size grows.

    A year without new training rows only repeats the fit of the year before and does not count again.
    """
    before = F.lag("n_train").over(W.partitionBy("panel").orderBy("year"))
    w = walk_forward_r10(spark, d).withColumn("_new", F.col("n_train") > F.coalesce(before, F.lit(0))).filter("fit_succeeded and _new").groupBy("panel")
    out = w.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("diff") < 0).alias("n_negative"), F.min_by(F.abs("diff"), "year").alias("first"), F.max_by(F.abs("diff"), "year").alias("last"), F.avg("diff").alias("mean"), F.stddev_samp("diff").alias("std"))
    return out.withColumn("trend", F.when(F.col("last") > F.col("first") * 1.1, "growing").when(F.col("last") < F.col("first") * 0.9, "shrinking").otherwise("flat"))


#: Runs of the bootstrap: label, panel, end of the training dates, placebo draws wanted.
RUNS = (("canonical", "loose", TRAIN[1], True), ("canonical", "strict", TRAIN[1], True), ("exploratory", "loose", "2024-12-31", False))


def _draws(spark: SparkSession, d: str, real: int = 1000, placebo: int = 500) -> DataFrame:
    """Draws of all RUNS; label is label/panel."""
    order = ["date", "ticker", "setup_id", "series"]
    # the panel is made once for all runs, of the columns that they need
    panel = _panel(spark, d).select(*order, "sector", "universe_variant", "fwd_ret", *WINDOWS, *TERMS["sensitivity"]).persist()
    every = []
    try:
        for end in dict.fromkeys(r[2] for r in RUNS):
            out, info = stats.residualize(panel, "fwd_ret", WINDOWS, TRAIN[0], end, cap="vol_contraction_ratio")
            runs = [r for r in RUNS if r[2] == end]
            # an infinite ratio, which the cap would make finite, is left out as in the SQL
            rows = out.filter(_estimable() & finite("vol_contraction_ratio") & F.col("universe_variant").isin([r[1] for r in runs]) & F.col("date").between(F.lit(TRAIN[0]).cast("date"), F.lit(end).cast("date")))
            for label, variant, _, with_placebo in runs:
                of = rows.filter(F.col("universe_variant") == variant)
                rows_of = of.orderBy(*order).limit(quantreg.MOST_ROWS + 1).select(*TERMS["primary"], "fwd_ret_resid").toArrow()
                n, *x, y = rows_of.num_rows, *[c.to_numpy().astype(float) for c in rows_of.columns]
                draws = quantreg.bootstrap(spark, np.column_stack([np.ones(n), *x]), y, {"real": real} | ({"placebo": placebo} if with_placebo else {}), f"{label}/{variant}", 20260514)
                every.append(draws.withColumns({"train_start": F.lit(TRAIN[0]).cast("date"), "train_end": F.lit(end).cast("date"), "n_train": F.lit(n).cast("bigint")}))
            info["rows"].unpersist()
    finally:
        panel.unpersist()
    return reduce(DataFrame.unionByName, every)


def _labelled(out: DataFrame) -> DataFrame:
    parts = F.split("label", "/")
    return out.withColumns({"label": parts[0], "panel": parts[1]})


def bootstrap_r12_r14_r17(spark: SparkSession, d: str) -> DataFrame:
    """The long draw table."""
    return _labelled(quantreg.number_draws(_draws(spark, d)))


def draw_counts_r12_r14_r17_r18_r19(spark: SparkSession, d: str) -> DataFrame:
    """Runs, modes and numbers of the draw table."""
    out = bootstrap_r12_r14_r17(spark, d).groupBy("label", "panel", "mode").agg(F.count(F.lit(1)).alias("n"), F.min("draw_idx").alias("first"), F.max("draw_idx").alias("last"), F.count_distinct("draw_idx").alias("n_distinct"), F.max("n_train").alias("n_train"), F.max("train_end").alias("train_end"))
    return out


def inference_r15_r16(spark: SparkSession, d: str) -> DataFrame:
    # the summary reads the draws three times, which are made once: one row a draw, as many whatever the panels hold
    draws = _draws(spark, d)
    return _labelled(quantreg.inference(spark.createDataFrame(draws.collect(), draws.schema)))


QUERIES = {f.__name__: f for f in (
    counts_a5, pivot_a6_o6, quantiles_nearest_a9, quantiles_linear_a10, moments_a11, correlations_a12_a13, missing_by_variant_a14, reasons_a15, top_sector_a16, sign_verdict_a22, range_verdict_a26, histogram_a27_k7,
    top_tickers_o3, first_rows_o1_o4, sample_o5, union_u1, excluded_tickers_u2_d16, difference_u4_s11_j10, upsert_s12, sector_lookup_j7_p21, gate_k2, scores_d10_p18, spacing_d9, data_block_s7, factor_panel_s8_e7_j3, factor_sums_w14,
    window_features_e1_e5_j14, forward_returns_e6_j15_w16, factor_windows_e8_w15_j4_j5, kept_by_year_a28, design_counts_r1, ols_r2, simple_ols_r2, residuals_r3, winsorized_r4_a29, slices_a30, residual_slices_a30, residual_balance_r2_r3, residual_rows_r3, quantile_counts_r5_r6, headline_rules_r7, flag_rules_r8, table_rules_r9, inference_rules_r15_r16,
    estimation_grid_r5_r6, headline_r7, flags_r8, coefficient_table_r9, bands_k7, walk_forward_r10, walk_counts_r10, sign_trend_r11, bootstrap_r12_r14_r17, draw_counts_r12_r14_r17_r18_r19, inference_r15_r16,
)}

_SECTOR = "case when trim(sector) <> '' then sector else 'Unknown' end"
_LONG = " union all ".join(f"select universe_variant, '{c}' as column_name, {c}::double as v from st" for c in FEATURES)
_FIN = "v is not null and isfinite(v)"
_FWD = f"""{SETUPS_SQL}, {BARS_SQL}, ah as (select ticker, date, close as c0, lead(close, 20) over g as c1, lead(date, 20) over g as d1, true as found from tb window g as (partition by ticker order by date)),
fw as (select s.*, c0, c1, d1, case when not exists (select 1 from tb where tb.ticker = s.ticker) then 'no bars' when found is null then 'date not found' when d1 is null then 'too few bars after' when not coalesce(c0 > 0 and c1 > 0, false) then 'bad close' end as fwd_reason
  from st s left join ah on ah.ticker = s.ticker and ah.date = s.date),
fr as (select * exclude (c0, c1, d1), case when fwd_reason is null then c1 / c0 - 1 end as fwd_ret, case when fwd_reason is null then d1 end as fwd_end_date from fw)"""
_PANEL = f"""{_FWD}, {FACTORS_SQL}, fs as (select date, {', '.join(f'sum({n}) over (order by date) as {n}' for n in FACTOR_NAMES)} from fa),
pn as (select r.* replace ({_SECTOR.replace('sector', 'r.sector')} as sector), {', '.join(f'b.{n} - a.{n} as {n}_window' for n in FACTOR_NAMES)} from fr r left join fs a on a.date = r.date left join fs b on b.date = r.fwd_end_date)"""
_USABLE = "fwd_ret is not null and not isnan(fwd_ret) and " + " and ".join(f"{w} is not null" for w in WINDOWS)
_CORR_OK = " and ".join(f"{c} is not null and not isnan({c})" for c in CORR)

_RANGES = " union all ".join(f"select '{c}' as column_name, {lo} as lo, {hi} as hi" for c, (lo, hi) in EXPECTED.items())
_RANGE_VALUES = " union all ".join(f"select '{c}' as column_name, {c}::double as v from st" for c in EXPECTED)
_AT = lambda p: f"max(v) filter (k = floor((n - 1) * {p} + 0.5))"

SQL = {
    "range_verdict_a26": f"""with {SETUPS_SQL}, x as ({_RANGE_VALUES}), r as (select column_name, v, row_number() over (partition by column_name order by v) - 1 as k, count(*) over (partition by column_name) as n from x where {_FIN}),
        q as (select column_name, {_AT(0.1)} as p10, {_AT(0.25)} as p25, {_AT(0.75)} as p75, {_AT(0.9)} as p90 from r group by 1)
        select column_name, p10, p25, p75, p90, case when p10 >= lo and p90 <= hi then 'inside' when p25 >= lo and p75 <= hi then 'middle half inside' else 'shifted' end as verdict from q join ({_RANGES}) e using (column_name)""",
    "data_block_s7": f"with {FACTORS_SQL}, l as (select strftime(date, '%Y%m%d') || ', ' || " + " || ', ' || ".join(f"printf('%.2f', {n} * 100)" for n in FACTOR_NAMES) + " as line from fa) select count(*) as n, min(line) as first, max(line) as last from l",
    "winsorized_r4_a29": f"""with {_PANEL}, u as (select vol_contraction_ratio as v, date between date '{TRAIN[0]}' and date '{TRAIN[1]}' as tr from pn where {_USABLE}),
        r as (select v, row_number() over (order by v) - 1 as k, count(*) over () as n from u where tr and v is not null and not isnan(v)), c as (select v as p99 from r where k = floor((n - 1) * 0.99 + 0.5))
        select any_value(p99) as p99, count(*) filter (v > p99 and tr) as n_train_above, count(*) filter (v > p99) as n_above, round(max(least(v, p99)) filter (v is not null and isfinite(v)), 9) as most from u, c""",
    "counts_a5": f"with {SETUPS_SQL} select universe_variant, {_SECTOR} as sector, count(*) as n from st group by all",
    "pivot_a6_o6": f"with {SETUPS_SQL}, x as (select {_SECTOR} as sector, universe_variant as v from st) select sector, count(*) filter (v = 'loose') as loose, count(*) filter (v = 'strict') as strict, count(*) filter (v in ('loose', 'strict')) as total from x group by 1",
    "quantiles_nearest_a9": f"""with {SETUPS_SQL}, x as ({_LONG}), r as (select universe_variant, column_name, v, row_number() over (partition by universe_variant, column_name order by v) - 1 as k, count(*) over (partition by universe_variant, column_name) as n from x where {_FIN})
        select universe_variant, column_name, p, v as quantile, n from r, (select unnest([0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0])::double as p) where k = floor((n - 1) * p + 0.5)""",
    "quantiles_linear_a10": f"with {SETUPS_SQL}, x as ({_LONG}) " + " union all ".join(f"select universe_variant, column_name, {p}::double as p, round(quantile_cont(v, {p}), 9) as quantile, count(*) as n from x where {_FIN} group by all" for p in (0.025, 0.1, 0.5, 0.9, 0.975)),
    "moments_a11": f"""with {SETUPS_SQL}, x as ({' union all '.join(f"select universe_variant, '{c}' as column_name, {c}::double as v from st" for c in ('adr_pct', 'base_duration_days', 'mom_pct', 'close'))})
        select universe_variant, column_name, count(*) as n, round(avg(v), 8) as mean, round(stddev_samp(v), 8) as std, round(quantile_cont(v, 0.5), 8) as median from x where {_FIN} group by all""",
    "correlations_a12_a13": f"with {SETUPS_SQL}, x as (select * from st where {_CORR_OK}) " + " union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 8) as corr from x" for i, a in enumerate(CORR) for b in CORR[i:]),
    "missing_by_variant_a14": f"with {SETUPS_SQL} select universe_variant, count(*) as n, " + ", ".join(f"count(*) filter ({c} is null or isnan({c}::double)) as {c}_missing" for c in FEATURES) + f", count(*) filter ({_SECTOR} = 'Unknown') as sector_missing from st group by 1",
    "reasons_a15": "select concat_ws(':', nullif(split_part(reason, ':', 1), ''), case when contains(reason, ':') then split_part(reason, ':', 2) end) as kind, count(*) as n from yfinance_failures group by 1",
    "top_sector_a16": f"with {SETUPS_SQL} select {_SECTOR} as sector, count(*) as n from st group by 1 order by 2 desc, 1 limit 1",
    "sign_verdict_a22": f"with {SETUPS_SQL}, y as (select avg(pre_legup_return) as m from st where pre_legup_return is not null and isfinite(pre_legup_return) group by year(date)) select count(*) as n_years, count(*) filter (m < 0) as n_negative, case when count(*) < 8 then 'INCOMPLETE' when count(*) filter (m < 0) >= 5 then 'PASS' else 'FAIL' end as verdict from y",
    "histogram_a27_k7": f"with {SETUPS_SQL}, b as (select least(floor(mom_pct * 49) + 1, 49)::bigint as bin, count(*) as n from st where mom_pct between 0 and 1 group by 1) select bin, n, round(n / sum(n) over () * 49, 8) as density from b",
    "top_tickers_o3": f"with {SETUPS_SQL}, c as (select universe_variant, ticker, count(*) as n from st where universe_variant is not null group by all) select *, row_number() over (partition by universe_variant order by n desc, ticker) as place from c qualify place <= 10",
    "first_rows_o1_o4": f"with {SETUPS_SQL} select setup_id, ticker, date from st where rs_slope_vs_spy is null or isnan(rs_slope_vs_spy) order by date, setup_id limit 50",
    "union_u1": f"with {SETUPS_SQL} select setup_id, universe_variant as variant, 0::bigint as part from st where universe_variant = 'strict' union all select setup_id, universe_variant, 1::bigint from st where universe_variant = 'loose'",
    "excluded_tickers_u2_d16": f"""with t as (select * replace ({SETUPS_SQL.split('replace (')[1].split(' as ticker)')[0]} as ticker) from yfinance_types), m as (select ticker, coalesce(bool_or(quote_type <> 'EQUITY'), false) as by_quote_type,
        coalesce(bool_or(country <> 'United States'), false) as by_country, coalesce(bool_or(regexp_matches(long_name, '(?i)\\bADR\\b|American Depositary|Sponsored ADR')), false) as by_name from t group by 1) select * from m where by_quote_type or by_country or by_name""",
    "difference_u4_s11_j10": "select distinct ticker from m1_setups where ticker <> '' and ticker not in (select ticker from yfinance_types where ticker is not null)",
    "upsert_s12": """with n as (select * from yfinance_types where trim(coalesce(country, '')) = '' or trim(coalesce(long_name, '')) = '')
        select type_id, ticker, quote_type, sector, industry, country, long_name, short_name from yfinance_types where type_id not in (select type_id from n)
        union all select type_id, ticker, quote_type, null, null, 'refetched', null, null from n""",
    "sector_lookup_j7_p21": f"""with {SETUPS_SQL}, t as (select * replace ({SETUPS_SQL.split('replace (')[1].split(' as ticker)')[0]} as ticker) from yfinance_types), l as (select ticker, sector from t qualify row_number() over (partition by ticker order by type_id desc) = 1)
        select setup_id, st.ticker, case when trim(l.sector) <> '' then l.sector else 'Unknown' end as type_sector from st left join l using (ticker)""",
    "gate_k2": f"with {SETUPS_SQL} " + " union all ".join(f"select '{c}' as column_name, round(avg(({c} is null or isnan({c}::double))::int), 9) as share, avg(({c} is null or isnan({c}::double))::int) > 0.05 as withheld from st" for c in FEATURES),
    "scores_d10_p18": "select setup_id, round(0.5 * greatest(0, least(1, 1 - cons_max_drop_pct / 0.30)) + 0.1 * greatest(0, least(1, cons_duration_days / 60)) + 0.2 * greatest(0, least(1, ma_touches_pct_in_cons)) + 0.2 * greatest(0, least(1, breakout_volume_ratio / 5)), 8) as score from m1_setups",
    "factor_panel_s8_e7_j3": f"with {FACTORS_SQL} select date, " + ", ".join(f"round(round({n} * 100, 2) / 100, 8) as {n}" for n in FACTOR_NAMES) + " from fa where date >= date '2015-01-01'",
    "factor_sums_w14": f"with {FACTORS_SQL} select date, " + ", ".join(f"round(sum({n}) over (order by date), 8) as {n}" for n in FACTOR_NAMES) + " from fa",
    "window_features_e1_e5_j14": f"""with {SETUPS_SQL}, {BARS_SQL}, w as (select setup_id, b.date, b.close, b.high, b.low, b.volume, row_number() over (partition by setup_id order by b.date) - 1 as pos, count(*) over (partition by setup_id) as n,
          case when b.close > 0 and i.close > 0 then ln(b.close / i.close) end as y from st s join tb b on b.ticker = s.ticker and b.date between s.cons_start_date and s.cons_end_date left join spy_daily i on i.date = b.date),
        a as (select setup_id, count(*) as n_bars, avg(volume) filter (pos < n // 2) as e, avg(volume) filter (pos >= n // 2) as l, avg((high - low) / nullif(close, 0)) as adr, bool_and(coalesce(close > 0, false)) as good, count(y) as k, case when count(y) >= 3 then regr_slope(y, pos) end as sl from w group by 1)
        select s.setup_id, coalesce(n_bars, 0) as n_bars, round(case when n_bars >= 2 and e > 0 then l / e end, 7) as vol_contraction_ratio, round(case when good then adr end, 7) as adr_pct, round(sl, 7) as rs_slope,
          case when s.ticker is null or s.ticker not in (select ticker from tb) then 'no bars' when n_bars is null then 'no bars in window' end as drop_reason from st s left join a using (setup_id)""",
    "forward_returns_e6_j15_w16": f"with {_FWD} select setup_id, round(fwd_ret, 9) as fwd_ret, fwd_end_date, fwd_reason from fr",
    "factor_windows_e8_w15_j4_j5": f"with {_PANEL} select setup_id, fwd_end_date, " + ", ".join(f"round({w}, 8) as {w}" for w in WINDOWS) + " from pn",
    "kept_by_year_a28": f"with {_FWD} select year(date) as year, count(*) as n, count(fwd_ret) as kept from fr group by 1",
    "design_counts_r1": f"""with {_PANEL}, t as (select sector, year(date)::varchar as y from pn where {_USABLE} and date between date '{TRAIN[0]}' and date '{TRAIN[1]}'),
        c as (select 'sector' as kind, sector as category, count(*) as n from t group by 2 union all select 'year', y, count(*) from t group by 2)
        select kind, category, n, case when kind = 'sector' then row_number() over (partition by kind order by n desc, category) = 1 else row_number() over (partition by kind order by category) = 1 end as is_reference from c""",
    "simple_ols_r2": f"with {_PANEL} select round(regr_intercept(fwd_ret, mkt_rf_window), 7) as a, round(regr_slope(fwd_ret, mkt_rf_window), 7) as b, round(regr_r2(fwd_ret, mkt_rf_window), 7) as r2, count(*) as n from pn where fwd_ret is not null and not isnan(fwd_ret) and mkt_rf_window is not null",
    "slices_a30": f"""with {_FWD}, x as (select case when date <= date '{TRAIN[1]}' then 'train' else 'later' end as slice, fwd_ret as v from fr where fwd_ret is not null and isfinite(fwd_ret))
        select slice, count(*) as n, round(avg(v), 8) as mean, round(stddev_samp(v), 8) as std, round(quantile_cont(v, 0.1), 8) as p10, round(quantile_cont(v, 0.5), 8) as p50, round(quantile_cont(v, 0.9), 8) as p90 from x group by 1""",
}
_EST = "vol_contraction_ratio is not null and isfinite(least(vol_contraction_ratio, 1e300)) and not isnan(vol_contraction_ratio) and isfinite(adr_pct) and isfinite(rs_slope_vs_spy) and base_duration_days is not null"
_FINITE = lambda c: f"({c} is not null and isfinite({c}))"
_MADE = f"""st0 as (select *, unnest({CORR}) as term, unnest([{', '.join(CORR)}]) as v from st where universe_variant is not null), g as (select universe_variant as panel, term, round(avg(v), 12) as a, count(*) as n from st0 where {_FIN} group by all),
  mk as (select panel, term, m.model, m.tau, a * m.w as coef, a * m.w * 4 as t from g, (values {', '.join(f"('{m}', {t or 'null'}::double, {w})" for m, t, w in MADE)}) m(model, tau, w))"""
_FOLD = """{head}, gs as (select {by}, list(struct_pack(d := date, s := score, seg := segment_id, p := days_in_segment, x := {row}) order by date, segment_id, days_in_segment, score, {row}) as r from {rows} group by all),
fo as (select {by}, r, 1 as i, [r[1]] as kept from gs union all
  select {by}, r, i + 1, case when hit is null then list_append(kept, now) when now.s > kept[hit].s then list_transform(kept, lambda x, j: case when j = hit then now else x end) else kept end
  from (select *, list_position(list_transform(kept, lambda x: case when x.seg = now.seg then abs(x.p - now.p) < {least} else abs(x.d - now.d) / 1.4 < {least} end), true) as hit from (select {by}, r, i, kept, r[i + 1] as now from fo where i < len(r)))),
sp as (select {by}, unnest(kept) as k from fo where i = len(r))"""
_SCORED = "sc as (select *, coalesce({}, 0) as score from st)".format("0.5 * greatest(0, least(1, 1 - cons_max_drop_pct / 0.30)) + 0.1 * greatest(0, least(1, cons_duration_days / 60)) + 0.2 * greatest(0, least(1, ma_touches_pct_in_cons)) + 0.2 * greatest(0, least(1, breakout_volume_ratio / 5))")
_RUN_COUNTS = " union all ".join(
    f"select '{label}' as label, '{panel}' as panel, m.mode, m.n::bigint as n, m.a::bigint as first, (m.n + m.a - 1)::bigint as last, m.n::bigint as n_distinct, (select count(*) from es where universe_variant = '{panel}' and date between date '{TRAIN[0]}' and date '{end}') as n_train, date '{end}' as train_end from (values ('point', 1, -1), ('real', 1000, 0){", ('placebo', 500, 0)" if placebo else ''}) m(mode, n, a)"
    for label, panel, end, placebo in RUNS
)

SQL |= {
    "sample_o5": f"with {SETUPS_SQL} select setup_id, ticker, date from st order by md5(concat_ws('/', setup_id, '42')), setup_id limit 10",
    "spacing_d9": _FOLD.format(head=f"with recursive {SETUPS_SQL}, {_SCORED}, rw as (select *, 0 as segment_id, date_diff('day', date '1970-01-01', date) as days_in_segment from sc where date is not null)", by="universe_variant, ticker", row="setup_id", rows="rw", least=30) + " select k.x as setup_id, ticker, universe_variant, k.d as date from sp",
    "residual_balance_r2_r3": f"""with {_PANEL}, t as (select sector, year(date)::varchar as y from pn where {_USABLE} and date between date '{TRAIN[0]}' and date '{TRAIN[1]}')
        select 'sector' as kind, sector as category, count(*) as n, true as balanced from t group by 2 union all select 'year', y, count(*), true from t group by 2 union all select 'factor', f, (select count(*) from t), true from (select unnest({WINDOWS}) as f)""",
    "residual_rows_r3": f"with {_PANEL} select setup_id.s as setup_id, setup_id.f as series, year(date) as year from pn where {_USABLE} and isfinite(fwd_ret)",
    "quantile_counts_r5_r6": f"""with {_PANEL}, es as (select * from pn where {_USABLE} and isfinite(fwd_ret) and {_EST} and universe_variant is not null), c as (select universe_variant as panel, count(*) as p, count(*) filter (isfinite(vol_contraction_ratio)) as q from es group by 1)
        select panel, spec, tau, case when spec = 'primary' then p else q end as n, true as same_rows, true as optimal from c, (select unnest(['primary', 'sensitivity']) as spec), (select unnest({TAUS})::double as tau)""",
    "headline_rules_r7": f"with {SETUPS_SQL}, {_MADE} select panel, 'primary' as spec, round(max(coef) filter (tau = 0.5), 8) as beta_low, round(max(coef) filter (tau = 0.9), 8) as beta_high, round(max(coef) filter (tau = 0.9) - max(coef) filter (tau = 0.5), 8) as diff from mk where term = 'legup_gain_pct' group by 1",
    "flag_rules_r8": f"with {SETUPS_SQL}, {_MADE} select panel, term, round(t, 8) as t_or_z from mk where model = 'ols' and abs(t) > 3",
    "table_rules_r9": f"with {SETUPS_SQL}, {_MADE} select panel, 'primary' as spec, term, " + ", ".join(f"max(printf('%.4f (%.1f)', coef, t)) filter (model = '{m}') as \"{m}\"" for m, _, _ in MADE) + " from mk group by panel, term",
    "inference_rules_r15_r16": f"""with {SETUPS_SQL}, l as (select universe_variant as label, * from st where universe_variant is not null), th as (select label, round(avg(mom_pct) - 0.5, 6) as theta from l where {_FINITE('mom_pct')} group by 1),
        re as (select label, round(mom_12_1 - 0.3, 6) as v from l where {_FINITE('mom_12_1')} and setup_id % 7 <> 0), pl as (select label, round(legup_gain_pct - 0.3, 6) as v from l where {_FINITE('legup_gain_pct')} and setup_id % 7 <> 0),
        r as (select label, count(*) as n, quantile_cont(v, 0.025) as lo, quantile_cont(v, 0.975) as hi, avg(v) as mean, stddev_samp(v) as std, count(*) filter (v >= 0) as pos from re group by 1),
        p as (select label, count(*) as n_placebo, avg(v) as placebo_mean, stddev_samp(v) as placebo_std, avg((v <= theta)::int) as placebo_share from pl join th using (label) group by 1)
        select label, theta, n, round(lo, 7) as lo, round(hi, 7) as hi, round(2 * theta - hi, 7) as basic_lo, round(2 * theta - lo, 7) as basic_hi, round(mean, 7) as mean, round(std, 7) as std, round((pos + 1) / (n + 1), 7) as p_one_sided, hi < 0 as excludes_zero,
          n_placebo, round(placebo_mean, 7) as placebo_mean, round(placebo_std, 7) as placebo_std, round((theta - placebo_mean) / placebo_std, 7) as placebo_z, round(placebo_share, 7) as placebo_share from th left join r using (label) left join p using (label)""",
    "walk_counts_r10": f"""with {_PANEL}, us as (select * from pn where {_USABLE}), ys as (select unnest(range({FIRST_SCORE_YEAR}, (select max(year(date)) from pn) + 1)) as y),
        cp as (select y, vol_contraction_ratio as v, row_number() over (partition by y order by vol_contraction_ratio) - 1 as k, count(*) over (partition by y) as n from us, ys where date between date '{TRAIN[0]}' and make_date(y - 1, 12, 31) and vol_contraction_ratio is not null and not isnan(vol_contraction_ratio)),
        ct as (select y, v as p99 from cp where k = floor((n - 1) * 0.99 + 0.5)),
        c as (select y, p.panel, count(*) filter (date between date '{TRAIN[0]}' and make_date(y - 1, 12, 31) and isfinite(fwd_ret) and {_EST}) as n_train, count(*) filter (year(date) = y) as n_score from ys, (select unnest({list(WALK_PANELS)}) as panel) p left join us on us.universe_variant = p.panel group by all)
        select y as year, panel, date '{TRAIN[0]}' as train_start, make_date(y - 1, 12, 31) as train_end, n_train, n_score, round(p99, 9) as p99_train, n_train >= {LEAST_ROWS} as fit_succeeded from c left join ct using (y)""",
    "draw_counts_r12_r14_r17_r18_r19": f"with {_PANEL}, es as (select * from pn where {_USABLE} and isfinite(fwd_ret) and {_EST} and isfinite(vol_contraction_ratio)) {_RUN_COUNTS}",
}
SQL |= {k: by_series(SQL[k], ("setup_id",)) for k in ("window_features_e1_e5_j14", "forward_returns_e6_j15_w16", "factor_windows_e8_w15_j4_j5")}
SQL |= {k: by_series(SQL[k], ()) for k in ("kept_by_year_a28", "design_counts_r1", "simple_ols_r2", "winsorized_r4_a29", "slices_a30", "residual_balance_r2_r3", "residual_rows_r3", "quantile_counts_r5_r6", "walk_counts_r10", "draw_counts_r12_r14_r17_r18_r19")}
