"""Walk-forward and bootstrap run every year, panel and regressor."""

import numpy as np
from pyspark.sql import functions as F

from tidewright.operators import quantreg
from tidewright.plans import study

DIR = "/root/testdata/sf0.01"


def test_walk_forward_has_every_year_and_panel(spark):
    rows = study.walk_forward_r10(spark, DIR).collect()
    last = study.setups(spark, DIR).selectExpr("max(year(date))").first()[0]
    assert [(r.year, r.panel) for r in rows] == [(y, p) for y in range(2017, last + 1) for p in ("loose", "strict")] and last == 2024
    assert all(r.fit_succeeded == (r.n_train >= study.LEAST_ROWS) == (r["diff"] is not None) for r in rows) and any(r.fit_succeeded for r in rows)
    assert all(r.train_end.year == r.year - 1 for r in rows)


def test_bootstrap_runs_every_panel(spark):
    assert study._draws.__defaults__ == (1000, 500)
    draws = study._draws(spark, DIR, 6, 3).persist()
    n = {(r.label, r.mode): (r["count"], r.n) for r in draws.groupBy("label", "mode").agg(F.count("*").alias("count"), F.max("n_train").alias("n")).collect()}
    assert {k: c for k, (c, _) in n.items()} == {
        ("canonical/loose", "point"): 1, ("canonical/loose", "real"): 6, ("canonical/loose", "placebo"): 3, ("canonical/strict", "point"): 1, ("canonical/strict", "real"): 6,
        ("canonical/strict", "placebo"): 3, ("exploratory/loose", "point"): 1, ("exploratory/loose", "real"): 6,
    }
    assert n["exploratory/loose", "real"][1] > n["canonical/loose", "real"][1]
    # the point row is the median and .9 fit on all four regressors
    rows = study._estimation_rows(spark, DIR).filter("universe_variant = 'strict' and date <= '2018-12-31'").toPandas()
    x = np.column_stack([np.ones(len(rows)), rows[study.TERMS["primary"]].to_numpy(float)])
    point = draws.filter("label = 'canonical/strict' and mode = 'point'").first()
    assert x.shape[1] == 5 and abs(point.beta_50 - quantreg.solve(x, rows["fwd_ret_resid"].to_numpy(), 0.5, 5000)[0][1]) < 1e-4
    draws.unpersist()


def test_sensitivity_is_unwinsorised_with_all_regressors(spark):
    terms = {}
    for r in study.estimation_grid_r5_r6(spark, DIR).collect():
        terms.setdefault(r.spec, set()).add(r.term)
    rest = {"const", "adr_pct", "base_duration_days", "rs_slope_vs_spy"}
    assert terms == {"primary": rest | {"vol_contraction_ratio_w"}, "sensitivity": rest | {"vol_contraction_ratio"}}
    assert {(r.panel, r.spec) for r in study.headline_r7(spark, DIR).collect()} == {(p, s) for p in ("loose", "strict") for s in terms}
