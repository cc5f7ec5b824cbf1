"""The bootstrap's queries make the panel once, of the columns they need, and let go of it."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import quantreg
from tidewright.plans import study


@pytest.fixture
def made(spark, monkeypatch):
    """A made panel of 480 events from 2014 to 2021, few draws; the list grows by one each time the panel is made."""
    rng = np.random.default_rng(2)
    names = [*study.WINDOWS, *study.TERMS["sensitivity"], "fwd_ret"]
    rows = [(datetime.date(2014, 1, 1) + datetime.timedelta(days=6 * i), f"t{i % 7}", i, f"f/t{i % 7}", "ab"[i % 2], ("loose", "strict")[i % 3 == 0], "kept by nobody", *map(float, rng.normal(size=len(names)))) for i in range(480)]
    # an infinite ratio takes no part, as in the SQL
    rows += [(*rows[1][:2], 480, *rows[1][3:11], float("inf"), *rows[1][12:])]
    assert names[4] == "vol_contraction_ratio" and rows[1][5] == "loose"
    panel = spark.createDataFrame(rows, "date date, ticker string, setup_id bigint, series string, sector string, universe_variant string, rest string, " + ", ".join(f"{n} double" for n in names))
    calls, boot = [], quantreg.bootstrap
    monkeypatch.setattr(study, "_panel", lambda *_: (calls.append(1), panel)[1])
    monkeypatch.setattr(quantreg, "bootstrap", lambda s, x, y, draws, *a, **k: boot(s, x, y, {m: n // 100 for m, n in draws.items()}, *a, **k))
    return calls


def test_draw_counts_make_the_panel_once(spark, made):
    got = {(r.label, r.panel, r.mode): (r.n, r.first, r["last"], r.n_distinct, r.n_train) for r in study.draw_counts_r12_r14_r17_r18_r19(spark, "").collect()}
    assert len(made) == 1
    n = {"loose": 203, "strict": 102}
    assert {k: v[:4] for k, v in got.items() if k[0] == "canonical"} == {("canonical", p, m): v for p in n for m, v in (("point", (1, -1, -1, 1)), ("real", (10, 0, 9, 10)), ("placebo", (5, 0, 4, 5)))}
    assert all(v[4] == n[p] for (label, p, _), v in got.items() if label == "canonical") and got["exploratory", "loose", "real"] == (10, 0, 9, 10, 320)


def test_inference_reads_one_panel_and_lets_go_of_it(spark, made):
    spark.catalog.clearCache()
    rows = {(r.label, r.panel): r for r in study.inference_r15_r16(spark, "").collect()}
    assert len(made) == 1 and spark.sparkContext._jsc.getPersistentRDDs().size() <= 1  # the draws, which are read three times
    draws = study.bootstrap_r12_r14_r17(spark, "").filter(F.col("mode") == "real").groupBy("label", "panel").agg(F.avg("diff").alias("mean"), F.count("*").alias("n")).collect()
    assert len(draws) == len(rows) == 3 and all(rows[d.label, d.panel].n == d.n == 10 and rows[d.label, d.panel]["mean"] == pytest.approx(d["mean"]) for d in draws)
    spark.catalog.clearCache()
