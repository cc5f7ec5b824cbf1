"""Draws of panels whose neighbouring rows are alike stay small, and the summary makes the draws once."""

import numpy as np
import pytest

from tidewright.operators import quantreg
from tidewright.plans import study

from test_resamples import _panel
from test_shared_panel import made  # noqa: F401


@pytest.mark.parametrize("mode", ["real", "placebo"])
def test_draws_of_repeated_rows_solve_for_few_rows(mode, monkeypatch):
    x, y = (np.repeat(v, 40, axis=0) for v in _panel(1_500))
    n, column = len(y), 1 if mode == "placebo" else None
    planes = {t: quantreg._plane(x, y, t, 5000)[0] for t in (0.5, 0.9)}
    if mode == "placebo":
        planes = {t: np.insert(quantreg._plane(x[:, [0, 2, 3]], y, t, 5000)[0], 1, 0.0) for t in planes}
    fits = quantreg._Resamples(x, y, planes, column)
    rows, inner = [], quantreg._interior
    monkeypatch.setattr(quantreg, "_interior", lambda *a, **k: (rows.append(len(a[1])), inner(*a, **k))[1])
    solved = 0
    for i in range(6):
        rng = np.random.default_rng(i)
        at = quantreg.block_indices(n, 30, rng)
        xx, dealt = x[at], None
        if mode == "placebo":
            xx[:, 1] = dealt = rng.permutation(x[at, 1])
        for tau in planes:
            rows.clear()
            b, used = fits.fit(tau, at, dealt)
            solved += sum(rows)
            assert used < 60
            want = inner(xx, y[at], tau)[0]
            assert quantreg.check_loss(y[at] - xx @ b, tau) <= quantreg.check_loss(y[at] - xx @ want, tau) * (1 + 1e-9)
    assert solved / 12 < {"real": n / 60, "placebo": n / 5}[mode]


def test_blocks_are_the_positions_counted_and_summed():
    for n in (1, 7, 500, 20_000):
        starts, lengths = quantreg._blocks(n, 30, np.random.default_rng(n))
        at = quantreg.block_indices(n, 30, np.random.default_rng(n))
        values = np.random.default_rng(1).normal(size=(n, 3))
        for drawn in (quantreg._Resample.of_blocks(n, starts, lengths), quantreg._Resample.of(at)):
            assert (drawn.counts(np.arange(n)) == np.bincount(at, minlength=n)).all()
            assert drawn.sums(quantreg._running(values)) == pytest.approx(values[at].sum(axis=0))
            assert drawn.sums(quantreg._running(values, values[:, 0] > 0)) == pytest.approx(values[at][values[at, 0] > 0].sum(axis=0))


def test_a_search_that_breaks_off_ends_at_once():
    x, y = _panel(400)
    weights = np.r_[np.full(399, 1.0), np.inf]
    with np.errstate(all="ignore"):
        before = np.random.default_rng(0).normal(size=4)
        b, used, _ = quantreg._interior(x, y, 0.5, 10**7, weights=weights, start=before)
    assert used == 10**7  # said not to have converged


def test_inference_makes_the_draws_once_and_keeps_none(spark, made, monkeypatch):  # noqa: F811
    spark.catalog.clearCache()
    done, boot = spark.sparkContext.accumulator(0), quantreg.bootstrap

    def counted(*a, **k):
        draws = boot(*a, **k)

        def run(batches):
            for batch in batches:
                done.add(batch.num_rows)
                yield batch

        return draws.mapInArrow(run, draws.schema)

    monkeypatch.setattr(quantreg, "bootstrap", counted)
    rows = study.inference_r15_r16(spark, "").collect()
    assert len(rows) == 3 and spark.sparkContext._jsc.getPersistentRDDs().size() == 0
    assert done.value == 3 * (1 + 10) + 2 * 5
