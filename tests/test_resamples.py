"""Fits of resamples solve for the rows near the plane only, and are optimal on all rows."""

import numpy as np
import pytest

from tidewright.operators import quantreg


def _panel(n, seed=3):
    rng = np.random.default_rng(seed)
    x = np.column_stack([np.ones(n), np.minimum(rng.lognormal(size=n), 6), rng.normal(size=n) * 0.01, rng.integers(10, 40, n)])
    return x, (rng.standard_t(3, n) * (0.1 + 0.05 * x[:, 1])).round(4)


@pytest.mark.parametrize("mode", ["real", "placebo"])
def test_resamples_are_optimal_on_all_rows(mode, monkeypatch):
    n = 30_000
    x, y = _panel(n)
    rows, inner = [], quantreg._interior
    monkeypatch.setattr(quantreg, "_interior", lambda *a, **k: (rows.append(len(a[1])), inner(*a, **k))[1])
    planes = {t: quantreg._plane(x, y, t, 5000)[0] for t in (0.5, 0.9)}
    if mode == "placebo":
        planes = {t: np.insert(quantreg._plane(x[:, [0, 2, 3]], y, t, 5000)[0], 1, 0.0) for t in planes}
    fits = quantreg._Resamples(x, y, planes, 1 if mode == "placebo" else None)
    assert max(rows) < n / 3
    for i in range(4):
        rng = np.random.default_rng(i)
        at = quantreg.block_indices(n, 30, rng)
        xx, dealt = x[at], None
        if mode == "placebo":
            xx[:, 1] = dealt = rng.permutation(x[at, 1])
        for tau in planes:
            if i == 3:  # from a plane far off, the radius grows until the rows left out are proven to be far
                fits.radius[tau] /= 50
                fits.side = {}
                fits.side[tau] = (near := np.flatnonzero(np.abs(fits.r[tau]) <= fits.radius[tau] * np.sqrt(fits.reach))), fits.rows * ((fits.r[tau] > 0) & ~np.isin(np.arange(n), near))[:, None]
            rows.clear()
            b, used = fits.fit(tau, at, dealt)
            assert used < 60 and max(rows) < n / 3
            want, _ = quantreg.solve(xx, y[at], tau)
            loss = quantreg.check_loss(y[at] - xx @ want, tau)
            assert quantreg.check_loss(y[at] - xx @ b, tau) <= loss * (1 + 1e-9)


def test_bootstrap_draws_are_those_of_whole_fits(spark, monkeypatch):
    x, y = _panel(2_000)
    draws = lambda x: {(r.mode, r.draw_idx): r for r in quantreg.bootstrap(spark, x, y, {"real": 8, "placebo": 4}, "t", 5).collect()}
    near = draws(x)
    monkeypatch.setattr(quantreg, "FEW_ROWS", 10_000)
    whole = draws(x)
    assert near.keys() == whole.keys() and len(near) == 13
    for k, r in near.items():
        assert r.converged and (r.beta_50, r.beta_90) == pytest.approx((whole[k].beta_50, whole[k].beta_90), rel=1e-4, abs=1e-6), k
    # collinear columns are fitted whole
    monkeypatch.setattr(quantreg, "FEW_ROWS", 500)
    assert len(draws(np.column_stack([x, x[:, 3]]))) == 13


def test_blocks_cover_a_resample():
    for n in (1, 29, 500, 40_000):
        at = quantreg.block_indices(n, 30, np.random.default_rng(n))
        assert len(at) == n and at.min() >= 0 and at.max() < n
    starts = np.flatnonzero(np.diff(at) % n != 1)
    assert 27 < n / (len(starts) + 1) < 33  # mean length of a block
    assert abs(np.mean(at) / n - 0.5) < 0.05
