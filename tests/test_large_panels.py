"""Panels beyond the rows of one task give the same table as small ones."""

import numpy as np
import pytest

from tidewright.operators import quantreg


def test_large_panel_is_fitted_in_the_cluster(spark):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([("pq"[i % 3 == 0], *map(float, rng.normal(size=2)), float(rng.standard_t(4))) for i in range(300)] + [("p", float("inf"), 0.0, 0.0)], "panel string, a double, b double, y double").coalesce(2)
    tables = [{(r.panel, r.spec, r.model, r.term): r for r in quantreg.estimation_grid(df, "panel", {"one": ["b"], "two": ["a", "b"]}, "y", [0.9], most).collect()} for most in (1000, 150)]
    assert tables[0].keys() == tables[1].keys() and len(tables[0]) == 2 * 2 * (2 + 3)
    for k, near in tables[0].items():
        far = tables[1][k]
        assert far.n == near.n == (100 if k[0] == "q" else 200 + (k[1] == "one")) and far.tau == near.tau
        for c in ("coef", "std_err", "t_or_z", "p", "rsquared", "pseudo_r2"):
            assert (far[c] is None) == (near[c] is None) and (far[c] is None or far[c] == pytest.approx(near[c], rel=1e-4, abs=1e-5)), (k, c)


@pytest.mark.parametrize("tau", [0.1, 0.5, 0.9])
def test_fits_are_optimal(tau):
    rng = np.random.default_rng(1)
    n = 400
    x = np.column_stack([np.ones(n), rng.normal(size=n) * 0.01, rng.integers(10, 40, n), rng.lognormal(size=n)])
    y = rng.standard_t(3, n) * 0.1
    b, used = quantreg.solve(x, y, tau)
    r = y - x @ b
    assert used < 60 and np.count_nonzero(r < -1e-7) <= tau * n <= np.count_nonzero(r < 1e-7)
    loss = quantreg.check_loss(r, tau)
    for _ in range(200):  # no neighbour is better
        assert quantreg.check_loss(y - x @ (b + rng.normal(size=4) * np.array([1e-3, 1e-2, 1e-4, 1e-3])), tau) >= loss - 1e-9
    # collinear columns and repeated rows
    twice = np.column_stack([x, x[:, 1]])
    c, _ = quantreg.solve(np.vstack([twice, twice]), np.r_[y, y], tau)
    assert abs(quantreg.check_loss(y - twice @ c, tau) - loss) < 1e-5
