"""Quantile regression, walk-forward refits and the stationary block bootstrap.

Panels of up to MOST_ROWS rows are fitted by a numpy kernel, one group per task: an interior-point method on the dual linear program (a
primal-dual path with predictor and corrector steps, after Portnoy and Koenker, 1997), some twenty steps of k x k systems.  Resamples of a panel are solved near the panel's plane only.  ``distributed_fit`` takes iteratively
reweighted least squares instead, whose steps are weighted Gram blocks summed in the cluster, for any number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewright.operators.quantiles import exact_quantiles
from tidewright.operators.stats import gram, ols, student_p

MOST_ROWS = 500_000  #: rows of a panel that one task fits, and that a bootstrap broadcasts
CLAMP = 1e-6
NEAR = 1e-4  #: standard deviations of y within which a row lies on the fitted plane


def _longest(v: np.ndarray, dv: np.ndarray) -> float:
    """The share of the step dv, at most 1, that keeps v above zero."""
    least = float(np.min(dv / v))
    return min(1.0, -0.99995 / least) if least < 0 else 1.0


def solve(x: np.ndarray, y: np.ndarray, tau: float, max_iter: int = 1000, tol: float = 1e-10) -> tuple[np.ndarray, int]:
    """Coefficients of the tau-quantile of y on x, and the iterations used (max_iter if it did not converge)."""
    return _interior(x, y, tau, max_iter, tol)[:2]


def _interior(x: np.ndarray, y: np.ndarray, tau: float, max_iter: int = 1000, tol: float = 1e-10, weights: np.ndarray | None = None, start: np.ndarray | None = None) -> tuple[np.ndarray, int, np.ndarray]:
    """As solve(), with the dual weights; ``weights``: how often each row counts, ``start``: coefficients near the solution.

    The dual program: weights a in 0..1 (0..weights) with x'a = (1 - tau) x'1 that maximise y'a; u = 1 - a.  z and w belong to the bounds a >= 0 and u >= 0, and
    the multipliers of the equations are the coefficients.  The gap between both programs ends the search.
    """
    b = np.linalg.lstsq(x, y, rcond=None)[0] if start is None else start
    off = np.abs(y - np.median(y))
    unit = max(float(np.average(off, weights=weights)), 1e-300)
    y = y / unit
    b = b / unit
    most, total = (np.ones(len(y)), len(y)) if weights is None else (weights, float(weights.sum()))
    want = (1 - tau) * (x.sum(axis=0) if weights is None else weights @ x)
    r = x @ b - y
    if start is None:
        z = np.maximum(r, 0) + 0.001
        w = z - r
        a = (1 - tau) * most
    else:  # the weights meet their equations from the beginning, as rows that stand for many would not let them be met later
        z = np.maximum(r, 0) + max(0.1 * float(np.mean(np.abs(r))), 1e-12)
        w = z - r
        a = (1 - tau) * most
    u = most - a

    def equations(q: np.ndarray, right: np.ndarray) -> np.ndarray:
        m = (x * q[:, None]).T @ x
        try:
            return np.linalg.solve(m, right)
        except np.linalg.LinAlgError:  # collinear columns
            return np.linalg.lstsq(m, right, rcond=None)[0]

    for i in range(1, max_iter + 1):
        gap = float(z @ a + w @ u)
        if gap < tol * total:
            return b * unit, i, a
        if not math.isfinite(gap):  # no later step would be of use
            break
        q = 1 / (z / a + w / u)
        lack = want - x.T @ a
        slack = x @ b - y - z + w  # what the other program's equations lack
        # predictor: straight for the optimum
        base = z - w + slack
        db = equations(q, -(lack + x.T @ (q * base)))
        da = -q * (x @ db + base)
        dz, dw = -z - z * da / a, -w + w * da / u
        step_a, step_z = min(_longest(a, da), _longest(u, -da)), min(_longest(z, dz), _longest(w, dw))
        ahead = float((z + step_z * dz) @ (a + step_a * da) + (w + step_z * dw) @ (u - step_a * da))
        mu = gap / (2 * len(y)) * (ahead / gap) ** 3
        # corrector: towards the centre, with the products of the predicted steps
        cz, cw = (mu - da * dz) / a, (mu + da * dw) / u
        base = cw - cz + z - w + slack
        db = equations(q, -(lack + x.T @ (q * base)))
        da = -q * (x @ db + base)
        dz, dw = cz - z - z * da / a, cw - w + w * da / u
        step_a, step_z = min(_longest(a, da), _longest(u, -da)), min(_longest(z, dz), _longest(w, dw))
        a, u = a + step_a * da, u - step_a * da
        b, z, w = b + step_z * db, z + step_z * dz, w + step_z * dw
    return b * unit, max_iter, a


def check_loss(r: np.ndarray, tau: float) -> float:
    return float(np.sum(np.where(r < 0, tau - 1, tau) * r))


def fit(x: np.ndarray, y: np.ndarray, tau: float, max_iter: int = 1000) -> dict:
    """Coefficients with robust standard errors (Epanechnikov kernel, Hall-Sheather bandwidth), t, p and pseudo R2."""
    b, used = solve(x, y, tau, max_iter)
    n, k = x.shape
    r = y - x @ b
    width = _sparsity(n, tau, float(np.std(y)), float(np.subtract(*np.percentile(r, [75, 25]))))
    u = r / width
    dens = np.where(np.abs(u) <= 1, 0.75 * (1 - u * u), 0.0)
    # rows on the plane, to within rounding, are none above it
    d = np.where(r > NEAR * float(np.std(y)), tau / max(1e-12, float(np.mean(dens) / width)), (1 - tau) / max(1e-12, float(np.mean(dens) / width))) ** 2
    inv = np.linalg.pinv(x.T @ x)
    se = np.sqrt(np.maximum(np.diag(inv @ ((x * d[:, None]).T @ x) @ inv), 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        t = b / se
    null = y - np.quantile(y, tau)
    return {"coef": b, "std_err": se, "t": t, "p": np.array([student_p(float(v), n - k) for v in t]), "pseudo_r2": 1 - check_loss(r, tau) / max(check_loss(null, tau), 1e-300), "n": n, "iterations": used}


def distributed_fit(df: DataFrame, x: list[str], y: str, tau: float, max_iter: int = 100, tol: float = 1e-6) -> tuple[np.ndarray, int]:
    """As solve(), for a DataFrame of any size: each iteration is one pass that sums a weighted Gram block."""
    rows = df.select(F.lit(1.0).alias("const"), *[F.col(c).cast("double").alias(c) for c in x], F.col(y).cast("double").alias(y)).persist()
    try:
        k = 1 + len(x)
        g = gram(rows, ["const", *x, y])
        b = np.linalg.lstsq(g[:k, :k], g[:k, k], rcond=None)[0]
        seen: list[np.ndarray] = []
        for i in range(1, max_iter + 1):
            r = _residual(x, y, b)
            w = F.when(r < 0, 1 - tau).otherwise(tau) / F.greatest(F.abs(r), F.lit(CLAMP))
            g = gram(rows.withColumn("_w", w), ["const", *x, y], "_w")
            new = np.linalg.lstsq(g[:k, :k], g[:k, k], rcond=None)[0]
            if np.max(np.abs(new - b)) < tol or i > 50 and any(np.max(np.abs(new - s)) < tol * 1e-2 for s in seen):
                return _vertex(rows, x, y, tau, new)[0], i
            seen = (seen + [new])[-10:]
            b = new
            if i % 10 == 0:  # the plane that the steps tend to may be found long before they arrive
                exact, optimal = _vertex(rows, x, y, tau, b)
                if optimal:
                    return exact, i
        return _vertex(rows, x, y, tau, b)[0], max_iter
    finally:
        rows.unpersist()


def _vertex(rows: DataFrame, x: list[str], y: str, tau: float, b: np.ndarray) -> tuple[np.ndarray, bool]:
    """The plane through the rows nearest to that of ``b``, if its check loss is no higher (else b), and whether it is an optimum.

    It is one if the slopes of the loss of all other rows are balanced by weights of tau - 1 .. tau on the rows that the plane goes through.
    """
    k, r = len(b), _residual(x, y, b)
    near = np.array([list(v) for v in rows.orderBy(F.abs(r), *x, y).select("const", *x, y).limit(8 * k).collect()])
    chosen: list[int] = []
    for i in range(len(near)):
        if np.linalg.matrix_rank(near[[*chosen, i], :k]) > len(chosen):
            chosen.append(i)
    if len(chosen) < k:
        return b, False
    through = near[chosen, :k]
    exact = np.linalg.solve(through, near[chosen, k])
    loss = lambda e: F.sum(F.when(e < 0, tau - 1).otherwise(tau) * e)
    e = _residual(x, y, exact)
    far = F.abs(e) > 1e-9 * (1 + F.abs(F.col(y)))
    slopes = [F.sum(F.when(far, F.when(e < 0, tau - 1).otherwise(tau) * F.col(c)).otherwise(0.0)) for c in ("const", *x)]
    old, new, *slope = rows.agg(loss(r), loss(e), *[g.alias(f"g{i}") for i, g in enumerate(slopes)]).first()
    if new > old:
        return b, False
    weights = np.linalg.solve(through.T, -np.array(slope))
    return exact, bool(np.all((weights >= tau - 1 - 1e-9) & (weights <= tau + 1e-9)))


def _residual(x: list[str], y: str, b: np.ndarray) -> Column:
    r = F.col(y) - F.lit(float(b[0]))
    for c, v in zip(x, b[1:]):
        r = r - F.lit(float(v)) * F.col(c)
    return r


def _sparsity(n: int, tau: float, spread: float, iqr: float) -> float:
    """Width of the kernel of the robust standard errors (Hall-Sheather bandwidth)."""
    norm = NormalDist()
    z, q = norm.inv_cdf(0.975), norm.inv_cdf(tau)
    h = n ** (-1 / 3) * z ** (2 / 3) * (1.5 * norm.pdf(q) ** 2 / (2 * q * q + 1)) ** (1 / 3)
    h = min(h, tau / 2, (1 - tau) / 2) if not 0 < tau - h < tau + h < 1 else h
    return min(spread, iqr / 1.34) * (norm.inv_cdf(tau + h) - norm.inv_cdf(tau - h)) or 1.0


def distributed_model(df: DataFrame, x: list[str], y: str, tau: float, max_iter: int = 1000) -> dict:
    """As fit(), for a DataFrame of any size: standard errors from summed Gram blocks, quartiles by bracketing."""
    rows = df.select(F.lit(1.0).alias("const"), *[F.col(c).cast("double").alias(c) for c in x], F.col(y).cast("double").alias(y)).persist()
    try:
        b, used = distributed_fit(rows, x, y, tau, max_iter)
        k, r = 1 + len(x), F.col("_r")
        rows_r = rows.withColumn("_r", _residual(x, y, b))
        at = {q["prob"]: q["quantile"] for q in exact_quantiles(rows_r, [], "_r", [0.25, 0.75]).collect()}
        null = exact_quantiles(rows, [], y, [tau]).first()["quantile"]
        loss = lambda e: F.sum(F.when(e < 0, tau - 1).otherwise(tau) * e)
        s = rows_r.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(y).alias("sd"), loss(r).alias("loss"), loss(F.col(y) - F.lit(null)).alias("null")).first()
        width = _sparsity(s["n"], tau, s["sd"], at[0.75] - at[0.25])
        u = r / F.lit(width)
        dens = max(1e-12, rows_r.agg(F.avg(F.when(F.abs(u) <= 1, 0.75 * (1 - u * u)).otherwise(0.0))).first()[0] / width)
        d = F.when(r > F.lit(NEAR * s["sd"]), F.lit((tau / dens) ** 2)).otherwise(F.lit(((1 - tau) / dens) ** 2))
        inv = np.linalg.pinv(gram(rows, ["const", *x]))
        se = np.sqrt(np.maximum(np.diag(inv @ gram(rows_r.withColumn("_w", d), ["const", *x], "_w") @ inv), 0))
    finally:
        rows.unpersist()
    with np.errstate(divide="ignore", invalid="ignore"):
        t = b / se
    return {"coef": b, "std_err": se, "t": t, "p": np.array([student_p(float(v), s["n"] - k) for v in t]), "pseudo_r2": 1 - s["loss"] / max(s["null"], 1e-300), "n": s["n"], "iterations": used}


def _matrix(pdf: pd.DataFrame, terms: list[str], y: str) -> tuple[np.ndarray, np.ndarray]:
    return np.column_stack([np.ones(len(pdf)), *[pdf[t].to_numpy(float) for t in terms]]), pdf[y].to_numpy(float)


COEF_SCHEMA = "panel string, spec string, model string, tau double, term string, coef double, std_err double, t_or_z double, p double, rsquared double, pseudo_r2 double, n bigint"


def estimation_grid(df: DataFrame, panel: str, specs: dict[str, list[str]], y: str, taus: list[float], most_rows: int = MOST_ROWS) -> DataFrame:
    """Long coefficient table of every panel, spec and model (OLS and one quantile model per tau).

    One task per panel, spec and model; a panel of more than ``most_rows`` rows is fitted in the cluster instead.  Rows with a
    missing value in the terms of any spec are left out, rows with an infinite one from the specs that have the term.
    """
    needed = sorted({t for terms in specs.values() for t in terms})
    grid = [(s, "ols", None) for s in specs] + [(s, f"qr_{t:g}", t) for s in specs for t in taus]
    models = F.explode(F.array(*[F.struct(F.lit(s).alias("spec"), F.lit(m).alias("model"), F.lit(t).cast("double").alias("tau")) for s, m, t in grid])).alias("m")
    rows = df.select(F.col(panel).alias("panel"), *needed, y)
    for c in (*needed, y):
        rows = rows.filter(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    # a panel that one task cannot hold never goes to it
    large = [r["panel"] for r in rows.groupBy("panel").count().filter(F.col("count") > most_rows).orderBy("panel").collect()]
    names_of = [c.split()[0] for c in COEF_SCHEMA.split(", ")]
    far = []
    for p, (spec, model, tau) in ((p, m) for p in large for m in grid):
        terms = specs[spec]
        of = rows.filter(F.col("panel").eqNullSafe(F.lit(p)))
        for c in (*terms, y):
            of = of.filter(F.abs(F.col(c).cast("double")) < float("inf"))
        if tau is None:
            f = ols(of, terms, y)
            far += [(p, spec, model, None, term, b, s, t, q, float(f.r2), None, f.n) for term, b, s, t, q in f.rows()]
        else:
            f = distributed_model(of, terms, y, tau)
            far += [(p, spec, model, tau, *map(lambda v: v if isinstance(v, str) else float(v), z), None, float(f["pseudo_r2"]), f["n"]) for z in zip(["const", *terms], f["coef"], f["std_err"], f["t"], f["p"])]
    for p in large:
        rows = rows.filter(~F.col("panel").eqNullSafe(F.lit(p)))
    long = rows.select("*", models).select("panel", "m.*", *needed, y)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf.iloc[0]
        terms = specs[head["spec"]]
        pdf = pdf.sort_values([*terms, y], kind="stable")  # the sums must not hang on the order of arrival
        pdf = pdf[np.isfinite(pdf[[*terms, y]].to_numpy(float)).all(axis=1)]
        x, v = _matrix(pdf, terms, y)
        names = ["const", *terms]
        if len(v) <= len(names):
            return pd.DataFrame(columns=names_of)
        if head["model"] == "ols":
            b = np.linalg.lstsq(x, v, rcond=None)[0]
            r = v - x @ b
            s2 = float(r @ r) / (len(v) - len(names))
            se = np.sqrt(np.maximum(np.diag(np.linalg.pinv(x.T @ x)) * s2, 0))
            t = b / se
            out = {"coef": b, "std_err": se, "t_or_z": t, "p": [student_p(float(z), len(v) - len(names)) for z in t], "rsquared": 1 - float(r @ r) / float(((v - v.mean()) ** 2).sum()), "pseudo_r2": None}
        else:
            f = fit(x, v, float(head["tau"]))
            out = {"coef": f["coef"], "std_err": f["std_err"], "t_or_z": f["t"], "p": f["p"], "rsquared": None, "pseudo_r2": f["pseudo_r2"]}
        base = {"panel": head["panel"], "spec": head["spec"], "model": head["model"], "tau": head["tau"], "term": names, "n": len(v)}
        return pd.DataFrame(base | out)[names_of]

    near = long.groupBy("panel", "spec", "model").applyInPandas(run, COEF_SCHEMA)
    return near.unionByName(df.sparkSession.createDataFrame(far, COEF_SCHEMA)) if far else near


def headline(coefs: DataFrame, term: str | list[str], low: float = 0.5, high: float = 0.9) -> DataFrame:
    """panel, spec, beta_low, beta_high and diff = beta_high - beta_low of one term, or of the one of several that a spec has."""
    of = lambda t: F.max(F.when(F.col("tau") == t, F.col("coef")))
    out = coefs.filter(F.col("term").isin(term)).groupBy("panel", "spec").agg(of(low).alias("beta_low"), of(high).alias("beta_high"))
    return out.withColumn("diff", F.col("beta_high") - F.col("beta_low"))


def coefficient_table(coefs: DataFrame, models: list[str]) -> DataFrame:
    """panel, spec, term and one text cell ``coef (t)`` per model."""
    cell = F.format_string("%.4f (%.1f)", "coef", "t_or_z")
    return coefs.withColumn("cell", cell).groupBy("panel", "spec", "term").pivot("model", models).agg(F.first("cell"))


def _blocks(n: int, mean_length: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths, n in all, of the blocks of a stationary block resample: uniform starts, geometric lengths; a block may run over the end."""
    lengths = starts = np.empty(0, dtype=np.int64)
    while (have := int(lengths.sum())) < n:
        more = int((n - have) / mean_length * 1.1) + 16
        lengths, starts = np.r_[lengths, rng.geometric(1.0 / mean_length, more)], np.r_[starts, rng.integers(n, size=more)]
    ends = np.cumsum(lengths)
    last = int(np.searchsorted(ends, n)) + 1
    first = np.r_[0, ends[: last - 1]]
    return starts[:last], np.minimum(ends[:last], n) - first


def _positions(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The n positions of blocks, wrapped around the end."""
    return (np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(n)) % max(n, 1)


def block_indices(n: int, mean_length: float, rng: np.random.Generator) -> np.ndarray:
    """n positions of a stationary block resample: uniform starts, geometric lengths, wrapped around the end."""
    return _positions(n, *_blocks(n, mean_length, rng))


def _corner(x: np.ndarray, y: np.ndarray, tau: float, weights: np.ndarray, b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The plane through the rows whose dual weights ``a`` are off their bounds, if it is an optimum; else b."""
    k = x.shape[1]
    inside = np.minimum(a, weights - a) / weights
    on = np.argpartition(-inside, k - 1)[:k]
    try:
        exact = np.linalg.solve(x[on], y[on])
        above = y > x @ exact
        above[on] = False
        dual = np.linalg.solve(x[on].T, (1 - tau) * (weights @ x) - (weights * above) @ x)
    except np.linalg.LinAlgError:
        return b
    slack = 1e-7 * weights[on]
    return exact if np.all((dual >= -slack) & (dual <= weights[on] + slack)) else b


class _Resample:
    """A resample as stretches first..last - 1 of rows; if a column is dealt anew also its rows ``at``, with the values ``dealt``."""

    def __init__(self, first: np.ndarray, last: np.ndarray, at: np.ndarray | None = None, dealt: np.ndarray | None = None):
        self.first, self.last, self.at, self.dealt = first, last, at, dealt
        self.firsts, self.lasts = np.sort(first), np.sort(last)
        self.total: np.ndarray | None = None

    @classmethod
    def of(cls, at: np.ndarray, dealt: np.ndarray | None = None) -> _Resample:
        cut = np.flatnonzero(np.diff(at) != 1)
        return cls(at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]] + 1, at, dealt)

    @classmethod
    def of_blocks(cls, n: int, starts: np.ndarray, lengths: np.ndarray, at: np.ndarray | None = None, dealt: np.ndarray | None = None) -> _Resample:
        first, last = starts, starts + lengths
        while (over := last > n).any():
            first, last = np.r_[first, np.zeros(over.sum(), dtype=np.int64)], np.r_[np.minimum(last, n), last[over] - n]
        return cls(first, last, at, dealt)

    def counts(self, i: np.ndarray) -> np.ndarray:
        """How often each row of i is there."""
        return (np.searchsorted(self.firsts, i, "right") - np.searchsorted(self.lasts, i, "right")).astype(float)

    def sums(self, running: np.ndarray) -> np.ndarray:
        """Sums over the rows, from running sums over the panel."""
        return (running[self.last] - running[self.first]).sum(axis=0)


def _running(rows: np.ndarray, where: np.ndarray | None = None) -> np.ndarray:
    """Sums of the rows (those ``where``) before each row, and of all."""
    out = np.zeros((len(rows) + 1, rows.shape[1]))
    np.cumsum(rows if where is None else rows * where[:, None], axis=0, out=out[1:])
    return out


class _Resamples:
    """Fits of resamples of a panel, each the optimum on all its rows.

    Most rows of a resample stay on their side of the panel's own plane ``at``.  Those further from it than a radius are put together, one row of their sums a side (the
    check loss of such a row is theirs as long as none changes sides), and the rows near it are solved for (after Portnoy and Koenker, 1997, and Chernozhukov,
    Fernandez-Val and Melly, 2020).  |x'd| <= |x white| |root d| proves that none has changed sides; else the radius grows, up to all rows.  Of the near rows, those far
    from the plane that one Newton step gives are put together too, until no sign among the near rows differs; each further search begins at the plane found last.
    The sums of a resample are differences of running sums over its blocks, so that a draw costs its blocks and near rows, not all rows.
    With ``column`` the planes are those without that column, whose values may be dealt anew.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, planes: dict[float, np.ndarray], column: int | None = None, max_iter: int = 5000):
        n, k = x.shape
        self.rows, self.planes, self.column, self.max_iter = np.column_stack([x, y, np.ones(n)]), planes, column, max_iter
        self.middle = float(x[:, column].mean()) if column is not None and np.all(x[:, 0] == 1) else 0.0
        rest = [i for i in range(k) if i != column]
        self.root, white = _metric(x[:, rest])
        self.rest, self.size = rest, 1.0
        self.reach = ((x[:, rest] @ white) ** 2).sum(axis=1)
        own = most_own = 0.0
        if column is not None:
            self.size = float(np.sqrt(np.mean((x[:, column] - self.middle) ** 2))) or 1.0
            own = ((x[:, column] - self.middle) / self.size) ** 2
            most_own = float(own.max())
        self.r = {tau: y - x @ b for tau, b in planes.items()}
        self.radius, self.far, self.bend, self.nearest = {}, {}, {}, {}
        self.running, self.running_up = _running(self.rows), {tau: _running(self.rows, r > 0) for tau, r in self.r.items()}
        first = min(n, int(5 * math.sqrt(k * n)) + 50) - 1
        span = np.sqrt(self.reach + own)
        for tau, r in self.r.items():
            far = self._over(r, span)
            self.radius[tau] = float(np.partition(far, first)[first])
            near = far <= self.radius[tau]
            # rows within a width, over that width, estimate the density on the plane: how the slopes of the loss change with it
            width = 2 * self.radius[tau] * span[near]
            self.bend[tau] = np.linalg.pinv((x[near] / np.maximum(width, 1e-300)[:, None]).T @ x[near])
            # the least radius within which a row may lie, whatever is dealt to it
            self.far[tau] = far if column is None else self._over(r, np.sqrt(self.reach + most_own))

    @staticmethod
    def _over(r: np.ndarray, span: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.nan_to_num(np.abs(r) / span, nan=np.inf)

    def moved(self, tau: float, b: np.ndarray) -> float:
        """|root d| of b and the panel's plane."""
        d = b - self.planes[tau]
        if self.column is None:
            return float(np.linalg.norm(self.root @ d))
        own = d[self.column]
        d[0] += self.middle * own if self.column else 0.0
        return float(np.hypot(np.linalg.norm(self.root @ d[self.rest]), self.size * own))

    def _near(self, tau: float, radius: float) -> tuple[np.ndarray, ...]:
        """The panel's rows within the radius: positions, equal rows side by side, where each different row begins, these rows, their spans, which are above; with a column flags of all rows."""
        if (tau, radius) not in self.nearest:
            flags = self.far[tau] <= radius
            if self.column is None:
                i = np.flatnonzero(flags)
                # equal rows have equal sums; those that are equal by chance are told apart below
                i = i[np.argsort((self.rows[i] * np.sqrt(np.arange(2, self.rows.shape[1] + 2))).sum(axis=1), kind="stable")]
                begin = np.flatnonzero(np.r_[True, (self.rows[i[1:]] != self.rows[i[:-1]]).any(axis=1)]) if len(i) else i
                first = i[begin]
                self.nearest[tau, radius] = i, begin, self.rows[first], np.sqrt(self.reach[first]), self.r[tau][first] > 0
            else:
                self.nearest[tau, radius] = (flags,)
        return self.nearest[tau, radius]

    def fit(self, tau: float, at: np.ndarray | _Resample, dealt: np.ndarray | None = None) -> tuple[np.ndarray, int]:
        """Coefficients and iterations on the rows ``at``, with the values ``dealt`` in the column if it has one."""
        drawn = at if isinstance(at, _Resample) else _Resample.of(at, dealt)
        radius, r, k, c = self.radius[tau], self.r[tau], len(self.planes[tau]), self.column
        if drawn.total is None:
            drawn.total = drawn.sums(self.running)
            if drawn.dealt is not None:
                drawn.total[c] = drawn.dealt.sum()
        total, up_total = drawn.total, drawn.sums(self.running_up[tau])
        if drawn.dealt is not None:
            up_total[c] = drawn.dealt @ (r > 0).astype(float)[drawn.at]
        guess = None
        while True:
            if drawn.dealt is not None:
                j = np.flatnonzero(self._near(tau, radius)[0][drawn.at])
                i, values = drawn.at[j], drawn.dealt[j]
                reach = self.reach[i] + ((values - self.middle) / self.size) ** 2
                ok = ~(r[i] * r[i] > radius * radius * reach)
                i, size = i[ok], np.sqrt(reach[ok])
                near, weights, up = self.rows[i], np.ones(len(i)), r[i] > 0
                near[:, c] = values[ok]
            else:
                i, begin, near, size, up = self._near(tau, radius)
                weights = np.add.reduceat(drawn.counts(i), begin) if len(i) else np.zeros(0)
                there = weights > 0
                near, weights, size, up = near[there], weights[there], size[there], up[there]
            inside = weights @ near
            above = up_total - (weights * up) @ near
            below = total - above - inside
            far = above[-1] + below[-1] > 0.5
            if guess is None:
                slope = tau * total[:k] - below[:k] - (weights * ~up) @ near[:, :k]
                guess = self.planes[tau] + self.bend[tau] @ slope
                if far and 1.3 * self.moved(tau, guess) >= radius:
                    radius = self._wider(tau, radius, guess)
                    continue
            b, used, done = self._among(tau, near, weights, size, above, below, guess, radius if far else math.inf)
            if done:
                return b, used
            radius, guess = self._wider(tau, radius, b), b

    def _wider(self, tau: float, radius: float, b: np.ndarray) -> float:
        """Twice, four times, ... the radius, so that the rows within one are found once, or all rows."""
        times = 1.3 * self.moved(tau, b) / radius if radius > 0 else math.inf
        return radius * 2 ** max(1, math.ceil(math.log2(max(times, 1)))) if times < 1e9 else math.inf

    def _among(self, tau: float, near: np.ndarray, weights: np.ndarray, size: np.ndarray, above: np.ndarray, below: np.ndarray, guess: np.ndarray, radius: float) -> tuple[np.ndarray, int, bool]:
        """Coefficients and iterations on rows near the plane and the sums of the others, and whether they lie within ``radius``, else a better guess at its border.

        ``guess``: about the plane sought, ``size``: how far the rows lie out.  With most rows put together the loss is too low but near the guess, so that the plane found may lie
        beyond the one sought: the next guess is where the loss of all rows is least on the way there.
        """
        k = len(guess)
        x, y = np.ascontiguousarray(near[:, :k]), near[:, k]
        size = np.maximum(size, 1e-300)
        keep = np.zeros(len(y), dtype=bool)
        off, few = y - x @ guess, FEW_ROWS
        while True:
            up = off > 0
            apart = np.abs(off) / size
            keep |= apart <= np.partition(apart, few)[few] if len(y) > few else True
            sums = [a + (weights * m) @ near for a, m in ((above, up & ~keep), (below, ~up & ~keep))]
            sums = np.array([s for s in sums if s[-1] > 0.5]).reshape(-1, k + 2)
            xx, yy, ww = np.vstack([x[keep], sums[:, :k] / sums[:, -1:]]), np.r_[y[keep], sums[:, k] / sums[:, -1]], np.r_[weights[keep], sums[:, -1]]
            b, used, a = _interior(xx, yy, tau, least := min(self.max_iter, 50), weights=ww, start=guess)
            if used == least:
                b, used, a = _interior(xx, yy, tau, self.max_iter, weights=ww)
            if used < self.max_iter:
                b = _corner(xx, yy, tau, ww, b, a)
            elif radius == math.inf and keep.all():
                return b, used, True
            there = self.moved(tau, b)
            if there < radius and (keep.all() or not (~keep & ((y > x @ b) != up)).any()):
                return b, used, True
            few *= 2
            if not np.isfinite(b).all():
                if keep.all():
                    return guess, used, False
                continue
            step = self._way(tau, x, weights, off, b - guess, above[:k], below[:k])
            now = self.moved(tau, guess)
            most = (radius - now) / (there - now) if there >= radius else 1.0
            guess = guess + min(step, most) * (b - guess)
            if step > most or there >= radius and keep.all():
                return guess, used, False
            off = y - x @ guess

    @staticmethod
    def _way(tau: float, x: np.ndarray, weights: np.ndarray, off: np.ndarray, d: np.ndarray, above: np.ndarray, below: np.ndarray) -> float:
        """The share, at most 1, of the way d from rows ``off`` the plane at which the loss is least."""
        xd = x @ d
        up = np.where(off == 0, xd < 0, off > 0)
        slope = (1 - tau) * (below @ d) - tau * (above @ d) - weights @ (np.where(up, tau, tau - 1) * xd)
        i = np.flatnonzero((off * xd > 0) & (np.abs(off) < np.abs(xd)))
        at = off[i] / xd[i]
        order = np.argsort(at)
        slopes = slope + np.cumsum((weights[i] * np.abs(xd[i]))[order])
        if slope >= 0:
            return 0.0
        first = int(np.searchsorted(slopes, 0.0))
        return float(at[order[first]]) if first < len(i) else 1.0


def _metric(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """root and white, with |x'd| <= |x white| |root d| for the rows of x; raises LinAlgError if columns are collinear."""
    scale = np.sqrt(np.mean(x * x, axis=0))
    scale[scale == 0] = 1.0
    values, vectors = np.linalg.eigh((x / scale).T @ (x / scale) / len(x))
    if values[0] < 1e-10 * values[-1]:
        raise np.linalg.LinAlgError("collinear columns")
    return (vectors * np.sqrt(values)).T * scale, vectors / np.sqrt(values) / scale[:, None]


def _plane(x: np.ndarray, y: np.ndarray, tau: float, max_iter: int) -> tuple[np.ndarray, int]:
    """As solve(), for many rows: from the plane of evenly spaced rows."""
    step = len(y) // (1000 + int(len(y) ** (2 / 3)))
    if step < 2:
        return solve(x, y, tau, max_iter)
    return _Resamples(x, y, {tau: solve(x[::step], y[::step], tau, max_iter)[0]}, max_iter=max_iter).fit(tau, np.arange(len(y)))


DRAW_SCHEMA = "label string, mode string, draw_idx bigint, diff double, beta_50 double, beta_90 double, converged boolean"
FEW_ROWS = 500  #: rows of a panel whose draws are fitted whole


def bootstrap(spark: SparkSession, x: np.ndarray, y: np.ndarray, draws: dict[str, int], label: str, seed: int, mean_length: float = 30, column: int = 1, max_iter: int = 5000) -> DataFrame:
    """Draws of beta(.9) - beta(.5) of one column: DRAW_SCHEMA with a row ``point`` (draw_idx -1).

    draws: mode -> number, modes ``real`` and ``placebo`` (the column is permuted after resampling).  Rows of x and y must be in time order.
    Each draw has its own random stream, so results do not hang on partitioning.  x and y go to every task: at most MOST_ROWS rows.
    """
    if len(y) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows")
    taus, planes, rest = (0.5, 0.9), None, [i for i in range(x.shape[1]) if i != column]
    if len(y) > FEW_ROWS:
        try:
            _metric(x)
            planes = {t: _plane(x, y, t, max_iter) for t in taus}
            without = {t: np.insert(_plane(x[:, rest], y, t, max_iter)[0], column, 0.0) for t in taus} if draws.get("placebo") else {}
        except np.linalg.LinAlgError:  # collinear columns: every draw is fitted whole
            planes = None
    shared = spark.sparkContext.broadcast((x, y, planes and (planes, without)))
    modes = [("point", 1), *draws.items()]
    tasks = [(m, i) for m, n in modes for i in range(n)]
    # slices of neighbouring draws: most tasks have draws of one mode
    todo = spark.range(0, len(tasks), 1, max(1, min(len(tasks), 4 * spark.sparkContext.defaultParallelism)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y, planes = shared.value
        fits = {}

        def fitted(mode: str, starts: np.ndarray, lengths: np.ndarray, rng: np.random.Generator) -> list[tuple[np.ndarray, int]]:
            if planes and mode == "real":
                if mode not in fits:
                    fits[mode] = _Resamples(x, y, {t: b for t, (b, _) in planes[0].items()}, max_iter=max_iter)
                drawn = _Resample.of_blocks(len(y), starts, lengths)
                return [fits[mode].fit(t, drawn) for t in taus]
            at = _positions(len(y), starts, lengths)
            dealt = rng.permutation(x[at, column]) if mode == "placebo" else None
            if planes is None:
                xx = x[at]
                if dealt is not None:
                    xx[:, column] = dealt
                return [solve(xx, y[at], t, max_iter) for t in taus]
            if mode not in fits:
                fits[mode] = _Resamples(x, y, planes[1], column, max_iter)
            drawn = _Resample.of_blocks(len(y), starts, lengths, at, dealt)
            return [fits[mode].fit(t, drawn) for t in taus]

        for batch in batches:
            rows = []
            for j in batch.column("id").to_pylist():
                mode, i = tasks[j]
                if mode == "point":
                    i = -1
                    (b5, n5), (b9, n9) = [planes[0][t] for t in taus] if planes else [solve(x, y, t, max_iter) for t in taus]
                else:
                    rng = np.random.default_rng(np.random.SeedSequence([seed, *label.encode(), len(mode), i]))
                    (b5, n5), (b9, n9) = fitted(mode, *_blocks(len(y), mean_length, rng), rng)
                rows.append((label, mode, i, float(b9[column] - b5[column]), float(b5[column]), float(b9[column]), n5 < max_iter and n9 < max_iter))
            names = [c.split()[0] for c in DRAW_SCHEMA.split(", ")]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows])

    return todo.mapInArrow(run, DRAW_SCHEMA)


def number_draws(draws: DataFrame) -> DataFrame:
    """The long draw table: converged draws numbered anew from 0 per label and mode, the point row -1."""
    over = W.partitionBy("label", "mode").orderBy("draw_idx")
    good = draws.filter("converged").withColumn("draw_idx", F.when(F.col("mode") == "point", F.lit(-1)).otherwise(F.row_number().over(over) - 1).cast("bigint"))
    return good.drop("converged")


def inference(draws: DataFrame) -> DataFrame:
    """label, n, theta, percentile and basic intervals, one-sided p, excludes_zero, and the place of theta among placebo draws."""
    good = draws.filter("converged")
    theta = good.filter(F.col("mode") == "point").groupBy("label").agg(F.first("diff").alias("theta"))
    real = good.filter(F.col("mode") == "real").groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.percentile("diff", F.lit(0.025)).alias("lo"), F.percentile("diff", F.lit(0.975)).alias("hi"), F.avg("diff").alias("mean"), F.stddev_samp("diff").alias("std"),
        F.count_if(F.col("diff") >= 0).alias("_pos"),
    )
    null = good.filter(F.col("mode") == "placebo").join(theta, "label").groupBy("label").agg(
        F.count(F.lit(1)).alias("n_placebo"), F.avg("diff").alias("placebo_mean"), F.stddev_samp("diff").alias("placebo_std"), F.avg((F.col("diff") <= F.col("theta")).cast("double")).alias("placebo_share")
    )
    out = theta.join(real, "label", "left").join(null, "label", "left")
    return out.select(
        "label", "theta", "n", "lo", "hi", (2 * F.col("theta") - F.col("hi")).alias("basic_lo"), (2 * F.col("theta") - F.col("lo")).alias("basic_hi"), "mean", "std",
        ((F.col("_pos") + 1) / (F.col("n") + 1)).alias("p_one_sided"), (F.col("hi") < 0).alias("excludes_zero"),
        "n_placebo", "placebo_mean", "placebo_std", F.try_divide(F.col("theta") - F.col("placebo_mean"), F.col("placebo_std")).alias("placebo_z"), "placebo_share",
    )
