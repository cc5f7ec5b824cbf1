"""Least squares, residuals, winsorising and correlations, from sufficient statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.operators.quantiles import exact_quantiles

MOST_CATEGORIES = 2000


def student_p(t: float, df: float) -> float:
    """Two-sided p-value of Student's t, by the incomplete beta function."""
    if not (math.isfinite(t) and df > 0):
        return math.nan
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        x, a, b = 1 - x, b, a
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a if x > 0 else 0.0
    # continued fraction, Lentz's method
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / (1 + num * d or tiny)
        c = 1 + num / c or tiny
        h *= d * c
        num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or tiny)
        c = 1 + num / c or tiny
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            break
    out = front * h
    return 1 - out if flip else out


def gram(df: DataFrame, columns: list[str], weights: str | None = None) -> np.ndarray:
    """Z'Z of the numeric ``columns`` over all rows, summed in the cluster: every task sends one k x k block, the driver gets k * k numbers.

    Rows with a null or NaN must be left out before.
    """
    k = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for b in batches:
            z = np.column_stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns]) if b.num_rows else np.zeros((0, k))
            total += z.T @ (z * b.column(weights).to_numpy(zero_copy_only=False)[:, None] if weights else z)
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(k * k)), "v": pa.array(total.ravel())})

    used = df.select(*[F.col(c).cast("double").alias(c) for c in columns], *([weights] if weights else []))
    out = np.zeros(k * k)
    for r in used.mapInArrow(run, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    return out.reshape(k, k)


@dataclass
class Fit:
    """A least-squares fit; ``table`` has coef, std_err, t, p by term."""

    terms: list[str]
    coef: np.ndarray
    std_err: np.ndarray
    n: int
    r2: float
    r2_adj: float

    def rows(self) -> list[tuple[str, float, float, float, float]]:
        dof = self.n - len(self.terms)
        out = []
        for term, b, s in zip(self.terms, self.coef, self.std_err):
            t = b / s if s > 0 else math.nan
            out.append((term, float(b), float(s), float(t), float(student_p(float(t), dof))))
        return out


def ols(df: DataFrame, x: list[str], y: str) -> Fit:
    """Ordinary least squares of y on a constant and x; collinear columns get the solution of least norm."""
    rows = df.select(F.lit(1.0).alias("const"), *x, y)
    g = gram(rows, ["const", *x, y])
    n, k = int(round(g[0, 0])), 1 + len(x)
    xx, xy, yy = g[:k, :k], g[:k, k], g[k, k]
    # scaled to unit diagonal, so that the rank does not hang on units
    s = np.sqrt(np.where(np.diag(xx) > 0, np.diag(xx), 1.0))
    inv = np.linalg.pinv(xx / np.outer(s, s), rcond=1e-12, hermitian=True) / np.outer(s, s)
    b = inv @ xy
    rank = np.linalg.matrix_rank(xx / np.outer(s, s), tol=1e-10, hermitian=True)
    rss = max(float(yy - 2 * b @ xy + b @ xx @ b), 0.0)
    tss = float(yy - g[0, k] ** 2 / n) if n else math.nan
    sigma2 = rss / (n - rank) if n > rank else math.nan
    r2 = 1 - rss / tss if tss > 0 else math.nan
    return Fit(["const", *x], b, np.sqrt(np.maximum(np.diag(inv), 0) * sigma2), n, r2, 1 - (1 - r2) * (n - 1) / (n - rank) if n > rank else math.nan)


@dataclass
class Design:
    """Numeric terms and dummies of training categories; the reference category of each has no term, nor have unseen ones."""

    numeric: list[str]
    dummies: dict[str, list] = field(default_factory=dict)

    def columns(self) -> dict[str, Column]:
        out = {f"x_{c}": F.col(c).cast("double") for c in self.numeric}
        for c, values in self.dummies.items():
            for i, v in enumerate(values):
                out[f"x_{c}_{i}"] = F.when(F.col(c) == F.lit(v), 1.0).otherwise(0.0)
        return out

    def names(self) -> dict[str, str]:
        """Term names of the columns."""
        out = {f"x_{c}": c for c in self.numeric}
        for c, values in self.dummies.items():
            out |= {f"x_{c}_{i}": f"{c}[{v}]" for i, v in enumerate(values)}
        return out


def categories(df: DataFrame, column: str) -> list[tuple[object, int]]:
    """Values and counts, in order of value; raises beyond MOST_CATEGORIES."""
    rows = df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(column).limit(MOST_CATEGORIES + 1).collect()
    if len(rows) > MOST_CATEGORIES:
        raise ValueError(f"{column} has more than {MOST_CATEGORIES} values")
    return [(r[0], r[1]) for r in rows]


def usable(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows where no column is null or NaN."""
    for c, kind in df.select(*columns).dtypes:
        df = df.filter(F.col(c).isNotNull() & ~F.isnan(c) if kind in ("double", "float") else F.col(c).isNotNull())
    return df


def residualize(df: DataFrame, y: str, numeric: list[str], train_start: str, train_end: str, cap: str | None = None, sector: str = "sector") -> tuple[DataFrame, dict]:
    """Usable rows with {y}_resid (and {cap}_w, winsorised at the training p99): fit on the training dates, applied to all rows.

    Dummies: sectors but the most frequent of the training rows (of equals the alphabetically first), years but the first.
    Returns the frame and what was fitted: fit, sector_ref, year_ref, p99, n_train, design and rows.  The fit needs a few passes over the
    usable rows, which are persisted; info["rows"].unpersist() lets go of them.
    """
    rows = usable(df.withColumn("year", F.year("date").cast("bigint")), [y, *numeric, sector, "date"]).persist()
    train = rows.filter(F.col("date").between(F.lit(train_start).cast("date"), F.lit(train_end).cast("date")))
    sectors, years = categories(train, sector), categories(train, "year")
    if not sectors:
        raise ValueError("no training rows")
    most = max(n for _, n in sectors)
    sector_ref = next(s for s, n in sectors if n == most)
    year_ref = years[0][0]
    design = Design(numeric, {sector: [s for s, _ in sectors if s != sector_ref], "year": [v for v, _ in years if v != year_ref]})
    fit = ols(train.select(*[c.alias(n) for n, c in design.columns().items()], y), list(design.columns()), y)
    predicted = F.lit(float(fit.coef[0]))
    for b, c in zip(fit.coef[1:], design.columns().values()):
        predicted = predicted + F.lit(float(b)) * c
    out = rows.withColumn(f"{y}_resid", F.col(y) - predicted)
    info = {"fit": fit, "sector_ref": sector_ref, "year_ref": year_ref, "n_train": fit.n, "design": design, "p99": None, "rows": rows}
    if cap:
        top = exact_quantiles(train, [], cap, [0.99], "nearest").collect()
        info["p99"] = top[0]["quantile"] if top else None
        out = winsorize(out, cap, info["p99"])
    return out, info


def winsorize(df: DataFrame, column: str, top: float | None) -> DataFrame:
    """Adds {column}_w: at most ``top``; null and NaN stay."""
    c = F.col(column)
    return df.withColumn(f"{column}_w", c if top is None else F.when(c.isNull() | F.isnan(c), c).otherwise(F.least(c, F.lit(float(top)))))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, corr for all pairs, over the rows where no column is missing; null with under two rows or a constant column.

    One aggregate for all pairs.
    """
    rows = usable(df, columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    aggs = []
    for a, b in pairs:
        # not F.corr, which divides by zero for a constant column in ANSI mode
        corr = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
        aggs.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.when(F.count(F.lit(1)) > 1, corr).alias("corr")))
    return rows.agg(F.array(*aggs).alias("all")).select(F.explode("all").alias("p")).select("p.*")
