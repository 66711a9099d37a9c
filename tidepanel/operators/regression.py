"""Least squares from Spark aggregates (M1-M5, P25).

A design row has few non-zeros: the numeric columns and one level of each
factor.  Every Arrow batch adds its rows' products into one k x k array
(numpy, factors as level numbers, no dummy columns), and the arrays' rows
are summed by a grouped aggregate.  Only that k x k block reaches the
driver, where ``pinv`` gives the coefficients; with a rank-deficient design
this is the minimum-norm solution, the one a pseudo-inverse OLS reports.
Pass 2 does the same with the coefficients and G+: residual sum of squares,
total sum of squares and the "meat" sum x x' e^2 (HC0, HC1), for HC3 divided
by (1 - h)^2 with the leverage h = x' G+ x (MacKinnon & White 1985).  Both
passes cost a few products per row, whatever the number of levels.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .design import dummy_name, factor_levels

LEVERAGE_EPS = 1e-10


def predict(cols: Sequence[str], coef: Sequence[float]) -> Column:
    """x'b (P25)."""
    expr = F.lit(0.0)
    for c, w in zip(cols, coef):
        if w != 0.0:
            expr = expr + F.col(c).cast("double") * F.lit(float(w))
    return expr


def min_norm_inverse(g: np.ndarray, rcond: float = 1e-12):
    """Generalised inverses of a PSD Gram matrix with a scale-free rank
    decision.  The rank is read from the equilibrated matrix D G D
    (D = diag(G)^-1/2), so a column measured in small units is not taken
    for a null direction.  Returns (G-, G+, null, rank): the inverse of the
    equilibrated matrix mapped back (exact for everything the data identify,
    and well conditioned), its projection onto the range of G (the
    Moore-Penrose inverse, for minimum-norm coefficients), an orthonormal
    null-space basis as columns, and the rank."""
    k = g.shape[0]
    dg = np.diag(g).copy()
    d = np.where(dg > 0, 1.0 / np.sqrt(np.where(dg > 0, dg, 1.0)), 1.0)
    gs = g * d[:, None] * d[None, :]
    w, v = np.linalg.eigh(gs)
    keep = w > rcond * max(w.max(), 0.0)
    g_minus = (d[:, None] * (v[:, keep] / w[keep]) @ v[:, keep].T) * d[None, :]
    null = d[:, None] * v[:, ~keep]
    if not null.shape[1]:
        return g_minus, g_minus, np.zeros((k, 0)), k
    q, _ = np.linalg.qr(null)
    proj = np.eye(k) - q @ q.T
    return g_minus, proj @ g_minus @ proj, q, int(keep.sum())


@dataclass
class OLSResult:
    names: list[str]
    coef: np.ndarray
    cov: np.ndarray | None
    std_error: list
    z: list
    p_value: list
    identified: list[bool]
    rank: int
    n: int
    ssr: float
    sst: float
    cov_type: str

    @property
    def r_squared(self) -> float:
        return 1.0 - self.ssr / self.sst if self.sst > 0 else float("nan")

    @property
    def adj_r_squared(self) -> float:
        dfr = self.n - self.rank
        return 1.0 - (self.n - 1) / dfr * (1.0 - self.r_squared) if dfr > 0 else float("nan")

    @property
    def llf(self) -> float:
        n = self.n
        return -n / 2.0 * (math.log(2 * math.pi) + math.log(self.ssr / n) + 1.0)

    @property
    def aic(self) -> float:
        return -2.0 * self.llf + 2.0 * self.rank

    @property
    def bic(self) -> float:
        return -2.0 * self.llf + math.log(self.n) * self.rank

    def coefficients(self, spark: SparkSession) -> DataFrame:
        schema = T.StructType([
            T.StructField("variable", T.StringType()), T.StructField("coefficient", T.DoubleType()),
            T.StructField("std_error", T.DoubleType()), T.StructField("t_stat", T.DoubleType()),
            T.StructField("p_value", T.DoubleType()), T.StructField("identified", T.BooleanType())])
        rows = [(n, float(b), se, z, p, bool(idf)) for n, b, se, z, p, idf in
                zip(self.names, self.coef, self.std_error, self.z, self.p_value, self.identified)]
        return spark.createDataFrame(rows, schema)

    def metrics(self, spark: SparkSession, formula: str = "") -> DataFrame:
        schema = T.StructType([
            T.StructField("r_squared", T.DoubleType()), T.StructField("adj_r_squared", T.DoubleType()),
            T.StructField("aic", T.DoubleType()), T.StructField("bic", T.DoubleType()),
            T.StructField("n_obs", T.LongType()), T.StructField("rank", T.IntegerType()),
            T.StructField("model_formula", T.StringType()),
            T.StructField("covariance_type", T.StringType())])
        return spark.createDataFrame([(self.r_squared, self.adj_r_squared, self.aic, self.bic,
                                       self.n, self.rank, formula, self.cov_type)], schema)


COV_TYPES = ("HC3", "HC1", "HC0", "nonrobust")


class _Rows:
    """Design rows of a batch: column numbers and values, both (n x s).
    Column k is the target; dropped levels have the number k + 1 and the
    value 0, so row k + 1 of a sum is free for counts."""

    def __init__(self, pdf: pd.DataFrame, y: str, x: list[str], factors: list[str],
                 levels: dict[str, list]):
        n, k = len(pdf), len(x) + sum(len(v) - 1 for v in levels.values())
        cols = [np.full(n, j) for j in range(len(x))]
        vals = [pdf[c].to_numpy(float) for c in x]
        base = len(x)
        for f in factors:
            code = pd.Categorical(pdf[f], categories=levels[f]).codes.astype(int)
            cols.append(np.where(code > 0, base + code - 1, k + 1))
            vals.append((code > 0).astype(float))
            base += len(levels[f]) - 1
        self.y = pdf[y].to_numpy(float)
        self.k, self.cols, self.vals = k, cols, vals

    def add_products(self, into: np.ndarray, weight: np.ndarray | float, target: bool) -> None:
        cols, vals = list(self.cols), list(self.vals)
        if target:
            cols.append(np.full(len(self.y), self.k))
            vals.append(self.y)
        for ca, va in zip(cols, vals):
            for cb, vb in zip(cols, vals):
                np.add.at(into, (ca, cb), weight * va * vb)

    def residual(self, coef: np.ndarray) -> np.ndarray:
        b = np.append(coef, [0.0, 0.0])
        return self.y - sum(v * b[c] for c, v in zip(self.cols, self.vals))

    def leverage(self, ginv: np.ndarray) -> np.ndarray:
        return sum(va * vb * ginv[ca, cb] for ca, va in zip(self.cols, self.vals)
                   for cb, vb in zip(self.cols, self.vals))


def _summed(df: DataFrame, size: int, make) -> np.ndarray:
    """Sum over all rows of the (size x size) array that ``make(pdf, into)``
    adds to: one array per task, then its rows by a grouped sum."""
    def partial(batches):
        into = np.zeros((size, size))
        for pdf in batches:
            make(pdf, into)
        yield pd.DataFrame({"i": range(size), "part": [r.tobytes() for r in into]})

    def total(pdf):
        row = sum(np.frombuffer(b) for b in pdf["part"])
        return pd.DataFrame({"i": pdf["i"].iloc[:1], "part": [row.tobytes()]})
    rows = (df.mapInPandas(partial, "i int, part binary").groupBy("i")
            .applyInPandas(total, "i int, part binary").collect())
    out = np.zeros((size, size))
    for r in rows:
        out[r["i"]] = np.frombuffer(r["part"])
    return out


def fit_ols(df: DataFrame, y: str, x: Sequence[str], cov_type: str = "HC3",
            rcond: float = 1e-12, absorbed: int = 0, factors: Sequence[str] = ()) -> OLSResult:
    """OLS of ``y`` on the columns ``x`` (include "const" for an intercept;
    it need not be a column) and treatment-coded ``factors``.  Rows with a
    null in any of them take no part (complete cases, F8).  ``cov_type`` is
    one of HC3, HC1, HC0, nonrobust.  ``absorbed`` counts parameters already
    projected out of y and x (fixed effects removed by a within transform); it
    enters the degrees of freedom, so the nonrobust and HC1 errors equal
    those of the dummy regression.  HC3 needs the leverage of the full
    design and is refused when ``absorbed`` > 0."""
    if cov_type not in COV_TYPES:
        raise ValueError(f"unknown cov_type {cov_type!r}")
    if cov_type == "HC3" and absorbed:
        raise ValueError("HC3 needs the full design's leverage; use HC1 with absorbed effects")
    x, factors = list(x), list(factors)
    const = "const" in x
    if const and "const" not in df.columns:
        df = df.withColumn("const", F.lit(1.0))
    num = list(dict.fromkeys(x + [y]))
    df = df.select(*[F.col(c).cast("double").alias(c) for c in num], *factors).dropna()
    levels = {f: factor_levels(df, f) for f in factors}
    names = x + [dummy_name(f, v) for f in factors for v in levels[f][1:]]
    k = len(names)
    shipped = df.sparkSession.sparkContext.broadcast(levels)

    def gram(pdf, into):
        _Rows(pdf, y, x, factors, shipped.value).add_products(into, 1.0, True)
        into[k + 1, 0] += len(pdf)
        into[k + 1, 1] += pdf[y].sum()
    full = _summed(df, k + 2, gram)
    n, y_sum = int(full[k + 1, 0]), full[k + 1, 1]
    g, xy = full[:k, :k], full[:k, k]
    # any generalised inverse gives the same fit and the same identified
    # coefficients; the others are reported with minimum norm
    ginv, plus, null_basis, rank = min_norm_inverse(g, rcond)
    solution = ginv @ xy
    identified = [bool(np.linalg.norm(null_basis[i]) < 1e-8) for i in range(k)]
    coef = np.where(identified, solution, plus @ xy)

    centre = y_sum / n if const and n else 0.0
    padded = np.zeros((k + 2, k + 2))
    padded[:k, :k] = ginv
    known = df.sparkSession.sparkContext.broadcast((solution, padded))

    def meat(pdf, into):
        b, gi = known.value
        rows = _Rows(pdf, y, x, factors, shipped.value)
        e = rows.residual(b)
        w = e * e
        if cov_type == "HC3":
            room = 1.0 - rows.leverage(gi)
            bad = room < LEVERAGE_EPS
            w = np.where(bad, 0.0, w / np.where(bad, 1.0, room) ** 2)
            for c, v in zip(rows.cols, rows.vals):
                np.add.at(into[k], c, np.abs(v) * bad)  # columns a blocked row touches
        if cov_type != "nonrobust":
            rows.add_products(into, w, False)
        into[k + 1, 0] += (e * e).sum()
        into[k + 1, 1] += ((rows.y - centre) ** 2).sum()
    second = _summed(df, k + 2, meat)
    ssr, sst = float(second[k + 1, 0]), float(second[k + 1, 1])

    dof = max(n - rank - absorbed, 1)
    if cov_type == "nonrobust":
        cov = (ssr / dof) * ginv
    else:
        cov = ginv @ second[:k, :k] @ ginv * (n / dof if cov_type == "HC1" else 1.0)
    se, z, p = fit_statistics(coef, np.diag(cov), identified, second[k, :k] > 0)
    return OLSResult(names, coef, cov, se, z, p, identified, rank, n, ssr, sst, cov_type)


def fit_statistics(coef, variances, identified, blocked) -> tuple[list, list, list]:
    """Standard errors, z and two-sided p values; null where a coefficient is
    not identified, or blocked by a row that is fitted exactly."""
    se, z, p = [], [], []
    for b, v, known, stop in zip(coef, variances, identified, blocked):
        if stop or not known or not np.isfinite(v) or v <= 0:
            se.append(None)
            z.append(None)
            p.append(None)
            continue
        s = math.sqrt(v)
        zz = b / s
        se.append(s)
        z.append(float(zz))
        p.append(math.erfc(abs(zz) / math.sqrt(2.0)))
    return se, z, p


def within_slope(demeaned: DataFrame, y: str, x: str) -> DataFrame:
    """Slope of the two-way demeaned y on demeaned x (one aggregate)."""
    return demeaned.agg((F.sum(F.col(x) * F.col(y)) / F.sum(F.col(x) * F.col(x))).alias("slope"),
                        F.count(F.lit(1)).alias("n"))


# What the metadata row says of a fixed-effects regression.
FE_ASSUMPTIONS = "Associational, not causal. Controls for industry and year effects."
FE_PURPOSE = "Estimate relationship between tariffs, infrastructure, and unemployment"


def regression_metadata(spark: SparkSession, res: OLSResult, y: str, formula: str,
                        model_name: str = "panel_fixed_effects",
                        fixed_effects: str = "industry and year",
                        feature_table: str = "features", assumptions: str = FE_ASSUMPTIONS,
                        purpose: str = FE_PURPOSE, n_params: int | None = None) -> DataFrame:
    """One row describing a fitted model (M5); ``n_params`` where it has more
    than the result names."""
    return spark.createDataFrame(
        [(model_name, y, fixed_effects, res.cov_type, feature_table, res.n, res.rank,
          n_params or len(res.names), formula, assumptions, purpose)],
        "model_name string, dependent_variable string, fixed_effects string, robust_se string, "
        "feature_table string, n_obs long, rank int, n_params int, formula string, "
        "assumptions string, purpose string")
