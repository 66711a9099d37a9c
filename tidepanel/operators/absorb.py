"""Regression with one large factor, by block elimination (M1-M5, q3).

The normal equations of  y ~ const + x + C(small factors) + C(absorb)  have a
diagonal block for the levels of ``absorb``.  Eliminating it leaves the small
block (the Schur complement)

    S = sum_i z_i z_i' - sum_g n_g m_g m_g'

over the columns z (numeric regressors and dummies of the small factors), where
m_g is the mean of z in level g.  Only S reaches the driver.  What belongs to a
level stays a row of a DataFrame: its count, its column sums (a level has no
more non-zero dummies than the small factors have levels), later its effect and
the sums of its weighted rows.  All of them are grouped sums with map-side
partial sums, so a level that holds a third of all rows is no hot group.

The leverage of a row is 1/n_g + (z - m_g)' S^- (z - m_g); expanded, it needs
of a level two numbers and the entries of S^- m_g at the row's own non-zero
columns.  Robust errors use the same expansion of sum_i w_i (z - m_g)(z - m_g)'.
Everything is centred by the column means first, which the effects absorb.

Levels seen once fit their row exactly and say nothing about the other
coefficients; their own effect has no standard error.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..stages import materialize
from .design import dummy_name, factor_levels
from .regression import (COV_TYPES, LEVERAGE_EPS, OLSResult, _summed, fit_statistics,
                         min_norm_inverse)

NULL_TOL = 1e-8


@dataclass
class Absorbed:
    """A fit with an absorbed factor: the small block (``result``; its first
    name is ``const``, the effect of the first level) and one row per level
    (``effects``: the level, n_obs, effect relative to the first level,
    std_error, t_stat, p_value, identified)."""
    result: OLSResult
    effects: DataFrame
    first: object

    def coefficients(self, spark: SparkSession) -> DataFrame:
        """The small block's coefficients and, as ``{factor}_{level}``, those
        of all levels but the first."""
        own = self.effects.columns[0]
        levels = self.effects.filter(F.col(own) != F.lit(self.first)).select(
            F.concat(F.lit(f"{own}_"), F.col(own).cast("string")).alias("variable"),
            F.col("effect").alias("coefficient"), "std_error", "t_stat", "p_value", "identified")
        return self.result.coefficients(spark).unionByName(levels)


class _Small:
    """Small columns: numbers 0..p-1 are regressors, then the dummies of the
    factors; the target stands at k."""

    def __init__(self, x: list[str], factors: list[str], levels: dict[str, list]):
        self.x, self.factors, self.levels = x, factors, levels
        self.names = x + [dummy_name(f, v) for f in factors for v in levels[f][1:]]
        self.k = len(self.names)
        self.at, base = {}, len(x)
        for f in factors:
            self.at[f] = base
            base += len(levels[f]) - 1


def _codes(small: _Small) -> list[str]:
    return [f"__c{i}" for i in range(len(small.factors))]


def _coded(rows: DataFrame, y: str, small: _Small, absorb: str, means: dict) -> DataFrame:
    """g, centred target and regressors ``__v`` (target last), column numbers
    of the row's dummies."""
    values = [F.col(c) - F.lit(float(means[c])) for c in [*small.x, y]]
    out = rows.select(F.col(absorb).alias("__g"), F.array(*values).alias("__v"), *small.factors)
    numbers = {}
    for name, f in zip(_codes(small), small.factors):
        lookup = {v: small.at[f] + i for i, v in enumerate(small.levels[f][1:])}
        numbers[name] = _number(out[f], lookup)
    return out.select("__g", "__v", *[c.alias(n) for n, c in numbers.items()])


def _number(column, lookup: dict):
    """Column number of a level as a map lookup (null: the first level)."""
    if not lookup:
        return F.lit(None).cast("int")
    pairs = [c for v, i in lookup.items() for c in (F.lit(v), F.lit(i))]
    return F.try_element_at(F.create_map(*pairs), column).cast("int")


def _level_sums(coded: DataFrame, small: _Small, weight: str | None = None, *more) -> DataFrame:
    """Per level: sum of weights (``n``), weighted sums of the values
    (``sums``), and of the dummies as a list of (column, sum), and the
    aggregates ``more``."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    width = len(small.x) + 1
    num = coded.groupBy("__g").agg(
        F.sum(w).alias("n"), *more,
        F.array(*[F.sum(F.col("__v")[i] * w) for i in range(width)]).alias("sums"))
    if not small.factors:
        return num.withColumn("cats", F.array().cast("array<struct<c:int,s:double>>"))
    parts = None
    for name in _codes(small):
        one = (coded.filter(F.col(name).isNotNull()).groupBy("__g", F.col(name).alias("c"))
               .agg(F.sum(w).alias("s")))
        parts = one if parts is None else parts.unionByName(one)
    cats = parts.groupBy("__g").agg(F.collect_list(F.struct("c", "s")).alias("cats"))
    return num.join(cats, "__g", "left").withColumn("cats", F.coalesce(
        "cats", F.array().cast("array<struct<c:int,s:double>>")))


def _row_columns(pdf: pd.DataFrame, small: _Small, target: bool):
    """(column numbers, values) of a batch of coded rows; a dropped level is
    column k + 1 with value 0."""
    n, p = len(pdf), len(small.x)
    v = np.stack(pdf["__v"].to_list()).astype(float) if n else np.zeros((0, p + 1))
    cols = [np.full(n, j) for j in range(p)]
    vals = [v[:, j] for j in range(p)]
    for name in _codes(small):
        c = pd.to_numeric(pdf[name]).to_numpy(float)
        cols.append(np.where(np.isnan(c), small.k + 1, c).astype(int))
        vals.append((~np.isnan(c)).astype(float))
    if target:
        cols.append(np.full(n, small.k))
        vals.append(v[:, p])
    return cols, vals


def _add_pairs(into: np.ndarray, cols, vals, weight) -> None:
    for ca, va in zip(cols, vals):
        for cb, vb in zip(cols, vals):
            np.add.at(into, (ca, cb), weight * va * vb)


CELLS = 1 << 21     # numbers in one dense slice of levels


def _slices(pdf: pd.DataFrame, k: int):
    step = max(1, CELLS // (k + 1))
    for lo in range(0, len(pdf), step):
        yield pdf.iloc[lo:lo + step]


def _dense(sums, cats, p: int, k: int) -> np.ndarray:
    """Column sums of a slice of levels, one row each: regressors, dummies,
    target."""
    v = np.stack(list(sums)).astype(float)
    out = np.zeros((len(v), k + 1))
    out[:, :p], out[:, k] = v[:, :p], v[:, p]
    for i, own in enumerate(cats):
        for c in own:
            out[i, c["c"]] = c["s"]
    return out


def fit_absorbed(df: DataFrame, y: str, x: Sequence[str], absorb: str, cov_type: str = "HC3",
                 factors: Sequence[str] = (), rcond: float = 1e-12) -> Absorbed:
    """OLS of ``y`` on an intercept, the columns ``x``, treatment-coded small
    ``factors`` and one treatment-coded factor ``absorb`` with any number of
    levels; complete cases.  Equal to :func:`~.regression.fit_ols` with both
    kinds of factors, but only the small block is on the driver."""
    if cov_type not in COV_TYPES:
        raise ValueError(f"unknown cov_type {cov_type!r}")
    x, factors = [c for c in x if c != "const"], list(factors)
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in dict.fromkeys([*x, y])],
                     *factors, absorb).dropna()
    levels = {f: factor_levels(rows, f) for f in factors}
    small = _Small(x, factors, levels)
    k, p = small.k, len(x)
    if not k:
        raise ValueError("no regressor and no second level of a small factor")
    start = rows.agg(F.count(F.lit(1)).alias("n"), F.min(absorb).alias("first"),
                     F.count_distinct(absorb).alias("groups"),
                     *[F.avg(c).alias(f"m_{c}") for c in dict.fromkeys([*x, y])]).first()
    n, groups = int(start["n"]), int(start["groups"])
    if not n:
        raise ValueError("no complete rows")
    means = {c: start[f"m_{c}"] for c in dict.fromkeys([*x, y])}
    coded = materialize(_coded(rows, y, small, absorb, means))
    per_level = materialize(_level_sums(coded, small))

    # --- the small block
    def raw(pdf, into):
        cols, vals = _row_columns(pdf, small, True)
        _add_pairs(into, cols, vals, 1.0)

    def between(pdf, into):
        for part in _slices(pdf, k):
            a = _dense(part["sums"], part["cats"], p, k)
            into[:k + 1, :k + 1] += a.T @ (a / part["n"].to_numpy(float)[:, None])
    total = _summed(coded, k + 2, raw)
    block = total - _summed(per_level.select("sums", "cats", "n"), k + 2, between)
    own = total[:k, :k].diagonal()
    # what the levels contain is left over as rounding only
    gone = block[:k, :k].diagonal() <= rcond * np.maximum(own, 1e-300)
    block[:k][gone] = 0.0
    block[:, :k][:, gone] = 0.0
    s_inv, plus, null, rank = min_norm_inverse(block[:k, :k], rcond)
    solution = s_inv @ block[:k, k]
    identified = np.array([bool(np.linalg.norm(null[i]) < NULL_TOL) for i in range(k)], bool)
    coef = np.where(identified, solution, plus @ block[:k, k])
    sst = float(total[k, k])                       # the target is centred

    # --- per level: effect, S^- m_g at its own columns, m_g' S^- m_g
    def known(batches):
        for pdf in batches:
            for part in _slices(pdf, k):
                m = _dense(part["sums"], part["cats"], p, k) / part["n"].to_numpy(float)[:, None]
                z, c = m[:, :k], [[d["c"] for d in own] for own in part["cats"]]
                at = z @ s_inv
                yield pd.DataFrame({
                    "__g": part["__g"], "n": part["n"], "sums": part["sums"], "cats": part["cats"],
                    "effect": m[:, k] - z @ solution, "q": (at * z).sum(axis=1),
                    "at_x": list(at[:, :p]), "c": c,
                    "at_c": [row[own].tolist() for row, own in zip(at, c)],
                    "null": list(z @ null)})
    kind = coded.schema["__g"].dataType.simpleString()
    facts = materialize(per_level.select("__g", "n", "sums", "cats").mapInPandas(
        known, f"__g {kind}, n double, sums array<double>, "
               "cats array<struct<c:int,s:double>>, effect double, q double, "
               "at_x array<double>, c array<int>, at_c array<double>, null array<double>"))

    # --- rows: residual, leverage, weight
    own_of = lambda c: F.when(F.col(c).isNotNull(), F.try_element_at(
        F.map_from_arrays("c", "at_c"), F.col(c))).otherwise(F.lit(0.0))
    joined = coded.join(facts.select("__g", "n", "effect", "q", "at_x", "c", "at_c"), "__g").select(
        "__g", "__v", *_codes(small), "n", "effect", "q", "at_x",
        F.array(*[own_of(c) for c in _codes(small)]).cast("array<double>").alias("at_own"))

    def weighted(batches):
        b = np.append(solution, [0.0, 0.0])
        inv = np.zeros((k + 2, k + 2))
        inv[:k, :k] = s_inv
        for pdf in batches:
            if not len(pdf):
                continue
            cols, vals = _row_columns(pdf, small, False)
            target = np.array([v[p] for v in pdf["__v"]], float)
            e = target - pdf["effect"].to_numpy(float)
            for c, v in zip(cols, vals):
                e = e - v * b[c]
            lev = 1.0 / pdf["n"].to_numpy(float) + pdf["q"].to_numpy(float)
            at = np.concatenate([np.stack(pdf["at_x"].to_list()).reshape(len(pdf), -1),
                                 np.stack(pdf["at_own"].to_list()).reshape(len(pdf), -1)], axis=1)
            for j, (ca, va) in enumerate(zip(cols, vals)):
                lev = lev - 2.0 * va * at[:, j].astype(float)
                for cb, vb in zip(cols, vals):
                    lev = lev + va * vb * inv[ca, cb]
            room = 1.0 - lev
            bad = room < LEVERAGE_EPS
            w = e * e
            if cov_type == "HC3":
                w = np.where(bad, 0.0, w / np.where(bad, 1.0, room) ** 2)
            yield pd.DataFrame({"__g": pdf["__g"], "__v": pdf["__v"],
                                **{c: pdf[c].astype("Int64") for c in _codes(small)},
                                "w": w, "e2": e * e, "bad": bad & (pdf["n"] > 1)})
    codes_ddl = "".join(f", {c} int" for c in _codes(small))
    rows_w = materialize(joined.mapInPandas(
        weighted, f"__g {kind}, __v array<double>{codes_ddl}, w double, e2 double, bad boolean"))

    # --- robust errors of the small block
    weights = None
    if cov_type != "nonrobust":
        weights = materialize(_level_sums(rows_w, small, "w", F.max("bad").alias("wbad")).select(
            "__g", F.col("n").alias("wn"), F.col("sums").alias("wsums"),
            F.col("cats").alias("wcats"), "wbad")
            .join(facts.select("__g", "n", "sums", "cats"), "__g"))

    def meat_rows(pdf, into):
        cols, vals = _row_columns(pdf, small, False)
        w = pdf["w"].to_numpy(float)
        if cov_type != "nonrobust":
            _add_pairs(into, cols, vals, w)
        bad = pdf["bad"].to_numpy(bool)
        for c, v in zip(cols, vals):
            np.add.at(into[k], c, np.abs(v) * bad)
        into[k + 1, 0] += pdf["e2"].sum()

    def meat_levels(pdf, into):
        for part in _slices(pdf, k):
            m = _dense(part["sums"], part["cats"], p, k) / part["n"].to_numpy(float)[:, None]
            u = _dense(part["wsums"], part["wcats"], p, k)
            cross = u.T @ m
            into[:k + 1, :k + 1] += (m * part["wn"].to_numpy(float)[:, None]).T @ m
            into[:k + 1, :k + 1] -= cross + cross.T
    second = _summed(rows_w, k + 2, meat_rows)
    ssr, blocked = float(second[k + 1, 0]), second[k, :k] > 0
    dof = max(n - rank - groups, 1)
    scale = n / dof if cov_type == "HC1" else 1.0
    if cov_type == "nonrobust":
        cov = (ssr / dof) * s_inv
    else:
        middle = second[:k, :k] + _summed(weights, k + 2, meat_levels)[:k, :k]
        cov = s_inv @ middle @ s_inv * scale

    effects = _effects(facts, weights, small, absorb, kind, start["first"], solution, s_inv, cov,
                       null, ssr / dof, scale, cov_type)
    const = effects.pop("const")
    const_value = (const["effect"] + means[y]
                   - sum(means[c] * b for c, b in zip(x, solution[:p])))
    shift = np.array([means[c] for c in x])
    # the intercept: the reference level's effect at zero regressors
    const_ok = bool(np.linalg.norm(np.asarray(const["null"]) + null[:p].T @ shift) < NULL_TOL)
    const_var = const["variance"](shift)
    names = ["const", *small.names]
    full_coef = np.concatenate([[const_value], coef])
    full_ok = [const_ok, *identified.tolist()]
    var = np.concatenate([[const_var], np.diag(cov)])
    no_error = [const["single"] or bool(blocked.any()), *blocked.tolist()]
    stats = fit_statistics(full_coef, var, full_ok, no_error)
    result = OLSResult(names, full_coef, cov, *stats, full_ok, rank + groups, n, ssr, sst, cov_type)
    return Absorbed(result, effects["table"], start["first"])


def _effects(facts, weights, small, absorb, kind, first, solution, s_inv, cov, null, sigma2, scale,
             cov_type) -> dict:
    """The level table, and what the intercept needs of the first level."""
    p, k, plain = len(small.x), small.k, weights is None
    whole = facts if weights is None else facts.join(
        weights.select("__g", "wn", "wsums", "wcats", "wbad"), "__g")

    def moments(part: pd.DataFrame):
        """Means, sum of weights, weighted sums of the centred rows."""
        n = part["n"].to_numpy(float)
        m = (_dense(part["sums"], part["cats"], p, k) / n[:, None])[:, :k]
        if plain:
            return n, m, n * sigma2, np.zeros_like(m), np.zeros(len(n), bool)
        w = part["wn"].to_numpy(float)
        u = _dense(part["wsums"], part["wcats"], p, k)[:, :k] - w[:, None] * m
        return n, m, w, u, part["wbad"].to_numpy(bool)
    ref = whole.filter(F.col("__g") == F.lit(first)).limit(1).toPandas()
    (n_ref,), (m_ref,), (w_ref,), (u_ref,), (bad_ref,) = moments(ref)
    v_ref, effect_ref = w_ref / n_ref ** 2 * scale, float(ref["effect"].iloc[0])
    single = cov_type == "HC3" and (n_ref <= 1 or bool(bad_ref))

    def variance(shift: np.ndarray) -> float:
        a = m_ref.copy()
        a[:p] += shift
        return float(v_ref - 2.0 * scale * a @ s_inv @ u_ref / n_ref + a @ cov @ a)

    def table(batches):
        for pdf in batches:
            for part in _slices(pdf, k):
                n, m, w, u, bad = moments(part)
                d = m - m_ref
                ok = np.linalg.norm(d @ null, axis=1) < NULL_TOL
                var = (scale * w / n ** 2 + v_ref + ((d @ cov) * d).sum(axis=1)
                       - 2.0 * scale * ((d @ s_inv) * (u / n[:, None] - u_ref / n_ref)).sum(axis=1))
                same = (part["__g"] == first).to_numpy()
                effect = np.where(same, 0.0, part["effect"].to_numpy(float) - effect_ref)
                # HC3: a level seen once is fitted exactly
                none = same | ~ok | ~(var > 0) | single
                if cov_type == "HC3":
                    none |= (n <= 1) | bad
                se = np.where(none, np.nan, np.sqrt(np.where(none, 1.0, var)))
                p_value = [None if x != x else math.erfc(abs(e / x) / math.sqrt(2.0))
                           for e, x in zip(effect, se)]
                given = lambda a: [None if x != x else float(x) for x in a]
                yield pd.DataFrame({
                    absorb: part["__g"], "n_obs": n.astype("int64"), "effect": effect,
                    "std_error": given(se), "t_stat": given(effect / se), "p_value": p_value,
                    "identified": ok})
    out = whole.mapInPandas(table, f"`{absorb}` {kind}, n_obs long, effect double, std_error double, "
                                   "t_stat double, p_value double, identified boolean")
    return {"table": out, "const": {"effect": effect_ref, "null": ref["null"].iloc[0],
                                    "single": single, "variance": variance}}
