"""DuckDB SQL of grouped least squares, for the oracles: co-moments per
group, then one CTE per swept column.  It shares no code with the
operators."""

from __future__ import annotations

from collections.abc import Sequence


def _s(i: int, j: int) -> str:
    return f"s_{min(i, j)}_{max(i, j)}"


def sweep_ctes(name: str, src: str, keys: Sequence[str], xs: Sequence[str], y: str,
               tol: float = 1e-10) -> str:
    """CTEs ``{name}_0 .. {name}_k``; the last one has ``n``, ``rank``, the
    means ``m_i``, the slopes ``s_i_k``, the residual sum of squares
    ``s_k_k``, minus the inverse in ``s_i_j`` and the target's own variation
    ``d_k``.  Rows with a null or NaN in any column take no part, but every
    group of ``src`` has a row."""
    z = [*xs, y]
    k = len(xs)
    ok = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in z)
    by = ", ".join(keys)
    lead = f"{by}, " if keys else ""
    group = f"GROUP BY {by}" if keys else ""
    v = [f"CASE WHEN __ok THEN CAST({c} AS DOUBLE) END" for c in z]
    first = [f"coalesce(covar_pop({v[i]}, {v[j]}) * count(CASE WHEN __ok THEN 1 END), 0) "
             f"AS {_s(i, j)}" for i in range(k + 1) for j in range(i, k + 1)]
    own = [f"coalesce(covar_pop({v[i]}, {v[i]}) * count(CASE WHEN __ok THEN 1 END), 0) AS d_{i}"
           for i in range(k + 1)]
    means = [f"coalesce(avg({v[i]}), 0) AS m_{i}" for i in range(k + 1)]
    carry = lead + "n, " + ", ".join(f"m_{i}, d_{i}" for i in range(k + 1))
    ctes = [f"""{name}_0 AS (
  SELECT {lead}CAST(count(CASE WHEN __ok THEN 1 END) AS INTEGER) AS n, 0 AS rank,
    {", ".join(means + own + first)}
  FROM (SELECT *, ({ok}) AS __ok FROM {src}) {group})"""]
    for t in range(k):
        good = f"{_s(t, t)} > {tol!r} * d_{t}"
        cols = []
        for i in range(k + 1):
            for j in range(i, k + 1):
                if i == t and j == t:
                    e = f"CASE WHEN {good} THEN -1 / {_s(t, t)} ELSE 0 END"
                elif t in (i, j):
                    e = f"CASE WHEN {good} THEN {_s(i, j)} / {_s(t, t)} ELSE 0 END"
                else:
                    e = (f"{_s(i, j)} - CASE WHEN {good} THEN {_s(i, t)} * {_s(j, t)} "
                         f"/ {_s(t, t)} ELSE 0 END")
                cols.append(f"{e} AS {_s(i, j)}")
        ctes.append(f"""{name}_{t + 1} AS (
  SELECT {carry}, rank + CASE WHEN {good} THEN 1 ELSE 0 END AS rank,
    {", ".join(cols)} FROM {name}_{t})""")
    return ",\n".join(ctes)


def _innovation_ctes(out: str, d: int, keys: Sequence[str], period: str, y: str,
                     exog: Sequence[str], long_ar: int, q: int) -> list[str]:
    """CTEs from ``{out}_l{d}`` to ``{out}_v{d}``: residuals of the long
    autoregression as ``shock0`` and their lags, ``first`` its status; and
    ``{out}_z{d}``, the last ones of every series."""
    by = ", ".join(keys)
    xs = [f"lag{n}" for n in range(1, long_ar + 1)] + list(exog)
    k, h = len(xs), f"{out}_h{d}"
    icpt = " - ".join([f"m_{k}"] + [f"s_{i}_{k} * m_{i}" for i in range(k)])
    minus = "".join(f" - g.b_{i} * r.{c}" for i, c in enumerate(xs))
    on = " AND ".join(f"g.{c} IS NOT DISTINCT FROM r.{c}" for c in keys)
    shocks = ", ".join(f"CASE WHEN first = 'ok' THEN lag(shock0, {n}) OVER w ELSE 0 END AS shock{n}"
                       for n in range(1, q + 1))
    return [sweep_ctes(h, f"{out}_l{d}", keys, xs, y),
            f"""{out}_g{d} AS (SELECT {by}, CASE WHEN n < rank + 3 THEN 'too_short'
      WHEN greatest(s_{k}_{k}, 0) <= 1e-12 * d_{k} THEN 'perfect_fit' ELSE 'ok' END AS first,
    {icpt} AS c, {", ".join(f"s_{i}_{k} AS b_{i}" for i in range(k))} FROM {h}_{k})""",
            f"""{out}_e{d} AS (SELECT r.*, g.first, CASE WHEN g.first = 'ok'
      THEN r.{y} - g.c{minus} ELSE 0 END AS shock0 FROM {out}_l{d} r JOIN {out}_g{d} g ON {on})""",
            f"""{out}_v{d} AS (SELECT *, {shocks} FROM {out}_e{d}
    WINDOW w AS (PARTITION BY {by} ORDER BY {period}))""",
            f"""{out}_z{d} AS (SELECT {by}, first,
      {", ".join(f"shock{n} AS shock_{n + 1}" for n in range(q))} FROM {out}_v{d}
    QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY {period} DESC) = 1)"""]


def arx_ctes(src: str, keys: Sequence[str], period: str, y: str, exog: Sequence[str],
             orders: Sequence[tuple[int, int, int]], out: str = "fits", long_ar: int = 4) -> str:
    """CTEs ending in ``out``: one row per (keys, order)."""
    by = ", ".join(keys)
    w = f"WINDOW w AS (PARTITION BY {by} ORDER BY {period})"
    parts, selects = [], []
    for d in sorted({o[1] for o in orders}):
        lags = max(o[0] for o in orders if o[1] == d)
        most = max(o[2] for o in orders if o[1] == d)
        prev = src
        for n in range(1, d + 1):
            cols = ", ".join(f"{c} - lag({c}) OVER w AS {c}" for c in [y, *exog])
            parts.append(f"{out}_b{d}_{n} AS (SELECT {by}, {period}, {cols} FROM {prev} {w})")
            prev = f"{out}_b{d}_{n}"
        base = f"{out}_b{d}"
        parts.append(f"{base} AS (SELECT {by}, {period}, {', '.join([y, *exog])} FROM {prev})")
        lagged = "".join(f", lag({y}, {n}) OVER w AS lag{n}"
                         for n in range(1, max(lags, long_ar if most else 0) + 1))
        parts.append(f"{out}_l{d} AS (SELECT *{lagged} FROM {base} {w})")
        rows = f"{out}_l{d}"
        needed = [f"lag{n}" for n in range(1, lags + 1)]
        if most:
            parts += _innovation_ctes(out, d, keys, period, y, exog, long_ar, most)
            rows = f"{out}_v{d}"
            needed += [f"shock{n}" for n in range(1, most + 1)]
        need = " AND ".join(f"{c} IS NOT NULL" for c in needed) or "TRUE"
        # every order of one degree uses the rows that have all lags
        hide = f"CASE WHEN {need} THEN {y} END"
        parts.append(f"{out}_r{d} AS (SELECT * REPLACE ({hide} AS {y}) FROM {rows})")
        for pos, (p, dd, q) in enumerate(orders):
            if dd != d:
                continue
            xs = ([f"lag{n}" for n in range(1, p + 1)] + [f"shock{n}" for n in range(1, q + 1)]
                  + list(exog))
            k = len(xs)
            o = f"{out}_o{pos}"
            parts.append(sweep_ctes(o, f"{out}_r{d}", keys, xs, y))
            icpt = " - ".join([f"m_{k}"] + [f"s_{i}_{k} * m_{i}" for i in range(k)])
            phi = [f"s_{i}_{k}" if i < p else "0" for i in range(2)]
            theta = [f"s_{p + i}_{k}" if i < q else "0" for i in range(2)]
            beta = ", ".join(f"CASE WHEN fit THEN s_{p + q + i}_{k} END AS beta_{c}"
                             for i, c in enumerate(exog))
            fit = "n >= rank + 3" + (" AND first <> 'too_short'" if q else "")
            known = [f"shock_{i}" if i <= most else "0" for i in (1, 2)]
            last = ""
            if most:
                on = " AND ".join(f"z.{c} IS NOT DISTINCT FROM o.{c}" for c in keys)
                last = f" o JOIN {out}_z{d} z ON {on}"
            own = ", ".join(f"o.{c}" for c in keys) if most else by
            selects.append(f"""SELECT {own}, {pos} AS pos, {p} AS ar, {d} AS diff, {q} AS ma,
    '({p}, {d}, {q})' AS ord, CASE WHEN NOT ({fit}) THEN 'too_short'
      WHEN greatest(s_{k}_{k}, 0) <= 1e-12 * d_{k} THEN 'perfect_fit' ELSE 'ok' END AS status,
    n AS n_obs, rank, {fit} AS fit, CASE WHEN fit THEN greatest(s_{k}_{k}, 0) / n END AS sigma2,
    CASE WHEN fit THEN {icpt} END AS intercept, CASE WHEN fit THEN {phi[0]} END AS phi_1,
    CASE WHEN fit THEN {phi[1]} END AS phi_2, CASE WHEN fit THEN {theta[0]} END AS theta_1,
    CASE WHEN fit THEN {theta[1]} END AS theta_2, {known[0]} AS shock_1, {known[1]} AS shock_2
    {", " + beta if beta else ""} FROM {o}_{k}{last}""")
    parts.append(f"{out}_u AS ({' UNION ALL '.join(selects)})")
    parts.append(f"""{out}_ll AS (SELECT *, CASE WHEN status = 'ok' THEN
    -0.5 * n_obs * (ln(2 * pi()) + ln(sigma2) + 1) END AS loglik FROM {out}_u)""")
    parts.append(f"""{out} AS (SELECT *, -2 * loglik + 2 * (rank + 2) AS aic,
    -2 * loglik + ln(n_obs) * (rank + 2) AS bic FROM {out}_ll)""")
    return ",\n".join(parts)


def best_ctes(fits: str, keys: Sequence[str], out: str = "best") -> str:
    by = ", ".join(keys)
    return f"""{out} AS (SELECT * FROM {fits}
  QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY aic IS NULL, aic, pos) = 1)"""


def forecast_ctes(train: str, fits: str, future: str, keys: Sequence[str], period: str, y: str,
                  exog: Sequence[str], z: float, out: str = "fc", scenario: str = "scenario") -> str:
    """CTEs ending in ``out``: the recursion of each scenario's future rows."""
    by = ", ".join(keys)
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys)
    step = " + ".join(["intercept"] + [
        f"beta_{c} * CASE WHEN diff = 1 THEN f.{c} - coalesce(f.prev_{c}, t.{c}) ELSE f.{c} END"
        for c in exog])
    part = ", ".join([*(f"f.{k}" for k in keys), f"f.{scenario}"])
    psi = ("CASE WHEN r.h = 0 THEN 1 ELSE a1 * r.g1 + a2 * r.g2 + a3 * r.g3 "
           "+ CASE r.h WHEN 1 THEN theta_1 WHEN 2 THEN theta_2 ELSE 0 END END")
    still = " AND ".join(f"{c} = 0" for c in ("a1", "a2", "a3", "theta_1", "theta_2"))
    prev = ", ".join(f"lag(f.{c}) OVER (PARTITION BY {part} ORDER BY f.{period}) AS prev_{c}"
                     for c in exog)
    return f"""{out}_t AS (SELECT * FROM (
    SELECT {by}, {period} AS last, {y} AS y1, lag({y}) OVER w AS y2, lag({y}, 2) OVER w AS y3,
      {", ".join(exog)} FROM {train} WINDOW w AS (PARTITION BY {by} ORDER BY {period}))
    QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY last DESC) = 1),
{out}_x AS (SELECT f.*, {prev} FROM {future} f JOIN {out}_t t ON {on('f', 't')}
    WHERE f.{period} > t.last),
{out}_u AS (SELECT {", ".join("f." + k for k in keys)}, f.{scenario}, f.{period},
      {step} AS u FROM {out}_x f JOIN {out}_t t ON {on('f', 't')}
      JOIN {fits} g ON {on('f', 'g')}),
{out}_a AS (SELECT {by}, sigma2, status, theta_1, theta_2, shock_1, shock_2,
      CASE WHEN diff = 1 THEN 1 + phi_1 ELSE phi_1 END AS a1,
      CASE WHEN diff = 1 THEN phi_2 - phi_1 ELSE phi_2 END AS a2,
      CASE WHEN diff = 1 THEN -phi_2 ELSE 0 END AS a3 FROM {fits}),
{out}_r AS (
  SELECT DISTINCT {", ".join("u." + k for k in keys)}, u.{scenario}, t.last AS p, 0 AS h,
    t.y1 AS y1, t.y2 AS y2, t.y3 AS y3, 0.0::DOUBLE AS g1, 0.0::DOUBLE AS g2, 0.0::DOUBLE AS g3,
    0.0::DOUBLE AS s2
  FROM {out}_u u JOIN {out}_t t ON {on('u', 't')}
  UNION ALL
  SELECT {", ".join("r." + k for k in keys)}, r.{scenario}, r.p + 1, r.h + 1,
    u.u + CASE WHEN a1 = 0 THEN 0 ELSE a1 * r.y1 END + CASE WHEN a2 = 0 THEN 0 ELSE a2 * r.y2 END
        + CASE WHEN a3 = 0 THEN 0 ELSE a3 * r.y3 END
        + CASE r.h WHEN 0 THEN theta_1 * shock_1 WHEN 1 THEN theta_2 * shock_1 ELSE 0 END
        + CASE r.h WHEN 0 THEN theta_2 * shock_2 ELSE 0 END, r.y1, r.y2,
    {psi}, r.g1, r.g2, r.s2 + pow({psi}, 2)
  FROM {out}_r r JOIN {out}_u u ON {on('r', 'u')} AND r.{scenario} = u.{scenario}
    AND u.{period} = r.p + 1 JOIN {out}_a a ON {on('r', 'a')}),
{out} AS (SELECT {", ".join("x." + k for k in keys)}, x.{scenario}, x.{period},
    CASE WHEN {still} THEN u.u ELSE r.y1 END AS predicted,
    CASE WHEN {still} THEN 1 ELSE r.s2 END AS s2,
    CASE WHEN a.sigma2 IS NULL THEN a.status WHEN predicted IS NULL THEN 'missing_driver'
      ELSE a.status END AS status,
    predicted - {z!r} * sqrt(a.sigma2 * s2) AS ci_lower,
    predicted + {z!r} * sqrt(a.sigma2 * s2) AS ci_upper
  FROM {out}_x x JOIN {out}_a a ON {on('x', 'a')}
  LEFT JOIN {out}_u u ON {on('x', 'u')} AND u.{scenario} = x.{scenario} AND u.{period} = x.{period}
  LEFT JOIN {out}_r r ON {on('x', 'r')} AND r.{scenario} = x.{scenario} AND r.p = x.{period}
    AND r.h > 0)"""


def rounded_list(cols: Sequence[str], places: int = 6) -> str:
    return ", ".join(f"round({c}, {places}) + 0.0 AS {c}" for c in cols)
