"""Oracle SQL for the gold layer at any grain.

``G`` describes the period: a SQL expression of a date column, the period
column's name and the inclusive range.  Means and sums of cent-valued
columns are computed in exact decimal arithmetic and converted to double
once (so they are bit-identical to the Spark side and are not rounded);
unit-price means are inexact and rounded to 4 places.
"""

from __future__ import annotations

from dataclasses import dataclass

from .gold import GoldConfig
from .sql_parts import LP, OC, any_kw, industry


@dataclass(frozen=True)
class G:
    grain: str = "year"
    col: str = "year"
    lo: int = 1995
    hi: int = 2001

    def of(self, date_col: str) -> str:
        if self.grain == "year":
            return f"CAST(year({date_col}) AS INTEGER)"
        if self.grain == "month":
            return f"CAST(year({date_col}) * 12 + month({date_col}) - 1 AS INTEGER)"
        raise ValueError(self.grain)

    def in_range(self, date_col: str) -> str:
        return f"{self.of(date_col)} BETWEEN {self.lo} AND {self.hi}"


def of_config(cfg: GoldConfig) -> G:
    return G(cfg.grain, cfg.period_col, cfg.start, cfg.end)


def exact_avg(value: str, cond: str | None = None) -> str:
    """Mean in exact decimal arithmetic, converted to double once."""
    v = f"CAST({value} AS DECIMAL(18,2))"
    if cond:
        return (f"CAST(sum(CASE WHEN {cond} THEN {v} END) AS DOUBLE) / "
                f"count(CASE WHEN {cond} THEN {value} END)")
    return f"CAST(sum({v}) AS DOUBLE) / count({value})"


def exact_sum(value: str, cond: str | None = None) -> str:
    v = f"CAST({value} AS DECIMAL(18,2))"
    return (f"CAST(sum(CASE WHEN {cond} THEN {v} END) AS DOUBLE)" if cond
            else f"CAST(sum({v}) AS DOUBLE)")


def _geo(cfg: GoldConfig) -> str:
    return "TRUE" if cfg.geo is None else f"r_name = '{cfg.geo}'"


def labour_sql(g: G, cfg: GoldConfig = GoldConfig()) -> str:
    m = {name: raw for raw, name in cfg.labour_measures.items()}
    return f"""
WITH {OC},
  x AS (SELECT {g.of('o_orderdate')} AS {g.col}, {industry()} AS industry, o_orderstatus,
               o_totalprice
        FROM oc WHERE {_geo(cfg)} AND o_orderstatus IN ('F', 'O', 'P'))
SELECT {g.col}, industry,
  {exact_avg("o_totalprice", f"o_orderstatus = '{m['unemployment_rate']}'")} AS unemployment_rate,
  {exact_avg("o_totalprice", f"o_orderstatus = '{m['employment']}'")} AS employment,
  {exact_avg("o_totalprice", f"o_orderstatus = '{m['labour_force']}'")} AS labour_force
FROM x WHERE industry IS NOT NULL AND {g.col} BETWEEN {g.lo} AND {g.hi} GROUP BY 1, 2
"""


def trade_sql(g: G, cfg: GoldConfig = GoldConfig()) -> str:
    f = cfg.focal_partner
    return f"""
WITH {OC}
SELECT {g.col}, CAST(f AS DOUBLE) AS exports_us, CAST(r + f AS DOUBLE) AS exports_total,
       CAST(f AS DOUBLE) / nullif(CAST(r + f AS DOUBLE), 0) AS us_export_share
FROM (SELECT {g.of('o_orderdate')} AS {g.col},
        sum(CASE WHEN r_name = '{f}' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS f,
        sum(CASE WHEN r_name <> '{f}' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS r,
        count(CASE WHEN r_name = '{f}' THEN 1 END) AS nf,
        count(CASE WHEN r_name <> '{f}' THEN 1 END) AS nr
      FROM oc WHERE {any_kw('o_orderpriority', cfg.trade_keywords)}
        AND {g.in_range('o_orderdate')}
      GROUP BY 1)
WHERE nf > 0 OR nr > 0
"""


def _inv_cols(cfg):
    return [f"inv_{t.lower()}" for t in cfg.investment_classes]


def infrastructure_sql(g: G, cfg: GoldConfig = GoldConfig()) -> str:
    a = {name: raw for raw, name in cfg.age_measures.items()}
    inv = _inv_cols(cfg)
    age_kw = any_kw("p_name", cfg.age_keywords)
    return f"""
WITH {LP},
  age AS (SELECT {g.of('l_shipdate')} AS {g.col},
            {exact_avg("l_quantity", f"l_returnflag = '{a['infra_avg_age_transport']}'")}
              AS infra_avg_age_transport,
            {exact_avg("l_quantity", f"l_returnflag = '{a['infra_rusl_ratio_transport']}'")}
              AS infra_rusl_ratio_transport
          FROM lp WHERE {age_kw} AND l_returnflag IN ('{"', '".join(cfg.age_measures)}')
            AND {g.in_range('l_shipdate')} GROUP BY 1),
  inv AS (SELECT {g.of('l_shipdate')} AS {g.col},
            {", ".join(exact_sum("l_extendedprice", f"p_type = '{t}'") + f" AS inv_{t.lower()}"
                       for t in cfg.investment_classes)}
          FROM lp WHERE {any_kw('p_name', cfg.investment_keywords)}
            AND {g.in_range('l_shipdate')} GROUP BY 1)
SELECT age.{g.col}, infra_avg_age_transport, infra_rusl_ratio_transport, {", ".join(inv)},
  {" + ".join(f"coalesce({c}, 0.0)" for c in inv)} AS infra_invest_total_transport
FROM age LEFT JOIN inv ON age.{g.col} = inv.{g.col}
"""


def prices_sql(g: G, cfg: GoldConfig = GoldConfig(), places: int | None = 4) -> str:
    shown = lambda e: e if places is None else f"round({e}, {places})"
    hits = [(ix.name, any_kw("p_type", ix.keywords)) for ix in cfg.price_indices]
    return f"""
WITH {LP},
  x AS (SELECT {g.of('l_shipdate')} AS {g.col}, p_type, l_extendedprice / nullif(l_quantity, 0) AS v
        FROM lp WHERE {g.in_range('l_shipdate')})
SELECT {g.col},
  {", ".join(shown(f"avg(CASE WHEN {h} THEN v END)") + f" AS {n}" for n, h in hits)}
FROM x WHERE {" OR ".join(h for _, h in hits)}
GROUP BY 1
"""


def controls_sql(g: G, cfg: GoldConfig = GoldConfig()) -> str:
    labs = cfg.industries
    return f"""
WITH {OC},
  rate AS (SELECT {g.of('l_shipdate')} AS {g.col}, {exact_avg("l_discount")} AS boc_policy_rate_avg
           FROM lineitem WHERE {g.in_range('l_shipdate')} GROUP BY 1),
  g AS (SELECT {g.col},
          {", ".join(exact_avg("o_totalprice", f"industry = '{lab}'") + f" AS gdp_{lab}"
                     for lab in labs)}
        FROM (SELECT {g.of('o_orderdate')} AS {g.col}, {industry()} AS industry, o_totalprice
              FROM oc WHERE {_geo(cfg)}
                AND {any_kw('o_orderpriority', cfg.output_keywords)})
        WHERE industry IS NOT NULL AND {g.col} BETWEEN {g.lo} AND {g.hi} GROUP BY 1)
SELECT coalesce(g.{g.col}, rate.{g.col}) AS {g.col}, {", ".join(f"gdp_{lab}" for lab in labs)},
  boc_policy_rate_avg
FROM g FULL JOIN rate ON g.{g.col} = rate.{g.col}
"""


def panel_sql(g: G, cfg: GoldConfig = GoldConfig(), price_places: int | None = 4) -> str:
    inv = _inv_cols(cfg)
    p = g.col
    return f"""
WITH lab AS ({labour_sql(g, cfg)}),
  tr AS ({trade_sql(g, cfg)}),
  inf AS ({infrastructure_sql(g, cfg)}),
  pr AS ({prices_sql(g, cfg, price_places)}),
  ct AS ({controls_sql(g, cfg)})
SELECT lab.*, tr.exports_us, tr.exports_total, tr.us_export_share,
  inf.infra_avg_age_transport, inf.infra_rusl_ratio_transport,
  {", ".join(f"inf.{c}" for c in inv)}, inf.infra_invest_total_transport,
  {", ".join(f"pr.{ix.name}" for ix in cfg.price_indices)},
  {", ".join(f"ct.gdp_{lab}" for lab in cfg.industries)}, ct.boc_policy_rate_avg
FROM lab LEFT JOIN tr ON lab.{p} = tr.{p} LEFT JOIN inf ON lab.{p} = inf.{p}
  LEFT JOIN pr ON lab.{p} = pr.{p} LEFT JOIN ct ON lab.{p} = ct.{p}
"""


def focal_sql(year_expr: str, focal: str, names=("exports_us", "exports_total", "us_export_share"),
              where: str = "TRUE") -> str:
    fn, tn, sn = names
    return f"""
WITH {OC}
SELECT year, CAST(f AS DOUBLE) AS {fn}, CAST(r + f AS DOUBLE) AS {tn},
       CAST(f AS DOUBLE) / nullif(CAST(r + f AS DOUBLE), 0) AS {sn}
FROM (SELECT {year_expr} AS year,
        sum(CASE WHEN r_name = '{focal}' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS f,
        sum(CASE WHEN r_name <> '{focal}' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS r,
        count(CASE WHEN r_name = '{focal}' THEN 1 END) AS nf,
        count(CASE WHEN r_name <> '{focal}' THEN 1 END) AS nr
      FROM oc WHERE {where} GROUP BY 1)
WHERE nf > 0 OR nr > 0
"""
