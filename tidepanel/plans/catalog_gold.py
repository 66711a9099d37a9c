"""Queries for the scan / scope / aggregate / gold layer (build steps 1-2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.names import sanitize_columns
from ..functions.scalars import (add_period, canonical_category, filter_period_range,
                                 horizontal_sum, keyword_any, period_expr, to_double)
from ..operators.aggregate import (annualize, as_cents, exact_mean, exact_sum as exact_total,
                                   focal_share, pivot_measures)
from ..operators.joins import full_outer_merge, left_attach, star_join
from ..sources import standins
from ..sources.tables import read_table
from . import gold
from .registry import materialize, query, rounded
from .sql_gold import (G, controls_sql, exact_avg, exact_sum, focal_sql, infrastructure_sql,
                       labour_sql, panel_sql, prices_sql, trade_sql)
from .sql_parts import LP, OC, any_kw, industry, year

CFG = gold.GoldConfig()
RULES = CFG.industry_rules
YG = G(CFG.grain, CFG.period_col, CFG.start, CFG.end)


def _orders_year(spark, d):
    o = read_table(spark, d, "orders")
    return add_period(o, "o_orderdate", "year", "year")


def _oc_year(spark, d):
    oc = standins.orders_customer(spark, d)
    return add_period(oc, "o_orderdate", "year", "year")


def _lp_year(spark, d):
    return add_period(standins.lineitem_part(spark, d), "l_shipdate", "year", "year")


# ------------------------------------------------------------------ step 1

@query("period_extract", step=1, sql=r"""
SELECT o_orderkey,
  TRY_CAST(regexp_extract(s, '^(\d{4})', 1) AS INTEGER) AS year,
  CASE WHEN TRY_CAST(regexp_extract(s, '^\d{4}-(\d{2})', 1) AS INTEGER) BETWEEN 1 AND 12
       THEN TRY_CAST(regexp_extract(s, '^(\d{4})', 1) AS INTEGER) * 12
            + TRY_CAST(regexp_extract(s, '^\d{4}-(\d{2})', 1) AS INTEGER) - 1 END AS month_idx,
  CAST(date_diff('day', DATE '1970-01-01', TRY_CAST(substring(s, 1, 10) AS DATE)) AS INTEGER) AS day_idx
FROM (SELECT o_orderkey, CAST(o_orderdate AS VARCHAR) AS s FROM orders)
""")
def q_period_extract(spark, d):
    """P4 on text dates: regex year, month index and day index."""
    o = read_table(spark, d, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("string").alias("ref_date"))
    return o.select("o_orderkey",
                    period_expr(o, "ref_date", "year").alias("year"),
                    period_expr(o, "ref_date", "month").alias("month_idx"),
                    period_expr(o, "ref_date", "day").alias("day_idx"))


@query("filter_scope", step=1, sql=f"""
WITH {OC}
SELECT o_orderkey, year, industry FROM (
  SELECT o_orderkey, {year('o_orderdate')} AS year, {industry()} AS industry
  FROM oc WHERE r_name = 'AMERICA')
WHERE year BETWEEN 1996 AND 2000 AND industry IN ('automobile', 'machinery')
""")
def q_filter_scope(spark, d):
    """F1 geography, F2 inclusive period range (pushed to the scan), F6 whitelist."""
    oc = standins.orders_customer(spark, d).filter(F.col("r_name") == "AMERICA")
    oc = add_period(oc, "o_orderdate", "year", "year")
    oc = filter_period_range(oc, "year", 1996, 2000, raw="o_orderdate")
    oc = oc.withColumn("industry", canonical_category("c_mktsegment", RULES))
    return oc.filter(F.col("industry").isin("automobile", "machinery")).select(
        "o_orderkey", "year", "industry")


@query("annualize_sum", step=1, sql=f"""
WITH {OC}
SELECT {year('o_orderdate')} AS year, r_name, {exact_sum("o_totalprice")} AS value
FROM oc GROUP BY 1, 2
""")
def q_annualize_sum(spark, d):
    """A2: flows summed per (year, group)."""
    return annualize(as_cents(_oc_year(spark, d), "o_totalprice"), ["year", "r_name"],
                     "o_totalprice", "sum")


@query("annualize_avg", step=1, sql=f"""
WITH {OC}
SELECT {year('o_orderdate')} AS year, c_mktsegment, {exact_avg("o_totalprice")} AS value
FROM oc GROUP BY 1, 2
""")
def q_annualize_avg(spark, d):
    """A1: levels averaged per (year, group)."""
    return annualize(as_cents(_oc_year(spark, d), "o_totalprice"), ["year", "c_mktsegment"],
                     "o_totalprice", "avg")


@query("focal_share", step=1, sql=focal_sql(year("o_orderdate"), "AMERICA",
                                            ("focal_value", "total_value", "focal_share")))
def q_focal_share(spark, d):
    """J1 + P12: focal, total and share per year, one conditional aggregate."""
    return focal_share(as_cents(_oc_year(spark, d), "o_totalprice"), "year", "r_name",
                       "o_totalprice", "AMERICA", focal_name="focal_value",
                       total_name="total_value", share_name="focal_share")


@query("full_outer_merge", step=1, sql=f"""
WITH a AS (SELECT {year('o_orderdate')} AS year, CAST(count(*) AS DOUBLE) AS n_orders
           FROM orders GROUP BY 1),
     b AS (SELECT {year('l_shipdate')} AS year, {exact_avg("l_discount")} AS avg_discount
           FROM lineitem GROUP BY 1),
     c AS (SELECT {year('ts')} AS year, {exact_sum("value")} AS event_value
           FROM events GROUP BY 1)
SELECT coalesce(a.year, b.year, c.year) AS year, n_orders, avg_discount, event_value
FROM a FULL JOIN b ON a.year = b.year
       FULL JOIN c ON coalesce(a.year, b.year) = c.year
""")
def q_full_outer_merge(spark, d):
    """Three period tables that cover different years, merged."""
    o = _orders_year(spark, d)
    li = add_period(read_table(spark, d, "lineitem"), "l_shipdate", "year", "year")
    ev = add_period(read_table(spark, d, "events"), "ts", "year", "year")
    # counts as double: a full merge leaves them nullable, and nullable
    # integers do not survive the trip to pandas unchanged
    a = o.groupBy("year").agg(F.count(F.lit(1)).cast("double").alias("n_orders"))
    b = li.groupBy("year").agg(exact_mean("l_discount").alias("avg_discount"))
    c = ev.groupBy("year").agg(exact_total("value").alias("event_value"))
    return full_outer_merge([a, b, c], "year")


_TRADE_SQL = trade_sql(YG, CFG)

@query("gold_focal_share", step=1, sql=_TRADE_SQL)
def q_gold_focal_share(spark, d):
    """Keyword filter, focal/rest split, total and share per year, from
    the pre-aggregated orders cube (exact decimal sums: no rounding)."""
    return gold.gold_trade(standins.trade_from_cube(standins.orders_cube(spark, d, CFG)), CFG)


# ------------------------------------------------------------------ step 2

@query("value_cast", step=2, sql=r"""
SELECT o_orderkey,
  TRY_CAST(regexp_extract(o_orderpriority, '^(\d+)', 1) AS DOUBLE) AS priority_num,
  TRY_CAST(o_orderstatus AS DOUBLE) AS status_num,
  TRY_CAST(CAST(o_totalprice AS VARCHAR) AS DOUBLE) AS price_num
FROM orders
""")
def q_value_cast(spark, d):
    """Text to double, unparsable cells null (no error under ANSI)."""
    o = read_table(spark, d, "orders")
    return o.select("o_orderkey",
                    to_double(F.regexp_extract("o_orderpriority", r"^(\d+)", 1)).alias("priority_num"),
                    to_double("o_orderstatus").alias("status_num"),
                    to_double(F.col("o_totalprice").cast("string")).alias("price_num"))


SANITIZE_INPUT = ["Order Key", "o-total.price", "(Status)", " Order  Key ", "", "prix (CAD$)",
                  "Cust/Key"]


@query("sanitize_columns", step=2, sql="""
SELECT o_orderkey AS order_key, o_totalprice AS o_total_price, o_orderstatus AS status,
       o_orderkey AS order_key_2, o_orderpriority AS col, o_totalprice AS prix_cad,
       o_custkey AS cust_key
FROM orders
""")
def q_sanitize_columns(spark, d):
    """Gold-flavour name rules and _2 de-duplication."""
    o = read_table(spark, d, "orders").select(
        "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderkey", "o_orderpriority",
        "o_totalprice", "o_custkey").toDF(*SANITIZE_INPUT)
    return sanitize_columns(o, "gold")


@query("canonical_category", step=2, sql=f"""
SELECT c_custkey, industry FROM (SELECT c_custkey, {industry()} AS industry FROM customer)
WHERE industry IS NOT NULL
""")
def q_canonical_category(spark, d):
    """Ordered keyword rules, first hit wins, no hit dropped."""
    c = read_table(spark, d, "customer")
    return (c.select("c_custkey", canonical_category("c_mktsegment", RULES).alias("industry"))
             .filter(F.col("industry").isNotNull()))


KW = ("ring", "rod", "old")


@query("keyword_any", step=2, sql=f"""
SELECT p_partkey, {any_kw('p_name', KW)} AS sub_hit,
       regexp_matches(lower(p_name), '\\b(ring|rod|old)\\b') AS word_hit
FROM part
""")
def q_keyword_any(spark, d):
    """any-of substring match (loose) and the whole-word variant."""
    p = read_table(spark, d, "part")
    return p.select("p_partkey", keyword_any("p_name", KW).alias("sub_hit"),
                    keyword_any("p_name", KW, whole_word=True).alias("word_hit"))


@query("optional_columns", step=2, sql=f"""
SELECT {year('o_orderdate')} AS year,
  {exact_avg("o_totalprice", "o_orderstatus = 'F'")} AS status_f,
  {exact_avg("o_totalprice", "o_orderstatus = 'O'")} AS status_o,
  {exact_avg("o_totalprice", "o_orderstatus = 'P'")} AS status_p,
  CAST(NULL AS DOUBLE) AS status_x
FROM orders WHERE o_orderstatus IN ('F', 'O', 'P', 'X') GROUP BY 1
""")
def q_optional_columns(spark, d):
    """A listed measure absent from the data is a typed null column."""
    m = {"F": "status_f", "O": "status_o", "P": "status_p", "X": "status_x"}
    return pivot_measures(as_cents(_orders_year(spark, d), "o_totalprice"), ["year"],
                          "o_orderstatus", "o_totalprice", m, "avg")


@query("pivot_measures", step=2, sql=f"""
SELECT {year('o_orderdate')} AS year, o_orderpriority,
  {exact_avg("o_totalprice", "o_orderstatus = 'F'")} AS fulfilled,
  {exact_avg("o_totalprice", "o_orderstatus IN ('O', 'P')")} AS open_or_partial
FROM orders WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY 1, 2
""")
def q_pivot_measures(spark, d):
    """Labels mapped to names before the pivot (two labels share one)."""
    m = {"F": "fulfilled", "O": "open_or_partial", "P": "open_or_partial"}
    return pivot_measures(as_cents(_orders_year(spark, d), "o_totalprice"),
                          ["year", "o_orderpriority"], "o_orderstatus", "o_totalprice", m, "avg")


@query("pivot_category", step=2, sql=f"""
WITH {OC}
SELECT year,
  {exact_avg("o_totalprice", "industry = 'automobile'")} AS gdp_automobile,
  {exact_avg("o_totalprice", "industry = 'building'")} AS gdp_building,
  {exact_avg("o_totalprice", "industry = 'machinery'")} AS gdp_machinery
FROM (SELECT {year('o_orderdate')} AS year, {industry()} AS industry, o_totalprice FROM oc)
WHERE industry IS NOT NULL GROUP BY 1
""")
def q_pivot_category(spark, d):
    """A4 + A6: mean per (year, category), categories as columns."""
    df = as_cents(_oc_year(spark, d), "o_totalprice").withColumn(
        "industry", canonical_category("c_mktsegment", RULES))
    return pivot_measures(df, ["year"], "industry", "o_totalprice", CFG.gdp_columns(), "avg")


def _inv_case(alias_prefix="inv_"):
    return ",\n  ".join(
        exact_sum("l_extendedprice", f"p_type = '{t}'") + f" AS {alias_prefix}{t.lower()}"
        for t in CFG.investment_classes)


@query("pivot_assets", step=2, sql=f"""
WITH {LP}
SELECT {year('l_shipdate')} AS year,
  {_inv_case()}
FROM lp WHERE {any_kw('p_name', CFG.investment_keywords)} GROUP BY 1
""")
def q_pivot_assets(spark, d):
    """A6 with sum: flows per asset class as columns."""
    df = as_cents(_lp_year(spark, d), "l_extendedprice").filter(
        keyword_any("p_name", CFG.investment_keywords))
    return pivot_measures(df, ["year"], "p_type", "l_extendedprice",
                          CFG.investment_columns(), "sum")


_HS_COLS = [f"inv_{t.lower()}" for t in CFG.investment_classes]


@query("horizontal_sum", step=2, sql=f"""
WITH {LP}
SELECT year, l_returnflag, {", ".join(_HS_COLS)},
  {" + ".join(f"coalesce({c}, 0.0)" for c in _HS_COLS)} AS total
FROM (SELECT {year('l_shipdate')} AS year, l_returnflag,
        {", ".join(exact_sum("l_extendedprice", f"p_type = '{t}'") + f" AS inv_{t.lower()}"
                   for t in CFG.investment_classes)}
      FROM lp GROUP BY 1, 2)
""")
def q_horizontal_sum(spark, d):
    """Null-as-zero row sum over sparse pivot columns."""
    df = as_cents(_lp_year(spark, d), "l_extendedprice")
    wide = pivot_measures(df, ["year", "l_returnflag"], "p_type", "l_extendedprice",
                          CFG.investment_columns(), "sum")
    return wide.withColumn("total", horizontal_sum(_HS_COLS))


_PRICE_SQL = prices_sql(YG, CFG)

@query("price_indices", step=2, sql=_PRICE_SQL)
def q_price_indices(spark, d):
    """A3: one filtered mean per index over the raw rows, one scan."""
    return rounded(gold.gold_prices(standins.price_long(spark, d), CFG), 4)


@query("gold_prices", step=2, sql=_PRICE_SQL)
def q_gold_prices(spark, d):
    """The same three indices from one scan with conditional aggregates."""
    lc = standins.lineitem_cube(spark, d, CFG)
    return rounded(gold.gold_prices(standins.price_from_cube(lc), CFG), 4)


@query("left_attach", step=2, sql=f"""
WITH a AS (SELECT {year('o_orderdate')} AS year, count(*) AS n_orders FROM orders GROUP BY 1),
     b AS (SELECT {year('l_shipdate')} AS year, {exact_avg("l_discount")} AS avg_discount
           FROM lineitem GROUP BY 1)
SELECT a.year, n_orders, avg_discount FROM a LEFT JOIN b ON a.year = b.year
""")
def q_left_attach(spark, d):
    """Left join; periods only on the right are lost."""
    a = _orders_year(spark, d).groupBy("year").agg(F.count(F.lit(1)).alias("n_orders"))
    li = add_period(read_table(spark, d, "lineitem"), "l_shipdate", "year", "year")
    b = li.groupBy("year").agg(exact_mean("l_discount").alias("avg_discount"))
    return left_attach(a, b, "year")


_LABOUR_SQL = labour_sql(YG, CFG)

@query("gold_measures", step=2, sql=_LABOUR_SQL)
def q_gold_measures(spark, d):
    """Scope, canonical industry, three measures pivoted (from the
    orders cube; exact means, no rounding)."""
    return gold.gold_labour(standins.labour_from_cube(standins.orders_cube(spark, d, CFG)), CFG)


_INFRA_SQL = infrastructure_sql(YG, CFG)

@query("gold_infrastructure", step=2, sql=_INFRA_SQL)
def q_gold_infrastructure(spark, d):
    """D3: estimate pivot (avg) left-joined to asset-class pivot (sum) + total."""
    # both sides read the cube with different filters: build it once
    lc = materialize(standins.lineitem_cube(spark, d, CFG))
    return gold.gold_infrastructure(standins.asset_age_from_cube(lc),
                                    standins.asset_investment_from_cube(lc), CFG)


_CONTROLS_SQL = controls_sql(YG, CFG)

@query("gold_controls", step=2, sql=_CONTROLS_SQL)
def q_gold_controls(spark, d):
    """Policy-rate mean full-merged with the category output pivot."""
    return gold.gold_controls(standins.rate_cube(spark, d, CFG), standins.output_from_cube(
        standins.orders_cube(spark, d, CFG)), CFG)


@query("panel_star_join", step=2, sql=f"""
WITH {OC},
  f AS (SELECT {year('o_orderdate')} AS year, c_mktsegment, count(*) AS n_orders,
          {exact_sum("o_totalprice")} AS revenue FROM oc GROUP BY 1, 2),
  r AS (SELECT {year('l_shipdate')} AS year, {exact_avg("l_discount")} AS avg_discount
        FROM lineitem GROUP BY 1),
  s AS (SELECT {year('o_orderdate')} AS year, count(*) AS n_fulfilled FROM orders
        WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT f.year, c_mktsegment, n_orders, revenue, avg_discount, n_fulfilled
FROM f LEFT JOIN r ON f.year = r.year LEFT JOIN s ON f.year = s.year
""")
def q_panel_star_join(spark, d):
    """Entity-period fact left-joined to period tables of all periods."""
    # one pass over orders: the fact table and the fulfilled-orders period
    # table both come from the (year, segment) aggregate
    f = _oc_year(spark, d).groupBy("year", "c_mktsegment").agg(
        F.count(F.lit(1)).alias("n_orders"), exact_total("o_totalprice").alias("revenue"),
        F.count_if(F.col("o_orderstatus") == "F").alias("__n_f"))
    f = materialize(f)
    li = add_period(read_table(spark, d, "lineitem"), "l_shipdate", "year", "year")
    r = li.groupBy("year").agg(exact_mean("l_discount").alias("avg_discount"))
    s = (f.groupBy("year").agg(F.sum("__n_f").alias("n_fulfilled"))
          .filter(F.col("n_fulfilled") > 0))
    return star_join(f.drop("__n_f"), [r, s], on="year")


PANEL_SQL = panel_sql(YG, CFG)
PANEL_RAW_SQL = panel_sql(YG, CFG, price_places=None)


def panel_df(spark, d, cfg: gold.GoldConfig = CFG):
    return gold.gold_panel(gold.build_gold_tables(spark, d, cfg), cfg)


# Unit-price means are sums of inexact doubles: 4 places.  Every other
# panel value is computed exactly (decimal sums) and left as is.
PRICE_COLS = ("cpi_core_avg", "construction_material_price_index_avg",
              "industrial_product_price_index_avg")
PANEL_ROUNDING = {c: (4 if c in PRICE_COLS else None)
                  for c in gold.panel_columns(CFG) if c not in ("year", "industry")}


@query("gold_panel", step=2, sql=PANEL_SQL)
def q_gold_panel(spark, d):
    """D6 (flagship): labour ⟕ trade ⟕ infrastructure ⟕ prices ⟕ controls."""
    return rounded(panel_df(spark, d), 6, **PANEL_ROUNDING)


@query("registry_duplicate_ids", step=2, sql="""
SELECT p_name, count(DISTINCT p_partkey) AS n_ids, min(p_partkey) AS first_id,
       max(p_partkey) AS last_id
FROM part GROUP BY p_name HAVING count(DISTINCT p_partkey) > 1
""")
def q_registry_duplicate_ids(spark, d):
    """S1/q7: a name registered under more than one id."""
    p = read_table(spark, d, "part")
    return (p.groupBy("p_name")
             .agg(F.count_distinct("p_partkey").alias("n_ids"),
                  F.min("p_partkey").alias("first_id"), F.max("p_partkey").alias("last_id"))
             .filter(F.col("n_ids") > 1))
