"""Queries for the feature layer (build step 3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import growth, log1p, pulse_dummy, safe_div, step_dummy
from ..operators.windows import first_difference, lag
from ..sources.tables import read_table
from ..functions.scalars import add_period
from . import features as feat
from . import gold
from .catalog_gold import PANEL_RAW_SQL, PANEL_ROUNDING, panel_df
from .registry import query, rounded
from .sql_gold import of_config, panel_sql
from .series import (NATION_SEGMENT_MONTH_SQL, SEGMENT_MONTH_SQL, month_index,
                     nation_segment_month, segment_month)

E1, E2 = month_index(1998, 1), month_index(2000, 1)
PULSE = list(range(month_index(1999, 1), month_index(2000, 12) + 1))
W = "WINDOW w AS (PARTITION BY k ORDER BY p)"


@query("event_dummies", step=3, sql=f"""
WITH {SEGMENT_MONTH_SQL}
SELECT k, p, CAST(p >= {E1} AS INTEGER) AS ev_1998, CAST(p >= {E2} AS INTEGER) AS ev_2000
FROM sm
""")
def q_event_dummies(spark, d):
    """Step dummies from a first period on."""
    sm = segment_month(spark, d)
    return sm.select("k", "p", step_dummy("p", E1).alias("ev_1998"),
                     step_dummy("p", E2).alias("ev_2000"))


@query("pulse_dummy", step=3, sql=f"""
WITH {SEGMENT_MONTH_SQL}
SELECT k, p, CAST(p BETWEEN {PULSE[0]} AND {PULSE[-1]} AS INTEGER) AS pulse FROM sm
""")
def q_pulse_dummy(spark, d):
    """1 inside a window of periods (1999-2000)."""
    sm = segment_month(spark, d)
    return sm.select("k", "p", pulse_dummy("p", PULSE).alias("pulse"))


@query("diff_ratio", step=3, sql=f"""
WITH {SEGMENT_MONTH_SQL}
SELECT k, p, n_orders - n_f AS n_other, round(n_f / nullif(n_orders, 0), 6) AS f_share,
       round(x_p / nullif(x1, 0), 6) AS p_to_all
FROM sm
""")
def q_diff_ratio(spark, d):
    """Difference and null-safe ratios."""
    sm = segment_month(spark, d)
    return rounded(sm.select("k", "p", (F.col("n_orders") - F.col("n_f")).alias("n_other"),
                             safe_div(F.col("n_f"), F.col("n_orders")).alias("f_share"),
                             safe_div("x_p", "x1").alias("p_to_all")), 6)


@query("log_transforms", step=3, sql=f"""
WITH {SEGMENT_MONTH_SQL}
SELECT k, p, round(CASE WHEN y > -1 THEN ln(1 + y) END, 8) AS log_y,
       round(ln(1 + n_orders), 8) AS log_n FROM sm
""")
def q_log_transforms(spark, d):
    """log1p."""
    sm = segment_month(spark, d)
    return rounded(sm.select("k", "p", log1p("y").alias("log_y"),
                             log1p(F.col("n_orders")).alias("log_n")), 8)


@query("interactions", step=3, sql=f"""
WITH {SEGMENT_MONTH_SQL}
SELECT k, p, round(CAST(p >= {E1} AS INTEGER) * y, 8) AS ev_1998_x_y,
       round(CAST(p >= {E2} AS INTEGER) * x1, 8) AS ev_2000_x_x1 FROM sm
""")
def q_interactions(spark, d):
    """Dummy x continuous."""
    sm = segment_month(spark, d)
    return rounded(sm.select("k", "p", (step_dummy("p", E1) * F.col("y")).alias("ev_1998_x_y"),
                             (step_dummy("p", E2) * F.col("x1")).alias("ev_2000_x_x1")), 8)


@query("yoy_growth", step=3, sql=f"""
WITH {SEGMENT_MONTH_SQL}
SELECT k, p, round(y / nullif(lag(y, 12) OVER w, 0) - 1, 8) AS y_yoy,
       round(y / nullif(lag(y, 1) OVER w, 0) - 1, 8) AS y_growth
FROM sm {W}
""")
def q_yoy_growth(spark, d):
    """X / lag - 1, 12 and 1 rows back."""
    sm = segment_month(spark, d)
    return rounded(sm.select("k", "p", growth("y", lag("y", "k", "p", 12)).alias("y_yoy"),
                             growth("y", lag("y", "k", "p", 1)).alias("y_growth")), 8)


@query("lag_features", step=3, sql=f"""
WITH {SEGMENT_MONTH_SQL}
SELECT k, p, lag(y) OVER w AS y_lag1, lag(x1) OVER w AS x1_lag1, lag(x_p) OVER w AS x_p_lag1
FROM sm {W}
""")
def q_lag_features(spark, d):
    """Several lags on one window spec (one exchange + sort)."""
    sm = segment_month(spark, d)
    return sm.select("k", "p", *[lag(c, "k", "p").alias(f"{c}_lag1") for c in ("y", "x1", "x_p")])


@query("lag_calendar_strict", step=3, sql=f"""
WITH {NATION_SEGMENT_MONTH_SQL}
SELECT k, p, y AS v, lag(y) OVER w AS v_lag_row,
       CASE WHEN p - lag(p) OVER w = 1 THEN lag(y) OVER w END AS v_lag_strict
FROM sm {W}
""")
def q_lag_calendar_strict(spark, d):
    """W2 strict: a lag only when the previous row is exactly one period back
    (months without an order of a nation and segment are missing)."""
    sp = nation_segment_month(spark, d).withColumnRenamed("y", "v")
    return sp.select("k", "p", "v", lag("v", "k", "p").alias("v_lag_row"),
                     lag("v", "k", "p", strict=True).alias("v_lag_strict"))


@query("first_difference", step=3, sql=f"""
WITH {SEGMENT_MONTH_SQL}
SELECT k, p, round(y - lag(y) OVER w, 8) AS dy FROM sm {W}
""")
def q_first_difference(spark, d):
    """Y - lag(y)."""
    sm = segment_month(spark, d)
    return rounded(sm.select("k", "p", first_difference("y", "k", "p").alias("dy")), 8)


@query("model_rows", step=3, sql=f"""
WITH {SEGMENT_MONTH_SQL}
SELECT * FROM (SELECT k, p, x_p, lag(x_p) OVER w AS x_p_lag1 FROM sm {W})
WHERE x_p_lag1 IS NOT NULL
""")
def q_model_rows(spark, d):
    """keep rows whose lag is present."""
    sm = segment_month(spark, d)
    return (sm.select("k", "p", "x_p", lag("x_p", "k", "p").alias("x_p_lag1"))
              .filter(F.col("x_p_lag1").isNotNull()))


# ---------------------------------------------------------------- D7 / D8

SPEC = feat.standin_spec()


# Values that the engines compute by different algorithms (sums of inexact
# unit prices, logarithms) are rounded in the final projection only.
PRICE_MEANS = ("cpi_core_avg", "construction_material_price_index_avg",
               "industrial_product_price_index_avg")
FEATURE_ROUNDING = {**{c: 4 for c in PRICE_MEANS},
                    **{c: 4 for c in ("cpi_core_lag1", "cm_index_lag1", "ipp_index_lag1")},
                    **{c: 6 for c in ("inflation_proxy", "construction_cost_pressure",
                                      "industrial_cost_pressure", "log_exports_total",
                                      "log_exports_us", "infra_invest_log")}}


def _feature_places(columns):
    return {c: FEATURE_ROUNDING.get(c, 6 if c.endswith("_x_infra_invest") else None)
            for c in columns}


def features_df(spark, d, cfg: gold.GoldConfig | None = None, spec: feat.FeatureSpec = SPEC):
    """Features over the gold panel, unrounded."""
    panel = panel_df(spark, d, cfg) if cfg is not None else panel_df(spark, d)
    return feat.build_features(panel, spec)


def features_raw_sql(panel: str, period: str, e1: str, e2: str, s1: int, s2: int, lo: int) -> str:
    """The feature table written out by hand from its documented formulas
    (it shares nothing with the feature specification)."""
    return f"""
WITH panel AS ({panel}),
  b AS (SELECT * FROM panel WHERE industry IN ('automobile', 'building', 'machinery')
        AND {period} >= {lo}),
  l AS (SELECT *,
      CASE WHEN {period} >= {s1} THEN 1 ELSE 0 END AS {e1},
      CASE WHEN {period} >= {s2} THEN 1 ELSE 0 END AS {e2},
      labour_force - employment AS unemployment_count,
      employment / nullif(labour_force, 0) AS employment_rate,
      infra_avg_age_transport / nullif(infra_rusl_ratio_transport, 0) AS infra_gap,
      CASE WHEN exports_total > -1 THEN ln(1 + exports_total) END AS log_exports_total,
      CASE WHEN exports_us > -1 THEN ln(1 + exports_us) END AS log_exports_us,
      CASE WHEN infra_invest_total_transport > -1
           THEN ln(1 + infra_invest_total_transport) END AS infra_invest_log,
      lag(cpi_core_avg) OVER w AS cpi_core_lag1,
      lag(construction_material_price_index_avg) OVER w AS cm_index_lag1,
      lag(industrial_product_price_index_avg) OVER w AS ipp_index_lag1,
      lag(unemployment_rate) OVER w AS unemployment_rate_lag1,
      lag(exports_total) OVER w AS exports_total_lag1,
      lag(infra_invest_total_transport) OVER w AS infra_invest_total_transport_lag1,
      lag(boc_policy_rate_avg) OVER w AS boc_policy_rate_lag1
    FROM b WINDOW w AS (PARTITION BY industry ORDER BY {period}))
SELECT *,
  cpi_core_avg / nullif(cpi_core_lag1, 0) - 1 AS inflation_proxy,
  construction_material_price_index_avg / nullif(cm_index_lag1, 0) - 1
    AS construction_cost_pressure,
  industrial_product_price_index_avg / nullif(ipp_index_lag1, 0) - 1 AS industrial_cost_pressure,
  exports_total / nullif(exports_total_lag1, 0) - 1 AS exports_total_yoy,
  {e1} * us_export_share AS {e1}_x_us_share, {e2} * us_export_share AS {e2}_x_us_share,
  {e1} * infra_avg_age_transport AS {e1}_x_infra_age,
  {e2} * infra_avg_age_transport AS {e2}_x_infra_age,
  {e1} * infra_invest_log AS {e1}_x_infra_invest, {e2} * infra_invest_log AS {e2}_x_infra_invest
FROM l WHERE unemployment_rate_lag1 IS NOT NULL"""


def _shown(raw: str, e1: str, e2: str) -> str:
    cols = ", ".join(f"round({c}, {n}) AS {c}" for c, n in {
        **FEATURE_ROUNDING, f"{e1}_x_infra_invest": 6, f"{e2}_x_infra_invest": 6}.items())
    return f"SELECT * REPLACE ({cols}) FROM ({raw})"


FEATURES_SQL = features_raw_sql(PANEL_RAW_SQL, "year", "event_1998", "event_2000", 1998, 2000, 1995)


@query("features", step=3, sql=_shown(FEATURES_SQL, "event_1998", "event_2000"))
def q_features(spark, d):
    """The 25 engineered columns over the panel."""
    out = features_df(spark, d)
    return rounded(out, 6, **_feature_places(out.columns))


# The dictionary written out by hand: name, type, description, formula,
# source, kind.
_DICTIONARY = """
year|int|Calendar year extracted from ref_date|year|gold|base
industry|string|Canonical industry label|industry|gold|base
unemployment_rate|double|Unemployment rate for industry-year|unemployment_rate|gold_labour|base
us_export_share|double|US export share|exports_us / exports_total|gold_trade_partner|base
event_1998|int|Event dummy starting 1998|1 if year >= 1998 else 0|engineered|event
event_2000|int|Event dummy starting 2000|1 if year >= 2000 else 0|engineered|event
unemployment_count|double|Implied unemployed count|labour_force - employment|gold_labour|difference
employment_rate|double|Employment divided by labour force|employment / labour_force|gold_labour|ratio
infra_gap|double|Infra stress proxy|infra_avg_age_transport / infra_rusl_ratio_transport|gold_infrastructure|ratio
log_exports_total|double|Log(1+total exports)|log1p(exports_total)|gold_trade_partner|log
log_exports_us|double|Log(1+exports to US)|log1p(exports_us)|gold_trade_partner|log
infra_invest_log|double|Log(1+transport infra investment)|log1p(infra_invest_total_transport)|gold_infrastructure|log
cpi_core_lag1|double|Lagged cpi_core_avg|lag(cpi_core_avg, 1) over industry|engineered|lag
cm_index_lag1|double|Lagged construction_material_price_index_avg|lag(construction_material_price_index_avg, 1) over industry|engineered|lag
ipp_index_lag1|double|Lagged industrial_product_price_index_avg|lag(industrial_product_price_index_avg, 1) over industry|engineered|lag
unemployment_rate_lag1|double|Lagged unemployment rate by industry|lag(unemployment_rate, 1) over industry|engineered|lag
exports_total_lag1|double|Lagged exports_total by industry|lag(exports_total, 1) over industry|engineered|lag
infra_invest_total_transport_lag1|double|Lagged infra_invest_total_transport|lag(infra_invest_total_transport, 1) over industry|engineered|lag
boc_policy_rate_lag1|double|Lagged policy rate by industry|lag(boc_policy_rate_avg, 1) over industry|engineered|lag
inflation_proxy|double|YoY core CPI change|(cpi_core_avg / cpi_core_lag1) - 1|gold_prices|growth
construction_cost_pressure|double|YoY construction material index change|(construction_material_price_index_avg / cm_index_lag1) - 1|gold_prices|growth
industrial_cost_pressure|double|YoY industrial product price change|(industrial_product_price_index_avg / ipp_index_lag1) - 1|gold_prices|growth
exports_total_yoy|double|Year-over-year export growth|(exports_total / exports_total_lag1) - 1|gold_trade_partner|growth
event_1998_x_us_share|double|event_1998 dummy interacted with US export share|event_1998 * us_export_share|engineered|interaction
event_2000_x_us_share|double|event_2000 dummy interacted with US export share|event_2000 * us_export_share|engineered|interaction
event_1998_x_infra_age|double|event_1998 dummy interacted with infra age|event_1998 * infra_avg_age_transport|engineered|interaction
event_2000_x_infra_age|double|event_2000 dummy interacted with infra age|event_2000 * infra_avg_age_transport|engineered|interaction
event_1998_x_infra_invest|double|event_1998 dummy interacted with infra investment log|event_1998 * infra_invest_log|engineered|interaction
event_2000_x_infra_invest|double|event_2000 dummy interacted with infra investment log|event_2000 * infra_invest_log|engineered|interaction
"""


def _dictionary_sql():
    rows = [line.split("|") for line in _DICTIONARY.strip().splitlines()]
    values = ", ".join("(" + ", ".join(f"'{c}'" for c in r) + ")" for r in rows)
    counts = " UNION ALL ".join(
        f"SELECT '{r[0]}' AS feature_name, count({r[0]}) AS n_non_null FROM feats" for r in rows)
    return f"""
WITH feats AS ({FEATURES_SQL}),
  d AS (SELECT * FROM (VALUES {values})
        AS t(feature_name, data_type, description, formula, source, kind)),
  c AS ({counts})
SELECT d.*, 'industry-year' AS grain, c.n_non_null
FROM d LEFT JOIN c ON d.feature_name = c.feature_name
"""


@query("feature_dictionary", step=3, sql=_dictionary_sql())
def q_feature_dictionary(spark, d):
    """One documented row per base and engineered column, with its
    coverage in the feature table (every documented column must be there)."""
    return feat.feature_dictionary(spark, SPEC, features_df(spark, d))


# ---------------------------------------------------------------- month grain

MONTH_CFG = gold.GoldConfig(grain="month", period_col="month", start=month_index(1995, 1),
                            end=month_index(2001, 8), geo=None)
MONTH_SPEC = feat.reference_spec(
    event_names=feat.STANDIN_EVENTS[0],
    event_starts=(month_index(1998, 1), month_index(2000, 1)),
    categories=("automobile", "building", "machinery"), min_period=MONTH_CFG.start,
    period="month")
MONTH_PANEL_RAW_SQL = panel_sql(of_config(MONTH_CFG), MONTH_CFG, price_places=None)


@query("gold_panel_monthly", step=3, sql=panel_sql(of_config(MONTH_CFG), MONTH_CFG))
def q_gold_panel_monthly(spark, d):
    """D1-D6 at month grain (period = month index, no geography scope): the
    same builders, one configuration change."""
    return rounded(panel_df(spark, d, MONTH_CFG), 6, **PANEL_ROUNDING)


MONTH_FEATURES_SQL = features_raw_sql(
    MONTH_PANEL_RAW_SQL, "month", "event_1998", "event_2000", month_index(1998, 1),
    month_index(2000, 1), MONTH_CFG.start)


@query("features_monthly", step=3, sql=_shown(MONTH_FEATURES_SQL, "event_1998", "event_2000"))
def q_features_monthly(spark, d):
    """D7 at month grain: lags, growth and events on month indexes."""
    out = features_df(spark, d, MONTH_CFG, MONTH_SPEC)
    return rounded(out, 6, **_feature_places(out.columns))


# ---------------------------------------------------------------- day grain

@query("event_daily_panel", step=3, sql="""
WITH d AS (
  SELECT event_type,
    CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS day,
    CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(value) AS mean_value,
    count(*) AS n_events
  FROM events GROUP BY 1, 2)
SELECT event_type, day, mean_value, n_events,
  lag(mean_value) OVER w AS mean_value_lag1,
  CASE WHEN day - lag(day) OVER w = 1 THEN lag(mean_value) OVER w END AS mean_value_prev_day
FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day)
""")
def q_event_daily_panel(spark, d):
    """A1 + W2 at day grain (events: type x day): exact daily means, then the
    positional and the calendar-strict lag."""
    ev = read_table(spark, d, "events")
    ev = add_period(ev.withColumn("value", F.col("value").cast("decimal(18,2)")), "ts", "day", "day")
    daily = ev.groupBy("event_type", "day").agg(
        F.try_divide(F.sum("value").cast("double"), F.count("value").cast("double")).alias("mean_value"),
        F.count(F.lit(1)).alias("n_events"))
    return daily.select("event_type", "day", "mean_value", "n_events",
                        lag("mean_value", "event_type", "day").alias("mean_value_lag1"),
                        lag("mean_value", "event_type", "day", strict=True).alias("mean_value_prev_day"))
