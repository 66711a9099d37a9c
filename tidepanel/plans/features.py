"""Engineered feature table and its dictionary.

A :class:`FeatureSpec` lists the features as data; :func:`build_features`
turns it into two projections over the panel (one with every lag on the
shared per-entity window, one with the expressions that read those lags),
so the plan has a single Exchange + Sort on the entity, whatever the
number of features.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import growth, log1p, safe_div, step_dummy
from ..operators.joins import broadcast_bounded
from ..operators.windows import lag


@dataclass(frozen=True)
class FeatureSpec:
    key: str = "industry"
    period: str = "year"
    categories: tuple[str, ...] | None = None          # F6 whitelist
    min_period: int | None = None                      # F2 lower bound
    events: tuple[tuple[str, int], ...] = ()           # (name, first period) P13
    diffs: tuple[tuple[str, str, str], ...] = ()       # name = a - b  P15
    ratios: tuple[tuple[str, str, str], ...] = ()      # name = a / b  P15, P17
    logs: tuple[tuple[str, str], ...] = ()             # name = log1p(src)  P16
    lags: tuple[tuple[str, str], ...] = ()             # name = lag(src)  W2
    growths: tuple[tuple[str, str, str], ...] = ()     # name = src / lagname - 1  P18
    interactions: tuple[tuple[str, str, str], ...] = ()  # name = dummy * x  P19
    require: str | None = None                         # F7: drop rows where null
    strict_lags: bool = False
    descriptions: dict = field(default_factory=dict, compare=False, hash=False)

    def engineered(self) -> list[tuple[str, str, str, str]]:
        """(name, type, formula, kind) for every engineered column, in
        output order."""
        out = [(n, "int", f"1 if {self.period} >= {s} else 0", "event") for n, s in self.events]
        out += [(n, "double", f"{a} - {b}", "difference") for n, a, b in self.diffs]
        out += [(n, "double", f"{a} / {b}", "ratio") for n, a, b in self.ratios]
        out += [(n, "double", f"log1p({s})", "log") for n, s in self.logs]
        out += [(n, "double", f"lag({s}, 1) over {self.key}", "lag") for n, s in self.lags]
        out += [(n, "double", f"({s} / {lg}) - 1", "growth") for n, s, lg in self.growths]
        out += [(n, "double", f"{d} * {x}", "interaction") for n, d, x in self.interactions]
        return out


def reference_spec(event_names=("tariff_2018", "tariff_2025"), event_starts=(2018, 2025),
                   categories=None, min_period=None, key="industry", period="year",
                   strict_lags=False) -> FeatureSpec:
    """The 25 engineered features of the panel, with the two step events
    given as (names, first periods).  Fixed values: the names and formulas."""
    e1, e2 = event_names
    return FeatureSpec(
        key=key, period=period, categories=categories, min_period=min_period,
        events=((e1, event_starts[0]), (e2, event_starts[1])),
        diffs=(("unemployment_count", "labour_force", "employment"),),
        ratios=(("employment_rate", "employment", "labour_force"),
                ("infra_gap", "infra_avg_age_transport", "infra_rusl_ratio_transport")),
        logs=(("log_exports_total", "exports_total"), ("log_exports_us", "exports_us"),
              ("infra_invest_log", "infra_invest_total_transport")),
        lags=(("cpi_core_lag1", "cpi_core_avg"),
              ("cm_index_lag1", "construction_material_price_index_avg"),
              ("ipp_index_lag1", "industrial_product_price_index_avg"),
              ("unemployment_rate_lag1", "unemployment_rate"),
              ("exports_total_lag1", "exports_total"),
              ("infra_invest_total_transport_lag1", "infra_invest_total_transport"),
              ("boc_policy_rate_lag1", "boc_policy_rate_avg")),
        growths=(("inflation_proxy", "cpi_core_avg", "cpi_core_lag1"),
                 ("construction_cost_pressure", "construction_material_price_index_avg",
                  "cm_index_lag1"),
                 ("industrial_cost_pressure", "industrial_product_price_index_avg",
                  "ipp_index_lag1"),
                 ("exports_total_yoy", "exports_total", "exports_total_lag1")),
        interactions=tuple(
            (f"{d}_x_{short}", d, x)
            for short, x in (("us_share", "us_export_share"),
                             ("infra_age", "infra_avg_age_transport"),
                             ("infra_invest", "infra_invest_log"))
            for d in (e1, e2)),
        require="unemployment_rate_lag1",
        strict_lags=strict_lags,
    )


# Stand-in events on the test data: steps from 1998 and 2000 (year grain).
STANDIN_EVENTS = (("event_1998", "event_2000"), (1998, 2000))


def standin_spec(**kw) -> FeatureSpec:
    return reference_spec(event_names=STANDIN_EVENTS[0], event_starts=STANDIN_EVENTS[1],
                          categories=("automobile", "building", "machinery"),
                          min_period=1995, **kw)


def build_features(panel: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Filters (F6, F2), then every engineered column (P13-P19, W2), then
    the required-lag filter (F7)."""
    df = panel
    if spec.categories is not None:
        df = df.filter(F.col(spec.key).isin(list(spec.categories)))
    if spec.min_period is not None:
        df = df.filter(F.col(spec.period) >= spec.min_period)
    k, p = spec.key, spec.period
    layer1 = {}
    for n, s in spec.events:
        layer1[n] = step_dummy(p, s)
    for n, a, b in spec.diffs:
        layer1[n] = (F.col(a) - F.col(b)).cast("double")
    for n, a, b in spec.ratios:
        layer1[n] = safe_div(a, b).cast("double")
    for n, s in spec.logs:
        layer1[n] = log1p(s).cast("double")
    for n, s in spec.lags:
        layer1[n] = lag(s, k, p, 1, spec.strict_lags).cast("double")
    df = df.withColumns(layer1)
    layer2 = {}
    for n, s, lg in spec.growths:
        layer2[n] = growth(s, lg).cast("double")
    for n, d, x in spec.interactions:
        layer2[n] = (F.col(d) * F.col(x)).cast("double")
    df = df.withColumns(layer2)
    if spec.require:
        df = df.filter(F.col(spec.require).isNotNull())
    return df


DICT_SCHEMA = ("feature_name string, data_type string, description string, formula string, "
               "source string, grain string, kind string")

# The documented columns that are not engineered (name, type,
# description, formula, source), in the names of the default panel.
BASE_ROWS = (
    ("year", "int", "Calendar year extracted from ref_date", "year", "gold"),
    ("industry", "string", "Canonical industry label", "industry", "gold"),
    ("unemployment_rate", "double", "Unemployment rate for industry-year", "unemployment_rate",
     "gold_labour"),
    ("us_export_share", "double", "US export share", "exports_us / exports_total",
     "gold_trade_partner"),
)

# What the engineered columns mean, and the period table of
# each measure.
DESCRIPTIONS = {
    "unemployment_count": "Implied unemployed count",
    "employment_rate": "Employment divided by labour force",
    "infra_gap": "Infra stress proxy",
    "log_exports_total": "Log(1+total exports)",
    "log_exports_us": "Log(1+exports to US)",
    "infra_invest_log": "Log(1+transport infra investment)",
    "inflation_proxy": "YoY core CPI change",
    "construction_cost_pressure": "YoY construction material index change",
    "industrial_cost_pressure": "YoY industrial product price change",
    "exports_total_yoy": "Year-over-year export growth",
    "unemployment_rate_lag1": "Lagged unemployment rate by industry",
    "exports_total_lag1": "Lagged exports_total by industry",
    "boc_policy_rate_lag1": "Lagged policy rate by industry",
}
MEASURE_SOURCES = {
    "labour_force": "gold_labour", "employment": "gold_labour", "unemployment_rate": "gold_labour",
    "exports_total": "gold_trade_partner", "exports_us": "gold_trade_partner",
    "infra_avg_age_transport": "gold_infrastructure",
    "infra_invest_total_transport": "gold_infrastructure",
    "cpi_core_avg": "gold_prices", "construction_material_price_index_avg": "gold_prices",
    "industrial_product_price_index_avg": "gold_prices",
}


def dictionary_rows(spec: FeatureSpec) -> list[tuple]:
    """Rows of the dictionary: the base columns, then every engineered one."""
    grain = f"{spec.key}-{spec.period}"
    rename = {"year": spec.period, "industry": spec.key}
    rows = [(rename.get(n, n), t, d, rename.get(f, f), s, grain, "base")
            for n, t, d, f, s in BASE_ROWS]
    first = {n: a for n, a, *_ in (*spec.diffs, *spec.ratios, *spec.logs, *spec.growths)}
    labels = {"us_export_share": "US export share", "infra_avg_age_transport": "infra age",
              "infra_invest_log": "infra investment log"}
    events = dict(spec.events)
    for name, typ, formula, kind in spec.engineered():
        said = spec.descriptions.get(name) or DESCRIPTIONS.get(name)
        source = MEASURE_SOURCES.get(first.get(name, ""), "engineered")
        if kind == "event":
            said = said or f"Event dummy starting {events[name]}"
        elif kind == "interaction":
            dummy, x = formula.split(" * ")
            said = said or f"{dummy} dummy interacted with {labels.get(x, x)}"
        elif kind == "lag":
            said, source = said or f"Lagged {dict(spec.lags)[name]}", "engineered"
        rows.append((name, typ, said or formula, formula, source, grain, kind))
    return rows


def feature_dictionary(spark: SparkSession, spec: FeatureSpec,
                       features: DataFrame | None = None) -> DataFrame:
    """One row per documented column (D8): type, description, formula, source
    and grain.  With the feature table given, adds each column's non-null
    count and checks that every documented column is in it."""
    rows = dictionary_rows(spec)
    d = spark.createDataFrame(rows, DICT_SCHEMA)
    if features is None:
        return d
    names = [r[0] for r in rows]
    missing = [n for n in names if n not in features.columns]
    if missing:
        raise ValueError(f"documented features missing from the table: {missing}")
    counts = features.agg(*[F.count(F.col(n)).alias(n) for n in names])
    stack = ", ".join(f"'{n}', `{n}`" for n in names)
    long = counts.selectExpr(f"stack({len(rows)}, {stack}) as (feature_name, n_non_null)")
    # one row per documented feature: a side bounded by the spec
    return d.join(broadcast_bounded(long, len(rows)), "feature_name", "left")
