"""Curated period tables and the entity-period panel.

Each builder takes long observation tables (``ref_date``, labels,
``value``) and a :class:`GoldConfig`; every step is a DataFrame operation,
so a builder is one lazy plan: scan -> pushed filters -> partial aggregate
-> shuffle on (period[, entity]) -> final aggregate.  The period tables have
at most one row per period in the configured range, a bound that holds at
any input size, so the panel's star join broadcasts them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import sanitize_name
from ..functions.scalars import (add_period, canonical_category, filter_period_range,
                                 horizontal_sum, keyword_any)
from ..operators.aggregate import focal_share, numeric, pivot_measures, weighted
from ..operators.joins import full_outer_merge, left_attach, period_count, star_join
from ..sources import standins
from .registry import materialize_all


@dataclass(frozen=True)
class PriceIndex:
    name: str
    keywords: tuple[str, ...]


@dataclass(frozen=True)
class GoldConfig:
    """Parameters of the gold layer; defaults are the test-data stand-ins.

    Periods are integers at ``grain``: calendar years, or month indexes
    ``year*12 + month - 1`` for ``grain="month"``."""
    grain: str = "year"
    period_col: str = "year"
    start: int = 1995
    end: int = 2001
    geo: str | None = "AMERICA"
    # ordered (keyword, label); first hit wins, no hit is dropped
    industry_rules: tuple[tuple[str, str], ...] = (
        ("auto", "automobile"), ("build", "building"), ("mach", "machinery"))
    labour_measures: Mapping[str, str] = field(default_factory=lambda: {
        "P": "unemployment_rate", "F": "employment", "O": "labour_force"})
    trade_keywords: tuple[str, ...] = ("urgent", "high")
    focal_partner: str = "AMERICA"
    total_labels: tuple[str, ...] = ()
    age_keywords: tuple[str, ...] = ("gear",)
    age_measures: Mapping[str, str] = field(default_factory=lambda: {
        "A": "infra_avg_age_transport", "R": "infra_rusl_ratio_transport"})
    investment_keywords: tuple[str, ...] = ("bolt", "gear", "ring", "rod")
    investment_classes: tuple[str, ...] = (
        "ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
    price_indices: tuple[PriceIndex, ...] = (
        PriceIndex("cpi_core_avg", ("standard",)),
        PriceIndex("construction_material_price_index_avg", ("promo",)),
        PriceIndex("industrial_product_price_index_avg", ("economy",)),
    )
    output_keywords: tuple[str, ...] = ("medium",)
    # ordered (keyword, name) rules for estimate labels known only by a
    # word in them; when set they replace the exact ``age_measures`` labels
    age_rules: tuple[tuple[str, str], ...] = ()

    @property
    def industries(self) -> list[str]:
        return list(dict.fromkeys(label for _, label in self.industry_rules))

    @property
    def period_bound(self) -> int:
        return period_count(self.start, self.end)

    def investment_columns(self) -> dict[str, str]:
        return {c: "inv_" + sanitize_name(c, "gold") for c in self.investment_classes}

    def gdp_columns(self) -> dict[str, str]:
        return {lab: "gdp_" + lab for lab in self.industries}


LABOUR_COLS = ("unemployment_rate", "employment", "labour_force")
WEIGHT = "n"


def _w(df: DataFrame) -> str | None:
    """Long tables may be pre-aggregated: ``value`` is then a sum over ``n``
    source rows and means are sum(value) / sum(n)."""
    return WEIGHT if WEIGHT in df.columns else None


def scope(df: DataFrame, cfg: GoldConfig, use_geo: bool = True) -> DataFrame:
    """Geography equality (F1) when the table has a ``geo`` column, period
    from ``ref_date`` (P4) and the inclusive period range (F2).  The range
    is also applied to the raw ``ref_date`` so it reaches the parquet scan."""
    if use_geo and cfg.geo is not None and "geo" in df.columns:
        df = df.filter(F.col("geo") == F.lit(cfg.geo))
    df = add_period(df, "ref_date", cfg.grain, out=cfg.period_col)
    return filter_period_range(df, cfg.period_col, cfg.start, cfg.end,
                               raw="ref_date", grain=cfg.grain)


def with_industry(df: DataFrame, cfg: GoldConfig, label_col: str = "industry_label") -> DataFrame:
    """Canonical category, uncategorised rows dropped."""
    return (df.withColumn("industry", canonical_category(label_col, cfg.industry_rules))
              .filter(F.col("industry").isNotNull()))


# ---------------------------------------------------------------- D1
def gold_labour(long: DataFrame, cfg: GoldConfig) -> DataFrame:
    df = with_industry(scope(long, cfg), cfg)
    wide = pivot_measures(df, [cfg.period_col, "industry"], "measure", "value",
                          cfg.labour_measures, how="avg", weight_col=_w(long))
    return wide.select(cfg.period_col, "industry", *LABOUR_COLS)


# ---------------------------------------------------------------- D2
def gold_trade(long: DataFrame, cfg: GoldConfig) -> DataFrame:
    df = scope(long, cfg).filter(keyword_any("trade", cfg.trade_keywords))
    return focal_share(df, cfg.period_col, "partner", "value", cfg.focal_partner,
                       exclude=cfg.total_labels)


# ---------------------------------------------------------------- D3
def gold_infrastructure(age_long: DataFrame, inv_long: DataFrame, cfg: GoldConfig) -> DataFrame:
    p = cfg.period_col
    age = scope(age_long, cfg).filter(keyword_any("asset_function", cfg.age_keywords))
    if cfg.age_rules:
        age = age.withColumn("estimate", canonical_category("estimate", cfg.age_rules))
        mapping = {name: name for _, name in cfg.age_rules}
    else:
        mapping = dict(cfg.age_measures)
    age = pivot_measures(age, [p], "estimate", "value", mapping, how="avg",
                         weight_col=_w(age_long))
    age = age.select(p, *dict.fromkeys(mapping.values()))

    inv_cols = cfg.investment_columns()
    total = "infra_invest_total_transport"
    inv = scope(inv_long, cfg).filter(keyword_any("assets", cfg.investment_keywords))
    if inv_cols:
        inv = pivot_measures(inv, [p], "asset_class", "value", inv_cols, how="sum",
                             weight_col=_w(inv_long))
        inv = inv.withColumn(total, horizontal_sum(list(inv_cols.values())))
    else:
        # without a list of classes the total is a grouped sum over the rows;
        # the number of labels never becomes a number of columns
        inv = (inv.groupBy(p).agg(F.sum(numeric(inv_long, "value")).cast("double").alias(total))
               .withColumn(total, F.coalesce(total, F.lit(0.0))))
    # years only in the investment side are lost, as in the source
    return left_attach(age, inv, on=p, right_bound=cfg.period_bound)


# ---------------------------------------------------------------- D4
def period_means(sources: Mapping[str, DataFrame],
                 indices: Sequence[tuple[str, str, Sequence[str], str]],
                 cfg: GoldConfig) -> DataFrame:
    """One mean per period for each (source name, label column, keywords,
    name), full-outer-merged on period (A3, J2).  Indices that name the same
    source are computed in one pass with conditional aggregates instead of
    one scan and one join each."""
    p = cfg.period_col
    by_source: dict[str, list] = {}
    for source, label_col, kws, name in indices:
        by_source.setdefault(source, []).append((label_col, kws, name))
    parts = []
    for source, group in by_source.items():
        df = scope(sources[source], cfg)
        hits = [(keyword_any(lc, kws) if kws else F.lit(True), name)
                for lc, kws, name in group]
        any_hit = hits[0][0]
        for h, _ in hits[1:]:
            any_hit = any_hit | h
        # rows matching no index are dropped first, so every period left
        # has at least one index, as with one table per index
        w = F.col(WEIGHT) if _w(df) else None
        v = numeric(df, "value")
        parts.append(df.filter(any_hit).groupBy(p).agg(
            *[weighted("avg", F.when(h, v), w).alias(n) for h, n in hits]))
    return full_outer_merge(parts, on=p)


def gold_prices(price: DataFrame, cfg: GoldConfig) -> DataFrame:
    return period_means({"price": price}, [("price", "product_class", ix.keywords, ix.name)
                                           for ix in cfg.price_indices], cfg)


# ---------------------------------------------------------------- D5
def gold_controls(rate_long: DataFrame, output_long: DataFrame, cfg: GoldConfig) -> DataFrame:
    p = cfg.period_col
    w = F.col(WEIGHT) if _w(rate_long) else None
    rate = (scope(rate_long, cfg)
            .groupBy(p).agg(weighted("avg", numeric(rate_long, "value"), w)
                            .alias("boc_policy_rate_avg")))
    gdp = with_industry(scope(output_long, cfg), cfg).filter(
        keyword_any("prices", cfg.output_keywords))
    gdp = pivot_measures(gdp, [p], "industry", "value", cfg.gdp_columns(), how="avg",
                         weight_col=_w(output_long))
    return full_outer_merge([gdp, rate], on=p)


# ---------------------------------------------------------------- D6
@dataclass
class GoldTables:
    labour: DataFrame
    trade: DataFrame
    infrastructure: DataFrame
    prices: DataFrame
    controls: DataFrame

    def items(self):
        return [("labour", self.labour), ("trade", self.trade),
                ("infrastructure", self.infrastructure), ("prices", self.prices),
                ("controls", self.controls)]


def build_gold_tables(spark: SparkSession, sf_dir: str, cfg: GoldConfig = GoldConfig(),
                      materialize: bool = True) -> GoldTables:
    """The five period tables over the test tables of ``sf_dir``.

    Both source joins are scanned once: each is aggregated to a month-level
    cube (bounded by label domains x months) and, with ``materialize``,
    written to the shared folder (both jobs side by side), so the five tables
    - seven aggregates - read small tables instead of re-joining the fact
    tables seven times.  Everything after that is a plan."""
    s = standins
    cubes = [s.orders_cube(spark, sf_dir, cfg), s.lineitem_cube(spark, sf_dir, cfg),
             s.rate_cube(spark, sf_dir, cfg)]
    oc, lc, rc = materialize_all(cubes) if materialize else cubes
    return GoldTables(
        labour=gold_labour(s.labour_from_cube(oc), cfg),
        trade=gold_trade(s.trade_from_cube(oc), cfg),
        infrastructure=gold_infrastructure(s.asset_age_from_cube(lc),
                                           s.asset_investment_from_cube(lc), cfg),
        prices=gold_prices(s.price_from_cube(lc), cfg),
        controls=gold_controls(rc, s.output_from_cube(oc), cfg),
    )


def gold_panel(tables: GoldTables, cfg: GoldConfig = GoldConfig()) -> DataFrame:
    """Entity-period panel: the labour table left-joined to the four period
    tables on the period (J5).  Each period table holds at most
    ``cfg.period_bound`` rows, so every join broadcasts it and the labour
    side is never shuffled for the joins."""
    return star_join(tables.labour,
                     [tables.trade, tables.infrastructure, tables.prices, tables.controls],
                     on=cfg.period_col, dim_bound=cfg.period_bound)


def panel_columns(cfg: GoldConfig = GoldConfig()) -> list[str]:
    return ([cfg.period_col, "industry", *LABOUR_COLS,
             "exports_us", "exports_total", "us_export_share",
             *dict.fromkeys(cfg.age_measures.values()),
             *cfg.investment_columns().values(), "infra_invest_total_transport",
             *[ix.name for ix in cfg.price_indices],
             *cfg.gdp_columns().values(), "boc_policy_rate_avg"])
