"""The gold layer over ingested archives (the source pipeline's own inputs).

``ingest`` (sources/archives.py) turns each product archive into a long
table with sanitised column names.  This module names the columns each
gold builder needs ("roles") for each product, renames them, and runs the
same builders as the stand-in path, so archives -> silver -> gold -> panel
is one chain of DataFrame plans.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import keyword_any
from .gold import GoldConfig, GoldTables, PriceIndex, gold_controls, gold_infrastructure, \
    gold_labour, gold_trade, period_means

# The product registry of the source pipeline (name -> table id).
# Two ids occur twice (18100256, 18100265).
PRODUCTS = {
    "labour_force_survey": "14100023",
    "merchandise_trade": "12100176",
    "internation_merchandise_trade": "12100011",
    "infrastructure_economics_accounts": "36100611",
    "industries_product_price_index": "18100256",
    "construction_material_price_index": "18100265",
    "infrastructure_investment_asset": "36100097",
    "cpi": "18100256",
    "industrial_product_price": "18100265",
    "gdp_by_industry": "36100434",
    "boc_policy_rate": "10100122",
}

# Scope, category rules and keyword lists of the source
# pipeline's gold layer.  Measure labels are matched exactly (the source
# picked pivot columns by substring, where "employment" also hits
# "unemployment rate"); the labels below are the ones its code looks for.
REFERENCE_GOLD = GoldConfig(
    grain="year", period_col="year", start=2016, end=2025, geo="Canada",
    industry_rules=(("construction", "construction"), ("manufacturing", "manufacturing"),
                    ("retail trade", "retail_trade"), ("retail", "retail_trade")),
    labour_measures={"Unemployment rate": "unemployment_rate", "Employment": "employment",
                     "Labour force": "labour_force"},
    trade_keywords=("export",), focal_partner="United States",
    age_keywords=("transport",),
    age_rules=(("remaining", "infra_rusl_ratio_transport"),
               ("useful", "infra_rusl_ratio_transport"),
               ("service life", "infra_rusl_ratio_transport"),
               ("age", "infra_avg_age_transport")),
    investment_keywords=("road", "highway", "rail", "airport", "port", "marine"),
    investment_classes=(),
    price_indices=(PriceIndex("cpi_core_avg", ("core",)),
                   PriceIndex("construction_material_price_index_avg",
                              ("lumber", "steel", "construction")),
                   PriceIndex("industrial_product_price_index_avg",
                              ("lumber", "steel", "construction"))),
    output_keywords=("chained",),
)

NAICS = "north_american_industry_classification_system_naics"
NAPCS = "north_american_product_classification_system_napcs"

# Which sanitised silver column plays which role, per product.
SILVER_ROLES: dict[str, dict[str, str]] = {
    "labour_force_survey": {"industry_label": NAICS, "measure": "labour_force_characteristics"},
    "internation_merchandise_trade": {"trade": "trade", "partner": "principal_trading_partners"},
    "infrastructure_economics_accounts": {"asset_function": "asset_function",
                                          "estimate": "estimate"},
    "infrastructure_investment_asset": {"assets": "assets", "asset_class": "assets"},
    "cpi": {"product_class": "alternative_measures"},
    "construction_material_price_index": {"product_class": NAPCS},
    "industrial_product_price": {"product_class": NAPCS},
    "boc_policy_rate": {},
    "gdp_by_industry": {"industry_label": NAICS, "prices": "prices"},
}


def registry(spark: SparkSession) -> DataFrame:
    """The product registry as a table."""
    return spark.createDataFrame(sorted(PRODUCTS.items()), "product string, product_id string")


def duplicate_ids(reg: DataFrame) -> DataFrame:
    """Ids registered under more than one product (q7)."""
    return (reg.groupBy("product_id")
               .agg(F.count("product").alias("n_products"),
                    F.sort_array(F.collect_list("product")).alias("products"))
               .filter(F.col("n_products") > 1))


def with_roles(df: DataFrame, product: str) -> DataFrame:
    """Rename a product's silver columns to the builders' roles; keeps
    ``ref_date``, ``geo`` and ``value``."""
    roles = SILVER_ROLES[product]
    cols = [F.col("ref_date").cast("string").alias("ref_date")]
    if "geo" in df.columns:
        cols.append(F.col("geo"))
    cols += [F.col(src).alias(role) for role, src in roles.items()]
    cols.append(F.col("value"))
    return df.select(*cols)


def gold_tables_from_silver(silver: Mapping[str, DataFrame],
                            cfg: GoldConfig = REFERENCE_GOLD) -> GoldTables:
    """The five period tables from ingested products (D1-D5).  Columns per
    asset come from ``cfg.investment_classes`` (see :func:`asset_classes`);
    without a list there is the total only."""
    r = {p: with_roles(df, p) for p, df in silver.items()}
    prices = period_means(r, [(p, "product_class", ix.keywords, ix.name)
                              for p, ix in zip(("cpi", "construction_material_price_index",
                                                "industrial_product_price"), cfg.price_indices)],
                          cfg)
    return GoldTables(
        labour=gold_labour(r["labour_force_survey"], cfg),
        trade=gold_trade(r["internation_merchandise_trade"], cfg),
        infrastructure=gold_infrastructure(r["infrastructure_economics_accounts"],
                                           r["infrastructure_investment_asset"], cfg),
        prices=prices,
        controls=gold_controls(r["boc_policy_rate"], r["gdp_by_industry"], cfg),
    )


def asset_classes(silver: Mapping[str, DataFrame], cfg: GoldConfig = REFERENCE_GOLD) -> DataFrame:
    """The asset labels that pass the keyword filter, one row each: what a
    caller who wants a column per asset can choose from."""
    inv = with_roles(silver["infrastructure_investment_asset"], "infrastructure_investment_asset")
    return (inv.filter(keyword_any("assets", cfg.investment_keywords))
            .select("asset_class").distinct().filter(F.col("asset_class").isNotNull()))
