"""Archives shaped like the source pipeline's products -> ingest -> gold
tables -> panel -> features, checked against hand-computed values."""

import zipfile
from dataclasses import replace

import pytest

from tidepanel.plans import features as feat
from tidepanel.plans.gold import gold_panel
from tidepanel.plans.silver import (PRODUCTS, REFERENCE_GOLD, asset_classes, duplicate_ids,
                                    gold_tables_from_silver, registry)
from tidepanel.sources.archives import ingest

NAICS = "North American Industry Classification System (NAICS)"
NAPCS = "North American Product Classification System (NAPCS)"
YEARS = range(2016, 2020)


def _csv(header, rows):
    out = ["﻿" + ",".join(f'"{h}"' for h in header)]
    out += [",".join(f'"{v}"' for v in r) for r in rows]
    return "\n".join(out) + "\n"


def _products():
    p = {}
    rows = []
    for y in YEARS:
        for m in (1, 7):
            for ind, base in (("Construction [23]", 5.0), ("Manufacturing [31-33]", 6.0),
                              ("Retail trade [44-45]", 7.0), ("Mining [21]", 9.0)):
                rows.append((f"{y}-{m:02d}", "Canada", ind, "Unemployment rate", base + m / 10 + (y - 2016)))
                rows.append((f"{y}-{m:02d}", "Canada", ind, "Employment", 100 * base))
                rows.append((f"{y}-{m:02d}", "Canada", ind, "Labour force", 110 * base))
                rows.append((f"{y}-{m:02d}", "Ontario", ind, "Employment", 1.0))
    p["labour_force_survey"] = (["REF_DATE", "GEO", NAICS, "Labour force characteristics", "VALUE"], rows)
    p["internation_merchandise_trade"] = (["REF_DATE", "GEO", "Trade", "Principal trading partners", "VALUE"],
        [(f"{y}-{m:02d}", "Canada", t, partner, v) for y in YEARS for m in (1, 2)
         for t in ("Domestic export", "Import") for partner, v in (("United States", 30), ("China", 10))])
    p["infrastructure_economics_accounts"] = (["REF_DATE", "GEO", "Asset function", "Estimate", "VALUE"],
        [(str(y), "Canada", "Transportation", e, v) for y in YEARS
         for e, v in (("Average age", 20 + y - 2016), ("Remaining useful life ratio", 0.4))])
    p["infrastructure_investment_asset"] = (["REF_DATE", "GEO", "Assets", "VALUE"],
        [(str(y), "Canada", a, v) for y in YEARS
         for a, v in (("Roads and highways", 100), ("Rail", 50), ("Schools", 999))])
    p["cpi"] = (["REF_DATE", "GEO", "Alternative measures", "VALUE"],
        [(f"{y}-{m:02d}", "Canada", a, 100 + y - 2016 + m) for y in YEARS for m in (1, 3)
         for a in ("CPI-common", "CPI-trim core")])
    for prod in ("construction_material_price_index", "industrial_product_price"):
        p[prod] = (["REF_DATE", "GEO", NAPCS, "VALUE"],
            [(f"{y}-01", "Canada", n, v) for y in YEARS for n, v in (("Lumber", 200), ("Steel", 100), ("Food", 7))])
    p["boc_policy_rate"] = (["REF_DATE", "GEO", "VALUE"],
        [(f"{y}-{m:02d}", "Canada", 1.0 + m / 4) for y in YEARS for m in (1, 2)])
    p["gdp_by_industry"] = (["REF_DATE", "GEO", NAICS, "Prices", "VALUE"],
        [(f"{y}-01", "Canada", ind, pr, v) for y in YEARS
         for ind, v in (("Construction [23]", 10), ("Manufacturing [31-33]", 20))
         for pr in ("Chained (2017) dollars", "Current dollars")])
    return p


@pytest.fixture(scope="module")
def silver(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("bronze")
    for i, (prod, (header, rows)) in enumerate(_products().items()):
        pid = f"{1000 + i}"
        with zipfile.ZipFile(d / f"{prod}_cansim.zip", "w") as zf:
            zf.writestr(f"{pid}.csv", _csv(header, rows).encode("utf-8"))
            zf.writestr(f"{pid}_MetaData.csv", _csv(["Cube Title"], [(prod,)]).encode("utf-8"))
    return ingest(spark, str(d))


def test_registry_duplicates(spark):
    dup = {r.product_id: r.products for r in duplicate_ids(registry(spark)).collect()}
    assert dup == {"18100256": ["cpi", "industries_product_price_index"],
                   "18100265": ["construction_material_price_index", "industrial_product_price"]}
    assert len(PRODUCTS) == 11


def test_gold_panel_and_features_from_archives(spark, silver):
    found = sorted(r.asset_class for r in asset_classes(silver).collect())
    assert found == ["Rail", "Roads and highways"]                       # "Schools" filtered out
    cfg = replace(REFERENCE_GOLD, investment_classes=tuple(found))
    tables = gold_tables_from_silver(silver, cfg)
    total = gold_tables_from_silver(silver).infrastructure              # no list: the total only
    assert {r.year: r.infra_invest_total_transport for r in total.collect()}[2018] == 150
    assert "inv_rail" in tables.infrastructure.columns and "inv_rail" not in total.columns
    lab = {(r.year, r.industry): r for r in tables.labour.collect()}
    assert set(i for _, i in lab) == {"construction", "manufacturing", "retail_trade"}
    assert lab[(2017, "construction")].unemployment_rate == pytest.approx(5.0 + 0.4 + 1)
    assert lab[(2017, "construction")].employment == pytest.approx(500.0)   # Ontario excluded
    tr = {r.year: r for r in tables.trade.collect()}
    assert tr[2016].exports_us == 60 and tr[2016].exports_total == 80
    assert tr[2016].us_export_share == pytest.approx(0.75)
    inf = {r.year: r for r in tables.infrastructure.collect()}
    assert inf[2018].infra_avg_age_transport == 22 and inf[2018].infra_rusl_ratio_transport == 0.4
    assert inf[2018].infra_invest_total_transport == 150
    pr = {r.year: r for r in tables.prices.collect()}
    assert pr[2016].cpi_core_avg == pytest.approx(102.0)                      # "trim core" only
    assert pr[2016].construction_material_price_index_avg == 150
    ct = {r.year: r for r in tables.controls.collect()}
    assert ct[2016].gdp_construction == 10 and ct[2016].gdp_retail_trade is None
    assert ct[2016].boc_policy_rate_avg == pytest.approx(1.375)

    panel = gold_panel(tables, cfg)
    assert panel.count() == 12
    f = feat.build_features(panel, feat.reference_spec(
        categories=("construction", "manufacturing", "retail_trade"), min_period=2016))
    rows = {(r.year, r.industry): r for r in f.collect()}
    assert len(rows) == 9                                                    # 2016 has no lag
    r = rows[(2018, "construction")]
    assert r.tariff_2018 == 1 and r.tariff_2025 == 0
    assert r.unemployment_rate_lag1 == pytest.approx(lab[(2017, "construction")].unemployment_rate)
    assert r.tariff_2018_x_us_share == pytest.approx(0.75)
