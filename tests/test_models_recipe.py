import math

import numpy as np
import pytest

from tidepanel.plans.models import ForecastSpec, prepared, recipe_backtest, scenarios


def _features(spark):
    rng = np.random.default_rng(5)
    rows = []
    for ind, n in (("a", 14), ("b", 14), ("short", 7)):
        y = 5.0
        for t in range(2010, 2010 + n):
            if ind == "b" and t == 2021:
                continue                                     # b misses 2021
            y = 0.5 * y + 2.5 + float(rng.normal() * 0.1)
            share = None if t == 2012 else 0.5 + 0.01 * (t - 2010)   # a gap to fill
            inv = float("inf") if t == 2013 else 3.0 + 0.1 * (t - 2010)
            rows.append((ind, t, y, int(t >= 2018), share, inv, 1.0 + 0.05 * (t - 2010)))
    return spark.createDataFrame(
        rows, "industry string, year int, unemployment_rate double, tariff_2018 int, "
              "us_export_share double, infra_invest_log double, boc_policy_rate_avg double")


SPEC = ForecastSpec(origins=(2019, 2020, 2021), train_end=2021, test_periods=(2022, 2023),
                    scenarios={"baseline": [], "high_tariffs": [("tariff_2018", "set", 1.0)],
                               "high_infrastructure": [("infra_invest_log", "add", math.log1p(0.2))]})


def test_recipe_gates_and_folds(spark):
    rows = prepared(_features(spark), SPEC)
    assert {r.industry for r in rows.select("industry").distinct().collect()} == {"a", "b"}
    out = recipe_backtest(rows, SPEC).collect()
    assert len(out) == 6                                     # every series and origin has a row
    bt = {(r.industry, r.train_end) for r in out if r.predicted is not None}
    assert {r.status for r in out if r.predicted is None} == {"missing_period"}
    # b has no 2021: origin 2020 (no te + 1) and 2021 (no te) are skipped
    assert bt == {("a", 2019), ("a", 2020), ("a", 2021), ("b", 2019)}


def test_recipe_scenarios(spark):
    rows = prepared(_features(spark), SPEC)
    sc = {(r.industry, r.scenario, r.year): r.predicted for r in scenarios(rows, SPEC).collect()}
    for y in (2022, 2023):
        # the tariff step is already 1 in the test years: same forecast
        assert sc[("a", "high_tariffs", y)] == pytest.approx(sc[("a", "baseline", y)], rel=1e-12)
        assert sc[("a", "high_infrastructure", y)] != pytest.approx(sc[("a", "baseline", y)])


def test_scenario_fill_median_per_series_and_scenario(spark):
    from tidepanel.plans.models import scenario_fill
    df = spark.createDataFrame(
        [("a", 1, "s", 1.0), ("a", 2, "s", float("inf")), ("a", 3, "s", 3.0),
         ("a", 1, "t", 10.0), ("a", 2, "t", None), ("b", 1, "s", None)],
        "k string, p int, scenario string, x double")
    got = {(r.k, r.p, r.scenario): r.x for r in scenario_fill(df, "k", ["x"]).collect()}
    assert got[("a", 2, "s")] == 2.0 and got[("a", 2, "t")] == 10.0 and got[("b", 1, "s")] is None


def test_holdout_picks_order_and_scores(spark):
    from tidepanel.plans.models import holdout
    rows = prepared(_features(spark), SPEC)
    out = {r.industry: r for r in holdout(rows, SPEC, [(0, 0, 0), (1, 0, 0)]).collect()}
    assert set(out) == {"a", "b"}
    for r in out.values():
        assert r.ord in ("(0, 0, 0)", "(1, 0, 0)") and r.n_forecasts == 2
        assert r.rmse >= r.mae >= 0
