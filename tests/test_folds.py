import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.operators.folds import (expand_origins, fold_train_stats, min_history, order_grid,
                                       standardize_by_fold, train_test_split)
from tidepanel.operators.scenario import apply_scenarios, changed_cells


def _series(spark):
    rows = [("five", p, float(p)) for p in range(1, 6)] + \
           [("six", p, float(p * p)) for p in range(1, 7)] + \
           [("eight", p, float(10 - p)) for p in range(1, 9) if p != 7]
    return spark.createDataFrame(rows, "k string, p int, y double")


def test_min_history(spark):
    s = train_test_split(_series(spark), "p", 5, [6, 7, 8])
    kept = {r.k for r in min_history(s, "k", 5, 1).select("k").distinct().collect()}
    assert kept == {"six", "eight"}


def test_fold_stats_match_brute_force(spark):
    df = _series(spark)
    got = {(r.k, r.te): (r.n_train, r.mean_y, r.sd_y)
           for r in fold_train_stats(df, "k", "p", "y", [3, 5, 6, 7]).collect()}
    rows = df.collect()
    for (k, te), (n, m, s) in got.items():
        vals = [r.y for r in rows if r.k == k and r.p <= te]
        assert n == len(vals) and m == pytest.approx(np.mean(vals)) and s == pytest.approx(np.std(vals))
    # eight misses p = 7: origins 6 (no te+1) and 7 (no te) are unusable
    assert ("eight", 6) not in got and ("eight", 7) not in got and ("eight", 5) in got
    assert ("five", 5) not in got


def test_expand_origins_copies(spark):
    ex = expand_origins(_series(spark).filter("k = 'six'"), "p", [2, 4])
    assert sorted((r.p, r.te) for r in ex.collect()) == [(1, 2), (1, 4), (2, 2), (2, 4), (3, 4), (4, 4)]


def test_standardize_zero_sd(spark):
    df = spark.createDataFrame([("a", 1, 1, 3.0, True), ("a", 1, 2, 3.0, True), ("a", 1, 3, 5.0, False)],
                               "k string, te int, p int, x double, is_train boolean")
    got = [r.x_z for r in standardize_by_fold(df, "k", "te", ["x"]).orderBy("p").collect()]
    assert got == [0.0, 0.0, 2.0]


def test_order_grid(spark):
    keys = spark.createDataFrame([("a",), ("b",)], "k string")
    g = order_grid(keys, [(1, 0, 0), (0, 0, 1)])
    assert g.count() == 4 and set(g.columns) == {"k", "pos", "ar", "diff", "ma"}


def test_scenarios(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 2.0)], "k string, p int, ev double, x double")
    sc = {"baseline": [], "hi": [("ev", "set", 1.0)], "up": [("x", "add", math.log1p(0.2))]}
    got = {r.scenario: (r.ev, r.x) for r in apply_scenarios(df, sc).collect()}
    assert got["baseline"] == (1.0, 2.0) and got["hi"] == (1.0, 2.0)
    assert got["up"][1] == pytest.approx(2.0 + math.log1p(0.2))
    cc = {r.scenario: r.changed_cells for r in changed_cells(df, sc, ["ev", "x"]).collect()}
    assert cc == {"baseline": 0, "hi": 0, "up": 1}
    with pytest.raises(ValueError):
        apply_scenarios(df, {"bad": [("nope", "set", 1.0)]})
    with pytest.raises(ValueError):
        apply_scenarios(df, {"bad": [("x", "mul", 1.0)]})
