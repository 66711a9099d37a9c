"""Property tests: operators against pandas brute force on random frames."""

import math

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidepanel.operators.aggregate import as_cents, focal_share, pivot_measures

ROW = st.tuples(st.integers(2000, 2003), st.sampled_from(["a", "b"]),
                st.sampled_from(["F", "O", "P", "X"]),
                st.one_of(st.none(), st.integers(-10_000, 10_000).map(lambda c: c / 100)))
SETTINGS = dict(max_examples=15, deadline=None,
                suppress_health_check=[HealthCheck.function_scoped_fixture])


@settings(**SETTINGS)
@given(st.lists(ROW, min_size=1, max_size=40))
def test_pivot_matches_pandas(spark, rows):
    df = spark.createDataFrame(rows, "p int, k string, m string, v double")
    mapping = {"F": "f", "O": "op", "P": "op"}
    got = {(r.p, r.k): (r.f, r.op) for r in
           pivot_measures(as_cents(df, "v"), ["p", "k"], "m", "v", mapping, "avg").collect()}
    pdf = pd.DataFrame(rows, columns=["p", "k", "m", "v"])
    pdf = pdf[pdf.m.isin(list(mapping))].assign(name=lambda x: x.m.map(mapping))
    want = {}
    for (p, k), g in pdf.groupby(["p", "k"]):
        means = g.groupby("name").v.mean()
        want[(p, k)] = tuple(None if n not in means or pd.isna(means[n]) else float(means[n])
                             for n in ("f", "op"))
    assert got.keys() == want.keys()
    for key in got:
        for a, b in zip(got[key], want[key]):
            assert (a is None and b is None) or a == pytest.approx(b, abs=1e-9)


FOCAL_ROW = st.tuples(st.integers(2000, 2002), st.sampled_from(["US", "CN", "MX", "ALL", None]),
                      st.integers(0, 100_000).map(lambda c: c / 100))


@settings(**SETTINGS)
@given(st.lists(FOCAL_ROW, min_size=1, max_size=30))
def test_focal_share_matches_pandas(spark, rows):
    df = spark.createDataFrame(rows, "p int, partner string, v double")
    out = {r.p: r for r in focal_share(as_cents(df, "v"), "p", "partner", "v", "US",
                                       exclude=["ALL"]).collect()}
    pdf = pd.DataFrame(rows, columns=["p", "partner", "v"])
    for p, g in pdf.groupby("p"):
        foc = g[g.partner == "US"]
        rest = g[g.partner.notna() & (g.partner != "US") & (g.partner != "ALL")]
        if foc.empty and rest.empty:
            assert p not in out
            continue
        f = foc.v.sum() if not foc.empty else None
        t = (f + rest.v.sum()) if (f is not None and not rest.empty) else None
        assert out[p].exports_us == (None if f is None else pytest.approx(f))
        assert out[p].exports_total == (None if t is None else pytest.approx(t))
        share = None if (t is None or t == 0) else f / t
        assert out[p].us_export_share == (None if share is None else pytest.approx(share))
