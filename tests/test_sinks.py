import pytest
from pyspark.sql import functions as F

from tidepanel import sinks
from tidepanel.plans import gold


def test_write_table_roundtrip_and_overwrite(spark, tmp_path):
    sinks.ensure_schema(spark, "t_sinks")
    df = spark.createDataFrame([(2000, "a", 1.0), (2001, "b", 2.0)], "year int, `Industry Name` string, v double")
    m = sinks.write_table(df, "t_sinks.t1", partition_cols=["year"])
    assert m["rows"] == 2 and m["columns"] == ["year", "industry_name", "v"]
    back = sinks.read_table_ordered(spark, "t_sinks.t1", m["columns"])
    assert back.columns == m["columns"] and back.count() == 2
    df2 = spark.createDataFrame([(2002, 9)], "year int, other int")
    sinks.write_table(df2, "t_sinks.t1", partition_cols=["year"])
    assert set(spark.table("t_sinks.t1").columns) == {"year", "other"}
    sinks.set_properties(spark, "t_sinks.t1", {"layer": "derived", "grain": "industry-year",
                                               "note": "the writer's \\ note"})
    props = {r.key: r.value for r in spark.sql("SHOW TBLPROPERTIES t_sinks.t1").collect()}
    assert props["layer"] == "derived" and props["note"] == "the writer's \\ note"


def test_write_path_manifest(spark, tmp_path):
    df = spark.range(17)
    m = sinks.write_path(df, str(tmp_path / "silver"))
    assert m["rows"] == 17
    assert spark.read.parquet(str(tmp_path / "silver")).count() == 17
    assert sinks.stamp(df, "2026-01-01T00:00:00").select("run_utc").distinct().count() == 1


def test_run_to_gold_reads_back(spark, sf):
    m = sinks.run_to_gold(spark, sf, "t_gold")
    assert set(m) == {"labour", "trade", "infrastructure", "prices", "controls", "panel"}
    direct = gold.gold_panel(gold.build_gold_tables(spark, sf))
    assert m["panel"]["rows"] == direct.count()


def test_run_features_with_properties(spark, sf):
    from tidepanel.plans.features import standin_spec
    sinks.run_to_gold(spark, sf, "t_feat")
    m = sinks.run_features(spark, "t_feat", "t_feat.gold_panel", standin_spec(), "2026-01-01T00:00:00")
    f = spark.table("t_feat.features")
    assert m["features"]["rows"] == f.count() > 0
    assert f.select("derived_run_utc").distinct().first()[0] == "2026-01-01T00:00:00"
    props = {r.key: r.value for r in spark.sql("SHOW TBLPROPERTIES t_feat.features").collect()}
    assert props["layer"] == "derived" and props["grain"] == "industry-year"
    d = spark.table("t_feat.feature_dictionary")
    assert d.count() == 29 and d.filter("n_non_null IS NULL").count() == 0
    assert {"description", "source", "grain", "created_utc"} <= set(d.columns)


def test_model_output_tables(spark):
    from test_models_recipe import SPEC, _features
    sinks.ensure_schema(spark, "t_models")
    sinks.write_table(_features(spark), "t_models.features", sanitize=False)
    m = sinks.run_forecasts(spark, "t_models", "t_models.features", SPEC, "2026-01-01T00:00:00")
    assert set(m) == {"forecast_predictions", "forecast_metrics", "forecast_models",
                      "forecast_scenarios", "forecast_metadata"}
    assert m["forecast_predictions"]["rows"] == 4 and m["forecast_metrics"]["rows"] == 6
    assert m["forecast_models"]["rows"] == 2 * 8 and m["forecast_metadata"]["rows"] == 1
    meta = spark.table("t_models.forecast_metadata").first()
    assert meta.run_utc == "2026-01-01T00:00:00" and "covid" in meta.exog_cols
    r = sinks.run_regression(spark, "t_models", "t_models.features", "unemployment_rate",
                             ["boc_policy_rate_avg"], ["industry"], "HC1", "2026-01-01T00:00:00")
    assert r["regression_coefficients"]["rows"] == 4 and r["regression_metrics"]["rows"] == 1
    meta = spark.table("t_models.regression_metadata").first()
    assert meta.fixed_effects == "industry" and meta.assumptions and meta.purpose
    assert spark.table("t_models.regression_coefficients").filter("run_utc IS NULL").count() == 0


def test_publish_swaps_in_one_step(spark):
    sinks.ensure_schema(spark, "t_swap")
    one = spark.createDataFrame([(2000, "a", 1.5), (2001, "b", None)],
                                "year int, `Industry Name` string, v double")
    m = sinks.publish(one, "t_swap.t", partition_cols=["year"])
    assert m["rows"] == 2 and spark.table("t_swap.t").columns == ["year", "industry_name", "v"]
    assert spark.table("t_swap.t").dtypes[0] == ("year", "int")
    # another schema; the name itself is read by what replaces it
    more = spark.table("t_swap.t").selectExpr("industry_name AS name", "CAST(year AS string) AS y")
    sinks.publish(more, "t_swap.t")
    assert sorted(map(tuple, spark.table("t_swap.t").collect())) == [("a", "2000"), ("b", "2001")]
    assert len(sinks.versions(spark, "t_swap.t")) == 2
    # a write that fails half-way leaves the old rows readable
    bad = spark.range(1000).selectExpr(
        "id", "CASE WHEN id = 997 THEN raise_error('stop') ELSE 'x' END AS name")
    with pytest.raises(Exception, match="stop"):
        sinks.publish(bad, "t_swap.t")
    assert spark.table("t_swap.t").count() == 2 and len(sinks.versions(spark, "t_swap.t")) == 2
    sinks.publish(spark.range(3), "t_swap.t")
    sinks.set_properties(spark, "t_swap.t", {"layer": "derived"})
    assert spark.table("t_swap.t").count() == 3 and len(sinks.versions(spark, "t_swap.t")) == 2
    sinks.write_table(one, "t_swap.plain")
    with pytest.raises(ValueError, match="is a table"):
        sinks.publish(one, "t_swap.plain")


def test_features_by_swap(spark, sf):
    from tidepanel.plans.features import standin_spec
    sinks.run_to_gold(spark, sf, "t_feat_swap")
    for _ in range(2):
        m = sinks.run_features(spark, "t_feat_swap", "t_feat_swap.gold_panel", standin_spec(),
                               "2026-01-01T00:00:00", swap=True)
    assert spark.table("t_feat_swap.features").count() == m["features"]["rows"] > 0
    props = {r.key: r.value for r in spark.sql("SHOW TBLPROPERTIES t_feat_swap.features").collect()}
    assert props["layer"] == "derived"
