"""Writers (K1-K9).

Tables are parquet (``format`` is a parameter; a Delta jar is not assumed).
Every writer takes the mode explicitly; overwrite replaces the schema too,
which plain parquet tables do.
"""

from __future__ import annotations

import datetime as _dt
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .functions.names import sanitize_columns


def run_timestamp() -> str:
    """ISO UTC run time, as a string (K8)."""
    return _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None).isoformat()


def stamp(df: DataFrame, ts: str, col: str = "run_utc") -> DataFrame:
    """Every output row carries the run time (K8)."""
    return df.withColumn(col, F.lit(ts))


def ensure_schema(spark: SparkSession, db: str) -> None:
    """K6."""
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{db}`")


def write_path(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet",
               partition_cols: Sequence[str] = ()) -> dict:
    """Write to a path and return a manifest with the row count observed
    while writing (K1, K7) - no second pass over the data."""
    obs = Observation("manifest")
    observed = df.observe(obs, F.count(F.lit(1)).alias("rows"))
    w = observed.write.mode(mode).format(fmt)
    if partition_cols:
        w = w.partitionBy(*partition_cols)
    w.save(path)
    return {"path": path, "rows": int(obs.get["rows"]), "columns": list(df.columns)}


def write_table(df: DataFrame, name: str, mode: str = "overwrite", fmt: str = "parquet",
                partition_cols: Sequence[str] = (), sanitize: bool = True,
                repartition_by_partition: bool = True) -> dict:
    """Catalog table with gold-flavour names (K2-K4).  Rows are clustered by
    the partition columns first so each partition directory gets one file
    per task rather than one per task and value (small files)."""
    if sanitize:
        df = sanitize_columns(df, "gold")
    if partition_cols and repartition_by_partition:
        df = df.repartition(*partition_cols)
    obs = Observation(f"manifest_{name.replace('.', '_')}")
    observed = df.observe(obs, F.count(F.lit(1)).alias("rows"))
    w = observed.write.mode(mode).format(fmt)
    if partition_cols:
        w = w.partitionBy(*partition_cols)
    w.saveAsTable(name)
    return {"table": name, "rows": int(obs.get["rows"]), "columns": list(df.columns)}


def publish(df: DataFrame, name: str, fmt: str = "parquet", partition_cols: Sequence[str] = (),
            sanitize: bool = True, keep: int = 2) -> dict:
    """Overwrite ``name`` with ``df``, whatever its schema, without a moment in
    which readers see neither (K2, K3): the rows are written to a location of
    their own, and only then is the name, a view, moved to it in one catalog
    call.  A write that fails half-way leaves the name as it was; ``df`` may
    read the name itself.  The last ``keep`` versions are listed in the view's
    properties, so that older ones can be removed by whoever owns the storage
    (``versions``); nothing is deleted here."""
    spark = df.sparkSession
    if sanitize:
        df = sanitize_columns(df, "gold")
    db, _, table = name.rpartition(".")
    db = db or spark.catalog.currentDatabase()
    before: list[str] = []
    if spark.catalog.tableExists(name):
        if spark.catalog.getTable(name).tableType != "VIEW":
            raise ValueError(f"{name} is a table; publish only replaces what it has published")
        before = versions(spark, name)
    home = spark.catalog.getDatabase(db).locationUri.rstrip("/")
    path = f"{home}/{table}-{uuid.uuid4().hex}"
    m = write_path(df.repartition(*partition_cols) if partition_cols else df, path,
                   "errorifexists", fmt, partition_cols)
    columns = ", ".join(f"`{c}`" for c in df.columns)
    casts = ", ".join(f"CAST(`{c}` AS {t}) AS `{c}`" for c, t in df.dtypes)
    kept = ",".join([path, *before][:keep])
    spark.sql(f"CREATE OR REPLACE VIEW {name} ({columns}) "
              f"TBLPROPERTIES ('versions' = '{kept}') AS SELECT {casts} FROM {fmt}.`{path}`")
    return {"table": name, "rows": m["rows"], "columns": list(df.columns), "path": path}


def versions(spark: SparkSession, name: str) -> list[str]:
    """Locations of a published name's versions, the present one first."""
    props = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
    return [p for p in props.get("versions", "").split(",") if p]


def read_table_ordered(spark: SparkSession, name: str, columns: Sequence[str]) -> DataFrame:
    """Parquet tables move partition columns last; select the written order."""
    return spark.table(name).select(*columns)


def set_properties(spark: SparkSession, name: str, props: Mapping[str, str]) -> None:
    """ALTER TABLE ... SET TBLPROPERTIES (K5)."""
    def quoted(x) -> str:
        return "'" + str(x).replace("\\", "\\\\").replace("'", "\\'") + "'"
    body = ", ".join(f"{quoted(k)} = {quoted(v)}" for k, v in props.items())
    kind = "VIEW" if spark.catalog.getTable(name).tableType == "VIEW" else "TABLE"
    spark.sql(f"ALTER {kind} {name} SET TBLPROPERTIES ({body})")


MANIFEST_SCHEMA = ("product string, source string, pid string, table string, rows long, "
                   "columns array<string>, metadata_path string, rows_metadata long, "
                   "run_utc string")


def append_manifest(spark: SparkSession, name: str, entries: Sequence[dict]) -> None:
    """Append ingest manifests as rows of a table (K7)."""
    rows = [tuple(e.get(f.split()[0]) for f in MANIFEST_SCHEMA.split(", ")) for e in entries]
    spark.createDataFrame(rows, MANIFEST_SCHEMA).write.mode("append").saveAsTable(name)


def run_to_gold(spark: SparkSession, sf_dir: str, db: str, cfg=None,
                mode: str = "overwrite") -> dict:
    """Write the five period tables, then build the panel from the written
    tables (read back: the source rebuilds all five a second time) (K9)."""
    from .plans import gold
    cfg = cfg or gold.GoldConfig()
    ensure_schema(spark, db)
    tables = gold.build_gold_tables(spark, sf_dir, cfg)
    manifests = {}
    for short, df in tables.items():
        manifests[short] = write_table(df, f"{db}.gold_{short}", mode,
                                       partition_cols=[cfg.period_col])
    back = gold.GoldTables(**{
        short: read_table_ordered(spark, f"{db}.gold_{short}", df.columns)
        for short, df in tables.items()})
    panel = gold.gold_panel(back, cfg)
    manifests["panel"] = write_table(panel, f"{db}.gold_panel", mode,
                                     partition_cols=[cfg.period_col])
    return manifests


def write_derived(spark: SparkSession, df: DataFrame, name: str, props: Mapping[str, str],
                  run_ts: str | None = None, stamp_col: str = "derived_run_utc",
                  partition_cols: Sequence[str] = (), swap: bool = False) -> dict:
    """A derived table as the source pipeline writes it: every row stamped
    with the run time (K8), overwritten with its new schema (K3; ``swap``: in
    one step, by :func:`publish`), then described by table properties (K5)."""
    ts = run_ts or run_timestamp()
    rows = stamp(df, ts, stamp_col)
    if swap:
        m = publish(rows, name, partition_cols=partition_cols, sanitize=False)
    else:
        m = write_table(rows, name, "overwrite", partition_cols=partition_cols, sanitize=False)
    set_properties(spark, name, {**props, "created_utc": ts})
    return m


def run_features(spark: SparkSession, db: str, panel_table: str, spec=None,
                 run_ts: str | None = None, swap: bool = False) -> dict:
    """Panel table -> feature table and its dictionary, with properties
    (the derived layer): reads the written panel, so nothing upstream is
    recomputed.  ``swap``: replace both in one step each."""
    from .plans import features as feat
    spec = spec or feat.reference_spec()
    ensure_schema(spark, db)
    ts = run_ts or run_timestamp()
    f = feat.build_features(spark.table(panel_table), spec)
    m1 = write_derived(spark, f, f"{db}.features", {"layer": "derived",
                                                     "source_table": panel_table,
                                                     "grain": f"{spec.key}-{spec.period}"}, ts,
                       swap=swap)
    written = spark.table(f"{db}.features")
    d = feat.feature_dictionary(spark, spec, written)
    m2 = write_derived(spark, d, f"{db}.feature_dictionary",
                       {"layer": "derived", "describes_table": f"{db}.features"}, ts,
                       stamp_col="created_utc", swap=swap)
    return {"features": m1, "feature_dictionary": m2}


def run_regression(spark: SparkSession, db: str, features_table: str, y: str,
                   drivers: Sequence[str], factors: Sequence[str], cov_type: str = "HC3",
                   run_ts: str | None = None) -> dict:
    """Feature table -> regression -> coefficient, metric and metadata tables
    (K4, M5), every row with the run time."""
    from .operators.regression import fit_ols, regression_metadata
    ensure_schema(spark, db)
    ts = run_ts or run_timestamp()
    rows = spark.table(features_table)
    res = fit_ols(rows, y, ["const", *drivers], cov_type=cov_type, factors=factors)
    formula = " ~ ".join([y, " + ".join([*drivers, *(f"C({f})" for f in factors)])])
    tables = {
        "regression_coefficients": res.coefficients(spark),
        "regression_metrics": res.metrics(spark, formula),
        "regression_metadata": regression_metadata(
            spark, res, y, formula, fixed_effects=" and ".join(factors),
            feature_table=features_table)}
    return {name: write_table(stamp(df, ts), f"{db}.{name}", sanitize=False)
            for name, df in tables.items()}


FORECAST_META = ("model_name string, dependent_variable string, feature_table string, "
                 "ord string, rolling_backtest_train_ends string, exog_cols string, "
                 "standardization string, cleaning string, notes string")


def run_forecasts(spark: SparkSession, db: str, features_table: str, spec,
                  run_ts: str | None = None) -> dict:
    """Feature table -> forecasting recipe -> prediction, metric, parameter,
    scenario and metadata tables (K4, M5), every row with the run time.  The
    cleaned model rows are written once and read by all of them."""
    from .plans import models
    from .plans.registry import materialize
    ensure_schema(spark, db)
    ts = run_ts or run_timestamp()
    rows = materialize(models.prepared(spark.table(features_table), spec))
    back = materialize(models.recipe_backtest(rows, spec))
    fit = ["ord", "status", "aic", "bic"]
    shown = [c for c in back.columns if c not in fit]
    meta = spark.createDataFrame([(
        "arx_rolling", spec.y, features_table, "({}, {}, {})".format(*spec.order),
        ",".join(map(str, spec.origins)), ",".join(spec.exog),
        "mean and deviation of the training rows only",
        "inf to null, fill forward and back per series, global median",
        "Autoregression with drivers by conditional least squares; one-step forecasts from "
        "rolling origins.")], FORECAST_META)
    tables = {
        "forecast_predictions": back.filter(F.col("predicted").isNotNull()).select(*shown),
        "forecast_metrics": back.select(spec.key, "train_end", "test_period", *fit),
        "forecast_models": models.final_params(rows, spec),
        "forecast_scenarios": models.scenarios(rows, spec),
        "forecast_metadata": meta}
    return {name: write_table(stamp(df, ts), f"{db}.{name}", sanitize=False)
            for name, df in tables.items()}


def ingest_to_silver(spark: SparkSession, location: str, silver_base: str,
                     manifest_table: str | None = None, mode: str = "overwrite") -> list[dict]:
    """Every archive in ``location`` -> ``{silver_base}/{product}/data`` and
    ``/metadata`` (K1), with one manifest entry per product: ids, paths,
    row counts observed while writing and the data columns (K7); appended
    to ``manifest_table`` when given.  Each archive is unzipped once."""
    from .sources.archives import pair_metadata, staged_archives, tables_of
    ts = run_timestamp()
    lines = staged_archives(spark, location)
    tables = tables_of(lines, {"data": None, "metadata": {}})
    sidecars, pids = {}, {}
    for r in pair_metadata(spark, location).collect():
        sidecars.setdefault(r["product"], r["metadata_json"])
    for r in lines.filter("line_no = 0").select("product", "pid").distinct().collect():
        pids.setdefault(r["product"], set()).add(r["pid"])
    base = silver_base.rstrip("/")
    entries = []
    for product, df in sorted(tables["data"].items()):
        d = write_path(df.drop("product"), f"{base}/{product}/data", mode)
        m = write_path(tables["metadata"][product].drop("product"),
                       f"{base}/{product}/metadata", mode)
        entries.append({"product": product, "source": sidecars.get(product),
                        "pid": ",".join(sorted(pids[product])), "table": d["path"],
                        "rows": d["rows"], "metadata_path": m["path"],
                        "rows_metadata": m["rows"],
                        "columns": [c for c in d["columns"] if c != "pid"], "run_utc": ts})
    if manifest_table:
        append_manifest(spark, manifest_table, entries)
    return entries
