import zipfile

from tidepanel.streaming.archives import start_ingest
from test_ingest import DATA, META, _zip


def test_available_now_ingest(spark, tmp_path):
    land = tmp_path / "landing"
    land.mkdir()
    _zip(land / "labour_cansim.zip", {"14100023.csv": DATA, "14100023_MetaData.csv": META})
    q = start_ingest(spark, str(land), str(tmp_path / "silver"), str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "silver" / "labour" / "data"))
    assert out.count() == 4
    assert spark.read.parquet(str(tmp_path / "silver" / "labour" / "metadata")).count() == 1
    # a second archive arriving later is picked up by a restart; the first is not re-read
    _zip(land / "cpi_cansim.zip", {"1.csv": DATA, "1_MetaData.csv": META})
    q = start_ingest(spark, str(land), str(tmp_path / "silver"), str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "silver" / "cpi" / "data")).count() == 4


def _tables(spark, base, products):
    from tidepanel.streaming.archives import read_ingested
    out = {}
    for product in products:
        for role in ("data", "metadata"):
            df = read_ingested(spark, str(base), product, role)
            cols = sorted(df.columns)
            out[product, role] = (cols, sorted(map(str, df.select(cols).collect())))
    return out


def test_any_split_into_micro_batches_gives_the_batch_tables(spark, tmp_path):
    from tidepanel.sinks import ingest_to_silver
    land = tmp_path / "landing"
    land.mkdir()
    more = DATA.replace("VALUE", "Extra").replace("2016", "2019")
    _zip(land / "labour_cansim.zip", {"14100023.csv": DATA, "14100023_MetaData.csv": META})
    _zip(land / "labour.zip", {"2.csv": more, "2_MetaData.csv": META})
    _zip(land / "LABOUR_copy_cansim.zip", {"3.csv": DATA, "3_MetaData.csv": META})
    products = ["labour", "LABOUR_copy"]
    ingest_to_silver(spark, str(land), str(tmp_path / "batch"))
    want = {}
    for product in products:
        for role in ("data", "metadata"):
            df = spark.read.parquet(str(tmp_path / "batch" / product / role))
            cols = sorted(df.columns)
            want[product, role] = (cols, sorted(map(str, df.select(cols).collect())))
    for n in (1, 2, 100):
        q = start_ingest(spark, str(land), str(tmp_path / f"s{n}"), str(tmp_path / f"c{n}"),
                         max_files_per_trigger=n)
        q.awaitTermination(240)
        assert _tables(spark, tmp_path / f"s{n}", products) == want
    manifest = spark.read.parquet(str(tmp_path / "s1" / "_manifest"))
    assert {(r["product"], r.role, r["_archive"], r.rows) for r in manifest.collect()} >= {
        ("labour", "data", "labour.zip", 4), ("labour", "data", "labour_cansim.zip", 4)}
    assert manifest.count() == 6


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    from tidepanel.streaming.archives import write_batch
    paths = []
    for name, data in (("x_cansim.zip", DATA), ("x.zip", DATA.replace("2016", "2020"))):
        _zip(tmp_path / name, {"1.csv": data, "1_MetaData.csv": META})
        paths.append(str(tmp_path / name))
    write_batch(spark, paths[:1], str(tmp_path / "out"))
    write_batch(spark, paths[1:], str(tmp_path / "out"))
    once = _tables(spark, tmp_path / "out", ["x"])
    write_batch(spark, paths[1:], str(tmp_path / "out"))
    assert _tables(spark, tmp_path / "out", ["x"]) == once
    assert len(once["x", "data"][1]) == 8
    # an archive that lands again with other rows replaces its own rows only
    _zip(tmp_path / "x.zip", {"1.csv": "REF_DATE,GEO,VALUE\n2021-01,Canada,7\n",
                              "1_MetaData.csv": META})
    write_batch(spark, paths[1:], str(tmp_path / "out"))
    assert len(_tables(spark, tmp_path / "out", ["x"])["x", "data"][1]) == 5
    assert write_batch(spark, [], str(tmp_path / "out")) == []
