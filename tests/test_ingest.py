import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from tidepanel.sources.archives import (extension_glob, ingest, list_files, pair_metadata,
                                        product_of, read_archives)

DATA = ("﻿REF_DATE,GEO,North American Industry Classification System (NAICS),VALUE,Status\n"
        "2016-01,Canada,Construction [23],5.1,\n"
        "2016-02,Canada,Construction [23],..,x\n"
        "2017-01,Canada,\"Retail trade, total\",4.2,\n"
        "2017-02,Canada,\"Note: two\nlines\",3.0,\n")
META = "﻿Cube Title,Product Id\nLabour,14100023\n"


def _zip(path, members):
    with zipfile.ZipFile(path, "w") as zf:
        for name, text in members.items():
            zf.writestr(name, text.encode("utf-8"))


@pytest.fixture()
def landing(tmp_path):
    d = tmp_path / "bronze"
    d.mkdir()
    _zip(d / "labour_cansim.zip", {"14100023.csv": DATA, "14100023_MetaData.csv": META})
    _zip(d / "cpi_cansim.ZIP", {"sub/18100256.csv": DATA.replace("Construction [23]", "Core"),
                                "sub/18100256_metadata.csv": META})
    (d / "labour_cansim_metadata.json").write_text(json.dumps({"id": 1}))
    (d / "notes.txt").write_text("x")
    (d / "folder.zip").mkdir()
    return str(d)


def test_listing_and_names(spark, landing):
    assert extension_glob("zip") == "*.[zZ][iI][pP]"
    files = list_files(spark, landing, "zip").select(product_of().alias("p")).collect()
    assert sorted(r.p for r in files) == ["cpi", "labour"]
    pairs = {r["product"]: r.metadata_json for r in pair_metadata(spark, landing).collect()}
    assert pairs["labour"].endswith("labour_cansim_metadata.json")
    assert pairs["cpi"] is None


def test_lines_and_parse(spark, landing):
    lines = read_archives(spark, landing)
    by_role = {(r.product, r.role): r["count"] for r in lines.groupBy("product", "role").count().collect()}
    assert by_role[("labour", "data")] == 5 and by_role[("labour", "metadata")] == 2
    tables = ingest(spark, landing)
    lab = tables["labour"]
    assert lab.columns == ["product", "pid", "ref_date", "geo",
                           "north_american_industry_classification_system_naics", "value",
                           "status"]
    rows = sorted(lab.collect(), key=lambda r: r.ref_date)
    assert [r.value for r in rows] == [5.1, None, 4.2, 3.0]   # ".." -> null
    assert rows[2].north_american_industry_classification_system_naics == "Retail trade, total"
    # a quoted field with a line break stays one record
    assert rows[3].north_american_industry_classification_system_naics == "Note: two\nlines"
    assert rows[0].ref_date == "2016-01" and rows[0].pid == "14100023"


def test_missing_member_raises(spark, tmp_path):
    d = tmp_path / "bad"
    d.mkdir()
    _zip(d / "x_cansim.zip", {"1.csv": DATA})
    with pytest.raises(Exception, match="MetaData"):
        read_archives(spark, str(d)).collect()
    d2 = tmp_path / "bad2"
    d2.mkdir()
    _zip(d2 / "y_cansim.zip", {"2_MetaData.csv": META})
    with pytest.raises(Exception, match="lacks its data member"):
        read_archives(spark, str(d2)).collect()


def test_ingest_to_silver_with_manifest(spark, landing, tmp_path):
    from tidepanel import sinks
    sinks.ensure_schema(spark, "t_ingest")
    entries = sinks.ingest_to_silver(spark, landing, str(tmp_path / "silver"), "t_ingest.manifest")
    by = {e["product"]: e for e in entries}
    assert by["labour"]["rows"] == 4 and by["labour"]["rows_metadata"] == 1
    assert by["labour"]["pid"] == "14100023" and by["labour"]["source"].endswith(".json")
    assert "value" in by["labour"]["columns"]
    back = spark.read.parquet(str(tmp_path / "silver" / "labour" / "data"))
    assert back.count() == 4
    man = spark.table("t_ingest.manifest").filter("product = 'labour'").first()
    assert man.rows == 4 and man.pid == "14100023"
    assert man.rows_metadata == 1 and man.metadata_path.endswith("labour/metadata")


def test_archives_of_one_product_are_united(spark, tmp_path):
    """Two archives of one product (other case, other columns), and an archive
    whose members come in several folders."""
    d = tmp_path / "bronze"
    d.mkdir()
    _zip(d / "gdp_cansim.zip", {"1.csv": "\ufeffREF_DATE,VALUE\n2016,1\n", "1_MetaData.csv": META})
    _zip(d / "gdp.ZIP", {"x/2_METADATA.CSV": META, "readme.txt": "x", "y/2.csv":
                         "\ufeffREF_DATE,GEO,VALUE\n2017,Canada,2\n2018,Canada,3\n"})
    from tidepanel import sinks
    entries = sinks.ingest_to_silver(spark, str(d), str(tmp_path / "silver"))
    assert [(e["product"], e["pid"], e["rows"], e["rows_metadata"]) for e in entries] == [
        ("gdp", "1,2", 3, 2)]
    rows = spark.read.parquet(str(tmp_path / "silver" / "gdp" / "data")).orderBy("ref_date")
    assert [(r.pid, r.geo, r.value) for r in rows.collect()] == [
        ("1", None, 1.0), ("2", "Canada", 2.0), ("2", "Canada", 3.0)]


def test_silver_and_catalog_scans(spark, tmp_path):
    from tidepanel import sinks
    from tidepanel.sources.tables import read_catalog, read_silver
    df = spark.createDataFrame([("2016", 1.0)], "ref_date string, value double")
    sinks.write_path(df, str(tmp_path / "cpi" / "data"))
    assert read_silver(spark, str(tmp_path / "cpi" / "data")).collect() == df.collect()
    sinks.ensure_schema(spark, "t_scan")
    sinks.write_table(df, "t_scan.t")
    assert read_catalog(spark, "t_scan.t").collect() == df.collect()


# --- archives read member by member ---------------------------------------------

@pytest.fixture()
def two_large(tmp_path):
    """An archive with two large members, and small ones beside it."""
    d = tmp_path / "large"
    d.mkdir()
    line = "2016-0%d,\"Québec, qc\",%d,\n"
    body = "REF_DATE,GEO,VALUE,Status\n" + "".join(line % (i % 9 + 1, i * 7919 % 10_007)
                                                    for i in range(60_000))
    _zip(d / "big_cansim.zip", {"a/1.csv": body, "a/1_MetaData.csv": body})
    for i in range(5):
        _zip(d / f"small{i}_cansim.zip", {"7.csv": DATA, "7_MetaData.csv": META})
    return str(d)


def _sorted_lines(df):
    return sorted((r.path, r["product"], r.pid, r.role, r.line_no, tuple(r.fields))
                  for r in df.collect())


def test_members_are_tasks_of_their_own(spark, two_large):
    by_member = read_archives(spark, two_large, split=True, pack_bytes=100_000)
    where = (by_member.withColumn("part", F.spark_partition_id()).groupBy("product", "role")
             .agg(F.collect_set("part").alias("p")).collect())
    at = {(r["product"], r.role): r.p for r in where}
    assert all(len(p) == 1 for p in at.values())
    large = {at["big", "data"][0], at["big", "metadata"][0]}
    small = {p[0] for (product, _), p in at.items() if product != "big"}
    assert len(large) == 2 and not large & small
    assert len(small) == 1                       # small members share a task
    assert _sorted_lines(by_member) == _sorted_lines(read_archives(spark, two_large, split=False))


def test_memory_does_not_grow_with_the_member(tmp_path):
    import tracemalloc

    from tidepanel.sources import zipped

    def peak(n):
        path = tmp_path / f"n{n}.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as zf:
            with zf.open("1.csv", "w") as f:
                for _ in range(n):
                    f.write(b"2016-01,Canada,some words of a cell,12345.678\n" * 1000)
            zf.writestr("1_MetaData.csv", META)
        reader = zipped.ZippedReader([str(path)], 1)
        part = next(p for p in reader.partitions() if p.items[0][2] == "data")
        tracemalloc.start()
        rows = sum(b.num_rows for b in reader.read(part))
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows == n * 1000
        return top
    small, large = peak(40), peak(400)
    assert large < 1.2 * small + (1 << 20)


def test_odd_archives(spark, tmp_path):
    """Paths with blanks and signs, empty members, records longer than the
    reader's usual limit, an empty folder."""
    d = tmp_path / "a folder with 100% signs & blanks"
    d.mkdir()
    wide = "x" * 300_000
    _zip(d / "odd name_cansim.zip", {"9.csv": "", "9_MetaData.csv": f"A,B\n{wide},\"q\"\"\n\"\n\n"})
    got = read_archives(spark, str(d), split=True)
    assert [(r.role, r.line_no, r.fields) for r in got.orderBy("line_no").collect()] == [
        ("metadata", 0, ["A", "B"]), ("metadata", 1, [wide, "q\"\n"]), ("metadata", 2, [])]
    (tmp_path / "none").mkdir()
    assert read_archives(spark, str(tmp_path / "none")).count() == 0


def test_what_python_cannot_open_goes_through_spark(spark, two_large):
    from tidepanel.sources import zipped
    assert not zipped.reachable("viewfs://nowhere/a.zip")
    assert not zipped.reachable("/no/such/archive.zip")


# --- inferred types ------------------------------------------------------------------

CELLS = {
    "whole": (["1", "-20", "", " 7 ", None, "0"], "bigint"),
    "decimal": (["1.5", "2", ".5", "1e3", "", "-0.25"], "double"),
    "big": (["1", "9" * 19, "2", "3", "4", "5"], "string"),
    "code": (["007", "12", "13", "1", "2", "3"], "string"),
    "day": (["2016-01-31", "", None, "2020-02-29", "1999-12-31", "2000-01-01"], "date"),
    "no_day": (["2016-02-30", "2016-01-01", "", "", "", ""], "string"),
    "period": (["2016-01", "2016-02", "", "2016-03", "2016-04", None], "string"),
    "year": (["2016", "2017", "2018", "2019", "2020", "2021"], "bigint"),
    "mixed": (["2016-01-01", "5", "", "", "", ""], "string"),
    "words": (["NaN", "1", "2", "3", "4", "5"], "string"),
    "empty": (["", None, "", "", "", ""], "string"),
    "dots": (["..", "1", "2.5", "..", "", "3"], "double"),
}


def test_types_are_inferred_from_all_cells(spark):
    from tidepanel.sources.archives import infer_types, with_inferred_types
    rows = list(zip(*[v for v, _ in CELLS.values()]))
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in CELLS)).repartition(3)
    assert infer_types(df, list(CELLS), ("", "..")) == {c: t for c, (_, t) in CELLS.items()}
    plan = df.sparkSession.createDataFrame([], df.schema)
    assert infer_types(plan, list(CELLS)) == dict.fromkeys(CELLS, "string")
    out = with_inferred_types(df, null_values=("", ".."))
    assert dict(out.dtypes) == {c: t for c, (_, t) in CELLS.items()}
    assert sorted(r.whole for r in out.collect() if r.whole is not None) == [-20, 0, 1, 7]
    assert sorted(r.dots for r in out.collect() if r.dots is not None) == [1.0, 2.5, 3.0]
    assert infer_types(df, []) == {}


def test_ingest_with_inferred_types(spark, landing):
    t = ingest(spark, landing, infer=True)["labour"]
    types = dict(t.dtypes)
    assert types["value"] == "double" and types["ref_date"] == "string"   # periods stay text
    assert sorted(r.value for r in t.collect() if r.value is not None) == [3.0, 4.2, 5.1]
