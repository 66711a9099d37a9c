"""Archive ingest: zipped CSV tables -> long observation tables.

Archives are listed by Spark and read by the data source of
:mod:`tidepanel.sources.zipped`: one task per large member, which seeks to it
and streams it through the standard CSV reader (quotes, embedded newlines, BOM),
one row per record with its fields as ``array<string>``.  Where only Spark's own
readers reach the files, ``binaryFile`` reads an archive whole and
:func:`archive_lines` opens it in the task that read it (:func:`read_paths`
says which of the two is taken).  Columns are then picked from the array by
position.  Only the header records (one per archive and member) are collected,
to build the schema.

Archive layout: ``{product}_cansim.zip`` holding ``{id}.csv`` and
``{id}_MetaData.csv`` (any folder inside the archive; the id is the text
before the first "_" of the member whose name ends in ``_metadata.csv``,
matched case-insensitively); optional sidecar
``{product}_cansim_metadata.json`` next to the archive.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import sanitized_names
from ..session import prepare, shared_path
from . import zipped

LINE_SCHEMA = ("path string, product string, pid string, role string, line_no long, "
               "fields array<string>")
LINES_PER_BATCH = 50_000


def extension_glob(extension: str) -> str:
    """``zip`` -> ``*.[zZ][iI][pP]``: a case-insensitive glob."""
    ext = extension.lstrip(".")
    return "*." + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ext)


def list_files(spark: SparkSession, location: str, extension: str) -> DataFrame:
    """Files of one extension in a folder, case-insensitive, directories
    skipped (S2).  Selecting only ``path``/``length`` keeps the reader from
    loading file contents."""
    return (spark.read.format("binaryFile")
            .option("pathGlobFilter", extension_glob(extension))
            .load(location)
            .select("path", "length", "modificationTime"))


def product_of(path_col: str = "path"):
    """Product name from the file name: without ".zip" and then without
    "_cansim", in any case (S3), as the listing ignores case too."""
    name = F.regexp_extract(F.col(path_col), r"([^/]+)$", 1)
    return F.regexp_replace(name, r"(?i)(_cansim)?\.zip$", "")


def pair_metadata(spark: SparkSession, location: str) -> DataFrame:
    """Each archive with its JSON sidecar path, null when absent (S4): a
    left join of the two listings on product."""
    zips = list_files(spark, location, "zip").select("path", product_of().alias("product"))
    js = list_files(spark, location, "json").select(
        F.col("path").alias("metadata_json"),
        F.regexp_extract("path", r"(?i)([^/]+)_cansim_metadata\.json$", 1).alias("product"))
    return zips.join(js.filter(F.col("product") != ""), "product", "left")


def _explode_archives(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import csv
    for batch in batches:
        for path, product, content in zip(batch["path"], batch["product"], batch["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as zf:
                members = zipped.archive_members(zf.namelist())
                pid = members["pid"]
                for role in ("data", "metadata"):
                    with zf.open(members[role]) as raw:
                        text = io.TextIOWrapper(raw, encoding="utf-8-sig", newline="")
                        chunk, start = [], 0
                        for rec in csv.reader(text):
                            chunk.append(rec)
                            if len(chunk) == LINES_PER_BATCH:
                                yield _records(path, product, pid, role, start, chunk)
                                start += len(chunk)
                                chunk = []
                        if chunk:
                            yield _records(path, product, pid, role, start, chunk)


def _records(path, product, pid, role, start, chunk) -> pd.DataFrame:
    return pd.DataFrame({"path": path, "product": product, "pid": pid, "role": role,
                         "line_no": range(start, start + len(chunk)), "fields": chunk})


def archive_lines(archives: DataFrame) -> DataFrame:
    """``binaryFile`` rows (path, content[, product]) -> one row per CSV
    line of the data and metadata members (S5, S6)."""
    if "product" not in archives.columns:
        archives = archives.withColumn("product", product_of())
    return archives.select("path", "product", "content").mapInPandas(_explode_archives,
                                                                     LINE_SCHEMA)


def read_paths(spark: SparkSession, paths: Sequence[str], split: bool | None = None,
               pack_bytes: int = zipped.PACK_BYTES) -> DataFrame:
    """Records of the archives at ``paths``.  ``split``: read member by member
    (True), archive by archive through ``binaryFile`` (False), or by member
    where the first path can be opened outside Spark (None)."""
    paths = list(paths)
    if not paths:
        return spark.createDataFrame([], LINE_SCHEMA)
    if split is None:
        split = zipped.reachable(paths[0])
    if not split:
        return archive_lines(spark.read.format("binaryFile").load(paths))
    prepare(spark)
    spark.dataSource.register(zipped.ZippedTables)
    rows = (spark.read.format("zipped_tables").option("paths", json.dumps(paths))
            .option("packBytes", pack_bytes).load())
    return rows.select("path", product_of().alias("product"), "pid", "role", "line_no", "fields")


def read_archives(spark: SparkSession, location: str, split: bool | None = None,
                  pack_bytes: int = zipped.PACK_BYTES) -> DataFrame:
    """Records of every archive in a folder."""
    paths = [r.path for r in list_files(spark, location, "zip").select("path").collect()]
    return read_paths(spark, sorted(paths), split, pack_bytes)


def parse_member(lines: DataFrame, header: list[str], flavour: str = "silver",
                 numeric: dict[str, str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """CSV records of one member -> typed columns (S7, S8), after the product,
    the id and the record columns ``keep``.  Columns are
    read as strings (no inference: "2016-01" would become a timestamp),
    names sanitised and de-duplicated (P1, P3), then listed columns cast
    with ``try_cast`` (suppressed cells become null).  Empty records are
    skipped; short records give nulls."""
    names = sanitized_names(header, flavour)
    body = lines.filter(F.col("line_no") > 0).filter(F.size("fields") > 0)
    out = body.select("product", "pid", *keep, *[F.get(F.col("fields"), i).alias(n)
                                          for i, n in enumerate(names)])
    for col, typ in ({"value": "double"} if numeric is None else numeric).items():
        if col in out.columns:
            out = out.withColumn(col, F.col(col).try_cast(typ))
    return out


# --- inferred types ---------------------------------------------------------------

_INT, _DOUBLE, _DATE, _STRING = 1, 2, 4, 8


def cell_kind(cell, null_values: Sequence[str] = ("",)):
    """What a cell can be read as, as a bit: whole number, decimal, calendar
    day, text; 0 for a missing one.  Numbers that a cast would change (leading
    zeros, over 18 digits) are text, and so are periods such as ``2016-01``."""
    t = F.trim(cell)
    plain = t.rlike(r"^[+-]?(0|[1-9][0-9]{0,17})$")
    # a zero may only stand before the point, a number needs a digit
    number = t.rlike(r"^[+-]?((0|[1-9][0-9]*)(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]{1,3})?$")
    whole = t.rlike(r"^[+-]?[0-9]*$")
    day = t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(t, "yyyy-MM-dd").isNotNull()
    return (F.when(t.isNull() | t.isin(list(null_values)), 0).when(plain, _INT)
            .when(number & ~whole, _DOUBLE).when(day, _DATE).otherwise(_STRING))


def infer_types(df: DataFrame, cols: Sequence[str],
                null_values: Sequence[str] = ("",)) -> dict[str, str]:
    """Type of each text column (S8), from one aggregate over all cells of all
    columns: missing < bigint < double, and string above everything else that
    meets (a column of days is a date); a column without values stays text."""
    if not cols:
        return {}
    found = df.agg(*[F.bit_or(cell_kind(F.col(f"`{c}`"), null_values)).alias(f"c{i}")
                     for i, c in enumerate(cols)]).first()
    named = {_INT: "bigint", _DOUBLE: "double", _INT | _DOUBLE: "double", _DATE: "date"}
    return {c: named.get(found[f"c{i}"], "string") for i, c in enumerate(cols)}


def with_inferred_types(df: DataFrame, keep_text: Sequence[str] = ("product", "pid", "path"),
                        null_values: Sequence[str] = ("",)) -> DataFrame:
    """Text columns cast to their inferred types; missing cells become null."""
    text = [c for c, t in df.dtypes if t == "string" and c not in keep_text]
    types = infer_types(df, text, null_values)
    cell = lambda c: F.when(~F.trim(f"`{c}`").isin(list(null_values)), F.trim(f"`{c}`"))
    return df.withColumns({c: cell(c).cast(t) for c, t in types.items() if t != "string"})


def staged(lines: DataFrame) -> DataFrame:
    """Records written once to the session's shared folder, partitioned by
    product and role, so that every table reads its own partition only."""
    spark = lines.sparkSession
    path = shared_path(spark, "ingest")
    lines.write.partitionBy("product", "role").parquet(path)
    return spark.read.schema(LINE_SCHEMA).parquet(path)


def staged_archives(spark: SparkSession, location: str) -> DataFrame:
    """The records of all archives in a folder, staged."""
    return staged(read_archives(spark, location))


def tables_of(lines: DataFrame, roles: dict[str, dict[str, str] | None],
              keep: Sequence[str] = ()) -> dict[str, dict[str, DataFrame]]:
    """Archive records -> {role: {product: table}}, with the record columns
    ``keep``.  The header records (one
    per archive and member) are the only rows brought to the driver.
    Archives of one product are united by column name."""
    heads = (lines.filter((F.col("line_no") == 0) & F.col("role").isin(list(roles)))
             .select("role", "product", "path", "fields").collect())
    by_table: dict[tuple[str, str], dict[tuple, list[str]]] = {}
    for h in sorted(heads, key=lambda r: (r["role"], r["product"], r["path"])):
        same = by_table.setdefault((h["role"], h["product"]), {})
        same.setdefault(tuple(h["fields"]), []).append(h["path"])
    out: dict[str, dict[str, DataFrame]] = {role: {} for role in roles}
    for (role, product), headers in by_table.items():
        own = lines.filter((F.col("role") == role) & (F.col("product") == product))
        parts = [parse_member(own if len(headers) == 1 else own.filter(F.col("path").isin(paths)),
                              list(header), numeric=roles[role], keep=keep)
                 for header, paths in headers.items()]
        table = parts[0]
        for other in parts[1:]:
            table = table.unionByName(other, allowMissingColumns=True)
        out[role][product] = table
    return out


def ingest(spark: SparkSession, location: str, role: str = "data",
           numeric: dict[str, str] | None = None, infer: bool = False,
           null_values: Sequence[str] = ("", "..")) -> dict[str, DataFrame]:
    """Every archive in ``location`` -> {product: long table}.  ``infer``: the
    columns' types come from their cells instead of from ``numeric``."""
    tables = tables_of(staged_archives(spark, location), {role: {} if infer else numeric})[role]
    if infer:
        return {product: with_inferred_types(t, null_values=null_values)
                for product, t in tables.items()}
    return tables
