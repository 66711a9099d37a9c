"""Incremental archive ingest with Structured Streaming.

A file stream names the archives that landed; each micro-batch reads them
member by member, as the batch ingest does, and writes the data and the metadata
table of each product partitioned by archive, overwriting only the partitions of
the archives it read (dynamic partition overwrite).  So the tables do not depend
on how the archives fall into micro-batches: archives of one product are united
whenever they come, an archive that lands again replaces its own rows, and a
batch that is run again after a failure rewrites the same partitions.  The
checkpoint location records which archives were taken.

``{silver}/_manifest`` has one row per archive and role, partitioned the same
way: id, rows, columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.names import sanitized_names
from ..sources.archives import extension_glob, read_paths, staged, tables_of

BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
ARCHIVE = "_archive"
ROLES = {"data": None, "metadata": {}}


def archive_stream(spark: SparkSession, landing: str, max_files_per_trigger: int = 100) -> DataFrame:
    """The paths of the archives that land; their contents are not read here."""
    return (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA)
            .option("pathGlobFilter", extension_glob("zip"))
            .option("maxFilesPerTrigger", max_files_per_trigger)
            .load(landing).select("path"))


def _by_archive(df: DataFrame, path: str) -> None:
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(ARCHIVE).parquet(path))


def write_batch(spark: SparkSession, paths: list[str], silver_base: str,
                split: bool | None = None) -> list[dict]:
    """Read the archives at ``paths`` and write their tables and manifest
    rows; returns the manifest rows."""
    if not paths:
        return []
    base = silver_base.rstrip("/")
    lines = staged(read_paths(spark, sorted(paths), split))
    archive = F.regexp_extract("path", r"([^/]+)$", 1).alias(ARCHIVE)
    tables = tables_of(lines, ROLES, keep=("path",))
    for role, products in tables.items():
        for product, df in sorted(products.items()):
            _by_archive(df.select(*[c for c in df.columns if c not in ("product", "path")],
                                  archive), f"{base}/{product}/{role}")
    # one row per archive and role, as the headers that tables_of reads
    counted = (lines.groupBy("path", "product", "role", "pid").agg(
        F.count_if((F.col("line_no") > 0) & (F.size("fields") > 0)).alias("rows"),
        F.max(F.when(F.col("line_no") == 0, F.col("fields"))).alias("header")))
    entries = [{**r.asDict(), ARCHIVE: r.path.rpartition("/")[2],
                "columns": sanitized_names(r.header or [], "silver")} for r in counted.collect()]
    _by_archive(spark.createDataFrame(
        [(e["product"], e["role"], e["pid"], e["rows"], e["columns"], e[ARCHIVE])
         for e in entries],
        f"product string, role string, pid string, rows long, columns array<string>, "
        f"{ARCHIVE} string"), f"{base}/_manifest")
    return entries


def read_ingested(spark: SparkSession, silver_base: str, product: str, role: str = "data"
                  ) -> DataFrame:
    """A product's table over all its archives, columns united by name."""
    path = f"{silver_base.rstrip('/')}/{product}/{role}"
    return spark.read.option("mergeSchema", "true").parquet(path).drop(ARCHIVE)


def start_ingest(spark: SparkSession, landing: str, silver_base: str, checkpoint: str,
                 available_now: bool = True, max_files_per_trigger: int = 100) -> StreamingQuery:
    """Start the stream; ``available_now`` processes what is there and stops."""
    def each(batch: DataFrame, epoch_id: int) -> None:
        paths = [r.path for r in batch.collect()]  # at most max_files_per_trigger
        write_batch(batch.sparkSession, paths, silver_base)

    w = (archive_stream(spark, landing, max_files_per_trigger).writeStream.foreachBatch(each)
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
