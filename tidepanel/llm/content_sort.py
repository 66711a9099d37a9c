"""Exact de-duplication by a distributed sort of the texts themselves.

Sampled splitters range-partition the rows by the head of the text, each
partition is sorted (externally, by Spark) by the whole text, and
neighbouring rows of equal text form a run.  Only DataFrame functions.

*Skew.*  A head that more rows share than a partition should hold is dealt
row by row over several salts, in proportion to its exact row count, whatever
the rows' ids are.  There are at most as many such heads as partitions, which
bounds the broadcast of their salt counts.  The runs of one text under several
salts are merged by the text itself, from one row per run.

The sorted rows are written once without their texts (for
:func:`content_sort_keep`, the heads of runs with all columns), and the groups
are derived from that table: the texts are shuffled once.

*Edge cases.*  A null text equals the empty text; a null id never stays
unless its group has no other; of rows repeated with the same id and text
one is kept; texts of any length are compared whole (a text must fit a row); an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import carried_back, id_text, work_table

HEAD_CHARS = 48


def _runs(docs: DataFrame, id_col: str, text_col: str, keep: str, normalise,
          carry: list[str] = ()) -> DataFrame:
    """The sorted rows with their place in their run of equal texts."""
    if keep not in ("max", "min"):
        raise ValueError("keep must be 'max' or 'min'")
    rows = id_text(docs, id_col, text_col, {f"__carry_{c}": F.col(f"`{c}`") for c in carry})
    carried = [f"__carry_{c}" for c in carry]
    if normalise is not None:
        rows = rows.withColumn("text", normalise(F.col("text")))
    rows = (rows.withColumn("head", F.substring("text", 1, HEAD_CHARS))
            .withColumn("row", F.monotonically_increasing_id()))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    heads = work_table(rows.groupBy(F.xxhash64("head").alias("head_key"))
                       .agg(F.count(F.lit(1)).alias("n")), "heads")
    total = heads.agg(F.sum("n")).scalar()
    # a head with more than total/parts rows: at most `parts` of them exist
    heavy = (heads.filter(F.col("n") * parts > total)
             .select("head_key", F.ceil(F.col("n") * 4 * parts / total)
                     .cast("int").alias("salts")))
    salted = (rows.withColumn("head_key", F.xxhash64("head"))
              .join(F.broadcast(heavy), "head_key", "left")
              .withColumn("salt", F.when(F.col("salts").isNull(), F.lit(-1)).otherwise(
                  F.pmod(F.xxhash64("row"), F.col("salts").cast("long")).cast("int")))
              .select("doc_id", "text", "head", "salt", *carried))
    ranged = salted.repartitionByRange("head", "salt")

    order = F.desc_nulls_last("doc_id") if keep == "max" else F.asc_nulls_last("doc_id")
    # head and salt are the range keys, so the sorted runs need no second shuffle
    run = Window.partitionBy("head", "salt", "text").orderBy(order)
    return ranged.select(
        "doc_id", "salt",
        F.sha2("text", 256).alias("text_sha256"),
        F.first("doc_id").over(run).alias("run_keep"),
        F.row_number().over(run).alias("nth"),
        F.lead(F.lit(1)).over(run).isNull().alias("last"),
        F.when(F.col("salt") >= 0, F.col("text")).alias("salted_text"), *carried)


def _merged(ends: DataFrame, keep: str) -> DataFrame:
    """Runs of salted texts (one row each, ``nth`` their size) with the id that
    stays, the salt it is kept under and the size of the whole group."""
    if keep == "max":
        best = F.max(F.struct(F.col("run_keep").alias("id"), (-F.col("salt")).alias("salt")))
        won = -F.col("best.salt")
    else:
        best = F.min(F.struct(F.col("run_keep").isNull().alias("none"),
                              F.col("run_keep").alias("id"), F.col("salt").alias("salt")))
        won = F.col("best.salt")
    groups = ends.groupBy("salted_text").agg(best.alias("best"), F.sum("nth").alias("group_size"))
    return ends.join(groups, "salted_text").select(
        "text_sha256", "salt", F.col("best.id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"), won.alias("kept_salt"))


def content_sort_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       keep: str = "max", normalise=None) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept,
    text_sha256``.  ``keep``: which id of a group of equal texts stays
    (``"max"`` or ``"min"``).  ``normalise``: a Column -> Column function
    applied to the text first."""
    runs = _runs(docs, id_col, text_col, keep, normalise)
    # of a salted text only the last row of each run is needed
    runs = work_table(runs.withColumn("salted_text", F.when(F.col("last"), F.col("salted_text"))),
                      "runs")
    ends = runs.filter("last")
    # one row per run, so the rows of a hot text meet it salt by salt
    of_run = (ends.filter("salt < 0").select(
        "text_sha256", "salt", F.col("run_keep").alias("keep_id"),
        F.col("nth").cast("long").alias("group_size"), F.lit(-1).alias("kept_salt"))
        .unionByName(_merged(ends.filter("salt >= 0"), keep)))
    return (runs.select("doc_id", "salt", "nth", "text_sha256")
            .join(of_run, ["text_sha256", "salt"])
            .select("doc_id", "keep_id", "group_size",
                    ((F.col("nth") == 1) & (F.col("salt") == F.col("kept_salt"))).alias("kept"),
                    "text_sha256"))


def content_sort_keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      keep: str = "max", normalise=None) -> DataFrame:
    """The rows that stay, with all their columns: heads of runs; only the
    heads of salted runs still have to be compared with each other."""
    heads = work_table(_runs(docs, id_col, text_col, keep, normalise, docs.columns)
                       .filter("nth = 1"), "heads-of-runs")
    salted = heads.filter("salt >= 0")
    won = _merged(salted, keep).filter("salt = kept_salt").select("text_sha256", "salt")
    return (carried_back(heads.filter("salt < 0"), docs.columns)
            .unionByName(carried_back(salted.join(won, ["text_sha256", "salt"], "left_semi"),
                                      docs.columns)))
