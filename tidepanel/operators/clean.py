"""Driver cleaning.

The composite clean is: +/-inf -> null, forward fill then back fill per
entity, then any value still missing takes the column's global median
(computed after the fills, as the source does).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite_or_null, is_finite
from ..stages import materialize
from .joins import broadcast_bounded
from .windows import back_fill, forward_fill


def missing_report(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column: missing (null or NaN) and infinite counts, one pass
    over the data for all columns, then unpivoted to one row per column
    (A7).  Sorted descending on (n_nan, n_inf)."""
    aggs = []
    for c in cols:
        x = F.col(c)
        aggs.append(F.count_if(x.isNull() | F.isnan(x)).alias(f"{c}__nan"))
        aggs.append(F.count_if(x.isNotNull() & (F.abs(x) == F.lit(float("inf")))).alias(f"{c}__inf"))
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{c}', `{c}__nan`, `{c}__inf`" for c in cols)
    return (wide.selectExpr(f"stack({len(cols)}, {stack}) as (col, n_nan, n_inf)")
                .orderBy(F.desc("n_nan"), F.desc("n_inf")))


def assert_finite(df: DataFrame, cols: Sequence[str]) -> None:
    """Raise unless every value of ``cols`` is finite (F12); one aggregate."""
    bad = df.agg(*[F.count_if(~is_finite(c)).alias(c) for c in cols]).first().asDict()
    bad = {k: v for k, v in bad.items() if v}
    if bad:
        raise ValueError(f"non-finite values remain: {bad}")


def flag_non_finite(df: DataFrame, cols: Sequence[str]) -> Column:
    """In-plan form of F12: a column that raises when evaluated on a bad row."""
    ok = None
    for c in cols:
        ok = is_finite(c) if ok is None else ok & is_finite(c)
    return F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("non-finite driver value")))


def locf(df: DataFrame, cols: Sequence[str], key, period: str,
         backfill: bool = True) -> DataFrame:
    """Forward fill, then back fill, per entity (W3, W4).  Both windows
    share one partitioning and ordering, so the plan sorts once.  Back fill
    reads *later* values; pass ``backfill=False`` for an honest backtest."""
    out = df.withColumns({c: forward_fill(c, key, period) for c in cols})
    if backfill:
        out = out.withColumns({c: back_fill(c, key, period) for c in cols})
    return out


def _bracket_pairs(df: DataFrame, cols: Sequence[str], accuracy: int) -> DataFrame:
    """(column, count of all values, value, count): the distinct values in a
    bracket around each column's middle, and one pair with a null value for
    everything below it."""
    x = F.col("__v")
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols)
    long = (df.selectExpr(f"stack({len(cols)}, {pairs}) AS (__c, __v)")
            .filter(x.isNotNull() & ~F.isnan(x)))
    near = 2.0 / accuracy
    # one row per column
    bracket = long.groupBy("__c").agg(
        F.count(F.lit(1)).alias("__n"),
        F.percentile_approx("__v", [max(0.0, 0.5 - near), min(1.0, 0.5 + near)], accuracy)
        .alias("__b"))
    placed = long.join(broadcast_bounded(bracket, len(cols)), "__c")
    return (placed.filter(x <= F.col("__b")[1])
            .groupBy("__c", "__n", F.when(x >= F.col("__b")[0], x).alias("__v"))
            .agg(F.count(F.lit(1)).alias("__k")))


def _wanted_parts(pairs: DataFrame) -> DataFrame:
    """For each column and each of its two middle ranks: the partition that
    holds the rank, and how many values stand before that partition.  A
    column's partition counts are one row per partition, whatever its size."""
    counts = pairs.groupBy("__c", "__n", "__part").agg(F.sum("__k").alias("k"))
    listed = counts.groupBy("__c", "__n").agg(
        F.sort_array(F.collect_list(F.struct(F.col("__part").alias("part"), "k"))).alias("parts"))
    half = lambda n: F.floor(n / 2).cast("long")
    ranks = F.array(F.struct(F.lit(0).alias("which"), half(F.col("__n") - 1).alias("rank")),
                    F.struct(F.lit(1).alias("which"), half(F.col("__n")).alias("rank")))
    # fold over the partitions: the first whose running count passes the rank
    state = "struct<before:bigint,part:int>"
    found = F.aggregate(
        "parts", F.struct(F.lit(0).cast("long").alias("before"),
                          F.lit(None).cast("int").alias("part")).cast(state),
        lambda a, x: F.when(a["part"].isNotNull(), a)
        .when(a["before"] + x["k"] > F.col("__r.rank"),
              F.struct(a["before"].alias("before"), x["part"].alias("part")))
        .otherwise(F.struct((a["before"] + x["k"]).alias("before"),
                            F.lit(None).cast("int").alias("part"))))
    return (listed.withColumn("__r", F.explode(ranks)).withColumn("__f", found)
            .select("__c", F.col("__f.part").alias("__part"), F.col("__r.which").alias("__which"),
                    (F.col("__r.rank") - F.col("__f.before")).alias("__at")))


def median_row(df: DataFrame, cols: Sequence[str], accuracy: int = 10_000) -> DataFrame:
    """Exact median of each column (mean of the two middle values for an
    even count; null and NaN skipped) as one row, by distributed selection.

    ``percentile_approx`` brackets the middle ranks (its rank error is at
    most count/accuracy, its memory bounded by ``accuracy``).  The values
    below the bracket are counted; those inside it, about 4/accuracy of all,
    are reduced to (value, count) pairs.  Equal values are one pair, however
    many there are.  The pairs are range-partitioned by (column, value) and
    written once; the partitions' counts, one row each, say which partition
    holds a middle rank, and only that partition's pairs are counted through.
    No column goes through one task, nothing is collected."""
    ranged = materialize(_bracket_pairs(df, cols, accuracy)
                         .repartitionByRange("__c", F.asc_nulls_first("__v"))
                         .withColumn("__part", F.spark_partition_id()))
    held = ranged.join(broadcast_bounded(_wanted_parts(ranged), 2 * len(cols)),
                       ["__c", "__part"])
    run = (Window.partitionBy("__c", "__part", "__which")
           .orderBy(F.asc_nulls_first("__v")))
    ranked = held.withColumn("__upto", F.sum("__k").over(run))
    middle = ranked.groupBy("__c", "__which").agg(
        F.min(F.when(F.col("__upto") > F.col("__at"), F.col("__v"))).alias("__m"))
    at = lambda c, i: F.max(F.when(
        (F.col("__c") == c) & (F.col("__which") == i), F.col("__m")))
    return middle.agg(*[((at(c, 0) + at(c, 1)) / 2.0).alias(c) for c in cols])


def exact_medians(df: DataFrame, cols: Sequence[str], accuracy: int = 10_000
                  ) -> dict[str, float | None]:
    return median_row(df, cols, accuracy).first().asDict()


def exact_median(df: DataFrame, col: str, accuracy: int = 10_000) -> float | None:
    return exact_medians(df, [col], accuracy)[col]


def fill_with_medians(df: DataFrame, cols: Sequence[str], source: DataFrame | None = None,
                      accuracy: int = 10_000) -> DataFrame:
    """Gaps of each column take its median over ``source`` (default: the frame
    itself), a scalar subquery."""
    row = median_row(source if source is not None else df, cols, accuracy)
    m = row.select(F.struct(*cols)).scalar()
    return df.withColumns({c: F.coalesce(F.col(c), m.getField(c)) for c in cols})


def clean_drivers(df: DataFrame, cols: Sequence[str], key, period: str,
                  backfill: bool = True, median_fill: bool = True) -> DataFrame:
    """The composite clean (W5): inf -> null (P22), forward and back fill
    per entity (W3, W4), then each column's remaining gaps take its global
    median (A8).  The filled rows are written once, as the medians read them
    twice and the result a third time."""
    out = df.withColumns({c: finite_or_null(c) for c in cols})
    out = locf(out, cols, key, period, backfill)
    return fill_with_medians(materialize(out), cols) if median_fill else out
