"""Splits, folds and standardising.

Rolling origins are a short literal list.  Instead of a theta join of the
rows with a fold table, each row emits the origins whose training window
contains it (``explode(filter(origins, te -> te >= period))``): a generator
in the scan's stage, no join, at most ``len(origins)`` copies per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import spec


def split_label(period: str, train_end: int, test_periods: Sequence[int]) -> Column:
    """'train' up to ``train_end``, 'test' inside ``test_periods``, else null."""
    p = F.col(period)
    return (F.when(p <= train_end, F.lit("train"))
             .when(p.isin(list(test_periods)), F.lit("test")))


def train_test_split(df: DataFrame, period: str, train_end: int,
                     test_periods: Sequence[int], out: str = "split") -> DataFrame:
    return (df.withColumn(out, split_label(period, train_end, test_periods))
              .filter(F.col(out).isNotNull()))


def history_counts(df: DataFrame, key, split_col: str = "split") -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).agg(F.count_if(F.col(split_col) == "train").alias("n_train"),
                                 F.count_if(F.col(split_col) == "test").alias("n_test"),
                                 F.count(F.lit(1)).alias("n_total"))


def min_history(df: DataFrame, key, min_train: int = 6, min_test: int = 1,
                min_total: int = 0, split_col: str = "split") -> DataFrame:
    """Keep the rows of keys with enough history (F10): a grouped count
    and a left-semi join back (the counts table has one row per key)."""
    keys = [key] if isinstance(key, str) else list(key)
    ok = history_counts(df, keys, split_col).filter(
        (F.col("n_train") >= min_train) & (F.col("n_test") >= min_test)
        & (F.col("n_total") >= min_total))
    return df.join(ok.select(*keys), on=keys, how="left_semi")


def expand_origins(df: DataFrame, period: str, origins: Sequence[int],
                   out: str = "te") -> DataFrame:
    """One copy of each row per origin whose training window holds it,
    i.e. every origin ``te >= period`` (J7)."""
    arr = F.array(*[F.lit(int(t)) for t in sorted(origins)])
    return df.withColumn(out, F.explode(F.filter(arr, lambda te: te >= F.col(period))))


def with_next(df: DataFrame, key, period: str, cols: Sequence[str]) -> DataFrame:
    """The next row's period and values per entity (the one-step target)."""
    w = spec(key, period)
    out = df.withColumn(f"{period}_next", F.lead(period).over(w))
    return out.withColumns({f"{c}_next": F.lead(c).over(w) for c in cols})


def fold_train_stats(df: DataFrame, key, period: str, y: str,
                     origins: Sequence[int]) -> DataFrame:
    """Per (entity, origin): training count, mean and population SD of
    ``y`` over rows up to the origin, for origins where both the origin and
    the next period exist (F11).  Running sums over one window replace the
    fold expansion: each origin reads one row."""
    keys = [key] if isinstance(key, str) else list(key)
    run = Window.partitionBy(*keys).orderBy(period).rowsBetween(Window.unboundedPreceding,
                                                                Window.currentRow)
    x = F.col(y)
    out = with_next(df, keys, period, []).select(
        *keys, period, f"{period}_next",
        F.count(x).over(run).alias("n_train"),
        F.sum(x).over(run).alias("__s"),
        F.sum(x * x).over(run).alias("__ss"),
    )
    out = out.filter(F.col(period).isin([int(t) for t in origins])
                     & (F.col(f"{period}_next") == F.col(period) + 1))
    mean = F.col("__s") / F.col("n_train")
    var = F.greatest(F.col("__ss") / F.col("n_train") - mean * mean, F.lit(0.0))
    return out.select(*keys, F.col(period).alias("te"), "n_train",
                      mean.alias("mean_y"), F.sqrt(var).alias("sd_y"))


def standardize_by_fold(df: DataFrame, key, fold: str, cols: Sequence[str],
                        train_flag: str = "is_train", suffix: str = "_z") -> DataFrame:
    """Scale each column with the mean and population SD of the *training*
    rows of its (entity, fold) (P24); zero SD divides by 1.  The statistics
    are window aggregates over (entity, fold), which holds one fold's rows:
    no join back, one exchange for all columns."""
    keys = ([key] if isinstance(key, str) else list(key)) + [fold]
    w = Window.partitionBy(*keys)
    tr = F.col(train_flag)
    out = {}
    for c in cols:
        m = F.avg(F.when(tr, F.col(c))).over(w)
        s = F.stddev_pop(F.when(tr, F.col(c))).over(w)
        out[f"{c}{suffix}"] = (F.col(c) - m) / F.when(s == 0, F.lit(1.0)).otherwise(s)
    return df.withColumns(out)


def order_grid(keys_df: DataFrame, orders: Sequence[tuple[int, int, int]]) -> DataFrame:
    """Every key × candidate (p, d, q) with its grid position (J6), by
    exploding a literal array: no join."""
    arr = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(p).alias("ar"),
                             F.lit(d).alias("diff"), F.lit(q).alias("ma"))
                    for i, (p, d, q) in enumerate(orders)])
    return keys_df.select("*", F.inline(arr))


def fold_status(df: DataFrame, key, period: str, origins: Sequence[int],
                min_train: int) -> DataFrame:
    """One row per (entity, origin): training rows up to the origin and why
    a fold would not run (q10): 'missing_period' when te or te + 1 is
    absent (F11), 'too_short' with fewer than ``min_train`` training rows
    (F10), else 'ok'.  Every row emits every origin (a fixed multiplier),
    then one grouped aggregate."""
    keys = [key] if isinstance(key, str) else list(key)
    arr = F.array(*[F.lit(int(t)) for t in sorted(origins)])
    p = F.col(period)
    ex = df.select(*keys, period, F.explode(arr).alias("te"))
    agg = ex.groupBy(*keys, "te").agg(
        F.count_if(p <= F.col("te")).alias("n_train"),
        F.count_if(p == F.col("te")).alias("__has_te"),
        F.count_if(p == F.col("te") + 1).alias("__has_next"))
    status = (F.when((F.col("__has_te") == 0) | (F.col("__has_next") == 0), "missing_period")
               .when(F.col("n_train") < min_train, "too_short").otherwise("ok"))
    return agg.select(*keys, "te", "n_train", status.alias("status"))
