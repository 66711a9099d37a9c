"""Two-way fixed effects with many levels: the within transform by
alternating projections (W7 generalised, SURVEY q3).

With very many levels even one k x k array is too large.  Then y and the
regressors are demeaned by entity and by period in turn
until both sets of means vanish (the method of alternating projections;
one round is exact for a balanced panel).  By the Frisch-Waugh-Lovell
theorem OLS on the demeaned columns gives the fixed-effects slopes, with
the same residuals; the absorbed parameters enter the degrees of freedom.

Per round: entity means are a window over one entity's rows (at most one
row per period), period means a grouped aggregate joined back (broadcast
when the number of periods is bounded).  Each round is checkpointed, so
the lineage stays one round deep and a lost executor recomputes one round.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import count_parts
from .joins import broadcast_bounded
from .regression import OLSResult, fit_ols


def alternating_demean(df: DataFrame, cols: Sequence[str], entity: str, period: str,
                       tol: float = 1e-10, max_iter: int = 500,
                       period_bound: int | None = None,
                       check_every: int = 5) -> tuple[DataFrame, int]:
    """Returns (demeaned frame, rounds used); raises when ``max_iter`` rounds do
    not get there.  Stops when every entity and
    period mean is below ``tol`` times the column's initial RMS; the check
    and the checkpoint run every ``check_every`` rounds, so the lineage is
    never more than that many rounds deep."""
    cols = list(cols)
    scale = df.agg(*[F.sqrt(F.avg(F.col(c) * F.col(c))).alias(c) for c in cols]).first().asDict()
    we = Window.partitionBy(entity)
    cur = df
    for it in range(1, max_iter + 1):
        cur = cur.withColumns({c: F.col(c) - F.avg(c).over(we) for c in cols})
        pm = cur.groupBy(period).agg(*[F.avg(c).alias(f"__p_{c}") for c in cols])
        cur = (cur.join(broadcast_bounded(pm, period_bound), period)
                  .withColumns({c: F.col(c) - F.col(f"__p_{c}") for c in cols})
                  .drop(*[f"__p_{c}" for c in cols]))
        if it % check_every and it < max_iter:
            continue
        cur = cur.checkpoint(eager=True)
        # period means are now zero; the entity means measure what is left
        left = (cur.groupBy(entity).agg(*[F.avg(c).alias(c) for c in cols])
                   .agg(*[F.max(F.abs(c)).alias(c) for c in cols]).first().asDict())
        if all((left[c] or 0.0) <= tol * max(scale[c] or 0.0, 1e-300) for c in cols):
            return cur, it
    raise RuntimeError(f"two-way means above tolerance after {max_iter} rounds")


def fe_within_ols(df: DataFrame, y: str, x: Sequence[str], entity: str, period: str,
                  cov_type: str = "HC1", tol: float = 1e-10, max_iter: int = 500,
                  period_bound: int | None = None) -> tuple[OLSResult, int]:
    """Two-way fixed-effects OLS of ``y`` on ``x`` through the within
    transform; returns (result, rounds).  The absorbed parameters are
    entities + periods - connected parts of the panel."""
    rows = df.select(entity, period, y, *x).dropna()
    counts = rows.agg(F.count_distinct(entity).alias("e"),
                      F.count_distinct(period).alias("t")).first()
    dm, rounds = alternating_demean(rows, [y, *x], entity, period, tol, max_iter, period_bound)
    absorbed = int(counts["e"]) + int(counts["t"]) - count_parts(rows, entity, period)
    return fit_ols(dm, y, list(x), cov_type=cov_type, absorbed=absorbed), rounds
