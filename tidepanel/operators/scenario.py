"""What-if edits of driver columns.

Scenarios are data: ``{name: [(column, op, amount), ...]}`` with op
``"set"`` (replace by amount) or ``"add"`` (add amount).  Rows are
multiplied by the scenario list with ``explode`` of a literal array (no
join; the scenario list is a fixed-size literal), then each column is one
``CASE`` over the scenario name.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The four scenarios of the source, on its driver names.
REFERENCE_SCENARIOS = {
    "baseline": [],
    "high_tariffs": [("tariff_2018", "set", 1.0)],
    "high_infrastructure": [("infra_invest_log", "add", math.log1p(0.20))],
    "high_tariffs_high_infrastructure": [("tariff_2018", "set", 1.0),
                                         ("infra_invest_log", "add", math.log1p(0.20))],
}

OPS = ("set", "add")


def apply_scenarios(df: DataFrame, scenarios: Mapping[str, Sequence[tuple[str, str, float]]],
                    out: str = "scenario") -> DataFrame:
    """One copy of every row per scenario, with that scenario's edits in
    their order (a later edit of a column sees the earlier one's result).
    Without scenarios there is one unedited copy, ``baseline``."""
    scenarios = dict(scenarios) or {"baseline": []}
    for name, edits in scenarios.items():
        for col, op, _ in edits:
            if col not in df.columns:
                raise ValueError(f"scenario {name!r}: unknown column {col!r}")
            if op not in OPS:
                raise ValueError(f"scenario {name!r}: unknown op {op!r}")
    rows = df.withColumn(out, F.explode(F.array(*[F.lit(n) for n in scenarios])))
    new = {}
    for col in dict.fromkeys(c for edits in scenarios.values() for c, _, _ in edits):
        original = F.col(col).cast("double")
        value = original
        for name, edits in scenarios.items():
            edited = original
            for c, op, amount in edits:
                if c == col:
                    edited = F.lit(float(amount)) if op == "set" else edited + F.lit(float(amount))
            if edited is not original:
                value = F.when(F.col(out) == name, edited).otherwise(value)
        new[col] = value
    return rows.withColumns(new)


def changed_cells(df: DataFrame, scenarios, cols: Sequence[str],
                  out: str = "scenario") -> DataFrame:
    """Per scenario: how many driver cells differ from the unedited rows
    (a scenario equal to the baseline shows 0)."""
    keep = df.withColumns({f"__orig_{c}": F.col(c) for c in cols})
    diff = sum((F.when(~F.col(c).eqNullSafe(F.col(f"__orig_{c}")), 1).otherwise(0)
                for c in cols), F.lit(0))
    return (apply_scenarios(keep, scenarios, out)
            .groupBy(out).agg(F.sum(diff).alias("changed_cells")))
