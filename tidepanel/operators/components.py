"""Connected parts of a panel: entities and periods linked by observed cells.

A design with both kinds of effects has as many redundant columns as the graph
has parts, so the rank is entities + periods - parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..stages import materialize


def panel_parts(df: DataFrame, entity: str, period: str, max_rounds: int = 100) -> DataFrame:
    """(period, part): every period with the smallest period that is connected
    to it.  A round takes the smallest label over each entity's periods, then
    over each period's entities (grouped minima, two shuffles of the distinct
    cells), and then the label's own label, which makes long chains collapse
    in logarithmically many rounds.  Every round is written out."""
    cells = materialize(df.select(F.col(entity).alias("e"), F.col(period).alias("p"))
                        .dropna().distinct())
    labels = materialize(cells.select("p", F.col("p").alias("l")).distinct())
    for _ in range(max_rounds):
        of_entity = cells.join(labels, "p").groupBy("e").agg(F.min("l").alias("l"))
        low = cells.join(of_entity, "e").groupBy("p").agg(F.min("l").alias("l"))
        jump = low.select(F.col("p").alias("l"), F.col("l").alias("to"))
        new = materialize(low.join(jump, "l").select("p", F.col("to").alias("l")))
        moved = (new.join(labels.withColumnRenamed("l", "before"), "p")
                 .filter("l <> before").limit(1).count())
        labels = new
        if not moved:
            return labels.select(F.col("p").alias(period), F.col("l").alias("part"))
    raise RuntimeError(f"parts still growing after {max_rounds} rounds")


def count_parts(df: DataFrame, entity: str, period: str) -> int:
    return panel_parts(df, entity, period).select("part").distinct().count()
