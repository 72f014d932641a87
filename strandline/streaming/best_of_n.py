"""Scoring of a stream: an addition, as the batch engine reads whole files.

Rows are scored one by one, so forward() runs on a stream as it is. The best of a
query is known only once its group has ended: that is when the watermark passes
the end of the group's window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_best_of_n(scored: DataFrame, time: str, window: str = "10 minutes", late: str = "10 minutes", group: str = "query_id", score: str = "score", row: str = "row_index") -> DataFrame:
    """group, window, row_index and score of the best row of each group and window.

    Append mode emits a group once, when no row of its window can come any more;
    rows later than ``late`` are dropped by the watermark. Ties go to the lowest
    row; a NaN wins only among NaNs.
    """
    value = F.when(F.isnan(score), F.lit(float("-inf"))).otherwise(F.col(score))
    best = F.max(F.struct(value.alias("v"), (-F.col(row)).alias("r"), F.col(score).alias("s")))
    return scored.withWatermark(time, late).groupBy(F.window(time, window), group).agg(best.alias("b")).select(group, "window", (-F.col("b.r")).alias(row), F.col("b.s").alias(score))
