"""Most-frequent value per series, smallest value on ties.

Built as two aggregations (``(series, value) -> count``, then the max of
``(count, -value)`` per series) so partial aggregation absorbs hot values
and no group's distinct values are gathered into one buffer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def modes(long_df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """``long_df(keys..., value)`` -> ``(keys..., mode, mode_count)``."""
    counts = (long_df.where(F.col(value).isNotNull())
              .groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")))
    # smallest (-count, value): highest count first, then the smallest value
    best = counts.groupBy(*keys).agg(
        F.min(F.struct((-F.col("_n")).alias("_neg"), F.col(value).alias("_v"))).alias("_b"))
    return best.select(*keys, F.col("_b._v").alias("mode"),
                       (-F.col("_b._neg")).alias("mode_count"))
