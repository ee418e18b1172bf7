"""Running totals and average ranks in a global order, without a global window.

Rows are first reduced to one per distinct value (partial aggregation absorbs
hot values).  Spark range-partitions them by series and value; totals run
inside each range, and the totals of the lower ranges of the series, one row
per range, are added by a join.  The ranges are written once, so that both
sides see the same ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialize


def running_totals(df: DataFrame, keys: list[str], value: str, sums: list[str], desc: bool = False,
                   ranges: int | None = None) -> DataFrame:
    """Add ``cum_<s>`` for every column in ``sums``: its total over the rows of
    the same series up to and including this one, in order of ``value``.
    ``df`` has one row per series and value, both not null."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = F.col(value).desc() if desc else F.col(value).asc()
    s = materialize(df.repartitionByRange(n, *[F.col(k) for k in keys], by)
                    .withColumn("_p", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy(*keys, "_p").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    below = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1) if keys \
        else Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    tot = s.groupBy(*keys, "_p").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    off = tot.select(*keys, "_p", *[F.coalesce(F.sum(f"_t_{c}").over(below), F.lit(0)).alias(f"_off_{c}") for c in sums])
    s = s.select("*", *[F.sum(c).over(inside).alias(f"_c_{c}") for c in sums]).join(off, [*keys, "_p"])
    for c in sums:
        s = s.withColumn(f"cum_{c}", F.col(f"_off_{c}") + F.col(f"_c_{c}")).drop(f"_off_{c}", f"_c_{c}")
    return s.drop("_p")


def avg_rank(long_df: DataFrame, keys: list[str], value: str = "value", desc: bool = False,
             ranges: int | None = None) -> DataFrame:
    """``(keys..., value)`` rows -> ``(keys..., value, count, rank)`` per distinct value.

    ``rank`` is the average 1-based rank (ties share the mean of their
    positions, like pandas ``rank()``); ``desc=True`` ranks the largest first.
    Values keep their type: text and large integers are ordered as they are.
    """
    vc = long_df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("count"))
    r = running_totals(vc, list(keys), value, ["count"], desc, ranges)
    return r.select(*keys, value, "count", (F.col("cum_count") - (F.col("count") - 1) / 2.0).alias("rank"))


def cumulative(df: DataFrame, order: str, sums: list[str], desc: bool = False,
               ranges: int | None = None) -> DataFrame:
    """``(order, sum(s)..., cum_<s>...)`` per distinct ``order`` value, where
    ``cum_<s>`` includes every row up to and including that value."""
    g = df.where(F.col(order).isNotNull()).groupBy(order).agg(*[F.sum(s).alias(s) for s in sums])
    return running_totals(g, [], order, sums, desc, ranges)
