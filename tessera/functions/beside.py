"""Rows beside every entry of a small table, without a cross join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.rank import avg_rank

#: Entries that one array holds at most.
BLOCK = 256


def beside(rows: DataFrame, few: DataFrame, key: str, salt_of: Column, name: str) -> DataFrame:
    """``rows`` with a column ``name``: an array of at most ``BLOCK`` rows of
    ``few`` in order of its columns, and as many rows as ``few`` has such blocks.

    ``key`` is not null and distinct in ``few``.  Both sides meet on (salt,
    block): a row's salt is a hash of ``salt_of``, each block is copied to
    every salt, so no key gathers all rows and any number of entries is served.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = avg_rank(few.select(F.col(key).alias("value")), [], "value") \
        .select(F.col("value").alias(key), F.floor((F.col("rank") - 1) / BLOCK).cast("int").alias("_blk"))
    blocks = few.join(place, key).groupBy("_blk").agg(F.sort_array(F.collect_list(F.struct(*few.columns))).alias(name))
    last = blocks.agg(F.max("_blk")).first()[0]
    if last is None:
        return rows.withColumn(name, F.array(F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in few.schema]))).limit(0)
    salts = blocks.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    each = rows.withColumn("_salt", F.pmod(F.xxhash64(salt_of), F.lit(n)).cast("int")) \
        .withColumn("_blk", F.explode(F.sequence(F.lit(0), F.lit(last))))
    return each.join(salts, ["_salt", "_blk"]).drop("_salt", "_blk")
