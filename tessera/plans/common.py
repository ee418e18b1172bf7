"""Inputs shared by several registered queries (each with its SQL twin)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.sources.tables import load

LINEITEM_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def lineitem_nulls(spark, sf_dir):
    """lineitem with missing values planted by expression."""
    li = load(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_partkey", "l_linenumber",
        F.when(F.col("l_linenumber") == 7, F.lit(None)).otherwise(F.col("l_quantity")).alias("l_quantity"),
        "l_extendedprice",
        F.when(F.col("l_partkey") % 13 == 0, F.lit(None)).otherwise(F.col("l_discount")).alias("l_discount"),
        F.when(F.col("l_orderkey") % 11 == 0, F.lit(None)).otherwise(F.col("l_tax")).alias("l_tax"),
        "l_returnflag", "l_linestatus", "l_shipdate")


LINEITEM_NULLS_SQL = """
SELECT l_orderkey, l_partkey, l_linenumber,
       CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END AS l_quantity,
       l_extendedprice,
       CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE l_discount END AS l_discount,
       CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_tax END AS l_tax,
       l_returnflag, l_linestatus, l_shipdate
FROM lineitem
"""


def union_sql(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)
