"""Parquet tables of a data directory and the retail view built over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def load_all(spark: SparkSession, sf_dir: str, views: bool = True) -> dict[str, DataFrame]:
    out = {t: load(spark, sf_dir, t) for t in TABLES}
    if views:
        for t, df in out.items():
            df.createOrReplaceTempView(t)
    return out


def retail_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Online-retail shaped rows over orders/lineitem/part/customer/nation.

    Edge cases are planted by expression (the same expressions run in the
    SQL oracle): cancelled invoices, missing item text, zero prices, missing
    customers.  ``CustomerID`` is a double like a CSV-inferred id column.
    """
    li = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice")
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    p = load(spark, sf_dir, "part").select("p_partkey", "p_brand")
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    # nation has a fixed 25 rows: broadcast is size-proven; the rest are
    # key joins that Catalyst plans as sort-merge (or broadcast below the
    # autoBroadcastJoinThreshold, which AQE re-checks at run time)
    j = (li.join(o, li.l_orderkey == o.o_orderkey)
           .join(p, li.l_partkey == p.p_partkey)
           .join(c, o.o_custkey == c.c_custkey)
           .join(F.broadcast(n), c.c_nationkey == n.n_nationkey))
    # one SQL projection: parsed by the JVM in a single call
    return j.selectExpr(*RETAIL_COLUMNS)


RETAIL_COLUMNS = [
    "CASE WHEN o_orderkey % 20 = 0 THEN concat('C', CAST(o_orderkey AS STRING)) "
    "ELSE CAST(o_orderkey AS STRING) END AS InvoiceNo",
    "CAST(l_partkey AS STRING) AS StockCode",
    "CASE WHEN l_linenumber = 7 THEN CAST(NULL AS STRING) ELSE p_brand END AS Description",
    "CASE WHEN o_orderkey % 20 = 0 THEN -l_quantity ELSE l_quantity END AS Quantity",
    "o_orderdate AS InvoiceDate",
    "CASE WHEN l_partkey % 97 = 0 THEN 0.0D ELSE l_extendedprice / l_quantity END AS UnitPrice",
    "CASE WHEN o_custkey % 50 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(o_custkey AS DOUBLE) END AS CustomerID",
    "n_name AS Country",
]


# The same view as DuckDB SQL, used by the oracle strings.
RETAIL_SQL = """
SELECT CASE WHEN o_orderkey % 20 = 0 THEN 'C' || CAST(o_orderkey AS VARCHAR)
            ELSE CAST(o_orderkey AS VARCHAR) END AS InvoiceNo,
       CAST(l_partkey AS VARCHAR) AS StockCode,
       CASE WHEN l_linenumber = 7 THEN NULL ELSE p_brand END AS Description,
       CASE WHEN o_orderkey % 20 = 0 THEN -l_quantity ELSE l_quantity END AS Quantity,
       o_orderdate AS InvoiceDate,
       CASE WHEN l_partkey % 97 = 0 THEN 0.0 ELSE l_extendedprice / l_quantity END AS UnitPrice,
       CASE WHEN o_custkey % 50 = 0 THEN NULL ELSE CAST(o_custkey AS DOUBLE) END AS CustomerID,
       n_name AS Country
FROM lineitem
JOIN orders ON l_orderkey = o_orderkey
JOIN part ON l_partkey = p_partkey
JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey
"""
