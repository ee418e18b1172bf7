"""Retail cleaning and RFM queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators.retail import clean_retail, derive_rfm
from tessera.plans.registry import register
from tessera.sources.tables import RETAIL_SQL, load, retail_view

CLEAN_SQL = f"""
WITH r AS ({RETAIL_SQL})
SELECT CAST(CAST(CustomerID AS BIGINT) AS VARCHAR) AS CustomerID, InvoiceNo, StockCode,
       Description, Quantity, InvoiceDate, UnitPrice, Country,
       Quantity * UnitPrice AS TotalPrice
FROM r
WHERE CustomerID IS NOT NULL AND NOT coalesce(starts_with(InvoiceNo, 'C'), false)
  AND Quantity > 0 AND UnitPrice > 0
"""


@register("retail_clean", CLEAN_SQL)
def q_retail_clean(spark, sf_dir):
    return clean_retail(retail_view(spark, sf_dir))


def rfm_base_sql(clean_sql: str) -> str:
    """Unrounded RFM table as SQL (columns as in :func:`derive_rfm`)."""
    return f"""
WITH c AS ({clean_sql}),
per AS (SELECT CustomerID, max(InvoiceDate) AS last_ts, count(DISTINCT InvoiceNo) AS Frequency,
               sum(TotalPrice) AS Monetary FROM c GROUP BY CustomerID),
s AS (SELECT max(last_ts) + INTERVAL 1 DAY AS snap, quantile_cont(Monetary, 0.75) AS thr FROM per)
SELECT CustomerID,
       CAST(floor(epoch(snap - last_ts) / 86400) AS BIGINT) AS Recency,
       Frequency, Monetary, Monetary / Frequency AS AvgOrderValue,
       CAST(Monetary >= thr AS INTEGER) AS HighValue
FROM per, s
"""


def rfm_sql(clean_sql: str) -> str:
    return f"""
SELECT CustomerID, Recency, Frequency, round(Monetary, 6) AS Monetary,
       round(Monetary, 6) / Frequency AS AvgOrderValue, HighValue
FROM ({rfm_base_sql(clean_sql)})
"""


def rounded_rfm(rfm):
    """Money rounded to 6 dp; the ratio is recomputed from the rounded sum so
    both engines divide identical operands (no rounding ties)."""
    m = F.round("Monetary", 6)
    return rfm.select("CustomerID", "Recency", "Frequency", m.alias("Monetary"),
                      (m / F.col("Frequency")).alias("AvgOrderValue"), "HighValue")


def rfm_frame(spark, sf_dir):
    """RFM over the cleaned retail view for the modelling queries: derived in
    each query, written once there because fits read it several times."""
    from tessera.session import materialize
    return materialize(derive_rfm(clean_retail(retail_view(spark, sf_dir))), "rfm_table")


@register("rfm", rfm_sql(CLEAN_SQL))
def q_rfm(spark, sf_dir):
    return rounded_rfm(derive_rfm(clean_retail(retail_view(spark, sf_dir))))


# events carry sub-day timestamps: user = customer, event = invoice, value = amount
EVENTS_CLEAN_SQL = """
SELECT CAST(user_id AS VARCHAR) AS CustomerID, CAST(event_id AS VARCHAR) AS InvoiceNo,
       ts AS InvoiceDate, value AS TotalPrice
FROM events WHERE value > 0
"""


def events_as_retail(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return (e.where(F.col("value") > 0)
             .select(F.col("user_id").cast("string").alias("CustomerID"),
                     F.col("event_id").cast("string").alias("InvoiceNo"),
                     F.col("ts").alias("InvoiceDate"), F.col("value").alias("TotalPrice")))


@register("rfm_subday", rfm_sql(EVENTS_CLEAN_SQL))
def q_rfm_subday(spark, sf_dir):
    return rounded_rfm(derive_rfm(events_as_retail(spark, sf_dir)))
