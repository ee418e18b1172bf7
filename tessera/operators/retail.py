"""Retail cleaning (P-05..P-11) and customer RFM features (A-17)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.quantile import quantiles
from tessera.session import materialize

# Formats tried, in order, when InvoiceDate arrives as text.
DATE_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd",
                "M/d/yyyy H:mm", "M/d/yyyy HH:mm", "M/d/yyyy", "dd/MM/yyyy HH:mm"]


def parse_ts(c: str, formats: list[str] = DATE_FORMATS):
    """Text -> timestamp; an unparsable value becomes NULL (never an error)."""
    return F.coalesce(*[F.try_to_timestamp(F.col(c), F.lit(f)) for f in formats])


def id_text(c: str, dt: T.DataType):
    """An id as text: whole numbers as they are, 17850.0 as "17850" (a number
    with a fraction keeps it, NaN is missing), text without a trailing ".0"."""
    col = F.col(c)
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        whole = (col == F.floor(col)) & (F.abs(col) < F.lit(2.0 ** 63))
        return F.when(~F.isnan(col), F.when(whole, col.try_cast("bigint").cast("string")).otherwise(col.cast("string")))
    if isinstance(dt, T.DecimalType):
        return F.regexp_replace(col.cast("string"), r"\.0+$", "")
    return F.regexp_replace(F.trim(col.cast("string")), r"\.0$", "")


def clean_retail(df: DataFrame) -> DataFrame:
    """Drop rows without customer, cancellations, non-positive quantity/price;
    parse dates; add ``TotalPrice``.  Each step runs only if its columns exist.

    All steps are row-local: Catalyst fuses them into the scan stage and
    pushes the null / comparison filters into the parquet reader.
    """
    cols = set(df.columns)
    out = df
    if "CustomerID" in cols:
        out = out.withColumn("CustomerID", id_text("CustomerID", out.schema["CustomerID"].dataType)) \
            .where(F.col("CustomerID").isNotNull())
    if "InvoiceNo" in cols:
        inv = F.col("InvoiceNo").cast("string")
        # a missing invoice number is kept (it is not a cancellation)
        out = out.withColumn("InvoiceNo", inv).where(
            ~F.coalesce(inv.startswith("C"), F.lit(False)))
    if "Quantity" in cols:
        out = out.where(F.col("Quantity") > 0)
    if "UnitPrice" in cols:
        out = out.where(F.col("UnitPrice") > 0)
    if "InvoiceDate" in cols:
        dt = out.schema["InvoiceDate"].dataType
        if isinstance(dt, T.StringType):
            out = out.withColumn("InvoiceDate", parse_ts("InvoiceDate"))
        elif isinstance(dt, T.DateType):
            out = out.withColumn("InvoiceDate", F.col("InvoiceDate").cast("timestamp_ntz"))
    if "Quantity" in cols and "UnitPrice" in cols:
        out = out.withColumn("TotalPrice", F.col("Quantity") * F.col("UnitPrice"))
    return out


RFM_COLUMNS = ["CustomerID", "InvoiceNo", "InvoiceDate", "TotalPrice"]


def _to_portable(c, dt):
    """A timestamp scalar that survives the trip to the driver unchanged by
    time zones: wall-clock text for TIMESTAMP_NTZ, epoch micros otherwise."""
    return c.cast("string") if isinstance(dt, T.TimestampNTZType) else F.unix_micros(c)


def _from_portable(v, dt):
    if isinstance(dt, T.TimestampNTZType):
        return F.lit(v).cast("timestamp_ntz")
    return F.timestamp_micros(F.lit(v))


def derive_rfm(df: DataFrame, customer: str = "CustomerID", invoice: str = "InvoiceNo",
               date: str = "InvoiceDate", total: str = "TotalPrice",
               high_value_q: float = 0.75) -> DataFrame | None:
    """One row per customer: Recency, Frequency, Monetary, AvgOrderValue, HighValue.

    * Recency: whole elapsed days from the customer's last purchase to
      (latest purchase overall + 1 day) — floors elapsed time, so 23:59 ->
      00:01 next day is 0 days.
    * Frequency: distinct invoices; Monetary: sum of TotalPrice.
    * AvgOrderValue: Monetary / Frequency, an infinite ratio becomes 0.
    * HighValue: 1 when Monetary >= its exact 0.75 quantile (interpolated).

    One shuffle by customer.  The two scalars (snapshot, threshold) are
    computed over the per-customer table — far smaller than the input —
    and enter the final projection as literals.
    """
    if not all(c in df.columns for c in (customer, invoice, date, total)):
        return None
    per = (df.where(F.col(customer).isNotNull())
             .groupBy(customer)
             .agg(F.max(date).alias("_last"),
                  F.count_distinct(invoice).alias("Frequency"),
                  F.sum(total).alias("Monetary")))
    # the per-customer table feeds three passes (snapshot + quantile fit and
    # the final projection): compute the big aggregation once
    per = materialize(per, "rfm")
    res = quantiles(per, [], [high_value_q], value="Monetary",
                    extra={"snapshot": _to_portable(F.max("_last"), per.schema["_last"].dataType)})
    snapshot = res.get(("__extra__", "snapshot"))
    thr = res.get((), [None])[0]
    snap = _from_portable(snapshot, per.schema["_last"].dataType) + F.expr("INTERVAL 1 DAY")
    aov = F.when(F.col("Frequency") == 0,
                 F.when(F.col("Monetary") == 0, F.lit(None)).otherwise(F.lit(0.0))) \
        .otherwise(F.col("Monetary") / F.col("Frequency"))
    return per.select(
        F.col(customer).alias("CustomerID"),
        F.timestamp_diff("DAY", F.col("_last"), snap).alias("Recency"),
        F.col("Frequency"),
        F.col("Monetary"),
        aov.alias("AvgOrderValue"),
        (F.col("Monetary") >= F.lit(thr)).cast("int").alias("HighValue"),
    )
