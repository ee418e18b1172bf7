"""Streaming use of the row-local operators.

The reference is batch only.  Retail cleaning and a fitted model's scoring
are row-local, so the same functions apply unchanged to a streaming
DataFrame (``spark.readStream``); :func:`clean_stream` wires that up and
:func:`write_clean` appends the cleaned rows to a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessera.operators.retail import clean_retail


def clean_stream(stream: DataFrame) -> DataFrame:
    """Row-local cleaning of a streaming retail source (no state)."""
    return clean_retail(stream)


def write_clean(stream: DataFrame, path: str, checkpoint: str, trigger_once: bool = True):
    """Append cleaned rows to a parquet table; the query checkpoint makes the
    sink exactly-once across restarts."""
    w = clean_stream(stream).writeStream.format("parquet").option("path", path) \
        .option("checkpointLocation", checkpoint).outputMode("append")
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start()
