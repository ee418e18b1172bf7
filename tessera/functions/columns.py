"""Small column-expression helpers (everything stays JVM-side, codegen'd)."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
            T.DoubleType, T.DecimalType)


def numeric_cols(df: DataFrame) -> list[str]:
    """Numeric columns in schema order (boolean excluded, decimal included)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC)]


def any_of(preds: list[Column]) -> Column:
    """OR across several predicates; NULL predicates count as false."""
    return reduce(or_, [F.coalesce(p, F.lit(False)) for p in preds])


def stack_long(df: DataFrame, cols: list[str], keys: list[str] | None = None,
               name: str = "column", value: str = "value") -> DataFrame:
    """Unpivot ``cols`` (cast to double) into ``(keys..., name, value)``."""
    keys = keys or []
    casted = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols])
    return casted.unpivot(keys, cols, name, value) if keys else \
        casted.unpivot([], cols, name, value)
