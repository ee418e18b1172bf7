"""Shared row-level helpers: guards, sampling, selection, unpivot, previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import numeric_cols


def require_rows(df: DataFrame, n: int, what: str = "operation") -> None:
    """Raise when ``df`` has fewer than ``n`` rows (reads at most n rows)."""
    got = df.limit(n).count()
    if got < n:
        raise ValueError(f"{what} needs at least {n} rows, got {got}")


def require_numeric(df: DataFrame, n: int = 1) -> list[str]:
    cols = numeric_cols(df)
    if len(cols) < n:
        raise ValueError(f"need at least {n} numeric columns, got {len(cols)}")
    return cols


def default_features(df: DataFrame, n: int) -> list[str]:
    """The first ``n`` numeric columns (the reference's default selection)."""
    return numeric_cols(df)[:n]


def portable_hash(id_col: str, seed: int):
    """Integer id -> [0, 2^31): a multiplicative hash any SQL engine can repeat:
    ``((id mod 2147483647) * 1103515245 + seed) mod 2147483648``."""
    x = F.pmod(F.col(id_col).cast("bigint"), F.lit(2147483647))
    return F.pmod(x * F.lit(1103515245) + F.lit(seed), F.lit(2147483648))


def sample_n(df: DataFrame, n: int, seed: int, id_col: str, method: str = "xxhash64") -> DataFrame:
    """Exactly ``min(n, rows)`` rows, chosen by a seeded hash of the id.

    Top-n by hash (TakeOrderedAndProject: per-partition top-n, then a merge of
    n rows per partition) — no full sort, no driver round-trip, and the choice
    does not depend on partitioning.  ``method="portable"`` uses
    :func:`portable_hash` so another engine can draw the same sample.
    """
    if method == "portable":
        h = portable_hash(id_col, seed)
    else:
        h = F.xxhash64(F.col(id_col), F.lit(seed).cast("bigint"))
    return df.orderBy(h, F.col(id_col)).limit(n)


def missing_only(report: DataFrame) -> DataFrame:
    """The rows of a missing report whose column has missing values."""
    return report.where(F.col("missing") > 0)


def outlier_label(flag) -> Column:
    """"Outlier" / "Normal" for a 0/1 flag."""
    return F.when(F.col(flag) == 1, "Outlier").otherwise("Normal")


def cluster_label(cluster) -> Column:
    """"Noise" for -1, "Cluster n" otherwise."""
    return F.when(F.col(cluster) == -1, "Noise").otherwise(F.concat(F.lit("Cluster "), F.col(cluster).cast("string")))


def head(df: DataFrame, n: int, order_by: str | list[str]) -> DataFrame:
    """First ``n`` rows in an explicit order (TakeOrderedAndProject, no full sort)."""
    keys = [order_by] if isinstance(order_by, str) else order_by
    return df.orderBy(*[F.col(k) for k in keys]).limit(n)


def tail(df: DataFrame, n: int, order_by: str | list[str]) -> DataFrame:
    """Last ``n`` rows of that order (returned last-first)."""
    keys = [order_by] if isinstance(order_by, str) else order_by
    return df.orderBy(*[F.col(k).desc() for k in keys]).limit(n)


def melt(df: DataFrame, ids: list[str], values: list[str] | None = None,
         var_name: str = "variable", value_name: str = "value") -> DataFrame:
    """Wide -> long; values are cast to double so mixed numeric types stack."""
    values = values or [c for c in df.columns if c not in ids]
    casted = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in values])
    return casted.unpivot(ids, values, var_name, value_name)
