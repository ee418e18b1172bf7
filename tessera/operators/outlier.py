"""Outlier detection (O-01..O-08): per-method flags as columns of one frame,
agreement, consensus, impact; LOF and isolation forest live in
``tessera.operators.knn`` / ``tessera.operators.iforest``.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.colstats import column_stats
from tessera.functions.columns import any_of


def _num(c: str) -> Column:
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v), v)


def zscore_flag(df: DataFrame, cols: list[str], threshold: float = 3.0, st: dict | None = None) -> Column:
    """1 when any feature has |x - mean| > threshold * std (ddof=1).

    Written without a division: a constant column never flags and ANSI mode
    never sees 0/0.
    """
    st = st or column_stats(df, cols, ["mean", "std"])
    preds = [F.abs(_num(c) - F.lit(st[c]["mean"])) > F.lit(threshold) * F.lit(st[c]["std"])
             for c in cols if st[c]["std"] is not None]
    return any_of(preds).cast("int") if preds else F.lit(0)


def iqr_flag(df: DataFrame, cols: list[str], k: float = 1.5, st: dict | None = None) -> Column:
    """1 when any feature lies outside [Q1 - k·IQR, Q3 + k·IQR]."""
    st = st or column_stats(df, cols, [], probs=[0.25, 0.75])
    preds = []
    for c in cols:
        q1, q3 = st[c]["q0.25"], st[c]["q0.75"]
        if q1 is None:
            continue
        iqr = q3 - q1
        preds.append((_num(c) < F.lit(q1 - k * iqr)) | (_num(c) > F.lit(q3 + k * iqr)))
    return any_of(preds).cast("int") if preds else F.lit(0)


def outlier_flags(df: DataFrame, id_col: str, cols: list[str], zscore: float | None = 3.0,
                  iqr: float | None = 1.5, extra: dict[str, DataFrame] | None = None,
                  keep: list[str] | None = None) -> DataFrame:
    """``(id, <method> int..., total_methods int)`` on the complete rows.

    Flags are columns of the same frame (no positional re-alignment).  Flags
    from neighbour methods (``extra``: ``{name: DataFrame(id, flag)}``) are
    joined on the id.
    """
    data = df.na.drop(subset=cols)
    flags = []
    cols_out = [F.col(id_col)] + [F.col(c) for c in (keep or [])]
    # one statistics fit for both rules (moments ride in the quantile pass)
    st = column_stats(data, cols, ["mean", "std"] if zscore is not None else [],
                      probs=[0.25, 0.75] if iqr is not None else None)
    if zscore is not None:
        cols_out.append(zscore_flag(data, cols, zscore, st).alias("zscore"))
        flags.append("zscore")
    if iqr is not None:
        cols_out.append(iqr_flag(data, cols, iqr, st).alias("iqr"))
        flags.append("iqr")
    out = data.select(*cols_out)
    for name, fdf in (extra or {}).items():
        out = out.join(fdf.select(F.col(fdf.columns[0]).alias(id_col),
                                  F.col(fdf.columns[1]).cast("int").alias(name)), id_col, "left") \
            .withColumn(name, F.coalesce(F.col(name), F.lit(0)))
        flags.append(name)
    total = reduce(add, [F.col(f) for f in flags]) if flags else F.lit(0)
    return out.withColumn("total_methods", total.cast("int"))


def outlier_summary(flags: DataFrame, methods: list[str]) -> DataFrame:
    """Per method: outliers and % of rows (2 dp)."""
    agg = flags.agg(F.count(F.lit(1)).alias("_n"), *[F.sum(m).alias(m) for m in methods])
    parts = [F.struct(F.lit(m).alias("method"), F.col(m).cast("bigint").alias("outliers"),
                      F.round(F.try_divide(F.col(m) * 100.0, F.col("_n")), 2).alias("pct"))
             for m in methods]
    return agg.select(F.explode(F.array(*parts)).alias("p")).select("p.*")


def agreement_counts(flags: DataFrame) -> DataFrame:
    """Rows by number of methods that flagged them, in key order."""
    return flags.groupBy("total_methods").agg(F.count(F.lit(1)).alias("rows")).orderBy("total_methods")


def consensus(flags: DataFrame, n: int) -> DataFrame:
    """Adds ``consensus`` (1 when at least ``n`` methods agree)."""
    return flags.withColumn("consensus", (F.col("total_methods") >= n).cast("int"))


def consensus_summary(flags: DataFrame, n: int) -> DataFrame:
    c = consensus(flags, n)
    return c.agg(F.sum("consensus").cast("bigint").alias("outliers"),
                 F.round(F.avg("consensus") * 100.0, 2).alias("pct"))


def drop_outliers(df: DataFrame, flags: DataFrame, id_col: str, n: int) -> DataFrame:
    """Rows of ``df`` that are not consensus outliers (anti join on the id)."""
    bad = consensus(flags, n).where(F.col("consensus") == 1).select(id_col)
    return df.join(bad, id_col, "left_anti")


def impact(df: DataFrame, flags: DataFrame, id_col: str, cols: list[str], n: int,
           digits: int = 3) -> DataFrame:
    """count/mean/std/min/quartiles/max per feature with and without the
    consensus outliers (``scope`` = all | cleaned)."""
    from tessera.operators.profile import describe_numeric
    kept = drop_outliers(df.na.drop(subset=cols), flags, id_col, n)
    a = describe_numeric(df.na.drop(subset=cols), cols, digits).withColumn("scope", F.lit("all"))
    b = describe_numeric(kept, cols, digits).withColumn("scope", F.lit("cleaned"))
    return a.unionByName(b)
