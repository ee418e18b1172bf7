"""Correlation matrices (A-13 Pearson, A-14 Spearman) in long form.

Output ``(col_a, col_b, corr)`` for every ordered pair including the
diagonal, pairwise-complete like pandas: a pair only uses rows where both
columns are present.  A constant column gives NULL (pandas: NaN).
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.rank import running_totals
from tessera.session import materialize


def _pair_corr(a, b):
    a2 = F.when(b.isNotNull(), a)
    b2 = F.when(a.isNotNull(), b)
    # covariance / (sd * sd) with NULL instead of a division error
    return F.try_divide(F.covar_samp(a2, b2), F.stddev_samp(a2) * F.stddev_samp(b2))


def _long_matrix(wide: DataFrame, cols: list[str]) -> DataFrame:
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            key = f"_c{min(i, j)}_{max(i, j)}"
            parts.append(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"),
                                  F.col(key).alias("corr")))
    return wide.select(F.explode(F.array(*parts)).alias("p")).select("p.*")


def _value(col: str):
    """The column as double; NaN counts as missing."""
    c = F.col(col).cast("double")
    return F.when(~F.isnan(c), c)


def pearson(df: DataFrame, cols: list[str]) -> DataFrame:
    """All pairs in one aggregation pass."""
    c = [_value(x) for x in cols]
    aggs = []
    for i in range(len(cols)):
        aggs.append(_pair_corr(c[i], c[i]).alias(f"_c{i}_{i}"))
    for i, j in combinations(range(len(cols)), 2):
        aggs.append(_pair_corr(c[i], c[j]).alias(f"_c{i}_{j}"))
    return _long_matrix(df.agg(*aggs), cols)


def spearman(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson on average ranks, pairwise-complete (pandas semantics).

    One scan stacks every row once per column pair (both values present) and
    collapses equal value pairs to a count, so hot values are few rows before
    anything is joined.  Each side is ranked per pair with the distributed
    :func:`avg_rank` over the counts, ranks are joined back by (pair, value)
    and one grouped aggregation gives every coefficient; the mean rank is
    (n + 1) / 2.  The job count does not grow with the number of columns.
    """
    spark = df.sparkSession
    pairs = list(combinations(range(len(cols)), 2))
    base = df.select(*[_value(c).alias(f"_v{i}") for i, c in enumerate(cols)])
    out = {}
    if pairs:
        stack = F.array(*[F.struct(F.lit(k).alias("pair"), F.col(f"_v{i}").alias("va"), F.col(f"_v{j}").alias("vb"))
                          for k, (i, j) in enumerate(pairs)])
        n = materialize(base.select(F.explode(stack).alias("s")).select("s.*").na.drop()
                        .groupBy("pair", "va", "vb").agg(F.count(F.lit(1)).alias("n")), "spearman")

        def ranks(side: str, out_col: str) -> DataFrame:
            c = n.groupBy("pair", side).agg(F.sum("n").alias("c"))
            r = running_totals(c, ["pair"], side, ["c"])
            return r.select("pair", side, (F.col("cum_c") - (F.col("c") - 1) / 2.0).alias(out_col))

        mid = n.groupBy("pair").agg(((F.sum("n") + 1) / 2.0).alias("mid"))  # one row per pair of columns
        j = n.join(ranks("va", "ra"), ["pair", "va"]).join(ranks("vb", "rb"), ["pair", "vb"]).join(mid, "pair")
        da, db = F.col("ra") - F.col("mid"), F.col("rb") - F.col("mid")
        sums = j.groupBy("pair").agg(F.sum(F.col("n") * da * db).alias("ab"), F.sum(F.col("n") * da * da).alias("aa"),
                                     F.sum(F.col("n") * db * db).alias("bb"))
        for r in sums.select("pair", F.try_divide(F.col("ab"), F.sqrt(F.col("aa") * F.col("bb"))).alias("r")).collect():
            out[pairs[r["pair"]]] = r["r"]
    diag = base.agg(*[_pair_corr(F.col(f"_v{i}"), F.col(f"_v{i}")).alias(f"_d{i}") for i in range(len(cols))]).first()
    rows = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            v = diag[f"_d{i}"] if i == j else out.get((min(i, j), max(i, j)))
            rows.append((a, b, None if v is None else float(v)))
    return spark.createDataFrame(rows, "col_a string, col_b string, corr double")


def corr_matrix(df: DataFrame, cols: list[str], method: str = "pearson") -> DataFrame:
    if method == "pearson":
        return pearson(df, cols)
    if method == "spearman":
        return spearman(df, cols)
    if method == "kendall":
        from tessera.operators.kendall import kendall
        return kendall(df, cols)
    raise ValueError(f"unknown method {method}")
