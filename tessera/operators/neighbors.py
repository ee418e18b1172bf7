"""Distances between rows (N-01) and the pairwise-distance operator (A-16).

Theta joins (``a.id < b.id``) would plan as nested loops.  ``pair_distances``
turns them into an equi-join on tile keys: rows are hashed into ``blocks``
groups, tile (i, j) with i <= j pairs group i with group j, so the n^2/2
distance evaluations spread over blocks*(blocks+1)/2 tasks and each row is
replicated ``blocks`` times.  Distances are plain column arithmetic and stay
inside whole-stage codegen.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.core import sample_n

METRICS = ("euclidean", "sqeuclidean", "cosine", "cityblock", "chebyshev", "minkowski")


def distance_expr(a: list[Column], b: list[Column], metric: str = "euclidean", p: float = 2.0) -> Column:
    diffs = [x - y for x, y in zip(a, b)]
    if metric == "euclidean":
        return F.sqrt(reduce(add, [d * d for d in diffs]))
    if metric == "sqeuclidean":
        return reduce(add, [d * d for d in diffs])
    if metric in ("cityblock", "manhattan"):
        return reduce(add, [F.abs(d) for d in diffs])
    if metric == "chebyshev":
        return F.greatest(*[F.abs(d) for d in diffs]) if len(diffs) > 1 else F.abs(diffs[0])
    if metric == "minkowski":
        return F.pow(reduce(add, [F.pow(F.abs(d), F.lit(p)) for d in diffs]), F.lit(1.0 / p))
    if metric == "cosine":
        dot = reduce(add, [x * y for x, y in zip(a, b)])
        na = F.sqrt(reduce(add, [x * x for x in a]))
        nb = F.sqrt(reduce(add, [y * y for y in b]))
        return F.lit(1.0) - F.try_divide(dot, na * nb)
    raise ValueError(f"unknown metric {metric}")


def pair_distances(df: DataFrame, id_col: str, cols: list[str], metric: str = "euclidean",
                   p: float = 2.0, blocks: int = 1) -> DataFrame:
    """Every unordered pair ``id_a < id_b`` of ``df`` with its distance.

    The output has n(n-1)/2 rows: callers bound n (a sample, a cluster
    summary table), this operator only spreads the work.
    """
    base = df.select(F.col(id_col).alias("_id"), *[F.col(c).cast("double").alias(c) for c in cols])
    blk = F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int")
    others = F.sequence(F.lit(0), F.lit(blocks - 1))
    left = base.select(F.col("_id").alias("id_a"), *[F.col(c).alias(f"a_{c}") for c in cols],
                       blk.alias("_bi"), F.explode(others).alias("_bj")).where(F.col("_bi") <= F.col("_bj"))
    right = base.select(F.col("_id").alias("id_b"), *[F.col(c).alias(f"b_{c}") for c in cols],
                        blk.alias("_bj"), F.explode(others).alias("_bi")).where(F.col("_bi") <= F.col("_bj"))
    j = left.join(right, ["_bi", "_bj"]).where(
        (F.col("_bi") < F.col("_bj")) | (F.col("id_a") < F.col("id_b")))
    d = distance_expr([F.col(f"a_{c}") for c in cols], [F.col(f"b_{c}") for c in cols], metric, p)
    lo = F.least("id_a", "id_b")
    hi = F.greatest("id_a", "id_b")
    return j.select(lo.alias("id_a"), hi.alias("id_b"), d.alias("dist"))


def pairwise_distance(df: DataFrame, id_col: str, cols: list[str], metric: str = "euclidean",
                      n: int = 50, seed: int = 42, p: float = 2.0,
                      sample_method: str = "xxhash64") -> DataFrame:
    """Distances between all pairs of a seeded sample of ``n`` complete rows
    (the sample size is the operator's parameter, as in the reference)."""
    complete = df.na.drop(subset=cols)
    s = sample_n(complete, n, seed, id_col, method=sample_method)
    blocks = max(1, -(-n // 4000))
    return pair_distances(s, id_col, cols, metric, p, blocks)
