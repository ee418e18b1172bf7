"""Kendall tau-b correlation (A-15), exact, without a self-join.

tau_b = (C - D) / sqrt((n0 - n1)(n0 - n2)); with n0 all pairs, n1 / n2 pairs
tied in x / y and n3 tied in both, C = n0 - n1 - n2 + n3 - D, so only the
discordant count D (pairs with x_i < x_j and y_i > y_j) needs pair logic.

Rows collapse to weighted distinct (x, y) points and x to its dense rank.  Any
two ranks first differ in exactly one bit: for every bit, points that share
the higher bits form a series, and each point with a 0 there is discordant
with those of the series that have a 1 and a smaller y.  These are running
totals in order of y, so D is one grouped sum over points x bits, with no
range, group or driver limit.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.rank import running_totals
from tessera.session import discard, materialize


def discordant(pts: DataFrame, ranges: int | None = None) -> DataFrame:
    """``(pair, d)``: per pair of columns the weighted number of pairs with
    x_i < x_j and y_i > y_j among the points ``(pair, x, y, w)``."""
    xs = running_totals(pts.select("pair", "x").distinct().withColumn("one", F.lit(1)), ["pair"], "x", ["one"],
                        ranges=ranges).select("pair", "x", (F.col("cum_one") - 1).alias("i"))
    top = xs.groupBy("pair").agg(F.max("i").alias("top"))
    bits = F.length(F.bin("top")) - 1
    p = pts.join(xs, ["pair", "x"]).join(top, "pair").withColumn("b", F.explode(F.sequence(F.lit(0), bits)))
    one = F.expr("shiftright(i, b) & 1")
    s = p.groupBy("pair", "b", F.expr("shiftright(i, b + 1)").alias("prefix"), "y").agg(
        F.sum(F.when(one == 0, F.col("w")).otherwise(0.0)).alias("w0"),
        F.sum(F.when(one == 1, F.col("w")).otherwise(0.0)).alias("w1"))
    r = running_totals(s, ["pair", "b", "prefix"], "y", ["w1"], ranges=ranges)
    return r.groupBy("pair").agg(F.sum(F.col("w0") * (F.col("cum_w1") - F.col("w1"))).alias("d"))


def tau_b(df: DataFrame, cols: list[str], ranges: int | None = None) -> dict[tuple[int, int], float | None]:
    """tau-b of every pair of columns (by position), all pairs in the same few
    jobs; a row counts for a pair if both values are present."""
    pairs = list(combinations(range(len(cols)), 2))
    if not pairs:
        return {}
    v = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(f"_v{i}") for i, c in enumerate(cols)]
    stack = F.array(*[F.struct(F.lit(k).alias("pair"), F.col(f"_v{i}").alias("x"), F.col(f"_v{j}").alias("y"))
                      for k, (i, j) in enumerate(pairs)])
    pts = materialize(df.select(*v).select(F.explode(stack).alias("s")).select("s.*").na.drop()
                      .groupBy("pair", "x", "y").agg(F.count(F.lit(1)).cast("double").alias("w")), "kendall")

    def tie(c: str):
        return F.sum(F.col(c) * (F.col(c) - 1) / 2)

    def ties(side: str) -> DataFrame:
        return pts.groupBy("pair", side).agg(F.sum("w").alias("t")).groupBy("pair").agg(
            tie("t").alias(f"t{side}"), F.count(F.lit(1)).alias(f"k{side}"))

    stats = pts.groupBy("pair").agg(F.sum("w").alias("n"), tie("w").alias("n3")).join(ties("x"), "pair") \
        .join(ties("y"), "pair").collect()  # one row per pair of columns
    # symmetric: the side with fewer values is ranked, fewer ranks mean fewer bits
    turned = [r["pair"] for r in stats if r["kx"] > r["ky"]]
    turn = F.col("pair").isin(turned) if turned else F.lit(False)
    d = {r["pair"]: r["d"] for r in discordant(pts.select(
        "pair", F.when(turn, F.col("y")).otherwise(F.col("x")).alias("x"),
        F.when(turn, F.col("x")).otherwise(F.col("y")).alias("y"), "w"), ranges).collect()}
    discard(pts)
    out: dict[tuple[int, int], float | None] = dict.fromkeys(pairs)
    for r in stats:
        n0, n1, n2 = r["n"] * (r["n"] - 1) / 2, r["tx"], r["ty"]
        if n0 - n1 > 0 and n0 - n2 > 0:
            conc = n0 - n1 - n2 + r["n3"] - d[r["pair"]]
            out[pairs[r["pair"]]] = (conc - d[r["pair"]]) / math.sqrt((n0 - n1) * (n0 - n2))
    return out


def kendall_tau(df: DataFrame, a: str, b: str, ranges: int | None = None) -> float | None:
    return tau_b(df, [a, b], ranges)[0, 1]


def kendall(df: DataFrame, cols: list[str]) -> DataFrame:
    """Long-form Kendall tau-b matrix ``(col_a, col_b, corr)``."""
    out = tau_b(df, cols)
    distinct = df.agg(*[F.count_distinct(c).alias(f"_d{i}") for i, c in enumerate(cols)]).first()
    rows = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            v = (1.0 if distinct[f"_d{i}"] > 1 else None) if i == j else out[(min(i, j), max(i, j))]
            rows.append((a, b, v))
    return df.sparkSession.createDataFrame(rows, "col_a string, col_b string, corr double")
