"""Mixing sources to target weights by entropy balancing.

Every document gets a rate r = min(cap, exp(lambda_s * u)), u being its size
over the size-weighted mean of its source: the distribution closest to taking
each document once (in relative entropy) among those whose expected words meet
the source's token constraint and whose rates stay under the cap.  The dual is
convex with a diagonal Hessian, one multiplier per source.  Newton steps run
as aggregations over the (source, size) histogram; multipliers live in a table,
only the largest residual comes to the driver.  Rates become whole copies by
rounding cumulative copies over descending sizes, which keeps each source's
words within half of one document, and a few single-copy corrections.

DataFrame operations only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import WORD, n_partitions, range_rank, salted
from tessera.session import discard, materialize


def source_targets(sources: DataFrame, weights: Sequence[float], total: float, cap: float) -> DataFrame:
    """Targets for ``(_sid, S)``: weights repeat over ``_sid``, the sources
    share ``total`` times all words, none exceeds ``cap`` times its own; what
    is above is shared again by weight until none is.  Each round collects
    three sums."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_sid") % len(weights) + 1).cast("int"))
    s = sources.withColumn("_w", w)
    first = s.agg(F.sum("S").alias("t"), F.sum("_w").alias("w")).first()
    want = total * float(first["t"] or 0)
    share, full = (want / first["w"] if first["w"] else 0.0), 0
    while True:
        over = F.col("S") * cap < F.lit(share) * F.col("_w")
        r = s.agg(F.count_if(over).alias("n"), F.sum(F.when(over, F.col("S") * cap)).alias("c"),
                  F.sum(F.when(~over, F.col("_w"))).alias("w")).first()
        if r["n"] == full or not r["w"]:
            break
        full = r["n"]
        share = (want - float(r["c"] or 0)) / r["w"]
    return s.withColumn("T", F.least(F.col("S") * F.lit(float(cap)), F.lit(share) * F.col("_w"))).drop("_w")


def _solve(hist: DataFrame, state: DataFrame, cap: float, tol: float = 1e-9, limit: int = 100) -> DataFrame:
    """Safeguarded Newton on each source's multiplier, all sources at once.
    Raises if some source has not converged after ``limit`` steps."""
    tilt = F.col("lam") * F.col("size") / F.col("m")
    capped = tilt >= F.lit(math.log(cap))
    words = F.col("n") * F.col("size")
    old = None
    for _ in range(limit):
        agg = hist.join(state, "_sid").groupBy("_sid").agg(
            F.sum(words * F.when(capped, F.lit(float(cap))).otherwise(F.exp(tilt))).alias("g"),
            F.sum(F.when(capped, 0.0).otherwise(words * F.col("size") / F.col("m") * F.exp(tilt))).alias("h"))
        gap = F.col("g") - F.col("T")
        new = materialize(state.join(agg, "_sid").select(
            "_sid", "S", "T", "m", "solved", F.abs(gap / F.col("T")).alias("err"), "lam",
            F.when(gap < 0, F.col("lam")).otherwise(F.col("lo")).alias("lo"),
            F.when(gap > 0, F.col("lam")).otherwise(F.col("hi")).alias("hi"),
            (F.col("lam") - gap / F.when(F.col("h") > 0, F.col("h"))).alias("step")), "mix-newton")
        discard(old)
        old = new
        worst = new.where(~F.col("solved")).agg(F.max("err")).first()[0]
        if worst is None or worst < tol:
            return new
        inside = (F.col("step") > F.col("lo")) & (F.col("step") < F.col("hi"))
        nxt = F.when(inside, F.col("step")).otherwise((F.col("lo") + F.col("hi")) / 2)
        state = new.withColumn("lam", F.when(F.col("solved") | (F.col("err") < tol), F.col("lam")).otherwise(nxt))
    raise RuntimeError("entropy balancing did not converge")


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), total: float = 1.5, cap: float = 2.0,
        text: str = "text", source: str = "source", row_id: str = "doc_id",
        carry: Sequence[str] = ()) -> DataFrame:
    """Copies of each document so that sources near their token targets.

    Sources in code point order (null last) get ``weights`` in turn and share
    ``total`` times all words, none above ``cap`` times its own.  ``cap`` must be a whole
    number, so that rounded rates stay under it.

    Returns ``row_id``, the columns in ``carry``, ``size`` (words; null text 0),
    ``source_size``, ``target``, ``rate``, ``copies`` and ``taken`` (copies
    times size), one row per input row.  A document without words gets rate 1.
    Other input columns are ignored, so their names never clash; null ids and
    repeated rows are ordinary rows, ties are broken by a hash of id and text
    (rows equal in both are interchangeable); an empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    keep = [row_id, *[c for c in carry if c != row_id]]
    d = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(keep)], F.col(source).alias("_src"),
                    F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
                    F.xxhash64(F.col(row_id), F.coalesce(F.col(text), F.lit(""))).alias("_tie"))
    d = materialize(d, "mix-docs")
    cells = materialize(d.groupBy("_src", "size").agg(F.count(F.lit(1)).alias("n")), "mix-cells")
    words = F.col("n") * F.col("size")
    src = cells.groupBy("_src").agg(F.sum(words).alias("S"), F.sum(words * F.col("size")).alias("_q"),
                                    F.min(F.when(F.col("size") > 0, F.col("size"))).alias("_least"))
    ranked = range_rank(src, [F.col("_src").asc_nulls_last()], "mix-sources")
    ranked = materialize(ranked.withColumnRenamed("_rank", "_sid"), "mix-ranked")
    state = source_targets(ranked, weights, total, cap)
    ratio = F.col("T") / F.col("S")
    m = F.col("_q") / F.col("S")
    full = ratio >= cap * (1 - 1e-12)
    top = math.log(cap) * m / F.col("_least")
    state = state.where(F.col("S") > 0).select(
        "_sid", "S", "T", m.alias("m"), (full | (ratio <= 0)).alias("solved"),
        F.when(full, top * 2).when(ratio <= 0, float("-inf")).otherwise(F.log(ratio)).alias("lam"),
        F.least(F.lit(0.0), F.log(ratio) * m / F.col("_least")).alias("lo"),
        F.greatest(F.lit(0.0), top).alias("hi"))
    state = materialize(state, "mix-state")
    sid = ranked.select(F.col("_src").alias("_src2"), "_sid")
    hist = materialize(cells.join(sid, F.col("_src").eqNullSafe(F.col("_src2"))).drop("_src", "_src2"), "mix-hist")
    # rounded, so that the order in which sums were added cannot show in a rerun
    lam = _solve(hist, state, cap).select("_sid", "T", F.round("lam", 9).alias("lam"), "m")

    tilt = F.col("lam") * F.col("size") / F.col("m")
    rate = F.when(F.col("lam").isNull() | (F.col("size") == 0), 1.0) \
        .when(tilt >= math.log(cap), float(cap)).otherwise(F.exp(tilt))
    by_size = Window.partitionBy("_sid").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, 0)
    cell = hist.join(lam, "_sid", "left").withColumn("rate", rate) \
        .withColumn("_cum", F.round(F.sum(F.col("n") * F.col("rate")).over(by_size)))
    prev = F.lag("_cum", 1, 0.0).over(Window.partitionBy("_sid").orderBy(F.col("size").desc()))
    most = (F.col("n") * F.lit(float(cap))).cast("long")
    cell = cell.withColumn("k", F.least(F.greatest((F.col("_cum") - prev).cast("long"), F.lit(0)), most)).drop("_cum")
    cell = _nearer(materialize(cell, "mix-copies"), most)

    base = F.floor(F.col("k") / F.col("n"))
    plan = cell.join(ranked.select("_sid", F.col("S").alias("source_size")), "_sid") \
        .join(source_targets(ranked, weights, total, cap).select("_sid", F.col("T").alias("target")), "_sid") \
        .select("_sid", "size", "rate", "source_size", "target", base.alias("_base"),
                (F.col("k") - base * F.col("n")).alias("_extra"))
    with_sid = d.join(sid, F.col("_src").eqNullSafe(F.col("_src2"))).drop("_src", "_src2")
    r = salted(with_sid, ["_sid", "size"], ["_tie"], F.col("_tie"), 4 * n_partitions(spark))
    copies = (F.col("_base") + (F.col("_rank") < F.col("_extra")).cast("long")).cast("long")
    return r.join(plan, ["_sid", "size"]).withColumn("copies", copies).select(
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(keep)], "size", "source_size", "target", "rate", "copies",
        (F.col("copies") * F.col("size")).alias("taken"))


def _nearer(cell: DataFrame, most, rounds: int = 3) -> DataFrame:
    """Add or remove one copy per source and round where that brings the
    source's words nearer to its target (a refinement; cells stay whole)."""
    for _ in range(rounds):
        left = cell.groupBy("_sid").agg((F.first("T", True) - F.sum(F.col("k") * F.col("size"))).alias("_left"))
        sign = F.when(F.col("_left") > 0, 1).otherwise(-1)
        gain = F.abs(F.col("_left")) - F.abs(F.abs(F.col("_left")) - F.col("size"))
        can = F.when(sign > 0, F.col("k") < most).otherwise(F.col("k") > 0) & (gain > 0.5)
        best = cell.join(left, "_sid").where(can).groupBy("_sid").agg(
            F.max(F.struct(gain.alias("g"), F.col("size"), sign.alias("s"))).alias("b")) \
            .select("_sid", F.col("b.size").alias("size"), F.col("b.s").alias("_d"))
        new = materialize(cell.join(best, ["_sid", "size"], "left")
                          .withColumn("k", F.col("k") + F.coalesce(F.col("_d"), F.lit(0))).drop("_d"), "mix-copies")
        discard(cell)
        cell = new
    return cell
