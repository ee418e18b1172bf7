"""Exact, linearly interpolated quantiles that scale past one task's memory.

pandas' ``quantile`` (linear interpolation between order statistics) is the
semantics to match.  Spark's exact ``percentile`` aggregate keeps a
value->count map per group and merges it in one task: fine for a few million
values, fatal for a 100 TB column.  Instead, distributed selection:

* pass 1 (one aggregation): count, min, max and an approximate quantile
  sketch (``percentile_approx``, mergeable, bounded memory) per series.  For
  each target order statistic the sketch gives a narrow value bracket;
* pass 2..: one aggregation per pass over the rows at or below the brackets:
  rows strictly below (a count) and the rows inside, either as exact
  ``(value, count)`` pairs when the bracket is small (``collect_rows``) or as
  ``buckets`` equal-width sub-ranges (count, min, max).  The sub-range holding
  the target rank becomes the next bracket.  A bracket that missed the rank
  (sketch error) is widened to the side the rank lies on.

Two passes suffice for millions of rows per series; each further pass shrinks
a bracket by ~``buckets``x.  Memory per task is bounded by the sketch and by
``buckets`` x targets; hot values are absorbed by partial aggregation.
Results come back as a small table (series x probabilities).
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ACCURACY = 10_000
BUCKETS = 4096
COLLECT_ROWS = 20_000
DRIVER_BUDGET = 1_000_000  # rows one refinement pass may return, over all brackets


def _interp(lo: float, hi: float, pos: float) -> float:
    # same arithmetic as Spark's percentile: (higher-pos)*lower + (pos-lower)*higher
    fl = math.floor(pos)
    if lo == hi or pos == fl:
        return float(lo)
    return (fl + 1 - pos) * lo + (pos - fl) * hi


def quantiles(long_df: DataFrame, keys: list[str], probs: list[float],
              value: str = "value", accuracy: int = ACCURACY, buckets: int = BUCKETS,
              collect_rows: int = COLLECT_ROWS, extra: dict | None = None, **_ignored) -> dict:
    """Exact quantiles of ``value`` per ``keys`` group.

    Returns ``{key_tuple: [q(p) for p in probs]}`` plus the count under key
    ``("__n__", key_tuple)``; series with no non-null value are absent.
    The number of groups must be modest (it is held on the driver).
    ``extra``: ``{name: aggregate Column}`` evaluated per series in the first
    pass (saves a separate job); results under ``("__extra__", name, key)``
    (``("__extra__", name)`` for a single series).
    """
    if not keys:  # one series: give it a constant key so every join stays an equi-join
        res = quantiles(long_df.withColumn("_series", F.lit(0)), ["_series"], probs, value,
                        accuracy, buckets, collect_rows, extra)
        out = {(() if k == (0,) else ("__n__", ())): v for k, v in res.items()
               if k == (0,) or k == ("__n__", (0,))}
        out.update({k[:2]: v for k, v in res.items() if k[0] == "__extra__"})
        return out
    extra = extra or {}
    v = F.col(value).cast("double")
    valid = v.isNotNull() & ~F.isnan(v)
    margin = 3.0 / accuracy
    sk = sorted({min(1.0, max(0.0, p + d)) for p in probs for d in (-margin, margin)})
    # pass 1: size, range and a quantile sketch of every series (+ extras)
    stats = long_df.groupBy(*keys).agg(
        F.count(F.when(valid, F.lit(1))).alias("_n"),
        F.min(F.when(valid, v)).alias("_lo"), F.max(F.when(valid, v)).alias("_hi"),
        F.percentile_approx(F.when(valid, v), sk, accuracy).alias("_sk"),
        *[c.alias(f"_x_{n}") for n, c in extra.items()]).collect()
    out: dict = {}
    for r in stats:
        for n in extra:
            out[("__extra__", n, tuple(r[k] for k in keys))] = r[f"_x_{n}"]
    stats = [r for r in stats if r["_n"] > 0]
    if not stats:
        return out
    data = long_df.select(*keys, v.alias("_v")).where(valid)
    out.update(_select(long_df.sparkSession, data, keys, probs, stats, sk, margin,
                       buckets, collect_rows))
    return out


def _select(spark: SparkSession, data: DataFrame, keys: list[str], probs: list[float],
            stats, sk: list[float], margin: float, buckets: int, collect_rows: int) -> dict:
    targets = {}
    need = defaultdict(list)
    for r in stats:
        key = tuple(r[k] for k in keys)
        n = r["_n"]
        sketch = dict(zip(sk, r["_sk"]))
        for p in probs:
            pos = p * (n - 1)
            lo = sketch[min(1.0, max(0.0, p - margin))]
            hi = sketch[min(1.0, max(0.0, p + margin))]
            for rank in {math.floor(pos), math.ceil(pos)}:
                tid = len(targets)
                targets[tid] = {"key": key, "rank": rank, "lo": max(lo, r["_lo"]), "hi": min(hi, r["_hi"]),
                                "min": r["_lo"], "max": r["_hi"], "value": None,
                                "est": 3 * margin * n + 2, "fetch": True}
                need[(key, p)].append(tid)
    key_fields = [T.StructField(k, data.schema[k].dataType) for k in keys]
    schema = T.StructType(key_fields + [T.StructField("_tid", T.LongType()),
                                        T.StructField("_tlo", T.DoubleType()),
                                        T.StructField("_thi", T.DoubleType()),
                                        T.StructField("_f", T.BooleanType())])
    while True:
        open_t = {t: s for t, s in targets.items() if s["value"] is None}
        if not open_t:
            break
        # keep what one pass brings back to the driver bounded for many series
        share = max(64, DRIVER_BUDGET // len(open_t))
        n_buckets, fetch_rows = min(buckets, share), min(collect_rows, share)
        for s in open_t.values():
            s["fetch"] = s["est"] <= fetch_rows or s["lo"] == s["hi"]
        # targets sharing a bracket (e.g. the two ranks around one quantile)
        # share one exploded copy of the rows
        brackets: dict = {}
        for t, s in open_t.items():
            s["bid"] = brackets.setdefault((s["key"], s["lo"], s["hi"], s["fetch"]), len(brackets))
        tdf = spark.createDataFrame(
            [(*key, b, float(lo), float(hi), f) for (key, lo, hi, f), b in brackets.items()], schema)
        # bracket table is tiny (series x probabilities): broadcast equi-join
        cond = [data[k].eqNullSafe(tdf[k]) for k in keys]
        j = data.join(F.broadcast(tdf), cond, "inner").drop(*[tdf[k] for k in keys]) \
            .where(F.col("_v") <= F.col("_thi"))
        below = F.col("_v") < F.col("_tlo")
        width = (F.col("_thi") - F.col("_tlo")) / n_buckets
        bucket = (F.when(below, F.lit(-2)).when(F.col("_f"), F.lit(-1))
                  .otherwise(F.least(F.lit(n_buckets - 1), F.floor(
                      F.try_divide(F.col("_v") - F.col("_tlo"), width)).cast("int"))))
        grp = j.select("_tid", bucket.alias("_b"),
                       F.when(bucket == -1, F.col("_v")).alias("_ev"), "_v")
        agg = grp.groupBy("_tid", "_b", "_ev").agg(
            F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_mn"), F.max("_v").alias("_mx")).collect()
        per = defaultdict(list)
        for r in agg:
            per[r["_tid"]].append(r)
        for t, s in open_t.items():
            rows = per.get(s["bid"], [])
            nb = sum(r["_c"] for r in rows if r["_b"] == -2)
            inside = [r for r in rows if r["_b"] != -2]
            n_in = sum(r["_c"] for r in inside)
            if s["rank"] < nb:  # sketch bracket too high: search below it
                s["hi"] = math.nextafter(s["lo"], -math.inf)
                s["lo"], s["est"] = s["min"], nb
                continue
            if s["rank"] >= nb + n_in:  # sketch bracket too low: search above it
                s["lo"] = math.nextafter(s["hi"], math.inf)
                s["hi"], s["est"] = s["max"], float("inf")
                continue
            cum = nb
            if s["fetch"]:
                for val, c in sorted((r["_ev"], r["_c"]) for r in inside):
                    if cum + c > s["rank"]:
                        s["value"] = val
                        break
                    cum += c
            else:
                for r in sorted(inside, key=lambda r: r["_b"]):
                    if cum + r["_c"] > s["rank"]:
                        s["lo"], s["hi"], s["est"] = r["_mn"], r["_mx"], r["_c"]
                        break
                    cum += r["_c"]
    out: dict = {}
    for r in stats:
        key = tuple(r[k] for k in keys)
        n = r["_n"]
        qs = []
        for p in probs:
            vals = {targets[t]["rank"]: targets[t]["value"] for t in need[(key, p)]}
            pos = p * (n - 1)
            qs.append(_interp(vals[math.floor(pos)], vals[math.ceil(pos)], pos))
        out[key] = qs
        out[("__n__", key)] = n
    return out


def quantile_table(spark: SparkSession, result: dict, keys: list[str], probs: list[float],
                   names: list[str], key_types: list[T.DataType] | None = None) -> DataFrame:
    """Turn a :func:`quantiles` result into a small DataFrame (one row per series)."""
    key_types = key_types or [T.StringType()] * len(keys)
    schema = T.StructType([T.StructField(k, t) for k, t in zip(keys, key_types)] +
                          [T.StructField(n, T.DoubleType()) for n in names])
    rows = [(*k, *v) for k, v in result.items() if not (k and k[0] in ("__n__", "__extra__"))]
    return spark.createDataFrame(rows, schema)


def grouped_quantiles(long_df: DataFrame, keys: list[str], probs: list[float], names: list[str],
                      value: str = "value") -> DataFrame:
    """``(keys..., names...)``: exact interpolated quantiles for any number of
    series.  Nothing but the result leaves the executors: values collapse to
    counts, running totals give every value its ranks, and the two order
    statistics of each quantile are minima over a grouped scan."""
    from tessera.functions.rank import running_totals
    c = long_df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    r = running_totals(c, keys, value, ["_c"])
    n = c.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    aggs = []
    for p, name in zip(probs, names):
        pos = F.lit(p) * (F.col("_n") - 1)
        for tag, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            aggs.append(F.min(F.when(F.col("cum__c") > at, F.col(value))).alias(f"_{tag}_{name}"))
    g = r.join(n, keys).groupBy(*keys, "_n").agg(*aggs)
    out = []
    for p, name in zip(probs, names):
        pos = F.lit(p) * (F.col("_n") - 1)
        lo, hi, fl = F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), F.floor(pos)
        out.append(F.when((lo == hi) | (pos == fl), lo).otherwise((fl + 1 - pos) * lo + (pos - fl) * hi).alias(name))
    return g.select(*keys, *out)
