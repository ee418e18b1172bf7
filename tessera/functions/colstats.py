"""Per-column scalar statistics, fitted in as few passes as possible.

This is the J-10 "scalar broadcast" pattern: a statistic of a whole column
(mean, std, quantile ...) is computed by one distributed aggregation, comes
back to the driver as a handful of numbers, and is applied to every row as a
literal inside a column expression (no join, no cross product).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import stack_long
from tessera.functions.quantile import quantiles

MOMENTS = {
    "count": F.count, "mean": F.avg, "std": F.stddev_samp, "std_pop": F.stddev_pop,
    "min": F.min, "max": F.max,
}


def _valid(c: str):
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v), v)


def column_stats(df: DataFrame, cols: list[str], stats: list[str],
                 probs: list[float] | None = None) -> dict[str, dict]:
    """``{col: {stat: value, "q<p>": quantile...}}``; NaN counts as missing."""
    out = {c: {} for c in cols}
    mom = [s for s in stats if s in MOMENTS]
    if mom and probs:
        # moments ride along in the quantile sketch pass: one job fewer
        long = stack_long(df, cols)
        v = F.when(~F.isnan("value"), F.col("value"))
        q = quantiles(long, ["column"], probs, extra={s: MOMENTS[s](v) for s in mom})
        for c in cols:
            vals = q.get((c,))
            for s in mom:
                x = q.get(("__extra__", s, (c,)))
                out[c][s] = float(x) if x is not None else None
            for j, p in enumerate(probs):
                out[c][f"q{p}"] = vals[j] if vals else None
        return out
    if mom:
        row = df.agg(*[MOMENTS[s](_valid(c)).alias(f"{s}__{i}")
                       for i, c in enumerate(cols) for s in mom]).first()
        for i, c in enumerate(cols):
            for s in mom:
                v = row[f"{s}__{i}"]
                out[c][s] = float(v) if v is not None else None
    if probs:
        long = stack_long(df, cols)
        q = quantiles(long, ["column"], probs)
        for c in cols:
            vals = q.get((c,))
            for j, p in enumerate(probs):
                out[c][f"q{p}"] = vals[j] if vals else None
    return out
