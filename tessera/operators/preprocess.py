"""Preprocessing (F-02..F-16): impute, cap outliers, scale, discretise, PCA.

Each fitted transform is two steps: a distributed aggregation computes the
per-column parameters (a few numbers per column), then a single projection
applies them as literals — the transform stays in one codegen stage and
keeps row order / partitioning intact.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.colstats import column_stats
from tessera.functions.columns import numeric_cols, stack_long
from tessera.functions.mode import modes
from tessera.functions.sqltext import dlit, ident
from tessera.session import materialize


def _replace(df: DataFrame, exprs: dict) -> DataFrame:
    return df.select(*[exprs[c].alias(c) if c in exprs else F.col(f"`{c}`") for c in df.columns])


def _num(c: str):
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v), v)


# ---------------------------------------------------------------- imputation
def impute(df: DataFrame, cols: list[str], strategy: str = "mean") -> DataFrame:
    """Fill missing values per column with its mean / median / most frequent
    value (smallest on ties), or drop incomplete rows (``"drop"``)."""
    if strategy == "drop":
        return df.na.drop(subset=cols)
    if strategy == "mean":
        st = column_stats(df, cols, ["mean"])
        fill = {c: st[c]["mean"] for c in cols}
    elif strategy == "median":
        st = column_stats(df, cols, [], probs=[0.5])
        fill = {c: st[c]["q0.5"] for c in cols}
    elif strategy in ("most_frequent", "mode"):
        m = modes(stack_long(df, cols).where(~F.isnan("value")), ["column"]).collect()
        fill = {r["column"]: r["mode"] for r in m}
    else:
        raise ValueError(f"unknown strategy {strategy}")
    return _replace(df, {c: F.coalesce(_num(c), F.lit(fill.get(c)).cast("double")) for c in cols})


def imputed_count(df: DataFrame, cols: list[str], strategy: str) -> int:
    """Cells filled (or rows dropped, for ``"drop"``)."""
    if strategy == "drop":
        cond = F.lit(False)
        for c in cols:
            cond = cond | F.col(c).isNull()
        return df.where(cond).count()
    return df.agg(sum((F.count_if(_num(c).isNull()) for c in cols), F.lit(0)).alias("n")).first()["n"]


# ------------------------------------------------------------------- capping
def cap_bounds(df: DataFrame, cols: list[str], method: str = "iqr", k: float | None = None) -> dict:
    """``{col: (lower, upper)}`` — IQR fences (k=1.5) or mean ± k·std (k=3)."""
    if method == "iqr":
        k = 1.5 if k is None else k
        st = column_stats(df, cols, [], probs=[0.25, 0.75])
        out = {}
        for c in cols:
            q1, q3 = st[c]["q0.25"], st[c]["q0.75"]
            out[c] = (None, None) if q1 is None else (q1 - k * (q3 - q1), q3 + k * (q3 - q1))
        return out
    if method == "zscore":
        k = 3.0 if k is None else k
        st = column_stats(df, cols, ["mean", "std"])
        out = {}
        for c in cols:
            m, s = st[c]["mean"], st[c]["std"]
            out[c] = (None, None) if m is None or s is None else (m - k * s, m + k * s)
        return out
    raise ValueError(f"unknown method {method}")


def _clip(c: str, lo, hi):
    v = _num(c)
    if lo is None:
        return v
    # when/otherwise keeps NULL as NULL (greatest/least would replace it)
    return F.when(v < lo, F.lit(lo)).when(v > hi, F.lit(hi)).otherwise(v)


def cap_outliers(df: DataFrame, cols: list[str], method: str = "iqr", k: float | None = None,
                 bounds: dict | None = None) -> DataFrame:
    bounds = bounds or cap_bounds(df, cols, method, k)
    return _replace(df, {c: _clip(c, *bounds[c]) for c in cols})


def capped_count(df: DataFrame, bounds: dict) -> DataFrame:
    """Cells outside the bounds, per column (one pass)."""
    aggs = [F.count_if((_num(c) < lo) | (_num(c) > hi)).alias(c)
            for c, (lo, hi) in bounds.items() if lo is not None]
    return df.agg(*aggs)


# ------------------------------------------------------------------- scaling
def scale_params(df: DataFrame, cols: list[str], method: str) -> dict:
    """``{col: (center, scale)}``; a zero scale becomes 1 (constant -> 0)."""
    if method == "minmax":
        st = column_stats(df, cols, ["min", "max"])
        par = {c: (st[c]["min"], None if st[c]["min"] is None else st[c]["max"] - st[c]["min"])
               for c in cols}
    elif method == "standard":
        st = column_stats(df, cols, ["mean", "std_pop"])
        par = {c: (st[c]["mean"], st[c]["std_pop"]) for c in cols}
    elif method == "robust":
        st = column_stats(df, cols, [], probs=[0.25, 0.5, 0.75])
        par = {c: (st[c]["q0.5"], None if st[c]["q0.5"] is None else st[c]["q0.75"] - st[c]["q0.25"])
               for c in cols}
    else:
        raise ValueError(f"unknown method {method}")
    return {c: (a, 1.0 if (b is None or b == 0) else b) for c, (a, b) in par.items()}


def scale(df: DataFrame, cols: list[str], method: str = "standard", params: dict | None = None) -> DataFrame:
    """min-max to [0, 1], standardise (population std) or robust (median/IQR)."""
    params = params or scale_params(df, cols, method)
    ex = {}
    for c in cols:
        a, b = params[c]
        ex[c] = (_num(c) - F.lit(a)) / F.lit(b) if a is not None else _num(c)
    return _replace(df, ex)


# -------------------------------------------------------------- discretising
def bin_edges(df: DataFrame, col: str, n_bins: int = 5, strategy: str = "uniform") -> list[float]:
    """Equal-width edges over [min, max], or interpolated quantile edges with
    (near-)duplicate edges merged."""
    if strategy == "uniform":
        st = column_stats(df, [col], ["min", "max"])[col]
        lo, hi = st["min"], st["max"]
        if lo is None:
            return []
        step = (hi - lo) / n_bins
        edges = [i * step + lo for i in range(n_bins)] + [hi]
        return edges
    if strategy == "quantile":
        probs = [i / n_bins for i in range(n_bins + 1)]
        st = column_stats(df, [col], [], probs=probs)[col]
        edges = [st[f"q{p}"] for p in probs]
        if edges[0] is None:
            return []
        keep = [edges[0]]
        for e in edges[1:]:
            if e - keep[-1] > 1e-8:
                keep.append(e)
        return keep
    raise ValueError(f"unknown strategy {strategy}")


def discretise(df: DataFrame, col: str, n_bins: int = 5, strategy: str = "uniform",
               out_col: str | None = None, edges: list[float] | None = None) -> DataFrame:
    """Ordinal bin code 0..bins-1 in ``<col>_binned``; missing stays missing."""
    edges = edges if edges is not None else bin_edges(df, col, n_bins, strategy)
    inner = edges[1:-1]
    x = f"CAST({ident(col)} AS DOUBLE)"
    code = " + ".join([f"CAST({x} >= {dlit(e)} AS INT)" for e in inner] or ["0"])
    return df.withColumn(out_col or f"{col}_binned",
                         F.expr(f"CASE WHEN isnan({x}) OR {x} IS NULL THEN NULL ELSE CAST({code} AS DOUBLE) END"))


# ----------------------------------------------------------------------- PCA
def pca_fit(df: DataFrame, cols: list[str], k: int):
    """Standardise complete rows, fit principal components with MLlib (a
    distributed covariance + a d x d eigen-decomposition), fix signs so each
    component's largest-magnitude loading is positive.

    Returns ``(scale_params, loadings d x k ndarray, explained_variance_ratio)``.
    """
    from pyspark.ml.feature import PCA, VectorAssembler

    complete = df.na.drop(subset=cols)
    params = scale_params(complete, cols, "standard")
    z = scale(complete.select(*cols), cols, "standard", params)
    vec = VectorAssembler(inputCols=cols, outputCol="_x").transform(z).select("_x")
    model = PCA(k=k, inputCol="_x", outputCol="_pc").fit(vec)
    pc = np.array(model.pc.toArray(), copy=True)
    for j in range(pc.shape[1]):
        if pc[np.argmax(np.abs(pc[:, j])), j] < 0:
            pc[:, j] = -pc[:, j]
    return params, pc, list(model.explainedVariance.toArray())


def pca_transform(df: DataFrame, cols: list[str], params: dict, pc, prefix: str = "PC",
                  keep: list[str] | None = None) -> DataFrame:
    """Scores as plain column arithmetic (stays in whole-stage codegen)."""
    z = {c: f"((CAST({ident(c)} AS DOUBLE) - {dlit(params[c][0])}) / {dlit(params[c][1])})" for c in cols}
    scores = []
    for j in range(pc.shape[1]):
        e = " + ".join(f"{z[c]} * {dlit(pc[i, j])}" for i, c in enumerate(cols))
        scores.append(F.expr(e).alias(f"{prefix}{j + 1}"))
    return df.na.drop(subset=cols).select(*(keep or []), *scores)


def pca(df: DataFrame, cols: list[str], k: int = 2, keep: list[str] | None = None) -> DataFrame:
    params, pc, _ = pca_fit(df, cols, k)
    return pca_transform(df, cols, params, pc, keep=keep)


def pca_variance(spark: SparkSession, ratios: list[float]) -> DataFrame:
    """component, explained-variance ratio, cumulative ratio (k rows)."""
    cum = np.cumsum(ratios)
    rows = [(i + 1, float(r), float(c)) for i, (r, c) in enumerate(zip(ratios, cum))]
    return spark.createDataFrame(rows, "component int, ratio double, cumulative double")


# ------------------------------------------------------------------ pipeline
def preprocess(df: DataFrame, cols: list[str] | None = None, impute_strategy: str | None = "mean",
               cap: str | None = None, cap_k: float | None = None, scaler: str | None = None,
               bin_col: str | None = None, n_bins: int = 5, bin_strategy: str = "uniform",
               pca_k: int | None = None, include_binned: bool = True, keep: list[str] | None = None):
    """missing -> outliers -> scale -> bin -> PCA, each step optional.

    Returns ``(DataFrame, steps DataFrame)`` — the log lists what each step did.
    ``keep`` columns (ids) ride along unchanged.
    """
    spark = df.sparkSession
    keep = keep or []
    cols = cols or [c for c in numeric_cols(df) if c not in keep]
    work = df.select(*keep, *cols)
    steps = []
    if impute_strategy:
        n = imputed_count(work, cols, impute_strategy)
        work = impute(work, cols, impute_strategy)
        steps.append(("impute", f"{impute_strategy}: {n} {'rows dropped' if impute_strategy == 'drop' else 'cells filled'}"))
    if cap:
        b = cap_bounds(work, cols, cap, cap_k)
        n = sum(capped_count(work, b).first())
        # later fits read the capped table, not the source and every step again
        work = materialize(cap_outliers(work, cols, bounds=b), "preprocess")
        steps.append(("cap", f"{cap}: {n} cells capped"))
    if scaler:
        work = scale(work, cols, scaler)
        steps.append(("scale", scaler))
    pca_cols = list(cols)
    if bin_col:
        work = discretise(work, bin_col, n_bins, bin_strategy)
        steps.append(("discretise", f"{bin_col}: {n_bins} bins, {bin_strategy}"))
        if include_binned:
            pca_cols.append(f"{bin_col}_binned")
    if pca_k:
        params, pc, ratios = pca_fit(work, pca_cols, pca_k)
        work = pca_transform(work, pca_cols, params, pc, keep=keep)
        steps.append(("pca", f"{pca_k} components, {100 * sum(ratios):.1f}% variance"))
    log = spark.createDataFrame([(i + 1, s, d) for i, (s, d) in enumerate(steps)],
                                "step int, operation string, detail string")
    return work, log
