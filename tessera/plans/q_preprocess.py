"""Preprocessing queries: imputation, capping, scaling, binning, PCA."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import preprocess as PP
from tessera.plans.common import LINEITEM_NULLS_SQL, lineitem_nulls
from tessera.plans.registry import register
from tessera.sources.tables import load

IMP_COLS = ["l_quantity", "l_discount", "l_tax"]


def _impute_sql(strategy):
    if strategy == "drop":
        return f"""WITH t AS ({LINEITEM_NULLS_SQL})
SELECT l_orderkey, l_linenumber, {", ".join(f"round({c}, 6) AS {c}" for c in IMP_COLS)}
FROM t WHERE {" AND ".join(f"{c} IS NOT NULL" for c in IMP_COLS)}"""
    if strategy == "mean":
        fills = {c: f"(SELECT avg({c}) FROM t)" for c in IMP_COLS}
    elif strategy == "median":
        fills = {c: f"(SELECT quantile_cont({c}, 0.5) FROM t)" for c in IMP_COLS}
    else:
        fills = {c: f"""(SELECT v FROM (SELECT {c} AS v, count(*) AS n FROM t WHERE {c} IS NOT NULL
                 GROUP BY 1) ORDER BY n DESC, v LIMIT 1)""" for c in IMP_COLS}
    sel = ", ".join(f"round(coalesce({c}, {fills[c]}), 6) AS {c}" for c in IMP_COLS)
    return f"WITH t AS ({LINEITEM_NULLS_SQL})\nSELECT l_orderkey, l_linenumber, {sel} FROM t"


def _make_impute(strategy):
    @register(f"impute_{'mode' if strategy == 'most_frequent' else strategy}", _impute_sql(strategy))
    def q(spark, sf_dir):
        d = lineitem_nulls(spark, sf_dir).select("l_orderkey", "l_linenumber", *IMP_COLS)
        out = PP.impute(d, IMP_COLS, strategy)
        return out.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in IMP_COLS])
    return q


for _s in ["mean", "median", "most_frequent", "drop"]:
    _make_impute(_s)


@register("cap_iqr", """
WITH s AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT event_id, round(CASE WHEN value < q1 - 1.5 * (q3 - q1) THEN q1 - 1.5 * (q3 - q1)
                            WHEN value > q3 + 1.5 * (q3 - q1) THEN q3 + 1.5 * (q3 - q1)
                            ELSE value END, 6) AS value
FROM events, s""")
def q_cap_iqr(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", "value")
    return PP.cap_outliers(e, ["value"], "iqr", 1.5).select("event_id", F.round("value", 6).alias("value"))


@register("cap_zscore", """
WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS sd FROM events)
SELECT event_id, round(CASE WHEN value < m - 3 * sd THEN m - 3 * sd
                            WHEN value > m + 3 * sd THEN m + 3 * sd ELSE value END, 6) AS value
FROM events, s""")
def q_cap_zscore(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", "value")
    return PP.cap_outliers(e, ["value"], "zscore", 3.0).select("event_id", F.round("value", 6).alias("value"))


SCALE_COLS = ["c_acctbal", "c_nationkey"]
_SCALE_SQL = {
    "minmax": ("min({c})", "CASE WHEN max({c}) - min({c}) = 0 THEN 1 ELSE max({c}) - min({c}) END"),
    "standard": ("avg({c})", "CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END"),
    "robust": ("quantile_cont({c}, 0.5)",
               "CASE WHEN quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) = 0 THEN 1 "
               "ELSE quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) END"),
}


def _scale_sql(method):
    a, b = _SCALE_SQL[method]
    stats = ", ".join(f"{a.format(c=c)} AS a_{c}, {b.format(c=c)} AS b_{c}" for c in SCALE_COLS)
    sel = ", ".join(f"round((CAST({c} AS DOUBLE) - a_{c}) / b_{c}, 6) AS {c}" for c in SCALE_COLS)
    return f"WITH s AS (SELECT {stats} FROM customer)\nSELECT c_custkey, {sel} FROM customer, s"


def _make_scale(method):
    @register(f"scale_{method}", _scale_sql(method))
    def q(spark, sf_dir):
        c = load(spark, sf_dir, "customer").select("c_custkey", *SCALE_COLS)
        out = PP.scale(c, SCALE_COLS, method)
        return out.select("c_custkey", *[F.round(x, 6).alias(x) for x in SCALE_COLS])
    return q


for _m in _SCALE_SQL:
    _make_scale(_m)


@register("bin_uniform", """
WITH s AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)
SELECT p_partkey, CAST((p_retailprice >= 1 * ((hi - lo) / 5) + lo)::INT + (p_retailprice >= 2 * ((hi - lo) / 5) + lo)::INT
       + (p_retailprice >= 3 * ((hi - lo) / 5) + lo)::INT + (p_retailprice >= 4 * ((hi - lo) / 5) + lo)::INT AS DOUBLE)
       AS p_retailprice_binned
FROM part, s""")
def q_bin_uniform(spark, sf_dir):
    p = load(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return PP.discretise(p, "p_retailprice", 5, "uniform").select("p_partkey", "p_retailprice_binned")


@register("bin_quantile", """
WITH s AS (SELECT quantile_cont(p_retailprice, 0.2) AS e1, quantile_cont(p_retailprice, 0.4) AS e2,
                  quantile_cont(p_retailprice, 0.6) AS e3, quantile_cont(p_retailprice, 0.8) AS e4 FROM part)
SELECT p_partkey, CAST((p_retailprice >= e1)::INT + (p_retailprice >= e2)::INT + (p_retailprice >= e3)::INT
       + (p_retailprice >= e4)::INT AS DOUBLE) AS p_retailprice_binned
FROM part, s""")
def q_bin_quantile(spark, sf_dir):
    p = load(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return PP.discretise(p, "p_retailprice", 5, "quantile").select("p_partkey", "p_retailprice_binned")


PCA_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("pca")
def q_pca(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    return PP.pca(li, PCA_COLS, 2, keep=["l_orderkey", "l_linenumber"])


@register("pca_variance")
def q_pca_variance(spark, sf_dir):
    _, _, ratios = PP.pca_fit(load(spark, sf_dir, "lineitem"), PCA_COLS, 3)
    return PP.pca_variance(spark, ratios)


# two standardised columns with correlation r: variances 1 + |r| and 1 - |r|, directions (1, ±1)/sqrt(2)
_TWO = ["l_quantity", "l_extendedprice"]
_TWO_SQL = """WITH st AS (SELECT avg(l_quantity) AS ma, stddev_pop(l_quantity) AS sa, avg(l_extendedprice) AS mb,
                   stddev_pop(l_extendedprice) AS sb, corr(l_quantity, l_extendedprice) AS r FROM lineitem)"""


@register("pca_two", _TWO_SQL + """
SELECT l_orderkey, l_linenumber,
       round(((l_quantity - ma) / sa + sign(r) * (l_extendedprice - mb) / sb) / sqrt(2.0), 4) AS PC1,
       round(abs((l_quantity - ma) / sa - sign(r) * (l_extendedprice - mb) / sb) / sqrt(2.0), 4) AS PC2_size
FROM lineitem, st""")
def q_pca_two(spark, sf_dir):
    """Scores on two columns (the sign of the second component is open)."""
    out = PP.pca(load(spark, sf_dir, "lineitem"), _TWO, 2, keep=["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", F.round("PC1", 4).alias("PC1"), F.round(F.abs("PC2"), 4).alias("PC2_size"))


@register("pca_variance_two", _TWO_SQL + """
SELECT 1 AS component, round((1 + abs(r)) / 2, 6) AS ratio, round((1 + abs(r)) / 2, 6) AS cumulative FROM st
UNION ALL SELECT 2, round((1 - abs(r)) / 2, 6), 1.0 FROM st""")
def q_pca_variance_two(spark, sf_dir):
    _, _, ratios = PP.pca_fit(load(spark, sf_dir, "lineitem"), _TWO, 2)
    v = PP.pca_variance(spark, ratios)
    return v.select("component", F.round("ratio", 6).alias("ratio"), F.round("cumulative", 6).alias("cumulative"))


@register("preprocess_pipeline")
def q_preprocess_pipeline(spark, sf_dir):
    d = lineitem_nulls(spark, sf_dir)
    out, _ = PP.preprocess(d, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"],
                           impute_strategy="median", cap="iqr", scaler="standard",
                           bin_col="l_extendedprice", n_bins=5, pca_k=2)
    return out


_PIPE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _pipeline_sql():
    med = ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in _PIPE)
    imp = ", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in _PIPE)
    qs = ", ".join(f"quantile_cont({c}, 0.25) AS a_{c}, quantile_cont({c}, 0.75) AS b_{c}" for c in _PIPE)
    cap = ", ".join(f"""CASE WHEN {c} < a_{c} - 1.5 * (b_{c} - a_{c}) THEN a_{c} - 1.5 * (b_{c} - a_{c})
        WHEN {c} > b_{c} + 1.5 * (b_{c} - a_{c}) THEN b_{c} + 1.5 * (b_{c} - a_{c}) ELSE {c} END AS {c}""" for c in _PIPE)
    st = ", ".join(f"avg({c}) AS u_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}"
                   for c in _PIPE)
    z = ", ".join(f"({c} - u_{c}) / s_{c} AS {c}" for c in _PIPE)
    code = " + ".join(f"CAST(l_extendedprice >= {i} * ((hi - lo) / 5) + lo AS INT)" for i in range(1, 5))
    out = ", ".join(f"round({c}, 6) AS {c}" for c in _PIPE)
    return f"""WITH t AS ({LINEITEM_NULLS_SQL}),
m AS (SELECT {med} FROM t),
i AS (SELECT l_orderkey, l_linenumber, {imp} FROM t, m),
q AS (SELECT {qs} FROM i),
c AS (SELECT l_orderkey, l_linenumber, {cap} FROM i, q),
s AS (SELECT {st} FROM c),
z AS (SELECT l_orderkey, l_linenumber, {z} FROM c, s),
e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM z)
SELECT l_orderkey, l_linenumber, {out}, CAST({code} AS DOUBLE) AS l_extendedprice_binned FROM z, e"""


@register("preprocess_steps", _pipeline_sql())
def q_preprocess_steps(spark, sf_dir):
    """impute (median) -> cap (IQR) -> standardise -> bin (5, uniform), ids kept."""
    d = lineitem_nulls(spark, sf_dir)
    out, _ = PP.preprocess(d, _PIPE, impute_strategy="median", cap="iqr", scaler="standard",
                           bin_col="l_extendedprice", n_bins=5, keep=["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in _PIPE],
                      "l_extendedprice_binned")
