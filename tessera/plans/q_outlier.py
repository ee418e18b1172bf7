"""Outlier queries over the customer RFM features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import outlier as O
from tessera.plans.q_retail import CLEAN_SQL, rfm_base_sql, rfm_frame
from tessera.plans.registry import register

FEATS = ["Recency", "Frequency", "Monetary", "AvgOrderValue"]

_FLAGS_SQL = f"""
WITH r AS ({rfm_base_sql(CLEAN_SQL)}),
st AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}, quantile_cont({c}, 0.25) AS a_{c}, quantile_cont({c}, 0.75) AS b_{c}" for c in FEATS)} FROM r),
f AS (SELECT CustomerID, {", ".join(FEATS)},
        CAST(({" OR ".join(f"abs({c} - m_{c}) > 3 * s_{c}" for c in FEATS)}) AS INTEGER) AS zscore,
        CAST(({" OR ".join(f"{c} < a_{c} - 1.5 * (b_{c} - a_{c}) OR {c} > b_{c} + 1.5 * (b_{c} - a_{c})" for c in FEATS)}) AS INTEGER) AS iqr
      FROM r, st)
"""


def flags_frame(spark, sf_dir):
    rfm = rfm_frame(spark, sf_dir)
    return rfm, O.outlier_flags(rfm, "CustomerID", FEATS, zscore=3.0, iqr=1.5)


@register("outlier_flags", _FLAGS_SQL + "SELECT CustomerID, zscore, iqr, zscore + iqr AS total_methods FROM f")
def q_outlier_flags(spark, sf_dir):
    return flags_frame(spark, sf_dir)[1]


@register("outlier_summary", _FLAGS_SQL + """
SELECT 'zscore' AS method, CAST(sum(zscore) AS BIGINT) AS outliers, round(sum(zscore) * 100.0 / count(*), 2) AS pct FROM f
UNION ALL
SELECT 'iqr', CAST(sum(iqr) AS BIGINT), round(sum(iqr) * 100.0 / count(*), 2) FROM f""")
def q_outlier_summary(spark, sf_dir):
    return O.outlier_summary(flags_frame(spark, sf_dir)[1], ["zscore", "iqr"])


@register("agreement_counts", _FLAGS_SQL + """
SELECT zscore + iqr AS total_methods, count(*) AS "rows" FROM f GROUP BY 1""")
def q_agreement_counts(spark, sf_dir):
    return O.agreement_counts(flags_frame(spark, sf_dir)[1])


@register("consensus", _FLAGS_SQL + """
SELECT CAST(sum(CASE WHEN zscore + iqr >= 2 THEN 1 ELSE 0 END) AS BIGINT) AS outliers,
       round(avg(CASE WHEN zscore + iqr >= 2 THEN 1 ELSE 0 END) * 100.0, 2) AS pct FROM f""")
def q_consensus(spark, sf_dir):
    return O.consensus_summary(flags_frame(spark, sf_dir)[1], 2)


@register("drop_clean", _FLAGS_SQL + """
SELECT CustomerID, Recency, Frequency, round(Monetary, 6) AS Monetary FROM f WHERE zscore + iqr < 2""")
def q_drop_clean(spark, sf_dir):
    rfm, flags = flags_frame(spark, sf_dir)
    kept = O.drop_outliers(rfm, flags, "CustomerID", 2)
    return kept.select("CustomerID", "Recency", "Frequency", F.round("Monetary", 6).alias("Monetary"))


def _impact_sql():
    parts = []
    for scope, cond in [("all", "TRUE"), ("cleaned", "zscore + iqr < 2")]:
        for c in FEATS:
            parts.append(f"""SELECT '{c}' AS "column", count({c}) AS "count", round(avg({c}), 6) AS mean,
  round(stddev_samp({c}), 6) AS std, round(min({c}) + 0.0, 6) AS "min", round(quantile_cont({c}, 0.25), 6) AS p25,
  round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75,
  round(max({c}) + 0.0, 6) AS "max", '{scope}' AS scope FROM f WHERE {cond}""")
    return _FLAGS_SQL + "\nUNION ALL\n".join(parts)


@register("impact", _impact_sql())
def q_impact(spark, sf_dir):
    rfm, flags = flags_frame(spark, sf_dir)
    return O.impact(rfm, flags, "CustomerID", FEATS, 2, digits=6)


# ---- neighbour / tree based detectors, on standardised features
_Z_SQL = f"""
WITH r AS ({rfm_base_sql(CLEAN_SQL)}),
st AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in FEATS)} FROM r),
p AS (SELECT CustomerID AS id, {", ".join(f"({c} - m_{c}) / s_{c} AS x{i}" for i, c in enumerate(FEATS))} FROM r, st)"""


def rfm_standard(spark, sf_dir):
    from tessera.operators.preprocess import scale
    return scale(rfm_frame(spark, sf_dir), FEATS, "standard")


@register("outlier_lof", _Z_SQL + f""",
d AS (SELECT a.id AS a, b.id AS b, sqrt({" + ".join(f"power(a.x{i} - b.x{i}, 2)" for i in range(len(FEATS)))}) AS dist
      FROM p a JOIN p b ON a.id <> b.id),
nn AS (SELECT a, b, dist FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY dist, b) AS rn FROM d) WHERE rn <= 20),
kd AS (SELECT a, max(dist) AS kdist FROM nn GROUP BY a),
lrd AS (SELECT nn.a, 1.0 / (avg(greatest(kd.kdist, nn.dist)) + 1e-10) AS lrd FROM nn JOIN kd ON nn.b = kd.a GROUP BY nn.a),
lf AS (SELECT nn.a, avg(lb.lrd) / la.lrd AS lof FROM nn JOIN lrd lb ON nn.b = lb.a JOIN lrd la ON nn.a = la.a
       GROUP BY nn.a, la.lrd)
SELECT a AS CustomerID, round(lof, 6) AS lof, CAST(lof > 1.5 AS INTEGER) AS lof_flag FROM lf""")
def q_outlier_lof(spark, sf_dir):
    from tessera.operators.knn import outlier_lof
    o = outlier_lof(rfm_standard(spark, sf_dir), "CustomerID", FEATS, k=20)
    return o.select("CustomerID", F.round("lof", 6).alias("lof"), "lof_flag")


@register("lof_embeddings", """
WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT a.id AS a, b.id AS b, list_distance(a.v, b.v) AS dist FROM e a JOIN e b ON a.id <> b.id),
nn AS (SELECT a, b, dist FROM d QUALIFY row_number() OVER (PARTITION BY a ORDER BY dist, b) <= 20),
kd AS (SELECT a, max(dist) AS kdist FROM nn GROUP BY a),
lrd AS (SELECT nn.a, 1.0 / (avg(greatest(kd.kdist, nn.dist)) + 1e-10) AS lrd FROM nn JOIN kd ON nn.b = kd.a GROUP BY nn.a)
SELECT nn.a AS vec_id, round(avg(lb.lrd) / any_value(la.lrd), 6) AS lof
FROM nn JOIN lrd lb ON nn.b = lb.a JOIN lrd la ON nn.a = la.a GROUP BY nn.a""")
def q_lof_embeddings(spark, sf_dir):
    """Local outlier factor over all dimensions of the embeddings."""
    from tessera.operators.knn import lof_scores
    from tessera.plans.q_classify import EMB_DIMS, emb_frame
    s = lof_scores(emb_frame(spark, sf_dir), "vec_id", [f"e{i}" for i in range(EMB_DIMS)], k=20)
    return s.select("vec_id", F.round("lof", 6).alias("lof"))


@register("outlier_iforest")
def q_outlier_iforest(spark, sf_dir):
    from tessera.operators.iforest import outlier_iforest
    return outlier_iforest(rfm_standard(spark, sf_dir), "CustomerID", FEATS, contamination=0.05, n_trees=100)


@register("iforest_check", f"""
SELECT count(*) AS "rows", CAST(count(*) - 1 - floor(0.95 * (count(*) - 1)) AS BIGINT) AS most_flagged,
       true AS within, true AS in_range FROM ({rfm_base_sql(CLEAN_SQL)})""")
def q_iforest_check(spark, sf_dir):
    """Rows, how many may lie above the interpolated 95 % quantile, whether no
    more are flagged and whether all scores lie in (0, 1)."""
    from tessera.operators.iforest import outlier_iforest
    o = outlier_iforest(rfm_standard(spark, sf_dir), "CustomerID", FEATS, contamination=0.05, n_trees=100)
    n = F.count(F.lit(1))
    most = n - 1 - F.floor(0.95 * (n - 1))
    return o.agg(n.alias("rows"), most.cast("long").alias("most_flagged"),
                 ((F.sum("iforest") <= most) & (F.sum("iforest") > 0)).alias("within"),
                 F.every((F.col("score") > 0) & (F.col("score") < 1)).alias("in_range"))


@register("outlier_battery")
def q_outlier_battery(spark, sf_dir):
    """All four detectors as columns of one frame, plus the agreement count."""
    from tessera.operators.iforest import outlier_iforest
    from tessera.operators.knn import outlier_lof
    from tessera.operators.preprocess import scale
    rfm = rfm_frame(spark, sf_dir)
    z = scale(rfm, FEATS, "standard")
    lof = outlier_lof(z, "CustomerID", FEATS, k=20).select("CustomerID", "lof_flag")
    ifo = outlier_iforest(z, "CustomerID", FEATS, 0.05, n_trees=100).select("CustomerID", "iforest")
    return O.outlier_flags(rfm, "CustomerID", FEATS, extra={"lof": lof, "iforest": ifo})
