"""Clustering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import cluster as K
from tessera.operators.preprocess import scale
from tessera.plans.q_retail import CLEAN_SQL, rfm_base_sql, rfm_frame
from tessera.plans.registry import register
from tessera.sources.tables import load

RFM_FEATS = ["Recency", "Frequency", "Monetary", "AvgOrderValue"]
SIL_COLS = ["c_acctbal", "c_nationkey"]


def rfm_scaled(spark, sf_dir):
    r = rfm_frame(spark, sf_dir)
    return scale(r, RFM_FEATS, "standard")


_RFM_Z = f"""
r AS ({rfm_base_sql(CLEAN_SQL)}),
st AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in RFM_FEATS)} FROM r),
p AS (SELECT CustomerID AS id, {", ".join(f"({c} - m_{c}) / s_{c} AS x{i}" for i, c in enumerate(RFM_FEATS))} FROM r, st)"""


def lloyd_sql(points: str, d: int, ks: list[int], n_init: int, seed: int = 42, tol: float = 1e-4, max_iter: int = 300) -> str:
    """CTEs that replay k-means from the same starts: ``fin`` (k, s, c, centre),
    ``near`` (k, s, id, c, dist, features), ``best`` (k, s, inertia).  ``points`` defines p(id, x0..)."""
    dims = range(d)
    xs = ", ".join(f"x{i}" for i in dims)

    def sq(a, b):
        return " + ".join(f"({a}.x{i} - {b}.x{i}) * ({a}.x{i} - {b}.x{i})" for i in dims)

    seeds = f"d0 AS MATERIALIZED (SELECT s, id, {xs}, CAST(1 AS DOUBLE) AS d2 FROM p, range({n_init}) AS r(s))"
    for t in range(max(ks)):
        u = f"(('0x' || substr(md5('{seed}:' || s || ':{t}:' || id), 1, 13))::BIGINT + 0.5::DOUBLE) / power(2, 52)"
        seen = sq("d", "c") if t == 0 else f"least(d.d2, {sq('d', 'c')})"
        seeds += f""",
s{t} AS MATERIALIZED (SELECT s, {t} AS c, {xs} FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY -ln({u}) / d2, id) AS rk
                                     FROM d{t} WHERE d2 > 0) WHERE rk = 1),
d{t + 1} AS MATERIALIZED (SELECT d.s, d.id, {", ".join(f"d.x{i}" for i in dims)}, {seen} AS d2 FROM d{t} d JOIN s{t} c USING (s))"""
    var = " + ".join(f"var_pop(x{i})" for i in dims)
    return f"""
WITH RECURSIVE {points},
{seeds},
seeds AS ({" UNION ALL ".join(f"SELECT * FROM s{t}" for t in range(max(ks)))}),
lim AS (SELECT {max(tol, 1e-20)!r}::DOUBLE * ({var}) / {d} AS least FROM p),
l AS (SELECT 0 AS it, k, s, c, {xs}, 'inf'::DOUBLE AS shift FROM seeds JOIN (SELECT unnest({ks}) AS k) kk ON c < k
      UNION ALL
      SELECT o.it + 1, o.k, o.s, o.c, {", ".join(f"coalesce(a.x{i}, o.x{i})" for i in dims)},
             sum(coalesce({sq("a", "o")}, 0)) OVER (PARTITION BY o.k, o.s)
      FROM l o LEFT JOIN (
        SELECT k, s, c, {", ".join(f"avg(x{i}) AS x{i}" for i in dims)} FROM (
          SELECT m.k, m.s, p.id, arg_min(m.c, {sq("p", "m")}) AS c, {", ".join(f"any_value(p.x{i}) AS x{i}" for i in dims)}
          FROM l m, p, lim WHERE m.shift > lim.least GROUP BY m.k, m.s, p.id) GROUP BY k, s, c) a
        ON a.k = o.k AND a.s = o.s AND a.c = o.c, lim
      WHERE o.shift > lim.least AND o.it < {max_iter}),
fin AS (SELECT * FROM l QUALIFY it = max(it) OVER (PARTITION BY k, s)),
near AS (SELECT f.k, f.s, p.id, arg_min(f.c, {sq("p", "f")}) AS c, min({sq("p", "f")}) AS dist,
                {", ".join(f"any_value(p.x{i}) AS x{i}" for i in dims)} FROM fin f, p GROUP BY f.k, f.s, p.id),
cost AS (SELECT k, s, sum(dist) AS inertia FROM near GROUP BY k, s),
best AS (SELECT k, min(s) AS s, arg_min(inertia, s) AS inertia FROM cost
         JOIN (SELECT k, min(inertia) AS floor FROM cost GROUP BY k) USING (k)
         WHERE inertia <= floor * (1 + 1e-9) GROUP BY k)"""


@register("kmeans", lloyd_sql(_RFM_Z, 4, [3], 10) + f"""
SELECT id AS CustomerID, {", ".join(f"round(x{i}, 6) AS {c}" for i, c in enumerate(RFM_FEATS))}, c AS cluster
FROM near JOIN best USING (k, s)""")
def q_kmeans(spark, sf_dir):
    lab, _, _ = K.kmeans(rfm_scaled(spark, sf_dir), RFM_FEATS, k=3, n_init=10, keep=["CustomerID"])
    return lab.select("CustomerID", *[F.round(c, 6).alias(c) for c in RFM_FEATS], "cluster")


@register("kmeans_check", f"""
SELECT count(*) AS "rows", CAST(3 AS BIGINT) AS clusters, CAST(0 AS BIGINT) AS misplaced, CAST(0 AS DOUBLE) AS drift
FROM ({rfm_base_sql(CLEAN_SQL)})""")
def q_kmeans_check(spark, sf_dir):
    """A k-means result at rest puts every row at its nearest centre, and every
    centre at the mean of its rows."""
    lab, _, model = K.kmeans(rfm_scaled(spark, sf_dir), RFM_FEATS, k=3, n_init=10, keep=["CustomerID"], tol=0.0)
    return K.kmeans_check(lab, model, RFM_FEATS)


_ELBOW_KS = list(range(2, 12))


@register("elbow", lloyd_sql(_RFM_Z, 4, _ELBOW_KS, 5) + """,
pick AS (SELECT near.* FROM near JOIN best USING (k, s)),
cs AS (SELECT k, c, count(*) AS n, sum(x0) AS y0, sum(x1) AS y1, sum(x2) AS y2, sum(x3) AS y3,
              sum(x0 * x0 + x1 * x1 + x2 * x2 + x3 * x3) AS psi FROM pick GROUP BY k, c),
dm AS (SELECT a.k, a.id, a.c AS own, cs.c AS other, cs.n,
              (cs.n * (x0 * x0 + x1 * x1 + x2 * x2 + x3 * x3) - 2 * (x0 * y0 + x1 * y1 + x2 * y2 + x3 * y3) + psi) / cs.n AS dis
       FROM pick a JOIN cs USING (k)),
ab AS (SELECT k, id, max(CASE WHEN own = other THEN n END) AS size,
              max(CASE WHEN own = other AND n > 1 THEN dis * n / (n - 1) END) AS a,
              min(CASE WHEN own <> other THEN dis END) AS b FROM dm GROUP BY k, id),
sv AS (SELECT k, avg(CASE WHEN size > 1 AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END) AS silhouette
       FROM ab GROUP BY k)
SELECT k, round(inertia, 6) AS inertia, round(silhouette, 6) AS silhouette FROM best JOIN sv USING (k)""")
def q_elbow(spark, sf_dir):
    e = K.elbow(rfm_scaled(spark, sf_dir), RFM_FEATS, k_max=11, n_init=5, id_col="CustomerID")
    return e.select("k", F.round("inertia", 6).alias("inertia"), F.round("silhouette", 6).alias("silhouette"))


_SIL_SQL = """
WITH c AS (SELECT c_custkey AS id, c_mktsegment AS lab, CAST(c_acctbal AS DOUBLE) AS x1,
                  CAST(c_nationkey AS DOUBLE) AS x2 FROM customer),
st AS (SELECT lab, count(*) AS n, sum(x1) AS y1, sum(x2) AS y2, sum(x1 * x1 + x2 * x2) AS psi FROM c GROUP BY lab),
d AS (SELECT c.id, c.lab AS own, st.lab AS other, st.n,
             (st.n * (c.x1 * c.x1 + c.x2 * c.x2) - 2 * (c.x1 * st.y1 + c.x2 * st.y2) + st.psi) / st.n AS dis
      FROM c, st),
ab AS (SELECT id, own AS lab, max(CASE WHEN own = other THEN CASE WHEN n = 1 THEN 0.0 ELSE dis * n / (n - 1) END END) AS a,
              min(CASE WHEN own <> other THEN dis END) AS b FROM d GROUP BY id, own),
sv AS (SELECT id, lab, CASE WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0.0 END AS silhouette FROM ab)
"""


@register("silhouette_samples", _SIL_SQL + """
SELECT id AS c_custkey, lab AS c_mktsegment, round(silhouette, 6) AS silhouette FROM sv""")
def q_silhouette_samples(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    s = K.silhouette_samples(c, "c_custkey", SIL_COLS, "c_mktsegment")
    return s.select("c_custkey", "c_mktsegment", F.round("silhouette", 6).alias("silhouette"))


@register("silhouette", _SIL_SQL + "SELECT round(avg(silhouette), 6) AS silhouette FROM sv")
def q_silhouette(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    v = K.silhouette(c, "c_custkey", SIL_COLS, "c_mktsegment")
    return spark.createDataFrame([(round(v, 6),)], "silhouette double")


@register("silhouette_euclidean", """
WITH c AS (SELECT c_custkey AS id, c_mktsegment AS lab, CAST(c_acctbal AS DOUBLE) AS x1, CAST(c_nationkey AS DOUBLE) AS x2 FROM customer),
d AS (SELECT a.id, a.lab, b.lab AS other, sum(sqrt((a.x1 - b.x1) * (a.x1 - b.x1) + (a.x2 - b.x2) * (a.x2 - b.x2))) AS t, count(*) AS n
      FROM c a, c b GROUP BY a.id, a.lab, b.lab),
ab AS (SELECT id, lab, max(CASE WHEN lab = other THEN n END) AS n, max(CASE WHEN lab = other AND n > 1 THEN t / (n - 1) END) AS a,
              min(CASE WHEN lab <> other THEN t / n END) AS b FROM d GROUP BY id, lab)
SELECT id AS c_custkey, lab AS c_mktsegment,
       round(CASE WHEN n > 1 AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END, 6) AS silhouette FROM ab""")
def q_silhouette_euclidean(spark, sf_dir):
    """Plain Euclidean silhouette per customer; exact while every segment's sample is whole."""
    from tessera.operators.silhouette import silhouette_euclidean
    s, _ = silhouette_euclidean(load(spark, sf_dir, "customer"), "c_custkey", SIL_COLS, "c_mktsegment")
    return s.withColumn("silhouette", F.round("silhouette", 6))


@register("silhouette_sq", """
WITH c AS (SELECT c_custkey AS id, c_mktsegment AS lab, CAST(c_acctbal AS DOUBLE) AS x1,
                  CAST(c_nationkey AS DOUBLE) AS x2 FROM customer),
st AS (SELECT lab, count(*) AS n, sum(x1) AS y1, sum(x2) AS y2, sum(x1 * x1 + x2 * x2) AS psi FROM c GROUP BY lab),
d AS (SELECT c.id, c.lab AS own, st.lab AS other, st.n,
             (st.n * (c.x1 * c.x1 + c.x2 * c.x2) - 2 * (c.x1 * st.y1 + c.x2 * st.y2) + st.psi) / st.n AS dis
      FROM c, st),
ab AS (SELECT id, max(CASE WHEN own = other THEN CASE WHEN n = 1 THEN 0.0 ELSE dis * n / (n - 1) END END) AS a,
              min(CASE WHEN own <> other THEN dis END) AS b FROM d GROUP BY id)
SELECT round(avg(CASE WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0.0 END), 6) AS silhouette FROM ab""")
def q_silhouette_sq(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    codes = c.select("c_mktsegment").distinct().orderBy("c_mktsegment").collect()  # five segments
    code = F.array_position(F.array(*[F.lit(r[0]) for r in codes]), F.col("c_mktsegment"))
    v = K.silhouette_squared(c.withColumn("segment", code), SIL_COLS, "segment")
    return spark.createDataFrame([(round(float(v), 6),)], "silhouette double")


@register("cluster_profile", """
SELECT c_mktsegment AS cluster, feature, round(avg(v), 2) AS mean, round(stddev_samp(v), 2) AS std,
       count(v) AS "count"
FROM (SELECT c_mktsegment, 'c_acctbal' AS feature, CAST(c_acctbal AS DOUBLE) AS v FROM customer
      UNION ALL SELECT c_mktsegment, 'c_nationkey', CAST(c_nationkey AS DOUBLE) FROM customer)
GROUP BY 1, 2""")
def q_cluster_profile(spark, sf_dir):
    return K.cluster_profile(load(spark, sf_dir, "customer"), "c_mktsegment", SIL_COLS)


@register("cluster_counts", """
SELECT count(DISTINCT CASE WHEN l <> -1 THEN l END) AS clusters, count(*) FILTER (WHERE l = -1) AS noise,
       round(avg(CASE WHEN l = -1 THEN 1.0 ELSE 0.0 END) * 100.0, 2) AS noise_pct
FROM (SELECT CASE WHEN c_acctbal < 0 THEN -1 ELSE c_nationkey // 5 END AS l FROM customer)""")
def q_cluster_counts(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    lab = c.select(F.when(F.col("c_acctbal") < 0, F.lit(-1))
                   .otherwise(F.floor(F.col("c_nationkey") / 5)).cast("int").alias("l"))
    return K.cluster_counts(lab, "l")


def _dbscan_sql(points: str, d: int, eps: float, min_samples: int, id_col: str) -> str:
    """Labels spread along links between core points, smaller ids first."""
    dist = " + ".join(f"power(a.x{i} - b.x{i}, 2)" for i in range(d))
    return f"""
WITH RECURSIVE {points},
nb AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.id <> b.id AND {dist} <= {eps * eps}),
core AS (SELECT p.id FROM p LEFT JOIN nb ON p.id = nb.a GROUP BY p.id HAVING count(nb.b) + 1 >= {min_samples}),
ce AS (SELECT a, b FROM nb WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
cc(id, comp) AS (SELECT id, id FROM core UNION SELECT ce.b, cc.comp FROM cc JOIN ce ON cc.id = ce.a WHERE cc.comp < ce.b),
comp AS (SELECT id, min(comp) AS comp FROM cc GROUP BY id),
lab AS (SELECT id, CAST(dense_rank() OVER (ORDER BY comp) - 1 AS INTEGER) AS cluster FROM comp),
border AS (SELECT nb.a AS id, min(lab.cluster) AS cluster FROM nb JOIN lab ON nb.b = lab.id
           WHERE nb.a NOT IN (SELECT id FROM core) GROUP BY nb.a)
SELECT p.id AS {id_col}, CAST(coalesce(lab.cluster, border.cluster, -1) AS INTEGER) AS cluster,
       lab.id IS NOT NULL AS is_core
FROM p LEFT JOIN lab ON p.id = lab.id LEFT JOIN border ON p.id = border.id"""


@register("dbscan", _dbscan_sql(_RFM_Z, 4, 0.5, 5, "CustomerID"))
def q_dbscan(spark, sf_dir):
    from tessera.operators.dbscan import dbscan
    return dbscan(rfm_scaled(spark, sf_dir), "CustomerID", RFM_FEATS, eps=0.5, min_samples=5)


@register("compare_clusterings")
def q_compare_clusterings(spark, sf_dir):
    from tessera.operators.dbscan import dbscan
    z = rfm_scaled(spark, sf_dir)
    km, _, _ = K.kmeans(z, RFM_FEATS, k=3, n_init=10, keep=["CustomerID"])
    db = dbscan(z, "CustomerID", RFM_FEATS, 0.5, 5).join(z, "CustomerID")
    res = []
    for name, d in [("kmeans", km), ("dbscan", db)]:
        n_cl = d.where(F.col("cluster") != -1).select("cluster").distinct().count()
        res.append((name, n_cl, K.silhouette(d, "CustomerID", RFM_FEATS, "cluster")))
    return K.compare_clusterings(spark, res)


@register("cluster_sizes", lloyd_sql(_RFM_Z, 4, [4], 10) + """
SELECT c AS cluster, count(*) AS size FROM near JOIN best USING (k, s) GROUP BY c""")
def q_cluster_sizes(spark, sf_dir):
    lab, _, _ = K.kmeans(rfm_scaled(spark, sf_dir), RFM_FEATS, k=4, n_init=10, keep=["CustomerID"])
    return K.cluster_sizes(lab, "cluster")


# DBSCAN over raw customer features: (account balance, nation key), eps 25
_DB_EPS, _DB_MIN = 25.0, 4
_DBSCAN_SQL = _dbscan_sql("p AS (SELECT c_custkey AS id, CAST(c_acctbal AS DOUBLE) AS x0, "
                          "CAST(c_nationkey AS DOUBLE) AS x1 FROM customer)", 2, _DB_EPS, _DB_MIN, "c_custkey")


@register("dbscan_customer", _DBSCAN_SQL)
def q_dbscan_customer(spark, sf_dir):
    from tessera.operators.dbscan import dbscan
    return dbscan(load(spark, sf_dir, "customer"), "c_custkey", ["c_acctbal", "c_nationkey"],
                  eps=_DB_EPS, min_samples=_DB_MIN)


# single linkage over raw customer features: Prim's tree from the first customer, then Kruskal's merges step by step
_LINK_K = 4
_LINK_SQL = """
WITH RECURSIVE p AS (SELECT c_custkey AS id, CAST(c_acctbal AS DOUBLE) AS x0, CAST(c_nationkey AS DOUBLE) AS x1,
                            row_number() OVER (ORDER BY c_custkey) - 1 AS row FROM customer),
prim AS (
  SELECT 1 AS it, p.row, p.x0, p.x1, o.row AS src, sqrt((p.x0 - o.x0) * (p.x0 - o.x0) + (p.x1 - o.x1) * (p.x1 - o.x1)) AS d
  FROM p JOIN p o ON o.row = 0 AND p.row > 0
  UNION ALL
  SELECT it + 1, row, x0, x1, CASE WHEN nearer THEN k_row ELSE src END, CASE WHEN nearer THEN nd ELSE d END
  FROM (SELECT *, (nd, least(row, k_row), greatest(row, k_row)) < (d, least(row, src), greatest(row, src)) AS nearer
        FROM (SELECT l.*, k.row AS k_row, sqrt((l.x0 - k.x0) * (l.x0 - k.x0) + (l.x1 - k.x1) * (l.x1 - k.x1)) AS nd
              FROM prim l, (SELECT row, x0, x1 FROM prim ORDER BY d, least(row, src), greatest(row, src) LIMIT 1) k
              WHERE l.row <> k.row))),
e AS MATERIALIZED (
  SELECT least(row, src) AS a, greatest(row, src) AS b, d,
         row_number() OVER (ORDER BY d, least(row, src), greatest(row, src)) - 1 AS rk
  FROM (SELECT * FROM prim QUALIFY row_number() OVER (PARTITION BY it ORDER BY d, least(row, src), greatest(row, src)) = 1)),
n AS (SELECT count(*) AS n FROM p),
l AS (
  SELECT CAST(0 AS BIGINT) AS step, row, row AS node FROM p
  UNION ALL
  SELECT l.step + 1, l.row, CASE WHEN l.node IN (x.na, x.nb) THEN n.n + l.step ELSE l.node END
  FROM l, n, (SELECT u.node AS na, w.node AS nb FROM e JOIN l u ON u.row = e.a AND u.step = e.rk JOIN l w ON w.row = e.b) x)
"""


@register("linkage_merges", _LINK_SQL + """,
m AS (SELECT step, node, count(*) AS size FROM l GROUP BY step, node)
SELECT e.rk AS merge, least(u.node, w.node) AS "left", greatest(u.node, w.node) AS "right", round(e.d, 6) AS height, m.size
FROM e, n, l u, l w, m WHERE u.row = e.a AND u.step = e.rk AND w.row = e.b AND w.step = e.rk
  AND m.step = e.rk + 1 AND m.node = n.n + e.rk""")
def q_linkage_merges(spark, sf_dir):
    """The whole single-linkage merge table of the customers."""
    from tessera.operators.linkage import linkage_table, single_linkage
    tree = single_linkage(load(spark, sf_dir, "customer"), "c_custkey", SIL_COLS)
    return linkage_table(tree).withColumn("height", F.round("height", 6))


@register("linkage_labels", _LINK_SQL + f"""
SELECT p.id AS c_custkey, CAST(dense_rank() OVER (ORDER BY f.first) - 1 AS INTEGER) AS cluster
FROM (SELECT row, min(row) OVER (PARTITION BY node) AS first FROM l, n WHERE step = greatest(n.n - {_LINK_K}, 0)) f JOIN p USING (row)""")
def q_linkage_labels(spark, sf_dir):
    """Single-linkage clusters of the customers, numbered by their smallest customer."""
    from tessera.operators.linkage import linkage_labels, single_linkage
    tree = single_linkage(load(spark, sf_dir, "customer"), "c_custkey", SIL_COLS)
    return linkage_labels(tree, _LINK_K).withColumnRenamed("id", "c_custkey")
