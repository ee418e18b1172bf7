"""Classification queries: naive Bayes, kNN, one-split trees and grids with SQL
oracles, MLlib models and the model battery."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import classify as C
from tessera.operators import metrics as M
from tessera.operators import trees as T
from tessera.plans.q_retail import CLEAN_SQL, rfm_base_sql, rfm_frame
from tessera.plans.registry import register
from tessera.session import materialize
from tessera.sources.tables import load

NB_FEATS = ["Recency", "Frequency", "AvgOrderValue"]
EMB_DIMS = 64


def rfm_split(spark, sf_dir):
    rfm = rfm_frame(spark, sf_dir)
    d, _ = C.encode_label(rfm, "HighValue")
    return C.train_test_split(d, "CustomerID", 0.25, 42, method="portable")


def nb_predictions(spark, sf_dir):
    d = rfm_split(spark, sf_dir)
    m = C.gaussian_nb_fit(d.where(~F.col("is_test")), NB_FEATS)
    p = C.gaussian_nb_predict(d.where(F.col("is_test")), m)
    # metrics read the predictions several times
    return materialize(p.select("CustomerID", "label", "prediction", F.element_at("probability", 2).alias("score")), "nb")


def _nb_sql(src: str, id_col: str, label_expr: str, feats: list[str], n_classes: int, is_test: str | None = None) -> str:
    is_test = is_test or f"(((CAST({id_col} AS BIGINT) % 2147483647) * 1103515245 + 42) % 2147483648) / 2147483648.0 < 0.25"
    k = len(feats)
    m = ", ".join(f"avg(x{i}) AS m{i}, var_pop(x{i}) + eps AS v{i}" for i in range(k))
    j = " ".join(f"- 0.5 * ln(2 * pi() * v{i}) - (x{i} - m{i}) * (x{i} - m{i}) / (2.0 * v{i})"
                 for i in range(k))
    xs = ", ".join(f"CAST({f} AS DOUBLE) AS x{i}" for i, f in enumerate(feats))
    return f"""
d AS (SELECT {id_col} AS id, CAST({label_expr} AS DOUBLE) AS label, {xs},
             {is_test} AS is_test FROM {src}),
tr AS (SELECT * FROM d WHERE NOT is_test),
ev AS (SELECT 1e-9 * greatest({", ".join(f"var_pop(x{i})" for i in range(k))}) AS eps FROM tr),
cls AS (SELECT label AS c, count(*) * 1.0 / (SELECT count(*) FROM tr) AS prior, {m} FROM tr, ev GROUP BY label, eps),
jl AS (SELECT d.id, d.label, cls.c, ln(prior) {j} AS j FROM d, cls WHERE d.is_test),
mx AS (SELECT id, max(j) AS mj, sum(exp(j - (SELECT max(j) FROM jl x WHERE x.id = jl.id))) AS z FROM jl GROUP BY id),
pred AS (SELECT jl.id, jl.label, min(CASE WHEN jl.j = mx.mj THEN jl.c END) AS prediction,
                max(CASE WHEN jl.c = 1 THEN exp(jl.j - mx.mj) / mx.z END) AS score
         FROM jl JOIN mx ON jl.id = mx.id GROUP BY jl.id, jl.label)"""


NB_CTE = f"WITH r AS ({rfm_base_sql(CLEAN_SQL)}),\n" + _nb_sql("r", "CustomerID", "HighValue", NB_FEATS, 2)


@register("gaussian_nb", NB_CTE + """
SELECT id AS CustomerID, label, prediction, round(score, 6) AS score FROM pred""")
def q_gaussian_nb(spark, sf_dir):
    p = nb_predictions(spark, sf_dir)
    return p.select("CustomerID", "label", "prediction", F.round("score", 6).alias("score"))


@register("confusion", NB_CTE + """,
lab AS (SELECT label AS l FROM pred UNION SELECT prediction FROM pred)
SELECT a.l AS label, b.l AS prediction,
       (SELECT count(*) FROM pred WHERE pred.label = a.l AND pred.prediction = b.l) AS "count"
FROM lab a, lab b""")
def q_confusion(spark, sf_dir):
    return M.confusion(nb_predictions(spark, sf_dir))


_PRF = """,
pc AS (SELECT l AS label,
         (SELECT count(*) FROM pred WHERE pred.label = l) AS support,
         (SELECT count(*) FROM pred WHERE pred.label = l AND pred.prediction = l) AS tp,
         (SELECT count(*) FROM pred WHERE pred.prediction = l) AS predicted
       FROM (SELECT label AS l FROM pred UNION SELECT prediction FROM pred)),
prf AS (SELECT label, support, coalesce(tp * 1.0 / nullif(predicted, 0), 0) AS precision,
               coalesce(tp * 1.0 / nullif(support, 0), 0) AS recall,
               coalesce(2.0 * tp / nullif(predicted + support, 0), 0) AS f1 FROM pc)"""


@register("class_metrics", NB_CTE + _PRF + """
SELECT round((SELECT avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) FROM pred), 6) AS accuracy,
       round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1
FROM prf WHERE label = (SELECT max(label) FROM prf)""")
def q_class_metrics(spark, sf_dir):
    m = M.classification_metrics(nb_predictions(spark, sf_dir))
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


def _report_sql(cte):
    return cte + _PRF + """
SELECT CAST(label AS VARCHAR) AS class, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1, support FROM prf
UNION ALL SELECT 'accuracy', NULL, NULL, round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6),
       count(*) FROM pred
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
       sum(support) FROM prf
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
       round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
       sum(support) FROM prf"""


def _round_report(r):
    return r.select("class", *[F.round(c, 6).alias(c) for c in ["precision", "recall", "f1"]], "support")


@register("class_report", _report_sql(NB_CTE))
def q_class_report(spark, sf_dir):
    return _round_report(M.classification_report(nb_predictions(spark, sf_dir)))


# ROC / AUC run on scores rounded to 6 dp in both engines, so thresholds are
# identical values (probabilities from two engines differ in the last bits)
_ROUNDED = """,
pr AS (SELECT id, label, round(score, 6) AS score FROM pred)"""


@register("roc", NB_CTE + _ROUNDED + """
SELECT 'inf'::DOUBLE AS threshold, 0.0 AS fpr, 0.0 AS tpr
UNION ALL
SELECT DISTINCT score, round(sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) OVER w * 1.0
                        / (SELECT sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) FROM pr), 6),
       round(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) OVER w * 1.0
             / (SELECT sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) FROM pr), 6)
FROM pr WINDOW w AS (ORDER BY score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def q_roc(spark, sf_dir):
    p = nb_predictions(spark, sf_dir).withColumn("score", F.round("score", 6))
    r = M.roc_curve(p, "label", "score", 1.0)
    return r.select("threshold", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@register("auc", NB_CTE + _ROUNDED + """,
pts AS (SELECT DISTINCT score,
          sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) OVER w * 1.0 / (SELECT sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) FROM pr) AS fpr,
          sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) OVER w * 1.0 / (SELECT sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) FROM pr) AS tpr
        FROM pr WINDOW w AS (ORDER BY score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
seg AS (SELECT fpr, tpr, lag(fpr, 1, 0.0) OVER (ORDER BY score DESC) AS f0,
               lag(tpr, 1, 0.0) OVER (ORDER BY score DESC) AS t0 FROM pts)
SELECT round(sum((fpr - f0) * (tpr + t0) / 2), 6) AS auc FROM seg""")
def q_auc(spark, sf_dir):
    p = nb_predictions(spark, sf_dir).withColumn("score", F.round("score", 6))
    a = M.auc_frame(p, "label", "score", 1.0)
    return a.select(F.round("auc", 6).alias("auc"))


@register("class_counts", f"""
SELECT HighValue, count(*) AS "count" FROM ({rfm_base_sql(CLEAN_SQL)}) GROUP BY HighValue""")
def q_class_counts(spark, sf_dir):
    return M.class_counts(rfm_frame(spark, sf_dir), "HighValue")


# ---- multi-class: embeddings (10 labels), all dimensions as features
def emb_frame(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label",
                    *[F.element_at("embedding", i + 1).cast("double").alias(f"e{i}") for i in range(EMB_DIMS)])


EMB_FEATS = [f"e{i}" for i in range(EMB_DIMS)]
EMB_SRC = ("(SELECT vec_id, label, " +
           ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(EMB_DIMS)) +
           " FROM embeddings)")
NB_MULTI_CTE = f"WITH src AS {EMB_SRC},\n" + _nb_sql("src", "vec_id", "label", EMB_FEATS, 10)


def nb_multi_predictions(spark, sf_dir):
    d = C.train_test_split(emb_frame(spark, sf_dir).withColumn("label", F.col("label").cast("double")),
                           "vec_id", 0.25, 42, method="portable")
    m = C.gaussian_nb_fit(d.where(~F.col("is_test")), EMB_FEATS)
    return materialize(C.gaussian_nb_predict(d.where(F.col("is_test")), m).select("vec_id", "label", "prediction"), "nb")


@register("class_report_multi", _report_sql(NB_MULTI_CTE))
def q_class_report_multi(spark, sf_dir):
    return _round_report(M.classification_report(nb_multi_predictions(spark, sf_dir)))


@register("class_metrics_multi", NB_MULTI_CTE + _PRF + """
SELECT round((SELECT avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) FROM pred), 6) AS accuracy,
       round(sum(precision * support) / sum(support), 6) AS precision,
       round(sum(recall * support) / sum(support), 6) AS recall,
       round(sum(f1 * support) / sum(support), 6) AS f1 FROM prf""")
def q_class_metrics_multi(spark, sf_dir):
    m = M.classification_metrics(nb_multi_predictions(spark, sf_dir))
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


# ---- MLlib / iterative models, with the reference's tree, round and sample counts
MODEL_FEATS = ["Recency", "Frequency", "Monetary", "AvgOrderValue"]


def scaled_split(spark, sf_dir):
    """Training and test rows, scaled by the training rows' statistics."""
    from tessera.operators.preprocess import scale
    d = materialize(rfm_split(spark, sf_dir), "split")
    tr, te = d.where(~F.col("is_test")), d.where(F.col("is_test"))
    sp = C.fit_scaler(tr, MODEL_FEATS)
    return scale(tr, MODEL_FEATS, params=sp), scale(te, MODEL_FEATS, params=sp)


def _model_query(kind, params=None):
    @register(f"model_{kind}")
    def q(spark, sf_dir):
        tr, te = scaled_split(spark, sf_dir)
        return C.fit_predict(kind, tr, te, MODEL_FEATS, "label", params, keep=["CustomerID"])[1]
    return q


for _k in ["rf", "gbt", "svm_linear", "ada", "svm_rbf", "svm_poly", "logreg"]:
    _model_query(_k)


_STUMP_SQL = f"""WITH r AS ({rfm_base_sql(CLEAN_SQL)}),
d AS (SELECT CustomerID AS id, HighValue AS y, CAST(Frequency AS DOUBLE) AS x,
             (((CAST(CustomerID AS BIGINT) % 2147483647) * 1103515245 + 42) % 2147483648) / 2147483648.0 < 0.25
             AS is_test FROM r),
tr AS (SELECT x, y FROM d WHERE NOT is_test),
v AS (SELECT x, count(*) AS n, sum(y) AS p FROM tr GROUP BY x),
c AS (SELECT x AS cut, sum(n) OVER (ORDER BY x) AS nl, sum(p) OVER (ORDER BY x) AS pl,
             sum(n) OVER () AS n, sum(p) OVER () AS p FROM v),
g AS (SELECT cut, nl, pl, n, p, nl * (1 - power(pl * 1.0 / nl, 2) - power(1 - pl * 1.0 / nl, 2))
             + (n - nl) * (1 - power((p - pl) * 1.0 / (n - nl), 2) - power(1 - (p - pl) * 1.0 / (n - nl), 2)) AS gini
      FROM c WHERE nl < n),
s AS (SELECT * FROM g ORDER BY gini, cut LIMIT 1)"""


@register("model_stump", _STUMP_SQL + """
SELECT d.id AS CustomerID, CAST(d.y AS DOUBLE) AS label,
       CASE WHEN d.x <= s.cut THEN CASE WHEN 2 * s.pl > s.nl THEN 1.0 ELSE 0.0 END
            ELSE CASE WHEN 2 * (s.p - s.pl) > s.n - s.nl THEN 1.0 ELSE 0.0 END END::DOUBLE AS prediction
FROM d, s WHERE d.is_test""")
def q_model_stump(spark, sf_dir):
    """One split on the number of orders: the best Gini split, found in SQL too."""
    d = rfm_split(spark, sf_dir)
    _, pr = C.fit_predict("dt", d.where(~F.col("is_test")), d.where(F.col("is_test")), ["Frequency"], "label",
                          {"max_depth": 1, "max_bins": 1024}, keep=["CustomerID"])
    return pr.select("CustomerID", "label", "prediction")


@register("logreg_check", f"""WITH r AS ({rfm_base_sql(CLEAN_SQL)})
SELECT count(*) AS "rows", CAST(sum(HighValue) AS BIGINT) AS positives, CAST(0 AS DOUBLE) AS residual,
       CAST(0 AS DOUBLE) AS moment FROM r""")
def q_logreg_check(spark, sf_dir):
    """The score equations of a logistic fit over all customers: residuals sum
    to zero, alone and weighted by each feature (means, 3 dp)."""
    from tessera.operators.preprocess import scale
    feats = ["Recency", "Frequency"]
    d = scale(C.encode_label(rfm_frame(spark, sf_dir), "HighValue")[0], feats, "standard")
    _, pr = C.fit_predict("logreg", d, d, feats, "label", keep=feats)
    e = F.col("score") - F.col("label")
    return pr.agg(F.count(F.lit(1)).alias("rows"), F.sum("label").cast("long").alias("positives"),
                  F.round(F.abs(F.avg(e)), 3).alias("residual"),
                  F.round(F.greatest(*[F.abs(F.avg(e * F.col(f))) for f in feats]), 3).alias("moment"))


@register("split_stratified", f"""WITH r AS ({rfm_base_sql(CLEAN_SQL)}),
h AS (SELECT CustomerID, HighValue, ((CAST(CustomerID AS BIGINT) % 2147483647) * 1103515245 + 42) % 2147483648 AS h FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY HighValue ORDER BY h) AS rk,
             count(*) OVER (PARTITION BY HighValue) AS n FROM h)
SELECT CustomerID, HighValue, rk <= round(n * 0.25) AS is_test FROM k""")
def q_split_stratified(spark, sf_dir):
    d = C.train_test_split(rfm_frame(spark, sf_dir), "CustomerID", 0.25, 42, "portable", stratify="HighValue")
    return d.select("CustomerID", "HighValue", "is_test")


@register("leaderboard")
def q_leaderboard(spark, sf_dir):
    board, _ = C.compare_models(rfm_frame(spark, sf_dir), "CustomerID", NB_FEATS, "HighValue")
    return board


_SPLIT = """row_number() OVER (PARTITION BY HighValue ORDER BY
   ((CAST(CustomerID AS BIGINT) % 2147483647) * 1103515245 + 42) % 2147483648)
   <= round(0.25 * count(*) OVER (PARTITION BY HighValue)) AS is_test"""
_BOARD_CTE = f"""WITH r AS ({rfm_base_sql(CLEAN_SQL)}),
h AS (SELECT *, {_SPLIT} FROM r),
st AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in NB_FEATS)} FROM h WHERE NOT is_test),
z AS (SELECT CustomerID, HighValue, is_test, {", ".join(f"({c} - m_{c}) / s_{c} AS {c}" for c in NB_FEATS)} FROM h, st),
""" + _nb_sql("z", "CustomerID", "HighValue", NB_FEATS, 2, "is_test")
_NB_BOARD = _BOARD_CTE + _PRF + """,
m AS (SELECT round((SELECT avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) FROM pred), 6) AS accuracy,
             round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1
      FROM prf WHERE label = (SELECT max(label) FROM prf))"""


def nb_board(spark, sf_dir):
    """The battery with naive Bayes alone."""
    board, _ = C.compare_models(rfm_frame(spark, sf_dir), "CustomerID", NB_FEATS, "HighValue", models=["nb"],
                                method="portable")
    return board.select("model", *[F.round(c, 6).alias(c) for c in ["accuracy", "precision", "recall", "f1"]])


@register("leaderboard_nb", _NB_BOARD + "\nSELECT 'nb' AS model, accuracy, precision, recall, f1 FROM m")
def q_leaderboard_nb(spark, sf_dir):
    return nb_board(spark, sf_dir)


@register("leaderboard_long", _NB_BOARD + """
SELECT 'nb' AS model, metric, value FROM (UNPIVOT m ON accuracy, precision, recall, f1 INTO NAME metric VALUE value)""")
def q_leaderboard_long(spark, sf_dir):
    from tessera.operators.core import melt
    return melt(nb_board(spark, sf_dir), ["model"], ["accuracy", "precision", "recall", "f1"], "metric", "value")


KNN_FEATS = ["Recency", "Frequency", "AvgOrderValue"]


def _knn_sql(dist: str) -> str:
    """The k nearest training rows by ``dist`` over features scaled by the
    training rows' means and deviations."""
    z = ", ".join(f"({c} - m{i}) / s{i} AS x{i}" for i, c in enumerate(KNN_FEATS))
    st = ", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(KNN_FEATS))
    return f"""
WITH r AS ({rfm_base_sql(CLEAN_SQL)}),
h AS (SELECT *, (((CAST(CustomerID AS BIGINT) % 2147483647) * 1103515245 + 42) % 2147483648) / 2147483648.0 < 0.25
             AS is_test FROM r),
st AS (SELECT {st} FROM h WHERE NOT is_test),
d AS (SELECT CustomerID AS id, CAST(HighValue AS DOUBLE) AS label, {z}, is_test FROM h, st),
pr AS (SELECT te.id, tr.label, tr.id AS tid, {dist} AS dist FROM d te JOIN d tr ON te.is_test AND NOT tr.is_test),
nn AS (SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, tid) AS rn FROM pr) WHERE rn <= 5),
v AS (SELECT id, label, count(*) AS n FROM nn GROUP BY id, label),
b AS (SELECT id, label, n, row_number() OVER (PARTITION BY id ORDER BY n DESC, label) AS rk FROM v)
SELECT b.id AS CustomerID, b.label AS prediction,
       round(coalesce((SELECT n FROM v WHERE v.id = b.id AND v.label = 1), 0) / 5.0, 6) AS score
FROM b WHERE rk = 1"""


def _knn(spark, sf_dir, metric, p=2.0):
    from tessera.operators.knn import knn_classify
    from tessera.operators.preprocess import scale
    d = rfm_split(spark, sf_dir)
    sp = C.fit_scaler(d.where(~F.col("is_test")), KNN_FEATS)
    d = scale(d, KNN_FEATS, params=sp)
    tr, te = d.where(~F.col("is_test")), d.where(F.col("is_test"))
    out = knn_classify(tr, te.select("CustomerID", *KNN_FEATS), "CustomerID", KNN_FEATS, "label", k=5, metric=metric, p=p)
    return out.select("CustomerID", "prediction", F.round("score", 6).alias("score"))


@register("knn_classify", _knn_sql("sqrt(" + " + ".join(f"power(te.x{i} - tr.x{i}, 2)" for i in range(3)) + ")"))
def q_knn_classify(spark, sf_dir):
    return _knn(spark, sf_dir, "euclidean")


@register("knn_manhattan", _knn_sql(" + ".join(f"abs(te.x{i} - tr.x{i})" for i in range(3))))
def q_knn_manhattan(spark, sf_dir):
    return _knn(spark, sf_dir, "manhattan")


@register("knn_minkowski", _knn_sql("power(" + " + ".join(f"power(abs(te.x{i} - tr.x{i}), 3)" for i in range(3)) + ", 1.0 / 3)"))
def q_knn_minkowski(spark, sf_dir):
    return _knn(spark, sf_dir, "minkowski", 3.0)


@register("knn_embeddings", f"""
WITH e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v,
                  (((vec_id % 2147483647) * 1103515245 + 42) % 2147483648) / 2147483648.0 < 0.25 AS is_test FROM embeddings),
pr AS (SELECT te.id, tr.label, tr.id AS tid, list_distance(te.v, tr.v) AS dist FROM e te JOIN e tr ON te.is_test AND NOT tr.is_test),
nn AS (SELECT id, label FROM pr QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, tid) <= 5),
c AS (SELECT id, label, count(*) AS n FROM nn GROUP BY id, label)
SELECT id AS vec_id, CAST(label AS DOUBLE) AS prediction FROM c
QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, label) = 1""")
def q_knn_embeddings(spark, sf_dir):
    """Labels of a quarter of the vectors from their five nearest others, all dimensions as features."""
    from tessera.operators.knn import knn_classify
    feats = [f"e{i}" for i in range(EMB_DIMS)]
    d = C.train_test_split(emb_frame(spark, sf_dir), "vec_id", 0.25, 42, method="portable")
    out = knn_classify(d.where(~F.col("is_test")), d.where(F.col("is_test")).select("vec_id", *feats), "vec_id", feats, "label", k=5)
    return out.select("vec_id", "prediction")


# ---- exact trees: every value of a feature is a candidate cut
TREE_DEPTH = 3


def tree_sql(src: str, id_col: str, feats: list[str], depth: int) -> str:
    """CTEs for a two-class Gini tree over ``src`` (id, y, is_test, features):
    ``tree`` (node, depth, feature, cut, gain, n, p) and ``at`` (id -> leaf)."""
    cols = ", ".join(f"CAST({f} AS DOUBLE) AS x{i}" for i, f in enumerate(feats))
    xs = ", ".join(f"x{i}" for i in range(len(feats)))
    out = f"r0 AS MATERIALIZED (SELECT {id_col} AS id, y, is_test, {cols}, 1::BIGINT AS node FROM {src})"
    for lv in range(depth):
        long = " UNION ALL ".join(f"SELECT node, {i} AS f, x{i} AS v, y FROM r{lv} WHERE NOT is_test" for i in range(len(feats)))
        out += f""",
v{lv} AS (SELECT node, f, v, count(*) AS n, sum(y) AS p FROM ({long}) GROUP BY node, f, v),
c{lv} AS (SELECT node, f, v, lead(v) OVER w AS nxt, sum(n) OVER w AS nl, sum(p) OVER w AS pl,
                 sum(n) OVER (PARTITION BY node, f) AS n, sum(p) OVER (PARTITION BY node, f) AS p
          FROM v{lv} WINDOW w AS (PARTITION BY node, f ORDER BY v)),
g{lv} AS (SELECT *, round((pl * pl + (nl - pl) * (nl - pl))::DOUBLE / nl
                 + ((p - pl) * (p - pl) + (n - nl - p + pl) * (n - nl - p + pl))::DOUBLE / (n - nl)
                 - (p * p + (n - p) * (n - p))::DOUBLE / n, 9) AS gain
          FROM c{lv} WHERE nl < n AND p > 0 AND p < n),
s{lv} AS MATERIALIZED (SELECT node, f, (v + nxt) / 2 AS cut, gain
          FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, v) AS k FROM g{lv}) WHERE k = 1),
r{lv + 1} AS MATERIALIZED (SELECT id, y, is_test, {xs}, CASE WHEN s.node IS NULL THEN r.node
          ELSE 2 * r.node + ([{xs}][s.f + 1] > s.cut)::BIGINT END AS node
          FROM r{lv} r LEFT JOIN s{lv} s ON s.node = r.node)"""
    splits = " UNION ALL ".join(f"SELECT {lv} AS depth, * FROM s{lv}" for lv in range(depth))
    return out + f""",
splits AS (SELECT * FROM ({splits})),
leaves AS (SELECT node, sum(y)::DOUBLE / count(*) AS p1 FROM r{depth} WHERE NOT is_test GROUP BY node)"""


TREE_CTE = f"WITH base AS ({rfm_base_sql(CLEAN_SQL)}),\nsrc AS (SELECT *, HighValue AS y, " \
    "(((CAST(CustomerID AS BIGINT) % 2147483647) * 1103515245 + 42) % 2147483648) / 2147483648.0 < 0.25 AS is_test FROM base),\n" \
    + tree_sql("src", "CustomerID", NB_FEATS, TREE_DEPTH)


def rfm_tree(spark, sf_dir):
    d = materialize(rfm_split(spark, sf_dir), "split")
    return T.tree_fit(d.where(~F.col("is_test")), NB_FEATS, n_classes=2, max_depth=TREE_DEPTH), d


@register("model_dt", TREE_CTE + f"""
SELECT r.id AS CustomerID, r.y::DOUBLE AS label, (l.p1 > 0.5)::INT::DOUBLE AS prediction, l.p1 AS score
FROM r{TREE_DEPTH} r JOIN leaves l USING (node) WHERE r.is_test""")
def q_model_dt(spark, sf_dir):
    """A tree with cuts between any two values, learned on the training rows."""
    model, d = rfm_tree(spark, sf_dir)
    return T.tree_predict(d.where(F.col("is_test")), model) \
        .select("CustomerID", "label", "prediction", F.element_at("probability", 2).alias("score"))


_NAMES = "[" + ", ".join(f"'{f}'" for f in NB_FEATS) + "]"


@register("importances", TREE_CTE + f"""
SELECT {_NAMES}[i + 1] AS feature, coalesce(sum(gain) / (SELECT sum(gain) FROM splits), 0)::DOUBLE AS importance
FROM (SELECT unnest(range({len(NB_FEATS)})) AS i) LEFT JOIN splits ON f = i GROUP BY i""")
def q_importances(spark, sf_dir):
    return T.tree_importances(rfm_tree(spark, sf_dir)[0])


@register("tree_text", TREE_CTE + f""",
nodes AS (SELECT node, depth, f, cut, NULL::DOUBLE AS p1 FROM splits
          UNION ALL SELECT node, length(bin(node)) - 1, NULL, NULL, p1 FROM leaves)
SELECT substr(bin(node), 2) || branch AS place, repeat('|   ', depth) || '|--- ' ||
       CASE branch WHEN 'x' THEN 'class: ' || (p1 > 0.5)::INT ELSE {_NAMES}[f + 1] ||
            CASE branch WHEN '0' THEN ' <= ' ELSE ' > ' END || printf('%.2f', cut) END AS line
FROM (SELECT *, unnest(CASE WHEN f IS NULL THEN ['x'] ELSE ['0', '1'] END) AS branch FROM nodes)""")
def q_tree_text(spark, sf_dir):
    return T.tree_lines(rfm_tree(spark, sf_dir)[0])


@register("model_rf_exact")
def q_model_rf_exact(spark, sf_dir):
    """A forest of exact trees: 20 trees, two of three features tried per node."""
    d = materialize(rfm_split(spark, sf_dir), "split")
    model = T.forest_fit(d.where(~F.col("is_test")), NB_FEATS, n_classes=2, n_trees=20, max_depth=6, per_node=2,
                         row_id="CustomerID")
    return T.tree_predict(d.where(F.col("is_test")), model) \
        .select("CustomerID", "label", "prediction", F.element_at("probability", 2).alias("score"))


_GRID_SQL = f"""WITH r AS ({rfm_base_sql(CLEAN_SQL)}),
h AS (SELECT CAST(HighValue AS DOUBLE) AS label, CAST(Recency AS DOUBLE) AS a, CAST(Frequency AS DOUBLE) AS b,
             (((CAST(CustomerID AS BIGINT) % 2147483647) * 1103515245 + 42) % 2147483648) / 2147483648.0 < 0.25
             AS is_test FROM r),
st AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM h WHERE NOT is_test),
z AS (SELECT label, is_test, (a - ma) / sa AS x0, (b - mb) / sb AS x1 FROM h, st),
ev AS (SELECT 1e-9 * greatest(var_pop(x0), var_pop(x1)) AS eps FROM z WHERE NOT is_test),
cls AS (SELECT label AS c, count(*) * 1.0 / (SELECT count(*) FROM z WHERE NOT is_test) AS prior, avg(x0) AS m0,
               var_pop(x0) + eps AS v0, avg(x1) AS m1, var_pop(x1) + eps AS v1
        FROM z, ev WHERE NOT is_test GROUP BY label, eps),
bo AS (SELECT min(x0) - 1 AS a0, max(x0) + 1 AS a1, min(x1) - 1 AS b0, max(x1) + 1 AS b1 FROM z),
ga AS (SELECT a0 + i * 0.3 AS g0 FROM bo, (SELECT unnest(generate_series(0, 10000)) AS i) WHERE i <= floor((a1 - a0) / 0.3)),
gb AS (SELECT b0 + i * 0.3 AS g1 FROM bo, (SELECT unnest(generate_series(0, 10000)) AS i) WHERE i <= floor((b1 - b0) / 0.3)),
jl AS (SELECT g0, g1, c, ln(prior) - 0.5 * ln(2 * pi() * v0) - power(g0 - m0, 2) / (2 * v0)
              - 0.5 * ln(2 * pi() * v1) - power(g1 - m1, 2) / (2 * v1) AS j FROM ga, gb, cls)
SELECT round(g0, 6) AS Recency, round(g1, 6) AS Frequency, arg_max(c, j) AS prediction FROM jl GROUP BY g0, g1"""


@register("score_grid", _GRID_SQL)
def q_score_grid(spark, sf_dir):
    """Decision surface of naive Bayes over standardised (Recency, Frequency):
    a regular grid with step 0.3 spanning the data with a margin of 1."""
    from tessera.operators.preprocess import scale
    d = rfm_split(spark, sf_dir)
    feats = ["Recency", "Frequency"]
    tr = d.where(~F.col("is_test"))
    sp = C.fit_scaler(tr, feats)
    z = scale(d, feats, params=sp)
    m = C.gaussian_nb_fit(z.where(~F.col("is_test")), feats)
    b = z.agg(F.min("Recency"), F.max("Recency"), F.min("Frequency"), F.max("Frequency")).first()
    bounds = (b[0] - 1.0, b[1] + 1.0, b[2] - 1.0, b[3] + 1.0)
    g = C.score_grid(lambda g: C.gaussian_nb_predict(g, m).drop("probability"), bounds, 0.3,
                     spark=spark, names=("Recency", "Frequency"))
    return g.select(F.round("Recency", 6).alias("Recency"), F.round("Frequency", 6).alias("Frequency"), "prediction")


# ---- softmax boosting over the embeddings, ten classes
BOOST_BINS, BOOST_RATE = 32, 0.1


def _emb_boost(spark, sf_dir, rounds: int, depth: int):
    from tessera.operators.boosting import boost_fit, boost_predict
    d = materialize(C.train_test_split(emb_frame(spark, sf_dir), "vec_id", 0.25, 42, method="portable"), "split")
    m = boost_fit(d.where(~F.col("is_test")), EMB_FEATS, "label", 10, n_estimators=rounds, learning_rate=BOOST_RATE,
                  max_depth=depth, bins=BOOST_BINS)
    return boost_predict(d.where(F.col("is_test")).select("vec_id", "label", *EMB_FEATS), m) \
        .select("vec_id", "label", "prediction", "probability")


@register("gbt_first_round", f"""
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v,
                  (((vec_id % 2147483647) * 1103515245 + 42) % 2147483648) / 2147483648.0 < 0.25 AS is_test FROM embeddings),
k AS (SELECT r.c, count(e.label)::DOUBLE / (SELECT count(*) FROM e WHERE NOT is_test) AS p
      FROM range(10) r(c) LEFT JOIN e ON e.label = r.c AND NOT is_test GROUP BY r.c),
x AS (SELECT label, unnest(range(64)) AS f, unnest(v) AS x FROM e WHERE NOT is_test),
n AS (SELECT f, x, count(*) AS c FROM x GROUP BY f, x),
cum AS (SELECT f, x, c, sum(c) OVER (PARTITION BY f ORDER BY x) AS nl, sum(c) OVER (PARTITION BY f) AS n,
               count(*) OVER (PARTITION BY f) AS d FROM n),
edge AS (SELECT f, x, nl, n FROM cum
         WHERE nl < n AND (d <= {BOOST_BINS} OR (nl * {BOOST_BINS})::BIGINT // n::BIGINT > ((nl - c) * {BOOST_BINS})::BIGINT // n::BIGINT)),
own AS (SELECT edge.f, edge.x, k.c, any_value(edge.nl)::DOUBLE AS nl, any_value(edge.n)::DOUBLE AS n, any_value(k.p) AS p,
               count(*) FILTER (WHERE x.x <= edge.x AND x.label = k.c) AS own_l, count(*) FILTER (WHERE x.label = k.c) AS own
        FROM edge JOIN x USING (f), k GROUP BY edge.f, edge.x, k.c),
g AS (SELECT *, own_l - nl * p AS gl, own - n * p AS g FROM own),
s AS (SELECT * FROM (SELECT *, round(gl * gl / nl + (g - gl) * (g - gl) / (n - nl) - g * g / n, 6) AS gain FROM g) WHERE gain > 0
      QUALIFY row_number() OVER (PARTITION BY c ORDER BY gain DESC, f, x) = 1),
score AS (SELECT e.vec_id, e.label, k.c, ln(least(greatest(k.p, 1.1920928955078125e-07), 1 - 1.1920928955078125e-07))
                 + coalesce({BOOST_RATE} * 0.9 * CASE WHEN e.v[s.f + 1] <= s.x THEN gl / (nl * s.p * (1 - s.p))
                                                 ELSE (g - gl) / ((n - nl) * s.p * (1 - s.p)) END, 0) AS z
          FROM e, k LEFT JOIN s USING (c) WHERE e.is_test),
pr AS (SELECT *, exp(z) / sum(exp(z)) OVER (PARTITION BY vec_id) AS p FROM score)
SELECT vec_id, label, arg_max(c, (round(p, 9), -c))::DOUBLE AS prediction, round(max(p), 6) AS likeliest,
       round(max(p) FILTER (WHERE c = 1), 6) AS p1 FROM pr GROUP BY vec_id, label""")
def q_gbt_first_round(spark, sf_dir):
    """One round of boosting, a cut per class: known in closed form."""
    p = _emb_boost(spark, sf_dir, 1, 1)
    return p.select("vec_id", "label", "prediction", F.round(F.array_max("probability"), 6).alias("likeliest"),
                    F.round(F.get("probability", F.lit(1)), 6).alias("p1"))


@register("model_gbt_multi")
def q_model_gbt_multi(spark, sf_dir):
    """Ten rounds of ten trees over all dimensions; probabilities of all classes."""
    return _emb_boost(spark, sf_dir, 10, 3)
