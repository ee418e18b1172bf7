"""Clustering (K-01..K-08): k-means with restarts, elbow, silhouette,
profiles, counts, comparison; DBSCAN lives in ``tessera.operators.dbscan``.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.beside import beside
from tessera.operators.core import require_rows
from tessera.operators.lloyd import assign, fit_all, silhouettes_squared
from tessera.session import materialize


def _vectors(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="skip").transform(df)


def kmeans(df: DataFrame, cols: list[str], k: int = 3, n_init: int = 10, seed: int = 42, max_iter: int = 300,
           keep: list[str] | None = None, tol: float = 1e-4):
    """Best of ``n_init`` k-means runs by inertia, all runs in the same scans
    (:mod:`tessera.operators.lloyd`).  Returns ``(labelled DataFrame with
    'cluster', inertia, fit)``.  The first column of ``keep`` is the row id that
    the random starts hash; without it the feature values are hashed."""
    keep = keep or []
    rows = df.select(*keep, *cols) if keep else df.select(F.xxhash64(*cols).alias("_row"), *cols)
    data, best, _ = fit_all(rows, (keep or ["_row"])[0], cols, [k], n_init, seed, max_iter, tol)
    if not best:
        return data.drop("_row").withColumn("cluster", F.lit(None).cast("int")), 0.0, None
    return assign(data, cols, best[k]).drop("_row"), best[k].inertia, best[k]


def kmeans_check(labelled: DataFrame, model, cols: list[str]) -> DataFrame:
    """What makes a result a k-means result: rows, clusters, rows that are not
    at their nearest centre, and the largest distance of a centre from the
    mean of its members (6 dp)."""
    centres = [[float(v) for v in c] for c in model.clusterCenters()]
    dist = [reduce(add, [(F.col(c) - F.lit(m)) * (F.col(c) - F.lit(m)) for c, m in zip(cols, centre)]) for centre in centres]
    near = F.array_position(F.array(*dist), F.least(*dist)).cast("int") - 1
    g = labelled.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.count_if(near != F.col("cluster")).alias("far"),
                                        *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(cols)])
    table = F.array(*[F.array(*[F.lit(v) for v in c]) for c in centres])
    off = F.greatest(*[F.abs(F.col(f"_m{i}") - F.element_at(F.element_at(table, F.col("cluster") + 1), i + 1))
                       for i in range(len(cols))])
    return g.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("clusters"), F.sum("far").alias("misplaced"),
                 F.round(F.max(off), 6).alias("drift"))


def silhouette_squared(df: DataFrame, cols: list[str], label: str) -> float:
    """Silhouette with squared Euclidean distance (MLlib evaluator; linear
    time via per-cluster sufficient statistics) over numeric labels.  0 when
    < 2 clusters."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    if df.select(label).distinct().limit(2).count() < 2:
        return 0.0
    v = _vectors(df.select(*cols, F.col(label).cast("double").alias("_l")), cols)
    return ClusteringEvaluator(featuresCol="features", predictionCol="_l",
                               distanceMeasure="squaredEuclidean").evaluate(v)


def silhouette_samples(df: DataFrame, id_col: str, cols: list[str], label: str) -> DataFrame:
    """Per-row silhouette with squared Euclidean distance, in linear time.

    The mean squared distance of a row to a cluster follows from the cluster's
    size, sum and sum of squares, so each row meets one row per cluster and no
    pairs of rows are formed.  A singleton and a single cluster give 0.
    """
    x = [F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)]
    rows = df.select(F.col(id_col).alias("_id"), F.col(label).alias("_lab"), *x).na.drop()
    sq = reduce(add, [F.col(f"_x{i}") * F.col(f"_x{i}") for i in range(len(cols))])
    stats = rows.groupBy("_lab").agg(F.count(F.lit(1)).alias("_n"), F.sum(sq).alias("_psi"),
                                     *[F.sum(f"_x{i}").alias(f"_y{i}") for i in range(len(cols))])
    # arrays of cluster statistics beside every row, any number of clusters
    j = beside(rows, materialize(stats, "clusters"), "_lab", F.col("_id"), "_cl").withColumn("_c", F.explode("_cl")).drop("_cl")
    n = F.col("_c._n")
    dot = reduce(add, [F.col(f"_x{i}") * F.col(f"_c._y{i}") for i in range(len(cols))])
    mean = (n * sq - 2 * dot + F.col("_c._psi")) / n
    own = F.col("_c._lab") == F.col("_lab")
    g = j.groupBy("_id", "_lab").agg(
        F.max(F.when(own, F.when(n == 1, 0.0).otherwise(mean * n / (n - 1)))).alias("a"),
        F.max(F.when(own, n)).alias("size"), F.min(F.when(~own, mean)).alias("b"))
    s = F.when((F.col("size") <= 1) | F.col("b").isNull() | (F.col("a") == F.col("b")), 0.0) \
        .when(F.col("a") < F.col("b"), 1 - F.col("a") / F.col("b")).otherwise(F.col("b") / F.col("a") - 1)
    return g.select(F.col("_id").alias(id_col), F.col("_lab").alias(label), s.alias("silhouette"))


def silhouette(df: DataFrame, id_col: str, cols: list[str], label: str) -> float:
    """Mean squared-Euclidean silhouette; noise (-1) counts as a cluster of its
    own.  0 when there are fewer than two clusters."""
    return silhouette_samples(df, id_col, cols, label).agg(F.avg("silhouette")).first()[0] or 0.0


def elbow(df: DataFrame, cols: list[str], k_max: int = 11, n_init: int = 5, seed: int = 42,
          id_col: str | None = None) -> DataFrame:
    """k = 2..min(k_max, n-1): inertia and (squared) silhouette per k; every k
    and start is fitted in the same scans.  ``id_col`` as in :func:`kmeans`."""
    require_rows(df, 10, "clustering")
    if len(cols) < 2:
        raise ValueError("clustering needs at least two features")
    rows = df.select(id_col, *cols) if id_col else df.select(F.xxhash64(*cols).alias("_row"), *cols)
    ks = list(range(2, min(k_max, rows.na.drop(subset=cols).count() - 1) + 1))
    data, best, stats = fit_all(rows, id_col or "_row", cols, ks, n_init, seed)
    sil = silhouettes_squared(data, cols, best, stats)
    return df.sparkSession.createDataFrame([(k, float(best[k].inertia), float(sil[k])) for k in ks],
                                           "k int, inertia double, silhouette double")


def cluster_profile(df: DataFrame, label: str, cols: list[str], digits: int | None = 2) -> DataFrame:
    """(cluster, feature, mean, std, count) — one partial-aggregated groupBy."""
    long = df.select(F.col(label).alias("cluster"),
                     *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        ["cluster"], cols, "feature", "value")
    g = long.groupBy("cluster", "feature").agg(F.avg("value").alias("mean"),
                                               F.stddev_samp("value").alias("std"),
                                               F.count("value").alias("count"))
    if digits is None:
        return g
    return g.select("cluster", "feature", F.round("mean", digits).alias("mean"),
                    F.round("std", digits).alias("std"), "count")


def cluster_counts(df: DataFrame, label: str) -> DataFrame:
    """clusters (noise -1 excluded), noise points, noise %."""
    return df.agg(F.count_distinct(F.when(F.col(label) != -1, F.col(label))).alias("clusters"),
                  F.count_if(F.col(label) == -1).alias("noise"),
                  F.round(F.avg((F.col(label) == -1).cast("double")) * 100.0, 2).alias("noise_pct"))


def cluster_sizes(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("size"))


def compare_clusterings(spark, results: list[tuple[str, int, float]]) -> DataFrame:
    """(method, clusters, silhouette 4 dp) — one row per method."""
    return spark.createDataFrame([(m, int(c), None if s is None else round(float(s), 4))
                                  for m, c, s in results],
                                 "method string, clusters int, silhouette double")
