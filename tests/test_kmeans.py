import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import cluster as K
from tessera.operators.lloyd import fit_all


def frame(spark, X):
    return spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(X)], "id long, a double, b double")


def test_every_run_rests_at_its_means(spark):
    rng = np.random.default_rng(3)
    X = np.concatenate([rng.normal(c, 0.4, (60, 2)) for c in ((0, 0), (4, 0), (0, 4), (5, 5))])
    data, best, stats = fit_all(frame(spark, X), "id", ["a", "b"], [2, 4], n_init=3, tol=0.0)
    for k, f in best.items():
        D = ((X[:, None] - f.centres[None]) ** 2).sum(-1)
        lab = D.argmin(1)
        assert f.inertia == pytest.approx(D.min(1).sum())
        for c in range(k):
            assert np.allclose(f.centres[c], X[lab == c].mean(0))
            assert stats[k, c][0] == (lab == c).sum()
    # with as many clusters as blobs the best of the starts finds the blobs
    lab, inertia, _ = K.kmeans(frame(spark, X), ["a", "b"], 4, 5, keep=["id"])
    got = {r["id"]: r["cluster"] for r in lab.collect()}
    assert all(len({got[i] for i in range(at, at + 60)}) == 1 for at in range(0, 240, 60))


def test_reruns_agree_whatever_the_partitions(spark):
    rng = np.random.default_rng(4)
    df = frame(spark, rng.normal(0, 1, (300, 2)))
    runs = [fit_all(d, "id", ["a", "b"], [3, 5], n_init=4)[1] for d in (df.coalesce(1), df.repartition(7))]
    for k in (3, 5):
        assert runs[0][k].start == runs[1][k].start
        assert np.allclose(runs[0][k].centres, runs[1][k].centres)


def test_elbow_silhouette_equals_the_samples(spark):
    rng = np.random.default_rng(5)
    X = np.concatenate([rng.normal(c, 0.5, (30, 2)) for c in ((0, 0), (3, 3))])
    df = frame(spark, X)
    e = {r["k"]: r for r in K.elbow(df, ["a", "b"], 4, 3, id_col="id").collect()}
    assert sorted(e) == [2, 3, 4] and e[2]["inertia"] > e[3]["inertia"] > e[4]["inertia"]
    for k in e:
        lab, inertia, _ = K.kmeans(df, ["a", "b"], k, 3, keep=["id"])
        assert inertia == pytest.approx(e[k]["inertia"])
        assert e[k]["silhouette"] == pytest.approx(K.silhouette(lab, "id", ["a", "b"], "cluster"))


def test_degenerate_tables(spark):
    same = spark.range(20).select("id", F.lit(1.0).alias("a"), F.lit(2.0).alias("b"))
    lab, inertia, fit = K.kmeans(same, ["a", "b"], 3, 2, keep=["id"])
    assert inertia == 0 and len(fit.centres) == 1 and lab.select("cluster").distinct().count() == 1
    nulls = same.withColumn("a", F.when(F.col("id") > 2, F.col("id").cast("double")))
    assert K.kmeans(nulls, ["a", "b"], 2, 2, keep=["id"])[0].count() == 17
    lab, inertia, fit = K.kmeans(same.limit(0), ["a", "b"], 2, 2, keep=["id"])
    assert lab.count() == 0 and fit is None and lab.columns[-1] == "cluster"
    assert K.kmeans(same, ["a", "b"], 2, 2)[0].columns == ["a", "b", "cluster"]


def test_scan_measures_distances_in_the_last_scan_only(spark):
    """Runs of several sizes in one scan: counts and sums as by hand, squared distances once asked for."""
    import numpy as np

    from tessera.operators.lloyd import Fit, _scan
    rng = np.random.default_rng(6)
    X = rng.normal(0, 1, (3000, 2))
    data = spark.createDataFrame([tuple(map(float, r)) for r in X], "a double, b double")
    fits = [Fit(k, s, rng.normal(0, 1, (k, 2))) for k in (2, 3) for s in range(2)] + [Fit(2, 2, rng.normal(0, 1, (2, 2)))]
    plain, last = _scan(data, ["a", "b"], fits), _scan(data, ["a", "b"], fits, last=True)
    assert plain.keys() == last.keys()
    for i, f in enumerate(fits):
        d2 = ((X[:, None] - f.centres[None]) ** 2).sum(-1)
        for c in range(f.k):
            mine = d2.argmin(axis=1) == c
            for got, near, sq in ((plain, 0, 0), (last, d2[mine, c].sum(), (X[mine] ** 2).sum())):
                n, dist, sums, squares = got.get((i, c), (0, 0, np.zeros(2), 0))
                assert np.allclose([n, dist, squares, *sums], [mine.sum(), near, sq, *X[mine].sum(axis=0)])
