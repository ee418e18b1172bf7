import numpy as np
import pytest

from tessera.operators.silhouette import silhouette_euclidean


def brute(X, lab):
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    out = np.zeros(len(X))
    for i in range(len(X)):
        own = lab == lab[i]
        if own.sum() > 1:
            a, b = D[i, own].sum() / (own.sum() - 1), min(D[i, lab == o].mean() for o in set(lab.tolist()) - {lab[i]})
            out[i] = (b - a) / max(a, b) if max(a, b) > 0 else 0
    return out


def test_whole_and_sampled_clusters(spark):
    rng = np.random.default_rng(1)
    X = np.concatenate([rng.normal(0, 1, (400, 2)), rng.normal(3, 2, (300, 2)), [[50.0, 50.0]], np.zeros((40, 2))])
    lab = np.array([0] * 400 + [1] * 300 + [2] + [3] * 40)
    df = spark.createDataFrame([(i, *map(float, x), f"c{c}") for i, (x, c) in enumerate(zip(X, lab))], "id long, a double, b double, l string")
    want = brute(X, lab)
    for m, limit in ((4096, 0.0), (100, 0.2)):
        s, bound = silhouette_euclidean(df, "id", ["a", "b"], "l", m)
        got = {r["id"]: r["silhouette"] for r in s.collect()}
        assert bound == pytest.approx(limit) and len(got) == len(X)
        err = np.array([got[i] - want[i] for i in range(len(X))])
        # silhouettes inherit at most twice the relative error of the mean distances
        assert np.sqrt((err ** 2).mean()) <= 2 * bound + 1e-9
        assert got[700] == 0


def test_one_cluster_and_empty(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, "a"), (2, 2.0, 2.0, "a"), (3, None, 2.0, "b"), (4, 1.0, 1.0, None)],
                               "id long, a double, b double, l string")
    assert [r["silhouette"] for r in silhouette_euclidean(df, "id", ["a", "b"], "l")[0].collect()] == [0.0, 0.0]
    assert silhouette_euclidean(df.limit(0), "id", ["a", "b"], "l")[0].count() == 0
