import numpy as np
import pytest

from tessera.operators.dbscan import dbscan
from tessera.operators.iforest import outlier_iforest
from tessera.operators.knn import knn_classify, lof_scores
from tessera.operators.neighbors import pairwise_distance
from shapes import SHAPES


def brute_dbscan(X, eps, ms):
    n = len(X)
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    nb = [np.flatnonzero(D[i] <= eps) for i in range(n)]
    core = np.array([len(x) >= ms for x in nb])
    lab = -np.ones(n, int)
    c = 0
    for i in range(n):
        if lab[i] != -1 or not core[i]:
            continue
        lab[i] = c
        st = [i]
        while st:
            p = st.pop()
            for q in nb[p]:
                if lab[q] == -1:
                    lab[q] = c
                    if core[q]:
                        st.append(q)
        c += 1
    return lab


def frame(spark, X):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(X)], "id long, x double, y double")


def test_dbscan_matches_bruteforce(spark):
    rng = np.random.default_rng(5)
    X = np.concatenate([rng.normal(0, .3, (150, 2)), rng.normal(3, .3, (150, 2)), rng.uniform(-2, 5, (30, 2))])
    X = np.concatenate([X, X[:20]])  # duplicated rows
    got = {r["id"]: r["cluster"] for r in dbscan(frame(spark, X), "id", ["x", "y"], 0.3, 6).collect()}
    ref = brute_dbscan(X, 0.3, 6)
    assert [got[i] for i in range(len(X))] == list(ref)


def test_lof_matches_bruteforce(spark):
    rng = np.random.default_rng(7)
    X = np.concatenate([rng.normal(0, 1, (200, 2)), [[8, 8], [-6, 5]]])
    n, k = len(X), 8
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    np.fill_diagonal(D, np.inf)
    idx = np.argsort(D, axis=1, kind="stable")[:, :k]
    dk = D[np.arange(n), idx[:, -1]]
    reach = np.maximum(D[np.arange(n)[:, None], idx], dk[idx])
    lrd = 1 / (reach.mean(1) + 1e-10)
    lof = lrd[idx].mean(1) / lrd
    got = {r["id"]: r["lof"] for r in lof_scores(frame(spark, X), "id", ["x", "y"], k).collect()}
    assert max(abs(got[i] - lof[i]) for i in range(n)) < 1e-9


def test_knn_classifier_and_moons_vs_kmeans(spark):
    from tessera.operators.cluster import kmeans
    moons = SHAPES["moons"](spark, 400, 0.05, 1)
    tr = moons.where("id % 3 != 0")
    te = moons.where("id % 3 = 0").select("id", "f1", "f2")
    p = knn_classify(tr, te, "id", ["f1", "f2"], "label", 5).join(moons, "id").toPandas()
    assert (p["prediction"] == p["label"]).mean() > 0.95
    db = dbscan(moons, "id", ["f1", "f2"], 0.2, 5).join(moons, "id").toPandas()
    assert db.groupby("label")["cluster"].nunique().max() == 1 and db["cluster"].nunique() >= 2
    km, _, _ = kmeans(moons, ["f1", "f2"], 2, 2, keep=["id", "label"])
    k = km.toPandas()
    assert k.groupby("label")["cluster"].nunique().max() == 2  # k-means cuts the moons


def test_iforest_ranks_planted(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(0, 1, (1000, 2))
    X[:10] += 9
    r = outlier_iforest(frame(spark, X), "id", ["x", "y"], 0.01, n_trees=50).toPandas()
    top = set(r.sort_values("score", ascending=False).head(10)["id"])
    assert len(top & set(range(10))) >= 9


def test_pairwise_distance_blocks(spark):
    rng = np.random.default_rng(1)
    X = rng.normal(0, 1, (60, 2))
    d1 = {(r["id_a"], r["id_b"]): r["dist"] for r in pairwise_distance(frame(spark, X), "id", ["x", "y"], n=60).collect()}
    assert len(d1) == 60 * 59 // 2
    assert d1[(0, 1)] == pytest.approx(np.linalg.norm(X[0] - X[1]))


@pytest.mark.parametrize("d", [1, 3, 4])
def test_dbscan_tight_cluster_dims(spark, d):
    rng = np.random.default_rng(9)
    X = np.round(np.concatenate([rng.normal(0, 0.02, (200, d)), rng.normal(1, 0.3, (100, d)),
                                 rng.uniform(-2, 3, (30, d))]), 3)
    cols = [f"c{i}" for i in range(d)]
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(X)],
                               "id long, " + ", ".join(f"{c} double" for c in cols))
    got = {r["id"]: r["cluster"] for r in dbscan(df, "id", cols, 0.2, 6).collect()}
    assert [got[i] for i in range(len(X))] == list(brute_dbscan(X, 0.2, 6))


def _knn_brute(X, Q, k, metric, p=3.0):
    diff = np.abs(Q[:, None] - X[None])
    D = {"euclidean": lambda: np.sqrt((diff ** 2).sum(-1)), "manhattan": lambda: diff.sum(-1),
         "minkowski": lambda: (diff ** p).sum(-1) ** (1 / p), "chebyshev": lambda: diff.max(-1)}[metric]()
    return np.sort(D, axis=1)[:, :k]


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "minkowski", "chebyshev"])
def test_knn_binary_features_first_and_small_leaves(spark, metric):
    """Three 0/1 features before the one that varies, repeated rows, text ids,
    leaves of ten points and one query far outside."""
    from tessera.operators.knn import knn, vertices
    rng = np.random.default_rng(2)
    X = np.column_stack([rng.integers(0, 2, (600, 3)), np.round(rng.normal(0, 1, 600), 2)]).astype(float)
    Q = np.concatenate([X[:40] + 0.01, [[50.0, 0, 0, 0]]])
    cols = ["a1", "a2", "a3", "a4"]
    schema = "id string, a1 double, a2 double, a3 double, a4 double"
    frame4 = lambda M, tag: spark.createDataFrame([(f"{tag}{i}", *map(float, r)) for i, r in enumerate(M)], schema)
    v, _ = vertices(frame4(X, "b"), "id", cols)
    q, qmap = vertices(frame4(Q, "q"), "id", cols)
    got = {}
    ids = dict(map(tuple, qmap.select("_id", "vid").collect()))
    for r in knn(q, v, cols, 7, False, metric, 3.0, leaf=10).collect():
        got.setdefault(r["a"], []).extend([r["dist"]] * r["used"])
    want = _knn_brute(X, Q, 7, metric)
    for i in range(len(Q)):
        assert sorted(got[ids[f"q{i}"]]) == pytest.approx(want[i], abs=1e-12)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "minkowski", "chebyshev"])
@pytest.mark.parametrize("way", ["blocks", "leaves", None])
def test_knn_many_features(spark, metric, way, monkeypatch):
    """Twelve features far from the origin, repeated rows, blocks of 25 rows merged four at a time."""
    from tessera.operators import knn as M
    monkeypatch.setattr(M, "VALUES", 300)
    monkeypatch.setattr(M, "MERGE", 4)
    rng = np.random.default_rng(8)
    cols = [f"c{i}" for i in range(12)]
    X = rng.normal(1e4, 1, (250, 12))
    X[200:] = X[:50]
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(X)], "id long, " + ", ".join(f"{c} double" for c in cols))
    v, rowmap = M.vertices(df, "id", cols)
    ids = dict(map(tuple, rowmap.select("_id", "vid").collect()))
    got = {}
    for r in M.knn(v, v, cols, 9, True, metric, 3.0, leaf=20, way=way).collect():
        got.setdefault(r["a"], []).extend([r["dist"]] * r["used"])
    want = _knn_brute(X, X, 10, metric)
    for i in range(len(X)):
        assert sorted(got[ids[i]]) == pytest.approx(want[i][1:], abs=1e-9)


def test_knn_fewer_points_than_k(spark):
    from tessera.operators.knn import lof_scores
    assert lof_scores(frame(spark, np.array([[0.0, 0], [1, 1], [2, 5]])), "id", ["x", "y"], 20).count() == 3


def test_dbscan_dense_region_stays_linear(spark):
    """One region within eps: text ids, all in a few cells, no pair tables."""
    rng = np.random.default_rng(3)
    X = rng.normal(0, 0.01, (5000, 4))
    cols = [f"c{i}" for i in range(4)]
    df = spark.createDataFrame([(f"p{i:05d}", *map(float, x)) for i, x in enumerate(X)],
                               "id string, " + ", ".join(f"{c} double" for c in cols))
    out = dbscan(df, "id", cols, 0.5, 5)
    assert [(r["cluster"], r["count"]) for r in out.groupBy("cluster").count().collect()] == [(0, 5000)]


def test_dbscan_two_hot_cells_apart(spark):
    """Adjacent cells with several blocks each: joined by one close pair only."""
    rng = np.random.default_rng(4)
    A, B = rng.uniform(0, 0.1, (2500, 2)), rng.uniform(0, 0.1, (2500, 2)) + [0.55, 0]
    far = dbscan(frame(spark, np.concatenate([A, B])), "id", ["x", "y"], 0.4, 5)
    assert far.select("cluster").distinct().count() == 2
    bridge = np.concatenate([A, B, [[0.3, 0.05]] * 5])
    assert dbscan(frame(spark, bridge), "id", ["x", "y"], 0.4, 5).select("cluster").distinct().count() == 1


def test_big_ids_keep_apart(spark):
    big = 1 << 53
    df = spark.createDataFrame([(big + i, float(i // 3 * 10), 0.0) for i in range(9)], "id long, x double, y double")
    got = {r["id"] - big: r["cluster"] for r in dbscan(df, "id", ["x", "y"], 0.5, 3).collect()}
    assert got == {i: i // 3 for i in range(9)}


def test_knn_blocks_move_linear_rows(spark, monkeypatch):
    """However small the pieces, a build row moves once per query block and no task hands on more than k candidates a query."""
    from tessera.operators import knn as M
    monkeypatch.setattr(M, "PIECE", 60)
    monkeypatch.setattr(M, "MERGE", 2)
    moved = []
    real = M._streamed
    monkeypatch.setattr(M, "_streamed", lambda q, b, cols, blocks, *a: moved.append((blocks, real(q, b, cols, blocks, *a).count())) or real(q, b, cols, blocks, *a))
    rng = np.random.default_rng(5)
    cols = [f"c{i}" for i in range(6)]
    X = np.round(rng.normal(0, 1, (600, 6)), 1)
    X[500:] = X[0]  # a vertex that fills all neighbours
    df = spark.createDataFrame([(f"v{i}", *map(float, x)) for i, x in enumerate(X)], "id string, " + ", ".join(f"{c} double" for c in cols))
    v, rowmap = M.vertices(df, "id", cols)
    ids = dict(map(tuple, rowmap.select("_id", "vid").collect()))
    got = {}
    for r in M.knn(v, v, cols, 5, True, leaf=50, way="blocks").collect():
        got.setdefault(r["a"], []).extend([r["dist"]] * r["used"])
    want = _knn_brute(X, X, 6, "euclidean")
    for i in range(len(X)):
        assert sorted(got[ids[f"v{i}"]]) == pytest.approx(want[i][1:], abs=1e-9)
    assert moved[0][0] <= 2 * spark.sparkContext.defaultParallelism and moved[0][1] <= 5 * len(X)


def test_dbscan_meets_blocks_in_place(spark, monkeypatch):
    """Crowded neighbouring cells, text ids: blocks travel as flat lists, and labels are those of all pairs."""
    from tessera.operators import dbscan as M
    monkeypatch.setattr(M, "BLOCK", 40)
    kinds = []
    real = M._meet
    monkeypatch.setattr(M, "_meet", lambda left, right, *a, **k: kinds.extend(
        b.schema["xs"].dataType.simpleString() for b in (left, right)) or real(left, right, *a, **k))
    rng = np.random.default_rng(12)
    X = np.round(np.concatenate([rng.uniform(0, .3, (150, 2)), rng.uniform(0, .3, (150, 2)) + [.42, 0], rng.uniform(-2, 3, (60, 2))]), 3)
    df = spark.createDataFrame([(f"p{i:03d}", *map(float, x)) for i, x in enumerate(X)], "id string, x double, y double")
    got = {r["id"]: r["cluster"] for r in M.dbscan(df, "id", ["x", "y"], 0.2, 6).collect()}
    assert [got[f"p{i:03d}"] for i in range(len(X))] == list(brute_dbscan(X, 0.2, 6))
    assert kinds and set(kinds) == {"array<double>"}


def test_iforest_scores_follow_the_trees(spark):
    """Scores are the mean depth of each row's leaf with its size's share, walked one by one."""
    from tessera.operators import iforest as M
    X = np.random.default_rng(4).normal(0, 1, (300, 2))
    df = frame(spark, X)
    forest = M.fit(df, "id", ["x", "y"], 7, 64)
    for r in M.score(df, forest, ["x", "y"], ["id"]).collect():
        total = 0.0
        for _, g in forest.groupby("tree"):
            t, node, depth = g.set_index("node"), 0, 0
            while t.at[node, "feature"] >= 0:
                go = X[r["id"]][t.at[node, "feature"]] < t.at[node, "split"]
                node, depth = t.at[node, "left" if go else "right"], depth + 1
            total += depth + M._c(t.at[node, "size"])
        assert r["score"] == pytest.approx(2.0 ** -(total / 7 / M._c(64)), abs=1e-12)
