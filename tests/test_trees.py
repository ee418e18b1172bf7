"""Exact trees against a recursive one."""

import math

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import classify as C
from tessera.operators import trees as T


def good(t, criterion):
    n = t.sum()
    if criterion == "gini":
        return float((t * t).sum() / n)
    return float(sum(x * math.log2(x / n) for x in t if x > 0))


def grow(x, y, w, k, depth, criterion, node=1, out=None):
    out = {} if out is None else out
    t = np.array([w[y == c].sum() for c in range(k)])
    out[node] = (None, None, tuple(t / t.sum()))
    if depth == 0 or t.max() == t.sum():
        return out
    best = None
    for f in range(x.shape[1]):
        vals = np.unique(x[:, f])
        for a, b in zip(vals, vals[1:]):
            left = x[:, f] <= a
            tl = np.array([w[left & (y == c)].sum() for c in range(k)])
            g = round(good(tl, criterion) + good(t - tl, criterion) - good(t, criterion), 9)
            if best is None or g > best[0]:
                best = (g, f, (a + b) / 2)
    if best is None:
        return out
    out[node] = (best[1], best[2], out[node][2])
    left = x[:, best[1]] <= best[2]
    grow(x[left], y[left], w[left], k, depth - 1, criterion, 2 * node, out)
    grow(x[~left], y[~left], w[~left], k, depth - 1, criterion, 2 * node + 1, out)
    return out


def data(spark, n=160, k=3, seed=3):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 9, n), rng.normal(size=n).round(1), rng.integers(0, 2, n)]).astype(float)
    y = ((x[:, 0] > 4).astype(int) + (x[:, 1] > 0.3) + (rng.random(n) < 0.1)).clip(0, k - 1)
    w = rng.integers(1, 4, n).astype(float)
    rows = [(i, *map(float, x[i]), int(y[i]), float(w[i])) for i in range(n)]
    return x, y, w, spark.createDataFrame(rows, "id long, a double, b double, c double, label int, w double")


def nodes_of(model):
    return {r["node"]: (r["feature"], r["cut"], tuple(r["proba"])) for r in model["nodes"].collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for n in want:
        assert got[n][0] == want[n][0] and (want[n][1] is None or abs(got[n][1] - want[n][1]) < 1e-12)
        assert np.allclose(got[n][2], want[n][2])


def test_every_value_is_a_cut(spark):
    x, y, w, df = data(spark)
    same(nodes_of(T.tree_fit(df, ["a", "b", "c"], max_depth=4)), grow(x, y, np.ones(len(y)), 3, 4, "gini"))
    model = T.tree_fit(df, ["a", "b", "c"], max_depth=3, criterion="entropy", weight="w")
    want = grow(x, y, w, 3, 3, "entropy")
    same(nodes_of(model), want)
    for r in T.tree_predict(df, model).collect():
        node, row = 1, (r["a"], r["b"], r["c"])
        while want[node][0] is not None:
            node = 2 * node + (row[want[node][0]] > want[node][1])
        assert np.allclose(r["probability"], want[node][2]) and r["prediction"] == int(np.argmax(want[node][2]))


def test_text_and_importances(spark):
    df = spark.createDataFrame([(1.0, 5.0, 0), (2.0, 5.0, 0), (3.0, 5.0, 1), (4.0, 1.0, 1), (4.0, 9.0, 0)], "a double, b double, label int")
    model = T.tree_fit(df, ["a", "b"], max_depth=5)
    lines = [r["line"] for r in T.tree_lines(model, class_names=["low", "high"]).orderBy("place").collect()]
    assert lines == ["|--- a <= 2.50", "|   |--- class: low", "|--- a > 2.50", "|   |--- b <= 7.00", "|   |   |--- class: high",
                     "|   |--- b > 7.00", "|   |   |--- class: low"]
    short = [r["line"] for r in T.tree_lines(model, max_depth=0).orderBy("place").collect()]
    assert short == ["|--- a <= 2.50", "|   |--- truncated branch", "|--- a > 2.50", "|   |--- truncated branch"]
    imp = {r["feature"]: r["importance"] for r in T.tree_importances(model).collect()}
    assert abs(sum(imp.values()) - 1) < 1e-12 and imp["a"] > 0 < imp["b"]


def test_forest(spark):
    x, y, _, df = data(spark, 400, 2, 5)
    model = T.forest_fit(df, ["a", "b", "c"], n_trees=8, max_depth=4, row_id="id")
    again = T.forest_fit(df.repartition(3), ["a", "b", "c"], n_trees=8, max_depth=4, row_id="id")
    key = ["tree", "node", "feature", "cut", "proba"]
    assert sorted(map(str, model["nodes"].select(key).collect())) == sorted(map(str, again["nodes"].select(key).collect()))
    got = T.tree_predict(df, model).collect()
    assert len(got) == 400 and np.mean([r["prediction"] == r["label"] for r in got]) > 0.85


def test_one_class_no_cut_and_missing(spark):
    one = spark.createDataFrame([(1.0, 0), (2.0, 0), (None, 0), (float("nan"), 0)], "a double, label int")
    assert list(nodes_of(T.tree_fit(one, ["a"], n_classes=2))) == [1]
    flat = spark.createDataFrame([(1.0, 0), (1.0, 1)], "a double, label int")
    model = T.tree_fit(flat, ["a"])
    assert [r["prediction"] for r in T.tree_predict(flat, model).collect()] == [0.0, 0.0]


def test_battery_uses_the_exact_tree(spark):
    *_, df = data(spark, 60, 2, 1)
    model, pr = C.fit_predict("dt", df, df, ["a", "b", "c"], "label", {"max_depth": 2}, keep=["id"], n_classes=2)
    assert pr.columns == ["id", "label", "prediction", "score"] and pr.count() == 60
    assert [f for f, _ in C.importances(model, ["a", "b", "c"])] and "|--- " in C.tree_text(model)
