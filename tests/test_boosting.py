"""Boosting against a plain numpy version over all values."""

import numpy as np
import pytest

from tessera.operators import boosting as B


def brute(X, y, k, rounds, lr, depth):
    """Scores on the rows themselves; every value is a cut."""
    n, outs = len(X), 1 if k == 2 else k
    share = np.bincount(y, minlength=k) / n
    s = np.tile(np.log(share[1:] / (1 - share[1:])) if outs == 1 else np.log(share), (n, 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-s)) if outs == 1 else np.exp(s) / np.exp(s).sum(1, keepdims=True)
        step = np.zeros_like(s)
        for c in range(outs):
            r, h = (y == (1 if outs == 1 else c)) - p[:, c], p[:, c] * (1 - p[:, c])
            parts = [np.arange(n)]
            for _ in range(depth):
                nxt = []
                for idx in parts:
                    best = None
                    for f in range(X.shape[1]):
                        for v in np.unique(X[idx, f])[:-1]:
                            left = X[idx, f] <= v
                            a, b = r[idx][left], r[idx][~left]
                            gain = round(a.sum() ** 2 / len(a) + b.sum() ** 2 / len(b) - r[idx].sum() ** 2 / len(idx), 6)
                            if gain > 0 and (best is None or gain > best[0]):
                                best = (gain, idx[left], idx[~left])
                    nxt += [idx] if best is None else [best[1], best[2]]
                parts = nxt
            for idx in parts:
                step[idx, c] = lr * r[idx].sum() / h[idx].sum() * (1 if outs == 1 else (k - 1) / k)
        s = s + step
    p = 1 / (1 + np.exp(-s)) if outs == 1 else np.exp(s) / np.exp(s).sum(1, keepdims=True)
    return np.hstack([1 - p, p]) if outs == 1 else p


@pytest.mark.parametrize("k", [2, 3])
def test_matches_numpy(spark, monkeypatch, k):
    monkeypatch.setattr(B, "WRITE_EVERY", 2)
    rng = np.random.default_rng(k)
    X = np.round(rng.normal(size=(160, 3)), 1)
    y = ((X[:, 0] > 0).astype(int) + (X[:, 1] * X[:, 2] > .3)).clip(0, k - 1)
    df = spark.createDataFrame([(i, *map(float, r), int(c)) for i, (r, c) in enumerate(zip(X, y))],
                               "id long, a double, b double, c double, label int")
    model = B.boost_fit(df, ["a", "b", "c"], n_classes=k, n_estimators=3, learning_rate=0.5, max_depth=2, bins=256)
    got = {r["id"]: r for r in B.boost_predict(df, model).collect()}
    want = brute(X, y, k, 3, 0.5, 2)
    assert max(abs(np.array(got[i]["probability"]) - want[i]).max() for i in range(len(X))) < 1e-6
    assert all(got[i]["prediction"] == int(np.argmax(got[i]["probability"])) for i in got)


def test_bins_and_odd_rows(spark):
    long = spark.createDataFrame([(0, float(i)) for i in range(100)] + [(1, float(i % 3)) for i in range(100)], "feature int, value double")
    edges = B.bin_edges(long, 2, 4)
    assert edges[0].tolist() == [24, 49, 74] and edges[1].tolist() == [0, 1]
    df = spark.createDataFrame([(1.0, 0), (2.0, 1), (None, 1), (float("nan"), 0), (1.0, None), (2.0, 1)], "a double, label int")
    model = B.boost_fit(df, ["a"], n_estimators=2, learning_rate=1.0)
    out = B.boost_predict(df, model).collect()
    assert [(r["a"], r["prediction"]) for r in out] == [(1.0, 0), (2.0, 1), (1.0, 0), (2.0, 1)]
    none = B.boost_fit(df.where("label > 5"), ["a"], n_estimators=2)
    assert none["rounds"] == [] and B.boost_predict(df, none).first()["probability"] == [0.5, 0.5]
    same = B.boost_fit(df.where("a = 2"), ["a"], n_estimators=1, n_classes=2)  # one class, nothing to cut
    assert B.boost_predict(df, same).first()["prediction"] == 1


def test_naive_bayes_with_many_classes(spark):
    """Classes in several blocks against numpy; equal classes: the smaller label."""
    from tessera.operators import classify as C
    rng = np.random.default_rng(4)
    k, X = 600, rng.normal(size=(2400, 2))
    y = np.arange(2400) % k
    X[y == 7] = X[y == 599]  # two classes alike
    df = spark.createDataFrame([(i, *map(float, r), float(c)) for i, (r, c) in enumerate(zip(X, y))], "id long, a double, b double, label double")
    m = C.gaussian_nb_fit(df, ["a", "b"])
    assert m["k"] == k
    q = [5, 7, 599, 1207, 2399]
    got = {r["id"]: r for r in C.gaussian_nb_predict(df.where(df.id.isin(q)), m).collect()}
    var = np.array([X[y == c].var(0) for c in range(k)]) + 1e-9 * X.var(0).max()
    mean = np.array([X[y == c].mean(0) for c in range(k)])
    for i in q:
        jll = -np.log(k) - (0.5 * np.log(2 * np.pi * var) + (X[i] - mean) ** 2 / (2 * var)).sum(1)
        p = np.exp(jll - jll.max())
        assert np.allclose(got[i]["probability"], p / p.sum(), atol=1e-9) and got[i]["prediction"] == np.argmax(np.round(jll, 9))
    assert 599.0 not in {r["prediction"] for r in got.values()}
    with pytest.raises(ValueError):
        C.gaussian_nb_fit(df.where("id < 0"), ["a", "b"])
