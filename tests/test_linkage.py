"""Single linkage against Kruskal over all pairs."""

import numpy as np
import pytest

from tessera.operators.linkage import linkage_labels, linkage_table, single_linkage


def brute(ids, X, dist):
    """(merge table, labels(k)) over rows in id order."""
    order = np.argsort(ids)
    X, n = X[order], len(ids)
    pairs = sorted((dist(X[i], X[j]), i, j) for i in range(n) for j in range(i + 1, n))
    comp, members, table, steps = list(range(n)), {i: [i] for i in range(n)}, [], []
    for d, i, j in pairs:
        a, b = comp[i], comp[j]
        if a != b:
            both = members.pop(a) + members.pop(b)
            new = n + len(table)
            table.append((len(table), min(a, b), max(a, b), d, len(both)))
            members[new] = both
            for m in both:
                comp[m] = new
            steps.append((i, j))

    def labels(k):
        up = list(range(n))
        for i, j in steps[:max(0, n - k)]:
            a, b = up[i], up[j]
            up = [min(a, b) if u in (a, b) else u for u in up]
        names = {c: at for at, c in enumerate(sorted(set(up)))}
        return {int(sorted(ids)[i]): names[up[i]] for i in range(n)}

    return table, labels


def l2(a, b):
    return float(np.sqrt(sum((u - v) * (u - v) for u, v in zip(a, b))))


def l1(a, b):
    return float(sum(abs(u - v) for u, v in zip(a, b)))


def table_of(tree, block):
    return [tuple(r) for r in linkage_table(tree, block).orderBy("merge").collect()]


def frame(spark, ids, X):
    return spark.createDataFrame([(int(i), *map(float, r)) for i, r in zip(ids, X)],
                                 "id long, " + ", ".join(f"c{i} double" for i in range(X.shape[1])))


def blobs():
    rng = np.random.default_rng(11)
    X = np.concatenate([rng.normal(0, .3, (70, 2)), rng.normal(4, .3, (70, 2)), rng.uniform(-2, 6, (20, 2))])
    X = np.concatenate([X, X[:15], X[:5]])  # copies
    return rng.permutation(len(X)) * 3, X


def grid():
    X = np.array([(i, j) for i in range(12) for j in range(12)], float)  # ties everywhere
    return np.arange(len(X))[::-1], X


@pytest.mark.parametrize("make", [blobs, grid])
def test_tree_over_many_leaves(spark, make):
    """Leaves of 12 points force searches across leaves, blocks of 50 edges the halving of ranks."""
    ids, X = make()
    table, labels = brute(ids, X, l2)
    tree = single_linkage(frame(spark, ids, X), "id", ["c0", "c1"], leaf=12)
    assert table_of(tree, 50) == table
    for k in (1, 4):
        assert {r["id"]: r["cluster"] for r in linkage_labels(tree, k).collect()} == labels(k)


def test_far_groups_that_fill_their_leaves(spark):
    """Components without any foreign point in their leaves, manhattan, three features."""
    rng = np.random.default_rng(3)
    X = np.concatenate([rng.normal(m, .1, (40, 3)) for m in (0, 50, 120, 300)])
    ids = np.arange(len(X)) + 7
    table, labels = brute(ids, X, l1)
    tree = single_linkage(frame(spark, ids, X), "id", ["c0", "c1", "c2"], metric="manhattan", leaf=10)
    assert table_of(tree, 1000) == table
    assert {r["id"]: r["cluster"] for r in linkage_labels(tree, 4).collect()} == labels(4)


def test_small_and_odd(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0), (None, 1.0, 1.0), (3, float("nan"), 0.0), (4, 3.0, 4.0), (5, 0.0, 0.0), (6, float("inf"), 0.0)],
                               "id long, a double, b double")
    tree = single_linkage(df, "id", ["a", "b"])
    assert table_of(tree, 8) == [(0, 0, 2, 0.0, 2), (1, 1, 3, 5.0, 3)]
    assert {r["id"]: r["cluster"] for r in linkage_labels(tree, 2).collect()} == {1: 0, 4: 1, 5: 0}
    assert {r["id"]: r["cluster"] for r in linkage_labels(tree, 9).collect()} == {1: 0, 4: 1, 5: 2}
    none = single_linkage(df.where("id > 9"), "id", ["a", "b"])
    assert table_of(none, 8) == [] and linkage_labels(none, 3).count() == 0
    with pytest.raises(ValueError):
        linkage_labels(tree, 0)
    far = spark.createDataFrame([(i, 1e200 * (i % 2) + i, 0.0) for i in range(8)], "id long, a double, b double")
    with pytest.raises(ValueError):
        single_linkage(far, "id", ["a", "b"], leaf=2)


def test_tables_pass_by_the_driver(spark, monkeypatch):
    """No table of components or levels is broadcast."""
    from tessera.operators import graph, linkage
    plans = []
    for m in (graph, linkage):
        def seen(df, name="stage", run=m.materialize):
            if name in ("cc", "sl_level", "sl_names", "sl_ends", "sl_comp"):
                plans.append(df._jdf.queryExecution().sparkPlan().toString())
            return run(df, name)
        monkeypatch.setattr(m, "materialize", seen)
    ids, X = blobs()
    tree = single_linkage(frame(spark, ids, X), "id", ["c0", "c1"])
    want, labels = brute(ids, X, l2)
    got = table_of(tree, 40)
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want]
    assert {r["id"]: r["cluster"] for r in linkage_labels(tree, 4).collect()} == labels(4)
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
