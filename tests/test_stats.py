import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.mode import modes
from tessera.functions.quantile import quantiles
from tessera.operators import preprocess as PP
from tessera.operators import profile as P
from tessera.operators.correlation import pearson, spearman


def one_col(spark, vals, name="x"):
    return spark.createDataFrame([(None if v is None else float(v),) for v in vals], f"{name} double")


def test_stats4(spark):
    r = P.describe_stats(one_col(spark, [1, 2, 3, 10]), ["x"]).first()
    assert r["skewness"] == pytest.approx(1.0182, abs=1e-4)
    assert r["kurtosis"] == pytest.approx(-0.7696, abs=1e-4)
    assert r["q1"] == 1.75 and r["q3"] == 4.75 and r["median"] == 2.5
    assert r["std"] == pytest.approx(4.0825, abs=1e-4)
    assert r["iqr"] == 3.0 and r["count"] == 4


def test_tied_mode_smallest(spark):
    df = one_col(spark, [3, 3, 1, 1, 7]).select(F.lit("x").alias("column"), F.col("x").alias("value"))
    assert modes(df, ["column"]).first()["mode"] == 1.0


@pytest.mark.parametrize("small_n", [10**9, 0])
def test_quantiles_match_numpy(spark, small_n):
    rng = np.random.default_rng(3)
    xs = np.concatenate([rng.exponential(5, 3000), np.full(1000, 2.0)])
    g = rng.integers(0, 3, len(xs))
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, xs)], "g int, value double")
    probs = [0, 0.1, 0.25, 0.5, 0.75, 0.99, 1]
    res = quantiles(df, ["g"], probs, accuracy=(10000 if small_n else 20), buckets=8, collect_rows=50)
    for k in range(3):
        assert np.allclose(res[(k,)], np.quantile(xs[g == k], probs), rtol=0, atol=1e-9)


def test_impute_even(spark):
    df = one_col(spark, [1, 3, 3, 1, None])
    get = lambda s: [r["x"] for r in PP.impute(df, ["x"], s).collect()][-1]
    assert get("mean") == 2.0 and get("median") == 2.0 and get("most_frequent") == 1.0
    assert PP.impute(df, ["x"], "drop").count() == 4


def test_constant_column(spark):
    df = one_col(spark, [5, 5, 5]).withColumn("y", F.col("x") * 2)
    for m in ["minmax", "standard", "robust"]:
        assert {r["x"] for r in PP.scale(df, ["x"], m).collect()} == {0.0}
    c = {(r["col_a"], r["col_b"]): r["corr"] for r in pearson(df, ["x", "y"]).collect()}
    assert c[("x", "y")] is None


def test_cap_keeps_null(spark):
    df = one_col(spark, [None, 1, 100, 2, 3, 2])
    out = [r["x"] for r in PP.cap_outliers(df, ["x"], "iqr").collect()]
    assert out[0] is None and max(v for v in out if v is not None) < 100


def test_bins_uniform_max_in_last_bin(spark):
    df = one_col(spark, [0, 1, 2, 3, 4, 5, 6, 7, 8, 10, None])
    out = [r["x_binned"] for r in PP.discretise(df, "x", 5, "uniform").collect()]
    assert out[-1] is None and out[-2] == 4.0 and out[0] == 0.0


def test_spearman_average_ranks(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 5.0), (4.0, 4.0), (None, 1.0)], "a double, b double")
    c = {(r["col_a"], r["col_b"]): r["corr"] for r in spearman(df, ["a", "b"]).collect()}
    ra = np.array([1, 2, 3, 4.0])
    rb = np.array([1.5, 1.5, 4, 3])
    assert c[("a", "b")] == pytest.approx(np.corrcoef(ra, rb)[0, 1])


def test_attribute_types(spark):
    df = spark.createDataFrame([(i, f"s{i % 3}", float(i)) for i in range(30)], "i int, s string, d double")
    t = {r["column"]: r["attribute_type"] for r in P.attribute_types(df).collect()}
    assert t == {"i": P.ATTR_DISCRETE, "s": P.ATTR_NOMINAL_LOW, "d": P.ATTR_CONTINUOUS}


def test_histogram_counts(spark):
    df = one_col(spark, list(range(10)))
    h = P.histogram(df, ["x"], 3).orderBy("bin").collect()
    assert [r["count"] for r in h] == [3, 3, 4] and math.isclose(h[0]["lo"], 0.0)


@pytest.mark.parametrize("ranges", [None, 1, 300])
def test_kendall_tau_b_bruteforce(spark, ranges):
    from tessera.operators.kendall import kendall_tau
    rng = np.random.default_rng(4)
    x = rng.integers(0, 15, 400).astype(float)
    y = (x + rng.integers(0, 10, 400)).astype(float)
    x[:100] = 3.0
    s = tx = ty = 0
    for i in range(len(x)):
        dx, dy = np.sign(x[i] - x[i + 1:]), np.sign(y[i] - y[i + 1:])
        s += (dx * dy).sum()
        tx += (dx != 0).sum()
        ty += (dy != 0).sum()
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "a double, b double")
    assert kendall_tau(df, "a", "b", ranges=ranges) == pytest.approx(s / np.sqrt(tx * ty), abs=1e-12)


def test_running_totals_over_many_ranges(spark):
    """Thousands of tiny ranges give the totals of one."""
    from tessera.functions.rank import running_totals
    rng = np.random.default_rng(8)
    vals = np.unique(np.round(rng.normal(0, 1, 3000), 4))
    w = rng.integers(1, 9, len(vals))
    df = spark.createDataFrame([(float(v), int(x)) for v, x in zip(vals, w)], "v double, w long")
    for ranges in (1, 7, 2000):
        got = {r["v"]: r["cum_w"] for r in running_totals(df, [], "v", ["w"], ranges=ranges).collect()}
        assert [got[float(v)] for v in vals] == np.cumsum(w).tolist()


def test_ranks_keep_large_ids_and_text_apart(spark):
    from tessera.functions.rank import avg_rank
    big = spark.createDataFrame([((1 << 53) + i,) for i in range(5)], "value long")
    assert sorted(r["rank"] for r in avg_rank(big, [], "value").collect()) == [1, 2, 3, 4, 5]
    text = spark.createDataFrame([(x,) for x in "baacb"], "value string")
    assert {r["value"]: r["rank"] for r in avg_rank(text, [], "value").collect()} == {"a": 1.5, "b": 3.5, "c": 5.0}
