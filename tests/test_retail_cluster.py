import datetime as dt

import pytest

from tessera.operators import cluster as K
from tessera.operators.retail import clean_retail, derive_rfm
from tessera.sources.csv import scan_csv, standardise_columns, write_csv


def test_elapsed_days_floor(spark):
    rows = [("1", "A1", dt.datetime(2020, 1, 1, 23, 59), 10.0),
            ("2", "A2", dt.datetime(2020, 1, 2, 0, 1), 5.0)]
    df = spark.createDataFrame(rows, "CustomerID string, InvoiceNo string, InvoiceDate timestamp_ntz, TotalPrice double")
    r = {x["CustomerID"]: x["Recency"] for x in derive_rfm(df).collect()}
    # snapshot = 2020-01-03 00:01; customer 1 bought 1 day 2 min earlier -> 1 whole day
    assert r == {"1": 1, "2": 1}


def test_clean_retail_edges(spark):
    rows = [("C1", 2.0, 1.0, 17850.0, "2020-01-01 10:00:00"), ("c2", 1.0, 1.0, 2.0, "bad"),
            (None, 1.0, 2.0, 3.0, "2020-01-01 10:00:00"), ("4", -1.0, 1.0, 4.0, "2020-01-01"),
            ("5", 1.0, 0.0, 5.0, "2020-01-01"), ("6", 1.0, 1.0, None, "2020-01-01")]
    df = spark.createDataFrame(rows, "InvoiceNo string, Quantity double, UnitPrice double, CustomerID double, InvoiceDate string")
    out = {r["CustomerID"]: r for r in clean_retail(df).collect()}
    assert set(out) == {"2", "3"}
    assert out["2"]["InvoiceDate"] is None and out["3"]["TotalPrice"] == 2.0


def test_standardise_and_csv_latin1(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_bytes(" Invoice ,Descrição,Unit Price,Customer ID\nC1,Café,1.5,17850.0\n".encode("latin-1"))
    df = scan_csv(spark, str(p), encoding="latin-1")
    s = standardise_columns(df)
    assert s.columns == ["InvoiceNo", "Descrição", "UnitPrice", "CustomerID"]
    assert s.first()["Descrição"] == "Café"
    write_csv(s, str(tmp_path / "out"))
    assert scan_csv(spark, str(tmp_path / "out")).count() == 1
    with pytest.raises(ValueError):
        standardise_columns(spark.createDataFrame([(1.0, 2.0)], "price double, unitprice double"))


def test_silhouette4(spark):
    df = spark.createDataFrame([(1, 0.0, 0), (2, 1.0, 0), (3, 5.0, 1), (4, 7.0, 1)], "id int, x double, l int")
    assert K.silhouette(df, "id", ["x"], "l") == pytest.approx(0.9113, abs=1e-4)


def test_kmeans_finds_blobs(spark):
    rows = [(i, float(i % 5) * 0.01 + (0 if i < 50 else 10), 0.0) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, x double, y double")
    lab, inertia, _ = K.kmeans(df, ["x", "y"], k=2, n_init=2, keep=["id"])
    groups = {r["id"] < 50: r["cluster"] for r in lab.collect()}
    assert len(set(groups.values())) == 2 and inertia < 1.0


def test_silhouette4_squared(spark):
    df = spark.createDataFrame([(1, 0.0, 0), (2, 1.0, 0), (3, 5.0, 1), (4, 7.0, 1)], "id int, x double, l int")
    assert K.silhouette_squared(df, ["x"], "l") == pytest.approx(0.9113, abs=1e-4)


def test_ids_keep_their_digits(spark):
    from pyspark.sql import functions as F
    from tessera.operators.retail import id_text
    big = spark.createDataFrame([(9007199254740993,), (9007199254740992,)], "c long")
    assert sorted(r[0] for r in big.select(id_text("c", big.schema["c"].dataType)).collect()) == ["9007199254740992", "9007199254740993"]
    text = spark.createDataFrame([("A12",), ("17850.0",), (" 7 ",), (None,), ("1.05",)], "c string")
    assert [r[0] for r in text.select(id_text("c", text.schema["c"].dataType)).collect()] == ["A12", "17850", "7", None, "1.05"]
    dbl = spark.createDataFrame([(17850.0,), (1.5,), (float("nan"),), (None,)], "c double")
    assert [r[0] for r in dbl.select(id_text("c", dbl.schema["c"].dataType)).collect()] == ["17850", "1.5", None, None]
    rows = spark.createDataFrame([("A12", 1.0, 2.0), (None, 1.0, 2.0)], "CustomerID string, Quantity double, UnitPrice double")
    assert [r["CustomerID"] for r in clean_retail(rows).collect()] == ["A12"]


@pytest.mark.parametrize("header,name", [
    ("Invoice", "InvoiceNo"), ("InvoiceDate", "InvoiceDate"), (" invoice date ", "InvoiceDate"), ("Stock Code", "StockCode"),
    ("Unit Price", "UnitPrice"), ("price", "UnitPrice"), ("Customer ID", "CustomerID"), ("COUNTRY", "Country"),
    ("Item Description", "Description"), ("quantity", "Quantity"), (" Notes ", "Notes"), ("InvoiceNo", "InvoiceNo")])
def test_canonical_headers(spark, header, name):
    df = spark.createDataFrame([(1,)], f"`{header}` int")
    assert standardise_columns(df).columns == [name]


def test_silhouette_samples_against_pairs(spark):
    """Per-row silhouette from cluster sums equals the one from all pairs."""
    import numpy as np
    rng = np.random.default_rng(0)
    X, lab = rng.normal(0, 1, (60, 3)), rng.integers(-1, 3, 60)
    lab[0] = 9  # a singleton
    df = spark.createDataFrame([(i, *map(float, x), int(c)) for i, (x, c) in enumerate(zip(X, lab))],
                               "id int, a double, b double, c double, l int")
    got = {r["id"]: r["silhouette"] for r in K.silhouette_samples(df, "id", ["a", "b", "c"], "l").collect()}
    D = ((X[:, None] - X[None]) ** 2).sum(-1)
    for i in range(60):
        own = lab == lab[i]
        if own.sum() == 1:
            assert got[i] == 0
            continue
        a = D[i, own].sum() / (own.sum() - 1)
        b = min(D[i, lab == o].mean() for o in set(lab.tolist()) - {lab[i]})
        assert got[i] == pytest.approx((b - a) / max(a, b), abs=1e-9)


def test_describe_every_type(spark):
    from tessera.operators.profile import describe_all
    df = spark.createDataFrame([(True, dt.date(1970, 1, 2), dt.datetime(1970, 1, 1, 0, 1), [1, 2]),
                                (True, None, dt.datetime(1970, 1, 1, 0, 3), [3]), (False, dt.date(1970, 1, 4), None, None)],
                               "b boolean, d date, t timestamp_ntz, a array<int>")
    r = {x["column"]: x for x in describe_all(df).collect()}
    assert (r["b"]["count"], r["b"]["unique"], r["b"]["top"], r["b"]["freq"]) == (3, 2, "true", 2)
    assert (r["d"]["count"], r["d"]["min"], r["d"]["max"]) == (2, 86400.0, 259200.0)
    assert r["t"]["mean"] == 120.0 and r["a"]["count"] == 2
    only_time = describe_all(df.select("t")).collect()
    assert len(only_time) == 1


def test_labels(spark):
    from tessera.operators.core import cluster_label, outlier_label
    df = spark.createDataFrame([(1, -1), (0, 2)], "f int, c int")
    assert [tuple(r) for r in df.select(outlier_label("f"), cluster_label("c")).collect()] == \
        [("Outlier", "Noise"), ("Normal", "Cluster 2")]


def test_shared_folder_is_required_on_a_cluster():
    from tessera.session import require_local
    for master in ("local", "local[4]", "local[*]"):
        require_local(master)
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(RuntimeError):
            require_local(master)


def test_many_classes_and_exact_split(spark):
    from pyspark.sql import functions as F
    from tessera.operators import classify as C
    df = spark.range(3000).select(F.col("id"), (F.col("id") % 300).alias("y"))
    d, k = C.encode_label(df, "y")
    assert k == 300 and d.where("label <> y").count() == 0
    s = C.train_test_split(df, "id", 0.3, 7, stratify="y").groupBy("y").agg(F.sum(F.col("is_test").cast("int")).alias("n"))
    assert {r["n"] for r in s.collect()} == {3}
    with pytest.raises(ValueError):
        C.make_estimator("dt", {"max_depth": 31})


def test_polynomial_kernel_map(spark):
    """The monomials' inner product is the kernel."""
    import numpy as np
    from pyspark.ml.functions import vector_to_array
    from tessera.operators.classify import _feature_map
    X = np.random.default_rng(1).normal(0, 1, (6, 3))
    df = spark.createDataFrame([tuple(map(float, x)) for x in X], "a double, b double, c double")
    for coef0 in (0.0, 1.5):
        fm = {"kind": "poly", "degree": 3, "gamma": 0.4, "coef0": coef0}
        Z = np.array([r[0] for r in _feature_map(df, ["a", "b", "c"], fm).select(vector_to_array("_z")).collect()])
        assert np.allclose(Z @ Z.T, (0.4 * X @ X.T + coef0) ** 3)


def test_itemsets_of_long_baskets(spark):
    """Forty items in every basket at low support: pairs only, no longer sets."""
    from pyspark.sql import functions as F
    from tessera.operators.rules import frequent_itemsets
    b = spark.range(200).select(F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: F.format_string("i%02d", i.cast("int"))).alias("items"))
    fi = frequent_itemsets(b, 0.01, 2)
    assert {r["length"]: r["count"] for r in fi.groupBy("length").count().collect()} == {1: 40, 2: 780}
    assert frequent_itemsets(b.limit(0), 0.01, 2).count() == 0


def test_grouped_quantiles(spark):
    import numpy as np
    from pyspark.sql import functions as F
    from tessera.functions.quantile import grouped_quantiles
    rng = np.random.default_rng(6)
    v = np.round(rng.normal(0, 2, 2000), 1)
    df = spark.createDataFrame([(int(i % 37), float(x)) for i, x in enumerate(v)], "k int, value double")
    got = {r["k"]: (r["a"], r["b"]) for r in grouped_quantiles(df, ["k"], [0.25, 0.9], ["a", "b"]).collect()}
    for k in range(37):
        assert got[k] == pytest.approx(tuple(np.quantile(v[k::37], [0.25, 0.9])))
