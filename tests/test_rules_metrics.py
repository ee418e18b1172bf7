import math

import pytest

from tessera.operators import metrics as M
from tessera.operators import rules as R


def test_baskets4(spark):
    rows = [(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b"), (2, "c"), (3, "a"), (3, "b"), (4, "c")]
    df = spark.createDataFrame(rows, "t int, i string")
    b = R.build_baskets(df, "t", "i")
    fi = R.frequent_itemsets(b, 0.4, 3)
    sup = {", ".join(r["items"]): r["support"] for r in fi.collect()}
    assert sup == {"a": .75, "b": .75, "c": .75, "a, b": .75, "a, c": .5, "b, c": .5, "a, b, c": .5}
    rules = R.association_rules(fi, 0.0).collect()
    assert len(rules) == 12
    conv = {(", ".join(r["antecedents"]), ", ".join(r["consequents"])): r["conviction"] for r in rules}
    for k in [("a", "b"), ("b", "a"), ("a, c", "b"), ("b, c", "a")]:
        assert math.isinf(conv[k])
    st = R.basket_stats(b).first()
    assert st["transactions"] == 4 and st["unique_items"] == 3


def test_roc4_auc(spark):
    df = spark.createDataFrame([(0, .1), (0, .4), (1, .35), (1, .8)], "y int, s double")
    assert M.auc(df, "y", "s") == pytest.approx(0.75)
    pts = M.roc_curve(df, "y", "s").orderBy("fpr", "tpr").collect()
    area = sum((b["fpr"] - a["fpr"]) * (a["tpr"] + b["tpr"]) / 2 for a, b in zip(pts, pts[1:]))
    assert area == pytest.approx(0.75)


def test_metrics_binary_and_report(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0), (1, 1)], "label int, prediction int")
    m = M.classification_metrics(df).first()
    assert m["accuracy"] == pytest.approx(0.8)
    assert m["precision"] == pytest.approx(1.0) and m["recall"] == pytest.approx(2 / 3)
    rep = {r["class"]: r for r in M.classification_report(df).collect()}
    assert rep["macro avg"]["support"] == 5
    cm = {(r["label"], r["prediction"]): r["count"] for r in M.confusion(df).collect()}
    assert cm == {(0, 0): 2, (0, 1): 0, (1, 0): 1, (1, 1): 2}
