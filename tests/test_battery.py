from pyspark.sql import functions as F

from tessera.operators import classify as C
from tessera.operators import metrics as M


def _rows(spark):
    rows = [(i, float(i % 17), float((i * 7) % 23), 1.0 if (i % 17) + (i * 7) % 23 > 20 else 0.0) for i in range(300)]
    return spark.createDataFrame(rows, "id long, a double, b double, label double").repartition(3, "id")


def _tasks_on(spark, df, use):
    """How often the rows of ``df`` are computed while ``use`` runs."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    use(df.mapInArrow(count, df.schema))
    return seen.value


def test_metrics_compute_the_predictions_once(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 1.0), (1.0, None)], "label double, prediction double")
    n = _tasks_on(spark, df, lambda d: M.classification_metrics(d).collect())
    assert n == 5
    assert _tasks_on(spark, df, lambda d: M.classification_report(d).collect()) == 5
    assert M.classification_metrics(df).first()["accuracy"] == 0.75  # the row without a prediction is left out
    report = {r["class"]: r for r in M.classification_report(df).collect()}
    assert report["accuracy"]["f1"] == 0.75 and report["accuracy"]["support"] == 5


def test_adaboost_keeps_a_rounds_rows_and_frees_them(spark):
    d = _rows(spark)
    passes = []
    for rounds in (1, 8):
        passes.append(_tasks_on(spark, d, lambda x: C.adaboost_fit(x, ["a", "b"], n_estimators=rounds)))
    assert passes[0] == passes[1]
    before = spark.sparkContext._jsc.sc().getRDDStorageInfo()
    m = C.adaboost_fit(d, ["a", "b"], n_estimators=8, checkpoint_every=3)
    assert len(spark.sparkContext._jsc.sc().getRDDStorageInfo()) == len(before)  # nothing stays behind
    assert len(m["stumps"]) == 8
    for every in (1, 100):  # where the lineage is cut changes nothing
        other = C.adaboost_fit(d, ["a", "b"], n_estimators=8, checkpoint_every=every)
        assert other["alphas"] == m["alphas"]
    pr = C.adaboost_predict(d, m)
    assert pr.columns == [*d.columns, "prediction", "score"]
    assert pr.where(F.col("prediction") == F.col("label")).count() > 270


def test_adaboost_rounds_read_kept_rows(spark, monkeypatch):
    from pyspark.ml.classification import DecisionTreeClassifier
    levels = []
    fit = DecisionTreeClassifier.fit
    monkeypatch.setattr(DecisionTreeClassifier, "fit", lambda self, d, *a: (levels.append(d.storageLevel.useMemory), fit(self, d, *a))[1])
    C.adaboost_fit(_rows(spark), ["a", "b"], n_estimators=4, checkpoint_every=3)
    assert levels and all(levels)
