import numpy as np
from pyspark.sql import functions as F

from tessera.llm import toxicity
from tessera.llm.common import doc_crc


def held():
    return doc_crc() % 4 == 2


def test_interactions_by_pairs():
    rng = np.random.default_rng(0)
    model = {"w0": -1.0, "w": rng.normal(size=30), "v": rng.normal(size=(30, toxicity.RANK))}
    ids = [1, 4, 9, 20, 29]
    slow = model["w0"] + model["w"][ids].sum() + sum(model["v"][a] @ model["v"][b] for a in ids for b in ids if a < b)
    assert abs(toxicity.logit(model, ids) - slow) < 1e-9
    assert toxicity.logit(model, []) == -1.0


def test_held_out_accuracy_and_reruns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    train = labels.where(~held()).select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(docs, train)
    again = toxicity.fit(docs.repartition(3), train.repartition(2))
    assert all(np.array_equal(model[k], again[k]) for k in model)
    rows = toxicity.score(docs, model, [F.col("doc_id"), held().alias("held_out")]).join(labels, "doc_id").where("held_out").collect()
    toxic = np.array([r["score"] for r in rows if r["toxic"] == 1])
    clean = np.array([r["score"] for r in rows if r["toxic"] == 0])
    assert np.mean(toxic[:, None] > clean[None, :]) > 0.95
    assert (toxic >= 0.3).mean() > 0.85 and (clean >= 0.3).mean() < 0.01
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_pairs_that_additive_weights_miss(spark):
    """Toxic only where an insult meets a group: neither word alone tells."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(1_200):
        a, b = (int(x) for x in rng.random(2) < 0.3)
        words = [f"filler{rng.integers(50)}" for _ in range(12)] + ["vermin"] * a + ["martians"] * b
        rows.append((i, " ".join(words), int(a and b)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.fit(docs, docs.where("doc_id < 900"))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, model, [F.col("doc_id")]).collect()}
    assert np.mean([got[i] == y for i, _, y in rows[900:]]) > 0.97


def test_odd_rows(odd, empty, spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, 0), (7, 1), (None, 1), (8, None), (99, 1)], "doc_id long, label int")
    model = toxicity.fit(odd, labels)
    rows = toxicity.score(odd, model, [F.col("doc_id")]).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    by = {r["doc_id"]: r["score"] for r in rows}
    assert by[3] == by[4]  # a null text scores like an empty one
    assert toxicity.score(empty, model, [F.col("doc_id")]).count() == 0
    assert toxicity.fit(empty, labels)["w0"] == 0.0


def test_one_class_or_none(docs, spark):
    none = spark.createDataFrame([], "doc_id long, label int")
    assert toxicity.fit(docs, none)["w0"] == 0.0
    ones = docs.select("doc_id", F.lit(1).alias("label"))
    assert toxicity.score(docs, toxicity.fit(docs, ones), [F.col("doc_id")]).agg(F.min("score")).first()[0] > 0.9


def test_cut_texts_have_the_same_terms(monkeypatch):
    text = ("Ärger, naïve WORDS; x1y2z3 " * 40).encode()
    whole = toxicity.present(text, {})
    real = toxicity.runs
    monkeypatch.setattr(toxicity, "runs", lambda t, run, gap: real(t, run, gap, size=5))
    assert toxicity.present(text, {}) == whole
