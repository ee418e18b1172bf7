import numpy as np
from pyspark.sql import functions as F

from tessera.llm import quality
from tessera.llm.common import doc_crc

def held():
    return doc_crc() % 5 == 0


def test_interactions_by_pairs():
    """The sum-of-squares identity against the sum over all pairs."""
    rng = np.random.default_rng(0)
    n = quality.DIM + quality.N_STATS
    model = {"w0": 0.3, "w": rng.normal(size=n), "v": rng.normal(size=(n, quality.RANK)),
             "mean": np.zeros(quality.N_STATS), "std": np.ones(quality.N_STATS)}
    idx, val, stats = quality.features(b"Some words, some more words!\nand a line", {})
    x = np.concatenate((val, np.clip(stats, -5, 5)))
    i = np.concatenate((idx, quality.DIM + np.arange(quality.N_STATS)))
    slow = model["w0"] + x @ model["w"][i] + sum(
        model["v"][i[a]] @ model["v"][i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a + 1, len(i)))
    assert abs(quality.logits(model, idx, val, stats) - slow) < 1e-8


def test_held_out_accuracy_and_reruns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    train = labels.where(~held()).select("doc_id", F.col("quality").alias("label"))
    model = quality.fit(docs, train)
    again = quality.fit(docs.repartition(3), train.repartition(2))
    assert all(np.array_equal(model[k], again[k]) for k in model)
    rows = quality.score(docs, model, [F.col("doc_id"), held().alias("held_out")]).join(labels, "doc_id") \
        .where("held_out").collect()
    good = [r["score"] for r in rows if r["quality"] == 1]
    bad = [r["score"] for r in rows if r["quality"] == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    kept = quality.keep_good(docs, model)
    good_ids = sorted(r[0] for r in quality.score(docs, model, [F.col("doc_id")]).where("predicted = 1").select("doc_id").collect())
    assert sorted(r["doc_id"] for r in kept.collect()) == good_ids and kept.columns == docs.columns


def test_odd_rows(odd, empty, spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, 0), (7, 1), (None, 1), (8, None), (99, 1)], "doc_id long, label int")
    model = quality.fit(odd, labels)
    rows = quality.score(odd, model, [F.col("doc_id")]).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    by = {r["doc_id"]: r["score"] for r in rows}
    assert by[3] == by[4]  # a null text scores like an empty one
    assert quality.score(empty, model, [F.col("doc_id")]).count() == 0


def test_one_class_or_none(docs, spark):
    none = spark.createDataFrame([], "doc_id long, label int")
    assert quality.fit(docs, none)["w0"] == 0.0
    ones = docs.select("doc_id", F.lit(1).alias("label"))
    assert quality.score(docs, quality.fit(docs, ones), [F.col("doc_id")]).agg(F.min("score")).first()[0] > 0.9


def test_sample_bound(docs):
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("label"))
    a, b = quality.fit(docs, labels, sample=20), quality.fit(docs, labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(20))
    assert np.array_equal(a["w"], b["w"])
