import inspect

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F

from tessera.llm import quality, simhash, substring
from tessera.llm.queries import REGISTRY
from tessera.session import materialize

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, docs):
    out, d = [docs], docs
    for _, f in P.STAGES:
        d = materialize(f(spark, d, SF), "test")
        out.append(d)
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in P.STAGES] == ["quality classifier", "SimHash near-dedup", "substring dedup",
                                        "mixing sources to target weights", "packing"]
    for d in stages[:-1]:
        assert d.columns == P.COLUMNS


def test_each_stage_does_what_its_operator_says(spark, stages):
    d0, d1, d2, d3, d4, d5 = stages
    ids = [sorted(r[0] for r in d.select("doc_id").collect()) for d in stages]
    assert set(ids[1]) < set(ids[0])
    assert ids[2] == sorted(r[0] for r in simhash.components(d1).select("component_id").distinct().collect())
    sub = substring.dedup_substrings(d2, [F.col("doc_id")]).collect()
    assert ids[3] == sorted(r["doc_id"] for r in sub if r["n_removed"] < r["n_words"] or not r["n_words"])
    assert d3.where(F.col("n_chars") != F.length("text")).count() == 0
    words = sum(r["n_words"] - r["n_removed"] for r in sub)
    n = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    assert d3.agg(F.sum(n)).first()[0] == words
    assert abs(d4.agg(F.sum(n)).first()[0] / words - 1.5) < 0.1 and set(ids[4]) <= set(ids[3])
    assert max(ids[4].count(i) for i in set(ids[4])) <= 2
    assert d5.agg(F.sum(F.when(F.col("start") == 0, 1))).first()[0] == d4.count()


def test_rejected_documents_score_low(spark, docs, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("crc32(cast(doc_id as string)) % 5 != 0")
    model = quality.fit(docs, labels.select("doc_id", F.col("quality").alias("label")))
    good = quality.score(docs, model, [F.col("doc_id")]).where("predicted = 1")
    assert sorted(map(tuple, good.select("doc_id").collect())) == sorted(map(tuple, stages[1].select("doc_id").collect()))


def test_run(spark, stages):
    assert sorted(map(tuple, P.run(spark, SF).collect())) == sorted(map(tuple, stages[-1].collect()))


def test_odd_and_empty_input(spark, odd, empty):
    for d in (odd, empty):
        for _, f in P.STAGES:
            d = materialize(f(spark, d, SF), "test")


def test_registered_queries():
    import __spark_entry__ as E
    names = [n for n in E.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in E.queries()
    assert set(REGISTRY) <= set(E.queries())
    assert all(len(inspect.signature(f).parameters) == 2 for f, _ in REGISTRY.values())
