import math

import pytest
from pyspark.sql import functions as F

from tessera.llm.mixing import mix


def _targets(sizes, weights=(3, 1, 2), total=1.5, cap=2.0):
    """Water filling by hand over sources in code point order, null last."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), total * sum(sizes.values())
    while open_:
        share = left / sum(w[s] for s in open_)
        full = {s for s in open_ if share * w[s] > cap * sizes[s]}
        if not full:
            target |= {s: share * w[s] for s in open_}
            break
        for s in full:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def _check(df, out):
    rows = out.collect()
    words = df.select("source", F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("([^\\x20\\x09-\\x0D]+)")))
                      .alias("n")).collect()
    sizes = {}
    for r in words:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["n"]
    want = _targets(sizes)
    src = {r["doc_id"]: r["source"] for r in df.collect()}
    taken, largest = {}, {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        s = src[r["doc_id"]]
        assert r["source_size"] == sizes[s] and math.isclose(r["target"], want[s], rel_tol=1e-9, abs_tol=1e-9)
        taken[s] = taken.get(s, 0) + r["taken"]
        largest[s] = max(largest.get(s, 0), r["size"])
    for s in want:
        assert abs(taken[s] - want[s]) <= max(1, largest[s] / 2)
    return rows


def test_sources_meet_targets(docs):
    out = mix(docs)
    rows = _check(docs, out)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mix(docs.repartition(7)).collect()))  # reruns agree


def test_rates_are_exponentially_tilted(docs):
    rows = mix(docs).where("rate < 1.999 and size > 0").withColumn("src", F.col("source_size")).collect()
    by = {}
    for r in rows:
        by.setdefault((r["source_size"], r["target"]), []).append(math.log(r["rate"]) / r["size"])
    assert all(max(v) - min(v) < 1e-9 for v in by.values())  # one multiplier per source


def test_odd_rows(odd):
    out = mix(odd.where("doc_id is not null"), carry=["lang"])
    assert out.count() == odd.where("doc_id is not null").count()
    assert mix(odd).count() == odd.count()
    assert {r["taken"] for r in out.where("size = 0").collect()} == {0}


def test_empty(empty):
    assert mix(empty).count() == 0


def test_no_words(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [r["target"] for r in mix(df).collect()] == [0.0, 0.0]


@pytest.mark.parametrize("n", [1, 3])
def test_one_hot_cell(spark, n):
    """All documents of one size in one source: a third get a second copy."""
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.lit("s").alias("source"))
    out = mix(df, weights=[1] * n)
    assert out.agg(F.sum("taken")).first()[0] == 1800
