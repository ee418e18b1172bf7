import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import sketch as S


def _brute(rows):
    rows = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        out[i] = (len(t), hashlib.sha256((t[:len(t) - half] + nxt[:half]).encode()).hexdigest(),
                  t[:len(t) - half] + nxt[:half], nxt)
    return out


@pytest.mark.parametrize("parts", [1, 4, 40])
def test_whole_table(spark, docs, texts, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = S.compare_neighbours(docs.repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    want = _brute([(i, t) for i, t, _, _ in texts])
    assert len(rows) == len(want)
    src = {i: t for i, t, _, _ in texts}
    for r in rows:
        n, sha, edited, nxt = want[r["doc_id"]]
        a, b, c = (S.sketch(x, {}) for x in (src[r["doc_id"]], edited, nxt))
        assert (r["n_chars"], r["edited_sha256"]) == (n, sha)
        assert (r["fingerprint"], r["edited_fingerprint"]) == (S.to_string(a), S.to_string(b))
        assert r["near_edited"] == S.resemblance(a, b) and r["near_next"] == S.resemblance(a, c)
    assert np.mean([r["near_edited"] for r in rows]) > 0.2 > np.mean([r["near_next"] for r in rows])


def test_estimates_against_exact_sets(texts):
    big = [(t, {tuple(t.encode().lower().split()[k:k + 5]) for k in range(len(t.split()) - 4)}) for _, t, _, _ in texts
           if len(t.split()) > 600]
    for (t, s), (u, v) in zip(big, big[1:]):
        mixed = t + " " + u
        m = {tuple(mixed.encode().lower().split()[k:k + 5]) for k in range(len(mixed.split()) - 4)}
        a, b = S.sketch(t, {}), S.sketch(mixed, {})
        assert abs(S.containment(a, b) - len(s & m) / len(s)) < 0.15
        assert abs(S.resemblance(a, b) - len(s & m) / len(s | m)) < 0.2


def test_merge_and_strings(texts):
    a, b = S.sketch(texts[0][1], {}), S.sketch(texts[1][1], {})
    merged = S.from_string(S.merge(S.to_string(a), S.to_string(b)))
    assert set(merged[1]) == set(a[1]) | set(b[1])
    assert S.to_string(S.from_string(S.to_string(a))) == S.to_string(a)


def test_odd_and_empty(odd, empty, spark):
    rows = S.compare_neighbours(odd).collect()
    assert len(rows) == odd.count()
    text = {r["doc_id"]: r["text"] or "" for r in odd.where("doc_id is not null").collect()}
    assert all(r["n_chars"] == len(text[r["doc_id"]]) for r in rows if r["doc_id"] is not None)
    assert S.compare_neighbours(empty).count() == 0
    one = spark.createDataFrame([(5, "abcd")], "doc_id long, text string")
    assert S.compare_neighbours(one).first()["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()
    same = spark.createDataFrame([(k, "a b c d e f") for k in range(9)], "doc_id long, text string")
    assert same.count() == 9 and S.compare_neighbours(same).select(F.countDistinct("fingerprint")).first()[0] == 1


def _shingles(t):
    w = t.lower().split()
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))}


@pytest.mark.parametrize("words, empty, zero, error", [((8, 20), 0.12, 0.12, 0.2), ((20, 50), 0.0, 0.0, 0.15)])
def test_short_texts_have_estimates(words, empty, zero, error):
    rng = np.random.default_rng(5)
    sk, est, exact = [], [], []
    for _ in range(600):
        n = int(rng.integers(*words))
        a, b = (" ".join(f"w{x}" for x in rng.integers(0, 10**6, n)) for _ in range(2))
        edited = " ".join(a.split()[:n - n // 4] + b.split()[:n // 4])  # most of the text stays
        x, y, s, u = S.sketch(a, {}), S.sketch(edited, {}), _shingles(a), _shingles(edited)
        sk.append(x)
        est.append(S.resemblance(x, y))
        exact.append(len(s & u) / len(s | u))
    est, exact = np.array(est), np.array(exact)
    assert np.mean([len(x[1]) == 0 for x in sk]) <= empty
    assert np.mean(est[exact > 0.3] == 0) <= zero
    assert np.sqrt(np.mean((est - exact) ** 2)) < error
