from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessera.llm.common import doc_crc
from tessera.llm.langid import SHIFT, learn_profiles, letter_table, ngram_counts, predict

def held():
    return doc_crc() % 4 == 2


def _grams(text):
    """1- to 3-grams of letters and word edges, counted one by one."""
    table = letter_table()
    s = [0]
    for ch in text:
        c = int(table[ord(ch)])
        if c or s[-1]:
            s.append(c)
    if s[-1]:
        s.append(0)
    out = Counter()
    for i, c in enumerate(s):
        if c:
            out[1, c] += 1
        if i + 1 < len(s) and (c or s[i + 1]):
            out[2, c << SHIFT | s[i + 1]] += 1
        if 0 < i < len(s) - 1 and c:
            out[3, s[i - 1] << 2 * SHIFT | c << SHIFT | s[i + 1]] += 1
    return out


def _code(n, c):
    return c | {1: 3 << 62, 2: 1 << 63, 3: 0}[n]


def test_ngrams_against_counting(texts):
    samples = [t for _, t, _, _ in texts[:40]] + ["", "12 !!", "a", "é\U0001f600z", "Ab  cd\n-x", "aaaa"]
    for t in samples:
        code, n = ngram_counts(t, letter_table())
        got = dict(zip(code.tolist(), n.tolist()))
        want = {_code(*k): v for k, v in _grams(t).items()} if any(letter_table()[ord(c)] for c in t) else {}
        assert got == want


def test_profiles_and_distances_against_brute_force(docs, texts):
    profiles = learn_profiles(docs, top=50)
    for lang in {x[2] for x in texts}:
        c = Counter()
        for _, t, lg, _ in texts:
            if lg == lang:
                c.update(_grams(t))
        best = sorted(((-n, int(np.uint64(_code(*k)).astype(np.int64))) for k, n in c.items()))[:50]
        assert profiles[lang] == [code for _, code in best]
    got = {r["doc_id"]: r for r in predict(docs, profiles, [F.col("doc_id")], top=50).collect()}
    for i, t, _, _ in texts[:30]:
        own = [c for _, c in sorted((-n, int(np.uint64(_code(*k)).astype(np.int64))) for k, n in _grams(t).items())[:50]]
        dist = {lg: sum(abs(p.index(c) - k) if c in p else 50 for k, c in enumerate(own)) for lg, p in profiles.items()}
        best = min(sorted(dist), key=dist.get)
        assert got[i]["lang_pred"] == best and abs(got[i]["score"] - (1 - dist[best] / (50 * len(own)))) < 1e-9


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = predict(docs, learn_profiles(docs.where(~held())), [F.col("doc_id"), F.col("lang"), held().alias("held_out")])
    rows = out.where("held_out").collect()
    assert len(rows) > 200 and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_and_empty(docs, odd, empty):
    profiles = learn_profiles(odd)
    assert set(profiles) == {"en", "de", "fr"}
    rows = predict(odd, profiles, [F.col("doc_id"), F.col("text")]).collect()
    assert len(rows) == odd.count()
    for r in rows:
        if not any(letter_table()[ord(c)] for c in r["text"] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in profiles
    assert learn_profiles(empty) == {}
    assert {r["lang_pred"] for r in predict(docs.limit(3), {}, [F.col("doc_id")]).collect()} == {"und"}
    assert predict(empty, profiles, [F.col("doc_id")]).count() == 0
