import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import substring


def _brute(rows, length=20):
    """(doc_id, n_words, n_removed, sha) by comparing every window with all earlier ones."""
    last = 1 << 63
    docs = {}
    for i, t in rows:
        docs.setdefault((last if i is None else i, t or ""), []).append(i)
    first = {}  # window -> ids where it came up before
    out = []
    import xxhash
    order = sorted(docs, key=lambda d: (d[0], np.array(xxhash.xxh64_intdigest(d[1].encode(), 42), dtype=np.uint64)
                                        .astype(np.int64)))
    # an equal text under a larger id repeats the first one; equal ids and texts are one document
    for d in order:
        w = d[1].encode().split()
        gone = [False] * len(w)
        for p in range(len(w) - length + 1):
            k = tuple(w[p:p + length])
            if k in first:
                gone[p:p + length] = [True] * length
            first.setdefault(k, d)
        left = [x for x, g in zip(w, gone) if not g]
        for i in docs[d]:
            out.append((str(i), len(w), len(w) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()))
    return sorted(out)


def _check(df, length=20, **more):
    got = substring.dedup_substrings(df, [F.col("doc_id")], length=length, **more).collect()
    want = _brute([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()], length)
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == want


def test_whole_table(docs):
    _check(docs)


def test_odd_and_empty(odd, empty):
    _check(odd)
    assert substring.dedup_substrings(empty, [F.col("doc_id")]).count() == 0


@pytest.mark.parametrize("hot", [20_000, 3])
@pytest.mark.parametrize("vocabulary", [2, 5, 400])
def test_repetitive_texts(spark, vocabulary, hot):
    """Few words: windows repeat within documents, overlap themselves and meet
    in every document; ``hot=3`` sends nearly all windows one by one."""
    rng = np.random.default_rng(vocabulary)
    passage = [f"p{k}" for k in range(70)]
    rows = []
    for i in range(60):
        w = [f"v{k}" for k in rng.integers(0, vocabulary, rng.integers(0, 120))]
        if i % 3 == 0:
            at = int(rng.integers(0, len(w) + 1))
            w[at:at] = passage[int(rng.integers(0, 20)):int(rng.integers(45, 70))]
        if i % 7 == 0:
            w = w + w + ["same"] * 45
        rows.append((i if i % 11 else None, " ".join(w)))
    _check(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot)


def test_automaton_against_sets():
    rng = np.random.default_rng(3)
    for size in (1, 2, 3, 9):
        sam, seen = substring.Automaton(4), set()
        for _ in range(40):
            w = rng.integers(0, size, rng.integers(0, 25)).tolist()
            want = []
            for p in range(len(w) - 3):
                k = tuple(w[p:p + 4])
                want.append(k in seen)
                seen.add(k)
            got = [False] * len(want)
            for a, b in sam.feed(w):
                got[a:b] = [True] * (b - a)
            assert got == want


def test_kept_text_keeps_its_white_space(spark):
    w = [f"w{k}" for k in range(30)]
    df = spark.createDataFrame([(1, " ".join(w)), (2, "a\n\tb " + " ".join(w[3:28]) + "\n c  d")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in substring.dedup_substrings(df, [F.col("doc_id")], with_text=True).collect()}
    assert rows[1]["kept"] == " ".join(w) and rows[2]["kept"] == "a\n\tb c  d" and rows[2]["n_removed"] == 25
