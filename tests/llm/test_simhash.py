import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import simhash


def _fingerprint(text):
    w = (text or "").encode().split()
    w = [bytes(b + 32 if 65 <= b <= 90 else b for b in x) for x in w]
    if not w:
        return 0
    sh = [b" ".join(w[k:k + 4]) for k in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(values, bits):
    """Component number of each value, comparing all pairs."""
    v = np.array(values, dtype=np.uint64)
    comp = list(range(len(v)))
    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v ^ v[i]) <= bits).tolist():
            a, b = comp[i], comp[j]
            if a != b:
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    return comp


def _check(df, bits=4):
    rows = simhash.components(df, max_bits=bits).collect()
    src = df.select("doc_id", "text").collect()
    assert len(rows) == len(src)
    fp = [_fingerprint(r["text"]) for r in src]
    comp = _components(fp, bits)
    least = {}
    for r, c in zip(src, comp):
        if r["doc_id"] is not None:
            least[c] = min(least.get(c, r["doc_id"]), r["doc_id"])
    want = sorted((str(r["doc_id"]), f"{f:016x}", str(least.get(c))) for r, f, c in zip(src, fp, comp))
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in rows) == want


def test_whole_table(docs):
    _check(docs)


def test_odd_and_empty(odd, empty):
    _check(odd)
    assert simhash.components(empty).count() == 0


@pytest.mark.parametrize("bits,run,blocks", [(4, 1024, None), (4, 8, None), (2, 16, None), (4, 16, 7)])
def test_links_of_dense_groups(spark, monkeypatch, bits, run, blocks):
    """Dense groups around a few centres and scattered values; tiny runs make
    one prefix span many runs and tasks."""
    rng = np.random.default_rng(bits)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64) * np.uint64(2)
    vals = set(rng.integers(0, 1 << 63, 150, dtype=np.uint64).tolist())
    for c in centres.tolist():
        for _ in range(60):
            v = int(c)
            for b in rng.integers(0, 64, rng.integers(0, 7)).tolist():
                v ^= 1 << b
            vals.add(v)
    vals = sorted(vals)
    monkeypatch.setattr(simhash, "RUN", run)
    if blocks:
        from itertools import combinations
        edges = [round(64 * i / blocks) for i in range(blocks + 1)]
        cut = [(64 - edges[i + 1], edges[i + 1] - edges[i]) for i in range(blocks)]
        monkeypatch.setattr(simhash, "tables_for", lambda n, b: (cut, list(combinations(range(blocks), blocks - b))))
    signed = np.array(vals, dtype=np.uint64).astype(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "_fp long")
    got = simhash.fingerprint_links(df, bits).collect()
    at = {x: k for k, x in enumerate(signed)}
    comp = list(range(len(vals)))
    for r in got:
        assert bin((vals[at[r["src"]]] ^ vals[at[r["dst"]]])).count("1") <= bits
        a, b = comp[at[r["src"]]], comp[at[r["dst"]]]
        comp = [min(a, b) if c in (a, b) else c for c in comp]
    assert comp == _components(vals, bits)


def test_every_choice_of_blocks_is_a_permutation():
    x = np.array([1, 1 << 63, 0x0123456789ABCDEF, (1 << 64) - 1], dtype=np.uint64)
    for n in (100, 1 << 25, 1 << 33):
        cut, choices = simhash.tables_for(n, 4)
        assert sum(w for _, w in cut) == 64
        for c in choices:
            moves = simhash.layout(cut, c)
            g = simhash.gray_ranks(x, moves)
            assert (simhash._back(g ^ (g >> np.uint64(1)), moves) == x).all()


def test_keep_first(docs, odd):
    comp = simhash.components(docs)
    kept = simhash.keep_first(docs)
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == \
        sorted(r[0] for r in comp.select("component_id").distinct().collect())
    assert kept.columns == docs.columns
    k = simhash.keep_first(odd)
    assert k.count() == simhash.components(odd).select("component_root").distinct().count()
    assert k.where(F.col("doc_id") == 2).count() == 0  # equal text, larger id
