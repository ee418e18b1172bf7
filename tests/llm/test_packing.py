import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm.packing import best_pattern, cutting_stock, pack, sequences
from tessera.llm.queries import tokenizer


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))


def test_knapsack_against_enumeration():
    width, value = np.array([3, 4, 7]), np.array([2.0, 3.0, 5.5])
    best = max(a * 2 + b * 3 + c * 5.5 for a in range(3) for b in range(6) for c in range(4)
               if 3 * a + 4 * b + 7 * c <= 20)
    worth, pattern = best_pattern(width, value, 20, np.array([2, 5, 3]))
    assert worth == best and pattern @ width <= 20 and (pattern <= [2, 5, 3]).all()


@pytest.mark.parametrize("n", [1, 7, 300, 3_000])
def test_cutting_stock_meets_demand(n):
    r = np.random.default_rng(n).integers(1, 257, n)
    width, demand = np.unique(r, return_counts=True)
    out = cutting_stock(width, demand, 256)
    assert (sum(k * a for k, a in out) == demand).all() and all(a @ width <= 256 for _, a in out)
    rooms = []
    for x in sorted(r.tolist(), reverse=True):  # first-fit decreasing, item by item
        k = next((k for k, room in enumerate(rooms) if room >= x), None)
        if k is None:
            rooms.append(256 - x)
        else:
            rooms[k] -= x
    assert sum(k for k, _ in out) <= len(rooms) + 1


def _check(df, rows, reference, capacity=2048):
    want = {}
    for r in df.collect():
        ids = np.array([*reference.encode(r["text"] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for at in range(0, len(ids), capacity):
            p = ids[at:at + capacity]
            k = (r["doc_id"], at, len(p), zlib.crc32(p.tobytes()), len(ids))
            want[k] = want.get(k, 0) + 1
    got = {}
    for r in rows:
        k = (r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"])
        got[k] = got.get(k, 0) + 1
    assert got == want
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return seqs


def test_whole_table(docs, reference):
    rows = pack(docs, **tokenizer()).collect()
    seqs = _check(docs, rows, reference)
    total = sum(r["length"] for r in rows)
    assert len(seqs) <= total / 2048 * 1.03 + 1  # little padding even for 200 documents
    assert sorted(map(tuple, rows)) == sorted(map(tuple, pack(docs.repartition(3), **tokenizer()).collect()))


def test_odd_rows_keep_ids(odd, reference):
    p = pack(odd, **tokenizer(), with_ids=True)
    rows = p.collect()
    _check(odd, rows, reference)
    for s in sequences(p).collect():
        assert len(s["ids"]) == 4 * s["length"]


def test_empty(empty):
    assert pack(empty, **tokenizer()).count() == 0
