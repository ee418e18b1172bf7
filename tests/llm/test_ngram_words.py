"""What op6 sends and sorts: texts split once, answers sent once, numbers sorted with their places."""
import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm.ngram_lm import (END, START, TO_BLOCKS, Block, _counted, add_up_pairs, add_up_pairs_of_triples,
                                  add_up_triples, list_words, narrow, number_words, order_of, pack_words, read_words,
                                  sort_places, split_words, unpack_words)

PARTS = ["a", "B", "bb", " ", "  ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x1f", "\x85", "\xa0", "é", "É", "\x00", ""]


def _texts(n=400, seed=3):
    r = random.Random(seed)
    return ["", " ", "\t\n", *("".join(r.choices(PARTS, k=r.randrange(40))) for _ in range(n))]


def _in_words(texts):
    return [t.encode().lower().split() for t in texts]


def test_words_are_those_of_bytes_split():
    texts = _texts()
    flat, sizes, words = split_words(pa.array(texts))
    words = words.cast(pa.binary()).to_pylist()
    assert len(set(words)) == len(words)
    got = np.split(np.array([words[k] for k in flat], object), np.cumsum(sizes)[:-1])
    assert [x.tolist() for x in got] == _in_words(texts)


@pytest.mark.parametrize("texts", [_texts(), [""], ["", " \t"], ["one"]])
def test_pieces_come_back_as_words(texts):
    """Blocks read numbered words, so no step but the first splits a text."""
    messages, sizes = [], []
    for part in (texts[:len(texts) // 2], texts[len(texts) // 2:]):
        if part:
            flat, n, words = split_words(pa.array(part, pa.string()))
            by = np.argsort(np.array(words.cast(pa.binary()).to_pylist(), object))
            rank = np.empty(len(by), np.int32)
            rank[by] = np.arange(len(by))
            messages.append(pack_words(rank[flat], words.take(pa.array(by))))
            sizes.append(n)
    got, want = unpack_words(messages, np.concatenate(sizes)), read_words([t.encode() for t in texts])
    assert (got.hashes == want.hashes).all() and (got.flat == want.flat).all() and (got.sizes == want.sizes).all()
    import xxhash
    h = [xxhash.xxh64_intdigest(w) for t in _in_words(texts) for w in (START, *t, END)]
    assert got.hashes[got.flat].tolist() == h


@pytest.mark.parametrize("top", [1, 7, 1 << 20, 1 << 33, (1 << 63) + 5])
def test_order_of_numbers(top):
    r = np.random.default_rng(5)
    x = r.integers(0, top, 3000, np.uint64)
    y = r.integers(0, min(top, 1 << 32), 3000, np.uint64)
    assert (x[order_of(x)] == np.sort(x)).all()
    order, want = order_of(x, y), np.lexsort((y, x))
    assert (x[order] == x[want]).all() and (y[order] == y[want]).all() and len(set(order.tolist())) == 3000
    z = x.copy()
    by = sort_places(z)
    assert (z == np.sort(x)).all() and (x[by] == z).all()
    assert not len(order_of(x[:0])) and not len(order_of(x[:0], y[:0]))


def test_pairs_are_counted():
    r = np.random.default_rng(6)
    a, b, n = r.integers(0, 30, 2000).astype(np.int32), r.integers(0, 9, 2000).astype(np.int32), r.random(2000) < 0.5
    count, at, place = _counted(a, b, 9, n)
    pairs = sorted(set(zip(a.tolist(), b.tolist())))
    assert list(zip(a[at].tolist(), b[at].tolist())) == pairs
    assert [pairs[k] for k in place] == list(zip(a.tolist(), b.tolist()))
    assert count.tolist() == [int(n[(a == x) & (b == y)].sum()) for x, y in pairs]


def test_counts_take_few_bytes():
    assert [narrow(np.array([0, k])).itemsize for k in (255, 256, 70_000)] == [1, 2, 4]
    assert not len(narrow(np.empty(0, np.uint32)))


@pytest.mark.parametrize("order", [2, 3])
def test_answers_go_straight_to_their_blocks(order):
    """Step 2 passes no answer on to step 3, and answers every list once."""
    r = random.Random(1)
    texts = [[" ".join(r.choices("abcdefghij", k=30)).encode() for _ in range(20)] for _ in range(3)]
    n, hot = len(texts), np.empty(0, np.uint64)
    asked = [row for k, t in enumerate(texts) for row in list_words(t, k, n)]
    named = [row for k in range(n) if (mine := [x for x in asked if x[0] == k]) for row in number_words(mine, k, n, hot)]
    blocks = [Block(t, np.ones(len(t), bool), n, hot, {x[1]: x[3] for x in named if x[0] == k}, order)
              for k, t in enumerate(texts)]
    rows = [row for k, b in enumerate(blocks) for row in b.messages(k)]
    step = add_up_pairs
    if order == 3:
        rows = [row for k in range(n) if (mine := [x for x in rows if x[0] == k]) for row in add_up_triples(mine, k, n, hot)]
        step = add_up_pairs_of_triples
    passed, answers = ([row for k in range(n) if (mine := [x for x in rows if x[0] == k]) for row in step(mine, k, n, a)]
                       for a in (False, True))
    assert passed and answers and not any(x[2] in TO_BLOCKS for x in passed) and all(x[2] in TO_BLOCKS for x in answers)
    assert {x[0] for x in answers} == set(range(n))
    assert len({x[:3] for x in answers}) == len(answers)
