import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm.common import doc_crc
from tessera.llm.ngram_lm import (START, TRIPLES, Block, _from_hashes, _from_ids, _from_rising, _hashes, _ids, _numbers,
                                  _read, _rising, discounts, hot_numbers, list_words, mapped, number_words, score)

def held():
    return doc_crc() % 10 == 0


def _model(rows):
    c, bi = Counter(), Counter()
    for w, train in rows:
        if train:
            c.update(w)
            bi.update(zip(["start", *w], w))
    n, v = sum(c.values()), len(c)
    ctx, followers, cont = Counter(), defaultdict(lambda: [0, 0, 0]), Counter()
    for (a, b), k in bi.items():
        ctx[a] += k
        followers[a][min(k, 3) - 1] += 1
        cont[b] += 1
    d2 = discounts(np.array([sum(k == x for k in bi.values()) for x in (1, 2, 3, 4)], float))
    d1 = discounts(np.array([sum(k == x for k in cont.values()) for x in (1, 2, 3, 4)], float))
    total = sum(cont.values())
    kinds = [sum(k == 1 for k in cont.values()), sum(k == 2 for k in cont.values()), sum(k >= 3 for k in cont.values())]
    left = sum(x * y for x, y in zip(d1, kinds)) / total if total else 1.0

    def one(w):
        k = cont[w]
        return (max(k - d1[min(k, 3) - 1], 0) / total if k else 0) + left / (v + 1)

    def two(a, w):
        if not ctx[a]:
            return one(w)
        k = bi[a, w]
        back = sum(x * y for x, y in zip(followers[a], d2)) / ctx[a]
        return (max(k - d2[min(k, 3) - 1], 0) / ctx[a] if k else 0) + back * one(w)

    return c, n, v, one, two


def _check(df, **more):
    got = score(df, ~held(), [F.col("doc_id"), held().alias("held_out")], **more).collect()
    rows = [(r["doc_id"], [*(r["text"] or "").encode().lower().split(), "end"],
             zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 10 != 0) for r in df.collect()]
    c, n, v, one, two = _model([(w, t) for _, w, t in rows])
    if n:
        assert math.isclose(sum(map(one, c)) + one("new"), 1, rel_tol=1e-9)
        a = c.most_common(1)[0][0]
        assert math.isclose(sum(two(a, w) for w in c) + two(a, "new"), 1, rel_tol=1e-9)
    want = sorted((str(i), not t, len(w), sum(c[x] > 0 for x in w), n,
                   round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 5),
                   round(sum(math.log10(two(a, b)) for a, b in zip(["start", *w], w)), 5)) for i, w, t in rows)
    out = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"],
                  round(r["base_score"], 5), round(r["score"], 5)) for r in got)
    for x, y in zip(out, want, strict=True):
        assert x[:5] == y[:5] and abs(x[5] - y[5]) < 1e-3 and abs(x[6] - y[6]) < 1e-3
    return got


@pytest.mark.parametrize("tokens", [3_000_000, 7_000])
def test_whole_table(docs, tokens):
    rows = _check(docs, block_tokens=tokens)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)  # better than the base on unseen texts


def test_odd_and_empty(odd, empty):
    _check(odd, block_tokens=20_000)
    assert score(empty, ~held(), [F.col("doc_id")]).count() == 0


def test_nothing_to_learn_from(docs):
    rows = score(docs.limit(5), F.lit(False), [F.col("doc_id")]).collect()
    assert len(rows) == 5 and all(r["train_tokens"] == r["n_known"] == 0 and r["score"] == 0 for r in rows)


def test_discounts_of_tiny_corpora():
    for n in ([0, 0, 0, 0], [5, 0, 0, 0], [0, 3, 1, 0], [100, 40, 20, 10]):
        d = discounts(np.array(n, float))
        assert all(0 < x < k for x, k in zip(d, (1, 2, 3)))


def test_mapped_arrays():
    a, b = np.arange(5), np.linspace(0, 1, 7)
    x, y, z = mapped([a, b, np.empty(0)])
    assert (x == a).all() and (y == b).all() and not len(z)


def test_word_numbers_are_distinct_and_hot_words_known():
    texts = [b"a a a b c", b"b d e f", b"g a"]
    buckets, words = 3, [b"a", b"b", START]
    hot = np.sort(np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64))
    asked = [r for k, t in enumerate(texts) for r in list_words([t], k, buckets)]
    got = {}
    for b in range(buckets):
        mine = [r for r in asked if r[0] == b]
        for to, src, _, a, *_ in number_words(mine, b, buckets, hot) if mine else ():
            h = _from_hashes(next(r[3] for r in mine if r[1] == to))
            for x, place in zip(h.tolist(), _from_ids(a).tolist()):
                assert got.setdefault(x, place * buckets + src) == place * buckets + src  # all blocks get the same
    assert len(set(got.values())) == len(got) == 9  # a to g, start and end
    assert sorted(got[xxhash.xxh64_intdigest(w)] for w in words) == sorted(hot_numbers(hot, buckets).tolist())


def test_lists_come_back():
    for x in ([], [0], [3, 200, 255, 256, 70_000, 2 ** 32 - 1]):
        x = np.array(x, np.uint64)
        assert (_from_ids(_ids(x)) == x).all() and (_read(_numbers(x)) == x).all()
        assert (_from_rising(_rising(x, 7), 7) == x).all()
        h = x << np.uint64(31)
        assert (_from_hashes(_hashes(h)) == h).all()


def test_lists_of_frequent_words_are_short(docs):
    """A list of triples costs far less than six bytes each; the texts' pieces and
    everything that follows had 7.5 times the input before words had numbers."""
    texts = [(r["text"] or "").encode() for r in docs.collect()]
    hot = np.empty(0, np.uint64)
    asked = list(list_words(texts, 0, 1))
    places = {src: a for _, src, _, a, *_ in number_words(asked, 0, 1, hot)}
    block = Block(texts, np.ones(len(texts), bool), 1, hot, places, 3)
    sent = sum(len(c) for _, _, kind, _, c, *_ in block.messages(0) if kind == TRIPLES)
    assert 0 < sent < 4 * len(block.triples)


def _three(rows):
    """Scores of order 3 by plain dictionaries: pairs count the distinct words
    before them, those of the start their occurrences."""
    c, tri, raw = Counter(), Counter(), Counter()
    for w, train in rows:
        if train:
            c.update(w)
            raw[w[0]] += 1
            tri.update(zip(["start", *w], w, w[1:]))
    bi, cont = Counter({("start", w): k for w, k in raw.items()}), Counter()
    for _, v, w in tri:
        bi[v, w] += 1
    for _, w in bi:
        cont[w] += 1

    def level(counts):
        ctx, kinds = Counter(), defaultdict(lambda: [0, 0, 0])
        for g, k in counts.items():
            ctx[g[:-1]] += k
            kinds[g[:-1]][min(k, 3) - 1] += 1
        d = discounts(np.array([sum(k == x for k in counts.values()) for x in (1, 2, 3, 4)], float))

        def p(g, lower):
            if not ctx[g[:-1]]:
                return lower
            k = counts[g]
            back = sum(x * y for x, y in zip(kinds[g[:-1]], d)) / ctx[g[:-1]]
            return (max(k - d[min(k, 3) - 1], 0) / ctx[g[:-1]] if k else 0) + back * lower

        return p

    one, two, three = level(Counter({(w,): k for w, k in cont.items()})), level(bi), level(tri)

    def prob(u, v, w):
        p = two((v, w), one((w,), 1 / (len(c) + 1)))
        return p if u is None else three((u, v, w), p)

    return c, prob


def _check_three(df, **more):
    got = {(str(r["doc_id"]), r["n_tokens"], round(r["score"], 3)) for r in
           score(df, ~held(), [F.col("doc_id")], order=3, **more).collect()}
    rows = [(r["doc_id"], [*(r["text"] or "").encode().lower().split(), "end"],
             zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 10 != 0) for r in df.collect()]
    c, prob = _three([(w, t) for _, w, t in rows])
    u, v = next((a, b) for _, w, t in rows if t and len(w) > 3 for a, b in zip(w, w[1:]))
    assert math.isclose(sum(prob(u, v, w) for w in c) + prob(u, v, "new"), 1, rel_tol=1e-9)
    want = {(str(i), len(w), sum(math.log10(prob(*g)) for g in zip([None, "start", *w], ["start", *w], w)))
            for i, w, _ in rows}
    for x, y in zip(sorted(got), sorted(want), strict=True):
        assert x[:2] == y[:2] and abs(x[2] - y[2]) < 2e-3


@pytest.mark.parametrize("tokens", [3_000_000, 7_000, 1_000])
def test_order_three_against_dictionaries(docs, tokens):
    _check_three(docs, block_tokens=tokens)


def test_order_three_odd_and_empty(odd, empty):
    _check_three(odd, block_tokens=20_000)
    assert score(empty, ~held(), [F.col("doc_id")], order=3).count() == 0
    nothing = score(odd, F.lit(False), [F.col("doc_id")], order=3).collect()
    assert all(r["train_tokens"] == 0 and r["score"] == 0 for r in nothing)
    with pytest.raises(ValueError):
        score(odd, ~held(), [F.col("doc_id")], order=4)


def test_more_context_predicts_better(docs):
    total = [sum(r["score"] for r in score(docs, ~held(), [held().alias("h")], order=k).where("h").collect())
             for k in (2, 3)]
    assert total[1] > total[0]
