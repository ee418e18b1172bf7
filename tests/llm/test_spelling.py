import zlib
from collections import Counter, defaultdict

import regex
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessera.llm import spelling

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def counts_by_hand(rows, min_len=6, min_count=5, m=199):
    out = Counter()
    for i, text in rows:
        for run in regex.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % m == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= min_len and n >= min_count}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def groups_by_hand(n, ratio=5):
    near = defaultdict(list)
    for a in n:
        for b in n:
            if a != b and one_edit(a, b):
                near[a].append(b)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def run(spark, n, ratio=5):
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    return sorted(tuple(r) for r in spelling.group_variants(df, ratio).select(COLUMNS).collect())


def test_whole_table(spark, docs, texts):
    by_hand = counts_by_hand([(r[0], r[1]) for r in texts])
    words = spelling.word_counts(docs, delete_one_in=199)
    assert dict(map(tuple, words.collect())) == by_hand
    assert sorted(tuple(r) for r in spelling.group_variants(words).select(COLUMNS).collect()) == groups_by_hand(by_hand)


def test_runs_of_one_letter_accents_and_chains(spark):
    n = {"aaaaaa": 5, "aaaaaaa": 30, "aaaaaaaa": 200, "abaaaa": 5, "aabaaa": 6, "naïveté": 100, "naivete": 3, "naivetée": 9,
         "naiveté": 20, "zoological": 7, "zoologicla": 7, "oological": 35, "xoological": 35, "zoologica": 1,
         "ünder": 5, "Ünder": 5, "under": 50, "a": 9, "b": 50, "": 1, "ab": 3, "ba": 4}
    assert run(spark, n) == groups_by_hand(n)


def test_long_words_take_few_levels(spark):
    base = "abcdefghij" * 40
    n = {base: 100, base[:390] + base[391:]: 5, base[:5] + "x" + base[6:]: 6, base[:33] + "xy" + base[35:]: 5,
         base + "q": 7, "q" + base: 8, base[:200] + "z" + base[200:]: 9, base[1:]: 4, base[:-1]: 3, base[:64]: 50,
         base[:65]: 5, base[:32]: 9, base[:31]: 90, base[:128] + "k": 4, base[:128]: 33, base[:127]: 2}
    assert run(spark, n) == groups_by_hand(n)
    assert len(spelling._levels(5_000)) < 45


@settings(max_examples=2, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.dictionaries(st.text("abé", max_size=9), st.integers(1, 200), min_size=30, max_size=80))
def test_dense_words(spark, n):
    assert run(spark, n, 2) == groups_by_hand(n, 2)


def test_odd_and_empty(spark, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    words = spelling.word_counts(odd, min_count=1, delete_one_in=2)
    by_hand = counts_by_hand(rows, min_count=1, m=2)
    assert dict(map(tuple, words.collect())) == by_hand and "word" in words.columns
    assert spelling.group_variants(spelling.word_counts(empty)).collect() == []
    assert [f.name for f in spelling.group_variants(spelling.word_counts(empty)).schema] == COLUMNS


def test_cut_texts_keep_runs_whole():
    from tessera.llm.common import runs
    text = b"abcdef  ghi jklmnop q " * 50
    pieces = list(runs(text, spelling.ANY, spelling.GAP, size=7))
    assert len(pieces) > 20 and [w for p in pieces for w in p] == text.split()
